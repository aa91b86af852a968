"""Columns of numbers, shuffled as packed arrays.

Fingerprints come by the hundred for each text. As rows they would cost more than the
texts, so a task sends one row of packed arrays to each of the session's shuffle
partitions. The number of partitions grows with the input as usual, and with it the
number of parts; a part's arrays stay as small as any other partition.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of texts in each partition that are handled together; bounds what one task holds.
GROUPS = 2


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema(fields: dict[str, str]) -> str:
    """Spark schema of packed arrays; ``fields`` maps names to NumPy types."""
    return "part int, n int, " + ", ".join(f"{name} binary" for name in fields)


def arrow_schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("n", pa.int32()), *((name, pa.binary()) for name in fields)])


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of an array, compressed."""
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, kind: str, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if n else b"", kind)


def pack(parts: np.ndarray, columns: dict[str, np.ndarray], fields: dict[str, str]) -> pa.RecordBatch:
    """One row for each part, with its entries of all columns in their order."""
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(parts)]
    out: dict[str, list] = {name: [] for name in fields}
    for name, kind in fields.items():
        values = np.ascontiguousarray(columns[name], np.dtype(kind))[order]
        out[name] = [squeeze(values[a:b]) for a, b in zip(first, last, strict=False)]
    rows = [pa.array(parts[first], pa.int32()), pa.array(last[: len(first)] - first, pa.int32())]
    return pa.RecordBatch.from_arrays([*rows, *(pa.array(v, pa.binary()) for v in out.values())], schema=arrow_schema(fields))


def unpack(table: pa.Table | pa.RecordBatch, fields: dict[str, str]) -> dict[str, np.ndarray]:
    """The entries of all rows, one after another."""
    counts = table.column("n").to_pylist()
    out = {}
    for name, kind in fields.items():
        found = [expand(x, kind, n) for x, n in zip(table.column(name).to_pylist(), counts, strict=True)]
        out[name] = np.concatenate(found) if found else np.zeros(0, np.dtype(kind))
    return out


def gather(batches: Iterable[pa.RecordBatch], fields: dict[str, str]) -> dict[str, np.ndarray]:
    """The entries of a whole partition."""
    found = [unpack(b, fields) for b in batches if b.num_rows]
    if not found:
        return {name: np.zeros(0, np.dtype(kind)) for name, kind in fields.items()}
    return {name: np.concatenate([x[name] for x in found]) for name in fields}


def send(df: DataFrame) -> DataFrame:
    """Every row to the partition of its part."""
    return df.repartitionById(width(df.sparkSession), "part")


_PRIME, _FACTOR = (1 << 31) - 1, 48271


def group_of(key: Column, groups: int) -> Column:
    """The group of an id; `group_of_ids` gives the same for arrays of ids."""
    return F.pmod(F.pmod(key, F.lit(_PRIME)) * F.lit(_FACTOR).cast("bigint") % F.lit(_PRIME), F.lit(groups)).cast("int")


def group_of_ids(ids: np.ndarray, groups: int) -> np.ndarray:
    return (np.mod(ids.astype(np.int64), _PRIME) * _FACTOR % _PRIME % groups).astype(np.int32)

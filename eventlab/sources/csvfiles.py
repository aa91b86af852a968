"""CSV files whose headers differ, read by column name.

Spark maps a declared schema to the columns of a CSV by place. Landed files may have their columns in another
order, more of them, or fewer. So the header of every file is read first, files are grouped by where
their headers have the declared columns, and every group is one scan with its own column order.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Column of the scans with the path of a row's file, as Spark writes it.
FILE = "_file"


def headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file, header)``: the first line of every file that has one, blank lines aside.

    A pass over the files' text, in which a task keeps one line of each of its files and sends no more.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    first = lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    at = first.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return at.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def names(header: str) -> list[str]:
    """The column names of a header line, trimmed and in lower case."""
    return [c.strip().lower() for c in next(csv.reader([header.removeprefix("\ufeff")]), [])]


def places(header: str, schema: T.StructType) -> tuple[tuple[int | None, ...], int]:
    """Where the declared columns stand in a header, its first of that name, and how many columns it has."""
    have = names(header)
    return tuple(have.index(f.name.lower()) if f.name.lower() in have else None for f in schema), len(have)


def _readable(file: str) -> str:
    """A path of a file's metadata, for a reader: decoded, with the signs of patterns taken as they are."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _arranged(spark: SparkSession, path: str, schema: T.StructType, wanted: set[str], glob: str) -> dict[tuple, list[str]]:
    """Paths by arrangement of the declared columns: a folder all of whose files share one stands for them, whatever their
    number. Only different headers and such paths come to the driver."""
    found = stored(headers(spark, path, glob), "headers")
    ids: dict[tuple | None, int] = {None: 0}  # files without a required column
    of_header = []
    for row in found.select("header").distinct().collect():
        where, width = places(row["header"], schema)
        fits = all(where[i] is not None for i, f in enumerate(schema) if f.name.lower() in wanted)
        of_header.append((row["header"], ids.setdefault((where, width) if fits else None, len(ids))))
    if len(ids) == 1:
        return {}
    known = found.join(spark.createDataFrame(of_header, "header string, id int"), "header").select("file", "id")
    ends = found.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    # Every path between the first and the last begins as both do; below a pattern, folders may hold other files.
    shared = os.path.commonprefix([ends["low"], ends["high"]]).rpartition("/")[0]
    folders = not re.search(r"[*?\[\]{}]", path) and ends["low"] != ends["high"]
    parts = F.split(F.substring(F.col("file"), len(shared) + 1, 1 << 20), "/")
    within = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.concat(F.lit(shared), F.array_join(F.slice(parts, 1, i), "/")).alias("at")))
    own = F.struct(F.size(parts).alias("depth"), F.col("file").alias("at"))
    places_of = known.select("file", "id", F.explode(F.concat(within, F.array(own)) if folders else F.array(own)).alias("in")).select("file", "id", "in.*")
    pure = places_of.groupBy("at").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low = high").select("at")
    highest = places_of.join(pure, "at").groupBy("file").agg(F.min_by(F.struct("id", "at"), "depth").alias("top"))
    arrangements = {i: arrangement for arrangement, i in ids.items()}
    groups: dict[tuple, list[str]] = {}
    for row in highest.select("top.*").where("id > 0").distinct().collect():
        groups.setdefault(arrangements[row["id"]], []).append(row["at"])
    return groups


def scans(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), glob: str = "*") -> list[DataFrame]:
    """One scan for each arrangement of the declared columns, with those that its files have, and `FILE`.

    Files without a required column are left out; `files_without` names them. Other columns are not
    read. A scan is given whole folders where all their files have its arrangement.
    """
    groups = _arranged(spark, path, schema, {c.lower() for c in required}, glob)
    out = []
    for (where, width), files in sorted(groups.items(), key=lambda g: str(g[0])):
        fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
        for place, f in zip(where, schema, strict=True):
            if place is not None:
                fields[place] = f
        reader = spark.read.schema(T.StructType(fields)).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        present = [f.name for place, f in zip(where, schema, strict=True) if place is not None]
        out.append(reader.csv([_readable(f) for f in sorted(files)]).select(*present, F.col("_metadata.file_path").alias(FILE)))
    return out


def together(spark: SparkSession, parts: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """The scans as one table of the declared columns and `FILE`; what a file lacks is null."""
    whole = T.StructType([*schema.fields, T.StructField(FILE, T.StringType())])
    empty = spark.createDataFrame([], whole)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty).select(*whole.names)


def read_by_name(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), glob: str = "*") -> DataFrame:
    """All files below a path, or one file, as one table of the declared columns."""
    return together(spark, scans(spark, path, schema, required, glob), schema).drop(FILE)


def files_without(spark: SparkSession, path: str, required: Sequence[str], glob: str = "*") -> DataFrame:
    """``(file, header, missing)``: files that lack a required column. Empty files have no header and are not named."""
    have = F.transform(F.split(F.lower(F.regexp_replace("header", "[\ufeff\"]", "")), ","), F.trim)
    missing = F.array_except(F.array(*[F.lit(c.lower()) for c in required]), have)
    return headers(spark, path, glob).withColumn("missing", missing).where(F.size("missing") > 0)

"""Result types that mean the same to Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlab.functions.scalars import to_places

PLACES = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers to bigint."""
    columns = {}
    for field in df.schema:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            columns[field.name] = to_places(F.col(field.name), PLACES)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            columns[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(columns) if columns else df


def r6(expression: str, alias: str | None = None) -> str:
    """SQL for the same rounding."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6" + (f" AS {alias or expression}")


def r6_all(*columns: str) -> str:
    return ", ".join(r6(c) for c in columns)

"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def change(new: Column, old: Column) -> Column:
    """Relative change; NULL where the base is zero."""
    return F.try_divide(new - old, old)


def to_places(value: Column, places: int) -> Column:
    """Round half up by plain arithmetic: exact on every engine, never -0.0, and cheap."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / scale


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating point column.

    Spark orders NaN above all numbers, so one NaN would pass every ``>`` filter.
    """
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def add_business_days(date: Column, days: Column | int) -> Column:
    """``date`` moved forward by Monday-to-Friday days, without holidays.

    A weekend date counts as the Friday before it.
    """
    days = F.lit(days) if isinstance(days, int) else days
    weekday = F.weekday(date)
    working = F.least(weekday, F.lit(4))
    weekends = F.floor((working + days) / 5).cast("int")
    return F.date_add(F.date_sub(date, weekday - working), days + 2 * weekends)


def bin_edges(bins: int) -> list[float]:
    """Equal-width edges of [0, 1] as step multiples, which is how linspace builds them."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def probability_bin(probability: Column, bins: int) -> Column:
    """0-based bin; an edge belongs to the bin it opens, and 1.0 to the last bin."""
    inner = F.array(*[F.lit(e) for e in bin_edges(bins)[1:-1]])
    return F.size(F.filter(inner, lambda edge: edge <= probability))


def clean_ticker(ticker: Column) -> Column:
    """Share classes are written with a hyphen (X.B -> X-B); blanks become NULL."""
    dashed = F.replace(F.trim(ticker), F.lit("."), F.lit("-"))
    return F.nullif(dashed, F.lit(""))


def lookup_ticker(ticker: Column) -> Column:
    """How a ticker typed by a user is looked up."""
    return F.upper(F.trim(ticker))


def hash_int(*parts: Column) -> Column:
    """A 60-bit number from md5, the same on every engine and for every partitioning."""
    return digest_part(digest(*parts), 0, 15)


def digest(*parts: Column) -> Column:
    """The md5 of the parts as hexadecimal digits."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def digest_part(digits: Column | str, i: int, width: int) -> Column:
    """The i-th number of ``width`` digits in a digest, from 0; 15 digits at most."""
    return F.conv(F.substring(digits, 1 + width * i, width), 16, 10).cast("bigint")


def run_id(timestamp: Column) -> Column:
    """Sortable run id: UTC time and six random hex digits."""
    return F.concat(F.date_format(timestamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.uuid(), 1, 6))


def pivot_struct(names: list[str], values: list[Column]) -> Column:
    """``map<string,double>`` from parallel names and values."""
    pairs: list[Column] = []
    for name, value in zip(names, values):
        pairs += [F.lit(name), value.cast("double")]
    return F.create_map(*pairs)

"""Column expressions: missing values, time numbers, distinct counts, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def missing(df: DataFrame, name: str) -> Column:
    """Null or, in floating columns, NaN."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)) else c.isNull()


def n_missing(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.sum(missing(df, name).cast("bigint")), F.lit(0).cast("bigint"))


def n_unique(name: str) -> Column:
    """Distinct values, null counted as one of them."""
    return F.count_distinct(F.col(name)) + F.coalesce(F.max(F.col(name).isNull().cast("bigint")), F.lit(0))


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without time zone, or a date (the session runs in UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def time_number(df: DataFrame, name: str) -> Column:
    """The time column as a number to subtract and compare: microseconds, or the number itself."""
    return micros(F.col(name)) if is_time(dtype(df, name)) else F.col(name)


def from_number(c: Column, unit: str = "us") -> Column:
    """A number since the epoch in the unit s, ms, us or ns as a timestamp."""
    if unit not in {"s", "ms", "us", "ns"}:
        raise ValueError("unit must be one of s, ms, us, ns")
    whole = {"s": c * 1_000_000, "ms": c * 1_000, "us": c, "ns": F.floor(c / 1_000)}[unit]
    return F.timestamp_micros(whole.cast("bigint"))


def parse_time(c: Column, pattern: str | None = None) -> Column:
    """A text as a timestamp, null if it is none."""
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def quarter_start(year: Column, quarter: Column) -> Column:
    """The first day of a quarter."""
    return F.make_date(year.cast("int"), ((quarter - 1) * 3 + 1).cast("int"), F.lit(1))


def sum_horizontal(*cols: Column) -> Column:
    """Sum over columns of one row; nulls count as zero."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0))
    return out


def clean_category(c: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(F.upper(c), F.lit(unknown))


def number_from_text(c: Column) -> Column:
    """A text as a double without its first comma; null if it is no number."""
    return F.regexp_replace(c, "^([^,]*),", "$1").try_cast("double")

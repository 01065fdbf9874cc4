"""Checks and conversions of time-series tables.

Declared types are judged without a job.  What needs data (texts that should be numbers or times, missing values, empty tables)
goes into one fused aggregate however many columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.errors import TimeColumnError
from tempora.functions import exprs as E

#: Distances between neighbours that an equidistant series may have.
MAX_STEPS = 1


def is_empty(df: DataFrame) -> bool:
    """No columns or no rows."""
    if df is None:
        raise ValueError("DataFrame cannot be None.")
    return not df.columns or df.isEmpty()


def _require(df: DataFrame, names: list[str]) -> None:
    for n in names:
        if n not in df.columns:
            raise ValueError(f"Column '{n}' not found")


def missing_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the number of nulls and NaNs of each column, in one pass."""
    _require(df, names)
    return df.agg(*[E.n_missing(df, n).alias(n) for n in names])


def count_missing(df: DataFrame, names: list[str]) -> dict[str, int]:
    if is_empty(df):
        raise ValueError("Empty DataFrame provided.")
    return missing_counts(df, names).first().asDict()


def _bad_texts(name: str, to: str) -> F.Column:
    c = F.col(name)
    cast = c.try_cast("double") if to == "double" else F.try_to_timestamp(c)
    return F.coalesce(F.sum((c.isNotNull() & cast.isNull()).cast("bigint")), F.lit(0).cast("bigint"))


def castable_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: for each column how many values are no number and how many are no time."""
    out = []
    for n in names:
        out += [_bad_texts(n, "double").alias(f"{n}_not_number"), _bad_texts(n, "timestamp").alias(f"{n}_not_time")]
    return df.agg(*out)


def check_number_or_time(df: DataFrame, name: str) -> None:
    """Raise unless the column is numeric, a time, or a text that is wholly one of them."""
    t = E.dtype(df, name) if name in df.columns else None
    if t is not None and (E.is_number(t) or E.is_time(t) or isinstance(t, T.BooleanType)):
        return
    if isinstance(t, T.StringType):
        r = castable_counts(df, [name]).first()
        if not r[0] or not r[1]:
            return
    raise ValueError(f"Column '{name}' is neither numeric nor datetime.")


def check_features(df: DataFrame, time_col: str | None = None) -> None:
    """Raise for the first column, the time column left out, that is not numeric."""
    if time_col is not None and time_col not in df.columns:
        raise TimeColumnError(f"Time column '{time_col}' not found")
    names = [n for n in df.columns if n != time_col]
    texts = [n for n in names if isinstance(E.dtype(df, n), T.StringType)]
    bad = df.agg(*[_bad_texts(n, "double").alias(n) for n in texts]).first().asDict() if texts else {}
    for n in names:
        t = E.dtype(df, n)
        if bad.get(n) or not (n in texts or E.is_number(t) or isinstance(t, T.BooleanType)):
            raise ValueError(f"Column '{n}' must be numeric")


def duplicate_times(df: DataFrame, time_col: str, id_col: str | None = None) -> DataFrame:
    """Times (of an entity) that occur more than once, with their number; null times are never duplicates."""
    keys = [id_col, time_col] if id_col else [time_col]
    return df.groupBy(*keys).agg(F.count(time_col).alias("n")).where("n > 1")


def step_counts(df: DataFrame, time_col: str, id_col: str | None = None) -> DataFrame:
    """Number of distinct distances between neighbours, per entity or over all.

    Without an entity the order is global; operators.order.lead_in_order keeps it in many tasks.
    """
    from tempora.operators.order import lead_in_order

    t = df.select(*([id_col] if id_col else []), E.time_number(df, time_col).alias("_t"))
    if id_col:
        nxt = t.withColumn("_n", F.lead("_t").over(Window.partitionBy(id_col).orderBy(F.col("_t").asc_nulls_first())))
    else:
        nxt = lead_in_order(t, "_t", 1, "_t", "_n")
    steps = nxt.where(F.col("_n").isNotNull()).withColumn("_d", F.col("_n") - F.col("_t"))
    # distinct first: the rows of one entity are never gathered in one place
    d = steps.select(*([id_col] if id_col else []), "_d").distinct()
    return d.groupBy(id_col).agg(F.count("*").alias("n_steps")) if id_col else d.agg(F.count("*").alias("n_steps"))


def check_order(df: DataFrame, time_col: str, id_col: str | None = None, equidistant: bool = False) -> None:
    """Raise for repeated times (within an entity) and, if asked, for more than one distance between neighbours."""
    check_number_or_time(df, time_col)
    if id_col is not None and id_col not in df.columns:
        raise ValueError(f"ID column '{id_col}' not found in DataFrame")
    within = " within groups" if id_col else ""
    if not duplicate_times(df, time_col, id_col).isEmpty():
        raise TimeColumnError(f"Duplicate timestamps found{within} in {time_col}")
    if equidistant and not step_counts(df, time_col, id_col).where(F.col("n_steps") > MAX_STEPS).isEmpty():
        raise TimeColumnError(f"Irregular time sampling found{within} in {time_col}")


def sort_time(df: DataFrame, time_col: str, ascending: bool = True) -> DataFrame:
    """Rows by time, nulls first either way."""
    _require(df, [time_col])
    check_number_or_time(df, time_col)
    c = F.col(time_col)
    return df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_first())


def time_to_micros(df: DataFrame, time_col: str) -> DataFrame:
    """The time column as double microseconds; numeric columns stay."""
    t = E.dtype(df, time_col)
    if E.is_number(t):
        return df
    if not E.is_time(t):
        raise TimeColumnError(f"Column '{time_col}' is not a datetime column, cannot convert to numeric.")
    return df.withColumn(time_col, E.micros(F.col(time_col)).cast("double"))


def time_to_number(df: DataFrame, time_col: str, unit: str = "us") -> DataFrame:
    """The time column since the epoch: us and ms as doubles, ns as bigint; numeric columns stay."""
    _require(df, [time_col])
    if unit not in {"us", "ms", "ns"}:
        raise ValueError("unit must be one of us, ms, ns")
    if is_empty(df):
        raise ValueError("Empty DataFrame provided.")
    if unit == "us" or E.is_number(E.dtype(df, time_col)):
        return time_to_micros(df, time_col)
    if not E.is_time(E.dtype(df, time_col)):
        raise TimeColumnError(f"Column '{time_col}' is not a datetime column, cannot convert to numeric.")
    c = F.col(time_col)
    return df.withColumn(time_col, F.unix_millis(c.cast("timestamp")).cast("double") if unit == "ms" else E.micros(c) * 1000)


def to_time(df: DataFrame, time_col: str, unit: str = "us", pattern: str | None = None) -> DataFrame:
    """The column as a timestamp: numbers since the epoch in the unit, texts parsed; anything else is an error."""
    if time_col not in df.columns:
        raise TimeColumnError(f"Time column '{time_col}' not found")
    t, c = E.dtype(df, time_col), F.col(time_col)
    if E.is_time(t):
        return df
    if E.is_number(t):
        return df.withColumn(time_col, E.from_number(c, unit))
    if isinstance(t, T.StringType):
        parsed, number = E.parse_time(c, pattern), c.try_cast("double")
        bad = df.agg(*[F.sum((c.isNotNull() & x.isNull()).cast("bigint")) for x in (parsed, number)]).first()
        if not bad[0]:
            return df.withColumn(time_col, parsed)
        if not bad[1]:
            return df.withColumn(time_col, E.from_number(number, unit))
    raise TimeColumnError(f"Column '{time_col}' must be string or numeric to convert to datetime")


def convert_time(df: DataFrame, time_col: str, conversion: str | None = None) -> DataFrame:
    """Check the time column (None) or convert it to "numeric" or "datetime"."""
    if time_col not in df.columns:
        raise TimeColumnError(f"Time column '{time_col}' not found")
    if conversion not in {None, "numeric", "datetime"}:
        raise ValueError("conversion must be 'numeric', 'datetime' or None")
    if conversion == "numeric":
        return time_to_micros(df, time_col)
    if conversion == "datetime":
        return to_time(df, time_col)
    check_number_or_time(df, time_col)
    return df

"""Padding a table to a length with rows of column means or of a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import checks
from tempora.operators.order import global_index


def _pad(df: DataFrame, rows: DataFrame, target_len: int, padding: str, order: str | None, ties: tuple[str, ...]) -> DataFrame:
    if padding not in {"pre", "post"}:
        raise ValueError("Padding must be 'pre' or 'post'")
    if df.isEmpty():
        raise ValueError("Empty DataFrame provided.")
    n = df.count()
    if target_len <= n:
        raise ValueError(f"Target length must be greater than {n}")
    k = target_len - n
    own = global_index(df, order, ties, "_seq") if order else df.withColumn("_seq", F.lit(None).cast("bigint"))
    names = df.columns
    own = own.select(*[F.col(c).cast("double") for c in names], "_seq")
    # the single row of values is repeated by a generator
    start = F.lit(n) if padding == "post" else F.lit(-k)
    more = rows.withColumn("_seq", F.explode(F.sequence(start.cast("bigint"), (start + k - 1).cast("bigint"))))
    return own.unionByName(more.select(*names, "_seq"))


def mean_fill_pad(df: DataFrame, target_len: int, padding: str = "post", order: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df as doubles with rows of column means after it (post) or before (pre), and _seq: rows by `order` are 0.., pads follow or are negative."""
    missing = checks.missing_counts(df, df.columns).first().asDict()
    if any(missing.values()):
        raise ValueError("Cannot process data containing null values")
    return _pad(df, df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in df.columns]), target_len, padding, order, ties)


def constant_pad(df: DataFrame, target_len: int, value: float = 0.0, padding: str = "post", order: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """As mean_fill_pad with a constant; missing values stay."""
    return _pad(df, df.agg(*[F.max(F.lit(float(value))).alias(c) for c in df.columns]), target_len, padding, order, ties)

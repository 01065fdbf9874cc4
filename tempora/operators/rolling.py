"""Group statistics, rolling means and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import exprs as E
from tempora.operators.order import means_in_order


def group_metrics(df: DataFrame, by: str, value: str, time_col: str | None = None) -> DataFrame:
    """Per group: mean, sample standard deviation, count, missing, and first and last time."""
    out = [F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.count(value).alias("n_value"), E.n_missing(df, value).alias("n_missing")]
    if time_col:
        out += [F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time")]
    return df.groupBy(by).agg(*out)


def frequency_span(df: DataFrame, by: str, time_col: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"), F.count(time_col).alias("n"))


def rolling_mean(df: DataFrame, value: str, size: int, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last `size` rows, null until there are so many or if one of them is null.

    Without `by` the rows form one sequence in the order given, across groups; chunks of it are handled side by side.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
        return df.withColumn(name, F.when(F.count(value).over(w) == size, F.avg(value).over(w)))
    return means_in_order(df, value, size, [F.col(f"`{c}`").asc_nulls_first() for c in order], name)


def mean_impute(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values replaced by the column's mean (one pass for all columns)."""
    valid = {n: F.when(~E.missing(df, n), F.col(n).cast("double")) for n in names}
    means = df.agg(*[F.avg(c).alias(n) for n, c in valid.items()]).first().asDict()
    return df.withColumns({n: F.coalesce(c, F.lit(means[n])) for n, c in valid.items()})


def count_in(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.where(F.col(name).isin(values)).agg(F.count("*").alias("n"))

"""Synthetic series, made by the executors from a range of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.order import global_index


def _check(num_samples: int, num_features: int, null_percentage: float, nan_percentage: float, mode: str) -> None:
    if num_samples < 0 or num_features < 0:
        raise ValueError("num_samples and num_features must be non-negative")
    if mode != "single_target":
        raise ValueError(f"Unsupported mode: {mode}")
    for name, x in (("null_percentage", null_percentage), ("nan_percentage", nan_percentage)):
        if not 0 <= x <= 1:
            raise ValueError(f"{name} must be between 0 and 1")


def time_series(spark: SparkSession, num_samples: int = 100, num_features: int = 3, *, with_nulls: bool = False, with_nans: bool = False, null_percentage: float = 0.05, nan_percentage: float = 0.05, mode: str = "single_target", time_col_numeric: bool = False, drop_time: bool = False, random_seed: int = 100) -> DataFrame:
    """time (daily from 2023-01-01, or 0.0, 1.0, ...), target and feature_i uniform in [0, 1).

    Asked for, max(1, int(n * share)) rows get null in all features, and as many others NaN.
    """
    _check(num_samples, num_features, null_percentage, nan_percentage, mode)
    i = F.col("id")
    time = i.cast("double") if time_col_numeric else F.timestamp_micros(F.lit(1672531200000000) + i * 86400000000)
    draw = lambda k: (F.xxhash64(F.lit(random_seed), F.lit(k), i).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))).cast("double")
    df = spark.range(num_samples).select("id", *([] if drop_time else [time.alias("time")]), draw(0).alias("target"), *[draw(k + 1).alias(f"feature_{k + 1}") for k in range(num_features)])
    names = [f"feature_{k + 1}" for k in range(num_features)]
    if num_samples and names and (with_nulls or with_nans):
        share = lambda on, p: min(num_samples, max(1, int(num_samples * p))) if on else 0
        nulls = share(with_nulls, null_percentage)
        nans = min(num_samples - nulls, share(with_nans, nan_percentage))
        # the chosen rows are the first by hash; places in that order are found without a sort in one task
        chosen = spark.range(num_samples).select(F.col("id").alias("_id"), F.xxhash64(F.lit(random_seed), F.lit(-1), "id").alias("_h"))
        chosen = global_index(chosen, "_h", ("_id",), "_rank").where(F.col("_rank") < nulls + nans)
        df = df.join(chosen, F.col("id") == F.col("_id"), "left")
        df = df.withColumns({n: F.when(F.col("_rank") < nulls, F.lit(None)).when(F.col("_rank") < nulls + nans, F.lit(float("nan"))).otherwise(F.col(n)) for n in names}).drop("_id", "_h", "_rank")
    return df.drop("id")


def health_series(spark: SparkSession, days: int = 365, start: str = "2022-01-01", seed: int = 1) -> DataFrame:
    """Daily systolic pressure and heart rate: a yearly and a weekly wave with noise."""
    i = F.col("id")
    wave = lambda period, size: F.lit(float(size)) * F.sin(F.lit(2 * math.pi / period) * i)
    ds = F.date_add(F.to_date(F.lit(start)), i.cast("int")).cast("timestamp")
    return spark.range(days).select(ds.alias("ds"), (F.lit(120.0) + wave(365.25, 10) + wave(7, 3) + F.randn(seed) * 3).alias("systolic"), (F.lit(70.0) + wave(365.25, 5) + wave(7, 2) + F.randn(seed + 1) * 3).alias("heart_rate"))

"""Data sets by name: a registry of functions that give a DataFrame and its target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import exprs as E

REGISTRY: dict[str, Callable[[SparkSession], tuple[DataFrame, str]]] = {}


def quarterly(df: DataFrame, year: str = "year", quarter: str = "quarter", time_col: str = "ds") -> DataFrame:
    """Year and quarter replaced by the quarter's first day."""
    return df.withColumn(time_col, E.quarter_start(F.col(year), F.col(quarter)).cast("timestamp")).drop(year, quarter)


def macrodata(spark: SparkSession) -> tuple[DataFrame, str]:
    """The quarterly macroeconomic series of statsmodels, if that package is installed."""
    try:
        from statsmodels.datasets import macrodata as source
    except ImportError as e:
        raise RuntimeError("this data set needs the package statsmodels") from e
    return quarterly(spark.createDataFrame(source.load_pandas().data)), "realgdp"


REGISTRY["macrodata"] = macrodata


def register(name: str, load: Callable[[SparkSession], tuple[DataFrame, str]]) -> None:
    REGISTRY[name] = load


def parquet_series(path: str, target: str) -> Callable[[SparkSession], tuple[DataFrame, str]]:
    """A loader of a Parquet table."""
    return lambda spark: (spark.read.parquet(path), target)


class DatasetLoader:
    def __init__(self, name: str = "macrodata"):
        if name not in REGISTRY:
            raise ValueError(f"Dataset '{name}' is not supported. Available datasets: {sorted(REGISTRY)}")
        self.name = name

    def load(self, spark: SparkSession) -> tuple[DataFrame, str]:
        df, target = REGISTRY[self.name](spark)
        print(f"Loaded '{self.name}' with {len(df.columns)} columns, target '{target}'.")
        return df, target

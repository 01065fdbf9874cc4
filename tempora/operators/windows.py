"""Row windows over an ordered table: sliding, expanding, and their train, test and validation parts.

Windows are rows of one table (window_id, split), made by exploding each row into the windows that hold it; no range join.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import exprs as E
from tempora.operators.order import global_index, index_and_count

#: Expanding windows whose sums run on in one task.
STEP = 4096


def validate_percentages(train: float, test: float | None = None, validation: float | None = None, precision: float = 1e-6) -> tuple[float, float, float]:
    """Missing shares are filled; all lie in [0, 1] and sum to 1."""
    for name, x in (("train", train), ("test", test), ("validation", validation)):
        if x is not None and not 0 <= x <= 1:
            raise ValueError(f"{name} percentage must be between 0 and 1")
    if test is None and validation is None:
        test, validation = 1.0 - train, 0.0
    elif test is None:
        test = 1.0 - train - validation
    elif validation is None:
        validation = 1.0 - train - test
    if min(test, validation) < -precision:
        raise ValueError("percentages must sum to 1.0")
    test, validation = max(0.0, test), max(0.0, validation)
    if abs(train + test + validation - 1.0) > precision:
        raise ValueError("percentages must sum to 1.0")
    return train, test, validation


def partition_scheme(num_partitions: int | None, window_size: int | None, total_rows: int, stride: int | None = None) -> tuple[str, int, int]:
    """("num_partitions" or "window_size", number of windows, window size)."""
    if num_partitions is not None:
        if num_partitions <= 0:
            raise ValueError("num_partitions must be positive")
        return "num_partitions", num_partitions, total_rows // num_partitions
    if window_size is None:
        raise ValueError("Either num_partitions or window_size must be given")
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    stride = window_size if stride is None else stride
    if stride <= 0:
        raise ValueError("stride must be positive")
    return "window_size", (total_rows - window_size) // stride + 1, window_size


def validate_cardinality(num_partitions: int, window_size: int, total_rows: int) -> None:
    if num_partitions > total_rows:
        raise ValueError(f"Insufficient rows: {num_partitions} partitions of {total_rows} rows")
    if window_size > total_rows:
        raise ValueError(f"Insufficient rows: a window of {window_size} in {total_rows} rows")


def print_config(config: dict) -> None:
    for k, v in config.items():
        if not isinstance(v, int | float | bool | str):
            raise TypeError(f"Invalid value type for key '{k}': {type(v).__name__}")
    wide = max([len("setting"), *map(len, config)]) if config else 7
    print("\n".join([f"{'setting':<{wide}}  value", *[f"{k:<{wide}}  {v}" for k, v in config.items()]]))


def assign(indexed: DataFrame, idx: str, size: int, stride: int, count: int) -> DataFrame:
    """Each row once for every window that holds it, with window_id and its place `pos` in the window."""
    i = F.col(idx)
    first = F.greatest(F.ceil((i - (size - 1)) / F.lit(stride)), F.lit(0)).cast("bigint")
    last = F.least(F.floor(i / F.lit(stride)), F.lit(count - 1)).cast("bigint")
    rows = indexed.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.withColumn("pos", i - F.col("window_id") * stride)


def expanding(indexed: DataFrame, idx: str, size: int, stride: int, count: int) -> DataFrame:
    """Window k holds the first size + k * stride rows.  These are rows times windows; sums alone are cheaper by expanding_sums()."""
    first = F.greatest(F.ceil((F.col(idx) - (size - 1)) / F.lit(stride)), F.lit(0)).cast("bigint")
    return indexed.where(first <= count - 1).withColumn("window_id", F.explode(F.sequence(first, F.lit(count - 1).cast("bigint"))))


def expanding_sums(indexed: DataFrame, idx: str, size: int, stride: int, count: int, value: str) -> DataFrame:
    """window_id, n, total of value for each expanding window: rows are summed once, by the first window that holds them, and the sums
    run on over the windows, in groups of STEP windows after one row per group."""
    first = F.greatest(F.ceil((F.col(idx) - (size - 1)) / F.lit(stride)), F.lit(0)).cast("bigint")
    own = indexed.withColumn("window_id", first).where(F.col("window_id") <= count - 1).groupBy("window_id").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    own = own.withColumn("step", F.floor(F.col("window_id") / STEP))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = own.groupBy("step").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    steps = steps.select("step", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("total").over(before).alias("t0"))
    w = Window.partitionBy("step").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    run = own.select("window_id", "step", F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total")).join(steps, "step")
    total = F.when(F.col("total").isNull(), F.col("t0")).otherwise(F.col("total") + F.coalesce("t0", F.lit(0)))
    return run.select("window_id", (F.col("n") + F.col("n0")).alias("n"), total.alias("total"))


def split_of(pos: Column, size: int, train: float, test: float) -> Column:
    """The part of a window in which the row at `pos` lies."""
    a = round(size * train)
    b = a + round(size * test)
    return F.when(pos < a, "train").when(pos < b, "test").otherwise("validation")


def time_bounds(windows: DataFrame, time_col: str, train: float, validation: float) -> DataFrame:
    """One row per window with its parts in proportion of time, in microseconds: train [start, split), test [split, end), and
    validation [end, validation_end), which lies past the window."""
    t = E.time_number(windows, time_col)
    b = windows.groupBy("window_id").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    length = F.col("end") - F.col("start")
    return b.select("window_id", "start", (F.col("start") + F.floor(length * F.lit(float(train))).cast("bigint")).alias("split"), "end", (F.col("end") + F.floor(length * F.lit(float(validation))).cast("bigint")).alias("validation_end"))


def rows_before(rows: DataFrame, marks: DataFrame, at: str) -> DataFrame:
    """marks with n, the number of rows whose `at` is smaller; by one common order, not by a range join."""
    both = rows.select(at, F.lit(1).alias("_row")).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    placed = global_index(both, at, ("_row",), "_all").where("_row = 0").drop("_row")
    return global_index(placed, "_all", (), "_own").withColumn("n", F.col("_all") - F.col("_own")).drop("_all", "_own")


@runtime_checkable
class Partitioner(Protocol):
    """What a partitioning algorithm offers."""

    def setup(self, df: DataFrame) -> DataFrame: ...
    def fit(self, df: DataFrame) -> DataFrame: ...
    def transform(self, df: DataFrame) -> DataFrame: ...
    def fit_transform(self, df: DataFrame) -> DataFrame: ...


@dataclass
class SlidingWindows:
    """Windows of `window_size` rows every `stride` rows in time order (or `num_partitions` equal ones), with parts.

    split "rows" parts each window by rows inside it; "time" in proportion of time, with validation past the window.
    """

    time_col: str
    window_size: int | None = None
    stride: int | None = None
    num_partitions: int | None = None
    train: float = 0.7
    test: float | None = None
    validation: float | None = None
    ties: tuple[str, ...] = ()
    split: str = "rows"
    kind: str = "sliding"

    def setup(self, df: DataFrame) -> DataFrame:
        """Check the configuration against the table; the table with its index."""
        self.shares = validate_percentages(self.train, self.test, self.validation)
        indexed, total = index_and_count(df, self.time_col, self.ties)
        how, self.count, self.size = partition_scheme(self.num_partitions, self.window_size, total, self.stride)
        self.step = self.size if how == "num_partitions" or self.stride is None else self.stride
        validate_cardinality(self.count, self.size, total)
        if self.split not in {"rows", "time"} or self.kind not in {"sliding", "expanding"}:
            raise ValueError("split must be 'rows' or 'time', kind 'sliding' or 'expanding'")
        return indexed

    def fit(self, df: DataFrame) -> DataFrame:
        """One row per window: first and last index, and its times."""
        w = self._windows(self.setup(df))
        return w.groupBy("window_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min(self.time_col).alias("start"), F.max(self.time_col).alias("end"), F.count("*").alias("n"))

    def _windows(self, indexed: DataFrame) -> DataFrame:
        if self.kind == "expanding":
            return expanding(indexed, "idx", self.size, self.step, self.count).withColumn("pos", F.col("idx"))
        return assign(indexed, "idx", self.size, self.step, self.count)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of every window, with window_id and split."""
        indexed = self.setup(df)
        w = self._windows(indexed)
        if self.split == "rows" and self.kind == "sliding":
            return w.withColumn("split", split_of(F.col("pos"), self.size, *self.shares[:2]))
        train, _, validation = self.shares
        b = time_bounds(w, self.time_col, train, validation)
        t = E.time_number(indexed, self.time_col)
        places = self._places(indexed, b, ("start", "validation_end"))
        ends = places.groupBy("window_id").agg(F.min("n").alias("a"), F.max("n").alias("z")).where("a < z")
        held = ends.join(b, "window_id").withColumn("idx", F.explode(F.sequence(F.col("a"), F.col("z") - 1)))
        # Spark takes what is exploded for as small as the windows, and would broadcast it
        rows = held.join(indexed.hint("merge"), "idx")
        part = F.when(t < F.col("split"), "train").when(t < F.col("end"), "test").otherwise("validation")
        return rows.withColumn("split", part).select(*indexed.columns, "window_id", "split")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def partitions(self, df: DataFrame) -> DataFrame:
        """Rows of each part of each window."""
        if self.split == "rows" and self.kind == "sliding":
            return self.transform(df).groupBy("window_id", "split").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))
        # parts by time are ranges of the index: the rows before each of a window's four bounds tell them, and no row is joined
        indexed = self.setup(df)
        train, _, validation = self.shares
        b = time_bounds(self._windows(indexed), self.time_col, train, validation)
        places = self._places(indexed, b, ("start", "split", "end", "validation_end")).groupBy("window_id").agg(*[F.max(F.when(F.col("side") == k, F.col("n"))).alias(f"n{k}") for k in range(4)])
        parts = F.array(*[F.struct(F.lit(part).alias("split"), F.col(f"n{k}").alias("a"), F.col(f"n{k + 1}").alias("z")) for k, part in enumerate(("train", "test", "validation"))])
        rows = places.select("window_id", F.explode(parts).alias("p")).where("p.a < p.z")
        return rows.select("window_id", "p.split", (F.col("p.z") - F.col("p.a")).alias("n"), F.col("p.a").alias("first"), (F.col("p.z") - 1).alias("last"))

    def _places(self, indexed: DataFrame, bounds: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """window_id, side (of the named bounds, from 0) and n, the number of rows before that bound."""
        marks = bounds.select("window_id", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("at")) for k, c in enumerate(names)])).alias("m")).select("window_id", "m.side", "m.at")
        return rows_before(indexed.select(E.time_number(indexed, self.time_col).alias("at")), marks, "at")

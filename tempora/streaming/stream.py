"""The checks and the shift over streams.  Event time must be a TIMESTAMP; `as_event_time` casts one without zone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora.staging import new_path


def as_event_time(df: DataFrame, time_col: str, late: str = "10 minutes") -> DataFrame:
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def drop_duplicate_times(df: DataFrame, time_col: str, id_col: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each (entity, time) within the watermark."""
    return as_event_time(df, time_col, late).dropDuplicatesWithinWatermark([id_col, time_col])


def tumbling(df: DataFrame, time_col: str, value: str, length: str, slide: str | None = None, by: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of value per window of time (sliding if slide is given)."""
    keys = [F.window(time_col, length, slide) if slide else F.window(time_col, length), *([F.col(by)] if by else [])]
    out = as_event_time(df, time_col, late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *([by] if by else []), "n", "total", "mean")


def sessions(df: DataFrame, time_col: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = as_event_time(df, time_col, late).groupBy(F.session_window(time_col, gap), by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def shifted(df: DataFrame, time_col: str, by: str, target: str, late: str = "10 minutes") -> DataFrame:
    """Each row with the target of its entity's next row, given out when that row has come.

    The state of an entity is its rows younger than the watermark and the last one before: late rows are put in order, and
    what is older than the watermark is final.  Rows wait for the watermark, so the last row of each entity never comes out.
    """
    rows = as_event_time(df, time_col, late).select(F.col(by).cast("string").alias("key"), F.col(time_col).alias("at"), F.col(target).cast("double").alias("value"))
    schema = "key string, at timestamp, value double, next double"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += list(zip(b["at"].astype("datetime64[us]").astype("int64").tolist(), b["value"].tolist(), strict=True))
        held.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        final = sum(1 for t, _ in held if t <= mark)
        out = [(key[0], held[k][0], held[k][1], held[k + 1][1]) for k in range(final - 1)]
        held = held[max(0, final - 1) :]
        state.update(([t for t, _ in held], [v for _, v in held]))
        if len(held) > 1:
            state.setTimeoutTimestamp(max(mark // 1000 + 1, held[1][0] // 1000 + 1))
        if out:
            yield pd.DataFrame({"key": [r[0] for r in out], "at": pd.to_datetime([r[1] for r in out], unit="us"), "value": [r[2] for r in out], "next": [r[3] for r in out]})

    return rows.groupBy("key").applyInPandasWithState(run, schema, "at array<bigint>, value array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a Parquet table, with the schema they have now; the table may be a single file."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a file source takes a file by pattern only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there and give its result as a table in the shared folder.

    In complete mode the table is the last batch's; else batches are written side by side, each at a place of its own number,
    so that a batch that is run again replaces itself.
    """
    spark = df.sparkSession
    at = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return out

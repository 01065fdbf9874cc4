"""Tables written once to a folder that every executor reaches: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Staged tables by the identity of their DataFrame, which is kept alive with them.
_PLACES: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset, a new one of a local session (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tempora-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (out, path)
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, directly or through a lazy result."""
    for df in staged:
        held = _PLACES.pop(id(df), None)
        if held:
            drop_path(df.sparkSession, held[1])


def settled(make: Callable[[], DataFrame], name: str, codec: str = "snappy") -> DataFrame:
    """What make() gives, staged; the tables that it staged on the way are deleted."""
    before = set(_PLACES)
    out = stage(make(), name, codec)
    discard(*[df for k, (df, _) in list(_PLACES.items()) if k not in before and df is not out])
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them once the driver has collected its garbage, which may take half an
    hour by itself.  The first round frees the plans, the second what only they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def clear(spark: SparkSession) -> None:
    """Delete all tables staged in this session; to be called when no lazy result reads them any more."""
    discard(*[df for df, _ in list(_PLACES.values()) if df.sparkSession is spark])

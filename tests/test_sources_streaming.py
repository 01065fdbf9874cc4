import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.sources import datasets, synth
from tempora.streaming import stream


@pytest.mark.parametrize("n,k", [(100, 3), (0, 0), (1000, 10)])
def test_synthetic_shape(spark, n, k):
    df = synth.time_series(spark, n, k, with_nulls=True, with_nans=True)
    assert df.columns == ["time", "target", *[f"feature_{j + 1}" for j in range(k)]] and df.count() == n
    if k:
        share = max(1, int(n * 0.05))
        assert df.where("feature_1 is null").count() == share and df.where("isnan(feature_1)").count() == share
        assert df.where("feature_1 is null and feature_2 is not null").count() == 0
        assert df.where("target < 0 or target >= 1").count() == 0


def test_synthetic_options(spark):
    assert synth.time_series(spark, 5, 1, time_col_numeric=True).agg(F.max("time")).first()[0] == 4.0
    assert "time" not in synth.time_series(spark, 5, 1, drop_time=True).columns
    assert sorted(map(tuple, synth.time_series(spark, 20, 2).collect())) == sorted(map(tuple, synth.time_series(spark, 20, 2).collect()))
    one = synth.time_series(spark, 1, 2, with_nulls=True, with_nans=True).first()
    assert one.feature_1 is None and one.feature_2 is None
    for bad in ({"num_samples": -1}, {"mode": "multi_target"}, {"null_percentage": 1.5}, {"nan_percentage": -0.1}):
        with pytest.raises(ValueError):
            synth.time_series(spark, **bad)
    assert synth.health_series(spark, 30).count() == 30


def test_registry(spark):
    with pytest.raises(ValueError, match="Available datasets"):
        datasets.DatasetLoader("nothing")
    df = spark.createDataFrame([(2000, 3, 1.5)], "year int, quarter int, realgdp double")
    datasets.register("small", lambda s: (datasets.quarterly(df), "realgdp"))
    got, target = datasets.DatasetLoader("small").load(spark)
    assert target == "realgdp" and str(got.first().ds.date()) == "2000-07-01" and got.columns == ["realgdp", "ds"]


def played(spark, tmp_path, make, mode="append"):
    """The rows of a streaming query over events in four files."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    low = e.agg(F.min("event_id")).first()[0]
    for k in range(4):
        e.where(F.floor((F.col("event_id") - low) / 250) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = make(src).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return e, spark.table(name)


def test_tumbling_and_sessions(spark, tmp_path):
    e, out = played(spark, tmp_path / "a", lambda s: stream.tumbling(s, "ts", "value", "1 day"), "complete")
    exp = e.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("window.start", "n")
    assert sorted((r.start, r.n) for r in out.collect()) == sorted(map(tuple, exp.collect()))
    e, out = played(spark, tmp_path / "b", lambda s: stream.sessions(s, "ts", "user_id", "1 day"))
    assert out.count() > 0


def test_duplicates_are_dropped(spark, tmp_path):
    e, out = played(spark, tmp_path, lambda s: stream.drop_duplicate_times(s.union(s), "ts", "user_id", "40 days"))
    assert out.count() == e.count()


def test_shift_in_a_stream(spark, tmp_path):
    e, out = played(spark, tmp_path, lambda s: stream.shifted(s, "ts", "user_id", "value", "0 seconds"))
    w = Window.partitionBy("user_id").orderBy("ts")
    exp = {(str(r.user_id), r.ts): r.nxt for r in e.withColumn("nxt", F.lead("value").over(w)).where("nxt is not null").collect()}
    got = {(r.key, r.at): r.next for r in out.collect()}
    assert len(got) > 0.5 * len(exp) and all(exp[k] == v for k, v in got.items())

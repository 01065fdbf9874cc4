import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.errors import TargetColumnWarning
from tempora.frame import TemporalFrame
from tempora.operators import importance, order, pad, quality, rolling, shift, windows


def numbers(spark, n, parts=5):
    return spark.range(n).select(F.col("id").alias("t"), (F.col("id") * 10).alias("y"), (F.col("id") % 7).alias("g")).repartition(parts)


@pytest.mark.parametrize("n,rows", [(1, 50), (3, 50), (60, 100), (49, 50)])
def test_global_shift_values(spark, n, rows):
    got = {r.t: r[f"y_shift_{n}"] for r in shift.shift_target(numbers(spark, rows), "y", n, "t").collect()}
    assert got == {t: (t + n) * 10 for t in range(rows - n)}


def test_shift_by_key_and_null_future(spark):
    df = numbers(spark, 70).withColumn("y", F.when(F.col("t") != 20, F.col("y")))
    got = {r.t: r.y_shift_1 for r in shift.shift_target(df, "y", 1, "t", by=("g",)).collect()}
    assert got == {t: (t + 7) * 10 for t in range(63) if t + 7 != 20}
    steps = {r.t: r.y_next for r in shift.shift_steps(numbers(spark, 30), "y", 2, "t").collect()}
    assert steps == {t: [(t + 1) * 10.0, (t + 2) * 10.0] for t in range(28)}


def test_shifter_inputs(spark):
    x = np.random.default_rng(1).random((10, 4))
    out = shift.TargetShifter().fit_transform(x)
    assert out.shape == (9, 4) and np.allclose(out[:, -1], x[1:, -1]) and np.allclose(out[:, :-1], x[:-1, :-1])
    frame = TemporalFrame.of(numbers(spark, 10), "t", "y", id_col="g", metadata={"k": 1})
    got = shift.TargetShifter(n_lags=2).fit_transform(frame)
    assert got.roles.target == "y_shift_2" and got.roles.id == "g" and got.metadata == {"k": 1} and "y" not in got.df.columns
    with pytest.warns(TargetColumnWarning):
        shift.TargetShifter("g").fit(frame)
    with pytest.raises(ValueError, match="greater than 0"):
        shift.TargetShifter(n_lags=0)
    with pytest.raises(ValueError, match="All rows were dropped"):
        shift.TargetShifter("y", order="t").fit_transform(numbers(spark, 1))
    with pytest.raises(ValueError, match="Cannot transform empty"):
        shift.TargetShifter("y", order="t").fit_transform(numbers(spark, 0))
    with pytest.raises(ValueError):
        shift.TargetShifter("lost").fit(numbers(spark, 3))


def test_index_is_a_permutation_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None if k % 11 == 0 else k // 5, k) for k in range(200)], "t int, k int").repartition(7)
    got = order.global_index(df, "t", ("k",)).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(200))
    assert [(r.t is not None, r.t or 0, r.k) for r in got] == sorted((r.t is not None, r.t or 0, r.k) for r in got)


def test_order_does_not_hang_on_partitions(spark):
    df = numbers(spark, 300)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(tuple(r) for r in shift.shift_target(df, "y", 5, "t").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert a == sorted(tuple(r) for r in shift.shift_target(df.repartition(2), "y", 5, "t").collect())


@pytest.mark.parametrize("how,seq", [("post", list(range(12))), ("pre", list(range(-9, 3)))])
def test_padding_keeps_means(spark, how, seq):
    df = spark.createDataFrame([(1, 2.0), (3, 5.0), (8, 11.0)], "a int, b double")
    got = pad.mean_fill_pad(df, 12, how, "a").orderBy("_seq").collect()
    assert [r._seq for r in got] == seq
    assert np.mean([r.a for r in got]) == pytest.approx(4) and np.mean([r.b for r in got]) == pytest.approx(6)
    for bad in ((3, "post"), (2, "post"), (12, "middle")):
        with pytest.raises(ValueError):
            pad.mean_fill_pad(df, *bad)
    with pytest.raises(ValueError, match="null values"):
        pad.mean_fill_pad(spark.createDataFrame([(float("nan"),)], "a double"), 5)
    assert pad.constant_pad(df, 4, 7.0).where("a = 7 and b = 7").count() == 1


def test_percentages():
    assert windows.validate_percentages(0.7, 0.2, 0.1) == (0.7, 0.2, 0.1)
    assert windows.validate_percentages(0.7, None, 0.1) == pytest.approx((0.7, 0.2, 0.1))
    assert windows.validate_percentages(0.7, 0.2) == pytest.approx((0.7, 0.2, 0.1))
    assert windows.validate_percentages(0.7) == pytest.approx((0.7, 0.3, 0.0))
    assert windows.validate_percentages(0.7, 0.2, 0.1 + 1e-7)
    for bad in ((0.7, 0.7, 0.1), (0.7, 0.5), (1.2,), (-0.1,)):
        with pytest.raises(ValueError):
            windows.validate_percentages(*bad)


def test_schemes(capsys):
    assert windows.partition_scheme(5, None, 100) == ("num_partitions", 5, 20)
    assert windows.partition_scheme(None, 20, 100, 10) == ("window_size", 9, 20)
    assert windows.partition_scheme(None, 20, 100) == ("window_size", 5, 20)
    for bad in ((None, None, 100, None), (None, 20, 100, 0), (0, None, 100, None), (None, 0, 100, None)):
        with pytest.raises(ValueError):
            windows.partition_scheme(*bad)
    for bad in ((101, 1, 100), (1, 101, 100)):
        with pytest.raises(ValueError):
            windows.validate_cardinality(*bad)
    windows.print_config({"size": 3, "name": "x"})
    assert "size" in capsys.readouterr().out
    with pytest.raises(TypeError):
        windows.print_config({"bad": [1]})


def test_windows(spark):
    df = numbers(spark, 103)
    s = windows.SlidingWindows("t", 20, 10, train=0.7, test=0.2)
    assert isinstance(s, windows.Partitioner)
    rows = s.transform(df).collect()
    for k in range(9):
        own = sorted((r.t, r.split) for r in rows if r.window_id == k)
        assert [t for t, _ in own] == list(range(10 * k, 10 * k + 20))
        assert [x for _, x in own] == ["train"] * 14 + ["test"] * 4 + ["validation"] * 2
    assert len(rows) == 180
    assert {(r.window_id, r.first, r.last, r.n) for r in s.fit(df).collect()} == {(k, 10 * k, 10 * k + 19, 20) for k in range(9)}
    wide = windows.SlidingWindows("t", 20, 40, kind="expanding").fit(df).collect()
    assert {(r.window_id, r.n) for r in wide} == {(0, 20), (1, 60), (2, 100)}
    assert windows.SlidingWindows("t", num_partitions=4).transform(df).count() == 100


def test_time_split_reaches_past_the_window(spark):
    s = windows.SlidingWindows("t", 10, 10, train=0.6, test=0.2, validation=0.2, split="time")
    got = {}
    for r in s.transform(numbers(spark, 30)).collect():
        got.setdefault((r.window_id, r.split), []).append(r.t)
    assert sorted(got[0, "train"]) == [0, 1, 2, 3, 4] and sorted(got[0, "test"]) == [5, 6, 7, 8] and sorted(got[0, "validation"]) == [9]


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts of more than 8 MB fail, as larger ones do for want of driver memory."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_time_parts_send_no_rows_through_the_driver(spark, small_broadcasts):
    s = windows.SlidingWindows("t", 2000, 100, train=0.5, test=0.25, validation=0.25, split="time")
    got = {(r.window_id, r.split): (r.n, r.first, r.last) for r in s.partitions(numbers(spark, 20000)).collect()}
    exp = {}
    for k in range(181):
        for part, a, z in (("train", 0, 999), ("test", 999, 1999), ("validation", 1999, 2498)):
            a, z = 100 * k + a, min(100 * k + z, 20000)
            exp[k, part] = (z - a, a, z - 1)
    assert got == exp


def test_time_windows_of_a_burst_are_not_broadcast(spark, small_broadcasts):
    """A third of the rows in the first thousandth of the time, as in window_split_time_bursts."""
    df = spark.range(20000).select((F.when(F.col("id") % 3 == 0, 1).otherwise(1000) * F.col("id")).alias("t"), "id").repartition(5)
    s = windows.SlidingWindows("t", 1000, 100, train=0.5, test=0.0, validation=0.5, split="time", ties=("id",))
    exp = {(r.window_id, r.split): (r.n, r.first, r.last) for r in s.partitions(df).collect()}
    rows = s.transform(df).groupBy("window_id", "split").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    assert {(r.window_id, r.split): (r.n, r.first, r.last) for r in rows.collect()} == exp
    assert {k for k, _ in exp} == set(range(191)) and {k for _, k in exp} == {"train", "test", "validation"}


@pytest.mark.parametrize("kind", ["sliding", "expanding"])
def test_time_split_with_uneven_density(spark, kind):
    times = [1000 * k for k in range(10)] + [9000 + k for k in range(1, 401)] + [20000, 50000] * 3
    s = windows.SlidingWindows("t", 10, 7, train=0.6, test=0.1, validation=0.3, split="time", kind=kind)
    df = spark.createDataFrame([(t,) for t in times], "t bigint").repartition(5)
    got = {(r.window_id, r.split): r.n for r in s.partitions(df).collect()}
    exp, times = {}, sorted(times)
    for k in range((len(times) - 10) // 7 + 1):
        own = times[7 * k : 7 * k + 10] if kind == "sliding" else times[: 7 * k + 10]
        a, z = own[0], own[-1]
        for t in times:
            part = "train" if t < a + int((z - a) * 0.6) else "test" if t < z else "validation"
            if a <= t < z + int((z - a) * 0.3):
                exp[k, part] = exp.get((k, part), 0) + 1
    assert got == exp and (kind == "expanding" or got[0, "validation"] == 401)


@pytest.mark.parametrize("size", [1, 4, 40])
def test_rolling_mean_in_one_sequence(spark, size):
    v = [None if k % 13 == 5 else float(k * k % 31) for k in range(150)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "t int, v double").repartition(6)
    got = {r.t: r.m for r in rolling.rolling_mean(df, "v", size, ["t"], "m").collect()}
    for k in range(150):
        own = v[k - size + 1 : k + 1] if k >= size - 1 else [None]
        assert got[k] is None if None in own else got[k] == pytest.approx(sum(own) / size)


def test_a_hot_time_is_split(spark):
    df = spark.range(2000).select(F.lit(7).alias("t"), F.col("id").alias("k"), (F.col("id") * 2).alias("y")).repartition(5)
    rows = order.global_index(df, "t", ("k",)).collect()
    assert all(r.idx == r.k for r in rows) and len(rows) == 2000
    assert {r.k: r.y_shift_4 for r in shift.shift_target(df, "y", 4, "t", ("k",)).collect()} == {k: 2 * (k + 4) for k in range(1996)}
    parts = order.in_order(df, order._keys(df, "t", ("k",)))[0].select(F.spark_partition_id().alias("p"), F.input_file_name().alias("f")).distinct().count()
    assert parts >= 4


def test_expanding_sums(spark):
    df = numbers(spark, 57).withColumn("y", F.when(F.col("t") > 3, F.col("y")))
    s = windows.SlidingWindows("t", 4, 5, kind="expanding")
    indexed = s.setup(df)
    was, windows.STEP = windows.STEP, 3
    try:
        got = {r.window_id: (r.n, r.total) for r in windows.expanding_sums(indexed, "idx", s.size, s.step, s.count, "y").collect()}
    finally:
        windows.STEP = was
    assert got == {k: (4 + 5 * k, sum(10 * t for t in range(4, 4 + 5 * k)) if k else None) for k in range(11)}


def table(spark, n, features=4, target=lambda k: k % 2):
    return spark.createDataFrame([(k, target(k), *[float(k * (j + 1)) for j in range(features)]) for k in range(n)], ", ".join(["time int", "target int", *[f"f{j} double" for j in range(features)]]))


def report(**more):
    return quality.QualityReport("time", "target", **({"min_samples": 50, "max_samples": 150, "min_features": 2, "max_features": 5, "min_unique_values": 5} | more))


def test_quality_report(spark):
    df = table(spark, 100)
    out = report().fit_transform(df, "target")
    assert list(out) == list(quality.CHECKS) and all(r.passed for r in out.values())
    assert out["sample_size"].details == {"num_samples": 100} and out["class_balance"].details == {"total_samples": 100}
    assert {r.check: r.passed for r in report().report(df, "target").collect()} == {k: r.passed for k, r in out.items()}
    with pytest.warns(UserWarning):
        few = report().fit_transform(table(spark, 10, 10), "target")
    assert {k for k, r in few.items() if not r.passed} == {"sample_size", "feature_count", "feature_ratio"}
    some = quality.summary(few)
    assert {k: some[k] for k in ("total_checks", "failed_checks", "passed_checks")} == {"total_checks": 5, "failed_checks": 3, "passed_checks": 2}
    assert some["check_details"]["feature_ratio"] == few["feature_ratio"].to_dict() and few["sample_size"].to_dict()["passed"] is False
    assert few["sample_size"].to_log_entry() == {"validation_passed": False, "validation_message": few["sample_size"].message, "validation_details": {"num_samples": 10}, "log_level": "WARNING"}
    with pytest.raises(ValueError, match="Invalid checks"):
        report(checks=["nonsense"])
    with pytest.raises(ValueError, match="Missing values detected in columns: f0"):
        report().fit(df.withColumn("f0", F.when(F.col("time") > 3, F.col("f0"))))
    with pytest.raises(ValueError, match="must be numeric"):
        report().fit(df.withColumn("f0", F.lit("word")))
    with pytest.raises(ValueError):
        report().fit(df.drop("target"))
    with pytest.raises(TypeError):
        report().fit([1])


def test_quality_extended(spark):
    df = table(spark, 60, 2, target=lambda k: int(k == 0)).withColumn("two", F.col("time") % 2)
    out = report(extended=True, enable_warnings=False).fit_transform(df, "target")
    assert out["binary_features"].details == {"two": 2} and not out["class_balance"].passed
    nulls = spark.createDataFrame([(None,)] * 100, "x double")
    assert not report(enable_warnings=False).transform(nulls)["feature_variability"].passed


def test_group_and_rolling(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (2, 3, 30.0), (2, 4, None), (3, 5, 50.0)], "id int, t int, v double")
    got = {r.id: r for r in rolling.group_metrics(df, "id", "v").collect()}
    assert got[1].mean_value == 15 and got[1].std_value == pytest.approx(50**0.5) and got[3].std_value is None and got[2].n_missing == 1
    out = {r.t: r.m for r in rolling.rolling_mean(df, "v", 2, ["id", "t"], "m").collect()}
    assert out == {1: None, 2: 15.0, 3: 25.0, 4: None, 5: None}
    assert [r.v for r in rolling.mean_impute(df, ["v"]).orderBy("t").collect()] == [10, 20, 30, 27.5, 50]
    assert rolling.count_in(df, "id", [1, 3]).first().n == 3


def test_texts_to_numbers(spark):
    df = spark.createDataFrame([("1,234",), ("7",), ("bad",), (None,), ("1,2,3",)], "s string")
    assert [r.s for r in quality.features_to_numbers(df, ["s"]).collect()] == [1234.0, 7.0, None, None, None]


def test_importance(spark):
    df = numbers(spark, 40).withColumn("x", F.col("t").cast("double")).withColumn("z", (F.col("t") * 2).cast("double"))
    w = windows.SlidingWindows("t", 20, 20, train=0.5, test=0.5).transform(df)
    linear = importance.mean_absolute_attributions(importance.linear_attributions(w, {"x": 1.0, "z": 3.0}), ["x", "z"])
    other = importance.mean_absolute_attributions(importance.explained(w, ["x", "z"], lambda b: b * [1.0, 3.0]), ["x", "z"])
    assert {r.window_id for r in linear.collect()} == {0, 1}
    assert {r.window_id: r.x for r in other.collect()} == {0: 4.5, 1: 24.5}
    top = {r.window_id: r.feature for r in importance.by_feature(linear, ["x", "z"]).where("rank = 1").collect()}
    assert top == {0: "z", 1: "z"}
    fitted = importance.train_per_window(w, ["x"], "y").collect()
    assert all(r.coefficients["x"] == pytest.approx(10) and r.rmse < 1e-6 and (r.n_train, r.n_test) == (10, 10) for r in fitted)


def test_no_slope_of_a_constant_feature(spark):
    """As DuckDB's regr_slope: NaN where the training rows have one value, null where there are none; the rest is as without it."""
    w = numbers(spark, 60).withColumn("c", F.when(F.col("t") < 20, 7).otherwise(F.col("t") % 3)).withColumn("window_id", F.floor(F.col("t") / 20))
    w = w.withColumn("split", F.when((F.col("t") % 20 < 15) & (F.col("t") < 40), "train").otherwise("test"))
    got = {r.window_id: r for r in importance.train_per_window(w, ["c"], "y").withColumn("slope", F.col("coefficients")["c"]).collect()}
    assert np.isnan(got[0].slope) and not np.isnan(got[1].slope) and got[2].slope is None
    assert got[0].rmse == pytest.approx(np.sqrt(np.mean((np.arange(150, 200, 10) - 70.0) ** 2))) and got[2].rmse is None
    both = {r.window_id: r for r in importance.train_per_window(w, ["c", "t"], "y").collect()}[0]
    assert both.coefficients["t"] == pytest.approx(10) and np.isnan(both.coefficients["c"]) and both.rmse < 1e-6


def test_trainer(spark):
    df = numbers(spark, 60).withColumn("x", (F.col("t") % 20).cast("double")).withColumn("y", F.when(F.col("x") > 5, 3.0).otherwise(1.0))
    trainer = importance.WindowTrainer(windows.SlidingWindows("t", 20, 20, train=0.8, test=0.2), ["x"], "y")
    scores = trainer.train_and_evaluate(df).collect()
    assert len(scores) == 3 and all(r.rmse < 0.05 and r.coefficients.keys() == {"0"} for r in scores)
    assert trainer.predictions(df).where("abs(prediction - y) > 0.05").count() == 0
    w = windows.SlidingWindows("t", 20, 20, train=0.8, test=0.2).transform(numbers(spark, 60).withColumn("x", F.sin(F.col("t"))).withColumn("z", F.cos(F.col("t") * 3)))
    for r in importance.train_per_window(w, ["x", "z"], "y").collect():
        own = [q for q in w.collect() if q.window_id == r.window_id]
        a, b = (np.array([[q.x, q.z, 1.0] for q in own if q.split == s]) for s in ("train", "test"))
        ya, yb = (np.array([float(q.y) for q in own if q.split == s]) for s in ("train", "test"))
        c = np.linalg.lstsq(a, ya, rcond=None)[0]
        assert [r.coefficients["x"], r.coefficients["z"]] == pytest.approx(c[:2].tolist()) and r.rmse == pytest.approx(float(np.sqrt(np.mean((b @ c - yb) ** 2))))

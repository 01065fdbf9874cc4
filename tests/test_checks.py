import datetime as dt

import pytest

from tempora.errors import TemporalError, TimeColumnError
from tempora.frame import TemporalFrame
from tempora.operators import checks


def series(spark, times, kind="bigint"):
    return spark.createDataFrame([(t, float(k)) for k, t in enumerate(times)], f"time {kind}, value double")


def entities(spark, rows, kind="bigint"):
    return spark.createDataFrame([(*r, 0.0) for r in rows], f"id {kind}, time bigint, value double")


def test_empty_and_none(spark):
    with pytest.raises(ValueError, match="cannot be None"):
        checks.is_empty(None)
    assert checks.is_empty(series(spark, [])) and not checks.is_empty(series(spark, [1]))


def test_missing_counts_see_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2), (None, 3)], "a double, b int")
    assert checks.count_missing(df, ["a", "b"]) == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="Column 'x' not found"):
        checks.count_missing(df, ["x"])
    with pytest.raises(ValueError, match="Empty DataFrame"):
        checks.count_missing(df.limit(0), ["a"])


@pytest.mark.parametrize("times,good", [([1, 2, 3, 4], True), ([1, 2, 2, 3], False), ([4, 1, 3, 2], True)])
def test_duplicates(spark, times, good):
    if good:
        checks.check_order(series(spark, times), "time")
    else:
        with pytest.raises(TimeColumnError, match="Duplicate timestamps found in"):
            checks.check_order(series(spark, times), "time")


def test_duplicates_within_entities(spark):
    checks.check_order(entities(spark, [(1, 1), (1, 2), (2, 1), (2, 2)]), "time", "id")
    with pytest.raises(TimeColumnError, match="within groups"):
        checks.check_order(entities(spark, [(1, 1), (1, 1), (2, 2), (2, 3)]), "time", "id")
    with pytest.raises(ValueError):
        checks.check_order(series(spark, [1, 2]), "time", "nothing")


def test_equal_spacing(spark):
    checks.check_order(series(spark, [1, 2, 3, 4]), "time", equidistant=True)
    with pytest.raises(TimeColumnError, match="Irregular time sampling found"):
        checks.check_order(series(spark, [1, 2, 4, 7]), "time", equidistant=True)
    days = [dt.datetime(2023, 1, d) for d in (1, 2, 4, 7)]
    checks.check_order(series(spark, days, "timestamp"), "time")
    with pytest.raises(TimeColumnError):
        checks.check_order(series(spark, days, "timestamp"), "time", equidistant=True)
    checks.check_order(entities(spark, [(i, t) for i in "AB" for t in (1, 2, 3, 4)], "string"), "time", "id", equidistant=True)
    checks.check_order(entities(spark, [("A", 1), ("A", 2), ("A", 3), ("B", 2), ("B", 4), ("B", 6)], "string"), "time", "id", equidistant=True)


def test_null_times_are_not_duplicates(spark):
    checks.check_order(series(spark, [None, None, 1]), "time")


def test_sorting_puts_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(3, 30), (None, 0), (1, 10), (2, 20)], "time int, value int")
    assert [r.value for r in checks.sort_time(df, "time").collect()] == [0, 10, 20, 30]
    assert [r.value for r in checks.sort_time(df, "time", False).collect()] == [0, 30, 20, 10]


def test_conversions(spark):
    texts = series(spark, ["2023-01-01", "2023-01-02"], "string")
    assert [r.time for r in checks.to_time(texts, "time").collect()] == [dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2)]
    assert checks.to_time(series(spark, [1672531200000000]), "time").first().time == dt.datetime(2023, 1, 1)
    assert checks.to_time(series(spark, [1672531200]), "time", unit="s").first().time == dt.datetime(2023, 1, 1)
    for bad in (series(spark, ["invalid", "dates", "here"], "string"), series(spark, [True, False], "boolean")):
        with pytest.raises(TimeColumnError, match="must be string or numeric"):
            checks.to_time(bad, "time")
    day = series(spark, [dt.datetime(2023, 1, 1)], "timestamp_ntz")
    assert checks.time_to_number(day, "time", "ns").first().time == 1672531200000000000
    assert checks.time_to_number(day, "time", "ms").first().time == 1672531200000.0
    assert checks.convert_time(day, "time", "numeric").dtypes[0][1] == "double"
    with pytest.raises(TimeColumnError, match="not a datetime column"):
        checks.time_to_micros(texts, "time")
    with pytest.raises(ValueError):
        checks.convert_time(day, "time", "other")
    with pytest.raises(TimeColumnError):
        checks.convert_time(day, "lost")


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([("1", "2023-01-01", "A", 1.0)], "number string, day string, word string, x double")
    for c in ("number", "day", "x"):
        checks.check_number_or_time(df, c)
    for c in ("word", "lost"):
        with pytest.raises(ValueError, match="neither numeric nor datetime"):
            checks.check_number_or_time(df, c)
    checks.check_features(df.select("day", "number", "x"), "day")
    with pytest.raises(ValueError, match="Column 'word' must be numeric"):
        checks.check_features(df.select("day", "word"), "day")
    with pytest.raises(TimeColumnError):
        checks.check_features(df, "lost")


def test_frame(spark):
    df = series(spark, [3, 1, 2])
    f = TemporalFrame.of(df, "time", "value", metadata={"a": 1})
    assert [r.time for r in f.ordered().collect()] == [1, 2, 3] and [r.time for r in f.ordered(False).collect()] == [3, 2, 1]
    assert f.with_metadata(b=2).metadata == {"a": 1, "b": 2} and f.metadata == {"a": 1}
    assert f.with_df(series(spark, [9])).df.count() == 1
    assert TemporalFrame.of(df, "time", "value", conversion="datetime").df.dtypes[0][1] == "timestamp"
    for bad in ({"time_col": 1}, {"sort": "x"}, {"id_col": 3}):
        with pytest.raises(TypeError):
            TemporalFrame.of(df, **({"time_col": "time", "target_col": "value"} | bad))
    for bad in ({"mode": "x"}, {"conversion": "x"}):
        with pytest.raises(ValueError):
            TemporalFrame.of(df, "time", "value", **bad)
    with pytest.raises(TemporalError):
        TemporalFrame.of(df, "lost", "value")
    with pytest.raises(ValueError):
        TemporalFrame.of(df.limit(0), "time", "value")
    with pytest.raises(TimeColumnError):
        TemporalFrame.of(series(spark, [1, 1]), "time", "value", unique=True)


def test_keys_from_environment(monkeypatch):
    from tempora.operators.quality import keys_from_environment

    monkeypatch.setenv("TEMPORA_TEST_KEY", "x")
    with pytest.warns(UserWarning, match="TEMPORA_TEST_LOST"):
        assert keys_from_environment(["TEMPORA_TEST_KEY", "TEMPORA_TEST_LOST"]) == {"TEMPORA_TEST_KEY": "x", "TEMPORA_TEST_LOST": None}

"""Queries over the supplied tables, one per operator, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora import errors
from tempora.frame import TemporalFrame
from tempora.functions import exprs as E
from tempora.operators import checks, importance, order, pad, quality, rolling, shift, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIZE, STRIDE = 1000, 500
WEIGHTS = {"value": 0.5, "k": -0.25, "hour": 2.0}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric series: ts, value, k and hour."""
    e = _table(spark, sf_dir, "events")
    return e.select("ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.hour("ts").alias("hour"))


_SERIES = "SELECT ts, value, json_extract_string(props, '$.k')::INT AS k, hour(ts)::INT AS hour FROM events"


# --- shifts

@query("SELECT event_id, ts, user_id, lead(value) OVER (ORDER BY ts, event_id) AS value_shift_1 FROM events QUALIFY value_shift_1 IS NOT NULL")
def shift_1_global(spark, d):
    return shift.shift_target(_events(spark, d), "value", 1, "ts", ("event_id",))


@query("SELECT event_id, ts, user_id, lead(value, 3) OVER (ORDER BY ts, event_id) AS value_shift_3 FROM events QUALIFY value_shift_3 IS NOT NULL")
def shift_3_indexed(spark, d):
    frame = TemporalFrame.of(_events(spark, d), "ts", "value", ties=("event_id",))
    return shift.TargetShifter(n_lags=3).fit_transform(frame).df


@query("SELECT event_id, ts, user_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_shift_1 FROM events QUALIFY value_shift_1 IS NOT NULL")
def shift_1_by_user(spark, d):
    return shift.shift_target(_events(spark, d), "value", 1, "ts", ("event_id",), by=("user_id",))


@query("SELECT event_id, lead(v) OVER (ORDER BY ts, event_id) AS v_shift_1 FROM (SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) QUALIFY v_shift_1 IS NOT NULL")
def shift_null_future(spark, d):
    e = _events(spark, d).select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return shift.shift_target(e, "v", 1, "ts", ("event_id",)).select("event_id", "v_shift_1")


@query("SELECT event_id, ts, user_id, value, lead(value, 2) OVER (ORDER BY ts, event_id) AS value_shift_2 FROM events QUALIFY value_shift_2 IS NOT NULL")
def shift_keep_target(spark, d):
    return shift.shift_target(_events(spark, d), "value", 2, "ts", ("event_id",), drop_target=False)


@query("SELECT event_id, lag(value) OVER (ORDER BY ts, event_id DESC) AS value_shift_1 FROM events QUALIFY value_shift_1 IS NOT NULL")
def shift_descending(spark, d):
    return shift.shift_target(_events(spark, d), "value", 1, "ts", ("event_id",), ascending=False).select("event_id", "value_shift_1")


@query("SELECT event_id, lead(value, 1) OVER w AS next_1, lead(value, 2) OVER w AS next_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY next_2 IS NOT NULL AND next_1 IS NOT NULL")
def shift_steps_by_user(spark, d):
    out = shift.shift_steps(_events(spark, d), "value", 2, "ts", by=("user_id",), ties=("event_id",))
    return out.select("event_id", F.get("value_next", 0).alias("next_1"), F.get("value_next", 1).alias("next_2"))


@query("SELECT event_id, lead(value, 1) OVER w AS next_1, lead(value, 3) OVER w AS next_3 FROM events WINDOW w AS (ORDER BY ts, event_id) QUALIFY lead(value, 2) OVER w IS NOT NULL AND next_3 IS NOT NULL AND next_1 IS NOT NULL")
def shift_steps_global(spark, d):
    out = shift.shift_steps(_events(spark, d), "value", 3, "ts", ties=("event_id",))
    return out.select("event_id", F.get("value_next", 0).alias("next_1"), F.get("value_next", 2).alias("next_3"))


# --- order

@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events")
def global_index(spark, d):
    return order.global_index(_events(spark, d).select("event_id", "ts"), "ts", ("event_id",)).select("event_id", "idx")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def index_by_key(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return order.global_index(o, "o_orderdate", ("o_orderkey",), by=("o_orderpriority",)).select("o_orderkey", "idx")


@query("SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
def sort_time_asc(spark, d):
    e = _events(spark, d).select("event_id", "ts")
    return checks.sort_time(order.global_index(e, "ts", ("event_id",), "place"), "ts")


@query("SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS place FROM events")
def sort_time_desc(spark, d):
    e = _events(spark, d).select("event_id", "ts")
    n = e.agg(F.count("*").alias("n"))
    placed = order.global_index(e, "ts", ("event_id",), "i")
    return checks.sort_time(placed.withColumn("place", F.lit(n.first()[0] - 1) - F.col("i")).drop("i"), "ts", ascending=False)


@query("SELECT l_orderkey, l_shipdate, count(l_shipdate) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def dup_time_by_key(spark, d):
    return checks.duplicate_times(_table(spark, d, "lineitem"), "l_shipdate", "l_orderkey")


@query("SELECT o_orderdate, count(o_orderdate) AS n FROM orders GROUP BY ALL HAVING n > 1")
def dup_time_global(spark, d):
    return checks.duplicate_times(_table(spark, d, "orders"), "o_orderdate")


@query("SELECT user_id, count(DISTINCT d) AS n_steps FROM (SELECT user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - ts AS d FROM events) WHERE d IS NOT NULL GROUP BY user_id")
def deltas_by_user(spark, d):
    return checks.step_counts(_events(spark, d), "ts", "user_id")


@query("SELECT count(DISTINCT d) AS n_steps FROM (SELECT lead(ts) OVER (ORDER BY ts) - ts AS d FROM events)")
def deltas_global(spark, d):
    return checks.step_counts(_events(spark, d), "ts")


@query("SELECT count(DISTINCT x) AS n_steps FROM (SELECT lead(day) OVER (ORDER BY day) - day AS x FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events))")
def equidistant_days(spark, d):
    return checks.step_counts(_events(spark, d).select(F.date_trunc("day", "ts").alias("day")).distinct(), "day")


# --- checks and conversions

def _holes(spark, d):
    m = F.col("event_id") % 7
    return _events(spark, d).select("event_id", F.when(m != 0, F.col("value")).alias("value"), F.when(m == 1, F.lit(float("nan"))).when(m != 2, F.col("value")).alias("other"))


@query("SELECT count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (event_id % 7 = 0 OR value IS NULL) AS value, count(*) FILTER (event_id % 7 IN (1, 2) OR value IS NULL) AS other FROM events")
def null_counts(spark, d):
    return checks.missing_counts(_holes(spark, d), ["event_id", "value", "other"])


@query("""SELECT count(*) FILTER (event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) AS event_type_not_number, count(*) FILTER (event_type IS NOT NULL AND try_cast(event_type AS TIMESTAMP) IS NULL) AS event_type_not_time,
count(*) FILTER (k IS NOT NULL AND try_cast(k AS DOUBLE) IS NULL) AS k_not_number FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events)""")
def castable_counts(spark, d):
    e = _table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return checks.castable_counts(e, ["event_type", "k"]).drop("k_not_time")


@query("SELECT event_id, epoch_us(ts)::DOUBLE AS ts FROM events")
def time_micros(spark, d):
    return checks.time_to_number(_events(spark, d).select("event_id", "ts"), "ts", "us")


@query("SELECT event_id, (epoch_us(ts) // 1000)::DOUBLE AS ts FROM events")
def time_millis(spark, d):
    return checks.time_to_number(_events(spark, d).select("event_id", "ts"), "ts", "ms")


@query("SELECT event_id, epoch_us(ts) * 1000 AS ts FROM events")
def time_nanos(spark, d):
    return checks.time_to_number(_events(spark, d).select("event_id", "ts"), "ts", "ns")


@query("SELECT event_id, ts FROM events")
def micros_to_time(spark, d):
    n = checks.time_to_number(_events(spark, d).select("event_id", "ts"), "ts", "ns").withColumn("ts", F.expr("ts div 1000"))
    return checks.convert_time(n, "ts", "datetime").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, ts FROM events")
def string_to_time(spark, d):
    s = _events(spark, d).select("event_id", F.col("ts").cast("string").alias("ts"))
    return checks.convert_time(s, "ts", "datetime").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT ts, value, k, hour FROM (" + _SERIES + ")")
def frame_checked(spark, d):
    return TemporalFrame.of(_series(spark, d), "ts", "value", unique=True).ordered()


@query("SELECT o_orderkey, make_date(year(o_orderdate), ((quarter(o_orderdate) - 1) * 3 + 1)::INT, 1)::TIMESTAMP AS start FROM orders")
def quarter_start(spark, d):
    o = _table(spark, d, "orders")
    return o.select("o_orderkey", E.quarter_start(F.year("o_orderdate"), F.quarter("o_orderdate")).cast("timestamp_ntz").alias("start"))


# --- padding

_PAD = """WITH s AS (SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS user_id, value FROM events),
i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS _seq FROM s), n AS (SELECT count(*) AS n FROM s),
m AS (SELECT avg(event_id) AS event_id, avg(user_id) AS user_id, avg(value) AS value FROM s)
SELECT event_id, user_id, round(value, 6) AS value, _seq FROM i UNION ALL SELECT event_id, user_id, round(value, 6), {} FROM m, n, range(25) AS r(r)"""


def _pad(spark, d, how):
    e = _events(spark, d).select("event_id", "user_id", "value")
    return pad.mean_fill_pad(e, e.count() + 25, how, "event_id").withColumn("value", F.round("value", 6))


@query(_PAD.format("n + r"))
def mean_pad_post(spark, d):
    return _pad(spark, d, "post")


@query(_PAD.format("r - 25"))
def mean_pad_pre(spark, d):
    return _pad(spark, d, "pre")


@query("SELECT event_id::DOUBLE AS event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS _seq FROM events UNION ALL SELECT -1, -1, (SELECT count(*) FROM events) + r FROM range(5) AS r(r)")
def constant_pad(spark, d):
    e = _events(spark, d).select("event_id", "value")
    return pad.constant_pad(e, e.count() + 5, -1.0, "post", "event_id")


# --- windows

_WINDOWS = f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx FROM ({_SERIES})), n AS (SELECT count(*) AS n FROM i),
g AS (SELECT w AS window_id FROM n, range((n - {SIZE}) // {STRIDE} + 1) AS r(w)),
x AS (SELECT g.window_id, i.*, idx - window_id * {STRIDE} AS pos FROM g JOIN i ON idx >= window_id * {STRIDE} AND idx < window_id * {STRIDE} + {SIZE}),
p AS (SELECT *, CASE WHEN pos < 700 THEN 'train' WHEN pos < 900 THEN 'test' ELSE 'validation' END AS split FROM x) """


def _sliding(**more):
    return windows.SlidingWindows("ts", SIZE, STRIDE, train=0.7, test=0.2, validation=0.1, **more)


@query(_WINDOWS + "SELECT window_id, idx, split FROM p")
def window_assign(spark, d):
    return _sliding().transform(_series(spark, d)).select("window_id", "idx", "split")


@query(_WINDOWS + "SELECT window_id, split, count(*) AS n, min(idx) AS first, max(idx) AS last FROM p GROUP BY ALL")
def window_split_stats(spark, d):
    return _sliding().partitions(_series(spark, d))


@query(_WINDOWS + """, b AS (SELECT window_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS "end" FROM x GROUP BY window_id)
SELECT window_id, start, start + floor(("end" - start) * 0.7::DOUBLE)::BIGINT AS split, "end", "end" + floor(("end" - start) * 0.1::DOUBLE)::BIGINT AS validation_end FROM b""")
def window_bounds_time(spark, d):
    s = _sliding()
    indexed = s.setup(_series(spark, d))
    return windows.time_bounds(windows.assign(indexed, "idx", s.size, s.step, s.count), "ts", 0.7, 0.1)


@query(_WINDOWS + """, b AS (SELECT window_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM x GROUP BY window_id)
SELECT window_id, CASE WHEN epoch_us(ts) < a + floor((z - a) * 0.7::DOUBLE)::BIGINT THEN 'train' WHEN epoch_us(ts) < z THEN 'test' ELSE 'validation' END AS split,
count(*) AS n, min(idx) AS first, max(idx) AS last FROM b JOIN i ON epoch_us(ts) >= a AND epoch_us(ts) < z + floor((z - a) * 0.1::DOUBLE)::BIGINT GROUP BY ALL""")
def window_split_time(spark, d):
    return _sliding(split="time").partitions(_series(spark, d))


_BURSTS = """SELECT event_id, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1000 END * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) AS ts FROM events"""


@query(f"""WITH e AS ({_BURSTS}), i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM e), n AS (SELECT count(*) AS n FROM i),
g AS (SELECT w AS window_id FROM n, range((n - 300) // 200 + 1) AS r(w)),
b AS (SELECT window_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM g JOIN i ON idx >= window_id * 200 AND idx < window_id * 200 + 300 GROUP BY window_id)
SELECT window_id, CASE WHEN epoch_us(ts) < a + floor((z - a) * 0.5::DOUBLE)::BIGINT THEN 'train' WHEN epoch_us(ts) < z THEN 'test' ELSE 'validation' END AS split,
count(*) AS n, min(idx) AS first, max(idx) AS last FROM b JOIN i ON epoch_us(ts) >= a AND epoch_us(ts) < z + floor((z - a) * 0.5::DOUBLE)::BIGINT GROUP BY ALL""")
def window_split_time_bursts(spark, d):
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    e = _table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    at = start + F.floor(F.when(F.col("event_id") % 3 == 0, 1).otherwise(1000) * (F.col("t") - start) / 1000).cast("bigint")
    s = windows.SlidingWindows("ts", 300, 200, train=0.5, test=0.0, validation=0.5, split="time", ties=("event_id",))
    return s.partitions(e.select("event_id", F.timestamp_micros(at).alias("ts")))


@query(_WINDOWS + f"SELECT window_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM g JOIN i ON idx < {SIZE} + window_id * {STRIDE} GROUP BY window_id")
def expanding_windows(spark, d):
    s = _sliding(kind="expanding")
    sums = windows.expanding_sums(s.setup(_series(spark, d)), "idx", s.size, s.step, s.count, "value")  # no value is null
    return sums.select("window_id", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean_value"))


@query(f"SELECT n AS total_rows, (n - {SIZE}) // {STRIDE} + 1 AS windows, n // 5 AS fifth FROM (SELECT count(*) AS n FROM events)")
def partition_scheme(spark, d):
    n = _events(spark, d).count()
    row = (n, windows.partition_scheme(None, SIZE, n, STRIDE)[1], windows.partition_scheme(5, None, n)[2])
    return spark.createDataFrame([row], "total_rows bigint, windows bigint, fifth bigint")


@query("SELECT 'train' AS part, 0.7::DOUBLE AS share UNION ALL SELECT 'test', 0.2::DOUBLE UNION ALL SELECT 'validation', 0.1::DOUBLE")
def window_shares(spark, d):
    return spark.createDataFrame([(k, round(x, 9)) for k, x in zip(("train", "test", "validation"), windows.validate_percentages(0.7, None, 0.1), strict=True)], "part string, share double")


# --- quality

@query("""WITH q AS (SELECT count(*) FILTER (value IS NULL OR isnan(value)) AS lost, count(DISTINCT ts) = count(*) AS uniq, count(*) = 0 AS none FROM events)
SELECT 'not_empty' AS "check", NOT none AS passed FROM q UNION ALL SELECT 'no_missing', lost = 0 FROM q UNION ALL SELECT 'time_is_time', true UNION ALL SELECT 'text_is_number', false
UNION ALL SELECT 'unique_times_by_user', (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id, ts HAVING count(ts) > 1)) = 0 UNION ALL SELECT 'shares_sum_to_one', false UNION ALL SELECT 'report_fits', true""")
def eager_checks(spark, d):
    e = _events(spark, d)

    def holds(f, *args, **more) -> bool:
        try:
            return f(*args, **more) is not False
        except (ValueError, errors.TimeColumnError):
            return False

    out = [
        ("not_empty", not checks.is_empty(e)), ("no_missing", sum(checks.count_missing(e, ["value"]).values()) == 0), ("time_is_time", holds(checks.check_number_or_time, e, "ts")),
        ("text_is_number", holds(checks.check_number_or_time, _table(spark, d, "events"), "event_type")), ("unique_times_by_user", holds(checks.check_order, e, "ts", "user_id", False)),
        ("shares_sum_to_one", holds(windows.validate_percentages, 0.7, 0.5)), ("report_fits", holds(quality.QualityReport("ts", "value").fit, _series(spark, d))),
    ]
    return spark.createDataFrame(out, "check string, passed boolean")


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL) AS value_missing, count(DISTINCT value) AS value_unique, count(*) FILTER (k IS NULL) AS k_missing, count(DISTINCT k) AS k_unique,
count(*) FILTER (hour IS NULL) AS hour_missing, count(DISTINCT hour) AS hour_unique FROM ({_SERIES})""")
def quality_counts(spark, d):
    return quality.quality_counts(_series(spark, d), ["value", "k", "hour"])


@query(f"""WITH q AS (SELECT count(*) AS n, count(DISTINCT k) AS uk, count(DISTINCT hour) AS uh, count(value) AS nt FROM ({_SERIES}))
SELECT 'sample_size' AS "check", n BETWEEN 3000 AND 50000 AS passed, n::DOUBLE AS value FROM q UNION ALL SELECT 'feature_count', false, 2.0::DOUBLE
UNION ALL SELECT 'feature_ratio', 2.0::DOUBLE / n <= 0.1, round(2.0::DOUBLE / n, 6) FROM q
UNION ALL SELECT 'feature_variability', uk >= 10 AND uh >= 10, ((uk < 10)::INT + (uh < 10)::INT)::DOUBLE FROM q UNION ALL SELECT 'class_balance', true, nt::DOUBLE FROM q""")
def quality_report(spark, d):
    return quality.QualityReport("ts", "value").report(_series(spark, d), "value")


@query("SELECT event_type, count(*) AS n, count(*)::DOUBLE / min(count(*)) OVER () AS ratio FROM events GROUP BY event_type")
def class_balance(spark, d):
    return quality.class_balance(_table(spark, d, "events"), "event_type")


@query("SELECT count(DISTINCT event_type) AS n_unique, count(*) AS n, count(*) FILTER (event_type IS NULL) AS n_missing FROM events")
def categorical_cardinality(spark, d):
    return quality.describe_column(_table(spark, d, "events"), "event_type", categorical=True)


@query("SELECT count(DISTINCT quality) = 2 AS quality, count(DISTINCT toxic) = 2 AS toxic FROM labels")
def binary_features(spark, d):
    return quality.quality_counts(_table(spark, d, "labels"), ["quality", "toxic"]).select((F.col("quality_unique") == 2).alias("quality"), (F.col("toxic_unique") == 2).alias("toxic"))


@query("SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(DISTINCT value) AS n_unique, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events")
def numeric_summary(spark, d):
    return quality.describe_column(_table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


# --- group statistics, rolling, cleaning

@query("SELECT user_id, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value, count(value) AS n_value, count(*) FILTER (value IS NULL) AS n_missing, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY user_id")
def group_metrics(spark, d):
    return rolling.group_metrics(_events(spark, d), "user_id", "value", "ts").withColumns({c: F.round(c, 6) for c in ("mean_value", "std_value")})


@query("SELECT user_id, min(ts) AS first_time, max(ts) AS last_time, count(ts) AS n FROM events GROUP BY user_id")
def freq_span(spark, d):
    return rolling.frequency_span(_events(spark, d), "user_id", "ts")


@query("""SELECT user_id, count(r) AS n, round(sum(r), 3) AS sum_rolling FROM (SELECT user_id, CASE WHEN count(value) OVER w = 2 THEN avg(value) OVER w END AS r FROM events
WINDOW w AS (ORDER BY user_id, ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) GROUP BY user_id""")
def rolling_mean_2(spark, d):
    out = rolling.rolling_mean(_events(spark, d), "value", 2, ["user_id", "ts"], "r")
    return out.groupBy("user_id").agg(F.count("r").alias("n"), F.round(F.sum("r"), 3).alias("sum_rolling"))


@query("SELECT event_id, CASE WHEN count(value) OVER w = 50 THEN round(avg(value) OVER w, 6) END AS r FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def rolling_mean_50(spark, d):
    return rolling.rolling_mean(_events(spark, d), "value", 50, ["ts", "event_id"], "r").select("event_id", F.round("r", 6).alias("r"))


@query("""SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS r FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_mean_by_user(spark, d):
    return rolling.rolling_mean(_events(spark, d), "value", 3, ["ts", "event_id"], "r", ("user_id",)).select("event_id", F.round("r", 6).alias("r"))


@query("SELECT event_id, coalesce(v, 0) + coalesce(w, 0) AS total, v + w AS plain FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN value END AS w FROM events)")
def sum_horizontal(spark, d):
    e = _events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("w"))
    return e.select("event_id", E.sum_horizontal(F.col("v"), F.col("w")).alias("total"), (F.col("v") + F.col("w")).alias("plain"))


@query("SELECT event_id, round(coalesce(v, avg(v) OVER ()), 6) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def mean_impute(spark, d):
    e = _events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rolling.mean_impute(e, ["v"]).withColumn("v", F.round("v", 6))


@query("SELECT coalesce(upper(CASE WHEN event_id % 7 <> 0 THEN event_type END), 'UNKNOWN') AS category, count(*) AS n FROM events GROUP BY 1")
def category_clean(spark, d):
    c = E.clean_category(F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return _table(spark, d, "events").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, try_cast(s AS DOUBLE) AS price FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE (floor(o_totalprice)::BIGINT // 1000)::VARCHAR || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0') END AS s FROM orders)")
def strip_commas(spark, d):
    whole = F.floor("o_totalprice").cast("bigint")
    text = F.when(F.col("o_orderkey") % 11 == 0, F.lit("bad")).otherwise(F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
    out = quality.features_to_numbers(_table(spark, d, "orders").select("o_orderkey", text.alias("price")), ["price"])
    return out


@query("SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def isin_count(spark, d):
    return rolling.count_in(_table(spark, d, "events"), "event_type", ["click", "view", "purchase"])


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id")
def time_range_counts(spark, d):
    e = _events(spark, d).where("ts >= timestamp_ntz '2024-01-10' AND ts < timestamp_ntz '2024-01-20'")
    return e.groupBy("user_id").agg(F.count("*").alias("n"))


# --- importance

_MASV = _WINDOWS + """, m AS (SELECT window_id, avg(value) AS mv, avg(k) AS mk, avg(hour) AS mh FROM p GROUP BY window_id)
SELECT p.window_id, round(avg(abs(0.5::DOUBLE * (value - mv))), 6) AS value, round(avg(abs(-0.25::DOUBLE * (k - mk))), 6) AS k, round(avg(abs(2.0::DOUBLE * (hour - mh))), 6) AS hour
FROM p JOIN m USING (window_id) WHERE split = 'train' GROUP BY p.window_id"""


def _masv(spark, d):
    w = _sliding().transform(_series(spark, d))
    return importance.mean_absolute_attributions(importance.linear_attributions(w, WEIGHTS), list(WEIGHTS))


@query(_MASV)
def masv_linear(spark, d):
    return _masv(spark, d).select("window_id", *[F.round(c, 6).alias(c) for c in WEIGHTS])


@query("WITH s AS (" + _MASV + ") SELECT feature, window_id, score FROM (UNPIVOT s ON value, k, hour INTO NAME feature VALUE score)")
def masv_by_feature(spark, d):
    return importance.by_feature(_masv(spark, d), list(WEIGHTS)).select("feature", "window_id", F.round("score", 6).alias("score"))


@query(_WINDOWS + "SELECT window_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, round(regr_slope(value, hour) FILTER (split = 'train'), 6) AS slope FROM p GROUP BY window_id")
def train_per_window(spark, d):
    out = importance.train_per_window(_sliding().transform(_series(spark, d)), ["hour"], "value")
    return out.select("window_id", "n_train", "n_test", F.round(F.col("coefficients")["hour"], 6).alias("slope"))


# --- sources

@query("""SELECT 1000 AS n, 50 AS n_null, 50 AS n_nan, 0 AS n_half, 0 AS n_outside, TIMESTAMP '2023-01-01' AS first, TIMESTAMP '2023-01-01' + INTERVAL 999 DAY AS last, 1 AS n_steps""")
def synthetic_series(spark, d):
    from tempora.sources.synth import time_series

    s = time_series(spark, 1000, 4, with_nulls=True, with_nans=True)
    f = [F.col(f"feature_{k}") for k in range(1, 5)]
    whole = F.size(F.array_distinct(F.transform(F.array(*f), lambda x: F.when(x.isNull(), 1).when(F.isnan(x), 2).otherwise(0))))
    n = lambda c: F.count_if(c)
    facts = s.agg(F.count("*").alias("n"), n(f[0].isNull()).alias("n_null"), n(F.isnan(f[0])).alias("n_nan"), n(whole > 1).alias("n_half"), n((F.col("target") < 0) | (F.col("target") >= 1)).alias("n_outside"), F.min("time").cast("timestamp_ntz").alias("first"), F.max("time").cast("timestamp_ntz").alias("last"))
    return facts.withColumn("n_steps", F.lit(checks.step_counts(s, "time").first()[0]))


@query("""SELECT 365 AS n, TIMESTAMP '2022-01-01' AS first, TIMESTAMP '2022-12-31' AS last, 0 AS n_odd""")
def health_series(spark, d):
    from tempora.sources.synth import health_series as make

    odd = (F.abs(F.col("systolic") - 120) > 40) | (F.abs(F.col("heart_rate") - 70) > 40)
    return make(spark).agg(F.count("*").alias("n"), F.min("ds").cast("timestamp_ntz").alias("first"), F.max("ds").cast("timestamp_ntz").alias("last"), F.count_if(odd).alias("n_odd"))


@query("SELECT event_id, value FROM events")
def dataset_by_name(spark, d):
    from tempora.sources import datasets

    datasets.register("events", datasets.parquet_series(f"{d}/events.parquet", "value"))
    df, target = datasets.DatasetLoader("events").load(spark)
    return df.select("event_id", target)


# --- streams, run over the table's files

@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from tempora.streaming import stream

    out = stream.run_available(stream.tumbling(stream.parquet_stream(spark, f"{d}/events.parquet"), "ts", "value", "1 day", by="event_type"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id FROM events")
def stream_drop_duplicates(spark, d):
    from tempora.streaming import stream

    s = stream.parquet_stream(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id")
    return stream.run_available(stream.drop_duplicate_times(s.unionByName(s), "ts", "user_id", "40 days")).select("event_id")


@query("""SELECT s::TIMESTAMP AS start, s::TIMESTAMP + INTERVAL 2 DAY AS "end", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY s""")
def stream_sliding(spark, d):
    from tempora.streaming import stream

    out = stream.run_available(stream.tumbling(stream.parquet_stream(spark, f"{d}/events.parquet"), "ts", "value", "2 days", slide="1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
(SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true))::INT AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    from tempora.streaming import stream

    out = stream.run_available(stream.sessions(stream.parquet_stream(spark, f"{d}/events.parquet"), "ts", "user_id", "6 hours"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""SELECT user_id::VARCHAR AS key, ts AS at, value, n AS next FROM (SELECT user_id, ts, value, lead(value) OVER w AS n, lead(ts) OVER w AS nts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
WHERE nts <= date_trunc('millisecond', (SELECT max(ts) FROM events))""")
def stream_shifted(spark, d):
    from tempora.streaming import stream

    out = stream.run_available(stream.shifted(stream.parquet_stream(spark, f"{d}/events.parquet"), "ts", "user_id", "value", "0 seconds"))
    return out.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "value", "next")

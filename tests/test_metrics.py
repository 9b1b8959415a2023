from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfkin.functions import buckets as B
from shelfkin.operators import counters as C
from shelfkin.operators import exposition as E
from shelfkin.operators import gauges as G
from shelfkin.operators import rates as R

T0 = datetime(2024, 1, 1, 12, 0, 0)
LOG = (
    "event_id long, ts timestamp, method string, endpoint string, status_code int, duration_s double, "
    "user_id string, rec_type string, error boolean"
)


def log(spark, rows):
    """Rows of (seconds, duration, status, user, type, error)."""
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), "GET", "/a", status, d, user, kind, error) for i, (s, d, status, user, kind, error) in enumerate(rows)],
        LOG,
    )


def durations(spark, values):
    return log(spark, [(i, v, 200, "u", "t", False) for i, v in enumerate(values)])


def test_histogram_is_cumulative(spark):
    wide = C.histogram(durations(spark, [0.05, 0.1, 0.3, 20.0]), ["method"], [0.1, 0.25, 0.5])
    rows = C.histogram_rows(wide, ["method"], [0.1, 0.25, 0.5]).collect()
    assert [(r["le"], r["n"]) for r in rows] == [("0.1", 2), ("0.25", 2), ("0.5", 3), ("+Inf", 4)]
    assert rows[0]["total"] == pytest.approx(20.45)


@pytest.mark.parametrize(
    "values, q, expected",
    [
        ([0.05, 0.1, 0.3, 20.0], 0.5, 0.1),  # end of the first bucket
        ([0.05, 0.1, 0.3, 20.0], 0.95, 0.5),  # beyond every finite bound
        ([0.05] * 4, 0.5, 0.05),  # half-way into the first bucket
        ([0.3] * 4, 0.5, 0.375),  # half-way into the last finite bucket
        ([0.05, 0.3], 0.75, 0.375),
    ],
)
def test_quantiles(spark, values, q, expected):
    bounds = [0.1, 0.25, 0.5]
    wide = C.histogram(durations(spark, values), ["method"], bounds)
    assert C.histogram_quantiles(wide, bounds, {"q": q}).first()["q"] == pytest.approx(expected)


def test_quantile_of_nothing_is_null(spark):
    bounds = [0.1]
    wide = C.histogram(durations(spark, [None]), ["method"], bounds)
    assert C.histogram_quantiles(wide, bounds, {"q": 0.5}).first()["q"] is None


def test_failed_recommendations_and_unknown_users(spark):
    rows = [(0, 1.0, 200, "u", "t", False), (1, 1.0, 200, None, "t", False), (2, 1.0, 500, "u", "t", True)]
    got = {(r[0], r[1], r[2]) for r in C.recommendation_counts(log(spark, rows)).collect()}
    assert got == {("u", "t", 1), ("unknown", "t", 1), ("u", "t_error", 1)}


def test_activities_ignore_other_kinds(spark):
    df = spark.createDataFrame([("experiment_logged",), ("model_saved",), ("model_saved",), ("other",)], "activity string")
    assert tuple(C.activity_counts(df).first()) == (1, 2)


def samples(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), k, float(v)) for i, (s, k, v) in enumerate(rows)], "event_id long, ts timestamp, k string, value double"
    )


def test_counter_restart(spark):
    df = samples(spark, [(0, "a", 10), (15, "a", 15), (30, "a", 3), (45, "a", 9)])
    assert R.counter_increases(df, ["k"]).agg(F.sum("increase")).first()[0] == 14


def test_counter_continues_across_hours_and_gaps(spark):
    df = samples(spark, [(0, "a", 1), (3599, "a", 4), (3601, "a", 6), (20000, "a", 2), (5, "b", 100), (4000, "b", 101)])
    got = {(r["k"], r["value"]): r["increase"] for r in R.counter_increases(df, ["k"]).collect()}
    assert got == {("a", 1): 0, ("a", 4): 3, ("a", 6): 2, ("a", 2): 2, ("b", 100): 0, ("b", 101): 1}


def test_rate_covers_five_minutes(spark):
    rates = R.event_rate(log(spark, [(30, 1.0, 200, "u", "t", False)]), ["endpoint"])
    rows = rates.orderBy("window_start").collect()
    assert len(rows) == 5 and all(r["rate"] == pytest.approx(1 / 300) for r in rows)
    assert rows[-1]["window_start"] == T0


def test_shares_sum_to_one(spark):
    rows = [(s, 1.0, 200 if s % 3 else 500, "u", "t", False) for s in range(0, 900, 7)]
    shares = R.status_shares(log(spark, rows)).groupBy("window_start").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in shares)


def test_mean_duration(spark):
    row = R.mean_duration(durations(spark, [1.0, 2.0, 6.0]), ["endpoint"], 300, 300).first()
    assert row["mean_s"] == 3.0


def test_in_progress_across_hours(spark):
    rows = [(0, 7300.0, 200, "u", "t", False), (3000, 100.0, 200, "u", "t", False), (3050, 10.0, 200, "u", "t", False), (4000, 1.0, 200, "u", "t", False)]
    got = {r["window_start"]: r["most_in_progress"] for r in G.in_progress(log(spark, rows)).collect()}
    # At 2:00:00 the first request is still under way.
    assert got == {T0: 3, T0 + timedelta(hours=1): 2, T0 + timedelta(hours=2): 1}


def test_in_progress_is_carried_over_quiet_windows(spark):
    rows = [(600, 9000.0, 200, "u", "t", False), (700, None, 200, "u", "t", False), (800, 0.0, 200, "u", "t", False), (4 * 3600, 5.0, 200, "u", "t", False)]
    got = {r["window_start"]: r["most_in_progress"] for r in G.in_progress(log(spark, rows)).collect()}
    assert got == {T0 + timedelta(hours=h): n for h, n in enumerate([2, 2, 2, 1, 2])}


def test_in_progress_does_not_depend_on_slots(spark):
    rows = [(k * 37 % 9000, float(k * 13 % 1700), 200, "u", "t", False) for k in range(300)]
    each = [sorted(map(tuple, G.in_progress(log(spark, rows), 600, slot).collect())) for slot in (1, 60, 100_000)]
    assert each[0] == each[1] == each[2]
    spans = [(a, a + d) for a, d, *_ in rows]
    for start, _, _, _, most in each[0]:
        low = (start - T0).total_seconds()
        moments = [low, *[a for a, _ in spans if low <= a < low + 600]]
        assert most == max(sum(a <= m < b for a, b in spans) for m in moments)


def test_an_end_counts_before_a_start_at_the_same_moment(spark):
    got = G.in_progress(log(spark, [(0, 10.0, 200, "u", "t", False), (10, 10.0, 200, "u", "t", False)])).collect()
    assert [r["most_in_progress"] for r in got] == [1]


def test_last_value_skips_nulls(spark):
    df = samples(spark, [(0, "a", 1), (9, "a", 2)]).withColumn("value", F.when(F.col("value") == 1, F.col("value")))
    assert G.last_values(df, ["k"]).first()["value"] == 1


def test_service_status(spark):
    scrapes = spark.createDataFrame(
        [(1, T0, "fresh", 1), (2, T0 - timedelta(seconds=40), "stale", 1), (3, T0, "failing", 0), (4, T0 + timedelta(hours=1), "failing", 1)],
        "event_id long, ts timestamp, job string, up int",
    )
    jobs = spark.createDataFrame([("fresh", 15), ("stale", 30), ("failing", 15), ("silent", 15)], "job string, interval_s int")
    got = {r["job"]: r["status"] for r in G.service_status(scrapes, jobs, F.lit(T0)).collect()}
    assert got == {"fresh": "UP", "stale": "DOWN", "failing": "DOWN", "silent": "DOWN"}


def test_bands(spark):
    df = spark.createDataFrame([("cpu_percent", v) for v in (0.0, 69.9, 70.0, 90.0, -1.0)] + [("up", 1.0), ("x", 5.0)], "metric string, value double")
    got = [r["colour"] for r in G.colour_bands(df).collect()]
    assert got == ["green", "green", "yellow", "red", None, "green", None]


def test_recent_and_retained(spark):
    df = samples(spark, [(0, "a", 1), (-3600, "a", 2), (-3601, "a", 3), (5, "a", 4), (-15 * 86400 - 1, "a", 5)])
    assert sorted(r["value"] for r in R.recent(df, F.lit(T0)).collect()) == [1, 2]
    assert sorted(r["value"] for r in R.retained(df, F.lit(T0)).collect()) == [1, 2, 3, 4]


def test_an_empty_batch_retires_old_days(spark, tmp_path):
    path = str(tmp_path / "r")
    df = samples(spark, [(0, "a", 1), (-10 * 86400, "a", 2)])
    R.write_retained(df, path, F.lit(T0))
    later = F.lit(T0 + timedelta(days=8))
    R.write_retained(df.limit(0), path, later)
    assert [r["value"] for r in spark.read.parquet(path).collect()] == [1]


def test_exposition_escapes_and_orders(spark, tmp_path):
    df = spark.createDataFrame([('a"b\\c\nd', 2), (None, 1)], "l string, n long")
    lines = E.exposition_lines(df, "hits_total", ["l"], "n")
    E.write_exposition(lines, {"hits_total": "counter"}, str(tmp_path / "x"))
    written = [r["value"] for r in spark.read.text(str(tmp_path / "x")).coalesce(1).collect()]
    assert written == ["# TYPE hits_total counter", 'hits_total{l=""} 1', 'hits_total{l="a\\"b\\\\c\\nd"} 2']


def test_written_numbers_are_exact(spark):
    df = spark.createDataFrame([(1e-9,), (0.1,), (2.5e7,), (3.0,), (float("inf"),), (float("nan"),)], "n double")
    got = [r["line"].split(" ")[1] for r in E.exposition_lines(df, "m", [], "n").collect()]
    assert got == ["1.0E-9", "0.1", "25000000", "3", "+Inf", "NaN"]


def test_histogram_buckets_rise(spark, tmp_path):
    wide = C.histogram(durations(spark, [0.3, 3.0, 70.0]), ["endpoint"], B.REQUEST_BOUNDS)
    lines = E.histogram_lines(C.histogram_rows(wide, ["endpoint"], B.REQUEST_BOUNDS), "d", ["endpoint"])
    E.write_exposition(lines.repartition(3), {"d": "histogram"}, str(tmp_path / "h"))
    written = [r["value"] for r in spark.read.text(str(tmp_path / "h")).coalesce(1).collect()]
    le = [x.split('le="')[1].split('"')[0] for x in written if "le=" in x]
    assert le == [*map(str, B.REQUEST_BOUNDS), "+Inf"] and written[-2].startswith("d_sum") and written[-1].startswith("d_count")


def test_histogram_takes_one_pass_without_exploding(spark):
    plan = C.histogram(durations(spark, [1.0]), ["method"], B.REQUEST_BOUNDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Expand" not in plan

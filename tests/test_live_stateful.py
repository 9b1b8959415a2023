"""Live gauges, counter rates and shares: any order of files, restarts, late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfkin.operators.gauges import in_progress
from shelfkin.operators.rates import counter_rate, status_shares
from shelfkin.operators.scrapes import bucket_increases, bucket_quantile, monotone, scraped_quantiles
from shelfkin.streaming import live, stateful

T0 = datetime(2024, 1, 1)
LOG = "event_id long, ts timestamp, method string, endpoint string, status_code int, duration_s double"
SAMPLES = "event_id long, ts timestamp, series string, value double"


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def drain(stream, folder):
    live.to_table(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def closed(df, last_s):
    end = at(last_s) - timedelta(minutes=10)
    return sorted((tuple(r) for r in df.collect() if r["window_end"] <= end), key=str)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_files(rows, ts, parts):
    """Rows in files whose order is only roughly that of time: neighbours are mixed within five minutes."""
    random.seed(3)
    mixed = sorted(rows, key=lambda r: r[ts] + timedelta(seconds=random.randint(0, 300)))
    step = -(-len(mixed) // parts)
    return [mixed[i : i + step] for i in range(0, len(mixed), step)]


def test_requests_under_way_in_any_order_and_across_restarts(spark, tmp_path):
    random.seed(1)
    spans = [(i, at(random.randint(0, 7200)), "GET", random.choice("ab"), 200, random.choice([None, 0.0, 5.5, 700.0, 4000.0])) for i in range(300)]
    spans += [(900, at(40_000), "GET", "a", 200, 1.0), (901, at(60_000), "POST", None, 200, 9.0), (902, at(60_000), "GET", "b", 200, 1.0)]
    source = str(tmp_path / "in")
    for part in in_files(spans, 1, 4):
        # Each file is drained by a query of its own, which goes on from the checkpoint.
        write(spark, source, part, LOG)
        got = drain(live.live_in_progress(live.read_log(spark, source, spark.read.parquet(source).schema), 600), tmp_path)
    batch = in_progress(spark.read.parquet(source), 600)
    assert ordered(got) == closed(batch, 60_000)
    # Quiet stretches hold what is open, and the requests without an end stay open.
    assert got.filter("endpoint = 'a'").agg(F.max("window_start")).first()[0] == at(39_600)
    assert got.filter(F.col("window_start") == at(36_000)).first()["most_in_progress"] > 0


def test_late_requests_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, at(0), "GET", "a", 200, 2.0)], [(2, at(5000), "GET", "a", 200, 2.0)], [(3, at(1), "GET", "a", 200, 2.0)], [(4, at(9000), "GET", "a", 200, 2.0)]):
        write(spark, source, rows, LOG)
        got = drain(live.live_in_progress(live.read_log(spark, source, spark.read.parquet(source).schema), 600), tmp_path)
    assert {r["window_start"]: r["most_in_progress"] for r in got.collect() if r["most_in_progress"]} == {at(0): 1, at(4800): 1}


def test_moves_are_forgotten_once_requests_end():
    class Handle:
        def getValueState(self, name, schema):
            return self

        def registerTimer(self, ms):
            pass

        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Time:
        getCurrentWatermarkInMs = lambda self: 10_000_000

    import pandas as pd

    handle, process = Handle(), stateful.OpenRequests(["k"], 60)
    process.init(handle)
    list(process.handleInputRows(("x",), iter([pd.DataFrame({"begun": [1_000_000, 2_000_000], "ended": [5_000_000, stateful.NEVER]})]), Time()))
    rows = list(process.handleExpiredTimer(("x",), Time(), None))
    assert rows[0]["most_in_progress"].tolist() == [2] and handle.value == (b"", 1, 60_000_000)
    with pytest.raises(ValueError):
        stateful.CounterIncreases(["k"], 300, 70)


def test_counter_rates_in_any_order_with_restarts(spark, tmp_path):
    random.seed(2)
    rows, value = [], {"a": 0.0, "b": 0.0}
    for i in range(400):
        series = random.choice("ab")
        value[series] = 0.0 if random.random() < 0.05 else value[series] + random.randint(0, 5)
        rows.append((i, at(i * 17 + i % 2), series, value[series]))
    rows += [(i, at(400 * 17), s, 1.0) for i, s in ((500, "a"), (501, "a"), (502, "b"))] + [(600, at(20_000), "a", 2.0), (601, at(20_000), None, 1.0)]
    source = str(tmp_path / "in")
    for part in in_files(rows, 1, 4):
        write(spark, source, part, SAMPLES)
        got = drain(live.live_counter_rates(live.read_log(spark, source, spark.read.parquet(source).schema), ["series"]), tmp_path)
    assert ordered(got) == closed(counter_rate(spark.read.parquet(source), ["series"]), 20_000)


def test_status_shares_equal_batch(spark, tmp_path):
    rows = [(i, at(i * 20), "GET", "a", [200, 200, 404, 500][i % 4], 0.5) for i in range(200)]
    source = str(tmp_path / "in")
    for part in in_files(rows, 1, 3):
        write(spark, source, part, LOG)
        got = drain(live.live_status_shares(live.read_log(spark, source, spark.read.parquet(source).schema)), tmp_path)
    batch = status_shares(spark.read.parquet(source)).select(got.columns)
    even = lambda df: df.withColumn("share", F.round("share", 9))
    assert ordered(even(got)) == closed(even(batch), 199 * 20) and got.count()


def scrape(spark, rows):
    return spark.createDataFrame([(i, at(s), "x", le, float(v)) for i, (s, le, v) in enumerate(rows)], "event_id long, ts timestamp, series string, le string, value double")


def test_scraped_buckets_restart_miss_and_disagree(spark):
    rows = [(0, "0.1", 10), (0, "0.5", 20), (0, "1.00", 25), (0, "+Inf", 30)]
    rows += [(60, "0.1", 14), (60, "0.5", 3), (60, "1.0", 31), (60, "+Inf", 40), (60, "strange", 5)]
    got = bucket_increases(scrape(spark, rows), ["series"], 60, 60).filter(F.col("window_start") == at(60)).first()
    # 0.5 restarted; 1.0 is spelled in two ways, which are two counters of one bound.
    assert [tuple(b) for b in got["buckets"]] == [(0.1, 4.0), (0.5, 3.0), (1.0, 0.0), (float("inf"), 10.0)]
    read = scraped_quantiles(scrape(spark, rows), ["series"], {"p20": 0.2, "p50": 0.5, "low": -1.0, "high": 2.0}, 60, 60)
    row = read.filter(F.col("window_start") == at(60)).first()
    # Repaired to 4, 4, 4, 10: rank 2 lies in the first bucket, rank 5 above every bound.
    assert (row["n"], round(row["p20"], 9), row["p50"], row["low"], row["high"]) == (10.0, 0.05, 1.0, float("-inf"), float("inf"))


@pytest.mark.parametrize(
    "buckets, expected",
    [
        ([], None),
        ([(float("inf"), 5.0)], None),
        ([(0.1, 2.0), (0.5, 5.0)], None),
        ([(0.1, 0.0), (float("inf"), 0.0)], None),
        ([(-1.0, 9.0), (1.0, 10.0), (float("inf"), 10.0)], -1.0),
        ([(0.1, 0.0), (0.5, 10.0), (float("inf"), 10.0)], 0.3),
        ([(0.1, 6.0), (0.5, 2.0), (float("inf"), 8.0)], 0.1 * 4 / 6),
        ([(0.1, 1.0), (0.5, 2.0), (float("inf"), 9.0)], 0.5),
    ],
)
def test_bucket_quantile(spark, buckets, expected):
    df = spark.createDataFrame([(buckets,)], "buckets array<struct<bound:double,increase:double>>")
    got = df.select(bucket_quantile(0.5, monotone(F.col("buckets")))).first()[0]
    assert got == (None if expected is None else pytest.approx(expected))

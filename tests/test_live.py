from datetime import datetime, timedelta

from shelfkin.operators.counters import request_counts
from shelfkin.operators.rates import event_rate
from shelfkin.streaming import live

from .test_metrics import LOG

T0 = datetime(2024, 1, 1, 12, 0, 0)


def write(spark, path, rows):
    """One file of (event_id, seconds) requests."""
    data = [(i, T0 + timedelta(seconds=s), "GET", "/a", 200, 0.5, "u", "t", False) for i, s in rows]
    spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(path)


def drain(stream, folder):
    live.to_table(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(i, i * 20) for i in range(200)])
    schema = spark.read.parquet(source).schema
    for job, batch in [
        (live.live_request_counts, lambda log: request_counts(log, 300)),
        (live.live_rates, lambda log: event_rate(log, ["method", "endpoint", "status_code"])),
    ]:
        got = drain(job(live.read_log(spark, source, schema)), tmp_path / job.__name__)
        closed = T0 + timedelta(seconds=199 * 20) - timedelta(minutes=10)
        expected = [r for r in batch(spark.read.parquet(source)).collect() if r["window_end"] <= closed]
        assert sorted(got.collect()) == sorted(expected) and expected


def test_repeats_and_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(1, 10), (1, 10), (2, 20)])
    schema = spark.read.parquet(source).schema
    stream = live.read_log(spark, source, schema, files_per_batch=1)
    drain(live.live_request_counts(stream), tmp_path)
    write(spark, source, [(3, 2000)])
    drain(live.live_request_counts(stream), tmp_path)
    write(spark, source, [(4, 15), (5, 5000)])  # event 4 is older than the watermark
    got = drain(live.live_request_counts(stream), tmp_path)
    assert sorted((r["window_start"], r["requests"]) for r in got.collect()) == [
        (T0, 2),
        (T0 + timedelta(seconds=1800), 1),
    ]


def test_update_mode_feeds_a_dashboard(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [(i, i) for i in range(5)])
    schema = spark.read.parquet(source).schema
    stream = request_counts(live.read_log(spark, source, schema), 300)
    seen = []
    query = live.to_batches(stream, str(tmp_path / "check"), lambda df, n: seen.append(df.count()), "1 second")
    query.processAllAvailable()
    query.stop()
    assert seen and seen[0] == 1

"""The live metrics, drained once over the event files."""

from pyspark.sql import functions as F

from shelfkin.functions import buckets as B
from shelfkin.plans import standins as S
from shelfkin.session import scratch_dir
from shelfkin.streaming import live

from .metrics import SQL as BATCH
from .sql import LOG, sliding


def event_stream(spark, sf):
    """The request log as a stream of the event table's files."""
    schema = S.table(spark, sf, "events").schema
    return S.log_from_events(live.read_log(spark, sf, schema, "events.parquet"))


def drained(stream, columns=()):
    spark = stream.sparkSession
    path = scratch_dir(spark, "live")
    live.to_table(stream, path, scratch_dir(spark, "live-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).withColumns({c: F.round(c, 6) for c in columns})


def sample_stream(spark, sf):
    """The sampled counters as a stream of the event table's files."""
    schema = S.table(spark, sf, "events").schema
    return S.samples_from_events(live.read_log(spark, sf, schema, "events.parquet"))


def counter_rates(spark, sf):
    return drained(live.live_counter_rates(sample_stream(spark, sf), ["metric", "device"]), ["increase", "rate"])


QUERIES = {
    "m19_live_request_counts": lambda spark, sf: drained(live.live_request_counts(event_stream(spark, sf))),
    "m19_live_durations": lambda spark, sf: drained(live.live_durations(event_stream(spark, sf)), ["total"]),
    "m19_live_rates": lambda spark, sf: drained(live.live_rates(event_stream(spark, sf)), ["rate"]),
    "m19_live_mean_durations": lambda spark, sf: drained(live.live_mean_durations(event_stream(spark, sf)), ["total", "mean_s"]),
    "m19_live_in_progress": lambda spark, sf: drained(live.live_in_progress(event_stream(spark, sf))),
    "m19_live_counter_rates": counter_rates,
    "m19_live_status_shares": lambda spark, sf: drained(live.live_status_shares(event_stream(spark, sf)), ["rate", "share"]),
}

# A window is written once the watermark, ten minutes behind the last event, has passed it.
_CLOSED = "window_end <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTES"
_TUMBLING = sliding("log", 300, 300)
_SLIDING = sliding("log")
_BUCKETS = ", ".join(f"count(*) FILTER (duration_s <= {b}) AS {B.bucket_column(b)}" for b in B.REQUEST_BOUNDS)

SQL = {
    "m19_live_request_counts": f"""WITH {LOG},{_TUMBLING}
        SELECT window_start, window_end, method, endpoint, status_code, count(*) AS requests FROM windowed WHERE {_CLOSED} GROUP BY ALL""",
    "m19_live_durations": f"""WITH {LOG},{_TUMBLING}
        SELECT window_start, window_end, method, endpoint, {_BUCKETS}, count(*) AS n, round(sum(duration_s), 6) AS total
        FROM windowed WHERE {_CLOSED} GROUP BY ALL""",
    "m19_live_rates": f"""WITH {LOG},{_SLIDING}
        SELECT window_start, window_end, method, endpoint, status_code, count(*) AS events, round(count(*) / 300.0::DOUBLE, 6) AS rate
        FROM windowed WHERE {_CLOSED} GROUP BY ALL""",
    "m19_live_mean_durations": f"""WITH {LOG},{_SLIDING}
        SELECT window_start, window_end, method, endpoint, round(sum(duration_s), 6) AS total, count(*) AS n,
               round(sum(duration_s) / count(*), 6) AS mean_s FROM windowed WHERE {_CLOSED} GROUP BY ALL""",
    # The batch SQL, of which only closed windows are written.
    "m19_live_in_progress": f"SELECT * FROM ({BATCH['m3_in_progress']}) WHERE {_CLOSED}",
    "m19_live_counter_rates": f"SELECT * FROM ({BATCH['m11_counter_rate']}) WHERE {_CLOSED}",
    "m19_live_status_shares": f"SELECT * FROM ({BATCH['m13_status_shares']}) WHERE {_CLOSED}",
}

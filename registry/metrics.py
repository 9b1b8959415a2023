"""Counters, histograms, gauges and rates over the request log."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfkin.functions import buckets as B
from shelfkin.operators import counters as C
from shelfkin.operators import exposition as E
from shelfkin.operators import gauges as G
from shelfkin.operators import rates as R
from shelfkin.operators import scrapes as Q
from shelfkin.plans import standins as S
from shelfkin.session import scratch_dir

from .sql import LOG, sliding

SERIES = ["method", "endpoint"]


def log(spark, sf):
    return S.request_log(spark, sf)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def counts(spark, sf):
    return C.request_counts(log(spark, sf))


def durations(spark, sf):
    wide = C.histogram(log(spark, sf), SERIES, B.REQUEST_BOUNDS)
    return rounded(C.histogram_rows(wide, SERIES, B.REQUEST_BOUNDS), "total")


def progress(spark, sf):
    return G.in_progress(log(spark, sf))


def recommendations(spark, sf):
    return C.recommendation_counts(log(spark, sf))


def recommendation_durations(spark, sf):
    kind = C.type_or_error("rec_type").alias("recommendation_type")
    wide = C.histogram(log(spark, sf), [kind], B.RECOMMENDATION_BOUNDS)
    return rounded(C.histogram_rows(wide, ["recommendation_type"], B.RECOMMENDATION_BOUNDS), "total")


def quality(spark, sf):
    scored = log(spark, sf).withColumn("score", F.when(~F.col("error"), F.col("duration_s")))
    return G.last_values(scored, ["rec_type"], "score")


def samples(spark, sf):
    return S.samples(spark, sf).withColumn("device", F.col("labels")["device"])


def last_samples(spark, sf):
    return G.last_values(samples(spark, sf), ["metric", "device"])


def query_durations(spark, sf):
    kind = C.type_or_error("rec_type").alias("query_type")
    wide = C.histogram(log(spark, sf), [kind], B.QUERY_BOUNDS)
    return rounded(C.histogram_rows(wide, ["query_type"], B.QUERY_BOUNDS), "total")


def activities(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "experiment_logged").when(F.col("event_type") == "signup", "model_saved")
    return C.activity_counts(S.table(spark, sf, "events").select(F.coalesce(kind, "event_type").alias("activity")))


def exposition(spark, sf):
    """The counters written as text files and read back."""
    path = scratch_dir(spark, "exposition")
    lines = E.exposition_lines(counts(spark, sf), "api_requests_total", [*SERIES, "status_code"], "requests")
    E.write_exposition(lines, {"api_requests_total": "counter"}, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def exposed_histogram(spark, sf):
    wide = C.histogram(log(spark, sf), SERIES, B.REQUEST_BOUNDS)
    rows = rounded(C.histogram_rows(wide, SERIES, B.REQUEST_BOUNDS), "total")
    return E.histogram_lines(rows, "api_request_duration_seconds", SERIES)


def written_histogram(spark, sf):
    """The histogram written as text files and read back, each line with its number in the files."""
    path = scratch_dir(spark, "exposition")
    E.write_exposition(exposed_histogram(spark, sf), {"api_request_duration_seconds": "histogram"}, path)
    read = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return read.select(F.col("value").alias("line"), F.row_number().over(Window.orderBy("file", "at")).alias("number"))


def rate(spark, sf):
    return rounded(R.event_rate(log(spark, sf), [*SERIES, "status_code"]), "rate")


def sampled_rate(spark, sf):
    return rounded(R.counter_rate(samples(spark, sf), ["metric", "device"]), "increase", "rate")


def quantiles(spark, sf):
    wide = C.histogram(log(spark, sf), SERIES, B.REQUEST_BOUNDS, window_s=300, slide_s=60)
    read = C.histogram_quantiles(wide, B.REQUEST_BOUNDS, {"p95": 0.95, "p50": 0.5})
    return rounded(read.select("window_start", "window_end", *SERIES, "n", "p95", "p50"), "p95", "p50")


def scraped_quantiles(spark, sf):
    read = Q.scraped_quantiles(S.scraped_buckets(spark, sf), SERIES, {"p95": 0.95, "p50": 0.5})
    return rounded(read, "p95", "p50")


def whole_quantiles(spark, sf):
    wide = C.histogram(log(spark, sf), SERIES, B.REQUEST_BOUNDS)
    return rounded(C.histogram_quantiles(wide, B.REQUEST_BOUNDS, {"p95": 0.95, "p50": 0.5}).select(*SERIES, "p95", "p50"), "p95", "p50")


def shares(spark, sf):
    return rounded(R.status_shares(log(spark, sf)), "rate", "share")


def means(spark, sf):
    return rounded(R.mean_duration(log(spark, sf), SERIES), "total", "mean_s")


def latest(spark, sf):
    """The time of the last event, as a scalar subquery."""
    return log(spark, sf).select(F.max("ts")).scalar()


def status(spark, sf):
    scrapes = log(spark, sf).select("event_id", "ts", F.col("endpoint").alias("job"), F.when(F.col("duration_s") > 0.02, 1).otherwise(0).alias("up"))
    known = log(spark, sf).select(F.col("endpoint").alias("job")).distinct()
    silent = known.select(F.concat("job", F.lit("-replica")).alias("job"))
    jobs = known.unionByName(silent).withColumn("interval_s", F.when(F.col("job") == "/view", 15).otherwise(1800))
    return G.service_status(scrapes, jobs, latest(spark, sf))


def bands(spark, sf):
    metric = F.when(F.col("metric") == "click", "cpu_percent").when(F.col("metric") == "view", "memory_percent").otherwise("other")
    return G.colour_bands(samples(spark, sf).select("event_id", metric.alias("metric"), "value"))


def recent(spark, sf):
    return R.recent(log(spark, sf), latest(spark, sf)).select("event_id")


def retained(spark, sf):
    path = scratch_dir(spark, "retained")
    R.write_retained(log(spark, sf), path, latest(spark, sf))
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))


QUERIES = {
    "m1_request_counts": counts,
    "m2_duration_histogram": durations,
    "m3_in_progress": progress,
    "m4_recommendation_counts": recommendations,
    "m5_recommendation_histogram": recommendation_durations,
    "m6_quality_gauge": quality,
    "m7_last_samples": last_samples,
    "m8_query_histogram": query_durations,
    "m9_activity_counts": activities,
    "m10_exposition": exposition,
    "m10_exposition_histogram": lambda spark, sf: exposed_histogram(spark, sf).select("line"),
    "m10_written_histogram": written_histogram,
    "m11_event_rate": rate,
    "m11_counter_rate": sampled_rate,
    "m12_quantiles_windowed": quantiles,
    "m12_quantiles": whole_quantiles,
    "m12_scraped_quantiles": scraped_quantiles,
    "m13_status_shares": shares,
    "m14_mean_duration": means,
    "m15_service_status": status,
    "m16_colour_bands": bands,
    "m17_recent": recent,
    "m18_retained": retained,
}


def _histogram(keys, bounds, columns):
    ends = ", ".join(f"('{b}', {b}::DOUBLE)" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"
    return f"""WITH {LOG}
        SELECT {columns}, le, count(*) FILTER (duration_s <= bound) AS n, round(sum(duration_s), 6) AS total
        FROM log, (VALUES {ends}) b(le, bound) GROUP BY {keys}, le"""


_TYPE = "CASE WHEN error THEN rec_type || '_error' ELSE rec_type END"
_SAMPLES = "samples AS (SELECT event_id, ts, event_type AS metric, 'disk' || user_id % 4 AS device, value FROM events)"


def _quantile_sql(group, source):
    """Interpolated quantiles found by unrolling buckets into rows."""
    bounds = B.REQUEST_BOUNDS
    ends = ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(zip([0.0, *bounds], bounds)))

    def pick(q):
        return (
            f"round(coalesce(arg_min(low + (high - low) * CASE WHEN upto > below THEN ({q} * n - below) / (upto - below) ELSE 0 END, i) "
            f"FILTER (upto >= {q} * n), {bounds[-1]}), 6)"
        )

    return f"""
        cumulative AS (SELECT {group}, i, low, high, count(*) FILTER (duration_s <= high) AS upto,
                              count(*) FILTER (i > 0 AND duration_s <= low) AS below, count(*) AS n
                       FROM {source}, (VALUES {ends}) b(i, low, high) GROUP BY {group}, i, low, high)
        SELECT {group}, n, {pick(0.95)} AS p95, {pick(0.5)} AS p50 FROM cumulative GROUP BY {group}, n"""


SQL = {
    "m1_request_counts": f"WITH {LOG} SELECT method, endpoint, status_code, count(*) AS requests FROM log GROUP BY ALL",
    "m2_duration_histogram": _histogram("method, endpoint", B.REQUEST_BOUNDS, "method, endpoint"),
    # Counted where it can peak: at every start of a request, and where a window begins.
    "m3_in_progress": f"""WITH {LOG},
        spans AS (SELECT method, endpoint, epoch_us(ts) AS low, epoch_us(ts) + round(duration_s * 1000000)::BIGINT AS high FROM log),
        ends AS (SELECT method, endpoint, min(low) - min(low) % 3600000000 AS first, max(high) - max(high) % 3600000000 AS last FROM spans GROUP BY ALL),
        windows AS (SELECT method, endpoint, unnest(range(first, last + 1, 3600000000)) AS start FROM ends),
        moments AS (SELECT method, endpoint, start, start AS us FROM windows
                    UNION SELECT method, endpoint, low - low % 3600000000, low FROM spans),
        counted AS (SELECT m.method, m.endpoint, m.start, m.us, count(s.low) AS open
                    FROM moments m LEFT JOIN spans s ON s.method = m.method AND s.endpoint = m.endpoint AND s.low <= m.us AND s.high > m.us
                    GROUP BY ALL)
        SELECT make_timestamp(start) AS window_start, make_timestamp(start + 3600000000) AS window_end,
               method, endpoint, max(open) AS most_in_progress FROM counted GROUP BY ALL""",
    "m4_recommendation_counts": f"""WITH {LOG} SELECT coalesce(user_id, 'unknown') AS user_id, {_TYPE} AS recommendation_type,
        count(*) AS recommendations FROM log GROUP BY ALL""",
    "m5_recommendation_histogram": _histogram(_TYPE, B.RECOMMENDATION_BOUNDS, f"{_TYPE} AS recommendation_type"),
    "m6_quality_gauge": f"""WITH {LOG} SELECT rec_type, arg_max(duration_s, (ts, event_id)) AS score, max(ts) AS ts
        FROM log WHERE NOT error GROUP BY rec_type""",
    "m7_last_samples": f"WITH {_SAMPLES} SELECT metric, device, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM samples GROUP BY ALL",
    "m8_query_histogram": _histogram(_TYPE, B.QUERY_BOUNDS, f"{_TYPE} AS query_type"),
    "m9_activity_counts": """SELECT count(*) FILTER (event_type = 'purchase') AS experiments_logged,
        count(*) FILTER (event_type = 'signup') AS models_saved FROM events""",
    "m10_exposition": f"""WITH {LOG}
        SELECT 'api_requests_total{{method="' || method || '",endpoint="' || endpoint || '",status_code="' || status_code || '"}} '
               || count(*) AS line FROM log GROUP BY method, endpoint, status_code
        UNION ALL SELECT '# TYPE api_requests_total counter'""",
    "m11_event_rate": f"""WITH {LOG},{sliding('log')}
        SELECT window_start, window_end, method, endpoint, status_code, count(*) AS events, round(count(*) / 300.0::DOUBLE, 6) AS rate
        FROM windowed GROUP BY ALL""",
    "m11_counter_rate": f"""WITH {_SAMPLES},
        before AS (SELECT *, lag(value) OVER (PARTITION BY metric, device ORDER BY ts, event_id) AS previous FROM samples),
        grown AS (SELECT *, CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END AS increase FROM before),
        {sliding('grown')}
        SELECT window_start, window_end, metric, device, round(sum(increase), 6) AS increase, round(sum(increase) / 300, 6) AS rate
        FROM windowed GROUP BY ALL""",
    "m12_quantiles_windowed": f"WITH {LOG},{sliding('log')},{_quantile_sql('window_start, window_end, method, endpoint', 'windowed')}",
    "m12_quantiles": f"SELECT * EXCLUDE (n) FROM (WITH {LOG},{_quantile_sql('method, endpoint', 'log')})",
    "m13_status_shares": f"""WITH {LOG},{sliding('log')},
        counted AS (SELECT window_start, window_end, status_code, count(*) AS events FROM windowed GROUP BY ALL)
        SELECT *, round(events / 300.0::DOUBLE, 6) AS rate, round(events / sum(events) OVER (PARTITION BY window_start), 6)::DOUBLE AS share FROM counted""",
    "m14_mean_duration": f"""WITH {LOG},{sliding('log')}
        SELECT window_start, window_end, method, endpoint, round(sum(duration_s), 6) AS total, count(*) AS n,
               round(sum(duration_s) / count(*), 6) AS mean_s FROM windowed GROUP BY ALL""",
    "m15_service_status": f"""WITH {LOG},
        seen AS (SELECT endpoint AS job, arg_max(duration_s > 0.02, (ts, event_id)) AS alive, max(ts) AS ts FROM log GROUP BY ALL),
        jobs AS (SELECT job, CASE WHEN job = '/view' THEN 15 ELSE 1800 END AS interval_s FROM seen
                 UNION ALL SELECT job || '-replica', 1800 FROM seen),
        state AS (SELECT jobs.job, CASE WHEN alive AND epoch_us((SELECT max(ts) FROM log)) - epoch_us(ts) <= interval_s * 1000000
                                        THEN 1 ELSE 0 END::INT AS up FROM jobs LEFT JOIN seen USING (job))
        SELECT job, up, CASE WHEN up = 1 THEN 'UP' ELSE 'DOWN' END AS status FROM state""",
    "m16_colour_bands": """
        SELECT event_id, CASE event_type WHEN 'click' THEN 'cpu_percent' WHEN 'view' THEN 'memory_percent' ELSE 'other' END AS metric, value,
               CASE WHEN event_type = 'click' THEN CASE WHEN value >= 90 THEN 'red' WHEN value >= 70 THEN 'yellow' ELSE 'green' END
                    WHEN event_type = 'view' THEN CASE WHEN value >= 95 THEN 'red' WHEN value >= 80 THEN 'yellow' ELSE 'green' END END AS colour
        FROM events""",
    "m17_recent": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "m18_retained": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 DAYS""",
}

_LABELS = "'{method=\"' || method || '\",endpoint=\"' || endpoint || '\"'"
_LINES = f"""
    SELECT 'api_request_duration_seconds_bucket' || {_LABELS} || ',le="' || le || '"}} ' || n AS line,
           {_LABELS} AS series, 0 AS part, CASE WHEN le = '+Inf' THEN 'inf' ELSE le END::DOUBLE AS le FROM rows
    UNION ALL SELECT 'api_request_duration_seconds_sum' || {_LABELS} || '}} ' || CASE WHEN total = floor(total) THEN total::BIGINT::VARCHAR ELSE total::VARCHAR END,
           {_LABELS}, 1, 0 FROM rows WHERE le = '+Inf'
    UNION ALL SELECT 'api_request_duration_seconds_count' || {_LABELS} || '}} ' || n, {_LABELS}, 2, 0 FROM rows WHERE le = '+Inf'"""
_ROWS = f"rows AS ({_histogram('method, endpoint', B.REQUEST_BOUNDS, 'method, endpoint')}), lines AS ({_LINES})"
SQL["m10_exposition_histogram"] = f"WITH {_ROWS} SELECT line FROM lines"
SQL["m10_written_histogram"] = f"""
    WITH {_ROWS} SELECT line, (1 + row_number() OVER (ORDER BY series, part, le))::INT AS number FROM lines
    UNION ALL SELECT '# TYPE api_request_duration_seconds histogram', 1"""


def _scraped_sql():
    """Scraped bucket counters, their increases by windows, and quantiles found row by row."""
    ends = ", ".join(f"('{b}', {b}::DOUBLE)" for b in B.REQUEST_BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)"

    def pick(q):
        reached = f"bound < 'inf'::DOUBLE AND upto >= {q} * n"
        value = f"low + (bound - low) * CASE WHEN upto > below THEN ({q} * n - below) / (upto - below) ELSE 0 END"
        return f"round(CASE WHEN any_value(n) > 0 THEN coalesce(arg_min({value}, bound) FILTER ({reached}), max(bound) FILTER (bound < 'inf'::DOUBLE)) END, 6) AS p{round(q * 100)}"

    return f"""WITH {LOG},
        minutes AS (
            SELECT method, endpoint, le, bound, epoch_us(ts) // 60000000 + 1 AS minute, count(*) FILTER (duration_s <= bound) AS n
            FROM log, (VALUES {ends}) b(le, bound) GROUP BY ALL),
        counted AS (SELECT *, make_timestamp(minute * 60000000) AS ts,
                           sum(n) OVER (PARTITION BY method, endpoint, le, (minute - 1) // 1440 ORDER BY minute)::DOUBLE AS value FROM minutes),
        samples AS (SELECT * FROM counted WHERE NOT (le = '0.5' AND endpoint = '/view') AND NOT (le = '0.25' AND minute % 3 = 0)),
        before AS (SELECT *, lag(value) OVER (PARTITION BY method, endpoint, le ORDER BY ts) AS previous FROM samples),
        grown AS (SELECT *, CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END AS increase FROM before),
        {sliding('grown')},
        summed AS (SELECT window_start, window_end, method, endpoint, bound, sum(increase) AS increase FROM windowed GROUP BY ALL),
        repaired AS (SELECT *, max(increase) OVER (PARTITION BY window_start, method, endpoint ORDER BY bound) AS upto FROM summed),
        sided AS (SELECT *, coalesce(lag(upto) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS low,
                         max(CASE WHEN bound = 'inf'::DOUBLE THEN upto END) OVER (PARTITION BY window_start, method, endpoint) AS n
                  FROM repaired WINDOW w AS (PARTITION BY window_start, method, endpoint ORDER BY bound))
        SELECT window_start, window_end, method, endpoint, any_value(n) AS n, {pick(0.95)}, {pick(0.5)} FROM sided GROUP BY ALL"""


SQL["m12_scraped_quantiles"] = _scraped_sql()

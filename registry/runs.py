"""Run tables made from conversations: a run per conversation, a step per turn."""

from pyspark.sql import functions as F

from shelfkin.operators import runs as X
from shelfkin.operators.loading import require_columns
from shelfkin.plans import standins as S
from shelfkin.session import scratch_dir
from shelfkin.sources.product_tables import replace_table

EXPERIMENT = "chat-1"


def turns(spark, sf):
    return S.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.concat(F.lit("chat-"), (F.col("conv_id") % 3).cast("string")).alias("experiment"),
        F.md5(F.concat(F.lit("chat-"), (F.col("conv_id") % 3).cast("string"))).alias("experiment_id"),
        F.col("turn").cast("int").alias("step"),
        F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
        "role",
        F.char_length("text").alias("length"),
        F.when(F.col("role") == "assistant", F.char_length("text")).alias("response_length"),
    )


def params(spark, sf):
    path = scratch_dir(spark, "run-params")
    X.append_rows(X.param_rows(turns(spark, sf), ["role", "experiment"]), path)
    return spark.read.parquet(path)


def metrics(spark, sf):
    return X.metric_rows(turns(spark, sf), ["length", "response_length"])


def experiments(spark, sf):
    seen = turns(spark, sf).filter("step = 0")
    existing = seen.filter("role = 'system'").select("experiment_id", F.col("experiment").alias("name")).distinct()
    names = turns(spark, sf).select(F.concat("experiment", F.lit("-"), "role").alias("name")).unionByName(
        seen.select(F.col("experiment").alias("name"))
    )
    return X.ensure_experiments(existing, names)


def states(spark, sf):
    failed = F.when(F.col("length") > 400, F.lit("too long"))
    return X.run_states(turns(spark, sf).withColumn("error", failed))


def _id(name):
    import hashlib

    return hashlib.md5(name.encode()).hexdigest()


def search(spark, sf):
    return X.search_runs(metrics(spark, sf), _id(EXPERIMENT), ["length", "response_length"])


def all_runs(spark, sf):
    """Every conversation is a run, also those without an answer, which is the metric."""
    t = turns(spark, sf)
    failed = F.when(F.col("length") > 400, F.lit("too long"))
    known = t.groupBy("run_id", "experiment_id").agg(F.count("*").alias("n_turns"))
    runs = known.join(X.run_states(t.withColumn("error", failed)).select("run_id", "status"), "run_id")
    return X.search_runs(
        X.metric_rows(t, ["response_length"]), _id(EXPERIMENT), ["response_length"], runs, X.param_rows(t, ["experiment", "role"]), ["experiment", "role"]
    )


def best_row(spark, sf):
    return X.best_of(all_runs(spark, sf), "response_length")


def best(key, ascending):
    return lambda spark, sf: X.best_run(metrics(spark, sf), _id(EXPERIMENT), key, ascending)


def timed(spark, sf):
    path, target = scratch_dir(spark, "timings"), scratch_dir(spark, "products")
    X.timed(spark, "store_products", path, lambda: replace_table(S.products(spark, sf), target))
    try:
        X.timed(spark, "check_columns", path, lambda: require_columns(S.products(spark, sf), ["absent"]))
    except ValueError:
        pass
    stored = spark.read.parquet(path)
    return stored.groupBy("query_type", "outcome").agg(F.count_if(F.col("duration_s") >= 0).alias("calls"))


QUERIES = {
    "x1_log_params": params,
    "x1_log_metrics": metrics,
    "x2_ensure_experiments": experiments,
    "x3_run_states": states,
    "x4_search_runs": search,
    "x4_search_all_runs": all_runs,
    "x5_best_run_row": best_row,
    "x5_best_run_max": best("length", False),
    "x5_best_run_min": best("length", True),
    "x5_best_run_unknown": best("no_such_metric", False),
    "u3_timed": timed,
}

_TURNS = """
  turns AS (SELECT conv_id::VARCHAR AS run_id, 'chat-' || conv_id % 3 AS experiment, md5('chat-' || conv_id % 3) AS experiment_id,
                   turn::INT AS step, make_timestamp((conv_id * 3600 + turn) * 1000000) AS ts, role, length(text) AS length,
                   CASE WHEN role = 'assistant' THEN length(text) END AS response_length
            FROM conversations)"""
_METRICS = f"""{_TURNS},
  metrics AS (SELECT run_id, experiment_id, 'length' AS key, length::DOUBLE AS value, step, ts FROM turns
              UNION ALL SELECT run_id, experiment_id, 'response_length', response_length, step, ts FROM turns WHERE response_length IS NOT NULL),
  latest AS (SELECT run_id, key, arg_max(value, step) AS value FROM metrics WHERE experiment_id = md5('{EXPERIMENT}') GROUP BY ALL)"""

SQL = {
    "x1_log_params": f"""WITH {_TURNS} SELECT run_id, experiment_id, 'role' AS key, role AS value FROM turns
        UNION ALL SELECT run_id, experiment_id, 'experiment', experiment FROM turns""",
    "x1_log_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "x2_ensure_experiments": f"""WITH {_TURNS},
        names AS (SELECT experiment || '-' || role AS name FROM turns UNION SELECT experiment FROM turns WHERE step = 0
                  UNION SELECT experiment FROM turns WHERE step = 0 AND role = 'system')
        SELECT DISTINCT md5(name) AS experiment_id, name FROM names""",
    "x3_run_states": f"""WITH {_TURNS}
        SELECT run_id, CASE WHEN arg_max(length, ts) > 400 THEN 'FAILED' ELSE 'FINISHED' END AS status, max(ts) AS ended_at
        FROM turns GROUP BY run_id""",
    "x4_search_runs": f"""WITH {_METRICS}
        SELECT run_id, max(value) FILTER (key = 'length') AS length, max(value) FILTER (key = 'response_length') AS response_length
        FROM latest GROUP BY run_id""",
    "x4_search_all_runs": all_runs,
    "x5_best_run_row": best_row,
    "x5_best_run_max": f"WITH {_METRICS} SELECT run_id, value FROM latest WHERE key = 'length' ORDER BY value DESC, run_id LIMIT 1",
    "x5_best_run_min": f"WITH {_METRICS} SELECT run_id, value FROM latest WHERE key = 'length' ORDER BY value, run_id LIMIT 1",
    "x5_best_run_unknown": f"WITH {_METRICS} SELECT run_id, value FROM latest WHERE key = 'no_such_metric'",
}
SQL["u3_timed"] = """
    SELECT 'store_products' AS query_type, 'ok' AS outcome, 1 AS calls
    UNION ALL SELECT 'check_columns_error', 'error', 1"""

SQL["x4_search_all_runs"] = f"""WITH {_TURNS},
    states AS (SELECT run_id, CASE WHEN arg_max(length > 400, (ts, length > 400)) THEN 'FAILED' ELSE 'FINISHED' END AS status FROM turns GROUP BY run_id)
    SELECT t.run_id, experiment_id, count(*) AS n_turns, status,
           arg_max(response_length, step) FILTER (response_length IS NOT NULL)::DOUBLE AS response_length,
           max(experiment) AS experiment, max(role) AS role
    FROM turns t JOIN states USING (run_id) WHERE experiment_id = md5('{EXPERIMENT}') GROUP BY t.run_id, experiment_id, status"""
SQL["x5_best_run_row"] = f"""SELECT * FROM ({SQL['x4_search_all_runs']})
    WHERE response_length IS NOT NULL ORDER BY response_length DESC, run_id LIMIT 1"""

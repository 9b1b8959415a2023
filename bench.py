"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per query, the fastest counts (default 2, after one warm-up)
BENCH_QUERIES  comma-separated names to run instead of the headline list
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import registry  # noqa: E402
from shelfkin.session import local_session  # noqa: E402

HEADLINE = [
    "s3_clean_products",
    "s7_check_products",
    "s8_generate_products",
    "s10_assign_images",
    "l4_product_options",
    "t5_lemmatize",
    "t5_lemmatize_joined",
    "t6_preprocess_text",
    "t7_embed_text",
    "v1_similarity_entries",
    "v4_blend",
    "v9_recommend",
    "v9_recommend_stored",
    "v11_recommend_all",
    "v12_recommend_requests",
    "v13_euclidean_all",
    "rag1_knowledge_prompts",
    "r7_generate",
    "s11_vector_store",
    "s12_read_images",
    "i4_build_vectors",
    "r5_responses",
    "r6_paragraphs",
    "x4_search_runs",
    "m1_request_counts",
    "m2_duration_histogram",
    "m3_in_progress",
    "m11_event_rate",
    "m11_counter_rate",
    "m12_quantiles_windowed",
    "m13_status_shares",
    "m14_mean_duration",
    "m19_live_request_counts",
]


def timed(query, spark, folder):
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    queries = registry.all_queries()
    seconds = {}
    for name in names:
        timed(queries[name], spark, folder)
        seconds[name] = round(min(timed(queries[name], spark, folder) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

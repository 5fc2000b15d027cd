"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores. Every query runs
from the raw tables to its last row; nothing prepared is carried over from one query to the next.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalens.queries import QUERIES  # noqa: E402
from catalens.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "q_laptop_features", "q_corr_target", "q_validate_requests", "q_histogram_lineitem", "q_kde", "q_bootstrap_ci",
    "q_tags", "q_term_counts", "q_content_topk", "q_topk_many_seeds", "q_stemmed_topk", "q_genre_topk", "q_director_top", "q_recommend_all",
    "q_similar_all", "q_genre_all", "q_sample_per_seed", "q_knn3", "q_ols", "q_tree", "q_forest", "q_rbf_svr",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the session outside the timings
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

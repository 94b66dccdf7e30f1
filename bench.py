"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "token_coverage", "clean_code", "tokenize_code", "drop_all_duplicates", "exact_split", "line_diff",
    "enclosing_scope_text", "scope_variants", "vocabulary", "padded_features", "hashed_ngrams", "bag_of_words",
    "document_vectors", "khop_neighbours", "line_edges", "dependence_contexts", "neighbour_sum", "attached_metrics",
    "blame_candidates", "introducing_functions", "target_scores", "compared_results", "nearest_neighbours",
)


def main():
    from faultline.cluster import local_session
    from faultline.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    QUERIES["clean_code"](spark, sf_dir).limit(1).collect()  # start-up and class loading are not a query
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

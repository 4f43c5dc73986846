"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gistmill.registry import all_queries
from gistmill.session import build_session

HEADLINE = [
    "prepare_corpus",
    "build_variants",
    "sliding_segments",
    "category_words",
    "build_vocabulary",
    "tfidf",
    "encode",
    "ctfidf",
    "topic_info",
    "coherence_cv",
    "classify_documents",
    "knn_graph",
    "mine_triplets",
    "density_clusters",
    "davies_bouldin",
    "category_alignment",
    "prompt_ablation",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the JVM's and Python's worker pools before timing.
    for name in ("pairwise_cosine", "strip_punct", "topic_words"):
        queries[name](spark, sf).count()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

#: What is built once has entries of its own, build_index and build_vector_lists; the queries find it built.
HEADLINE = ("term_freq", "bm25_daat_topk", "bm25_wand_topk", "bm25_bmw_topk", "evaluate_means", "exact_knn", "ivf_pq", "rrf", "sharded_topk", "tombstone_search", "open_loop_single_worker", "lru_hits", "latency_percentiles")


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lodestar.plans import catalog
    from lodestar.plans.catalog import QUERIES

    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    took: dict[str, float] = {}
    for name, build in (("build_index", catalog.index_of), ("build_vector_lists", catalog.vector_lists_of)):
        began = time.perf_counter()
        build(spark, sf_dir)
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    for name in (q for q in HEADLINE if q in QUERIES):
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "bench_queries": asked}))
    spark.stop()


if __name__ == "__main__":
    main()

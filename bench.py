"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.operators import index, recall
from lodestone.session import configure
from workload import bindings, registry, words

HEADLINE = [
    "c3_term_stats",
    "e1_bm25_top10",
    "e4_coarse_rank",
    "d2_vector_exact",
    "d3_vector_cells",
    "g2_prefix_dictionary",
    "g5_suggest",
    "h5_hints",
    "j4_cooccurrence",
    "j5_top_cooccur",
    "k2_profiles",
    "k3_refresh_interests",
    "k4_interest_vectors",
    "d7_fuse_rrf",
    "o1_search_ranked",
    "o1_search",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries, times = registry.queries(), {}

    def run(name, make) -> None:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    run("warm_up", lambda: spark.read.parquet(f"{d}/region.parquet"))
    # Derived stores that queries read; built before the clock starts.
    for build in (bindings.corpus, bindings.catalog, bindings.user_profiles, words.cooccur):
        build(spark, d)
    run("index_build", lambda: index.build_postings(bindings.corpus(spark, d)))
    start = time.perf_counter()
    snapshot = bindings.snapshot(spark, d)
    times["index_snapshot"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    bindings.vector_cells(spark, d)
    times["vector_index"] = round(time.perf_counter() - start, 3)
    run("bm25_all_queries", lambda: recall.search_bm25(bindings.queries(spark, d), snapshot, 10))
    for name in HEADLINE:
        run(name, lambda n=name: queries[n](spark, d))
    times.pop("warm_up")
    total = round(sum(times.values()), 3)
    n = bindings.raw_queries(spark, d).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
                "search_queries": n,
                "bm25_queries_per_sec": round(n / times["bm25_all_queries"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite.queries import QUERIES, graph_of  # noqa: E402

HEADLINE = (
    "star_query",
    "star_query_no_hierarchy",
    "star_query_early_stop",
    "star_query_fixpoint",
    "compare_hierarchy",
    "chain_two",
    "chain_three",
    "run_workload",
    "nation_workload",
    "nation_chains",
    "top_k_sweep",
    "answer_paths",
    "size_sweep",
    "star_visit_pruned",
    "star_visit_coverage",
    "shortest_path",
    "chain_k_sweep",
    "chain_three_fixpoint",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    times = {}

    started = time.time()
    graph_of(spark, folder)
    times["graph_layout"] = round(time.time() - started, 3)
    QUERIES["star_query"](spark, folder).collect()  # compile once, as in a running service
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).collect()
        times[name] = round(time.time() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one line of JSON.

Each query runs once to warm up and then REPEATS times; the fastest run counts. Results are written to the noop sink,
so that every row is made. The ingest and merge figures write to a graph of their own.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2
HEADLINE = [
    "flagship", "scan_label", "inline_props", "two_hop", "three_hop", "cycle_pattern", "comma_natural_join", "expand_edge_props", "optional_match_where", "exists_semi", "not_exists_anti",
    "pattern_comprehension", "varlen_bounded", "varlen_unbounded", "shortest_path", "group_count_sum_avg_min_max", "stdev_percentile", "top_k", "with_having", "merge_nodes", "merge_edges", "set_props", "access_log_hops",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lattica import catalogue
    from lattica.graph import PropertyGraph
    from lattica.session import GraphSession

    took: dict[str, float] = {}

    def timed(name: str, run, repeats: int = REPEATS) -> None:
        best = float("inf")
        for _ in range(repeats + 1):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)

    for name in HEADLINE:
        timed(name, lambda n=name: catalogue.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    def merge_100k() -> None:
        g = GraphSession(PropertyGraph(spark))
        rows = spark.range(100_000).selectExpr("id % 50000 as k")
        g.cypher("UNWIND $rows AS row MERGE (n:Key {k: row.k}) ON CREATE SET n.c = 1 ON MATCH SET n.c = n.c + 1", {"rows": rows})

    timed("merge_100k_keys", merge_100k, 1)

    def create_1m() -> None:
        g = GraphSession(PropertyGraph(spark))
        g.cypher("UNWIND range(1, 1000000) AS i CREATE (:Span {trace_id: 't' + toString(i), span_id: i, service: 's', op: 'o'})")
        g.cypher("MATCH (n:Span) RETURN count(n) AS c").collect()

    timed("create_and_scan_1m_nodes", create_1m, 1)
    try:
        from lattica.llm import queries as llm
    except ImportError:
        llm = None
    for name in llm.QUERIES if llm else ():
        timed(name, lambda n=name: llm.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save(), 1)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

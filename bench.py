"""Times the headline queries, the median of three runs after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from corpusloom.plans.queries import QUERIES
from corpusloom.session import session

HEADLINE = [
    "token_stats_by_lang", "flagship_rouge1_by_subset", "repetition_rate", "strip_html_pages", "sentence_split", "filter_reasons",
    "bm25_centrality", "extractive_budget", "chunk_documents", "latency_summary", "greedy_embedding_match", "pivot_counts_cube",
    "bootstrap_ci_cluster", "lexrank_centrality",
]
#: After one warm-up each query runs so often; the median counts.
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(sf_dir).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()

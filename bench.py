"""Time the headline queries; prints one JSON line.

The given tables are first copied, untimed, into FILES files each: as single files of one row group they
would be read by one task, as no table of a cluster is. Every query is run once to warm up and three times for the
figure (the median), and its whole result is written to the no-op sink, so that no work is optimised away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from checks.views import TABLES  # noqa: E402
from sparkcurate.session import local_session  # noqa: E402

HEADLINE = (
    "filter_stats", "filter_kept", "filter_stats_physics", "heal_methods", "profile",
    "topic_counts", "purity", "entropy", "rule_messages", "greedy_dedup", "collect_papers",
    "chunk_texts", "paper_prompts", "parse_pairs", "keywords", "keyword_edges", "retrieval",
    "split_60_20_20", "sample_random", "citations", "catalogue_qa", "graph_nodes", "graph_links",
    "evaluation_summary", "best_attempt", "generation_progress", "energy", "job_status",
    "jsonl_counted", "stream_filter",
)


FILES = 16


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    copies = tempfile.TemporaryDirectory(prefix="bench-")
    sf_dir = copies.name
    for table in TABLES:
        rows = spark.read.parquet(f"{given}/{table}.parquet").repartition(FILES)
        rows.write.parquet(f"{sf_dir}/{table}.parquet")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(given.rstrip("/")), "files": FILES,
            }
        )
    )


if __name__ == "__main__":
    main()

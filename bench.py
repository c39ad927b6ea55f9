"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver).  A warm-up query runs first so
JVM start-up is not charged to the first timed query.  Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "extractive_short",
    "extractive_standard",
    "extractive_detailed",
    "summarize_corpus_extractive",
    "summarize_corpus",
    "split_chunks",
    "render_prompts",
    "file_identity",
    "skip_seen",
    "list_view",
    "lookup_requests",
    "resolve_prefixes",
    "latest_per_path",
    "usage_rollup",
    "delete_requests",
    "latest_for_paths",
    "summarize_chunked",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from corpusbrief.queries import QUERIES
    from corpusbrief.session import get_session

    mem = os.environ.get("BENCH_DRIVER_MEMORY", "16g")

    spark = get_session(f"local[{cpus}]", app_name="corpusbrief-bench", shuffle_partitions=cpus * 2,
                        extra_conf={"spark.driver.memory": mem,
                                    # batch throughput: full heap from the start, throughput collector
                                    "spark.driver.extraJavaOptions": os.environ.get(
                                        "BENCH_JAVA_OPTS", f"-Xms{mem} -XX:+UseParallelGC"),
                                    "spark.sql.files.maxPartitionBytes": "16m"})
    names = sys.argv[1:] or HEADLINE
    # warm-up on the small data set: JVM JIT, codegen caches, Python workers
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("extractive_short", "extractive_standard", "extractive_detailed", "summarize_corpus_extractive",
              "summarize_corpus", "lookup_requests"):
        QUERIES[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

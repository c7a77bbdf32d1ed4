"""Timings of the headline queries, as one line of JSON.

Every query runs ``BENCH_RUNS`` times (3 by default) with all its rows written
to a sink that keeps nothing; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from pageloom.plans.queries import QUERIES

HEADLINE = (
    "scan_filter",
    "html_main_text",
    "markdown_text",
    "clean_text",
    "doc_stats",
    "clean_and_keep",
    "vector_search",
    "vector_search_category",
    "batch_topk",
    "batch_topk_blocks",
    "render_url_form",
    "upsert",
    "delete_domain",
    "embed_hashed",
    "build_documents",
    "build_and_search",
    "stream_index",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pageloom-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="pageloom-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    medians = {}
    for name in names:
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        medians[name] = round(statistics.median(seconds), 3)
    spark.stop()
    result = {
        "metric": "sum of the median seconds of the headline queries",
        "value": round(sum(medians.values()), 3),
        "unit": "sec",
        "queries": medians,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

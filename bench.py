"""Time the headline queries; prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill import catalog  # noqa: E402

HEADLINE = [
    "nodes_by_tag", "links", "path_nav", "css_descendant", "extract_table", "cells", "url_resolve", "filter_allowed",
    "pages_dedup", "fetch_join", "reshape_aligned", "reshape_strided_level", "layout_horizontal", "crawl_schedule",
    "spec_rules", "robots_rules", "csv_roundtrip", "stream_extract", "link_site", "crawl_bfs", "crawl_multi_seed",
    "crawl_redirects", "crawl_summary", "crawl_and_extract",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.files.maxPartitionBytes", "1m")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagemill-bench-"))
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="pagemill-bench-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    # Start the Python workers once, outside the clock.
    catalog.links(spark, folder).limit(1).collect()

    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        if name == "link_site":                # builds the site and its index for the crawls that follow
            catalog.link_site_tables(spark, folder)
        else:
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    pages = catalog.pages_of(spark, folder).count()
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "pages": pages,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

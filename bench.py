"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registered import QUERIES  # noqa: E402
from registered.registry import event_lines, events, table  # noqa: E402
from registered.requests import LOG  # noqa: E402
from registered.searches import ERRORS, TWO_HISTOGRAMS  # noqa: E402
from tidelog import json_lines_index, search, time_table_index, write_time_table  # noqa: E402
from tidelog.operators import many_requests as many  # noqa: E402
from tidelog.sources.shared import shared_folder  # noqa: E402

REPEATS = 3
HEADLINE = [
    "filter_bool_nested",
    "filter_multi_match_wildcard",
    "filter_multi_match_parts",
    "hist_anchored_errors",
    "hist_clock_30m",
    "hist_clock_2d",
    "hist_calendar_month",
    "hist_two_named",
    "hist_two_fields",
    "hist_merge_sources",
    "hits_topk",
    "hits_merged_topk",
    "time_index_hourly",
    "index_summary",
    "field_profile",
    "multi_search",
    "multi_search_bucketed",
    "multi_search_hits",
]


def collect(*frames) -> None:
    for df in frames:
        df.collect()


def searches(spark: SparkSession, folder: str) -> dict:
    typed = events(spark, folder)
    lines = json_lines_index(spark, "lines", event_lines(spark, folder), "datetime")
    path = shared_folder(spark, "bench-table")
    write_time_table(table(spark, folder, "events"), path, "ts")
    dated = time_table_index(
        spark, "events", path, "ts", id="event_id", text=["event_type", "props"]
    )

    def run(index, aggs):
        def job():
            result = search(index, {"query": ERRORS, "size": 50, "aggs": aggs})
            collect(result.hits, result.summary)

        return job

    one = {"day": TWO_HISTOGRAMS["day"]}
    requests = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.lit("error").alias("index"),
        F.concat(F.lit(": "), (F.col("s_nationkey")).cast("string")).alias("q"),
        F.expr("TIMESTAMP_NTZ'2024-01-03 00:00:00'").alias("gte"),
        F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'").alias("lte"),
    )

    def all_requests():
        found = many.match_requests(table(spark, folder, "events"), requests, LOG)
        collect(many.request_counts(found, requests))

    return {
        "search_0_histograms": run(typed, {}),
        "search_1_histogram": run(typed, one),
        "search_2_histograms": run(typed, TWO_HISTOGRAMS),
        "search_json_lines_1_histogram": run(lines, one),
        "search_time_table_2_histograms": run(dated, TWO_HISTOGRAMS),
        "requests_per_supplier_one_pass": all_requests,
    }


def best_of(job) -> float:
    job()  # warm up
    times = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        job()
        times.append(time.perf_counter() - start)
    return round(min(times), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = searches(spark, folder)
    for name in HEADLINE:
        jobs[name] = lambda name=name: collect(QUERIES[name](spark, folder))
    times = {name: best_of(job) for name, job in jobs.items()}
    print(
        json.dumps(
            {
                "metric": "total_time_of_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Sparse time index."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.registry import register, table
from tidelog.functions import times
from tidelog.operators.time_index import (
    end_positions,
    refresh_time_index,
    start_positions,
    time_index,
)
from tidelog.sources.shared import shared_folder

HOUR = 3_600
HOUR_US = HOUR * 1_000_000


def index_sql(step_seconds: int, source: str = "events") -> str:
    """Entries with their bucket; truncation counts from year one."""
    step, shift = step_seconds * 1_000_000, times.YEAR_ONE_SECONDS * 1_000_000
    return (
        f"SELECT ((epoch_us(ts) + {shift}) // {step} * {step} - {shift}) AS bucket_us, "
        "epoch_us(min(ts)) AS first_us, arg_min(event_id, ts) AS position "
        f"FROM {source} GROUP BY bucket_us"
    )


def flat(index):
    return index.select(
        F.expr(times.unix_micros("bucket", True)).alias("bucket_us"),
        F.expr(times.unix_micros("first_ts", True)).alias("first_us"),
        "position",
    )


def hourly(spark, folder):
    return time_index(table(spark, folder, "events"), "ts", "event_id", HOUR)


def stored_hourly(spark, folder):
    """The index is written once; lookups then read entries, not the log."""
    path = shared_folder(spark, "hourly-index")
    hourly(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


@register("time_index_hourly", index_sql(HOUR))
def time_index_hourly(spark, folder):
    return flat(hourly(spark, folder))


UNSORTED = (
    f"SELECT ((epoch_us(l_shipdate) + {times.YEAR_ONE_SECONDS * 1_000_000}) // {HOUR * 1_000_000} "
    f"* {HOUR * 1_000_000} - {times.YEAR_ONE_SECONDS * 1_000_000}) AS bucket_us, "
    "epoch_us(min(l_shipdate)) AS first_us, "
    "arg_min(l_orderkey * 10 + l_linenumber, {'t': l_shipdate, 'p': l_orderkey * 10 + l_linenumber}) "
    "AS position FROM lineitem GROUP BY bucket_us"
)


@register("time_index_unsorted", UNSORTED)
def time_index_unsorted(spark, folder):
    """Rows that come in no order of time; equal times give the least position."""
    df = table(spark, folder, "lineitem")
    rows = df.selectExpr("l_shipdate AS ts", "l_orderkey * 10 + l_linenumber AS position")
    return flat(time_index(rows, "ts", "position", HOUR))


@register("time_index_weekly", index_sql(7 * 86_400))
def time_index_weekly(spark, folder):
    """Seven days from year one start on Mondays."""
    df = table(spark, folder, "events")
    return flat(time_index(df, "ts", "event_id", 7 * 86_400))


@register("time_index_refresh", index_sql(HOUR))
def time_index_refresh(spark, folder):
    """A stored index of the first part, then only the tail is indexed."""
    df = table(spark, folder, "events")
    cut = F.expr("TIMESTAMP_NTZ'2024-01-20 10:20:30'")
    path = shared_folder(spark, "time-index")
    stored = time_index(df.where(F.col("ts") < cut), "ts", "event_id", HOUR)
    stored.write.parquet(path)
    tail = time_index(df.where(F.col("ts") >= cut), "ts", "event_id", HOUR)
    return flat(refresh_time_index(spark.read.parquet(path), tail))


def asked(spark, folder):
    """One request per event: 100 minutes before it happened."""
    when = F.timestamp_add("MINUTE", F.lit(-100), F.col("ts")).alias("asked")
    return table(spark, folder, "events").select("event_id", when)


ENTRIES = (
    "WITH entries AS (SELECT min(ts) AS first_ts, arg_min(event_id, ts) AS position "
    "FROM events GROUP BY date_trunc('hour', ts)), "
    "asked AS (SELECT event_id, ts - INTERVAL 100 MINUTE AS asked FROM events) "
)


@register(
    "time_index_start",
    ENTRIES + "SELECT a.event_id, coalesce(e.position, 0) AS position "
    "FROM asked a ASOF LEFT JOIN entries e ON a.asked >= e.first_ts",
)
def time_index_start(spark, folder):
    index = stored_hourly(spark, folder)
    found = start_positions(asked(spark, folder), index, "asked", HOUR)
    return found.select("event_id", "position")


@register(
    "time_index_end",
    ENTRIES + "SELECT a.event_id, CASE WHEN s.position IS NOT NULL THEN s.position "
    "ELSE e.position END AS position FROM asked a "
    "ASOF LEFT JOIN entries e ON a.asked < e.first_ts "
    "LEFT JOIN entries s ON s.first_ts = date_trunc('hour', a.asked)",
)
def time_index_end(spark, folder):
    index = stored_hourly(spark, folder)
    found = end_positions(asked(spark, folder), index, "asked", HOUR)
    return found.select("event_id", "position")

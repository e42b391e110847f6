"""Measured health (A10) and requests matched on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, phrase
from registered.registry import event_lines, register, table
from registered.requests import KINDS
from registered.sources import LINE_FIELDS
from tidelog import json_lines_index, match_new_files, match_totals, search_observed
from tidelog.functions.documents import row_json
from tidelog.functions.times import format_rfc3339_fraction
from tidelog.operators import many_requests as many
from tidelog.sources.shared import shared_folder
from tidelog.sources.writers import write_json_lines


def damaged_lines(spark, folder) -> str:
    """``events`` as JSON lines of which every fifth is cut off."""
    lines = table(spark, folder, "events").select(
        "event_id",
        row_json("event_id", "event_type").alias("whole"),
    )
    path = shared_folder(spark, "damaged-lines")
    broken = F.col("whole").substr(F.lit(1), F.length("whole") - 2)
    lines.select(F.when(F.col("event_id") % 5 == 0, broken).otherwise(F.col("whole")).alias("value")).write.text(path)
    return path


@register(
    "health_observed",
    "SELECT 'lines' AS name, 1 AS successful, 0 AS failed, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(0 AS BIGINT) AS n_malformed, CAST(0 AS BIGINT) AS n_untimed FROM events "
    "UNION ALL SELECT 'damaged', 1, 0, CAST(count(*) AS BIGINT), "
    "CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT), CAST(count(*) AS BIGINT) FROM events "
    "UNION ALL SELECT 'missing', 0, 1, NULL, NULL, NULL "
    "UNION ALL SELECT 'all', 2, 1, CAST(count(*) AS BIGINT), NULL, NULL FROM events "
    "WHERE event_type = 'error'",
)
def health_observed(spark, folder):
    """Three sources, one with damaged lines and one that is not there; the last
    row counts what the others found."""
    gone = shared_folder(spark, "no-such-lines")
    sources = {
        "lines": lambda: json_lines_index(spark, "lines", event_lines(spark, folder), "datetime"),
        "damaged": lambda: json_lines_index(spark, "damaged", damaged_lines(spark, folder), "datetime"),
        "missing": lambda: json_lines_index(spark, "missing", gone, "datetime"),
    }
    request = {"query": bool_filter(must=[phrase(message="error")]), "size": 5}
    result = search_observed(spark, sources, request)
    counts = ["n_rows", "n_malformed", "n_untimed"]
    each = result.source_health.select("name", "successful", "failed", *counts)
    found = result.totals.selectExpr("0 AS successful", "0 AS failed", "total AS n_rows")
    health = result.health.selectExpr("successful", "failed", "NULL AS n_rows")
    whole = health.unionByName(found).agg(
        F.sum("successful").cast("int").alias("successful"),
        F.sum("failed").cast("int").alias("failed"),
        F.sum("n_rows").alias("n_rows"),
    )
    return each.unionByName(whole.withColumn("name", F.lit("all")), allowMissingColumns=True)


STREAMED = f"""
WITH requests AS (
    SELECT s_suppkey AS id, ({KINDS})[s_nationkey % 6 + 1] AS index,
           CASE WHEN s_nationkey % 4 <> 0 THEN '"event_id":' || s_nationkey END AS q,
           TIMESTAMP '2024-01-01' + to_days(CAST(s_nationkey AS INTEGER)) AS gte
    FROM supplier)
SELECT r.id, CAST(count(*) AS BIGINT) AS n, CAST(sum(e.event_id) AS BIGINT) AS ids FROM requests r JOIN events e
ON e.event_type = r.index AND e.ts >= r.gte AND (r.q IS NULL OR contains('"event_id":' || e.event_id || ',', r.q))
GROUP BY r.id
"""


@register("stream_matches", STREAMED)
def stream_matches(spark, folder):
    """Two arrivals of lines matched as they come, and a call without news."""
    base = shared_folder(spark, "matches")
    source, target, state = f"{base}/in", f"{base}/found", f"{base}/state"
    nation = F.col("s_nationkey")
    asked = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.array(*[F.lit(kind) for kind in KINDS])[nation % 6].alias("index"),
        F.when(nation % 4 != 0, F.concat(F.lit('"event_id":'), nation.cast("string"))).alias("q"),
        F.timestamp_seconds(1_704_067_200 + 86_400 * nation).alias("gte"),
        F.expr("CAST(NULL AS TIMESTAMP)").alias("lte"),
    )
    rows = table(spark, folder, "events").select(
        F.expr(format_rfc3339_fraction("ts", True, 6)).alias("datetime"),
        F.col("event_type").alias("message"),
        "event_id",
        "value",
    )
    log = many.LogSide(index="message", time="datetime", raw="raw")
    for arrival in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1, None):
        if arrival is not None:
            write_json_lines(rows.where(arrival), source, "append")
        match_new_files(spark, source, asked, target, state, LINE_FIELDS, log).awaitTermination()
    return match_totals(spark, target, "event_id").withColumnRenamed("sum_event_id", "ids")

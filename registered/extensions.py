"""Request keys that only take effect as extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, phrase, text
from registered.histograms import BUCKET, DAY_US, HOUR_US, anchored_key, clock_key, whole_only
from registered.registry import (
    GTE,
    GTE_SQL,
    LTE,
    LTE_SQL,
    buckets_sql,
    events,
    orders,
    register,
    rfc3339,
    table,
)
from tidelog import log_index, search
from tidelog.functions import times
from tidelog.functions.intervals import columnar_interval, document_interval
from tidelog.operators import histogram as hist
from tidelog.operators.predicates import query_filter


@register(
    "ext_should",
    "SELECT event_id FROM events WHERE event_type = 'error' OR contains(props, '77')",
)
def should(spark, folder):
    index = events(spark, folder)
    query = bool_filter(should=[phrase(event_type="error"), text("77")])
    kept = index.df.where(query_filter(index, query, use_should=True))
    return kept.select("event_id")


@register(
    "ext_range_any_field",
    "SELECT event_id FROM events WHERE value >= 20 AND value < 60 AND event_type > 'error' "
    f"AND ts > {GTE_SQL} AND ts <= {LTE_SQL}",
)
def range_any_field(spark, folder):
    """Ranges of a number, a text and the time, with strict bounds."""
    index = events(spark, folder)
    query = bool_filter(
        filter=[
            {"range": {"value": {"gte": 20, "lt": 60}}},
            {"range": {"event_type": {"gt": "error"}}},
            {"range": {"datetime": {"gt": GTE, "lte": LTE}}},
        ]
    )
    return index.df.where(query_filter(index, query, use_should=True)).select("event_id")


RARE_SQL = "events WHERE event_type = 'error' AND contains(props, '77')"


@register(
    "ext_gap_fill",
    f"WITH counts AS (SELECT {clock_key('ts', HOUR_US)} AS key, count(*) AS n "
    f"FROM {RARE_SQL} GROUP BY key), "
    "series AS (SELECT unnest(range((SELECT min(key) FROM counts), "
    "(SELECT max(key) + 1 FROM counts), 3600000)) AS key) "
    f"SELECT s.key, {rfc3339('s.key')} AS key_as_string, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS doc_count "
    "FROM series s LEFT JOIN counts c ON c.key = s.key",
)
def gap_fill(spark, folder):
    index = events(spark, folder)
    query = bool_filter(must=[phrase(event_type="error"), text("77")])
    h = hist.Histogram("h", index.time, columnar_interval("1h", None))
    counts = hist.date_histogram(index.df.where(query_filter(index, query)), h)
    return hist.fill_gaps(counts, h).select(*BUCKET)


@register(
    "ext_gap_fill_anchored",
    f"WITH counts AS (SELECT {anchored_key('ts', GTE_SQL, HOUR_US)} AS key, count(*) AS n "
    f"FROM {RARE_SQL} AND {whole_only('ts', GTE_SQL, LTE_SQL, HOUR_US)} GROUP BY key), "
    f"series AS (SELECT (epoch_us({GTE_SQL}) + unnest(range((epoch_us({LTE_SQL}) "
    f"- epoch_us({GTE_SQL})) // {HOUR_US})) * {HOUR_US}) // 1000 AS key) "
    f"SELECT s.key, {rfc3339('s.key')} AS key_as_string, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS doc_count "
    "FROM series s LEFT JOIN counts c ON c.key = s.key",
)
def gap_fill_anchored(spark, folder):
    index = events(spark, folder, flavour="document")
    query = bool_filter(must=[phrase(event_type="error")])
    h = hist.anchored(
        "h",
        index.time,
        document_interval("1h", None),
        times.parse_instant(GTE),
        times.parse_instant(LTE),
    )
    kept = index.df.where(query_filter(index, query) & F.col("props").contains("77"))
    return hist.fill_gaps(hist.date_histogram(kept, h), h).select(*BUCKET)


@register(
    "ext_gap_fill_month",
    "WITH counts AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, "
    "count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' "
    "AND o_orderstatus = 'P' GROUP BY t), "
    "series AS (SELECT unnest(generate_series((SELECT min(t) FROM counts), "
    "(SELECT max(t) FROM counts), INTERVAL 1 MONTH)) AS t) "
    "SELECT epoch_us(s.t) // 1000 AS key, CAST(coalesce(c.n, 0) AS BIGINT) AS doc_count "
    "FROM series s LEFT JOIN counts c ON c.t = s.t",
)
def gap_fill_month(spark, folder):
    index = orders(spark, folder)
    kept = index.df.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    h = hist.Histogram("h", index.time, columnar_interval(None, "1M"))
    filled = hist.fill_gaps(hist.date_histogram(kept, h), h)
    return filled.select("key", "doc_count")


@register(
    "ext_min_doc_count",
    f"SELECT * FROM ({buckets_sql(clock_key('ts', HOUR_US), 'events')}) "
    "WHERE doc_count >= 20",
)
def min_doc_count(spark, folder):
    index = events(spark, folder)
    h = hist.Histogram("h", index.time, columnar_interval("1h", None))
    return hist.at_least(hist.date_histogram(index.df, h), 20).select(*BUCKET)


@register(
    "ext_time_zone",
    f"SELECT (epoch_us(ts) + {2 * HOUR_US}) // {DAY_US} * {DAY_US // 1000} "
    f"- {2 * HOUR_US // 1000} AS key, CAST(count(*) AS BIGINT) AS doc_count "
    "FROM events GROUP BY key",
)
def time_zone(spark, folder):
    """Days of a zone two hours ahead of UTC (its winter time)."""
    spec = {"field": "ts", "calendar_interval": "1d", "time_zone": "Europe/Kyiv"}
    request = {"aggs": {"day": {"date_histogram": spec}}}
    found = search(events(spark, folder), request, extensions=True)
    return found.aggs.select("key", "doc_count")


# Orders with their midnight dates spread over the day, six years of clock changes.
SPREAD = (
    "(SELECT ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv' AS wall FROM ("
    "SELECT o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INTEGER)) AS ts FROM orders))"
)
ZONED_HOURS = (
    "SELECT (epoch_us(ts) - epoch_us(wall) % 3600000000) // 1000 AS key, "
    f"CAST(count(*) AS BIGINT) AS doc_count FROM {SPREAD} GROUP BY key"
)


def spread_orders(spark, folder):
    at = "timestampadd(SECOND, CAST(o_orderkey % 86400 AS INT), CAST(o_orderdate AS TIMESTAMP_NTZ))"
    return log_index("orders", table(spark, folder, "orders").selectExpr("o_orderkey", f"{at} AS ts"), "ts")


def zoned_hours(spark, folder, least):
    spec = {"field": "ts", "fixed_interval": "1h", "time_zone": "Europe/Kyiv", "min_doc_count": least}
    request = {"aggs": {"hour": {"date_histogram": spec}}}
    found = search(spread_orders(spark, folder), request, extensions=True)
    return found.aggs.select("key", "doc_count")


@register("ext_time_zone_hours", ZONED_HOURS)
def time_zone_hours(spark, folder):
    return zoned_hours(spark, folder, 1)


@register(
    "ext_time_zone_gap_fill",
    f"WITH counts AS ({ZONED_HOURS}) SELECT s.key, coalesce(c.doc_count, 0) AS doc_count FROM ("
    "SELECT unnest(range((SELECT min(key) FROM counts), (SELECT max(key) FROM counts) + 1, 3600000)) AS key"
    ") s LEFT JOIN counts c ON c.key = s.key",
)
def time_zone_gap_fill(spark, folder):
    return zoned_hours(spark, folder, 0)


@register("ext_source_excludes", "SELECT event_id, user_id, event_type, value FROM events")
def source_excludes(spark, folder):
    request = {"_source": {"excludes": ["ts", "props"]}}
    hits = search(events(spark, folder), request, extensions=True).hits
    return hits.select("_source.*")


@register(
    "ext_docvalue_format",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') "
    "|| lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts_text, "
    "user_id FROM events",
)
def docvalue_format(spark, folder):
    request = {
        "docvalue_fields": [
            {"field": "ts", "format": "date_time"},
            {"field": "user_id"},
        ],
        "_source": {"excludes": ["value"]},
    }
    hits = search(events(spark, folder), request, extensions=True).hits
    return hits.select(
        F.col("_source.event_id").alias("event_id"),
        F.col("fields.ts").alias("ts_text"),
        F.col("fields.user_id").alias("user_id"),
    )

"""Hit rows, order and size."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, phrase
from registered.histograms import three_sources
from registered.registry import events, register, seconds, table
from tidelog import log_index, search, search_many, union_sources
from tidelog.operators.hits import project_hits

SORT = seconds("ts")


def flat(hits):
    """Hits of events with their id as a number and without nested columns."""
    return hits.select(
        F.col("_id").cast("bigint").alias("event_id"), F.col("sort")[0].alias("sort")
    )


@register(
    "hits_projection",
    f"SELECT 'events' AS index_name, event_id, {SORT} AS sort, event_type, value, "
    "CAST(0 AS DOUBLE) AS score FROM events",
)
def projection(spark, folder):
    hits = project_hits(events(spark, folder), table(spark, folder, "events"))
    return hits.select(
        F.col("_index").alias("index_name"),
        F.col("_id").cast("bigint").alias("event_id"),
        F.col("sort")[0].alias("sort"),
        F.col("_source.event_type").alias("event_type"),
        F.col("_source.value").alias("value"),
        F.col("_score").alias("score"),
    )


@register(
    "hits_digest_id",
    f"SELECT sha256(props) AS id, {SORT} AS sort FROM events",
)
def digest_id(spark, folder):
    """Without a key the id is a digest of the raw line."""
    df = table(spark, folder, "events")
    hits = project_hits(log_index("events", df, "ts", raw="props"), df)
    return hits.select(F.col("_id").alias("id"), F.col("sort")[0].alias("sort"))


@register(
    "hits_topk",
    f"SELECT event_id, {SORT} AS sort FROM events "
    "WHERE event_type = 'error' ORDER BY sort, event_id LIMIT 50",
)
def topk(spark, folder):
    query = bool_filter(must=[phrase(event_type="error")])
    return flat(search(events(spark, folder), {"query": query, "size": 50}).hits)


@register(
    "hits_topk_desc",
    f"SELECT event_id, {SORT} AS sort FROM events ORDER BY sort DESC, event_id LIMIT 50",
)
def topk_desc(spark, folder):
    request = {"sort": [{"ts": {"order": "desc"}}], "size": 50}
    return flat(search(events(spark, folder), request).hits)


@register(
    "hits_sorted_by_field",
    "SELECT event_id, epoch_us(ts) // 1000000 AS sort FROM events "
    "ORDER BY value DESC, sort, event_id LIMIT 50",
)
def sorted_by_field(spark, folder):
    request = {"sort": [{"value": {"order": "desc"}}, {"ts": {"order": "asc"}}], "size": 50}
    return flat(search(events(spark, folder), request).hits)


@register(
    "hits_all",
    f"SELECT event_id, {SORT} AS sort FROM events WHERE event_type = 'view'",
)
def all_hits(spark, folder):
    """No size: every matching row."""
    query = bool_filter(must=[phrase(event_type="view")])
    return flat(search(events(spark, folder), {"query": query}).hits)


@register(
    "hits_merged_topk",
    "SELECT index_name, id, sort FROM ("
    "SELECT 'events' AS index_name, event_id AS id, epoch_us(ts) // 1000000 AS sort "
    "FROM events UNION ALL "
    "SELECT 'orders', o_orderkey, epoch_us(o_orderdate) // 1000000 FROM orders) "
    "ORDER BY sort DESC, index_name, id LIMIT 200",
)
def merged_topk(spark, folder):
    sources = three_sources(spark, folder)[:2]
    request = {"sort": [{"datetime": {"order": "desc"}}], "size": 200}
    return search_many(sources, request).hits.select(
        F.col("_index").alias("index_name"),
        F.col("_id").cast("bigint").alias("id"),
        F.col("sort")[0].alias("sort"),
    )


@register(
    "union_sources",
    "SELECT 'customer' AS index_name, c_custkey AS key, c_name AS name FROM customer "
    "UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier "
    "UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
)
def union_of_sources(spark, folder):
    """Duplicates stay when a source is listed twice."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")
    )
    one = log_index("customer", customer, None)
    two = log_index("supplier", supplier, None)
    return union_sources([one, two, two]).select(
        F.col("_index").alias("index_name"), "key", "name"
    )

"""Requests that name fields of documents, and results as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, in_range, text
from registered.histograms import HOUR_US
from registered.registry import (
    GTE_SQL,
    LTE,
    LTE_SQL,
    anchored_key,
    event_lines,
    events,
    orders,
    register,
    rfc3339,
    table,
    whole_only,
)
from tidelog import json_lines_index, log_index, search, search_many

LINE_FIELDS = {"datetime": {"type": "date"}, "event_id": {"type": "long"}}


def lines(spark, folder):
    path = event_lines(spark, folder)
    return json_lines_index(spark, "lines", path, "datetime", LINE_FIELDS)


def document_field(name: str, kind: str):
    return F.try_variant_get("_source", f"$.{name}", kind).alias(name)


@register(
    "json_sorted_by_field",
    "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, ts, event_type, "
    "CAST(event_id AS VARCHAR) LIMIT 500",
)
def json_sorted_by_field(spark, folder):
    """Documents by a key that is not declared."""
    request = {"sort": [{"value": {"order": "desc"}}], "size": 500}
    hits = search(lines(spark, folder), request).hits
    return hits.select(document_field("event_id", "bigint"), document_field("value", "double"))


@register(
    "json_newest_first",
    "SELECT event_id FROM (SELECT event_id FROM events ORDER BY epoch_us(ts) // 1000000 DESC, ts, "
    "event_type, CAST(event_id AS VARCHAR) LIMIT 500)",
)
def json_newest_first(spark, folder):
    """The declared name of the time field in ``sort``."""
    request = {"sort": [{"datetime": {"order": "desc", "unmapped_type": "boolean"}}], "size": 500}
    return search(lines(spark, folder), request).hits.select(document_field("event_id", "bigint"))


@register("json_source_excludes", "SELECT event_id, 'datetime,event_id,message' AS keys FROM events")
def json_source_excludes(spark, folder):
    request = {"_source": {"excludes": ["value", "props"]}}
    hits = search(lines(spark, folder), request, extensions=True).hits
    keys = F.map_keys(F.col("_source").cast("map<string,variant>"))
    return hits.select(
        document_field("event_id", "bigint"), F.array_join(F.array_sort(keys), ",").alias("keys")
    )


@register(
    "json_docvalues",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') "
    "|| lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts_text, "
    "event_type AS kind FROM events",
)
def json_docvalues(spark, folder):
    """The time as text, a declared field and a key that is not declared."""
    names = [{"field": "datetime", "format": "date_time"}, {"field": "event_id"}, {"field": "message"}]
    hits = search(lines(spark, folder), {"docvalue_fields": names}, extensions=True).hits
    return hits.select(
        F.col("fields.event_id").alias("event_id"),
        F.col("fields.datetime").alias("ts_text"),
        F.col("fields.message").cast("string").alias("kind"),
    )


@register(
    "dotted_columns",
    "SELECT event_id, event_type AS kind FROM events WHERE contains(event_type, 'c') "
    "ORDER BY value DESC NULLS LAST, event_id LIMIT 200",
)
def dotted_columns(spark, folder):
    """Names as flattened logs have them."""
    df = table(spark, folder, "events").selectExpr(
        "event_id AS `event.id`", "ts AS `event.ts`", "event_type AS `event.kind`", "value AS `event.value`"
    )
    index = log_index("flat", df, "event.ts", id="event.id", text=["event.kind"])
    request = {
        "query": bool_filter(must=[text("c")]),
        "sort": [{"event.value": {"order": "desc"}}],
        "size": 200,
    }
    hits = search(index, request).hits
    return hits.select(
        F.col("_source").getField("event.id").alias("event_id"),
        F.col("_source").getField("event.kind").alias("kind"),
    )


@register(
    "search_many_sorted",
    "SELECT name, CAST(id AS VARCHAR) AS id FROM ("
    "SELECT 'events' AS name, event_id AS id, value AS v FROM events UNION ALL "
    "SELECT 'orders', o_orderkey, CAST(o_totalprice AS DOUBLE) FROM orders) "
    "ORDER BY v DESC NULLS LAST, name, id LIMIT 300",
)
def search_many_sorted(spark, folder):
    """Two sources merged in the requested order."""
    first = events(spark, folder)
    second = orders(spark, folder)
    price = F.col("o_totalprice").cast("double").alias("v")
    sources = [
        first.with_df(first.df.withColumnRenamed("value", "v")),
        second.with_df(second.df.select("*", price)),
    ]
    hits = search_many(sources, {"sort": [{"v": {"order": "desc"}}], "size": 300}).hits
    return hits.select(F.col("_index").alias("name"), F.col("_id").alias("id"))


@register(
    "search_many_offset",
    f"SELECT key, replace({rfc3339('key + 7200000')}, 'Z', '+02:00') AS key_as_string, "
    f"CAST(count(*) AS BIGINT) AS doc_count FROM (SELECT {anchored_key('ts', GTE_SQL, 6 * HOUR_US)} "
    f"AS key FROM events WHERE {whole_only('ts', GTE_SQL, LTE_SQL, 6 * HOUR_US)}) GROUP BY key",
)
def search_many_offset(spark, folder):
    """Buckets keep the offset that the range was written with."""
    index = events(spark, folder, flavour="document")
    request = {
        "query": bool_filter(filter=[in_range("2024-01-05T05:17:11.965+02:00", LTE)]),
        "size": 0,
        "aggs": {"h": {"date_histogram": {"field": "ts", "fixed_interval": "6h"}}},
    }
    return search_many([index], request).aggs.select("key", "key_as_string", "doc_count")


DAYS = (
    "SELECT epoch_us(date_trunc('day', ts)) // 1000 AS key, CAST(count(*) AS BIGINT) AS doc_count "
    "FROM events GROUP BY key"
)


@register(
    "result_document",
    "SELECT 'hits' AS part, CAST(to_json({'_index': 'events', '_id': CAST(event_id AS VARCHAR), "
    "'_score': 0.0::DOUBLE, '_source': {'event_id': event_id, 'user_id': user_id, "
    "'event_type': event_type}, 'sort': [epoch_us(ts) // 1000000]}) AS VARCHAR) AS value FROM events "
    "UNION ALL SELECT 'aggregations', CAST(to_json({'agg': 'day', 'key': key, 'key_as_string': "
    f"{rfc3339('key')}, 'doc_count': doc_count}}) AS VARCHAR) FROM ({DAYS}) "
    "UNION ALL SELECT 'totals', CAST(to_json({'total': count(*), 'bucket_total': count(*), "
    "'max_score': 0.0::DOUBLE}) AS VARCHAR) FROM events "
    "UNION ALL SELECT '_shards', CAST(to_json({'total': 1, 'successful': 1, 'skipped': 0, "
    "'failed': 0, 'timed_out': false}) AS VARCHAR)",
)
def result_document(spark, folder):
    """A whole result as rows of JSON text; every hit is in it."""
    request = {
        "size": None,
        "_source": {"excludes": ["ts", "value", "props"]},
        "aggs": {"day": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}},
    }
    return search(events(spark, folder), request, extensions=True).document_rows()

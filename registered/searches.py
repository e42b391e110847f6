"""Whole searches (Q1, Q2), flattened into sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, in_range, phrase, text
from registered.histograms import DAY_US, HOUR_US, clock_key
from registered.registry import (
    GTE,
    GTE_SQL,
    LTE,
    LTE_SQL,
    anchored_key,
    event_lines,
    events,
    orders,
    register,
    table,
    whole_only,
)
from tidelog import json_lines_index, search, search_many, time_table_index, write_time_table
from tidelog.sources.shared import shared_folder


def sections(result):
    """Hits, buckets and the total as rows of one table."""
    none = F.lit(None).cast("bigint")
    hits = result.hits.select(
        F.lit("hit").alias("section"),
        F.col("_index").alias("name"),
        F.col("_id").alias("id"),
        F.col("sort")[0].alias("key"),
        none.alias("n"),
    )
    summary = result.summary.select(
        F.when(F.col("agg").isNull(), "total").otherwise("bucket").alias("section"),
        F.col("agg").alias("name"),
        F.lit(None).cast("string").alias("id"),
        "key",
        F.col("doc_count").alias("n"),
    )
    return hits.unionByName(summary)


def sections_sql(hits: str, buckets: dict[str, str], matched: str) -> str:
    parts = [
        f"SELECT 'hit' AS section, name, id, key, CAST(NULL AS BIGINT) AS n FROM ({hits})",
        "SELECT 'total', NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM " + matched,
    ]
    for name, key in buckets.items():
        source = key if " FROM " in key else f"SELECT {key} AS key FROM {matched}"
        parts.append(
            f"SELECT 'bucket', '{name}', NULL, key, CAST(count(*) AS BIGINT) "
            f"FROM ({source}) GROUP BY key"
        )
    return " UNION ALL ".join(parts)


ERRORS = bool_filter(
    filter=[{"match_all": {}}, in_range(GTE, LTE)],
    must=[phrase(event_type="error")],
    must_not=[text('"k": 6')],
)
TWO_HISTOGRAMS = {
    "day": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}},
    "week": {"date_histogram": {"field": "ts", "calendar_interval": "1w"}},
}
KEPT = (
    "(SELECT * FROM events WHERE event_type = 'error' AND NOT contains(props, '\"k\": 6') "
    f"AND ts BETWEEN date_trunc('second', {GTE_SQL}) AND {LTE_SQL})"
)
DAY_AND_WEEK = {
    "day": clock_key("ts", DAY_US),
    "week": "epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP)) // 1000",
}


def first_hits(source: str, size: int, name: str = "events") -> str:
    return (
        f"SELECT '{name}' AS name, CAST(event_id AS VARCHAR) AS id, "
        f"epoch_us(ts) // 1000000 AS key FROM {source} "
        f"ORDER BY key, event_id LIMIT {size}"
    )


@register("search_events", sections_sql(first_hits(KEPT, 50), DAY_AND_WEEK, KEPT))
def search_events(spark, folder):
    request = {"query": ERRORS, "size": 50, "aggs": TWO_HISTOGRAMS}
    return sections(search(events(spark, folder), request))


@register("search_time_table", sections_sql(first_hits(KEPT, 50), DAY_AND_WEEK, KEPT))
def search_time_table(spark, folder):
    """The same search on a table partitioned by date."""
    path = shared_folder(spark, "search-table")
    write_time_table(table(spark, folder, "events"), path, "ts")
    index = time_table_index(
        spark, "events", path, "ts", id="event_id", text=["event_type", "props"]
    )
    request = {"query": ERRORS, "size": 50, "aggs": TWO_HISTOGRAMS}
    return sections(search(index, request))


def time_table_of_events(spark, folder):
    path = shared_folder(spark, "search-table")
    write_time_table(table(spark, folder, "events"), path, "ts")
    return time_table_index(
        spark, "events", path, "ts", id="event_id", text=["event_type", "props"]
    )


SOME_DAYS = {"range": {"datetime": {"gte": GTE, "lte": LTE}}}
CLICKS = "(SELECT * FROM events WHERE event_type = 'click')"
CLICKS_OF_DAYS = (
    "(SELECT * FROM events WHERE event_type = 'click' AND ts BETWEEN "
    f"date_trunc('second', {GTE_SQL}) AND {LTE_SQL})"
)


@register("search_time_table_mixed_filter", sections_sql(first_hits(CLICKS, 50), {}, CLICKS))
def search_time_table_mixed_filter(spark, folder):
    """Text and range in one object: the text counts, and no date is left out."""
    both = {"multi_match": {"query": "click"}, **SOME_DAYS}
    request = {"query": {"bool": {"filter": [both]}}, "size": 50}
    return sections(search(time_table_of_events(spark, folder), request))


@register(
    "search_time_table_must_range", sections_sql(first_hits(CLICKS_OF_DAYS, 50), {}, CLICKS_OF_DAYS)
)
def search_time_table_must_range(spark, folder):
    """A range under must prunes dates as one under filter does."""
    query = {"bool": {"must": [SOME_DAYS], "filter": [{"match_phrase": {"event_type": "click"}}]}}
    return sections(search(time_table_of_events(spark, folder), {"query": query, "size": 50}))


IN_RANGE = f"(SELECT * FROM events WHERE ts BETWEEN {GTE_SQL} AND {LTE_SQL} AND event_type = 'click')"


@register(
    "search_json_lines",
    sections_sql(
        "SELECT 'lines' AS name, CAST(event_id AS VARCHAR) AS id, "
        f"epoch_us(ts) // 1000000 AS key FROM {IN_RANGE}",
        {
            "six_hours": f"SELECT {anchored_key('ts', GTE_SQL, 6 * HOUR_US)} AS key FROM events "
            f"WHERE event_type = 'click' AND {whole_only('ts', GTE_SQL, LTE_SQL, 6 * HOUR_US)}"
        },
        IN_RANGE,
    ),
)
def search_json_lines(spark, folder):
    """The document rules on JSON lines; every hit is returned."""
    index = json_lines_index(spark, "lines", event_lines(spark, folder), "datetime")
    query = bool_filter(
        filter=[in_range(GTE, LTE)], must=[phrase(message="click"), text('"message":"cl')]
    )
    aggs = {"six_hours": {"date_histogram": {"field": "ignored", "fixed_interval": "6h"}}}
    result = search(index, {"query": query, "aggs": aggs})
    found = sections(result)
    ids = result.hits.select(
        F.lit("hit").alias("section"),
        F.col("_index").alias("name"),
        F.try_variant_get("_source", "$.event_id", "string").alias("id"),
        F.col("sort")[0].alias("key"),
        F.lit(None).cast("bigint").alias("n"),
    )
    return ids.unionByName(found.where(F.col("section") != "hit"))


UNTIL = "TIMESTAMP '2024-01-20 00:00:00'"
BOTH = (
    "(SELECT 'events' AS name, event_id AS id, ts AS t FROM events UNION ALL "
    "SELECT 'orders', o_orderkey, o_orderdate FROM orders)"
)
BOTH_KEPT = f"(SELECT * FROM {BOTH} WHERE t <= {UNTIL})"


@register(
    "search_many",
    sections_sql(
        "SELECT name, CAST(id AS VARCHAR) AS id, key FROM (SELECT name, id, "
        f"epoch_us(t) // 1000000 AS key FROM {BOTH_KEPT} ORDER BY key, name, id LIMIT 100)",
        {"t": clock_key("t", 7 * DAY_US)},
        BOTH_KEPT,
    ),
)
def search_two(spark, folder):
    def renamed(index, name):
        return index.with_df(index.df.withColumnRenamed(index.time.name, name))

    from tidelog import log_index

    first, second = events(spark, folder), orders(spark, folder)
    sources = [
        log_index("events", renamed(first, "t").df, "t", id="event_id"),
        log_index("orders", renamed(second, "t").df, "t", id="o_orderkey"),
    ]
    request = {
        "query": bool_filter(filter=[in_range(None, "2024-01-20T00:00:00Z")]),
        "size": 100,
        "aggs": {"t": {"date_histogram": {"field": "t", "fixed_interval": "7d"}}},
    }
    return sections(search_many(sources, request))


SAME_THREE = f"(SELECT * FROM {KEPT} UNION ALL SELECT * FROM {KEPT} UNION ALL SELECT * FROM {KEPT})"


@register(
    "search_same_source_thrice",
    sections_sql(first_hits(SAME_THREE, 50), DAY_AND_WEEK, SAME_THREE),
)
def search_thrice(spark, folder):
    """A source listed three times counts three times."""
    index = events(spark, folder)
    request = {"query": ERRORS, "size": 50, "aggs": TWO_HISTOGRAMS}
    return sections(search_many([index, index, index], request))

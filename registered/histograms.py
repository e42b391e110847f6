"""Date histograms and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, in_range, phrase
from registered.registry import (
    GTE,
    GTE_SQL,
    LTE,
    LTE_SQL,
    anchored_key,
    buckets_sql,
    events,
    lineitem,
    ms,
    orders,
    register,
    table,
    whole_only,
)
from tidelog import log_index, search
from tidelog.functions import times
from tidelog.functions.intervals import columnar_interval, document_interval
from tidelog.operators import histogram as hist
from tidelog.operators import merge
from tidelog.operators.predicates import scan_filter

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
BUCKET = ["key", "key_as_string", "doc_count"]


def clock_key(ts: str, step_us: int) -> str:
    return f"(epoch_us({ts}) // {step_us} * {step_us}) // 1000"


def clock(index, fixed=None, calendar=None):
    interval = columnar_interval(fixed, calendar)
    h = hist.Histogram("h", index.time, interval)
    return hist.date_histogram(index.df, h).select(*BUCKET)


@register(
    "hist_anchored_errors",
    buckets_sql(
        anchored_key("ts", GTE_SQL, 6 * HOUR_US),
        "events",
        whole_only("ts", GTE_SQL, LTE_SQL, 6 * HOUR_US) + " AND event_type = 'error'",
    ),
)
def anchored_errors(spark, folder):
    index = events(spark, folder, flavour="document")
    query = bool_filter(filter=[in_range(GTE, LTE)], must=[phrase(event_type="error")])
    h = hist.anchored(
        "h",
        index.time,
        document_interval("6h", None),
        times.parse_instant(GTE),
        times.parse_instant(LTE),
    )
    kept = index.df.where(scan_filter(index, query))
    return hist.date_histogram(kept, h).select(*BUCKET)


@register("hist_clock_30m", buckets_sql(clock_key("ts", HOUR_US // 2), "events"))
def clock_30m(spark, folder):
    return clock(events(spark, folder), "30m")


@register("hist_clock_2d", buckets_sql(clock_key("l_shipdate", 2 * DAY_US), "lineitem"))
def clock_2d(spark, folder):
    return clock(lineitem(spark, folder), "2d")


def calendar_sql(unit: str) -> str:
    return buckets_sql(ms(f"CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP)"), "orders")


@register("hist_calendar_day", calendar_sql("day"))
def calendar_day(spark, folder):
    return clock(orders(spark, folder), None, "1d")


@register("hist_calendar_week", calendar_sql("week"))
def calendar_week(spark, folder):
    return clock(orders(spark, folder), None, "1w")


@register("hist_calendar_month", calendar_sql("month"))
def calendar_month(spark, folder):
    return clock(orders(spark, folder), None, "1M")


@register("hist_calendar_year", calendar_sql("year"))
def calendar_year(spark, folder):
    return clock(orders(spark, folder), None, "1y")


@register("hist_calendar_quarter", calendar_sql("quarter"))
def calendar_quarter(spark, folder):
    return clock(orders(spark, folder), None, "3M")


@register(
    "hist_calendar_2w",
    buckets_sql(
        f"((epoch_us(o_orderdate) - {4 * DAY_US}) // {14 * DAY_US} * {14 * DAY_US} "
        f"+ {4 * DAY_US}) // 1000",
        "orders",
    ),
)
def calendar_2w(spark, folder):
    return clock(orders(spark, folder), None, "2w")


ORDERS_GTE, ORDERS_LTE = "1995-02-03T04:05:06Z", "2001-07-01T00:00:00Z"
ORDERS_GTE_SQL = "TIMESTAMP '1995-02-03 04:05:06'"
ORDERS_LTE_SQL = "TIMESTAMP '2001-07-01 00:00:00'"


@register(
    "hist_month_as_30d",
    buckets_sql(
        anchored_key("o_orderdate", ORDERS_GTE_SQL, 30 * DAY_US),
        "orders",
        whole_only("o_orderdate", ORDERS_GTE_SQL, ORDERS_LTE_SQL, 30 * DAY_US),
    ),
)
def month_as_30d(spark, folder):
    index = orders(spark, folder)
    h = hist.anchored(
        "h",
        index.time,
        document_interval(None, "1M"),
        times.parse_instant(ORDERS_GTE),
        times.parse_instant(ORDERS_LTE),
    )
    return hist.date_histogram(index.df, h).select(*BUCKET)


@register(
    "hist_default_document",
    buckets_sql(
        anchored_key("ts", GTE_SQL, DAY_US),
        "events",
        whole_only("ts", GTE_SQL, LTE_SQL, DAY_US),
    ),
)
def default_document(spark, folder):
    """An unusable interval counts 24 hours."""
    index = events(spark, folder, flavour="document")
    h = hist.anchored(
        "h",
        index.time,
        document_interval("10x", None),
        times.parse_instant(GTE),
        times.parse_instant(LTE),
    )
    return hist.date_histogram(index.df, h).select(*BUCKET)


@register("hist_default_columnar", buckets_sql(clock_key("ts", HOUR_US), "events"))
def default_columnar(spark, folder):
    """A missing interval counts one hour."""
    return clock(events(spark, folder))


@register(
    "hist_two_named",
    buckets_sql(clock_key("ts", 6 * HOUR_US), "events", agg="six_hours")
    + " UNION ALL "
    + buckets_sql(ms("CAST(date_trunc('month', ts) AS TIMESTAMP)"), "events", agg="month"),
)
def two_named(spark, folder):
    """Both from one pass; an aggregation of another kind has no buckets."""
    request = {
        "aggs": {
            "six_hours": {"date_histogram": {"field": "ts", "fixed_interval": "6h"}},
            "month": {"date_histogram": {"field": "ts", "calendar_interval": "1M"}},
            "other": {"terms": {"field": "event_type"}},
        }
    }
    return search(events(spark, folder), request).aggs


def _order_lines(spark, folder):
    """Order lines with the order's date: one index with two time columns."""
    lines = table(spark, folder, "lineitem")
    dated = lines.join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return log_index("order_lines", dated, "o_orderdate", text=["l_returnflag"])


ORDER_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@register(
    "hist_two_fields",
    buckets_sql(clock_key("o_orderdate", 7 * DAY_US), ORDER_LINES, agg="ordered")
    + " UNION ALL "
    + buckets_sql(ms("CAST(date_trunc('year', l_shipdate) AS TIMESTAMP)"), ORDER_LINES, agg="shipped"),
)
def two_fields(spark, folder):
    request = {
        "aggs": {
            "ordered": {
                "date_histogram": {"field": "o_orderdate", "fixed_interval": "7d"}
            },
            "shipped": {
                "date_histogram": {"field": "l_shipdate", "calendar_interval": "1y"}
            },
        }
    }
    return search(_order_lines(spark, folder), request).aggs


TWO_DAY_BUCKETS = """
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM events) AS total,
           (SELECT CAST(count(*) * 2 AS BIGINT) FROM events) AS bucket_total,
           CAST(0 AS DOUBLE) AS max_score
"""


@register("hist_totals", TWO_DAY_BUCKETS)
def totals(spark, folder):
    """Rows counted once exactly and once per histogram."""
    request = {
        "aggs": {
            "a": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}},
            "b": {"date_histogram": {"field": "ts", "calendar_interval": "1w"}},
        }
    }
    return search(events(spark, folder), request).totals


@register(
    "hist_docs_count",
    "SELECT CAST(count(*) AS BIGINT) AS bucket_total FROM events WHERE "
    + whole_only("ts", GTE_SQL, LTE_SQL, DAY_US),
)
def docs_count(spark, folder):
    return hist.docs_count(default_document(spark, folder))


THREE_SOURCES = (
    "(SELECT ts AS t FROM events UNION ALL SELECT o_orderdate FROM orders "
    "UNION ALL SELECT l_shipdate FROM lineitem)"
)


def three_sources(spark, folder):
    return [
        events(spark, folder),
        orders(spark, folder),
        lineitem(spark, folder),
    ]


@register(
    "hist_merge_sources", buckets_sql(clock_key("t", DAY_US), THREE_SOURCES, agg="day")
)
def merge_sources(spark, folder):
    interval = columnar_interval("1d", None)
    return merge.merge_histograms(
        [
            hist.bucket_counts(s.df, hist.Histogram("day", s.time, interval))
            for s in three_sources(spark, folder)
        ]
    )


@register(
    "hist_merge_shards",
    "SELECT 'year' AS agg, key, "
    "strftime(make_timestamp(key * 1000), '%Y-%m-%dT%H:%M:%SZ') AS key_as_string, "
    "CAST(count(*) AS BIGINT) AS doc_count, "
    "CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS shards FROM "
    "(SELECT epoch_us(CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)) // 1000 AS key, "
    "o_orderpriority FROM orders) GROUP BY key",
)
def merge_shards(spark, folder):
    """Every priority is a shard with its own partial counts."""
    index = orders(spark, folder)
    h = hist.Histogram("year", index.time, columnar_interval(None, "1y"))
    rows = hist.add_buckets(index.df, [h])
    partial = merge.shard_partials(rows, "o_orderpriority", "_bucket0")
    merged = partial.groupBy("_bucket0").agg(
        F.sum("doc_count").cast("bigint").alias("doc_count"),
        F.count("*").alias("shards"),
    )
    keyed = hist.finish(merged, h, "_bucket0", "doc_count")
    shards = merged.select(
        (F.unix_date("_bucket0").cast("bigint") * 86_400_000).alias("key"), "shards"
    )
    return keyed.join(shards, "key").select("agg", *BUCKET, "shards")


@register(
    "hist_merge_partitions",
    buckets_sql(clock_key("l_shipdate", 7 * DAY_US), "lineitem", agg="week"),
)
def merge_partitions(spark, folder):
    """Every partition is a shard; the merge gives the direct counts."""
    index = lineitem(spark, folder)
    h = hist.Histogram("week", index.time, columnar_interval("7d", None))
    rows = hist.add_buckets(index.df, [h])
    partial = merge.shard_partials(rows, None, "_bucket0")
    return merge.merge_histograms(hist.finish(partial, h, "_bucket0", "doc_count"))


@register(
    "totals_merge",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS bucket_total, "
    f"CAST(0 AS DOUBLE) AS max_score FROM {THREE_SOURCES}",
)
def totals_merge(spark, folder):
    def request(index):
        spec = {"field": index.time.name, "fixed_interval": "1d"}
        return {"aggs": {"day": {"date_histogram": spec}}}

    sources = three_sources(spark, folder)
    return merge.merge_totals([search(s, request(s)).totals for s in sources])

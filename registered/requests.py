"""Many requests over one scan (J1, J2).  One request per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.registry import register, table
from tidelog.functions.documents import row_json
from tidelog.operators import many_requests as many
from tidelog.operators import merge

KINDS = ["click", "error", "purchase", "signup", "view", "missing"]

LOG = many.LogSide(index="event_type", time="ts", raw="props", id="event_id")

REQUESTS = f"""
WITH requests AS (
    SELECT s_suppkey AS id,
           ({KINDS})[s_nationkey % 6 + 1] AS index,
           CASE WHEN s_nationkey % 5 = 0 THEN NULL
                ELSE ': ' || CAST(s_nationkey AS VARCHAR) END AS q,
           CASE WHEN s_nationkey % 7 = 0 THEN NULL
                ELSE TIMESTAMP '2024-01-01' + to_days(CAST(s_nationkey AS INTEGER))
           END AS gte,
           CASE WHEN s_nationkey % 11 = 0 THEN NULL
                ELSE TIMESTAMP '2024-01-01' + to_days(CAST(s_nationkey AS INTEGER))
                     + to_minutes(CAST(37 * (s_nationkey % 4) ** 6 AS BIGINT))
           END AS lte
    FROM supplier),
matched AS (
    SELECT r.id, e.* FROM requests r JOIN events e ON e.event_type = r.index
      AND (r.gte IS NULL OR e.ts >= r.gte) AND (r.lte IS NULL OR e.ts <= r.lte)
      AND (r.q IS NULL OR contains(e.props, r.q)))
"""

COUNTS = (
    REQUESTS
    + "SELECT r.id, CAST(count(m.id) AS BIGINT) AS n FROM requests r "
    + "LEFT JOIN matched m ON m.id = r.id GROUP BY r.id"
)


def requests(spark, folder):
    nation = F.col("s_nationkey")
    start = F.timestamp_add("DAY", nation, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    minutes = (37 * F.pow(nation % 4, F.lit(6))).cast("bigint")
    end = F.timestamp_add("MINUTE", minutes.cast("int"), start)
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        kinds[nation % 6].alias("index"),
        F.when(nation % 5 != 0, F.concat(F.lit(": "), nation.cast("string"))).alias("q"),
        F.when(nation % 7 != 0, start).alias("gte"),
        F.when(nation % 11 != 0, end).alias("lte"),
    )


def matched(spark, folder):
    return many.match_requests(table(spark, folder, "events"), requests(spark, folder), LOG)


def counted(spark, folder, hint=None):
    """``hint`` is a join hint that a caller puts on the requests."""
    asked = requests(spark, folder)
    if hint is not None:
        asked = asked.hint(hint)
    return many.count_requests(table(spark, folder, "events"), asked, LOG)


@register("multi_search", COUNTS)
def multi_search(spark, folder):
    return counted(spark, folder)


@register("multi_search_plain", COUNTS)
def multi_search_plain(spark, folder):
    """Requests without a log row still have a count."""
    return counted(spark, folder)


@register("multi_search_bucketed", COUNTS)
def multi_search_bucketed(spark, folder):
    """As a caller has it that asks for hash tables of shuffled requests."""
    return counted(spark, folder, "shuffle_hash")


@register("multi_search_shuffled", COUNTS)
def multi_search_shuffled(spark, folder):
    """As a caller has it that asks for sorted, shuffled requests."""
    return counted(spark, folder, "merge")


KEY_REQUESTS = f"""
WITH requests AS (
    SELECT s_suppkey AS id, ({KINDS})[s_nationkey % 6 + 1] AS index,
           CASE WHEN s_suppkey % 9 = 0 THEN ',"' ELSE '"event_id":' || s_suppkey || ',' END AS q,
           CASE WHEN s_nationkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_nationkey // 3 AS INTEGER)) END AS gte
    FROM supplier),
lines AS (SELECT *, '{{"event_id":' || event_id || ',"user_id":' || user_id || '}}' AS line FROM events)
SELECT r.id, CAST(count(l.event_id) AS BIGINT) AS n FROM requests r LEFT JOIN lines l
ON l.event_type = r.index AND (r.gte IS NULL OR l.ts >= r.gte) AND contains(l.line, r.q) GROUP BY r.id
"""


def key_requests(spark, folder):
    """A text of its own for nearly every supplier, and the lines they search."""
    nation = F.col("s_nationkey")
    day = F.timestamp_add("DAY", F.expr("CAST(s_nationkey div 3 AS int)"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    own = F.concat(F.lit('"event_id":'), F.col("s_suppkey").cast("string"), F.lit(","))
    asked = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.array(*[F.lit(kind) for kind in KINDS])[nation % 6].alias("index"),
        F.when(F.col("s_suppkey") % 9 == 0, ',"').otherwise(own).alias("q"),
        F.when(nation % 7 != 0, day).alias("gte"),
        F.expr("CAST(NULL AS TIMESTAMP_NTZ)").alias("lte"),
    )
    lines = table(spark, folder, "events").select(
        "event_id", "event_type", "ts", row_json("event_id", "user_id").alias("line")
    )
    return lines, asked


KEY_LOG = many.LogSide(index="event_type", time="ts", raw="line", id="event_id")


@register("multi_search_ngram", KEY_REQUESTS)
def multi_search_ngram(spark, folder):
    """Texts made from every supplier key; lines meet those they share a trigram with."""
    lines, asked = key_requests(spark, folder)
    return many.request_counts(many.match_requests(lines, asked, KEY_LOG, by_trigrams=True), asked)


@register(
    "multi_search_histogram",
    REQUESTS
    + "SELECT id, epoch_us(ts) // 86400000000 * 86400000 AS key, "
    + "CAST(count(*) AS BIGINT) AS doc_count FROM matched GROUP BY id, key",
)
def multi_search_histogram(spark, folder):
    return many.request_histograms(matched(spark, folder), LOG, 86_400)


@register(
    "multi_search_hits",
    REQUESTS
    + "SELECT id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT id, event_id, "
    + "row_number() OVER (PARTITION BY id ORDER BY epoch_us(ts) // 1000000, event_id) AS rank "
    + "FROM matched) WHERE rank <= 5",
)
def multi_search_hits(spark, folder):
    found = many.first_hits(table(spark, folder, "events"), requests(spark, folder), LOG, 5)
    return found.select("id", "event_id", "rank")


@register(
    "health_merge",
    REQUESTS
    + "SELECT CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (known) AS INTEGER) AS successful, "
    + "0 AS skipped, CAST(count(*) FILTER (NOT known) AS INTEGER) AS failed, false AS timed_out "
    + "FROM (SELECT index IN (SELECT event_type FROM events) AS known FROM requests)",
)
def health_merge(spark, folder):
    """The counters of all requests in one row; one of the indexes is unknown."""
    registry = table(spark, folder, "events").select(F.col("event_type").alias("index"))
    known = registry.distinct().withColumn("known", F.lit(True))
    asked = requests(spark, folder).join(known, "index", "left")
    return merge.merge_health(merge.source_health(asked, F.col("known").isNotNull()))


@register(
    "multi_search_unknown_index",
    REQUESTS
    + "SELECT id, index, 1 AS total, 0 AS successful, 0 AS skipped, 1 AS failed "
    + "FROM requests WHERE index NOT IN (SELECT event_type FROM events)",
)
def multi_search_unknown_index(spark, folder):
    registry = table(spark, folder, "events").select(F.col("event_type").alias("index"))
    return many.unknown_indexes(requests(spark, folder), registry)

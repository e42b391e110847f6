"""Searches that use stored partial counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, in_range, phrase
from registered.histograms import DAY_US, HOUR_US, clock_key
from registered.hits import flat
from registered.registry import GTE, GTE_SQL, LTE, LTE_SQL, register, rfc3339, seconds, table
from tidelog import PartialCounts, refresh_partials, search_counted, write_time_table
from tidelog.sources.shared import shared_folder
from tidelog.sources.writers import time_table_index

KEPT = (
    f"(SELECT * FROM events WHERE event_type <> 'view' AND ts BETWEEN date_trunc('second', {GTE_SQL}) AND {LTE_SQL})"
)


def counted_events(spark, folder):
    """``events`` in two loads, each counted when it has arrived."""
    path, state = shared_folder(spark, "counted-table"), shared_folder(spark, "counted-state")
    counts = PartialCounts(shared_folder(spark, "counts"), "ts", ("event_type",))
    df = table(spark, folder, "events")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        write_time_table(df.where(part), path, "ts", mode="append")
        refresh_partials(spark, path, counts, state)
    return time_table_index(spark, "events", path, "ts", id="event_id", text=["event_type"]), counts


def _buckets(name: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS agg, key, {rfc3339('key')} AS key_as_string, CAST(count(*) AS BIGINT) AS doc_count "
        f"FROM (SELECT {key} AS key FROM {KEPT}) GROUP BY key"
    )


@register(
    "hist_from_partials",
    " UNION ALL ".join(
        [
            _buckets("quarters", clock_key("ts", HOUR_US // 4)),
            _buckets("days", clock_key("ts", DAY_US)),
            _buckets("months", "epoch_us(CAST(date_trunc('month', ts) AS TIMESTAMP)) // 1000"),
            f"SELECT NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM {KEPT}",
        ]
    ),
)
def hist_from_partials(spark, folder):
    """Ranges off the minute: whole minutes come from counts, edges from rows."""
    index, counts = counted_events(spark, folder)
    query = bool_filter(filter=[in_range(GTE, LTE)], must_not=[phrase(event_type="view")])
    aggs = {
        "quarters": {"date_histogram": {"field": "ts", "fixed_interval": "15m"}},
        "days": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}},
        "months": {"date_histogram": {"field": "ts", "calendar_interval": "1M"}},
    }
    return search_counted(index, counts, {"query": query, "size": 0, "aggs": aggs}).summary


@register(
    "hits_newest_pruned",
    f"SELECT event_id, {seconds('ts')} AS sort FROM events WHERE event_type = 'error' AND ts <= {LTE_SQL} "
    f"ORDER BY sort DESC, event_id LIMIT 20",
)
def hits_newest_pruned(spark, folder):
    """The newest hits, from as few dates as hold them."""
    index, counts = counted_events(spark, folder)
    query = bool_filter(filter=[in_range(None, LTE)], must=[phrase(event_type="error")])
    request = {"query": query, "size": 20, "sort": [{"ts": {"order": "desc"}}]}
    return flat(search_counted(index, counts, request).hits)

"""Raw logs searched by way of an index of their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.filters import bool_filter, in_range, phrase, text
from registered.registry import GTE, GTE_SQL, LTE, LTE_SQL, ORACLES, event_lines, register, seconds, table
from registered.searches import sections
from tidelog import FileIndex, document_table_index, open_index, read_json_lines, search, write_document_table
from tidelog.functions.documents import row_json
from tidelog.functions.times import format_rfc3339_fraction
from tidelog.sources.shared import shared_folder


def daily_lines(spark, folder) -> str:
    """``events`` as JSON lines, a file a day; returns the folder."""
    df = table(spark, folder, "events")
    rows = df.select(
        F.expr(format_rfc3339_fraction("ts", True, 6)).alias("datetime"),
        F.col("event_type").alias("message"),
        "event_id",
        "value",
        "props",
    )
    path = shared_folder(spark, "daily-lines")
    day = F.col("datetime").substr(1, 10).alias("day")
    lines = rows.select(row_json(*rows.columns).alias("value"), day)
    lines.repartition("day").write.partitionBy("day").text(path)
    return path


def declared(spark, folder):
    """The daily lines as a declaration opens them, with an index of one hour."""
    (index,) = open_index(
        spark,
        "lines",
        {
            "version": 1,
            "timestamp": {"field": "datetime"},
            "fields": {"message": {"type": "text", "searchable": True}},
            "provider": {
                "name": "jsonLogFile",
                "config": {
                    "logfile": daily_lines(spark, folder),
                    "index": {"path": shared_folder(spark, "file-index"), "resolution": "1h"},
                },
            },
        },
    )
    return index


@register("raw_search_pruned", ORACLES["search_json_lines"])
def raw_search_pruned(spark, folder):
    """The search of ``search_json_lines``; days out of range are not read."""
    query = bool_filter(
        filter=[in_range(GTE, LTE)], must=[phrase(message="click"), text('"message":"cl')]
    )
    aggs = {"six_hours": {"date_histogram": {"field": "ignored", "fixed_interval": "6h"}}}
    result = search(declared(spark, folder), {"query": query, "aggs": aggs})
    ids = result.hits.select(
        F.lit("hit").alias("section"),
        F.col("_index").alias("name"),
        F.try_variant_get("_source", "$.event_id", "string").alias("id"),
        F.col("sort")[0].alias("key"),
        F.lit(None).cast("bigint").alias("n"),
    )
    return ids.unionByName(sections(result).where(F.col("section") != "hit"))


@register(
    "text_search_skipped",
    f"SELECT event_id, {seconds('ts')} AS sort FROM events WHERE event_id % 100 = 77 AND event_id < 178",
)
def text_search_skipped(spark, folder):
    """Texts that few files hold; the trigrams of the others rule them out."""
    index = declared(spark, folder)
    found = None
    for number in (77, 177):
        query = bool_filter(must=[text(f'"event_id":{number},')])
        hits = search(index, {"query": query}).hits.select(
            F.try_variant_get("_source", "$.event_id", "bigint").alias("event_id"),
            F.col("sort")[0].alias("sort"),
        )
        found = hits if found is None else found.unionByName(hits)
    return found


@register(
    "raw_files_summary",
    "SELECT CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_lines, "
    "CAST(0 AS BIGINT) AS n_untimed, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events",
)
def raw_files_summary(spark, folder):
    """Extent of a raw log from the index of its files; no line is read again."""
    files = FileIndex(daily_lines(spark, folder), shared_folder(spark, "file-index"), "datetime")
    files.refresh(spark)
    return files.summary(spark).select(
        "n_files",
        "n_lines",
        "n_untimed",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
    )


@register(
    "json_phrase_shredded",
    f"SELECT event_id, {seconds('ts')} AS sort FROM events WHERE event_type = 'signup' "
    f"AND ts BETWEEN {GTE_SQL} AND {LTE_SQL} ORDER BY value DESC, event_id LIMIT 30",
)
def json_phrase_shredded(spark, folder):
    """A phrase and an order on keys of stored documents, which are columns there."""
    path = shared_folder(spark, "documents")
    write_document_table(read_json_lines(spark, event_lines(spark, folder), "datetime"), path)
    fields = {"message": {"type": "text"}, "event_id": {"type": "long"}}
    index = document_table_index(spark, "lines", path, "datetime", fields)
    request = {
        "query": bool_filter(filter=[in_range(GTE, LTE)], must=[phrase(message="signup")]),
        "size": 30,
        "sort": [{"value": {"order": "desc"}}, {"event_id": {"order": "asc"}}],
    }
    return search(index, request).hits.select(
        F.try_variant_get("_source", "$.event_id", "bigint").alias("event_id"),
        F.col("sort")[0].alias("sort"),
    )

"""Scans, declared schemas, loading and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.registry import (
    GTE,
    GTE_SQL,
    LTE,
    LTE_SQL,
    event_lines,
    events,
    ms,
    orders,
    register,
    rfc3339,
    table,
)
from tidelog import apply_schema, log_index, pruned_scan, read_json_lines, write_time_table
from tidelog.functions import times
from tidelog.functions.documents import field_as, field_value, has_field, parse_documents
from tidelog.operators.describe import field_indices, field_profile, index_summary
from tidelog.sources.readers import parse_declared, row_documents
from tidelog.sources.shared import shared_folder
from tidelog.sources.writers import write_json_lines
from tidelog.streaming.ingest import ingest_new_files

# Declaration of the JSON lines that event_lines writes.
LINE_FIELDS = {
    "datetime": {"type": "date", "searchable": True, "aggregatable": True},
    "message": {"type": "text", "searchable": True},
    "event_id": {"type": "long"},
}


@register("json_lines_roundtrip", "SELECT event_id, epoch_us(ts) AS us FROM events")
def json_lines_roundtrip(spark, folder):
    lines = read_json_lines(spark, event_lines(spark, folder), "datetime")
    return lines.select(
        field_as(F.col("doc"), "event_id", "bigint").alias("event_id"),
        F.unix_micros("ts").alias("us"),
    )


@register(
    "json_field_presence",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(*) FILTER (WHERE json_exists(props, '$.k')) AS BIGINT) AS with_k, "
    "CAST(count(*) FILTER (WHERE json_exists(props, '$.z')) AS BIGINT) AS with_z "
    "FROM events",
)
def json_field_presence(spark, folder):
    docs = parse_documents(table(spark, folder, "events"), "props")
    doc = F.col("doc")
    return docs.agg(
        F.count("*").alias("n_rows"),
        F.count_if(has_field(doc, "k")).alias("with_k"),
        F.count_if(has_field(doc, "z")).alias("with_z"),
    )


@register(
    "time_text_roundtrip",
    f"SELECT event_id, {rfc3339(ms('ts'))} AS text, "
    "epoch_us(ts) // 1000000 * 1000000 AS us FROM events",
)
def time_text_roundtrip(spark, folder):
    """Timestamp to RFC3339 text and back."""
    index = events(spark, folder)
    text = times.format_rfc3339(times.unix_millis("ts", index.time.ntz))
    text = index.df.select("event_id", F.expr(text).alias("text"))
    back = F.unix_micros(times.parse_rfc3339(F.col("text")))
    return text.select("event_id", "text", back.alias("us"))


@register(
    "row_to_document",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def row_to_document(spark, folder):
    """Rows as JSON text, and the fields read back from it."""
    docs = parse_documents(row_documents(table(spark, folder, "customer")), "doc_json")
    doc = F.col("doc")
    return docs.select(
        field_as(doc, "c_custkey", "bigint").alias("c_custkey"),
        field_as(doc, "c_name", "string").alias("c_name"),
        field_as(doc, "c_nationkey", "int").alias("c_nationkey"),
        field_as(doc, "c_acctbal", "double").alias("c_acctbal"),
        field_as(doc, "c_mktsegment", "string").alias("c_mktsegment"),
    )


@register("apply_schema", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def declared_schema(spark, folder):
    docs = parse_documents(table(spark, folder, "events"), "props")
    return apply_schema(docs, {"k": {"type": "long"}}, keep=["event_id"])


@register(
    "declared_lines",
    "SELECT event_id, epoch_us(ts) AS us, event_type AS message FROM events",
)
def declared_lines(spark, folder):
    """JSON lines straight to the declared columns."""
    lines = spark.read.text(event_lines(spark, folder))
    typed = parse_declared(lines, "value", LINE_FIELDS)
    return typed.select("event_id", F.unix_micros("datetime").alias("us"), "message")


@register(
    "load_typed_table",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, "
    "CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY day",
)
def load_typed_table(spark, folder):
    """JSON lines to a typed table, partitioned by date and ordered by time."""
    lines = spark.read.text(event_lines(spark, folder))
    path = shared_folder(spark, "typed-table")
    write_time_table(parse_declared(lines, "value", LINE_FIELDS), path, "datetime")
    loaded = spark.read.parquet(path)
    return loaded.groupBy(F.col("dt").cast("string").alias("day")).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("message").alias("kinds"),
        F.sum("event_id").alias("ids"),
    )


@register(
    "pruned_scan",
    "SELECT event_id, epoch_us(ts) AS us FROM events "
    f"WHERE ts BETWEEN {GTE_SQL} AND {LTE_SQL}",
)
def pruned(spark, folder):
    path = shared_folder(spark, "time-table")
    write_time_table(table(spark, folder, "events"), path, "ts")
    rows = pruned_scan(spark, path, "ts", GTE, LTE)
    return rows.select("event_id", F.expr(times.unix_micros("ts", True)).alias("us"))


@register(
    "incremental_ingest",
    "SELECT CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY day",
)
def incremental_ingest(spark, folder):
    """Two arrivals of JSON lines, each loaded once, plus a call with no news.

    Every seventh line has a bare date, which is no time: its row has no date.
    """
    base = shared_folder(spark, "ingest")
    source, target, checkpoint = f"{base}/in", f"{base}/table", f"{base}/state"
    df = table(spark, folder, "events")
    rows = df.select(
        F.when(
            F.expr("event_id % 7 <> 0"), F.expr(times.format_rfc3339_fraction("ts", True, 6))
        )
        .otherwise(F.col("ts").cast("date").cast("string"))
        .alias("datetime"),
        F.col("event_type").alias("message"),
        "event_id",
        "ts",
    )
    noon = F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")
    for arrival in (rows.where(F.col("ts") < noon), rows.where(F.col("ts") >= noon), None):
        if arrival is not None:
            write_json_lines(arrival.drop("ts"), source, "append")
        done = ingest_new_files(spark, source, target, checkpoint, LINE_FIELDS, "datetime")
        done.awaitTermination()
    loaded = spark.read.parquet(target)
    return loaded.groupBy(F.col("dt").cast("string").alias("day")).agg(
        F.count("*").alias("n_rows"), F.sum("event_id").alias("ids")
    )


def _key_counts(table_name: str, key: str, index: str) -> str:
    return (
        f"SELECT '{index}' AS index, '{key}' AS field, "
        f"CAST(count(*) AS BIGINT) AS n_rows FROM {table_name}"
    )


@register(
    "field_profile",
    "SELECT field, declared_type, CAST(count(*) AS BIGINT) AS n_rows, "
    "declared_type = 'long' AS searchable FROM ("
    "SELECT unnest(json_keys(props)) AS field, 'long' AS declared_type FROM events) "
    "GROUP BY field, declared_type "
    "UNION ALL SELECT 'absent', 'text', 0, false",
)
def profile(spark, folder):
    df = table(spark, folder, "events").select("ts", F.col("props").alias("raw"))
    fields = {"k": {"type": "long", "searchable": True}, "absent": {"type": "text"}}
    index = log_index("props", df, "ts", fields=fields, raw="raw")
    return field_profile(index).select("field", "declared_type", "n_rows", "searchable")


@register(
    "field_profile_types",
    "SELECT 'BIGINT' AS observed_type, CAST(count(*) FILTER "
    "(WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS BIGINT) AS n_rows "
    "FROM events",
)
def profile_types(spark, folder):
    df = table(spark, folder, "events").select("ts", F.col("props").alias("raw"))
    seen = field_profile(log_index("props", df, "ts", raw="raw"))
    return seen.select("observed_type", "n_rows")


@register(
    "field_indices",
    "SELECT field, count(*) AS n_indices, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ("
    + " UNION ALL ".join(
        [_key_counts("customer", k, "c") for k in ("key", "name", "c_mktsegment")]
        + [_key_counts("supplier", k, "s") for k in ("key", "name")]
    )
    + ") GROUP BY field",
)
def fields_by_index(spark, folder):
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment"
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")
    )
    seen = field_indices(
        [log_index("c", customer, None), log_index("s", supplier, None)]
    )
    return seen.select(
        "field", F.size("indices").cast("bigint").alias("n_indices"), "n_rows"
    )


def _summary_sql(index: str, table_name: str, ts: str) -> str:
    return (
        f"SELECT '{index}' AS index, CAST(count(*) AS BIGINT) AS n_rows, "
        f"{ms(f'min({ts})')} AS first_ms, {ms(f'max({ts})')} AS last_ms FROM {table_name}"
    )


@register(
    "index_summary",
    _summary_sql("events", "events", "ts")
    + " UNION ALL "
    + _summary_sql("orders", "orders", "o_orderdate"),
)
def summary(spark, folder):
    return index_summary([events(spark, folder), orders(spark, folder)])


@register(
    "json_value_text",
    "SELECT event_id, props->>'$.k' AS k FROM events",
)
def json_value_text(spark, folder):
    """A field as JSON text."""
    docs = parse_documents(table(spark, folder, "events"), "props")
    return docs.select("event_id", F.to_json(field_value(F.col("doc"), "k")).alias("k"))

"""Filters (F1 to F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.registry import (
    GTE,
    GTE_SQL,
    LTE,
    LTE_SQL,
    events,
    lineitem,
    register,
    table,
)
from tidelog import log_index
from tidelog.functions.documents import parse_documents
from tidelog.operators.predicates import exclude, match_phrase, query_filter, scan_filter


def bool_filter(**lists) -> dict:
    return {"bool": lists}


def in_range(gte: str | None = None, lte: str | None = None) -> dict:
    bounds = {"gte": gte, "lte": lte}
    return {"range": {"datetime": {k: v for k, v in bounds.items() if v}}}


def phrase(**values) -> dict:
    return {"match_phrase": values}


def text(query: str) -> dict:
    return {"multi_match": {"type": "phrase", "query": query, "lenient": True}}


@register("filter_match_all", "SELECT event_id FROM events")
def match_all(spark, folder):
    index = events(spark, folder)
    query = bool_filter(filter=[{"match_all": {}}])
    return index.df.where(query_filter(index, query)).select("event_id")


@register(
    "filter_multi_match_raw",
    """SELECT event_id FROM events WHERE contains(props, '"k": 6')""",
)
def multi_match_raw(spark, folder):
    index = events(spark, folder, raw="props")
    query = bool_filter(must=[text('"k": 6')])
    return index.df.where(query_filter(index, query)).select("event_id")


@register(
    "filter_multi_match_fields",
    "SELECT conv_id, turn FROM conversations "
    "WHERE contains(role, 'us') OR contains(text, 'us')",
)
def multi_match_fields(spark, folder):
    df = table(spark, folder, "conversations")
    index = log_index("talk", df, None, text=["role", "text"])
    query = bool_filter(must=[text("us")])
    return df.where(query_filter(index, query)).select("conv_id", "turn")


@register(
    "filter_multi_match_wildcard",
    "SELECT doc_id FROM documents WHERE text LIKE '%a_b%'",
)
def multi_match_wildcard(spark, folder):
    df = table(spark, folder, "documents")
    index = log_index("documents", df, None, text=["text"])
    query = bool_filter(must=[text("a_b")])
    return df.where(query_filter(index, query)).select("doc_id")


@register(
    "filter_multi_match_parts",
    "SELECT doc_id FROM documents WHERE text LIKE '%the%on_the%ing%' "
    "OR lang LIKE '%the%on_the%ing%'",
)
def multi_match_parts(spark, folder):
    df = table(spark, folder, "documents")
    index = log_index("documents", df, None, text=["text", "lang"])
    query = bool_filter(must=[text("the%on_the%ing")])
    return df.where(query_filter(index, query)).select("doc_id")


@register(
    "filter_multi_match_literal",
    "SELECT doc_id FROM documents WHERE contains(text, '%%%') OR contains(lang, '%%%')",
)
def multi_match_literal(spark, folder):
    df = table(spark, folder, "documents")
    index = log_index("documents", df, None, text=["text", "lang"], wildcards=False)
    query = bool_filter(must=[text("%%%")])
    return df.where(query_filter(index, query)).select("doc_id")


@register(
    "filter_phrase_all",
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def phrase_all(spark, folder):
    index = lineitem(spark, folder, flavour="document")
    query = bool_filter(must=[phrase(l_returnflag="R", l_linestatus="F")])
    kept = index.df.where(query_filter(index, query))
    return kept.select("l_orderkey", "l_linenumber")


@register(
    "filter_phrase_any",
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_returnflag = 'R' OR l_linestatus = 'F'",
)
def phrase_any(spark, folder):
    index = lineitem(spark, folder)
    wanted = phrase(l_returnflag="R", l_linestatus="F", l_quantity="7")
    kept = index.df.where(query_filter(index, bool_filter(must=[wanted])))
    return kept.select("l_orderkey", "l_linenumber")


@register(
    "filter_phrase_json",
    "SELECT event_id FROM events WHERE event_type = 'error'",
)
def phrase_json(spark, folder):
    """A string field of the row's JSON document."""
    df = table(spark, folder, "events")
    lines = df.select("event_id", "ts", F.to_json(F.struct("*")).alias("raw"))
    docs = parse_documents(lines, "raw")
    index = log_index("lines", docs, "ts", raw="raw", doc="doc")
    query = bool_filter(must=[phrase(event_type="error")])
    return docs.where(query_filter(index, query)).select("event_id")


@register(
    "filter_phrase_json_string_only",
    "SELECT CAST(count(*) FILTER (WHERE json_type(props, '$.k') = 'VARCHAR' "
    "AND props->>'$.k' = '6') AS BIGINT) AS by_phrase, "
    "CAST(count(*) FILTER (WHERE props->>'$.k' = '6') AS BIGINT) AS by_text "
    "FROM events",
)
def phrase_json_string_only(spark, folder):
    """``k`` is a JSON number, which no phrase equals."""
    docs = parse_documents(table(spark, folder, "events"), "props")
    index = log_index("props", docs, "ts", raw="props", doc="doc")
    return docs.agg(
        F.count_if(match_phrase(index, {"k": "6"})).alias("by_phrase"),
        F.count_if(F.try_variant_get("doc", "$.k", "string") == "6").alias("by_text"),
    )


@register(
    "filter_range_exact",
    f"SELECT event_id FROM events WHERE ts BETWEEN {GTE_SQL} AND {LTE_SQL}",
)
def range_exact(spark, folder):
    index = events(spark, folder, flavour="document")
    query = bool_filter(filter=[in_range(GTE, LTE)])
    return index.df.where(scan_filter(index, query)).select("event_id")


@register(
    "filter_range_seconds",
    "SELECT event_id FROM events WHERE ts BETWEEN "
    f"date_trunc('second', {GTE_SQL}) AND {LTE_SQL}",
)
def range_seconds(spark, folder):
    index = events(spark, folder)
    query = bool_filter(filter=[in_range(GTE, LTE)])
    return index.df.where(scan_filter(index, query)).select("event_id")


@register(
    "filter_range_open",
    "SELECT event_id FROM events "
    f"WHERE ts >= date_trunc('second', {GTE_SQL})",
)
def range_open(spark, folder):
    index = events(spark, folder)
    query = bool_filter(filter=[in_range(GTE)])
    return index.df.where(scan_filter(index, query)).select("event_id")


@register(
    "filter_range_until",
    f"SELECT event_id FROM events WHERE ts IS NULL OR ts <= {LTE_SQL}",
)
def range_until(spark, folder):
    """Without ``gte`` the document rules keep rows that have no time."""
    index = events(spark, folder, flavour="document")
    query = bool_filter(filter=[in_range(None, LTE)])
    return index.df.where(scan_filter(index, query)).select("event_id")


@register(
    "filter_request_bounds",
    f"SELECT event_id FROM events WHERE ts BETWEEN {GTE_SQL} AND {LTE_SQL} "
    "AND contains(props, '9')",
)
def request_bounds(spark, folder):
    """A range beside a text match bounds the scan but is no filter itself."""
    index = events(spark, folder, raw="props")
    query = bool_filter(filter=[{**text("9"), **in_range(GTE, LTE)}])
    return index.df.where(scan_filter(index, query)).select("event_id")


@register(
    "filter_bool",
    "SELECT event_id FROM events WHERE event_type = 'error' "
    "AND contains(props, '1') AND NOT contains(props, '7')",
)
def bool_all(spark, folder):
    index = events(spark, folder)
    query = bool_filter(
        filter=[phrase(event_type="error")],
        must=[text("1")],
        must_not=[text("7")],
    )
    return index.df.where(query_filter(index, query)).select("event_id")


@register(
    "filter_bool_nested",
    f"SELECT event_id FROM events WHERE ts >= date_trunc('second', {GTE_SQL}) AND NOT ("
    "contains(props, '2') AND NOT (event_type = 'click' AND NOT contains(props, '5')))",
)
def bool_nested(spark, folder):
    index = events(spark, folder)
    inner = {"filter": [phrase(event_type="click")], "must_not": text("5")}
    middle = {"filter": [text("2")], "must_not": {"bool": inner}, "must": [text("x")]}
    query = bool_filter(
        filter=[in_range(GTE)], must_not=[{"bool": middle, "match_all": {}}]
    )
    return index.df.where(query_filter(index, query)).select("event_id")


@register(
    "filter_dispatch_order",
    "SELECT event_id FROM events WHERE contains(event_type, 'click') "
    "OR contains(props, 'click')",
)
def dispatch_order(spark, folder):
    """Of several kinds in one filter object, the text match wins here."""
    index = events(spark, folder)
    mixed = {
        **text("click"),
        **phrase(event_type="error"),
        "match_all": {},
        **in_range(GTE, LTE),
    }
    return index.df.where(query_filter(index, bool_filter(must=[mixed]))).select(
        "event_id"
    )


@register(
    "filter_must_not_null",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
    "WHERE (l.quality = 1) IS DISTINCT FROM true",
)
def must_not_null(spark, folder):
    """Negation keeps rows that lack the field."""
    labels = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality")
    )
    df = table(spark, folder, "documents").join(labels, "doc_id", "left")
    index = log_index("documents", df, None, text=["quality"])
    unwanted = exclude(match_phrase(index, {"quality": "1"}))
    return df.where(unwanted).select("doc_id")

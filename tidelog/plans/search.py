"""The search API: a request against one source or several.

A request is a mapping with ``query``, ``size``, ``sort`` and ``aggs``.  The
result is lazy: one job computes the hits, one job all histograms and totals.
"""

from __future__ import annotations

import json
import time as clock
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.documents import row_json, without_keys
from tidelog.functions.intervals import columnar_interval, document_interval
from tidelog.functions.times import TimeColumn, quoted, utc_offset_minutes
from tidelog.operators import hits as hit_ops
from tidelog.operators import histogram as hist
from tidelog.operators import merge
from tidelog.operators.hits import SCORE
from tidelog.operators.predicates import (
    request_bounds,
    requires_time,
    scan_filter,
    written_bounds,
)
from tidelog.sources.composite import combine_alike
from tidelog.sources.file_index import required_texts
from tidelog.sources.index import DOCUMENT, LogIndex


@dataclass(frozen=True)
class SearchResult:
    """``hits`` and ``summary`` are independent jobs over the same filter.

    ``summary`` holds every histogram bucket and, with a NULL ``agg``, the
    exact number of matching rows.
    """

    hits: DataFrame
    summary: DataFrame
    names: tuple[str, ...]
    size: int | None
    sources: int = 1
    unknown: int = 0
    filtered: DataFrame | None = None

    @property
    def health(self) -> DataFrame:
        """One row: sources asked, answered, skipped and failed."""
        asked = [(True,)] * self.sources + [(False,)] * self.unknown
        rows = self.hits.sparkSession.createDataFrame(asked, "answered boolean")
        return merge.merge_health(merge.source_health(rows, F.col("answered")))

    @property
    def aggs(self) -> DataFrame:
        """``(agg, key, key_as_string, doc_count)`` in ascending key order."""
        return self.summary.where(F.col("agg").isNotNull()).orderBy("agg", "key")

    @property
    def totals(self) -> DataFrame:
        """One row: the exact ``total``, the histograms' ``bucket_total`` and the
        highest score, which needs no look at the hits as all have the same."""
        return totals_of(self.summary).withColumn("max_score", F.lit(SCORE))

    def to_document(self) -> dict[str, Any]:
        """The result as one nested document; runs both jobs.

        It is made in this process, for results that fit it; those of any
        size are written with ``write_document``.
        """
        start = clock.monotonic()
        buckets = self.summary.collect()
        found = [json.loads(row[0]) for row in hit_documents(self.hits).collect()]
        health = self.health.first().asDict()
        aggs: dict[str, Any] = {name: {"buckets": []} for name in self.names}
        for row in sorted((r for r in buckets if r.agg is not None), key=lambda r: r.key):
            aggs[row.agg]["buckets"].append(
                {
                    "key_as_string": row.key_as_string,
                    "key": row.key,
                    "doc_count": row.doc_count,
                }
            )
        total = sum(r.doc_count for r in buckets if r.agg is None)
        scores = [hit.get("_score", 0.0) for hit in found]
        return {
            "took": int((clock.monotonic() - start) * 1000),
            "timed_out": health.pop("timed_out"),
            "_shards": health,
            "hits": {
                "total": {"value": total, "relation": "eq"},
                "max_score": max(scores, default=0.0),
                "hits": found,
            },
            "aggregations": aggs,
        }

    def write_hits(self, path: str, mode: str = "errorifexists") -> None:
        """Hits as JSON lines, written in parallel."""
        hit_documents(self.hits).write.mode(mode).text(path)

    def document_rows(self) -> DataFrame:
        """``(part, value)``: hits, buckets, totals and ``_shards`` as JSON text."""

        def part(name: str, rows: DataFrame) -> DataFrame:
            return rows.select(F.lit(name).alias("part"), row_json(*rows.columns).alias("value"))

        buckets = self.summary.where(F.col("agg").isNotNull())
        return (
            part("hits", self.hits)
            .union(part("aggregations", buckets))
            .union(part("totals", self.totals))
            .union(part("_shards", self.health))
        )

    def write_document(self, path: str, mode: str = "errorifexists") -> None:
        """The whole result as JSON lines, a folder for each part, in parallel."""
        self.document_rows().write.mode(mode).partitionBy("part").text(path)

    def unpersist(self) -> None:
        if self.filtered is not None:
            self.filtered.unpersist()


def totals_of(summary: DataFrame) -> DataFrame:
    """Totals of the counts alone; they have no score."""
    count = F.col("doc_count")
    exact = F.sum(F.when(F.col("agg").isNull(), count))
    buckets = F.sum(F.when(F.col("agg").isNotNull(), count))
    return summary.agg(
        F.coalesce(exact, F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(buckets, F.lit(0)).cast("bigint").alias("bucket_total"),
        F.lit(None).cast("double").alias("max_score"),
    )


def hit_documents(hits: DataFrame) -> DataFrame:
    """Hits as JSON text."""
    return hits.select(row_json("*").alias("value"))


def request_histograms(
    index: LogIndex, request: Mapping[str, Any], extensions: bool = False
) -> list[hist.Histogram]:
    """The request's date histograms, by the rules of the index's flavour."""
    found = []
    for name, agg in (request.get("aggs") or {}).items():
        spec = agg.get("date_histogram")
        if spec is None:
            continue  # stays in the result with no buckets
        fixed, calendar = spec.get("fixed_interval"), spec.get("calendar_interval")
        if index.flavour == DOCUMENT:
            gte, lte = request_bounds(index, request.get("query"))
            offset = utc_offset_minutes(_written_gte(index, request.get("query")))
            interval = document_interval(fixed, calendar)
            found.append(hist.anchored(name, index.time, interval, gte, lte, offset))
            continue
        field = spec.get("field") or index.time.name
        found.append(
            hist.Histogram(
                name,
                TimeColumn.of(index.df, field),
                columnar_interval(fixed, calendar),
                zone=spec.get("time_zone") if extensions else None,
            )
        )
    return found


def _written_gte(index: LogIndex, query: Mapping[str, Any] | None):
    for each in ((query or {}).get("bool") or {}).get("filter") or []:
        if each and each.get("range") is not None:
            return written_bounds(index, each["range"]).get("gte")
    return None


def search(
    index: LogIndex,
    request: Mapping[str, Any],
    *,
    extensions: bool = False,
    persist: bool = False,
) -> SearchResult:
    """Filter, hits, histograms and totals for one source.

    ``extensions`` honours request keys that are otherwise accepted without
    effect: ``should``, ``time_zone``, ``min_doc_count``, ``docvalue_fields``
    and ``_source``.
    """
    query = request.get("query")
    index = narrowed(index, query)
    filtered = index.df.where(scan_filter(index, query, use_should=extensions))
    if persist:
        filtered = filtered.persist(StorageLevel.MEMORY_AND_DISK)
    histograms = request_histograms(index, request, extensions)
    summary = hist.summarise(filtered, histograms)
    if extensions:
        summary = _with_min_counts(summary, histograms, request.get("aggs") or {})
    return SearchResult(
        hits=_hit_rows(index, filtered, request).select(
            *_hit_columns(index, request, extensions)
        ),
        summary=summary,
        names=tuple(request.get("aggs") or {}),
        size=request.get("size"),
        filtered=filtered if persist else None,
    )


def narrowed(index: LogIndex, query: Mapping[str, Any] | None) -> LogIndex:
    """An index of raw files cut to the files that can hold an answer."""
    if index.files is None:
        return index
    spark = index.df.sparkSession
    paths = index.files.matching(spark, *request_bounds(index, query), required_texts(query))
    return index.with_df(index.files.lines(spark, paths))


def _with_min_counts(
    summary: DataFrame, histograms: list[hist.Histogram], aggs: Mapping[str, Any]
) -> DataFrame:
    """Extension: drop buckets below ``min_doc_count``, or add the empty ones."""
    for h in histograms:
        least = aggs[h.name]["date_histogram"].get("min_doc_count", 1)
        mine = F.col("agg").eqNullSafe(F.lit(h.name))
        if least > 1:
            summary = summary.where(~mine | (F.col("doc_count") >= least))
        elif least == 0:
            filled = hist.fill_gaps(summary.where(mine), h)
            summary = summary.where(~mine).unionByName(filled)
    return summary


def _hit_rows(
    index: LogIndex, filtered: DataFrame, request: Mapping[str, Any]
) -> DataFrame:
    return hit_ops.first_rows(
        index,
        filtered,
        hit_ops.requested_order(index, request.get("sort")),
        request.get("size"),
        time_known=requires_time(index, request.get("query")),
    )


def _hit_columns(
    index: LogIndex, request: Mapping[str, Any], extensions: bool
) -> list[Column]:
    if not extensions:
        return hit_ops.hit_columns(index)
    source = None
    excludes = (request.get("_source") or {}).get("excludes") or []
    if excludes and index.doc is not None:
        source = without_keys(F.col(quoted(index.doc)), excludes)
    elif excludes:
        source = F.struct(*[F.col(quoted(c)) for c in index.source_columns if c not in excludes])
    columns = hit_ops.hit_columns(index, source)
    values = hit_ops.docvalue_columns(index, request.get("docvalue_fields") or [])
    if values:
        columns.append(F.struct(*values).alias("fields"))
    return columns


def search_many(
    sources: list[LogIndex],
    request: Mapping[str, Any],
    *,
    unknown: list[str] | None = None,
    extensions: bool = False,
) -> SearchResult:
    """One request over several sources, their answers merged.

    Every source filters, aggregates and takes its top rows on its own, by its
    own flavour; only bucket rows and at most ``size`` hits per source meet.
    Sources that follow the same rules are searched as one union.
    ``unknown`` names requested indexes that do not exist: they count as failed.
    The merged rows follow the request's ``sort``, by default ascending time.
    """
    if not sources:
        raise ValueError("no sources")
    asked, query = len(sources), request.get("query")
    # what is narrowed once needs no file index any more, and combines
    sources = combine_alike([replace(narrowed(each, query), files=None) for each in sources])
    parts = [search(each, request, extensions=extensions) for each in sources]
    hits = merged_hits(
        [mergeable_hits(each, request, extensions) for each in sources], sources[0], request
    )
    return SearchResult(
        hits=hits,
        summary=merge.summed([part.summary for part in parts]),
        names=parts[0].names,
        size=request.get("size"),
        sources=asked,
        unknown=len(unknown or []),
    )


def merged_hits(parts: list[DataFrame], like: LogIndex, request: Mapping[str, Any]) -> DataFrame:
    """The first ``size`` of the sources' ``mergeable_hits``; ``like`` is one of them."""
    hits = merge.union_all(parts)
    order = [
        F.col(f"_order{i}").desc() if descending else F.col(f"_order{i}").asc()
        for i, (_, descending) in enumerate(_merge_entries(like, request))
    ]
    if not order:
        order = [F.col("sort")[0].asc()]
    order += [F.col("_index"), F.col("_number"), F.col("_text")]
    merged = hit_ops.limit_rows(hits, order, request.get("size"))
    return merged.drop(*(c for c in merged.columns if c.startswith("_order")), "_number", "_text")


def mergeable_hits(
    index: LogIndex, request: Mapping[str, Any], extensions: bool
) -> DataFrame:
    """A source's top rows with ``_source`` as VARIANT and the typed tie-break,
    so that the merge orders rows exactly as the source did."""
    filtered = index.df.where(scan_filter(index, request.get("query"), extensions))
    rows = _hit_rows(index, filtered, request)
    kind = None if index.id is None else index.df.schema[index.id].dataType
    number = isinstance(kind, T.IntegralType)
    tie = index.tiebreak()
    hits = rows.select(
        *_hit_columns(index, request, extensions),
        (tie.cast("bigint") if number else F.lit(None).cast("bigint")).alias("_number"),
        (F.lit(None).cast("string") if number else tie.cast("string")).alias("_text"),
        *(
            (F.lit(None) if column is None else column).alias(f"_order{i}")
            for i, (column, _) in enumerate(_merge_entries(index, request))
        ),
    )
    if index.doc is None:
        hits = hits.withColumn("_source", F.to_variant_object("_source"))
    return hits


def _merge_entries(index: LogIndex, request: Mapping[str, Any]):
    return hit_ops.sort_entries(index, request.get("sort"))

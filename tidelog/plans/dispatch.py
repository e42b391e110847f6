"""Answering a list of requests, each addressed to a named index."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from tidelog.plans.search import SearchResult, search, search_many
from tidelog.sources.index import LogIndex

_HIT = "_index string, _id string, _score double, _source variant, sort array<bigint>"
_BUCKET = "agg string, key bigint, key_as_string string, doc_count bigint"


def failed_result(spark: SparkSession, request: Mapping[str, Any]) -> SearchResult:
    """An empty result that counts one failed source."""
    return SearchResult(
        hits=spark.createDataFrame([], _HIT),
        summary=spark.createDataFrame([], _BUCKET),
        names=(),
        size=request.get("size", 0),
        sources=0,
        unknown=1,
    )


def answer(
    spark: SparkSession,
    indexes: Mapping[str, LogIndex | list[LogIndex]],
    requests: Iterable[tuple[str, str, Mapping[str, Any]]],
) -> dict[str, SearchResult]:
    """``(id, index, request)`` to a lazy result per id.

    A list of sources is searched as one index.  A request for an unknown
    index gets a failed result.  For many simple requests over one log see
    ``operators.many_requests``, which answers them in a single pass.
    """
    results = {}
    for key, name, request in requests:
        found = indexes.get(name)
        if found is None:
            results[key] = failed_result(spark, request)
        elif isinstance(found, LogIndex):
            results[key] = search(found, request)
        else:
            results[key] = search_many(found, request)
    return results

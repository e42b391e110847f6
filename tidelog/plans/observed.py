"""Searches of several sources whose health is measured while they run.

Each source is searched by itself and its small answer (buckets, totals and at
most ``size`` hits) is stored. What was read is counted by observations in the
same job. A source that can't be opened, or fails while it is read, counts as
failed and the others still answer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import quoted
from tidelog.operators import histogram as hist
from tidelog.operators import merge
from tidelog.operators.predicates import scan_filter
from tidelog.plans.search import (
    SearchResult,
    merged_hits,
    mergeable_hits,
    narrowed,
    request_histograms,
)
from tidelog.sources.index import LogIndex
from tidelog.sources.shared import shared_folder

SOURCE = (
    "name string, total int, successful int, skipped int, failed int, timed_out boolean, "
    "n_rows bigint, n_malformed bigint, n_untimed bigint, error string"
)


@dataclass(frozen=True)
class ObservedResult(SearchResult):
    """A result with one row of measured ``source_health`` for each source."""

    source_health: DataFrame | None = None

    @property
    def health(self) -> DataFrame:
        return merge.merge_health(self.source_health)


@dataclass(frozen=True)
class _Answer:
    index: LogIndex
    hits: DataFrame
    summary: DataFrame
    counts: dict[str, int]
    skipped: bool


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _answer(name: str, index: LogIndex, request: Mapping[str, Any], extensions: bool) -> _Answer:
    query = request.get("query")
    near = replace(narrowed(index, query), files=None)
    skipped = index.files is not None and not near.df.inputFiles()
    seen = Observation()
    none = F.lit(False)
    malformed = F.col(quoted(near.doc)).isNull() if near.doc else none
    untimed = F.col(near.time.sql).isNull() if near.time else none
    rows = near.df.observe(
        seen,
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(malformed).alias("n_malformed"),
        F.count_if(untimed).alias("n_untimed"),
    )
    summary = hist.summarise(
        rows.where(scan_filter(near, query, extensions)), request_histograms(near, request, extensions)
    )
    summary = _kept(summary, "observed-summary")
    hits = _kept(mergeable_hits(near, request, extensions), "observed-hits")
    return _Answer(near, hits, summary, dict(seen.get), skipped)


def search_observed(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], LogIndex]],
    request: Mapping[str, Any],
    *,
    extensions: bool = False,
) -> ObservedResult:
    """One request over several sources that are opened here; runs their jobs.

    Raises what the last source raised when none of them answers.
    """
    answers, health, last = [], [], None
    for name, open_source in sources.items():
        try:
            found = _answer(name, open_source(), request, extensions)
        except (PySparkException, Py4JJavaError, OSError) as error:
            last = error
            health.append((name, 1, 0, 0, 1, False, None, None, None, str(error).split("\n")[0]))
            continue
        answers.append(found)
        counts = (found.counts[c] for c in ("n_rows", "n_malformed", "n_untimed"))
        health.append((name, 1, 1, int(found.skipped), 0, False, *counts, None))
    if not answers:
        raise last or ValueError("no sources")
    return ObservedResult(
        hits=merged_hits([a.hits for a in answers], answers[0].index, request),
        summary=merge.summed([a.summary for a in answers]),
        names=tuple(request.get("aggs") or {}),
        size=request.get("size"),
        sources=len(answers),
        unknown=len(sources) - len(answers),
        source_health=spark.createDataFrame(health, SOURCE),
    )

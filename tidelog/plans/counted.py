"""Searches of a time table that has stored partial counts.

Histograms and totals are taken from the counts where a whole step lies in the
request's range, and from rows only at the two edges. Hits in order of time are
read from as few dates as hold ``size`` of them, which the counts tell.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.times import instant_micros, micros_instant, quoted
from tidelog.operators import histogram as hist
from tidelog.operators import merge
from tidelog.operators.partials import COUNT, DATE, PartialCounts
from tidelog.operators.predicates import RANGE_KEY, scan_filter, time_bounds, time_test
from tidelog.plans.search import SearchResult, request_histograms, search
from tidelog.sources.index import COLUMNAR, LogIndex

_MICRO = timedelta(microseconds=1)


def _split(index: LogIndex, counts: PartialCounts, query: Mapping[str, Any] | None):
    """``(ranges, query without them)``, None if counts can't answer the rest."""
    root = (query or {}).get("bool")
    if index.flavour != COLUMNAR or index.time is None or counts.time != index.time.name:
        return None
    if query is not None and root is None:
        return None
    ranges, rest = [], {}
    for part in ("filter", "must", "must_not"):
        rest[part] = []
        for spec in (root or {}).get(part) or []:
            kind = _kind(spec)
            if kind == "range" and part != "must_not":
                ranges.append(spec["range"])
            elif _by_columns(index, counts, spec):
                rest[part].append(spec)
            else:
                return None
    return (ranges, {"bool": rest}) if len(ranges) < 2 else None


def _kind(spec: Mapping[str, Any] | None) -> str | None:
    """The kind that counts of a filter object: the first of these."""
    kinds = ("bool", "multi_match", "match_phrase", "match_all", "range")
    return next((kind for kind in kinds if (spec or {}).get(kind) is not None), None)


def _by_columns(index: LogIndex, counts: PartialCounts, spec: Mapping[str, Any] | None) -> bool:
    """Whether a filter looks only at columns that are counted by."""
    kind = _kind(spec)
    if kind in (None, "match_all"):
        return True
    if kind == "multi_match":
        return set(index.searchable) <= set(counts.by)
    if kind == "match_phrase":
        return {c for c in index.searchable if c in spec["match_phrase"]} <= set(counts.by)
    if kind == "bool":
        inner = spec["bool"]
        unwanted = inner.get("must_not") or []
        unwanted = [unwanted] if isinstance(unwanted, Mapping) else unwanted
        return all(_by_columns(index, counts, each) for each in [*(inner.get("filter") or []), *unwanted])
    return False


def _fits(index: LogIndex, counts: PartialCounts, h: hist.Histogram) -> bool:
    """Whether every bucket of a histogram is made of whole steps."""
    if h.time != index.time or h.zone is not None or h.anchored:
        return False
    return h.interval.months is not None or h.interval.micros % counts.step_micros == 0


class _Counted:
    """A request's rows, split into whole steps and edges."""

    def __init__(self, index: LogIndex, counts: PartialCounts, ranges: list, query: Mapping[str, Any]):
        self.index, self.counts = index, counts
        gte, lte = time_bounds(index, ranges[0]) if ranges else (None, None)
        step = counts.step_micros
        first = None if gte is None else -(-instant_micros(gte) // step) * step
        end = None if lte is None else (instant_micros(lte) + 1) // step * step
        if first is not None and end is not None and first >= end:
            first = end = instant_micros(gte)  # no whole step
        self.first = None if first is None else micros_instant(first)
        self.end = None if end is None else micros_instant(end)
        steps = index.with_df(counts.read(index.df))
        steps = replace(steps, id=None, partition=DATE)
        inside = scan_filter(steps, query)
        if first is not None or end is not None:
            inside = inside & time_test(steps, self.first, None if end is None else self.end - _MICRO)
        self.steps = steps.df.where(inside)
        rows = scan_filter(index, query)
        edges = F.lit(False)
        if gte is not None and gte < self.first:
            edges = edges | time_test(index, gte, self.first - _MICRO)
        if lte is not None:
            edges = edges | time_test(index, self.end, lte)
        if gte is not None and first == end:
            edges = time_test(index, gte, lte)
        self.edges = index.df.where(rows & edges) if ranges and (gte or lte) else index.df.limit(0)

    def summary(self, histograms: list[hist.Histogram]):
        parts = [hist.summarise(self.steps, histograms, COUNT), hist.summarise(self.edges, histograms)]
        return merge.summed(parts)

    def last_date(self, size: int, descending: bool) -> date | None:
        """The date by which at least ``size`` rows were met, in order of time."""
        days = self.steps.where(F.col(DATE).isNotNull()).groupBy(DATE).agg(F.sum(COUNT).alias("n")).collect()
        held = 0
        for day in sorted(days, key=lambda row: row[DATE], reverse=descending):
            held += day.n
            if held >= size:
                return day[DATE]
        return None


def _by_time(index: LogIndex, request: Mapping[str, Any]) -> bool | None:
    """Whether hits come in descending order of time; None in another order."""
    entries = [item for entry in request.get("sort") or [] for item in entry.items()]
    if not entries:
        return False
    (name, how), *more = entries
    if more or name not in (RANGE_KEY, *index.time_keys):
        return None
    return (how or {}).get("order", "asc") == "desc"


def _within(index: LogIndex, day: date, descending: bool) -> Column:
    column = F.col(quoted(index.partition))
    if descending:
        return column >= F.lit(day)
    return column.isNull() | (column <= F.lit(day))  # rows without a time come first


def search_counted(index: LogIndex, counts: PartialCounts, request: Mapping[str, Any]) -> SearchResult:
    """``search`` of a time table with the help of its partial counts.

    The counts must be those of the table's rows (see ``refresh_partials``). What
    they can't answer (filters on other columns, steps that cross buckets) is
    answered from the rows, as ``search`` does.
    """
    plain = search(index, request)
    split = _split(index, counts, request.get("query"))
    if split is None:
        return plain
    found = _Counted(index, counts, *split)
    histograms = request_histograms(index, request)
    if all(_fits(index, counts, h) for h in histograms):
        plain = replace(plain, summary=found.summary(histograms))
    size, descending = request.get("size"), _by_time(index, request)
    if size and descending is not None and index.partition is not None:
        day = found.last_date(size, descending)
        if day is not None:
            near = index.with_df(index.df.where(_within(index, day, descending)))
            plain = replace(plain, hits=search(near, request).hits)
    return plain

"""Search filters as Spark predicates.

Every predicate is two-valued: a missing value makes a test false, never NULL,
so negation keeps rows that lack a field.  Tests are written as
``isNotNull AND test`` or ``<=>`` because those forms reach the scan as pushed
filters, which ``coalesce(test, false)`` does not.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, ge, gt, le, lt, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.documents import string_field_equals
from tidelog.functions.times import TimeColumn, parse_instant, quoted
from tidelog.sources.index import DOCUMENT, LogIndex

# Fixed value: the key under which a request writes its time range.
RANGE_KEY = "datetime"


def match_all() -> Column:
    return F.lit(True)


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(and_, tests) if tests else match_all()


def any_of(tests: Sequence[Column]) -> Column:
    """True when one test is; an empty list is no condition at all."""
    return reduce(or_, tests) if tests else match_all()


def contains_text(text: Column, query: str) -> Column:
    """Case-sensitive substring."""
    return text.isNotNull() & text.contains(query)


def like_text(text: Column, query: str) -> Column:
    """Substring in which ``%`` and ``_`` of the query act as wildcards.

    Same as ``LIKE '%query%'`` in linear time: the parts between ``%`` are
    looked for one after the other and a part once found is not given up,
    where LIKE goes back and tries every other place.
    """
    parts = [part for part in query.split("%") if part]
    if not parts:
        return text.isNotNull()
    if len(parts) == 1 and "_" not in query:
        return contains_text(text, parts[0])
    found = [".".join(re.escape(each) for each in part.split("_")) for part in parts]
    if len(found) == 1:
        pattern = "(?s)" + found[0]
    else:
        pattern = "(?s)\\A" + "".join(f"(?>.*?{each})" for each in found)
    return text.isNotNull() & text.rlike(pattern)


def multi_match(index: LogIndex, query: str) -> Column:
    if index.flavour == DOCUMENT:
        return contains_text(index.raw_text(), query)
    test = like_text if index.wildcards else contains_text
    return any_of([test(F.col(quoted(name)), query) for name in index.searchable])


def match_phrase(index: LogIndex, values: Mapping[str, str]) -> Column:
    """Exact equality: all fields (document) or any searchable one (columnar)."""
    if index.flavour == DOCUMENT:
        return all_of([_phrase_field(index, *item) for item in values.items()])
    return any_of(
        [
            F.col(quoted(name)).eqNullSafe(F.lit(values[name]))
            for name in index.searchable
            if name in values
        ]
    )


def _phrase_field(index: LogIndex, name: str, value: str) -> Column:
    if index.doc is not None:
        return string_field_equals(F.col(quoted(index.doc)), name, value)
    typed = {f.name: f.dataType for f in index.df.schema.fields}
    if isinstance(typed.get(name), T.StringType):
        return F.col(quoted(name)).eqNullSafe(F.lit(value))
    return F.lit(False)


def written_bounds(index: LogIndex, range_filter: Mapping[str, Any]) -> Mapping[str, Any]:
    """The bounds as the request has them, under any name of the time column."""
    names = (RANGE_KEY, *index.time_keys)
    return next((range_filter[name] for name in names if name in range_filter), None) or {}


def time_bounds(index: LogIndex, range_filter: Mapping[str, Any]):
    """``(gte, lte)`` of a range filter, None where open."""
    if index.time is None:
        raise ValueError(f"{index.name!r} has no time column")
    bounds = written_bounds(index, range_filter)
    gte, lte = parse_instant(bounds.get("gte")), parse_instant(bounds.get("lte"))
    if index.flavour != DOCUMENT:
        # whole seconds, applied to the constants and never to the column
        gte = gte and gte.replace(microsecond=0)
        lte = lte and lte.replace(microsecond=0)
    return gte, lte


def time_range(index: LogIndex, range_filter: Mapping[str, Any]) -> Column:
    """The time test; on a time table it also names the dates that can pass.

    Rows that pass the time test pass that of the date, so both together mean
    the same as the time test alone, also when negated.
    """
    return time_test(index, *time_bounds(index, range_filter))


# Fixed value: the bounds of a range and what they ask.
BOUNDS = {"gte": ge, "gt": gt, "lte": le, "lt": lt}


def any_range(index: LogIndex, range_filter: Mapping[str, Any]) -> Column:
    """Extension: ranges of the time and of other fields, with all four bounds.

    ``gte`` and ``lte`` of the time mean what they mean without the extension;
    other tests are false where the value is missing. An unknown field or bound
    is an error.
    """
    tests = []
    for name, bounds in range_filter.items():
        is_time = name == RANGE_KEY or name in index.time_keys
        time = index.time if is_time else _time_field(index, name)
        column = index.field_column(name) if time is None else F.expr(time.sql)
        if column is None or (index.doc is not None and not is_time and name not in index.fields):
            raise ValueError(f"{index.name!r} has no field {name!r} of a known type")
        unknown = set(bounds) - set(BOUNDS) - {"format", "time_zone"}
        if unknown:
            raise ValueError(f"unknown bounds of {name!r}: {sorted(unknown)}")
        asked = {key: bounds[key] for key in BOUNDS if bounds.get(key) is not None}
        if is_time:
            tests.append(time_range(index, range_filter))
            asked = {key: value for key, value in asked.items() if key in ("gt", "lt")}
        if time is not None:
            asked = {key: F.expr(time.literal(parse_instant(value))) for key, value in asked.items()}
        for key, value in asked.items():
            tests.append(column.isNotNull() & BOUNDS[key](column, F.lit(value)))
    return all_of(tests)


def _time_field(index: LogIndex, name: str) -> TimeColumn | None:
    """A column of instants, whose bounds are read as those of the time are."""
    kinds = {f.name: f.dataType for f in index.df.schema.fields}
    if isinstance(kinds.get(name), (T.TimestampType, T.TimestampNTZType)):
        return TimeColumn.of(index.df, name)
    if index.doc is not None and name in index.fields and index.fields[name].type == "date":
        raise ValueError(f"ranges of {name!r}, a date inside documents, are not supported")
    return None


def time_test(index: LogIndex, gte, lte) -> Column:
    test = index.time.between(gte, lte, missing_is_first=index.flavour == DOCUMENT)
    if index.partition is None or (gte is None and lte is None):
        return test
    return _partition_range(index, gte, lte) & test


def exclude(test: Column) -> Column:
    return ~test


def one_filter(index: LogIndex, spec: Mapping[str, Any] | None, extensions: bool = False) -> Column:
    """One filter object; when it holds several kinds the first listed wins.

    ``extensions`` honours ranges of other fields than the time (``any_range``).
    """
    spec = spec or {}
    if spec.get("bool") is not None:
        return nested_bool(index, spec["bool"], extensions)
    if spec.get("multi_match") is not None:
        return multi_match(index, spec["multi_match"].get("query", ""))
    if spec.get("match_phrase") is not None:
        return match_phrase(index, spec["match_phrase"])
    if spec.get("match_all") is not None:
        return match_all()
    if spec.get("range") is not None:
        return (any_range if extensions else time_range)(index, spec["range"])
    return match_all()


def nested_bool(index: LogIndex, spec: Mapping[str, Any], extensions: bool = False) -> Column:
    """Inner bool: a ``filter`` list and a ``must_not`` object (or list)."""
    unwanted = spec.get("must_not")
    if isinstance(unwanted, Mapping):
        unwanted = [unwanted]
    return all_of(
        [one_filter(index, each, extensions) for each in spec.get("filter") or []]
        + [exclude(one_filter(index, each, extensions)) for each in unwanted or []]
    )


def query_filter(
    index: LogIndex, query: Mapping[str, Any] | None, use_should: bool = False
) -> Column:
    """The predicate of a whole query; ``use_should`` honours the extensions:
    ``should``, and ranges of any field."""
    if query is None:
        return match_all()
    root = query.get("bool")
    if root is None:
        raise ValueError("unsupported query type")
    required = [*(root.get("filter") or []), *(root.get("must") or [])]
    tests = [one_filter(index, each, use_should) for each in required]
    tests += [exclude(one_filter(index, each, use_should)) for each in root.get("must_not") or []]
    should = root.get("should") or []
    if use_should and should and not required:
        tests.append(any_of([one_filter(index, each, use_should) for each in should]))
    return all_of(tests)


def request_bounds(index: LogIndex, query: Mapping[str, Any] | None):
    """Bounds of the first range directly under ``query.bool.filter``."""
    root = (query or {}).get("bool") or {}
    for each in root.get("filter") or []:
        if each and each.get("range") is not None:
            return time_bounds(index, each["range"])
    return None, None


def scan_filter(
    index: LogIndex, query: Mapping[str, Any] | None, use_should: bool = False
) -> Column:
    """``query_filter`` plus what the request's time bounds add to the scan."""
    test = query_filter(index, query, use_should)
    gte, lte = request_bounds(index, query)
    if index.flavour == DOCUMENT and (gte or lte):
        test = time_test(index, gte, lte) & test
    return test


def requires_time(index: LogIndex, query: Mapping[str, Any] | None) -> bool:
    """Whether ``scan_filter`` passes no row without a time."""
    if index.flavour == DOCUMENT and request_bounds(index, query)[0] is not None:
        return True
    root = (query or {}).get("bool") or {}
    first = ("bool", "multi_match", "match_phrase", "match_all")
    return any(
        each
        and each.get("range") is not None
        and not any(each.get(kind) is not None for kind in first)
        and time_bounds(index, each["range"])[0] is not None
        for each in [*(root.get("filter") or []), *(root.get("must") or [])]
    )


def _partition_range(index: LogIndex, gte, lte) -> Column:
    """Partitions that can hold a row of the range; unknown dates stay in."""
    day = F.col(quoted(index.partition))
    tests = []
    if gte is not None:
        tests.append(day >= F.lit(gte.date()))
    if lte is not None:
        tests.append(day <= F.lit(lte.date()))
    if not tests:
        return match_all()
    inside = day.isNotNull() & all_of(tests)
    return inside if gte is not None else inside | day.isNull()

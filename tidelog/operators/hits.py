"""Hit rows: projection, order and size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.times import quoted
from tidelog.operators.predicates import RANGE_KEY
from tidelog.sources.index import LogIndex

# Scores are not computed: every hit has this one.
SCORE = 0.0

HIT_COLUMNS = ["_index", "_id", "_score", "_source", "sort"]


def hit_columns(index: LogIndex, source: Column | None = None) -> list[Column]:
    """The columns of a hit."""
    return [
        F.lit(index.name).alias("_index"),
        index.id_column().alias("_id"),
        F.lit(SCORE).alias("_score"),
        (index.source() if source is None else source).alias("_source"),
        F.array(index.time.seconds()).alias("sort"),
    ]


def project_hits(index: LogIndex, df: DataFrame, with_uuid: bool = False) -> DataFrame:
    """Rows as hits; ``with_uuid`` gives random ids, new ones on every call."""
    hits = df.select(*hit_columns(index))
    return hits.withColumn("_id", F.uuid()) if with_uuid else hits


def time_order(index: LogIndex, descending: bool = False) -> list[Column]:
    """By whole second, then by id, so that a size limit is repeatable."""
    second = index.time.seconds()
    first = second.desc() if descending else second.asc()
    return [first, index.tiebreak().asc()]


def _undeclared_key(index: LogIndex, name: str) -> bool:
    known = (RANGE_KEY, *index.time_keys, *index.fields, *index.df.columns)
    return index.doc is not None and name not in known


def sort_entries(
    index: LogIndex, sort: Sequence[Mapping[str, Mapping]] | None
) -> list[tuple[Column | None, bool]]:
    """(column, descending) of a request's ``sort`` list.

    A name that the index lacks is an error unless its entry has an
    ``unmapped_type``: then it has no column.  Values of an undeclared key of
    a document may be of any kind: numbers come in their order, then texts.
    """
    entries = []
    for entry in sort or []:
        for name, how in entry.items():
            if name == RANGE_KEY or name in index.time_keys:
                column = index.time.seconds()
            else:
                column = index.field_column(name)
            if column is not None and _undeclared_key(index, name):
                number, text = (F.try_variant_get(column, "$", kind) for kind in ("double", "string"))
                column = F.struct(number.isNull().alias("other"), number.alias("number"), text.alias("text"))
                column = F.when(text.isNotNull(), column)
            if column is None and not (how or {}).get("unmapped_type"):
                raise ValueError(f"{index.name!r} has no field {name!r} to sort by")
            entries.append((column, (how or {}).get("order", "asc") == "desc"))
    return entries


def requested_order(
    index: LogIndex, sort: Sequence[Mapping[str, Mapping]] | None
) -> list[Column]:
    """A request's ``sort`` list; the default is ascending time."""
    order = [
        column.desc() if descending else column.asc()
        for column, descending in sort_entries(index, sort)
        if column is not None
    ]
    if not order:
        return time_order(index)
    return [*order, index.tiebreak().asc()]


def requested_sort_field(request: Mapping) -> Mapping:
    """The sort entry of the request's only docvalue field."""
    fields = request.get("docvalue_fields") or []
    if len(fields) != 1:
        raise ValueError("unsupported docvalue fields")
    return (request.get("sort") or [{}])[0].get(fields[0]["field"])


def limit_rows(df: DataFrame, order: list[Column], size: int | None) -> DataFrame:
    """The first ``size`` rows (None: all), planned as a distributed top-k."""
    ordered = df.orderBy(*order)
    return ordered if size is None else ordered.limit(size)


def first_rows(
    index: LogIndex,
    df: DataFrame,
    order: list[Column],
    size: int | None,
    time_known: bool = False,
) -> DataFrame:
    """``limit_rows`` that reads wide columns only where hits are.

    On a date-partitioned table with a key, the top-k is found on the narrow
    columns first.  Its at most ``size`` keys are then joined back, which
    prunes the second read to the dates that hold hits.  ``time_known`` says
    that ``df`` has no rows without a time (they have no date to join on).
    """
    two_steps = time_known and index.partition is not None and index.id is not None
    if not two_steps or size is None:
        return limit_rows(df, order, size)
    keys = limit_rows(df, order, size).select(
        F.col(quoted(index.partition)).alias("_day"), F.col(quoted(index.id)).alias("_key")
    )
    same = (F.col(quoted(index.partition)) == F.col("_day")) & F.col(
        quoted(index.id)
    ).eqNullSafe(F.col("_key"))
    found = df.join(keys, same, "left_semi")
    return limit_rows(found, order, size)


def docvalue_columns(
    index: LogIndex, fields: Sequence[Mapping[str, str]]
) -> list[Column]:
    """Extension: requested extra columns; ``date_time`` formats the time.

    A name that the index lacks is left out.
    """
    columns = []
    for entry in fields:
        name = entry["field"]
        if name not in index.time_keys:
            value = index.field_column(name)
        elif entry.get("format") == "date_time":
            text = times.format_rfc3339_fraction(index.time.sql, index.time.ntz, 3)
            value = F.expr(text)
        else:
            value = F.col(quoted(index.time.name))
        if value is not None:
            columns.append(value.alias(name))
    return columns

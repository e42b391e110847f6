"""What a search runs on: a named DataFrame of time-stamped rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.documents import document_time, field_as, field_value, row_json
from tidelog.functions.times import TimeColumn, quoted

# Declared field types and the Spark type each one is read as.
FIELD_TYPES: dict[str, T.DataType] = {
    "date": T.TimestampType(),
    "ip": T.StringType(),
    "keyword": T.StringType(),
    "text": T.StringType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
}

DOCUMENT = "document"
COLUMNAR = "columnar"


@dataclass(frozen=True)
class Field:
    """A declared field."""

    type: str
    searchable: bool = False
    aggregatable: bool = False

    def __post_init__(self) -> None:
        if self.type not in FIELD_TYPES:
            raise ValueError(f"unknown field type {self.type!r}")

    @classmethod
    def of(cls, value: "Field | Mapping") -> "Field":
        if isinstance(value, Field):
            return value
        return cls(
            value["type"],
            bool(value.get("searchable", False)),
            bool(value.get("aggregatable", False)),
        )

    @property
    def metadata(self) -> dict:
        return {
            "type": self.type,
            "searchable": self.searchable,
            "aggregatable": self.aggregatable,
        }


@dataclass(frozen=True)
class LogIndex:
    """A log and the rules its searches follow.

    ``flavour`` selects one of the two sets of search rules (see the README).
    ``partition`` names a DATE column holding the UTC date of the time column,
    as ``write_time_table`` lays tables out; time ranges then prune partitions.
    ``time_field`` is the name that requests use for the time column where
    the log calls it otherwise than the DataFrame.  ``files`` is the file index
    of a raw log: a search of it reads only files that can match.
    """

    name: str
    df: DataFrame
    time: TimeColumn | None
    fields: Mapping[str, Field] = field(default_factory=dict)
    id: str | None = None
    raw: str | None = None
    doc: str | None = None
    flavour: str = COLUMNAR
    wildcards: bool = True
    partition: str | None = None
    time_field: str | None = None
    files: Any = None

    @property
    def time_keys(self) -> tuple[str, ...]:
        """The names by which a request may call the time column."""
        names = (self.time_field, self.time and self.time.name)
        return tuple(name for name in names if name is not None)

    def field_column(self, name: str) -> Column | None:
        """A field that a request names: of its declared type in a document,
        a column, or what a document holds under an undeclared key."""
        if self.doc is not None and name in self.fields:
            kind = self.fields[name].type
            if kind == "date":
                return document_time(F.col(quoted(self.doc)), name)
            kind = FIELD_TYPES[kind].simpleString()
            return field_as(F.col(quoted(self.doc)), name, kind)
        if name in self.df.columns:
            return F.col(quoted(name))
        if self.doc is not None:
            return field_value(F.col(quoted(self.doc)), name)
        return None

    @property
    def searchable(self) -> list[str]:
        """The declared text columns that a text search looks at."""
        return [
            name
            for name, declared in self.fields.items()
            if declared.type == "text" and declared.searchable
        ]

    @property
    def source_columns(self) -> list[str]:
        hidden = {self.doc, self.partition}
        return [name for name in self.df.columns if name not in hidden]

    def raw_text(self) -> Column:
        """The whole row as text: the raw line, else the row as JSON."""
        if self.raw is not None:
            return F.col(quoted(self.raw))
        return row_json(*self.source_columns)

    def source(self) -> Column:
        """The whole row as one value."""
        if self.doc is not None:
            return F.col(quoted(self.doc))
        return F.struct(*(F.col(quoted(name)) for name in self.source_columns))

    def id_column(self) -> Column:
        """A stable id: the key column, else a digest of the row."""
        if self.id is not None:
            return F.col(quoted(self.id)).cast("string")
        return F.sha2(self.raw_text(), 256)

    def tiebreak(self) -> Column:
        """Orders rows of one second.  Equal values are equal rows."""
        return F.col(quoted(self.id)) if self.id is not None else self.raw_text()

    def with_df(self, df: DataFrame) -> "LogIndex":
        return replace(self, df=df)


def log_index(
    name: str,
    df: DataFrame,
    time: str | None,
    *,
    fields: Mapping[str, Field | Mapping] | None = None,
    text: list[str] | None = None,
    id: str | None = None,
    raw: str | None = None,
    doc: str | None = None,
    flavour: str | None = None,
    wildcards: bool = True,
    partition: str | None = None,
    time_field: str | None = None,
    files: Any = None,
) -> LogIndex:
    """Describe a log.  A log with a raw line follows the document rules.

    ``text`` is a short way to declare searchable text columns.  ``time`` may
    be None for a table that is only filtered by text or value.
    """
    declared = {key: Field.of(value) for key, value in (fields or {}).items()}
    for column in text or []:
        declared.setdefault(column, Field("text", searchable=True))
    flavour = flavour or (COLUMNAR if raw is None else DOCUMENT)
    if flavour not in (DOCUMENT, COLUMNAR):
        raise ValueError(f"unknown flavour {flavour!r}")
    return LogIndex(
        name=name,
        df=df,
        time=None if time is None else TimeColumn.of(df, time),
        fields=declared,
        id=id,
        raw=raw,
        doc=doc,
        flavour=flavour,
        wildcards=wildcards,
        partition=partition,
        time_field=time_field,
        files=files,
    )

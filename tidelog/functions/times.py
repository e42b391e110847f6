"""Timestamp helpers that do not depend on the session time zone.

A log's time column may be TIMESTAMP (an instant) or TIMESTAMP_NTZ (read here
as UTC wall time).  ``TimeColumn`` hides the difference, so the operators can
be written once.

The helpers take and return SQL expression text for ``F.expr``: one parsed
expression costs the driver one call, where the same tree built from Column
objects costs a call per node.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted timestamp text, and the origin that truncation to
# a step counts from (0001-01-01T00:00:00Z, in seconds before 1970).
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
YEAR_ONE_SECONDS = 62_135_596_800

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
EPOCH = "TIMESTAMP'1970-01-01 00:00:00+00:00'"
DAY_SECONDS = 86_400
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_instant(value: str | datetime | None) -> datetime | None:
    """A request bound as an aware UTC datetime; naive datetimes are UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        if not re.match(RFC3339, value):
            raise ValueError(f"not an RFC3339 timestamp: {value!r}")
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    if value == datetime(1, 1, 1, tzinfo=timezone.utc):
        return None  # the zero time stands for "no bound"
    return value.astimezone(timezone.utc)


def instant_micros(value: datetime) -> int:
    return (value - _EPOCH) // timedelta(microseconds=1)


def micros_instant(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


def utc_offset_minutes(value: str | datetime | None) -> int:
    """The offset a request bound was written with (0 for UTC and naive)."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value is None or value.utcoffset() is None:
        return 0
    return value.utcoffset() // timedelta(minutes=1)


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class TimeColumn:
    """The time column of a log: its name and whether it is TIMESTAMP_NTZ."""

    name: str
    ntz: bool

    @classmethod
    def of(cls, df: DataFrame, name: str) -> "TimeColumn":
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"time column {name!r} is {kind.simpleString()}")
        return cls(name, isinstance(kind, T.TimestampNTZType))

    @property
    def sql(self) -> str:
        return quoted(self.name)

    def literal(self, instant: datetime) -> str:
        """A constant of the column's own type, so comparisons push down."""
        utc = instant.astimezone(timezone.utc).replace(tzinfo=None)
        text = utc.isoformat(sep=" ", timespec="microseconds")
        return f"TIMESTAMP_NTZ'{text}'" if self.ntz else f"TIMESTAMP'{text}+00:00'"

    def between(
        self,
        gte: datetime | None,
        lte: datetime | None,
        missing_is_first: bool = False,
    ) -> Column:
        """Inclusive range, never NULL and pushed to the scan.

        ``missing_is_first`` counts a missing time as earlier than every
        bound: a range without ``gte`` then keeps such rows.
        """
        if gte is None and lte is None:
            return F.lit(True)
        if gte is None and missing_is_first:
            return F.expr(f"{self.sql} IS NULL OR {self.sql} <= {self.literal(lte)}")
        tests = [f"{self.sql} IS NOT NULL"]
        if gte is not None:
            tests.append(f"{self.sql} >= {self.literal(gte)}")
        if lte is not None:
            tests.append(f"{self.sql} <= {self.literal(lte)}")
        return F.expr(" AND ".join(tests))

    def seconds(self) -> Column:
        """Unix seconds, rounded down."""
        return F.expr(unix_seconds(self.sql, self.ntz))

    def utc_date(self) -> Column:
        return F.expr(utc_date(self.sql, self.ntz))


def floor_div(value: str, step: int) -> str:
    """Integer division rounding down, in BIGINT (``div`` rounds toward zero)."""
    return f"(({value} - pmod({value}, {step}L)) div {step}L)"


def unix_seconds(ts: str, ntz: bool) -> str:
    if not ntz:
        return f"unix_seconds({ts})"
    # unix_timestamp is zone-free and cheap for NTZ but rounds toward zero,
    # so times before 1970 take the exact, slower way.
    exact = floor_div(unix_micros(ts, True), 1_000_000)
    return f"CASE WHEN {ts} >= {EPOCH_NTZ} THEN unix_timestamp({ts}) ELSE {exact} END"


def unix_micros(ts: str, ntz: bool) -> str:
    """Exact epoch microseconds.

    For NTZ this goes through an interval (several times the cost of a plain
    long): use it on aggregated rows, not once per log row.  ``timestampdiff``
    would not do, because it reads NTZ values in the session time zone.
    """
    if not ntz:
        return f"unix_micros({ts})"
    since = f"CAST({ts} - {EPOCH_NTZ} AS INTERVAL SECOND)"
    return f"CAST(CAST({since} AS DECIMAL(20,6)) * 1000000 AS BIGINT)"


def unix_millis(ts: str, ntz: bool) -> str:
    return floor_div(unix_micros(ts, True), 1_000) if ntz else f"unix_millis({ts})"


def utc_date(ts: str, ntz: bool) -> str:
    if ntz:
        return f"to_date({ts})"
    days = floor_div(f"unix_seconds({ts})", DAY_SECONDS)
    return f"date_from_unix_date(CAST({days} AS INT))"


def utc_wall_time(us: str) -> str:
    """Epoch microseconds as a TIMESTAMP_NTZ in UTC."""
    return f"timestampadd(MICROSECOND, {us}, {EPOCH_NTZ})"


def convert_zone(source: str, target: str, wall: str) -> str:
    """A TIMESTAMP_NTZ moved between time zones; names come from requests."""
    for zone in (source, target):
        if not re.fullmatch(r"[A-Za-z0-9_+\-/:]+", zone):
            raise ValueError(f"no time zone: {zone!r}")
    return f"convert_timezone('{source}', '{target}', {wall})"


def format_rfc3339(millis: str, offset_minutes: int = 0) -> str:
    """Epoch milliseconds as RFC3339 text without fraction."""
    zone = "Z"
    if offset_minutes:
        hours, minutes = divmod(abs(offset_minutes), 60)
        zone = f"{'-' if offset_minutes < 0 else '+'}{hours:02d}:{minutes:02d}"
    shifted = f"{millis} * 1000 + {offset_minutes * 60_000_000}L"
    text = f"CAST({utc_wall_time(shifted)} AS STRING)"
    return f"concat(substr({text}, 1, 10), 'T', substr({text}, 12, 8), '{zone}')"


def format_rfc3339_fraction(ts: str, ntz: bool, digits: int) -> str:
    """RFC3339 text in UTC with 1 to 6 digits of fraction."""
    us = unix_micros(ts, ntz)
    second = format_rfc3339(floor_div(us, 1_000))
    fraction = f"substr(lpad(pmod({us}, 1000000L), 6, '0'), 1, {digits})"
    return f"concat(substr({second}, 1, 19), '.', {fraction}, 'Z')"


def parse_rfc3339(text: Column) -> Column:
    """RFC3339 text to TIMESTAMP; anything else is NULL.

    The pattern keeps out the other forms Spark would accept (bare dates,
    missing offset).  Digits beyond microseconds are cut off.
    """
    dotted = F.when(text.contains(","), F.replace(text, F.lit(","), F.lit(".")))
    return F.when(
        text.rlike(RFC3339), F.try_to_timestamp(F.coalesce(dotted, text))
    )

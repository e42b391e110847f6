"""Date histograms.

Fixed-length buckets use ``window`` (plain long arithmetic inside the scan's
generated code) and calendar months use DATE arithmetic.  Epoch keys and text
are derived after the aggregation, from one row per bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import times
from tidelog.functions.intervals import Interval
from tidelog.functions.times import TimeColumn

# Fixed value: day of the first Monday after 1970-01-01, where weeks start.
MONDAY_OFFSET = "4 days"

_MONTHS_1970 = 1970 * 12

# Steps that one row lists when gaps are filled.
CHUNK = 65_536


@dataclass(frozen=True)
class Histogram:
    """One named histogram over one time column.

    With ``gte`` and ``lte`` the buckets are anchored at ``gte`` and only
    whole buckets up to ``lte`` count; without, they follow the clock.
    ``zone`` (an extension) aligns clock buckets to a time zone's wall time.
    """

    name: str
    time: TimeColumn
    interval: Interval
    gte: datetime | None = None
    lte: datetime | None = None
    zone: str | None = None
    offset_minutes: int = 0

    @property
    def anchored(self) -> bool:
        return self.gte is not None

    @property
    def whole_buckets(self) -> int:
        span = times.instant_micros(self.lte) - times.instant_micros(self.gte)
        return max(span, 0) // self.interval.micros

    @property
    def end(self) -> datetime:
        """First instant after the last whole bucket of an anchored one."""
        start = times.instant_micros(self.gte)
        return times.micros_instant(start + self.whole_buckets * self.interval.micros)

    def shape(self) -> tuple:
        """Equal for histograms whose buckets come from the same column."""
        return (self.time, self.zone)


def anchored(
    name: str,
    time: TimeColumn,
    interval: Interval,
    gte: datetime | None,
    lte: datetime | None,
    offset_minutes: int = 0,
) -> Histogram:
    if gte is None or lte is None:
        raise ValueError("an anchored histogram needs a range with gte and lte")
    return Histogram(name, time, interval, gte, lte, offset_minutes=offset_minutes)


def _wall(h: Histogram, us: str) -> str:
    """The zone's wall time of UTC microseconds."""
    return times.convert_zone("UTC", h.zone, times.utc_wall_time(us))


def _zoned_bucket(h: Histogram) -> str:
    """UTC start of the row's bucket of wall time.

    The start keeps the row's own offset where the clock did not change since,
    so the doubled hour of a clock change is two buckets; else it is the
    instant at which the zone's clock showed it.
    """
    size = h.interval.micros
    offset = 4 * times.DAY_SECONDS * 1_000_000 if h.interval.unit == "w" else 0
    us = times.unix_micros(h.time.sql, h.time.ntz)
    wall = times.unix_micros(_wall(h, us), True)
    into = f"pmod({wall} - {offset}L, {size}L)"
    own, shown = f"({us} - {into})", times.utc_wall_time(f"({wall} - {into})")
    moved = times.convert_zone(h.zone, "UTC", shown)
    same = f"{_wall(h, own)} = {shown}"
    return f"CASE WHEN {same} THEN {times.utc_wall_time(own)} ELSE {moved} END"


def bucket(h: Histogram) -> Column:
    """Start of the row's bucket, NULL where the time is missing."""
    ts, ntz = h.time.sql, h.time.ntz
    months = h.interval.months
    if h.zone is not None:
        if months is None:
            return F.expr(_zoned_bucket(h))
        ts, ntz = _wall(h, times.unix_micros(ts, ntz)), True
    if months is not None:
        return F.expr(_month_bucket(times.utc_date(ts, ntz), months))
    offset = "0 seconds"
    if h.anchored:
        offset = f"{times.instant_micros(h.gte) % h.interval.micros} microseconds"
    elif h.interval.unit == "w":
        offset = MONDAY_OFFSET
    # window() drops rows without a time; they must stay for the total
    present = f"coalesce({ts}, {times.EPOCH_NTZ if ntz else times.EPOCH})"
    size = f"{h.interval.seconds} seconds"
    start = f"window({present}, '{size}', '{size}', '{offset}').start"
    return F.expr(f"CASE WHEN {ts} IS NOT NULL THEN {start} END")


def _month_bucket(day: str, months: int) -> str:
    if months == 1:
        return f"trunc({day}, 'month')"
    if months == 12:
        return f"trunc({day}, 'year')"
    number = f"(year({day}) * 12 + month({day}) - {_MONTHS_1970 + 1})"
    return f"add_months(DATE'1970-01-01', {number} - pmod({number}, {months}))"


def add_buckets(df: DataFrame, histograms: list[Histogram]) -> DataFrame:
    """Add ``_bucket0``, ``_bucket1``, … (one projection per window)."""
    for i, h in enumerate(histograms):
        df = df.withColumn(f"_bucket{i}", bucket(h))
    return df


def bucket_millis(h: Histogram, start: str, kind: T.DataType) -> str:
    """Epoch milliseconds of a bucket start, rounded down."""
    if h.zone is not None and h.interval.months is not None:
        wall = f"CAST({start} AS TIMESTAMP_NTZ)"
        return times.unix_millis(times.convert_zone(h.zone, "UTC", wall), True)
    if isinstance(kind, T.DateType):
        return f"unix_date({start}) * {times.DAY_SECONDS * 1_000}L"
    return times.unix_millis(start, isinstance(kind, T.TimestampNTZType))


def is_whole(h: Histogram, start: str) -> str:
    """The bucket counts: it is known, and inside the anchored range."""
    if not h.anchored:
        return f"{start} IS NOT NULL"
    first, end = h.time.literal(h.gte), h.time.literal(h.end)
    return f"({start} IS NOT NULL AND {start} >= {first} AND {start} < {end})"


def finish(df: DataFrame, h: Histogram, start: str, count: str) -> DataFrame:
    """``(agg, key, key_as_string, doc_count)`` from bucket starts and counts."""
    key = bucket_millis(h, start, df.schema[start].dataType)
    return (
        df.where(is_whole(h, start))
        .selectExpr(f"{key} AS key", f"{count} AS doc_count")
        .select(
            F.lit(h.name).alias("agg"),
            "key",
            F.expr(times.format_rfc3339("key", h.offset_minutes)).alias("key_as_string"),
            "doc_count",
        )
    )


def date_histogram(df: DataFrame, h: Histogram) -> DataFrame:
    """One histogram, in ascending key order."""
    return bucket_counts(df, h).orderBy("key")


def bucket_counts(df: DataFrame, h: Histogram) -> DataFrame:
    """``date_histogram`` in no order, for parts that are merged."""
    if h.anchored:
        # the tail is dropped before the aggregation, so it is never read
        first, end = h.time.literal(h.gte), h.time.literal(h.end)
        df = df.where(f"{h.time.sql} >= {first} AND {h.time.sql} < {end}")
    counts = (
        df.where(f"{h.time.sql} IS NOT NULL")
        .select(bucket(h).alias("_bucket0"))
        .groupBy("_bucket0")
        .agg(F.count("*").alias("doc_count"))
    )
    return finish(counts, h, "_bucket0", "doc_count")


def summarise(df: DataFrame, histograms: list[Histogram], weight: str | None = None) -> DataFrame:
    """All histograms and the row count in one pass over ``df``.

    Rows are ``(agg, key, key_as_string, doc_count)``; the row count has a
    NULL ``agg``.  ``weight`` names a column that says how many rows of a log
    one of ``df`` stands for.
    """
    counted = F.count("*")
    if weight is not None:
        counted = F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")
    if not histograms:
        return df.agg(counted.alias("doc_count")).select(
            F.lit(None).cast("string").alias("agg"),
            F.lit(None).cast("bigint").alias("key"),
            F.lit(None).cast("string").alias("key_as_string"),
            "doc_count",
        )
    names = [f"_bucket{i}" for i in range(len(histograms))]
    rows = add_buckets(df, histograms).select(*names, *([] if weight is None else [weight]))
    if len({h.shape() for h in histograms}) == 1:
        # Buckets of one column nest or interleave, so there are few distinct
        # combinations: count those first, then roll the small result up.
        rows = rows.groupBy(*names).agg(counted.alias("_rows"))
        counted = F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint")
    # Combinations of unrelated columns could multiply, so there each histogram is
    # only its own grouping set.
    sets = [[F.col(name)] for name in names] + [[]]
    grouped = rows.groupingSets(sets, *[F.col(name) for name in names]).agg(
        counted.alias("doc_count"),
        *[F.grouping(name).alias(f"_out{i}") for i, name in enumerate(names)],
    )
    return _label(grouped, histograms)


def _label(grouped: DataFrame, histograms: list[Histogram]) -> DataFrame:
    """Turn grouping-set rows into labelled buckets without another pass."""
    named, keys, kept = [], [], []
    for i, h in enumerate(histograms):
        start, mine = f"_bucket{i}", f"WHEN _out{i} = 0 THEN"
        kind = grouped.schema[start].dataType
        named.append(f"{mine} {i}")
        keys.append(f"{mine} {bucket_millis(h, start, kind)}")
        kept.append(f"{mine} {is_whole(h, start)}")
    names = F.array(*[F.lit(h.name) for h in histograms])
    labelled = grouped.where(f"CASE {' '.join(kept)} ELSE true END").select(
        F.get(names, F.expr(f"CASE {' '.join(named)} END")).alias("agg"),
        F.expr(f"CASE {' '.join(keys)} END").alias("key"),
        "doc_count",
    )
    # the histograms of one request share its bounds, hence their offset
    text = times.format_rfc3339("key", histograms[0].offset_minutes)
    return labelled.select("agg", "key", F.expr(text).alias("key_as_string"), "doc_count")


def docs_count(histogram: DataFrame) -> DataFrame:
    """Rows counted by a histogram (or by several, summed)."""
    total = F.coalesce(F.sum("doc_count"), F.lit(0)).cast("bigint")
    return histogram.agg(total.alias("bucket_total"))


def at_least(histogram: DataFrame, min_doc_count: int) -> DataFrame:
    """Extension: keep buckets with at least ``min_doc_count`` rows."""
    return histogram.where(F.col("doc_count") >= min_doc_count)


def fill_gaps(histogram: DataFrame, h: Histogram) -> DataFrame:
    """Extension (``min_doc_count`` 0): add the empty buckets.

    Anchored histograms are filled over their whole range, others from their
    first to their last bucket.  The series has one row per bucket, not per
    log row.
    """
    if h.anchored:
        first, step = times.instant_micros(h.gte), h.interval.micros
        starts = histogram.sparkSession.range(
            first, first + h.whole_buckets * step, step
        )
        series = starts.selectExpr(f"{times.floor_div('id', 1_000)} AS key")
    else:
        series = _clock_series(histogram, h)
    counts = histogram.select("key", "doc_count")
    filled = series.join(counts, "key", "full")  # no counted bucket is lost
    return filled.select(
        F.lit(h.name).alias("agg"),
        "key",
        F.expr(times.format_rfc3339("key", h.offset_minutes)).alias("key_as_string"),
        F.coalesce("doc_count", F.lit(0).cast("bigint")).alias("doc_count"),
    ).orderBy("key")


def _clock_series(histogram: DataFrame, h: Histogram) -> DataFrame:
    """Keys of all buckets between the first and the last one."""
    ends = histogram.selectExpr("min(key) AS lo", "max(key) AS hi")
    if h.interval.months is not None:
        return _month_series(ends, h)
    size = h.interval.seconds
    if h.zone is None:
        return _instants(ends, size).selectExpr("at AS key")
    # A clock change shortens or lengthens buckets; looking at this many
    # instants meets each of them.
    step = size // 4 if size >= 4 * 3_600 else math.gcd(size, 900)
    looks = _instants(ends, step).selectExpr("lo", "hi", f"{times.utc_wall_time('at * 1000')} AS at")
    at = replace(h, time=TimeColumn.of(looks, "at"))
    starts = looks.select("lo", "hi", bucket(at).alias("start"))
    keys = starts.selectExpr("lo", "hi", f"{bucket_millis(at, 'start', T.TimestampNTZType())} AS key")
    return keys.where("key BETWEEN lo AND hi").select("key").distinct()


def _instants(ends: DataFrame, step_seconds: int) -> DataFrame:
    """``(lo, hi, at)``: every step from ``lo`` to ``hi``, in milliseconds.

    Chunks of steps are dealt to all tasks before they are listed, so no row
    holds more than a chunk, whatever the gap.
    """
    spark, step = ends.sparkSession, step_seconds * 1_000
    chunks = ends.selectExpr(
        "lo", "hi", f"explode(sequence(0L, (hi - lo) div {step}L div {CHUNK}L)) AS chunk"
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = f"(lo + chunk * {CHUNK * step}L)"
    last = f"least(hi, {first} + {(CHUNK - 1) * step}L)"
    return chunks.selectExpr("lo", "hi", f"explode(sequence({first}, {last}, {step}L)) AS at")


def _month_series(ends: DataFrame, h: Histogram) -> DataFrame:
    zone = h.zone or "UTC"
    wall = [
        times.convert_zone("UTC", zone, times.utc_wall_time(f"{end} * 1000")) for end in ("lo", "hi")
    ]
    step = f"make_interval(0, {h.interval.months})"
    starts = ends.selectExpr(f"explode(sequence({wall[0]}, {wall[1]}, {step})) AS start")
    utc = times.convert_zone(zone, "UTC", "start")
    return starts.selectExpr(f"{times.unix_millis(utc, True)} AS key")

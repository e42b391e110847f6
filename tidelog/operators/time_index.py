"""Sparse time index: where each step of time starts in a log.

``position`` is any number that grows along the log (a row key, an offset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.times import TimeColumn

# Steps per group when neighbouring entries are looked up, and how often groups
# are grouped again: 8192 ** 3 steps are over 10,000 years of seconds.
GROUP, DEPTH = 8_192, 3


def truncate(ts: Column, step_seconds: int) -> Column:
    """Start of the step that ``ts`` falls in, counted from year one."""
    offset = -times.YEAR_ONE_SECONDS % step_seconds
    return F.window(ts, f"{step_seconds} seconds", None, f"{offset} seconds")["start"]


def time_index(df: DataFrame, ts: str, position: str, step_seconds: int) -> DataFrame:
    """``(bucket, first_ts, position)``: where every step starts.

    The position is that of the row with the first time, of rows of equal time
    the least.  Time and position are compared as one number, so the group-by
    is a hash aggregate: no order and no sort.  Rows without a time are left
    out.
    """
    rows = df.select(truncate(F.col(ts), step_seconds).alias("bucket"), ts, position)
    return rows.groupBy("bucket").agg(
        F.min(ts).alias("first_ts"),
        F.min_by(position, _order_of(df, ts, position)).alias("position"),
    )


def _order_of(df: DataFrame, ts: str, position: str) -> Column:
    """Time, then position, as one DECIMAL."""
    time = TimeColumn.of(df, ts)
    micros = times.unix_micros(time.sql, time.ntz)
    place = f"CAST({times.quoted(position)} AS DECIMAL(19,0))"
    high = "CAST(10000000000000000000 AS DECIMAL(20,0))"
    return F.expr(f"CAST(CAST({micros} AS DECIMAL(18,0)) * {high} + {place} AS DECIMAL(38,0))")


def refresh_time_index(index: DataFrame, tail: DataFrame) -> DataFrame:
    """Add the entries of newly arrived rows; only the tail is read again."""
    both = index.unionByName(tail)
    return both.groupBy("bucket").agg(
        F.min("first_ts").alias("first_ts"),
        F.min_by("position", _order_of(both, "first_ts", "position")).alias("position"),
    )


def _numbered(index: DataFrame, step_seconds: int) -> DataFrame:
    """Entries with their step as a running number."""
    number = step_number(TimeColumn.of(index, "bucket"), step_seconds)
    return index.select(number.alias("step"), "first_ts", "position")


def step_number(time: TimeColumn, step_seconds: int) -> Column:
    seconds = f"({times.unix_seconds(time.sql, time.ntz)} + {times.YEAR_ONE_SECONDS}L)"
    return F.expr(times.floor_div(seconds, step_seconds))


def _around(asked: DataFrame, entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(step, own, before, after)`` of every asked step: the entry there and
    the nearest ones on either side.

    ``asked`` holds distinct steps and ``entries`` one ``(step, entry)`` a step,
    so a group has at most twice GROUP rows.  What lies outside a group comes
    from the first and last entries of the others, looked up in the same way:
    no steps are filled in, and no task orders more than one group.
    """
    nothing = F.lit(None).cast(entries.schema["entry"].dataType)
    both = asked.select("step", nothing.alias("entry"), F.lit(True).alias("asked"))
    both = both.union(entries.select("step", "entry", F.lit(False)))
    both = both.groupBy("step").agg(
        F.first("entry", ignorenulls=True).alias("own"), F.max("asked").alias("asked")
    )
    # the ends of all groups of groups are one group at last
    size = GROUP if depth > 1 else 1 << 62
    both = both.withColumn("group", F.expr(times.floor_div("step", size)))
    rows = Window.partitionBy("group")
    earlier = rows.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    later = rows.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.select(
        "*",
        F.last("own", ignorenulls=True).over(earlier).alias("before"),
        F.last("own", ignorenulls=True).over(later).alias("after"),
    ).where("asked")
    if depth == 1:
        return near.select("step", "own", "before", "after")
    group = F.expr(times.floor_div("step", GROUP)).alias("step")
    ends = entries.groupBy(group).agg(
        F.struct(
            F.min_by("entry", "step").alias("head"), F.max_by("entry", "step").alias("tail")
        ).alias("entry")
    )
    beyond = _around(asked.select(group).distinct(), ends, depth - 1).select(
        F.col("step").alias("group"),
        F.col("before.tail").alias("_tail"),
        F.col("after.head").alias("_head"),
    )
    return near.join(beyond, "group").select(
        "step",
        "own",
        F.coalesce("before", "_tail").alias("before"),
        F.coalesce("after", "_head").alias("after"),
    )


def _lookup(
    requests: DataFrame, index: DataFrame, ts: str, step_seconds: int
) -> DataFrame:
    """Requests with the entries around their step."""
    at = step_number(TimeColumn.of(requests, ts), step_seconds)
    requests = requests.withColumn("_step", at)
    entries = _numbered(index, step_seconds).select(
        "step", F.struct("first_ts", "position").alias("entry")
    )
    asked = requests.where("_step IS NOT NULL").select(F.col("_step").alias("step")).distinct()
    around = _around(asked, entries).select(
        F.col("step").alias("_at"),
        F.col("own.first_ts").alias("_first_ts"),
        F.col("own.position").alias("_own"),
        F.col("before.position").alias("_before"),
        F.col("after.position").alias("_after"),
    )
    return requests.join(around, F.col("_step") == F.col("_at"), "left")


def start_positions(
    requests: DataFrame, index: DataFrame, ts: str, step_seconds: int
) -> DataFrame:
    """Add ``position``: the last entry at or before ``ts``, 0 without one."""
    found = _lookup(requests, index, ts, step_seconds)
    own = F.col("_first_ts") <= F.col(ts)
    position = F.when(own, F.col("_own")).otherwise(F.col("_before"))
    return found.select(
        *requests.columns,
        F.coalesce(position, F.lit(0)).cast("bigint").alias("position"),
    )


def end_positions(
    requests: DataFrame, index: DataFrame, ts: str, step_seconds: int
) -> DataFrame:
    """Add ``position``: the first entry after ``ts`` or exactly at the start
    of its step; NULL without one."""
    asked = F.col(ts)
    found = _lookup(requests, index, ts, step_seconds)
    ntz = TimeColumn.of(requests, ts).ntz
    since = f"{times.unix_micros('_first_ts', ntz)} + {times.YEAR_ONE_SECONDS}000000L"
    into_step = F.expr(f"pmod({since}, {step_seconds}000000L)")
    own = (F.col("_first_ts") > asked) | (into_step == 0)
    position = F.when(own, F.col("_own")).otherwise(F.col("_after"))
    return found.select(*requests.columns, position.cast("bigint").alias("position"))

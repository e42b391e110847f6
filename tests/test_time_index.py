import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidelog.operators import time_index as ti

HOUR = 3_600
YEAR_ONE = datetime(1, 1, 1)


def truncated(at: datetime, step: int) -> datetime:
    return YEAR_ONE + (at - YEAR_ONE) // timedelta(seconds=step) * timedelta(seconds=step)


def walk(rows, step):
    """Entries of a sequential walk over a sorted log."""
    entries, last = [], None
    for at, position in rows:
        if last is None or truncated(at, step) != truncated(last, step):
            entries.append((at, position))
            last = at
    return entries


def start_by_hand(entries, at):
    return max([p for ts, p in entries if ts <= at], default=0)


def end_by_hand(entries, at, step):
    for ts, position in entries:
        if ts == truncated(at, step) or ts > at:
            return position
    return None


def sorted_log(seed: int, n: int, mean_gap: float):
    rng = random.Random(seed)
    at, rows = datetime(1969, 12, 30), []
    for i in range(n):
        gap = rng.choice([0, 0, rng.expovariate(1 / mean_gap)])
        at += timedelta(seconds=int(gap * 10) / 10)
        if rng.random() < 0.2:
            at = truncated(at, HOUR) + timedelta(hours=1)  # exactly on a step
        rows.append((at, 100 + i * 7))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "t timestamp_ntz, pos long")


@pytest.mark.parametrize(
    ("seed", "mean_gap", "step", "group"),
    [
        (1, 600.0, HOUR, 3),
        (2, 20_000.0, HOUR, 3),
        (3, 500_000.0, HOUR, 4_096),
        (4, 20_000.0, 7 * HOUR, 2),
        (5, 500_000.0, 86_400, 5),
    ],
)
def test_index_and_lookups(spark, monkeypatch, seed, mean_gap, step, group):
    monkeypatch.setattr(ti, "GROUP", group)  # small groups have many borders
    rows = sorted_log(seed, 200, mean_gap)
    index = ti.time_index(frame(spark, rows), "t", "pos", step)
    entries = walk(rows, step)
    found = sorted((r.first_ts, r.position) for r in index.collect())
    assert found == entries

    rng = random.Random(seed)
    first, last = rows[0][0], rows[-1][0]
    asked = [first - timedelta(days=40), last + timedelta(days=40), first, last]
    asked += [at for at, _ in entries[:20]]
    asked += [truncated(at, step) for at, _ in entries[:20]]
    asked += [first + (last - first) * rng.random() for _ in range(60)]
    requests = spark.createDataFrame(list(enumerate(asked)), "id int, at timestamp_ntz")
    starts = ti.start_positions(requests, index, "at", step)
    assert {r.id: r.position for r in starts.collect()} == {
        i: start_by_hand(entries, at) for i, at in enumerate(asked)
    }
    ends = ti.end_positions(requests, index, "at", step)
    assert {r.id: r.position for r in ends.collect()} == {
        i: end_by_hand(entries, at, step) for i, at in enumerate(asked)
    }


def test_refresh_reads_only_the_tail(spark):
    rows = sorted_log(4, 300, 900.0)
    whole = ti.time_index(frame(spark, rows), "t", "pos", HOUR)
    stored = ti.time_index(frame(spark, rows[:170]), "t", "pos", HOUR)
    tail = ti.time_index(frame(spark, rows[170:]), "t", "pos", HOUR)
    both = ti.refresh_time_index(stored, tail)
    assert sorted(both.collect()) == sorted(whole.collect())


def test_order_of_the_input_does_not_matter(spark):
    rows = sorted_log(5, 200, 900.0)
    mixed = frame(spark, rows).orderBy(F.rand(1))
    index = ti.time_index(mixed, "t", "pos", HOUR)
    assert sorted((r.first_ts, r.position) for r in index.collect()) == walk(rows, HOUR)


def test_empty_index(spark):
    empty = ti.time_index(frame(spark, []), "t", "pos", HOUR)
    requests = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, at timestamp_ntz")
    assert ti.start_positions(requests, empty, "at", HOUR).first().position == 0
    assert ti.end_positions(requests, empty, "at", HOUR).first().position is None


def test_columns_of_the_requests_may_have_any_name(spark):
    rows = sorted_log(6, 50, 900.0)
    index = ti.time_index(frame(spark, rows), "t", "pos", HOUR)
    requests = spark.createDataFrame(
        [(rows[-1][0], 1, 2, 3)], "first_ts timestamp_ntz, step int, own int, after int"
    )
    found = ti.start_positions(requests, index, "first_ts", HOUR)
    assert found.columns == ["first_ts", "step", "own", "after", "position"]
    assert found.first().position == walk(rows, HOUR)[-1][1]


def test_rows_without_a_time_are_left_out(spark):
    rows = [(None, 0), (datetime(2024, 1, 1), 5)]
    index = ti.time_index(frame(spark, rows), "t", "pos", HOUR)
    assert [r.position for r in index.collect()] == [5]


def test_instants_are_truncated_in_utc(spark, in_new_york):
    df = spark.sql("SELECT TIMESTAMP'2024-01-03 01:30:00+00:00' AS t, 1L AS pos")
    index = ti.time_index(df, "t", "pos", 86_400)
    bucket = index.select(F.unix_seconds("bucket")).first()[0]
    assert bucket == 1_704_240_000


def test_first_row_of_a_step_gives_time_and_position(spark):
    rows = [("2024-01-01 00:05:00", 10), ("2024-01-01 00:50:00", 1), ("2024-01-01 00:05:00", 12)]
    df = spark.createDataFrame(rows, "t string, position long").selectExpr("to_timestamp(t) AS ts", "position")
    index = ti.time_index(df, "ts", "position", 3600)
    assert [r.position for r in index.collect()] == [10]
    later = ti.time_index(df.where("position = 1"), "ts", "position", 3600)
    assert [r.position for r in ti.refresh_time_index(later, index).collect()] == [10]
    assert "SortAggregate" not in plan_of(index)

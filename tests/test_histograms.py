from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog import log_index, search
from tidelog.functions.intervals import columnar_interval, document_interval
from tidelog.functions.times import TimeColumn, parse_instant
from tidelog.operators import histogram as hist
from tidelog.operators import merge

START = datetime(2024, 3, 1, 0, 0, tzinfo=timezone.utc)
OFFSETS = [0, 1, 59, 60, 61, 3_599, 3_600, 86_399, 86_400, 200_000, 300_000.5, 400_000]


def ms(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))


@pytest.fixture(params=["timestamp", "timestamp_ntz"])
def rows(spark, request):
    zone = "+00:00" if request.param == "timestamp" else ""
    stamps = [
        (START + timedelta(seconds=s)).replace(tzinfo=None).isoformat(sep=" ") + zone
        for s in OFFSETS
    ]
    df = spark.createDataFrame([(s,) for s in [*stamps, None]], "t string")
    return df.select(F.col("t").cast(request.param).alias("ts"))


def buckets(df):
    return {r.key: r.doc_count for r in df.collect()}


def anchored_by_hand(gte, lte, step):
    whole = int((lte - gte).total_seconds() // step)
    seen = Counter()
    for s in OFFSETS:
        at = START + timedelta(seconds=s)
        n = int((at - gte).total_seconds() // step)
        if gte <= at <= lte and 0 <= n < whole:
            seen[ms(gte + timedelta(seconds=n * step))] += 1
    return dict(seen)


@pytest.mark.parametrize("step", ["30s", "7m", "1h", "1d", "2d"])
@pytest.mark.parametrize("shift", [0, 0.25, 37])
def test_anchored_buckets(rows, step, shift):
    gte = START + timedelta(seconds=shift)
    lte = START + timedelta(seconds=350_000)
    ts = TimeColumn.of(rows, "ts")
    h = hist.anchored("h", ts, document_interval(step, None), gte, lte)
    expected = anchored_by_hand(gte, lte, h.interval.seconds)
    assert buckets(hist.date_histogram(rows, h)) == expected
    # the one-pass form counts the same and keeps the rest for the total
    kept = rows.where(ts.between(gte, lte))
    summary = hist.summarise(kept, [h])
    assert buckets(summary.where("agg IS NOT NULL")) == expected
    total = sum(START + timedelta(seconds=s) >= gte for s in OFFSETS[:-1])
    assert summary.where("agg IS NULL").first().doc_count == total


def test_anchored_range_shorter_than_one_bucket(rows):
    ts = TimeColumn.of(rows, "ts")
    h = hist.anchored("h", ts, document_interval("1d", None), START, START + timedelta(hours=1))
    assert hist.date_histogram(rows, h).count() == 0


@pytest.mark.parametrize("bounds", [(None, None), (START, None), (None, START)])
def test_anchored_needs_both_bounds(rows, bounds):
    ts = TimeColumn.of(rows, "ts")
    with pytest.raises(ValueError):
        hist.anchored("h", ts, document_interval("1d", None), *bounds)


@pytest.mark.parametrize(
    ("calendar", "expected"),
    [
        ("1d", {"2024-03-01": 8, "2024-03-02": 1, "2024-03-03": 1, "2024-03-04": 1, "2024-03-05": 1}),
        ("1w", {"2024-02-26": 10, "2024-03-04": 2}),
        # day 19772 is 2024-02-19, and (19772 - 4) % 14 == 0
        ("2w", {"2024-02-19": 10, "2024-03-04": 2}),
        ("1M", {"2024-03-01": 12}),
        ("2M", {"2024-03-01": 12}),
        ("5M", {"2024-03-01": 12}),
        ("4M", {"2024-01-01": 12}),
        ("1y", {"2024-01-01": 12}),
        ("4y", {"2022-01-01": 12}),
    ],
)
def test_calendar_buckets(rows, in_new_york, calendar, expected):
    h = hist.Histogram("h", TimeColumn.of(rows, "ts"), columnar_interval(None, calendar))
    found = hist.date_histogram(rows, h).collect()
    assert {r.key_as_string[:10]: r.doc_count for r in found} == expected
    assert all(r.key_as_string.endswith("T00:00:00Z") for r in found)
    assert [r.key for r in found] == sorted(r.key for r in found)


def test_buckets_before_1970(spark):
    df = spark.range(1).selectExpr("TIMESTAMP_NTZ'1969-12-31 23:30:00' AS ts")
    ts = TimeColumn.of(df, "ts")
    clock = hist.date_histogram(df, hist.Histogram("h", ts, columnar_interval("1h", None)))
    assert clock.first().key == -3_600_000
    for calendar, key in (("1M", "1969-12-01"), ("1y", "1969-01-01"), ("2y", "1968-01-01"), ("2w", "1969-12-22")):
        h = hist.Histogram("h", ts, columnar_interval(None, calendar))
        assert hist.date_histogram(df, h).first().key_as_string[:10] == key


def test_total_is_zero_when_nothing_matches(spark):
    df = spark.range(0).selectExpr("TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "'a' AS m")
    index = log_index("log", df, "ts", text=["m"])
    one = {"a": {"date_histogram": {"field": "ts"}}}
    for aggs in ({}, one):
        result = search(index, {"size": 1, "aggs": aggs})
        assert tuple(result.totals.first()) == (0, 0, 0.0)
        assert result.aggs.count() == 0


def test_missing_times_count_in_the_total_only(rows):
    index = log_index("log", rows, "ts")
    request = {"aggs": {"d": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}}}
    totals = search(index, request).totals.first()
    assert (totals.total, totals.bucket_total) == (13, 12)


def test_shards_merge_to_the_direct_count(rows):
    h = hist.Histogram("h", TimeColumn.of(rows, "ts"), columnar_interval("1h", None))
    direct = buckets(hist.date_histogram(rows, h))
    for k in (1, 2, 5):
        parts = [
            hist.date_histogram(rows.where(F.pmod(F.hash("ts"), F.lit(k)) == i), h)
            for i in range(k)
        ]
        assert buckets(merge.merge_histograms(parts)) == direct
    spread = merge.shard_partials(
        hist.add_buckets(rows.repartition(4), [h]), None, "_bucket0"
    )
    assert buckets(merge.merge_histograms(hist.finish(spread, h, "_bucket0", "doc_count"))) == direct


def test_offset_of_the_request_shows_in_the_key_text(spark):
    df = spark.range(1).selectExpr("TIMESTAMP_NTZ'2024-01-01 00:30:00' AS ts", "'{}' AS raw")
    index = log_index("log", df, "ts", raw="raw")
    bounds = {"gte": "2024-01-01T02:00:00+02:00", "lte": "2024-01-01T04:00:00+02:00"}
    request = {
        "query": {"bool": {"filter": [{"range": {"datetime": bounds}}]}},
        "aggs": {"h": {"date_histogram": {"fixed_interval": "1h"}}},
    }
    row = search(index, request).aggs.first()
    assert (row.key, row.key_as_string) == (1_704_067_200_000, "2024-01-01T02:00:00+02:00")


def test_gaps_over_a_clock_change(spark):
    df = spark.createDataFrame(
        [("2024-03-29 12:00:00",), ("2024-04-01 12:00:00",)], "t string"
    ).select(F.col("t").cast("timestamp_ntz").alias("ts"))
    h = hist.Histogram(
        "h", TimeColumn.of(df, "ts"), columnar_interval(None, "1d"), zone="Europe/Kyiv"
    )
    filled = hist.fill_gaps(hist.date_histogram(df, h), h).collect()
    assert [r.doc_count for r in filled] == [1, 0, 0, 1]
    # midnight in Kyiv: 22:00 UTC in winter, 21:00 UTC in summer
    assert [r.key_as_string[11:13] for r in filled] == ["22", "22", "22", "21"]


def test_min_doc_count_is_an_extension(rows):
    index = log_index("log", rows, "ts")
    spec = {"field": "ts", "fixed_interval": "1d", "min_doc_count": 0}
    other = {"field": "ts", "fixed_interval": "1d", "min_doc_count": 2}
    request = {"aggs": {"all": {"date_histogram": spec}, "busy": {"date_histogram": other}}}
    plain = search(index, request).aggs
    assert plain.where("agg = 'busy'").count() == 5
    found = search(index, request, extensions=True).aggs
    assert found.where("agg = 'busy'").count() == 1
    assert found.where("agg = 'all'").count() == 5


def test_parse_instant_is_exact():
    assert ms(parse_instant("2024-03-01T00:00:00.001Z")) == ms(START) + 1


def test_gaps_of_seventy_years_of_seconds_are_listed_in_chunks(spark):
    times_of = spark.sql(
        "SELECT explode(array(TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'2040-01-01 00:00:00')) AS ts"
    )
    ends = times_of.selectExpr("unix_millis(min(CAST(ts AS TIMESTAMP))) AS lo", "unix_millis(max(CAST(ts AS TIMESTAMP))) AS hi")
    row = hist._instants(ends, 1).agg(F.count("*"), F.max("at")).first()
    assert tuple(row) == (2_208_988_800 + 1, 2_208_988_800_000)


def test_zoned_hours_on_days_of_clock_changes(spark):
    rows = spark.sql(
        "SELECT explode(sequence(TIMESTAMP_NTZ'2024-10-26 22:15:00', TIMESTAMP_NTZ'2024-10-27 03:45:00', "
        "INTERVAL 30 MINUTES)) AS ts"
    )
    hour = 3_600_000
    zoned = lambda interval: hist.Histogram(
        "h", TimeColumn.of(rows, "ts"), interval, zone="Europe/Kyiv"
    )
    h = zoned(columnar_interval("1h", None))
    found = [(r.key, r.doc_count) for r in hist.date_histogram(rows, h).collect()]
    first = 1_729_980_000_000  # 2024-10-26T22:00:00Z
    assert found == [(first + i * hour, 2) for i in range(6)]
    thin = rows.where("ts < '2024-10-26 22:30:00' OR ts > '2024-10-27 03:30:00'")
    h = zoned(columnar_interval("1h", None))
    filled = [(r.key, r.doc_count) for r in hist.fill_gaps(hist.date_histogram(thin, h), h).collect()]
    assert filled == [(first + i * hour, 1 if i in (0, 5) else 0) for i in range(6)]
    h = zoned(columnar_interval("2h", None))
    found = [(r.key, r.doc_count) for r in hist.date_histogram(rows, h).collect()]
    # 02:00 to 04:00 by the clock is three hours long
    assert found == [(first - hour, 2), (first + hour, 6), (first + 4 * hour, 4)]

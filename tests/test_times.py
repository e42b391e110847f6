from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.functions import times

UTC = timezone.utc


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("1970-01-01T00:00:00Z", 0),
        ("1970-01-01T02:00:00+02:00", 0),
        ("1969-12-31T23:00:00-01:00", 0),
        ("1970-01-01T00:00:00.5Z", 500_000),
        ("1970-01-01T00:00:00,25Z", 250_000),
        ("1970-01-01T00:00:00.123456789Z", 123_456),
        ("1970-01-01T00:00:00.1234567891234Z", 123_456),
        ("1969-12-31T23:59:58.5Z", -1_500_000),
        ("1970-01-01", None),
        ("1970-01-01T00:00:00", None),
        ("1970-01-01 00:00:00Z", None),
        ("1970-01-01T00:00:00z", None),
        ("1970-13-01T00:00:00Z", None),
        ("1970-01-01T25:00:00Z", None),
        ("5", None),
        ("", None),
        (None, None),
    ],
)
def test_rfc3339_text(spark, text, micros):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(F.unix_micros(times.parse_rfc3339(F.col("t")))).first()[0]
    assert found == micros


NTZ_CASES = [
    ("1970-01-01 00:00:00", 0),
    ("1969-12-31 23:59:58.5", -1_500_000),
    ("2024-03-10 02:30:00.000001", 1_710_037_800_000_001),  # no such hour in New York
    ("2024-11-03 01:30:00", 1_730_597_400_000_000),
    ("0001-01-01 00:00:00", -62_135_596_800_000_000),
    ("9999-12-31 23:59:59.999999", 253_402_300_799_999_999),
]


@pytest.mark.parametrize(("text", "micros"), NTZ_CASES)
def test_wall_time_does_not_depend_on_the_session_zone(spark, in_new_york, text, micros):
    df = spark.range(1).selectExpr(f"TIMESTAMP_NTZ'{text}' AS t")
    found = df.selectExpr(
        f"{times.unix_micros('t', True)} AS us",
        f"{times.unix_millis('t', True)} AS ms",
        f"{times.unix_seconds('t', True)} AS s",
        f"{times.utc_wall_time(times.unix_micros('t', True))} = t AS same",
        f"CAST({times.utc_date('t', True)} AS STRING) AS day",
        f"{times.format_rfc3339(times.unix_millis('t', True))} AS text",
    ).first()
    assert found.us == micros
    assert found.ms == micros // 1_000
    assert found.s == micros // 1_000_000
    assert found.same
    assert found.day == text[:10]
    assert found.text == text[:19].replace(" ", "T") + "Z"


def test_instants_in_another_session_zone(spark, in_new_york):
    df = spark.range(1).selectExpr("TIMESTAMP'2024-01-01 01:00:00+00:00' AS t")
    found = df.selectExpr(
        f"CAST({times.utc_date('t', False)} AS STRING) AS day",
        f"{times.format_rfc3339(times.unix_millis('t', False), 330)} AS text",
        f"{times.format_rfc3339_fraction('t', False, 3)} AS millis",
    ).first()
    assert found.day == "2024-01-01"
    assert found.text == "2024-01-01T06:30:00+05:30"
    assert found.millis == "2024-01-01T01:00:00.000Z"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bounds_keep_rows_in_any_session_zone(spark, in_new_york, kind):
    zone = "+00:00" if kind == "timestamp" else ""
    df = spark.range(1).selectExpr(
        f"explode(array({kind}'2024-01-01 00:00:00{zone}', "
        f"{kind}'2024-01-01 00:00:00.5{zone}', {kind}'2024-01-02 00:00:00{zone}', "
        f"CAST(NULL AS {kind}))) AS t"
    )
    ts = times.TimeColumn.of(df, "t")
    gte = times.parse_instant("2024-01-01T02:00:00.5+02:00")
    assert df.where(ts.between(gte, None)).count() == 2
    assert df.where(ts.between(None, gte)).count() == 2
    assert df.where(ts.between(None, gte, missing_is_first=True)).count() == 3
    assert df.where(~ts.between(gte, None)).count() == 2
    assert df.where(ts.between(None, None)).count() == 4


def test_request_bounds():
    at = datetime(2024, 1, 1, tzinfo=UTC)
    assert times.parse_instant("2024-01-01T02:00:00+02:00") == at
    assert times.parse_instant(datetime(2024, 1, 1)) == at
    assert times.parse_instant("0001-01-01T00:00:00Z") is None
    assert times.parse_instant(None) is None
    with pytest.raises(ValueError):
        times.parse_instant("2024-01-01")
    assert times.utc_offset_minutes("2024-01-01T02:00:00-02:30") == -150


def test_time_column_must_be_a_timestamp(spark):
    with pytest.raises(ValueError):
        times.TimeColumn.of(spark.range(1), "id")


@pytest.mark.parametrize("value", [-11, -10, -1, 0, 9, 10, 11])
def test_division_rounds_down(spark, value):
    df = spark.range(1).selectExpr(f"{value}L AS v")
    assert df.selectExpr(times.floor_div("v", 10)).first()[0] == value // 10

import json

import pytest
from pyspark.sql import functions as F

from tidelog import apply_schema, read_json_lines
from tidelog.functions.documents import (
    field_as,
    has_field,
    key_path,
    parse_documents,
    string_field_equals,
)
from tidelog.sources.readers import declared_fields, parse_declared, row_documents

LINES = {
    "normal": '{"datetime":"2024-01-01T00:00:00Z","message":"a b"}',
    "offset": '{"datetime":"2024-01-01T02:00:00+02:00","message":"50% off"}',
    "nanos": '{"datetime":"2024-01-01T00:00:00.123456789Z","message":"x"}',
    "date only": '{"datetime":"2024-01-01","message":"x"}',
    "number time": '{"datetime":5,"message":"n"}',
    "no time": '{"message":"nots"}',
    "number message": '{"datetime":"2024-01-01T00:00:01Z","message":7}',
    "no message": '{"datetime":"2024-01-01T00:00:02Z"}',
    "repeated": '{"datetime":"2024-01-01T00:00:03Z","message":"a","message":"b"}',
    "bad": "{bad",
    "empty": "",
    "array": "[1]",
    "null": "null",
    "trailing": '{"datetime":"2024-01-01T00:00:00Z"} x',
    "two": '{"a":1}{"b":2}',
    "comma": '{"a":1},7',
    "bracket": '{"a":1}] x',
    "single quotes": "{'a':1}",
}
GOOD = {
    "normal",
    "offset",
    "nanos",
    "date only",
    "number time",
    "no time",
    "number message",
    "no message",
    "repeated",
}


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "log.json")
    with open(path, "w") as out:
        out.write("\n".join(LINES.values()) + "\n")
    return read_json_lines(spark, path, "datetime")


def named(df):
    by_line = {line: name for name, line in LINES.items()}
    return {by_line[row.raw] for row in df.select("raw").collect()}


def test_every_line_is_kept_and_bad_ones_have_no_document(lines):
    assert named(lines) == set(LINES)
    assert named(lines.where("doc IS NOT NULL")) == GOOD


def test_times(lines):
    found = {
        r.raw: r.us for r in lines.select("raw", F.unix_micros("ts").alias("us")).collect()
    }
    start = 1_704_067_200_000_000
    expected = {
        "normal": start,
        "offset": start,
        "nanos": start + 123_456,
        "number message": start + 1_000_000,
        "no message": start + 2_000_000,
        "repeated": start + 3_000_000,
    }
    assert found == {line: expected.get(name) for name, line in LINES.items()}


def test_last_repeated_value_wins_and_only_strings_match(lines):
    doc = F.col("doc")
    assert named(lines.where(string_field_equals(doc, "message", "b"))) == {"repeated"}
    assert named(lines.where(string_field_equals(doc, "message", "a"))) == set()
    assert named(lines.where(string_field_equals(doc, "message", "7"))) == set()
    kept = named(lines.where(~string_field_equals(doc, "message", "b")))
    assert kept == set(LINES) - {"repeated"}


def test_presence(spark):
    df = spark.createDataFrame([('{"a":null,"b.c":"d"}',)], "raw string")
    doc = F.col("doc")
    found = parse_documents(df, "raw").select(
        has_field(doc, "a"), has_field(doc, "b"), field_as(doc, "b.c", "string")
    )
    assert tuple(found.first()) == (True, False, "d")


def test_key_paths():
    assert key_path("it's") == '$["it\'s"]'
    with pytest.raises(ValueError):
        key_path("'\"")


def test_declared_schema(lines):
    fields = {
        "datetime": {"type": "date", "searchable": True, "aggregatable": True},
        "message": {"type": "text", "searchable": True},
        "n": {"type": "integer"},
    }
    typed = apply_schema(lines, fields, keep=["raw"])
    assert [(f.name, f.dataType.simpleString()) for f in typed.schema.fields] == [
        ("raw", "string"),
        ("datetime", "timestamp"),
        ("message", "string"),
        ("n", "int"),
    ]
    declared = declared_fields(typed)
    assert declared["message"].searchable and not declared["message"].aggregatable
    assert named(typed.where("message = '7'")) == {"number message"}


def test_both_ways_to_typed_columns_agree(spark, lines):
    fields = {"datetime": {"type": "date"}, "message": {"type": "text"}, "n": {"type": "long"}}
    extra = ['{"n":7}', '{"n":"8"}', '{"n":null}', '{"n":[1]}', '{"n":9007199254740993}']
    more = spark.createDataFrame([(line,) for line in extra], "raw string")
    raw = lines.select("raw").unionByName(more)
    direct = parse_declared(raw, "raw", fields, keep=["raw"])
    through = apply_schema(parse_documents(raw, "raw"), fields, keep=["raw"])
    assert direct.schema == through.schema
    assert sorted(direct.collect(), key=str) == sorted(through.collect(), key=str)


def test_rows_become_documents(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t")
    assert json.loads(row_documents(df).first()[0])["b"] == "x"


def test_a_line_is_parsed_once(lines):
    from tests.conftest import plan_of

    kept = lines.where("ts > TIMESTAMP'2024-01-01 00:00:00Z' AND ts IS NOT NULL")
    plan = plan_of(kept.where(F.col("raw").contains("a")).select("raw", "ts"))
    assert plan.count("parseJson") == 1, plan

"""Measured health, requests on a stream, and candidates by trigrams."""

import gzip
import json
import os
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from registered.documents import result_document
from registered.requests import KEY_LOG, key_requests
from tests.conftest import plan_of
from tidelog import FileIndex, indexed_lines, json_lines_index, log_index, match_new_files, match_totals, read_matches
from tidelog import parse_declared, search_many, search_observed
from tidelog.operators import many_requests as many

FIELDS = {"t": {"type": "date"}, "kind": {"type": "keyword"}, "n": {"type": "long"}}


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as out:
        out.writelines(line + "\n" for line in lines)


def line(n, kind="a", day=1):
    return json.dumps({"t": f"2024-01-{day:02d}T00:00:{n % 60:02d}Z", "kind": kind, "n": n})


REQUEST = {
    "query": {"bool": {"must": [{"match_phrase": {"kind": "a"}}]}},
    "size": 3,
    "sort": [{"t": {"order": "desc"}}],
}


def test_health_is_measured(spark, tmp_path):
    write(tmp_path / "good", "a", [line(i) for i in range(10)])
    write(tmp_path / "bad", "a", [line(50), "{broken", "", '{"kind": "a", "n": 3}', "[1]"])
    os.makedirs(tmp_path / "torn")
    packed = gzip.compress("\n".join(line(i) for i in range(5_000)).encode())
    (tmp_path / "torn" / "x.gz").write_bytes(packed[: len(packed) // 2])
    sources = {
        name: lambda name=name: json_lines_index(spark, name, str(tmp_path / name), "t")
        for name in ("good", "bad", "torn", "gone")
    }
    found = search_observed(spark, sources, REQUEST)
    rows = {r.name: r for r in found.source_health.collect()}
    counts = {n: (r.successful, r.failed, r.n_rows, r.n_malformed, r.n_untimed) for n, r in rows.items()}
    assert counts["good"] == (1, 0, 10, 0, 0)
    assert counts["bad"] == (1, 0, 5, 3, 4)
    assert counts["torn"] == counts["gone"] == (0, 1, None, None, None)
    assert "PATH_NOT_FOUND" in rows["gone"].error and rows["torn"].error
    assert tuple(found.health.first()) == (4, 2, 0, 2, False)
    plain = search_many([sources["good"](), sources["bad"]()], REQUEST)
    assert [r.sort for r in found.hits.collect()] == [r.sort for r in plain.hits.collect()]
    assert found.totals.first().total == plain.totals.first().total == 12
    document = found.to_document()
    assert document["_shards"] == {"total": 4, "successful": 2, "skipped": 0, "failed": 2}


def test_sources_without_a_matching_file_are_skipped(spark, tmp_path):
    write(tmp_path / "in", "a", [line(1)])
    files = FileIndex(str(tmp_path / "in"), str(tmp_path / "index"), "t")
    request = {"query": {"bool": {"filter": [{"range": {"datetime": {"gte": "2025-01-01T00:00:00Z"}}}]}}}
    found = search_observed(spark, {"x": lambda: indexed_lines(spark, "x", files)}, request)
    assert tuple(found.health.first()) == (1, 1, 1, 0, False)
    assert found.hits.count() == 0 and found.source_health.first().n_rows == 0


def test_no_source_answers(spark, tmp_path):
    gone = {"x": lambda: json_lines_index(spark, "x", str(tmp_path / "no"), "t")}
    with pytest.raises(PySparkException):
        search_observed(spark, gone, REQUEST)


def test_typed_tables_are_counted_too(spark):
    rows = spark.range(20).selectExpr("id", "CASE WHEN id > 4 THEN timestamp_seconds(id) END AS t", "'a' AS kind")
    index = log_index("x", rows, "t", id="id", text=["kind"])
    found = search_observed(spark, {"x": lambda: index}, REQUEST)
    row = found.source_health.first()
    assert (row.n_rows, row.n_malformed, row.n_untimed) == (20, 0, 5)


def requests_of(spark, rows):
    return spark.createDataFrame(rows, "id int, index string, q string, gte timestamp, lte timestamp")


def test_stream_tells_each_match_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "found", "state"))
    asked = requests_of(spark, [(1, "a", None, None, None), (2, "b", '"n": 1', None, None), (3, "a", "nothing", None, None)])
    log = many.LogSide(index="kind", time="t", raw="raw")

    def run():
        match_new_files(spark, source, asked, target, state, FIELDS, log, max_files=1).awaitTermination()
        return sorted((r.id, r.n) for r in read_matches(spark, target).collect())

    write(source, "one", [line(1), line(2, "b"), line(11, "b"), "{broken"])
    assert run() == [(1, 1), (2, 11)]
    write(source, "two", [line(12, "b"), line(3)])
    want = [(1, 1), (1, 3), (2, 11), (2, 12)]
    assert run() == want
    # as after a failure before the last batch was committed
    last = max(int(f) for f in os.listdir(f"{state}/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    assert run() == want
    lines = spark.read.text(source).select(F.col("value").alias("raw"))
    whole = many.match_requests(parse_declared(lines, "raw", FIELDS, keep=["raw"]), asked, log)
    assert sorted((r.id, r.n) for r in whole.collect()) == want


def test_stream_stores_a_line_once_for_requests_that_ask_the_same(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "found", "state"))
    rows = [(i, "a", None, None, None) for i in range(200)] + [(i, "b", '"n": 1', None, None) for i in range(150, 170)]
    rows += [(7, "a", None, None, None), (None, "a", None, None, None), (None, "b", "nothing", None, None)]
    asked, log = requests_of(spark, rows), many.LogSide(index="kind", time="t", raw="raw")
    for name, numbers in (("one", range(10, 30)), ("two", range(30, 50))):
        write(source, name, [line(n, kind) for n in numbers for kind in "ab"])
        match_new_files(spark, source, asked, target, state, FIELDS, log).awaitTermination()
    # 40 + 10 lines, and in each of two folders the 202 requests of one condition, the 20 of another once
    assert spark.read.option("mergeSchema", "true").parquet(f"{target}/batch=*").count() == 50 + 2 * 202 + 20

    lines = spark.read.text(source).select(F.col("value").alias("raw"))
    whole = many.match_requests(parse_declared(lines, "raw", FIELDS, keep=["raw"]), asked, log)
    want = Counter((r.id, r.kind, r.n, r.raw) for r in whole.collect())
    found = read_matches(spark, target)
    assert found.columns == [*whole.columns, "batch"]
    assert Counter((r.id, r.kind, r.n, r.raw) for r in found.collect()) == want
    totals = whole.groupBy("id").agg(F.count("*").alias("n"), F.sum("n").alias("sum_n"))
    assert Counter(map(tuple, match_totals(spark, target, "n").collect())) == Counter(map(tuple, totals.collect()))


def test_matches_stored_as_pairs_are_still_read(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "found", "state"))
    asked, log = requests_of(spark, [(i, "a", None, None, None) for i in range(3)]), many.LogSide(index="kind", time="t")
    write(tmp_path / "before", "zero", [line(5), line(6)])
    lines = spark.read.text(str(tmp_path / "before")).select(F.col("value").alias("raw"))
    pairs = many.match_requests(parse_declared(lines, "raw", FIELDS, keep=["raw"]), asked, log)
    pairs.write.parquet(f"{target}/batch=7")
    want = [(i, n) for i in range(3) for n in (5, 6)]
    assert sorted((r.id, r.n) for r in read_matches(spark, target).collect()) == want
    assert sorted(map(tuple, match_totals(spark, target, "n").collect())) == [(i, 2, 11) for i in range(3)]
    write(source, "one", [line(9), line(8, "b")])
    match_new_files(spark, source, asked, target, state, FIELDS, log).awaitTermination()
    assert sorted((r.id, r.n) for r in read_matches(spark, target).collect()) == sorted(want + [(i, 9) for i in range(3)])
    assert sorted(map(tuple, match_totals(spark, target, "n").collect())) == [(i, 3, 20) for i in range(3)]


def test_requests_without_any_text_or_end(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "found", "state"))
    asked = spark.range(3).selectExpr("id", "'a' AS index", "NULL AS q", "timestamp_seconds(id) AS gte", "NULL AS lte")
    write(source, "one", [line(1), line(2, "b")])
    log = many.LogSide(index="kind", time="t")
    match_new_files(spark, source, asked, target, state, FIELDS, log).awaitTermination()
    assert sorted((r.id, r.n) for r in read_matches(spark, target).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_a_batch_whose_requests_are_not_written_tells_nothing_yet(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "found", "state"))
    asked, log = requests_of(spark, [(1, "a", None, None, None)]), many.LogSide(index="kind", time="t")
    write(source, "one", [line(1)])
    match_new_files(spark, source, asked, target, state, FIELDS, log).awaitTermination()
    stored = spark.read.option("mergeSchema", "true").parquet(f"{target}/batch=0")
    half = str(tmp_path / "half")
    stored.where("_part = 'line'").write.parquet(f"{half}/batch=0")
    assert read_matches(spark, target).count() == 1
    assert read_matches(spark, half).count() == match_totals(spark, half, "n").count() == 0


def test_trigrams_cut_the_rows_tested(spark, folder):
    lines, asked = key_requests(spark, folder)
    profile = many.profile_requests(asked)
    texts = many._by_bucket(asked).where("length(_q) >= 3").select(*many._KEYS, "_q").distinct()
    side = many._with_buckets(lines, KEY_LOG, profile.levels)
    plain = many.bucket_candidates(side, texts, KEY_LOG).count()
    cut = many.trigram_candidates(side, texts, KEY_LOG).count()
    assert 10 * cut <= plain


def test_trigram_candidates_lose_nothing(spark):
    rows = spark.range(400).selectExpr(
        "id", "element_at(array('a', 'b'), CAST(id % 2 + 1 AS int)) AS _index",
        "timestamp_seconds(id * 5000) AS ts", "concat('häß-', id % 37, ' 日本', id % 5, ' x') AS raw",
    )
    texts = [None, "", "x", "-1", "ß-3", "日本4", "häß-36 日本", "not there", "ß-12 ", "🙂🙂🙂"]
    asked = requests_of(spark, [(10 * i + j, index, q, None, None) for i, q in enumerate(texts) for j, index in enumerate("ab")])
    bounds = F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.col("id") * 3_000))
    asked = asked.withColumn("gte", bounds)
    pairs = [
        sorted((r.id, r.line) for r in many.match_requests(rows.withColumnRenamed("id", "line"), asked, by_trigrams=by).select("id", "line").collect())
        for by in (False, True)
    ]
    assert pairs[0] and pairs[0] == pairs[1]


def test_a_result_document_scans_twice(spark, folder):
    df = result_document(spark, folder)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "events" in plan_of(df)
    assert plan.count("FileScan parquet") == 2

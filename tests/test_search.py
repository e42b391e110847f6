import json

import pytest
from pyspark.sql import functions as F

from tidelog import (
    json_lines_index,
    log_index,
    open_index,
    search,
    search_many,
    time_table_index,
    union_sources,
    write_time_table,
)
from tests.conftest import plan_of
from tidelog.operators import merge
from tidelog.operators.hits import (
    project_hits,
    requested_sort_field,
    time_order,
)
from tidelog.operators.predicates import scan_filter
from tidelog.plans.dispatch import answer
from tidelog.plans.search import hit_documents
from tidelog.sources.composite import combine_alike, with_shard
from tidelog.sources.readers import jdbc_options

FIELDS = {
    "datetime": {"type": "date", "searchable": True, "aggregatable": True},
    "message": {"type": "text", "searchable": True},
}
RANGE = {"range": {"datetime": {"gte": "2024-01-01T00:00:00Z", "lte": "2024-01-01T01:00:00Z"}}}
AGGS = {"m": {"date_histogram": {"field": "datetime", "fixed_interval": "10m"}}}
REQUEST = {"query": {"bool": {"filter": [{"match_all": {}}, RANGE]}}, "size": 3, "aggs": AGGS}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    """A log whose lines are not in time order."""
    path = str(tmp_path_factory.mktemp("log") / "test.log")
    minutes = [50, 0, 10, 5, 59, 90, 20, 10]
    with open(path, "w") as out:
        for n, minute in enumerate(minutes):
            stamp = f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"
            out.write(json.dumps({"datetime": stamp, "message": f"m{n}", "n": n}) + "\n")
        out.write("not json\n")
    return path


def config(provider):
    return {
        "version": 1,
        "provider": provider,
        "timestamp": {"field": "datetime"},
        "fields": FIELDS,
    }


def file_provider(path):
    return {"name": "jsonLogFile", "config": {"logfile": path}}


@pytest.fixture(scope="module")
def lines(spark, path):
    return open_index(spark, "example", config(file_provider(path)))[0]


@pytest.fixture(scope="module")
def typed(spark, lines):
    df = lines.df.where("ts IS NOT NULL").select(
        F.col("ts").alias("datetime"),
        F.try_variant_get("doc", "$.message", "string").alias("message"),
        F.try_variant_get("doc", "$.n", "int").alias("n"),
    )
    return log_index("typed", df, "datetime", fields=FIELDS, id="n")


def messages(result, source="_source"):
    return [
        json.loads(r[0])["message"]
        for r in result.hits.select(F.to_json(F.col(source))).collect()
    ]


def test_document_search(lines):
    found = search(lines, REQUEST).to_document()
    assert set(found) == {"took", "timed_out", "_shards", "hits", "aggregations"}
    assert found["_shards"] == {"total": 1, "successful": 1, "skipped": 0, "failed": 0}
    assert found["timed_out"] is False
    hits = found["hits"]
    assert hits["total"] == {"value": 7, "relation": "eq"}
    assert hits["max_score"] == 0.0
    assert [h["_source"]["message"] for h in hits["hits"]] == ["m1", "m3", "m2"]
    assert hits["hits"][0]["_index"] == "example"
    assert hits["hits"][0]["sort"] == [1_704_067_200]
    start = 1_704_067_200_000
    assert [(b["key"], b["doc_count"]) for b in found["aggregations"]["m"]["buckets"]] == [
        (start, 2),
        (start + 600_000, 2),
        (start + 1_200_000, 1),
        (start + 3_000_000, 2),
    ]
    assert found["aggregations"]["m"]["buckets"][0]["key_as_string"] == "2024-01-01T00:00:00Z"


def test_ids_are_stable_unless_random_ones_are_asked_for(lines):
    first = [r._id for r in search(lines, REQUEST).hits.collect()]
    again = [r._id for r in search(lines, REQUEST).hits.collect()]
    assert first == again and len(set(first)) == 3 and len(first[0]) == 64
    one, two = (project_hits(lines, lines.df, with_uuid=True).collect() for _ in "ab")
    assert {r._id for r in one}.isdisjoint({r._id for r in two})


@pytest.mark.parametrize(("size", "n"), [(0, 0), (1, 1), (3, 3), (100, 7), (None, 7)])
def test_size_is_exact(lines, typed, size, n):
    for index in (lines, typed):
        assert search(index, {**REQUEST, "size": size}).hits.count() == n


def test_result_document_of_any_size_is_written(typed, tmp_path):
    result = search(typed, {**REQUEST, "size": None})
    assert len(result.to_document()["hits"]["hits"]) == 7
    result.write_document(str(tmp_path / "out"))
    rows = typed.df.sparkSession.read.text(str(tmp_path / "out")).collect()
    parts = {}
    for row in rows:
        parts.setdefault(row.part, []).append(json.loads(row.value))
    assert len(parts["hits"]) == 7 and parts["totals"][0]["total"] == 7
    assert parts["_shards"][0]["successful"] == 1
    assert sum(b["doc_count"] for b in parts["aggregations"]) == parts["totals"][0]["bucket_total"]


def test_time_table_answers_like_its_plain_table(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", f"m{i % 4}") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, t string, message string")
    df = df.selectExpr("id", "to_timestamp_ntz(t) AS ts", "message")
    df = df.unionByName(spark.sql("SELECT 900L AS id, CAST(NULL AS TIMESTAMP_NTZ) AS ts, 'm1' AS message"))
    write_time_table(df, str(tmp_path / "t"), "ts")
    plain = log_index("x", df, "ts", id="id", text=["message"])
    timed = time_table_index(spark, "x", str(tmp_path / "t"), "ts", id="id", text=["message"])
    some = {"range": {"datetime": {"gte": "2024-01-03T00:00:00Z", "lte": "2024-01-05T00:00:00Z"}}}
    for body in (
        {"filter": [{"multi_match": {"query": "m1"}, **some}]},
        {"must": [some], "filter": [{"match_phrase": {"message": "m1"}}]},
        {"must_not": [some]},
        {"filter": [{"bool": {"filter": [some], "must_not": {"multi_match": {"query": "m1"}}}}]},
    ):
        request = {"query": {"bool": body}, "size": 200}
        wanted, found = (
            [r._id for r in search(each, request).hits.collect()] for each in (plain, timed)
        )
        assert found == wanted and wanted
    test = scan_filter(timed, {"bool": {"must": [some]}})
    assert "PartitionFilters: [isnotnull(dt" in plan_of(timed.df.where(test))


def test_search_many_sorts_like_search(typed):
    for sort in ([{"n": {"order": "desc"}}], [{"message": {}}], [{"datetime": {"order": "desc"}}], []):
        request = {**REQUEST, "sort": sort}
        assert messages(search_many([typed], request)) == messages(search(typed, request))


def test_bucket_text_keeps_the_written_offset(typed, path):
    index = json_lines_index(typed.df.sparkSession, "raw", path, "datetime", FIELDS)
    bounds = {"gte": "2024-01-01T02:00:00+02:00", "lte": "2024-01-01T03:00:00+02:00"}
    request = {**REQUEST, "query": {"bool": {"filter": [{"range": {"datetime": bounds}}]}}}
    texts = [[r.key_as_string for r in each.aggs.collect()] for each in (search(index, request), search_many([index], request))]
    assert texts[0] == texts[1] and texts[0][0].endswith("+02:00")


def test_dotted_columns(spark):
    df = spark.sql("SELECT 1L AS `e.id`, TIMESTAMP_NTZ'2024-01-01 00:00:01' AS `e.ts`, 'abc' AS `log.message`")
    index = log_index("x", df, "e.ts", id="e.id", text=["log.message"])
    for query in ({"multi_match": {"query": "b"}}, {"match_phrase": {"log.message": "abc"}}):
        request = {"query": {"bool": {"filter": [query]}}, "size": 5, "sort": [{"log.message": {}}]}
        assert search(index, request).hits.count() == 1


def test_time_zone_is_a_name(typed):
    histogram = {"field": "datetime", "fixed_interval": "1h", "time_zone": "' || 'UTC"}
    with pytest.raises(ValueError, match="time zone"):
        search(typed, {**REQUEST, "aggs": {"h": {"date_histogram": histogram}}}, extensions=True)


def test_other_data_sources_are_refused(spark):
    provider = {"name": "clickhouse", "config": {"dsn": "clickhouse://db:9000/default", "table": "x"}}
    with pytest.raises(ValueError, match="no reader"):
        open_index(spark, "x", config(provider))


def test_hits_can_be_written(typed, tmp_path):
    search(typed, {**REQUEST, "size": None}).write_hits(str(tmp_path / "out"))
    rows = typed.df.sparkSession.read.text(str(tmp_path / "out")).collect()
    assert len(rows) == 7
    assert json.loads(rows[0].value)["_source"]["message"].startswith("m")


def test_missing_values_stay_in_written_hits(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS t, CAST(NULL AS STRING) AS m")
    search(log_index("x", df, "t"), {}).write_hits(str(tmp_path / "out"))
    row = spark.read.text(str(tmp_path / "out")).first()
    assert json.loads(row.value)["_source"]["m"] is None


def test_source_holds_every_column_of_a_typed_table(typed):
    raw = log_index("x", typed.df, "datetime", raw="message")
    row = search(raw, {"size": 1}).hits.first()
    assert set(row._source.asDict()) == {"datetime", "message", "n"}


def test_order_of_hits(typed):
    assert messages(search(typed, REQUEST)) == ["m1", "m3", "m2"]
    descending = {**REQUEST, "sort": [{"datetime": {"order": "desc"}}]}
    assert messages(search(typed, descending)) == ["m4", "m0", "m6"]
    by_field = {**REQUEST, "sort": [{"n": {"order": "desc"}}, {"nowhere": {"unmapped_type": "long"}}]}
    assert messages(search(typed, by_field)) == ["m7", "m6", "m4"]
    with pytest.raises(ValueError, match="nowhere"):
        search(typed, {**REQUEST, "sort": [{"nowhere": {}}]})
    latest = typed.df.orderBy(*time_order(typed, descending=True)).first()
    assert latest.message == "m5"


def test_docvalue_sort_field():
    request = {"docvalue_fields": [{"field": "t"}], "sort": [{"t": {"order": "desc"}}]}
    assert requested_sort_field(request) == {"order": "desc"}
    with pytest.raises(ValueError):
        requested_sort_field({"docvalue_fields": [], "sort": []})


def test_anchored_histogram_needs_bounds(lines):
    with pytest.raises(ValueError):
        search(lines, {"aggs": AGGS})


def test_search_without_bounds_keeps_bad_lines(lines):
    result = search(lines, {"size": None})
    assert result.totals.first().total == 9
    until = {"range": {"datetime": {"lte": "2024-01-01T00:00:00Z"}}}
    query = {"bool": {"filter": [until]}}
    assert search(lines, {"query": query}).totals.first().total == 2


def test_same_source_three_times(spark, path):
    provider = {"name": "aggregate", "config": {"subProviders": [file_provider(path)] * 3}}
    sources = open_index(spark, "internal", config(provider))
    result = search_many(sources, {**REQUEST, "size": 4})
    assert messages(result) == ["m1", "m1", "m1", "m3"]
    found = result.to_document()
    assert found["hits"]["total"]["value"] == 21
    assert [b["doc_count"] for b in found["aggregations"]["m"]["buckets"]] == [6, 6, 3, 6]
    assert found["_shards"]["successful"] == 3
    assert union_sources(sources).count() == 27


def test_sources_of_both_kinds_and_an_unknown_one(lines, typed):
    result = search_many([lines, typed], REQUEST, unknown=["gone"])
    assert tuple(result.health.first()) == (3, 2, 0, 1, False)
    assert result.totals.first().total == 14
    assert [r._index for r in result.hits.collect()] == ["example", "typed", "example"]
    down = search_many([lines, typed], {**REQUEST, "sort": [{"datetime": {"order": "desc"}}]})
    assert messages(down) == ["m4", "m4", "m0"]


def test_merge_equals_one_search_over_the_union(typed):
    halves = [
        typed.with_df(typed.df.where("n % 2 = 0")),
        typed.with_df(typed.df.where("n % 2 = 1")),
    ]
    whole, merged = search(typed, REQUEST), search_many(halves, REQUEST)
    assert messages(whole) == messages(merged)
    assert whole.aggs.collect() == merged.aggs.collect()
    assert whole.totals.first() == merged.totals.first()


def test_requests_go_to_their_index(spark, lines, typed):
    indexes = {"one": typed, "both": [lines, typed]}
    requests = [("a", "one", REQUEST), ("b", "both", REQUEST), ("c", "gone", REQUEST)]
    found = answer(spark, indexes, requests)
    documents = {key: result.to_document() for key, result in found.items()}
    totals = {key: d["hits"]["total"]["value"] for key, d in documents.items()}
    assert totals == {"a": 7, "b": 14, "c": 0}
    assert documents["c"]["_shards"] == {"total": 1, "successful": 0, "skipped": 0, "failed": 1}
    assert documents["c"]["hits"]["hits"] == [] and documents["c"]["aggregations"] == {}


def test_alike_sources_are_combined(lines, typed):
    other = log_index("typed", typed.df, "datetime", fields=FIELDS)
    renamed = log_index("other", typed.df, "datetime", fields=FIELDS, id="n")
    found = combine_alike([typed, lines, typed, other, typed, renamed])
    assert [(s.name, s.id) for s in found] == [
        ("typed", "n"),
        ("example", None),
        ("typed", None),
        ("other", "n"),
    ]
    assert [s.df.count() for s in found] == [24, 9, 8, 8]
    many = search_many([typed] * 40, REQUEST)
    assert many.totals.first().total == 7 * 40
    assert many.health.first().successful == 40


def test_no_sources():
    for call in (lambda: search_many([], REQUEST), lambda: union_sources([])):
        with pytest.raises(ValueError, match="no sources"):
            call()


def test_health_and_scores_merge(spark):
    columns = "total int, successful int, skipped int, failed int, timed_out boolean"
    parts = spark.createDataFrame([(1, 1, 0, 0, False), (1, 0, 0, 1, True)], columns)
    assert tuple(merge.merge_health(parts).first()) == (2, 1, 0, 1, True)
    none = spark.createDataFrame([], "_score double")
    assert merge.max_score(none).first()[0] == 0.0
    some = spark.createDataFrame([(1.5,), (0.5,)], "_score double")
    assert merge.max_score(some).first()[0] == 1.5


def test_shards_are_partitions(typed):
    spread = with_shard(typed.df.repartition(3))
    counts = spread.groupBy("_shard").count().collect()
    assert sum(r["count"] for r in counts) == 8 and len(counts) <= 3
    assert with_shard(typed.df, F.col("n")).select("_shard").distinct().count() == 8


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"version": 2}, "unsupported version"),
        ({"fields": {}}, "no fields"),
        ({"provider": {"name": "jsonLogFile", "config": {}}}, "no log file"),
        ({"provider": {"name": "aggregate", "config": {}}}, "no sources"),
        ({"provider": {"name": "clickhouse", "config": {}}}, "no table"),
        ({"provider": {"name": "webSocketServer", "config": {}}}, "partitions"),
        ({"provider": {"name": "other"}}, "unsupported provider"),
    ],
)
def test_bad_declarations(spark, change, message):
    with pytest.raises(ValueError, match=message):
        open_index(spark, "x", {**config(file_provider("p")), **change})


def test_declared_table(spark, typed, tmp_path):
    path = str(tmp_path / "table")
    typed.df.write.parquet(path)
    provider = {"name": "clickhouse", "config": {"table": path}}
    index = open_index(spark, "table", config(provider))[0]
    assert index.searchable == ["message"]
    assert search(index, REQUEST).totals.first().total == 7


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t"}
    split = jdbc_options("jdbc:x", "t", split="ts", lower="a", upper="b", partitions=8)
    assert split["partitionColumn"] == "ts" and split["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", split="ts")


def test_time_table_gives_the_same_answers(spark, typed, tmp_path):
    path = str(tmp_path / "table")
    write_time_table(typed.df, path, "datetime")
    index = time_table_index(spark, "typed", path, "datetime", fields=FIELDS, id="n")
    for request in (REQUEST, {**REQUEST, "query": None}, {**REQUEST, "size": None}):
        a, b = search(typed, request), search(index, request)
        assert messages(a) == messages(b)
        assert a.aggs.collect() == b.aggs.collect()
        assert a.totals.first() == b.totals.first()


def test_rows_without_a_time_stay_in_a_time_table(spark, tmp_path):
    df = spark.sql(
        "SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t UNION ALL SELECT 2, NULL"
    )
    write_time_table(df, str(tmp_path / "table"), "t")
    index = time_table_index(spark, "x", str(tmp_path / "table"), "t", id="id")
    assert [r._id for r in search(index, {"size": 5}).hits.collect()] == ["2", "1"]
    bounded = {"bool": {"filter": [{"range": {"datetime": {"gte": "2023-01-01T00:00:00Z"}}}]}}
    assert [r._id for r in search(index, {"size": 5, "query": bounded}).hits.collect()] == ["1"]


def test_persist_keeps_the_answer(typed):
    kept = search(typed, REQUEST, persist=True)
    assert messages(kept) == messages(search(typed, REQUEST))
    kept.unpersist()


def test_extensions_shape_the_hits(typed):
    request = {
        **REQUEST,
        "_source": {"excludes": ["n"]},
        "docvalue_fields": [{"field": "datetime", "format": "date_time"}, {"field": "n"}],
    }
    row = search(typed, request, extensions=True).hits.first()
    assert set(row._source.asDict()) == {"datetime", "message"}
    assert row.fields.asDict() == {"datetime": "2024-01-01T00:00:00.000Z", "n": 1}
    plain = search(typed, request).hits
    assert plain.columns == ["_index", "_id", "_score", "_source", "sort"]


def test_json_index_by_hand(spark, path):
    index = json_lines_index(spark, "x", path, "datetime")
    phrase = {"bool": {"must": [{"match_phrase": {"n": "3"}}]}}
    assert search(index, {"query": phrase}).totals.first().total == 0
    phrase = {"bool": {"must": [{"match_phrase": {"message": "m3"}}]}}
    assert search(index, {"query": phrase}).totals.first().total == 1


def test_requests_name_fields_of_documents(spark, tmp_path):
    rows = [
        {"@timestamp": "2024-01-01T00:00:01Z", "n": 9, "k": "b"},
        {"@timestamp": "2024-01-01T00:00:03Z", "n": 10, "k": "a", "x.y": 1},
        {"@timestamp": "2024-01-01T00:00:02Z", "n": "text"},
        {"k": "c"},
    ]
    (tmp_path / "log").write_text("".join(json.dumps(row) + "\n" for row in rows) + "no json\n")
    index = json_lines_index(spark, "x", str(tmp_path / "log"), "@timestamp", {"k": {"type": "text"}})

    def found(name, order, query=None):
        request = {"query": query, "sort": [{name: {"order": order}}]}
        return [json.loads(r[0])["_source"] for r in hit_documents(search(index, request).hits).collect()]

    assert [r and r.get("n") for r in found("n", "desc")][:3] == ["text", 10, 9]
    assert [r and r.get("k") for r in found("k", "desc")][:3] == ["c", "b", "a"]
    assert [r and r.get("n") for r in found("@timestamp", "desc")][:3] == [10, "text", 9]
    since = {"bool": {"filter": [{"range": {"@timestamp": {"gte": "2024-01-01T00:00:02Z"}}}]}}
    assert [r["n"] for r in found("@timestamp", "asc", since)] == ["text", 10]
    request = {
        "query": since,
        "_source": {"excludes": ["n", "x.y"]},
        "docvalue_fields": [{"field": "@timestamp", "format": "date_time"}, {"field": "k"}, {"field": "n"}],
    }
    hits = [json.loads(r[0]) for r in hit_documents(search(index, request, extensions=True).hits).collect()]
    assert hits[1]["_source"] == {"@timestamp": "2024-01-01T00:00:03Z", "k": "a"}
    assert hits[1]["fields"] == {"@timestamp": "2024-01-01T00:00:03.000Z", "k": "a", "n": 10}
    # search_many orders alike
    request = {"sort": [{"n": {"order": "desc"}}], "size": 2}
    once, many = (r.hits.select("_id").collect() for r in (search(index, request), search_many([index], request)))
    assert once == many

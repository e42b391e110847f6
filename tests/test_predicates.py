import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import log_index
from tidelog.operators.predicates import (
    exclude,
    like_text,
    one_filter,
    query_filter,
    request_bounds,
    scan_filter,
)

ROWS = [
    # id, second, message, level, code
    (1, "2024-01-01 00:00:00", "50% off", "info", 7),
    (2, "2024-01-01 00:00:00.5", "50 off", "warn", 7),
    (3, "2024-01-01 00:00:01", "a_b", "info", None),
    (4, "2024-01-01 00:00:02", "axb", None, 8),
    (5, None, None, "warn", 8),
    (6, "2024-01-01 00:00:03", "back\\slash", "A B", None),
]
FIELDS = {
    "message": {"type": "text", "searchable": True},
    "level": {"type": "text", "searchable": True},
    "hidden": {"type": "text", "searchable": False},
    "code": {"type": "long", "searchable": True},
}


@pytest.fixture(scope="module")
def rows(spark):
    schema = "id int, t string, message string, level string, code long"
    df = spark.createDataFrame(ROWS, schema)
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    return df.withColumn("hidden", F.lit("secret"))


@pytest.fixture(scope="module")
def columnar(rows):
    return log_index("log", rows, "ts", fields=FIELDS, id="id")


@pytest.fixture(scope="module")
def document(rows):
    return log_index("log", rows, "ts", fields=FIELDS, id="id", flavour="document")


def ids(index, test):
    return sorted(r.id for r in index.df.where(test).select("id").collect())


ALL = [1, 2, 3, 4, 5, 6]


def text(q):
    return {"multi_match": {"query": q, "type": "best_fields", "lenient": True}}


def phrase(**values):
    return {"match_phrase": values}


def span(gte=None, lte=None):
    return {"range": {"datetime": {"gte": gte, "lte": lte}}}


@pytest.mark.parametrize("spec", [None, {}, {"match_all": {}}, {"fuzzy": {}}])
def test_match_all_and_unknown_kinds(columnar, document, spec):
    for index in (columnar, document):
        assert ids(index, one_filter(index, spec)) == ALL
        assert ids(index, exclude(one_filter(index, spec))) == []


@pytest.mark.parametrize(
    ("query", "columnar_ids", "document_ids"),
    [
        ("50% off", [1, 2], [1]),
        ("a_b", [3, 4], [3]),
        ("Off", [], []),
        ("info", [1, 3], [1, 3]),
        ("secret", [], ALL),
        ('"code":7', [], [1, 2]),
        ("k\\s", [6], []),
        ("", ALL, ALL),
    ],
)
def test_text_match(columnar, document, query, columnar_ids, document_ids):
    assert ids(columnar, one_filter(columnar, text(query))) == columnar_ids
    assert ids(document, one_filter(document, text(query))) == document_ids


def test_text_match_without_wildcards(rows):
    index = log_index("log", rows, "ts", fields=FIELDS, wildcards=False)
    assert ids(index, one_filter(index, text("50% off"))) == [1]
    assert ids(index, one_filter(index, text("a_b"))) == [3]


def test_text_match_without_columns_is_no_condition(rows):
    index = log_index("log", rows, "ts")
    assert ids(index, one_filter(index, text("nothing"))) == ALL


@pytest.mark.parametrize(
    ("values", "columnar_ids", "document_ids"),
    [
        ({"level": "info"}, [1, 3], [1, 3]),
        ({"level": "info", "message": "axb"}, [1, 3, 4], []),
        ({"level": "info", "message": "a_b"}, [1, 3], [3]),
        ({"level": "inf"}, [], []),
        ({"level": "info", "nowhere": "x"}, [1, 3], []),
        ({"nowhere": "x"}, ALL, []),
        ({"code": "7"}, ALL, []),
        ({"hidden": "secret"}, ALL, ALL),
        ({}, ALL, ALL),
    ],
)
def test_phrase(columnar, document, values, columnar_ids, document_ids):
    assert ids(columnar, one_filter(columnar, phrase(**values))) == columnar_ids
    assert ids(document, one_filter(document, phrase(**values))) == document_ids


@pytest.mark.parametrize(
    ("gte", "lte", "columnar_ids", "document_ids"),
    [
        ("2024-01-01T00:00:00.7Z", "2024-01-01T00:00:02Z", [1, 2, 3, 4], [3, 4]),
        ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z", [1], [1, 2]),
        ("2024-01-01T02:00:01+02:00", None, [3, 4, 6], [3, 4, 6]),
        (None, "2024-01-01T00:00:01Z", [1, 2, 3], [1, 2, 3, 5]),
        (None, None, ALL, ALL),
    ],
)
def test_range(columnar, document, gte, lte, columnar_ids, document_ids):
    for index, expected in ((columnar, columnar_ids), (document, document_ids)):
        test = one_filter(index, span(gte, lte))
        assert ids(index, test) == expected
        assert ids(index, exclude(test)) == [i for i in ALL if i not in expected]


def test_range_of_another_field_is_no_condition(columnar):
    spec = {"range": {"code": {"gte": "2024-01-01T00:00:00Z"}}}
    assert ids(columnar, one_filter(columnar, spec)) == ALL


def test_ranges_of_any_field_are_an_extension(columnar):
    def found(spec):
        test = one_filter(columnar, {"range": spec}, extensions=True)
        kept = ids(columnar, test)
        assert ids(columnar, exclude(test)) == [i for i in ALL if i not in kept]
        return kept

    codes = {r[0]: r[4] for r in ROWS}
    assert found({"code": {"gte": 8}}) == [i for i in ALL if codes[i] is not None and codes[i] >= 8]
    assert found({"code": {"gt": 7, "lt": 9}}) == [i for i in ALL if codes[i] == 8]
    assert found({"ts": {"gt": "2024-01-01T00:00:01Z"}}) == [4, 6]
    assert found({"datetime": {"gte": "2024-01-01T00:00:01Z", "lt": "2024-01-01T00:00:02Z"}, "code": {"lt": 100}}) == [
        i for i in (3,) if codes[i] is not None
    ]
    assert found({"level": {"lte": "info"}}) == [i for i in ALL if ROWS[i - 1][3] and ROWS[i - 1][3] <= "info"]
    for wrong in ({"nowhere": {"gte": 1}}, {"code": {"above": 1}}):
        with pytest.raises(ValueError):
            one_filter(columnar, {"range": wrong}, extensions=True)


def test_range_by_the_time_columns_own_name(columnar):
    spec = {"range": {"ts": {"gte": "2024-01-01T00:00:02Z"}}}
    assert ids(columnar, one_filter(columnar, spec)) == [4, 6]


def test_bool_combines_filter_must_and_must_not(columnar):
    query = {
        "bool": {
            "filter": [span("2024-01-01T00:00:00Z", "2024-01-01T00:00:02Z")],
            "must": [text("o")],
            "must_not": [phrase(level="warn"), phrase(level="A B")],
            "should": [phrase(level="warn")],
        }
    }
    assert ids(columnar, query_filter(columnar, query)) == [1, 3]


def test_nested_bool_ignores_must_and_should(columnar):
    inner = {
        "filter": [phrase(level="warn")],
        "must": [phrase(level="info")],
        "should": [phrase(level="info")],
        "must_not": text("50"),
    }
    query = {"bool": {"filter": [{"bool": inner}]}}
    assert ids(columnar, query_filter(columnar, query)) == [5]
    as_list = {**inner, "must_not": [text("50"), text("warn")]}
    query = {"bool": {"must": [{"bool": as_list}]}}
    assert ids(columnar, query_filter(columnar, query)) == []


def test_order_of_kinds_in_one_filter(columnar):
    kinds = [
        ("bool", {"filter": [phrase(level="warn")]}, [2, 5]),
        ("multi_match", {"query": "axb"}, [4]),
        ("match_phrase", {"message": "a_b"}, [3]),
        ("match_all", {}, ALL),
        ("range", span("2024-01-01T00:00:03Z")["range"], [6]),
    ]
    for at in range(len(kinds)):
        spec = {name: value for name, value, _ in kinds[at:]}
        assert ids(columnar, one_filter(columnar, spec)) == kinds[at][2]


def test_empty_and_missing_queries(columnar):
    assert ids(columnar, query_filter(columnar, None)) == ALL
    assert ids(columnar, query_filter(columnar, {"bool": {}})) == ALL
    for query in ({}, {"multi_match": {"query": "x"}}, {"bool": None}):
        with pytest.raises(ValueError, match="unsupported query type"):
            query_filter(columnar, query)


def test_should_is_an_extension(columnar):
    query = {"bool": {"should": [phrase(level="warn"), text("axb")]}}
    assert ids(columnar, query_filter(columnar, query)) == ALL
    assert ids(columnar, query_filter(columnar, query, use_should=True)) == [2, 4, 5]
    query["bool"]["must"] = [phrase(level="info")]
    assert ids(columnar, query_filter(columnar, query, use_should=True)) == [1, 3]


def test_first_range_bounds_the_request(columnar, document):
    first, second = "2024-01-01T00:00:01Z", "2024-01-01T00:00:02Z"
    query = {"bool": {"filter": [{**text(""), **span(first)}, span(second)]}}
    gte, lte = request_bounds(columnar, query)
    assert (gte.second, lte) == (1, None)
    # the range beside the text match bounds document scans only
    only = {"bool": {"filter": [{**text("o"), **span(first)}]}}
    assert ids(document, scan_filter(document, only)) == [3, 4, 6]
    assert ids(columnar, scan_filter(columnar, only)) == [1, 2, 3]


def filters():
    leaves = st.sampled_from(
        [
            text("50"),
            text("a"),
            phrase(level="info"),
            phrase(level="warn", message="axb"),
            phrase(nowhere="x"),
            span("2024-01-01T00:00:01Z"),
            span(None, "2024-01-01T00:00:01Z"),
            {"match_all": {}},
        ]
    )
    return st.recursive(
        leaves,
        lambda inner: st.builds(
            lambda kept, gone: {"bool": {"filter": kept, "must_not": gone}},
            st.lists(inner, max_size=2),
            st.none() | inner,
        ),
        max_leaves=4,
    )


def by_hand(index, spec, row):
    """Row-at-a-time reading of the same rules."""
    if "bool" in spec:
        kept = all(by_hand(index, each, row) for each in spec["bool"]["filter"])
        gone = spec["bool"]["must_not"]
        return kept and not (gone is not None and by_hand(index, gone, row))
    if "multi_match" in spec:
        q = spec["multi_match"]["query"]
        return any(q in (row[c] or "") for c in ("message", "level"))
    if "match_phrase" in spec:
        known = {k: v for k, v in spec["match_phrase"].items() if k in ("message", "level")}
        return not known or any(row[k] == v for k, v in known.items())
    if "range" in spec:
        at = row["t"]
        bounds = spec["range"]["datetime"]
        if at is None:
            return False
        low, high = bounds["gte"], bounds["lte"]
        clean = lambda b: b.replace("T", " ").rstrip("Z")
        return (low is None or at >= clean(low)) and (high is None or at <= clean(high))
    return True


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(spec=filters())
def test_random_filters_equal_a_row_at_a_time_reading(columnar, spec):
    names = ("id", "t", "message", "level", "code")
    expected = [r[0] for r in ROWS if by_hand(columnar, spec, dict(zip(names, r)))]
    test = one_filter(columnar, spec)
    assert ids(columnar, test) == expected
    assert ids(columnar, exclude(test)) == [i for i in ALL if i not in expected]
    assert columnar.df.where(test.isNull()).count() == 0


TEXTS = st.text(alphabet="ab_%\\.*é\n", max_size=8)


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(queries=st.lists(TEXTS, min_size=20, max_size=20), texts=st.lists(TEXTS, min_size=5, max_size=30))
def test_wildcards_equal_like(spark, queries, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    pairs = []
    for query in queries:
        like = F.col("t").like("%" + query.replace("\\", "\\\\") + "%")
        pairs += [like_text(F.col("t"), query), F.coalesce(like, F.lit(False))]
    for row in df.select(*pairs).collect():
        assert row[0::2] == row[1::2]

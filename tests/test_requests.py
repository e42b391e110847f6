import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidelog.operators import many_requests as many

START = datetime(2024, 1, 1)
LOG_SCHEMA = "id int, _index string, ts timestamp_ntz, raw string"
REQUEST_SCHEMA = "id int, index string, q string, gte timestamp_ntz, lte timestamp_ntz"


def log_rows(n=400, seed=1):
    """A third of the rows is one index, one instant and one text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, "hot", START + timedelta(hours=5), "same text"))
        else:
            at = START + timedelta(seconds=rng.randrange(90 * 86_400))
            if rng.random() < 0.05:
                at = None
            rows.append((i, rng.choice(["hot", "cold"]), at, f"row {rng.randrange(50)}"))
    return rows


def request_rows(n=80, seed=2):
    rng = random.Random(seed)
    spans = [0, 1, 1_800, 3_600, 86_400, 86_401, 20 * 86_400, 2_592_000, 90 * 86_400, 5 * 31_536_000]
    rows = []
    for i in range(n):
        gte = START + timedelta(seconds=rng.randrange(-86_400, 90 * 86_400))
        lte = gte + timedelta(seconds=rng.choice(spans))
        rows.append(
            (
                i,
                rng.choice(["hot", "cold", "unknown"]),
                rng.choice([None, "row 1", "same", "nowhere", ""]),
                gte if rng.random() < 0.8 else None,
                lte if rng.random() < 0.8 else None,
            )
        )
    rows.append((n, "hot", None, START + timedelta(days=2), START))  # reversed
    rows.append((n + 1, "hot", "same", START + timedelta(hours=5), START + timedelta(hours=5)))
    return rows


def by_hand(logs, requests):
    return Counter(
        (request[0], log[0])
        for request in requests
        for log in logs
        if log[1] == request[1]
        and (request[2] is None or request[2] in log[3])
        and (request[3] is None or (log[2] is not None and log[2] >= request[3]))
        and (request[4] is None or (log[2] is not None and log[2] <= request[4]))
    )


@pytest.fixture(scope="module")
def data(spark):
    logs, requests = log_rows(), request_rows()
    return (
        spark.createDataFrame(logs, LOG_SCHEMA).withColumnRenamed("id", "row"),
        spark.createDataFrame(requests, REQUEST_SCHEMA),
        by_hand(logs, requests),
    )


SIDE = many.LogSide(index="_index", time="ts", raw="raw", id="row")
# join hints that a caller may put on the requests
HINTS = [None, "shuffle_hash", "merge"]


def hinted(requests, hint):
    return requests if hint is None else requests.hint(hint)


@pytest.mark.parametrize("hint", HINTS)
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_every_join_finds_the_same_pairs(spark, data, hint, threshold):
    logs, requests, expected = data
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = many.match_requests(logs, hinted(requests, hint), SIDE)
        assert Counter((r.id, r.row) for r in found.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hint", HINTS)
def test_counts_hits_and_histograms(data, hint):
    logs, requests, expected = data
    found = many.match_requests(logs, hinted(requests, hint), SIDE)
    per_request = Counter(i for i, _ in expected.elements())
    counts = {r.id: r.n for r in many.request_counts(found, requests).collect()}
    assert counts == {i: per_request.get(i, 0) for i in range(82)}

    times = {row[0]: row[2] for row in log_rows()}
    first = {}
    for i in per_request:
        rows = [row for j, row in expected if j == i]
        key = lambda row: (times[row] is not None, times[row] or START, row)
        first[i] = sorted(rows, key=lambda r: (key(r)[0], key(r)[1].replace(microsecond=0), r))[:3]
    hits = {}
    for r in many.request_hits(found, SIDE, 3).orderBy("id", "rank").collect():
        hits.setdefault(r.id, []).append(r.row)
    assert hits == first

    days = Counter(
        (i, int((times[row].replace(hour=0, minute=0, second=0) - datetime(1970, 1, 1)).total_seconds() * 1000))
        for i, row in expected.elements()
        if times[row] is not None
    )
    found_days = many.request_histograms(found, SIDE, 86_400).collect()
    assert {(r.id, r.key): r.doc_count for r in found_days} == dict(days)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_the_log_is_cut_to_the_range_of_all_requests(spark, in_new_york, kind):
    zone = "+00:00" if kind == "timestamp" else ""
    at = lambda text: f"{kind}'2024-01-{text}{zone}'"
    logs = spark.range(1).selectExpr(
        f"explode(array({at('01 00:00:00')}, {at('03 04:00:00')}, {at('09 00:00:00')}, "
        f"CAST(NULL AS {kind}))) AS ts",
        "'a' AS _index",
        "'x' AS raw",
    )
    bounded = spark.range(2).selectExpr(
        "id", "'a' AS index", "'x' AS q", f"{at('02 00:00:00')} AS gte", f"{at('08 00:00:00')} AS lte"
    )
    profile = many.profile_requests(bounded)
    assert (profile.gte.isoformat(), profile.lte.isoformat()) == (
        "2024-01-02T00:00:00+00:00",
        "2024-01-08T00:00:00+00:00",
    )
    side = many.LogSide()
    assert many._enclosing(logs, side, profile).count() == 1
    half_open = bounded.selectExpr("id", "index", "q", "nullif(gte, gte) AS gte", "lte")
    assert many.profile_requests(half_open).gte is None
    open_ended = half_open.selectExpr("id", "index", "q", "gte", "gte AS lte")
    for hint in HINTS:
        for requests, n in ((bounded, 2), (half_open, 4), (open_ended, 8)):
            found = many.match_requests(logs, hinted(requests, hint), side)
            assert found.count() == n


def test_kinds_of_timestamps_do_not_mix(data):
    logs, requests, _ = data
    other = logs.withColumn("ts", logs["ts"].cast("timestamp"))
    with pytest.raises(ValueError, match="same kind"):
        many.match_requests(other, requests, SIDE)


def test_dates_of_a_time_table_are_pruned(spark, tmp_path):
    from tests.conftest import plan_of
    from tidelog import write_time_table

    logs = spark.range(240).selectExpr(
        "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts",
        "'a' AS _index",
        "'x' AS raw",
    )
    write_time_table(logs, str(tmp_path / "t"), "ts")
    requests = spark.range(1).selectExpr(
        "id", "'a' AS index", "CAST(NULL AS STRING) AS q",
        "TIMESTAMP_NTZ'2024-01-03 12:00:00' AS gte", "TIMESTAMP_NTZ'2024-01-04 11:00:00' AS lte",
    )
    side = many.LogSide(partition="dt")
    found = many.match_requests(spark.read.parquet(str(tmp_path / "t")), requests, side)
    assert "(dt#" in plan_of(found).split("PartitionFilters: ")[1].split("]")[0]
    assert found.count() == 24


def test_a_request_covers_at_most_two_buckets(spark, data):
    _, requests, _ = data
    seconds = [f"({b})" for b in ("unix_timestamp(gte)", "unix_timestamp(lte)")]
    level = many._level(*seconds)
    for i, _ in enumerate(many.WIDTHS):
        n = f"{many._bucket(seconds[1], i)} - {many._bucket(seconds[0], i)}"
        spans = requests.where("gte <= lte").where(f"({level}) = {i}")
        assert spans.where(f"{n} > 1").count() == 0


def test_a_hot_bucket_is_split_at_run_time(spark, tmp_path):
    """Copies of one row share every key; the skewed partition is still split."""

    def stored(df, name):
        # constants of a generated table would be folded into the plan
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    copies = spark.range(0, 200_000, 1, 16).selectExpr(
        "CAST(id AS INT) AS row",
        "'hot' AS _index",
        "TIMESTAMP_NTZ'2024-01-01 05:00:00' AS ts",
        "CASE WHEN id % 3 = 0 THEN 'same text' ELSE sha2(CAST(id AS STRING), 256) END AS raw",
    )
    others = spark.range(0, 2_000, 1, 4).selectExpr(
        "CAST(id AS INT) AS row",
        "'hot' AS _index",
        "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-02 00:00:00') AS ts",
        "'same text' AS raw",
    )
    requests = spark.range(400).selectExpr(
        "CAST(id AS INT) AS id",
        "'hot' AS index",
        "'same' AS q",
        "timestampadd(HOUR, CAST(id AS INT) * 5, TIMESTAMP_NTZ'2024-01-01 05:00:00') AS gte",
        "timestampadd(HOUR, CAST(id AS INT) * 5, TIMESTAMP_NTZ'2024-01-01 05:30:00') AS lte",
    )
    logs = stored(copies.unionByName(others), "logs")
    requests = stored(requests, "requests")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = many.match_requests(logs, requests, SIDE)
        counts = many.request_counts(found, requests)
        total = sum(r.n for r in counts.collect())
        assert "skew=true" in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)
    hours = {n for n in range(2_000)}
    later = sum(1 for i in range(400) if i * 5 - 19 in hours)
    assert total == (200_000 + 2) // 3 + later


def test_no_requests(spark, data):
    logs, requests, _ = data
    for hint in HINTS:
        none = many.match_requests(logs, hinted(requests.where("false"), hint), SIDE)
        assert none.count() == 0


def shared_requests():
    """Few conditions of many requests; ids that repeat or are missing."""
    late = START + timedelta(days=40)
    asked = [
        ("hot", None, None, None),
        ("hot", "row 1", None, late),
        ("hot", "same", START, START + timedelta(days=1)),
        ("cold", "", late, None),
        ("cold", None, START, late),
        ("cold", None, late, START),
        ("unknown", None, None, None),
        (None, "row", None, None),
    ]
    rows = [(10 * n + i, *row) for n, row in enumerate(asked) for i in range(4)]
    return rows + [(0, *asked[0]), (0, *asked[4]), (10, *asked[0]), (None, *asked[0]), (None, *asked[3])]


def most_rows(df):
    """Of all steps of a plan that ran, the most rows that one made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def one_request(spark, tmp_path_factory):
    """300 suppliers that ask the same of 300 events, all of which match."""
    path = tmp_path_factory.mktemp("one")
    spark.range(300).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(300).selectExpr(
        "id AS event_id", "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts",
        "'click' AS event_type", "id / 2 AS value", "'{}' AS props",
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_first_hits_of_shared_conditions(spark, data, threshold):
    logs, _, _ = data
    requests = spark.createDataFrame(shared_requests(), REQUEST_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        pairs = many.request_hits(many.match_requests(logs, requests, SIDE), SIDE, 3)
        hits = many.first_hits(logs, requests, SIDE, 3)
        assert hits.columns == pairs.columns
        told = Counter(tuple(r) for r in hits.collect())
        assert told == Counter(tuple(r) for r in pairs.collect())
        assert sum(told.values()) > 60 and any(row[0] is None for row in told)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hits_do_not_list_every_pair(spark, one_request):
    import __spark_entry__ as entry

    hits = entry.queries()["multi_search_hits"](spark, one_request)
    assert most_rows(hits) < 5_000
    assert Counter(r.event_id for r in hits.collect()) == {i: 300 for i in range(5)}


@pytest.mark.parametrize("hint", HINTS)
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_counts_of_shared_conditions(spark, data, hint, threshold):
    logs, _, _ = data
    requests = spark.createDataFrame(shared_requests(), REQUEST_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        pairs = many.request_counts(many.match_requests(logs, requests, SIDE), requests)
        counts = many.count_requests(logs, hinted(requests, hint), SIDE)
        told = Counter(tuple(r) for r in counts.collect())
        assert told == Counter(tuple(r) for r in pairs.collect())
        assert sum(told.values()) == len(shared_requests()) and told[(None, 0)] == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [f"multi_search{x}" for x in ("", "_plain", "_bucketed", "_shuffled")])
def test_counts_do_not_list_every_pair(spark, one_request, name):
    import __spark_entry__ as entry

    counts = entry.queries()[name](spark, one_request)
    assert most_rows(counts) < 5_000
    assert {r.id: r.n for r in counts.collect()} == {i: 300 for i in range(300)}


def test_unknown_indexes_fail(spark):
    requests = spark.createDataFrame(request_rows(5)[:5], REQUEST_SCHEMA)
    registry = spark.createDataFrame([("hot",), ("cold",), ("hot",)], "index string")
    failed = many.unknown_indexes(requests, registry).collect()
    expected = {row[0] for row in request_rows(5)[:5] if row[1] == "unknown"}
    assert {r.id for r in failed} == expected
    assert all((r.total, r.successful, r.failed) == (1, 0, 1) for r in failed)

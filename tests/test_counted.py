"""Searches with partial counts against searches of rows alone."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidelog import PartialCounts, refresh_partials, search, search_counted, write_time_table
from tidelog.sources.writers import time_table_index


@pytest.fixture(scope="module")
def counted(spark, tmp_path_factory):
    """A month of rows at odd instants, some without a time, in three loads."""
    base = str(tmp_path_factory.mktemp("counted"))
    rows = spark.range(3_000).selectExpr(
        "id",
        "CASE WHEN id % 50 <> 7 THEN timestamp_micros(1709251200000000 + id * 863999123 + id * id * 17) END AS t",
        "CASE WHEN id % 10 <> 3 THEN element_at(array('a', 'b', 'c'), CAST(id % 3 + 1 AS int)) END AS kind",
        "concat('text ', id % 7) AS body",
    )
    counts = PartialCounts(f"{base}/counts", "t", ("kind",), minutes=5)
    for load in range(3):
        write_time_table(rows.where(F.col("id") % 3 == load), f"{base}/table", "t", mode="append")
        refresh_partials(spark, f"{base}/table", counts, f"{base}/state")
    refresh_partials(spark, f"{base}/table", counts, f"{base}/state")
    index = time_table_index(spark, "log", f"{base}/table", "t", id="id", text=["kind", "body"])
    return index, counts


RANGES = [
    None,
    {"gte": "2024-03-03T02:03:04Z", "lte": "2024-03-09T23:59:59Z"},
    {"gte": "2024-03-03T02:05:00Z", "lte": "2024-03-03T02:07:00Z"},
    {"gte": "2024-03-03T00:00:00Z", "lte": "2024-03-04T00:00:00Z"},
    {"gte": "2024-03-20T11:11:11Z"},
    {"lte": "2024-03-05T12:34:56Z"},
    {"gte": "2024-03-09T00:00:00Z", "lte": "2024-03-01T00:00:00Z"},
    {"gte": "2025-01-01T00:00:00Z"},
]
FILTERS = [
    {},
    {"must": [{"match_phrase": {"kind": "b"}}]},
    {"must_not": [{"match_phrase": {"kind": "a"}}]},
    {"must": [{"bool": {"filter": [{"match_phrase": {"kind": "c"}}], "must_not": {"match_phrase": {"kind": "a"}}}}]},
    {"must": [{"match_phrase": {"body": "text 3"}}]},
    {"must": [{"multi_match": {"query": "ext 2"}}]},
]
AGGS = {
    "hour": {"date_histogram": {"field": "t", "fixed_interval": "1h"}},
    "week": {"date_histogram": {"field": "t", "calendar_interval": "1w"}},
}


def query_of(bounds, more):
    each = [{"range": {"datetime": bounds}}] if bounds else []
    return {"bool": {"filter": each, **more}}


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("bounds", RANGES, ids=str)
def test_summaries_equal(counted, bounds):
    index, counts = counted
    for more, aggs in zip(FILTERS, itertools.cycle([AGGS, {}])):
        request = {"query": query_of(bounds, more), "size": 0, "aggs": aggs}
        assert rows(search_counted(index, counts, request).summary) == rows(search(index, request).summary)


def test_intervals_that_cross_steps_are_counted_from_rows(counted):
    index, counts = counted
    aggs = {"odd": {"date_histogram": {"field": "t", "fixed_interval": "7m"}}}
    request = {"query": query_of(RANGES[1], {}), "size": 0, "aggs": aggs}
    found = search_counted(index, counts, request)
    assert counts.path not in plan_of(found.summary)
    assert rows(found.summary) == rows(search(index, request).summary)


@pytest.mark.parametrize("order", [None, "asc", "desc"])
@pytest.mark.parametrize("bounds", [None, RANGES[1], RANGES[4], RANGES[7]], ids=str)
def test_hits_equal(counted, order, bounds):
    index, counts = counted
    for more, size in zip(FILTERS, (1, 40, 5, 100_000, 3, 7)):
        request = {"query": query_of(bounds, more), "size": size}
        if order:
            request["sort"] = [{"t": {"order": order}}]
        found = search_counted(index, counts, request).hits.select("_id", "sort").collect()
        assert found == search(index, request).hits.select("_id", "sort").collect()


def dates_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\]", plan_of(df)), plan


def test_newest_hits_read_one_date(spark, counted):
    index, counts = counted
    request = {"query": query_of(None, {}), "size": 20, "sort": [{"t": {"order": "desc"}}]}
    found = search_counted(index, counts, request).hits
    (filters, *_), _ = dates_read(found)
    last = index.df.agg(F.max("dt")).first()[0]
    assert f">= {last}" in filters
    kept = index.df.where(F.col("dt") >= F.lit(last)).select("dt").distinct().count()
    assert kept == 1


def test_edges_prune_dates(counted):
    index, counts = counted
    request = {"query": query_of(RANGES[1], {}), "size": 0, "aggs": AGGS}
    plan = plan_of(search_counted(index, counts, request).summary)
    assert "dt" in "".join(re.findall(r"PartitionFilters: \[(.*?)\]", plan))
    edges = [f for f in re.findall(r"PartitionFilters: \[(.*?)\]", plan) if "OR" in f]
    assert edges and "2024-03-03" in edges[0] and "2024-03-09" in edges[0]


def test_a_repeated_load_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:30"), (2, None)], "id int, t string").selectExpr("id", "CAST(t AS timestamp) AS t")
    counts = PartialCounts(str(tmp_path / "counts"), "t")
    assert counts.read(df).count() == 0
    for _ in range(2):
        counts.add(df, 5)
    assert counts.read(df).agg(F.sum("doc_count")).first()[0] == 2

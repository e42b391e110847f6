"""What the plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from registered.registry import events
from registered.searches import ERRORS, TWO_HISTOGRAMS
from tests.conftest import plan_of
from tidelog import log_index, search, time_table_index, write_time_table


@pytest.fixture(scope="module")
def found(spark, folder):
    request = {"query": ERRORS, "size": 50, "aggs": TWO_HISTOGRAMS}
    return search(events(spark, folder), request)


def test_filters_reach_the_scan(found):
    plan = plan_of(found.summary)
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed
    assert "LessThanOrEqual(ts" in pushed
    assert "EqualNullSafe(event_type,error)" in pushed
    assert "StringContains(props" in pushed


def test_instants_reach_the_scan_in_any_session_zone(spark, folder, in_new_york, tmp_path):
    df = spark.read.parquet(f"{folder}/events.parquet")
    zoned = df.selectExpr("event_id", "timestamp_micros(event_id * 1000000) AS t")
    zoned.write.parquet(str(tmp_path / "zoned"))
    index = log_index("x", spark.read.parquet(str(tmp_path / "zoned")), "t", id="event_id")
    bounds = {"gte": "1970-01-01T00:00:10Z", "lte": "1970-01-01T00:00:20Z"}
    query = {"bool": {"filter": [{"range": {"datetime": bounds}}]}}
    kept = search(index, {"query": query}).hits
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan_of(kept)
    assert kept.count() == 11


def test_histograms_read_only_the_columns_they_need(found):
    plan = plan_of(found.summary)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in plan


def test_two_histograms_are_one_scan(found):
    assert plan_of(found.summary).count("Scan parquet") == 2  # tree and details


def test_hits_are_a_distributed_top_k(found):
    plan = plan_of(found.hits)
    assert "TakeOrderedAndProject" in plan
    assert "Exchange" not in plan


def test_aggregations_hash_instead_of_sorting(spark, folder):
    for name in ("hist_clock_30m", "time_index_hourly", "hist_two_named", "index_summary"):
        plan = plan_of(entry.queries()[name](spark, folder))
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_hits_of_a_time_table_are_fetched_in_two_steps(spark, folder, tmp_path):
    path = str(tmp_path / "table")
    write_time_table(spark.read.parquet(f"{folder}/events.parquet"), path, "ts")
    index = time_table_index(spark, "events", path, "ts", id="event_id", text=["event_type", "props"])
    hits = search(index, {"query": ERRORS, "size": 5}).hits
    plan = plan_of(hits)
    assert "dynamicpruning" in plan
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert any("user_id" not in schema for schema in schemas)
    assert hits.count() == 5


def test_few_requests_do_not_shuffle_the_log(spark, folder):
    from registered.requests import matched

    plan = plan_of(matched(spark, folder))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_requests_join_by_bucket(spark, folder):
    from registered.requests import matched

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(matched(spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert re.search(r"hashpartitioning\(event_type#\d+, _level#\d+, _bucket#\d+L", plan)


def test_rank_limit_is_applied_before_the_shuffle(spark, folder):
    plan = plan_of(entry.queries()["multi_search_hits"](spark, folder))
    assert plan.count("WindowGroupLimit") >= 2


def test_merged_parts_are_sorted_once(spark, folder):
    plan = plan_of(entry.QUERIES["hist_merge_sources"](spark, folder))
    assert len(re.findall(r"rangepartitioning", plan)) == 1

"""Every registered query against its SQL, on the smallest tables; no plan may
hold a cross join or Python code."""

import pytest

import __spark_entry__ as entry
import check_queries
import registered
from tests.conftest import plan_of

NOT_IN_PLANS = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
)
MAY_BE_EMPTY = {"multi_search_unknown_index", "ext_min_doc_count"}


@pytest.fixture(scope="module")
def con(folder):
    return check_queries.connect(folder)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    plan = plan_of(df)
    for bad in NOT_IN_PLANS:
        assert bad not in plan
    problem = check_queries.compare(df, con, name)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        problem = None
    assert problem is None


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(registered.ORACLES)
    assert set(entry.queries()) >= set(registered.QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "key_as_string", "doc_count"]
    assert df.count() > 0

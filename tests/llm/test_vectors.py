"""Both vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import neighbours, top_k
from tidelog.llm.queries import QUERIES
from tidelog.llm.tables import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, is_query, k, whole=False):
    ok = [
        (i, np.floor(np.array(v, float) * 256) if whole else np.array(v, float))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    ok = [(i, v) for i, v in ok if whole or v.any()]
    out = {}
    for i, q in ok:
        if is_query(i):
            scores = [(-product(q, v), j) for j, v in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_searches(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    near, exact = found(QUERIES["op2_nearest_neighbours"](spark, sf)), brute(rows, lambda i: i % 20 == 0, 20)
    hits = sum(len({j for j, _ in near[q]} & {j for j, _ in exact[q]}) for q in exact)
    assert set(near) == set(exact) and hits >= 0.99 * sum(map(len, exact.values()))
    assert found(QUERIES["op6_top_k"](spark, sf)) == brute(rows, lambda i: i % 50 == 0, 5, whole=True)


def odd_rows(n=700, dimensions=9):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(dimensions).round(2)]) for i in range(n)]
    for i in range(100, 300):
        rows[i] = (i, rows[100][1])  # a large group of equal vectors
    rows[5] = (5, None)
    rows[6] = (6, [])
    rows[7] = (7, [0.0] * dimensions)
    rows[8] = (8, [None, *rows[8][1][1:]])
    rows[9] = (9, [float("nan"), *rows[9][1][1:]])
    rows[10] = (10, [float("inf"), *rows[10][1][1:]])
    rows[11] = (None, rows[11][1])
    return rows


def test_ties_nulls_and_equal_vectors(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "block")
    query = F.expr("vec_id % 20 = 0")
    near = found(neighbours.nearest(df, query, k=7, block_rows=100, group_queries=10))
    assert near == brute(rows, lambda i: i % 20 == 0, 7)
    best = found(top_k.top_k(df, query, k=7, sample=50, tree_rows=90, group_queries=10))
    assert best == brute(rows, lambda i: i % 20 == 0, 7, whole=True)


def test_few_repeated_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    for some in (rows, rows[:1], []):
        df = spark.createDataFrame([(i, v, 0) for i, v in some], SCHEMA)
        query = F.expr("vec_id = 0")
        wanted = {0: [(1, 0.5), (1, 0.5)]} if len(some) > 1 else {}
        assert found(neighbours.nearest(df, query, k=3)) == wanted
        wanted = {0: [(1, 32768), (1, 32768)]} if len(some) > 1 else {}
        assert found(top_k.top_k(df, query, k=3)) == wanted


def test_tree_skips_most_of_clustered_rows():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16)))
    limit = float((rows**2).sum(axis=1).max())
    tree = top_k.MTree(limit)
    tree.load(np.arange(4000), rows, rows[0])
    measured = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            measured.append(len(self))
            return np.asarray(self) @ other

    tree.pages = [(p[0], p[1], p[2].view(Counted), p[3], p[4]) for p in tree.pages]
    for q in range(0, 4000, 400):
        best = tree.search(rows[q], q, 5, -float(1 << 52))
        products = rows @ rows[q]
        products[q] = -np.inf
        order = np.lexsort((np.arange(4000), -products))[:5]
        assert [i for _, i in best] == order.tolist()
    assert sum(measured) < 10 * 4000 * 0.7


def test_codes_rule_out_most_rows_at_high_recall(spark):
    """On vectors without clusters, where blocks rule out nothing."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    options = {"id_column": "vec_id", "vector_column": "embedding", "seed": 7, "width": 2.0, "first": 4}
    options |= {"block_rows": 512, "group_queries": 64, "sample": 1024, "most_centres": 16}
    near = neighbours.found_near(df, F.expr("vec_id % 20 = 0"), 20, **options)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    exact = brute(rows, lambda i: i % 20 == 0, 20)
    best = found(neighbours.best_ranked(near, 20))
    hits = sum(len({j for j, _ in best[q]} & {j for j, _ in exact[q]}) for q in exact)
    assert hits >= 0.95 * 20 * len(exact)
    assert near.agg(F.sum("measured")).first()[0] <= 0.4 * len(exact) * len(rows)


def test_blocks_rule_out_far_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 32)) * 10
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.1, 32)]) for i in range(1_600)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    options = {"id_column": "vec_id", "vector_column": "embedding", "seed": 7, "width": 2.0, "first": 1}
    options |= {"block_rows": 100, "group_queries": 50, "sample": 800, "most_centres": 16}
    near = neighbours.found_near(df, F.expr("vec_id % 20 = 0"), 5, **options)
    exact = brute(rows, lambda i: i % 20 == 0, 5)
    best = found(neighbours.best_ranked(near, 5))
    hits = sum(len({j for j, _ in best[q]} & {j for j, _ in exact[q]}) for q in exact)
    assert hits >= 0.95 * 5 * len(exact)
    assert near.agg(F.sum("measured")).first()[0] <= 0.1 * len(exact) * len(rows)


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    rows, queries = rng.standard_normal((3_000, 48)), rng.standard_normal((20, 48))
    centre = rows.mean(axis=0)
    codes = neighbours.Codes(*neighbours.encode(rows - centre, 7), centre, 7)
    close, miss = codes.estimate(queries, 2.0)
    off = np.abs(close - queries @ rows.T) > miss
    assert 0.01 < off.mean() < 0.08


def test_check_finds_what_signs_miss(spark):
    """With no width, signs alone miss many neighbours, and some blocks are small."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(24) * (1 + i % 3)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    query = F.expr("vec_id % 20 = 0")
    for options in ({"width": 0.0}, {"first": 1, "block_rows": 9}, {}):
        near = found(neighbours.nearest(df, query, k=12, **options))
        assert near == brute(rows, lambda i: i % 20 == 0, 12)


def test_no_product_is_above_its_highest():
    rng = np.random.default_rng(6)
    rows, queries = rng.standard_normal((2_000, 48)), rng.standard_normal((20, 48))
    for scale in (1e-30, 1.0, 1e30):
        centre = rows.mean(axis=0) * scale
        steps = neighbours.fine_steps(rows * scale - centre, 7)
        lengths = np.sqrt(((rows * scale - centre) ** 2).sum(axis=1))
        most = neighbours.highest(queries * scale, *steps, lengths, centre, 7)
        over = (most - queries @ rows.T * scale**2) / scale**2
        assert over.min() >= 0 and over.max() < 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_registered_search_is_exact(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    near = found(QUERIES["op2_nearest_neighbours"](spark, sf))
    assert near == brute(rows, lambda i: i % 20 == 0, 20)

"""Exact top-k search by inner product of integers in M-trees.

Integer vectors get one more component, sqrt(M - |x|^2) with M the largest
squared length, and queries a zero: then the squared distance to a query is
``|q|^2 + M - 2 <q, x>``, so the nearest row has the largest product and metric
trees apply. Every row goes to its nearest pivot (pivots come from a sample of
bounded size), large pivots are split by hash, and each part is bulk loaded into
an M-tree of pages. An entry of a page holds an object, its covering radius and
its distance to the page's own object.

A query first measures the sample, whose k-th best product bounds the answer
from below, and visits only pivots whose balls can reach that. In a tree it
takes pages from a queue by the least distance they allow; an entry whose stored
parent distance already rules it out by the triangle inequality is skipped
unmeasured, and the search ends when the queue's best page can't reach the k-th
product found. Ties are never pruned (bounds carry a slack above rounding).

Cases: see ``valid_vectors`` (zero vectors take part); components must stay
below 2^24 and squared lengths below 2^52; fewer than k other rows give fewer
results; a row never finds its own id; repeated query rows are asked once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import groups_for, stored
from tidelog.llm.vectors import best_ranked, dealt, every, matrix, valid_vectors

PAGE = 128
SLACK = 1e-6
PAGES = "pivot int, salt int, page int, leaf boolean, ids array<long>, objects binary, radii binary, parent binary"


def distances(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Distances of integer rows ``a`` to ``b`` with their added components."""
    aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    more = np.sqrt(np.maximum(0, limit - aa))[:, None] * np.sqrt(np.maximum(0, limit - bb))
    return np.sqrt(np.maximum(0, 2 * limit - 2 * (a @ b.T + more)))


def query_distances(q: np.ndarray, rows: np.ndarray, limit: float) -> np.ndarray:
    """Distances of queries (whose added component is 0) to rows."""
    return np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + limit - 2 * (q @ rows.T)))


def spread(rows: np.ndarray, n: int, limit: float) -> np.ndarray:
    """Places of up to ``n`` rows, each farthest from those before; no two equal."""
    chosen = [0]
    nearest = distances(rows, rows[:1], limit)[:, 0]
    while len(chosen) < n and nearest.max() > SLACK * (1 + np.sqrt(limit)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(rows, rows[chosen[-1:]], limit)[:, 0])
    return np.array(chosen)


class MTree:
    """Pages of one tree; page 0 is the root."""

    def __init__(self, limit: float):
        self.limit = limit
        self.pages: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def load(self, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> int:
        """Bulk load rows under a page whose own object is ``centre``."""
        page = len(self.pages)
        self.pages.append(())
        to_centre = distances(rows, centre[None], self.limit)[:, 0]
        if len(rows) <= PAGE:
            self.pages[page] = (True, ids, rows, np.zeros(len(rows)), to_centre)
            return page
        fanout = min(PAGE, -(-2 * len(rows) // PAGE))
        heads = spread(rows[:: max(1, len(rows) // 2048)], fanout, self.limit) * max(1, len(rows) // 2048)
        to_heads = distances(rows, rows[heads], self.limit)
        owner = to_heads.argmin(axis=1)
        children, objects, radii, parent = [], [], [], []
        for head in range(len(heads)):
            own = np.flatnonzero(owner == head)
            if len(heads) == 1 or len(own) == len(rows):
                parts = np.array_split(own, -(-len(own) // PAGE))  # equal rows: any split is as good
            else:
                parts = [own] if len(own) else []
            for part in parts:
                children.append(self.load(ids[part], rows[part], rows[heads[head]]))
                objects.append(rows[heads[head]])
                radii.append(to_heads[part, head].max())
                parent.append(to_centre[heads[head]])
        self.pages[page] = (False, np.array(children), np.array(objects), np.array(radii), np.array(parent))
        return page

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (product, id), best first, of products not below ``least``."""
        qq = float(query @ query)
        slack = SLACK * (1 + np.sqrt(qq + self.limit))
        reach = np.sqrt(max(0.0, qq + self.limit - 2 * least)) + slack
        best: list[tuple[float, int]] = []  # a heap, its worst first
        queue = [(0.0, 0, None)]
        while queue:
            bound, page, to_centre = heapq.heappop(queue)
            if bound > reach:
                break
            leaf, ids, rows, radii, parent = self.pages[page]
            if to_centre is not None:
                near = np.flatnonzero(np.abs(to_centre - parent) - radii <= reach)
                ids, rows, radii = ids[near], rows[near], radii[near]
            products = rows @ query
            if leaf:
                for at in np.flatnonzero(products >= least):
                    if ids[at] == own:
                        continue
                    item = (float(products[at]), -int(ids[at]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k and best[0][0] > least:
                    least = best[0][0]
                    reach = np.sqrt(max(0.0, qq + self.limit - 2 * least)) + slack
            else:
                to_rows = np.sqrt(np.maximum(0, qq + self.limit - 2 * products))
                for child, d, r in zip(ids.tolist(), to_rows.tolist(), radii.tolist(), strict=True):
                    if d - r <= reach:
                        heapq.heappush(queue, (max(0.0, d - r), child, d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))

    def rows(self, pivot: int, salt: int) -> pd.DataFrame:
        return pd.DataFrame(
            [
                (pivot, salt, n, leaf, ids.tolist(), *(x.astype(float).tobytes() for x in (rows, radii, parent)))
                for n, (leaf, ids, rows, radii, parent) in enumerate(self.pages)
            ],
            columns=["pivot", "salt", "page", "leaf", "ids", "objects", "radii", "parent"],
        )

    @classmethod
    def of(cls, pages: pd.DataFrame, limit: float) -> MTree:
        tree = cls(limit)
        for row in pages.sort_values("page").itertuples():
            ids = np.array(row.ids, np.int64)
            objects = np.frombuffer(row.objects).reshape(len(ids), -1)
            tree.pages.append((row.leaf, ids, objects, np.frombuffer(row.radii), np.frombuffer(row.parent)))
        return tree


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component), as whole doubles."""
    rows = valid_vectors(df, id_column, vector_column, zero=True)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def top_k(
    df: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 256.0,
    sample: int = 1024,
    pivots: int = 32,
    tree_rows: int = 8192,
    group_queries: int = 4096,
) -> DataFrame:
    """The k rows of the largest integer product with each row that ``is_query``.

    The sample is at most about twice ``sample`` rows, whatever the table's size.
    """
    schema = "query_id long, query_hash long, vec_id long, score long"
    rows = stored(integer_vectors(df, id_column, vector_column, scale), "integer-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    n, limit = rows.agg(F.count("*"), F.max(square)).first()
    if not n:
        return best_ranked(df.sparkSession.createDataFrame([], schema), k)
    share = min(1.0, sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30) < share).limit(2 * sample)
    drawn = sorted(drawn.collect() or rows.limit(1).collect(), key=lambda r: (r["vec_id"], r["v"]))
    sample_ids = np.array([r["vec_id"] for r in drawn], np.int64)
    sample_rows = np.array([r["v"] for r in drawn])
    heads = sample_rows[spread(sample_rows, pivots, limit)]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to_heads = distances(matrix(batch.column(1)), heads, limit)
            pivot = to_heads.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(pivot, pa.int32()),
                    pa.array(to_heads[np.arange(len(pivot)), pivot]),
                ],
                names=["vec_id", "v", "pivot", "far"],
            )

    placed = rows.mapInArrow(assigned, "vec_id long, v array<double>, pivot int, far double")
    # One row for each pivot, of which there are at most ``pivots``.
    balls = {r["pivot"]: (r["n"], r["r"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}
    parts = {p: groups_for(count, tree_rows) for p, (count, _) in balls.items()}
    parts_of = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col("pivot")]

    def loaded(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(limit)
        tree.load(part["vec_id"].to_numpy(), np.stack(part["v"].to_list()), heads[key[0]])
        return tree.rows(*key)

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), parts_of).cast("int"))
    pages = stored(salted.groupBy("pivot", "salt").applyInPandas(loaded, PAGES), "m-tree-pages")

    numbers = sorted(balls)
    reaches = np.array([balls[p][1] for p in numbers])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pivot that a query has to visit, with its bound."""
        for batch in batches:
            vectors = matrix(batch.column(1))
            products = vectors @ sample_rows.T
            products[batch.column(0).to_numpy()[:, None] == sample_ids] = -np.inf
            least = np.full(len(vectors), -np.inf)
            if len(sample_ids) > k:
                least = np.partition(products, -k, axis=1)[:, -k]
            least = np.where(np.isfinite(least), least, -float(1 << 52))
            to_heads = query_distances(vectors, heads[numbers], limit)
            size = (vectors**2).sum(axis=1)
            reach = np.sqrt(np.maximum(0, size + limit - 2 * least))
            slack = SLACK * (1 + np.sqrt(size + limit))
            i, j = np.nonzero(to_heads - reaches <= (reach + slack)[:, None])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(i)),
                    batch.column(1).take(pa.array(i)),
                    batch.column(2).take(pa.array(i)),
                    pa.array(np.array(numbers)[j], pa.int32()),
                    pa.array(least[i]),
                ],
                names=["query_id", "v", "query_hash", "pivot", "least"],
            )

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("query_hash"))
    queries = queries.dropDuplicates(["query_id", "query_hash"])
    groups = groups_for(queries.count(), group_queries)
    asked = (
        queries.mapInArrow(
            routed, "query_id long, v array<double>, query_hash long, pivot int, least double"
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), parts_of - 1)))
        .withColumn("part", dealt("query_id", groups))
    )

    def searched(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(asked):
            tree = MTree.of(pages, limit)
            for row in asked.itertuples():
                for score, found in tree.search(row.v, row.query_id, k, row.least):
                    out.append((row.query_id, row.query_hash, found, int(score)))
        return pd.DataFrame(out, columns=["query_id", "query_hash", "vec_id", "score"])

    found = (
        pages.withColumn("part", every(groups))
        .groupBy("pivot", "salt", "part")
        .cogroup(asked.groupBy("pivot", "salt", "part"))
        .applyInPandas(searched, schema)
    )
    return best_ranked(found, k)

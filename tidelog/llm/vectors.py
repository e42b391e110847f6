"""What the two vector searches share: which rows take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import q


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part.

    Left out: null ids, null or empty vectors, null or non-finite components and
    (unless ``zero``) zero vectors, and vectors of another length than most.
    """
    rows = df.select(
        q(id_column).cast("long").alias("vec_id"), q(vector_column).cast("array<double>").alias("v")
    ).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(finite)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1 if n else 0)


def paired_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``a[i]`` and ``b[j]``, summed in component order.

    The same pair of vectors gives the same double wherever it lies.
    """
    out = np.empty(len(i))
    for at in range(0, len(i), 200_000):
        rows, others = i[at : at + 200_000], j[at : at + 200_000]
        total = np.zeros(len(rows))
        for x, y in zip(a.T, b.T, strict=True):
            total += x[rows] * y[others]
        out[at : at + 200_000] = total
    return out


def best_ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: highest score first, ties to smaller ids."""
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def dealt(column: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int")


def every(groups: int | str) -> Column:
    """One row for each of ``groups`` (a number or a column's name) of the other side."""
    last = F.lit(groups - 1) if isinstance(groups, int) else F.col(groups) - 1
    return F.explode(F.sequence(F.lit(0), last))

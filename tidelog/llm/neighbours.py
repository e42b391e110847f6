"""Nearest neighbours with randomly rotated one-bit codes, and an exact check.

Rows are gathered in blocks around centroids, which a bounded sample gives. What
is left of a vector after its centroid is rotated by a fixed random orthogonal
matrix and kept as the signs of its components (packed bits), its length, and
how well the sign vector aligns with it. A query is rotated too and kept in
``BITS`` bits a component, so its product with a sign vector is a few counts of
common bits. With unit sign vector s, alignment a, length n and centroid c the
product of a row and a query q is about ``<q, c> + n * <s, Rq> / a``, off by at
most ``n * |q| * sqrt(1 - a*a) / a * width / sqrt(dimensions - 1)`` but with a
chance that falls exponentially with ``width`` squared.

A query first visits the ``first`` blocks whose centroids have the largest
products with it and measures the ``FIRST`` times k rows of the highest estimates
in each; the k-th product measured is its bound. Then it visits the blocks that can hold a
larger one (centroid product plus query length times radius, which is never too
small) and measures the rows whose estimate reaches the bound within their
error. Scores are exact products of the original vectors in double precision.

``width`` sets how many neighbours the signs find: an error beyond 2 befalls about
one in 44 of those whose product is just that of the bound, and hardly any of
those with larger ones. An exact check finds the others: a row also keeps the
rotated components in whole steps of ``LEVELS`` to its largest, and how far these
lie from the vector. By Cauchy and Schwarz a product is at most that of the steps
plus query length times this distance, so a row below the bound even then can be
left out for sure, and all others are measured. Shares measured are in the README.

Cases: see ``valid_vectors``; fewer than k other rows give fewer results; ties go
to smaller ids; a row never finds its own id; queries that repeat a whole row are
asked once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import groups_for, stored
from tidelog.llm.vectors import best_ranked, every, matrix, paired_products, valid_vectors

BITS = 6  # of a component of a query
FIRST = 8  # rows, as multiples of k, that give a query its bound in a block
LEVELS = 127  # steps to the largest component of a row


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    normal = np.random.default_rng(seed).standard_normal((dimensions, dimensions))
    basis, upper = np.linalg.qr(normal)
    return basis * np.sign(np.diag(upper))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs packed in 64-bit words, lengths and alignments of rows."""
    rotated = vectors @ rotation(vectors.shape[1], seed)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.abs(rotated).sum(axis=1) / (lengths * np.sqrt(vectors.shape[1]))
    align = np.where(lengths > 0, np.clip(align, 1e-12, 1), 1)
    return words_of_bits(rotated > 0), lengths, align


def words_of_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def fine_steps(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated components in whole steps, the step, and the length of what is left."""
    rotated = vectors @ rotation(vectors.shape[1], seed)
    step = np.maximum(np.abs(rotated).max(axis=1) / LEVELS, 1e-300)
    levels = np.rint(rotated / step[:, None]).astype(np.int8)
    return levels, step, np.sqrt(((rotated - levels * step[:, None]) ** 2).sum(axis=1))


def highest(
    queries: np.ndarray, levels: np.ndarray, step: np.ndarray, left: np.ndarray, lengths: np.ndarray, centre: np.ndarray, seed: int
) -> np.ndarray:
    """What products (query by row) can be at most; not a number where that is unknown."""
    dimensions = queries.shape[1]
    size = np.sqrt((queries**2).sum(axis=1))
    with np.errstate(all="ignore"):
        turned = ((queries / size[:, None]) @ rotation(dimensions, seed)).astype(np.float32)
        close = turned @ levels.astype(np.float32).T * step
        # both roundings: of single precision in the steps' product, of double in the rest
        left = left + np.finfo(np.float32).eps * (dimensions + 8) * lengths + 1e-9 * np.sqrt((centre**2).sum())
        return size[:, None] * (close + left) + (queries @ centre)[:, None]


@dataclass
class Codes:
    """The codes of a block's rows, relative to its centroid."""

    signs: np.ndarray
    lengths: np.ndarray
    align: np.ndarray
    centre: np.ndarray
    seed: int

    def estimate(self, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated products (query by row) and the bounds of their errors."""
        dimensions = queries.shape[1]
        turned = queries @ rotation(dimensions, self.seed)
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum((high - low) / ((1 << BITS) - 1), 1e-300)
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        ones = np.bitwise_count(self.signs).sum(axis=1, dtype=np.float64)
        product = np.empty((len(queries), len(self.signs)))
        planes = [words_of_bits(levels >> bit & 1 == 1) for bit in range(BITS)]
        for i in range(len(queries)):
            held = np.zeros(len(self.signs), np.int32)
            for bit, plane in enumerate(planes):
                for word in range(self.signs.shape[1]):
                    held += np.bitwise_count(self.signs[:, word] & plane[i, word]).astype(np.int32) << bit
            product[i] = 2 * (low[i] * ones + step[i] * held) - turned[i].sum()
        factor = self.lengths / (self.align * np.sqrt(dimensions))
        size = np.sqrt((queries**2).sum(axis=1))
        miss = self.lengths * np.sqrt(np.maximum(0, 1 - self.align**2)) / self.align / np.sqrt(max(1, dimensions - 1))
        rounding = 2 * step * np.sqrt(dimensions / 12)
        bound = width * np.sqrt((size[:, None] * miss) ** 2 + (rounding[:, None] * factor) ** 2)
        return product * factor + (queries @ self.centre)[:, None], bound


def centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of ``n`` groups of a sample, by Lloyd's rounds."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_centre(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def code_index(rows: DataFrame, centres: np.ndarray, block_rows: int, seed: int = 7) -> DataFrame:
    """Every row (vec_id, v) with its block, code and correction scalars.

    A block is part of a centroid's rows, of about ``block_rows``: a centroid
    with very many rows has several blocks.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1))
            own = nearest_centre(vectors, centres) if len(vectors) else np.zeros(0, np.int64)
            rest = vectors - centres[own]
            signs, lengths, align = encode(rest, seed) if len(vectors) else (own[:, None], own, own)
            levels, step, left = fine_steps(rest, seed) if len(vectors) else (own[:, None], own, own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(own, pa.int32()),
                    pa.array([s.tobytes() for s in signs], pa.binary()),
                    pa.array(lengths, pa.float64()),
                    pa.array(align, pa.float64()),
                    pa.array([x.tobytes() for x in levels], pa.binary()),
                    pa.array(step, pa.float64()),
                    pa.array(left, pa.float64()),
                ],
                names=["vec_id", "v", "centre", "code", "length", "align", "levels", "step", "left"],
            )

    kind = "vec_id long, v array<double>, centre int, code binary, length double, align double"
    kind += ", levels binary, step double, left double"
    index = stored(rows.mapInArrow(coded, kind), "codes")
    parts = index.groupBy("centre").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    row = F.monotonically_increasing_id()  # spreads rows that repeat all else
    part = F.pmod(F.xxhash64("vec_id", row), F.col("parts")).cast("int")
    block = F.struct("centre", part.alias("part")).alias("block")
    kept = ("code", "length", "align", "levels", "step", "left")
    return index.join(parts, "centre").select("vec_id", "v", block, *kept)


def _scored(rows: pa.Table, centres: np.ndarray, asked: pa.Table, seed: int):
    """A block's ids, vectors, codes and steps, and the queries' columns."""
    centre = rows.column("block")[0].as_py()["centre"]
    signs = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
    lengths, align = (rows.column(c).to_numpy() for c in ("length", "align"))
    codes = Codes(signs, lengths, align, centres[centre], seed)
    levels = np.frombuffer(b"".join(rows.column("levels").to_pylist()), np.int8).reshape(rows.num_rows, -1)
    steps = (levels, rows.column("step").to_numpy(), rows.column("left").to_numpy(), lengths, centres[centre], seed)
    return rows.column("vec_id").to_numpy(), matrix(rows.column("v")), codes, steps, matrix(asked.column("v"))


def kth_best(i: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of ``n`` queries, infinitely low for fewer."""
    order = np.lexsort((-score, i))
    i, score = i[order], score[order]
    last = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
    out = np.full(n, -np.inf)
    out[i[last]] = score[last]
    return out


def search_block(
    rows: pa.Table, asked: pa.Table, centres: np.ndarray, k: int, seed: int, width: float, sure: bool
) -> pa.Table:
    """The k best of a block for each query, of those that reach its bound.

    Without a bound the rows of the highest estimates are measured. If ``sure``,
    all rows that these leave out are checked, so none of the k best is missed.
    """
    ids, vectors, codes, steps, wanted = _scored(rows, centres, asked, seed)
    own, bound = asked.column("query_id").to_numpy(), asked.column("bound").to_numpy(zero_copy_only=False)
    found, seen = [], 0
    for at in range(0, len(own), 256):
        part = slice(at, at + 256)
        close, miss = codes.estimate(wanted[part], width)
        close[own[part, None] == ids] = -np.inf
        if np.isnan(bound[part]).all():
            n = min(FIRST * k, len(ids))
            j = np.argpartition(-close, n - 1, axis=1)[:, :n].ravel()
            i = np.repeat(np.arange(len(close)), n)
            taken = np.isfinite(close[i, j])
            i, j = i[taken], j[taken]
            least = np.full(len(close), -np.inf)
        else:
            # a hair below the bound, so that rounding loses no tie
            least = bound[part] - 1e-9 * (1 + np.abs(bound[part]))
            least = np.where(np.isnan(least), -np.inf, least)
            i, j = np.nonzero((close + miss >= least[:, None]) & np.isfinite(close))
        score = paired_products(wanted[part], vectors, i, j)
        if sure:
            kth = kth_best(i, score, len(close), k)
            least = np.maximum(least, kth - 1e-9 * (1 + np.abs(kth)))
            more = ~(highest(wanted[part], *steps) < least[:, None]) & (own[part, None] != ids)
            more[i, j] = False
            others = np.nonzero(more)
            score = np.concatenate([score, paired_products(wanted[part], vectors, *others)])
            i, j = (np.concatenate(x) for x in zip((i, j), others, strict=True))
        seen += len(i)
        reached = score >= least[i]
        i, j, score = i[reached], j[reached], score[reached]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((at + i[top], ids[j[top]], score[top]))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = np.zeros(len(i), np.int64)
    counts[:1] = seen  # of the whole block, told once
    return pa.table(
        {
            "query_id": own[i],
            "query_hash": asked.column("query_hash").to_numpy()[i],
            "vec_id": j,
            "score": score,
            "measured": counts,
        }
    )


FOUND = "query_id long, query_hash long, vec_id long, score double, measured long"


def _visited(queries: DataFrame, centres: np.ndarray, blocks: DataFrame, first: int | None) -> DataFrame:
    """Queries (query_id, query_hash, v, bound) once for each block they visit:
    all blocks of the ``first`` best centroids, or of all that reach the bound."""
    radius = {r.centre: r.radius for r in blocks.groupBy("block.centre").agg(F.max("radius").alias("radius")).collect()}
    there = np.array(sorted(radius), np.int64)
    reach = np.array([radius[c] for c in there.tolist()])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2))
            product = v @ centres[there].T
            if first is not None:
                n = min(first, len(there))
                j = np.argpartition(-product, n - 1, axis=1)[:, :n].ravel()
                i = np.repeat(np.arange(len(v)), n)
            else:
                rounded = 1e-9 * np.sqrt((centres[there] ** 2).sum(axis=1))
                most = product + np.sqrt((v**2).sum(axis=1))[:, None] * (reach + rounded)
                bound = batch.column(3).to_numpy(zero_copy_only=False)
                least = np.where(np.isnan(bound), -np.inf, bound - 1e-9 * (1 + np.abs(bound)))
                i, j = np.nonzero(most >= least[:, None])
            for at in range(0, len(i), 10_000):
                some = batch.take(pa.array(i[at : at + 10_000]))
                own = pa.array(there[j[at : at + 10_000]], pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns, own], names=[*some.schema.names, "centre"])

    kind = "query_id long, query_hash long, v array<double>, bound double, centre int"
    visits = queries.select("query_id", "query_hash", "v", "bound").mapInArrow(chosen, kind)
    places = blocks.select(F.col("block.centre").alias("centre"), "block")
    return visits.join(places, "centre").drop("centre")


def _search(
    index: DataFrame, visits: DataFrame, centres: np.ndarray, k: int, seed: int, width: float, group: int, sure: bool
) -> DataFrame:
    """What queries find in the blocks they visit, in groups of about ``group``."""
    visits = stored(visits, "visits")
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    rows = index.join(parts, "block").withColumn("slot", every("parts")).drop("parts")
    asked = visits.join(parts, "block").withColumn(
        "slot", F.pmod(F.xxhash64("query_id", "query_hash"), F.col("parts")).cast("int")
    ).drop("parts")

    def searched(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return empty
        return search_block(rows.combine_chunks(), asked.combine_chunks(), centres, k, seed, width, sure)

    empty = pa.schema(
        [("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("measured", pa.int64())]
    ).empty_table()
    return rows.groupBy("block", "slot").cogroup(asked.groupBy("block", "slot")).applyInArrow(searched, FOUND)


def nearest(
    df: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = 7,
    width: float = 2.0,
    first: int = 4,
    block_rows: int = 4096,
    group_queries: int = 2048,
    sample: int = 16_384,
    most_centres: int = 4096,
) -> DataFrame:
    """The k rows of the largest inner product with each row that ``is_query``.

    ``is_query`` may use ``vec_id``. ``sample`` rows, drawn by hash, and at most
    ``most_centres`` centroids of them are all that tasks are sent.
    """
    return best_ranked(found_near(**locals()), k)


def found_near(df, is_query, k, id_column, vector_column, seed, width, first, block_rows, group_queries, sample, most_centres):
    """What ``nearest`` ranks, with the number of rows measured."""
    rows = stored(valid_vectors(df, id_column, vector_column, zero=False), "vectors")
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], FOUND)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    drawn = np.array([r.v for r in drawn.orderBy("vec_id", "v").select("v").limit(2 * sample).collect()])
    centres = rows.limit(1).select("v").first().v if not len(drawn) else None
    centres = np.array([centres]) if centres else centroids(drawn, min(most_centres, groups_for(n, block_rows)))
    index = stored(code_index(rows, centres, block_rows, seed), "code-index")
    blocks = stored(index.groupBy("block").agg(F.max("length").alias("radius")), "blocks")
    queries = index.where(is_query).select(
        F.col("vec_id").alias("query_id"),
        F.xxhash64("v").alias("query_hash"),
        "v",
        F.lit(None).cast("double").alias("bound"),
    )
    queries = stored(queries.dropDuplicates(["query_id", "query_hash"]), "queries")
    near = _search(index, _visited(queries, centres, blocks, first), centres, k, seed, width, group_queries, False)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"))
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    kth = stored(kth.select("query_id", "query_hash", F.col("score").alias("bound")), "bounds")
    queries = queries.drop("bound").join(kth, ["query_id", "query_hash"], "left")
    return _search(index, _visited(queries, centres, blocks, None), centres, k, seed, width, group_queries, True)

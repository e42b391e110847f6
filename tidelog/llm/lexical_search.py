"""Ranked lexical search that scores a bag of words once, however often it occurs.

Documents are cut to the items' vocabulary: what is left of one is its term
counts and ``m``, into which its length goes. Documents in which both agree are
one class: Spark groups them by a hash and compares the counts themselves, so
classes are verified. A class is scored once against all items, and the best
classes of an item are opened to their members in ascending order of ids.

With N documents that have a term, L terms in all, n in one, df documents that
hold a term and tf occurrences of it: w is floor(1000 ln((2N+2)/(2df+1))), m is
25 + 75nN div L, the score adds w (10^9 tf div (1000 tf + 8m)) over the terms of
an item, repeats included. Scores are sums of integers below 2^53.

Items come in blocks of a bounded number of terms; a block's terms are sent to
all tasks, and the documents are read once for each block. A task keeps the best
``k`` classes of each item as it goes, so no group is ever gathered.

Cases: null and empty texts have no terms; repeated documents are several
results, repeated items are one; items of one id and other texts are several;
null document ids come last among equals; an item without a hit gives no rows,
an empty table of either kind none at all; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.tables import groups_for, q, stored
from tidelog.llm.words import chunks, gathered

# Letters A to Z become small, other ASCII characters but digits and letters
# blanks; bytes of other characters belong to terms.
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_EXACT = float(1 << 53)
CELLS = 1_000_000  # scores or postings that a task holds at once


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BLANK).split() if text else []


@dataclass
class Items:
    """A block of items: the postings of each term."""

    ids: list
    vocabulary: dict[bytes, int]
    item: np.ndarray
    times: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Items:
        keys = sorted({(r.item_key, r.item_id) for r in rows}, key=lambda k: k[0])
        number = {key: i for i, (key, _) in enumerate(keys)}
        vocabulary = {term: i for i, term in enumerate(sorted({bytes(r.term) for r in rows}))}
        term = np.array([vocabulary[bytes(r.term)] for r in rows], np.int64)
        item = np.array([number[r.item_key] for r in rows], np.int64)
        order = np.lexsort((item, term))
        return cls(
            [i for _, i in keys],
            vocabulary,
            item[order],
            np.array([r.times for r in rows], np.int64)[order],
            np.searchsorted(term[order], np.arange(len(vocabulary) + 1)),
        )


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_key, item_id, term, times) of the distinct items."""
    rows = items.select(q(id_column).alias("item_id"), q(text_column).cast("string").alias("text")).distinct()
    key = F.sha2(F.to_json(F.struct("item_id", "text"), {"ignoreNullFields": "false"}), 256)
    rows = rows.select(key.alias("item_key"), "item_id", F.col("text").cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(text)) for text in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    pa.array([t for c in found for t in c], pa.binary()),
                    pa.array([n for c in found for n in c.values()], pa.int64()),
                ],
                names=["item_key", "item_id", "term", "times"],
            )

    kind = T.StructType(
        [
            T.StructField("item_key", T.StringType()),
            rows.schema["item_id"],
            T.StructField("term", T.BinaryType()),
            T.StructField("times", T.LongType()),
        ]
    )
    return rows.mapInArrow(counted, kind)


def bags(docs: DataFrame, vocabulary, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term; ``terms`` ascend.

    ``vocabulary`` is a broadcast dictionary from terms to numbers.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        size = len(vocabulary.value)
        for batch in batches:
            for part in chunks(batch.column(1)):
                rows = batch.slice(part.start, part.stop - part.start)
                words = [terms_of(text) for text in rows.column(1).to_pylist()]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                term = np.fromiter(
                    map(number, chain.from_iterable(words), repeat(-1)), np.int64, int(lengths.sum())
                )
                doc = np.repeat(np.arange(len(words)), lengths)[term >= 0]
                both, times = np.unique(doc * size + term[term >= 0], return_counts=True)
                ends = np.searchsorted(both, np.arange(len(words) + 1) * size).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                    for flat in (both % max(size, 1), times)
                ]
                kept = pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(lengths), *lists], names=["doc_id", "n", "terms", "counts"]
                )
                yield kept.filter(pa.array(lengths > 0))

    rows = docs.select(q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, counts array<int>")


class Best:
    """The best classes of each item so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.least = np.ones(len(items.ids))
        self.held: list[tuple] = []

    def scores(self, m: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Class by item; all sums are exact (see ``search``)."""
        row = np.repeat(np.arange(len(m)), sizes)
        tf = counts.astype(np.int64)
        gain = self.weights[terms] * (1_000_000_000 * tf // (1_000 * tf + 8 * m[row]))
        begin, width = self.items.starts[terms], np.diff(self.items.starts)[terms]
        out = np.zeros(len(m) * len(self.items.ids))
        # postings of at most about CELLS at once
        for part in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(np.cumsum(width) // CELLS)) + 1):
            at = gathered(np.arange(len(self.items.item)), begin[part], width[part])
            cell = np.repeat(row[part], width[part]) * len(self.items.ids) + self.items.item[at]
            out += np.bincount(cell, np.repeat(gain[part], width[part]) * self.items.times[at], len(out))
        return out.reshape(len(m), -1)

    def add(self, batch: pa.RecordBatch) -> None:
        """A batch of classes: first, bag, m, terms, counts."""
        lists = batch.column(3), batch.column(4)
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        m = batch.column(2).to_numpy(zero_copy_only=False)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        score = self.scores(m, *flat, sizes)
        row, item = np.nonzero(score >= self.least)
        if not len(row):
            return
        taken = batch.take(pa.array(np.unique(row))).to_pylist()
        place = np.searchsorted(np.unique(row), row)
        new = [(i, s, taken[p]) for i, s, p in zip(item.tolist(), score[row, item].tolist(), place.tolist(), strict=True)]
        order = sorted(self.held + new, key=_order)
        self.held, n, last = [], 0, None
        for found in order:
            n = n + 1 if found[0] == last else 1
            last = found[0]
            if n <= self.k:
                self.held.append(found)
                if n == self.k:
                    self.least[last] = found[1]


def _order(found: tuple) -> tuple:
    item, score, row = found
    return item, -score, row["first"] is None, row["first"]


def best_classes(classes: DataFrame, items, weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, first, bag, m, terms, counts): at least the k best classes
    of each item, at most k from a task."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items.value, weights, k)
        step = max(1, CELLS // max(1, len(items.value.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                best.add(batch.slice(at, step))
        for at in range(0, len(best.held), 1_000):
            part = best.held[at : at + 1_000]
            yield pa.RecordBatch.from_pylist(
                [{"item": i, "score": int(s), **row} for i, s, row in part], schema=schema
            )

    rows = classes.select("first", "bag", "m", "terms", "counts")
    schema = pa.schema(
        [("item", pa.int32()), ("score", pa.int64()), ("first", pa.int64()), ("bag", pa.int64()), ("m", pa.int64())]
        + [(name, pa.list_(pa.int32())) for name in ("terms", "counts")]
    )
    kind = "item int, score long, first long, bag long, m long, terms array<int>, counts array<int>"
    return rows.mapInArrow(scored, kind)


def _search_block(docs: DataFrame, rows: list, kind: T.DataType, k: int, id_column: str, text_column: str) -> DataFrame | None:
    spark = docs.sparkSession
    items = Items.of(rows)
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    found = stored(bags(docs, vocabulary, id_column, text_column), "bags")
    total, length = found.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    held = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    holders = np.zeros(len(items.vocabulary), np.int64)
    holders[[r.term for r in held]] = [r["count"] for r in held]
    weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in holders.tolist()]
    weights = np.array(weights, np.int64)
    longest = np.bincount(items.item, items.times).max()
    if 1_000_000.0 * weights.max() * longest >= _EXACT:
        raise ValueError("an item of too many terms for exact sums")
    m = F.expr(f"25 + (75 * n * {total}L) div {length}L")
    marked = found.where("size(terms) > 0").withColumn("m", m)
    marked = marked.withColumn("bag", F.xxhash64("m", "terms", "counts"))
    same = ["bag", "m", "terms", "counts"]
    classes = stored(marked.groupBy(*same).agg(F.min("doc_id").alias("first")), "bag-classes")
    best = best_classes(classes, spark.sparkContext.broadcast(items), weights, k)
    ordered = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    best = best.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k)
    best = stored(best.drop("first", "place"), "best-classes")
    # Of a class only the k smallest ids can be wanted. Tasks drop the others
    # before the shuffle, so a class of a third of all rows is a few rows a task.
    smallest = Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id"))
    members = marked.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k)
    hits = best.join(members.select(*same, "doc_id"), same)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    named = spark.createDataFrame(list(enumerate(items.ids)), names)
    return hits.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    block_terms: int = 100_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest scores above 0.

    ``block_terms`` bounds the terms (distinct in each item) that are sent to all
    tasks at once. An item whose terms could add up to 2^53 raises ValueError.
    """
    wanted = stored(item_terms(items, item_id_column, item_text_column), "item-terms")
    kind = wanted.schema["item_id"].dataType
    blocks = groups_for(wanted.count(), block_terms)
    block = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
    parts = []
    for number in range(blocks):
        rows = wanted.where(block == number).collect()
        part = _search_block(docs, rows, kind, k, id_column, text_column) if rows else None
        if part is not None:
            parts.append(part)
    if not parts:
        empty = T.StructType([T.StructField("item_id", kind)])
        nothing = docs.sparkSession.createDataFrame([], empty)
        return nothing.selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

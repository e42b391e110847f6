"""Similarity join of documents on word shingles by chosen paths.

A document's set holds the hashes of its runs of ``words`` words (lower case,
cut at white space; a shorter text is one run). Documents of equal sets are one
class of copies with one representative.

Search: each representative has a signature of ``SIZE`` minimum hashes, the
tokens of the paths. A run starts with all sets in one bucket; a bucket chooses
one of its token places, and a second with chance ``1/similarity - 1``, so a pair
at the similarity keeps on average one common path; the values there name the
buckets below. A bucket of at most ``bucket`` sets is compared by brute force,
a larger one splits again, up to ``depth`` times. Runs are repeated until a pair at
the similarity meets with a chance of ``recall`` even where all its buckets split
that often (see ``runs_for``). A bucket that paths can't split (near
copies share them all) is compared in pairs of blocks, each its own task.

Nothing is emitted per pair: a bucket gives a spanning forest of the pairs whose
signatures agree in ``likely`` places or more, and the components of these
forests are checked exactly: all sets of a component are intersected in blocks,
giving for each set the number of documents it is linked to and a spanning
forest of the exact links. Classes are the components of those.

Cases: null, empty and blank texts have no set, link to nothing and are their own
class; repeated rows are copies; a null id is ignored when a class is named by
its smallest id; other columns pass by; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.tables import fresh, q, stored

SIZE = 64
_MASK = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, _MASK, n, np.uint64, endpoint=True) | np.uint64(1)


_PLACES, _SCALES, _SHIFTS = _odd(64, 1), _odd(SIZE, 2), _odd(SIZE, 3)


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is kept."""

    def __missing__(self, word: str) -> int:
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if len(self) > 400_000:
            self.clear()
        value = self[word] = int.from_bytes(digest, "little")
        return value


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's runs of words."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    n = min(words, len(found))
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    total = np.full(len(found) - n + 1, n, np.uint64)
    for place in range(n):
        total += each[place : len(found) - n + 1 + place] * _PLACES[place % len(_PLACES)]
        total ^= total >> np.uint64(29)
    total *= _PLACES[-1]
    return np.unique(total ^ total >> np.uint64(32))


def signature(found: np.ndarray) -> np.ndarray:
    """The upper halves of the minima of ``SIZE`` hashes of a set."""
    least = np.full(SIZE, _MASK, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096] * _SCALES[:, None] + _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_number(found: np.ndarray) -> int:
    digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, set, sig) of each document; set is null without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            numbers, signatures = [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words, hashes)
                numbers.append(set_number(found) if len(found) else None)
                signatures.append(signature(found))
            flat = np.concatenate(signatures) if signatures else np.empty(0, np.int32)
            ends = np.arange(len(signatures) + 1, dtype=np.int32) * SIZE
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(numbers, pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                names=["doc_id", "text_hash", "set", "sig"],
            )

    return docs.mapInArrow(made, "doc_id long, text_hash long, set long, sig array<int>")


def _below(rows: DataFrame, similarity: float) -> DataFrame:
    """(set, node) of the buckets below those of (set, node, sig)."""
    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SIZE)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SIZE - 1)).cast("int") + 1
    two = F.pmod(one + step, F.lit(SIZE))
    chance = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < (1 / similarity - 1) * (1 << 20)
    places = F.when(chance, F.array(one, two)).otherwise(F.array(one))
    chosen = rows.select("set", "node", "sig", F.explode(places).alias("place"))
    value = F.element_at("sig", F.col("place") + 1)
    return chosen.select("set", F.xxhash64("node", "place", value).alias("node"))


def leaves(sets: DataFrame, *, similarity: float, runs: int, bucket: int, depth: int) -> DataFrame:
    """(set, node, n): the buckets of two or more sets that split no further."""
    starts = F.explode(F.array(*(F.xxhash64(F.lit(f"run {r}")) for r in range(runs))))
    rows = _below(sets.select("set", "sig", starts.alias("node")), similarity)
    done = None
    for level in range(1, depth + 1):
        rows = stored(rows, "path-level")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sized = stored(rows.join(sizes, "node"), "path-sized")
        small = sized.where(F.col("n") <= bucket) if level < depth else sized
        done = small if done is None else done.unionByName(small)
        if level == depth or not sized.where(F.col("n") > bucket).limit(1).count():
            return done
        large = sized.where(F.col("n") > bucket).select("set", "node")
        rows = _below(large.join(sets.select("set", "sig"), "set"), similarity)
    return done


def in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows dealt to tasks by ``task``: a group, or a pair of blocks of a large one.

    ``side`` is the row's block; a row of a group of n blocks goes to n tasks.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    cut = rows.withColumn("blocks", blocks)
    cut = cut.withColumn("side", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64(group, F.least("side", "other"), F.greatest("side", "other"))
    return cut.withColumn("task", pair).drop("blocks", "other")


def by_task(
    rows: DataFrame, columns: list[str], work: Callable[[list], tuple | None], schema: str, names: list[str]
) -> DataFrame:
    """Give ``work`` the columns of one task's rows at a time.

    Rows are partitioned and sorted by ``task``, so one Python worker streams
    through many small tasks instead of starting a group for each.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[tuple]:
            if held and sum(b.num_rows for b in held) > 1:
                table = pa.Table.from_batches(held).combine_chunks()
                found = work([table.column(c + 1).combine_chunks() for c in range(len(columns))])
                if found is not None:
                    yield found
            held.clear()

        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(tasks[1:] != tasks[:-1]) + 1
            edges = [0, *cuts.tolist(), len(tasks)]
            out = []
            for begin, end in zip(edges, edges[1:], strict=False):
                if held and held[-1].column(0)[0].as_py() != tasks[begin]:
                    out += finish()
                held.append(batch.slice(begin, end - begin))
            if out:
                yield _batch(out)
        if out := [*finish()]:
            yield _batch(out)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dealt = rows.select("task", *columns).repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(streamed, schema)


def roots(linked: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Per row the least number of its component in a symmetric matrix of links."""
    label = np.argsort(np.argsort(numbers, kind="stable"), kind="stable")
    while True:
        lower = np.minimum(label, np.where(linked, label, len(label)).min(axis=1))
        if (lower == label).all():
            return np.sort(numbers)[label]
        label = lower


def _likely_forest(least: int) -> Callable[[list], tuple | None]:
    def forest(columns: list) -> tuple | None:
        numbers, sides = columns[0].to_numpy(), columns[1].to_numpy()
        sig = columns[2].flatten().to_numpy().reshape(len(numbers), SIZE)
        same = np.zeros((len(numbers), len(numbers)), np.uint8)
        for place in sig.T:
            same += place[:, None] == place
        linked = same >= least
        if sides.min() != sides.max():
            linked &= sides[:, None] != sides
        root = roots(linked, numbers)
        new = root != numbers
        return (numbers[new], root[new]) if new.any() else None

    return forest


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[inverse] > 1
    column, row = (np.cumsum(times > 1) - 1)[inverse[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total, width = np.zeros((len(sets), len(sets))), 4096
    ends = np.searchsorted(column, np.arange(0, (times > 1).sum() + width, width))
    for step, (begin, end) in enumerate(zip(ends, ends[1:], strict=False)):
        part = np.zeros((len(sets), width), np.float32)
        part[row[begin:end], column[begin:end] - step * width] = 1
        total += part @ part.T
    np.fill_diagonal(total, sizes)
    return total


def _exact_links(similarity: float) -> Callable[[list], tuple | None]:
    def links(columns: list) -> tuple | None:
        numbers, once = np.unique(columns[0].to_numpy(), return_index=True)  # rows may repeat
        if len(numbers) < 2:
            return None
        sides, copies = (c.to_numpy()[once] for c in columns[1:3])
        sets = _unpack(columns[3].take(pa.array(once)))
        sizes = np.array([len(s) for s in sets])
        both = common(sets)
        linked = both / (sizes[:, None] + sizes - both) >= similarity
        np.fill_diagonal(linked, False)
        if sides.min() != sides.max():
            linked &= sides[:, None] != sides
        count = linked @ copies.astype(np.int64)
        any_link = count > 0
        root = roots(linked, numbers)
        return (numbers[any_link], root[any_link], count[any_link]) if any_link.any() else None

    return links


def runs_for(similarity: float, depth: int, recall: float) -> int:
    """Runs by which a pair at the similarity meets with a chance of ``recall``.

    A bucket splits by one token, by a second with chance ``1/similarity - 1``, and
    a pair shares a token with the chance of its similarity: a branching process,
    whose chance to have died out after ``depth`` splits is that of one miss. Runs
    share signatures, so misses are not quite independent; the runs for half the
    chance to miss are taken, which measured recall bears out (see the README).
    """
    second, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        below = 1 - similarity + similarity * lost
        lost = (1 - second) * below + second * below**2
    return 1 if lost <= 0 else max(1, math.ceil(math.log((1 - recall) / 2) / math.log(lost)))


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id, n_links (documents similar to it), n_copies.

    ``class_id`` is the smallest id of the documents that links connect; copies
    count as links. Options are those of ``classified``.
    """
    return classified(df, **options).select("doc_id", "class_id", "n_links", "n_copies")


def classified(
    df: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    recall: float = 0.99,
    bucket: int = 128,
    depth: int = 5,
    likely: float = 0.6,
    block: int = 1024,
) -> DataFrame:
    """As ``near_duplicates``, with text_hash and ``class``, a number of the class
    (null for texts without words)."""
    runs = runs_for(similarity, depth, recall)
    texts = df.select(q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text"))
    docs = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    records = stored(_sets(docs, words), "shingle-sets")
    sets = stored(
        records.where("set IS NOT NULL")
        .groupBy("set")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"),
            F.count("*").alias("copies"),
            F.first("sig").alias("sig"),
        ),
        "set-classes",
    )
    met = leaves(sets, similarity=similarity, runs=runs, bucket=bucket, depth=depth)
    met = met.join(sets.select("set", "sig"), "set")
    forest = by_task(
        in_blocks(met, "node", "n", block),
        ["set", "side", "sig"],
        _likely_forest(round(likely * SIZE)),
        "a long, b long",
        ["a", "b"],
    )
    near = stored(components(forest), "likely-components")
    sizes = near.groupBy("label").agg(F.count("*").alias("n"))
    members = near.join(sizes, "label").withColumnRenamed("node", "set")
    members = members.join(sets.drop("sig"), "set")
    checked = _with_shingles(members, docs, words)
    links = stored(
        by_task(
            in_blocks(checked, "label", "n", block // 2),
            ["set", "side", "copies", "shingles"],
            _exact_links(similarity),
            "a long, b long, links long",
            ["a", "b", "links"],
        ),
        "exact-links",
    )
    label = components(links)
    linked = links.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    classes = (
        sets.drop("sig", "text_hash")
        .join(label.withColumnRenamed("node", "set"), "set", "left")
        .join(linked, "set", "left")
        .withColumn("label", F.coalesce("label", "set"))
    )
    classes = stored(classes, "set-labels")
    named = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(named, "label").select("set", "label", "class_id", "copies", "links")
    found = records.select("doc_id", "text_hash", "set").join(classes, "set", "left")
    return found.select(
        "doc_id",
        "text_hash",
        F.col("label").alias("class"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def _with_shingles(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Members with their sets, made again from the representatives' texts."""
    wanted = members.withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_hash", "own_hash")
    same = (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    # Texts are dealt by their hash for any number of members, so the plan, and
    # with it the need for disk, is the same at every size.
    rows = docs.join(stored(wanted, "set-members").hint("merge"), same)
    rows = rows.select("set", "label", "n", "copies", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(text.as_py(), words, hashes).tobytes() for text in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(found, pa.binary())],
                names=["set", "label", "n", "copies", "shingles"],
            )

    return rows.mapInArrow(made, "set long, label long, n long, copies long, shingles binary")


def without_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """``df`` with one document of each class: that of its smallest id, of equal
    ids that of the smallest hash of its text.

    Rows are told apart by id and text, so another text under the id of a copy
    stays, and a class of null ids is one document too. Of rows that repeat id
    and text one stays; but texts without words are no copies of each other, and
    those of a null id all stay. Columns of any name pass by.
    """
    names = (options.get("id_column", "doc_id"), options.get("text_column", "text"))
    found = stored(classified(df, **options).select("doc_id", "text_hash", "class"), "document-classes")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = found.where("class IS NOT NULL").groupBy("class").agg(F.min(row).alias("chosen"))
    told = found.join(chosen, "class").where(~row.eqNullSafe(F.col("chosen")))
    twice = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("class").alias("class"))
    twice = twice.where("n > 1 AND (doc_id IS NOT NULL OR class IS NOT NULL)")
    fates = told.select("doc_id", "text_hash", F.lit(True).alias("gone")).distinct()
    fates = fates.unionByName(twice.select("doc_id", "text_hash", F.lit(False).alias("gone")))
    fates = fates.groupBy("doc_id", "text_hash").agg(F.max("gone").alias("gone"))
    own = fresh(df, "doc_key", "no_key", "text_hash")

    def keys(doc_id: Column, text_hash: Column) -> dict[str, Column]:
        return dict(zip(own, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text_hash), strict=True))

    marked = df.withColumns(keys(q(names[0]).cast("long"), F.xxhash64(q(names[1]).cast("string"))))
    fates = stored(
        fates.withColumns(keys(F.col("doc_id"), F.col("text_hash"))).select(*own, "gone"), "document-fates"
    )
    # Both joins meet the documents in one exchange of their texts, at every size.
    once = marked.join(fates.hint("merge"), own, "left_anti")
    again = marked.join(fates.where("NOT gone").hint("merge"), own, "left_semi").dropDuplicates(own)
    return once.unionByName(again).drop(*own)

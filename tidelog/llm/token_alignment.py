"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

Both vocabularies encode the text after one space. Byte offsets at which a token
of each ends cut the text into groups, and the two tokens that end there are
linked. How often a pair of ids is linked in all documents is counted by a
minimal perfect hash: a first pass tallies the pairs of each task, the distinct
ones are hashed in shards, tallies become dense vectors indexed by the hash, and
the vectors are summed in a tree. A second pass aligns the documents again and
looks the counts up; the hash is checked against the stored pair, so no foreign
pair can be counted.

Neither tokenizer has a token over a single space between two characters that
are no white space, so words are aligned alone and equal words once for each
table of words. Other texts are aligned whole. Alignment is cheap beside that,
which is why it is made anew in the second pass instead of kept.

A pair of ids is one of at most |A| x |B| (1.6 billion here), however large the
corpus. What a task holds is bounded by ``resident_pairs``: where there are more
distinct pairs, hash, counts and passes are cut into as many slices.

Cases: a text that is null, empty, or whose joined token bytes differ from space
and text has no tokens: zeros and an empty string; repeated rows and null ids are
rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidelog.llm.perfect_hash import PerfectHash, build, lot
from tidelog.llm.sentence_pieces import MARK
from tidelog.llm.tables import groups_for, q, stored
from tidelog.llm.tokens import Encoder, unsure
from tidelog.llm.words import WordTable, chunks, gathered, sums

SHARD_PAIRS = 50_000
RESIDENT_PAIRS = 4_000_000
TALLY = 500_000
TABLE_WORDS = 1_000_000
WORDS_OF_A = 200_000  # that the byte-level encoder keeps for itself, twice
CHUNK_BYTES = 2_000_000  # of text that is worked on at once
CHUNK = 8_192  # counts in one row of a vector
FAN = 64  # vectors that a step of the tree sums
_SHIFT = 32


class Vocabulary:
    """Ids and the bytes of each."""

    def __init__(self, raw: list[bytes]):
        self.lengths = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.raw, self.starts[ids], self.lengths[ids])


class Aligner:
    """Aligns words (each after one space) by a byte-level and a piece vocabulary."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Encoder(byte_path, WORDS_OF_A, plain=True)
        self.a_bytes = Vocabulary(self.a.token_bytes())
        self.b = model = SentencePieceProcessor(model_file=piece_path)
        raw = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i)
            one = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(MARK, " ").encode()
            raw.append(b"" if special else one)
        self.b_bytes = Vocabulary(raw)
        text = [str(i) for i in range(max(len(self.a_bytes.lengths), len(raw)))]
        # behind a token: within its side, at the end of it, and of a word
        self.written = [t + mark for mark in (",", "|", ";", "") for t in text]
        self.most = len(text)

    def _odd_ids(self, word: str) -> bytes:
        """Ids of a word that has its space, or line breaks."""
        if word[0] == " ":
            return self.a.whole(word)
        first, *rest = word.split("\n")
        return self.a[first] + b"".join([self.a[f"\n{part}"] for part in rest])

    def byte_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The byte-level ids of words and of their space, and their words."""
        self.a.make_room()
        kept, odd = self.a.__getitem__, self._odd_ids
        found = [odd(w) if w[0] == " " or "\n" in w else kept(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4").astype(np.int64), np.repeat(np.arange(len(words)), counts)

    def align(self, words: list[str]) -> dict[str, np.ndarray]:
        """Of all words, one after the other: ``a`` and ``b`` ids with their
        words, the tokens that end groups, and which words are sound."""
        a, a_word = self.byte_ids(words)
        spaced = any(w[0] == " " for w in words)
        found = self.b.encode([w.removeprefix(" ") for w in words] if spaced else words, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        b_word = np.repeat(np.arange(len(found)), counts)
        if spaced:
            texts = [(w if w[0] == " " else f" {w}").encode() for w in words]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            wanted = np.frombuffer(b"".join(texts), np.uint8)
        else:  # the only spaces are those before words
            wanted = np.frombuffer(f" {' '.join(words)}".encode(), np.uint8)
            size = np.diff(np.append(np.flatnonzero(wanted == 32), len(wanted)))
        sound = np.ones(len(words), bool)
        for ids, word, table in ((a, a_word, self.a_bytes), (b, b_word, self.b_bytes)):
            have = np.bincount(word, table.lengths[ids], len(words)).astype(np.int64)
            sound &= have == size
        for ids, word, table in ((a, a_word, self.a_bytes), (b, b_word, self.b_bytes)):
            where = np.repeat(np.arange(len(words)), size)
            here = sound[where]
            wrong = table.bytes_of(ids[sound[word]]) != wanted[here]
            sound[where[here][wrong]] = False
        a, a_word = a[sound[a_word]], a_word[sound[a_word]]
        b, b_word = b[sound[b_word]], b_word[sound[b_word]]
        # the words' bytes lie in a row, so their ends are offsets of both
        _, a_last, b_last = np.intersect1d(
            np.cumsum(self.a_bytes.lengths[a]), np.cumsum(self.b_bytes.lengths[b]), assume_unique=True, return_indices=True
        )
        return {"a": a, "a_word": a_word, "b": b, "b_word": b_word, "a_last": a_last, "b_last": b_last, "sound": sound}

    def groups_text(self, found: dict[str, np.ndarray]) -> list[str]:
        """Each word's groups as ``a1,a2|b1;a3|b2``."""
        n = len(found["sound"])
        parts = []
        for side, (ids, word, last) in enumerate(
            (found[x], found[f"{x}_word"], found[f"{x}_last"]) for x in ("a", "b")
        ):
            ends = np.zeros(len(ids), bool)
            ends[last] = True
            group = np.cumsum(ends) - ends
            final = ends.copy()
            final[:-1] &= word[1:] != word[:-1]
            mark = np.where(ends, 1 if side == 0 else np.where(final, 3, 2), 0)
            parts.append((2 * group + side, mark * self.most + ids, word))
        order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        code = np.concatenate([p[1] for p in parts])[order]
        stops = np.cumsum(np.bincount(np.concatenate([p[2] for p in parts]), minlength=n)).tolist()
        text = list(map(self.written.__getitem__, code.tolist()))
        return ["".join(text[i:j]) for i, j in zip([0, *stops], stops)]


def words_of(text: str | None) -> list[str]:
    """A text's words without their space; one that can't be cut for sure is a
    word as a whole, with its space."""
    if not text:
        return []
    return [f" {text}"] if unsure(text) else text.split(" ")


class WordPairs:
    """The linked pairs (or what ``of`` makes of them) of words, by word."""

    def __init__(self, aligner: Aligner, of=None, written: bool = False):
        self.aligner, self.of, self.written = aligner, of, written
        self.table = WordTable(self.make, TABLE_WORDS)
        self.table.on_clear = self.clear
        self.clear()

    def clear(self) -> None:
        self.sound = np.zeros(0, bool)
        self.n_a = self.n_b = np.zeros(0, np.int64)
        self.texts: list[str] = []

    def make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.aligner.align(words)
        n = len(words)
        self.sound = np.concatenate([self.sound, found["sound"]])
        self.n_a = np.concatenate([self.n_a, np.bincount(found["a_word"], minlength=n)])
        self.n_b = np.concatenate([self.n_b, np.bincount(found["b_word"], minlength=n)])
        if self.written:
            self.texts += self.aligner.groups_text(found)
        pairs = found["a"][found["a_last"]] << _SHIFT | found["b"][found["b_last"]]
        counts = np.bincount(found["a_word"][found["a_last"]], minlength=n)
        return (pairs if self.of is None else self.of(pairs)), counts

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts that have tokens, and how many each text has."""
        words = [words_of(text) for text in texts]
        found = self.table.look_up([w for each in words for w in each])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        whole = sums((~self.sound[found]).astype(np.int64), counts) == 0
        return found[np.repeat(whole, counts)], np.where(whole, counts, 0)


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in chunks(batch.column(column), CHUNK_BYTES):
        rows = batch.slice(part.start, part.stop - part.start)
        yield rows, rows.column(column).to_pylist()


def _tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    known, at = np.unique(pairs, return_inverse=True)
    return known, np.bincount(at, times, len(known)).astype(np.int64)


def tallies(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(pairs, times): the pairs linked in each task's share of (doc_id, text),
    and how often, in rows of at most about ``TALLY`` pairs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordPairs(aligner(*paths))
        held, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for _, texts in _texts(batch, 1):
                numbers, times = np.unique(words.of_texts(texts)[0], return_counts=True)
                table = words.table
                lengths = table.lengths[numbers]
                held.append((gathered(table.flat, table.starts[numbers], lengths), np.repeat(times, lengths)))
                waiting += len(held[-1][0])
                if waiting > TALLY:
                    held, waiting = [_tallied(held)], 0
                    if len(held[0][0]) > TALLY:
                        yield _row(*held.pop())
                        held.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        yield _row(*_tallied(held))

    def _row(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pairs": pa.array([pairs]), "times": pa.array([times])}, schema=schema)

    schema = pa.schema([("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    return docs.mapInArrow(found, "pairs array<long>, times array<long>")


def distinct_pairs(tallied: DataFrame) -> DataFrame:
    """(pair, lot) of all tallies; ``lot`` deals pairs to shards."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lots = lot(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lots)], names=["pair", "lot"])

    pairs = tallied.select(F.explode("pairs").alias("pair")).distinct()
    return pairs.mapInArrow(dealt, "pair long, lot int")


def hashed_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, n, sizes, bits, keys): the perfect hash of each shard."""

    def built(key: tuple, table: pa.Table) -> pa.Table:
        sizes, bits, keys = build(np.sort(table.column("pair").to_numpy()))
        row = {"shard": key[0].as_py(), "n": len(keys), "sizes": sizes, "bits": bits, "keys": keys.tobytes()}
        return pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())]
    )
    shard = F.expr(f"CAST(lot * {shards}L div 65536 AS int)")
    return (
        pairs.select(shard.alias("shard"), "pair")
        .groupBy("shard")
        .applyInArrow(built, "shard int, n long, sizes array<long>, bits binary, keys binary")
    )


def tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """(chunk, counts) from (part, chunk, counts): vectors summed ``FAN`` at a time."""

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for raw in table.column("counts"):
            total += np.frombuffer(raw.as_buffer(), np.int64)
        row = {"part": key[1].as_py(), "chunk": key[0].as_py(), "counts": total.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())]))

    while parts > 1:
        up = F.expr(f"CAST(part div {FAN} AS int)")
        vectors = vectors.withColumn("part", up).groupBy("chunk", "part").applyInArrow(added, "part int, chunk int, counts binary")
        parts = -(-parts // FAN)
    return vectors.select("chunk", "counts")


def counted(tallied: DataFrame, hashed, parts: int) -> DataFrame:
    """(chunk, counts) of the pairs of a slice; ``hashed`` is broadcast."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(hashed.value.keys), np.int64)
        for batch in batches:
            pairs, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            at = hashed.value.numbers(pairs)
            np.add.at(counts, at[at >= 0], times[at >= 0])
        part = TaskContext.get().partitionId()
        for chunk in range(-(-len(counts) // CHUNK)):
            piece = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
            if piece.any():
                padded = np.pad(piece, (0, CHUNK - len(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([padded.tobytes()], pa.binary())],
                    names=["part", "chunk", "counts"],
                )

    return tree_sum(tallied.mapInArrow(found, "part int, chunk int, counts binary"), parts)


def looked_up(docs: DataFrame, paths: tuple[str, str], tables, last: bool) -> DataFrame:
    """Adds a slice's counts; the last slice also gives the alignment itself.

    ``tables`` is broadcast: the slice's hash, its counts, and the highest count
    of each B id.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts, best = tables.value

        def numbers(pairs: np.ndarray) -> np.ndarray:
            at = hashed.numbers(pairs)
            count = np.where(at >= 0, counts[at], 0)
            top = (at >= 0) & (count == best[pairs & 0xFFFFFFFF])
            return count << 1 | top

        words = WordPairs(aligner(*paths), numbers, written=last)
        for batch in batches:
            for rows, texts in _texts(batch, 1):
                number, n = words.of_texts(texts)
                table = words.table
                each = table.lengths[number]
                values = gathered(table.flat, table.starts[number], each)
                links = sums(each, n)
                scored = {
                    "n_best": sums(values & 1, links) + rows.column(2).to_numpy(zero_copy_only=False),
                    "count_sum": sums(values >> 1, links) + rows.column(3).to_numpy(zero_copy_only=False),
                }
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), *map(pa.array, scored.values())], names=names
                    )
                    continue
                written, stops = list(map(words.texts.__getitem__, number.tolist())), np.cumsum(n).tolist()
                groups = [";".join(written[i:j]) for i, j in zip([0, *stops], stops)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        *(pa.array(x) for x in (sums(words.n_a[number], n), sums(words.n_b[number], n), links, links)),
                        *map(pa.array, scored.values()),
                        pa.array(groups, pa.string()),
                    ],
                    names=names,
                )

    kind = "doc_id long, text string, n_best long, count_sum long"
    if last:
        kind = (
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        )
    names = [field.split()[0] for field in kind.split(", ")]
    return docs.mapInArrow(found, kind)


def align(
    df: DataFrame,
    *,
    byte_vocabulary: str,
    piece_model: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    resident_pairs: int = RESIDENT_PAIRS,
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``n_best`` counts the links whose pair is the most frequent of its B id,
    ``groups`` is the alignment written as ``a1,a2|b1;a3|b2,b3``. As no token is
    without bytes, each group has one link.
    """
    paths = (byte_vocabulary, piece_model)
    spark = df.sparkSession
    docs = df.select(q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text"))
    tallied = stored(tallies(docs, paths), "pair-tallies")
    pairs = stored(distinct_pairs(tallied), "pairs")
    shards = min(65_536, groups_for(pairs.count(), SHARD_PAIRS))
    hashes = stored(hashed_shards(pairs, shards), "pair-hashes")
    parts = tallied.rdd.getNumPartitions()
    slices = _slices(hashes, resident_pairs)
    best = np.zeros(SentencePieceProcessor(model_file=piece_model).get_piece_size(), np.int64)
    vectors = []
    for begin, end in slices:
        hashed = _hash_of(hashes, begin, end, shards)
        sent = spark.sparkContext.broadcast(hashed)
        vectors.append(stored(counted(tallied, sent, parts), "pair-counts"))
        sent.unpersist()
        np.maximum.at(best, hashed.keys & 0xFFFFFFFF, _counts_of(vectors[-1], len(hashed.keys)))
    out = docs.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for number, (begin, end) in enumerate(slices):
        hashed = _hash_of(hashes, begin, end, shards)
        sent = spark.sparkContext.broadcast((hashed, _counts_of(vectors[number], len(hashed.keys)), best))
        last = number == len(slices) - 1
        out = looked_up(out, paths, sent, last)
        if not last:
            out = stored(out, "aligned")
    return out


def _slices(hashes: DataFrame, resident: int) -> list[tuple[int, int]]:
    """Ranges of shards with at most ``resident`` pairs (one shard at least)."""
    sizes = sorted((r.shard, r.n) for r in hashes.select("shard", "n").collect())
    out, begin, held = [], 0, 0
    for shard, n in sizes:
        if held and held + n > resident:
            out.append((begin, shard))
            begin, held = shard, 0
        held += n
    return [*out, (begin, 65_536)]


def _hash_of(hashes: DataFrame, begin: int, end: int, shards: int) -> PerfectHash:
    rows = hashes.where(F.col("shard").between(begin, end - 1)).collect()
    return PerfectHash.of(shards, [(r.shard, r.sizes, bytes(r.bits), bytes(r["keys"])) for r in rows])


def _counts_of(vectors: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(-(-n // CHUNK) * CHUNK, np.int64)
    for row in vectors.collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out[:n]

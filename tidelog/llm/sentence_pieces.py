"""SentencePiece encoding by merge rounds over all words at once.

A byte-pair model joins, again and again, the neighbouring symbols whose joined
piece has the highest score, the leftmost of equals. No piece has a space mark
behind another character, so words (a run of space marks and what follows) are
merged alone, and equal words alike.

The symbols of all new words lie in one flat array. In a round every pair's rank
is looked up, the least rank of each word found by a segmented minimum, and all
pairs of that rank are joined, of overlapping ones the leftmost. Words without a
pair leave the arrays; rounds end when none is left. Joining several pairs at
once is what joining them one by one gives unless a new pair ranks as high as
the joined ones; words where that happens, and words with pairs left after
``ROUNDS`` rounds, are merged one pair at a time by an agenda.

Cases: a null or empty text has no ids; a text is never cut; characters that the
model lacks become the ids of their bytes; rows are kept as they are, repeated
ones too, with null ids and in an empty table; other columns pass by ``decode``
and are dropped by ``encode``; ids that are no ids of the model raise ValueError.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from tidelog.llm.tables import q
from tidelog.llm.words import WordTable, chunks, gathered, runs, sums

# Fixed value: how a model writes a space.
MARK = "▁"
NONE = np.int32(2**31 - 1)
ROUNDS = 64
CHUNK_IDS = 250_000  # decoded at once
_BITS = 21  # of a symbol: an id, or behind all ids a character of its own
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class Pieces:
    """A model's pieces, and the pairs of symbols that join to one."""

    def __init__(self, path: str):
        self.model = model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(self.size)]
        byte = [model.is_byte(i) for i in range(self.size)]
        if sum(byte) != 256 or any(map(model.is_unused, range(self.size))):
            raise ValueError("only models with byte pieces and without unused ones are supported")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = [i for i in range(self.size) if not special[i] and not byte[i]]
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece of this model goes over words")
        self._bytes(names, special, byte)
        self._pairs(names, normal)
        self.words = WordTable(self.merge)

    def _bytes(self, names: list[str], special: list[bool], byte: list[bool]) -> None:
        raw = [
            b"" if special[i] else bytes([int(name[3:5], 16)]) if byte[i] else name.replace(MARK, " ").encode()
            for i, name in enumerate(names)
        ]
        self.special = np.array(special)
        self.marked = np.array([name.startswith(MARK) for name in names])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(b) for b in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths

    def _pairs(self, names: list[str], normal: list[int]) -> None:
        known = {names[i]: i for i in normal}
        self.symbols = self.size + np.arange(0x110000, dtype=np.int32)
        for name, i in known.items():
            if len(name) == 1:
                self.symbols[ord(name)] = i
        scores = {-self.model.get_score(i) for i in normal}
        ranks = {score: rank for rank, score in enumerate(sorted(scores))}
        keys, rank, joined = [], [], []
        for name, i in known.items():
            for cut in range(1, len(name)):
                left, right = (
                    int(self.symbols[ord(part)]) if len(part) == 1 else known.get(part)
                    for part in (name[:cut], name[cut:])
                )
                if left is not None and right is not None:
                    keys.append(left << _BITS | right)
                    rank.append(ranks[-self.model.get_score(i)])
                    joined.append(i)
        self._place(np.array(keys, np.int64), np.array(rank, np.int32), np.array(joined, np.int32))

    def _place(self, keys: np.ndarray, ranks: np.ndarray, joined: np.ndarray) -> None:
        """Pairs in an open table of at least eight slots a pair."""
        bits = max(4, int(8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.joined = np.full(1 << bits, NONE), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            mine = free[first]
            for table, values in ((self.keys, keys), (self.ranks, ranks), (self.joined, joined)):
                table[slot] = values[left[mine]]
            rest = np.ones(len(left), bool)
            rest[mine] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        spread = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and piece of pairs of symbols."""
        key = left.astype(np.int64) << _BITS | right
        at = self._slot(key)
        held = self.keys[at]
        other = np.flatnonzero((held != key) & (held >= 0))
        while len(other):  # taken by another pair: one slot on
            at[other] = (at[other] + 1) & self.mask
            held = self.keys[at[other]]
            other = other[(held != key[other]) & (held >= 0)]
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.joined[at]

    def _neighbours(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, joined = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int32)
        rank[:-1], joined[:-1] = self.look(symbol[:-1], symbol[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
        return rank, joined

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, joined, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol, word = self.symbols[letters], np.repeat(np.arange(len(words)), lengths)
        rank, joined = self._neighbours(symbol, word)
        done = [(word[:0], symbol[:0])]
        for turn in range(ROUNDS + 1):
            if not len(symbol):
                break
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(word)))
            live = np.repeat(least < NONE, size)
            done.append((word[~live], symbol[~live]))
            symbol, word, rank, joined = (x[live] for x in (symbol, word, rank, joined))
            low = np.repeat(least, size)[live]
            if turn == ROUNDS or not len(symbol):
                done += [self.one_by_one(symbol[word == w], w) for w in np.unique(word)]
                break
            left = _leftmost(rank == low)
            new, kept = symbol.copy(), np.ones(len(symbol), bool)
            new[left], kept[left + 1] = joined[left], False
            apart = self._out_of_turn(symbol, word, joined, low, left, new, kept)
            if len(apart):
                done += [self.one_by_one(symbol[word == w], w) for w in apart]
                kept &= ~np.isin(word, apart)
            symbol, word = new[kept], word[kept]
            rank, joined = self._neighbours(symbol, word)
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._with_bytes(word[order], symbol[order], len(words))

    def _out_of_turn(self, symbol, word, joined, low, left, new, kept) -> np.ndarray:
        """Words of several joins in which a new pair comes before one of them."""
        several = np.bincount(word[left], minlength=int(word[-1]) + 1)[word[left]] > 1
        left = left[several]
        if not len(left):
            return left
        at = (np.cumsum(kept) - 1)[left]
        after, where = new[kept], word[kept]
        early = np.zeros(len(left), bool)
        for a, b in ((at, np.minimum(at + 1, len(after) - 1)), (np.maximum(at - 1, 0), at)):
            rank, _ = self.look(after[a], after[b])
            early |= (a != b) & (where[a] == where[b]) & (rank <= low[left])
        # the next join's left symbol stands beside this one for a while
        beside = np.minimum(left + 2, len(symbol) - 1)
        for_now, _ = self.look(joined[left], symbol[beside])
        early |= (word[beside] == word[left]) & (beside == left + 2) & (for_now <= low[left])
        return np.unique(word[left][early])

    def one_by_one(self, symbols: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray]:
        """One word's symbols merged by an agenda of its pairs."""
        held = symbols.tolist()
        n = len(held)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, joined = self.look(symbols[:-1], symbols[1:])
        agenda = [
            (r, i, held[i], held[i + 1], j)
            for i, (r, j) in enumerate(zip(ranks.tolist(), joined.tolist(), strict=True))
            if r < NONE
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            at = after[i]
            if held[i] != left or at >= n or held[at] != right:
                continue
            held[i], held[at] = piece, None
            after[i] = after[at]
            if after[at] < n:
                before[after[at]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    (rank,), (piece,) = self.look(np.array([held[a]]), np.array([held[b]]))
                    if rank < NONE:
                        heapq.heappush(agenda, (int(rank), a, held[a], held[b], int(piece)))
        left = np.array([s for s in held if s is not None], np.int32)
        return np.full(len(left), word, np.int64), left

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word; characters without a piece as bytes."""
        missing = np.flatnonzero(symbol >= self.size)
        if len(missing):
            raw = [chr(c).encode() for c in (symbol[missing] - self.size).tolist()]
            width = np.ones(len(symbol), np.int64)
            width[missing] = [len(b) for b in raw]
            starts = (np.cumsum(width) - width)[missing]
            word, symbol = np.repeat(word, width), np.repeat(symbol, width)
            at = np.repeat(starts - np.cumsum(width[missing]) + width[missing], width[missing])
            symbol[at + np.arange(len(at))] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, np.bincount(word, minlength=n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and how many each has."""
        words = [_WORDS(self.model.normalize(text)) for text in texts]
        ids, lengths = self.words.values([w for each in words for w in each])
        return ids, sums(lengths, np.fromiter(map(len, words), np.int64, len(words)))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of stretches of ``counts`` ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id that the model lacks")
        lengths = self.raw_lengths[ids]
        raw = gathered(self.raw, self.raw_starts[ids], lengths).tobytes()
        ends = np.cumsum(counts)
        odd = sums(self.special[ids], counts)
        stops = np.cumsum(sums(lengths, counts)).tolist()
        texts, begin = [], 0
        for end, n, stop, strange in zip(ends.tolist(), counts.tolist(), stops, odd.tolist(), strict=True):
            skip = 1 if n and self.marked[ids[end - n]] else 0
            try:
                text = None if strange else raw[begin + skip : stop].decode()
            except UnicodeDecodeError:
                text = None
            texts.append(self.model.decode(ids[end - n : end].tolist()) if text is None else text)
            begin = stop
        return texts


def _leftmost(best: np.ndarray) -> np.ndarray:
    """Places of ``best`` pairs, every second one of those that overlap in a row."""
    at = np.arange(len(best))
    first = best.copy()
    first[1:] &= ~best[:-1]
    run = np.maximum.accumulate(np.where(first, at, 0))
    return np.flatnonzero(best & ((at - run) % 2 == 0))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each path and Python worker."""
    return Pieces(path)


def encode(df: DataFrame, *, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the model's ids of every whole text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            for part in chunks(batch.column(1)):
                texts = batch.column(1).slice(part.start, part.stop - part.start).to_pylist()
                ids, counts = table.encode([text or "" for text in texts])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                keys = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    docs = df.select(q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text"))
    return docs.mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(df: DataFrame, *, model: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """``df`` with the decoded text in ``text_column`` (null ids: null), which
    replaces a column of that name."""
    rest = df.drop(text_column)
    schema = T.StructType([*rest.schema.fields, T.StructField(text_column, T.StringType())])
    at = rest.columns.index(ids_column)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            for part in runs(batch.column(at).value_lengths().fill_null(0).to_pylist(), CHUNK_IDS):
                rows = batch.slice(part.start, part.stop - part.start)
                lists = rows.column(at)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = pa.array(table.decode(ids, counts), pa.string(), mask=np.asarray(lists.is_null()))
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], names=schema.names)

    return rest.mapInArrow(decoded, schema)

"""Language identification by cross-parsing.

A suffix automaton of some labelled text of each language says how long the
longest match of the next letters in that text is. Parsing a document into
longest matches gives few, long phrases in its own language and many short ones
in others. With ``phrases * log2(training letters) / letters`` languages of
unequal training text compare as bits a letter; the least wins, ties go to the
smaller name.

Letters are lower-cased, everything else is one space. Long texts are parsed in
stretches of ``STRETCH`` letters, all stretches of many documents side by side:
the automaton with its restarts is one table, so a step is one gather. All letters
of the training text have symbols; with many of them the table is kept sparse.

Training text is a sample by hash of at most ``letters`` characters a language
from the whole labelled table, in pieces of ``PIECE`` from anywhere in a text.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every
text if there are no labels. Letters that no training text has match nothing. With one
language the score is 1. Rows with a null label teach nothing. Repeated rows are
predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import fresh, q

UNDETERMINED = "und"
PIECE = 2_000
STRETCH = 256
TOGETHER = 2_000_000
# Symbols: filling after a stretch's end, white space and the like, foreign letters.
FILL, SPACE, FOREIGN, KNOWN = 0, 1, 2, 3
# Symbols up to which a language's steps are one dense table.
DENSE = 256

Sample = tuple[tuple[str, str], ...]


def training_sample(
    df: DataFrame, text: Column, label: Column, key: Column, letters: int = 30_000
) -> Sample:
    """(label, text) of at most ``letters`` characters a label, sorted by label.

    Only labels are grouped, so two small passes over the table; the second
    keeps about four times what is needed and collects that.
    """
    rows = df.select(
        label.cast("string").alias("label"),
        text.cast("string").alias("text"),
        F.xxhash64(key, text).alias("hash"),
    ).where("label IS NOT NULL AND text IS NOT NULL AND text <> ''")
    size = F.least(F.length("text"), F.lit(PIECE))
    totals = {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum(size)).collect()}
    if not totals:
        return ()
    share = F.create_map(
        *(F.lit(x) for name, n in totals.items() for x in (name, min(1.0, 4 * letters / n)))
    )
    begin = F.pmod("hash", F.greatest(F.lit(1), F.length("text") - PIECE)).cast("int") + 1
    kept = rows.where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < share[F.col("label")])
    texts: dict[str, str] = {}
    found = kept.select("label", "hash", F.substring("text", begin, F.lit(PIECE)).alias("text"))
    for row in sorted(found.collect(), key=lambda r: (r["hash"], r["text"])):
        held = texts.get(row["label"], "")
        if len(held) < letters:
            texts[row["label"]] = f"{held} {row['text']}"[:letters]
    return tuple(sorted(texts.items()))


class Symbols:
    """Characters to small numbers; equal for all languages."""

    def __init__(self, texts: list[str]):
        known = sorted({c for text in texts for c in text.lower() if c.isalpha()})
        self.size = KNOWN + len(known)
        self.kind = np.uint8 if self.size <= 1 << 8 else np.uint16 if self.size <= 1 << 16 else np.int32
        table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.table = np.where(table, FOREIGN, SPACE).astype(self.kind)
        for number, letter in enumerate(known, KNOWN):
            self.table[ord(letter)] = number
            if len(letter.upper()) == 1:
                self.table[ord(letter.upper())] = number
        # Letters whose lower case is several characters count as the first.
        for letter in {c for text in texts for c in text if c.isalpha()}:
            if self.table[ord(letter)] == FOREIGN:
                self.table[ord(letter)] = self.table[ord(letter.lower()[0])]

    def of(self, text: str) -> np.ndarray:
        """Symbols of a text, without doubled spaces; empty if it has no letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        found = self.table[points]
        blank = found == SPACE
        if blank.all():
            return found[:0]
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        return found[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        state = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in goto[at]:
            goto[at][symbol] = state
            at = link[at]
        if at != -1:
            after = goto[at][symbol]
            if length[after] == length[at] + 1:
                link[state] = after
            else:
                copy = len(goto)
                goto.append(dict(goto[after]))
                length.append(length[at] + 1)
                link.append(link[after])
                link[after] = link[state] = copy
                while at != -1 and goto[at].get(symbol) == after:
                    goto[at][symbol] = copy
                    at = link[at]
        last = state
    return goto


def parsing_table(goto: list[dict[int, int]], size: int) -> np.ndarray:
    """Next state times four plus the phrases that end, by state and symbol.

    Where a match can't go on, its phrase ends and the next begins with the
    symbol; a symbol that no text of the language has is a phrase by itself.
    """
    start = np.full(size, 1, np.int32)
    for symbol, state in goto[0].items():
        start[symbol] = 4 * state
    restart = np.where(start == 1, 2, start + 1).astype(np.int32)
    table = np.tile(restart, (len(goto), 1))
    table[0] = start
    for state, edges in enumerate(goto):
        if edges:
            table[state, list(edges)] = [4 * s for s in edges.values()]
    table[:, FILL] = 4 * np.arange(len(goto))
    return table.ravel()


class DenseTable:
    """All states by all symbols, for small alphabets."""

    def __init__(self, goto: list[dict[int, int]], size: int):
        self.size, self.table = size, parsing_table(goto, size)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.table.take(state * self.size + symbols)


class SparseTable:
    """The same steps from the transitions alone, for alphabets of any size.

    State and symbol are a key in a table of hashes, filled to a quarter at most;
    taken slots are passed to the next one.
    """

    def __init__(self, goto: list[dict[int, int]], size: int):
        self.size = size
        self.restart = np.full(size, 2, np.int32)
        for symbol, state in goto[0].items():
            self.restart[symbol] = 4 * state + 1
        keys = np.array([s * size + symbol for s, edges in enumerate(goto) for symbol in edges], np.int64)
        after = np.array([4 * s for edges in goto for s in edges.values()], np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.after = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            open_ = np.flatnonzero(self.keys[slots[left]] < 0)
            taken, first = np.unique(slots[left[open_]], return_index=True)
            placed = left[open_[first]]
            self.keys[taken], self.after[taken] = keys[placed], after[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            # Only where another key lies does a key go on.
            slots[left] = np.where(self.keys[slots[left]] >= 0, (slots[left] + 1) & self.mask, slots[left])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = state.astype(np.int64) * self.size + symbols
        out = np.where(state == 0, np.int32(1), self.restart.take(symbols))
        slots = self._slots(keys)
        held = self.keys.take(slots)
        hit = held == keys
        out[hit] = self.after[slots[hit]]
        left = np.flatnonzero(~hit & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.after[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return np.where(symbols == FILL, 4 * state, out)


class CrossParser:
    """Languages' parsing tables over common symbols."""

    def __init__(self, sample: Sample):
        self.names = [name for name, _ in sample]
        self.symbols = Symbols([text for _, text in sample])
        self.tables, self.bits = [], []
        for _, text in sample:
            symbols = self.symbols.of(text)
            goto = suffix_automaton(symbols.tolist())
            kind = DenseTable if self.symbols.size <= DENSE else SparseTable
            self.tables.append(kind(goto, self.symbols.size))
            self.bits.append(np.log2(max(2, len(symbols))))

    def phrases(self, stretches: np.ndarray) -> np.ndarray:
        """Phrases by language and stretch; a column of ``stretches`` is one."""
        out = np.empty((len(self.tables), stretches.shape[1]), np.int64)
        for row, table in enumerate(self.tables):
            state = np.zeros(stretches.shape[1], np.int32)
            count = np.zeros(stretches.shape[1], np.int32)
            for symbols in stretches:
                found = table.step(state, symbols)
                count += found & 3
                state = found >> 2
            out[row] = count + (state != 0)
        return out

    def rates(self, texts: list[str | None]) -> np.ndarray:
        """Bits a letter by text and language; NaN where a text has no letter."""
        symbols = [self.symbols.of(text) if text else np.empty(0, self.symbols.kind) for text in texts]
        lengths = np.array([len(s) for s in symbols], np.int64)
        n = -(-lengths // STRETCH)
        flat = np.full(n.sum() * STRETCH, FILL, self.symbols.kind)
        at = (np.cumsum(n) - n) * STRETCH
        for begin, found in zip(at.tolist(), symbols, strict=True):
            flat[begin : begin + len(found)] = found
        stretches = np.ascontiguousarray(flat.reshape(-1, STRETCH).T)
        total = np.zeros((len(self.names), len(texts) + 1), np.int64)
        owner = np.repeat(np.arange(len(texts)), n)
        for row, counts in enumerate(self.phrases(stretches)):
            total[row] = np.bincount(owner, counts, len(texts) + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            rate = total[:, :-1].T * np.array(self.bits) / lengths[:, None]
        rate[lengths == 0] = np.nan
        return rate


@lru_cache(maxsize=2)
def cross_parser(sample: Sample) -> CrossParser:
    """Built once in each Python worker."""
    return CrossParser(sample)


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``TOGETHER`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def predict(df: DataFrame, sample: Sample, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``bits`` (a letter, of the best).

    The score is how much fewer bits the best language takes than the next.
    Columns of these names are replaced.
    """
    replaced = {"lang_pred", "score", "bits"}
    kept = [c for c in df.columns if c.lower() not in replaced]
    (own,) = fresh(df, "text")
    narrow = df.select(*(q(c) for c in kept), q(text).cast("string").alias(own))
    schema = df.select(*(q(c) for c in kept)).schema.add("lang_pred", "string")
    schema = schema.add("score", "double").add("bits", "double")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = cross_parser(sample) if sample else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, bits = [], [], []
            for run in _together(texts):
                for rate in parser.rates(run) if parser else [[np.nan]] * len(run):
                    if np.isnan(rate[0]):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        bits.append(None)
                        continue
                    best = int(np.argmin(rate))
                    rest = np.delete(rate, best)
                    names.append(parser.names[best])
                    scores.append(float(1 - rate[best] / rest.min()) if len(rest) else 1.0)
                    bits.append(float(rate[best]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(batch.num_columns - 1)),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(bits, pa.float64()),
                ],
                names=[*kept, "lang_pred", "score", "bits"],
            )

    return narrow.mapInArrow(predicted, schema)

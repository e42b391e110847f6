"""Texts as numbered words, so that work on a word is done once and in bulk.

Words recur. A table numbers them, values of all new words of a chunk of texts
are made in one call, and what belongs to a text is gathered from flat arrays.
A table keeps a bounded number of words; beyond it it begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; words, and characters of words, beyond
# which a table begins anew.
CHUNK_BYTES = 500_000
KEPT_WORDS = 200_000
KEPT_CHARS = 16_000_000


def runs(sizes: Sequence[int], limit: int) -> Iterator[slice]:
    """Runs of rows whose sizes add up to about ``limit``; a larger row is one alone."""
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > limit:
            yield slice(begin, at)
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of a text column of about ``limit`` bytes."""
    return runs(pc.binary_length(texts).fill_null(0).to_pylist(), limit)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``counts`` values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.cumsum(counts)
    return ends[at] - ends[at - counts]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class WordTable:
    """Flat values of words: ``make`` gives those of a list of new words and
    how many each has."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_WORDS):
        self.make, self.kept = make, kept
        self.on_clear: Callable[[], None] | None = None
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.flat = np.zeros(0, np.int32)
        self.lengths = self.starts = np.zeros(0, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The numbers of words; they hold until the next call."""
        if len(self.numbers) > self.kept or self.chars > KEPT_CHARS:
            self._clear()
            if self.on_clear is not None:
                self.on_clear()
        known = len(self.numbers)
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            new = list(islice(self.numbers, known, None))
            self.chars += sum(map(len, new))
            flat, lengths = self.make(new)
            begins = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, flat])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.concatenate([self.starts, begins])
        return found

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' values joined, and how many each word has."""
        found = self.look_up(words)
        lengths = self.lengths[found]
        return gathered(self.flat, self.starts[found], lengths), lengths

"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie over bytes. Each node has a failure link and the
number of tokens that are settled when it is followed, so a word is read once,
byte by byte, and its pieces are counted without being built. A word is a space
and then its bytes, as byte-level vocabularies write it.

A word that the vocabulary can't spell counts as one token. Null, empty and
blank texts have none. Repeated rows are counted each; other columns pass by.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.tables import q
from tidelog.llm.tokens import byte_letters

_NONE = -1


class LongestMatch:
    """Counts the greedy longest-match tokens of byte strings."""

    def __init__(self, tokens: list[bytes]):
        self.goto: dict[int, int] = {}
        ends = [False]
        for token in tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.goto.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(False)
            ends[node] = bool(token)
        self.fail, self.pops = [_NONE] * len(ends), [0] * len(ends)
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        goto, fail, pops = self.goto, self.fail, self.pops
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in goto.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for byte, node in below.get(parent, ()):
                waiting.append(node)
                if ends[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                back, settled = fail[parent], pops[parent]
                while back != _NONE and (back << 8 | byte) not in goto:
                    settled += pops[back]
                    back = fail[back]
                if back != _NONE:
                    fail[node], pops[node] = goto[back << 8 | byte], settled

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (after := goto.get(node << 8 | byte)) is None:
                if fail[node] == _NONE:
                    return 1
                total += pops[node]
                node = fail[node]
            node = after
        while node:
            if fail[node] == _NONE:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class WordCounts(dict):
    """Counts of words met so far in this process, of bounded number."""

    def __init__(self, automaton: LongestMatch, kept: int = 500_000):
        super().__init__()
        self.automaton, self.kept = automaton, kept

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(f" {word}".encode())
        if len(word) <= 64:
            self[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        if len(self) > self.kept:
            self.clear()
        words = text.split() if text else []
        return len(words), sum(map(self.__getitem__, words))


def vocabulary_tokens(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(map(byte_of.__getitem__, t)) for t in spec["model"]["vocab"] if t not in added]


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(LongestMatch(vocabulary_tokens(path)))


def token_counts(
    df: DataFrame, *, vocabulary: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: its id, its white-space words and their longest-match tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary)
        for batch in batches:
            found = [counts.text(text.as_py()) for text in batch.column(1)]
            words, tokens = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return df.select(
        q(id_column).cast("long").alias("doc_id"), q(text_column).cast("string").alias("text")
    ).mapInArrow(counted, "doc_id long, n_words long, n_tokens long")

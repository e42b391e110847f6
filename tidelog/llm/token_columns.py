"""Token ids of whole columns of texts by the tokenizers library.

As in ``tokens``, a text is cut by its spaces and each piece is merged alone. Here
no step is taken for a single piece: Arrow cuts and numbers the pieces of a chunk of
texts, marks behind a word are told from it, all words that are not in the table go
to the library in a few calls, and ids of texts are gathered from those of pieces.
The table holds the words met last, in a bounded number. Texts that ``tokens``
encodes whole are encoded whole here too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tidelog.llm.tokens import Encoder
from tidelog.llm.words import chunks, gathered

# White space as Python tells it; at an end of a text or in a row it leaves pieces unsure.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSURE = rf"\A{_BLANK}|{_BLANK}(?:{_BLANK}|\z)"
# No apostrophe, which may begin a part of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE_MARKS = r"[0-9A-Za-zÀ-ÖØ-öø-ɏ]\z"
_LETTERS = r"\A\n?[A-Za-zÀ-ÖØ-öø-ɏ]+\z"
CHUNK_BYTES = 4_000_000
KEPT_BYTES = 64
FEW = 20
_AT_ONCE = 10_000

_TEXT, _IDS = pa.large_string(), pa.large_binary()


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)


def _column(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Strings or ids that lie one after the other in ``flat`` up to ``ends``."""
    buffers = [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat)]
    return pa.Array.from_buffers(kind, len(ends), buffers)


class ColumnEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = 250_000):
        self.one, self.kept = Encoder(path), kept
        # words that are cut and written in the vocabulary's letters, a mark between them
        self.parts = Tokenizer(self.one.tokenizer.model)
        self.parts.pre_tokenizer = CharDelimiterSplit("|")
        self.line = "\n".translate(self.one.letters)
        # a line break is one id, also where small vocabularies lack some bytes
        line = self.one.whole("\n")
        self.by_pieces = self.one.by_piece and len(line) == 4 and line == self.one.part("\n")
        self.begins = np.array([raw[:1] in (b" ", b"\n") for raw in self.one.token_bytes()])
        self.words, self.of_words = pa.array([], _TEXT), pa.array([], _IDS)

    def ids(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """The ids of each text; a null or empty one has none."""
        for rows in chunks(texts, CHUNK_BYTES):
            yield from self._chunk(texts[rows].cast(_TEXT))

    def _chunk(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        sure = pc.and_not(
            pc.and_(pc.greater(pc.binary_length(texts), 0), self.by_pieces),
            pc.match_substring_regex(texts, _UNSURE),
        )
        for token in self.one.added:
            sure = pc.and_not(sure, pc.match_substring(texts, token))
        sure = sure.fill_null(False)
        ids, ends = self._by_pieces(texts.filter(sure))
        found = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        for at, by_pieces in enumerate(sure.to_pylist()):
            if by_pieces:
                begin, end = next(found)
                yield ids[begin + 4 : end]  # without that of the line break put before it
            else:
                text = texts[at].as_py()
                yield self.one.whole(text) if text else b""

    def _by_pieces(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Joined ids of texts, and where each begins and ends. A line break is put before
        each, as pieces behind one have no space of their own, like the first of a text."""
        line, nothing = pa.scalar("\n", _TEXT), pa.scalar("", _TEXT)
        lines = pc.binary_join_element_wise(line, pc.replace_substring(texts, "\n", " \n"), nothing)
        pieces = pc.split_pattern(lines, " ")
        ends, numbered = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        del lines, pieces, texts
        ids = self._pieces(numbered.dictionary).take(numbered.indices)
        return memoryview(ids.buffers()[2] or b""), _offsets(ids)[ends]

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces, those of marks behind a letter or digit apart."""
        words = pc.ascii_rtrim(pieces, characters=_MARKS)
        words = pc.if_else(pc.match_substring_regex(words, _BEFORE_MARKS), words, pieces)
        held = pc.binary_length(words).to_numpy()
        marks = pc.binary_length(pieces).to_numpy() - held
        flat = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        tails = _column(gathered(flat, _offsets(pieces)[:-1] + held, marks), np.cumsum(marks), _TEXT)
        words, tails = words.dictionary_encode(), tails.dictionary_encode()
        of_tails = [self.one.tail(tail) if tail else b"" for tail in tails.dictionary.to_pylist()]
        return pc.binary_join_element_wise(
            self._words(words.dictionary).take(words.indices),
            pa.array(of_tails, _IDS).take(tails.indices),
            pa.scalar(b"", _IDS),
        )

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of different words after their space; one that begins with a line break has none."""
        # a look into the table costs as much as reading it, which few words aren't worth
        few = len(words) < len(self.words) // FEW
        table, of_table = (x[:0] if few else x for x in (self.words, self.of_words))
        known = pc.index_in(words, value_set=table)
        new = pc.is_null(known)
        letters = pc.match_substring_regex(words, _LETTERS)
        groups = [pc.and_(new, letters), pc.and_not(new, letters)]
        at = known.fill_null(-1).to_numpy().copy()
        met, columns = len(table), [of_table]
        for group, only in zip(groups, (True, False), strict=True):
            some = words.filter(group)
            columns += [self._new(some[i : i + _AT_ONCE], only) for i in range(0, len(some), _AT_ONCE)]
            at[group.to_numpy(zero_copy_only=False)] = np.arange(met, met + len(some))
            met += len(some)
        ids = pa.concat_arrays(columns).take(pa.array(at))
        if not few:
            self._keep(words, ids, at)
        return ids

    def _keep(self, words: pa.Array, ids: pa.Array, at: np.ndarray) -> None:
        """These words are in the table from now on, before those met earlier."""
        short = pc.less_equal(pc.binary_length(words), KEPT_BYTES)
        unused = np.ones(len(self.words), bool)
        unused[at[at < len(unused)]] = False
        unused = pa.array(unused)
        self.words, self.of_words = (
            pa.concat_arrays([now.filter(short), earlier.filter(unused)])[: self.kept]
            for now, earlier in ((words, self.words), (ids, self.of_words))
        )

    def _new(self, words: pa.Array, letters: bool) -> pa.Array:
        """Ids of words, of letters alone or not, in one call of the library.

        Each word begins with a space or a line break, and none of its other tokens does.
        """
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        joined = pc.binary_join(one, pa.scalar(" ", _TEXT))[0].as_py()
        text = f" {joined}".replace(" \n", "\n")
        if letters:
            text = text.replace(" ", "| ").replace("\n", "|\n|")
            if text.isascii():
                text = text.replace(" ", self.one.space).replace("\n", self.line)
            else:
                text = text.encode().decode("latin-1").translate(self.one.letters)
        library = self.parts if letters else self.one.tokenizer
        # an added token with a space in it may arise between words
        if not any(token in text for token in self.one.added):
            (found,) = library.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            begins = np.flatnonzero(self.begins[ids])
            if len(begins) == len(words):
                return _column(ids, 4 * np.append(begins[1:], len(ids)), _IDS)
        alone = (word if word[:1] == "\n" else f" {word}" for word in words.to_pylist())
        return pa.array(map(self.one.whole, alone), _IDS)


@lru_cache(maxsize=2)
def column_encoder(path: str) -> ColumnEncoder:
    """One for each path and Python worker."""
    return ColumnEncoder(path)

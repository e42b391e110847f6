"""Token ids of whole texts by the tokenizers library, piece by piece.

A byte-level vocabulary cuts a text by a fixed pattern before it merges, and
each cut part is merged by itself. A single space between two characters that
are no white space always begins a new part, a single line break always stands
alone, so the ids of a text are those of its space-delimited pieces, joined.
Pieces recur, so those met are kept: in a bounded table, and in the one before it
when it is full, so pieces in use outlive it.
Texts in which this doesn't hold (white space in a row or at an end, an added
token) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

from tokenizers import Tokenizer

# Spark's tasks use the cores; threads of the library only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_UNSURE = re.compile(r"\s(?:\s|\Z)").search
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
# No apostrophe, which may begin a part of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = ("  ", " \n", "\n ", "\n\n")
_KEPT_CHARS = 64
_KEPT_TAILS = 10_000


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(_KEPT_CHARS)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


def unsure(text: str) -> bool:
    """Whether white space lies at an end of a text or in a row."""
    if text[0].isspace():
        return True
    # printable lines have no white space but spaces
    if not all(map(str.isprintable, text.split("\n"))):
        return _UNSURE(text) is not None
    return text[-1] in " \n" or any(pair in text for pair in _SPACES)


class Encoder(dict):
    """Ids as little-endian unsigned 32-bit integers; the dict keeps pieces.

    With ``plain`` the strings of special tokens are text like other text.
    """

    def __init__(self, path: str, kept: int = 400_000, plain: bool = False):
        super().__init__()
        self.earlier: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"]["type"] == "BPE"
        )
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t["content"] for t in spec.get("added_tokens", [])]
        self.kept = kept
        self.model = self.tokenizer.model.tokenize
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.space = letters[32]
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return _packed(found.ids)

    def part(self, text: str) -> bytes:
        """Ids of one part of the cut."""
        written = text.encode().decode("latin-1").translate(self.letters)
        return _packed([token.id for token in self.model(written)])

    def tail(self, marks: str) -> bytes:
        """Ids of marks behind a word; few forms recur, so they are kept too."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.part(marks)
            if len(self.tails) < _KEPT_TAILS:
                self.tails[marks] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        """Ids of a piece after its space; a piece that begins with a line break has none."""
        ids = self.earlier.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        word = piece.rstrip(_MARKS)
        ascii_word = word.isascii() and word.isalpha()
        if ascii_word and word == piece:
            ids = _packed([token.id for token in self.model(self.space + word)])
        elif ascii_word or _LETTERS(word):
            ids = self.part(f" {word}") if word == piece else self[word] + self.tail(piece[len(word) :])
        elif word[:1] == "\n" and _LETTERS(word[1:]):
            ids = self.tail("\n") + self.part(word[1:])
            if word != piece:
                ids += self.tail(piece[len(word) :])
        else:
            ids = self.whole(piece if piece[:1] == "\n" else f" {piece}")
        if len(piece) <= _KEPT_CHARS:
            self[piece] = ids
        return ids

    def make_room(self) -> None:
        """Begins a new table when this one is full."""
        if len(self) > self.kept:
            self.earlier = self.copy()
            self.clear()

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        letters = {letter: byte for byte, letter in byte_letters().items()}
        raw = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in letters for c in name)
            raw[i] = bytes(letters[c] for c in name) if known else name.encode()
        return raw

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if (
            not self.by_piece
            or any(token in text for token in self.added)
            or unsure(text)
        ):
            return self.whole(text)
        self.make_room()
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    return Encoder(path)

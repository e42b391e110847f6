"""Merge rounds against the sentencepiece library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tests.conftest import SMALL
from tidelog.llm import sentence_pieces
from tidelog.llm.queries import PIECES, op13_sentence_pieces

LIBRARY = SentencePieceProcessor(model_file=PIECES)
ODD = [
    None,
    "",
    " ",
    "a  b",
    " lead and trail ",
    "▁▁x",
    "\x00a\n\r\n\t",
    "<s> <0x41> </s>",
    "梦龘𠀀é é",
    "aaaaaaaaaaab" * 9,
    "a" * 5_000,
    " " * 3_000 + "x",
]


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def assert_as_library(texts):
    table = sentence_pieces.pieces(PIECES)
    ids, counts = table.encode(texts)
    assert split(ids, counts) == [LIBRARY.encode(text) for text in texts]
    assert table.decode(ids, counts) == [LIBRARY.decode(part) for part in split(ids, counts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("  aabeinorst▁\n梦é𠀀."), max_size=60), min_size=1, max_size=8))
def test_texts_of_few_letters(texts):
    assert_as_library(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=5))
def test_any_text(texts):
    assert_as_library(texts)


def test_odd_texts():
    assert_as_library([text or "" for text in ODD])


def test_long_words_are_finished_by_the_agenda():
    letters = np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 30_000)
    assert_as_library(["".join(letters)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, LIBRARY.get_piece_size() - 1), min_size=1, max_size=12))
def test_any_ids_decode_as_the_library_has_it(ids):
    table = sentence_pieces.pieces(PIECES)
    assert table.decode(np.array(ids), np.array([len(ids)])) == [LIBRARY.decode(ids)]


def test_ids_beyond_the_model_are_an_error():
    table = sentence_pieces.pieces(PIECES)
    with pytest.raises(ValueError):
        table.decode(np.array([LIBRARY.get_piece_size()]), np.array([1]))


def test_a_small_word_table_gives_the_same(monkeypatch):
    table = sentence_pieces.Pieces(PIECES)
    table.words.kept = 3
    for text in ["one two three four", "two five six", "one six"]:
        assert table.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_rows_of_any_kind(spark, docs):
    rows = [*((i, text) for i, text in enumerate(ODD)), (None, "x y"), (3, "a  b"), (3, "a  b")]
    df = docs(rows).withColumn("ids", F.lit(1)).withColumn("doc_id_", F.lit(2))
    found = sentence_pieces.decode(sentence_pieces.encode(df, model=PIECES), model=PIECES)
    got = sorted((str(r.doc_id), list(r.ids), r.text) for r in found.collect())
    want = [(str(i), LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows]
    assert got == sorted(want)


def test_null_ids_and_other_columns_pass_by_decode(spark):
    df = spark.createDataFrame([([1, 306], 7, "old"), (None, 8, "x"), ([], 9, "y")], "ids array<int>, n int, text string")
    found = sentence_pieces.decode(df, model=PIECES).orderBy("n").collect()
    assert [(r.n, r.text) for r in found] == [(7, LIBRARY.decode([1, 306])), (8, None), (9, "")]


def test_empty_table(docs):
    found = sentence_pieces.decode(sentence_pieces.encode(docs([]), model=PIECES), model=PIECES)
    assert found.columns == ["doc_id", "ids", "text"] and found.count() == 0


def test_query_equals_the_library(spark):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = LIBRARY.encode(row.text or "")
        want.append((row.doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    found = op13_sentence_pieces(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(want)

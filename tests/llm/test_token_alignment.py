"""Alignments against a plain loop over tokens, and the perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidelog.llm import perfect_hash, token_alignment
from tidelog.llm.queries import PIECES, VOCABULARY, op12_token_alignment
from tidelog.llm.tokens import byte_letters

A = Tokenizer.from_file(VOCABULARY)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=PIECES)
LETTERS = {letter: byte for byte, letter in byte_letters().items()}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def a_tokens(text):
    ids = A.encode(" " + text, add_special_tokens=False).ids
    return [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in ids]


def b_tokens(text):
    def raw(i):
        return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()

    return [(i, raw(i)) for i in B.encode(text)]


def one(text):
    """(n_a, n_b, links, groups) of a text by itself."""
    if not text:
        return 0, 0, [], ""
    sides = a_tokens(text), b_tokens(text)
    if any(b"".join(raw for _, raw in side) != (" " + text).encode() for side in sides):
        return 0, 0, [], ""
    ends = [{}, {}]
    for side, held in zip(sides, ends):
        at = 0
        for i, raw in side:
            at += len(raw)
            held[at] = i
    both = sorted(ends[0].keys() & ends[1].keys())
    groups, begin = [], 0
    for end in both:
        told = [",".join(str(held[e]) for e in sorted(held) if begin < e <= end) for held in ends]
        groups.append("|".join(told))
        begin = end
    return len(sides[0]), len(sides[1]), [(ends[0][e], ends[1][e]) for e in both], ";".join(groups)


def plain(rows):
    found = [(doc_id, one(text)) for doc_id, text in rows]
    count = Counter(link for _, (_, _, links, _) in found for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, (n_a, n_b, links, groups) in found:
        top = sum(count[link] == best[link[1]] for link in links)
        out.append((doc_id, n_a, n_b, len(links), len(links), top, sum(count[link] for link in links), groups))
    return out


def aligned(df, **options):
    return token_alignment.align(df, byte_vocabulary=VOCABULARY, piece_model=PIECES, **options)


ROWS = [
    (1, "The quick brown fox."),
    (2, None),
    (3, ""),
    (4, " lead  and\n\n trail "),
    (5, "has ▁ mark"),
    (6, "<|endoftext|> <s> </s> <0x41>"),
    (7, "梦龘𠀀é café\x00 1234567890"),
    (8, "The quick brown fox."),
    (8, "The quick brown fox."),
    (None, "antidisestablishmentarianism\nnext line"),
    (9, "word " * 3_000 + "end"),
    (10, "x" * 20_000),
]


def assert_same(found, rows):
    assert found.columns == COLUMNS
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))


def test_rows_of_any_kind(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.withColumns({name: F.lit("x") for name in ("n_best", "pair", "groups", "shard", "part")})
    assert_same(aligned(df), ROWS)


def test_slices_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "SHARD_PAIRS", 10)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert_same(aligned(df, resident_pairs=25), ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_any_words(texts):
    words = token_alignment.WordPairs(token_alignment.aligner(VOCABULARY, PIECES), written=True)
    number, counts = words.of_texts(texts)
    at = iter(number.tolist())
    for text, n in zip(texts, counts.tolist()):
        mine = [next(at) for _ in range(n)]
        n_a, n_b, links, groups = one(text)
        assert (words.n_a[mine].sum(), words.n_b[mine].sum(), words.table.lengths[mine].sum()) == (n_a, n_b, len(links))
        assert ";".join(words.texts[i] for i in mine) == groups


def test_empty_table(spark):
    found = aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == COLUMNS and found.count() == 0


def test_tree_sum_has_steps(spark, monkeypatch):
    one = np.arange(token_alignment.CHUNK, dtype=np.int64)
    monkeypatch.setattr(token_alignment, "FAN", 3)
    rows = [(part, 0, one.tobytes()) for part in range(20)]
    found = token_alignment.tree_sum(spark.createDataFrame(rows, "part int, chunk int, counts binary"), 20).collect()
    assert len(found) == 1 and (np.frombuffer(bytes(found[0]["counts"]), np.int64) == 20 * one).all()


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 30_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    shards = 5
    shard = perfect_hash.shard_of(perfect_hash.lot(keys), shards)
    rows = []
    for s in range(shards):
        sizes, bits, ordered = perfect_hash.build(keys[shard == s])
        rows.append((s, sizes, bits, ordered.tobytes()))
    table = perfect_hash.PerfectHash.of(shards, rows[::-1])
    numbers = table.numbers(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    assert (table.keys[numbers] == keys).all()
    foreign = np.setdiff1d(rng.integers(0, 1 << 48, 2_000), keys)
    assert (table.numbers(foreign) == -1).all()


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5]))


def test_query_equals_plain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [
        (*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for row in plain(rows)
    ]
    found = op12_token_alignment(spark, SMALL).select(*COLUMNS[:-1], "groups_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_byte_level_ids_of_words():
    """As of the library, with special tokens as text; plain words take no call of it."""
    aligner = token_alignment.Aligner(VOCABULARY, PIECES)
    whole, asked = aligner.a.whole, []
    aligner.a.whole = lambda text: asked.append(text) or whole(text)
    plain = ["word", "word,", "éÉa!", "one\ntwo,\nthree", "word\nword", "x..."]
    odd = ["it's", "3rd", "<|endoftext|>", "a\t7", "日本\nかな", " a  b \n c ", "''", "x" * 300 + "1"]
    for words in (plain, odd, plain + odd):
        ids, word = aligner.byte_ids(words)
        assert bool(asked) == (words is not plain)
        for i, w in enumerate(words):
            wanted = aligner.a.tokenizer.encode(w if w[0] == " " else f" {w}", add_special_tokens=False).ids
            assert ids[word == i].tolist() == wanted

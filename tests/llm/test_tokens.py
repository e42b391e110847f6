"""Token ids, packing, token counts and token files against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers, trainers

from tidelog.llm import packing, token_counts, token_files
from tidelog.llm.queries import QUERIES, VOCABULARY
from tidelog.llm.tables import table
from tidelog.llm.token_columns import ColumnEncoder
from tidelog.llm.tokens import Encoder
from tidelog.sources.shared import shared_folder

PLAIN = Tokenizer.from_file(VOCABULARY)
ENCODER = Encoder(VOCABULARY, kept=50)

ODD_TEXTS = [
    None,
    "",
    " ",
    "a  b \n c\n\n d  \n",
    "'ll can't I'm 3rd\t x y",
    "x <|endoftext|> y",
    "ªº x×y a\tb c\x00d",
    "日本 語\nかな 🙂 é\nÉa $$$ x'y",
    "word " * 5000,
    "x" * 20_000,
]


def plain(text):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, np.uint32)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_of_odd_texts(text):
    assert ENCODER.ids(text) == plain(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZß é1 \n.,'-\t _ 　"), max_size=30))
def test_ids_of_any_text(text):
    assert ENCODER.ids(text) == plain(text).tobytes()


def pieces_of(rows):
    docs = {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    return docs


def check_packing(rows, window):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sequences


def test_packing_of_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = QUERIES["op4_packing"](spark, folder).collect()
    sequences = check_packing(rows, 2048)
    assert {r["doc_id"] for r in rows} == set(docs)
    for (doc_id, tokens), pieces in pieces_of(rows).items():
        ids = np.append(plain(docs[doc_id]), 1)
        assert tokens == len(ids)
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == tokens
    used = [sum(n for _, n in p) for p in sequences.values()]
    padding = sum(0 if u & (u - 1) == 0 else 2048 - u for u in used)
    assert padding < 0.05 * sum(used)


def test_packing_of_odd_documents(docs):
    df = docs([*ODD_TEXTS, (3, "again"), (3, "again"), (None, "no id")])
    df = df.withColumnsRenamed({"n_chars": "start"}).withColumnRenamed("lang", "shard")
    rows = packing.pack(df, vocabulary=VOCABULARY, window=64, shard_docs=5).collect()
    check_packing(rows, 64)
    wanted = sum(len(plain(t)) + 1 for t in [*ODD_TEXTS, "again", "again", "no id"])
    assert sum(r["length"] for r in rows) == wanted
    assert not packing.pack(df.limit(0), vocabulary=VOCABULARY).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_is_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit(lengths, 32)
    rooms = []
    for length, at, offset in zip(lengths, windows, offsets, strict=True):
        fitting = [room for room in rooms if room >= length]
        if at == len(rooms):
            assert not fitting and offset == 0
            rooms.append(32)
        assert rooms[at] == min(fitting, default=32)
        assert offset == 32 - rooms[at]
        rooms[at] -= length


def greedy_count(word, tokens):
    text, n = b" " + word.encode(), 0
    while text:
        size = next((k for k in range(len(text), 0, -1) if text[:k] in tokens), 0)
        if not size:
            return 1
        text, n = text[size:], n + 1
    return n


def test_token_counts(spark, folder, docs):
    tokens = set(token_counts.vocabulary_tokens(VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    for r in QUERIES["op5_token_counts"](spark, folder).collect():
        words = texts[r["doc_id"]].split()
        assert r["n_words"] == len(words)
        assert r["n_tokens"] == sum(greedy_count(w, tokens) for w in words)
    found = token_counts.token_counts(docs([*ODD_TEXTS, "a a", "a a"]), vocabulary=VOCABULARY)
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in found.collect()}
    assert rows[0] == rows[1] == rows[2] == (0, 0) and rows[10] == rows[11]


@settings(max_examples=300, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=4), max_size=12),
    st.text("abc", max_size=12),
)
def test_longest_match_counts(vocabulary, word):
    tokens = {t.encode() for t in vocabulary} | {b" ", b" a"}
    assert token_counts.LongestMatch(sorted(tokens)).count(b" " + word.encode()) == greedy_count(
        word, tokens
    )


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)),
        max_size=300,
    ),
    st.integers(1, 9),
)
def test_blocks_round_trip(ids, times):
    ids = np.array(ids * times, np.uint64)
    assert (token_files.decode_block(token_files.encode_block(ids)) == ids).all()


def test_damaged_block():
    block = bytearray(token_files.encode_block(np.arange(5000, dtype=np.uint64)))
    block[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode_block(bytes(block))


def wanted_files(texts):
    at, out = 0, []
    for doc_id, text in texts:
        ids = np.append(plain(text), 0)
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files_of_documents(spark, folder):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect())
    rows = QUERIES["op7_token_files"](spark, folder).collect()
    assert sorted(tuple(r) for r in rows) == wanted_files(docs)


def test_token_files_of_odd_documents(spark, docs, monkeypatch):
    rng = random.Random(5)
    texts = [*ODD_TEXTS, *(" ".join(rng.choices(["aa", "b", "the"], k=40_000)) for _ in range(4))]
    path = shared_folder(spark, "token-files")
    df = docs(texts).withColumnRenamed("lang", "part").repartition(5)
    token_files.write_token_files(df, path, vocabulary=VOCABULARY)
    rows = sorted(tuple(r) for r in token_files.read_token_files(spark, path).collect())
    assert rows == wanted_files(enumerate(texts))


def test_token_files_of_repeated_and_no_documents(spark, docs):
    for rows in ([], [(2, "a b"), (2, "a b"), (None, "c"), (1, None)]):
        path = shared_folder(spark, "token-files")
        token_files.write_token_files(docs(rows), path, vocabulary=VOCABULARY)
        found = token_files.read_token_files(spark, path).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted_files(order)))


def test_packing_keeps_large_ids_beside_null_ones(docs):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, None]
    df = docs([(i, "a b") for i in ids])
    found = packing.pack(df, vocabulary=VOCABULARY, shard_docs=100).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted(ids, key=repr)
    assert {r.offset for r in found} == {0, 3, 6, 9, 12}


def test_packing_deals_repeated_rows_to_all_shards(docs):
    df = docs([(7, "a b")] * 400)
    found = packing.pack(df, vocabulary=VOCABULARY, shard_docs=100).collect()
    assert len(found) == 400 and len({r.sequence_id >> 32 for r in found}) == 4


def test_pieces_in_use_outlive_a_full_table():
    encode, calls = Encoder(VOCABULARY, kept=60), []
    model = encode.model
    encode.model = lambda written: calls.append(written) or model(written)
    for i in range(40):
        text = " ".join(["x", "often", "often,", *(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(10))])
        assert encode.ids(text) == plain(text).tobytes()
        assert len(encode) + len(encode.earlier) <= 2 * (60 + 13)
    assert sum("often" in written for written in calls) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 3, 200, 40_000, 1 << 30, (1 << 60) - 1, 1 << 63]), max_size=2_100))
def test_words_of_blocks_take_most_ids(ids):
    ids = np.array(ids, np.uint64)
    best, taken = token_files.selectors(ids)
    at, starts = 0, []
    while at < len(ids):
        left = min(len(ids), at - at % token_files.RUN + token_files.RUN) - at
        for count, width in zip(token_files.COUNTS[:-2].tolist(), token_files.WIDTHS.tolist()):
            if all(int(x) >> width == 0 for x in ids[at : at + min(count, left)]):
                break
        else:
            count = 1
        assert taken[at] == min(count, left)
        starts.append(at)
        at += int(taken[at])
    assert token_files.word_starts(taken).tolist() == starts
    assert (token_files.decode_block(token_files.encode_block(ids)) == ids).all()


COLUMNS = ColumnEncoder(VOCABULARY, kept=50)
# Words, marks and white space that are cut in their own ways.
FORMS = [
    *"abZß é1\n.,'-\t_|²ª٣ʰ’»\x00\x1c\x85\u3000", " ", " ", " ", " ",
    "'s", "###", "...", "word", "Éa", "日本", "<|endoftext|>",
]


def columns_ids(encode, texts):
    return [bytes(ids) for ids in encode.ids(pa.array(texts, pa.string()))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(FORMS), max_size=25).map("".join), max_size=8))
def test_ids_of_columns_of_any_texts(texts):
    assert columns_ids(COLUMNS, texts) == [plain(text).tobytes() for text in texts]


def test_ids_of_columns_of_odd_texts(monkeypatch):
    odd = [*ODD_TEXTS, "x" * 70 + " y", "Straße größer,\nÉté. x|y ñ|"]
    assert columns_ids(COLUMNS, odd) == [plain(text).tobytes() for text in odd]
    assert columns_ids(COLUMNS, []) == []
    monkeypatch.setattr("tidelog.llm.token_columns.CHUNK_BYTES", 10)
    assert columns_ids(COLUMNS, odd[3:] + odd) == [plain(text).tobytes() for text in odd[3:] + odd]
    assert columns_ids(COLUMNS, pa.array(["cut off", *odd, "cut off"])[1:-1]) == columns_ids(COLUMNS, odd)


def counted(library, calls):
    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **options)

    return Counted()


def test_new_words_of_a_column_are_encoded_together():
    encode, calls = ColumnEncoder(VOCABULARY, kept=300), []
    encode.parts, encode.one.tokenizer = (counted(x, calls) for x in (encode.parts, encode.one.tokenizer))
    encode.one.model = None  # no calls for single words
    letters = [chr(97 + i) for i in range(26)]
    words = [f"w{a}{b}" for a in letters[:10] for b in letters]
    texts = [" ".join([w, "often", "often", f"{w}{i}"]) for i, w in enumerate(words)]
    assert columns_ids(encode, texts) == [plain(text).tobytes() for text in texts]
    assert len(calls) == 2
    for i in range(20):  # each with new words, more than the table holds
        texts = [f"new{letters[i]}{w} often" for w in words]
        assert columns_ids(encode, texts) == [plain(text).tobytes() for text in texts]
        assert len(encode.words) == len(encode.of_words) <= 300
    assert sum("often" in text for text in calls) == 1


def test_columns_with_added_tokens_that_hold_a_space(tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    library.add_special_tokens(["9 8"])
    library.save(str(tmp_path / "more.json"))
    texts = ["a9", "8b", "x9 8y", "c a9\n8b"]
    wanted = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert columns_ids(ColumnEncoder(str(tmp_path / "more.json")), texts) == wanted


@pytest.mark.parametrize("learned", ["abc", "ab ab abc", "ab\nab abc"])
@pytest.mark.parametrize("prefix", [False, True])
def test_columns_of_vocabularies_without_some_bytes(tmp_path, learned, prefix):
    library = Tokenizer(models.BPE())
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=prefix)
    library.train_from_iterator([learned], trainers.BpeTrainer(vocab_size=30, show_progress=False))
    library.save(str(tmp_path / "small.json"))
    texts = ["ab abc\nab", "b", "abd a, b\n.c", "d d", None, "a  b"]
    found = [library.encode(text or "").ids for text in texts]
    assert columns_ids(ColumnEncoder(str(tmp_path / "small.json")), texts) == [
        np.array(ids, "<u4").tobytes() for ids in found
    ]

"""Scores of bag classes against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import lexical_search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    if not bags:
        return []
    big_n, big_l = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, bag in bags:
            m = 25 + 75 * sum(bag.values()) * big_n // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in terms(text)
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        best = sorted(scored)[:k]
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(best, 1)]
    return out


def assert_as_plain(spark, docs, items, **options):
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id string, text string")
    found = lexical_search.search(left, right, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain(docs, items, options.get("k", 10))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def random_docs(seed, n):
    draw = random.Random(seed)
    words = ["Été", "été", "a1", "B", "b", "na-ïve", "x_y", "日本", "the", "THE", "end."]
    return [(i, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("terms_at_once", [100_000, 4])
def test_random_documents(spark, terms_at_once):
    items = [("p", "the été THE b"), ("q", "日本 naïve ïve"), ("r", "nothing here"), ("s", "x y x y x"), ("t", "B a1")]
    assert_as_plain(spark, random_docs(1, 60), items, block_terms=terms_at_once)


def test_copies_ties_and_nulls(spark):
    docs = [(9, "one two"), (3, "One, two!"), (None, "one two"), (3, "one two"), (7, None), (8, ""), (6, "- -"), (5, "two three")]
    docs += [(i, "one two") for i in range(20, 60)]
    docs += [(100, "four " * 400 + "one")]
    items = [("a", "one"), ("a", "one"), ("b", None), (None, "two one two"), ("c", ""), ("d", "four"), ("a", "three")]
    assert_as_plain(spark, docs, items)
    assert_as_plain(spark, docs, items, k=2)


def test_two_classes_of_equal_score_mix_by_id(spark):
    docs = [(i, "one two" if i % 2 else "one three") for i in range(30)]
    assert_as_plain(spark, docs, [("a", "one")])


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(4, "x")], "item_id long, text string")
    more = {name: F.lit(0) for name in ("n", "bag", "m", "terms", "score", "item_id", "term")}
    found = lexical_search.search(docs.withColumns(more), items.withColumns({k: v for k, v in more.items() if k != "item_id"}))
    assert [tuple(r)[:3] for r in found.collect()] == [(4, 1, 1)]
    for left, right in ((docs.limit(0), items), (docs, items.limit(0))):
        empty = lexical_search.search(left, right)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_an_item_beyond_exact_sums_is_an_error(spark):
    items = spark.createDataFrame([("a", "x " * 1_000_000 + "y")], "item_id string, text string")
    docs = spark.createDataFrame([(i, "x" if i else "y " * 9) for i in range(200_000)], "doc_id long, text string")
    with pytest.raises(ValueError):
        lexical_search.search(docs, items)


def test_copies_are_one_class(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(50)] + [(99, "one two two")], "doc_id long, text string")
    vocabulary = spark.sparkContext.broadcast({b"one": 0, b"two": 1})
    rows = lexical_search.bags(docs, vocabulary, "doc_id", "text")
    assert rows.select("terms", "counts").distinct().count() == 2

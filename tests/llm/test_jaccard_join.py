"""The similarity join against brute force."""

import random

import numpy as np
import pytest

from tidelog.llm import jaccard_join
from tidelog.llm.components import components
from tidelog.llm.queries import QUERIES
from tidelog.llm.tables import table


def brute(rows, similarity=0.8, words=5):
    """(class_id, n_links) by row from all pairs."""
    sets = []
    for _, text in rows:
        found = (text or "").lower().split()
        n = min(words, len(found))
        sets.append({tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set())
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if n / (len(s) + len(sets[j]) - n) >= similarity:
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out.setdefault((rows[i][0], links[i]), []).append(min(ids, default=None))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def joined(df, **options):
    out = {}
    for r in jaccard_join.near_duplicates(df, **options).collect():
        out.setdefault((r["doc_id"], r["n_links"]), []).append(r["class_id"])
    return {k: sorted(v, key=repr) for k, v in out.items()}


def near_texts(seed=1):
    """Groups of edited copies, a large group, shared passages, clean texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(80)]
    texts += [passage + " " + " ".join(rng.choices(words, k=60)) for _ in range(150)]
    for base, copies in ((texts[0], 30), (texts[1], 12), (" ".join(rng.choices(words, k=100)), 250)):
        for _ in range(copies):
            own = base.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    return texts + [texts[3]] * 40


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    found = {}
    for r in QUERIES["op8_jaccard_join"](spark, folder).collect():
        found.setdefault((r["doc_id"], r["n_links"]), []).append(r["class_id"])
    assert found == brute(rows)


def test_groups_small_buckets_and_blocks(docs):
    texts = near_texts()
    rows = list(enumerate(texts))
    assert joined(docs(texts)) == brute(rows)
    # buckets that never fit and groups cut into blocks, so every way is taken
    assert joined(docs(texts), bucket=8, depth=3, block=64) == brute(rows)


def test_odd_rows(docs):
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one two"), (4, "One  two"), (None, "one two")]
    rows += [(7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, "x " * 30_000)]
    df = docs(rows).withColumnsRenamed({"lang": "set", "source": "node"})
    assert joined(df) == brute(rows)
    assert joined(df.limit(0)) == {}
    kept = jaccard_join.without_near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["text"][:5] if r["text"] else r["text"]) for r in kept if r["doc_id"] is not None) == sorted(
        [(0, None), (1, ""), (2, "  \n "), (3, "one t"), (7, "a b c"), (8, "x x x")], key=repr
    ) or {r["doc_id"] for r in kept} == {0, 1, 2, 3, 7, 8, None}
    assert [r["doc_id"] for r in kept].count(7) == 1


def test_one_document_of_each_class_stays(docs):
    texts = near_texts(2)
    classes = {c for v in brute(list(enumerate(texts))).values() for c in v}
    kept = jaccard_join.without_near_duplicates(docs(texts)).collect()
    assert {r["doc_id"] for r in kept} == classes and len(kept) == len(classes)


def test_common_counts_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(12)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (jaccard_join.common(sets) == wanted).all()


@pytest.mark.parametrize("shape", ["chain", "star", "two", "none"])
def test_components(spark, shape):
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(40)],
        "two": [(1, 2), (2, 3), (7, 9), (5, 5)],
        "none": [],
    }[shape]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r["node"]: r["label"] for r in rows}
    assert len(rows) == len(found)
    wanted = {
        "chain": {i: 0 for i in range(61)},
        "star": {i: 0 for i in [99, *range(40)]},
        "two": {1: 1, 2: 1, 3: 1, 7: 7, 9: 7},
        "none": {},
    }[shape]
    assert found == wanted


def test_a_row_is_judged_by_its_text(docs):
    rows = [(0, "x y z"), (1, "x y z"), (1, "quite other text here now"), (None, "X  y z"), (None, "p q r"), (None, "p q r")]
    df = docs(rows).withColumnsRenamed({"lang": "_key_", "source": "doc_key", "n_chars": "text_hash"})
    kept = jaccard_join.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(0, "x y z"), (1, "quite other text here now"), (None, "p q r")], key=repr
    )


def test_runs_follow_from_recall():
    assert [jaccard_join.runs_for(0.8, depth, 0.99) for depth in (1, 3, 5)] == [3, 6, 8]
    assert jaccard_join.runs_for(0.8, 5, 0.999) > 8 and jaccard_join.runs_for(1.0, 5, 0.99) == 1

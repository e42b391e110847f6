"""Mixing against the same computation in plain Python."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidelog.llm import mixing
from tidelog.llm.queries import QUERIES, marginals
from tidelog.llm.tables import table


def plain_goals(tokens, weight, kept):
    whole = set()
    while True:
        rest = sum(w for v, w in weight.items() if v not in whole)
        rate = max(0.0, kept - sum(tokens[v] for v in whole)) / rest if rest else 0.0
        more = whole | {v for v, w in weight.items() if w > 0 and rate * w >= tokens[v]}
        if more == whole:
            return {v: float(tokens[v]) if v in whole else rate * w for v, w in weight.items()}
        whole = more


def plain_mix(rows, targets=None, keep=0.5, power=0.5, rounds=60, together=6, tolerance=0.001):
    """(doc_id, probability) kept of (doc_id, text, tokens, cell) rows, the cells'
    expected tokens and the targets."""
    cells = collections.Counter()
    for _, _, tokens, cell in rows:
        cells[cell] += tokens
    total = sum(cells.values())
    kept = keep * total
    places = range(len(next(iter(cells))))
    held = [collections.Counter() for _ in places]
    for c, n in cells.items():
        for p in places:
            held[p][c[p]] += n
    if targets is None:
        targets = []
        for sums in held:
            raised = {v: n**power for v, n in sums.items() if n}
            targets.append({v: x / sum(raised.values()) for v, x in raised.items()})
    goals = [plain_goals(held[p], {v: x for v, x in targets[p].items() if v in held[p]}, kept) for p in places]
    weight = {c: n * kept / total for c, n in cells.items()}
    for done in range(1, rounds + 1):
        for p in places:
            for v in held[p]:
                own = [c for c in cells if c[p] == v]
                goal = goals[p].get(v, 0.0)
                full = [c for c in own if weight[c] >= cells[c]]
                free = [c for c in own if weight[c] < cells[c]]
                fixed, loose = sum(weight[c] for c in full), sum(weight[c] for c in free)
                for c in full:
                    weight[c] = min(weight[c] * (goal / fixed if fixed > goal else 1.0), cells[c])
                for c in free:
                    weight[c] = min(weight[c] * (max(goal - fixed, 0.0) / loose if loose else 0.0), cells[c])
        off = max(
            abs(sum(w for c, w in weight.items() if c[p] == v) - goals[p].get(v, 0.0)) for p in places for v in held[p]
        )
        if done % together == 0 and off <= tolerance * kept:
            break
    chance = {c: min(1.0, weight[c] / n) if n else 0.0 for c, n in cells.items()}
    out = []
    for doc_id, text, _, cell in rows:
        key = str(doc_id) if doc_id is not None else text or ""
        u = int(hashlib.md5(f"20:{key}".encode()).hexdigest()[:8], 16) / 2**32
        if u < chance[cell]:
            out.append((doc_id, round(chance[cell], 6)))
    return sorted(out, key=repr), weight, targets


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    df = QUERIES["op3_mixing"](spark, folder)
    docs = table(spark, folder, "documents").withColumn("topic", marginals()["topic"])
    rows = [(r["doc_id"], r["text"], len((r["text"] or "").split()), (r["source"], r["lang"], r["topic"])) for r in docs.collect()]
    wanted, weight, targets = plain_mix(rows)
    kept = sorted(((r["doc_id"], r["probability"]) for r in df.collect()), key=repr)
    assert [k for k, _ in kept] == [k for k, _ in wanted]
    # a cell at its limit is full or not by the order in which sums are added
    assert [p for _, p in kept] == pytest.approx([p for _, p in wanted], abs=2e-4)
    for bad in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan_of(df)


def test_odd_rows_and_given_targets(spark, docs):
    texts = [("a", "x"), ("a", None), (None, "x"), ("b", "x"), ("b", "y")] * 40
    rows = [(i, f"w {i} " + "z " * (i % 7), lang, source) for i, (lang, source) in enumerate(texts)]
    rows += [(500, None, "a", "x"), (501, "", "q", "x"), (None, "no id", "a", "x"), (7, rows[7][1], *rows[7][2:])]
    df = docs(rows).withColumnRenamed("n_chars", "probability")
    by = {"source": F.col("source"), "lang": F.col("lang")}
    cells = [(i, t, len((t or "").split()), (s or mixing.NONE, la or mixing.NONE)) for i, t, la, s in rows]
    wanted, _, _ = plain_mix(cells)
    found = mixing.mix(df, by).collect()
    assert sorted(((r["doc_id"], round(r["mix_probability"], 6)) for r in found), key=repr) == wanted
    assert mixing.mix(df.limit(0), by).count() == 0
    shares = {"source": {"x": 0.9, "y": 0.1}, "lang": {"a": 0.5, "b": 0.5}}
    targets = {n: spark.createDataFrame([*t.items()], "v string, t double") for n, t in shares.items()}
    wanted, _, _ = plain_mix(cells, [shares["source"], shares["lang"]], keep=0.2)
    found = mixing.mix(df, by, targets=targets, keep=0.2).collect()
    assert sorted(((r["doc_id"], round(r["mix_probability"], 6)) for r in found), key=repr) == wanted


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_expected_sample_has_the_feasible_shares(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.shares(docs, marginals()).collect()
    assert {r.marginal for r in rows} == {"source", "lang", "topic"}
    scarce = {r.marginal for r in rows if not r.feasible}
    for marginal in ("source", "lang", "topic"):
        own = [r for r in rows if r.marginal == marginal]
        assert sum(r.expected for r in own) == pytest.approx(1, abs=1e-6)
        if marginal not in scarce:
            assert all(abs(r.expected - r.target) <= 0.005 for r in own)
        # what scarce categories lack goes to the others in proportion
        missing = sum(r.target - r.expected for r in own if not r.feasible)
        plenty = sum(r.target for r in own if r.feasible)
        for r in own:
            if r.feasible:
                assert r.expected == pytest.approx(r.target * (1 + missing / plenty), abs=0.005)


def test_infeasible_and_contradicting_targets(spark, docs):
    rows = [(i, "w " * 10, "a" if i < 10 else "b", "x" if i % 2 else "y") for i in range(100)]
    by = {"lang": F.col("lang"), "source": F.col("source")}
    share = lambda **t: spark.createDataFrame([*t.items()], "v string, t double")
    targets = {"lang": share(a=0.5, b=0.5), "source": share(x=0.5, y=0.5)}
    found = {(r.marginal, r.category): r for r in mixing.shares(docs(rows), by, targets=targets).collect()}
    assert not found["lang", "a"].feasible and found["lang", "a"].expected == pytest.approx(0.2, abs=0.002)
    assert found["source", "x"].expected == pytest.approx(0.5, abs=0.002)
    # languages and sources that are the same thing can't have other shares
    rows = [(i, "w " * 10, "ab"[i % 2], "xy"[i % 2]) for i in range(100)]
    targets = {"lang": share(a=0.2, b=0.8), "source": share(x=0.5, y=0.5)}
    assert mixing.mix(docs(rows), by, targets=targets, rounds=12).count() > 0


def test_columns_named_like_added_ones(docs):
    df = docs([(i, "a b c", "en", "x") for i in range(50)])
    df = df.withColumns({name: F.lit("old") for name in ("mix_probability", "mix_source", "mix_tokens", "tokens", "weight")})
    found = mixing.mix(df, {"source": F.col("source")})
    assert found.where("mix_source = 'x' AND mix_probability <= 1 AND tokens = 'old'").count() == found.count() > 0

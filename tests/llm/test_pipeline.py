"""The pipeline's stages, each against what its operator's tests vouch for."""

import corpus_pipeline as pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_personal_data import plain_spans
from tests.llm.test_tokens import check_packing, plain
from tidelog.llm.tables import table


def test_stages(spark, docs):
    folder = "/root/testdata/sf0.01"
    names = ["language_id", "jaccard_join", "personal_data", "mixing", "packing"]
    assert [n for n, _ in pipeline.STAGES] == names
    start = table(spark, folder, "documents").unionByName(docs([(-1, "..."), (-2, None), (-3, "ok @x")]))
    stages = [f for _, f in pipeline.STAGES]

    known = stages[0](spark, start, folder)
    assert known.columns == start.columns
    rows = known.collect()
    assert {r["doc_id"] for r in start.collect()} - {r["doc_id"] for r in rows} == {-1, -2}
    assert all(r["lang"] for r in rows)

    single = stages[1](spark, known, folder)
    classes = {c for v in brute([(r["doc_id"], r["text"]) for r in rows]).values() for c in v}
    left = single.collect()
    assert {r["doc_id"] for r in left} == classes and len(left) == len(classes)

    clean = stages[2](spark, single, folder)
    assert clean.columns == start.columns
    texts = {r["doc_id"]: r["text"] for r in left}
    for r in clean.collect():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not any(c in "0123456789@" for c in texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]

    mixed = stages[3](spark, clean, folder)
    assert mixed.columns == start.columns and 0 < mixed.count() < clean.count()

    packed = stages[4](spark, mixed, folder).collect()
    check_packing(packed, 2048)
    assert sum(r["length"] for r in packed) == sum(len(plain(r["text"])) + 1 for r in mixed.collect())


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0

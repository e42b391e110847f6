"""Personal data: base spans against plain patterns, what the trees add."""

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import personal_data as pii
from tidelog.llm.queries import QUERIES, spans_digest
from tidelog.llm.tables import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        doubled = [x * 2 if i % 2 else x for i, x in enumerate(reversed(d))]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a.@-+1 2(5%é_4"), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("4. 1-"), max_size=60))
def test_base_spans_of_numbers(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    rows = QUERIES["op9_personal_data"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        told = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        for kind in pii.BASE_KINDS:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in spans)
        assert set(told) <= set(r["spans"].split(",")) | {""}


def taught_texts(n=2400):
    rng = random.Random(6)

    def word():
        return "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))

    def some(k):
        return " ".join(word() for _ in range(k))

    out = []
    for i in range(n):
        number = lambda k: "".join(rng.choices("0123456789", k=k))
        about = [
            f"call +1 ({number(3)}) 555-{number(4)}",
            f"{word()}.{number(2)}@mail.{word()}.com",
            f"password={rng.getrandbits(64):016x}a",
            f"in {rng.randint(1900, 2030)} about {number(3)} of {number(2)}",
            f"part{number(2)} {number(6)}",
        ][i % 5]
        out.append(f"{some(8)} {about} {some(6)}")
    return out


def test_trees_add_what_patterns_miss(docs):
    df = docs(taught_texts())
    finder = pii.fit_finder(df, F.col("text"), F.col("doc_id"))
    assert set(finder.models) == set(pii.MORE_KINDS)
    texts = ["please call (269) 555-3296 ok", "write abc.12(at)mail.xyz.com now", "no data of 1990 here", "only words here"]
    found = pii.find(docs(texts), finder).orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["spans"]] for r in found]
    assert kinds[0] == ["number"] and kinds[1] == ["contact"]
    assert kinds[2:] == [[], []]


def test_odd_rows(docs):
    texts = [None, "", "x@y.zz " * 3000, "1" * 50_000, "@" * 500, "\U0001f600 a@b.cc", "a@b.cc", "a@b.cc"]
    df = docs([*texts, (7, "a@b.cc")]).withColumnRenamed("source", "spans")
    finder = pii.fit_finder(df, F.col("text"), F.col("doc_id"))
    rows = pii.find(df, finder).select("doc_id", *(c.alias(n) for n, c in spans_digest("spans").items())).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and by[0]["all_spans"] == by[1]["all_spans"] == ""
    assert by[2]["n_email"] == 3000 and by[5]["all_spans"] == "email:2:8"
    assert pii.find(df.limit(0), finder).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs(texts), finder).collect()}
    assert clean[0] is None and clean[6] == "[EMAIL]" and clean[5] == "\U0001f600 [EMAIL]"
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_rare_kinds_are_learned(docs):
    rng = random.Random(8)
    texts = [f"{t} {rng.randint(1, 99)}" for t in taught_texts(4000) if "password" not in t and "@" not in t]
    rare = [f"some words password={rng.getrandbits(64):016x}a and more" for _ in range(120)]
    at = ["written to someone at home", "and nothing"]
    df = docs(texts + rare + at)  # about one text in twenty; ten or so in the drawn ones
    finder = pii.fit_finder(df, F.col("text"), F.col("doc_id"), sample=200)
    assert "secret" in finder.models and finder.thresholds["secret"] <= 1
    keys = pii.find(docs(rare), finder).collect()
    assert sum("secret" in [s["kind"] for s in r["spans"]] for r in keys) > 100
    assert "contact" not in finder.models


def test_examples_are_drawn_from_the_whole_text():
    text = " ".join(f"value 10{i:06d}" for i in range(400)) + " write to abc@mail.com"
    found = pii.examples(text, 5, 20, 6)
    assert [kind for kind, wanted, _ in found if wanted] == ["contact"] * 2
    assert sum(kind == "number" for kind, *_ in found) == 20 + 6
    assert found == pii.examples(text, 5, 20, 6) != pii.examples(text, 6, 20, 6)


def secrets(text):
    return {text[a:b] for kind, a, b in pii.candidates(text) if kind == "secret"}


def test_secrets_of_any_length_are_proposed():
    rng = random.Random(3)
    for n in (12, 64, 65, 128, 5000, 300_000):
        key = "".join(rng.choices("0123456789abcdef", k=n))
        assert key in secrets(f"see {key}, ok") and key in secrets(f"token={key}")
    parts = ["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIi0" * 20, "SflKxw-_9" * 15]
    assert set(parts) <= secrets(f"auth {'.'.join(parts)} end")
    assert {"hunter2"} == secrets("Password: hunter2. Then") == secrets("my password = 'hunter2'")
    assert {"abc"} == secrets("secret:abc") and secrets("token: ") == set() and {"a b;c"} == secrets('api_key="a b;c"')
    assert secrets("a secretary: none, no passage: here") == set()


def test_long_and_short_secrets_are_redacted(docs):
    rng = random.Random(4)
    plain = [t for t in taught_texts(1500) if "password" not in t]
    long = [f"some words token={rng.getrandbits(512):0128x} and more" for _ in range(150)]
    short = [f"some words password: x{rng.randint(10, 99)}{c}9 and more" for c in "abcdefgh" for _ in range(20)]
    finder = pii.fit_finder(docs(plain + long + short), F.col("text"), F.col("doc_id"))
    clean = [r["text"] for r in pii.redacted(docs(long + short), finder).orderBy("doc_id").collect()]
    assert sum("[SECRET]" in t for t in clean[:150]) > 140 and sum("[SECRET]" in t for t in clean[150:]) > 140


def test_many_spans_in_one_text_take_little_time():
    text = " ".join(f"u{i}@example.org, +1 555 {i % 900 + 100} 0{i % 1000:03d}" for i in range(100_000))
    base = pii.base_spans(text)
    begin = time.monotonic()
    pii.teaching(text)
    held = pii.Covered(base)
    assert all(held.meets(a, b) for _, a, b in base[::1000])
    assert not held.meets(base[0][2], base[0][2] + 1)
    assert time.monotonic() - begin < 60


def test_covered_equals_looking_at_all():
    draw = random.Random(2)
    spans = [("k", a, a + draw.randint(1, 9)) for a in (draw.randint(0, 300) for _ in range(40))]
    held = pii.Covered(spans)
    for _ in range(2_000):
        a = draw.randint(0, 310)
        b = a + draw.randint(1, 12)
        assert held.meets(a, b) == any(a < e and s < b for _, s, e in spans)


def test_clashing_text_column(spark):
    df = spark.createDataFrame([(1, "a@b.org", "x", "y")], "doc_id long, text string, _text_ string, _text string")
    found = pii.find(df, pii.Finder())
    assert found.columns == [*df.columns, "spans"] and len(found.first().spans) == 1

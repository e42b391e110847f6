"""Personal data in texts: wide generators, boosted trees, calibrated thresholds.

Base kinds (email, ip, card, phone) follow fixed patterns and checks and are
always kept. Wider generators propose overlapping further spans: addresses with
a written-out "at" (``contact``), runs of digits of any grouping (``number``) and
keys or passwords (``secret``: runs of 12 or more characters with a digit, however
long, and any value after a key's name). Boosted trees score them by format and context;
where several overlap, the best stays, and none that overlaps a base span.

The trees of each further kind learn from texts drawn by hash: about ``sample``
of all, and for each kind about ``vouched`` of those that hold a positive of it,
however rare they are. A text teaches at most ``each`` positives and ``each``
negatives of a kind, and ``words`` words as negatives, drawn by its hash.
Positives are spans that a check vouches for, rewritten as the base patterns miss
them (a phone number without its country code, an address with "(at)", the value
after ``password=``); negatives are other candidates. The marks that vouch for a
span are no features.

A third of the texts, by hash, teaches nothing: all candidates of all these texts
are scored and counted, and the counts set the threshold at which ``precision`` is
met in the whole table, so what was drawn needs no weights. A kind adds nothing
with less than 5 positives on either side, or where no threshold will do: with 0.95
and one wrong row in addition that takes 19 held-out positives in the table.

Cases: a null or empty text has no spans; offsets are code points, ends
exclusive; repeated rows are searched each; columns ``spans`` are replaced.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.boosting import BoostedTrees, calibrated
from tidelog.llm.tables import fresh, q, stored

# Kinds in order, base kinds first.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("contact", "number", "secret")
KINDS = BASE_KINDS + MORE_KINDS

# Characters and patterns of the base kinds. A number can't begin
# inside a run of digits, as the run's beginning would have matched before.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer

# Texts without any of this have no spans; also read by Spark.
ANY = r"[0-9@]|[(\[{] ?at ?[)\]}]|(?i:pass(?:word|wd)?|secret|token|api[_-]?key)\s?[=:]"
_ANY = re.compile(ANY).search
_CONTACT = re.compile(
    r"[\w.+-]{1,64} ?(?:@|[(\[{] ?at ?[)\]}]) ?\w[\w-]{0,62}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?\w[\w-]{0,62}){1,4}"
).finditer
_NUMBER = re.compile(r"(?<![\w+])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){5,18}(?![\w])").finditer
# Runs of any length, read once; those without a digit are words.
_SECRET = re.compile(r"(?<![\w/+=-])[A-Za-z0-9_/+=-]{12,}+(?!\w)").finditer
_DIGIT = re.compile(r"[0-9]").search
# What may stand between a key's name and its value, and the value.
_SET = re.compile(r"\s?[=:]\s?[\"']?").finditer
_VALUE = re.compile(r"[^\s\"']+").match
_QUOTED = {c: re.compile(rf"[^{c}\n]+(?={c})").match for c in "\"'"}
_CUE = re.compile(
    r"(?i)(pass(?:word|wd)?|secret|token|api[_-]?key|key|tel|phone|fax|call|mobile|mail|contact|id|ssn|iban|no)\W{0,3}\Z"
).search
_KEYED = re.compile(r"(?i)(?:pass(?:word|wd)?|secret|token|api[_-]?key)\s?[=:]\s?[\"']?\Z").search
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}").fullmatch
_WORDS = re.compile(r"[^\W_]{4,}(?: [^\W_]+){0,2}").finditer
_KEY_NAME = re.compile(r"(?i)\A(?:pass(?:word|wd)?|secret|token|api[_-]?key)[=:]").match

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """From each @ to both sides, so a long word is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (domain := _DOMAIN(text, at)):
            done = domain.end()
            yield "email", begin, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    found = [*_emails(text)] if "@" in text else []
    for m in _IP(text):
        parts = [p.lstrip("0") or "0" for p in m.groups()]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    return found


def _key_values(text: str) -> Iterator[tuple[int, int]]:
    """Any value after a key's name: to white space or a quote, or to the closing quote."""
    done = 0
    for m in _SET(text):
        begin = m.end()
        if begin < done or not _KEYED(text[max(0, begin - 24) : begin]):
            continue
        quoted = _QUOTED.get(text[begin - 1])
        value = quoted and quoted(text, begin)
        if value:
            done = value.end()
            yield begin, done
        elif value := _VALUE(text, begin):
            done = value.end()
            end = begin + len(value[0].rstrip(".,;:!?)]}>"))
            if end > begin:
                yield begin, end


def candidates(text: str, kinds: tuple[str, ...] = MORE_KINDS) -> list[Span]:
    """What the wide generators propose; spans may overlap."""
    found: list[Span] = []
    if "contact" in kinds and ("at" in text or "@" in text):
        found += [("contact", m.start(), m.end()) for m in _CONTACT(text)]
    if "number" in kinds:
        found += [("number", m.start(), m.end()) for m in _NUMBER(text)]
    if "secret" in kinds:
        places = set()
        for m in _SECRET(text):
            name = _KEY_NAME(m[0])
            begin = m.start() + (name.end() if name else 0)
            if begin < m.end() and _DIGIT(text, begin, m.end()):
                places.add((begin, m.end()))
        places.update(_key_values(text))
        found += [("secret", a, b) for a, b in sorted(places)]
    return found


def features(text: str, begin: int, end: int, cue: bool | None = None) -> list[float]:
    """Format of a span and its surroundings."""
    span = text[begin:end]
    n = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    upper = sum(c.isupper() for c in span)
    lower = sum(c.islower() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    kinds = ["d" if "0" <= c <= "9" else "u" if c.isupper() else "l" if c.islower() else "o" for c in span]
    counts = Counter(span).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    before, after = text[max(0, begin - 16) : begin], text[end : end + 1]
    if cue is None:
        cue = bool(_CUE(before))
    return [
        n,
        digits,
        digits / n,
        upper / n,
        lower / n,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        entropy,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        n - digits - upper - lower,
        span.count(" ") + span.count("-"),
        "(" in span,
        "." in span or "dot" in span,
        cue,
        before[-1:] in (" ", "\n", ""),
        after in (" ", "\n", "", ".", ","),
        bool(digits) and luhn(_digits(span)),
    ]


def _vouched(text: str, kind: str, a: int, b: int) -> bool:
    """Whether a candidate is a key or the value of one."""
    return kind == "secret" and bool(_KEYED(text[max(0, a - 24) : a]) or _ACCESS_KEY(text, a, b))


class Covered:
    """The stretches of a text that spans cover, apart and in order."""

    def __init__(self, spans: list[Span] = ()):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.ends, a)
        return at < len(self.begins) and self.begins[at] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none."""
        at = bisect_right(self.ends, a)
        self.begins.insert(at, a)
        self.ends.insert(at, b)


def positives(text: str, base: list[Span]) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of the base spans, rewritten as the base patterns miss them."""
    for kind, a, b in base:
        span, told = text[a:b], []
        if kind == "phone":
            rest = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
            told = [("number", rest)] if len(_digits(rest)) >= 7 else []
        elif kind == "email":
            ways = (("(at)", "."), (" [at] ", " [dot] "))
            told = [("contact", span.replace("@", at).replace(".", dot)) for at, dot in ways]
        elif kind == "card":
            told = [("number", ".".join(span[i : i + 4] for i in range(0, len(span), 4)))]
        for more, new in told:
            # Features look at a few characters to both sides.
            before = text[max(0, a - 64) : a]
            yield more, before + new + text[b : b + 64], len(before), len(before) + len(new)


def teaching(text: str) -> list[tuple[str, bool, str, int, int]]:
    """(kind, wanted, text, begin, end) of all that a text can teach but words."""
    base = base_spans(text)
    held = Covered(base)
    out = [(kind, True, *rest) for kind, *rest in positives(text, base)]
    for kind, a, b in candidates(text):
        if not held.meets(a, b):
            out.append((kind, _vouched(text, kind, a, b), text, a, b))
    return out


def taught_features(kind: str, wanted: bool, text: str, a: int, b: int) -> list[float]:
    # What vouches for a secret is hidden, here and when it is asked for.
    return features(text, a, b, cue=False if wanted and kind == "secret" else None)


def _asked(text: str, kind: str, a: int, b: int) -> list[float]:
    return taught_features(kind, _vouched(text, kind, a, b), text, a, b)


def examples(text: str, seed: int, each: int, words: int) -> list[tuple[str, bool, list[float]]]:
    """(kind, wanted, features) that a text teaches, drawn by ``seed`` where there are more."""
    rng = random.Random(seed)
    groups: dict[tuple[str, bool], list] = {}
    for found in teaching(text):
        groups.setdefault(found[:2], []).append(found)
    out = []
    for (kind, wanted), own in groups.items():
        for found in rng.sample(own, each) if len(own) > each else own:
            out.append((kind, wanted, taught_features(*found)))
    # Words teach what is nothing personal.
    places = [m.span() for m in _WORDS(text)]
    for a, b in rng.sample(places, words) if len(places) > words else places:
        out += [(kind, False, features(text, a, b)) for kind in MORE_KINDS]
    return out


def vouched_kinds(text: str) -> int:
    """The kinds that a text holds positives of, as bits."""
    base = base_spans(text)
    kinds = {kind for kind, *_ in positives(text, base)}
    if "secret" not in kinds:
        own = (s for s in candidates(text, ("secret",)) if _vouched(text, *s))
        held = Covered(base)
        if any(not held.meets(a, b) for _, a, b in own):
            kinds.add("secret")
    return sum(1 << MORE_KINDS.index(kind) for kind in kinds)


@dataclass
class Finder:
    """Base spans and what the trees of each further kind let pass."""

    models: dict[str, BoostedTrees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def more(self, texts: list[str], base: list[list[Span]]) -> list[list[tuple]]:
        """Per text the further spans (kind, begin, end, score)."""
        asked: dict[str, list[tuple[int, Span]]] = {}
        for i, text in enumerate(texts):
            held = Covered(base[i])
            for span in candidates(text):
                if span[0] in self.models and not held.meets(*span[1:]):
                    asked.setdefault(span[0], []).append((i, span))
        passed: list[list[tuple]] = [[] for _ in texts]
        for kind, spans in asked.items():
            rows = np.array([_asked(texts[i], *span) for i, span in spans], float)
            for (i, (_, a, b)), score in zip(spans, self.models[kind].score(rows), strict=True):
                if score >= self.thresholds[kind]:
                    passed[i].append((kind, a, b, float(score)))
        for i, spans in enumerate(passed):
            kept, held = [], Covered()
            for span in sorted(spans, key=lambda s: (-s[3], s[1], s[2])):
                if not held.meets(*span[1:3]):
                    held.add(*span[1:3])
                    kept.append(span)
            passed[i] = kept
        return passed


# Steps of a score that are told apart when thresholds are set.
STEPS = 1 << 14


def fit_finder(
    df: DataFrame,
    text: Column,
    key: Column,
    sample: int = 3_000,
    precision: float = 0.95,
    vouched: int = 1_000,
    each: int = 20,
    words: int = 6,
) -> Finder:
    """Trees from drawn texts, thresholds from all candidates of the held-out third."""
    docs = df.select(text.cast("string").alias("text"), F.xxhash64(key, text).alias("hash"))
    docs = docs.where(F.col("text").rlike(ANY))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array([vouched_kinds(text.as_py()) for text in batch.column(0)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), kinds], names=["hash", "kinds"])

    teaches = docs.where(F.pmod("hash", F.lit(3)) != 0)
    marks = stored(teaches.mapInArrow(marked, "hash long, kinds int"), "vouched-kinds")
    has = [F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(MORE_KINDS))]
    n, *counts = marks.agg(F.count("*"), *(F.count_if(h) for h in has)).first()
    place = F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) / float(1 << 30)
    wanted = place < (sample / n if n else 0.0)
    for h, count in zip(has, counts, strict=True):
        wanted = wanted | (h & (place < (vouched / count if count else 0.0)))
    # A few thousand numbers, so texts are only scanned, never dealt.
    hashes = [r[0] for r in marks.where(wanted).select("hash").distinct().collect()]
    drawn = teaches.where(F.col("hash").isin(hashes))

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, hash in zip(batch.column("text"), batch.column("hash"), strict=True):
                found = examples(text.as_py(), hash.as_py(), each, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e[0] for e in found], pa.string()),
                        pa.array([e[1] for e in found], pa.bool_()),
                        pa.array([[float(x) for x in e[2]] for e in found], pa.list_(pa.float64())),
                    ],
                    names=["kind", "wanted", "features"],
                )

    taken = drawn.mapInArrow(taught, "kind string, wanted boolean, features array<double>").toArrow()
    models: dict[str, BoostedTrees] = {}
    for kind in MORE_KINDS:
        own = taken.filter(pc.equal(taken["kind"], kind)).combine_chunks()
        right = own["wanted"].to_numpy().astype(float)
        if min(right.sum(), (1 - right).sum()) < 5:
            continue
        x = own["features"].combine_chunks().flatten().to_numpy().reshape(len(right), -1)
        order = np.lexsort((*x.T, right))  # rows come in any order
        models[kind] = BoostedTrees().fit(x[order], right[order])
    return Finder(models, {}) if not models else _with_thresholds(docs, models, precision)


def _with_thresholds(docs: DataFrame, models: dict[str, BoostedTrees], precision: float) -> Finder:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            asked: dict[str, list[tuple]] = {}
            for text in batch.column(0):
                for found in teaching(text.as_py()):
                    if found[0] in models:
                        asked.setdefault(found[0], []).append(found)
            for kind, own in asked.items():
                score = models[kind].score(np.array([taught_features(*found) for found in own], float))
                step = np.minimum((score * STEPS).astype(np.int64), STEPS - 1)
                right = np.bincount(step, [found[1] for found in own], STEPS).astype(np.int64)
                total = np.bincount(step, minlength=STEPS)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(at), pa.string()), *map(pa.array, (at, right[at], total[at]))],
                    names=["kind", "step", "wanted", "n"],
                )

    held = docs.where(F.pmod("hash", F.lit(3)) == 0)
    counts = held.mapInArrow(scored, "kind string, step long, wanted long, n long")
    counts = counts.groupBy("kind", "step").agg(F.sum("wanted"), F.sum("n")).collect()
    finder = Finder()
    for kind, model in models.items():
        right, total = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
        for _, step, wanted, n in (r for r in counts if r[0] == kind):
            right[step], total[step] = wanted, n
        if right.sum() >= 5:
            finder.models[kind] = model
            finder.thresholds[kind] = max(0.5, calibrated(right, total, precision))
    return finder


SPANS = T.ArrayType(
    T.StructType()
    .add("kind", "string")
    .add("begin", "long")
    .add("end", "long")
    .add("base", "boolean")
    .add("score", "double")
)


# Texts looked at together.
TOGETHER = 256


def _all_spans(finder: Finder, column: pa.Array) -> list[list[tuple]]:
    """Per text all spans (kind, begin, end, base, score) by begin, then kind as listed."""
    texts, rows = [], []
    for i, text in enumerate(column):
        text = text.as_py()
        if text and _ANY(text):
            texts.append(text)
            rows.append(i)
    base = [base_spans(text) for text in texts]
    spans: list[list[tuple]] = [[] for _ in range(len(column))]
    for i, certain, likely in zip(rows, base, finder.more(texts, base), strict=True):
        both = [(k, a, b, True, 1.0) for k, a, b in certain]
        both += [(k, a, b, False, s) for k, a, b, s in likely]
        spans[i] = sorted(both, key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def find(df: DataFrame, finder: Finder, text_column: str = "text") -> DataFrame:
    """``df`` with ``spans``: all spans by begin, then kind as listed."""
    kept = [c for c in df.columns if c.lower() != "spans"]
    (own,) = fresh(df, "text")
    narrow = df.select(*(q(c) for c in kept), q(text_column).cast("string").alias(own))
    schema = df.select(*(q(c) for c in kept)).schema.add("spans", SPANS)
    arrow = pa.list_(
        pa.struct(
            [
                ("kind", pa.string()),
                ("begin", pa.int64()),
                ("end", pa.int64()),
                ("base", pa.bool_()),
                ("score", pa.float64()),
            ]
        )
    )

    fields = ("kind", "begin", "end", "base", "score")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            all_spans = _all_spans(finder, batch.column(batch.num_columns - 1))
            spans = [[dict(zip(fields, s, strict=True)) for s in own] for own in all_spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(spans, arrow)],
                names=[*kept, "spans"],
            )

    return narrow.mapInArrow(found, schema)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, named instead."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, finder: Finder, text_column: str = "text") -> DataFrame:
    """``df`` with its texts redacted; nothing else changes.

    Spans are found and named in one Python worker a task, ``TOGETHER`` texts at a time.
    """
    place = [c.lower() for c in df.columns].index(text_column.lower())
    names = df.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            columns = [*batch.columns]
            spans = _all_spans(finder, columns[place])
            texts = [
                redact(text.as_py(), [s[:3] for s in own])
                for text, own in zip(columns[place], spans, strict=True)
            ]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = q(text_column).cast("string").alias(names[place])
    kept = df.select(*(text if i == place else q(c) for i, c in enumerate(names)))
    return kept.mapInArrow(cleaned, kept.schema)

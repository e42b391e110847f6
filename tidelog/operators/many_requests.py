"""Many saved searches over one log in a single pass.

``requests`` has ``(id, index, q, gte, lte)``; NULL ``q``, ``gte`` or ``lte``
means no condition.  The log side has ``(_index, ts, raw)`` at least.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.times import TimeColumn

# Fixed bucket widths in seconds (an hour, a day, a month, three years); a
# request longer than the last one, or open, gets one bucket for all of time.
WIDTHS = (3_600, 86_400, 2_592_000, 94_608_000)
_OPEN = len(WIDTHS)

@dataclass(frozen=True)
class LogSide:
    """Which columns of the log a request is matched against.

    ``partition`` is the DATE column of a time table, if the log is one.
    """

    index: str = "_index"
    time: str = "ts"
    raw: str = "raw"
    id: str | None = None
    partition: str | None = None


@dataclass(frozen=True)
class RequestsProfile:
    """What is measured of the requests, in one aggregation that ends as one row.

    ``gte`` and ``lte`` enclose all requests, None where one of them is open.
    ``levels`` are the bucket widths in use: at most len(WIDTHS) + 1.
    """

    levels: tuple[int, ...]
    gte: datetime | None
    lte: datetime | None


def profile_requests(requests: DataFrame) -> RequestsProfile:
    ntz = TimeColumn.of(requests, "gte").ntz
    lo, hi = _bounds(ntz)
    row = requests.selectExpr(
        f"collect_set({_level(lo, hi)}) AS levels",
        f"CASE WHEN count(*) = count(gte) THEN {times.unix_micros('min(gte)', ntz)} END AS gte",
        f"CASE WHEN count(*) = count(lte) THEN {times.unix_micros('max(lte)', ntz)} END AS lte",
    ).first()
    gte, lte = (None if us is None else times.micros_instant(us) for us in (row.gte, row.lte))
    return RequestsProfile(tuple(sorted(row.levels)), gte, lte)


def _bounds(ntz: bool) -> tuple[str, str]:
    """Unix seconds of a request's bounds."""
    return tuple(f"({times.unix_seconds(bound, ntz)})" for bound in ("gte", "lte"))


def match_requests(
    logs: DataFrame, requests: DataFrame, log: LogSide = LogSide(), by_trigrams: bool = False
) -> DataFrame:
    """Every log row with the ``id`` of each request it answers.

    One plan for any number of requests.  A row meets the distinct texts that
    are asked of its index near its time, each tested once however many
    requests share it; rows that hold one then meet its requests by the same
    bucket and are tested against their bounds.  Both are equality joins
    without hints: Spark broadcasts a side that it knows to be small, and
    splits hot buckets of a shuffled one.  The log is first cut to the range
    that encloses all requests, which takes a job over the requests while the
    plan is built.

    ``by_trigrams`` is for very many texts: a row is then tested against those
    texts only whose rarest trigram it holds (see ``trigram_candidates``).
    """
    if TimeColumn.of(logs, log.time).ntz != TimeColumn.of(requests, "gte").ntz:
        raise ValueError("the log and the requests need the same kind of timestamp")
    return _matched(logs, requests, profile_requests(requests), log, by_trigrams)


def match_conditions(
    logs: DataFrame, requests: DataFrame, log: LogSide = LogSide(), by_trigrams: bool = False
) -> DataFrame:
    """As ``match_requests``, once for all requests that ask the same: the ``id``
    is what they ask (see ``condition``).

    Rows follow the conditions, however many requests share them. What is made
    of them goes to the requests by ``per_request``.
    """
    if TimeColumn.of(logs, log.time).ntz != TimeColumn.of(requests, "gte").ntz:
        raise ValueError("the log and the requests need the same kind of timestamp")
    asked = requests.select(*_ASKED).distinct().withColumn("id", condition())
    return _matched(logs, asked, profile_requests(requests), log, by_trigrams)


_ASKED = ["index", "q", "gte", "lte"]


def condition() -> Column:
    """What a request asks, as one value; fields may be NULL and are then equal."""
    return F.struct(*_ASKED)


def per_request(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows whose ``id`` is a condition, for each request that asks it."""
    asked = requests.select("id", condition().alias("_asked"))
    each = found.withColumnRenamed("id", "_asked").join(asked, "_asked")
    return each.select("id", *[F.col(times.quoted(name)) for name in found.columns if name != "id"])


def _matched(
    logs: DataFrame, requests: DataFrame, profile: RequestsProfile, log: LogSide, by_trigrams: bool
) -> DataFrame:
    asked = _by_bucket(requests)
    texts = asked.select(*_KEYS, "_q").distinct()
    side = _with_buckets(_enclosing(logs, log, profile), log, profile.levels or (_OPEN,))
    candidates = trigram_candidates if by_trigrams else bucket_candidates
    raw = F.col(times.quoted(log.raw))
    held = candidates(side, texts, log).where(F.col("_q").isNull() | raw.contains(F.col("_q")))
    ts = F.col(f"log.{times.quoted(log.time)}")
    joined = held.alias("log").join(
        asked.alias("req"),
        _same_bucket("log", "req", log)
        & F.col("log._q").eqNullSafe(F.col("req._q"))
        & (F.col("req._gte").isNull() | (ts >= F.col("req._gte")))
        & (F.col("req._lte").isNull() | (ts <= F.col("req._lte"))),
    )
    return joined.select(
        F.col("req._id").alias("id"),
        *[F.col(f"log.{times.quoted(name)}").alias(name) for name in logs.columns],
    )


_KEYS = ["_request_index", "_level", "_bucket"]

# Slots of the set by which trigrams that no text has are dropped.
SLOTS = 1 << 16


def bucket_candidates(side: DataFrame, texts: DataFrame, log: LogSide) -> DataFrame:
    """Rows with each distinct text ``_q`` that is asked near their time."""
    near = side.alias("log").join(texts.alias("text"), _same_bucket("log", "text", log))
    return near.select("log.*", F.col("text._q").alias("_q"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def _slot(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(SLOTS)).cast("int")


def rarest_trigrams(texts: DataFrame, side: DataFrame, log: LogSide, share: float = 0.01) -> DataFrame:
    """``(_q, _gram)``: of each text the trigram that fewest rows, then fewest
    texts have. Rows are a sample of ``share``: it steers speed, not results."""
    distinct = texts.select("_q").distinct()
    grams = distinct.select("_q", F.explode(trigrams(F.col("_q"))).alias("_gram"))
    asked = grams.groupBy("_gram").agg(F.count("*").alias("_texts"))
    rows = side.select(F.col(times.quoted(log.raw)).alias("_raw")).sample(share, seed=1)
    seen = rows.select(F.explode(trigrams(F.col("_raw"))).alias("_gram")).groupBy("_gram").count()
    rated = asked.join(seen, "_gram", "left").select(
        "_gram", F.struct(F.coalesce("count", F.lit(0)).alias("rows"), "_texts", "_gram").alias("_rate")
    )
    return grams.join(rated, "_gram").groupBy("_q").agg(F.min("_rate").alias("_rate")).select(
        "_q", F.col("_rate._gram").alias("_gram")
    )


def trigram_candidates(side: DataFrame, texts: DataFrame, log: LogSide) -> DataFrame:
    """As ``bucket_candidates``, less the texts whose rarest trigram a row lacks.

    An inverted index from trigrams to texts, joined on index, time bucket and
    trigram. Before rows are listed by their trigrams, those are dropped that no
    text goes by, up to hash collisions: a set of ``SLOTS`` bits, whatever the
    number of texts, which a job over the texts makes while the plan is built.
    """
    short = F.col("_q").isNull() | (F.length("_q") < 3)
    long = texts.where(~short)
    kept = rarest_trigrams(long, side, log)
    words = kept.select(_slot(F.col("_gram")).alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pmod(slot, 64))")).alias("bits")
    )
    bits = [0] * (SLOTS // 64)
    for row in words.collect():
        bits[row.word] = row.bits
    if not any(bits):
        return bucket_candidates(side, texts.where(short), log)
    held = F.expr(f"array({', '.join(f'{b}L' if b > -(1 << 63) else 'bigint(-9223372036854775808)' for b in bits)})")
    wanted = F.filter(
        trigrams(F.col(times.quoted(log.raw))),
        lambda g: F.getbit(F.element_at(held, F.shiftright(_slot(g), 6) + 1), F.pmod(_slot(g), F.lit(64))) == 1,
    )
    posted = long.join(kept, "_q")
    rows = side.select("*", F.explode(wanted).alias("_row_gram"))
    near = rows.alias("log").join(
        posted.alias("text"), _same_bucket("log", "text", log) & (F.col("log._row_gram") == F.col("text._gram"))
    )
    found = near.select("log.*", F.col("text._q").alias("_q")).drop("_row_gram")
    return found.unionByName(bucket_candidates(side, texts.where(short), log))



def _same_bucket(left: str, right: str, log: LogSide) -> Column:
    index = F.col(f"{left}.{times.quoted(log.index)}") == F.col(f"{right}._request_index")
    return (
        index
        & (F.col(f"{left}._level") == F.col(f"{right}._level"))
        & (F.col(f"{left}._bucket") == F.col(f"{right}._bucket"))
    )


def _enclosing(logs: DataFrame, log: LogSide, profile: RequestsProfile) -> DataFrame:
    """Log rows that can match at all; pushed to the scan."""
    time = TimeColumn.of(logs, log.time)
    logs = logs.where(time.between(profile.gte, profile.lte))
    if log.partition is not None:
        day = times.quoted(log.partition)
        if profile.gte is not None:
            logs = logs.where(f"{day} >= DATE'{profile.gte.date()}'")
        if profile.lte is not None:
            logs = logs.where(f"{day} <= DATE'{profile.lte.date()}'")
    return logs


def _bucket(seconds: str, level: int) -> str:
    """Number of the bucket; all of time is one bucket on the open level."""
    return "0L" if level == _OPEN else times.floor_div(seconds, WIDTHS[level])


def _level(lo: str, hi: str) -> str:
    """The first level whose buckets are at least as long as the request, so
    that the request covers at most two of them."""
    cases = " ".join(f"WHEN {hi} - {lo} <= {w} THEN {i}" for i, w in enumerate(WIDTHS))
    return f"CASE WHEN gte IS NULL OR lte IS NULL THEN {_OPEN} {cases} ELSE {_OPEN} END"


def _by_bucket(requests: DataFrame) -> DataFrame:
    """Requests once for each bucket they cover, two at most."""
    lo, hi = _bounds(TimeColumn.of(requests, "gte").ntz)
    covered = " ".join(
        f"WHEN {i} THEN sequence({_bucket(lo, i)}, {_bucket(hi, i)})" for i in range(_OPEN)
    )
    return (
        # a reversed range matches nothing
        requests.where("NOT coalesce(gte > lte, false)")
        .withColumn("_level", F.expr(_level(lo, hi)))
        .withColumn("_bucket", F.expr(f"explode(CASE _level {covered} ELSE array(0L) END)"))
        .selectExpr(
            "id AS _id",
            "index AS _request_index",
            "_level",
            "_bucket",
            "q AS _q",
            "gte AS _gte",
            "lte AS _lte",
        )
    )


def _with_buckets(logs: DataFrame, log: LogSide, levels: tuple[int, ...]) -> DataFrame:
    """Log rows once for each bucket width in use (five at most)."""
    time = TimeColumn.of(logs, log.time)
    seconds = f"({times.unix_seconds(time.sql, time.ntz)})"
    slots = ", ".join(
        f"named_struct('_level', {level}, '_bucket', {_bucket(seconds, level)})"
        for level in levels
    )
    names = [F.col(times.quoted(name)) for name in logs.columns]
    return logs.select(*names, F.expr(f"inline(array({slots}))"))


def count_requests(
    logs: DataFrame, requests: DataFrame, log: LogSide = LogSide(), by_trigrams: bool = False
) -> DataFrame:
    """``request_counts`` of all requests, without the pairs of rows and requests:
    rows are counted by condition, requests of one ``id`` are added up."""
    counts = match_conditions(logs, requests, log, by_trigrams).groupBy("id").agg(F.count("*").alias("n"))
    return _of_all(requests, per_request(counts, requests).groupBy("id").agg(F.sum("n").alias("n")))


def request_counts(matched: DataFrame, requests: DataFrame) -> DataFrame:
    """``(id, n)`` for every request, 0 where nothing matched."""
    return _of_all(requests, matched.groupBy("id").agg(F.count("*").alias("n")))


def _of_all(requests: DataFrame, counts: DataFrame) -> DataFrame:
    return requests.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def request_histograms(matched: DataFrame, log: LogSide, seconds: int) -> DataFrame:
    """``(id, key, doc_count)``: a clock histogram per request."""
    time = TimeColumn.of(matched, log.time)
    start = F.window(time.name, f"{seconds} seconds")["start"]
    counts = (
        matched.select("id", start.alias("start"))
        .groupBy("id", "start")
        .agg(F.count("*").alias("doc_count"))
    )
    return counts.select(
        "id", F.expr(times.unix_millis("start", time.ntz)).alias("key"), "doc_count"
    )


def first_hits(
    logs: DataFrame, requests: DataFrame, log: LogSide, size: int, by_trigrams: bool = False
) -> DataFrame:
    """``request_hits`` of all requests, without the pairs of rows and requests.

    The first rows of each condition are found once, then told to its requests.
    Requests that share an ``id`` are ranked together, as in ``request_hits``.
    """
    first = request_hits(match_conditions(logs, requests, log, by_trigrams), log, size)
    return request_hits(per_request(first.drop("rank"), requests), log, size)


def request_hits(matched: DataFrame, log: LogSide, size: int) -> DataFrame:
    """The first ``size`` rows of each request, by second and then key.

    The rank limit is applied in every partition before the shuffle, so a
    request that matches a third of the log still moves few rows.
    """
    time = TimeColumn.of(matched, log.time)
    order = [time.seconds(), F.col(times.quoted(log.id or log.raw))]
    ranked = matched.withColumn(
        "rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= size)


def unknown_indexes(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """A failed result for every request whose index does not exist."""
    missing = requests.join(registry.select("index").distinct(), "index", "left_anti")
    return missing.select(
        "id",
        "index",
        F.lit(1).alias("total"),
        F.lit(0).alias("successful"),
        F.lit(0).alias("skipped"),
        F.lit(1).alias("failed"),
    )

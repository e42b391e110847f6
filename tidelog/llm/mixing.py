"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell, a cell being one combination of the marginals'
columns (source, language, topic). What is kept of the cells is raked: scaled to
one marginal's targets after the other, in rounds, until all hold. A cell can't
give more than it has, so cells that reach their tokens are held there and the
others are scaled to what remains of a target. A cell's documents are then kept
with the probability that gives its share in expectation. Whether a document is
kept is decided by a hash of its id, so reruns agree.

Targets are shares of the kept tokens. A category that has fewer tokens than its
share is wanted whole, and the others of its marginal in proportion for the rest;
``shares`` names such categories and tells wanted and expected shares. Rounds end
when no marginal is off by more than ``tolerance``, or after ``rounds``, where
marginals contradict each other.

Everything is DataFrame functions. Documents are only scanned: once for the
cells (partial sums before the shuffle, so a hot source is a row per task) and
once to be kept; rounds work on the cells.

Cases: a null category is a category of its own; a null text has no tokens and is
kept with its cell's probability (0 in a cell without tokens); a null id is
decided by its text; repeated rows share their fate; a category without a target
gets none; an empty table gives no rows; columns named like those that are added
are replaced, others pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import q, stored

# Cells without a category: what null is called inside.
NONE = "\x00"


def topic_of(text: Column) -> Column:
    """A stand-in for a topic label: what form a text has."""
    blank = text.isNull() | ~text.rlike("\\S")
    return (
        F.when(blank, "empty")
        .when(text.rlike("[@]|[0-9]{3}"), "records")
        .when(text.rlike("[$%&*#<>{}]{3}"), "marked")
        .when(~text.rlike("[a-z]"), "shouted")
        .otherwise("prose")
    )


def token_number(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def cells_of(docs: DataFrame, by: list[str], tokens: str) -> DataFrame:
    named = (F.coalesce(q(c).cast("string"), F.lit(NONE)).alias(c) for c in by)
    return docs.groupBy(*named).agg(F.sum(tokens).alias("tokens"))


def flattened(cells: DataFrame, column: str, power: float) -> DataFrame:
    """(column, target): shares of tokens raised to ``power``, adding up to 1."""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("n")).where("n > 0")
    raised = F.pow(F.col("n").cast("double"), F.lit(power))
    total = sums.agg(F.sum(raised)).first()[0]
    return sums.select(column, (raised / F.lit(total or 1.0)).alias("target"))


def bounded_targets(cells: DataFrame, column: str, target: DataFrame, kept: float) -> DataFrame:
    """(column, goal): the tokens wanted of each category, none more than it has."""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("tokens"))
    sums = stored(sums.join(target.withColumnRenamed("target", "weight"), column), "category-tokens")
    return with_goals(sums, kept).select(column, "goal")


def with_goals(sums: DataFrame, kept: float) -> DataFrame:
    """``sums`` (tokens, weight) with ``goal``: ``kept`` tokens dealt by weight,
    but no more than there are.

    Categories taken whole only grow in number, so this ends after as many looks
    as that number changes.
    """
    whole, taken = F.lit(False), -1
    while True:
        n, full, rest = sums.agg(
            F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))
        ).first()
        rate = max(0.0, kept - float(full or 0)) / rest if rest else 0.0
        if n == taken:
            break
        taken = n
        whole = whole | ((F.col("weight") > 0) & (F.lit(rate) * F.col("weight") >= F.col("tokens")))
    goal = F.when(whole, F.col("tokens").cast("double")).otherwise(F.lit(rate) * F.col("weight"))
    return sums.withColumn("goal", F.coalesce(goal, F.lit(0.0)))


def raked(
    cells: DataFrame, goals: dict[str, DataFrame], kept: float, rounds: int = 60, tolerance: float = 0.001, together: int = 6
) -> DataFrame:
    """``cells`` with ``goal_<column>`` and ``weight``: expected kept tokens that
    add up to the goals by each column, none above the cell's ``tokens``.

    ``together`` rounds make one job; a stored table of cells ends it. Cells are
    sums, one short row for a combination of categories however many documents it
    has, so a round needs no shuffle: its sums are taken over one partition.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens") * F.lit(kept / total if total else 0.0))
    for column, goal in goals.items():
        now = now.join(goal.withColumnRenamed("goal", f"goal_{column}"), column, "left")
    now = stored(now.fillna(0.0, [f"goal_{c}" for c in goals]), "raked-cells")
    for done in range(1, rounds + 1):
        now = now.coalesce(1)
        for column in goals:
            group = Window.partitionBy(column)
            full = F.col("weight") >= F.col("tokens")
            free = F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).over(group)
            held = F.sum(F.when(full, F.col("weight")).otherwise(0.0)).over(group)
            goal = F.col(f"goal_{column}")
            # cells that are full stay so unless they alone are too much
            rate = F.when(free > 0, F.greatest(goal - held, F.lit(0.0)) / free).otherwise(0.0)
            less = F.when(held > goal, goal / held).otherwise(1.0)
            scaled = F.when(full, F.col("weight") * less).otherwise(F.col("weight") * rate)
            now = now.withColumn("weight", F.least(scaled, F.col("tokens").cast("double")))
        if done % together == 0 or done == rounds:
            now = stored(now, "raked-cells")
            if kept <= 0 or residual(now, list(goals), kept) <= tolerance:
                break
    return now


def residual(cells: DataFrame, columns: list[str], kept: float) -> float:
    """By how much of the kept tokens a category is off at most."""
    worst = [
        cells.groupBy(c).agg((F.abs(F.sum("weight") - F.first(f"goal_{c}")) / kept).alias("off")).agg(F.max("off"))
        for c in columns
    ]
    off = worst[0]
    for more in worst[1:]:
        off = off.union(more)
    return max(float(row[0] or 0) for row in off.collect())


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the id, without one on the text."""
    what = F.coalesce(key.cast("string"), text, F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), what).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def _planned(
    docs: DataFrame, by: dict[str, Column], targets, keep: float, power: float, rounds: int, text_column: str
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Documents with their categories, raked cells, and the wanted shares."""
    names = [f"mix_{name}" for name in by]
    added = {*names, "mix_tokens", "mix_probability"}
    marked = docs.select(
        *(q(c) for c in docs.columns if c.lower() not in added),
        *(column.cast("string").alias(f"mix_{name}") for name, column in by.items()),
        token_number(q(text_column)).alias("mix_tokens"),
    )
    cells = stored(cells_of(marked, names, "mix_tokens"), "cells")
    if targets is None:
        wanted = {c: flattened(cells, c, power) for c in names}
    else:
        wanted = {f"mix_{name}": t.toDF(f"mix_{name}", "target") for name, t in targets.items()}
    kept = keep * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {c: bounded_targets(cells, c, target, kept) for c, target in wanted.items()}
    return marked, raked(cells, goals, kept, rounds), wanted


def mix(
    docs: DataFrame,
    by: dict[str, Column],
    *,
    targets: dict[str, DataFrame] | None = None,
    keep: float = 0.5,
    power: float = 0.5,
    rounds: int = 60,
    seed: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The kept documents with ``mix_<name>`` of each marginal, ``mix_tokens`` and
    ``mix_probability``. Without ``targets``, shares are flattened by ``power``."""
    marked, cells, wanted = _planned(docs, by, targets, keep, power, rounds, text_column)
    chance = F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0))).otherwise(0.0)
    names = list(wanted)
    chances = stored(cells.select(*names, chance.alias("mix_probability")), "cell-chances")
    same = None
    for name in names:
        equal = F.coalesce(marked[name], F.lit(NONE)) == chances[name]
        same = equal if same is None else same & equal
    kept = marked.join(chances, same).where(
        uniform(q(id_column), q(text_column), seed) < F.col("mix_probability")
    )
    return kept.drop(*(chances[name] for name in names))


def shares(
    docs: DataFrame,
    by: dict[str, Column],
    *,
    targets: dict[str, DataFrame] | None = None,
    keep: float = 0.5,
    power: float = 0.5,
    rounds: int = 60,
    text_column: str = "text",
) -> DataFrame:
    """(marginal, category, target, feasible, expected): the wanted share of each
    category, whether there are tokens enough for it, and its share of the
    expected sample."""
    _, cells, wanted = _planned(docs, by, targets, keep, power, rounds, text_column)
    whole, kept = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    limit, kept = keep * float(whole or 0), float(kept or 0)
    parts = None
    for name, target in wanted.items():
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"))
        part = sums.join(target, name, "left").select(
            F.lit(name.removeprefix("mix_")).alias("marginal"),
            F.col(name).alias("category"),
            F.coalesce("target", F.lit(0.0)).alias("target"),
            (F.coalesce("target", F.lit(0.0)) * limit <= F.col("tokens")).alias("feasible"),
            (F.col("weight") / F.lit(kept) if kept else F.lit(0.0)).alias("expected"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts

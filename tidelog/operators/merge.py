"""Merging what several sources or shards answered.

Counts are additive, so each source aggregates on its own and only its bucket
rows meet: a third of the data behind one source or one bucket changes
nothing in the size of this step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEALTH = ["total", "successful", "skipped", "failed"]


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; duplicates stay."""
    if not parts:
        raise ValueError("no sources")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_histograms(parts: DataFrame | list[DataFrame]) -> DataFrame:
    """Sum ``doc_count`` per histogram name and key, ascending keys."""
    return summed(parts).orderBy("agg", "key")


def summed(parts: DataFrame | list[DataFrame]) -> DataFrame:
    """``merge_histograms`` in no order, for what is ordered or merged later."""
    rows = parts if isinstance(parts, DataFrame) else union_all(parts)
    merged = rows.groupBy("agg", "key").agg(
        F.min("key_as_string").alias("key_as_string"),
        F.sum("doc_count").cast("bigint").alias("doc_count"),
    )
    return merged.select("agg", "key", "key_as_string", "doc_count")


def shard_partials(df: DataFrame, shard: Column | str | None, bucket: str) -> DataFrame:
    """One ``(_shard, bucket, doc_count)`` row per shard and bucket.

    Without a shard column every partition is a shard.
    """
    if shard is None:
        shard = F.spark_partition_id()
    elif isinstance(shard, str):
        shard = F.col(shard)
    return (
        df.select(shard.alias("_shard"), bucket)
        .groupBy("_shard", bucket)
        .agg(F.count("*").alias("doc_count"))
    )


def merge_totals(parts: DataFrame | list[DataFrame]) -> DataFrame:
    """Sum the totals of one row per source; the highest score is kept."""
    rows = parts if isinstance(parts, DataFrame) else union_all(parts)
    sums = [
        F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
        for name in ("total", "bucket_total")
    ]
    return rows.agg(*sums, F.max("max_score").alias("max_score"))


def source_health(asked: DataFrame, answered: Column) -> DataFrame:
    """The counters of every asked source, one row each."""
    one = answered.cast("int")
    return asked.select(
        F.lit(1).alias("total"),
        one.alias("successful"),
        F.lit(0).alias("skipped"),
        (1 - one).alias("failed"),
        F.lit(False).alias("timed_out"),
    )


def merge_health(parts: DataFrame | list[DataFrame]) -> DataFrame:
    """Sum the source counters; timed out when one source was."""
    rows = parts if isinstance(parts, DataFrame) else union_all(parts)
    return rows.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("int").alias(name) for name in HEALTH],
        F.coalesce(F.max("timed_out"), F.lit(False)).alias("timed_out"),
    )


def max_score(hits: DataFrame) -> DataFrame:
    """Highest hit score, 0 without hits."""
    return hits.agg(F.coalesce(F.max("_score"), F.lit(0.0)).alias("max_score"))

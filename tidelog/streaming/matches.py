"""Saved requests matched against lines as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.times import quoted
from tidelog.operators.many_requests import LogSide, condition, match_conditions
from tidelog.sources.index import Field
from tidelog.sources.readers import parse_declared

BATCH = "batch"

# What a stored row is about, and whether it is a line that meets it or the ``id``
# of a request that asks it. Folders of before have neither, but pairs of both.
_ASKED, _PART = "_asked", "_part"
_LINE, _REQUEST = "line", "request"


def match_new_files(
    spark: SparkSession,
    source: str,
    requests: DataFrame,
    target: str,
    checkpoint: str,
    fields: Mapping[str, Field | Mapping],
    log: LogSide,
    max_files: int | None = None,
) -> StreamingQuery:
    """Match the lines of files that arrived since the last call, and stop.

    Each batch of lines is joined with the requests as they are then, and its
    matches become the folder of the batch's number: every line once for each
    condition it meets, however many requests ask the same, then these requests
    by ``id``. A batch that is repeated after a failure replaces its own folder,
    so every match is told once. ``log.raw`` is a declared field, or ``raw`` for
    the whole line.
    """
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(source).select(F.col("value").alias("raw"))
    typed = parse_declared(lines, "raw", fields, keep=["raw"])

    conditions = f"{target}/_conditions"
    requests = _typed(requests)

    def matched(rows: DataFrame, number: int) -> None:
        path = f"{target}/{BATCH}={number}"
        # stored, so that Spark knows their size and lines needn't be shuffled to meet few
        requests.select("index", "q", "gte", "lte").distinct().write.mode("overwrite").parquet(conditions)
        found = match_conditions(rows, spark.read.parquet(conditions), log).withColumnRenamed("id", _ASKED)
        untold = F.lit(None).cast(requests.schema["id"].dataType)
        found.withColumns({"id": untold, _PART: F.lit(_LINE)}).write.mode("overwrite").parquet(path)
        met = spark.read.parquet(path).select(_ASKED).distinct()
        asking = requests.select("id", condition().alias(_ASKED)).join(met, _ASKED, "left_semi")
        asking.withColumn(_PART, F.lit(_REQUEST)).write.mode("append").parquet(path)

    return (
        typed.writeStream.foreachBatch(matched)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _typed(requests: DataFrame) -> DataFrame:
    """Columns without a type, NULL throughout, can't be stored and read as such."""
    kinds = {"index": T.StringType(), "q": T.StringType(), "lte": requests.schema["gte"].dataType}
    void = {name: F.col(name).cast(kind) for name, kind in kinds.items() if requests.schema[name].dataType == T.NullType()}
    return requests.withColumns(void)


def read_matches(spark: SparkSession, target: str) -> DataFrame:
    """All matches so far, with the number of their batch."""
    lines, asking, pairs = _stored(spark, target)
    if lines is None:
        return pairs
    return lines.join(asking, [BATCH, _ASKED]).select(*map(quoted, pairs.columns)).unionByName(pairs)


def match_totals(spark: SparkSession, target: str, *sums: str) -> DataFrame:
    """Of each ``id`` the number ``n`` of its matches so far, and the sum of each
    of some columns as ``sum_`` and its name; matches are not listed for it."""
    lines, asking, pairs = _stored(spark, target)
    totals = [F.count("*").alias("n"), *[F.sum(quoted(name)).alias(f"sum_{name}") for name in sums]]
    found = pairs.groupBy("id").agg(*totals)
    if lines is not None:
        each = lines.groupBy(BATCH, _ASKED).agg(*totals).join(asking, [BATCH, _ASKED])
        found = each.select(*map(quoted, found.columns)).unionByName(found)
    return found.groupBy("id").agg(*[F.sum(quoted(name)).alias(name) for name in found.columns if name != "id"])


def _stored(spark: SparkSession, target: str) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Lines by condition, requests by condition, and pairs that were stored as such."""
    reader = spark.read.option("basePath", target).option("mergeSchema", "true")
    rows = reader.parquet(f"{target}/{BATCH}=*")
    if _PART not in rows.columns:
        return None, None, rows
    names = [quoted(name) for name in rows.columns if name not in ("id", _ASKED, _PART)]
    lines = rows.where(F.col(_PART) == _LINE).select(_ASKED, *names)
    asking = rows.where(F.col(_PART) == _REQUEST).select(BATCH, _ASKED, "id")
    return lines, asking, rows.where(F.col(_PART).isNull()).select("id", *names)

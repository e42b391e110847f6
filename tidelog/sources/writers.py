"""Writing typed logs in a layout that time ranges can prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.documents import row_json
from tidelog.functions.times import TimeColumn, parse_instant
from tidelog.sources.index import LogIndex, log_index

# Fixed value: the partition column, the UTC date of the time column.
DATE_PARTITION = "dt"


def with_date(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(DATE_PARTITION, TimeColumn.of(df, time).utc_date())


def write_time_table(
    df: DataFrame, path: str, time: str, mode: str = "overwrite"
) -> None:
    """Write Parquet partitioned by date and sorted by time inside each file.

    REBALANCE gathers a date's rows into files of the advisory size: small
    dates share a task, and a date (or a single instant) that holds much of
    the log is split over many, which range partitioning on equal times cannot
    do.  The sort gives row groups narrow time ranges.
    """
    (
        with_date(df, time)
        .hint("rebalance", F.col(DATE_PARTITION))
        .sortWithinPartitions(DATE_PARTITION, time)
        .write.mode(mode)
        .partitionBy(DATE_PARTITION)
        .parquet(path)
    )


def time_table_index(
    spark: SparkSession, name: str, path: str, time: str, **described
) -> LogIndex:
    """A written time table as a searchable index."""
    df = spark.read.parquet(path)
    return log_index(name, df, time, partition=DATE_PARTITION, **described)


def write_document_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parsed lines (``raw``, ``doc``, ``ts``) as a time table of documents.

    Spark shreds the documents: keys that occur often, with one type, become
    Parquet columns of their own, so a search reads the keys that it names.
    """
    write_time_table(df.select("raw", "doc", "ts"), path, "ts", mode)


def document_table_index(
    spark: SparkSession, name: str, path: str, time_field: str, fields=None
) -> LogIndex:
    """A table of documents, searched by the document rules."""
    df = spark.read.parquet(path)
    return log_index(
        name, df, "ts", fields=fields, raw="raw", doc="doc", time_field=time_field, partition=DATE_PARTITION
    )


def pruned_scan(spark: SparkSession, path: str, time: str, gte, lte) -> DataFrame:
    """Rows of a time table in an inclusive range, skipping other dates."""
    gte, lte = parse_instant(gte), parse_instant(lte)
    df = spark.read.parquet(path)
    day = F.col(DATE_PARTITION)
    if gte is not None:
        df = df.where(day >= F.lit(gte.date()))
    if lte is not None:
        df = df.where(day <= F.lit(lte.date()))
    return df.where(TimeColumn.of(df, time).between(gte, lte))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    df.select(row_json("*").alias("value")).write.mode(mode).text(path)

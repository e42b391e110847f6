"""Incremental loading of JSON lines into a time table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.sources.index import Field
from tidelog.sources.readers import parse_declared
from tidelog.sources.writers import DATE_PARTITION, with_date


def json_lines_stream(
    spark: SparkSession,
    path: str,
    fields: Mapping[str, Field | Mapping],
    max_files: int | None = None,
) -> DataFrame:
    """New JSON-lines files as typed rows; the schema is the declaration."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select(F.col("value").alias("raw"))
    return parse_declared(lines, "raw", fields)


def ingest_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    fields: Mapping[str, Field | Mapping],
    time: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Load what arrived since the last call and stop.

    The checkpoint remembers the files already loaded and the file sink
    commits each batch as a whole, so a rerun after a failure loads nothing
    twice.  Rows without a time have no date, as in ``write_time_table``.  As
    there, REBALANCE gathers a batch's rows by date, so the number of files
    follows the dates and their sizes, not the tasks that read the lines.
    """
    rows = json_lines_stream(spark, source, fields, max_files)
    rows = with_date(rows, time).hint("rebalance", F.col(DATE_PARTITION))
    return (
        rows.writeStream.format("parquet")
        .partitionBy(DATE_PARTITION)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Stored partial counts of a time table: rows by step of time and date.

Counts are additive: every load appends the counts of its own rows, and readers
sum them up. A table may be counted by some of its columns too, so that filters
on those can be answered from counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.intervals import Interval
from tidelog.functions.times import TimeColumn, quoted
from tidelog.operators.histogram import Histogram, bucket

# The column of counts, the folder level of loads, and the column of
# dates, which is that of a time table.
COUNT = "doc_count"
LOAD = "load"
DATE = "dt"


@dataclass(frozen=True)
class PartialCounts:
    """Counts at ``path`` of a table whose time column is ``time``, in steps of
    ``minutes`` and by the columns ``by``."""

    path: str
    time: str
    by: tuple[str, ...] = ()
    minutes: int = 1

    @property
    def step_micros(self) -> int:
        return self.minutes * 60_000_000

    def counted(self, df: DataFrame) -> DataFrame:
        """One row for each step, date and combination of ``by``; rows without a
        time have neither step nor date. Partial sums go before the shuffle."""
        time = TimeColumn.of(df, self.time)
        start = bucket(Histogram("step", time, Interval(self.minutes, "m"))).alias(self.time)
        rows = df.select(start, time.utc_date().alias(DATE), *(F.col(quoted(c)) for c in self.by))
        names = [self.time, DATE, *self.by]
        return rows.groupBy(*(F.col(quoted(c)) for c in names)).agg(F.count("*").alias(COUNT))

    def add(self, df: DataFrame, load: int | str) -> None:
        """The counts of one load's rows; the same load again replaces them."""
        self.counted(df).hint("rebalance", F.col(DATE)).write.mode("overwrite").partitionBy(DATE).parquet(
            f"{self.path}/{LOAD}={load}"
        )

    def read(self, like: DataFrame) -> DataFrame:
        """The counts of all loads; ``like`` has the counted table's columns."""
        kinds = [like.schema[c] for c in (self.time, *self.by)]
        more = [T.StructField(COUNT, T.LongType()), T.StructField(LOAD, T.StringType()), T.StructField(DATE, T.DateType())]
        schema = T.StructType([*kinds, *more])
        spark = like.sparkSession
        try:
            return spark.read.schema(schema).option("basePath", self.path).parquet(self.path).drop(LOAD)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema).drop(LOAD)


def refresh_partials(spark: SparkSession, table: str, counts: PartialCounts, checkpoint: str) -> None:
    """Count what was added to a time table since the last call.

    The table's files are a stream; its batches are the loads. A batch that is
    repeated after a failure replaces its own counts, so no row counts twice.
    """
    schema = spark.read.parquet(table).schema

    def load(rows: DataFrame, batch: int) -> None:
        counts.add(rows, batch)

    query = (
        spark.readStream.schema(schema)
        .parquet(table)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

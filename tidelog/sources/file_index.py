"""What each file of a raw log holds, so that a search reads only some of them.

For every file the index keeps, beside its size and change time, the first and
last time of each step of time that occurs in it (the sparse time index with
files as positions), how many lines have no time, and a Bloom set of the text's
trigrams. A search then reads the files whose steps meet its range and whose
sets hold all trigrams of its texts. Sets err on one side only: a file that is
left out has no line that matches. A file that is new, or was changed since, is
always read.

The index is a Parquet table with a row a file. ``refresh`` reads new and changed
files only and appends their rows; rows of other versions of a file are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import TimeColumn
from tidelog.operators.time_index import step_number
from tidelog.sources.index import Field, LogIndex, log_index
from tidelog.sources.readers import parse_log_lines, read_json_lines

# Bits of a file's set. It is kept as its words that are not 0, so a file with few
# trigrams has a small one.
BITS = 1 << 20

ENTRY = (
    "file string, size bigint, modified bigint, n_lines bigint, n_untimed bigint, "
    "steps array<struct<first_ts timestamp, last_ts timestamp, n_lines bigint>>, words map<int, bigint>"
)


def trigram_bits(text: Column) -> Column:
    """Places in a set of the trigrams of a text, without repeats."""
    found = F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.array_distinct(F.transform(found, _bit))


def _bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS)).cast("int")


def holds(words: Column, query: str) -> Column:
    """Whether a set may hold a text; shorter ones than three letters always may."""
    tests = F.lit(True)
    for trigram in sorted({query[i : i + 3] for i in range(len(query) - 2)}):
        bit = _bit(F.lit(trigram))
        word = F.coalesce(F.try_element_at(words, F.shiftright(bit, 6)), F.lit(0).cast("bigint"))
        tests = tests & (F.getbit(word, F.pmod(bit, F.lit(64))) == 1)
    return tests


@dataclass(frozen=True)
class FileIndex:
    """The index at ``path`` of the files of ``source`` (a folder, file or list)."""

    source: str | tuple[str, ...]
    path: str
    time_field: str
    step_seconds: int = 3_600

    def listed(self, spark: SparkSession) -> DataFrame:
        """(path, file, size, modified) of the files there now; none is read."""
        files = spark.read.format("binaryFile").load(_paths(self.source))
        return files.select(
            "path",
            F.col("_metadata.file_path").alias("file"),
            F.col("length").alias("size"),
            F.unix_micros("modificationTime").alias("modified"),
        )

    def entries(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(ENTRY).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], ENTRY)

    def refresh(self, spark: SparkSession) -> int:
        """Index the files that are new or changed; returns how many."""
        known = self.entries(spark).select("file", "size", "modified")
        new = self.listed(spark).join(known, ["file", "size", "modified"], "left_anti")
        rows = new.collect()
        if rows:
            self._entries_of(spark, rows).write.mode("append").parquet(self.path)
        return len(rows)

    def _entries_of(self, spark: SparkSession, files: list) -> DataFrame:
        paths = [row.path for row in files]
        lines = spark.read.text(paths).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
        timed = parse_log_lines(lines, "raw", self.time_field).select("file", "ts")
        steps = (
            timed.groupBy("file", step_number(TimeColumn("ts", False), self.step_seconds).alias("bucket"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_lines"))
        )
        step = F.when(F.col("bucket").isNotNull(), F.struct("first_ts", "last_ts", "n_lines"))
        times = steps.groupBy("file").agg(
            F.sum("n_lines").alias("n_lines"),
            F.sum(F.when(F.col("bucket").isNull(), F.col("n_lines")).otherwise(0)).alias("n_untimed"),
            F.collect_list(step).alias("steps"),
        )
        bits = lines.select("file", F.explode(trigram_bits(F.col("raw"))).alias("bit"))
        words = bits.groupBy("file", F.shiftright("bit", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, pmod(bit, 64))")).alias("held")
        )
        sets = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "held"))).alias("words"))
        seen = spark.createDataFrame(
            [(row.file, row.size, row.modified) for row in files], "file string, size bigint, modified bigint"
        )
        none = F.lit(0).cast("bigint")
        return seen.join(times, "file", "left").join(sets, "file", "left").select(
            "file",
            "size",
            "modified",
            F.coalesce("n_lines", none).alias("n_lines"),
            F.coalesce("n_untimed", none).alias("n_untimed"),
            F.coalesce("steps", F.expr("array()")).alias("steps"),
            F.coalesce("words", F.expr("map()")).alias("words"),
        )

    def matching(
        self, spark: SparkSession, gte: datetime | None, lte: datetime | None, texts: Sequence[str] = ()
    ) -> list[str]:
        """The files that can hold a line of the range that has all the texts."""
        known = self.entries(spark).withColumn("known", F.lit(True))
        found = self.listed(spark).join(known, ["file", "size", "modified"], "left")
        test = F.lit(True)
        if gte is not None or lte is not None:
            stamp = TimeColumn("ts", False)

            def meets(step: Column) -> Column:
                inside = F.lit(True)
                if gte is not None:
                    inside = inside & (step["last_ts"] >= F.expr(stamp.literal(gte)))
                if lte is not None:
                    inside = inside & (step["first_ts"] <= F.expr(stamp.literal(lte)))
                return inside

            test = F.exists("steps", meets)
            if gte is None:  # lines without a time come before all others
                test = test | (F.col("n_untimed") > 0)
        for text in texts:
            test = test & holds(F.col("words"), text)
        found = found.where(F.col("known").isNull() | test)
        return [row.path for row in found.select("path").distinct().orderBy("path").collect()]

    def lines(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """(raw, doc, ts) of the lines of some files."""
        if not paths:
            empty = spark.createDataFrame([], "raw string")
            return parse_log_lines(empty, "raw", self.time_field)
        return read_json_lines(spark, paths, self.time_field)

    def summary(self, spark: SparkSession) -> DataFrame:
        """(n_files, n_lines, n_untimed, first_ts, last_ts) of the files there
        now, from the index alone."""
        now = self.listed(spark).join(self.entries(spark), ["file", "size", "modified"])
        return now.agg(
            F.count("*").alias("n_files"),
            F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce(F.sum("n_untimed"), F.lit(0)).cast("bigint").alias("n_untimed"),
            F.min(F.array_min(F.transform("steps", lambda s: s["first_ts"]))).alias("first_ts"),
            F.max(F.array_max(F.transform("steps", lambda s: s["last_ts"]))).alias("last_ts"),
        )


def _paths(source: str | tuple[str, ...]) -> str | list[str]:
    return source if isinstance(source, str) else list(source)


def indexed_lines(
    spark: SparkSession,
    name: str,
    files: FileIndex,
    fields: Mapping[str, Field | Mapping] | None = None,
) -> LogIndex:
    """JSON lines whose searches read only files that can match.

    The index is brought up to date first. ``search`` asks it for each request.
    """
    files.refresh(spark)
    df = read_json_lines(spark, _paths(files.source), files.time_field)
    return log_index(
        name, df, "ts", fields=fields, raw="raw", doc="doc", time_field=files.time_field, files=files
    )


def required_texts(query: Mapping[str, Any] | None) -> list[str]:
    """Texts that every line of an answer has, by the document rules."""
    root = (query or {}).get("bool") or {}
    each = [*(root.get("filter") or []), *(root.get("must") or [])]
    return [
        spec["multi_match"].get("query", "")
        for spec in each
        if spec and spec.get("bool") is None and spec.get("multi_match") is not None
    ]

"""Several sources searched as one, and indexes opened from a declaration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.intervals import document_interval
from tidelog.operators.merge import union_all
from tidelog.sources.file_index import FileIndex, indexed_lines
from tidelog.sources.index import Field, LogIndex, log_index
from tidelog.sources.readers import json_lines_index, read_jdbc, read_table

# Configuration version and provider names.
CONFIG_VERSION = 1
JSON_LINES_PROVIDER = "jsonLogFile"
TABLE_PROVIDER = "clickhouse"
COMPOSITE_PROVIDER = "aggregate"
SHARDED_PROVIDER = "webSocketServer"


def union_sources(sources: list[LogIndex]) -> DataFrame:
    """All rows of all sources with ``_index``; duplicates stay."""
    if not sources:
        raise ValueError("no sources")
    return union_all([s.df.withColumn("_index", F.lit(s.name)) for s in sources])


def combine_alike(sources: list[LogIndex]) -> list[LogIndex]:
    """Sources that differ in their rows only, as one source each.

    The parts of one declared index are alike, so a composite of hundreds of
    parts is planned as one union instead of hundreds of searches.
    """
    groups: dict[tuple, list[LogIndex]] = {}
    for source in sources:
        rules = replace(source, df=None, fields=tuple(source.fields.items()))
        groups.setdefault((rules, source.df.schema.json()), []).append(source)
    return [
        alike[0].with_df(union_all([each.df for each in alike]))
        for alike in groups.values()
    ]


def with_shard(df: DataFrame, shard: Column | None = None) -> DataFrame:
    """Add ``_shard``: a given column, else the partition a row is read in."""
    return df.withColumn("_shard", F.spark_partition_id() if shard is None else shard)


def open_index(
    spark: SparkSession, name: str, config: Mapping[str, Any]
) -> list[LogIndex]:
    """The sources behind a declared index: one, or all of a composite."""
    if config.get("version") != CONFIG_VERSION:
        raise ValueError("unsupported version")
    if not config.get("fields"):
        raise ValueError("no fields")
    fields = {key: Field.of(value) for key, value in config["fields"].items()}
    time = config["timestamp"]["field"]
    return _open(spark, name, config["provider"], fields, time)


def _open(spark, name, provider, fields, time) -> list[LogIndex]:
    kind, settings = provider["name"], provider.get("config") or {}
    if kind == JSON_LINES_PROVIDER:
        path = settings.get("logfile") or settings.get("logFile")
        if not path:
            raise ValueError("no log file")
        if settings.get("index") is None:
            return [json_lines_index(spark, name, path, time, fields)]
        files = _file_index(path, settings["index"], time)
        return [indexed_lines(spark, name, files, fields)]
    if kind == TABLE_PROVIDER:
        df = _open_table(spark, settings)
        return [log_index(name, df, time, fields=fields)]
    if kind == COMPOSITE_PROVIDER:
        parts = settings.get("subProviders") or []
        if not parts:
            raise ValueError("no sources")
        return [s for part in parts for s in _open(spark, name, part, fields, time)]
    if kind == SHARDED_PROVIDER:
        raise ValueError("shards are the partitions of a DataFrame; name its source")
    raise ValueError(f"unsupported provider {kind!r}")


def _file_index(path: str, settings: Mapping[str, Any], time: str) -> FileIndex:
    """The file index that a declaration asks for: its ``path`` and ``resolution``."""
    if not settings.get("path"):
        raise ValueError("an index of files needs a path")
    resolution = settings.get("resolution")
    step = 3_600 if resolution is None else document_interval(resolution, None).seconds
    return FileIndex(path, settings["path"], time, step)


def _open_table(spark: SparkSession, settings: Mapping[str, Any]) -> DataFrame:
    dsn, table = settings.get("dsn"), settings.get("table")
    if not table:
        raise ValueError("no table")
    if dsn and dsn.startswith("jdbc:"):
        return read_jdbc(spark, dsn, table, **(settings.get("options") or {}))
    if dsn:
        raise ValueError(f"no reader for the data source {dsn!r}")
    return read_table(spark, table)

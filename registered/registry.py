"""The registry and the indexes that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import LogIndex, log_index
from tidelog.functions.times import format_rfc3339_fraction
from tidelog.sources.shared import shared_folder
from tidelog.sources.writers import write_json_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A range inside events, with a fraction of a second, and its microseconds.
GTE = "2024-01-05T03:17:11.965Z"
LTE = "2024-01-12T09:00:00Z"
GTE_SQL = "TIMESTAMP '2024-01-05 03:17:11.965'"
LTE_SQL = "TIMESTAMP '2024-01-12 09:00:00'"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, **described) -> LogIndex:
    """``events`` as a typed table with ``event_type`` and ``props`` as text."""
    described.setdefault("text", ["event_type", "props"])
    df = table(spark, folder, "events")
    return log_index("events", df, "ts", id="event_id", **described)


def orders(spark: SparkSession, folder: str) -> LogIndex:
    df = table(spark, folder, "orders")
    text = ["o_orderstatus", "o_orderpriority"]
    return log_index("orders", df, "o_orderdate", id="o_orderkey", text=text)


def lineitem(spark: SparkSession, folder: str, **described) -> LogIndex:
    described.setdefault("text", ["l_returnflag", "l_linestatus"])
    df = table(spark, folder, "lineitem")
    return log_index("lineitem", df, "l_shipdate", **described)


def event_lines(spark: SparkSession, folder: str) -> str:
    """``events`` written as JSON lines; returns the folder.

    ``datetime`` is RFC3339 text with microseconds.
    """
    df = table(spark, folder, "events")
    path = shared_folder(spark, "event-lines")
    write_json_lines(
        df.select(
            F.expr(format_rfc3339_fraction("ts", True, 6)).alias("datetime"),
            F.col("event_type").alias("message"),
            "event_id",
            "value",
            "props",
        ),
        path,
    )
    return path


def ms(sql: str) -> str:
    """Epoch milliseconds, rounded down, in DuckDB."""
    return f"(epoch_us({sql}) // 1000)"


def seconds(sql: str) -> str:
    return f"(epoch_us({sql}) // 1000000)"


def rfc3339(key: str) -> str:
    return f"strftime(make_timestamp(({key}) * 1000), '%Y-%m-%dT%H:%M:%SZ')"


def buckets_sql(key: str, source: str, where: str = "true", agg: str | None = None) -> str:
    """A histogram in SQL from its key expression (epoch milliseconds)."""
    name = f"'{agg}' AS agg, " if agg else ""
    return (
        f"SELECT {name}key, {rfc3339('key')} AS key_as_string, "
        f"CAST(count(*) AS BIGINT) AS doc_count "
        f"FROM (SELECT {key} AS key FROM {source} WHERE {where}) GROUP BY key"
    )


def anchored_key(ts: str, gte: str, step_us: int) -> str:
    return (
        f"((epoch_us({ts}) - epoch_us({gte})) // {step_us} * {step_us} "
        f"+ epoch_us({gte})) // 1000"
    )


def whole_only(ts: str, gte: str, lte: str, step_us: int) -> str:
    """Rows of an anchored range up to its last whole bucket."""
    whole = f"(epoch_us({lte}) - epoch_us({gte})) // {step_us}"
    return (
        f"{ts} BETWEEN {gte} AND {lte} AND "
        f"(epoch_us({ts}) - epoch_us({gte})) // {step_us} < {whole}"
    )

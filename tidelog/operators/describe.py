"""What is in an index: its fields and its extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import times
from tidelog.functions.documents import parse_documents
from tidelog.operators.merge import union_all
from tidelog.sources.index import LogIndex

_DECLARED = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("declared_type", T.StringType()),
        T.StructField("searchable", T.BooleanType()),
        T.StructField("aggregatable", T.BooleanType()),
    ]
)


def observed_fields(index: LogIndex) -> DataFrame:
    """``(index, field, observed_type, n_rows)`` per top-level key and type.

    Only one small row per key and type of a partition is shuffled.
    """
    if index.doc is not None:
        docs = index.df.select(F.col(index.doc).alias("doc"))
    elif index.raw is not None:
        docs = parse_documents(index.df.select(F.col(index.raw).alias("raw")), "raw")
    else:
        row = F.struct(*index.source_columns)
        docs = index.df.select(F.to_variant_object(row).alias("doc"))
    keys = docs.select("doc").lateralJoin(
        docs.sparkSession.tvf.variant_explode(F.col("doc").outer())
    )
    return (
        keys.select(
            F.lit(index.name).alias("index"),
            F.col("key").alias("field"),
            _kind(F.col("value")).alias("observed_type"),
        )
        .groupBy("index", "field", "observed_type")
        .agg(F.count("*").alias("n_rows"))
    )


def _kind(value: Column) -> Column:
    """The type without its inner detail (``OBJECT``, ``ARRAY``, ``DECIMAL``),
    so that the number of groups does not grow with the shapes of objects."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)


def field_profile(index: LogIndex) -> DataFrame:
    """Observed fields next to their declaration; declared ones always appear."""
    declared = index.df.sparkSession.createDataFrame(
        [(k, f.type, f.searchable, f.aggregatable) for k, f in index.fields.items()],
        _DECLARED,
    )
    joined = observed_fields(index).join(declared, "field", "full")
    return joined.select(
        F.lit(index.name).alias("index"),
        "field",
        "declared_type",
        "observed_type",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("searchable", F.lit(False)).alias("searchable"),
        F.coalesce("aggregatable", F.lit(False)).alias("aggregatable"),
    )


def field_indices(indexes: list[LogIndex]) -> DataFrame:
    """Which indexes each observed field occurs in."""
    seen = union_all([observed_fields(index) for index in indexes])
    return (
        seen.groupBy("field")
        .agg(
            F.sort_array(F.collect_set("index")).alias("indices"),
            F.sum("n_rows").cast("bigint").alias("n_rows"),
        )
    )


def index_summary(indexes: list[LogIndex]) -> DataFrame:
    """Row count, first and last time of each index."""
    return union_all([_summary(index) for index in indexes])


def _summary(index: LogIndex) -> DataFrame:
    ts, ntz = index.time.name, index.time.ntz
    found = index.df.agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    return found.select(
        F.lit(index.name).alias("index"),
        "n_rows",
        F.expr(times.unix_millis("lo", ntz)).alias("first_ms"),
        F.expr(times.unix_millis("hi", ntz)).alias("last_ms"),
    )

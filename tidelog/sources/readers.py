"""Reading logs: JSON lines, tables and external databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.documents import (
    allow_repeated_keys,
    compute_once,
    document_time,
    field_as,
    parse_documents,
    row_json,
)
from tidelog.functions.times import parse_rfc3339
from tidelog.sources.index import FIELD_TYPES, Field, LogIndex, log_index

# Options that make Spark's JSON reader refuse what is not JSON.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_log_lines(df: DataFrame, raw: str, time_field: str) -> DataFrame:
    """Add ``doc`` and ``ts`` to raw lines.

    Bad lines keep their raw text with a NULL ``doc`` and ``ts``.  Each line
    is parsed once; filters on the raw text run before the parse.
    """
    df = parse_documents(df, raw)
    df = compute_once(df, _time=field_as(F.col("doc"), time_field, "string"))
    return compute_once(df, ts=parse_rfc3339(F.col("_time"))).drop("_time")


def read_json_lines(
    spark: SparkSession, path: str | list[str], time_field: str
) -> DataFrame:
    """``(raw, doc, ts)`` from files with one JSON object per line."""
    allow_repeated_keys(spark)
    lines = spark.read.text(path).select(F.col("value").alias("raw"))
    return parse_log_lines(lines, "raw", time_field)


def json_lines_index(
    spark: SparkSession,
    name: str,
    path: str | list[str],
    time_field: str,
    fields: Mapping[str, Field | Mapping] | None = None,
) -> LogIndex:
    df = read_json_lines(spark, path, time_field)
    return log_index(
        name, df, "ts", fields=fields, raw="raw", doc="doc", time_field=time_field
    )


def apply_schema(
    df: DataFrame,
    fields: Mapping[str, Field | Mapping],
    doc: str = "doc",
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents to typed columns by the declaration.

    Undeclared keys are dropped unless the document is listed in ``keep``.
    The declaration travels along as column metadata.
    """
    columns = [F.col(name) for name in keep or []]
    for name, declared in fields.items():
        declared = Field.of(declared)
        if declared.type == "date":
            value = document_time(F.col(doc), name)
        else:
            kind = FIELD_TYPES[declared.type].simpleString()
            value = field_as(F.col(doc), name, kind)
        columns.append(value.alias(name, metadata=declared.metadata))
    return df.select(*columns)


def parse_declared(
    df: DataFrame,
    raw: str,
    fields: Mapping[str, Field | Mapping],
    keep: list[str] | None = None,
) -> DataFrame:
    """Raw lines straight to typed columns: the way for loading.

    Only the declared keys are decoded, in one pass that costs about two
    thirds of going through a document.  Lines that are not one JSON object
    give a row of NULLs.  Integers are JSON integers or text holding one.
    """
    declared = {name: Field.of(value) for name, value in fields.items()}
    row = T.StructType([T.StructField(name, T.StringType()) for name in declared])
    # the empty object behind the line makes trailing text malformed
    framed = F.concat(F.lit("["), F.col(raw), F.lit(",{}]"))
    df = compute_once(df, _rows=F.from_json(framed, T.ArrayType(row), STRICT_JSON))
    one_object = (F.size("_rows") == 2) & F.ltrim(raw, F.lit(" \t\r")).startswith("{")
    first = F.when(one_object, F.col("_rows")[0])
    columns = [F.col(name) for name in keep or []]
    for name, field in declared.items():
        value = first.getField(name)
        if field.type == "date":
            value = parse_rfc3339(value)
        else:
            value = value.try_cast(FIELD_TYPES[field.type])
        columns.append(value.alias(name, metadata=field.metadata))
    return df.select(*columns)


def declared_fields(df: DataFrame) -> dict[str, Field]:
    """The declaration that ``apply_schema`` left in the column metadata."""
    return {
        f.name: Field.of(f.metadata) for f in df.schema.fields if "type" in f.metadata
    }


def row_documents(df: DataFrame, name: str = "doc_json") -> DataFrame:
    """Every row as one JSON object text."""
    return df.select(row_json("*").alias(name))


def jdbc_options(
    url: str,
    table: str,
    *,
    split: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read.

    With ``split`` (a numeric, date or timestamp column) the read is cut into
    ``partitions`` range queries; filters and columns push down either way.
    """
    options = {"url": url, "dbtable": table, **(extra or {})}
    if split is not None:
        if lower is None or upper is None or partitions is None:
            raise ValueError("a split read needs lower, upper and partitions")
        options.update(
            partitionColumn=split,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    reader = spark.read.format("jdbc")
    return reader.options(**jdbc_options(url, table, **options)).load()


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet path (with a slash) or a table of the session catalog."""
    return spark.read.parquet(table) if "/" in table else spark.read.table(table)

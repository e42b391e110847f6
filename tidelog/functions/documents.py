"""JSON documents held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import parse_rfc3339, quoted

_END = "end of line"


def allow_repeated_keys(spark: SparkSession) -> None:
    """Repeated keys in one document: the last value wins, as in most readers.

    Spark's default turns the whole document into NULL.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not evaluate again.

    Catalyst inlines a projected expression into every filter that is pushed
    below the projection, so a JSON parse would run once per use.  Filters on
    a generator's output stay above it, while filters on the other columns
    still move down to the scan.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def row_json(*columns: str) -> Column:
    """Columns as one JSON object; missing values stay, as JSON null."""
    named = [c if c == "*" else F.col(quoted(c)) for c in columns]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def key_path(key: str) -> str:
    """Path of a top-level key; dots in the key are part of its name."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"a key with both kinds of quotes is not supported: {key!r}")


def field_value(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, key_path(key), "variant")


def field_as(doc: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(doc, key_path(key), kind)


def without_keys(doc: Column, keys: Sequence[str]) -> Column:
    """The document without these top-level keys."""
    kept = F.map_filter(doc.cast("map<string,variant>"), lambda key, _: ~key.isin(*keys))
    return F.to_variant_object(kept)


def has_field(doc: Column, key: str) -> Column:
    """True when the key is present, even with a JSON null."""
    return field_value(doc, key).isNotNull()


def string_field_equals(doc: Column, key: str, value: str) -> Column:
    """The field is a JSON string and equals ``value``; never NULL."""
    is_string = F.schema_of_variant(field_value(doc, key)).eqNullSafe(F.lit("STRING"))
    return field_as(doc, key, "string").eqNullSafe(F.lit(value)) & is_string


def parse_documents(df: DataFrame, raw: str, doc: str = "doc") -> DataFrame:
    """Add ``doc``: the JSON object in ``raw``, NULL when it is not exactly one.

    Spark's parser stops after the first value of a line.  The line is put in
    an array before an end mark, so that trailing text makes the array
    malformed or moves the mark.  Of a key that occurs twice the last value
    counts, in any session.
    """
    allow_repeated_keys(df.sparkSession)
    line = F.col(raw)
    framed = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_END}"]')))
    df = compute_once(df, _framed=framed)
    whole = (
        F.ltrim(line, F.lit(" \t\r")).startswith("{")
        & F.try_variant_get("_framed", "$[1]", "string").eqNullSafe(F.lit(_END))
        & F.try_variant_get("_framed", "$[2]", "variant").isNull()
    )
    value = F.when(whole, F.try_variant_get("_framed", "$[0]", "variant"))
    return compute_once(df, **{doc: value}).drop("_framed")


def document_time(doc: Column, key: str) -> Column:
    """The document's RFC3339 timestamp.

    Numbers, objects and booleans render to text that is not RFC3339, so no
    separate type test is needed.
    """
    return parse_rfc3339(field_as(doc, key, "string"))

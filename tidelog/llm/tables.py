"""Intermediate tables and small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a new table of the shared folder and read again.

    Cuts lineage: later jobs read the files, a lost executor repeats only its
    own tasks, and Spark knows the size of what it joins.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def groups_for(rows: int, each: int) -> int:
    """How many groups of about ``each`` rows."""
    return max(1, -(-rows // each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that are no columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """The column of exactly this name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")

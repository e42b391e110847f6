"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, folder of tables) and works on all documents that
the stage before it kept. ``run`` writes every stage's result as Parquet into the
shared folder and reads it again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard_join, language_id, mixing, packing, personal_data
from tidelog.llm.queries import VOCABULARY, language_sample, marginals
from tidelog.llm.tables import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; where the label is null it is predicted.

    What has no letter at all is rejected.
    """
    found = language_id.predict(docs, language_sample(docs))
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.select("doc_id", "text", lang, "source", "n_chars")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.without_near_duplicates(docs).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds."""
    finder = personal_data.fit_finder(docs, F.col("text"), F.col("doc_id"))
    clean = personal_data.redacted(docs, finder)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have flattened weights."""
    return mixing.mix(docs, marginals()).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs, vocabulary=VOCABULARY)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("personal_data", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

# Suffix automata, boosted trees and token ids are beyond SQL; tests compare the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

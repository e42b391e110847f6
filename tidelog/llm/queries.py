"""The registered queries of the operators, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    jaccard_join,
    language_id,
    lexical_search,
    mixing,
    neighbours,
    packing,
    personal_data,
    sentence_pieces,
    token_alignment,
    token_counts,
    token_files,
    top_k,
    warc,
)
from tidelog.llm.tables import table
from tidelog.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def learns(key) -> F.Column:
    """Whether a document's label may be learned from; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def language_sample(docs: DataFrame) -> language_id.Sample:
    return language_id.training_sample(
        docs.where(learns(F.col("doc_id"))), F.col("text"), F.col("lang"), F.col("doc_id")
    )


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_sample(docs))
    return found.select(
        "doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score"
    )


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.expr("vec_id % 20 = 0"), k=20)


def marginals() -> dict:
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "topic": mixing.topic_of(F.col("text")),
    }


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    kept = mixing.mix(table(spark, folder, "documents"), marginals())
    return kept.select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("probability"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary=VOCABULARY)


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary=VOCABULARY)


def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k(table(spark, folder, "embeddings"), F.expr("vec_id % 50 = 0"), k=5)


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, vocabulary=VOCABULARY)
    return token_files.read_token_files(spark, path)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def spans_digest(spans: str) -> dict:
    base = F.filter(spans, lambda s: s["base"])
    told = lambda found: F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": number(kind) for kind in personal_data.BASE_KINDS}
    return counts | {"base_sha256": F.sha2(told(base).cast("binary"), 256), "all_spans": told(F.col(spans))}


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    finder = personal_data.fit_finder(docs, F.col("text"), F.col("doc_id"))
    found = personal_data.find(docs.select("doc_id", "text"), finder).drop("text")
    digest = found.select("doc_id", *(c.alias(name) for name, c in spans_digest("spans").items()))
    return digest.withColumnRenamed("all_spans", "spans")


def page_rows(records: DataFrame) -> DataFrame:
    return records.where("gap IS NULL").select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return page_rows(warc.read_archives(spark.read.format("binaryFile").load(path)))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = token_alignment.align(
        table(spark, folder, "documents"), byte_vocabulary=VOCABULARY, piece_model=PIECES
    )
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def op13_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    ids = sentence_pieces.encode(table(spark, folder, "documents"), model=PIECES)
    sha256 = lambda text: F.sha2(text.cast("binary"), 256)
    return sentence_pieces.decode(ids, model=PIECES).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("text")).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_top_k": op6_top_k,
    "op7_token_files": op7_token_files,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_personal_data": op9_personal_data,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_sentence_pieces": op13_sentence_pieces,
}

_PRODUCTS = """
WITH taken AS (
    SELECT vec_id, {vector} AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 {more}
), pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, {score} AS score
    FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLES: dict[str, str] = {
    "op2_nearest_neighbours": _PRODUCTS.format(
        vector="CAST(embedding AS DOUBLE[])",
        more="AND len([x for x in embedding if x <> 0]) > 0",
        score="list_inner_product(a.v, b.v)",
        every=20,
        k=20,
    ),
    "op6_top_k": _PRODUCTS.format(
        vector="[floor(256 * CAST(x AS DOUBLE)) for x in embedding]",
        more="",
        score="CAST(list_inner_product(a.v, b.v) AS BIGINT)",
        every=50,
        k=5,
    ),
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)
    """,
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS row_id, doc_id, {documents} AS terms FROM documents
        ), d AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
        tf AS (
            SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY row_id, term
        ), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole
        ), m AS (SELECT row_id, doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM d, whole),
        asked AS (SELECT item_id, unnest({items}) AS term FROM benchmark),
        wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
        scored AS (
            SELECT item_id, row_id, doc_id,
                   CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM wanted JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row_id)
            GROUP BY item_id, row_id, doc_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """.format(documents=_TERMS, items=_TERMS),
}

"""Documents to token ids in five stages; each works on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of ``docs``; the last returns the encoded documents.
Nulls, empty and very long texts, repeated rows and empty tables pass through as each function says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import byte_bpe, exact_dedup, jaccard, language, templates
from catalens.llm.queries import RANKS, language_model
from catalens.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known, mixtures included; texts without a letter, or null, go.

    The model is fitted on the labelled rows of ``docs`` outside the held-out fold. With none, any letter is enough.
    """
    return language.keep_rows(docs, language_model(docs))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id; null texts equal empty ones; of repeated rows one stays."""
    key = ["no_id", "id", "sha"]  # beside the row, which is kept in one column, whatever its own columns are called

    def known(text):
        return [F.isnull("doc_id").alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text.alias("sha")]

    kept = exact_dedup.exact_dedup(docs).filter("kept").select(*known(F.col("text_sha256")))
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    keyed = docs.select(*known(text), F.struct("*").alias("row"))
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the one with the smallest id; documents without words stay.

    Rows that share an id stay if one of them does.
    """
    groups = jaccard.jaccard_groups(docs)
    kept = groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, verbatim or re-parameterised. A row without an id has none and stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = materialize(templates.contaminated(docs, items).select(F.col("doc_id").alias("found_id")), "contaminated")
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    with open(public_tokenizers.path(RANKS), "rb") as file:
        return byte_bpe.digests(docs, file.read(), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("exact_dedup", one_of_equals),
    ("near_dedup", one_of_near_copies),
    ("decontamination", no_benchmark_items),
    ("byte_bpe", encoded),
]

#: Encoding and shingle links are beyond SQL; tests hold the rows against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

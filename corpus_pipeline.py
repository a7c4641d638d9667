"""The corpus pipeline: each stage reads the Parquet that the one before it wrote.

Columns are those of documents, any others are left behind; the first stage keeps one row for each doc_id (that of the
greatest text, then of the greatest other columns). A null doc_id is one document and is kept as such. Null and empty
texts, and those without a letter, go in the first stage. Texts of any length are taken whole by every stage. Of near or
exact copies the smallest doc_id stays. A changed text gets a new n_chars, others keep the one they came with. Empty tables
give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import common, decontam, langid, near, pieces, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; the others keep all columns, lang being the predicted one."""
    found = langid.label(docs).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component stays."""
    gone = near.near_duplicates(docs).where("not kept").selectExpr("doc_id _id")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; texts that lose none stay as they are, texts that lose all their words go."""
    kept = substrings.clean(docs.select(*COLUMNS, F.length("text").alias("_was")))
    changed = F.length("text") < F.col("_was")
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose their long hit spans, and n_chars follows where one went."""
    kept = decontam.clean(docs.withColumn("_was", F.length("text")), common.table(spark, sf_dir, "benchmark"))
    changed = F.length("text") < F.col("_was")
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Language ID is a trained network: no SQL expresses it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = common.through_table(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
        if before is not None:
            common.drop(before)
        before = docs
    return docs

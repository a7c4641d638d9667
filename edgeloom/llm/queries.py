"""The queries of the text operators and their SQL."""

from __future__ import annotations

from . import binout, chat, common as c, decontam, fingerprint, langid, license, near, pieces, substrings, suffixes
from .oracles import ORACLE  # noqa: F401


def op1(spark, d):
    return substrings.dedup(c.table(spark, d, "documents")).selectExpr("doc_id", "n_units n_words", "n_removed", "kept_sha256")


def op2(spark, d):
    import public_tokenizers

    return pieces.digests(c.table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3(spark, d):
    return fingerprint.fingerprints(c.table(spark, d, "documents"))


def op4(spark, d):
    return langid.identify(c.table(spark, d, "documents"))


def op8(spark, d):
    return license.scan(c.table(spark, d, "documents"))


def op10(spark, d):
    return near.near_duplicates(c.table(spark, d, "documents"))


def op6(spark, d):
    return suffixes.dedup(c.table(spark, d, "documents")).selectExpr("doc_id", "n_units n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5(spark, d):
    return decontam.digest(decontam.scan(c.table(spark, d, "documents"), c.table(spark, d, "benchmark")))


def op7(spark, d):
    import public_tokenizers

    return binout.read(spark, binout.write(c.table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9(spark, d):
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = c.table(spark, d, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.read_back(chat.format(rows.unionByName(own)))


QUERIES = {
    "op1_substring_dedup": op1,
    "op2_sentencepiece": op2,
    "op3_document_fingerprints": op3,
    "op4_language_id": op4,
    "op5_benchmark_decontamination": op5,
    "op6_suffix_array_dedup": op6,
    "op7_token_binary": op7,
    "op8_license_scans": op8,
    "op9_chat_formatting": op9,
    "op10_minhash_near_dedup": op10,
}

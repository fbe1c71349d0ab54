"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, exact_dedup, filter_audit, langid, mixing, ngram_join, packing, prefix_trie, quality, token_rans, toxicity, url_filter
from .shared import table

#: Rules of the url query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0, length=1024)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.select("conv_id", "turn", "role", "text").schema)
    return chat.chat_digests(turns.select("conv_id", "turn", "role", "text").unionByName(extra))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the second meets the index of the first in the anti-join."""
    rows = exact_dedup.dedup_in_batches(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_rans.scratch_path(spark)
    token_rans.write_tokens(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=1)
    return token_rans.read_tokens(spark, path)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), heads, conv - conv % 5, most=8)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_language_id, op3_quality, op4_mixing, op5_packing, op6_ngram_jaccard, op7_chat_formatting, op8_near_vectors, op9_exact_dedup, op10_token_rans, op11_prefix_trie, op12_filter_audit, op13_toxicity)
}

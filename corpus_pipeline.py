"""Corpus pipeline: quality, exact dedup, n-gram Jaccard dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import exact_dedup, mixing, ngram_join, packing, quality
from tonearm.llm.shared import save, small_enough, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; null and blank texts go."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % Jaccard on five-word shingles the least id of each group stays.

    One row of each group stays: null ids come after all others, equal ids are told apart by
    their texts, and of rows that repeat both any one stays. Texts without words are in no group.
    """
    row = F.struct(F.isnull(docs["doc_id"]).alias("none"), docs["doc_id"].alias("id"), F.unhex(F.sha2(docs["text"], 256)).alias("digest"))
    groups = save(ngram_join.ngram_jaccard_components(docs.select(row.alias("row"), "text"), key="row", n=5, percent=80).where("n_shingles > 0"), "groups")
    lost = small_enough(save(groups.where("not (row <=> component_id)").select(F.col("row").alias("lost")), "lost"))
    left = docs.join(lost, row.eqNullSafe(lost["lost"]), "left_anti")
    again = save(groups.where("row <=> component_id").groupBy("row").count().where("count > 1").select(F.col("row").alias("again")), "again")
    if again.isEmpty():
        return left
    again = small_enough(again)
    once = left.withColumn("__row", row).join(again, F.col("__row").eqNullSafe(again["again"]), "left_semi").dropDuplicates(["__row"]).drop("__row")
    return left.join(again, row.eqNullSafe(again["again"]), "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to source, language and topic targets."""
    return mixing.keep_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, "byte_bpe_50k.json", end_id=0, length=1024)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, Jaccard components and tokenizer are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text (digest, key of the row that
stays, number of rows), bucketed and sorted by digest. A new batch is reduced to
digests, joined to the index by sort-merge anti-join, and the new digests are
appended as a further generation; rows of known digests are counted in one of their
own. Nothing but digests and keys is shuffled.

Defined results: a null text counts as empty; of equal texts in one batch the
largest key stays (null keys come last); rows repeated with the same key and
text are counted, and one of them stays; an indexed text always wins over a
later batch; other columns are carried unchanged, whatever their names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, new_path, remove, require, save, shuffle_partitions, small_enough

#: Digests with more than 1/HOT_PARTS of all rows are joined by broadcast; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1000
#: Keys from which batches of other keys than numbers are cut.
CUT_SAMPLE = 10_000


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the text's UTF-8 bytes, null as empty, as 32 bytes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Generations of (digest, keep_id, group_size), each bucketed and sorted by digest.

    A generation ``g`` holds the digests that a batch brought; a generation ``c`` (digest,
    rows) counts the batch's rows whose digests were known before. ``name`` is a
    table-name prefix in the session's catalog; ``location`` is the shared folder that
    holds the files.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.location = location or new_path(spark, self.name)
        self.buckets = buckets or shuffle_partitions(spark)
        known = [t.name for t in spark.catalog.listTables()]
        by_number = lambda kind: sorted((t for t in known if re.fullmatch(rf"{re.escape(self.name)}_{kind}\d+", t)), key=lambda t: int(t.rpartition(f"_{kind}")[2]))
        self.generations, self.counts = by_number("g"), by_number("c")

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size) of all generations; group sizes count all batches' rows."""
        if not self.generations:
            raise ValueError("the index has no batch")
        parts = [self.spark.table(t) for t in self.generations]
        kind = parts[0].schema["keep_id"].dataType
        parts += [self.spark.table(t).select("digest", F.lit(None).cast(kind).alias("keep_id"), F.col("rows").alias("group_size")) for t in self.counts]
        if len(parts) == 1:
            return parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def _write(self, rows: DataFrame, at: str) -> DataFrame:
        # hash partitioning by the bucket column is the writer's own layout: one file per bucket
        (
            rows.repartition(self.buckets, "digest")
            .write.format("parquet")
            .option("path", f"{self.location}/{at}")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(at)
        )
        return self.spark.table(at)

    def append(self, digests: DataFrame) -> DataFrame:
        """Write the rows as a new generation; they must not be in the index yet."""
        at = f"{self.name}_g{len(self.generations)}"
        out = self._write(digests, at)
        self.generations.append(at)
        return out

    def count(self, rows: DataFrame) -> None:
        """Note further rows (digest, rows) of digests that the index holds."""
        at = f"{self.name}_c{len(self.counts)}"
        self._write(rows, at)
        self.counts.append(at)

    def drop(self) -> None:
        """Remove the tables and their files."""
        for t in self.generations + self.counts:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        remove(self.spark, self.location)
        self.generations, self.counts = [], []


def batch_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, key, n): rows of the batch counted by text and key."""
    require(docs, key, text)
    return docs.select(text_digest(docs[text]).alias("digest"), docs[key].alias("key")).groupBy("digest", "key").agg(F.count("*").alias("n"))


def add_batch(index: DigestIndex, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append the batch's new texts to the index; return that generation.

    The batch's digests meet each earlier generation in a sort-merge anti-join, on the
    buckets that these are written in.
    """
    rows = docs.select(text_digest(docs[text]).alias("digest"), docs[key].alias("key"))
    batch = rows.groupBy("digest").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    if not index.generations:
        return index.append(batch)
    batch = save(batch, "batch")
    before = [index.spark.table(t).select("digest").hint("merge") for t in index.generations]
    new = batch
    for t in before:
        new = new.join(t, "digest", "left_anti")
    out = index.append(new)
    known = batch.join(out.select("digest").hint("merge"), "digest", "left_anti")
    index.count(known.select("digest", F.col("group_size").alias("rows")))
    drop(batch)
    return out


def memberships(index: DigestIndex, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, digest.

    Digests that hold more than a thousandth of the rows are matched from a
    broadcast table (fewer than ``HOT_PARTS`` rows by arithmetic), all others by
    sort-merge join on the digest, so no task gets a hot digest.
    """
    rows = batch_digests(docs, key, text)
    known = index.read()
    total = known.agg(F.sum("group_size")).first()[0] or 0
    hot = known.where(F.col("group_size") * HOT_PARTS > total)
    cold = known.where(F.col("group_size") * HOT_PARTS <= total)
    marked = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    columns = ["digest", "key", "n", "keep_id", "group_size"]
    joined = marked.where("is_hot").join(F.broadcast(hot), "digest").select(columns).unionByName(marked.where("is_hot is null").join(cold, "digest").select(columns))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select(
        "key", "keep_id", "group_size", (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest"
    )


def dedup_in_batches(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """``memberships`` of ``docs`` brought to a new index in batches of descending key, null keys last.

    So the largest key of equal texts comes first and stays, whatever the batch of the
    others. Keys that are not numbers are cut at those of ``CUT_SAMPLE`` drawn by hash. The
    result is saved; the index and its files are removed.
    """
    require(docs, key, text)
    shares = [1 - (k + 1) / batches for k in range(batches - 1)]
    if isinstance(docs.schema[key].dataType, T.NumericType):
        cuts = docs.agg(F.percentile_approx(docs[key], shares, 10_000).alias("cuts")).first()["cuts"] if shares else []
    else:
        drawn = docs.select(docs[key].alias("key")).where("key is not null").orderBy(F.xxhash64("key")).limit(CUT_SAMPLE)
        found = [r.key for r in drawn.orderBy("key").collect()]
        cuts = [found[int(s * len(found))] for s in shares] if found else []
    index, above = DigestIndex(docs.sparkSession), None
    for low in [*dict.fromkeys(cuts or []), None]:
        rest = F.lit(True) if above is None else F.coalesce(docs[key] < above, F.lit(True))
        add_batch(index, docs.where(rest & (F.lit(True) if low is None else docs[key] >= low)), key, text)
        above = low
    out = save(memberships(index, docs, key, text), "dedup")
    index.drop()
    return out


def keep_first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Only (digest, key) pairs are shuffled; the rows that go are taken out by anti-join
    on the pair, by broadcast where a count shows that they are few.
    """
    own = index or DigestIndex(docs.sparkSession)
    pairs = save(batch_digests(docs, key, text), "pairs")
    stay = add_batch(own, docs, key, text).select("digest", F.col("keep_id").alias("stays"))
    same = lambda a, d, k: (a["digest"] == d) & a["key"].eqNullSafe(k)
    lost = save(pairs.join(stay, same(pairs, stay["digest"], stay["stays"]), "left_anti").select("digest", "key"), "lost")
    again = save(pairs.where("n > 1").join(stay, same(pairs, stay["digest"], stay["stays"]), "left_semi").select("digest", "key"), "again")
    drop(pairs)
    if index is None:
        own.drop()
    digest = text_digest(docs[text])
    few = small_enough(lost)
    left = docs.join(few, same(few, digest, docs[key]), "left_anti")
    if again.isEmpty():
        return left
    repeated = small_enough(again)
    d = "__digest_" + uuid.uuid4().hex[:8]
    once = left.withColumn(d, text_digest(left[text]))
    once = once.join(repeated, same(repeated, once[d], once[key]), "left_semi").dropDuplicates([d, key]).drop(d)
    return left.join(repeated, same(repeated, text_digest(left[text]), left[key]), "left_anti").unionByName(once)

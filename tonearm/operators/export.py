"""Export: id translation, audit, page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that fit a page, and the share of audited ids that must agree.
ROWS_PER_PAGE, AUDIT_GATE = 154, 0.999


def translate_pairs(pairs: DataFrame, id_map: DataFrame) -> DataFrame:
    """(id_a, id_b, sim) with both ends translated, least first, each pair once with its best similarity."""
    a = id_map.select(F.col("old").alias("a"), F.col("new").alias("x"))
    b = id_map.select(F.col("old").alias("b"), F.col("new").alias("y"))
    return pairs.join(a, "a").join(b, "b").groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("sim").alias("sim"))


def skipped_pairs(pairs: DataFrame, id_map: DataFrame) -> DataFrame:
    """Pairs with an end that the map lacks."""
    known = id_map.select("old")
    hit = pairs.join(known.withColumnRenamed("old", "a"), "a", "left_semi").join(known.withColumnRenamed("old", "b"), "b", "left_semi")
    return pairs.join(hit.select("a", "b"), ["a", "b"], "left_anti")


def audit(id_map: DataFrame, sizes: DataFrame, target_sizes: DataFrame) -> DataFrame:
    """One row: ok, bad and missing ids by equal sizes on both sides, and whether the gate is passed."""
    j = id_map.join(sizes.select(F.col("id").alias("old"), F.col("size").alias("here")), "old", "left").join(target_sizes.select(F.col("id").alias("new"), F.col("size").alias("there")), "new", "left")
    missing = F.col("here").isNull() | F.col("there").isNull()
    ok = ~missing & (F.col("here") == F.col("there"))
    row = j.agg(F.count_if(ok).alias("ok"), F.count_if(~missing & (F.col("here") != F.col("there"))).alias("bad"), F.count_if(missing).alias("missing"))
    return row.withColumn("passed", F.coalesce(F.try_divide(F.col("ok").cast("double"), F.col("ok") + F.col("bad") + F.col("missing")) >= AUDIT_GATE, F.lit(True)))


def page_of(ordinal: Column, rows_per_page: int = ROWS_PER_PAGE) -> Column:
    """Page (from 0) of a row numbered from 1."""
    return F.floor((ordinal - 1) / rows_per_page)


def split_millis(ms: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of a time in milliseconds."""
    return F.shiftright(ms, 32), ms.bitwiseAND(F.lit(0xFFFFFFFF))

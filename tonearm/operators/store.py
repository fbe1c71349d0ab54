"""The long-format feature store: latest-wins upserts, merges, pivots, fills, provenance, change sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import durable


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key, whole. Null order values come first.

    A maximum over a struct aggregates map-side, so a hot key never sorts in one task.
    """
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(store: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``store`` with the rows of ``new`` in place of those with their keys; ``new`` wins, then its latest row."""
    both = store.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)))
    return latest(both, key, [F.col("__rank"), *[F.col(c) for c in order]]).drop("__rank")


def merge_external(store: DataFrame, external: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bulk replace by a second store with the same columns."""
    return upsert(store, external, key, [])


def append_run(spark, path: str, row: DataFrame) -> None:
    """One more line in the run ledger."""
    row.write.mode("append").parquet(path)


def pivot_features(features: DataFrame, names: Sequence[str], key: str = "rb_id", value: str = "num") -> DataFrame:
    """Wide rows with one column per name; the list is explicit, so the schema is known before the data is read."""
    return features.where(F.col("name").isin(*names)).groupBy(key).pivot("name", list(names)).agg(F.max(value))


def one_value() -> Column:
    """The number as text if there is one, else the text."""
    return F.coalesce(F.col("num").cast("string"), F.col("txt"))


def complete_rows(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which every named column is there and finite."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in names]
    return wide.where(reduce(lambda a, b: a & b, ok))


def not_done(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose key has no row in ``done``."""
    return work.join(done.select(*key), list(key), "left_anti")


def only_listed(work: DataFrame, listed: DataFrame, key: Sequence[str]) -> DataFrame:
    return work.join(listed.select(*key), list(key), "left_semi")


def fill_empty(current: Column, new: Column) -> Column:
    """The current text unless it is null or blank."""
    return F.coalesce(F.nullif(F.trim(current), F.lit("")), new)


def get_or_create(dim: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``dim`` with a new row for each unknown name, numbered on from the largest key in the order of names."""
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dim.select(name), name, "left_anti")
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    numbered = number_rows(new, [F.col(name)], "n").crossJoin(F.broadcast(top))  # one row
    return dim.select(key, name).unionByName(numbered.select((F.col("n") + F.col("top")).cast(dim.schema[key].dataType).alias(key), name))


def change_set(desired: DataFrame, existing: DataFrame, key: Sequence[str], value: str, deleted: str = "deleted") -> DataFrame:
    """(key, op, value): insert, resurrect, remove or unchanged for each key of either side.

    ``existing`` has one row per key with a 0/1 ``deleted``; a deleted row that is not desired is left out.
    """
    d = desired.select(*key, F.col(value).alias("__value"), F.lit(True).alias("__want"))
    e = existing.select(*key, F.col(deleted).alias("__dead"))
    op = (
        F.when(F.col("__want") & F.col("__dead").isNull(), "insert")
        .when(F.col("__want") & (F.col("__dead") == 1), "resurrect")
        .when(F.col("__want"), "unchanged")
        .when(F.col("__dead") == 0, "remove")
    )
    return d.join(e, list(key), "full").select(*key, op.alias("op"), F.col("__value").alias(value)).where("op is not null")


def apply_changes(existing: DataFrame, changes: DataFrame, key: Sequence[str], value: str, deleted: str = "deleted") -> DataFrame:
    """The next snapshot: (key, value, deleted)."""
    kept = existing.join(changes.select(*key, "op", F.col(value).alias("__new")), list(key), "left")
    old = kept.select(*key, F.when(F.col("op").isin("resurrect", "unchanged"), F.col("__new")).otherwise(F.col(value)).alias(value), F.when(F.col("op") == "remove", 1).when(F.col("op") == "resurrect", 0).otherwise(F.col(deleted)).alias(deleted))
    return old.unionByName(changes.where("op = 'insert'").select(*key, value, F.lit(0).alias(deleted)))


def change_numbers(changes: DataFrame, base: int, value: str, key: Sequence[str]) -> DataFrame:
    """Consecutive numbers after ``base``: inserts by falling value, then resurrected, then removed rows.

    Numbers follow one order of all changes. Parts of a global sort are counted first and
    numbered apart, so no single task takes them all.
    """
    ops = changes.where("op <> 'unchanged'").withColumn("__op", F.when(F.col("op") == "insert", 0).when(F.col("op") == "resurrect", 1).otherwise(2))
    return number_rows(ops, [F.col("__op"), F.when(F.col("__op") == 0, -F.col(value)).asc_nulls_first(), *[F.col(k) for k in key]], "usn", base).drop("__op")


def number_rows(rows: DataFrame, order: Sequence[Column], name: str, base: int = 0) -> DataFrame:
    """``name`` = base + 1, 2, ... in the given global order, by range partitions and one count per partition.

    The sorted rows are written before they are counted, so that counts and numbers see
    the same partitions and the same order of ties.
    """
    parts = durable.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    firsts = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = firsts.select("__part", "__first", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, (F.col("__id") - F.col("__first") + F.col("__before") + base + 1).cast("long")).drop("__part", "__id", "__first", "__before")


def running_total(rows: DataFrame, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """``name`` = sum of ``weight`` of all rows before this one in the given global order, in the manner of ``number_rows``."""
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = durable.written(placed.withColumn("__in", F.coalesce(F.sum(weight).over(within), F.lit(0))))
    sums = parts.groupBy("__part").agg(F.sum(weight).alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")

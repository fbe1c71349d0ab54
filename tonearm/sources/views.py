"""Domain views over the driver's tables; their SQL forms stand beside them for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the features in ``features``.
EVENTS = ["click", "error", "purchase", "signup", "view"]

FEATURES_SQL = "select user_id as rb_id, event_type as name, value as num, props as txt, ts as fetched_at, event_id as seq from events"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rb_id"), F.col("event_type").alias("name"), F.col("value").alias("num"), F.col("props").alias("txt"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq")
    )


# Genres dealt to tracks by their id.
GENRES = ["Electronic---House", "Electronic---Techno", "Electronic---Goa Trance", "Electronic---Drum n Bass", "Electronic---Dubstep", "Electronic---Ambient", "Hip Hop---Trap", "Electronic---Halftime", "Electronic---Disco House", "Electronic---Hardcore", "Rock---Indie", "Electronic---UK Garage"]
KEYS = ["Abm", "B", "Ebm", "F#", "Bbm", "Db", "Fm", "Ab", "Cm", "Eb", "Gm", "Bb", "Dm", "F", "Am", "C", "Em", "G", "Bm", "D", "F#m", "A", "Dbm", "E"]


def _list_sql(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


TRACKS_SQL = f"""select p_partkey as track, p_name as title, p_brand as artist, p_type as kind, p_size as length,
  case when p_partkey % 11 = 0 then null else (60 + (p_partkey * 37) % 120)::double end as bpm,
  ({_list_sql(GENRES)})[(p_partkey % {len(GENRES)} + 1)::int] as genre, ({_list_sql(KEYS)})[(p_partkey % 24 + 1)::int] as key,
  p_retailprice as price from part"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (k % len(items) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("track"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("length"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(60 + (k * 37) % 120).cast("double").alias("bpm"),
        pick(GENRES).alias("genre"),
        pick(KEYS).alias("key"),
        F.col("p_retailprice").alias("price"),
    )


VECTORS_SQL = f"""select vec_id, embedding::double[] as vec, label, (60 + (vec_id * 37) % 120)::double as bpm,
  ({_list_sql(KEYS)})[(vec_id % 24 + 1)::int] as key, 'l' || (vec_id % 97) as name from embeddings"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        k,
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        (60 + (k * 37) % 120).cast("double").alias("bpm"),
        F.element_at(F.array(*[F.lit(x) for x in KEYS]), (k % 24 + 1).cast("int")).alias("key"),
        F.concat(F.lit("l"), (k % 97).cast("string")).alias("name"),
    )


TREE_SQL = """select 'root' as id, null as parent, 'root' as name, 'folder' as kind
  union all select 'r' || r_regionkey, 'root', r_name, 'folder' from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'folder' from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, 'list' from customer"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, prefix: str, key: str, parent, label: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.col(label).alias("name"), F.lit(kind).alias("kind"))

    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("name"), F.lit("folder").alias("kind"))
    out = root.unionByName(level("region", "r", "r_regionkey", F.lit("root"), "r_name", "folder"))
    out = out.unionByName(level("nation", "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", "folder"))
    return out.unionByName(level("customer", "c", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name", "list"))


MEMBERS_SQL = "select 'c' || o_custkey as id, o_orderkey as item from orders"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("item"))

"""Similarity pairs, neighbours, change sets, export, clusters, directions."""

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import harmony, tempo
from tonearm.operators import angular, clusters, density, durable, export, layout, ridge, scale, store, vectors
from tonearm.sources import pages
from tonearm.sources.views import GENRES, VECTORS_SQL
from tonearm.sources.views import table
from tonearm.sources.views import vectors as vector_view

from .registry import query
from .rule_queries import _WHEEL

#: Similarity from which two vectors of the test tables match, partners per vector, bonus of a fitting key.
TAU, TOP, KEY_BONUS = 0.25, 6, 0.02
#: Members of a density cluster of the test tables, neighbours of the core distance.
CLUSTER_LEAST, CLUSTER_SAMPLES = 5, 3

_V = f"v as materialized (select *, {_WHEEL.format(k='key')} // 2 + 1 as kn, {_WHEEL.format(k='key')} % 2 as kl from ({VECTORS_SQL}))"
_FIT = "(a.kn = b.kn or (a.kl = b.kl and (a.kn - b.kn + 12) % 12 in (1, 11)))"


def _tempo_sql(t: float) -> str:
    return "(" + " or ".join(f"abs(a.bpm - b.bpm * {r}::double) / (b.bpm * {r}::double) <= {t}::double" for r in (1.0, 2.0, 0.5)) + ")"


_PAIRS = f"""{_V}, d as (select a.vec_id as i, b.vec_id as j, list_dot_product(a.vec, b.vec) as sim, b.name as lj, case when {_FIT} then 0.02::double else 0.0::double end as bonus
  from v a join v b on a.vec_id <> b.vec_id and a.name <> b.name and list_dot_product(a.vec, b.vec) >= {TAU}::double and list_dot_product(a.vec, b.vec) < 0.997::double and {_tempo_sql(0.08)}),
  l as (select *, row_number() over (partition by i, lj order by sim + bonus desc, j desc) as rl from d), k as (select *, row_number() over (partition by i order by sim + bonus desc, j desc) as rk from l where rl = 1),
  pairs as materialized (select least(i, j) as a, greatest(i, j) as b, max(sim) as sim from k where rk <= {TOP} group by all)"""


def matching(spark, sf_dir, threshold=TAU, top=TOP, tolerance=0.08):
    v = vector_view(spark, sf_dir)
    facts = v.select("vec_id", "bpm", "name", harmony.wheel_number(F.col("key")).alias("kn"), harmony.wheel_letter(F.col("key")).alias("kl"))
    side = lambda s: facts.select(*[F.col(c).alias("i" if c == "vec_id" and s == "i" else "j" if c == "vec_id" else f"{c}_{s}") for c in facts.columns])
    near = vectors.both_ways(angular.similar_pairs(v, "vec_id", "vec", threshold).where("sim < 0.997"))
    d = near.join(side("i"), "i").join(side("j"), "j").where(F.col("name_i") != F.col("name_j")).where(tempo.tempo_fits(F.col("bpm_i"), F.col("bpm_j"), tolerance))
    bonus = F.when(harmony.keys_fit(F.col("kn_i"), F.col("kl_i"), F.col("kn_j"), F.col("kl_j")), KEY_BONUS).otherwise(0.0)
    return durable.written(vectors.undirected(vectors.top_partners(d.withColumn("score", F.col("sim") + bonus), top, "score", "name_j")))


@query(f"with {_PAIRS} select a, b, round(sim, 4) as sim from pairs")
def matching_pairs(spark, sf_dir):
    return matching(spark, sf_dir).select("a", "b", F.round("sim", 4).alias("sim"))


@query(f"""with {_PAIRS}, e as (select a as id from pairs union all select b from pairs), g as (select v.vec_id, count(e.id) as d from v left join e on e.id = v.vec_id group by 1)
  select count(*) as nodes, count_if(d > 0) as matched, floor(quantile_cont(d, 0.5))::bigint as median_degree, floor(quantile_cont(d, 0.9))::bigint as p90_degree, max(d) as max_degree, (select count(*) from pairs) as pairs from g""")
def matching_degree(spark, sf_dir):
    return vectors.degree_report(matching(spark, sf_dir), vector_view(spark, sf_dir), "vec_id")


@query(f"""with {_PAIRS}, r as (select *, row_number() over (order by sim desc, a, b) as rn, count(*) over () as n from pairs) select a, b, round(sim, 4) as sim, rn from r where rn <= 5 or (rn > n // 2 and rn <= n // 2 + 5) or rn > n - 5""")
def matching_sample(spark, sf_dir):
    p = matching(spark, sf_dir)
    n = p.count()
    ranked = store.number_rows(p, [F.col("sim").desc(), F.col("a"), F.col("b")], "rn")
    return ranked.where((F.col("rn") <= 5) | ((F.col("rn") > n // 2) & (F.col("rn") <= n // 2 + 5)) | (F.col("rn") > n - 5)).select("a", "b", F.round("sim", 4).alias("sim"), "rn")


_STATE = "state as (select a, b, ((a + b) % 3 = 1)::int as deleted from pairs where (a + b) % 3 < 2 union all select -1 - a, b, a % 2 from pairs where (a + b) % 50 = 0)"
_CHANGES = """c as (select coalesce(p.a, s.a) as a, coalesce(p.b, s.b) as b, sim, case when p.a is not null and s.a is null then 'insert' when p.a is not null and deleted = 1 then 'resurrect' when p.a is not null then 'unchanged' when deleted = 0 then 'remove' end as op
  from pairs p full join state s on p.a = s.a and p.b = s.b)"""


def changes(spark, sf_dir):
    p = matching(spark, sf_dir)
    s = F.col("a") + F.col("b")
    old = p.where(s % 3 < 2).select("a", "b", (s % 3 == 1).cast("int").alias("deleted"))
    stale = p.where(s % 50 == 0).select((-1 - F.col("a")).alias("a"), "b", (F.col("a") % 2).cast("int").alias("deleted"))
    return store.change_set(p, old.unionByName(stale), ["a", "b"], "sim")


@query(f"with {_PAIRS}, {_STATE}, {_CHANGES} select a, b, op, round(sim, 4) as sim from c where op is not null")
def matching_diff_cdc(spark, sf_dir):
    return changes(spark, sf_dir).select("a", "b", "op", F.round("sim", 4).alias("sim"))


@query(f"with {_PAIRS}, {_STATE}, {_CHANGES} select a, b, op, 1000 + row_number() over (order by case op when 'insert' then 0 when 'resurrect' then 1 else 2 end, case when op = 'insert' then -sim end nulls first, a, b) as usn from c where op in ('insert', 'resurrect', 'remove')")
def matching_usn(spark, sf_dir):
    return store.change_numbers(changes(spark, sf_dir), 1000, "sim", ["a", "b"]).select("a", "b", "op", "usn")


_MAP = "map as (select vec_id as old, 100000 + (vec_id * 7) % 5003 as new from v where vec_id % 17 <> 3)"


def id_map(spark, sf_dir):
    k = F.col("vec_id")
    return vector_view(spark, sf_dir).where(k % 17 != 3).select(k.alias("old"), (100000 + (k * 7) % 5003).alias("new"))


@query(f"with {_PAIRS}, {_MAP} select least(x.new, y.new) as id_a, greatest(x.new, y.new) as id_b, round(max(sim), 4) as sim from pairs join map x on x.old = a join map y on y.old = b group by 1, 2")
def export_idmap(spark, sf_dir):
    return export.translate_pairs(matching(spark, sf_dir), id_map(spark, sf_dir)).withColumn("sim", F.round("sim", 4))


@query(f"with {_PAIRS}, {_MAP} select a, b from pairs where a not in (select old from map) or b not in (select old from map)")
def export_skipped(spark, sf_dir):
    return export.skipped_pairs(matching(spark, sf_dir), id_map(spark, sf_dir)).select("a", "b")


@query("""with m as (select p_partkey as old, p_partkey + 5 as new from part), j as (select o.p_size as here, case when n.p_partkey % 9 = 0 then n.p_size + 1 else o.p_size end as there, n.p_partkey is null as gone from m join part o on o.p_partkey = old left join part n on n.p_partkey = m.new)
  select count_if(not gone and here = there) as ok, count_if(not gone and here <> there) as bad, count_if(gone) as missing, count_if(not gone and here = there) / count(*) >= 0.999 as passed from j""")
def export_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    m = p.select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 5).alias("new"))
    here = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    sizes = p.select(F.col("p_partkey").alias("new"), F.col("p_size").alias("own")).join(p.select((F.col("p_partkey") + 5).alias("new"), F.col("p_size").alias("old_size")), "new")
    there = sizes.select(F.col("new").alias("id"), F.when(F.col("new") % 9 == 0, F.col("own") + 1).otherwise(F.col("old_size")).alias("size"))
    return export.audit(m, here, there)


@query(f"with {_PAIRS}, r as (select row_number() over (order by a, b) as rn from pairs) select (rn - 1) // 154 as page, count(*) as n, min(rn) as first_row from r group by 1")
def export_pages(spark, sf_dir):
    rows = store.number_rows(matching(spark, sf_dir), [F.col("a"), F.col("b")], "rn")
    return rows.groupBy(export.page_of(F.col("rn")).cast("long").alias("page")).agg(F.count("*").alias("n"), F.min("rn").alias("first_row"))


@query("select event_id, ((epoch_us(ts) // 1000) >> 32)::bigint as high, ((epoch_us(ts) // 1000) & 4294967295)::bigint as low from events")
def export_split_time(spark, sf_dir):
    high, low = export.split_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").select("event_id", high.alias("high"), low.alias("low"))


@query("select l_orderkey & 4294967295 as created_low, 0::bigint as created_high, l_partkey as partner_id, l_suppkey as owner_id, l_linenumber::bigint as like_rate, 0::bigint as flags from lineitem")
def page_roundtrip(spark, sf_dir):
    """Rows written as binary pages and read back."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("created_low"), F.lit(0).cast("long").alias("created_high"), F.col("l_partkey").alias("partner_id"), F.col("l_suppkey").alias("owner_id"), F.col("l_linenumber").cast("long").alias("like_rate"), F.lit(0).cast("long").alias("flags"))
    built = pages.image_pages(store.number_rows(li, [F.col("created_low"), F.col("like_rate"), F.col("partner_id")], "n"), "n")

    def read(frames):
        for f in frames:
            yield pd.DataFrame([r for b in f["bytes"] for r in pages.page_rows(bytes(b))], columns=list(pages.COLUMNS), dtype="int64")

    return built.select("bytes").mapInPandas(read, pages.SCHEMA)


_KNN = f"with {_V}, s as (select a.vec_id as q, b.vec_id as vec_id, list_dot_product(a.vec, b.vec) as sim, {_tempo_sql(0.06)} as t, {_FIT} as h from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s)"


def _queries(spark, sf_dir):
    return vector_view(spark, sf_dir).where("vec_id % 50 = 0")


@query(f"{_KNN} select q, vec_id, round(sim, 4) as sim, rank from r where rank <= 10")
def knn_topk(spark, sf_dir):
    near = angular.nearest(_queries(spark, sf_dir), vector_view(spark, sf_dir), "vec_id", "vec", 10)
    return near.select("q", "vec_id", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"{_KNN}, p as (select *, row_number() over (partition by q order by rank) as place from r where rank <= 200 and t and h) select q, vec_id, round(sim, 4) as sim, place from p where place <= 5")
def knn_harmonic(spark, sf_dir):
    """The five nearest that fit in key and tempo, out of the 200 nearest; there may be fewer."""
    v = vector_view(spark, sf_dir)
    near = angular.nearest(_queries(spark, sf_dir), v, "vec_id", "vec", 200)
    facts = v.select("vec_id", "bpm", harmony.wheel_number(F.col("key")).alias("n"), harmony.wheel_letter(F.col("key")).alias("l"))
    both = near.join(facts, "vec_id").join(facts.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("bpm").alias("qb"), F.col("n").alias("qn"), F.col("l").alias("ql")), "q")
    fit = both.where(tempo.tempo_fits(F.col("qb"), F.col("bpm"), 0.06) & harmony.keys_fit(F.col("qn"), F.col("ql"), F.col("n"), F.col("l")))
    return fit.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank")).cast("long")).where("place <= 5").select("q", "vec_id", F.round("sim", 4).alias("sim"), "place")


_CENTROIDS = f"""{_V}, x as (select label as cluster, generate_subscripts(vec, 1) as pos, unnest(vec) as x from v), m as (select cluster, pos, avg(x) as x from x group by all), c as (select cluster, list(x order by pos) as m, sqrt(sum(x * x)) + 1e-9::double as n from m group by cluster),
  cents as (select cluster, list_transform(m, lambda y: y / n) as centroid from c)"""


@query(f"with {_CENTROIDS} select cluster, pos, round(centroid[pos], 6) as x from cents, range(1, 65) r(pos)")
def centroid_means(spark, sf_dir):
    c = vectors.mean_vectors(vector_view(spark, sf_dir), "label", "vec")
    return c.select("cluster", F.posexplode("centroid").alias("pos", "x")).select("cluster", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"with {_CENTROIDS}, s as (select vec_id, cluster, list_dot_product(vec, centroid) as sim from v, cents), b as (select vec_id, arg_max(cluster, (sim, -cluster)) as cluster, max(sim) as sim from s group by 1) select vec_id, case when sim >= 0.2::double then cluster end as cluster, round(sim, 4) as sim from b")
def centroid_assign_floor(spark, sf_dir):
    v = vector_view(spark, sf_dir)
    got = vectors.nearest_centroid(v, vectors.mean_vectors(v, "label", "vec"), "vec_id", "vec", 0.2)
    return got.withColumn("sim", F.round("sim", 4))


def _first_centroids(spark, sf_dir, k=8):
    first = vector_view(spark, sf_dir).orderBy("vec_id").limit(k)
    return first.select((F.row_number().over(W.orderBy("vec_id")) - 1).alias("cluster"), vectors.unit(F.col("vec")).alias("centroid"))


@query(f"with {_V}, c as (select (row_number() over (order by vec_id) - 1)::int as cluster, vec as centroid from (select * from v order by vec_id limit 8)), s as (select vec_id, cluster, list_dot_product(vec, centroid) as sim from v, c) select arg_max(cluster, (sim, -cluster)) as cluster, vec_id from s group by vec_id")
def kmeans_lloyd_step(spark, sf_dir):
    lab, _ = clusters.lloyd_step(vector_view(spark, sf_dir), _first_centroids(spark, sf_dir), "vec_id", "vec")
    return lab.select("vec_id", "cluster")


@query()
def kmeans_spherical(spark, sf_dir):
    return clusters.spherical_kmeans(vector_view(spark, sf_dir), _first_centroids(spark, sf_dir, clusters.K), "vec_id", "vec", clusters.ROUNDS).select("vec_id", "cluster")


@query()
def kmeans_cosine_ml(spark, sf_dir):
    from pyspark.ml.clustering import KMeans

    v = vector_view(spark, sf_dir).select("vec_id", array_to_vector("vec").alias("features"))
    return KMeans(k=18, seed=0, maxIter=10, distanceMeasure="cosine").fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


_MEMBERS = "mem as (select label as cluster, (['deep-house', 'house', 'goa', 'trap', ''])[(case when label % 2 = 0 then vec_id % 5 else vec_id % 2 + 1 end + 1)::int] as sub, (['hip-hop', 'techno', 'house'])[(vec_id % 3 + 1)::int] as family from embeddings)"


@query(
    f"""with {_MEMBERS}, n as (select cluster, count(*) as n from mem group by 1), s as (select cluster, sub, count(*) as c, row_number() over (partition by cluster order by count(*) desc, sub) as r from mem where sub not in ('', 'house') group by 1, 2),
  f as (select cluster, family, row_number() over (partition by cluster order by count(*) desc, family) as r from mem group by 1, 2), g as (select n.cluster, n, case when c >= greatest(12, 0.30::double * n) then sub else family end as name from n join f on f.cluster = n.cluster and f.r = 1 left join s on s.cluster = n.cluster and s.r = 1)
  select name, count(*) as clusters, sum(n)::bigint as n from g group by name"""
)
def cluster_name_merge(spark, sf_dir):
    k = F.col("vec_id")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    m = vector_view(spark, sf_dir).select(F.col("label").alias("cluster"), pick(["deep-house", "house", "goa", "trap", ""], F.when(F.col("label") % 2 == 0, k % 5).otherwise(k % 2 + 1)).alias("sub"), pick(["hip-hop", "techno", "house"], k % 3).alias("family"))
    return clusters.merge_names(clusters.cluster_names(m))


@query("""select name, round(gx - gy, 6) as along, round((gx - gy) / sqrt(2), 6) as unit_along from (values ('A', 5.0::double, 1.0::double), ('B', 4.0::double, 3.0::double), ('C', 2.0::double, 2.0::double), ('D', 1.0::double, 4.0::double), ('E', 0.0::double, 5.0::double)) v(name, gx, gy)""")
def direction_table(spark, sf_dir):
    v = spark.createDataFrame([("A", 5.0, 1.0), ("B", 4.0, 3.0), ("C", 2.0, 2.0), ("D", 1.0, 4.0), ("E", 0.0, 5.0)], "name string, x double, y double")
    d = F.array(F.lit(1.0), F.lit(-1.0))
    return v.select("name", F.round(vectors.dot(F.array("x", "y"), d), 6).alias("along"), F.round(vectors.projection(F.array("x", "y"), d), 6).alias("unit_along"))


@query(f"with {_V} select vec_id, round(list_dot_product(vec, list_transform(range(1, 65), lambda i: (i % 3 - 1)::double)) / sqrt(list_sum(list_transform(range(1, 65), lambda i: power(i % 3 - 1, 2)::double))), 6) as along from v")
def direction_projection(spark, sf_dir):
    d = F.array(*[F.lit(float(i % 3 - 1)) for i in range(1, 65)])
    return vector_view(spark, sf_dir).select("vec_id", F.round(vectors.projection(F.col("vec"), d), 6).alias("along"))


@query(f"with {_V}, s as (select label, avg(round(vec[1], 1)) as m, quantile_cont(vec[1], 0.5) as median, count(*) as n from v group by 1) select label, n, round(median, 6) as median from s")
def genre_median(spark, sf_dir):
    v = vector_view(spark, sf_dir).select("label", F.get("vec", F.lit(0)).alias("score"))
    return scale.group_medians(v, "label").withColumn("median", F.round("median", 6))


_X = f"""with {_V}, x as (select vec_id, label, vec[1] as a, round(vec[2], 1) as b from v)"""


@query(f"{_X}, r as (select rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rb, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as ra from x) select round(corr(ra, rb), 6) as rho from r")
def spearman_ranks(spark, sf_dir):
    x = vector_view(spark, sf_dir).select("vec_id", F.get("vec", F.lit(0)).alias("a"), F.round(F.get("vec", F.lit(1)), 1).alias("b"))
    ranked = scale.ranks(scale.ranks(x, "b", "rb"), "a", "ra")
    return ranked.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def _target(spark, sf_dir):
    """Vectors with a target that follows from them and their label."""
    return vector_view(spark, sf_dir).select("vec_id", "label", "vec", (F.col("label") + F.get("vec", F.lit(0)) * 3).alias("target"))


def _fitted(rows):
    offset, direction = ridge.fit(rows, "vec", "target")
    return ridge.predicted(F.col("vec"), F.lit(offset), F.array(*[F.lit(float(x)) for x in direction]))


@query()
def ridge_direction(spark, sf_dir):
    """(pos, weight): the fitted direction; as many rows as a vector has numbers."""
    _, w = ridge.fit(_target(spark, sf_dir).where("vec_id % 5 <> 0"), "vec", "target")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w / np.linalg.norm(w))], "pos int, weight double")


@query()
def spearman_heldout(spark, sf_dir):
    v = _target(spark, sf_dir)
    held = v.where("vec_id % 5 = 0").select("vec_id", _fitted(v.where("vec_id % 5 <> 0")).alias("prediction"), "target")
    ranked = scale.ranks(scale.ranks(held, "prediction", "rp"), "target", "rt")
    return ranked.agg(F.corr("rp", "rt").alias("rho"))


@query()
def leave_one_group_out(spark, sf_dir):
    """(label, n, error): each label predicted by the fit to all others; one pass of moments for all fits."""
    v = _target(spark, sf_dir)
    fits = ridge.fits_without(v, "vec", "target", F.col("label")).withColumnRenamed("group", "label")
    out = v.join(fits, "label").withColumn("error", F.abs(ridge.predicted(F.col("vec"), F.col("offset"), F.col("direction")) - F.col("target")))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg("error").alias("error"))


@query()
def impute_from_embedding(spark, sf_dir):
    """The target where it is known, else the prediction from the vector."""
    known = _target(spark, sf_dir).withColumn("target", F.when(F.col("vec_id") % 4 != 0, F.col("target")))
    return known.select("vec_id", F.coalesce(F.col("target"), _fitted(known)).alias("score"), F.col("target").isNull().alias("imputed"))


@query()
def pca_corr(spark, sf_dir):
    """(component, r): correlation of the first principal components with the target."""
    from pyspark.ml.feature import PCA

    v = _target(spark, sf_dir).withColumn("features", array_to_vector("vec"))
    p = PCA(k=4, inputCol="features", outputCol="pc").fit(v).transform(v).withColumn("pc", vector_to_array("pc"))
    row = p.agg(*[F.corr(F.get("pc", F.lit(i)), "target").alias(f"c{i}") for i in range(4)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.abs(F.col(f"c{i}")).alias("r")) for i in range(4)])).alias("x")).select("x.component", "x.r")


@query()
def map_projection(spark, sf_dir):
    """Two principal components per vector: a linear stand-in for a manifold map."""
    from pyspark.ml.feature import PCA

    v = _target(spark, sf_dir).withColumn("features", array_to_vector("vec"))
    p = PCA(k=2, inputCol="features", outputCol="pc").fit(v).transform(v).withColumn("pc", vector_to_array("pc"))
    return p.select("vec_id", F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))


@query(f"with {_V}, s as (select a.vec_id as q, b.label, list_dot_product(a.vec, b.vec) as sim, b.vec_id as o from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by sim desc, o) as k from s), c as (select q, label, count(*) as n from r where k <= 10 group by all) select q, arg_max(label, (n, -label)) as label, max(n) as votes from c group by q")
def knn_vote(spark, sf_dir):
    """The commonest label among the ten nearest of each query: what gives noise points a cluster."""
    v = vector_view(spark, sf_dir)
    near = angular.nearest(_queries(spark, sf_dir), v, "vec_id", "vec", 10).join(v.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"), F.max("n").alias("votes"))


@query()
def manifold_map(spark, sf_dir):
    """(vec_id, c0, c1): a map by neighbourhoods."""
    return layout.manifold_map(vector_view(spark, sf_dir).select("vec_id", "vec"), "vec_id", "vec")


@query()
def density_clusters(spark, sf_dir):
    """(vec_id, cluster, noise): leaf clusters by mutual reachability; noise has the cluster that its neighbours vote for."""
    return density.density_clusters(vector_view(spark, sf_dir).select("vec_id", "vec"), "vec_id", "vec", CLUSTER_LEAST, CLUSTER_SAMPLES)


@query(f"with {_V}, p as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.vec, b.vec) as sim, abs(a.bpm - b.bpm) as gap from v a join v b on a.vec_id < b.vec_id and list_dot_product(a.vec, b.vec) >= {TAU}::double) select count(*) as pairs, round(avg(gap), 6) as mean_gap from p")
def neighbour_smoothness(spark, sf_dir):
    v = vector_view(spark, sf_dir)
    b = v.select("vec_id", "bpm")
    p = angular.similar_pairs(v, "vec_id", "vec", TAU).join(b.select(F.col("vec_id").alias("a"), F.col("bpm").alias("x")), "a").join(b.select(F.col("vec_id").alias("b"), F.col("bpm").alias("y")), "b")
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mean_gap"))


@query()
def map_neighbour_card(spark, sf_dir):
    """Query, neighbour, and the card's facts of both."""
    v = vector_view(spark, sf_dir).select("vec_id", "vec", "bpm", "key", "label", F.element_at(F.array(*[F.lit(g) for g in GENRES]), (F.col("vec_id") % len(GENRES) + 1).cast("int")).alias("genre"))
    near = angular.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "vec", 5)
    facts = v.drop("vec")
    return near.join(facts, "vec_id").join(facts.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("bpm").alias("q_bpm"), F.col("key").alias("q_key")), "q")



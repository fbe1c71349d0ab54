"""Energy scale over pivoted features, its calibration and validation, and signal series."""

from pyspark.sql import functions as F

from tonearm.operators import scale, signal, store
from tonearm.sources.views import EVENTS, FEATURES_SQL, features, table

from .registry import query
from .store_queries import _LATEST, latest_features

# The test tables' five features stand for components (sign, group).
SCALE = scale.Scale({"click": (+1, "drive"), "error": (-1, "full"), "purchase": (+1, "weight"), "signup": (+1, "full"), "view": (-1, "weight")}, {"drive": 0.40, "weight": 0.35, "full": 0.25})
ANCHORS = {"click": (0.0, 100.0), "error": (80.0, 0.0), "purchase": (5.0, 120.0), "signup": (0.0, 90.0), "view": (100.0, 10.0)}


def wide(spark, sf_dir):
    return store.complete_rows(store.pivot_features(latest_features(spark, sf_dir), EVENTS), EVENTS)


def _z(c: str, frm: str) -> str:
    return f"greatest(-4.0::double, least(4.0::double, ({c} - (select quantile_cont({c}, 0.5) from {frm})) / ((select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from {frm}) + 1e-12::double)))"


_WIDE = f"{_LATEST}, w as materialized (select rb_id, " + ", ".join(f'max(num) filter (name = \'{n}\') as "{n}"' for n in EVENTS) + " from latest group by rb_id)"


def scored_sql(name: str, source: str) -> str:
    z = ", ".join(f'{_z(chr(34) + n + chr(34), source)} * {SCALE.components[n][0]} as z_{n}' for n in SCALE.components)
    m = ", ".join("(" + " + ".join(f"z_{n}" for n in SCALE.members(g)) + f") / {len(SCALE.members(g))}.0::double as m_{g}" for g in SCALE.weights)
    gs = ", ".join(f"{_z('m_' + g, name + '_m')} as g_{g}" for g in SCALE.weights)
    total = " + ".join(f"{w}::double * g_{g}" for g, w in SCALE.weights.items())
    return f"{name}_z as materialized (select *, {z} from {source}), {name}_m as materialized (select *, {m} from {name}_z), {name}_g as materialized (select *, {gs} from {name}_m), {name} as materialized (select *, {total} as score from {name}_g)"


_S = f"{_WIDE}, {scored_sql('s', 'w')}"
_D = f"{_S}, d as materialized (select *, (row_number() over (order by score, rb_id) - 0.5::double) / count(*) over () as pct from s), e as materialized (select *, least(floor(pct * 10.0::double) + 1, 10)::int as decile from d)"


def scored(spark, sf_dir):
    return scale.score(wide(spark, sf_dir), SCALE)


def deciled(spark, sf_dir):
    return scale.relative_deciles(scored(spark, sf_dir), "rb_id")


@query(f"{_S} select rb_id, " + ", ".join(f"round(z_{n}, 6) as z_{n}" for n in SCALE.components) + " from s")
def robust_z(spark, sf_dir):
    return scored(spark, sf_dir).select("rb_id", *[F.round(f"z_{n}", 6).alias(f"z_{n}") for n in SCALE.components])


@query(f"{_S} select rb_id, " + ", ".join(f"round(g_{g}, 6) as g_{g}" for g in SCALE.weights) + ", round(score, 6) as score from s")
def energy_group_score(spark, sf_dir):
    return scored(spark, sf_dir).select("rb_id", *[F.round(f"g_{g}", 6).alias(f"g_{g}") for g in SCALE.weights], F.round("score", 6).alias("score"))


@query(f"{_D} select rb_id, round(score, 4) as score, round(pct, 6) as pct, decile from e")
def energy_decile_relative(spark, sf_dir):
    return deciled(spark, sf_dir).select("rb_id", F.round("score", 4).alias("score"), F.round("pct", 6).alias("pct"), "decile")


@query(f"{_WIDE}, half as materialized (select * from w where rb_id % 2 = 0), {scored_sql('s', 'half')}, r as (select rb_id, round(score, 4) as score, row_number() over (order by score desc, rb_id) as place from s) select * from r where place <= 10")
def energy_rank_subset(spark, sf_dir):
    """The ten highest of a subset that is scored on its own."""
    own = scale.score(wide(spark, sf_dir).where("rb_id % 2 = 0"), SCALE)
    return store.number_rows(own, [F.col("score").desc(), F.col("rb_id")], "place").where("place <= 10").select("rb_id", F.round("score", 4).alias("score"), "place")


_TH = "[" + ", ".join(f"quantile_cont(score, {k / 8})" for k in range(1, 8)) + "]"
_CAL = f"o as (select {_TH} as o from s), th as materialized (select list_concat(o, [o[7] + (o[7] - o[6]), o[7] + 2 * (o[7] - o[6])]) as th from o)"


@query(
    f"{_S}, {_CAL} "
    + " union all ".join(f"select 'median {g}' as name, round(quantile_cont(m_{g}, 0.5), 6) as value from s union all select 'iqr {g}', round(quantile_cont(m_{g}, 0.75) - quantile_cont(m_{g}, 0.25), 6) from s" for g in SCALE.weights)
    + " union all select 'threshold ' || i, round(th[i], 6) from th, range(1, 10) r(i)"
)
def energy_calibration(spark, sf_dir):
    """The frozen numbers as rows: raw group means' medians and IQRs, and nine thresholds."""
    c = scale.calibrate(wide(spark, sf_dir), SCALE)
    rows = [(f"median {g}", m) for g, (m, _) in c.groups.items()] + [(f"iqr {g}", i) for g, (_, i) in c.groups.items()] + [(f"threshold {k + 1}", t) for k, t in enumerate(c.thresholds)]
    return spark.createDataFrame(rows, "name string, value double").withColumn("value", F.round("value", 6))


@query(f"{_S}, {_CAL} select rb_id, (1 + len(list_filter(th, lambda t: t <= score)))::int as decile from s, th")
def energy_decile_frozen(spark, sf_dir):
    """Calibrate on all rows, then score them as if newly read: the deciles are the calibration's own."""
    rows = wide(spark, sf_dir)
    c = scale.calibrate(rows, SCALE)
    c = scale.Calibration.from_json(c.to_json())
    again = scale.score(rows, SCALE, c)
    return again.select("rb_id", scale.frozen_decile(F.col("score"), F.array(*[F.lit(t) for t in c.thresholds])).alias("decile"))


_ABS = " + ".join(f"{w}::double * ((" + " + ".join(f'greatest(0.0::double, least(1.0::double, ("{n}" - {ANCHORS[n][0]}::double) / {ANCHORS[n][1] - ANCHORS[n][0]}::double))' for n in SCALE.members(g)) + f") / {len(SCALE.members(g))}.0::double)" for g, w in SCALE.weights.items())


@query(f"{_WIDE} select rb_id, round(10.0::double * ({_ABS}), 6) as energy from w")
def energy_absolute(spark, sf_dir):
    return wide(spark, sf_dir).select("rb_id", F.round(scale.absolute_score(SCALE, ANCHORS), 6).alias("energy"))


@query(f"{_S} " + " union all ".join(f"select '{n[2:]}' as name, round(corr({n}, score), 6) as r from s" for n in [*(f"z_{c}" for c in SCALE.components), *(f"g_{g}" for g in SCALE.weights)]))
def energy_component_corr(spark, sf_dir):
    return scale.component_correlations(scored(spark, sf_dir), SCALE).withColumn("r", F.round("r", 6))


@query(f"{_D}, p as (select a.rb_id as a, b.rb_id as b from e a join e b on a.rb_id % 40 = b.rb_id % 40 and a.rb_id < b.rb_id) select count(*) as pairs, round(avg(abs(x.pct - y.pct)), 6) as mean_distance, round(avg((abs(x.decile - y.decile) > 2)::int::double), 6) as far_share from p join e x on x.rb_id = a join e y on y.rb_id = b")
def dup_consistency(spark, sf_dir):
    """Pairs of one normalised song name; here ids equal modulo 40 share a name."""
    d = deciled(spark, sf_dir)
    named = d.select("rb_id", (F.col("rb_id") % 40).alias("song"))
    pairs = named.alias("x").join(named.alias("y"), "song").where("x.rb_id < y.rb_id").select(F.col("x.rb_id").alias("a"), F.col("y.rb_id").alias("b"))
    out = scale.pair_consistency(pairs, d, "rb_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_distance", "far_share")})


@query(f"{_D} select round(corr(60 + rb_id * 37 % 120, score), 6) as r, round(abs(corr(60 + rb_id * 37 % 120, pct)), 6) as r_pct from e")
def tempo_corr(spark, sf_dir):
    b = (60 + F.col("rb_id") * 37 % 120).cast("double")
    return deciled(spark, sf_dir).agg(F.round(F.corr(b, "score"), 6).alias("r"), F.round(F.abs(F.corr(b, "pct")), 6).alias("r_pct"))


@query(f"{_D} select rb_id % 3 = 0 as half_time, count(*) as n, round(avg(decile), 6) as mean_decile from e group by 1")
def halftime_audit(spark, sf_dir):
    return deciled(spark, sf_dir).groupBy((F.col("rb_id") % 3 == 0).alias("half_time")).agg(F.count("*").alias("n"), F.round(F.avg("decile"), 6).alias("mean_decile"))


_F = f"with f as ({FEATURES_SQL})"


@query(f"{_F}, x as (select *, greatest(0.0::double, coalesce(num - lag(num) over (partition by rb_id order by fetched_at, seq), 0.0::double)) as flux from f), p as (select rb_id, quantile_cont(flux, 0.75) as p75 from x group by 1), n as (select *, lag(flux) over w as b, lead(flux) over w as a from x window w as (partition by rb_id order by fetched_at, seq)) select rb_id, seq, round(flux, 6) as flux from n join p using (rb_id) where flux > p75 and flux >= b and flux > a")
def signal_flux_peaks(spark, sf_dir):
    order = ["fetched_at", "seq"]
    x = signal.positive_flux(features(spark, sf_dir), "rb_id", order, "num")
    return signal.peaks(x, "rb_id", order, "flux").select("rb_id", "seq", F.round("flux", 6).alias("flux"))


@query(f"{_F}, p as (select rb_id, quantile_cont(num, 0.1) as p10, quantile_cont(num, 0.5) as p50, quantile_cont(num, 0.9) as p90, quantile_cont(num, 0.95) as p95, quantile_cont(num, 0.99) as p99 from f group by 1) select rb_id, count(*) as n, round(avg((num > 0.5::double * p95)::int::double), 6) as sustain, round(any_value(p99 / (p50 + 1e-9::double)), 6) as crest, round(any_value(log10((p90 + 1e-9::double) / (p10 + 1e-9::double))), 6) as dyn_range from f join p using (rb_id) group by rb_id")
def signal_summary(spark, sf_dir):
    out = signal.series_summary(features(spark, sf_dir), "rb_id", "num")
    return out.withColumns({c: F.round(c, 6) for c in ("sustain", "crest", "dyn_range")})


@query("select p_partkey as track, k as segment, round(case when p_size * 8 < 40 then 0.0::double else p_size * 8 * 0.05::double + (p_size * 8 * 0.90::double - 15.0::double - p_size * 8 * 0.05::double) * k / 5.0::double end, 6) as start from part, range(6) r(k) where k = 0 or p_size * 8 >= 40")
def segment_schedule(spark, sf_dir):
    starts = signal.segment_starts((F.col("p_size") * 8).cast("double"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.posexplode(starts).alias("segment", "start")).select("track", F.col("segment").cast("long").alias("segment"), F.round("start", 6).alias("start"))


@query()
def stft_bands(spark, sf_dir):
    """Spectral features of each user's series taken as samples at 64 Hz."""
    series = features(spark, sf_dir).groupBy("rb_id").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "seq", "num"))).alias("s")).select("rb_id", F.col("s.num").alias("x"))
    return signal.signal_features(series, "rb_id", "x", rate=64.0, frame=16, hop=4, shortest_s=0.25, shortest_frames=4)

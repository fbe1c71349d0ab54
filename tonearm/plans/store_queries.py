"""Feature store, enrichment, candidates, dimensions."""

from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import enrich, store
from tonearm.sources.views import EVENTS, FEATURES_SQL, TRACKS_SQL, features, table, tracks

from .registry import query

_F = f"with f as ({FEATURES_SQL})"
_LATEST = f"""{_F}, latest as (select rb_id, name, arg_max(num, (fetched_at, seq)) as num, arg_max(txt, (fetched_at, seq)) as txt, arg_max(fetched_at, (fetched_at, seq)) as fetched_at from f group by all)"""
_COLUMNS = ", ".join(f"max(num) filter (name = '{n}') as {n}" for n in EVENTS)


def latest_features(spark, sf_dir):
    return store.latest(features(spark, sf_dir), ["rb_id", "name"], [F.col("fetched_at"), F.col("seq")])


@query(f"{_LATEST} select * from latest")
def feature_upsert_latest(spark, sf_dir):
    return latest_features(spark, sf_dir).drop("seq")


@query(f"""{_F} select rb_id, name, arg_max(num, (seq % 2, fetched_at, seq)) as num, max(seq % 2)::int as external from f group by all""")
def feature_merge_external(spark, sf_dir):
    f = features(spark, sf_dir).select("rb_id", "name", "num", "fetched_at", "seq", (F.col("seq") % 2).cast("int").alias("external"))
    here = store.latest(f.where("external = 0"), ["rb_id", "name"], [F.col("fetched_at"), F.col("seq")])
    there = store.latest(f.where("external = 1"), ["rb_id", "name"], [F.col("fetched_at"), F.col("seq")])
    return store.merge_external(here, there, ["rb_id", "name"]).select("rb_id", "name", "num", "external")


@query(f"{_LATEST} select rb_id, {_COLUMNS} from latest group by rb_id")
def feature_pivot_wide(spark, sf_dir):
    return store.pivot_features(latest_features(spark, sf_dir), EVENTS)


@query(f"""{_F} select rb_id, name, count(*) as n, count_if(coalesce(case when seq % 3 = 0 then null else 'num' end, txt) = 'num') as numbers,
  max(case when seq % 3 = 0 then txt end) as last_text from f group by all""")
def feature_polymorphic_value(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("num", F.when(F.col("seq") % 3 == 0, None).otherwise(F.col("num")))
    v = f.select("rb_id", "name", "num", store.one_value().alias("value"))
    return v.groupBy("rb_id", "name").agg(F.count("value").alias("n"), F.count_if(F.col("value") == F.col("num").cast("string")).alias("numbers"), F.max(F.when(F.col("num").isNull(), F.col("value"))).alias("last_text"))


@query(f"{_LATEST}, wide as (select rb_id, {_COLUMNS} from latest where not (rb_id % 4 = 0 and name = 'view') group by rb_id) select * from wide where click is not null and error is not null and purchase is not null and signup is not null and \"view\" is not null")
def feature_complete_rows(spark, sf_dir):
    some = latest_features(spark, sf_dir).where(~((F.col("rb_id") % 4 == 0) & (F.col("name") == "view")))
    return store.complete_rows(store.pivot_features(some, EVENTS), EVENTS)


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def incremental_todo(spark, sf_dir):
    return store.not_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def incremental_semi(spark, sf_dir):
    return store.only_listed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


_HOLES_SQL = f"""(select track::varchar as rb_id, title, artist, length, case when track % 3 = 0 then null else genre end as genre, case when track % 5 = 0 then '' else kind end as label,
  case when track % 7 = 0 then 0 else 1960 + (track % 60)::int end as year, case when track % 4 = 0 then ' ' else 'K' || track end as catno, track from ({TRACKS_SQL}))"""


def holes(spark, sf_dir):
    """Tracks with deterministic gaps."""
    t, k = tracks(spark, sf_dir), F.col("track")
    return t.select(
        k.cast("string").alias("rb_id"), "title", "artist", "length",
        F.when(k % 3 == 0, None).otherwise(F.col("genre")).alias("genre"), F.when(k % 5 == 0, "").otherwise(F.col("kind")).alias("label"),
        F.when(k % 7 == 0, 0).otherwise(1960 + k % 60).cast("int").alias("year"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("K"), k.cast("string"))).alias("catno"), "track",
    )


_JUNK_SQL = """case when coalesce(length, 0) >= 60 then false else trim(regexp_replace(lower(coalesce(artist, '')), '[^a-z0-9]+', ' ', 'g')) in ('loopmasters', '', 'none')
  or (regexp_matches(coalesce(title, ''), '^[A-Z0-9''_ -]{1,14}$') and not contains(coalesce(title, ''), ' ')) end"""


@query(f"select rb_id, genre, label, year from {_HOLES_SQL} where not ({_JUNK_SQL}) and (coalesce(trim(genre), '') = '' or coalesce(trim(label), '') = '' or coalesce(year, 0) = 0) order by track limit 25")
def candidates_missing_limit(spark, sf_dir):
    return enrich.candidates(holes(spark, sf_dir), ["genre", "label", "year"], 25, "track").select("rb_id", "genre", "label", "year")


@query(f"select {_JUNK_SQL} as junk, count(*) as n from (select case when p_partkey % 5 = 0 then 'ONE_SHOT-' || (p_partkey % 9) else p_name end as title, case when p_partkey % 7 = 0 then 'Loopmasters!' else p_brand end as artist, (p_size * 2)::int as length from part) group by 1")
def junk_predicate_hist(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    title = F.when(k % 5 == 0, F.concat(F.lit("ONE_SHOT-"), (k % 9).cast("string"))).otherwise(F.col("p_name"))
    artist = F.when(k % 7 == 0, "Loopmasters!").otherwise(F.col("p_brand"))
    return p.select(text.is_junk(F.col("p_size") * 2, artist, title).alias("junk")).groupBy("junk").agg(F.count("*").alias("n"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as norm from documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


_TITLES_SQL = """(select p_partkey as track, case p_partkey % 6 when 0 then p_name || ' (Original Mix)' when 1 then p_name || ' [Club Edit] feat. ' || p_brand when 2 then p_name || ' - ' when 3 then 'ft ' || p_name
  when 4 then p_name || ' [' || 'KAT' || (p_partkey % 900 + 10) || ']' else p_name || '  (live) {x}' end as title from part)"""


def titles(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    title = (
        F.when(k % 6 == 0, F.concat(n, F.lit(" (Original Mix)"))).when(k % 6 == 1, F.concat(n, F.lit(" [Club Edit] feat. "), F.col("p_brand"))).when(k % 6 == 2, F.concat(n, F.lit(" - ")))
        .when(k % 6 == 3, F.concat(F.lit("ft "), n)).when(k % 6 == 4, F.concat(n, F.lit(" [KAT"), (k % 900 + 10).cast("string"), F.lit("]"))).otherwise(F.concat(n, F.lit("  (live) {x}")))
    )
    return table(spark, sf_dir, "part").select(k.alias("track"), title.alias("title"))


@query(
    f"""select track, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title,
  '\\s*[\\(\\[][^)\\]]*\\b({text.NOISE_WORDS})\\b[^)\\]]*[\\)\\]]', '', 'gi'), '\\s*\\b(feat\\.?|ft\\.?|featuring)\\b.*$', '', 'gi'),
  '[\\[\\(][^)\\]]*[\\)\\]]', '', 'g'), '\\s+', ' ', 'g'), ' -') as title from {_TITLES_SQL}"""
)
def title_clean(spark, sf_dir):
    return titles(spark, sf_dir).select("track", text.clean_title(F.col("title")).alias("title"))


@query(f"""select track, nullif(regexp_extract(title, '[\\[\\(]\\s*([A-Za-z]{{2,}}[A-Za-z0-9]*\\d{{2,}}[A-Za-z0-9]*)\\s*[\\]\\)]', 1), '') as catno from {_TITLES_SQL}""")
def catno_extract(spark, sf_dir):
    return titles(spark, sf_dir).select("track", text.catalogue_number(F.col("title")).alias("catno"))


@query("select page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') as slug, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as label from pages")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.match_label(F.col("url")).alias("label"))


@query(
    """select page_id, regexp_replace(regexp_extract(u, '([^/]*)$', 1), '\\.[^.]*$', '') as base, trim(left(coalesce(regexp_extract(u, '([^/]*)$', 1), '') || ' - x', 44), ' -') as label
  from (select page_id, regexp_replace(replace(url, 'http', 'file'), '^file://(localhost)?', '') as u from pages where not contains(url, '%'))"""
)
def path_labels(spark, sf_dir):
    """Every page; the SQL leaves out urls with escapes, which the given tables do not hold and a test covers."""
    u = text.file_path(F.replace(F.col("url"), F.lit("http"), F.lit("file")))
    p = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", text.base_name(F.col("u")).alias("base"), F.btrim(F.left(F.concat(F.regexp_extract("u", "([^/]*)$", 1), F.lit(" - x")), F.lit(44)), F.lit(" -")).alias("label"))


def _sources(spark, sf_dir):
    t, k = tracks(spark, sf_dir), F.col("track")
    rb = k.cast("string").alias("rb_id")
    releases = t.where(k % 2 == 0).select(
        rb, (k % 10 != 0).cast("int").alias("matched"), ((k % 100) / 100.0).alias("confidence"), F.col("kind").alias("label"), F.lit("Electronic").alias("genre"),
        F.when(k % 4 == 0, F.col("artist")).otherwise("").alias("style"), F.when(k % 6 == 0, 0).otherwise(1990 + k % 30).cast("int").alias("year"), F.when(k % 8 == 0, "None").otherwise(F.concat(F.lit("CAT"), k.cast("string"))).alias("catno"),
    )
    streams = t.where(k % 3 == 0).select(rb, (k % 9 != 0).cast("int").alias("matched"), F.when(k % 2 == 0, '["Deep house","x"]').otherwise("[]").alias("artist_genres"), F.when(k % 5 == 0, "20x1").otherwise(F.concat((1980 + k % 40).cast("string"), F.lit("-05"))).alias("release_date"))
    return releases, streams


_SOURCES_SQL = f"""with h as (select * from {_HOLES_SQL}), t as ({TRACKS_SQL}),
r as (select track::varchar as rb_id, (track % 10 <> 0)::int as matched, (track % 100) / 100.0::double as confidence, kind as label, 'Electronic' as genre,
  case when track % 4 = 0 then artist else '' end as style, case when track % 6 = 0 then 0 else 1990 + (track % 30)::int end as year, case when track % 8 = 0 then 'None' else 'CAT' || track end as catno from t where track % 2 = 0),
s as (select track::varchar as rb_id, case when track % 2 = 0 then 'Deep House' end as genre, try_cast(left(case when track % 5 = 0 then '20x1' else (1980 + track % 40)::varchar || '-05' end, 4) as int) as year from t where track % 3 = 0 and track % 9 <> 0),
j as (select coalesce(r.rb_id, s.rb_id) as rb_id, coalesce(r.matched = 1 and r.confidence >= 0.6::double, false) as ok, r.confidence, coalesce(nullif(r.style, ''), r.genre) as rg, r.label as rl, r.year as ry, r.catno as rc, s.genre as sg, s.year as sy from r full join s on r.rb_id = s.rb_id),
p as (
  select h.rb_id, 'genre' as field, case when ok then rg else sg end as value, case when ok then 'discogs' else 'spotify' end as source, case when ok then confidence end as confidence from j join h on h.rb_id = j.rb_id where coalesce(trim(h.genre), '') = ''
  union all select h.rb_id, 'label', rl, 'discogs', confidence from j join h on h.rb_id = j.rb_id where ok and coalesce(trim(h.label), '') = ''
  union all select h.rb_id, 'year', (case when ok and ry <> 0 then ry else sy end)::varchar, case when ok and ry <> 0 then 'discogs' else 'spotify' end, case when ok and ry <> 0 then confidence end from j join h on h.rb_id = j.rb_id where coalesce(h.year, 0) = 0
  union all select h.rb_id, 'catno', rc, 'discogs', confidence from j join h on h.rb_id = j.rb_id where ok and lower(rc) <> 'none' and coalesce(trim(h.catno), '') = ''
), pv as (select * from p where value is not null)"""


@query(f"{_SOURCES_SQL} select * from pv")
def enrich_provenance(spark, sf_dir):
    return enrich.provenance(holes(spark, sf_dir), enrich.resolve(*_sources(spark, sf_dir)))


@query(
    f"""{_SOURCES_SQL} select h.rb_id, coalesce(g.value, h.genre) as genre, coalesce(l.value, h.label) as label, coalesce(y.value::int, h.year) as year, coalesce(c.value, h.catno) as catno
  from h left join pv g on g.rb_id = h.rb_id and g.field = 'genre' left join pv l on l.rb_id = h.rb_id and l.field = 'label'
  left join pv y on y.rb_id = h.rb_id and y.field = 'year' left join pv c on c.rb_id = h.rb_id and c.field = 'catno'"""
)
def enrich_apply_fill_empty(spark, sf_dir):
    return enrich.apply_fills(holes(spark, sf_dir), enrich.resolve(*_sources(spark, sf_dir))).select("rb_id", "genre", "label", "year", "catno")


@query("""select l_partkey as track, arg_max(l_suppkey, (l_quantity, -pos)) as supplier, max(l_quantity) as score
  from (select *, l_orderkey * 10 + l_linenumber as pos from lineitem) where l_quantity > 0 group by l_partkey""")
def best_candidate_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return enrich.best_candidate(li, ["track"], "score", "pos").select("track", "supplier", "score")


@query()
def fuzzy_match_ratio(spark, sf_dir):
    """Documents against benchmark items that share their first word: blocked, so no cross product."""
    first = lambda c: F.substring_index(text.normalise(F.col(c)), " ", 1)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), first("text").alias("w"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"), first("text").alias("w"))
    return d.join(b, "w").select("doc_id", "item_id", F.round(text.match_confidence(F.col("q"), F.col("t"), F.lit(False), F.col("w")), 2).alias("confidence"))


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def enrich_report(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rb_id"), "quality", "toxic", F.col("quality").alias("confidence"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rb_id"), "source")
    return enrich.ranked_report(docs, found).select(F.col("rb_id").alias("doc_id"), "source", "quality", "toxic")


@query("select count(*) as fetched, count_if(quality = 1) as matched, round(count_if(quality = 1)::double / count(*), 9) as rate, round(avg(toxic::double) filter (quality = 1), 9) as confidence, 'labels' as source from labels")
def match_rate(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select(F.col("quality").alias("matched"), F.col("toxic").cast("double").alias("confidence"))
    return enrich.fetch_report(found, "labels").withColumns({"rate": F.round("rate", 9), "confidence": F.round("confidence", 9)})


@query("""with dim as (select row_number() over (order by name)::bigint as id, name from (select distinct p_brand as name from part where p_partkey % 3 = 0)),
  fresh as (select distinct p_brand as name from part where p_brand not in (select name from dim))
  select * from dim union all select (select coalesce(max(id), 0) from dim) + row_number() over (order by name), name from fresh""")
def dim_get_or_create(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"))
    dim = store.number_rows(p.where("p_partkey % 3 = 0").select("name").distinct(), [F.col("name")], "id")
    return store.get_or_create(dim, p, "id", "name")


@query(f"""{_F} select rb_id, name, arg_max(num, (fetched_at, seq)) as value from f where seq % 2 = 0 group by all""")
def applied_log_latest(spark, sf_dir):
    log = features(spark, sf_dir).where("seq % 2 = 0").select("rb_id", F.col("name").alias("field"), F.col("num").alias("value"), F.struct("fetched_at", "seq").alias("applied_at"))
    return enrich.latest_applied(log).select("rb_id", F.col("field").alias("name"), "value")

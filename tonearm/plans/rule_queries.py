"""Genres, tempo, keys, moods, tags, playlists."""

from pyspark.sql import functions as F

from tonearm.functions import harmony, rules, tempo, text
from tonearm.operators import clusters, tags
from tonearm.sources.views import EVENTS, KEYS, TRACKS_SQL, table, tracks

from .registry import query
from .store_queries import _LATEST, latest_features

_T = f"with t as ({TRACKS_SQL})"
_SUB = "lower(case when contains(genre, '---') then substr(genre, position('---' in genre) + 3) else '' end)"
_PARENT = "split_part(genre, '---', 1)"


def _any(words):
    return "(" + " or ".join(f"contains({_SUB}, '{w}')" for w in words) + ")"


_FAMILY = f"case when {_PARENT} = 'Hip Hop' then 'hip-hop' when {_PARENT} <> 'Electronic' then 'other' " + " ".join(f"when {_any(w)} then '{n}'" for n, w in rules.FAMILY_WORDS) + f" when {_SUB} = 'hip hop' then 'hip-hop' else 'other' end"
_TAG = f"case when {_PARENT} = 'Hip Hop' or {_SUB} = 'hip hop' then 'hip-hop' when {_PARENT} <> 'Electronic' then null " + " ".join(f"when {_any(w)} then '{n}'" for n, w in rules.TAG_WORDS) + " end"
_BAND = "case when coalesce({b}, 0) = 0 then 'unknown-bpm' " + " ".join(f"when {{b}} >= {lo} and {{b}} < {hi} then '{n}'" for lo, hi, n in tempo.BANDS) + " else '175+' end"


@query(f"{_T} select {_FAMILY} as family, count(*) as n from t group by 1")
def genre_family_hist(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy(rules.genre_family(F.col("genre")).alias("family")).agg(F.count("*").alias("n"))


@query(f"{_T} select {_TAG} as tag, count(*) as n from t group by 1")
def genre_tag_hist(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy(rules.genre_tag(F.col("genre")).alias("tag")).agg(F.count("*").alias("n"))


@query(
    f"""{_T}, s as (select lower(genre) as g from t) select case when contains(g, 'trance') or contains(g, 'goa') then 'Trance' when contains(g, 'techno') or contains(g, 'schranz') then 'Techno'
  when contains(g, 'house') or (contains(g, 'garage') and not contains(g, 'uk')) then 'House' when contains(g, 'hip hop') or contains(g, 'rap') or contains(g, 'trap') or contains(g, 'r&b') then 'Hip Hop'
  when contains(g, 'drum n bass') or contains(g, 'jungle') or contains(g, 'halftime') or contains(g, 'neurofunk') or contains(g, 'liquid') then 'DnB'
  when contains(g, 'bassline') or contains(g, 'dubstep') or contains(g, 'grime') or contains(g, 'riddim') or contains(g, 'uk garage') or g = 'bass music' or contains(g, 'break') then 'Bass'
  when contains(g, 'ambient') or contains(g, 'downtempo') or contains(g, 'chill') or contains(g, 'experimental') or contains(g, 'idm') or contains(g, 'drone') or contains(g, 'new age') or contains(g, 'trip hop') then 'Ambient'
  when contains(g, 'hardcore') or contains(g, 'hardstyle') or contains(g, 'gabber') or contains(g, 'electro') or contains(g, 'edm') or contains(g, 'dance') or contains(g, 'dub') then 'Electro/Hard' else 'Other' end as family, count(*) as n from s group by 1"""
)
def display_family_hist(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy(rules.display_family(F.col("genre")).alias("family")).agg(F.count("*").alias("n"))


_FEEL = f"""f as (select *, {_FAMILY} as family from t), feel as (select *, case
  when family in ('hip-hop', 'halftime') then case when bpm < 118 then bpm when bpm < 236 then bpm / 2 else bpm / 4 end
  when family in ('house', 'techno', 'trance', 'psytrance', 'hardcore', 'dubstep-bass') then case when bpm >= 95 then bpm when bpm * 2 >= 95 then bpm * 2 else bpm * 4 end
  when family = 'dnb-juke' then case when bpm >= 120 then bpm when bpm * 2 >= 120 then bpm * 2 else bpm * 4 end else bpm end as feel from f)"""


def felt(spark, sf_dir):
    """Tracks with family and felt tempo, each computed once."""
    t = tracks(spark, sf_dir).withColumn("family", rules.genre_family(F.col("genre")))
    return t.withColumn("feel", tempo.feel_tempo(F.col("family"), F.col("bpm")))


@query(f"{_T}, {_FEEL} select track, family, feel from feel")
def tempo_feel_fold(spark, sf_dir):
    return felt(spark, sf_dir).select("track", "family", "feel")


@query(f"{_T} select track, case when bpm / 4 * power(2, track % 4) < 22.5 then bpm / 4 * power(2, track % 4) * 8 when bpm / 4 * power(2, track % 4) < 45 then bpm / 4 * power(2, track % 4) * 4 when bpm / 4 * power(2, track % 4) < 90 then bpm / 4 * power(2, track % 4) * 2 when bpm / 4 * power(2, track % 4) < 180 then bpm / 4 * power(2, track % 4) when bpm / 4 * power(2, track % 4) < 360 then bpm / 4 * power(2, track % 4) / 2 else bpm / 4 * power(2, track % 4) / 4 end as bpm from t")
def tempo_canonical(spark, sf_dir):
    b = F.col("bpm") / 4 * F.pow(F.lit(2.0), F.col("track") % 4)
    return tracks(spark, sf_dir).select("track", tempo.canonical_tempo(b).alias("bpm"))


@query(f"{_T}, {_FEEL} select {_BAND.format(b='feel')} as band, count(*) as n from feel group by 1")
def tempo_band_hist(spark, sf_dir):
    return felt(spark, sf_dir).groupBy(tempo.tempo_band(F.col("feel")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""{_T}, f as (select *, {_FAMILY} as family, 50 + (track * 13 % 500) / 10.0::double as second from t) select track, family, second, round_even(second * 100, 0)::int as stored
  from f where family in ('hip-hop', 'halftime') and bpm >= 118 and abs(bpm - 2 * second) / (2 * second) < 0.05::double""")
def halftime_candidates(spark, sf_dir):
    t = tracks(spark, sf_dir).select("track", "bpm", rules.genre_family(F.col("genre")).alias("family"), (50 + (F.col("track") * 13 % 500) / 10.0).alias("second"))
    return t.where(F.col("family").isin("hip-hop", "halftime") & tempo.is_half_time(F.col("bpm"), F.col("second"))).select("track", "family", "second", tempo.stored_tempo(F.col("second")).alias("stored"))


_WHEEL = "(list_position([" + ", ".join(f"'{k}'" for k in KEYS) + "], {k}) - 1)"
_NOTES = "(values " + ", ".join(f"('{n}', {p})" for n, p in harmony.PITCH.items()) + ") v(note, pc)"


@query(f"""{_T}, k as (select key, {_WHEEL.format(k='key')} // 2 + 1 as n, case when {_WHEEL.format(k='key')} % 2 = 0 then 'A' else 'B' end as l from (select distinct key from t))
  select a.key as a, b.key as b from k a, k b where a.n = b.n or (a.l = b.l and (a.n - b.n + 12) % 12 in (1, 11))""")
def key_compatibility(spark, sf_dir):
    """Which keys fit which: 24 names, so the product is 576 rows."""
    k = tracks(spark, sf_dir).select("key").distinct().select("key", harmony.wheel_number(F.col("key")).alias("n"), harmony.wheel_letter(F.col("key")).alias("l"))
    return k.alias("a").join(F.broadcast(k.alias("b")), harmony.keys_fit(F.col("a.n"), F.col("a.l"), F.col("b.n"), F.col("b.l"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


@query(f"""select note, mode, case when mode = 'major' then ((pc * 7 + 7) % 12 + 1)::varchar || 'B' else (((pc - 9) * 7 + 7 + 84) % 12 + 1)::varchar || 'A' end as code from {_NOTES}, (values ('major'), ('minor')) m(mode)""")
def key_wheel_arithmetic(spark, sf_dir):
    notes = spark.createDataFrame([(n, m) for n in harmony.PITCH for m in ("major", "minor")], "note string, mode string")
    return notes.select("note", "mode", harmony.wheel_code(F.col("note"), F.col("mode")).alias("code"))


# moods: pivoted events scaled to [0, 1] by a fixed rule
_MOODS = f"""{_LATEST}, m as (select rb_id, (max(num) filter (name = 'click')) % 1.0::double as h, (max(num) filter (name = 'error')) % 1.0::double as r, (max(num) filter (name = 'purchase')) % 1.0::double as s,
  (max(num) filter (name = 'signup')) % 1.0::double as a, (max(num) filter (name = 'view')) % 1.0::double as p, rb_id % 10 / 10.0::double as e, case when rb_id % 2 = 0 then 'minor' else 'major' end as mode from latest group by rb_id)"""


def moods(spark, sf_dir):
    w = latest_features(spark, sf_dir).groupBy("rb_id").pivot("name", EVENTS).agg(F.max("num"))
    f = [(F.col(c) % 1.0).alias(x) for c, x in zip(EVENTS, "hrsap")]
    return w.select("rb_id", *f, (F.col("rb_id") % 10 / 10.0).alias("e"), F.when(F.col("rb_id") % 2 == 0, "minor").otherwise("major").alias("mode"))


_INTENSITY = "case when coalesce(a, 0) > 0.6 then 'peak' when coalesce(a, 0) > 0.35 then 'driving' when coalesce(a, 0) > 0.15 then 'groovy' else 'warmup' end"


@query(f"{_MOODS} select rb_id, {_INTENSITY} as intensity from m")
def intensity_tag(spark, sf_dir):
    return moods(spark, sf_dir).select("rb_id", rules.intensity(F.col("a")).alias("intensity"))


_HYPNOTIC = "(a > 0.10 and a < 0.60 and h < 0.25 and r < 0.50 and s < 0.10 and p > 0.87)"
_VIBES = " union all ".join(
    f"select rb_id, '{n}' as vibe from m where {c}"
    for n, c in [
        ("happy", "h > 0.40"), ("chill", "r > 0.60"), ("dark", "s > 0.12 or (a > 0.55 and h < 0.10)"), ("listening", "p < 0.60"), ("euphoric", "h > 0.50 and e > 0.45 and p > 0.90"), ("hypnotic", _HYPNOTIC),
        ("melancholic", "(s > 0.05 and r > 0.40 and h < 0.15) or (mode = 'minor' and r > 0.55 and h < 0.10 and a < 0.30)"), ("feelgood", f"h > 0.15 and h <= 0.50 and p > 0.90 and a < 0.40 and not {_HYPNOTIC}"),
    ]
)


def vibe_rows(spark, sf_dir):
    v = rules.vibes(*[F.col(c) for c in "hrsape"], F.col("mode"))
    return moods(spark, sf_dir).select("rb_id", F.explode(v).alias("vibe"))


@query(f"{_MOODS} {_VIBES}")
def vibe_tags_exploded(spark, sf_dir):
    return vibe_rows(spark, sf_dir)


@query(f"""{_MOODS} select rb_id, coalesce(nullif(concat_ws(',', case when h > 0.40 then 'happy' end, case when r > 0.60 then 'chill' end,
  case when s > 0.12 or (a > 0.55 and coalesce(nullif(h, 0), 1) < 0.10) then 'dark' end, case when coalesce(nullif(p, 0), 1) < 0.60 then 'listening' end), ''), '—') as mood from m""")
def mood_string(spark, sf_dir):
    return moods(spark, sf_dir).select("rb_id", rules.map_mood(*[F.col(c) for c in "hrsap"]).alias("mood"))


@query(f"""{_MOODS}, plan as (select rb_id as track, 'Energy' as bank, {_INTENSITY} as tag from m union all select rb_id, 'Vibe', vibe from ({_VIBES})),
  links as (select track, bank from plan where (bank = 'Energy' and track % 3 = 0) or (bank = 'Vibe' and track % 4 = 0))
  select track, bank, tag from plan where (bank, track) not in (select (bank, track) from links)""")
def tags_fill_only(spark, sf_dir):
    energy = moods(spark, sf_dir).select(F.col("rb_id").alias("track"), F.lit("Energy").alias("bank"), rules.intensity(F.col("a")).alias("tag"))
    plan = energy.unionByName(vibe_rows(spark, sf_dir).select(F.col("rb_id").alias("track"), F.lit("Vibe").alias("bank"), F.col("vibe").alias("tag")))
    links = plan.where("(bank = 'Energy' and track % 3 = 0) or (bank = 'Vibe' and track % 4 = 0) or (bank = 'Energy' and track % 5 = 1)").withColumn("level", (F.col("bank") == "Energy") & (F.col("track") % 3 != 0))
    return tags.fill_only(plan, links, F.col("level")).select("track", "bank", "tag")


@query("""with l as (select distinct o_orderpriority as tag, o_custkey as track from orders), old as (select * from l where track % 3 = 0)
  select tag, track, row_number() over (partition by tag order by track) + (select count(*) from old where old.tag = l.tag) as track_no from l where track % 3 <> 0""")
def tag_link_numbering(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("track")).distinct()
    return tags.number_links(links, links.where("track % 3 = 0"))


@query("""with p as (select p_partkey as track, case when p_partkey % 3 = 0 then '#house-deep nice' when p_partkey % 3 = 1 then '  ' else p_name end as c, list_sort(list_distinct(['#house', '#' || lower(split_part(p_type, ' ', 1)), '#peak'])) as tags from part),
  m as (select track, c, list_filter(tags, lambda t: not contains(c, t)) as missing from p)
  select track, case when len(missing) = 0 then c else trim(rtrim(c) || ' ' || array_to_string(missing, ' ')) end as comment from m""")
def comment_hashtag_mirror(spark, sf_dir):
    k = F.col("p_partkey")
    c = F.when(k % 3 == 0, "#house-deep nice").when(k % 3 == 1, "  ").otherwise(F.col("p_name"))
    names = F.array_distinct(F.array(F.lit("house"), F.lower(F.substring_index("p_type", " ", 1)), F.lit("peak")))
    return table(spark, sf_dir, "part").select(k.alias("track"), text.with_hashtags(c, names).alias("comment"))


@query("""select l_suppkey as playlist, l_partkey as track, pos as position, row_number() over (partition by l_suppkey order by pos, l_partkey) as n
  from (select l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) as pos from lineitem group by all)""")
def playlist_ordered_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("playlist"), F.col("l_partkey").alias("track"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return tags.first_occurrences(li, "playlist", "track", "position")


@query("""with l as (select distinct o_orderpriority as tag, o_custkey as track from orders), m as (select case when tag = '5-LOW' then '4-NOT SPECIFIED' when tag = '2-HIGH' then '1-URGENT' else tag end as tag, track, tag as was from l),
  k as (select *, row_number() over (partition by tag, track order by (was <> tag)::int, was) as rn from m)
  select tag, count(*) as links, count_if(rn > 1) as deleted from k group by tag""")
def bank_consolidate_repoint(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("track")).distinct()
    bank = links.select(F.col("tag").alias("id")).distinct().select("id", F.lit("root").alias("parent"), F.col("id").alias("name"), F.lit(1).alias("seq"))
    moves = spark.createDataFrame([("5-LOW", None, None, None, "4-NOT SPECIFIED"), ("2-HIGH", None, None, None, "1-URGENT"), ("3-MEDIUM", "bank", "mid", 7, None)], "id string, to_parent string, to_name string, to_seq int, merge_into string")
    _, out = tags.consolidate(bank, links, moves)
    return out.groupBy("tag").agg(F.count("*").alias("links"), F.count_if(F.col("deleted") == 1).alias("deleted"))


@query("""select distinct o_orderpriority as id, case when o_orderpriority = '3-MEDIUM' then 'bank' else 'root' end as parent, case when o_orderpriority = '3-MEDIUM' then 'mid' else o_orderpriority end as name,
  case when o_orderpriority = '3-MEDIUM' then 7 else 1 end as seq, (o_orderpriority in ('5-LOW', '2-HIGH'))::int as deleted from orders""")
def bank_overlay(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("track")).distinct()
    bank = links.select(F.col("tag").alias("id")).distinct().select("id", F.lit("root").alias("parent"), F.col("id").alias("name"), F.lit(1).alias("seq"))
    moves = spark.createDataFrame([("5-LOW", None, None, None, "4-NOT SPECIFIED"), ("2-HIGH", None, None, None, "1-URGENT"), ("3-MEDIUM", "bank", "mid", 7, None)], "id string, to_parent string, to_name string, to_seq int, merge_into string")
    return tags.consolidate(bank, links, moves)[0]


@query("""with s as (select l_orderkey // 4 as g, list_sort(list_distinct(list(l_partkey % 40))) as items from lineitem group by 1) select a.g as a, b.g as b from s a join s b on a.items = b.items and a.g < b.g""")
def playlist_duplicate_proof(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).cast("long").alias("g"), (F.col("l_partkey") % 40).alias("item"))
    return tags.equal_sets(li, "g", "item")


def _bands(spark, sf_dir):
    # the filter names a stored column: one on the band would be pushed down with the whole fold inside
    rows = felt(spark, sf_dir).where("bpm <> 0").select(F.col("kind").alias("folder"), tempo.tempo_band(F.col("feel")).alias("band"))
    place = F.array_position(F.array(*[F.lit(n) for _, _, n in tempo.BANDS]), F.col("band"))
    return rows.groupBy("folder", "band").agg(F.count("*").alias("n")).withColumn("position", place)


_BAND_PLACE = "list_position([" + ", ".join(f"'{n}'" for _, _, n in tempo.BANDS) + "], band)"


@query(
    f"""with recursive t as ({TRACKS_SQL}), {_FEEL}, b as (select kind as folder, {_BAND.format(b='feel')} as band from feel), c as (select folder, band, {_BAND_PLACE} as position, count(*) as n from b where band <> 'unknown-bpm' group by all),
  o as (select *, row_number() over (partition by folder order by position) as rn from c),
  w(folder, band, rn, leaf, held) as (select folder, band, rn, 1, case when n >= 8 then 0 else n end from o where rn = 1
    union all select o.folder, o.band, o.rn, case when w.held = 0 then w.leaf + 1 else w.leaf end, case when w.held + o.n >= 8 then 0 else w.held + o.n end from w join o on o.folder = w.folder and o.rn = w.rn + 1),
  last as (select folder, greatest(1, arg_max(case when held > 0 then leaf - 1 else leaf end, rn)) as m from w group by folder)
  select folder, band, least(leaf, m)::int as leaf from w join last using (folder)"""
)
def tempo_leaves(spark, sf_dir):
    return clusters.band_leaves(_bands(spark, sf_dir))


_SEG = "with recursive"


@query(
    f"""{_SEG} t as ({TRACKS_SQL}), o as (select kind as folder, track, bpm, row_number() over (partition by kind order by bpm, track) as rn from t where bpm is not null),
  w(folder, track, rn, leaf, lo, total, n) as (select folder, track, rn, 0, bpm, bpm, 1 from o where rn = 1
    union all select o.folder, o.track, o.rn,
      case when ((w.total + o.bpm) / (w.n + 1) - w.lo) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double or (o.bpm - (w.total + o.bpm) / (w.n + 1)) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double then w.leaf + 1 else w.leaf end,
      case when ((w.total + o.bpm) / (w.n + 1) - w.lo) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double or (o.bpm - (w.total + o.bpm) / (w.n + 1)) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double then o.bpm else w.lo end,
      case when ((w.total + o.bpm) / (w.n + 1) - w.lo) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double or (o.bpm - (w.total + o.bpm) / (w.n + 1)) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double then o.bpm else w.total + o.bpm end,
      case when ((w.total + o.bpm) / (w.n + 1) - w.lo) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double or (o.bpm - (w.total + o.bpm) / (w.n + 1)) / ((w.total + o.bpm) / (w.n + 1)) > 0.08::double then 1 else w.n + 1 end
    from w join o on o.folder = w.folder and o.rn = w.rn + 1)
  select folder, track, leaf::int as leaf from w union all select kind, track, null from t where bpm is null"""
)
def tempo_segments_8pct(spark, sf_dir):
    t = tracks(spark, sf_dir).select(F.col("kind").alias("folder"), "track", "bpm")
    return clusters.tempo_segments(t).select("folder", "track", "leaf")


@query(f"""{_T} select kind, min(bpm) as lo, max(bpm) as hi, count(bpm) as n from t group by kind""")
def leaf_spans(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("kind").agg(F.min("bpm").alias("lo"), F.max("bpm").alias("hi"), F.count("bpm").alias("n"))


@query(f"""{_T}, n as (select track, kind, round(bpm / 10)::int || 'bpm' as name from t where bpm is not null), r as (select *, row_number() over (partition by kind, name order by track) as rn from n)
  select track, kind, case when rn = 1 then name else name || '-' || rn end as name from r""")
def name_suffixing(spark, sf_dir):
    t = tracks(spark, sf_dir).where("bpm is not null").select("track", "kind", F.concat(F.round(F.col("bpm") / 10).cast("int").cast("string"), F.lit("bpm")).alias("name"))
    return tags.suffix_repeats(t, ["kind"], "name", ["track"])


@query(f"""{_T} select {_FAMILY} as family, genre, count(*) as n, row_number() over (partition by {_FAMILY} order by count(*) desc, genre) as place from t group by 1, 2""")
def facet_counts(spark, sf_dir):
    """Counts by family and genre with the genre's rank in its family, which picks its shade."""
    from pyspark.sql import Window as W

    n = tracks(spark, sf_dir).groupBy(rules.genre_family(F.col("genre")).alias("family"), "genre").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(F.col("n").desc(), "genre")).cast("long"))

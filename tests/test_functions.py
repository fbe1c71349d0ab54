import math

import pytest
from pyspark.sql import functions as F

from tonearm.functions import harmony, rules, tempo, text


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def feel(family, b):
    if not b:
        return None
    floor = {"dnb-juke": 120}.get(family, 95)
    if family in ("hip-hop", "halftime"):
        while b >= 118:
            b /= 2
    elif family != "other":
        while b < floor:
            b *= 2
    return b


EDGES = [0.0, None, 1e-5, 29.9, 47.0, 59.0, 89.99, 90.0, 94.99, 95.0, 117.99, 118.0, 179.99, 180.0, 236.0, 999.0]


@pytest.mark.parametrize("family", ["hip-hop", "halftime", "house", "dnb-juke", "other"])
def test_feel_tempo(spark, family):
    assert column(spark, EDGES, "double", lambda x: tempo.feel_tempo(F.lit(family), x)) == [feel(family, b) for b in EDGES]


def test_canonical_tempo(spark):
    got = column(spark, EDGES, "double", tempo.canonical_tempo)
    assert [g is None for g in got] == [not b for b in EDGES]
    assert all(90 <= g < 180 and math.log2(g / b) == round(math.log2(g / b)) for g, b in zip(got, EDGES) if b)


def test_bands(spark):
    cuts = [0.0, None, 74.99, 75.0, 85.0, 95.0, 110.0, 122.0, 128.0, 135.0, 145.0, 160.0, 175.0, 999.0, 2000.0]
    want = ["unknown-bpm"] * 2 + ["<75", "75-85", "85-95", "95-110", "110-122", "122-128", "128-135", "135-145", "145-160", "160-175", "175+", "175+", "175+"]
    assert column(spark, cuts, "double", tempo.tempo_band) == want


def test_tempo_fit_is_directed_and_null_safe(spark):
    rows = spark.createDataFrame([(108.0, 100.0), (100.0, 108.0), (200.0, 100.0), (50.0, 100.0), (None, 1.0), (0.0, 0.0), (float("nan"), 100.0), (109.0, 100.0)], "a double, b double")
    assert [r.y for r in rows.select(tempo.tempo_fits(F.col("a"), F.col("b"), 0.08).alias("y")).collect()] == [True, True, True, True, False, False, False, False]


def test_stored_tempo_rounds_half_to_even(spark):
    assert column(spark, [87.125, 87.135, 1.005], "double", tempo.stored_tempo) == [8712, round(87.135 * 100), 100]


def test_keys(spark):
    pairs = [("C", "G", True), ("C", "Am", True), ("E", "B", True), ("C", "D", False), ("C", "Em", False), ("?", "?", False), (None, "C", False), ("Abm", "Dbm", True)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    n, letter = harmony.wheel_number, harmony.wheel_letter
    got = rows.select(harmony.keys_fit(n(F.col("a")), letter(F.col("a")), n(F.col("b")), letter(F.col("b"))).alias("y")).collect()
    assert [r.y for r in got] == [w for _, _, w in pairs]
    assert column(spark, ["C", "A", "F#", "x"], "string", lambda x: harmony.wheel_code(x, F.lit("major"))) == ["8B", "11B", "2B", None]
    assert column(spark, ["A", "E"], "string", lambda x: harmony.wheel_code(x, F.lit("minor"))) == ["8A", "9A"]


def test_titles(spark):
    titles = ["Deep (Original Mix)", "Deep [KAT012] feat. Someone", " - Deep - ", None, "A (x) B", "Left [ABC 99]"]
    assert column(spark, titles, "string", text.clean_title) == ["Deep", "Deep", "Deep", "", "A B", "Left"]
    assert column(spark, titles, "string", text.catalogue_number) == [None, "KAT012", None, None, None, None]
    assert column(spark, ["Ab_C!", None, "--"], "string", text.slug) == ["ab-c", "x", "x"]
    assert column(spark, ["/a/b.c.mp3", "x"], "string", text.base_name) == ["b.c", "x"]
    assert column(spark, ["file:///a%20b+c.mp3", "/plain"], "string", text.file_path) == ["/a b+c.mp3", "/plain"]
    assert column(spark, ["r&b soul", None], "string", text.title_case) == ["R&B Soul", None]
    assert column(spark, ["2001-05", "20x1", None], "string", text.year_prefix) == [2001, None, None]


def test_junk(spark):
    rows = spark.createDataFrame([(60, None, "KICK_01"), (5, "Loopmasters", "x"), (5, "Me", "KICK_01"), (5, "Me", "KICK 01"), (None, None, "a")], "n int, a string, t string")
    assert [r.y for r in rows.select(text.is_junk(F.col("n"), F.col("a"), F.col("t")).alias("y")).collect()] == [False, True, True, False, True]


def test_match_confidence(spark):
    rows = spark.createDataFrame([("a b", "a b", "zz", False), ("abc", "xyz", "", True), ("abcd", "abcx", "abcx", False)], "q string, t string, a string, same boolean")
    got = rows.select(text.match_confidence(F.col("q"), F.col("t"), F.col("same"), F.col("a")).alias("y")).collect()
    assert [round(r.y, 4) for r in got] == [1.0, 0.95, 0.9]


def test_hashtags(spark):
    rows = spark.createDataFrame([("#house-deep", ["house", "peak"]), (None, ["b", "a"]), ("x", [])], "c string, t array<string>")
    assert [r.y for r in rows.select(text.with_hashtags(F.col("c"), F.col("t")).alias("y")).collect()] == ["#house-deep #peak", "#a #b", "x"]


def test_genres(spark):
    full = ["Electronic---Goa Trance", "Electronic---Halftime", "Hip Hop---Trap", "Rock---House", None, "Electronic---Disco House", "Electronic", "Electronic---Hip Hop"]
    assert column(spark, full, "string", rules.genre_family) == ["psytrance", "halftime", "hip-hop", "other", "other", "house", "other", "hip-hop"]
    assert column(spark, full, "string", rules.genre_tag) == ["psy", "bass", "hip-hop", None, None, "disco", None, "hip-hop"]
    assert column(spark, ["UK Garage", "Garage", "Trap", "Break", None], "string", rules.display_family) == ["Bass", "House", "Hip Hop", "Other", "Other"]


def test_vibes(spark):
    rows = spark.createDataFrame(
        [(0.2, 0.1, 0.0, 0.3, 0.95, 0.0, None), (0.3, 0.1, 0.0, 0.3, 0.95, 0.0, None), (0.0, 0.6, 0.0, 0.1, 0.9, 0.0, "minor"), (None,) * 7],
        "h double, r double, s double, a double, p double, e double, m string",
    )
    got = [r.y for r in rows.select(rules.vibes(*[F.col(c) for c in "hrsape"], F.col("m")).alias("y")).collect()]
    assert got == [["hypnotic"], ["feelgood"], ["melancholic"], ["listening"]]
    zero = spark.createDataFrame([(0.0, 0.0, 0.0, 0.6, 0.0)], "h double, r double, s double, a double, p double")
    assert zero.select(rules.map_mood(*[F.col(c) for c in "hrsap"]).alias("y")).first().y == "—"
    assert column(spark, [None, 0.15, 0.35, 0.60, 0.61], "double", rules.intensity) == ["warmup", "warmup", "groovy", "driving", "peak"]


def test_folds_of_any_tempo(spark):
    rows = [(1e-300,), (1e-9,), (47.0,), (94.99,), (95.0,), (118.0,), (1e300,), (float("inf"),), (0.0,), (None,), (-5.0,)]
    got = [(r.b, r.up, r.down) for r in spark.createDataFrame(rows, "b double").select("b", tempo._double_below(F.col("b"), 95.0).alias("up"), tempo._halve_from(F.col("b"), 118.0).alias("down")).collect()]
    for b, up, down in got:
        if b is None or b <= 0 or b == float("inf"):
            assert up is None or b == float("inf")
            continue
        want = b
        while want < 95:
            want *= 2
        assert up == want
        want = b
        while want >= 118:
            want /= 2
        assert down == want

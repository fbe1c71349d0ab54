"""Lookups with an offline service that writes down every call and pause."""

import json
import os

import pytest

from tonearm.sources import lookup
from tonearm.sources.registry import Throttled


class Service:
    """Answers from a dictionary; each call is a line of a file, since it runs in workers."""

    def __init__(self, folder, answers, closed=()):
        self.file, self.answers, self.closed = str(folder / "calls"), answers, closed

    def __call__(self, key):
        with open(self.file, "a") as f:
            f.write(key + "\n")
        if any(key.startswith(c) for c in self.closed):
            raise lookup.Rejected(403)
        return self.answers.get(key, {"results": [], "items": []})

    def calls(self):
        if not os.path.exists(self.file):
            return []
        with open(self.file) as f:
            out = f.read().splitlines()
        os.remove(self.file)
        return out


class Quick(lookup.Pace):
    """A pace that waits for nothing."""

    def __init__(self, rate):
        super().__init__(rate, lambda: 0.0, lambda s: None)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "k string, v string")


def test_pace_spaces_calls_and_throttling_waits_longer(tmp_path):
    now, slept = [100.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    pace = lookup.Pace(0.5, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [2.0, 2.0]
    now[0] += 10
    pace.wait()
    assert slept == [2.0, 2.0]
    tries = []

    def call(key):
        tries.append(key)
        if len(tries) < 3:
            raise Throttled(None if len(tries) == 2 else 7)
        return {"ok": 1}

    slept.clear()
    now[0] += 10
    assert lookup.answer(call, "x", pace) == {"ok": 1} and slept == [7, 6.0]
    assert lookup.answer(lambda k: (_ for _ in ()).throw(Throttled(0)), "x", pace, 2) == {"error": "retries exhausted"}
    assert lookup.answer(lambda k: (_ for _ in ()).throw(OSError("down")), "x", pace) == {"error": "down"}
    assert lookup.answer(lambda k: (_ for _ in ()).throw(lookup.Rejected(404)), "x", pace) == {"error": "HTTP 404", "status": 404}


def test_lanes_share_one_rate(spark, nothing, tmp_path):
    rates = str(tmp_path / "rates")

    class Noted(Quick):
        def __init__(self, rate):
            super().__init__(rate)
            with open(rates, "a") as f:
                f.write(f"{rate}\n")

    service = Service(tmp_path, {})
    asked = spark.createDataFrame([(f"k{i % 30}",) for i in range(90)] + [(None,)], "k string").repartition(7)
    got = lookup.ask(asked, nothing, service, rate=3.0, lanes=4, pace=Noted)
    assert got.count() == 30 == got.count() and sorted(service.calls()) == sorted(f"k{i}" for i in range(30))
    with open(rates) as f:
        used = [float(x) for x in f]
    assert set(used) == {0.75} and len(used) <= 4
    again = lookup.ask(asked, got, service, pace=Noted)
    assert again.count() == 30 and service.calls() == []


def test_release_steps_ask_only_what_is_open(spark, nothing, tmp_path):
    key = lambda **p: json.dumps(p, separators=(",", ":"))
    hit = lambda i, title, **more: {"id": i, "title": title, **more}
    service = Service(
        tmp_path,
        {
            key(catno="ABC123"): {"results": [hit(1, "Other - Thing"), hit(2, "Unlike", catno="abc123", label=["L", "M"], style=["Goa"], year="1999")]},
            key(artist="Ann", track="Song"): {"results": [hit(3, "Ann - Song", genre=["House"])]},
            key(q="Bob Tune"): {"results": [hit(n, f"Bob - Tune {n}") for n in range(10, 20)]},
        },
    )
    tracks = spark.createDataFrame([("t1", "Zed", "Name [ABC123]"), ("t2", "Ann", "Song (Extended Mix)"), ("t3", "Bob", "Tune"), ("t4", "None", "Lost"), ("t5", "Ann", "Song"), ("t6", None, None)], "rb_id string, artist string, title string")
    found, cache = lookup.find_releases(tracks, nothing, service, pace=Quick)
    got = {r.rb_id: r for r in found.collect()}
    assert {k: (r.matched, r.release_id) for k, r in got.items()} == {"t1": (1, 2), "t2": (1, 3), "t3": (1, 10), "t4": (0, None), "t5": (1, 3), "t6": (0, None)}
    assert (got["t1"].confidence, got["t1"].label, got["t1"].style, got["t1"].year) == (0.95, "L", "Goa", "1999")
    assert got["t2"].genre == "House" and got["t2"].confidence == 1.0 and got["t4"].confidence == 0
    calls = service.calls()
    # one search by number, one for both versions of Ann's song, no later step for what was found
    assert len(calls) == len(set(calls)) == 1 + 4 + 3
    assert key(catno="ABC123") in calls and key(q="Ann Song") not in calls and key(artist="Zed", track="Name") not in calls
    more, _ = lookup.find_releases(tracks, cache, service, pace=Quick)
    assert more.count() == 6 and service.calls() == []


@pytest.mark.parametrize("closed", [(), ("features:",)])
def test_recordings_and_a_closed_endpoint(spark, nothing, tmp_path, closed):
    items = lambda n: {"items": [{"id": f"r{n}", "release_date": f"200{n}-01", "artist": f"a{n % 2}"}]}
    service = Service(tmp_path, {**{f"isrc:I{n}": items(n) for n in range(6)}, "artist:a0": {"genres": ["goa trance"]}, "artist:a1": {}, **{f"features:r{n}": {"energy": n / 10, "tempo": 120 + n, "mode": 1} for n in range(6)}}, closed)
    tracks = spark.createDataFrame([(f"t{n}", f"I{n}") for n in range(6)] + [("t8", "I8"), ("t9", None), ("t10", "")], "rb_id string, isrc string")
    found, cache = lookup.find_recordings(tracks, nothing, service, pace=Quick)
    got = {r.rb_id: r for r in found.collect()}
    assert sorted(got) == sorted([f"t{n}" for n in range(6)] + ["t8"]) and (got["t8"].matched, got["t8"].track_id) == (0, None)
    assert [got[f"t{n}"].artist_genres for n in (0, 1)] == ['["goa trance"]', "[]"]
    assert got["t3"].energy == (None if closed else 0.3) and got["t3"].release_date == "2003-01"
    calls = service.calls()
    assert sum(c.startswith("features:") for c in calls) == (1 if closed else 6) and len(calls) == 7 + 2 + (1 if closed else 6)
    # later tracks: the closed endpoint stays closed
    later = spark.createDataFrame([("t0", "I0"), ("n", "I8")], "rb_id string, isrc string")
    service.answers["isrc:I7"] = items(7)
    new = spark.createDataFrame([("t7", "I7")], "rb_id string, isrc string").unionByName(later)
    lookup.find_recordings(new, cache, service, pace=Quick)[0].collect()
    assert sorted(service.calls()) == (["isrc:I7"] if closed else ["features:r7", "isrc:I7"])

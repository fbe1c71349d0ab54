from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonearm.llm import chat, exact_dedup, url_filter


def test_chat_merges_and_reads_back(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, 4, "assistant", "x</turn>\n### user: y"), (None, 1, None, "n"), (2, 1, "a: \\b\n", "\\l\\\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert got[1].formatted.count("### ") == 2
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("user", "b"), ("assistant", ""), ("assistant", "x</turn>\n### user: y")]
    assert got[1].loss == "x</turn>\n### user: y"
    assert [tuple(t) for t in got[None].turns] == [("", "n")]
    assert [tuple(t) for t in got[2].turns] == [("a: \\b\n", "\\l\\\\")]
    assert chat.format_chats(turns.limit(0)).collect() == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab:\\#</turn>\n ", max_size=6), st.text("\\#<bhl/turn>\n: ", max_size=20)), min_size=1, max_size=8))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(0, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [tuple(t) for t in chat.read_chats(chat.format_chats(df)).first().turns] == turns


def test_exact_dedup_cases(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "c")] + [(100 + i, "hot") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(3)
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.add_batch(index, docs)
    got = exact_dedup.memberships(index, docs).collect()
    assert len(got) == len(rows)
    by = {r.key: r for r in got}
    assert (by[1].keep_id, by[1].kept, by[2].kept, by[3].keep_id, by[4].group_size) == (2, False, True, 4, 2)
    assert by[120].keep_id == 149 and by[149].kept and by[120].group_size == 50
    assert sum(r.kept for r in got if r.key == 5) == 1 and sum(r.kept for r in got if r.key is None) == 1
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "c"), (2, "a"), (4, ""), (5, "b"), (149, "hot")]
    later = spark.createDataFrame([(900, "a"), (901, "new"), (902, "new")], "doc_id long, text string")
    assert [r.keep_id for r in exact_dedup.add_batch(index, later).collect()] == [902]
    assert len(exact_dedup.DigestIndex(spark, index.name, index.location).generations) == 2
    assert exact_dedup.keep_first_copies(docs.limit(0)).collect() == []
    index.drop()


def brute_rule(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h), v == "block")
            best = max(best or (rank, h + p, v), (rank, h + p, v))
    return host, path, best and best[1], best[2] if best else default


def test_url_rules_against_brute_force(spark):
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "xa.com", "a.org", "-a.com", "a.com:80", "A.COM", "", "..", "é.com"]
    paths = ["", "/", "/x", "/x/y", "/en/1", "?q=/x", "#/x", "/x?b#c", "/\n/x"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "a.com/x", "x://", "http://a.com://b"] + ["http://hot.a.com/x/%d" % i for i in range(400)]
    rules = [("com", "", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/", "allow"), ("a.com", "/x/y", "allow"), ("a.com", "/x/y", "block"), ("a.com", "/", "allow"), ("org", "/e", "block"), (None, "/", "block"), ("b.a.com", None, "allow"), ("c.b.a.com", "/", "block")]
    pages = spark.createDataFrame([(None if i == 3 else 2**60 + i, u, i) for i, u in enumerate(urls)], "page_id long, url string, verdict int").repartition(4)
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    clean = [(h, p or "", v) for h, p, v in rules if h is not None]
    want = {(None if i == 3 else 2**60 + i): brute_rule(u, clean) for i, u in enumerate(urls)}
    assert len(got) == len(urls)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.filter_urls(pages, none, default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), none).collect() == []

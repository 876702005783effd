"""Retrieval on a small catalogue, and the component around it."""

from __future__ import annotations

import json

import pytest
from lodestar.operators import index, lexical, rank, retrieve, vector
from lodestar.plans import api, engine
from pyspark.sql import functions as F

APPS = [
    (1, "地图", "di tu", "maps", "dt", "travel", ["navigation", "road"], 50, True),
    (2, "Mail Box", "", "mail box", "mb", "office", ["letters"], 0, False),
    (3, "Map Maker", "", "map maker", "mm", "travel", ["drawing"], 3, True),
    (4, "Notes", "", "notes", "n", "office", ["writing"], 100, True),
    (5, "Photo Note", "", "photo note", "pn", "media", None, 0, False),
]
KIND = "app_id long, name string, py string, en string, abbr string, cat string, tags array<string>, uses long, installed boolean"


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame(APPS, KIND)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


def names(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.app_id)
    return out


def test_first_tier_with_hits_wins(spark, apps):
    got = retrieve.tiered_search(ask(spark, "notes", "map", "ntes", "zzzz", "地图", "dt"), apps)
    by = names(got)
    assert by[0] == [4] and set(by[1]) == {1, 3} and by[2][0] == 4 and by[4] == [1] and by[5] == [1] and 3 not in by
    tiers = {r.query_id: r.tier for r in got.collect()}
    assert (tiers[0], tiers[1], tiers[2]) == (0, 1, 2)
    score = {(r.query_id, r.app_id): r.score for r in got.collect()}
    assert score[0, 4] == 1000 + 80 + 60 and score[1, 3] == 800 + 6 + 60


def test_union_counts_the_best_kind_of_match(spark, apps):
    q = ask(spark, "map")
    meta = spark.createDataFrame([(0, 4), (0, 4)], "query_id long, app_id long")
    got = {r.app_id: r for r in retrieve.union_pipeline(q, apps, meta).collect()}
    plain = {r.app_id: r.score for r in retrieve.union_fuzzy(q, apps).collect()}
    assert got[3].score == plain[3] and got[3].source == "fuzzy" and not got[3].is_extra
    assert [r.rank for r in sorted(got.values(), key=lambda r: -r.score)] == list(range(1, len(got) + 1))


def test_unknown_and_blocked(spark):
    hits = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "query string, app string")
    flags = spark.createDataFrame([("a", "x", None), ("b", "x", "2020-01-01")], "query string, app string, e string").select("query", "app", F.to_timestamp("e").alias("expire_ts"))
    left = retrieve.without_blocked(hits, flags, F.lit("2024-01-01").cast("timestamp"))
    assert {tuple(r) for r in left.collect()} == {("a", "y"), ("b", "x")}


def test_bm25_order_and_edges(spark):
    docs = spark.createDataFrame([("a", "red red red ring"), ("b", "red ring"), ("c", "blue"), ("", "red"), ("d", None)], "doc_id string, text string")
    q = spark.createDataFrame([(0, "red"), (1, "green"), (2, "")], "query_id long, q string")
    got = lexical.bm25(docs, q, k=5).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0} and got[0][1] in ("a", "") and [r.rank for r in got] == list(range(1, len(got) + 1))


def test_knn(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    got = {(r.query_id, r.rank): (r.id, r.score) for r in vector.knn(v, asked, k=2).collect()}
    assert got[1, 1] == (1, pytest.approx(1)) and got[1, 2] == (3, pytest.approx(0.5**0.5)) and got[4, 1] == (1, 0.0)
    dup = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 2.0], 2), ("", [1.0, 1.0], 3), ("b", None, 4)], "id string, v array<float>, seq long")
    kept = {r.id: list(r.v) for r in vector.load(dup).collect()}
    assert kept == {"a": [0.0, 1.0]}


def test_rerank_puts_exact_first_and_caps(spark):
    c = spark.createDataFrame([("a", "Alpha", 0.9, 0, 0.15, 0.2, 0.2), ("b", "Beta", 0.2, 1, 0.0, 0.0, 0.0), ("c", "Gamma", 0.9, 2, 0.0, 0.0, 0.0)], "pkg string, name string, score double, ordinal int, b_heatmap double, b_hourly double, b_feedback double")
    got = {r.pkg: r for r in rank.rerank(c, " beta ").collect()}
    assert [got[p].rank for p in "bac"] == [1, 2, 3] and got["a"].boost == 0.5 and got["b"].mode == "exact-match" and "heatmap +0.150" in got["a"].explanation
    whole = {r.pkg: r.final for r in rank.rerank(c.withColumn("score", F.col("score") * 100), "x", "relative").collect()}
    assert whole["a"] == pytest.approx(90 + 27) and whole["c"] == 90


def test_index_updates(spark, apps):
    t = index.trie(apps)
    less = index.trie_remove(t, spark.createDataFrame([(4,)], "app_id long"))
    assert less.where("app_id = 4").count() == 0 and t.where("app_id = 4").count() > 0
    back = index.trie_insert(less, apps.where("app_id = 4"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    known = index.fingerprint(apps).head()[0]
    assert index.fingerprint(apps.repartition(3)).head()[0] == known and index.fingerprint(apps.where("app_id < 5")).head()[0] != known


def test_component(spark, apps):
    clock = [0.0]
    plugins = api.Plugins()
    plugins.register({"name": "p", "version": "1"}, {"after_search": lambda df: df.where("app_id <> 5"), "before_search": lambda df: 1 / 0})
    with pytest.raises(ValueError, match="unknown"):
        plugins.register({"name": "p", "version": "1"}, {"nope": print})
    with pytest.raises(ValueError, match="lacks"):
        plugins.register({"name": "p"}, {})
    s = api.Search(spark, apps, plugins=plugins, clock=lambda: clock[0])
    heard = []
    off = s.bus.on("query", heard.append)
    r = s.query("notes", 5)
    assert r.ok and r.mode == "exact" and [i["app_id"] for i in r.items] == [4] and heard == [r] and plugins.errors
    assert s.query("notes", 5) is r
    clock[0] = 301
    off()
    assert s.query("notes", 5) is not r and len(heard) == 1
    bad = s.query("!")
    assert not bad.ok and bad.error["code"] == "INVALID_QUERY" and json.loads(bad.as_json())["error"]["message"] == "too_short"
    assert json.loads(r.as_json())["data"]["total"] == 1 and r.as_compact().startswith("4:") and r.as_text().startswith("1. Notes") and bad.as_text() == "error: INVALID_QUERY"
    s.set_apps(apps.where("app_id <> 4"))
    assert s.query("notes", 5).mode != "exact"
    assert [api.clamp_limit(x) for x in (None, 0, 5, 1000)] == [12, 1, 5, 100]


def test_stale_snapshots_are_not_used():
    now = [0.0]
    s = api.Snapshot(30, lambda: now[0])
    assert s.get() is None
    s.put({"affinity": 1})
    now[0] = 30
    assert s.get() == {"affinity": 1}
    now[0] = 31
    assert s.get() is None


def test_tree_finds_subsequences_that_begin_inside(spark):
    words = spark.createDataFrame([("english", "gear", 1), ("english", "widget", 2), ("syllables", "hongse", 3), ("english", "ring", 4), ("english", "ear", 5)], "tree string, word string, app_id long")
    found = index.tree_search(words, ask(spark, "idget", "ng", "oge", "ear", "er", "zz"))
    got = {(r.query_id, r.stage, r.app_id) for r in found.collect()}
    ids = {r.q: r.query_id for r in ask(spark, "idget", "ng", "oge", "ear", "er", "zz").collect()}
    assert got == {(ids["idget"], 4, 2), (ids["ng"], 4, 4), (ids["oge"], 5, 3), (ids["ear"], 1, 5), (ids["er"], 4, 1), (ids["er"], 4, 5)}


def places(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, app_id long, place int")


def test_the_whole_search_by_its_flags(spark, apps):
    q = ask(spark, "notes", "qq", "box", "nots", "\u5730\u56fe")
    meta = spark.createDataFrame([(0, 5, 40), (0, 4, 99), (2, 1, 30)], "query_id long, app_id long, score long")
    some, blocked = places(spark, (1, 1, 0), (1, 2, 9), (1, 3, 1), (0, 3, 0)), places(spark, (1, 3, 0))
    recall = places(spark, (1, 4, 0), (1, 5, 9), (2, 5, 0))
    boosts = spark.createDataFrame([(0, 5, 0.25), (2, 1, 9.0)], "query_id long, app_id long, boost double")
    shortcuts = spark.createDataFrame([("Nots", 3, 0), ("nots", 2, 1), ("notes", 1, 0)], "key string, app_id long, place int")
    tables = {"meta": meta, "suggestions": some, "blocked": blocked, "recall": recall, "boosts": boosts, "shortcuts": shortcuts}

    def run(**flags):
        base = {"fuzzy": False, "tree": False, "meta": False, "sim_int": False, "rag": False, "rerank": False}
        out = {}
        for r in engine.search(q, apps, engine.Flags(**(base | flags)), **tables).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.app_id, r.score))
        return out

    plain = {0: [(4, 1140)], 4: [(1, 1140)]}
    assert run() == plain
    assert run(rag=True) == plain | {1: [(4, 50), (5, 20)], 2: [(5, 50)]}
    assert run(sim_int=True, rag=True) == plain | {1: [(1, 60), (2, 24)], 2: [(5, 50)]}  # 3 is blocked, and 0 has hits
    assert run(meta=True, rerank=True) == {0: [(4, 1140), (5, 46)], 2: [(1, 39)], 4: [(1, 1140)]}  # 0.25 of 0.5, and all of it
    assert run(tree=True) == plain | {3: [(3, 1000), (2, 990)]}
    fuzzy = run(fuzzy=True)
    assert fuzzy[0] == plain[0] and fuzzy[3][0][0] == 4 and 2 in [a for a, _ in fuzzy[2]]
    digits = ask(spark, "6245")
    on, off = ({r.app_id for r in engine.search(digits, apps, engine.Flags(t9=x)).collect()} for x in (True, False))
    assert on > off  # Mail Box
    rows = spark.createDataFrame([("ab", [0.5]), ("a", [0.5]), ("ab", [0.9])], "query string, factors array<double>")
    wait = lambda **f: [r.delay for r in engine.delays(rows, engine.Flags(**f)).collect()]
    assert wait(sim_int=True) == [80, 0, 0] and wait() == [0, 0, 0] and wait(sim_int=True, refresh=False) == [0, 0, 0]


def test_indexes_age(spark):
    now = F.lit("2024-03-31").cast("timestamp")
    rows = spark.createDataFrame([("a", "2024-03-01"), ("b", "2024-03-10"), ("c", None)], "name string, t string").select("name", F.to_timestamp("t").alias("built_at"))
    due = lambda flags: {r.name for r in engine.rebuild_due(rows, now, flags).where("due").collect()}
    assert due(engine.Flags()) == {"a", "c"} and due(engine.Flags(rebuild=False)) == set()
    states = spark.createDataFrame([("a", "2024-03-21", False), ("b", "2024-02-01", False), ("c", "2024-03-21", True)], "name string, t string, finalized boolean").select("name", F.to_timestamp("t").alias("started_at"), "finalized")
    on = {r.name: list(r.paths) for r in engine.index_weights(states, now, engine.Flags()).collect()}
    assert on["a"] == ["previous", "current"] and on["b"] == ["current"] == on["c"]
    assert all(r.weight == 0 and r.paths == ["current"] for r in engine.index_weights(states, now, engine.Flags(transition=False)).collect())


def test_selections_reach_the_plugins_and_the_affinities(spark, apps):
    seen = []
    plugins = api.Plugins()
    plugins.register({"name": "p", "version": "1"}, {"on_feedback": lambda df: seen.append(df.count()) or df, "on_error": lambda e: seen.append(str(e)) or e})
    s = api.Search(spark, apps, plugins=plugins)
    assert s.personal().count() == 0
    rows = spark.createDataFrame([("notes", "Notes", 0, "2024-01-01", "morning", "select")], "query string, app string, rank int, t string, part string, kind string")
    rows = rows.select("query", "app", "rank", F.to_timestamp("t").alias("ts"), "part", "kind")
    s.record_selection(rows)
    s.record_selection(rows.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")))
    assert seen == [1, 1] and [(r.app, r.selections) for r in s.personal().collect()] == [("Notes", 2)]
    s.tables["meta"] = lambda q: 1 / 0
    with pytest.raises(ZeroDivisionError):
        s.batch(ask(spark, "notes"))
    assert seen[-1] == "division by zero" and s.misses == 0

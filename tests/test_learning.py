"""Learning, statistics, patterns, streams and stores."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from lodestar.functions import maths as M
from lodestar.operators import learn as L
from lodestar.operators import maintain, patterns, rank, semantic, stats
from lodestar.sources import corpus, tables
from lodestar.streaming import jobs
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, 12)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_affinities_by_hand(spark):
    rows = [("qq", "a", 1, at(0), "am", "select"), ("qq", "a", 0, at(0), "am", "select"), ("maps", "a", 1, at(0), "am", "select"), ("maps", "b", 2, at(1), "am", "select"), ("maps", "b", 1, at(1.5), "am", "negative"), ("maps", "c", 0, at(2), "pm", "negative")]
    got = {(r.query, r.app): r for r in L.affinities(spark.createDataFrame(rows, "query string, app string, rank int, ts timestamp, part string, kind string")).collect()}
    assert got["qq", "a"].weighted == pytest.approx(0.075 + 0.075) and got["qq", "a"].selections == 2  # short queries count half
    a, b = got["maps", "a"], got["maps", "b"]
    assert a.corrections == 1 and a.current_weight == pytest.approx(0.15 - 0.15) and b.negatives == 1 and b.current_weight == pytest.approx(0.15 - 0.075)
    assert ("maps", "c") not in got and a.first_seen == at(0)


def test_affinities_equal_the_fold(spark):
    rng = random.Random(3)
    rows = [(f"query{rng.randint(0, 3)}", f"app{rng.randint(0, 2)}", rng.randint(0, 5), at(i * rng.random()), rng.choice(["am", "pm"]), "negative" if rng.random() < 0.2 else "select") for i in range(300)]
    df = spark.createDataFrame(rows, "query string, app string, rank int, ts timestamp, part string, kind string")
    got = {(r.query, r.app): r.current_weight for r in L.affinities(df.repartition(5)).collect()}
    want = {}
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], r[1], r[2]))
        for app, a in L.fold_affinities(q, [(r[3].replace(tzinfo=dt.timezone.utc).timestamp(), r[1], r[2], r[4], r[5]) for r in mine]).items():
            want[q, app] = a["current"]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_aliases_and_boosts(spark):
    a = spark.createDataFrame([("q", "x", 0.7, 0.7), ("q", "y", 0.2, 0.9), ("r", "x", 0.4, 0.4), ("s", "x", -0.1, 0.0)], "query string, app string, current_weight double, confidence double")
    got = {r.query: (r.app, r.status) for r in L.aliases(a).collect()}
    assert got == {"q": ("x", "active"), "r": ("x", "candidate"), "s": ("x", "suppressed")}
    row = spark.createDataFrame([(1,)], "x int")
    day = lambda d: F.lit(d).cast("timestamp")
    status = lambda s, w, c, e="2025-01-01": row.select(L.alias_status(F.lit(s), F.lit(w), F.lit(c), day(e), day("2024-01-01"))).head()[0]
    assert [status("deleted", 1.0, 1.0), status("active", 1.0, 0.7), status("candidate", 1.0, 0.4), status("suppressed", 1.0, 0.4), status("suppressed", 0.1, 0.1), status("active", -0.3, 0.9), status("active", 1.0, 0.9, "2023-01-01")] == ["deleted", "active", "candidate", "candidate", "suppressed", "suppressed", "suppressed"]


def test_feedback_by_hand():
    w, skipped = L.fold_feedback([(0, ["a", "b", "c"], "a")])
    assert w == {"a": 0.56, "b": 0.5, "c": 0.5}
    w, skipped = L.fold_feedback([(0, ["a", "b"], "b")])
    assert w["a"] == pytest.approx(0.5 * 0.7 * 0.8) and w["b"] == pytest.approx(0.62) and skipped == {"a": 1, "b": 0}
    w, skipped = L.fold_feedback([(i, ["a", "b"], "b") for i in range(3)])
    assert w["a"] == 0.0 and skipped["a"] == 3
    w, _ = L.fold_feedback([(0, ["a", "b", "c", "d"], "d")])
    assert w["d"] == pytest.approx(0.7 + 3 * 0.42 * 0.15) and w["a"] == pytest.approx(0.42 * 0.85)
    assert L.fold_feedback([(0, ["a"], "z")]) == ({}, {})


def test_transfer(spark):
    df = spark.createDataFrame([("maps", "x", 0.5), ("mapz", "x", 0.9), ("kkk", "x", 0.1)], "query string, app string, weight double")
    got = {r.query: r.weight for r in L.transfer(df).collect()}
    assert got["maps"] == pytest.approx(0.5 + 0.4 * 0.2) and got["mapz"] == pytest.approx(0.9) and got["kkk"] == 0.1


def test_small_learning_rules(spark):
    clicks = spark.createDataFrame([("a",)] * 3 + [("b",)] * 30, "app string")
    assert {r.app: r.preference for r in L.global_preference(clicks).collect()} == {"a": pytest.approx(0.65), "b": 1.0}
    # two corrections to y; x matched the text in the first only, z has no weight yet, the eighth candidate doesn't count
    fix = spark.createDataFrame(
        [("q", "x", 0, "y", T0, True), ("q", "z", 1, "y", T0, False), ("q", "y", 2, "y", T0, False), ("q", "far", 7, "y", T0, False), ("q", "x", 0, "y", at(1), False)],
        "query string, candidate string, place int, new_app string, ts timestamp, text_match boolean",
    )
    w = spark.createDataFrame([("q", "x", 0.8), ("r", "x", 0.7)], "query string, app string, weight double")
    soft, flags = L.self_heal(w, fix)
    assert {(r.query, r.app): r.weight for r in soft.collect()} == {("q", "x"): pytest.approx(0.8 * 0.85 * 0.5), ("q", "z"): pytest.approx(0.25), ("q", "y"): 1.0, ("r", "x"): 0.7}  # y: 0.6 + 0.3 + 0.3, bounded
    assert sorted((r.app, r.expire_ts) for r in flags.collect()) == [("x", at(1) + dt.timedelta(days=3)), ("z", T0 + dt.timedelta(days=3))]
    hard, _ = L.self_heal(w, fix, "hard")
    assert {(r.query, r.app): r.weight for r in hard.collect()} == {("q", "x"): pytest.approx(-0.2), ("q", "z"): -0.5, ("q", "y"): 2.0, ("r", "x"): 0.7}
    shown = spark.createDataFrame([("a", at(i / 60)) for i in (0, 1, 4, 5, 9, 10, 30)], "app string, ts timestamp")
    assert [r.ts for r in L.throttled(shown, 5).orderBy("ts").collect()] == [at(i / 60) for i in (0, 5, 10, 30)]


def test_bayes_falls_back_to_the_query(spark):
    seen = [("q", "x", "am")] * 3 + [("q", "y", "am"), ("q", "y", "pm"), ("r", "x", "am")]
    asked = spark.createDataFrame([("q", "am"), ("q", "pm"), ("q", "night"), ("r", "am"), ("s", "am")], "query string, bucket string")
    got = {(r.query, r.bucket, r.app): r.p for r in stats.bayes(spark.createDataFrame(seen, "query string, app string, bucket string"), asked).collect()}
    # one observation is too few in a bucket, and for a query
    assert got == {("q", "am", "x"): 0.75, ("q", "am", "y"): 0.25, ("q", "pm", "x"): 0.6, ("q", "pm", "y"): 0.4, ("q", "night", "x"): 0.6, ("q", "night", "y"): 0.4}


def test_bubbles_by_hand(spark):
    """Counts of the hour, ranks of all uses, and each of the last events."""
    rows = [(i, app, T0.replace(hour=h) + dt.timedelta(minutes=i)) for i, (app, h) in enumerate([("a", 9), ("a", 9), ("b", 9), ("b", 1), ("b", 1), ("c", 2), ("d", 3), ("c", 12), ("a", 13), ("a", 14)])]
    got = {r.app: r.score for r in stats.bubbles(spark.createDataFrame(rows, "event_id int, app string, ts timestamp"), 9, k=2, recent=3).collect()}
    # a: 0.5 * 2 + 4 * 0.3 + 0.2 + 0.4 / 3; b: 0.5 + 3 * 0.15
    assert got == {"a": pytest.approx(1 + 1.2 + 0.2 + 0.4 / 3), "b": pytest.approx(0.5 + 0.45)}


def test_synonyms_by_kind(spark):
    pairs = spark.createDataFrame([("car", "auto"), ("auto", "vehicle"), ("carpet", "rug"), ("bike", "Auto")], "term string, synonym string")
    got = {r.synonym: (r.score, r.source) for r in semantic.expand(spark.createDataFrame([("auto",), ("car",)], "term string"), pairs).where("term = 'auto'").collect()}
    assert got == {"vehicle": (0.9, 0), "car": (0.85, 1), "bike": (0.85, 1)}
    got = {r.synonym: (r.score, r.source) for r in semantic.expand(spark.createDataFrame([("car",)], "term string"), pairs).collect()}
    assert got == {"auto": (0.9, 0), "carpet": (0.6, 2)}  # of a key that contains the term, the key itself
    shards = spark.createDataFrame([("C", "car", "wagon", False), ("C", "car", "auto", True)], "initial string, term string, synonym string, raw boolean")
    got = {r.synonym: r.score for r in semantic.expand_sharded(spark.createDataFrame([("car",)], "term string"), shards, pairs).collect()}
    assert got == {"wagon": 0.95, "auto": 0.92, "carpet": 0.6}


def test_reminders_without_an_app_before(spark):
    edges = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 0.0), ("c", "z", 2.0)], "from_app string, to_app string, weight double")
    uses = spark.createDataFrame([("x", T0)], "app string, ts timestamp").where("app = 'none'")
    got = {r.app: r.score for r in L.remind(edges, uses, spark.createDataFrame([], "app string"), None, 9, 1, 5).collect()}
    assert got == {"x": pytest.approx(0.4 * 1.75), "y": pytest.approx(0.4 * 0.25), "z": pytest.approx(0.4)}


def test_maths(spark):
    row = spark.createDataFrame([(1,)], "x int")
    ask = lambda c: row.select(c).head()[0]
    assert ask(M.clamp(F.lit(float("nan")), 0.0, 1.0)) == 0.0 and ask(M.clamp(F.lit(7.0), 0.0, 1.0)) == 1.0
    assert ask(M.usage_weight(F.lit(100), F.lit(1000))) == 250 and ask(M.usage_weight(F.lit(None).cast("int"), F.lit(3))) is None
    assert [ask(M.heat_level(F.lit(n))) for n in (0, 1, 3, 4, 6, 7, 10, 11)] == [0, 1, 2, 3, 3, 4, 4, 5]
    assert ask(M.half_up(F.lit(2.5))) == 3 and ask(M.mode_boost(F.lit(3), F.lit(5))) == 40 and ask(M.mode_boost(F.lit(3), F.lit(4))) == 0
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert ask(M.rounded_median(arr(1, 2, 4, 8))) == 3 and ask(M.rounded_median(arr(9, 1, 5))) == 5 and ask(M.nearest_rank(arr(5, 1, 3), 0.9)) == 5
    assert ask(M.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) == pytest.approx(math.sqrt(0.5)) and ask(M.cosine(arr(0.0), arr(1.0))) == 0.0
    assert list(ask(M.fit_dims(arr(1.0, 2.0), 3))) == [1.0, 2.0, 0.0] and list(ask(M.fit_dims(arr(1.0, 2.0, 3.0), 2))) == [1.0, 2.0]
    start = F.lit("2024-01-01").cast("timestamp")
    blend = [ask(M.blend_weight(start, F.lit(d).cast("timestamp"), F.lit(done))) for d, done in (("2024-01-01", False), ("2024-01-08 12:00:00", False), ("2024-01-16", False), ("2024-02-01", False), ("2024-01-02", True))]
    assert blend == pytest.approx([1, 0.5, 0, 0, 0])  # the old index's share
    assert ask(M.weight_boost(F.lit(1.0))) == 110 and ask(M.weight_boost(F.lit(None).cast("double"))) == 0


def test_patterns_need_enough_and_merge(spark):
    uses = spark.createDataFrame([("a", at(24 * i), 1000 * i) for i in range(10)] + [("b", at(0), 5)] * 2, "pkg string, ts timestamp, duration_ms long")
    got = patterns.timing_patterns(uses, F.lit("2024-01-10 12:00:00").cast("timestamp")).collect()
    assert [(r.pkg, r.samples, r.typical_hour, r.typical_minute, r.p90_duration_ms, r.confidence) for r in got] == [("a", 10, 12, 0, 9000, 1.0)]
    moves = spark.createDataFrame([("a", "b", at(i), 60_000) for i in range(3)] + [("a", "c", at(0), 1)] * 2, "from_app string, to_app string, ts timestamp, delay_ms long")
    assert [r.to_app for r in patterns.transition_patterns(moves, F.lit("2024-01-02").cast("timestamp")).collect()] == ["b"]
    kind = "pkg string, samples long, typical_hour int, weekdays array<boolean>, confidence double"
    old = spark.createDataFrame([("a", 5, 8, [True, False], 0.5), ("b", 5, 8, [True, False], 0.5), ("c", 1, 1, [False, False], 0.1)], kind)
    new = spark.createDataFrame([("a", 3, 9, [False, True], 1.0), ("b", 2, 9, [False, False], 1.0), ("d", 1, 2, [True, True], 0.2)], kind)
    got = {r.pkg: (r.samples, r.typical_hour, r.weekdays, r.confidence) for r in patterns.merge_patterns(old, new, ["pkg"]).collect()}
    assert got == {"a": (8, 9, [True, True], 0.8), "b": (7, 8, [True, False], 0.6), "c": (1, 1, [False, False], 0.1), "d": (1, 2, [True, True], 0.2)}


def test_signal_sessions_and_their_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"p{rng.randint(0, 4)}", i * 1000 + rng.randint(0, 900), rng.choice(["foreground", "background"])) for i in range(300)]
    kind = "pkg string, ts_ms long, event_type string"
    batch = {(r.pkg, r.started_ms): (r.duration_ms, r.closed) for r in patterns.sessions(spark.createDataFrame(rows, kind)).select("pkg", M.millis(F.col("started_at")).alias("started_ms"), "duration_ms", "closed").collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.signal_sessions(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in"))
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    got = {(r.pkg, r.started_ms): (r.duration_ms, r.closed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert len(batch) - len(got) <= 5  # those that are open at the end


def test_typing_and_its_stream(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([5, 9, 10, 120, 240, 300, 5000, 5001])
        rows.append((f"s{i % 3}", t, rng.random() < 0.1))
    kind = "session string, ts_ms long, is_backspace boolean"
    batch = {r.session: tuple(r) for r in jobs.typing_batch(spark.createDataFrame(rows, kind)).collect()}
    for s in ("s0", "s1", "s2"):
        mine = [r for r in rows if r[0] == s]
        gaps = [b[1] - a[1] for a, b in zip(mine, mine[1:]) if 10 <= b[1] - a[1] <= 5000]
        ema = 0.0
        for g in gaps:
            ema = 0.7 * ema + 0.3 * g
        last, errors = gaps[-20:], sum(r[2] for r in mine) / len(mine)
        mean = sum(last) / len(last)
        dev = math.sqrt(sum((x - mean) ** 2 for x in last) / len(last))
        assert batch[s][1:] == pytest.approx((len(mine), ema, errors, jobs.waits(last, errors)[0], max(30.0, min(1.5 * mean, mean + dev))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.typing(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).foreachBatch(
        lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}")
    ).start().awaitTermination()
    got = {r.session: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/0").collect()}
    assert got.keys() == batch.keys() and all(got[s][1:] == pytest.approx(batch[s][1:]) for s in got)
    assert jobs.waits([], 0.0) == (200.0, 100.0) and jobs.waits([100, 300], 0.5) == (400.0, 300.0)


def test_orchestrator():
    fired = jobs.orchestrate([(0, "a"), (50, "ab"), (300, "abc"), (1000, "")], 100, 100)
    assert fired == [(0, "a"), (150, "ab"), (400, "abc"), (1000, "")]
    assert jobs.orchestrate([], 100, 100) == []


def test_store_and_sinks(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        s.read("x")
    assert s.read("x", "a int").count() == 0
    s.write("x", spark.range(3))
    s.write("x", s.read("x").union(spark.range(2)))
    assert s.read("x").count() == 5 and s.names() == ["x"]
    sink = jobs.merge_changes(s, "apps", ["pkg"])
    kind = "pkg string, action string, ts long"
    sink(spark.createDataFrame([("a", "ADDED", 1), ("b", "ADDED", 1)], kind), 0)
    change = spark.createDataFrame([("a", "REMOVED", 2), ("c", "ADDED", 2), ("c", "REPLACED", 3)], kind)
    for _ in range(2):  # the same batch again changes nothing
        sink(change, 1)
        assert sorted(map(tuple, s.read("apps").collect())) == [("b", 1), ("c", 3)]
    keep = jobs.ring(s, "ring", 3)
    for _ in range(2):
        keep(spark.createDataFrame([(f"u{i}", i, at(i)) for i in range(5)], "user string, event_id long, ts timestamp"), 7)
    assert sorted(r.event_id for r in s.read("ring").collect()) == [2, 3, 4] and s.read("ring").where("user like 'u%'").count() == 0
    s.remove("x")
    assert s.names() == ["apps", "ring"]


def test_json_and_synonyms(spark):
    kv = spark.createDataFrame([("a", '{"n": 1}'), ("b", "{oops"), ("c", None)], "key string, value string")
    assert {r.key: r.value.n for r in tables.json_values(kv, "n int", '{"n": -1}').collect()} == {"a": 1, "b": -1, "c": -1}
    raw = spark.createDataFrame([('[{"pkg": "a", "ts_ms": 5, "event_type": "foreground"}, {"pkg": null, "ts_ms": 1}]',), ("broken",), (None,)], "value string")
    assert [(r.pkg, r.ts_ms) for r in tables.signals(raw).collect()] == [("a", 5)]
    lines = spark.createDataFrame([("Aa01= big large",), ("Aa02= small tiny little",), ("",), ("junk",)], "value string")
    pairs = {tuple(r[:2]) for r in corpus.synonym_pairs(corpus.parse_synonyms(lines)).select("term", "synonym").collect()}
    assert ("big", "large") in pairs and ("tiny", "little") in pairs and ("big", "tiny") not in pairs


def test_snapshot_and_limits(spark):
    out, failed = rank.snapshot(spark, {"a": lambda: spark.range(2), "b": lambda: 1 / 0}, {"a": "id long", "b": "x string", "c": "y int"})
    assert failed == ["b", "c"] and out["a"].count() == 2 and out["b"].columns == ["x"]
    b = spark.createDataFrame([("q", 0.4), ("q", 0.2), ("r", 0.1)], "query string, personal double")
    assert sorted(r.personal for r in rank.limit_boosts(b, 0.15).collect()) == pytest.approx([0.1, 0.1, 0.2])
    e = spark.createDataFrame([(i, at(i)) for i in range(30)], "event_id long, ts timestamp")
    assert maintain.compact(e, 10, 15).count() == 15 and maintain.compact(e, 10, 25).count() == 30


def test_empty_statistics(spark):
    e = spark.createDataFrame([], "event_id long, ts timestamp, user long, app string, value double")
    assert stats.hourly_stats(e).count() == 24 and stats.transitions(e).count() == 0 and stats.shares(stats.transitions(e)).count() == 0

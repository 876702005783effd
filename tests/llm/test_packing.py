from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from lodestar.llm import packing as P

from . import cases


def docs_of(spark, sizes):
    return cases.plain(spark, [(i, "".join(chr(97 + (i + j) % 26) for j in range(n)), "en", "web", n) for i, n in enumerate(sizes)])


def check(packs, docs, c):
    texts = defaultdict(list)
    for r in docs.collect():
        if r.text:
            texts[r.doc_id].append(r.text)
    whole = defaultdict(list)
    for p in packs:
        assert 0 < p.used <= c.capacity and p.used == len(p.text) == sum(p.lengths)
        at = 0
        for d, s, n in zip(p.doc_ids, p.starts, p.lengths):
            whole[d].append((s, p.text[at : at + n]))
            at += n
    assert whole.keys() == texts.keys()
    for d, parts in whole.items():
        assert sum(len(t) for _, t in parts) == sum(map(len, texts[d]))
        if len(texts[d]) == 1:
            assert "".join(t for _, t in sorted(parts)) == texts[d][0]
        else:
            assert sorted(parts) == sorted((k, t[k : k + c.capacity]) for t in texts[d] for k in range(0, len(t), c.capacity))
    assert len({p.pack_id for p in packs}) == len(packs)


@pytest.mark.parametrize("config", [P.Config(), P.Config(capacity=1000, groups=8, shard=50)])
def test_nothing_is_lost_and_packs_are_full(spark, config):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.clip(rng.lognormal(6, 1.2, 700), 1, 40_000)]
    docs = docs_of(spark, sizes).repartition(6)
    packs = P.pack(docs, config).collect()
    check(packs, docs, config)
    least = -(-sum(sizes) // config.capacity)
    assert len(packs) <= 1.1 * least + 2


def test_configurations_cover_every_item():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes = np.sort(rng.choice(np.arange(130, 1000), 6, replace=False))[::-1]
        counts = rng.integers(1, 60, 6)
        plan = P.configurations(sizes, counts, 1000)
        assert (sum(col * n for col, n in plan) == counts).all()
        assert all(int(col @ sizes) <= 1000 for col, _ in plan)


def test_best_fit_takes_the_tightest_room():
    made = iter(range(100, 200))
    got = P.best_fit({5: [1], 9: [2], 20: [3]}, [9, 5, 6, 6, 30], 30, lambda: next(made))
    assert got == [2, 1, 3, 3, 100]


def test_same_result_in_any_partitioning(spark):
    docs = docs_of(spark, [i * 13 % 900 + 1 for i in range(300)])
    c = P.Config(capacity=1000)
    a, b = (sorted((p.pack_id, tuple(p.doc_ids)) for p in P.pack(docs.repartition(n), c).collect()) for n in (1, 5))
    assert a == b


def test_defined_results(spark):
    docs = cases.wide(spark)
    check(P.pack(docs).collect(), docs, P.Config())


def test_empty(spark):
    assert P.pack(cases.plain(spark, [])).count() == 0
    assert P.pack(cases.plain(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
    assert P.pack(cases.plain(spark, [(1, "a" * 8192, None, None, None)])).count() == 1


def optimum(sizes, capacity):
    """The least number of packs, by trying every pack for each item, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[i]}):
            left = list(rooms)
            left.remove(r)
            place(i + 1, sorted([*left, r - sizes[i]]))
        place(i + 1, sorted([*rooms, capacity - sizes[i]]))

    place(0, [])
    return best[0]


def test_configurations_against_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(12):
        k = int(rng.integers(2, 5))
        sizes = np.sort(rng.choice(np.arange(130, 800), k, replace=False))[::-1]
        counts = rng.integers(1, 4, k)
        got = sum(n for _, n in P.configurations(sizes, counts, 1000))
        # rounding the program's solution down leaves less than one pack of each size to first-fit
        assert optimum(np.repeat(sizes, counts).tolist(), 1000) <= got <= optimum(np.repeat(sizes, counts).tolist(), 1000) + k - 1


def brute(pieces, c):
    """Packs as lists of (doc_id, start, len, text): the scheme with every place written out and every pack looked at."""
    small = c.capacity // c.parts
    packs = [[p] for p in pieces if p["len"] == c.capacity]
    large = sorted((p for p in pieces if small < p["len"] < c.capacity), key=lambda p: (-p["len"], p["bucket"], p["doc_id"] is not None, p["doc_id"] or 0, p["start"], p["piece"]))
    group = max(1, -(-len(large) // c.groups))
    groups = [large[i : i + group] for i in range(0, len(large), group)]
    sizes, number = np.array([g[0]["len"] for g in groups]), np.array([len(g) for g in groups])
    first, waiting = len(packs), [list(g) for g in groups]
    for column, n in P.configurations(sizes, number, c.capacity):
        for _ in range(n):
            packs.append([waiting[k].pop(0) for k in np.flatnonzero(column) for _ in range(int(column[k]))])
    assert not any(waiting)
    room = {i: c.capacity - sum(p["len"] for p in packs[i]) for i in range(first, len(packs))}
    for p in sorted((p for p in pieces if p["len"] <= small), key=lambda p: (-p["len"], p["doc_id"] or 0, p["start"], p["piece"])):
        fits = sorted((r, i) for i, r in room.items() if r >= p["len"])
        if fits:
            at = fits[0][1]  # any pack of that room will do
        else:
            at = len(packs)
            packs.append([])
            room[at] = c.capacity
        packs[at].append(p)
        room[at] -= p["len"]
    return packs


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    c = P.Config(capacity=1000, groups=6)
    sizes = [int(x) for x in np.clip(rng.lognormal(5.6, 0.9, 260), 1, 2500)] + [300] * 9
    rows = [(i, "".join(chr(97 + (i + j) % 26) for j in range(n)), "en", "web", n) for i, n in enumerate(sizes)]
    rows += [(5, "q" * 400, "en", "web", 1), (5, "r" * 400, "en", "web", 1), (None, "s" * 300, None, None, None)]
    docs = cases.plain(spark, rows).repartition(5)
    bucket = P.F.pmod(P.F.xxhash64("doc_id", "start"), P.F.lit(P.BUCKETS)).cast("int")
    pieces = [r.asDict() for r in P._pieces(docs, "text", "doc_id", c).withColumn("bucket", bucket).collect()]
    want, packs = brute(pieces, c), P.pack(docs, c).collect()
    # the same pieces stand together; of packs with equal room, any may take a small piece, so small ones are compared by how full packs get
    small = c.capacity // c.parts
    key = lambda ps: tuple(sorted((str(d), s, n) for d, s, n in ps if n > small))
    assert sorted(key(zip(p.doc_ids, p.starts, p.lengths)) for p in packs) == sorted(key((x["doc_id"], x["start"], x["len"]) for x in p) for p in want)
    assert sorted(p.used for p in packs) == sorted(sum(x["len"] for x in p) for p in want)


def test_repeated_ids_of_equal_length(spark):
    rows = [(7, f"{i:03d}" * 100, "en", "web", 1) for i in range(40)]
    c = P.Config(capacity=1000)
    a, b = (sorted((p.pack_id, p.text) for p in P.pack(cases.plain(spark, rows[::step]).repartition(n), c).collect()) for step, n in ((1, 1), (-1, 5)))
    assert a == b


def test_pieces_are_moved_twice(spark):
    """To their ranks and to their packs; the room of the packs comes from counts."""
    rng = random.Random(6)
    texts = [f"{rng.getrandbits(4 * n):0{n}x}" for n in [*range(3000, 3300), *[8192] * 5, *[40] * 30]]
    docs = cases.plain(spark, [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]).repartition(6).cache()
    assert docs.count() == len(texts)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        time.sleep(1)  # for the listeners
        every = store.executorList(False)
        return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))

    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        packs = P.pack(docs).collect()
        assert sum(map(len, texts)) < written() - before < 2.4 * sum(map(len, texts))
        check(packs, docs, P.Config())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        docs.unpersist()

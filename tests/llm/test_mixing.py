from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from lodestar.llm import mixing as M

from . import cases


def table(spark, n=3000, hot=2000):
    data = [(i, "x" * (50 + i * 37 % 400), "en", "hot" if i < hot else f"s{i % 7}", 1) for i in range(n)]
    return data, cases.plain(spark, data)


def expected(data, weights=None, c=M.Config()):
    chars = defaultdict(int)
    for _, t, _, s, _ in data:
        chars[s] += len(t or "")
    w = {s: (n**c.temperature if n else 0.0) for s, n in chars.items()} if weights is None else {s: weights.get(s, 0.0) for s in chars}
    total = sum(w.values()) or 1
    return {s: (w[s] / total * sum(chars.values()) * c.size / n if n else 0.0) for s, n in chars.items()}


@pytest.mark.parametrize("config", [M.Config(), M.Config(leaf=64, fan=3, seed=9)])
def test_totals_are_met_to_less_than_one_document(spark, config):
    data, docs = table(spark)
    lam, n, got = expected(data, c=config), defaultdict(int), defaultdict(int)
    for _, _, _, s, _ in data:
        n[s] += 1
    for r in M.plan(docs, config=config).collect():
        assert r.copies in (int(lam[r.source]), int(lam[r.source]) + 1)
        got[r.source] += r.copies
    for s in n:
        assert abs(got[s] - lam[s] * n[s]) < 1 + 1e-6


def test_every_document_keeps_its_expectation():
    rng = np.random.default_rng(0)
    p = rng.random(9)
    total = np.zeros(9)
    for _ in range(8000):
        got, at, q = M.pivot(p, rng.random(9))
        if at >= 0:
            got[at] = rng.random() < q
        total += got
    assert np.abs(total / 8000 - p).max() < 0.03


def test_same_result_in_any_partitioning(spark):
    _, docs = table(spark, 500, 300)
    a = sorted(map(tuple, M.plan(docs.repartition(1)).collect()))
    assert a == sorted(map(tuple, M.plan(docs.repartition(7)).collect()))


def test_given_weights(spark):
    data, docs = table(spark, 600, 300)
    got = defaultdict(int)
    for r in M.plan(docs, {"hot": 1, "s3": 3}).collect():
        got[r.source] += r.copies
    lam = expected(data, {"hot": 1, "s3": 3})
    assert set(k for k, v in got.items() if v) == {"hot", "s3"} and abs(got["hot"] - 300 * lam["hot"]) < 1
    assert M.mix(docs, {}).count() == 0


def test_defined_results(spark):
    docs = cases.wide(spark)
    plan = M.plan(docs)
    keys = {(r.doc_id, r.source) for r in docs.collect()}
    rows = plan.collect()
    assert len(rows) == len(keys) and {(r.doc_id, r.source) for r in rows} == keys
    out = M.mix(docs)
    assert out.schema == docs.schema
    copies = {(r.doc_id, r.source): r.copies for r in rows}
    assert out.count() == sum(copies[r.doc_id, r.source] for r in docs.collect())


def test_empty(spark):
    assert M.plan(cases.plain(spark, [])).count() == 0 and M.mix(cases.plain(spark, [])).count() == 0
    assert M.mix(cases.plain(spark, [(1, "", "en", "a", 0)])).count() == 0


def test_rows_that_differ_in_which_column_is_null(spark):
    docs = cases.swapped(spark)
    rows = M.plan(docs).collect()
    assert sorted(((r.doc_id, r.source) for r in rows), key=str) == sorted({(r.doc_id, r.source) for r in docs.collect()}, key=str)
    items = spark.createDataFrame([(None, "x" * 9, "a"), ("a", "x" * 9, None)], "doc_id string, text string, source string")
    assert M.plan(items).count() == 2 and M.mix(items).count() == sum(r.copies for r in M.plan(items).collect())


def brute(items, lam, leaves, c):
    """Copies of each item: its leaf's fractions are paired in order of the keys, then each ``fan`` leaves' residuals, up to one root a source."""

    def meet(some, level):
        draw = dict(zip((x["key"] for x in some), M._draws(c.seed + level, np.array([x["key"] for x in some], np.int64).view(np.uint64))))
        held = None
        for x in sorted(some, key=lambda x: (x["key"], x["more"])):
            if M.EPS < x["p"] < 1 - M.EPS:
                if held is None:
                    held = x
                    continue
                total, u = held["p"] + x["p"], draw[x["key"]]
                if total < 1:  # the mass goes to one of them
                    wins, loses = (x, held) if u * total < x["p"] else (held, x)
                    wins["p"], loses["p"] = total, 0.0
                else:  # one is in
                    wins, loses = (x, held) if u * (2 - total) < 1 - held["p"] else (held, x)
                    wins["p"], loses["p"] = 1.0, total - 1
                held = next((y for y in (wins, loses) if M.EPS < y["p"] < 1 - M.EPS), None)
        return [held] if held else []

    out = {}
    for source in {x["source"] for x in items}:
        mine = [dict(x, p=lam[source] % 1) for x in items if x["source"] == source]
        nodes = defaultdict(list)
        for x in mine:
            nodes[x["leaf"]].append(x)
        most, level = max(leaves.values()), 0
        while True:
            left = defaultdict(list)
            for n, some in nodes.items():
                left[n // c.fan] += meet(some, level)
            if most <= 1:
                break
            nodes, most, level = left, -(-most // c.fan), level + 1
        for x in (x for some in left.values() for x in some):
            x["p"] = float(x["root"] < x["p"])
        for x in mine:
            out[x["doc_id"], source] = int(lam[source]) + round(x["p"])
    return out


def test_against_brute_force(spark):
    from lodestar.llm._util import row_key
    from pyspark.sql import functions as F

    c = M.Config(leaf=40, fan=3, seed=4)
    data, docs = table(spark, 900, 500)
    lam, n = expected(data, c=c), defaultdict(int)
    for _, _, _, s, _ in data:
        n[s] += 1
    leaves = {s: max(1, -(-k // c.leaf)) for s, k in n.items()}
    keyed = docs.select("doc_id", "source", row_key(F.col("source"), F.col("doc_id"), seed=3).alias("k")).select("doc_id", "source", F.col("k.a").alias("key"), F.col("k.b").alias("more"))
    keyed = keyed.withColumn("h", F.xxhash64("key")).withColumn("root", F.xxhash64(F.lit(c.seed), "key").cast("double") / 2.0**64 + 0.5)
    items = [dict(r.asDict(), leaf=r.h % leaves[r.source]) for r in keyed.collect()]
    got = {(r.doc_id, r.source): r.copies for r in M.plan(docs.repartition(5), config=c).collect()}
    assert got == brute(items, lam, leaves, c)

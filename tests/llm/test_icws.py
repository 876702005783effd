from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from lodestar.llm import icws as I
from pyspark.sql import functions as F

from . import cases


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values())


def pairs():
    out = []
    for i in range(10):
        w = cases.prose(i, 200).replace(".", "").split()
        other = cases.prose(50 + i, 200).replace(".", "").split()
        out.append((" ".join(w), " ".join(w[: 20 * i] + other[20 * i :] + w[: 15 * i] * (i % 3))))
    return out


def test_collision_rate_is_the_generalised_jaccard_similarity():
    c = I.Config(samples=2048)
    for a, b in pairs():
        sig = I.signatures(*I.terms(pa.array([a.lower(), b.lower()])), c)
        assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.05


def test_against_the_formulas_term_by_term():
    c = I.Config(samples=16)
    h, w, b = I.terms(pa.array(["a b b c c c", "b", "", "c a a"]))
    sig = I.signatures(h, w, b, c)
    r, lnc, beta = I.variates(h, c.samples, c.seed)
    for row in range(4):
        lo, hi = b[row], b[row + 1]
        if lo == hi:
            assert not sig[row].any()
            continue
        for s in range(c.samples):
            t = np.floor(np.log(w[lo:hi].astype(np.float32)) / r[lo:hi, s] + beta[lo:hi, s])
            least = int((lnc[lo:hi, s] - r[lo:hi, s] * (t - beta[lo:hi, s] + 1)).argmin())
            want = I.K.mix(h[lo + least : lo + least + 1] + I.K.mix(np.array([t[least]]).astype(np.int64).view(np.uint64) + np.uint64(1)))[0]
            assert sig[row, s] == want


def test_the_variates_are_gamma():
    r, lnc, b = I.variates(np.arange(20_000, dtype=np.uint64), 8, 1)
    assert abs(r.mean() - 2) < 0.02 and abs(r.var() - 2) < 0.06 and abs(np.exp(lnc).mean() - 2) < 0.02 and abs(b.mean() - 0.5) < 0.01


def test_defined_results(spark):
    docs = cases.wide(spark)
    rows = I.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert (r.signature is None) == (r.terms == 0)
        if r.doc_id in (5, 6):
            by.setdefault("same", set()).add(tuple(r.signature))
    assert len(by["same"]) == 1
    two = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3, 9])], "a array<long>, b array<long>")
    assert two.select(I.similarity(F.col("a"), F.col("b"))).head()[0] == 0.5


def test_empty(spark):
    assert I.fingerprints(cases.plain(spark, [])).count() == 0

from __future__ import annotations

import random

import numpy as np
import pytest
from lodestar.llm import lpf as L

from . import cases


def brute(texts: list[str | None], words: int) -> list[list[bool]]:
    """Which words of each text go: those of a run of ``words`` words that stands somewhere before."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            run = tuple(w[i : i + words])
            if run in seen:
                gone[i : i + words] = [True] * words
            seen.add(run)
        out.append(gone)
    return out


def made(seed: int) -> list[str]:
    rng = random.Random(seed)
    shared = [cases.prose(500 + i, 70 + 20 * i) for i in range(4)]
    out = []
    for i in range(60):
        parts = [cases.prose(seed * 1000 + i, rng.randint(0, 90))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            w = s.split()
            a = rng.randint(0, 20)
            parts += [" ".join(w[a : a + rng.randint(30, 120)]), cases.prose(seed * 7777 + i, rng.randint(0, 30))]
        if i % 9 == 0:
            parts.append("again and " * 60)
        out.append(" ".join(p for p in parts if p))
    return out


@pytest.mark.parametrize("config", [L.Config(), L.Config(words=50, window=24, chunk=40), L.Config(words=12, window=5)])
def test_against_brute_force(spark, config):
    texts = made(3)
    docs = cases.plain(spark, [(i, t, "en", "web", 1) for i, t in enumerate(texts)]).repartition(5)
    got = {r.doc_id: r for r in L.deduplicate(docs, config).collect()}
    for i, gone in enumerate(brute(texts, config.words)):
        left = [w for w, g in zip(texts[i].split(), gone) if not g]
        assert got[i].text.split() == left
        assert (got[i].words_removed or 0) == sum(gone)


def test_longest_previous_factor():
    rng = np.random.default_rng(4)
    t = rng.permutation(300)
    first = np.zeros(300, np.int64)
    got = L.previous_smaller(t, first)
    for i in range(300):
        before = [j for j in range(i) if t[j] < t[i]]
        assert got[i] == (before[-1] if before else -1)


def test_defined_results(spark):
    docs = cases.wide(spark)
    out = L.drop_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r.text for r in out.collect()]
    assert sum(t == cases.prose(1, 120) for t in texts) == 1  # the first of four copies
    assert sum(t is None for t in texts) == 3 and cases.prose(99, 30_000) in texts and "x" * 300_000 in texts
    assert L.deduplicate(docs).count() == docs.count()


def test_empty(spark):
    assert L.deduplicate(cases.plain(spark, [])).count() == 0
    assert [r.text for r in L.deduplicate(cases.plain(spark, [(None, None, None, None, None)])).collect()] == [None]


def test_rows_that_differ_in_which_column_is_null(spark):
    t = cases.prose(1, 80)
    docs = spark.createDataFrame([(t, None), (None, t)], "doc_id string, text string")
    assert {(r.doc_id, r.text, r.words_removed) for r in L.deduplicate(docs).collect()} == {(t, None, None), (None, t, None)}
    assert sorted(map(str, L.drop_passages(docs).collect())) == sorted(map(str, docs.collect()))
    docs = cases.swapped(spark)
    out = L.deduplicate(docs).collect()
    assert len(out) == 6 and sorted(r.words_removed or 0 for r in out) == [0, 0, 0, 0, 0, 80]  # of two equal texts, the later one's goes

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lodestar.llm import quality as Q

from . import cases

BAD = ["BUY NOW!! CLICK HERE!! WIN $$$ ### *** !!! NOW!! FREE!!", "menu | home | about | login | help | cart | more", "spam spam spam spam spam spam spam spam spam spam spam spam"]


def corpus(spark, n=120):
    data = [(i, cases.prose(1000 + i, 40 + i), "en", "web", 1) for i in range(n)]
    data += [(10_000 + i, " ".join([BAD[i % 3]] * (2 + i % 5)), "en", "web", 1) for i in range(n // 3)]
    return cases.plain(spark, data)


def test_held_out_accuracy(spark):
    got = {r.doc_id for r in Q.classify(corpus(spark)).collect()}
    good = set(range(120))
    assert len(got & good) >= 0.98 * len(good)
    assert len(got - good) <= 2


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.85, 0.8, 0.75])
    v = np.where(rng.random((len(y), 10)) < right, y[:, None], ~y[:, None]).astype(np.int8)
    v[rng.random(v.shape) < 0.3] = Q.NONE
    p, n = np.unique(Q.patterns(v), return_counts=True)
    prior, rate, q = Q.estimate(p, n)
    assert abs(prior - 0.7) < 0.02
    heard = rate[:, 1, Q.GOOD] / (rate[:, 1, Q.GOOD] + rate[:, 1, Q.BAD])
    assert np.abs(heard - right).max() < 0.03
    assert ((q[np.searchsorted(p, Q.patterns(v))] > 0.5) == y).mean() > 0.97


def test_patterns_round_trip():
    v = np.random.default_rng(1).integers(0, 3, (50, len(Q.LABELLERS))).astype(np.int8)
    assert (Q.unpack(Q.patterns(v)) == v).all()


def test_same_text_same_vote_in_any_batch():
    texts = [r[1] for r in cases.rows()]
    whole = Q.votes(pa.array(texts, pa.string()))
    each = np.concatenate([Q.votes(pa.array([t], pa.string())) for t in texts])
    assert (whole == each).all()


def test_defined_results(spark):
    docs = cases.wide(spark)
    kept = Q.keep_good(docs)
    assert kept.schema == docs.schema
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts
    # repeated rows are judged alike
    n = sum(t == cases.prose(1, 120) for t in texts)
    assert n in (0, 4)
    assert cases.prose(99, 30_000) in texts


def test_empty(spark):
    docs = cases.plain(spark, [])
    assert Q.keep_good(docs).count() == 0 and Q.classify(docs).count() == 0
    assert Q.keep_good(cases.plain(spark, [(1, None, None, None, None)])).count() == 0


SIGNS, END, TAIL = b"*#$&%", b".?!", b".,;:!?"


def plain_votes(text):
    """The ten labellers by a loop over words."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in re.split(rb"[\t\n\v\f\r ]+", low) if w]
    n = len(words)
    if not n:
        return [Q.NONE] * 10
    letter = lambda b: 97 <= b <= 122 or b >= 128
    share = lambda f: sum(map(f, range(n))) / n
    stop = {w.encode() for w in Q._STOP}
    end = lambda i, k: words[i][max(len(words[i]) - k, 0)]
    sym = share(lambda i: len(words[i]) > 1 and end(i, 1) in SIGNS and end(i, 2) in SIGNS)
    bang = share(lambda i: end(i, 1) == 33 and end(i, 2) == 33)
    bar = share(lambda i: words[i] == b"|")
    rep = share(lambda i: i > 0 and words[i] == words[i - 1])
    run = share(lambda i: i > 2 and len(set(words[i - 3 : i + 1])) == 1)
    echo = share(lambda i: words[i] in words[max(0, i - 3) : i])
    stops = share(lambda i: (words[i][:-1] if len(words[i]) > 1 and end(i, 1) in TAIL else words[i]) in stop)
    ends = share(lambda i: end(i, 1) in END)
    alpha = share(lambda i: letter(words[i][0]) and (letter(end(i, 1)) or (end(i, 1) in TAIL and letter(end(i, 2)))))
    caps = sum(65 <= b <= 90 for b in raw) / max(1, sum(map(letter, low)))
    vote = lambda bad, good: Q.BAD if bad else Q.GOOD if good else Q.NONE
    some, many = n >= 4, n >= 20
    return [
        vote(sym > 0.08, False), vote(some and caps > 0.5, False), vote(bang > 0.08, False), vote(bar > 0.08, False), vote(some and rep > 0.15, many and rep < 0.05), vote(some and run > 0.08, False), vote(some and echo > 0.25, many and echo < 0.15),
        vote(many and stops < 0.02, many and stops > 0.08), vote(many and ends < 0.01, many and 0.02 < ends < 0.4), vote(some and alpha < 0.6, some and alpha > 0.9),
    ]


def plain_fit(votes, rounds):
    """Expectation-maximisation over documents, one at a time."""
    q = [1 / (1 + math.exp(-(v.count(Q.GOOD) - 1.5 * v.count(Q.BAD)))) for v in votes]
    for _ in range(rounds):
        prior = (sum(q) + 1) / (len(q) + 2)
        rate = [[[0.5] * 3 for _ in range(2)] for _ in range(10)]
        for v, p in zip(votes, q):
            for j, k in enumerate(v):
                rate[j][1][k] += p
                rate[j][0][k] += 1 - p
        rate = [[[x / sum(side) for x in side] for side in lab] for lab in rate]
        q = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j][1][k] / rate[j][0][k]) for j, k in enumerate(v) if k != Q.NONE)
            q.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
    return prior, rate, q


def plain_features(text, dims):
    """Hashed runs of one to four byte classes and repeated words, unit length, by a loop over bytes."""
    raw, counts = (text or "").encode(), Counter()
    for k in range(4):
        for i in range(len(raw) - k):
            code = sum(int(Q._CLASS[raw[i + j]]) << (4 * j) for j in range(k + 1)) + ((k + 1) << 17)
            counts[code * 2654435761 % 2**32 >> (32 - dims.bit_length() + 1)] += 1
    low = [w for w in re.split(rb"[\t\n\v\f\r ]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw)) if w]
    counts[1] += sum(a == b for a, b in zip(low, low[1:]))
    root = math.sqrt(sum(counts.values()))
    return {c: math.sqrt(n) / root for c, n in counts.items() if n}


def test_the_query_against_plain_python(spark):
    """Labels, fit, features, training and decision, each document by itself; the sample holds all of them."""
    c = Q.Config(dims=1 << 10, steps=80, rounds=25)
    docs = corpus(spark, 60)
    data = sorted(docs.collect()) + [(20_000, "two words", "en", "web", 1), (20_001, "", "en", "web", 1), (20_002, None, "en", "web", 1), (20_003, "Größe " * 9, "en", "web", 1)]
    votes = [plain_votes(r[1]) for r in data]
    assert votes == Q.votes(pa.array([r[1] for r in data], pa.string())).tolist()
    _, _, q = plain_fit(votes, c.rounds)
    rows = [plain_features(r[1], c.dims) for r in data]
    taught = [i for i, r in enumerate(data) if r[1]]
    w, move = np.zeros(c.dims + 1), np.zeros(c.dims + 1)
    x = np.zeros((len(data), c.dims + 1))
    for i, row in enumerate(rows):
        for k, v in row.items():
            x[i, k] = v
        x[i, -1] = 1
    for _ in range(c.steps):
        err = 1 / (1 + np.exp(-x[taught] @ w)) - np.array(q)[taught]
        grad = x[taught].T @ err / len(taught) + 1e-5 * np.append(w[:-1], 0)
        move = 0.9 * move - 8.0 * grad
        w = w + move
    score = 1 / (1 + np.exp(-x @ w))
    want = {}
    for i, r in enumerate(data):
        n = len((r[1] or "").split())
        s = 0.0 if n == 0 else q[i] if n < 4 else score[i]
        if s >= c.threshold:
            want[r[0]] = (s, q[i], votes[i].count(Q.GOOD), votes[i].count(Q.BAD))
    got = {r.doc_id: tuple(r)[1:] for r in Q.classify(cases.plain(spark, data).repartition(3), c).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-4) for d in want)

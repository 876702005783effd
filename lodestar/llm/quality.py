"""Quality classifier by weak labels (operator 1).

Ten overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts
of the vote patterns of the whole corpus (at most 3**10 rows, whatever its size) estimates how reliable each labeller is and
gives each pattern a posterior. Posterior labels of a bounded sample (``train_rows``) then train a linear scorer over
hashed features, which decides on every document, so that documents on which the labellers abstain are judged too.
A text of one to three words has too little shape for the scorer and keeps its posterior.

Defined results: a null or empty text has no evidence and is rejected with score 0; repeated rows score alike; an empty
table gives an empty result; other columns, of any name, pass through :func:`keep_good` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._util import chunks, free_name, text_or_empty

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "shouting", "bangs", "bars", "repeats", "runs", "echoes", "stopwords", "sentences", "letters")
_STOP = (
    "the of and to in is that it for was on are as with be by at this from or have not "
    "der die und das von zu mit den ist des im für auf ein eine dem nicht als auch sich "
    "le la les de des et un une du en est que qui dans pour pas sur au par elle avec "
    "el los las y a una por con para del se su al lo no como más"
).split()

#: Byte classes for the shape features: letters by case, digits, spaces, and each common sign by itself.
_CLASS = np.full(256, 15, np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[128:], _CLASS[48:58] = 0, 1, 2, 3
for _i, _signs in enumerate((b" ", b"\n\r", b".", b",", b"!", b"|", b"*#$&%", b"\t", b"?", b"'\"", b"-_")):
    for _s in _signs:
        _CLASS[_s] = 4 + _i


@dataclass(frozen=True)
class Config:
    train_rows: int = 4000  #: bound on the rows that train the scorer, half of each posterior class
    dims: int = 1 << 13  #: hashed features
    rounds: int = 60  #: of expectation-maximisation
    steps: int = 300  #: of gradient descent
    threshold: float = 0.5
    seed: int = 17


def _stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per row that the labellers look at."""
    start, end, b = K.words(buf, off)
    n = np.diff(b)
    lower = buf.copy()
    up = (buf >= 65) & (buf <= 90)
    lower[up] += 32
    h = K.word_hashes(lower, start, end)
    out = {"words": n}
    if not len(start):
        return out | {k: np.zeros(len(n), np.int64) for k in ("upper", "letters", "sym", "bang", "bar", "rep", "run", "echo", "stop", "end", "alpha")} | {"rows": h, "bounds": b, "again": np.zeros(0, bool)}
    last, before = lower[end - 1], lower[np.maximum(end - 2, start)]
    sign = np.isin(lower, np.frombuffer(b"*#$&%", np.uint8))
    out["sym"] = K.row_sum(sign[end - 1] & sign[np.maximum(end - 2, start)] & (end - start > 1), b)
    out["bang"] = K.row_sum((last == 33) & (before == 33), b)
    out["bar"] = K.row_sum((end - start == 1) & (last == 124), b)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[b[:-1][n > 0]] = False
    out["rep"] = K.row_sum(again, b)
    # words that end a run of four alike, and words said within the three before
    row = np.repeat(np.arange(len(n)), n)
    run, echo = again.copy(), again.copy()
    for k in (2, 3):
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) & (row[k:] == row[:-k])
        run &= same
        echo |= same
    out["run"], out["echo"] = K.row_sum(run, b), K.row_sum(echo, b)
    # stop words are compared without the signs around them; one trailing sign is stripped
    tail = np.isin(last, np.frombuffer(b".,;:!?", np.uint8))
    stripped = K.word_hashes(lower, start, np.where(tail & (end - start > 1), end - 1, end))
    out["stop"] = K.row_sum(np.isin(stripped, _stop_hashes()), b)
    out["end"] = K.row_sum(np.isin(last, np.frombuffer(b".?!", np.uint8)), b)
    letter = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    out["alpha"] = K.row_sum(letter[start] & (letter[end - 1] | (tail & letter[np.maximum(end - 2, start)])), b)
    out["upper"] = K.row_sum(up, off)
    out["letters"] = K.row_sum(letter, off)
    return out | {"rows": h, "bounds": b, "again": again}


def _stop_hashes() -> np.ndarray:
    text = pa.array([" ".join(_STOP)])
    buf, off = K.utf8(text)
    start, end, _ = K.words(buf, off)
    return np.unique(K.word_hashes(buf, start, end))


def votes(text: pa.Array, s: dict | None = None) -> np.ndarray:
    """One vote per row and labeller: GOOD, BAD or NONE."""
    s = s or _stats(*K.utf8(text))
    n = np.maximum(s["words"], 1)
    r = {k: s[k] / n for k in ("sym", "bang", "bar", "rep", "run", "echo", "stop", "end", "alpha")}
    caps = s["upper"] / np.maximum(s["letters"], 1)
    some, many = s["words"] >= 4, s["words"] >= 20

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, NONE)).astype(np.int8)

    out = np.stack(
        [
            # these four see one defect each; its absence says nothing
            vote(r["sym"] > 0.08, False),
            vote(some & (caps > 0.5), False),
            vote(r["bang"] > 0.08, False),
            vote(r["bar"] > 0.08, False),
            vote(some & (r["rep"] > 0.15), many & (r["rep"] < 0.05)),
            vote(some & (r["run"] > 0.08), False),
            vote(some & (r["echo"] > 0.25), many & (r["echo"] < 0.15)),
            vote(many & (r["stop"] < 0.02), many & (r["stop"] > 0.08)),
            vote(many & (r["end"] < 0.01), many & (r["end"] > 0.02) & (r["end"] < 0.4)),
            vote(some & (r["alpha"] < 0.6), some & (r["alpha"] > 0.9)),
        ],
        axis=1,
    )
    out[s["words"] == 0] = NONE
    return out


_BASE = 3 ** np.arange(len(LABELLERS), dtype=np.int32)


def patterns(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int32) * _BASE).sum(axis=1).astype(np.int32)


def unpack(pattern: np.ndarray) -> np.ndarray:
    return (np.asarray(pattern)[:, None] // _BASE % 3).astype(np.int8)


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over pattern counts: (share of good, [labeller, class, vote] rates, posterior of each pattern).

    Starts from the majority vote, so that the class called good stays the one that the labellers call so.
    """
    v, count = unpack(pattern), np.asarray(count, float)
    lead = (v == GOOD).sum(axis=1) - 1.5 * (v == BAD).sum(axis=1)
    q = 1 / (1 + np.exp(-lead))
    prior, rate = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        mass = count * q
        prior = float((mass.sum() + 1) / (count.sum() + 2))
        for y, m in ((1, mass), (0, count - mass)):
            for k in (BAD, GOOD, NONE):
                rate[:, y, k] = ((v == k) * m[:, None]).sum(axis=0) + 0.5
            rate[:, y] /= rate[:, y].sum(axis=1, keepdims=True)
        q = posterior(v, prior, rate)
    return prior, rate, q


def posterior(v: np.ndarray, prior: float, rate: np.ndarray) -> np.ndarray:
    """P(good | votes). An abstention says nothing."""
    heard = v != NONE
    odds = np.full(len(v), np.log(prior / (1 - prior)))
    for j in range(v.shape[1]):
        odds += np.where(heard[:, j], np.log(rate[j, 1, v[:, j]] / rate[j, 0, v[:, j]]), 0.0)
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def features(buf: np.ndarray, off: np.ndarray, s: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (row, column, value): runs of one to four byte classes and of repeated words, unit length."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    code = _CLASS[buf]
    keys, acc = [], np.zeros(len(buf), np.uint32)
    for k in range(4):
        acc = acc.copy()
        acc[: len(buf) - k] += code[k:] << np.uint32(4 * k)
        whole = np.arange(len(buf)) + k < off[row + 1] if len(buf) else np.zeros(0, bool)
        slot = (acc + np.uint32((k + 1) << 17)) * np.uint32(2654435761) >> np.uint32(32 - int(dims).bit_length() + 1)
        keys.append(row[whole] * dims + slot[whole])
    word_row = np.repeat(np.arange(n, dtype=np.int64), np.diff(s["bounds"]))
    keys.append(word_row[s["again"]] * dims + 1)
    counts = np.bincount(np.concatenate(keys), minlength=n * dims).reshape(n, dims) if n else np.zeros((0, dims))
    r, c = np.nonzero(counts)
    x = np.sqrt(counts[r, c])
    x /= np.sqrt(np.bincount(r, x * x, minlength=n))[r] if len(r) else 1.0
    return r, c, x


def fit(r: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray, mass: np.ndarray, dims: int, steps: int) -> np.ndarray:
    """Logistic regression on soft labels, rows weighted by ``mass``, by full-batch descent with momentum; the last weight is the bias."""
    w, move = np.zeros(dims + 1), np.zeros(dims + 1)
    mass = mass / mass.sum()
    for _ in range(steps):
        z = np.bincount(r, x * w[c], minlength=len(y)) + w[dims]
        err = mass * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(np.bincount(c, x * err[r], minlength=dims) + 1e-5 * w[:dims], err.sum())
        move = 0.9 * move - 8.0 * grad
        w = w + move
    return w


@dataclass(frozen=True)
class Model:
    config: Config
    prior: float
    rate: np.ndarray
    weights: np.ndarray

    def judge(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, posterior, score) of each row."""
        out = [np.zeros(len(text), np.int32), np.zeros(len(text)), np.zeros(len(text))]
        for i, n in chunks(text, 1_000_000):
            # at most 64 rows at a time in the dense feature counts
            for at in range(i, i + n, 64):
                part = text.slice(at, min(64, i + n - at))
                buf, off = K.utf8(part)
                s = _stats(buf, off)
                v = votes(part, s)
                r, c, x = features(buf, off, s, self.config.dims)
                z = np.bincount(r, x * self.weights[c], minlength=len(part)) + self.weights[-1]
                rows = slice(at, at + len(part))
                out[0][rows], out[1][rows] = patterns(v), posterior(v, self.prior, self.rate)
                score = np.where(s["words"] < 4, out[1][rows], 1 / (1 + np.exp(-np.clip(z, -60, 60))))
                out[2][rows] = np.where(s["words"] > 0, score, 0.0)
        return out[0], out[1], out[2]


def train(docs: DataFrame, text_col: str = "text", config: Config = Config()) -> Model:
    """Fit the label model on all documents and the scorer on a bounded sample of them."""
    texts = docs.select(text_or_empty(F.col(f"`{text_col}`")).alias("t"))

    def count(batches):
        for batch in batches:
            for i, n in chunks(batch.column(0)):
                p = patterns(votes(batch.column(0).slice(i, n)))
                k, c = np.unique(p, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int64())], ["p", "n"])

    table = texts.mapInArrow(count, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").toPandas()
    if not len(table):
        return Model(config, 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), np.zeros(config.dims + 1))
    prior, rate, q = estimate(table["p"].to_numpy(), table["n"].to_numpy(), config.rounds)
    n_good = float((table["n"] * (q >= 0.5)).sum())
    n_bad = float(table["n"].sum() - n_good)
    half = config.train_rows // 2
    odds = {c: min(1.0, 1.3 * half / max(n, 1)) for c, n in ((1, n_good), (0, n_bad))}

    def sample(batches):
        for batch in batches:
            text, draw = batch.column(0), batch.column(1).to_numpy()
            for i, n in chunks(text):
                part = text.slice(i, n)
                p = posterior(votes(part), prior, rate)
                hit = np.flatnonzero(draw[i : i + n] < np.where(p >= 0.5, odds[1], odds[0]))
                for at in range(0, len(hit), 64):
                    rows = hit[at : at + 64]
                    some = part.take(pa.array(rows))
                    buf, off = K.utf8(some)
                    r, c, x = features(buf, off, _stats(buf, off), config.dims)
                    cut = np.searchsorted(r, np.arange(len(rows) + 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(draw[i + rows] / np.where(p[rows] >= 0.5, odds[1], odds[0])),
                            pa.array(p[rows]),
                            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(c, pa.int32())),
                            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.float32())),
                        ],
                        ["u", "y", "c", "x"],
                    )

    draw = (F.xxhash64(F.lit(config.seed), "t").cast("double") / F.lit(2.0**64) + 0.5).alias("draw")
    rows = texts.where(F.length("t") > 0).select("t", draw).mapInArrow(sample, "u double, y double, c array<int>, x array<float>")
    picked = rows.orderBy("u", "y", F.xxhash64("c")).limit(config.train_rows).toPandas()
    if not len(picked):
        return Model(config, prior, rate, np.zeros(config.dims + 1))
    size = picked["c"].map(len).to_numpy()
    weights = fit(
        np.repeat(np.arange(len(picked)), size),
        np.concatenate(picked["c"].to_list()).astype(np.int64),
        np.concatenate(picked["x"].to_list()).astype(float),
        picked["y"].to_numpy(),
        # undoes the draw's bias towards the rarer class, by half: the scorer should see many kinds of bad text yet keep the common good
        np.where(picked["y"] >= 0.5, 1 / odds[1], 1 / odds[0]) ** 0.5,
        config.dims,
        config.steps,
    )
    return Model(config, prior, rate, weights)


def judged(model: Model):
    """An Arrow function: text -> struct(pattern, posterior, score)."""

    @F.arrow_udf("pattern int, posterior double, score double")
    def judge(text: pa.Array) -> pa.Array:
        p, q, s = model.judge(text)
        return pa.StructArray.from_arrays([pa.array(p, pa.int32()), pa.array(q), pa.array(s)], ["pattern", "posterior", "score"])

    return judge.asNondeterministic()  # or else a filter on its result makes Spark evaluate it twice


def keep_good(docs: DataFrame, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    model = train(docs, text_col, config)
    name = free_name(docs, "judged")
    out = docs.withColumn(name, judged(model)(text_or_empty(F.col(f"`{text_col}`"))))
    return out.where(F.col(f"{name}.score") >= config.threshold).select(*[f"`{c}`" for c in docs.columns])


def classify(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, score, posterior, good_votes, bad_votes) of every document that is accepted."""
    model = train(docs, "text", config)
    j = docs.select("doc_id", judged(model)(text_or_empty(F.col("text"))).alias("j")).where(F.col("j.score") >= config.threshold)
    digit = [F.floor(F.col("j.pattern") / int(b)) % 3 for b in _BASE]

    def tally(k):
        return sum((F.when(d == k, 1).otherwise(0) for d in digit[1:]), F.when(digit[0] == k, 1).otherwise(0))

    return j.select("doc_id", F.col("j.score").alias("score"), F.col("j.posterior").alias("posterior"), tally(GOOD).alias("good_votes"), tally(BAD).alias("bad_votes"))

"""Document fingerprints by consistent weighted sampling (operator 7).

A document is a weighted set of terms (lower case, parted at everything but letters and digits; the weight is how often
the term occurs). For each of ``samples`` and each term of weight S, the improved scheme takes r, c ~ Gamma(2, 1) and
b ~ Uniform(0, 1), fixed by the term and the sample alone, and forms

    t = floor(ln S / r + b),  ln a = ln c - r (t - b + 1),

and the sample is (term, t) of least ln a. Two documents agree in a sample with probability equal to their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the larger.

The gamma variates are made once per distinct term of a batch, and ln a once per distinct term and weight, so the work in
a document is only to gather and to take minima. Ties in ln a go to the smaller term hash.

Defined results: a text without terms, or null, has a null signature; repeated rows have equal signatures; very long texts
are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._util import chunks


@dataclass(frozen=True)
class Config:
    samples: int = 64
    seed: int = 7


def variates(term: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b), each [term, sample] float32; r and c are sums of two exponentials, which is Gamma(2, 1)."""
    lane = K.mix(np.arange(samples, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    h = K.mix(term[:, None] ^ lane)

    def uniforms(h):
        return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24), (
            ((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)
        ) * np.float32(2.0**-24)

    u1, u2 = uniforms(h)
    h = K.mix(h + np.uint64(0x632BE59BD9B4E019))
    u3, u4 = uniforms(h)
    b = (K.mix(h + np.uint64(0x9E6C63D0676A9A99)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
    return -np.log(u1 * u2), np.log(-np.log(u3 * u4)), b


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as uint32 in the same order."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000))


def signatures(term: np.ndarray, weight: np.ndarray, bounds: np.ndarray, c: Config) -> np.ndarray:
    """[row, sample] uint64 of rows of distinct terms (hashes) and their weights; rows without terms have zeros."""
    out = np.zeros((len(bounds) - 1, c.samples), np.uint64)
    if not len(term):
        return out
    kinds, of = np.unique(np.rec.fromarrays([term, weight]), return_inverse=True)
    of = of.ravel()
    terms, first = np.unique(kinds["f0"], return_inverse=True)
    weights = np.log(kinds["f1"].astype(np.float32))
    r, lnc, b = (np.empty((len(terms), c.samples), np.float32) for _ in range(3))
    for i in range(0, len(terms), 8192):
        r[i : i + 8192], lnc[i : i + 8192], b[i : i + 8192] = variates(terms[i : i + 8192], c.samples, c.seed)
    key = np.empty((len(kinds), c.samples), np.uint64)
    t = np.empty((len(kinds), c.samples), np.float32)
    for i in range(0, len(kinds), 8192):
        e = slice(i, i + 8192)
        f = first[e]
        t[e] = np.floor(weights[e, None] / r[f] + b[f])
        a = lnc[f] - r[f] * (t[e] - b[f] + 1)
        key[e] = (_ordered(a).astype(np.uint64) << np.uint64(32)) | np.arange(i, i + len(f), dtype=np.uint64)[:, None]
    some = np.flatnonzero(np.diff(bounds) > 0)
    # rows in groups, so that what is gathered stays small
    size = np.diff(bounds)[some]
    at = 0
    while at < len(some):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 16384, "right")) + at)
        rows = some[at:upto]
        lo, hi = bounds[rows[0]], bounds[rows[-1] + 1]
        best = np.minimum.reduceat(key[of[lo:hi]], bounds[rows] - lo, axis=0) & np.uint64(0xFFFFFFFF)
        best = best.astype(np.int64)
        lane = np.arange(c.samples)
        out[rows] = K.mix(kinds["f0"][best] + K.mix(t[best, lane].astype(np.int64).view(np.uint64) + np.uint64(1)))
        at = upto
    return out


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, weight, bounds) of each row's distinct terms."""
    buf, off = K.utf8(text)
    start, end, b = K.words(buf, off, K.BREAK)
    h = K.word_hashes(buf, start, end)
    row = np.repeat(np.arange(len(b) - 1), np.diff(b))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.r_[new, len(h)]).astype(np.float64), np.searchsorted(row[new], np.arange(len(b)))


def fingerprints(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, terms, signature) of every row: the number of distinct terms and the samples as longs."""

    def run(batches):
        for batch in batches:
            for i, n in chunks(batch.column(1), 2_000_000):
                h, w, b = terms(batch.column(1).slice(i, n))
                sig = signatures(h, w, b, config)
                size = np.diff(b)
                flat = pa.array(sig.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * config.samples), flat, mask=pa.array(size == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(size, pa.int32()), lists], ["doc_id", "terms", "signature"])

    low = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), low.alias("low")).mapInArrow(run, f"doc_id {kind}, terms int, signature array<long>")


def similarity(a, b):
    """Column: the estimate of the generalised Jaccard similarity of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)

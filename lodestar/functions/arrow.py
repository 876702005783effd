"""Text functions that need a loop over two strings: Arrow functions, a batch of rows at a time."""

from __future__ import annotations

import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NEIGHBOURS


def lcs_length(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def keyboard_distance(a: str, b: str, guarded: bool = True) -> int:
    """Edit distance where an insertion or deletion costs 2 and a substitution 2, or 1 by a touching key; the borders cost 1.

    ``guarded``: texts of over 64 characters or of very unequal length get the plain distance instead.
    """
    if not a or not b:
        return len(a) + len(b)
    if guarded:
        gap = abs(len(a) - len(b))
        if gap > (len(a) + len(b)) // 2 + 2:
            return gap
        if max(len(a), len(b)) > 64:
            return levenshtein(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        touch = NEIGHBOURS.get(x.lower(), ())
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 2, row[j - 1] + 2, last + (0 if x == y else 1 if y.lower() in touch else 2))
    return row[-1]




def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub("c+", "c", re.sub("v+", "v", _shape(stem)))))


def _shape(w: str) -> str:
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of an English word by Porter's algorithm (1980)."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for old, new in sorted((x.split(":") for x in table), key=lambda p: -len(p[0])):
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def bpe(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """Merge pairs by the rule of lowest index, leftmost first, until none applies."""
    parts, rank = list(word), {m: i for i, m in enumerate(merges)}
    while len(parts) > 1:
        best, at = min((rank.get((a, b), len(merges)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == len(merges):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def segment(query: str, points: dict[str, int], longest: int = 10) -> list[str]:
    """Parts from the left, each the run of most points, a longer one before a shorter; one character where no run has any."""
    out, i = [], 0
    while i < len(query):
        runs = [query[i:e] for e in range(min(len(query), i + longest), i, -1)]
        part = max(runs, key=lambda r: points.get(r, 0))
        out.append(part if points.get(part, 0) else query[i])
        i += len(out[-1])
    return out


def scramble(q: str, t: str, guard: int = 4) -> int:
    """Up to 300 by the share of the query's characters that the target has, whatever their order.

    Where an ASCII character of the query isn't in the target, 0.6 of 120 times the share of distinct characters, from half of them on. Else 250 times
    the share, and half the coverage of the target more, from 0.9 on; 200 and 0.3 from 0.7; 150 from 0.5; 100 from 0.3; 80 below.
    Queries over ``guard`` times the target's length get 0; with a guard of 4, those of over 32 characters go by their pairs.
    """
    if not q or not t or len(q) > guard * len(t):
        return 0
    whole = lambda x: math.floor(round(x, 4))  # noqa: E731  takes back what binary fractions lose
    if guard == 4 and len(q) > 32:
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (q, t))
        share = len(x & y) / len(x | y) if x and y else 0.0
        return whole(220 * share) if share >= 0.4 else 0
    a, b = set(q), set(t)
    if any(c < "\x80" for c in a - b):
        share = len(a & b) / len(a)
        return whole(0.6 * whole(120 * share)) if share >= 0.5 else 0
    shared = sum(min(q.count(c), t.count(c)) for c in a & b)
    r, cover = shared / len(q), shared / len(t)
    points = 250 * r * (1 + cover * 0.5) if r >= 0.9 else 200 * r * (1 + cover * 0.3) if r >= 0.7 else 150 * r if r >= 0.5 else 100 * r if r >= 0.3 else 80 * r
    return min(300, whole(points))


def scrambled_udf(guard: int = 4):
    """The best scramble of a query among several texts."""

    @F.arrow_udf(T.IntegerType())
    def run(q: pa.Array, *texts: pa.Array) -> pa.Array:
        score = cache(lambda a, b: scramble(a, b, guard))  # equal pairs of a batch are scored once
        return pa.array([max(score(x or "", t or "") for t in row) for x, *row in zip(q.to_pylist(), *(t.to_pylist() for t in texts))], pa.int32())

    return run


def _pair(f, kind):
    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        value = cache(f)  # equal pairs of a batch are compared once
        return pa.array([value(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run


lcs_udf = _pair(lcs_length, T.IntegerType())
keyboard_distance_udf = _pair(keyboard_distance, T.IntegerType())
plain_keyboard_distance_udf = _pair(lambda a, b: keyboard_distance(a, b, guarded=False), T.IntegerType())


@F.arrow_udf(T.StringType())
def porter_udf(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else porter(w) for w in words.to_pylist()], pa.string())


def bpe_udf(merges: list[tuple[str, str]]):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else bpe(w, merges) for w in words.to_pylist()], pa.list_(pa.string()))

    return run


@F.arrow_udf(T.ArrayType(T.StringType()))
def segment_udf(queries: pa.Array, runs: pa.Array, points: pa.Array) -> pa.Array:
    rows = zip(queries.to_pylist(), runs.to_pylist(), points.to_pylist())
    return pa.array([segment(q or "", dict(zip(r or (), p or ()))) for q, r, p in rows], pa.list_(pa.string()))


def hash_embed(text: str | None, dims: int = 512) -> list[float]:
    """Signed character-trigram counts by a fixed hash, unit length: a stand-in for a model behind the same port."""
    import zlib

    v = [0.0] * dims
    t = f"  {(text or '').lower()} "
    for i in range(len(t) - 2):
        h = zlib.crc32(t[i : i + 3].encode())
        v[h % dims] += 1.0 if h >> 31 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hash_embedder(texts: pa.Array) -> pa.Array:
    return pa.array([hash_embed(t) for t in texts.to_pylist()], pa.list_(pa.float32()))

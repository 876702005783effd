"""Text functions against plain Python on random and hand-made strings."""

from __future__ import annotations

import math
import random

import pytest
from lodestar.functions import arrow as A
from lodestar.functions import text as X
from pyspark.sql import functions as F


def strings(n=400, seed=1):
    rng = random.Random(seed)
    out = [("", ""), ("a", ""), ("", "b"), ("abc", "abc"), ("größe", "grösse"), ("北京", "北京大学")]
    while len(out) < n:
        b = "".join(rng.choice("abcdeqws ") for _ in range(rng.randint(0, 9)))
        a = "".join(c for c in b if rng.random() < 0.6) if rng.random() < 0.5 else "".join(rng.choice("abcdeqws ") for _ in range(rng.randint(0, 6)))
        out.append((a, b))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(strings())], "i int, a string, b string")


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def bigrams(a, b):
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def walk(q, t):
    at, out = 0, []
    for ch in q:
        p = t.find(ch, at)
        out.append(p)
        if p >= 0:
            at = p + 1
    return out


def contained(q, t):
    return sum(p >= 0 for p in walk(q, t)) / len(q) if q else 0.0


def subsequence(q, t):
    if not q or not t or -1 in walk(q, t):
        return 0
    last, streak, score = -1, 0, 0
    for p in walk(q, t):
        if p == last + 1:
            streak += 1
            score += 30 * streak
        else:
            streak = 0
            score += 15 - (min(20, 3 * (p - last - 1)) if last >= 0 else 0)
        last = p
    return max(50, score)


def continuity(q, t):
    places = walk(q, t)
    if not q or -1 in places:
        return 0
    slack = len(t) - len(q)
    return 49 if slack == 0 else math.floor(49 * (1 - (places[-1] - places[0] + 1 - len(q)) / slack))


def overlap(q, t):
    return sum(min(q.count(c), t.count(c)) for c in set(q))


def gaussian(q, t):
    n = min(len(q), len(t), 3)
    return sum(math.exp(-X.key_distance(x, y) ** 2 / 8) for x, y in zip(q[:n], t[:n])) / n if n else 1.0


def typing(q):
    return math.prod(math.exp(-X.grid_distance(x, y) ** 2 / 4.5) for x, y in zip(q, q[1:]))


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (lambda a, b: X.jaccard(a, b), jaccard),
        (lambda a, b: X.ngram_jaccard(a, b), bigrams),
        (lambda a, b: X.contain_ratio(a, b), contained),
        (lambda a, b: X.subsequence_score(a, b), subsequence),
        (lambda a, b: X.continuity(a, b), continuity),
        (lambda a, b: X.is_subsequence(a, b), lambda q, t: bool(q and t) and -1 not in walk(q, t)),
        (lambda a, b: X.disorder(a, b), lambda q, t: bool(q) and set(q) <= set(t)),
        (lambda a, b: X.multiset_overlap(a, b), overlap),
        (lambda a, b: X.gaussian_factor(a, b), gaussian),
        (lambda a, b: X.typing_factor(a), lambda q, t: typing(q)),
        (lambda a, b: X.adjacent_swap(a, b), lambda q, t: any(q[:i] + q[i + 1] + q[i] + q[i + 2 :] in t for i in range(len(q) - 1))),
        (lambda a, b: X.edit_distance(a, b), lambda q, t: abs(len(q) - len(t)) if abs(len(q) - len(t)) > (len(q) + len(t)) / 2 + 2 else A.levenshtein(q, t)),
        (lambda a, b: A.lcs_udf(a, b), A.lcs_length),
        (lambda a, b: A.keyboard_distance_udf(a, b), A.keyboard_distance),
    ],
)
def test_pairs(pairs, column, plain):
    got = pairs.select("a", "b", column(F.col("a"), F.col("b")).alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx(plain(r.a, r.b), abs=1e-9), (r.a, r.b)


def brute_lcs(a, b):
    if not a or not b:
        return 0
    return 1 + brute_lcs(a[:-1], b[:-1]) if a[-1] == b[-1] else max(brute_lcs(a[:-1], b), brute_lcs(a, b[:-1]))


def test_loops():
    for a, b in strings(120, 2):
        assert A.lcs_length(a[:6], b[:6]) == brute_lcs(a[:6], b[:6])
    assert A.levenshtein("kitten", "sitting") == 3
    assert A.keyboard_distance("cat", "cst") == 1 and A.keyboard_distance("cat", "cpt") == 2 and A.keyboard_distance("", "abc") == 3
    assert A.bpe("lower", [("l", "o"), ("e", "r"), ("lo", "w")]) == ["low", "er"] and A.bpe("", []) == []
    assert A.segment("redblueox", {"red": 900, "redb": 300, "blue": 900, "ox": 200}) == ["red", "blue", "ox"] and A.segment("zred", {"red": 200}) == ["z", "red"]
    assert [A.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "conditional")] == ["caress", "poni", "relat", "hop", "sky", "condit"]
    v = A.hash_embed("some text")
    assert len(v) == 512 and sum(x * x for x in v) == pytest.approx(1) and A.hash_embed("some text") == v


def one(spark, column, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).head()[0]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (X.full_normalize, "  Ｈｅｌｌｏ​　World \x07 ", "hello world"),
        (X.full_normalize, None, ""),
        (X.sanitize, "a", None), (X.sanitize, "x" * 41, None), (X.sanitize, "!!??", None), (X.sanitize, "1001", None), (X.sanitize, "2345", "2345"), (X.sanitize, "aaaaaa", None), (X.sanitize, "map app", "map app"), (X.sanitize, "a\x01b", None),
        (X.sanitize_reason, "", "empty"), (X.sanitize_reason, "a", "too_short"), (X.sanitize_reason, "y" * 41, "too_long"), (X.sanitize_reason, "...", "no_alnum_or_cjk"), (X.sanitize_reason, "ab\x02", "control_chars"), (X.sanitize_reason, "aaab", "repetition_too_high"), (X.sanitize_reason, "good query", None), (X.sanitize_reason, "北京", None),
        (X.t9, "Map 2", "6272"), (X.t9, "北京ab", "22"), (X.soundex, "Robert", "R163"), (X.soundex, "Rupert", "R163"), (X.soundex, "", "0000"), (X.initials, " bei jing  da ", "bjd"), (X.latin_name, "北京 Map-2", "map2"),
        (X.input_language, "2345", "NUMERIC_T9"), (X.input_language, "北京", "CHINESE"), (X.input_language, "a北", "MIXED"), (X.input_language, "abc", "ENGLISH"), (X.is_short, "a b", True), (X.is_short, "abc", False), (X.compress_runs, "aaaaabb", "aaabb"), (X.mode_count, "abca", 2),
    ],
)
def test_values(spark, column, value, want):
    assert one(spark, column, value) == want


def test_languages(spark):
    know = ["bei", "jing"]
    for q, want in (("北京", "zh"), ("bei jing", "pinyin"), ("hello", "en"), ("北a", "mixed"), ("", "unknown"), ("123", "unknown")):
        assert one(spark, lambda c: X.detect_language(c, know), q) == want


def test_syllables(spark):
    df = spark.createDataFrame([("bj", ["bei", "jing"], 2), ("beij", ["bei", "jing"], 2), ("jing", ["bei", "jing"], 1), ("bx", ["bei", "jing"], 0), ("", ["a"], 0)], "q string, s array<string>, want int")
    assert all(r.got == r.want for r in df.select("want", X.syllable_match(F.col("q"), F.col("s")).alias("got")).collect())


def test_unique_strings(spark):
    df = spark.createDataFrame([(["Map", " map ", "", "Chat", "CHAT", "x"],)], "a array<string>")
    assert df.select(X.unique_strings(F.col("a"))).head()[0] == ["Map", "Chat", "x"]

"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, columns of clashing names."""

from __future__ import annotations

import random

NAMES = "doc_id long, text string, lang string, source string, n_chars long, uid long, nth int, score double, shard long, key string, `row` int, `rank` string, judged string, cleaned string, copies int, p double, node long, comp long"
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """``n`` words in sentences, different for each seed."""
    rng = random.Random(seed)
    vowels, rest = "aeiou", "bcdfglmnprstv"
    stop = ["the", "of", "and", "to", "in", "is", "that", "it"]
    out = []
    while len(out) < n:
        size = rng.randint(6, 14)
        words = [rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(2, 4))) for _ in range(size)]
        words[0], words[-1] = words[0].capitalize(), words[-1] + "."
        out += words
    return " ".join(out[:n])


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)"""
    long = prose(99, 30_000)
    texts = [None, "", " \n\t ", "a", "Größe naïve 東京 \U0001f600", prose(1, 120), prose(1, 120), prose(2, 80), long, "x" * 300_000, prose(3, 60)]
    out = [(i, t, "en", "web" if i % 2 else "books", len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], out[0], out[1]]  # repeated rows
    out += [(None, prose(4, 70), None, None, None), (None, None, None, None, None), (7, prose(5, 70), "en", "web", 1)]  # null and shared ids
    return out


def wide(spark, data=None):
    """The rows with more columns, which are called as the operators might call theirs."""
    data = rows() if data is None else data
    more = (None, 1, 0.5, None, "k", 2, "r", None, "c", 3, None, 4, None)
    return spark.createDataFrame([r + more for r in data], NAMES)


def plain(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, PLAIN)


def swapped(spark, words: int = 80):
    """Rows of string ids that differ only in which column is null."""
    t = prose(1, words)
    return spark.createDataFrame([(t, None, "a"), (None, t, "a"), ("a", t, None), (None, None, "a"), ("", "", ""), (None, "", None)], "doc_id string, text string, source string")

"""Whole-batch text kernels: words and their hashes from UTF-8 bytes, without a Python loop over rows or words."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Anything that isn't an ASCII letter or digit parts words here; bytes from 128 up belong to letters.
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, end to end, and the row bounds; a null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    if not len(text) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(text.buffers()[2], np.uint8, off[-1] - off[0], off[0]), off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): byte ranges of the words, and where each row's words begin in them."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~breaks[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(buf)]
    opens[edge] = inside[edge]
    shuts = inside.copy()
    shuts[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    shuts[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A uint64 per word that depends on its bytes alone."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    if not size.all():  # reduceat can't do empty words; theirs is the hash of nothing
        out = np.full(len(size), mix(np.zeros(1, np.uint64))[0])
        out[size > 0] = word_hashes(buf, start[size > 0], end[size > 0])
        return out
    total = int(size.sum())
    first = np.cumsum(size) - size
    place = np.arange(total, dtype=np.int64) - np.repeat(first, size)
    at = place + np.repeat(start, size)
    turn = (place >> 8).astype(np.uint64)  # words of over 256 bytes: each round of places gets other weights
    value = (_BYTE[buf[at]] ^ (turn * np.uint64(0x9E3779B97F4A7C15))) * _PLACE[place & 255]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words and the row bounds in them; a row of fewer words, but any, has one of them all."""
    count = np.diff(bounds)
    n = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    row = np.repeat(np.arange(len(n)), n)
    at = bounds[row] + np.arange(out_bounds[-1]) - out_bounds[row]
    acc = np.zeros(len(at), np.uint64)
    stop = bounds[row + 1]
    for j in range(k):
        p = at + j
        ok = p < stop
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, h[np.minimum(p, len(h) - 1)], np.uint64(j + 1))
    return mix(acc), out_bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in order of value, and their bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(bounds)))


def row_min(values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """The minimum of each row's values (along axis 0), ``empty`` for rows without any."""
    count = np.diff(bounds)
    out = np.full((len(count),) + values.shape[1:], empty, values.dtype)
    some = count > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, bounds[:-1][some], axis=0)
    return out


def row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Letters and digits of any script, parted at everything else; one apostrophe or hyphen between two of them belongs to the word.
WORD = re.compile(r"[^\W_]+(?:['\u2019-][^\W_]+)*")
_PIECE = 4_000_000  #: a longer text is read in parts
_GROUP = 100_000  #: characters that are read at once, so that what is made of them stays in the cache


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for letters and digits, 2 for what joins them, 0 for others; and a hash of it without its letter case."""
    every = "".join(map(chr, range(0x110000)))
    kind, small = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64)
    for m in re.finditer(r"[^\W_]+", every):
        kind[m.start() : m.end()] = 1
        for c in m.group():
            low = c.casefold()
            if low != c and len(low) == 1:
                small[ord(c)] = ord(low)
    kind[[ord(c) for c in "'\u2019-"]] = 2
    return kind, mix(small + np.uint64(0x9E3779B97F4A7C15))


def small(text: str) -> str:
    """The text without difference of letter case, one character at a time, so that its characters stay as many."""
    return text.lower() if text.isascii() else "".join(x if len(x := c.casefold()) == 1 else c for c in text)


def _pieces(texts: list[str]):
    """(row, first character, part) of the texts; those that are too long for one go are parted where no word is."""
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > _PIECE:
            gap = re.compile(r"[^\w'\u2019-]").search(text, at + _PIECE)
            if not gap:
                break
            yield row, at, text[at : gap.end()]
            at = gap.end()
        yield row, at, text[at:] if at else text


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds) of the words (:data:`WORD`) of each text, in its characters; letter case makes no difference to a hash.

    Letter case goes one character at a time, so a word has one hash wherever it stands.
    """
    kind, value = _characters()
    parts = [[], [], [], []]
    group, held = [], 0

    def flush():
        joined = "\n".join(t for _, _, t in group)
        cp = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = kind[cp]
        solid = k == 1
        inside = solid.copy()
        if len(k) > 2:
            inside[1:-1] |= (k[1:-1] == 2) & solid[:-2] & solid[2:]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum([0] + [len(t) + 1 for _, _, t in group])[:-1]
        which = np.searchsorted(first, start, side="right") - 1
        h = np.zeros(0, np.uint64)
        if len(start):
            size = end - start
            lead = np.cumsum(size) - size
            place = np.arange(int(lead[-1] + size[-1])) - np.repeat(lead, size)
            v = value[cp[inside]]
            if int(size.max()) > 256:
                v ^= (place >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                place &= 255
            v *= _PLACE[place]
            h = mix(np.add.reduceat(v, lead) + size.astype(np.uint64))
        shift = np.array([at for _, at, _ in group], np.int64) - first
        for x, y in zip(parts, (h, start + shift[which], end + shift[which], np.array([r for r, _, _ in group], np.int64)[which])):
            x.append(y)

    for piece in _pieces([t or "" for t in texts]):
        if group and held + len(piece[2]) > _GROUP:
            flush()
            group, held = [], 0
        group.append(piece)
        held += len(piece[2]) + 1
    if group:
        flush()
    if not parts[0]:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, np.zeros(len(texts) + 1, np.int64)
    h, start, end, row = (np.concatenate(x) for x in parts)
    return h, start, end, np.searchsorted(row, np.arange(len(texts) + 1))


def rows_with(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, in how many rows it occurs) of the hashes, each once."""
    found, counts = [], []
    row = 0
    while row < len(bounds) - 1:
        # a table of rows by distinct hashes marks what occurs; a few rows at a time, so that it stays small
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + 20_000, side="right")) - 1)
        to = min(to, row + 64)
        code, distinct_ = pd.factorize(h[bounds[row] : bounds[to]])
        if len(code):
            mark = np.zeros((to - row, len(distinct_)), bool)
            mark[np.repeat(np.arange(to - row), np.diff(bounds[row : to + 1])), code] = True
            found.append(distinct_)
            counts.append(mark.sum(axis=0))
        row = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, distinct_ = pd.factorize(np.concatenate(found))
    return distinct_, np.bincount(code, np.concatenate(counts)).astype(np.int64)

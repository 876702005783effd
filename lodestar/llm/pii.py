"""Information-theoretic sanitisation of personal data (operator 3).

Protected entities are the values that the detectors find: mail and network addresses, telephone, card, account and
social security numbers, secrets. What a term t tells about an entity e is their pointwise mutual information over the
documents of the whole corpus, PMI(t; e) = ln(n(t, e) N / (n(t) n(e))), out of IC(e) = ln(N / n(e)), all there is to know:
``PMI / IC`` is 1 where t occurs only with e. n(t, e), as n(t), counts whole documents (or, with ``window``, those with t
within so many words of e). An entity
tells all about itself, so its mentions are always generalised to their kind, "[EMAIL]". Other terms from ``generalise``
up are replaced by their shape ("[NAME]", "[NUMBER]", "[WORD]") wherever they occur, from ``remove`` up they are removed.

The pairs of an entity that occurs in ``support`` different surroundings count with ``support`` documents and as many
different surroundings: in copies of one passage every word accompanies the entity, which says nothing about the words.
Surroundings are the neighbours of the term and of the entity; at least half of the pair's documents must differ in them.
Most values are rarer than that, in one document or in copies of one. Their pairs count from one document on, but on such
thin evidence only a ratio from ``remove`` up discloses, so in general that of a term that occurs nowhere without the entity,
and it counts as ``generalise``: the term's shape stays.

A term is a word in any letter case, known by a 64-bit hash of its letters without case, one character at a time; one kernel reads
all texts whole, whether terms are counted or replaced and however many they are. Up to ``ship`` disclosing terms go to the
workers; more are joined by hash, of which a table of ``marks`` bits at most lets through all that disclose and few others. Texts and lines that can't hold an entity
are told apart by one linear expression (``CANDIDATE``), which matches wherever a detector does.

Defined results: null texts stay null and empty ones empty; texts without findings stay as they are, byte for byte;
repeated rows count as documents; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._util import chunks, cut, free_name


@dataclass(frozen=True)
class Config:
    window: int | None = None  #: words to either side of a value that n(t, e) counts; None: its document's, as n(t) does
    support: int = 5
    generalise: float = 0.85
    remove: float = 0.98
    frequent: int = 200_000  #: so many of the most frequent terms and entities are known where pairs are made
    ship: int = 200_000  #: up to so many disclosing terms go to the workers with the code; more are joined, with the same result
    marks: int = 2**26  #: bits at most of the table that tells which words are worth joining


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
KINDS = {
    "EMAIL": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "SECRET": r"(?<!\w)(?i:(?:access[_-]?|auth[_-]?)?token|secret|passw(?:or)?d|passwd|api[_-]?key|secret[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?(?P<value>[^\s\"',;]{6,})",
    "KEY": r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|xox[abps]-[\w-]{10,}|(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,})(?!\w)",
    "IBAN": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "CARD": r"(?<![\w.+-])(?:\d{12,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}(?:(?P=gap)\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "PHONE": r"(?<![\w.])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|\.\d)",
    "IP": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "IPV6": r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
#: A text that this doesn't match has no entity; it spares such texts the detectors. Python's engine alone reads it, so that
#: digits and letter case mean the same as in ENTITY.
HINT = re.compile(r"[\d@]|AKIA|gh[pousr]_|sk-|xox[abps]-|[0-9a-fA-F]:[0-9a-fA-F]|(?i:token|secret|passwd|password|key)[\"']?[ \t]*[=:]")
#: The same for whole columns, in linear time: each detector without what surrounds a value, and shorter.
CANDIDATE = (
    r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]|(?i:token|secret|passwd|password|key)[\"']?[ \t]*[=:][ \t]*[\"']?[^ \t\n\r\f\"',;]{6}"
    r"|AKIA[0-9A-Z]{16}|(?:gh[pousr]_|sk-)[^ \t\n\r\f]{20}|xox[abps]-[^ \t\n\r\f]{10}|[0-9a-fA-F]{32}|[A-Z]{2}\p{Nd}{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}"
    r"|\p{Nd}{12}|\p{Nd}{4}[ -]\p{Nd}{4}[ -]\p{Nd}{4}|\p{Nd}{4}[ -]\p{Nd}{6}[ -]\p{Nd}|\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"
    r"|\+\p{Nd}{1,3}[ .-]?\(?\p{Nd}|\(\p{Nd}{3}\) ?\p{Nd}{3}|\p{Nd}{3}[.-]\p{Nd}{3}[.-]\p{Nd}{4}|(?:\p{Nd}{1,3}\.){3}\p{Nd}|(?:[0-9a-fA-F]{1,4}:){7}"
)
#: No value goes on beyond the end of a line or a full stop before a space, and none looks further.
_LINE = re.compile(r"\n|\.(?= )")
WORD = K.WORD


def _detected(text: str, shift: int = 0) -> list[tuple[int, int, str]]:
    out = []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m.group(k) is not None)
        s, e = m.span("value") if kind == "SECRET" else m.span()
        out.append((s + shift, e + shift, "SECRET" if kind == "KEY" else kind))
    return out


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each protected value, in order and without overlaps."""
    return _detected(text) if HINT.search(text) else []


def entities_of(texts: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
    """:func:`entities` of each of the texts that has any, by its place."""
    hit = pc.match_substring_regex(texts, CANDIDATE)
    rows = np.flatnonzero(pc.fill_null(hit, False).to_numpy(zero_copy_only=False))
    row, shift, lines = [], [], []
    for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
        at = 0
        for m in _LINE.finditer(text):
            row.append(i)
            shift.append(at)
            lines.append(text[at : m.end()])
            at = m.end()
        row.append(i)
        shift.append(at)
        lines.append(text[at:])
    out = {}
    if lines:
        for i in np.flatnonzero(pc.match_substring_regex(pa.array(lines, pa.large_string()), CANDIDATE).to_numpy(zero_copy_only=False)).tolist():
            if found := _detected(lines[i], shift[i]):
                out.setdefault(row[i], []).extend(found)
    return out


def _hash(names: list[str]) -> np.ndarray:
    buf, off = K.utf8(pa.array(names, pa.string()))
    return K.word_hashes(buf, off[:-1], off[1:]).view(np.int64)


def _terms(words: list[str]) -> np.ndarray:
    """The hashes of terms."""
    return K.folded(words)[0].view(np.int64)


class Frequent:
    """Counts of the most frequent terms and entities: a pair that they rule out isn't made.

    As n(t, e) <= n(e), PMI / IC can reach ``least`` only where n(t) <= n(e) (N / n(e)) ** (1 - least).
    """

    def __init__(self, counts: DataFrame, total: int, c: Config):
        def most(entity: bool):
            t = counts.where((F.col("entity") == entity) & (F.col("n") > 1)).orderBy(F.desc("n")).limit(c.frequent).select("h", "n").toArrow()
            h, n = t["h"].to_numpy(), t["n"].to_numpy()
            order = np.argsort(h)
            return h[order], n[order], int(n.min(initial=total)) if len(n) == c.frequent else 1

        self.terms, self.entities, self.total, self.least = most(False), most(True), total, c.generalise

    @staticmethod
    def _count(h: np.ndarray, table, other: int) -> np.ndarray:
        hashes, n, _ = table
        if not len(hashes):
            return np.full(len(h), other)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, n[at], other)

    def of_terms(self, terms: list[str]) -> np.ndarray:
        """n(t), 0 for those that aren't known."""
        return self._count(_terms(terms), self.terms, 0) if terms else np.zeros(0, np.int64)

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        """:meth:`of_terms` by hash."""
        return self._count(h, self.terms, 0)

    def most(self, entities: np.ndarray) -> np.ndarray:
        """The largest n(t) of a term that can disclose each entity, by hash."""
        n = self._count(entities, self.entities, self.entities[2]).astype(float)
        return n * np.maximum(1.0, self.total / n) ** (1 - self.least) * (1 + 1e-9)


def _read(text: str, found: list[tuple[int, int, str]], window: int | None, frequent: Frequent | None = None) -> Iterator[tuple[str | None, str, str]]:
    """(term, entity, surroundings) once for each term and entity of the text; (None, entity, neighbours) for each entity."""
    terms = [(m.start(), m.end(), K.small(m.group())) for m in WORD.finditer(text)]
    inside, spans = set(), iter(found)
    span = next(spans, None)
    for i, (s, e, _) in enumerate(terms):
        while span and span[1] <= s:
            span = next(spans, None)
        if span and e > span[0]:
            inside.add(i)
    starts = [t[0] for t in terms]
    outside = [i for i in range(len(terms)) if i not in inside]
    first = {}
    for i in outside:
        if len(terms[i][2]) > 2:
            first.setdefault(terms[i][2], i)
    n_t = dict(zip(first, frequent.of_terms(list(first)).tolist())) if frequent else None
    seen, named = set(), set()
    for s, e, _ in found:
        name = text[s:e].lower()
        if window is None and name in named:
            continue
        at, to = bisect_left(starts, s), bisect_left(starts, e)
        a, b = bisect_left(outside, at), bisect_left(outside, to)
        lo, hi = (0, len(outside)) if window is None else (bisect_left(outside, at - window), bisect_left(outside, to + window))
        near = (terms[outside[a - 1]][2] if a > lo else "") + "\0" + (terms[outside[b]][2] if b < hi else "")
        if name not in named:
            named.add(name)
            yield None, name, near
        most = frequent.most(_hash([name]))[0] if frequent else 0
        for i in first.values() if window is None else outside[lo:a] + outside[b:hi]:
            t = terms[i][2]
            if n_t and n_t.get(t, 0) > most:
                continue
            if window is None or (len(t) > 2 and (t, name) not in seen):
                if window is not None:
                    seen.add((t, name))
                yield t, name, f"{near}\0{terms[i - 1][2] if i else ''}\0{terms[i + 1][2] if i + 1 < len(terms) else ''}"


def _mentions(text: str, window: int | None) -> list[tuple[str, str, str]]:
    """(term, entity, surroundings) once for each term and entity of the text."""
    return [row for row in _read(text, entities(text), window) if row[0] is not None]


def _read_whole(texts: list[str], found: list[list[tuple[int, int, str]]], frequent: Frequent, named: bool) -> Iterator[tuple]:
    """What :func:`_read` gives of whole texts, by hash: (terms or None, h, null, entity, context) columns, one block for each entity of a text."""
    h, start, end, bounds = K.folded(texts)
    names = [{text[s:e].lower(): (s, e) for s, e, _ in reversed(some)} for text, some in zip(texts, found)]  # each one's first mention
    entity = _hash(list(chain.from_iterable(names)))
    most, at = frequent.most(entity), 0
    for row, (text, some) in enumerate(zip(texts, found)):
        w, s, e = (x[bounds[row] : bounds[row + 1]] for x in (h, start, end))
        from_, to_ = np.array([x[:2] for x in some]).T
        span = np.searchsorted(to_, s, side="right")
        outside = np.flatnonzero((span == len(to_)) | (e <= from_[np.minimum(span, len(to_) - 1)]))
        long = outside[e[outside] - s[outside] > 2]
        distinct, first = np.unique(w[long], return_index=True)
        first = long[first]
        n_t = frequent.of_hashes(distinct.view(np.int64))
        beside = np.zeros(len(w) + 2, np.uint64)
        beside[1:-1] = w
        for x, y in names[row].values():
            a, b = np.searchsorted(outside, np.searchsorted(s, (x, y)))
            near = beside[[outside[a - 1] + 1 if a else 0, outside[b] + 1 if b < len(outside) else 0]]
            keep = n_t <= most[at]
            i = first[keep]
            # the entity's own row comes first
            left, right = (np.concatenate([np.zeros(1, np.uint64), beside[i + k]]) for k in (0, 2))
            context = K.mix(K.mix(K.mix(K.mix(np.full(len(left), near[0])) + near[1]) + left) + right)
            terms = [None, *(K.small(text[s[k] : e[k]]) for k in i.tolist())] if named else None
            hashes = np.concatenate([np.zeros(1, np.uint64), distinct[keep]])
            yield terms, hashes.view(np.int64), np.arange(len(hashes)) == 0, np.full(len(hashes), entity[at]), context.view(np.int64)
            at += 1


def _pairs(texts: DataFrame, c: Config, frequent: Frequent, named: bool = True) -> DataFrame:
    """(term, h, entity, context) rows, and rows without term and h for each document that holds the entity; not ``named``, without the column term."""

    def near(text, found):
        while rows := list(islice(found, 50_000)):
            terms, names, contexts = zip(*rows)
            null = np.array([t is None for t in terms])
            h = np.zeros(len(rows), np.int64)
            h[~null] = _terms([t for t in terms if t is not None])
            yield list(terms) if named else None, h, null, _hash(list(names)), _hash(list(contexts))

    def blocks(batches):
        for batch in batches:
            for i, n in chunks(batch.column(0)):
                texts = batch.column(0).slice(i, n)
                found = entities_of(texts)
                if not found:
                    continue
                some = texts.take(pa.array(list(found))).to_pylist()
                if c.window is None:
                    yield from _read_whole(some, list(found.values()), frequent, named)
                    continue
                for text, spans in zip(some, found.values()):
                    yield from near(text, _read(text, spans, c.window, frequent))

    def batch_of(held):
        terms, h, null, *more = zip(*held)
        columns = [pa.array(np.concatenate(h), mask=np.concatenate(null)), *(pa.array(np.concatenate(x)) for x in more)]
        if named:
            return pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(terms)), pa.string()), *columns], ["term", "h", "entity", "context"])
        return pa.RecordBatch.from_arrays(columns, ["h", "entity", "context"])

    def run(batches):
        # a document with many entities has as many rows for each of its terms, so rows go out in bounded batches
        held, rows = [], 0
        for block in blocks(batches):
            held.append(block)
            rows += len(block[1])
            if rows >= 50_000:
                yield batch_of(held)
                held, rows = [], 0
        if held:
            yield batch_of(held)

    return texts.mapInArrow(run, "term string, " * named + "h long, entity long, context long")


def _documents_with(texts: DataFrame) -> DataFrame:
    """(entity, h, n): in how many texts (column t) each term and each entity occurs, by hash."""

    def run(batches):
        for batch in batches:
            for i, n in chunks(batch.column(0)):
                texts = batch.column(0).slice(i, n)
                h, _, _, bounds = K.folded(texts.to_pylist())
                names = []
                for row, found in entities_of(texts).items():
                    text = texts[row].as_py()
                    names += {text[s:e].lower() for s, e, _ in found}
                for entity, (k, count) in ((False, K.rows_with(h, bounds)), (True, np.unique(_hash(names), return_counts=True) if names else ([], []))):
                    if len(k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), entity)), pa.array(k.view(np.int64)), pa.array(count, pa.int64())], ["entity", "h", "n"])

    return texts.mapInArrow(run, "entity boolean, h long, n long").groupBy("entity", "h").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(term, h, ratio) of the terms that tell too much about some entity; ratio is the largest PMI / IC, on thin evidence ``generalise``."""
    return _disclosing(docs, text_col, config)[0]


def _disclosing(docs: DataFrame, text_col: str, config: Config, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`disclosing`, not ``named`` without the column term, and the counts of terms and entities."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(text.alias("t"))
    texts = texts.where(F.col("t").isNotNull())
    counts, total = cut(_documents_with(texts)), docs.count()
    rows = _pairs(texts, config, Frequent(counts, total, config), named)
    term = ["term"] if named else []
    least = [F.min(x).alias(x) for x in term]
    stats = cut(rows.groupBy("h", "entity").agg(*least, F.count("*").alias("n"), F.count_distinct("context").alias("contexts")))
    known = stats.where("h is null").select("entity", F.col("n").alias("n_e"), (F.col("contexts") < config.support).alias("thin"))
    enough = (F.col("n_te") >= config.support) & (F.col("contexts") >= config.support) & (2 * F.col("contexts") >= F.col("n_te"))
    pairs = stats.where("h is not null").withColumnRenamed("n", "n_te").join(known, "entity").where(F.col("thin") | enough).select(*term, "h", "n_te", "n_e", "thin")
    n_t = pairs.select("h").distinct().join(counts.where("not entity"), "h").select("h", F.col("n").alias("n_t"))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t").cast("double") * F.col("n_e")))
    ratio = F.when(ic > 0, pmi / ic).otherwise(0.0)  # an entity in every document has nothing left to tell
    counted = F.when(~F.col("thin"), ratio).when(ratio >= config.remove, config.generalise)
    told = pairs.join(n_t, "h").select(*term, "h", counted.alias("ratio"))
    return told.groupBy("h").agg(*least, F.max("ratio").alias("ratio")).where(F.col("ratio") >= config.generalise).select(*term, "h", "ratio"), counts


def _shape(word: str) -> str:
    return "[NUMBER]" if word[:1].isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def _replaced(text: str, found: list[tuple[int, int, str]], hits: list[tuple[int, int, float]], config: Config) -> tuple[str, int, int]:
    """(the text, mentions generalised, terms generalised or removed), by the places of both and the terms' ratios."""
    cuts = [(s, e, f"[{k}]") for s, e, k in found]
    at = 0
    for s, e, ratio in hits:
        while at < len(found) and found[at][1] <= s:
            at += 1
        if at < len(found) and found[at][0] < e:
            continue
        cuts.append((s, e, "" if ratio >= config.remove else _shape(text[s:e])))
    out, last = [], 0
    for s, e, new in sorted(cuts):
        if new == "" and text[e : e + 1] == " " and (s == 0 or text[s - 1].isspace()):
            e += 1  # a removed word takes one of its spaces along
        out += [text[last:s], new]
        last = e
    return "".join(out) + text[last:], len(found), len(cuts) - len(found)


def clean(text: str, tells: dict[str, float] | None = None, config: Config = Config()) -> tuple[str, int, int]:
    """(the text, mentions generalised, terms generalised or removed), by the terms' ratios."""
    words = ((m.start(), m.end(), (tells or {}).get(K.small(m.group()), 0.0)) for m in WORD.finditer(text))
    return _replaced(text, entities(text), [w for w in words if w[2] >= config.generalise], config)


KIND = "text string, entities int, terms int"


def _clean_all(texts: pa.Array, config: Config, ratios, told: set[int] | None = None) -> pa.StructArray:
    """:func:`clean` of each text, null where nothing changes; ``ratios(i, h, bounds)`` gives those of the words of the texts from i on.

    Where it is known which texts have disclosing terms (``told``), words of no other are read.
    """
    new, entity, term = [None] * len(texts), np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    for i, n in chunks(texts):
        some = texts.slice(i, n)
        found = entities_of(some)
        h, start, end, bounds = K.folded(some.to_pylist() if told is None else [some[r].as_py() if i + r in told else None for r in range(n)])
        ratio = ratios(i, h.view(np.int64), bounds)
        hit = np.flatnonzero(ratio >= config.generalise)
        row = np.searchsorted(bounds, hit, side="right") - 1
        hits = {}
        for r, s, e, x in zip(row.tolist(), start[hit].tolist(), end[hit].tolist(), ratio[hit].tolist()):
            hits.setdefault(r, []).append((s, e, x))
        for r in found.keys() | hits.keys():
            new[i + r], entity[i + r], term[i + r] = _replaced(some[r].as_py(), found.get(r, []), hits.get(r, []), config)
            if not entity[i + r] and not term[i + r]:
                new[i + r] = None
    return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(entity), pa.array(term)], ["text", "entities", "terms"])


def _looked_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each hash, 0 for those without; ``keys`` in order."""
    if not len(keys) or not len(h):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def _marked(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those that :func:`_marks` had."""
    h, last = h.view(np.uint64), np.uint64(64 * len(table) - 1)
    out = np.ones(len(h), bool)
    for at in (h & last, (h >> np.uint64(32)) & last):
        out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out


def _marks(found: DataFrame, most: int) -> np.ndarray:
    """A table of bits, two of them set for each h of ``found``: 16 bits for each or more, up to ``most`` in all."""
    bits = max(64, min(1 << (most.bit_length() - 1), 1 << (16 * found.count()).bit_length()))
    places = F.explode(F.array(*(F.expr(f"{x} & {bits - 1}L") for x in ("h", "shiftrightunsigned(h, 32)")))).alias("at")
    words = found.select(places).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _asked(texts: DataFrame, table: np.ndarray, often: np.ndarray) -> DataFrame:
    """(u, h): the words of the texts (u, t) that may disclose something, each once: those marked, and not of the hashes ``often``."""

    def run(batches):
        for batch in batches:
            for i, n in chunks(batch.column(1)):
                h, _, _, bounds = K.folded(batch.column(1).slice(i, n).to_pylist())
                may = _marked(h, table)
                may[may] = ~np.isin(h[may].view(np.int64), often)
                h, bounds = K.distinct(h[may], np.concatenate([[0], np.cumsum(may)])[bounds])
                u = batch.column(0).slice(i, n).take(pa.array(np.repeat(np.arange(n), np.diff(bounds))))
                yield pa.RecordBatch.from_arrays([u, pa.array(h.view(np.int64))], ["u", "h"])

    return texts.mapInArrow(run, "u binary, h long")


def sanitised(docs: DataFrame, text_col: str = "text", config: Config = Config(), id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` and a column more, struct(text, entities, terms), and its name; the struct's text is null where nothing changes."""
    found, counts = _disclosing(docs, text_col, config, named=False)
    found = cut(found.select("h", "ratio"))
    name = free_name(docs, "cleaned")
    text = F.col(f"`{text_col}`").cast("string")
    head = found.limit(config.ship + 1).toArrow()

    if head.num_rows <= config.ship:
        keys = head["h"].to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], head["ratio"].to_numpy()[order]

        @F.arrow_udf(KIND)
        def run(t: pa.Array) -> pa.Array:
            return _clean_all(t, config, lambda i, h, bounds: _looked_up(h, keys, values))

        return docs.withColumn(name, run.asNondeterministic()(text)), name

    # too many terms to ship: each text gets its own by a join. Only words that a table of bits lets through enter it, and none
    # that is frequent and discloses nothing, lest a word let through by chance be a hot key
    often = counts.where("not entity and n > 1").orderBy(F.desc("n"), "h").limit(config.frequent).join(found, "h", "left_anti")
    often = np.sort(often.select("h").toArrow()["h"].to_numpy())

    @F.arrow_udf(KIND)
    def run_own(t: pa.Array, own: pa.Array) -> pa.Array:
        some = set(np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist())

        def ratios(i, h, bounds):
            out = np.zeros(len(h))
            for r in range(len(bounds) - 1):
                if i + r in some:
                    mine = sorted((x["h"], x["ratio"]) for x in own[i + r].as_py())
                    out[bounds[r] : bounds[r + 1]] = _looked_up(h[bounds[r] : bounds[r + 1]], *map(np.array, zip(*mine)))
            return out

        return _clean_all(t, config, ratios, some)

    uid, own = free_name(docs, "uid"), free_name(docs, "own")
    keyed = docs.withColumn(uid, F.unhex(F.md5(text)))
    told = _asked(keyed.select(F.col(uid).alias("u"), text.alias("t")), _marks(found, config.marks), often).join(found, "h")
    told = told.groupBy("u").agg(F.collect_set(F.struct("h", "ratio")).alias("own_"))
    joined = keyed.join(told, keyed[uid] == told["u"], "left").select(keyed["*"], F.col("own_").alias(own))
    return joined.withColumn(name, run_own.asNondeterministic()(text, F.col(own))).drop(uid, own), name


def sanitise(docs: DataFrame, text_col: str = "text", config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the texts sanitised, columns unchanged."""
    out, name = sanitised(docs, text_col, config, id_col)
    return out.select(*[F.coalesce(F.col(f"{name}.text"), F.col(f"`{c}`").cast("string")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text, entities, terms): each document's sanitised text and what was replaced in it."""
    out, name = sanitised(docs, "text", config)
    return out.select("doc_id", F.coalesce(F.col(f"{name}.text"), F.col("text")).alias("text"), F.col(f"{name}.entities").alias("entities"), F.col(f"{name}.terms").alias("terms"))

"""Removal of repeated passages by longest-previous-factor arrays (operator 2).

The corpus is one sequence of words (parted at white space, compared byte for byte), documents in order of doc_id. LPF of a
position is the length of the longest run of words from it that also starts at an earlier position. It is the larger of the
common prefixes with the previous and the next entry of smaller position in suffix order. Words within a run of at least
``words`` words that has an earlier copy go; the first copy stays.

A suffix array of everything would move each suffix of the corpus. Runs of ``words`` words are needed only, so it is
sampled and parted: of the runs of k words within any ``words`` words the one of least hash is an anchor, so that equal
passages have equal anchors at equal places, k = words - window + 1. Suffixes that share an anchor's k words stand together
in suffix order and all longer matches are among them, so each anchor is a shard by itself; anchors that occur once are
dropped before any text moves. A shard is sorted by the words after the anchor. For each start up to window - 1 words before
the anchor, the suffixes that agree up to it form one stretch of the suffix array; their previous and next smaller positions
(by pointer jumping) give the exact LPF at that start, as far as ``words`` words, which is all that the decision needs.

Defined results: null texts stay null, texts of under ``words`` words stay as they are; a null doc_id comes last, equal ones
are ordered by a hash of the text; of rows that repeat doc_id and text, the first counts and the others, from ``words`` words
on, lose the whole text; repeated rows are known by a 128-bit key, in which null isn't empty; runs may overlap their earlier copy within one document; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._util import chunks, free_name, partitions, row_key


@dataclass(frozen=True)
class Config:
    words: int = 50  #: passages from this length on are removed
    window: int = 24  #: larger samples fewer anchors but compares more words around each
    chunk: int = 200_000  #: suffixes sorted at once; a larger shard goes on with one suffix of each kind so far

    @property
    def k(self) -> int:
        return self.words - self.window + 1


def _words(text: pa.Array):
    buf, off = K.utf8(text)
    start, end, b = K.words(buf, off)
    return K.word_hashes(buf, start, end), b, start, end, off


def anchors(h: np.ndarray, b: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position in the row, hash of the k words) of each anchor."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < c.words:
        return none
    gram = np.zeros(len(h) - c.k + 1, np.uint64)
    for j in range(c.k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(gram)]
    gram = K.mix(gram)
    first = len(h) - c.words + 1  # starts of whole windows
    least, at = gram[:first].copy(), np.arange(first)
    for j in range(1, c.window):
        g = gram[j : j + first]
        less = g < least
        least[less] = g[less]
        at[less] = np.flatnonzero(less) + j
    row = np.repeat(np.arange(len(b) - 1), np.diff(b))
    whole = row[:first] == row[c.words - 1 :]
    at = np.unique(at[whole])
    return row[at], at - b[row[at]], gram[at]


def _anchor_rows(docs: DataFrame, c: Config) -> DataFrame:
    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for i, n in chunks(batch.column(1)):
                h, b, *_ = _words(batch.column(1).slice(i, n))
                row, pos, g = anchors(h, b, c)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(uid[i + row]), pa.array(pos, pa.int32())], ["g", "uid", "pos"])

    return docs.select("uid", "text").mapInArrow(run, "g long, uid long, pos int")


def _shards(batches, limit: int):
    """Tables of whole shards (column g) from batches sorted by g, and (table, True) for a part of a shard over ``limit`` rows."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        table = pa.Table.from_batches(held)
        g = table.column("g").to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield table.slice(0, last), False
            table = table.slice(last)
        if table.num_rows >= limit:
            yield table, True
            held, rows = [], 0
        else:
            held, rows = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held), False


def _repeated(rows: DataFrame, n: int) -> DataFrame:
    """The anchors that occur more than once."""

    def run(batches):
        before, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            new = np.r_[before is None or g[0] != before, g[1:] != g[:-1]]
            keep = ~new
            keep[:-1] |= ~new[1:]
            if waiting is not None and not new[0]:
                yield waiting
            waiting = None if keep[-1] else batch.slice(len(g) - 1)
            before = g[-1]
            yield batch.filter(pa.array(keep))

    ordered = rows.repartition(n, "g").sortWithinPartitions("g")
    return ordered.mapInArrow(run, rows.schema)


def _contexts(docs: DataFrame, flags: DataFrame, c: Config) -> DataFrame:
    """(g, ord, uid, pos, near): near has the hashes of the window - 1 words before (nearest first) and after each repeated anchor."""
    by_doc = flags.groupBy("uid").agg(F.collect_set(F.struct("pos", "g")).alias("at"))
    joined = docs.join(by_doc, "uid").select("uid", "ord", "text", F.col("at.pos").alias("pos"), F.col("at.g").alias("g"))
    side = c.window - 1

    def run(batches):
        for batch in batches:
            uid, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, n in chunks(batch.column(2)):
                h, b, *_ = _words(batch.column(2).slice(i, n))
                low = (h >> np.uint64(32)).astype(np.uint32)
                lists = batch.column(3).slice(i, n)
                pos, g = lists.flatten().to_numpy().astype(np.int64), batch.column(4).slice(i, n).flatten()
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                step = np.arange(side)
                at = np.concatenate([(b[row] + pos)[:, None] - 1 - step, (b[row] + pos)[:, None] + c.k + step], axis=1)
                inside = (at >= b[row][:, None]) & (at < b[row + 1][:, None])
                near = low[np.clip(at, 0, max(len(low) - 1, 0))]
                # beyond the text nothing is alike: a hash of the place stands for the word
                alone = K.mix(uid[i + row].view(np.uint64)[:, None] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                near = np.where(inside, near, (alone >> np.uint64(32)).astype(np.uint32))
                for s in range(0, len(row), 20_000):
                    e = slice(s, s + 20_000)
                    block = np.ascontiguousarray(near[e])
                    yield pa.RecordBatch.from_arrays(
                        [
                            g.slice(s, len(block)),
                            pa.array(order[i + row[e]]),
                            pa.array(uid[i + row[e]]),
                            pa.array(pos[e], pa.int32()),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(side * 8), len(block), [None, pa.py_buffer(block.tobytes())]).cast(pa.binary()),
                        ],
                        ["g", "ord", "uid", "pos", "near"],
                    )

    return joined.mapInArrow(run, "g long, ord long, uid long, pos int, near binary")


def previous_smaller(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the nearest entry before each that is smaller, not before ``first`` of it; -1 for none.

    Minima of runs of 2**l entries tell whether a whole run can be skipped; skipping from the longest run down takes one
    step a level. A level is made only for the entries that have so many before them.
    """
    n = len(t)
    at = np.arange(n) - 1
    room = at - first + 1
    top = int(room.max(initial=0)).bit_length()
    minima = [t]
    for level in range(1, top):
        half, low = 1 << (level - 1), minima[-1].copy()
        low[half:] = np.minimum(minima[-1][half:], minima[-1][:-half])
        minima.append(low)
    for level in range(top - 1, -1, -1):
        size = 1 << level
        i = np.flatnonzero(at - first >= size - 1)
        skip = i[minima[level][at[i]] > t[i]]
        at[skip] -= size
    at[at < first] = -1
    return at


def lpf(t: np.ndarray, first: np.ndarray, last: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Longest common prefix with an earlier suffix, -1 where there is none, of suffixes in suffix order.

    ``t``: positions; ``first``, ``last``: ends of each one's stretch; ``after``: the words, one row a suffix.
    """
    n = len(t)
    back = previous_smaller(t, first)
    ahead = n - 1 - previous_smaller(t[::-1], n - 1 - last[::-1])[::-1]
    best = np.full(n, -1)
    for other, some in ((back, back >= 0), (ahead, ahead < n)):
        i = np.flatnonzero(some)
        same = after[i] == after[other[i]]
        best[i] = np.maximum(best[i], np.where(same.all(axis=1), after.shape[1], same.argmin(axis=1)))
    return best


def shard_matches(g: np.ndarray, near: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by shard and position: words before and after the anchor's in runs with earlier copies; -1 for none."""
    side, n = c.window - 1, len(g)
    before, after = near[:, :side], near[:, side:]
    bucket = np.cumsum(np.r_[False, g[1:] != g[:-1]])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((*after.T[::-1], bucket))] = np.arange(n)  # suffix order
    left, right = np.full(n, -1), np.full(n, -1)
    # rows whose stretch has no other row drop out: further words before only part the stretches
    live = np.argsort(rank, kind="stable")
    kind = bucket.astype(np.uint64)[live]
    for o in range(c.window):
        if o:
            kind = K.mix(kind * np.uint64(31) + before[live, o - 1])
        order = np.argsort(kind, kind="stable")
        live, kind = live[order], kind[order]
        edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        size = np.diff(np.r_[edge, len(kind)])
        many = np.repeat(size > 1, size)
        live, kind, size = live[many], kind[many], size[size > 1]
        if not len(live):
            break
        edge = np.cumsum(size) - size
        best = lpf(live, np.repeat(edge, size), np.repeat(edge + size - 1, size), after[live])
        ok = (best >= 0) & (o + c.k + best >= c.words)
        left[live[ok]] = o
        right[live[ok]] = np.maximum(right[live[ok]], best[ok])
    return left, right


def _spans(rows: DataFrame, n: int, c: Config) -> DataFrame:
    """(uid, from, to): word ranges with an earlier copy."""
    side = c.window - 1

    def run(batches):
        reps = None  # of the shard that is under way: one suffix of each kind so far
        before = None
        for table, part in _shards(batches, c.chunk):
            # repeated rows have the same suffixes, which are no earlier copies of themselves; in this order they are neighbours
            key = np.rec.fromarrays([table.column(x).to_numpy() for x in ("g", "uid", "pos")])
            new = np.r_[before is None or key[0] != before, key[1:] != key[:-1]]
            before = key[-1]
            if not new.all():
                table = table.filter(pa.array(new))
                if not table.num_rows:
                    continue
            g = table.column("g").to_numpy()
            near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.uint32).reshape(len(g), 2 * side)
            old = 0
            all_g, all_near = g, near
            if reps is not None and reps[0] == g[0]:
                old = len(reps[1])
                all_g, all_near = np.r_[np.full(old, g[0]), g], np.concatenate([reps[1], near])
            left, right = (x[old:] for x in shard_matches(all_g, all_near, c))
            hit = np.flatnonzero(left >= 0)
            if len(hit):
                pos = table.column("pos").to_numpy()[hit].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table.column("uid").to_numpy()[hit]), pa.array(pos - left[hit], pa.int32()), pa.array(pos + c.k + right[hit], pa.int32())], ["uid", "from", "to"]
                )
            reps = None
            if part:
                _, at = np.unique(all_near, axis=0, return_index=True)
                reps = g[0], all_near[np.sort(at)]

    ordered = rows.repartition(n, "g").sortWithinPartitions("g", "ord", "uid", "pos")
    return ordered.mapInArrow(run, "uid long, `from` int, `to` int")


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words in the (merged) ranges, and how many they are; white space after a removed word goes too."""
    raw = text.encode()
    _, _, start, _, _ = _words(pa.array([text], pa.large_string()))
    gone = np.zeros(len(start) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    bounds = np.r_[0 if not len(start) else start, len(raw)]
    parts = [raw[: bounds[0]]]
    i = 0
    while i < len(start):
        j = i
        while j < len(start) and gone[j] == gone[i]:
            j += 1
        if not gone[i]:
            parts.append(raw[bounds[i] : bounds[j]])
        i = j
    return b"".join(parts).decode(), int(gone.sum())


def cleaned(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, words_removed, uid, more, nth) of every row."""
    c, n = config, partitions(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), key["a"].alias("uid"))
    flags = _repeated(_anchor_rows(rows.select("uid", F.coalesce("text", F.lit("")).alias("text")), c), n)
    # both joins below read this one exchange of the texts
    parted = rows.repartition(n, "uid")
    whole = F.col("doc_id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("doc_id")
    order = F.when(F.col("doc_id").isNull(), F.lit(2**63 - 1)).otherwise(whole).alias("ord")
    spans = _spans(_contexts(parted.select("uid", order, F.coalesce("text", F.lit("")).alias("text")), flags, c), n, c)
    by_doc = spans.groupBy("uid").agg(F.collect_set(F.struct("from", "to")).alias("at"))

    @F.arrow_udf("text string, gone int")
    def drop(text: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        out = [(None, 0) if t is None else _cut(t, list(zip(a, b))) for t, a, b in zip(text.to_pylist(), first.to_pylist(), last.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([m for _, m in out], pa.int32())], ["text", "gone"])

    # the key's other half comes after the exchange, which else would differ from the one that the first join reads
    joined = parted.join(by_doc, "uid", "left").withColumn("more", row_key(F.col("doc_id"), F.col("text"))["b"]).withColumn("nth", F.row_number().over(Window.partitionBy("uid", "more").orderBy("uid")))
    words = F.size(F.regexp_extract_all(F.when(F.col("nth") > 1, F.col("text")), F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0)))
    again = (F.col("nth") > 1) & (words >= c.words)
    hit = F.col("at").isNotNull() & ~again
    new = drop.asNondeterministic()(F.when(hit, F.col("text")), F.when(hit, F.col("at.from")), F.when(hit, F.col("at.to")))
    out = joined.withColumn("new", new).withColumn("again", again).withColumn("n", words)
    text = F.when(F.col("again"), F.lit("")).otherwise(F.coalesce("new.text", "text"))
    removed = F.when(F.col("again"), F.col("n")).when(F.col("at").isNotNull(), F.col("new.gone"))
    return out.select("doc_id", text.alias("text"), removed.alias("words_removed"), "uid", "more", "nth")


def deduplicate(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text, words_removed): every document without the passages that occur before; words_removed is null where none does."""
    return cleaned(docs, config).select("doc_id", "text", "words_removed")


def drop_passages(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with later copies of passages removed from the texts, columns unchanged."""
    uid, nth = free_name(docs, "uid"), free_name(docs, "nth")
    keyed = docs.withColumn(uid, row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(uid).orderBy(uid)))
    new = cleaned(docs, config, text_col, id_col).where("words_removed > 0").select(F.struct(F.col("uid").alias("a"), F.col("more").alias("b")).alias("_u_"), F.col("nth").alias("_n_"), F.col("text").alias("_t_"))
    out = keyed.join(new, (keyed[uid] == new["_u_"]) & (keyed[nth] == new["_n_"]), "left")
    return out.select(*[F.coalesce(new["_t_"], keyed[f"`{c}`"].cast("string")).alias(c) if c == text_col else keyed[f"`{c}`"] for c in docs.columns])

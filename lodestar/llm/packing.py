"""Best-fit packing by linear grouping (operator 6).

Documents go into packs of ``capacity`` characters. A longer document is cut into pieces of the capacity and a rest, so
nothing is lost; whole pieces fill packs of their own. Large pieces (over capacity / ``parts``) are sorted by length and
parted into ``groups`` groups of equal cardinality, whose lengths are rounded up to the largest of the group. For these few
sizes the configurations of a pack are optimised: column generation over the linear program, priced by a knapsack, its
solution rounded down and the few pieces left put first-fit. The actual pieces then take the places of their sizes; since
each is no longer than its place, packs never overflow. Small pieces go best-fit into the room left, each to the pack that
it fills best, or else to new packs.

The driver sees only counts by length, at most ``capacity`` rows. A piece's rank in its length comes from counts of hashed
buckets, so a common length is no hot spot, and best fit runs in shards of about ``shard`` small pieces with their share of
the packs.

Defined results: null and empty texts take no room and are in no pack; every repeated row is packed; a null doc_id is packed
as null; equal lengths are ordered by doc_id, position and text; an empty table gives no packs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut

BUCKETS = 256


@dataclass(frozen=True)
class Config:
    capacity: int = 8192
    parts: int = 8  #: pieces up to capacity / parts are small
    groups: int = 24
    shard: int = 20_000


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs for ``counts`` items of each size: (items of each size in the pack, how many packs alike), covering each item once."""
    k = len(sizes)
    if not k:
        return []
    grid = min(capacity, 1024)
    unit = capacity / grid
    weight = np.maximum(1, np.ceil(sizes / unit - 1e-9).astype(int))
    weight = np.minimum(weight, grid)
    basis = np.diag((grid // weight).astype(float))
    x = counts / np.diag(basis)
    for _ in range(40 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        best, take = np.zeros(grid + 1), np.full(grid + 1, -1)
        for c in range(1, grid + 1):
            fits = weight <= c
            gain = np.where(fits, best[np.maximum(c - weight, 0)] + duals, -1.0)
            i = int(gain.argmax())
            best[c] = best[c - 1]
            if gain[i] > best[c] + 1e-12:
                best[c], take[c] = gain[i], i
        if best[grid] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), grid
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= weight[take[c]]
        way = np.linalg.solve(basis, column)
        ok = way > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, way, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0.0)
        x[out] = step
        basis[:, out] = column
    packs, left = [], counts.astype(int).copy()
    for i in np.argsort(-x, kind="stable"):
        column = basis[:, i].astype(int)
        n = int(min([np.floor(x[i] + 1e-9)] + [left[j] // column[j] for j in np.flatnonzero(column)]))
        if n > 0:
            packs.append((column, n))
            left -= column * n
    # the rest, largest first, each into the first pack that has room
    rest: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[j])):
            for row, (column, room) in enumerate(rest):
                if room >= sizes[j]:
                    column[j] += 1
                    rest[row] = (column, room - int(sizes[j]))
                    break
            else:
                column = np.zeros(k, int)
                column[j] = 1
                rest.append((column, capacity - int(sizes[j])))
    return packs + [(column, 1) for column, _ in rest]


@dataclass(frozen=True)
class Layout:
    """Where the large piece of each rank, longest first, goes."""

    group: int
    packs: int
    starts: tuple[np.ndarray, ...]  #: by size: first place of each configuration,
    each: tuple[np.ndarray, ...]  #: places of the size in a pack of it,
    first: tuple[np.ndarray, ...]  #: and its first pack

    def pack(self, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        size, place = rank // self.group, rank % self.group
        for k in np.unique(size):
            rows = size == k
            at = np.searchsorted(self.starts[k], place[rows], "right") - 1
            out[rows] = self.first[k][at] + (place[rows] - self.starts[k][at]) // self.each[k][at]
        return out


def layout(lengths: np.ndarray, counts: np.ndarray, c: Config) -> Layout:
    """From the histogram of the large pieces."""
    order = np.argsort(-lengths)
    lengths, upto = lengths[order], np.cumsum(counts[order])
    total = int(upto[-1]) if len(upto) else 0
    group = max(1, -(-total // c.groups))
    heads = np.arange(0, total, group)
    sizes = lengths[np.searchsorted(upto, heads, "right")]
    number = np.minimum(group, total - heads)
    plan = configurations(sizes, number, c.capacity)
    starts, each, first = ([[] for _ in sizes] for _ in range(3))
    filled, packs = np.zeros(len(sizes), int), 0
    for column, n in plan:
        for k in np.flatnonzero(column):
            starts[k].append(filled[k])
            each[k].append(column[k])
            first[k].append(packs)
            filled[k] += column[k] * n
        packs += n
    return Layout(group, packs, *(tuple(np.array(x, np.int64) for x in side) for side in (starts, each, first)))


def best_fit(free: dict[int, list[int]], lengths: list[int], capacity: int, new) -> list[int]:
    """The pack of each length: the one with the least room that is enough, or a new one. ``free``: packs by room, changed."""
    rooms = sorted(r for r, packs in free.items() if packs and r > 0)
    out = []
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            pack = free[room].pop()
            if not free[room]:
                del rooms[at]
        else:
            room, pack = capacity, new()
        out.append(pack)
        left = room - n
        if left > 0:
            if not free.get(left):
                free[left] = []
                insort(rooms, left)
            free[left].append(pack)
    return out


def _pieces(docs: DataFrame, text_col: str, id_col: str, c: Config) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t")).where(F.length("t") > 0)
    parts = F.when(F.length("t") > c.capacity, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{c.capacity}}}"), F.lit(0))).otherwise(F.array("t"))
    each = rows.select("doc_id", F.posexplode(parts).alias("nth", "piece"))
    return each.select("doc_id", (F.col("nth") * c.capacity).cast("long").alias("start"), F.length("piece").alias("len"), "piece")


def assign(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(pack_id, doc_id, start, len, piece) of every piece."""
    c, small = config, config.capacity // config.parts
    pieces = _pieces(docs, text_col, id_col, c)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int"))
    lens = cut(keyed.groupBy("len", "bucket").agg(F.count("*").alias("n")))
    hist = lens.groupBy("len").agg(F.sum("n").alias("n")).toPandas()
    length, number = hist["len"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    full = int(number[length == c.capacity].sum())
    big = (length > small) & (length < c.capacity)
    plan = layout(length[big], number[big], c)
    n_small = int(number[length <= small].sum())

    # ranks: longest first; a length's ranks by bucket; a bucket's by doc_id
    order = np.argsort(-length[big])
    before = np.cumsum(number[big][order]) - number[big][order]
    spark = docs.sparkSession
    table = [(int(x), int(b)) for x, b in zip(length[big][order], before)] + [(c.capacity, 0)]
    first = spark.createDataFrame(table, "len int, before long")
    in_len = F.sum("n").over(Window.partitionBy("len").orderBy("bucket")) - F.col("n")
    starts = lens.where(F.col("len") > small).withColumn("inside", in_len).join(F.broadcast(first), "len").select("len", "bucket", "n", (F.col("before") + F.col("inside")).alias("from"))
    nth = F.row_number().over(Window.partitionBy("len", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "start", "piece"))
    large = keyed.where(F.col("len") > small).join(starts.drop("n"), ["len", "bucket"]).withColumn("rank", F.col("from") + nth - 1)

    @F.arrow_udf("long")
    def place(rank: pa.Array, length: pa.Array) -> pa.Array:
        r, n = rank.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False)
        out = r.copy()
        rest = n < c.capacity
        out[rest] = full + plan.pack(r[rest])
        return pa.array(out)

    placed = large.select(place("rank", "len").alias("pack_id"), "doc_id", "start", "len", "piece")
    if not n_small:
        return placed
    shards = max(1, -(-n_small // c.shard))
    packs = full + plan.packs
    # a pack's room follows from the ranks and lengths that are there, so no text is moved for it
    ranks = starts.where(F.col("len") < c.capacity).select("len", F.explode(F.expr("sequence(`from`, `from` + n - 1)")).alias("rank"))
    room = ranks.groupBy(place("rank", "len").alias("pack_id")).agg((F.lit(c.capacity) - F.sum("len")).cast("int").alias("room")).where("room > 0")
    room = room.withColumn("shard", F.pmod(F.xxhash64("pack_id"), F.lit(shards)))
    little = pieces.where(F.col("len") <= small).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(shards)))
    kind = dict(pieces.dtypes)["doc_id"]

    def fill(key: tuple, items: pa.Table, rooms: pa.Table) -> pa.Table:
        free: dict[int, list[int]] = {}
        for pack, r in sorted(zip(rooms["pack_id"].to_pylist(), rooms["room"].to_pylist()), reverse=True):
            free.setdefault(r, []).append(pack)
        items = items.sort_by([("len", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        made = iter(range(packs + key[0].as_py(), 2**62, shards))
        at = best_fit(free, items["len"].to_pylist(), c.capacity, lambda: next(made))
        return pa.table([pa.array(at, pa.int64()), *(items[x] for x in ("doc_id", "start", "len", "piece"))], names=["pack_id", "doc_id", "start", "len", "piece"])

    filled = little.groupBy("shard").cogroup(room.groupBy("shard")).applyInArrow(fill, f"pack_id long, doc_id {kind}, start long, len int, piece string")
    return placed.unionByName(filled)


def pack(docs: DataFrame, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(pack_id, doc_ids, starts, lengths, used, text) of each pack; text is the pieces end to end, longest first."""
    piece = F.struct((-F.col("len")).alias("less"), "doc_id", "start", "piece")
    packs = assign(docs, config, text_col, id_col).groupBy("pack_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return packs.select(
        "pack_id",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.start").alias("starts"),
        F.transform("p.less", lambda x: -x).alias("lengths"),
        F.aggregate("p.less", F.lit(0), lambda a, x: a - x).alias("used"),
        F.array_join("p.piece", "").alias("text"),
    )

"""Approximate nearest neighbours by robust-pruned directed graphs (operator 5).

Rows with equal vectors are one point: pruning would leave a point one of many equal ones as a neighbour, and the others out of
reach. Points are hashed into shards of about ``shard``. Each shard builds one directed graph in two passes: every point is
searched for greedily in the graph so far, and of the points that the search visits those are kept as neighbours that no
kept one is much nearer to (``alpha`` relaxes the rule in the second pass, so that long edges stay); edges are also added
backwards and full lists pruned alike. Points are taken in batches, so that a batch's searches and prunings are a few
array operations. Every shard's graph is a file in the shared folder. A task has about ``block`` queries and goes through the shards
with them, one graph in memory at a time, by beam search from the shard's medoid; it keeps each query's nearest ``k`` points of all
shards, so neither graphs nor vectors nor candidates are copied by a shuffle or broadcast. The points found stand for all their
rows, and those and the rows of the query's own point are what it chooses its nearest ``k`` from.

Points and rows are known by hashes of their values, so results don't depend on how the table is partitioned.

Distance is the squared Euclidean one. Defined results: rows whose vector is null, empty, of another length than the most
common one, or has a null or a number that isn't finite have no place in the graph and no result; repeated rows are
found as rows of their own; of the rows with a query's id and vector one is left out, others are not; ties go to the smaller id; a
table of one row gives no pairs, an empty one an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, row_key, shared_dir


@dataclass(frozen=True)
class Config:
    k: int = 10
    degree: int = 32
    build_beam: int = 48
    beam: int = 64  #: of a query; more is slower and finds more
    alpha: float = 1.2
    shard: int = 12_000
    block: int = 4_000  #: queries of one task, about


def _nearest(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the points of its row of ``at``; of -1 infinite."""
    p = x[np.maximum(at, 0)]
    d = (p * p).sum(axis=2) - 2 * np.matmul(p, q[:, :, None])[:, :, 0] + (q * q).sum(axis=1)[:, None]
    return np.where(at >= 0, np.maximum(d, 0), np.inf).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(points, distances) of the ``beam`` nearest found for each query, nearest first, -1 where there are fewer.

    All queries step together: each expands its nearest point that isn't expanded yet. With ``keep``, the points that were
    expanded come back too, up to so many, in front of the order.
    """
    n = len(q)
    best = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    best[:, 0], dist[:, 0], done[:, 0] = start, _nearest(x, q, np.full((n, 1), start))[:, 0], False
    seen = np.zeros((n, -(-len(x) // 8)), np.uint8)
    seen[:, start >> 3] |= np.uint8(1 << (start & 7))
    went = np.full((n, keep), -1, np.int32)
    steps = 0
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        has = open_.any(axis=1)
        live = live[has]
        if not len(live):
            break
        col = open_[has].argmax(axis=1)
        node = best[live, col]
        done[live, col] = True
        if steps < keep:
            went[live, steps] = node
        steps += 1
        near = edges[node]
        old = (near < 0) | ((seen[live[:, None], np.maximum(near, 0) >> 3] >> (near & 7).astype(np.uint8)) & 1).astype(bool)
        near = np.where(old, -1, near)
        bits = np.where(old, 0, 1 << (near & 7)).astype(np.uint8)
        np.bitwise_or.at(seen, (live[:, None], np.maximum(near, 0) >> 3), bits)
        d = _nearest(x, q[live], near)
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        best[live] = np.take_along_axis(np.concatenate([best[live], near], axis=1), order, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], axis=1), order, axis=1)
        dist[live] = np.take_along_axis(all_d, order, axis=1)
    if keep:
        return np.concatenate([went, best], axis=1), dist
    return best, dist


def robust_prune(x: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """[point, degree] neighbours out of the candidates ``near``: the nearest, then those not ``alpha`` times nearer to one kept."""
    near = np.where(near == points[:, None], -1, near)
    order = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    d = _nearest(x, x[points], near)
    order = np.argsort(d, axis=1, kind="stable")[:, : int(np.isfinite(d).sum(axis=1).max(initial=1))]
    near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
    out = np.full((len(points), degree), -1, np.int32)
    vectors = x[np.maximum(near, 0)]
    norms = (vectors * vectors).sum(axis=2)
    free = near >= 0
    row = np.arange(len(points))
    factor = alpha * alpha  # distances are squared
    for j in range(degree):
        any_ = free.any(axis=1)
        if not any_.any():
            break
        at = free.argmax(axis=1)
        out[any_, j] = near[row[any_], at[any_]]
        free[row, at] = False
        chosen = vectors[row, at]
        between = norms + norms[row, at][:, None] - 2 * np.matmul(vectors, chosen[:, :, None])[:, :, 0]
        free &= factor * between > d
    return out


def build(x: np.ndarray, c: Config, seed: int = 1) -> tuple[np.ndarray, int]:
    """(edges [point, degree], start) of the graph of the points ``x``."""
    n = len(x)
    start = int(_nearest(x, x.mean(axis=0, keepdims=True).astype(np.float32), np.arange(n)[None])[0].argmin())
    edges = np.full((n, c.degree), -1, np.int32)
    rng = np.random.default_rng(seed)
    for alpha in (1.0, c.alpha):
        order = rng.permutation(n)
        at, size = 0, 1
        while at < n:
            points = order[at : at + size]
            at += size
            # the first batches are small, or the points would have only the start to link to
            size = min(size * 2, 512, max(1, n // 20)) if alpha == 1.0 else min(512, max(1, n // 20))
            found, _ = beam_search(x, edges, start, x[points], c.build_beam, c.build_beam)
            edges[points] = robust_prune(x, points, np.concatenate([found, edges[points]], axis=1), c.degree, alpha)
            _link_back(x, edges, points, c.degree, alpha)
    return edges, start


def _link_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(points, degree)
    target = edges[points].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    size = np.diff(np.r_[heads, len(target)])
    nodes = target[heads]
    for lo in range(0, len(nodes), 1024):
        part = slice(lo, lo + 1024)
        some, count = nodes[part], size[part]
        extra = np.full((len(some), int(count.max(initial=0))), -1, np.int32)
        row = np.repeat(np.arange(len(some)), count)
        col = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        extra[row, col] = source[heads[lo] : heads[lo] + len(row)]
        known = (extra[:, :, None] == edges[some][:, None, :]).any(axis=2)
        extra[known] = -1
        have = (edges[some] >= 0).sum(axis=1)
        more = (extra >= 0).sum(axis=1)
        fits = have + more <= degree
        both = np.concatenate([edges[some], extra], axis=1)
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        edges[some[fits]] = packed[fits, :degree]
        full = ~fits & (more > 0)
        if full.any():
            edges[some[full]] = robust_prune(x, some[full], both[full], degree, alpha)


def _points(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<float>").alias("v")).where(F.size("v") > 0)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # negative zeros are zeros
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    return rows.withColumn("key", row_key(F.col("v")))


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    """Lists of equal length as rows of an array."""
    flat = [c.flatten() for c in column.chunks if len(c)]
    return np.concatenate([c.to_numpy(zero_copy_only=False) for c in flat]).astype(kind, copy=False).reshape(-1, width) if flat else np.zeros((0, width), kind)


def _nearest_k(query: np.ndarray, dist: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Which of the candidates are among their query's nearest ``k``, or as near as the last of them; in order."""
    order = np.lexsort((other, dist, query))
    if not len(order):
        return order
    q, d = query[order], dist[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[first, len(q)])
    last = d[first + np.minimum(size, k) - 1]
    return order[d <= np.repeat(last, size)]


def neighbours(table: DataFrame, config: Config = Config(), id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(vec_id, neighbour, rank, distance): the ``k`` nearest other rows of each row of ``queries`` (of the table by default), found approximately."""
    c, spark = config, table.sparkSession
    rows = _points(table, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    kind = dict(table.dtypes)[id_col]
    if sizes is None:
        return spark.createDataFrame([], f"vec_id {kind}, neighbour {kind}, rank int, distance double")
    width = sizes["d"]
    rows = rows.where(F.size("v") == width)
    points = cut(rows.groupBy("key").agg(F.first("v").alias("v")).select("v", F.col("key.a").alias("a"), F.col("key.b").alias("b")))
    n = points.count()
    shards = max(1, -(-n // c.shard))
    home = f"{shared_dir(spark).rstrip('/')}/graphs-{uuid.uuid4().hex}"

    def graph(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        x = _matrix(t["v"], np.float32, width)
        edges, start = build(np.ascontiguousarray(x), c)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * c.degree), pa.array(edges.ravel()))
        shard = t["shard"].to_numpy()
        row = pa.array((shard.astype(np.int64) << 32) + np.arange(len(x)))
        return pa.table([t["v"], t["a"], t["b"], row, t["shard"], lists, pa.array(np.arange(len(x)) == start)], names=["v", "a", "b", "row", "shard", "edges", "start"])

    spread = points.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).repartition(shards, "shard")
    built = spread.groupBy("shard").applyInArrow(graph, "v array<float>, a long, b long, row long, shard int, edges array<int>, start boolean")
    built.write.partitionBy("shard").parquet(home)
    graphs = spark.read.parquet(home)
    if queries is None:
        asked, q = rows.select("id", "key"), points
    else:
        valid = _points(queries, id_col, vec_col).where(F.size("v") == width)
        asked = valid.select("id", "key")
        q = valid.groupBy("key").agg(F.first("v").alias("v")).select("v", F.col("key.a").alias("a"), F.col("key.b").alias("b"))

    def read(fs: pafs.FileSystem, root: str, s: int) -> pa.Table:
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/shard={s}")) if f.path.endswith(".parquet"))
        return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in files])

    def found(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        fs, root = pafs.FileSystem.from_uri(home if "://" in home else "file://" + home)
        who, far, row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        present = {int(f.base_name.split("=")[1]) for f in fs.get_file_info(pafs.FileSelector(root)) if "=" in f.base_name}
        for s in sorted(present):
            shard = read(fs, root, s)
            x = np.ascontiguousarray(_matrix(shard["v"], np.float32, width))
            edges = _matrix(shard["edges"], np.int32, c.degree)
            start = int(shard["start"].to_numpy(zero_copy_only=False).argmax())
            own, ka, kb = (shard[name].to_numpy() for name in ("row", "a", "b"))
            for i in range(0, len(v), 512):
                some = v[i : i + 512]
                best, _ = beam_search(x, edges, start, some, c.beam)
                at = np.maximum(best, 0)
                ok = (best >= 0) & ((ka[at] != a[i : i + 512, None]) | (kb[at] != b[i : i + 512, None]))
                ok &= np.cumsum(ok, axis=1) <= c.k
                r, col = np.nonzero(ok)
                # exact distances for the order across shards
                gap = some[r].astype(np.float64) - x[best[r, col]]
                who, far, row = np.r_[who, r + i], np.r_[far, (gap * gap).sum(axis=1)], np.r_[row, own[best[r, col]]]
            keep = _nearest_k(who, far, row, c.k)
            who, far, row = who[keep], far[keep], row[keep]
        return pa.RecordBatch.from_arrays([pa.array(a[who]), pa.array(b[who]), pa.array(row), pa.array(far)], ["a", "b", "other", "distance"])

    def search(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(x.num_rows for x in held) >= 2 * c.block:
                t = pa.Table.from_batches(held)
                yield run(t.slice(0, c.block))
                held = t.slice(c.block).to_batches()
        if held:
            yield run(pa.Table.from_batches(held))

    def run(t: pa.Table) -> pa.RecordBatch:
        return found(np.ascontiguousarray(_matrix(t["v"], np.float32, width)), t["a"].to_numpy(), t["b"].to_numpy())

    spread = q.repartition(max(1, -(-n // c.block)), "a") if queries is None else q.repartition("a")
    hits = spread.mapInArrow(search, "a long, b long, other long, distance double")
    # the query's own point is as near as can be
    mine = graphs.join(q.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.col("row").alias("other"), F.lit(0.0).alias("distance"))
    hits = hits.unionByName(mine)
    # one of a point's rows may be the query's, so k + 1 of each are enough
    members = rows.select("id", "key").join(graphs.select(F.struct("a", "b").alias("key"), F.col("row").alias("other")), "key")
    first = members.select("other", F.col("id").alias("neighbour")).withColumn("nth", F.row_number().over(Window.partitionBy("other").orderBy("neighbour"))).where(F.col("nth") <= c.k + 1)
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("distance", "neighbour", "other", "copy"))
    chosen = hits.join(first.withColumnRenamed("nth", "copy"), "other").withColumn("nth", nth).where(F.col("nth") <= c.k + 1)
    own = F.col("distance") == 0
    lists = chosen.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", own.alias("own"), "distance"))).alias("all"))
    each = asked.join(lists.select(F.struct("a", "b").alias("key"), "all"), "key")
    self_ = F.array_min(F.transform(F.filter("all", lambda x: x["own"] & x["neighbour"].eqNullSafe(F.col("id"))), lambda x: x["nth"]))
    others = F.slice(F.filter("all", lambda x: x["nth"] != F.coalesce(F.col("self"), F.lit(0))), 1, c.k)
    each = each.withColumn("self", self_).select(F.col("id").alias("vec_id"), F.posexplode(others).alias("pos", "x"))
    return each.select("vec_id", "x.neighbour", (F.col("pos") + 1).alias("rank"), "x.distance")

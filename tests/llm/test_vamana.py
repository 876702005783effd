from __future__ import annotations

import numpy as np
import pytest
from lodestar.llm import vamana as V
from pyspark.sql import functions as F


def vectors(n, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 2
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d))).astype(np.float32)


def exact(x, k):
    x = x.astype(np.float64)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("config", [V.Config(), V.Config(shard=400, block=300)])
def test_recall(spark, config):
    x = vectors(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = V.neighbours(df, config).toPandas()
    assert (got.groupby("vec_id").size() == config.k).all() and got["vec_id"].nunique() == len(x)
    assert (got["vec_id"] != got["neighbour"]).all()
    true = exact(x, config.k)
    hits = sum(len(set(g["neighbour"]) & set(true[i].tolist())) for i, g in got.groupby("vec_id"))
    assert hits / true.size >= 0.95
    one = got[got.vec_id == 3].sort_values("rank")
    far = ((x[3].astype(float) - x[one["neighbour"].to_numpy()].astype(float)) ** 2).sum(axis=1)
    assert np.allclose(one["distance"], far) and (np.diff(one["distance"]) >= 0).all()


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [5, 5]], np.float32)
    got = V.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 1, 0]]), 4, 1.0)[0]
    assert [i for i in got.tolist() if i >= 0] == [1, 3]  # 2 and 4 are nearer to a kept one


def test_defined_results(spark):
    x = vectors(60, 4)
    data = [(i, v.tolist(), "a", 1.0, 7) for i, v in enumerate(x)]
    data += [(100, None, None, None, None), (101, [], "b", 1.0, 1), (102, [1.0, 2.0], "b", 1.0, 1), (103, [1.0, None, 2.0, 3.0], "b", 1.0, 1), (104, [float("nan"), 1.0, 1.0, 1.0], "b", 1.0, 1), (105, [float("inf"), 1.0, 1.0, 1.0], "b", 1.0, 1)]
    data += [data[5], (None, x[6].tolist(), None, None, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, v string, distance double, shard int")
    got = V.neighbours(df, V.Config(k=5)).toPandas()
    assert not got["vec_id"].isin(range(100, 106)).any() and not got["neighbour"].isin(range(100, 106)).any()
    assert len(got) == 62 * 5
    assert set(got[(got.vec_id == 5) & (got["rank"] == 1)]["neighbour"]) == {5}  # the repeated row finds the other


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert V.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert V.neighbours(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert V.neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], kind)).count() == 2
    assert V.neighbours(spark.createDataFrame([(1, None)], kind)).count() == 0


@pytest.mark.parametrize("config", [V.Config(), V.Config(shard=40, block=30)])
def test_recall_among_equal_vectors(spark, config):
    distinct = vectors(120, seed=5)
    distinct[0, 0] = 0.0
    times = np.ones(len(distinct), int)
    times[:8] = [3, 12, 33, 40, 64, 100, 400, 2500]
    point = np.repeat(np.arange(len(distinct)), times)
    point = point[np.random.default_rng(6).permutation(len(point))]
    x = distinct[point]
    zeros = np.flatnonzero(point == 0)
    x[zeros[0], 0] = -0.0  # equal to 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = V.neighbours(df, config).toPandas().sort_values(["vec_id", "rank"])
    assert len(got) == len(x) * config.k and (got["vec_id"] != got["neighbour"]).all()
    assert not got.duplicated(["vec_id", "neighbour"]).any()
    # the k smallest distances to other rows, by brute force over the distinct vectors
    d = ((distinct[:, None].astype(float) - distinct[None].astype(float)) ** 2).sum(axis=2)
    want = {p: np.sort(np.repeat(d[p], times - (np.arange(len(d)) == p)))[: config.k] for p in range(len(d))}
    hits = sum(int((g["distance"].to_numpy() <= want[point[i]] + 1e-6).sum()) for i, g in got.groupby("vec_id"))
    assert hits / len(got) >= 0.99
    # rows in groups of more than k find their copies of the smallest ids
    big = got[times[point[got["vec_id"]]] > config.k]
    assert (big["distance"] == 0).all() and (point[big["vec_id"]] == point[big["neighbour"]]).all()


def test_any_partitioning_gives_the_same(spark):
    x = vectors(1200, 8)
    x[600:640] = x[5]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    c = V.Config(shard=300, block=200, beam=12, build_beam=16, degree=8)
    one, five = (sorted(map(tuple, V.neighbours(df.repartition(p).sortWithinPartitions(F.rand(p)), c).collect())) for p in (1, 5))
    assert one == five and len(one) == 12_010


def test_stated_queries(spark):
    """A set of queries against all rows gives what every row as a query gives; vectors that aren't in the table find theirs too."""
    x = vectors(700, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    every = sorted(map(tuple, V.neighbours(df).where("vec_id % 50 = 0").collect()))
    assert every == sorted(map(tuple, V.neighbours(df, queries=df.where("vec_id % 50 = 0")).collect())) and len(every) == 140
    new = spark.createDataFrame([(-1, (x[3] + 0.001).tolist()), (-2, None), (-3, [1.0])], "vec_id long, embedding array<float>")
    got = V.neighbours(df, queries=new).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [-1] * 10 and got[0].neighbour == 3
    assert V.neighbours(df, queries=df.where("vec_id < 0")).count() == 0


def test_recall_of_the_query(spark, small):
    from lodestar.llm.queries import op5_vamana

    rows = [r for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r.embedding is not None]
    x = np.array([r.embedding for r in rows], float)
    got, ids = {}, np.array([r.vec_id for r in rows])
    for r in op5_vamana(spark, small).collect():
        got.setdefault(r.vec_id, []).append(r.distance)
    assert got.keys() == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for i in got:
        d = np.sort(((x - x[ids == i][0]) ** 2).sum(axis=1)[ids != i])[:10]
        hits += sum(y <= d[-1] + 1e-6 for y in got[i])
    assert hits >= 0.95 * 10 * len(got)

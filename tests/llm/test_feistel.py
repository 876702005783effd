from __future__ import annotations

import numpy as np
import pytest
from lodestar.llm import feistel as Z

from . import cases


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4097, 70_001])
def test_it_is_a_permutation_with_an_inverse(n):
    x = np.arange(n)
    y = Z.permute(x, n)
    assert (np.sort(y) == x).all() and (Z.inverse(y, n) == x).all()


def test_it_shuffles():
    y = Z.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), y)[0, 1]) < 0.05
    assert (np.bincount(y[:2000] // 1000, minlength=10) > 120).all()


def test_any_partitioning_gives_the_same(spark):
    docs = cases.plain(spark, [(i * 7 - 40, f"t{i}", "en", "a", 1) for i in range(500)])
    c = Z.Config(shard_rows=64)
    a, b = (sorted(map(tuple, Z.shards(docs.repartition(k), c).collect())) for k in (1, 6))
    assert a == b
    assert sorted(r[1] for r in a) == list(range(500)) and sorted((r[3], r[4]) for r in a) == [(i // 64, i % 64) for i in range(500)]
    assert (Z.permute(np.array([r[1] for r in a]), 500, c) == np.array([r[2] for r in a])).all()


def test_sql_says_the_same(spark):
    import duckdb
    import pandas as pd

    docs = cases.plain(spark, [(i * 7919 % 100_003, "t", "en", "a", 1) for i in range(777)])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r.doc_id for r in docs.select("doc_id").collect()]}))
    assert sorted(con.execute(Z.sql()).fetchall()) == sorted(map(tuple, Z.shards(docs).collect()))


def test_defined_results(spark):
    docs = cases.wide(spark)
    got = Z.shards(docs).collect()
    assert sorted(r.position for r in got) == list(range(docs.count())) and sum(r.doc_id is None for r in got) == 2
    assert Z.shards(cases.plain(spark, [])).count() == 0
    assert Z.shards(docs.select("text"), id_col="text").count() == docs.count()

"""Shuffled sharding by a Feistel permutation (operator 9).

Every row gets a global row number: its place in the order of (bucket, doc_id, row hash), bucket a fixed arithmetic hash,
so that numbering needs one shuffle of small keys and a table of at most ``BUCKETS`` counts, never a global sort. A
four-round Feistel network permutes the numbers below 4**h >= N; walking its cycle until the value is below N again makes
it a permutation of the N rows. Its value over the shard size is the shard, the rest the slot. Anyone who knows N, the
shard size and the seed can compute a row's shard and slot, and :func:`inverse` the row of a slot.

Defined results: null doc_ids come first in their bucket; rows that share a doc_id are told apart by a hash of all their
columns, equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8192
PRIME = 2_147_483_647


@dataclass(frozen=True)
class Config:
    shard_rows: int = 1000
    seed: int = 20_240_607
    rounds: int = 4


def _keys(c: Config) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, below 2**31."""
    return [((c.seed * (2 * r + 3) + 1_103_515_245) % (PRIME - 1) + 1, (c.seed * (r + 7) + 12_345) % PRIME) for r in range(c.rounds)]


def half_bits(n: int) -> int:
    """h, the least with 4**h >= n, but 1."""
    h = 1
    while 4**h < n:
        h += 1
    return h


def _round(x: np.ndarray, key: tuple[int, int], mask: int) -> np.ndarray:
    # the products stay below 2**62, so that any SQL dialect's signed 64-bit integers do the same
    y = (x % PRIME * key[0] + key[1]) % PRIME
    y = (y ^ (y >> 15)) * 48_271 % PRIME
    return (y ^ (y >> 13)) & mask


def _network(x: np.ndarray, h: int, keys: list[tuple[int, int]]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for key in keys:
        left, right = right, left ^ _round(right, key, mask)
    return (left << h) | right


def _reverse(x: np.ndarray, h: int, keys: list[tuple[int, int]]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for key in reversed(keys):
        left, right = right ^ _round(left, key, mask), left
    return (left << h) | right


def _walk(x: np.ndarray, n: int, step, c: Config) -> np.ndarray:
    x = np.asarray(x, np.int64)
    h, keys = half_bits(n), _keys(c)
    out = step(x, h, keys)
    while (far := out >= n).any():
        out[far] = step(out[far], h, keys)
    return out


def permute(x: np.ndarray, n: int, c: Config = Config()) -> np.ndarray:
    """Positions of the row numbers ``x`` among ``n``."""
    return _walk(x, n, _network, c)


def inverse(position: np.ndarray, n: int, c: Config = Config()) -> np.ndarray:
    """Row numbers of the positions."""
    return _walk(position, n, _reverse, c)


def number(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, row_number): 0 to N - 1 without gaps, whatever the partitioning."""
    kind = dict(docs.dtypes)[id_col]
    key = F.col(f"`{id_col}`")
    # ids that aren't integers are hashed; integers stay arithmetic so that SQL can say the same
    whole = key.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    rows = docs.select(
        key.alias("doc_id"),
        F.coalesce(F.pmod(F.pmod(whole, F.lit(PRIME)) * 40_503 + 17, F.lit(PRIME)) % BUCKETS, F.lit(0)).cast("int").alias("bucket"),
        *([] if len(docs.columns) == 1 else [F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not dict(docs.dtypes)[c].startswith(("map", "variant"))]).alias("tie")]),
    )
    if "tie" not in rows.columns:
        rows = rows.withColumn("tie", F.lit(0))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    # at most BUCKETS rows, so one partition holds the running sum and the join may broadcast it
    starts = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie"))
    return rows.withColumn("nth", nth).join(F.broadcast(starts), "bucket").select("doc_id", (F.col("start") + F.col("nth") - 1).alias("row_number"))


def shards(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """(doc_id, row_number, position, shard, slot) of every row."""
    n = docs.count()

    @F.arrow_udf("long")
    def position(x: pa.Array) -> pa.Array:
        return pa.array(permute(x.to_numpy(zero_copy_only=False).copy(), max(n, 1), config))

    out = number(docs, id_col).withColumn("position", position("row_number"))
    size = F.lit(config.shard_rows)
    return out.select("doc_id", "row_number", "position", F.floor(F.col("position") / size).alias("shard"), (F.col("position") % size).alias("slot"))


def sql(table: str = "documents", config: Config = Config()) -> str:
    """DuckDB SQL for :func:`shards` of a table whose doc_ids are distinct integers."""

    # each round is a step of its own in the recursion, or the text would double with every one
    steps = []
    for r, (a, b) in enumerate(_keys(config)):
        y = f"((r % {PRIME} * {a} + {b}) % {PRIME})"
        y = f"(xor({y}, {y} >> 15) * 48271 % {PRIME})"
        steps.append(f"when k = {r} then xor(l, xor({y}, {y} >> 13) % m)")
    new = f"(case {' '.join(steps)} end)"
    return f"""
with recursive size as (select count(*) as n, greatest(2, cast(pow(2, ceil(ln(greatest(count(*), 1)) / ln(4) - 1e-12)) as bigint)) as m from {table}),
numbered as (
  select doc_id, row_number() over (order by (((doc_id % {PRIME}) * 40503 + 17) % {PRIME}) % {BUCKETS}, doc_id) - 1 as row_number from {table}),
walk(doc_id, row_number, n, m, l, r, k) as (
  select doc_id, row_number, n, m, row_number // m, row_number % m, 0 from numbered, size
  union all
  select doc_id, row_number, n, m, if(k < {config.rounds}, r, l), if(k < {config.rounds}, {new}, r), (k + 1) % {config.rounds + 1}
  from walk where k < {config.rounds} or l * m + r >= n),
found as (select doc_id, row_number, l * m + r as position from walk where k = {config.rounds} and l * m + r < n)
select doc_id, row_number, position, position // {config.shard_rows} as shard, position % {config.shard_rows} as slot from found
"""

"""Mixing sources to target weights by pivotal dependent rounding (operator 4).

Each source should make up a given share of the mixture's characters, so each of its documents should appear
lambda = (share * all characters) / (the source's characters) times on average: its whole part is certain, its fraction
a probability. Rounding documents on their own would make a source's total vary with the root of its size. The pivotal
method instead pairs two fractions and moves mass between them at random, keeping each one's expectation, until one is 0
or 1; the other goes on to the next pair. A source's copies then sum to its target to less than one document.

Pairing runs as a reduction tree: leaves of about ``leaf`` documents (a hash of the doc_id picks the leaf, so a hot
source has many) each leave at most one undecided document; ``fan`` leaves' residuals meet in a node, and so on up to one
root per source, whose residual is drawn alone. Draws hash the seed and the items' 128-bit keys, in which null isn't empty and
values don't shift between columns, so a task that is run again decides alike.

Defined results: rows that share source and doc_id (nulls count as values) are one item and are copied alike; a null
source is a source; null or empty texts weigh nothing but are drawn like the rest; a source without characters, or with
a target of 0, gets no copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, free_name, row_key


@dataclass(frozen=True)
class Config:
    temperature: float = 0.5  #: without given weights, a source's is its character share to this power
    size: float = 1.0  #: characters of the mixture, as a multiple of the input's
    leaf: int = 4096
    fan: int = 64
    seed: int = 5


def _draws(seed: int, keys: np.ndarray) -> np.ndarray:
    """A uniform number in (0, 1) per key."""
    h = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for mul in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(mul)
    h ^= h >> np.uint64(33)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


EPS = 1e-9


def pivot(prob: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Settle all but one of ``prob``: (settled 0 or 1, index of the undecided one or -1, its probability).

    ``draw[i]`` decides the meeting of the item so far undecided with item i.
    """
    out = np.zeros(len(prob), np.int64)
    at, p = -1, 0.0
    for i, q in enumerate(prob.tolist()):
        if q <= EPS or q >= 1 - EPS:
            out[i] = q > 0.5
            continue
        if at < 0:
            at, p = i, q
            continue
        total = p + q
        if total < 1:  # one of them gets all, the other nothing
            if draw[i] * total < q:
                at = i
            p = total
        else:  # one of them is in, the other keeps the rest
            if draw[i] * (2 - total) < 1 - p:
                out[i] = 1
            else:
                out[at] = 1
                at = i
            p = total - 1
        if p <= EPS or p >= 1 - EPS:
            out[at] = p > 0.5
            at, p = -1, 0.0
    return out, at, p


def _node(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "more"], kind="stable")
        settled, at, p = pivot(pdf["p"].to_numpy(), _draws(seed, pdf["key"].to_numpy().view(np.uint64)))
        state = np.full(len(pdf), -1.0)
        if at >= 0:
            state[at] = p
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "more": pdf["more"].to_numpy(), "src": pdf["src"].to_numpy(), "node": pdf["node"].to_numpy() if len(pdf) else [], "got": settled, "p": state})

    return run


SCHEMA = "key long, more long, src long, node long, got long, p double"


def plan(docs: DataFrame, weights: Mapping[str, float] | None = None, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, copies) of each item, zero copies included.

    ``weights`` gives target shares by source, which are scaled to sum to one; sources it doesn't name get none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("chars"))
    items = rows.groupBy("source", "doc_id").agg(F.sum("chars").alias("chars")).withColumn("id", row_key(F.col("source"), F.col("doc_id"), seed=3)).select("source", "doc_id", "chars", F.col("id.a").alias("key"), F.col("id.b").alias("more"))
    by = items.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    if weights is None:
        by = by.withColumn("w", F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(config.temperature))).otherwise(0.0))
    else:
        table = spark.createDataFrame([(s, float(w)) for s, w in weights.items()] or [(None, 0.0)], "source string, w double")
        by = by.join(table, by["source"].cast("string").eqNullSafe(table["source"]), "left").select(by["*"], F.coalesce("w", F.lit(0.0)).alias("w"))
    every = Window.partitionBy(F.lit(0))  # one row a source
    share = F.when(F.sum("w").over(every) > 0, F.col("w") / F.sum("w").over(every)).otherwise(0.0)
    target = share * F.sum("chars").over(every) * F.lit(config.size)
    by = by.select(F.col("source").alias("s"), F.xxhash64(F.lit(7), F.col("source").isNull(), "source").alias("src"), "n", F.when(F.col("chars") > 0, target / F.col("chars")).otherwise(0.0).alias("lam"))
    by = by.select("s", "src", "lam", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(config.leaf))).cast("long").alias("leaves"))
    by = cut(by)
    most = by.agg(F.max("leaves")).head()[0] or 1
    joined = items.join(by, items["source"].eqNullSafe(by["s"])).select(
        "key", "more", "source", "doc_id", "src", F.floor("lam").cast("long").alias("whole"), (F.col("lam") - F.floor("lam")).alias("p"), F.pmod(F.xxhash64("key"), F.col("leaves")).alias("node")
    )
    joined = cut(joined)
    level = 0
    left = joined.select("key", "more", "src", "node", "p")
    settled = None
    while True:
        done = cut(left.groupBy("src", "node").applyInPandas(_node(config.seed + level), SCHEMA))
        ready = done.where("p < 0").select("key", "more", "got")
        settled = ready if settled is None else settled.unionByName(ready)
        left = done.where("p >= 0").select("key", "more", "src", F.floor(F.col("node") / config.fan).cast("long").alias("node"), "p")
        if most <= 1:
            break
        most, level = -(-most // config.fan), level + 1
    # what is left at the roots, at most one a source, is drawn alone
    last = (F.xxhash64(F.lit(config.seed), "key").cast("double") / F.lit(2.0**64) + 0.5) < F.col("p")
    settled = settled.unionByName(left.select("key", "more", last.cast("long").alias("got")))
    return joined.join(settled, ["key", "more"]).select("doc_id", "source", (F.col("whole") + F.col("got")).alias("copies"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, config: Config = Config(), text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the plan says, columns unchanged."""
    p = plan(docs, weights, config, text_col, id_col, source_col).where("copies > 0").select(F.col("doc_id").alias("_id_"), F.col("source").alias("_src_"), F.col("copies").alias("_copies_"))
    copies, each = free_name(docs, "copies"), free_name(docs, "each")
    on = docs[f"`{id_col}`"].eqNullSafe(p["_id_"]) & docs[f"`{source_col}`"].eqNullSafe(p["_src_"])
    kept = docs.join(p, on).select(*[docs[f"`{c}`"] for c in docs.columns], p["_copies_"].alias(copies))
    out = kept.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*[f"`{c}`" for c in docs.columns])

"""Upkeep of state tables: decay, pruning, expiry, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M


def prune_chain(edges: DataFrame, least: float = 1.0, per_node: int = 20, total: int = 500) -> DataFrame:
    """Edges (from_key, to_key, weight, ...) of weight ``least`` up, the heaviest ``per_node`` of each source, ``total`` in all."""
    w = Window.partitionBy("from_key").orderBy(F.desc("weight"), "to_key")
    rows = edges.where(F.col("weight") >= least).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_node).drop("_n")
    return rows.orderBy(F.desc("weight"), "from_key", "to_key").limit(total)


def prune_memory(memory: DataFrame, as_of: Column, days: int = 90, last: int = 220) -> DataFrame:
    """The ``last`` records (ts, ...) of the last ``days``."""
    return memory.where(F.col("ts") > as_of - F.make_dt_interval(F.lit(days))).orderBy(F.desc("ts"), *[c for c in memory.columns if c != "ts"][:1]).limit(last)


def decay_weights(weights: DataFrame, as_of: Column) -> DataFrame:
    """Weights (query, app, weight, last_ts) as they stand at ``as_of``: a function of the row, so running it again changes nothing."""
    return weights.withColumn("weight", M.decay_to_half(F.col("weight"), F.col("last_ts"), as_of))


def multiplied_decay(weights: DataFrame, as_of: Column, days: float = 30.0) -> DataFrame:
    """The other rule: times the half-life factor, 0.35 at least."""
    age = M.days_between(F.col("last_ts"), as_of)
    return weights.withColumn("weight", F.col("weight") * F.when(age <= 0, 1.0).otherwise(F.greatest(F.lit(0.35), F.pow(F.lit(0.5), age / days))))


def live_flags(flags: DataFrame, as_of: Column, cap: int = 200) -> DataFrame:
    """Block flags that haven't expired (null: never), the ``cap`` newest."""
    return flags.where(F.col("expire_ts").isNull() | (F.col("expire_ts") > as_of)).orderBy(F.desc("created_ts"), "query", "app").limit(cap)


def last_n(rows: DataFrame, n: int, by: str = "ts", group: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows, of each group if there are any."""
    order = [F.desc(by)] + ([F.desc(tie)] if tie else [])
    if not group:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def compact(events: DataFrame, every: int = 1000, keep: int = 10_000) -> DataFrame:
    """The last ``keep`` events once there are ``every`` more than that."""
    return last_n(events, keep, tie="event_id" if "event_id" in events.columns else None) if events.count() >= keep + every else events


def maintain(weights: DataFrame, edges: DataFrame, memory: DataFrame, flags: DataFrame, as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All four tables as they should be, and a report (step, before, after)."""
    new = {"weights": decay_weights(weights, as_of), "edges": prune_chain(edges), "memory": prune_memory(memory, as_of), "flags": live_flags(flags, as_of)}
    old = {"weights": weights, "edges": edges, "memory": memory, "flags": flags}
    report = None
    for name in new:
        row = old[name].agg(F.lit(name).alias("step"), F.count("*").alias("before")).crossJoin(new[name].agg(F.count("*").alias("after")))
        report = row if report is None else report.unionByName(row)
    return new, report

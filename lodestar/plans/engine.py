"""The whole search: tiers, what only categories find, suggestions, recall by documents, personal order. One plan for many queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X
from ..operators import learn as L
from ..operators import retrieve as R
from ..operators import vector
from .hints import asked_of, broadcast_if_small


@dataclass(frozen=True)
class Flags:
    """What a search takes part in."""

    fuzzy: bool = True  #: the fuzzy tier, where exact and prefix search find nothing
    tree: bool = True  #: shortcuts, which spare the fuzzy tier
    refresh: bool = True  #: delays that follow the typing speed
    sim_int: bool = False  #: suggestions for queries that find nothing, block flags
    t9: bool = False  #: keypad digits
    rag: bool = False  #: recall by documents, where all else finds nothing
    rerank: bool = True  #: the personal order
    rebuild: bool = True  #: documents are embedded anew each month
    transition: bool = True  #: an old index is faded out
    meta: bool = True  #: hits by category after the others

    def with_(self, **changes: bool) -> Flags:
        return replace(self, **changes)


SOURCES = ("tier", "meta", "suggestion", "recall")


def _places(rows: DataFrame, first: int, step: int, least: int, source: int) -> DataFrame:
    """(query_id, app_id, source, score): points by place."""
    return rows.select("query_id", "app_id", F.lit(source).alias("source"), F.greatest(F.lit(least), first - step * F.col("place")).cast("long").alias("score"))


def _missing(queries: DataFrame, found: DataFrame) -> DataFrame:
    """The queries of two characters and more without hits."""
    return queries.where(F.length("q") >= 2).join(found.select("query_id").distinct(), "query_id", "left_anti")


def tiers(queries: DataFrame, apps: DataFrame, flags: Flags, k: int, shortcuts: DataFrame | None = None) -> DataFrame:
    """(query_id, app_id, tier, score, rank) of the first tier that finds anything: exact, prefix, then a shortcut's apps (key, app_id, place) at 1000
    points less 10 a place, or without one the fuzzy tier."""
    exact = R.exact_search(queries, apps).withColumn("tier", F.lit(0))
    hits = R.first_tier(exact.unionByName(R.prefix_search(queries, apps).withColumn("tier", F.lit(1))))
    points = (F.when(F.col("tier") == 0, 1000).otherwise(800) + R.usage_score()).cast("long")
    found = hits.join(apps.select("app_id", "uses", "installed"), "app_id").select("query_id", "app_id", "tier", points.alias("score"))
    open_ = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    if flags.tree and shortcuts is not None:
        quick = open_.join(shortcuts.select(X.lowered(F.col("key")).alias("q"), "app_id", "place"), "q")
        quick = quick.select("query_id", "app_id", F.lit(2).alias("tier"), (1000 - 10 * F.col("place")).cast("long").alias("score"))
        found = found.unionByName(quick)
        open_ = open_.join(quick.select("query_id").distinct(), "query_id", "left_anti")
    if flags.fuzzy:
        found = found.unionByName(R.fuzzy_search(open_, apps, t9=flags.t9).select("query_id", "app_id", F.lit(2).alias("tier"), F.col("score").cast("long").alias("score")))
    return R.top(found, k, F.desc("score"), F.asc("app_id"))


def search(
    queries: DataFrame, apps: DataFrame, flags: Flags = Flags(), *, shortcuts: DataFrame | None = None, meta: DataFrame | None = None, suggestions: DataFrame | None = None, blocked: DataFrame | None = None, recall: DataFrame | None = None, boosts: DataFrame | None = None, k: int = 30
) -> DataFrame:
    """(query_id, app_id, tier, source, score, rank).

    Hits of the tiers come first, in their order, then those of ``meta`` (query_id, app_id, score) that the tiers lack. A query without either gets its
    ``suggestions`` (query_id, app_id, place) at 60 points less 6 a place, 24 at least, without those ``blocked`` (query_id, app_id); if there are none,
    its ``recall`` (query_id, app_id, place) at 50 less 5 a place, 20 at least. ``boosts`` (query_id, app_id, boost) then lift scores by up to 30 %, half a
    point of boost being all of it, in whole points; names equal to the query come first, equal scores keep their order. Each part takes
    part if its flag is set and its table given.
    """
    q = queries.select("query_id", X.lowered(F.col("q")).alias("q")).where("q <> ''")
    found = tiers(q, apps, flags, k, shortcuts).select("query_id", "app_id", "tier", F.lit(0).alias("source"), "score")
    none = F.lit(None).cast("int")
    if flags.meta and meta is not None:
        more = meta.join(found.select("query_id", "app_id"), ["query_id", "app_id"], "left_anti")
        found = found.unionByName(more.select("query_id", "app_id", none.alias("tier"), F.lit(1).alias("source"), F.col("score").cast("long").alias("score")))
    if flags.sim_int and suggestions is not None:
        free = suggestions if blocked is None else suggestions.join(blocked.select("query_id", "app_id"), ["query_id", "app_id"], "left_anti")
        more = _places(free.join(_missing(q, found).select("query_id"), "query_id", "left_semi"), 60, 6, 24, 2)
        found = found.unionByName(more.withColumn("tier", none))
    if flags.rag and recall is not None:
        more = _places(recall.join(_missing(q, found).select("query_id"), "query_id", "left_semi"), 50, 5, 20, 3)
        found = found.unionByName(more.withColumn("tier", none))
    ordered = found.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("source", F.desc("score"), "app_id")))
    if not flags.rerank or boosts is None:
        return ordered.where(F.col("ordinal") <= k).withColumnRenamed("ordinal", "rank")
    lifted = ordered.join(boosts.select("query_id", "app_id", F.least(F.lit(0.5), "boost").alias("boost")), ["query_id", "app_id"], "left")
    named = asked_of(lifted).join(apps.select("app_id", R.low("name").alias("_name")), "app_id").join(broadcast_if_small(q), "query_id")
    final = F.col("score") + F.floor(F.round(F.coalesce("boost", F.lit(0.0)) / 0.5 * F.col("score") * 0.3, 6))
    out = named.withColumn("exact", F.col("_name") == F.col("q")).withColumn("score", final.cast("long")).select("query_id", "app_id", "tier", "source", "score", "exact", "ordinal")
    return R.top(out, k, F.desc("exact"), F.desc("score"), F.asc("ordinal")).drop("exact", "ordinal")


def delays(rows: DataFrame, flags: Flags) -> DataFrame:
    """(query, delay) of queries with their keys' factors: what the refresh waits longer, nothing without simulated intelligence."""
    q = X.lowered(F.col("query"))
    wanted = q.rlike("^[a-z]{2,}$") if flags.refresh and flags.sim_int else F.lit(False)
    return rows.select("query", F.when(wanted, L.hesitation(F.col("factors"))).otherwise(0).alias("delay"))


def rebuild_due(indexes: DataFrame, as_of: Column, flags: Flags, days: int = 30) -> DataFrame:
    """(name, due) of indexes (name, built_at): never built, or so many days ago (VEC9)."""
    old = F.col("built_at").isNull() | (M.days_between(F.col("built_at"), as_of) >= days)
    return indexes.select("name", (old if flags.rebuild else F.lit(False)).alias("due"))


def index_weights(states: DataFrame, as_of: Column, flags: Flags) -> DataFrame:
    """(name, weight, paths): how much the old index still counts (VEC8); without transitions the new one counts alone."""
    if flags.transition:
        return vector.active_paths(states, as_of)
    return states.select("name", F.lit(0.0).alias("weight"), F.array(F.lit("current")).alias("paths"))

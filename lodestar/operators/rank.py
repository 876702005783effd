"""Personal ranking: five boosts joined to the candidates, capped and explained; affinity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..plans.hints import broadcast_if_small

CAPS = {"heatmap": 0.15, "hourly": 0.20, "transition": 0.15, "geofence": 0.15, "feedback": 0.20}
TOTAL = 0.5


def _left(c: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return c.join(broadcast_if_small(table), on, "left")


def heatmap_boost(c: DataFrame, cells: DataFrame, hour: int, weekday: int) -> DataFrame:
    """Column b_heatmap: the app's share of the cell's launches (hour, weekday, pkg, count, launch_count), of at least five."""
    here = cells.where((F.col("hour") == hour) & (F.col("weekday") == weekday))
    b = M.clamp(F.col("count") / F.greatest(F.lit(5), F.col("launch_count")), 0.0, 1.0) * CAPS["heatmap"]
    return _left(c, here.select("pkg", b.alias("b_heatmap")), ["pkg"]).withColumn("b_heatmap", F.coalesce("b_heatmap", F.lit(0.0)))


def hourly_boost(c: DataFrame, hourly: DataFrame, smart: DataFrame, hour: int) -> DataFrame:
    """Column b_hourly: half the count (of ten) and half the recency; without a row for the hour, 0.6 of the place in the smart
    ranking and 0.4 of its score (of ten)."""
    h = hourly.where(F.col("hour") == hour).select("pkg", (0.5 * F.least(F.col("count") / 10, F.lit(1.0)) + 0.5 * F.col("recency_score")).alias("_h"))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    s = smart.select("pkg", (0.6 * (1 - F.col("pos") / n) + 0.4 * F.least(F.col("score") / 10, F.lit(1.0))).alias("_s"))
    out = _left(_left(c, h, ["pkg"]), s, ["pkg"])
    return out.withColumn("b_hourly", M.clamp(F.coalesce("_h", "_s", F.lit(0.0)), 0.0, 1.0) * CAPS["hourly"]).drop("_h", "_s")


def transition_boost(c: DataFrame, moves: DataFrame, from_pkg: str, as_of: Column, least: float = 0.05) -> DataFrame:
    """Column b_transition: the probability of coming from ``from_pkg``, from ``least`` up, halved every 30 days."""
    age = F.greatest(F.lit(0.0), M.days_between(F.col("last_occurred"), as_of))
    t = moves.where((F.col("from_pkg") == from_pkg) & (F.col("probability") >= least))
    t = t.select(F.col("to_pkg").alias("pkg"), (M.clamp(F.col("probability") * F.pow(F.lit(0.5), age / 30), 0.0, 1.0) * CAPS["transition"]).alias("b_transition"))
    return _left(c, t, ["pkg"]).withColumn("b_transition", F.coalesce("b_transition", F.lit(0.0)))


def geofence_boost(c: DataFrame, preferred: DataFrame, geofence: str) -> DataFrame:
    """Column b_geofence: the app's weight where the user is."""
    g = preferred.where(F.col("geofence_id") == geofence).select("pkg", (M.clamp(F.col("weight"), 0.0, 1.0) * CAPS["geofence"]).alias("b_geofence"))
    return _left(c, g, ["pkg"]).withColumn("b_geofence", F.coalesce("b_geofence", F.lit(0.0)))


def feedback_boost(c: DataFrame, events: DataFrame, query: str) -> DataFrame:
    """Column b_feedback: a third of the clicks for the query, by rank (later than first 1.2, first 1, unknown 0.7), halved every 20
    events back; all events count as steps back."""
    # 0.5 ** (step / 20) is 0 as a double from step 21 500 on: the last so many are picked before they are counted
    last = events.orderBy(F.desc("event_idx")).limit(21_500)
    step = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("event_idx"))) - 1
    factor = F.when(F.col("clicked_rank") > 0, 1.2).when(F.col("clicked_rank") == 0, 1.0).otherwise(0.7)
    rows = last.withColumn("step", step).where(F.lower("query") == query.lower())
    f = rows.groupBy(F.col("clicked_pkg").alias("pkg")).agg(F.sum(F.pow(F.lit(0.5), F.col("step") / 20) * factor / 3).alias("x"))
    f = f.select("pkg", (M.clamp(F.col("x"), 0.0, 1.0) * CAPS["feedback"]).alias("b_feedback"))
    return _left(c, f, ["pkg"]).withColumn("b_feedback", F.coalesce("b_feedback", F.lit(0.0)))


def rerank(c: DataFrame, query: str, scale: str = "absolute", group: str | None = None) -> DataFrame:
    """Candidates (pkg, name, score, ordinal, b_*) in their new order: the boosts' sum, 0.5 at most, is added to the score
    ("absolute") or lifts it by up to 30 % in whole points ("relative"); an exact name comes first; ties keep their order.

    Adds boost, final, mode (exact-match, personal, engine-only), explanation and rank.
    """
    parts = [x for x in c.columns if x.startswith("b_")]
    total = F.least(F.lit(TOTAL), sum((F.col(x) for x in parts[1:]), F.col(parts[0]))) if parts else F.lit(0.0)
    exact = F.lower(F.trim("name")) == query.strip().lower()
    final = F.col("score") + (F.col("boost") if scale == "absolute" else F.floor(F.col("boost") / TOTAL * F.col("score") * 0.3))
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(x) > 0, F.concat(F.lit(x[2:] + " +"), F.format_number(F.col(x), 3))) for x in parts])), "; ") if parts else F.lit("")
    out = c.withColumn("boost", total).withColumn("final", final).withColumn("exact", exact)
    out = out.withColumn("mode", F.when(F.col("exact"), "exact-match").when(F.col("boost") > 0, "personal").otherwise("engine-only")).withColumn("explanation", why)
    order = Window.partitionBy(group or F.lit(0)).orderBy(F.desc("exact"), F.desc("final"), "ordinal")
    return out.withColumn("rank", F.row_number().over(order)).drop("exact")


def merge_candidates(engine: DataFrame, base: DataFrame) -> DataFrame:
    """(query, pkg, engine_score, base_score) of both lists, 0 where one lacks it."""
    e = engine.select("query", "pkg", F.col("score").alias("engine_score"))
    b = base.select("query", "pkg", F.col("score").alias("base_score"))
    return e.join(b, ["query", "pkg"], "full_outer").select("query", "pkg", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("engine_score", "base_score")])


def rank_candidates(candidates: DataFrame, affinities: DataFrame | None, exact: Column | None = None, most: float = 0.5) -> DataFrame:
    """(query, pkg, personal, final, kind, rank): the larger score plus the personal boost; suppressed apps (weight -0.3 and less) last,
    exact ones first. Without affinities the engine's order stands."""
    c = candidates if affinities is None else candidates.join(affinities.select("query", "pkg", "current_weight", "confidence"), ["query", "pkg"], "left")
    w = F.col("current_weight") if affinities is not None else F.lit(None).cast("double")
    conf = F.coalesce("confidence", F.lit(1.0)) if affinities is not None else F.lit(1.0)
    personal = F.when(w > 0, F.greatest(F.lit(0.0), F.least(F.lit(most), w * conf))).otherwise(0.0)
    suppressed = F.coalesce(w <= -0.3, F.lit(False))
    out = c.withColumn("personal", personal).withColumn("final", F.greatest("engine_score", "base_score") + personal)
    is_exact = exact if exact is not None else F.lit(False)
    kind = F.when(is_exact, "exact").when(suppressed, "suppressed").when(F.col("personal") > 0, "personal").otherwise("engine")
    out = out.withColumn("kind", kind)
    order = Window.partitionBy("query").orderBy(F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "suppressed", 2).otherwise(1), F.desc("final"), "pkg")
    return out.withColumn("rank", F.row_number().over(order)).select("query", "pkg", "personal", "final", "kind", "rank")


def limit_boosts(rows: DataFrame, most: float = 0.5, group: str = "query") -> DataFrame:
    """``personal`` scaled down where a group's sum is over ``most`` per row; with each row within ``most`` it never is."""
    w = Window.partitionBy(group)
    total, cap = F.sum("personal").over(w), F.count("*").over(w) * most
    return rows.withColumn("personal", F.when(total > cap, F.col("personal") * cap / total).otherwise(F.col("personal")))


def snapshot(spark, readers: dict, schemas: dict) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables that the readers give, an empty one for each that fails, and the failed ones' names."""
    out, failed = {}, []
    for name, schema in schemas.items():
        try:
            out[name] = readers[name]()
        except Exception:  # noqa: BLE001  a reader is foreign code; its failure degrades the ranking and must not end it
            out[name] = spark.createDataFrame([], schema)
            failed.append(name)
    return out, failed

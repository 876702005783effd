"""Sessions, and patterns of time and of transition mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M


def sessions(signals: DataFrame) -> DataFrame:
    """(pkg, started_at, ended_at, duration_ms, closed) from foreground and background signals (pkg, ts_ms, event_type).

    A foreground opens a session, the next signal of the package ends it; the last one open is kept with ``closed`` false.
    """
    w = Window.partitionBy("pkg").orderBy("ts_ms", "event_type")
    rows = signals.withColumn("next", F.lead("ts_ms").over(w)).withColumn("next_type", F.lead("event_type").over(w)).where("event_type = 'foreground'")
    ended = F.coalesce("next", "ts_ms")
    return rows.select(
        "pkg", F.timestamp_millis("ts_ms").alias("started_at"), F.timestamp_millis(ended).alias("ended_at"), (ended - F.col("ts_ms")).alias("duration_ms"), (F.coalesce("next_type", F.lit("")) == "background").alias("closed")
    )


def gap_sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user, session, started_at, ended_at, n): a gap of more than ``minutes`` starts a user's next session."""
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    new = F.when(M.micros(F.col("ts")) - M.micros(F.lag("ts").over(w)) > minutes * 60_000_000, 1).otherwise(0)
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user", "session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n"))


def session_transitions(sessions_: DataFrame, longest: int = 30 * 60_000) -> DataFrame:
    """(from_pkg, to_pkg, ts, delay_ms): from the end of a user's session to the start of the next, of other packages, within ``longest``."""
    w = Window.partitionBy("user").orderBy("started_at", "pkg")
    rows = sessions_.select(F.lag("pkg").over(w).alias("from_pkg"), F.col("pkg").alias("to_pkg"), F.col("started_at").alias("ts"), F.lag("ended_at").over(w).alias("before"))
    rows = rows.withColumn("delay_ms", F.floor((M.micros(F.col("ts")) - M.micros(F.col("before"))) / 1000).cast("long"))
    return rows.where((F.col("from_pkg") != F.col("to_pkg")) & F.col("delay_ms").between(0, longest)).select("from_pkg", "to_pkg", "ts", "delay_ms")


def timing_patterns(uses: DataFrame, as_of: Column, key: list[str] = ["pkg"], full: int = 10, least: int = 3, confidence: float = 0.4, days: float = 30.0) -> DataFrame:  # noqa: B006
    """Per key, from (key, ts, duration_ms): the usual hour (the earliest of the most frequent) and its median minute, weekdays
    seen (0: Monday), hours scaled by the largest, p90 duration, and the confidence min(1, n / full) times the hour's share,
    which must reach ``confidence`` before it decays."""
    hours = [F.count_if(F.hour("ts") == h) for h in range(24)]
    minutes = F.sort_array(F.collect_list(F.struct(F.hour("ts").alias("h"), F.minute("ts").alias("m"))))
    rows = uses.groupBy(*key).agg(
        F.count("*").alias("n"), F.array(*hours).alias("hours"), minutes.alias("at"), F.array(*[F.max(F.weekday("ts") == d) for d in range(7)]).alias("weekdays"),
        F.collect_list("duration_ms").alias("durations"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    most = F.array_max("hours")
    rows = rows.withColumn("typical_hour", (F.array_position("hours", most) - 1).cast("int")).withColumn("raw", F.least(F.lit(1.0), F.col("n") / full) * (most / F.col("n")))
    kept = rows.where((F.col("n") >= least) & (F.col("raw") >= confidence))
    here = F.transform(F.filter("at", lambda x: x["h"] == F.col("typical_hour")), lambda x: x["m"])
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), M.days_between(F.col("last_seen"), as_of)) / days)
    return kept.select(
        *key, F.col("n").alias("samples"), "typical_hour", M.rounded_median(here).cast("int").alias("typical_minute"), "weekdays",
        F.transform("hours", lambda x: x / F.greatest(F.lit(1), F.array_max("hours"))).alias("hourly"), M.nearest_rank(F.col("durations"), 0.9).alias("p90_duration_ms"),
        M.round4(F.greatest(F.lit(0.05), F.col("raw") * decay)).alias("confidence"), "first_seen", "last_seen",
    )


def transition_patterns(moves: DataFrame, as_of: Column, full: int = 10, least: int = 3, confidence: float = 0.0, days: float = 30.0, longest: int = 30 * 60_000) -> DataFrame:
    """Per (from_app, to_app), from (from_app, to_app, ts, delay_ms): count, decayed count, median and p90 delay, confidence."""
    fade = F.greatest(F.lit(0.05), F.pow(F.lit(0.5), F.greatest(F.lit(0.0), M.days_between(F.col("ts"), as_of)) / days))
    rows = moves.groupBy("from_app", "to_app").agg(
        F.count("*").alias("n"), F.sum(fade).alias("weighted"), F.collect_list("delay_ms").alias("delays"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    raw = F.least(F.lit(1.0), F.col("n") / full)
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), M.days_between(F.col("last_seen"), as_of)) / days)
    median = M.rounded_median(F.col("delays"))
    return rows.where((F.col("n") >= least) & (raw >= confidence)).select(
        "from_app", "to_app", "n", M.round4(F.col("weighted")).alias("weighted"), median.cast("long").alias("median_delay_ms"), M.nearest_rank(F.col("delays"), 0.9).alias("p90_delay_ms"),
        M.round4(F.least(F.lit(1.0), median / longest)).alias("delay_penalty"), M.round4(F.greatest(F.lit(0.05), raw * decay)).alias("confidence"), "first_seen", "last_seen",
    )


def merge_patterns(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Timing patterns updated: weekdays or-ed, confidence 0.4 old and 0.6 new from three new samples on, else a light merge that
    keeps the old hour and adds a tenth of the new confidence; patterns on one side only stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "full_outer")
    here, there = F.col("n.samples").isNotNull(), F.col("o.samples").isNotNull()
    strong = F.col("n.samples") >= 3
    confidence = (
        F.when(here & there & strong, 0.4 * F.col("o.confidence") + 0.6 * F.col("n.confidence"))
        .when(here & there, F.least(F.lit(1.0), F.col("o.confidence") + 0.1 * F.col("n.confidence")))
        .otherwise(F.coalesce("o.confidence", "n.confidence"))
    )
    hour = F.when(here & (strong | ~there), F.col("n.typical_hour")).otherwise(F.col("o.typical_hour"))
    days = F.when(here & there, F.zip_with("o.weekdays", "n.weekdays", lambda a, b: a | b)).otherwise(F.coalesce("o.weekdays", "n.weekdays"))
    samples = F.coalesce("o.samples", F.lit(0)) + F.coalesce("n.samples", F.lit(0))
    return both.select(*key, samples.alias("samples"), hour.alias("typical_hour"), days.alias("weekdays"), M.round4(confidence).alias("confidence"))


def keep_patterns(patterns: DataFrame, cap: int = 1000, key: list[str] = ["pkg"]) -> DataFrame:  # noqa: B006
    """The ``cap`` patterns seen last, equal ones by key."""
    return patterns.orderBy(F.desc("last_seen"), *key).limit(cap)

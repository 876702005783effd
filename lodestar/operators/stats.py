"""Behaviour statistics over usage events (user, app, ts, ...): counts by hour, day part and day, shares, predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..plans.hints import broadcast_if_small


def top(df: DataFrame, k: int, group: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= k)


def hourly_stats(events: DataFrame, k: int = 5) -> DataFrame:
    """(hour, total, apps): all 24 hours, with their ``k`` most used apps as (app, n)."""
    counts = events.groupBy(F.hour("ts").alias("hour"), "app").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("total", F.sum("n").over(Window.partitionBy("hour")))
    best = top(ranked, k, ["hour"], F.desc("n"), F.asc("app"))
    lists = best.groupBy("hour", "total").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "app", "n"))), lambda x: F.struct(x["app"].alias("app"), x["n"].alias("n"))).alias("apps"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(lists), "hour", "left").select("hour", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("apps", F.array().cast("array<struct<app:string,n:bigint>>")).alias("apps"))


def hourly_top(events: DataFrame, k: int = 5) -> DataFrame:
    """(hour, app, n, rank) in long form."""
    counts = events.groupBy(F.hour("ts").alias("hour"), "app").agg(F.count("*").alias("n"))
    return top(counts, k, ["hour"], F.desc("n"), F.asc("app"))


def day_part_top(events: DataFrame, k: int = 3, scheme: str = "six_hours") -> DataFrame:
    """(part, app, n, rank)."""
    counts = events.groupBy(M.day_part(F.col("ts"), scheme).alias("part"), "app").agg(F.count("*").alias("n"))
    return top(counts, k, ["part"], F.desc("n"), F.asc("app"))


def full_stats(events: DataFrame, query_app: str = "view", click_app: str = "click", k: int = 3) -> DataFrame:
    """One row: queries, clicks, distinct apps and users, the ``k`` most used apps."""
    counts = events.groupBy("app").agg(F.count("*").alias("n"))
    lead = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "app"))), 1, k), lambda x: x["app"])
    by_app = counts.agg(
        F.coalesce(F.sum(F.when(F.col("app") == query_app, F.col("n"))), F.lit(0)).alias("queries"),
        F.coalesce(F.sum(F.when(F.col("app") == click_app, F.col("n"))), F.lit(0)).alias("clicks"),
        F.count("*").alias("apps"),
        F.array_join(lead, ",").alias("top_apps"),
    )
    return by_app.crossJoin(F.broadcast(events.agg(F.count_distinct("user").alias("users"))))


def time_matrix(events: DataFrame) -> DataFrame:
    """(app, h0 ... h23): counts by hour, one aggregation without a pivot's extra pass."""
    return events.groupBy("app").agg(*[F.count(F.when(F.hour("ts") == h, 1)).alias(f"h{h}") for h in range(24)])


def heatmap(events: DataFrame, as_of: Column) -> DataFrame:
    """(day, app, n, level): whole days before ``as_of``."""
    counts = events.groupBy(M.day_index(F.col("ts"), as_of).alias("day"), "app").agg(F.count("*").alias("n"))
    return counts.withColumn("level", M.heat_level(F.col("n")))


def recommend(events: DataFrame, hour: int, k: int = 5) -> DataFrame:
    """(app, score, rank): 0.4 of all uses and 0.6 of those in the hour."""
    scored = events.groupBy("app").agg((0.4 * F.count("*") + 0.6 * F.count(F.when(F.hour("ts") == hour, 1))).alias("score"))
    return top(scored, k, [], F.desc("score"), F.asc("app"))


def bubbles(events: DataFrame, hour: int, k: int = 5, recent: int = 5) -> DataFrame:
    """(app, score, rank): half the uses in the hour of its ``k`` most used apps, 0.3 of all uses of the ``k`` most used ones, less with each rank, and
    0.2 down to 0.04 for each of the last ``recent`` events."""
    counts = events.groupBy("app").agg(F.count("*").alias("n"), F.count(F.when(F.hour("ts") == hour, 1)).alias("h"))
    # no more than k rows of each kind are left before they meet
    by_hour = top(counts.where("h > 0").select("app", "h"), k, [], F.desc("h"), F.asc("app")).select("app", (0.5 * F.col("h")).alias("s"))
    overall = top(counts.select("app", "n"), k, [], F.desc("n"), F.asc("app")).select("app", (F.col("n") * ((k - F.col("rank") + 1) * 0.3 / k)).alias("s"))
    last = top(events.orderBy(F.desc("ts"), F.desc("event_id")).limit(recent).select("app", "ts", "event_id"), recent, [], F.desc("ts"), F.desc("event_id"))
    last = last.select("app", ((recent - F.col("rank") + 1) * 0.2 / recent).alias("s"))
    scored = reduce(DataFrame.unionByName, (by_hour, overall, last)).groupBy("app").agg(F.sum("s").alias("score"))
    return top(scored, k, [], F.desc(F.round("score", 9)), F.asc("app"))


def transitions(events: DataFrame) -> DataFrame:
    """(user, ts, from_app, to_app, delay_ms) of each event after the user's one before."""
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    rows = events.select("user", "ts", F.lag("app").over(w).alias("from_app"), F.col("app").alias("to_app"), F.lag("ts").over(w).alias("before"))
    delay = F.floor((M.micros(F.col("ts")) - M.micros(F.col("before"))) / 1000).cast("long")
    return rows.where("from_app is not null").select("user", "ts", "from_app", "to_app", delay.alias("delay_ms"))


def shares(edges: DataFrame, least: float = 0.0, total: int = 2, k: int | None = None) -> DataFrame:
    """(from_app, to_app, n, share): each edge's share of its source, from ``least`` on, of sources with ``total`` uses."""
    counts = edges.groupBy("from_app", "to_app").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("from_app"))
    rows = counts.withColumn("whole", whole).withColumn("share", F.floor(F.col("n") / F.col("whole") * 100 + 0.5) / 100)
    rows = rows.where((F.col("n") / F.col("whole") >= least) & (F.col("whole") >= total)).select("from_app", "to_app", "n", "share")
    return rows if k is None else top(rows, k, ["from_app"], F.desc("n"), F.asc("to_app")).drop("rank")


def query_bubbles(edges: DataFrame, members: DataFrame, share: float = 0.6, k: int = 3) -> DataFrame:
    """(query, app, score, rank): edges (query, app, weight) with ``share`` of the query's weight, then at 0.5 the apps that share an
    intent (query, app) with it; each app once."""
    part = F.col("weight") / F.sum("weight").over(Window.partitionBy("query"))
    strong = edges.withColumn("score", part).where(F.col("score") >= share).select("query", "app", "score", F.lit(0).alias("source"))
    rows = strong.unionByName(members.select("query", "app", F.lit(0.5).alias("score"), F.lit(1).alias("source")))
    one = rows.groupBy("query", "app").agg(F.min_by(F.struct("score", "source"), "source").alias("x")).select("query", "app", "x.*")
    return top(one, k, ["query"], F.asc("source"), F.desc("score"), F.asc("app")).drop("source")


def bayes(observed: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """(query, bucket, app, p): P(app | query, bucket) from observations (query, app, bucket), or P(app | query) where the bucket
    has under ``least`` of them; of asked (query, bucket), with ``least`` observations of the query."""
    by = observed.groupBy("query", "bucket", "app").agg(F.count("*").alias("n"))
    q = by.join(broadcast_if_small(asked.select("query").distinct()), "query", "left_semi")
    in_bucket = q.withColumn("whole", F.sum("n").over(Window.partitionBy("query", "bucket"))).where(F.col("whole") >= least)
    first = asked.join(in_bucket, ["query", "bucket"]).select("query", "bucket", "app", (F.col("n") / F.col("whole")).alias("p"))
    overall = q.groupBy("query", "app").agg(F.sum("n").alias("n")).withColumn("whole", F.sum("n").over(Window.partitionBy("query"))).where(F.col("whole") >= least)
    poor = asked.join(in_bucket.select("query", "bucket").distinct(), ["query", "bucket"], "left_anti")
    return first.unionByName(poor.join(overall, "query").select("query", "bucket", "app", (F.col("n") / F.col("whole")).alias("p")))


def mode_frequency(modes: DataFrame) -> DataFrame:
    """(mode, n, boost) of match kinds used (mode)."""
    counts = modes.groupBy("mode").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).select("mode", "n", M.mode_boost(F.col("n"), F.col("total")).alias("boost"))


def daily_usage(usage: DataFrame, scheme: str = "late_night") -> DataFrame:
    """(date, app, launches, duration, last_used, parts): parts maps day parts to launches."""
    by = usage.groupBy(F.to_date("ts").alias("date"), "app", M.day_part(F.col("ts"), scheme).alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("d"), F.max("ts").alias("t"))
    return by.groupBy("date", "app").agg(
        F.sum("n").alias("launches"), F.sum("d").alias("duration"), F.max("t").alias("last_used"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "n")))).alias("parts")
    )


def daily_totals(usage: DataFrame, ok: Column, k: int = 3) -> DataFrame:
    """(date, n, successes, top_apps) of each day."""
    by = usage.groupBy(F.to_date("ts").alias("date"), "app").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    lead = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "app"))), 1, k), lambda x: x["app"])
    return by.groupBy("date").agg(F.sum("n").alias("n"), F.sum("ok").alias("successes"), F.array_join(lead, ",").alias("top_apps"))


def keyword_stats(searches: DataFrame) -> DataFrame:
    """(keyword, n, clicks, apps): apps maps clicked apps to clicks; searches: (keyword, app), app null without a click."""
    by = searches.groupBy("keyword", "app").agg(F.count("*").alias("n"))
    clicked = F.filter(F.sort_array(F.collect_list(F.struct("app", "n"))), lambda x: x["app"].isNotNull())
    return by.groupBy("keyword").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("app").isNotNull(), F.col("n"))), F.lit(0)).alias("clicks"), F.map_from_entries(clicked).alias("apps"))


def gesture_stats(gestures: DataFrame, ok: Column) -> DataFrame:
    """(gesture, triggers, successes, last)."""
    return gestures.groupBy("gesture").agg(F.count("*").alias("triggers"), F.count_if(ok).alias("successes"), F.max("ts").alias("last"))


def since(events: DataFrame, marks: DataFrame) -> DataFrame:
    """(app, n, mark): events after each app's high-water mark (app, mark), and the new mark."""
    new = events.join(broadcast_if_small(marks), "app", "left").where(F.col("mark").isNull() | (F.col("ts") > F.col("mark")))
    return new.groupBy("app").agg(F.count("*").alias("n"), F.max("ts").alias("mark"))


def summary(events: DataFrame) -> DataFrame:
    """One row: totals, active days, the favourite app, counts by weekday (0: Monday) and day part."""
    by = events.groupBy(F.to_date("ts").alias("date"), "app", M.day_part(F.col("ts"), "late_night").alias("part")).agg(F.count("*").alias("n"))
    apps = by.groupBy("app").agg(F.sum("n").alias("n")).agg(F.max_by("app", F.struct("n", "app")).alias("favourite"))
    week = [F.sum(F.when(F.weekday("date") == d, F.col("n")).otherwise(0)).alias(f"weekday_{d}") for d in range(7)]
    parts = [F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(p) for p in ("morning", "afternoon", "evening", "night")]
    return by.agg(F.sum("n").alias("total"), F.count_distinct("date").alias("active_days"), *week, *parts).crossJoin(apps)


def predict_slots(events: DataFrame, hour: int, in_slot: int = 3, all_day: int = 2, slots: int = 5) -> DataFrame:
    """(app, source, rank): the hour's most used, then the day's, then the most recent, then the rest in order of a hash; each once."""
    counts = events.groupBy("app").agg(F.count("*").alias("n"), F.count(F.when(F.hour("ts") == hour, 1)).alias("h"), F.max("ts").alias("last"))
    first = top(counts.where("h > 0"), in_slot, [], F.desc("h"), F.asc("app")).select("app", F.lit(0).alias("source"), F.col("rank").alias("nth"))
    rest = counts.join(first.select("app"), "app", "left_anti")
    second = top(rest, all_day, [], F.desc("n"), F.asc("app")).select("app", F.lit(1).alias("source"), F.col("rank").alias("nth"))
    third = rest.join(second.select("app"), "app", "left_anti")
    third = top(third, slots, [], F.desc("last"), F.asc(F.xxhash64("app"))).select("app", F.lit(2).alias("source"), F.col("rank").alias("nth"))
    return top(reduce(DataFrame.unionByName, (first, second, third)), slots, [], F.asc("source"), F.asc("nth")).drop("nth")


def user_vectors(events: DataFrame, intents: DataFrame, categories: list[str], k: int = 10, dims: int = 65) -> DataFrame:
    """(user, vector): shares of the 24 hours, of intents (user, intent number 0 to 10) and categories, and of the top ``k`` apps, each
    part scaled by its largest entry; cut or padded to ``dims``."""

    def scaled(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.transform(counts, lambda x: F.when(most > 0, x / most).otherwise(0.0))

    hours = events.groupBy("user").agg(F.array(*[F.count_if(F.hour("ts") == h) for h in range(24)]).alias("hours"), F.array(*[F.count_if(F.col("app") == c) for c in categories]).alias("cats"))
    whims = intents.groupBy("user").agg(F.array(*[F.count_if(F.col("intent") == i) for i in range(11)]).alias("intents"))
    used = events.groupBy("user", "app").agg(F.count("*").alias("n")).groupBy("user").agg(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, k).alias("apps"))
    joined = hours.join(whims, "user", "left").join(used, "user", "left")
    zero = F.array_repeat(F.lit(0).cast("bigint"), 11)
    apps = F.concat("apps", F.array_repeat(F.lit(0).cast("bigint"), F.lit(k) - F.size("apps")))
    whole = F.concat(scaled(F.col("hours")), scaled(F.coalesce("intents", zero)), scaled(F.col("cats")), scaled(apps))
    return joined.select("user", M.fit_dims(F.transform(whole, lambda x: x.cast("float")), dims).alias("vector"))


def pending(searches: DataFrame, cap: int = 120) -> DataFrame:
    """(query, n, users, first_seen, last_seen): unknown queries (query, user, ts), the ``cap`` most recent of them."""
    rows = searches.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return rows.orderBy(F.desc("last_seen"), "query").limit(cap)


def grouped(signals: DataFrame, key: str) -> DataFrame:
    """(key, items, n): the rows of each key, oldest first."""
    items = F.sort_array(F.collect_list(F.struct("ts", *[c for c in signals.columns if c not in (key, "ts")])))
    return signals.groupBy(key).agg(items.alias("items"), F.count("*").alias("n"))


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))

"""Learning from selections. What depends on the order of events is a fold per query (Arrow groups); the rest is expressions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X

DAY = 86_400.0


def click_increment(rank: Column, repeat: Column, length: Column) -> Column:
    """0.15 for a first click; for another 0.1, and 0.05 at rank 1 or 0.2 at rank 0 and beyond 3; half for queries up to two letters."""
    inc = F.when(~repeat, 0.15).otherwise(0.1 + F.when(rank == 1, 0.05).when((rank == 0) | (rank > 3), 0.2).otherwise(0.0))
    return inc * F.when((length > 0) & (length <= 2), 0.5).otherwise(1.0)


def personal_boost(weight: Column, confidence: Column, most: float = 0.5) -> Column:
    return F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(most), weight * F.coalesce(confidence, F.lit(1.0))))).otherwise(0.0)


def suppressed(weight: Column) -> Column:
    return F.coalesce(weight <= -0.3, F.lit(False))


def alias_status(status: Column, weight: Column, confidence: Column, expires: Column, as_of: Column) -> Column:
    """deleted stays; expired or weight -0.3 and less: suppressed; confidence 0.6 up: active; 0.3 up: active or candidate stays,
    else candidate; less: candidate unless suppressed."""
    c = F.coalesce(confidence, F.lit(0.0))
    low = F.when(status == "suppressed", "suppressed").otherwise("candidate")
    middle = F.when(status.isin("candidate", "active"), status).otherwise("candidate")
    return F.when(status == "deleted", "deleted").when((expires < as_of) | (weight <= -0.3), "suppressed").when(c >= 0.6, "active").when(c >= 0.3, middle).otherwise(low)


# --- affinities ------------------------------------------------------------------------------------------------------


def _increment(rank: int, repeat: bool, query: str) -> float:
    inc = 0.15 if not repeat else 0.1 + (0.05 if rank == 1 else 0.2 if rank == 0 or rank > 3 else 0.0)
    n = len("".join(query.split()))
    return inc * 0.5 if 0 < n <= 2 else inc


def _decay(last: float, now: float) -> float:
    return 1.0 if now <= last else max(0.05, 0.5 ** ((now - last) / DAY / 30))


def fold_affinities(query: str, events: Iterable[tuple], state: dict | None = None) -> dict[str, dict]:
    """Fold a query's events (ts in s, app, rank, day part, kind) in order into app -> affinity.

    "select" raises its app and corrects the query's other apps by 0.15, half as much again when the selections change app
    twice in a row; "negative" lowers its app by 0.075. A correction's effect on the weight lasts as a count that every later
    selection of the app subtracts again.
    """
    out = dict(state or {})
    before, changes = None, 0
    for ts, app, rank, part, kind in events:
        a = out.get(app)
        if kind == "negative":
            if a:
                a["negatives"] += 1
                a["last"] = ts
                a["current"] -= 0.075
                a["confidence"] = min(1.0, max(0.0, a["current"]))
            continue
        if a is None:
            inc = _increment(rank, False, query)
            out[app] = {"count": 1, "weighted": inc, "current": inc, "confidence": min(1.0, inc), "corrections": 0, "negatives": 0, "first": ts, "last": ts, "parts": {part: [1, float(rank)]}}
        else:
            a["weighted"] = a["weighted"] * _decay(a["last"], ts) + _increment(rank, True, query)
            a["count"] += 1
            a["last"] = ts
            n, mean = a["parts"].get(part, [0, 0.0])
            a["parts"][part] = [n + 1, (mean * n + rank) / (n + 1)]
            a["confidence"] = min(1.0, max(0.0, a["weighted"]))
            a["current"] = a["weighted"] - a["corrections"] * 0.15 - a["negatives"] * 0.075
        changes = changes + 1 if before not in (None, app) else 0
        if changes:
            for other, o in out.items():
                if other != app:
                    o["corrections"] += 1
                    o["last"] = ts
                    o["current"] -= 0.15 * (1.5 if changes > 1 else 1.0)
                    o["confidence"] = min(1.0, max(0.0, o["current"]))
        before = app
    return out


AFFINITY = "query string, app string, selections long, weighted double, current_weight double, confidence double, corrections long, negatives long, first_seen timestamp, last_seen timestamp"


def affinities(events: DataFrame) -> DataFrame:
    """Affinities from events (query, app, rank, ts, part, kind); one group per query, as a click changes its siblings too."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "app", "rank"], kind="stable")
        query = pdf["query"].iloc[0]
        seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
        found = fold_affinities(query, zip(seconds, pdf["app"], pdf["rank"], pdf["part"], pdf["kind"]))
        rows = [(query, app, a["count"], a["weighted"], a["current"], a["confidence"], a["corrections"], a["negatives"], pd.Timestamp(round(a["first"] * 1e6), unit="us"), pd.Timestamp(round(a["last"] * 1e6), unit="us")) for app, a in sorted(found.items())]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in AFFINITY.split(", ")])

    return events.select("query", "app", "rank", "ts", "part", "kind").groupBy("query").applyInPandas(fold, AFFINITY)


def aliases(affinity: DataFrame) -> DataFrame:
    """(query, app, status, current_weight): the app of the largest weight stands for the query; without a positive one it is suppressed."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("current_weight"), "app"))
    one = affinity.withColumn("_n", best).where("_n = 1")
    status = F.when(F.col("current_weight") <= 0, "suppressed").when(F.col("confidence") >= 0.6, "active").otherwise("candidate")
    return one.select("query", "app", status.alias("status"), "current_weight")


def boosts_for(affinity: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, app, boost, suppressed) of candidates; 0 without an affinity."""
    j = candidates.select("query", "app").join(affinity.select("query", "app", "current_weight", "confidence"), ["query", "app"], "left")
    return j.select("query", "app", personal_boost(F.col("current_weight"), F.col("confidence")).alias("boost"), suppressed(F.col("current_weight")).alias("suppressed"))


# --- negative feedback -----------------------------------------------------------------------------------------------


def fold_feedback(impressions: Iterable[tuple[float, list[str], str]], weights: dict | None = None, ignored: dict | None = None) -> tuple[dict, dict]:
    """Fold (ts in s, shown apps, clicked app) in order into (app -> weight in 0..1, app -> times ignored in a row).

    Weights decay to 0.5 after a day. Apps above the clicked one lose (times 0.7 above rank 1; 0.05 when the click came in the
    last third of ten and more; else 0.08) and are 0 after being ignored three times; the clicked one wins 0.24, 0.12, 0.2 or
    0.06. From rank 3 on it takes 15 % of each app above it; at rank 1 and 2 those lose another fifth for being seen.
    """
    w, skipped, last = dict(weights or {}), dict(ignored or {}), None
    clip = lambda x: max(0.0, min(1.0, x))
    for ts, shown, clicked in impressions:
        if last is not None and (ts - last) / DAY >= 1:
            factor = 0.5 ** ((ts - last) / DAY / 30)
            for app, cur in w.items():
                new = max(0.35, 0.5 + (cur - 0.5) * factor)
                if abs(new - cur) > 0.001:
                    w[app] = clip(new)
        if clicked not in shown:
            continue
        at, late = shown.index(clicked), len(shown) >= 10 and shown.index(clicked) >= int(len(shown) * 0.7)
        for i, app in enumerate(shown):
            cur = w.get(app, 0.5)
            if i < at:
                cur = cur * 0.7 if at == 1 else cur - (0.05 if late else 0.08)
                skipped[app] = skipped.get(app, 0) + 1
                if skipped[app] >= 3:
                    cur = 0.0
            elif app == clicked:
                skipped[app] = 0
                cur += 0.24 if late else 0.12 if at == 1 else 0.2 if at > 1 else 0.06
            w[app] = clip(cur)
        if at >= 3:
            taken = 0.0
            for app in shown[:at]:
                taken += w[app] * 0.15
                w[app] = clip(w[app] * 0.85)
            w[clicked] = clip(w[clicked] + taken)
        elif at >= 1:
            for app in shown[:at]:
                w[app] = clip(w[app] * 0.8)
        last = ts
    return w, skipped


def feedback_weights(impressions: DataFrame) -> DataFrame:
    """(query, app, weight, ignored) from impressions (query, ts, shown array, clicked)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "clicked"], kind="stable")
        seconds = pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6
        w, skipped = fold_feedback((t, list(s), c) for t, s, c in zip(seconds, pdf["shown"], pdf["clicked"]))
        return pd.DataFrame([(pdf["query"].iloc[0], a, x, skipped.get(a, 0)) for a, x in sorted(w.items())], columns=["query", "app", "weight", "ignored"])

    return impressions.select("query", "ts", "shown", "clicked").groupBy("query").applyInPandas(fold, "query string, app string, weight double, ignored long")


def transfer(weights: DataFrame, ratio: float = 0.2) -> DataFrame:
    """(query, app, weight) after what similar queries know: their distance from 0.5 times ``ratio``, clamped after each in their order.

    Similar queries share their first two characters or half their characters; the pairs are blocked by shared characters.
    """
    q = weights.select("query").distinct()
    keys = q.select("query", F.explode(F.array_distinct(X.chars(F.lower("query")))).alias("ch"))
    pairs = keys.join(keys.withColumnRenamed("query", "other"), "ch").where("query <> other").select("query", "other").distinct()
    pairs = pairs.where(X.is_similar(F.col("query"), F.col("other")))
    known = pairs.join(weights.select(F.col("query").alias("other"), "app", (F.col("weight") - 0.5).alias("d")), "other")
    steps = known.groupBy("query", "app").agg(F.transform(F.sort_array(F.collect_list(F.struct("other", "d"))), lambda x: x["d"]).alias("ds"))
    fold = F.aggregate(F.coalesce("ds", F.array().cast("array<double>")), F.col("weight"), lambda w, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w + d * ratio)))
    return weights.join(steps, ["query", "app"], "left").select("query", "app", fold.alias("weight"))


def global_preference(clicks: DataFrame, step: float = 0.05) -> DataFrame:
    """(app, preference): 0.5 and 0.05 more a click, 1 at most."""
    return clicks.groupBy("app").agg(F.least(F.lit(1.0), 0.5 + step * F.count("*")).alias("preference"))


def click_delay(clicks: DataFrame, alpha: float = 0.15, start: float = 600.0) -> DataFrame:
    """(user, n, average, multiplier): moving average of delays (user, ts, delay_ms) and the confidence it gives."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "delay_ms"))), lambda x: x["delay_ms"].cast("double"))
    rows = clicks.groupBy("user").agg(F.count("*").alias("n"), ordered.alias("d"))
    return rows.select("user", "n", M.ema(F.col("d"), alpha, start).alias("average")).withColumn("multiplier", M.click_multiplier(F.col("average"), F.col("n")))


def hesitation(factors: Column, swapped: Column | None = None) -> Column:
    """80 ms more when one of the first three keys is far off (factor under 0.8), or letters were swapped."""
    far = F.exists(F.slice(factors, 1, 3), lambda x: x < 0.8)
    return F.when(far | (swapped if swapped is not None else F.lit(False)), 80).otherwise(0)


def self_heal(weights: DataFrame, corrections: DataFrame, rule: str = "soft", first: int = 6) -> tuple[DataFrame, DataFrame]:
    """(weights, block flags) after corrections (query, candidate, place, new_app, ts, text_match), a row for each candidate shown.

    "soft": of the ``first`` candidates, others than the new app keep 0.85 of their weight (0.5 if they had none) if they matched the text,
    else half and a block flag of three days; the new app gains 0.3 (on 0.6) once a correction; each step within 0 and 1, in order of time.
    "hard": candidates lose 0.5 and the new app wins 1, without bounds.
    """
    shown = corrections.where((F.col("place") < first) & (F.col("candidate") != F.col("new_app")))
    op = lambda df, app, kind: df.select("query", F.col(app).alias("app"), "ts", kind.alias("kind"))
    lose = op(shown, "candidate", F.when(F.col("text_match"), F.lit(1)).otherwise(0))
    win = op(corrections.select("query", "new_app", "ts").distinct(), "new_app", F.lit(2))
    # a key's corrections, in order; what came at once is taken from the least kind on
    steps = lose.unionByName(win).groupBy("query", "app").agg(F.sort_array(F.collect_list(F.struct("ts", "kind"))).alias("steps"))
    both = weights.join(steps, ["query", "app"], "full")

    def soft(w, x):
        start = F.coalesce(w, F.when(x["kind"] == 2, 0.6).otherwise(0.5))
        new = F.when(x["kind"] == 2, start + 0.3).when(x["kind"] == 1, start * 0.85).otherwise(start * 0.5)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), new))

    def hard(w, x):
        return F.coalesce(w, F.lit(0.0)) + F.when(x["kind"] == 2, 1.0).otherwise(-0.5)

    told = F.aggregate("steps", F.col("weight").cast("double"), soft if rule == "soft" else hard)
    flags = shown.where(~F.col("text_match")).select("query", F.col("candidate").alias("app"), (F.col("ts") + F.expr("interval 3 days")).alias("expire_ts"), F.col("ts").alias("created_ts"))
    return both.select("query", "app", F.coalesce(F.when(F.col("steps").isNotNull(), told), F.col("weight").cast("double")).alias("weight")), flags


def healing_history(corrections: DataFrame, n: int = 10) -> DataFrame:
    from .maintain import last_n

    return last_n(corrections, n, "ts", ["query"], "new_app")


def block(flags: DataFrame, add: DataFrame, remove: DataFrame, as_of: Column, cap: int = 200) -> DataFrame:
    """Flags with others added (query, app, expire_ts, created_ts; the newer counts) or removed (query, app), expired ones dropped."""
    from .maintain import live_flags

    rows = flags.unionByName(add).groupBy("query", "app").agg(F.max_by(F.struct("expire_ts", "created_ts"), "created_ts").alias("x")).select("query", "app", "x.*")
    return live_flags(rows.join(remove.select("query", "app"), ["query", "app"], "left_anti"), as_of, cap)


def bayes_table(observed: DataFrame, cap: int = 220) -> DataFrame:
    """(query, app, bucket, n, last_ts) of the ``cap`` queries seen last, then most often."""
    by = observed.groupBy("query", "app", "bucket").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    keep = by.groupBy("query").agg(F.max("last_ts").alias("t"), F.max("n").alias("m")).orderBy(F.desc("t"), F.desc("m"), "query").limit(cap)
    return by.join(keep.select("query"), "query", "left_semi")


def remind(edges: DataFrame, uses: DataFrame, blocked: DataFrame, from_app: str | None, hour: int, weekday: int, k: int = 1) -> DataFrame:
    """(app, score, rank): chain share 0.5 (without a source app the sum of all apps' shares, at 0.4), the hour's share 0.25, the weekday and hour's
    0.15, the overall one 0.10, over the sum of the parts that have anything; blocked apps out."""

    def share(counts: DataFrame, weight: float) -> DataFrame:
        return counts.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select("app", (F.col("s") * weight).alias("s"), F.lit(weight).alias("w"))

    edges = edges.where("weight > 0")
    if from_app:
        chain = share(edges.where(F.col("from_app") == from_app).groupBy(F.col("to_app").alias("app")).agg(F.sum("weight").alias("n")), 0.5)
    else:  # each source app's shares
        whole = edges.groupBy("from_app").agg(F.sum("weight").alias("whole"))
        part = edges.join(whole, "from_app").select(F.col("to_app").alias("app"), (F.col("weight") / F.col("whole")).alias("s"))
        chain = part.groupBy("app").agg((0.5 * 0.4 * F.sum("s")).alias("s")).withColumn("w", F.lit(0.5))
    by_hour = uses.where(F.hour("ts") == hour)
    count = lambda d: d.groupBy("app").agg(F.count("*").alias("n"))
    parts = (chain, share(count(by_hour), 0.25), share(count(by_hour.where(F.weekday("ts") == weekday)), 0.15), share(count(uses), 0.10))
    rows = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part", F.lit(i)))
    active = rows.select("part", "w").distinct().agg(F.sum("w").alias("active"))
    total = rows.groupBy("app").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(active)).select("app", (F.col("s") / F.col("active")).alias("score"))
    free = total.join(blocked.select("app").distinct(), "app", "left_anti")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 9)), "app"))
    return free.withColumn("rank", rank).where(F.col("rank") <= k)


def reminder_blocks(feedback: DataFrame, as_of: Column) -> DataFrame:
    """(app, until): rejected apps rest three days, ignored ones one."""
    days = F.when(F.col("action") == "rejected", 3).when(F.col("action") == "ignored", 1)
    rows = feedback.where(F.col("action").isin("rejected", "ignored")).withColumn("until", F.col("ts") + F.make_dt_interval(days))
    return rows.groupBy("app").agg(F.max("until").alias("until")).where(F.col("until") > as_of)


def throttled(shown: DataFrame, minutes: int = 5) -> DataFrame:
    """Reminders (app, ts) without those within ``minutes`` of the one shown before, as a fold over the accepted ones."""
    times = F.sort_array(F.collect_list("ts"))
    gap = minutes * 60_000_000
    kept = F.aggregate(times, F.array().cast("array<timestamp>"), lambda s, t: F.when((F.size(s) == 0) | (M.micros(t) - M.micros(F.element_at(s, -1)) >= gap), F.array_append(s, t)).otherwise(s))
    return shown.groupBy("app").agg(kept.alias("ts")).select("app", F.explode("ts").alias("ts"))


def record(memory: DataFrame, searches: DataFrame) -> DataFrame:
    """Memory with the searches appended."""
    return memory.unionByName(searches, allowMissingColumns=True)


def is_misfire(search_ts: Column, click_ts: Column, ms: int = 120) -> Column:
    return F.coalesce(M.millis(click_ts) - M.millis(search_ts) < ms, F.lit(False))


def matched_selections(events: DataFrame, search: str = "view", click: str = "click") -> DataFrame:
    """(user, click_id, search_id, search_ts, ts, misfire): each click with the user's last search before it."""
    w = Window.partitionBy("user").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = F.when(F.col("app") == search, F.struct("event_id", "ts"))
    rows = events.where(F.col("app").isin(search, click)).withColumn("s", F.last(s, ignorenulls=True).over(w)).where((F.col("app") == click) & F.col("s").isNotNull())
    return rows.select("user", F.col("event_id").alias("click_id"), F.col("s.event_id").alias("search_id"), F.col("s.ts").alias("search_ts"), "ts", is_misfire(F.col("s.ts"), F.col("ts")).alias("misfire"))


def replace_usage(apps: DataFrame, uses: DataFrame) -> DataFrame:
    """The catalogue with its uses replaced by (app_id, uses), 0 where there are none."""
    return apps.drop("uses").join(uses.select("app_id", "uses"), "app_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def recent_feedback(feedback: DataFrame, rule: str | None = None, action: str | None = None, since: Column | None = None, k: int = 50) -> DataFrame:
    rows = feedback
    for name, value in (("rule", rule), ("action", action)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return (rows if since is None else rows.where(F.col("ts") >= since)).orderBy(F.desc("ts"), F.desc("event_id") if "event_id" in rows.columns else F.lit(0)).limit(k)

"""Registered queries over events: statistics, patterns, ranking, learning, upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..operators import learn as L
from ..operators import maintain, patterns, rank, retrieve, semantic, stats, vector
from ..sources import corpus, tables
from . import roles
from .queries import AS_OF, as_of, r6, register
from .roles import table

_E = "e as (select event_id, ts, user_id as usr, event_type as app, value from events)"
_MOVES = f"{_E}, m as (select usr, ts, lag(app) over w as from_app, app as to_app, (epoch_us(ts) - epoch_us(lag(ts) over w)) // 1000 as delay_ms from e window w as (partition by usr order by ts, event_id))"


@register(f"""with {_E}, c as (select hour(ts) as hour, app, count(*) as n from e group by all), r as (select *, sum(n) over (partition by hour) as total, row_number() over (partition by hour order by n desc, app) as rank from c)
 select h as hour, cast(coalesce(any_value(total), 0) as bigint) as total, coalesce(string_agg(app || ':' || n, ',' order by rank), '') as apps from range(24) t(h) left join (select * from r where rank <= 5) r on r.hour = h group by 1""")
def hourly_stats(spark, sf_dir):
    """AGG1: all 24 hours with their top apps."""
    s = stats.hourly_stats(roles.usage(spark, sf_dir))
    return s.select(F.col("hour").cast("long").alias("hour"), "total", F.array_join(F.transform("apps", lambda x: F.concat(x["app"], F.lit(":"), x["n"].cast("string"))), ",").alias("apps"))


@register(f"""with {_E}, c as (select hour(ts) as hour, app, count(*) as n from e group by all) select hour, app, n, rank from (select *, row_number() over (partition by hour order by n desc, app) as rank from c) where rank <= 3""")
def hourly_top_apps(spark, sf_dir):
    """AGG1, WIN2."""
    return stats.hourly_top(roles.usage(spark, sf_dir), 3)


@register(f"""with {_E}, c as (select case when hour(ts) < 6 then 'night' when hour(ts) < 12 then 'morning' when hour(ts) < 18 then 'afternoon' else 'evening' end as part, app, count(*) as n from e group by all)
 select part, app, n, rank from (select *, row_number() over (partition by part order by n desc, app) as rank from c) where rank <= 3""")
def daypart_top_apps(spark, sf_dir):
    """AGG2."""
    return stats.day_part_top(roles.usage(spark, sf_dir))


@register(f"""with {_E} select cast(count(*) filter (app = 'view') as bigint) as queries, cast(count(*) filter (app = 'click') as bigint) as clicks, count(distinct app) as apps,
 (select string_agg(app, ',' order by n desc, app) from (select app, count(*) as n from e group by 1 order by n desc, app limit 3)) as top_apps, count(distinct usr) as users from e""")
def full_stats(spark, sf_dir):
    """AGG3."""
    return stats.full_stats(roles.usage(spark, sf_dir))


@register(f"with {_E} select app, " + ", ".join(f"count(*) filter (hour(ts) = {h}) as h{h}" for h in range(24)) + " from e group by 1")
def time_matrix(spark, sf_dir):
    """AGG4."""
    return stats.time_matrix(roles.usage(spark, sf_dir))


@register(f"""with {_E}, c as (select cast(floor((epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6) as bigint) as day, app, count(*) as n from e group by all)
 select *, case when n <= 0 then 0 when n <= 1 then 1 when n <= 3 then 2 when n <= 6 then 3 when n <= 10 then 4 else 5 end as level from c""")
def heatmap_levels(spark, sf_dir):
    """AGG5, DAT3."""
    return stats.heatmap(roles.usage(spark, sf_dir), as_of(spark, sf_dir))


@register(f"""with {_E}, s as (select app, 0.4 * count(*) + 0.6 * count(*) filter (hour(ts) = 9) as score from e group by 1) select app, cast(round(score, 6) as double) as score, row_number() over (order by score desc, app) as rank from s""")
def recommendations(spark, sf_dir):
    """AGG6."""
    return stats.recommend(roles.usage(spark, sf_dir), 9).withColumn("score", r6("score"))


@register(f"""with {_E}, c as (select app, count(*) as n, count(*) filter (hour(ts) = 9) as h from e group by 1), p as (select app, 0.5 * h as s from (select * from c where h > 0 order by h desc, app limit 5)
 union all select app, n * ((6 - row_number() over (order by n desc, app)) * 0.3 / 5) from (select * from c order by n desc, app limit 5)
 union all select app, (6 - row_number() over (order by ts desc, event_id desc)) * 0.2 / 5 from (select * from e order by ts desc, event_id desc limit 5)),
 t as (select app, sum(cast(s as double)) as score from p group by 1), r as (select app, round(score, 6) as score, row_number() over (order by round(score, 9) desc, app) as rank from t) select * from r where rank <= 5""")
def quick_bubbles(spark, sf_dir):
    """AGG7, WIN7."""
    return stats.bubbles(roles.usage(spark, sf_dir), 9).withColumn("score", r6("score"))


@register(f"""with {_MOVES}, c as (select from_app, to_app, count(*) as n from m where from_app is not null group by all) select from_app, to_app, n, floor(n / sum(n) over (partition by from_app) * 100 + 0.5) / 100 as share from c""")
def transition_share(spark, sf_dir):
    """AGG9, JN10, WIN4, WIN5."""
    return stats.shares(stats.transitions(roles.usage(spark, sf_dir)))


@register(f"""with {_E}, o as (select cast(usr % 20 as varchar) as query, app, case when hour(ts) < 12 then 'am' else 'pm' end as bucket from e), b as (select query, bucket, app, count(*) as n from o group by all)
 select query, bucket, app, round(n / sum(n) over (partition by query, bucket), 6) as p from b""")
def bayes_predict(spark, sf_dir):
    """AGG10: every bucket here has its two observations; the fallback is tested in Python."""
    o = roles.usage(spark, sf_dir).select((F.col("user") % 20).cast("string").alias("query"), "app", F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("bucket"))
    return stats.bayes(o, o.select("query", "bucket").distinct()).withColumn("p", r6("p"))


@register(f"""with {_E}, c as (select app as mode, count(*) as n from e group by 1) select mode, n, cast(case when n / sum(n) over () > 0.2 then least(40, floor((n / sum(n) over () - 0.2) * 100 + 0.5)) else 0 end as bigint) as boost from c""")
def mode_boosts(spark, sf_dir):
    """AGG11."""
    return stats.mode_frequency(roles.usage(spark, sf_dir).select(F.col("app").alias("mode"))).withColumn("boost", F.col("boost").cast("long"))


@register(f"""with {_E}, b as (select cast(ts as date) as date, app, case when hour(ts) >= 22 or hour(ts) < 6 then 'night' when hour(ts) < 12 then 'morning' when hour(ts) < 18 then 'afternoon' else 'evening' end as part, count(*) as n, sum(value) as d, max(ts) as t from e group by all)
 select cast(date as varchar) as date, app, cast(sum(n) as bigint) as launches, round(sum(d), 4) as duration, max(t) as last_used, string_agg(part || ':' || n, ',' order by part) as parts from b group by 1, 2""")
def daily_usage(spark, sf_dir):
    """AGG12."""
    d = stats.daily_usage(roles.usage(spark, sf_dir))
    parts = F.array_join(F.transform(F.sort_array(F.map_entries("parts")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return d.select(F.col("date").cast("string").alias("date"), "app", "launches", F.round("duration", 4).alias("duration"), "last_used", parts.alias("parts"))


@register(f"""with {_E}, b as (select cast(ts as date) as date, app, count(*) as n, count(*) filter (value > 50) as ok from e group by all), r as (select *, row_number() over (partition by date order by n desc, app) as r from b)
 select cast(date as varchar) as date, cast(sum(n) as bigint) as n, cast(sum(ok) as bigint) as successes, string_agg(app, ',' order by r) filter (r <= 3) as top_apps from r group by 1""")
def daily_totals(spark, sf_dir):
    """AGG12."""
    return stats.daily_totals(roles.usage(spark, sf_dir), F.col("value") > 50).withColumn("date", F.col("date").cast("string"))


@register(f"""with {_E}, s as (select cast(usr % 25 as varchar) as keyword, case when app in ('click', 'purchase') then app end as app from e), b as (select keyword, app, count(*) as n from s group by all)
 select keyword, cast(sum(n) as bigint) as n, cast(coalesce(sum(n) filter (app is not null), 0) as bigint) as clicks, coalesce(string_agg(app || ':' || n, ',' order by app) filter (app is not null), '') as apps from b group by 1""")
def keyword_stats(spark, sf_dir):
    """AGG13."""
    s = roles.usage(spark, sf_dir).select((F.col("user") % 25).cast("string").alias("keyword"), F.when(F.col("app").isin("click", "purchase"), F.col("app")).alias("app"))
    apps = F.array_join(F.transform(F.sort_array(F.map_entries("apps")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return stats.keyword_stats(s).select("keyword", "n", "clicks", apps.alias("apps"))


@register(f"with {_E} select app as gesture, count(*) as triggers, count(*) filter (value > 20) as successes, max(ts) as last from e group by 1")
def gesture_stats(spark, sf_dir):
    """AGG14, WIN6."""
    return stats.gesture_stats(roles.usage(spark, sf_dir).withColumnRenamed("app", "gesture"), F.col("value") > 20)


@register(f"with {_E}, m as (select app, max(ts) as mark from e where ts < timestamp '2024-01-15' group by 1) select e.app, count(*) as n, max(ts) as mark from e left join m using (app) where m.mark is null or ts > m.mark group by 1")
def usage_delta(spark, sf_dir):
    """AGG15: what came after each app's high-water mark."""
    e = roles.usage(spark, sf_dir)
    marks = e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("app").agg(F.max("ts").alias("mark"))
    return stats.since(e, marks)


@register(f"""with {_E} select count(*) as total, count(distinct cast(ts as date)) as active_days, """ + ", ".join(f"count(*) filter (isodow(ts) = {d + 1}) as weekday_{d}" for d in range(7)) + """,
 count(*) filter (hour(ts) between 6 and 11) as morning, count(*) filter (hour(ts) between 12 and 17) as afternoon, count(*) filter (hour(ts) between 18 and 21) as evening, count(*) filter (hour(ts) >= 22 or hour(ts) < 6) as night,
 (select app from (select app, count(*) as n from e group by 1 order by n desc, app desc limit 1)) as favourite from e""")
def usage_summary(spark, sf_dir):
    """AGG16."""
    return stats.summary(roles.usage(spark, sf_dir))


@register(f"""with {_E}, c as (select app, count(*) as n, count(*) filter (hour(ts) = 9) as h from e group by 1), f as (select app, 0 as source, row_number() over (order by h desc, app) as nth from c where h > 0 qualify nth <= 3),
 s as (select app, 1 as source, row_number() over (order by n desc, app) as nth from c where app not in (select app from f) qualify nth <= 2) select app, source, row_number() over (order by source, nth) as rank from (from f union all from s)""")
def predicted_slots(spark, sf_dir):
    """AGG17, SET4: with five kinds of events the first two sources fill all slots."""
    return stats.predict_slots(roles.usage(spark, sf_dir), 9)


_USES = "uses as (select event_type || '-' || (user_id % 40) as pkg, ts, cast(floor(value * 1000) as bigint) as duration_ms from events)"


def _uses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("pkg"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"))


@register(f"""with {_USES}, h as (select pkg, hour(ts) as h, count(*) as c from uses group by all), t as (select pkg, h as typical_hour, c from h qualify row_number() over (partition by pkg order by c desc, h) = 1),
 a as (select pkg, count(*) as n, max(ts) as last_seen, list_sort(list(duration_ms)) as d from uses group by 1), m as (select pkg, list_sort(list(minute(ts))) as m from uses join t using (pkg) where hour(ts) = typical_hour group by 1),
 r as (select *, least(1.0, n / 10.0) * (c / n) as raw from a join t using (pkg) join m using (pkg) where n >= 3)
 select pkg, n as samples, cast(typical_hour as int) as typical_hour, cast(case when len(m) % 2 = 1 then m[len(m) // 2 + 1] else floor((m[len(m) // 2] + m[len(m) // 2 + 1]) / 2 + 0.5) end as int) as typical_minute, d[cast(least(n, floor(0.9 * n) + 1) as int)] as p90_duration_ms,
  floor(greatest(0.05, raw * pow(0.5, greatest(0, (epoch_us({AS_OF}) - epoch_us(last_seen)) / 86400e6) / 30)) * 10000 + 0.5) / 10000 as confidence from r where raw >= 0.08""")
def timing_pattern(spark, sf_dir):
    """AGG18, AGG20: with a confidence that synthetic events, spread over the day, reach."""
    p = patterns.timing_patterns(_uses(spark, sf_dir), as_of(spark, sf_dir), confidence=0.08)
    return p.select("pkg", "samples", "typical_hour", "typical_minute", "p90_duration_ms", "confidence")


@register(f"""with {_MOVES}, g as (select from_app, to_app, count(*) as n, list_sort(list(delay_ms)) as d, max(ts) as last_seen, sum(greatest(0.05, pow(0.5, greatest(0, (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6) / 30))) as w from m where from_app is not null group by all)
 select from_app, to_app, n, floor(w * 100 + 0.5) / 100 as weighted, cast(case when n % 2 = 1 then d[n // 2 + 1] else floor((d[n // 2] + d[n // 2 + 1]) / 2 + 0.5) end as bigint) as median_delay_ms, d[cast(least(n, floor(0.9 * n) + 1) as int)] as p90_delay_ms,
  floor(greatest(0.05, least(1.0, n / 10.0) * pow(0.5, greatest(0, (epoch_us({AS_OF}) - epoch_us(last_seen)) / 86400e6) / 30)) * 10000 + 0.5) / 10000 as confidence from g where n >= 3""")
def transition_pattern(spark, sf_dir):
    """AGG19, the percentile rule."""
    p = patterns.transition_patterns(stats.transitions(roles.usage(spark, sf_dir)), as_of(spark, sf_dir))
    return p.select("from_app", "to_app", "n", (F.floor(F.col("weighted") * 100 + 0.5) / 100).alias("weighted"), "median_delay_ms", "p90_delay_ms", "confidence")


@register(f"""with {_E}, g as (select *, case when ts - lag(ts) over w > interval 30 minute then 1 else 0 end as new from e window w as (partition by usr order by ts, event_id)),
 s as (select *, sum(new) over (partition by usr order by ts, event_id rows unbounded preceding) as session from g) select usr as user, cast(session as bigint) as session, min(ts) as started_at, max(ts) as ended_at, count(*) as n from s group by all""")
def gap_sessions(spark, sf_dir):
    """STM4's analogue: sessions by a gap."""
    return patterns.gap_sessions(roles.usage(spark, sf_dir))


@register("""with s as (select cast(user_id as varchar) as pkg, (epoch_us(ts) // 1000) as ts_ms, case when event_type in ('view', 'signup') then 'foreground' else 'background' end as event_type from events),
 n as (select *, lead(ts_ms) over w as next, lead(event_type) over w as next_type from s window w as (partition by pkg order by ts_ms, event_type)) select pkg, ts_ms as started_ms, coalesce(next, ts_ms) - ts_ms as duration_ms, coalesce(next_type = 'background', false) as closed from n where event_type = 'foreground'""")
def signal_sessions(spark, sf_dir):
    """STM4, SRC8: foreground and background signals to sessions."""
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").cast("string").alias("pkg"), M.millis(F.col("ts")).alias("ts_ms"), F.when(F.col("event_type").isin("view", "signup"), "foreground").otherwise("background").alias("event_type"))
    return patterns.sessions(s).select("pkg", M.millis(F.col("started_at")).alias("started_ms"), "duration_ms", "closed")


@register("""with c as (select cast(user_id as varchar) as from_key, event_type as to_key, cast(count(*) as double) as weight from events group by all), p as (select *, row_number() over (partition by from_key order by weight desc, to_key) as n from c where weight >= 1)
 select from_key, to_key, weight from p where n <= 3 order by weight desc, from_key, to_key limit 200""")
def chain_prune(spark, sf_dir):
    """MNT2, WIN2, WIN3: the feature is the cap."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("from_key"), F.col("event_type").alias("to_key")).agg(F.count("*").cast("double").alias("weight"))
    return maintain.prune_chain(e, per_node=3, total=200)


@register(f"""select event_id, ts from events where ts > {AS_OF} - interval 5 day order by ts desc, event_id desc limit 220""")
def memory_prune(spark, sf_dir):
    """MNT3: the feature is the cap."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return maintain.prune_memory(e, as_of(spark, sf_dir), 5)


@register(f"""with w as (select event_id, value / 100 as weight, (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6 as age from events), d as (select *, greatest(0.35, 0.5 + (weight - 0.5) * pow(0.5, age / 30)) as new from w)
 select event_id, round(case when age < 1 or abs(new - weight) <= 0.001 then weight else least(1, new) end, 6) as weight from d""")
def decayed_weights(spark, sf_dir):
    """MNT1, MTH3."""
    w = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("weight"), F.col("ts").alias("last_ts"))
    return maintain.decay_weights(w, as_of(spark, sf_dir)).select("event_id", r6("weight").alias("weight"))


@register(f"""with {_E}, f as (select distinct cast(usr as varchar) as query, app from e where app = 'error' and ts > {AS_OF} - interval 3 day) select cast(usr as varchar) as query, app, count(*) as n from e where not exists (select 1 from f where f.query = cast(usr as varchar) and f.app = e.app) group by all""")
def unblocked(spark, sf_dir):
    """FLT3, JN6, LRN12: hits without a live block flag."""
    e, now = roles.usage(spark, sf_dir), as_of(spark, sf_dir)
    hits = e.select(F.col("user").cast("string").alias("query"), "app")
    flags = e.where("app = 'error'").select(F.col("user").cast("string").alias("query"), "app", (F.col("ts") + F.expr("interval 3 days")).alias("expire_ts"))
    return retrieve.without_blocked(hits, flags, now).groupBy("query", "app").agg(F.count("*").alias("n"))


# --- ranking ---------------------------------------------------------------------------------------------------------

_SIGNALS = """c as (select cast(c_custkey as varchar) as pkg, c_name as name, c_acctbal as score, c_custkey as ordinal from customer),
 cells as (select cast(o_custkey as varchar) as pkg, count(*) as n from orders where isodow(o_orderdate) = 3 group by 1), launches as (select sum(n) as l from cells),
 hourly as (select cast(o_custkey as varchar) as pkg, count(*) as n, least(1, max(o_totalprice) / 600000) as recency from orders where o_orderpriority = '1-URGENT' group by 1),
 smart as (select cast(c_custkey as varchar) as pkg, row_number() over (order by c_acctbal desc, c_custkey) - 1 as pos, c_acctbal / 1000 as s from customer where c_mktsegment = 'BUILDING'),
 moves as (select cast(o_custkey as varchar) as pkg, count(*) / 100.0 as p, max(o_orderdate) as t from orders where o_orderstatus = 'F' group by 1), now as (select max(o_orderdate) as now from orders)"""


def _signals(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string").alias("pkg")
    cells = o.where(F.weekday("o_orderdate") == 2).groupBy(key).agg(F.count("*").alias("count"))
    total = cells.agg(F.sum("count").alias("launch_count"))
    cells = cells.crossJoin(F.broadcast(total)).withColumn("hour", F.lit(9)).withColumn("weekday", F.lit(2))
    hourly = o.where("o_orderpriority = '1-URGENT'").groupBy(key).agg(F.count("*").alias("count"), F.least(F.lit(1.0), F.max("o_totalprice") / 600000).alias("recency_score")).withColumn("hour", F.lit(9))
    from pyspark.sql import Window

    smart = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("pkg"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_acctbal"), "c_custkey")) - 1).alias("pos"), (F.col("c_acctbal") / 1000).alias("score"))
    moves = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("to_pkg")).agg((F.count("*") / 100).alias("probability"), F.max("o_orderdate").alias("last_occurred")).withColumn("from_pkg", F.lit("home"))
    now = roles.moment(o.agg(F.max("o_orderdate")).head()[0])
    candidates = c.select(F.col("c_custkey").cast("string").alias("pkg"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("ordinal"))
    return candidates, cells, hourly, smart, moves, now


@register(f"""with {_SIGNALS}, b as (select c.*, 0.15 * least(1, coalesce(cells.n / greatest(5, l), 0)) as heat, 0.2 * greatest(0, least(1, coalesce(0.5 * least(1, hourly.n / 10) + 0.5 * recency, 0.6 * (1 - pos / (select count(*) from smart)) + 0.4 * least(1, s), 0))) as hour,
  0.15 * coalesce(case when p >= 0.05 then least(1, p * pow(0.5, greatest(0, (epoch_us(now) - epoch_us(t)) / 86400e6) / 30)) end, 0) as move
  from c left join cells using (pkg) left join hourly using (pkg) left join smart using (pkg) left join moves using (pkg), launches, now), f as (select *, least(0.5, heat + hour + move) as boost, name = 'Customer#000000007' as exact from b)
 select pkg, round(heat, 6) as b_heatmap, round(hour, 6) as b_hourly, round(move, 6) as b_transition, round(boost, 6) as boost, round(score + boost, 5) as final, case when exact then 'exact-match' when boost > 0 then 'personal' else 'engine-only' end as mode,
  row_number() over (order by exact desc, score + boost desc, ordinal) as rank from f""".replace("least(1, s)", "least(1, s / 10)"))
def rerank_boosts(spark, sf_dir):
    """RNK1 to RNK3, RNK6, JN3, JN4, FLT6: customers ranked by their orders' signals."""
    c, cells, hourly, smart, moves, now = _signals(spark, sf_dir)
    b = rank.heatmap_boost(c, cells, 9, 2)
    b = rank.hourly_boost(b, hourly, smart, 9)
    b = rank.transition_boost(b, moves, "home", now)
    out = rank.rerank(b, "Customer#000000007")
    return out.select("pkg", r6("b_heatmap").alias("b_heatmap"), r6("b_hourly").alias("b_hourly"), r6("b_transition").alias("b_transition"), r6("boost").alias("boost"), F.round("final", 5).alias("final"), "mode", "rank")


@register("""with e as (select event_id, cast(user_id % 7 as varchar) as query, cast(user_id as varchar) as pkg, event_id % 4 - 1 as r, row_number() over (order by event_id desc) - 1 as step from events),
 f as (select pkg, sum(pow(0.5, step / 20) * case when r > 0 then 1.2 when r = 0 then 1.0 else 0.7 end / 3) as x from e where query = '3' group by 1),
 g as (select pkg, least(1, max(v)) as w from (select cast(user_id as varchar) as pkg, value / 100 as v from events) group by 1)
 select cast(c_custkey as varchar) as pkg, round(0.2 * least(1, coalesce(x, 0)), 6) as b_feedback, round(0.15 * coalesce(w, 0), 6) as b_geofence from customer left join f on f.pkg = cast(c_custkey as varchar) left join g on g.pkg = cast(c_custkey as varchar)""")
def feedback_boosts(spark, sf_dir):
    """RNK4, RNK5, WIN8."""
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pkg"))
    events = e.select(F.col("event_id").alias("event_idx"), (F.col("user_id") % 7).cast("string").alias("query"), F.col("user_id").cast("string").alias("clicked_pkg"), (F.col("event_id") % 4 - 1).alias("clicked_rank"))
    preferred = e.groupBy(F.col("user_id").cast("string").alias("pkg")).agg(F.least(F.lit(1.0), F.max(F.col("value") / 100)).alias("weight")).withColumn("geofence_id", F.lit("g"))
    out = rank.geofence_boost(rank.feedback_boost(c, events, "3"), preferred, "g")
    return out.select("pkg", r6("b_feedback").alias("b_feedback"), r6("b_geofence").alias("b_geofence"))


@register("""with a as (select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as pkg, c_acctbal / 1000 as score from customer where c_mktsegment <> 'BUILDING'), b as (select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as pkg, c_acctbal / 2000 as score from customer where c_mktsegment <> 'MACHINERY'),
 w as (select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as pkg, (c_custkey % 20 - 8) / 10 as w, c_custkey % 10 / 10 as c from customer where c_acctbal > 0),
 j as (select coalesce(a.query, b.query) as query, coalesce(a.pkg, b.pkg) as pkg, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) as base from a full join b on a.query = b.query and a.pkg = b.pkg),
 f as (select j.*, w, case when w > 0 then greatest(0, least(0.5, w * c)) else 0 end as personal from j left join w using (query, pkg)), k as (select *, base + personal as final, case when w <= -0.3 then 'suppressed' when personal > 0 then 'personal' else 'engine' end as kind from f)
 select query, pkg, round(personal, 6) as personal, round(final, 6) as final, kind, row_number() over (partition by query order by case when kind = 'suppressed' then 2 else 1 end, final desc, pkg) as rank from k""")
def ranked_candidates(spark, sf_dir):
    """RNK9, JN2, LRN6, LRN20: two lists merged and ranked with affinities."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").cast("string").alias("pkg"), "c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    engine = c.where("c_mktsegment <> 'BUILDING'").select("query", "pkg", (F.col("c_acctbal") / 1000).alias("score"))
    base = c.where("c_mktsegment <> 'MACHINERY'").select("query", "pkg", (F.col("c_acctbal") / 2000).alias("score"))
    aff = c.where("c_acctbal > 0").select("query", "pkg", ((k % 20 - 8) / 10).alias("current_weight"), (k % 10 / 10).alias("confidence"))
    out = rank.rank_candidates(rank.merge_candidates(engine, base), aff)
    return out.select("query", "pkg", r6("personal").alias("personal"), r6("final").alias("final"), "kind", "rank")


# --- learning --------------------------------------------------------------------------------------------------------


def selections(spark, sf_dir):
    """(query, app, rank, ts, part, kind) from clicks, purchases and errors."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    return e.select((F.col("user_id") % 50).cast("string").alias("query"), (F.col("user_id") % 3).cast("string").alias("app"), (F.col("event_id") % 5).cast("int").alias("rank"), "ts", M.day_part(F.col("ts")).alias("part"), F.when(F.col("event_type") == "error", "negative").otherwise("select").alias("kind"))


@register()
def affinity_fold(spark, sf_dir):
    """LRN1 to LRN4, LRN24: an ordered fold per query; tested against plain Python."""
    return L.affinities(selections(spark, sf_dir))


@register()
def alias_states(spark, sf_dir):
    """LRN5, LRN24."""
    return L.aliases(L.affinities(selections(spark, sf_dir)))


@register()
def feedback_fold(spark, sf_dir):
    """LRN7: weights after each query's impressions, apps in order of a hash."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    apps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((i + F.col("user_id")) % 5).cast("string"))
    return L.feedback_weights(e.select((F.col("user_id") % 50).cast("string").alias("query"), "ts", apps.alias("shown"), (F.col("event_id") % 5).cast("string").alias("clicked")))


@register()
def similar_transfer(spark, sf_dir):
    """LRN8: weights of similar names; tested against plain Python."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query"), F.col("p_type").alias("app")).agg((F.avg("p_size") / 50).alias("weight"))
    return L.transfer(p)


@register("select event_type as app, least(1.0, 0.5 + 0.05 * count(*)) as preference from events group by 1")
def global_preference(spark, sf_dir):
    """LRN9."""
    return L.global_preference(roles.usage(spark, sf_dir))


@register("""with e as (select user_id, event_id, ts, value * 20 as d from events where event_type = 'click'), o as (select user_id, count(*) as n, list(d order by ts, event_id) as l from e group by 1),
 a as (select user_id as user, n, list_reduce(list_prepend(cast(600 as double), l), lambda v, x: v * 0.85 + x * 0.15) as v from o) select user, n, round(v, 4) as average, case when n < 3 then 1.0 when v < 400 then 1.5 when v < 800 then 1.25 when v > 3000 then 0.4 when v > 1500 then 0.6 else 1.0 end as multiplier from a""")
def click_delays(spark, sf_dir):
    """LRN10, LRN18, WIN9."""
    c = roles.usage(spark, sf_dir).where("app = 'click'").select("user", "ts", (F.col("value") * 20).alias("delay_ms"))
    return L.click_delay(c).withColumn("average", F.round("average", 4))


@register("""with e as (select event_id, user_id, ts, event_type from events where event_type in ('view', 'click')), s as (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over w as search_id, last_value(case when event_type = 'view' then ts end ignore nulls) over w as search_ts
  from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)) select user_id as user, event_id as click_id, search_id, search_ts, ts, (epoch_us(ts) // 1000) - (epoch_us(search_ts) // 1000) < 120 as misfire from s where event_type = 'click' and search_id is not null""")
def matched_selections(spark, sf_dir):
    """JN11, JN12, FLT7: each click with the last search before it."""
    return L.matched_selections(roles.usage(spark, sf_dir))


@register("""with b as (select cast(user_id as varchar) as query, event_type as app, case when hour(ts) < 12 then 'am' else 'pm' end as bucket, count(*) as n, max(ts) as last_ts from events group by all), k as (select query from (select query, max(last_ts) as t, max(n) as m from b group by 1) order by t desc, m desc, query limit 40)
 select * from b where query in (from k)""")
def bayes_table(spark, sf_dir):
    """LRN13: the cap is the feature."""
    o = roles.usage(spark, sf_dir).select(F.col("user").cast("string").alias("query"), "app", F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("bucket"), "ts")
    return L.bayes_table(o, 40)


def _reminders_sql(chain: str) -> str:
    return f"""with {_MOVES}, g as (select from_app, to_app, count(*) as n from m where from_app is not null group by all), ch as ({chain}),
 h as (select app, count(*) as n from e where hour(ts) = 9 group by 1), w as (select app, count(*) as n from e where hour(ts) = 9 and isodow(ts) = 2 group by 1), o as (select app, count(*) as n from e group by 1),
 p as (select app, s from ch union all select app, 0.25 * n / sum(n) over () from h union all select app, 0.15 * n / sum(n) over () from w union all select app, 0.1 * n / sum(n) over () from o),
 t as (select app, sum(cast(s as double)) / ((exists (from ch))::int * 0.5 + (exists (from h))::int * 0.25 + (exists (from w))::int * 0.15 + 0.1) as score from p where app <> 'error' group by 1)
 select app, round(score, 6) as score, row_number() over (order by round(score, 9) desc, app) as rank from t"""


def _reminders(spark, sf_dir, from_app):
    e = roles.usage(spark, sf_dir)
    edges = stats.transitions(e).groupBy("from_app", "to_app").agg(F.count("*").alias("weight"))
    blocked = spark.createDataFrame([("error",)], "app string")
    return L.remind(edges, e, blocked, from_app, 9, 1, 5).withColumn("score", r6("score"))


@register(_reminders_sql("select to_app as app, 0.5 * n / sum(n) over () as s from g where from_app = 'view'"))
def reminders(spark, sf_dir):
    """LRN14: after an app."""
    return _reminders(spark, sf_dir, "view")


@register(_reminders_sql("select to_app as app, sum(0.5 * 0.4 * share) as s from (select to_app, n / sum(n) over (partition by from_app) as share from g) group by 1"))
def reminders_anywhere(spark, sf_dir):
    """LRN14: without an app before, each app's own shares of its transitions count."""
    return _reminders(spark, sf_dir, None)


@register(f"""with {_E}, f as (select app, case when event_id % 7 = 0 then 'rejected' when event_id % 7 = 1 then 'ignored' else 'accepted' end as action, ts from e), u as (select app, max(ts + case when action = 'rejected' then interval 3 day else interval 1 day end) as until
 from f where action <> 'accepted' group by 1) select app, until from u where until > (select max(ts) from e)""")
def reminder_blocks(spark, sf_dir):
    """LRN15: rejected apps rest three days, ignored ones one."""
    e = roles.usage(spark, sf_dir)
    n = F.col("event_id") % 7
    action = F.when(n == 0, "rejected").when(n == 1, "ignored").otherwise("accepted")
    return L.reminder_blocks(e.select("app", action.alias("action"), "ts"), as_of(spark, sf_dir))


@register("""with t as (select event_type as app, list_sort(list(ts)) as l from events group by 1)
 select app, len(list_reduce(list_prepend([l[1]], list_transform(l, lambda x: [x])), lambda s, x: case when epoch_us(x[1]) - epoch_us(s[len(s)]) >= 3600000000 then list_concat(s, x) else s end)) as n from t""")
def throttled_reminders(spark, sf_dir):
    """LRN15: at most one an hour."""
    e = roles.usage(spark, sf_dir).select("app", "ts")
    return L.throttled(e, 60).groupBy("app").agg(F.count("*").alias("n"))


# --- sources ---------------------------------------------------------------------------------------------------------


@register("""with d as (select p_partkey, p_name, p_size from part where p_type <> 'PROMO' and p_size > 5), a as (select p_partkey, upper(p_name) as p_name, p_size + 100 as p_size from part where p_size <= 5) select * from d union all select * from a""")
def catalogue_delta(spark, sf_dir):
    """SRC3, SRC7: removed and replaced rows."""
    part = table(spark, sf_dir, "part")
    p = part.select("p_partkey", "p_name", "p_size")
    added = p.where("p_size <= 5").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return tables.apply_delta(p, added, part.where("p_type = 'PROMO'"), "p_partkey", "p_name")


@register("""with s as (select user_id as id, ts, event_type as action from events qualify row_number() over (partition by user_id order by ts desc) = 1) select cast(id as varchar) as pkg, case when action = 'error' then 'REMOVED' else 'ADDED' end as action, ts from s where action <> 'error'""")
def package_changes(spark, sf_dir):
    """SRC4: the last change of every package."""
    e = table(spark, sf_dir, "events")
    return tables.changes(e.select(F.col("user_id").cast("string").alias("pkg"), F.when(F.col("event_type") == "error", "REMOVED").otherwise("ADDED").alias("action"), "ts"))


@register("""with g as (select p_brand as code, list_distinct(list(p_name)) as w from part group by 1), e as (select code, unnest(w) as term, w from g), p as (select distinct term, unnest(w) as synonym from e) select upper(term[1]) as initial, count(*) as n, count(distinct term) as terms from p where term <> synonym group by 1""")
def synonym_shards(spark, sf_dir):
    """SRC10, SRC15, SEM2: brands as synonym groups, counted by shard."""
    p = table(spark, sf_dir, "part")
    lines = p.groupBy("p_brand").agg(F.collect_set(F.regexp_replace("p_name", " ", "_")).alias("w")).select(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("= "), F.array_join("w", " ")).alias("value"))
    return corpus.synonym_pairs(corpus.parse_synonyms(lines)).groupBy("initial").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@register("""with s as (select distinct split_part(p_name, ' ', 2) as term, split_part(p_name, ' ', 1) as synonym from part union select distinct p_name, p_type from part), t as (select distinct split_part(p_name, ' ', 2) as term from part union select distinct split_part(p_name, ' ', 1) from part),
 x as (select t.term, synonym, 0.9 as score, 0 as source from t join s using (term) union all select t.term, s.term, 0.85, 1 from t join s on lower(synonym) = t.term where s.term <> t.term
  union all select distinct t.term, s.term, 0.6, 2 from t join s on s.term <> t.term and (contains(s.term, t.term) or contains(t.term, s.term))),
 y as (select * from (select *, row_number() over (partition by term, synonym order by source) as n from x) where n = 1)
 select term, synonym, cast(score as double) as score, source, rank from (select *, row_number() over (partition by term order by source, score desc, synonym) as rank from y) where rank <= 10""")
def synonym_expansion(spark, sf_dir):
    """SEM1: the words of the names, by synonyms of words and of whole names: direct, reverse and contained."""
    p = table(spark, sf_dir, "part")
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    pairs = p.select(second.alias("term"), first.alias("synonym")).unionByName(p.select(F.col("p_name").alias("term"), F.col("p_type").alias("synonym"))).distinct()
    return semantic.expand(p.select(second.alias("term")).unionByName(p.select(first.alias("term"))), pairs)


@register("""with t as (select distinct p_name as term from part), g as (select term, list_concat(['^' || term[1]], list_transform(range(1, length(term)), lambda i: substr(term, i, 2)), [term[length(term)] || '$']) as g from t), f as (select term, len(g) as len, unnest(g) as gram from g), c as (select term, len, gram, count(*) as tf from f group by all),
 d as (select gram, count(*) as df from c group by 1), w as (select term, gram, tf / len * (ln(((select count(*) from t) + 1) / (df + 1)) + 1) as w from c join d using (gram)), u as (select term, gram, w / sqrt(sum(w * w) over (partition by term)) as w from w),
 s as (select a.term, b.term as other, sum(a.w * b.w) as score from u a join u b using (gram) where a.term <> b.term group by all) select term, other, round(score, 5) as score, rank from (select *, row_number() over (partition by term order by round(score, 9) desc, other) as rank from s where score >= 0.2) where rank <= 5""")
def similar_terms(spark, sf_dir):
    """IDX16, SEM3, STR23."""
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    return semantic.similar(semantic.gram_vectors(t), t, k=5).withColumn("score", F.round("score", 5))


@register("""select substr(sha256(lower(p_name)), 1, 16) as id, p_name as name, any_value(p_name) || ' ' || string_agg(distinct p_type, ' ' order by p_type) as document from part where p_name not like 'blue%' group by p_name""")
def expanded_seeds(spark, sf_dir):
    """SRC11, SRC13, SRC14: new seeds only."""
    p = table(spark, sf_dir, "part")
    seeds = p.groupBy(F.col("p_name").alias("name")).agg(F.sort_array(F.collect_set("p_type")).alias("cats")).withColumn("words", F.array().cast("array<string>"))
    return corpus.expand_seeds(seeds, p.where("p_name like 'blue%'").select(F.col("p_name").alias("name"))).select("id", "name", "document")


@register("""with l as (select vec_id % 100 as id, list_transform(embedding, lambda x: cast(x as double)) as v, vec_id from embeddings qualify row_number() over (partition by vec_id % 100 order by vec_id desc) = 1) select cast(id as varchar) as id, round(list_sum(list_transform(v, lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x)), 6) as norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first from l""")
def loaded_vectors(spark, sf_dir):
    """SRC12: the last of equal ids, unit length."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).cast("string").alias("id"), F.col("embedding").alias("v"), F.col("vec_id").alias("seq"))
    return vector.load(e).select("id", F.round(M.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


@register()
def user_vectors(spark, sf_dir):
    """AGG22, D14: hours, intents, categories and top apps of each user in 65 dimensions."""
    e = roles.usage(spark, sf_dir)
    intents = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 11).alias("intent"))
    return stats.user_vectors(e, intents, ["signup", "error", "click", "view", "purchase"])


@register()
def vector_exports(spark, sf_dir):
    """SNK1, SNK2: the vector store as JSON lines."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return corpus.vector_store(v, "1", "hash", 64, "2024-01-01T00:00:00Z")

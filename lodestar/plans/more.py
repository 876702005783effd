"""Registered queries: sources and sinks, small functions, suggestions, upkeep of state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X
from ..operators import index as I
from ..operators import learn as L
from ..operators import maintain, patterns, rank, retrieve, stats, vector
from ..sources import corpus, tables
from ..sources.shared import shared_folder
from ..streaming import jobs
from . import api, engine, roles
from .hints import broadcast_if_small
from .behaviour import _E, _SIGNALS, _signals
from .queries import APPS, AS_OF, RUNGS_SQL, SEARCHES, USAGE, as_of, r6, register, searches
from .roles import table

# --- sources and sinks -----------------------------------------------------------------------------------------------


@register(f"with {APPS} select app_id, name, abbr, cat, uses, installed, cast({USAGE} as bigint) as points from apps")
def catalogue(spark, sf_dir):
    """SRC1, SRC2, MTH9: the catalogue, as SQL sees it once it is injected."""
    tables.inject(roles.catalog(spark, sf_dir), "lodestar_apps")
    return spark.table("lodestar_apps").select("app_id", "name", "abbr", "cat", "uses", "installed", retrieve.usage_score().cast("long").alias("points"))


@register("""select event_id, case when event_type = 'error' then -1 else cast(json_extract(props, '$.k') as bigint) end as k, '["' || event_type || '","' || user_id || '"]' as list, 2 as n,
 to_json({app: event_type, value: user_id}) as object from events""")
def json_values(spark, sf_dir):
    """SRC5, ARR1, JSN1: JSON values with a fallback for broken ones, list and map codecs there and back."""
    e = table(spark, sf_dir, "events")
    kv = e.select(F.col("event_id").alias("key"), F.when(F.col("event_type") == "error", "{broken").otherwise(F.col("props")).alias("value"))
    parsed = tables.json_values(kv, "k bigint", '{"k": -1}')
    coded = corpus.lists_to_json(F.array("event_type", F.col("user_id").cast("string")))
    rest = e.select("event_id", coded.alias("list"), F.size(corpus.json_to_list(coded)).cast("long").alias("n"), F.to_json(F.struct(F.col("event_type").alias("app"), F.col("user_id").alias("value"))).alias("object"))
    return rest.join(parsed.select(F.col("key").alias("event_id"), F.col("value.k").alias("k")), "event_id").select("event_id", "k", "list", "n", "object")


@register("select cast(o_custkey as varchar) as query, o_orderpriority as app, count(*) as n, max(o_orderdate) as last_ts from orders group by 1, 2")
def state_round_trip(spark, sf_dir):
    """SRC6, UDF4, LRN22: a state table written, exported, restored elsewhere and read."""
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("query"), F.col("o_orderpriority").alias("app")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_ts"))
    home = shared_folder(spark, "state")
    first, second = tables.Store(spark, f"{home}/a"), tables.Store(spark, f"{home}/b")
    first.write("bayes", state)
    first.export(f"{home}/export")
    second.restore(f"{home}/export", first.names())
    return second.read("bayes")


@register("""select cast(user_id as varchar) as pkg, count(*) as n, cast(sum(cast(floor(value * 1000) as bigint)) as bigint) as duration_ms, max(ts) as last_used from events
 where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""")
def usage_provider(spark, sf_dir):
    """SRC9: signals of a span of time, totals by package, of the observed packages."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pkg"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"))
    rows = tables.between(e, roles.moment("2024-01-05"), roles.moment("2024-01-20"))
    return tables.usage_totals(rows.join(tables.observed(rows), "pkg", "left_semi"))


@register("""select cast(c_custkey as varchar) as pkg, count(o_orderkey) as seen, min(o_orderdate) as first_seen from customer join orders on o_custkey = c_custkey group by 1""")
def discovered_stubs(spark, sf_dir):
    """LRN23: packages found in use, each recorded once, by an upsert of the second half of the log over the first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("pkg"), "o_orderkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pkg"))
    whole = o.join(c, "pkg", "left_semi").groupBy("pkg").agg(F.count("*").alias("seen"), F.min("o_orderdate").alias("first_seen"))
    early = whole.select("pkg", F.lit(0).cast("long").alias("seen"), "first_seen")
    return tables.upsert(early, whole, ["pkg"])


# --- predicates and small functions ----------------------------------------------------------------------------------


@register("select p_partkey as app_id, p_name as name from part where exists (select 1 from lineitem where l_partkey = p_partkey)")
def installed_apps(spark, sf_dir):
    """FLT4: the catalogue's rows that are in use."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("app_id"))
    return roles.apps(spark, sf_dir).select("app_id", "name").join(used, "app_id", "left_semi")


@register(r"""select conv_id, turn, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) <= 2 as short, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) as latin from conversations""")
def short_and_latin(spark, sf_dir):
    """FLT8, STR28: whether a turn has at most two characters, and its letters and digits."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_short(F.col("text")).alias("short"), X.latin_name(F.col("text")).alias("latin"))


@register("select p_partkey as app_id, p_type || ',' || p_brand as tags, true as any_brand, p_size > 10 as every from part")
def unique_tags(spark, sf_dir):
    """PRJ6, ARR2: tags without repeats whatever their case; some and every."""
    tags = F.array("p_type", F.lower("p_type"), F.concat(F.lit(" "), "p_brand"), F.upper("p_type"), F.lit(" "))
    p = table(spark, sf_dir, "part").withColumn("t", X.unique_strings(tags))
    return p.select(F.col("p_partkey").alias("app_id"), F.array_join("t", ",").alias("tags"), F.exists("t", lambda x: F.lower(x).startswith("brand")).alias("any_brand"), F.forall(F.array("p_size"), lambda x: x > 10).alias("every"))


@register("""select k as key, count(distinct p_partkey) as n from part, unnest(list_transform(range(1, least(6, length(p_name)) + 1), lambda i: substr(p_name, 1, i))) t(k) group by 1""")
def syllable_postings(spark, sf_dir):
    """IDX2: prefixes of full syllables."""
    apps = roles.apps(spark, sf_dir).withColumn("py", F.col("name"))
    return I.syllable_index(apps).groupBy("key").agg(F.count("*").alias("n"))


_GRID = " union all ".join(f"select '{ch}' as k, {r} as r, {c} as c, {c + (0, 0.5, 1.25)[r]} as s" for ch, (r, c) in X.KEYS.items())


@register(f"""with g as ({_GRID}) select a.k as a, b.k as b, case when a.k = b.k then 0 else round(sqrt(1.6 * (a.r - b.r) ** 2 + (a.s - b.s) ** 2) + case when a.r <> b.r and a.s <> b.s then 0.15 else 0 end, 6) end as distance,
 a.k <> b.k and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 as neighbour from g a, g b""")
def key_distances(spark, sf_dir):
    """STR5, STR27: every pair of keys."""
    rows = [(a, b, round(X.key_distance(a, b), 6)) for a in X.KEYS for b in X.KEYS]
    return spark.createDataFrame(rows, "a string, b string, distance double").select("a", "b", "distance", X.is_neighbour(F.col("a"), F.col("b")).alias("neighbour"))


@register("""with s as (select doc_id, greatest(1, n_chars) / 60.0 as minutes, len(regexp_extract_all(text, '[A-Za-z]+')) as words, len(regexp_extract_all(text, '[一-龥]')) as han from documents)
 select doc_id, round(han / minutes, 6) as han_per_minute, round(words / minutes, 6) as words_per_minute from s""")
def display_speeds(spark, sf_dir):
    """STR30: characters and words a minute, at one character a second."""
    t, minutes = X.text(F.col("text")), F.greatest(F.lit(1), F.col("n_chars")) / 60.0
    return table(spark, sf_dir, "documents").select("doc_id", r6(F.regexp_count(t, F.lit(f"[{X.CJK}]")) / minutes).alias("han_per_minute"), r6(F.regexp_count(t, F.lit("[A-Za-z]+")) / minutes).alias("words_per_minute"))


#: Syllables of the letters' names, in the role of a dictionary of characters.
SYLLABLES = {ch: s for ch, s in zip("abcdefghijklmnopqrstuvwxyz", "ei bi si di i ef dji eich ai djei kei el em en ou pi kiu ar es ti iu vi dabl eks uai zed".split())}


@register(f"""with d as (select unnest([{", ".join(f"'{k}'" for k in SYLLABLES)}]) as ch, unnest([{", ".join(f"'{v}'" for v in SYLLABLES.values())}]) as s), n as (select distinct p_name from part), c as (select p_name, unnest(string_split(p_name, '')) as ch, unnest(range(1, length(p_name) + 1)) as i from n)
 select p_name as name, string_agg(coalesce(s, c.ch), ' ' order by i) as full, string_agg(coalesce(s, c.ch)[1], '' order by i) as initials from c left join d using (ch) where trim(c.ch) <> '' group by 1""")
def syllables(spark, sf_dir):
    """STR19: a dictionary's syllables of every character, whole and initials; characters without any stand for themselves."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    known = F.create_map(*[F.lit(x) for kv in SYLLABLES.items() for x in kv])
    parts = F.transform(F.filter(X.chars(F.col("name")), lambda c: F.trim(c) != ""), lambda c: F.coalesce(F.element_at(known, c), c))
    return names.select("name", F.array_join(parts, " ").alias("full"), F.array_join(F.transform(parts, lambda s: F.substring(s, 1, 1)), "").alias("initials"))


@register("""with s as (select p_partkey, string_split(p_name, '') as a, string_split(lower(p_type), '') as b from part) select p_partkey as app_id, len(list_intersect(a, b)) as shared, len(list_intersect(list_distinct(b), list_distinct(a))) = len(list_distinct(b)) as subset from s""")
def shared_characters(spark, sf_dir):
    """SET3: intersection and subset test of character sets."""
    a, b = F.array_distinct(X.chars(F.col("p_name"))), F.array_distinct(X.chars(F.lower("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"), (F.size(F.array_except(b, a)) == 0).alias("subset"))


@register("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, strftime(o_orderdate, '%Y-%m-%d-%H') as hour_key, isodow(o_orderdate) - 1 as weekday, epoch_us(o_orderdate) // 1000 as ms from orders""")
def parsed_times(spark, sf_dir):
    """DAT2: ISO and hour keys parsed and written again."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    t = F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(F.to_timestamp(F.date_format(t, "yyyy-MM-dd-HH"), "yyyy-MM-dd-HH"), "yyyy-MM-dd-HH").alias("hour_key"), F.weekday(t).cast("long").alias("weekday"), M.millis(F.col("o_orderdate")).alias("ms")
    )


@register("""select event_id, cast(case when event_type = 'click' then 30 else 0 end + case when value > 50 then 12 else 0 end + case when hour(ts) >= 22 or hour(ts) < 6 then 8 else 0 end + case when regexp_matches(event_type, 'sign|purch') then 5 else 0 end as double) as points from events""")
def context_boosts(spark, sf_dir):
    """MTH10: points of the context rules that hold."""
    h = F.hour("ts")
    rules = [(F.col("event_type") == "click", 30), (F.col("value") > 50, 12), ((h >= 22) | (h < 6), 8), (F.col("event_type").rlike("sign|purch"), 5)]
    return table(spark, sf_dir, "events").select("event_id", M.rule_boost(rules).alias("points"))


@register("""with v as (select vec_id, list_transform(embedding, lambda x, i: case when i - 1 in (0, 7, label) then least(1.0, cast(x as double) + 0.05) else cast(x as double) end) as n, list_transform(embedding, lambda x: cast(x as double)) as o from embeddings)
 select vec_id, round(list_sum(n), 5) as total, round(list_dot_product(n, o) / sqrt(list_dot_product(n, n) * list_dot_product(o, o)), 6) as cosine from v""")
def preference_vectors(spark, sf_dir):
    """MTH11: entries raised and capped, and how near the vector stays to what it was."""
    e = table(spark, sf_dir, "embeddings").withColumn("o", F.transform("embedding", lambda x: x.cast("double")))
    e = e.withColumn("n", M.preference_update(F.col("o"), F.array(F.lit(0), F.lit(7), F.col("label"))))
    return e.select("vec_id", F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), r6(M.cosine(F.col("n"), F.col("o"))).alias("cosine"))


@register("select event_id, case when value < 80 or user_id % 2 = 0 then 80 else 0 end as ms from events")
def hesitation_delays(spark, sf_dir):
    """STM5: more wait for far keys or swapped letters."""
    factors = F.array(F.lit(1.0), F.col("value") / 100, F.lit(1.0), F.lit(0.1))
    return table(spark, sf_dir, "events").select("event_id", L.hesitation(factors, F.col("user_id") % 2 == 0).alias("ms"))


# --- retrieval and suggestions ---------------------------------------------------------------------------------------


@register(f"""with {APPS}, {SEARCHES}, x as (select query_id, app_id from searches, apps where name = q or abbr = q), p as (select query_id, app_id from searches, apps where starts_with(name, q) or starts_with(abbr, q)), n as (select query_id, count(*) as n from x group by 1)
 select query_id, app_id from x union select query_id, app_id from p where coalesce((select n from n where n.query_id = p.query_id), 0) < 6""")
def supplemented_search(spark, sf_dir):
    """RET24, RET25: exact hits, and prefix hits too for queries with under six."""
    a = roles.apps(spark, sf_dir)
    q = searches(spark).select("query_id", X.lowered(F.col("q")).alias("q"))
    return retrieve.supplemented(retrieve.exact_search(q, a), retrieve.prefix_search(q, a), 6)


@register(f"""with {APPS}, {SEARCHES}, s as (select query_id, app_id, 900 as score, 0 as source from searches, apps where name = q or abbr = q union all select query_id, app_id, 95, 1 from searches, apps where cat = q
 union all select query_id, app_id, 50, 2 from searches, apps where contains(tag, q)), o as (select * from s qualify row_number() over (partition by query_id, app_id order by source) = 1)
 select query_id, app_id, score, source, rank from (select *, row_number() over (partition by query_id order by source, score desc, app_id) as rank from o) where rank <= 30""")
def facade_search(spark, sf_dir):
    """RET41: names, then categories, then tags; each app once."""
    a = roles.apps(spark, sf_dir)
    q = searches(spark).select("query_id", X.lowered(F.col("q")).alias("q"))
    main = retrieve.exact_search(q, a).withColumn("score", F.lit(900))
    cats = retrieve.apps_by_category(a, q.select(F.col("q").alias("category"))).join(broadcast_if_small(q), F.col("category") == F.col("q")).select("query_id", "app_id", F.lit(95).alias("score"))
    tags = a.select("app_id", F.explode("tags").alias("tag")).join(broadcast_if_small(q), F.col("tag").contains(F.col("q"))).select("query_id", "app_id", F.lit(50).alias("score")).distinct()
    return retrieve.merged(main, cats, tags)


@register(f"""with {APPS}, {SEARCHES}, h as (select query_id, app_id, min(case when name = q or abbr = q then 0 when starts_with(name, q) or starts_with(abbr, q) then 1 end) as t from searches, apps group by all having t is not null),
 s as (select h.query_id, app_id, name, cast((case t when 0 then 1000 else 800 end) + {USAGE} as bigint) as score from (select *, min(t) over (partition by query_id) as first from h) h join apps using (app_id) where t = first)
 select query_id, app_id, score, rank, name || '!' as name from (select *, row_number() over (partition by query_id order by score desc, app_id) as rank from s) where rank <= 30""")
def component_search(spark, sf_dir):
    """RET32, FLT9, UDF1: the component's batch of searches without the fuzzy tier, a plugin after it."""
    plugins = api.Plugins()
    plugins.register({"name": "mark", "version": "1"}, {"after_search": lambda df: df.withColumn("name", F.concat("name", F.lit("!")))})
    s = api.Search(spark, roles.catalog(spark, sf_dir), api.Flags(fuzzy=False), plugins)
    return s.batch(searches(spark)).select("query_id", "app_id", "score", "rank", "name")


def _engine_sql(meta: bool, sim_int: bool, rag: bool, rerank: bool) -> str:
    """The whole search without the fuzzy tier, over the rungs' searches."""
    more = ""
    if meta:
        more += " union all select query_id, app_id, null, 1, score from m where (query_id, app_id) not in (select (query_id, app_id) from t)"
    steps = [f"f0 as (select query_id, app_id, tier, 0 as source, score from t{more})"]
    last = "f0"
    for on, source, name, first, step, least in ((sim_int, 2, "sg", 60, 6, 24), (rag, 3, "rc", 50, 5, 20)):
        if on:
            steps.append(f"f{source} as (select * from {last} union all select query_id, app_id, null, {source}, greatest({least}, {first} - {step} * place) from {name} where query_id not in (select query_id from {last}) and query_id in (select query_id from rungs where length(q) >= 2))")
            last = f"f{source}"
    order = f"o as (select *, row_number() over (partition by query_id order by source, score desc, app_id) as ordinal from {last})"
    if rerank:
        order += """, z as (select o.query_id, o.app_id, tier, source, cast(score + floor(round(coalesce(boost, 0) / 0.5 * score * 0.3, 6)) as bigint) as score, name = q as exact, ordinal from o join apps using (app_id) join rungs using (query_id) left join bo using (query_id, app_id)),
 w as (select *, row_number() over (partition by query_id order by exact desc, score desc, ordinal) as rank from z)"""
    else:
        order += ", w as (select *, ordinal as rank from o)"
    return f"""with {APPS}, {RUNGS_SQL}, h as (select query_id, app_id, min(case when name = q or abbr = q then 0 when starts_with(name, q) or starts_with(abbr, q) then 1 end) as tier from rungs, apps group by all having tier is not null),
 t0 as (select h.query_id, h.app_id, tier, cast((case tier when 0 then 1000 else 800 end) + {USAGE} as bigint) as score from (select *, min(tier) over (partition by query_id) as first from h) h join apps using (app_id) where tier = first),
 t as (select query_id, app_id, tier, score from (select *, row_number() over (partition by query_id order by score desc, app_id) as n from t0) where n <= 30),
 m as (select query_id, app_id, n as score from (select query_id, app_id, p_size as n from rungs join part on lower(p_type) = q join apps on app_id = p_partkey)),
 sg as (select query_id, p_partkey as app_id, p_size as place from rungs, part where p_size < 8 and p_partkey % 5 = 0 and p_partkey % 10 <> 0), rc as (select query_id, p_partkey as app_id, p_size as place from rungs, part where p_size < 4 and query_id % 2 = 0),
 bo as (select query_id, app_id, least(0.5, uses / 100.0) as boost from rungs, apps), {", ".join(steps)}, {order} select query_id, app_id, tier, source, score, rank from w where rank <= 30"""


def _engine(spark, sf_dir, **flags):
    a, q = roles.catalog(spark, sf_dir), roles.queries_frame(spark, roles.RUNGS)
    p = table(spark, sf_dir, "part")
    every = p.select(F.col("p_partkey").alias("app_id"), F.col("p_size").alias("place"), F.lower("p_type").alias("kind")).crossJoin(F.broadcast(q))  # the stated searches
    meta = every.where("kind = q").select("query_id", "app_id", F.col("place").alias("score"))
    some = every.where("place < 8 and app_id % 5 = 0").select("query_id", "app_id", "place")
    recall = every.where("place < 4 and query_id % 2 = 0").select("query_id", "app_id", "place")
    boosts = a.select("app_id", (F.col("uses") / 100.0).alias("boost")).crossJoin(F.broadcast(q.select("query_id")))
    return engine.search(q, a, engine.Flags(fuzzy=False).with_(**flags), meta=meta, suggestions=some, blocked=some.where("app_id % 10 = 0"), recall=recall, boosts=boosts)


@register(_engine_sql(True, False, False, True))
def engine_meta(spark, sf_dir):
    """RET14, RET32, FLT9: tiers, then hits by category, in the personal order."""
    return _engine(spark, sf_dir, meta=True, rerank=True)


@register(_engine_sql(False, True, True, False))
def engine_suggestions(spark, sf_dir):
    """RET14, RET30, FLT9: searches without hits get suggestions that aren't blocked, else recalled documents."""
    return _engine(spark, sf_dir, meta=False, sim_int=True, rag=True, rerank=False)


@register(_engine_sql(True, False, True, False))
def engine_recall(spark, sf_dir):
    """RET14, FLT9: searches without hits get recalled documents."""
    return _engine(spark, sf_dir, meta=True, rag=True, rerank=False)


@register("""with e as (select c_mktsegment as from_key, cast(o_orderpriority as varchar) as to_key, sum(o_totalprice) as weight from orders join customer on c_custkey = o_custkey group by all), s as (select *, weight / sum(weight) over (partition by from_key) as share from e),
 r as (select from_key, to_key, 1 as source, share as w from s where share >= 0.15 union all select distinct c_mktsegment, 'home', 0, 1.0 from customer union all select distinct c_mktsegment, 'unknown', 2, 0.0 from customer)
 select from_key, to_key, source, rank from (select *, row_number() over (partition by from_key order by source, w desc, to_key) as rank from r) where rank <= 6""")
def routed_suggestions(spark, sf_dir):
    """RET31: context rules, strong edges, unknown apps."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("from_key"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("to_key"), "o_totalprice")
    edges = o.join(c, "c_custkey").groupBy("from_key", "to_key").agg(F.sum("o_totalprice").alias("weight"))
    keys = c.select("from_key").distinct()
    return retrieve.route(edges, keys.withColumn("to_key", F.lit("home")), keys.withColumn("to_key", F.lit("unknown")), share=0.15)


@register(f"""with {_E}, g as (select cast(usr as varchar) as query, app, cast(count(*) as double) as weight from e group by all), s as (select query, app, weight / sum(weight) over (partition by query) as score, 0 as source from g qualify score >= 0.25),
 m as (select distinct cast(usr as varchar) as query, app, 0.5 as score, 1 as source from e where app = 'purchase'), u as (select * from s union all select * from m), o as (select * from u qualify row_number() over (partition by query, app order by source) = 1)
 select query, app, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by source, score desc, app) as rank from o) where rank <= 3""")
def query_bubbles(spark, sf_dir):
    """AGG8: strong edges, then apps that share an intent."""
    e = roles.usage(spark, sf_dir)
    edges = e.groupBy(F.col("user").cast("string").alias("query"), "app").agg(F.count("*").cast("double").alias("weight"))
    members = e.where("app = 'purchase'").select(F.col("user").cast("string").alias("query"), "app").distinct()
    return stats.query_bubbles(edges, members, 0.25).withColumn("score", r6("score"))


# --- patterns, ranking, upkeep ---------------------------------------------------------------------------------------


def _half(e: DataFrame, late: bool) -> DataFrame:
    rows = e.where((F.col("ts") >= roles.moment("2024-01-16")) == F.lit(late))
    days = F.array(*[F.max(F.weekday("ts") == d) for d in range(7)])
    return rows.groupBy(F.col("user_id").cast("string").alias("pkg")).agg(F.count("*").alias("samples"), F.min(F.hour("ts")).alias("typical_hour"), days.alias("weekdays"), (F.least(F.lit(100), F.count("*")) / 100).alias("confidence"))


@register(f"""with h as (select cast(user_id as varchar) as pkg, ts >= timestamp '2024-01-16' as late, count(*) as n, min(hour(ts)) as hour, [{", ".join(f"bool_or(isodow(ts) = {d + 1})" for d in range(7))}] as w, least(100, count(*)) / 100 as c from events group by all), o as (select * from h where not late), m as (select * from h where late)
 select coalesce(o.pkg, m.pkg) as pkg, coalesce(o.n, 0) + coalesce(m.n, 0) as samples, cast(case when m.pkg is not null and (m.n >= 3 or o.pkg is null) then m.hour else o.hour end as int) as typical_hour,
 array_to_string(list_transform(range(1, 8), lambda i: case when coalesce(o.w[i], false) or coalesce(m.w[i], false) then '1' else '0' end), '') as weekdays,
 floor((case when o.pkg is null then m.c when m.pkg is null then o.c when m.n >= 3 then 0.4 * o.c + 0.6 * m.c else least(1, o.c + 0.1 * m.c) end) * 10000 + 0.5) / 10000 as confidence from o full join m on o.pkg = m.pkg""")
def merged_patterns(spark, sf_dir):
    """AGG21, LRN16: patterns of the first half of a month updated by those of the second; the store keeps the last thousand."""
    e = table(spark, sf_dir, "events")
    out = patterns.merge_patterns(_half(e, False), _half(e, True), ["pkg"])
    return out.withColumn("weekdays", F.array_join(F.transform("weekdays", lambda x: F.when(x, "1").otherwise("0")), ""))


@register("select cast(user_id as varchar) as pkg, count(*) as n, arg_min(event_id, (ts, event_id)) as first, arg_max(event_id, (ts, event_id)) as last from events group by 1")
def grouped_signals(spark, sf_dir):
    """AGG24: each package's signals in order of time."""
    g = stats.grouped(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pkg"), "ts", "event_id"), "pkg")
    return g.select("pkg", "n", F.element_at("items", 1)["event_id"].alias("first"), F.element_at("items", -1)["event_id"].alias("last"))


@register("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def learning_counts(spark, sf_dir):
    """AGG25: rows by status."""
    return stats.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@register(f"""with {_SIGNALS}, b as (select c.*, 0.15 * least(1, coalesce(cells.n / greatest(5, l), 0)) as heat from c left join cells using (pkg), launches), f as (select *, score + floor(heat / 0.5 * score * 0.3) as final, name = 'Customer#000000007' as exact from b)
 select pkg, final, row_number() over (order by exact desc, final desc, ordinal) as rank from f""")
def relative_rerank(spark, sf_dir):
    """RNK7, RNK8, SRT2: boosts that lift a score in whole points."""
    c, cells, *_ = _signals(spark, sf_dir)
    return rank.rerank(rank.heatmap_boost(c, cells, 9, 2), "Customer#000000007", "relative").select("pkg", "final", "rank")


@register("""select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as pkg, round(least(1, 0.25 * count(*) over (partition by c_nationkey) / sum(w) over (partition by c_nationkey)) * w, 6) as personal from (select *, c_custkey % 10 / 10 as w from customer)""")
def limited_boosts(spark, sf_dir):
    """RNK10: a query's boosts scaled down to a quarter a row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").cast("string").alias("pkg"), (F.col("c_custkey") % 10 / 10).alias("personal"))
    return rank.limit_boosts(c, 0.25).withColumn("personal", r6("personal"))


@register("""select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as pkg, 0.0 as personal, c_acctbal as final, 'engine' as kind, row_number() over (partition by cast(c_nationkey as varchar) order by greatest(c_acctbal, 0) desc, cast(c_custkey as varchar)) as rank from customer""".replace("c_acctbal as final", "greatest(c_acctbal, 0) as final"))
def degraded_ranking(spark, sf_dir):
    """LRN21, RNK11, UDF3: a reader that fails leaves an empty table, and without affinities the engine's order stands."""

    def broken():
        raise OSError("no snapshot")

    snapshot, failed = rank.snapshot(spark, {"affinity": broken}, {"affinity": "query string, pkg string, current_weight double, confidence double"})
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").cast("string").alias("pkg"), F.col("c_acctbal").alias("score"))
    both = rank.merge_candidates(c, c.select("query", "pkg", F.lit(0.0).alias("score")))
    return rank.rank_candidates(both, None if failed else snapshot["affinity"])


@register("""with w as (select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as app, c_custkey % 11 / 10.0 as weight from customer where c_custkey % 3 = 0),
 o as (select o_orderkey, o_custkey, o_orderdate, cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as new_app from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'),
 c as (select o.*, cast(o_custkey + i as varchar) as candidate, i as place, i % 2 = 0 as text_match from o, unnest(range(8)) t(i)),
 s as (select query, candidate as app, o_orderdate as ts, case when text_match then 1 else 0 end as kind from c where place < 6 and candidate <> new_app union all select query, new_app, ts, 2 from (select distinct query, new_app, o_orderdate as ts from o)),
 k as (select query, app, list(kind order by ts, kind) as steps from s group by all),
 r as (select query, app, case when steps is null then weight else list_reduce(list_prepend(coalesce(weight, case when steps[1] = 2 then 0.6 else 0.5 end)::double, list_transform(steps, lambda x: x::double)), lambda w, x: greatest(0, least(1, case x when 2 then w + 0.3 when 1 then w * 0.85 else w * 0.5 end))) end as weight from w full join k using (query, app)),
 f as (select query, candidate as app, count(*) as flags from c where place < 6 and candidate <> new_app and not text_match group by all) select query, app, round(weight, 6) as weight, coalesce(flags, 0) as flags from r left join f using (query, app)""")
def healed_weights(spark, sf_dir):
    """LRN11: corrections lower the candidates' weights and raise the new app's; candidates that the text didn't match are blocked for three days."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").cast("string").alias("app"))
    weights = c.where("c_custkey % 3 = 0").select("query", "app", (F.col("c_custkey") % 11 / 10.0).alias("weight"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("ts"))
    shown = o.join(c, "c_custkey").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(7))))
    fixes = shown.select("query", (F.col("c_custkey") + F.col("place")).cast("string").alias("candidate"), "place", F.col("app").alias("new_app"), "ts", (F.col("place") % 2 == 0).alias("text_match"))
    weights, flags = L.self_heal(weights, fixes)
    n = flags.groupBy("query", "app").agg(F.count("*").alias("flags"))
    return weights.join(n, ["query", "app"], "left").select("query", "app", r6("weight").alias("weight"), F.coalesce("flags", F.lit(0)).alias("flags"))


@register("select event_id, event_type as rule, ts from events where event_type = 'click' and ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 50")
def recent_feedback(spark, sf_dir):
    """LRN25: the last fifty of a rule; the feature is the cap."""
    f = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule"), "ts")
    return L.recent_feedback(f, rule="click", since=roles.moment("2024-01-10"))


@register("select event_id, ts from events qualify count(*) over () < 2000 or row_number() over (order by ts desc, event_id desc) <= 1000")
def compacted_events(spark, sf_dir):
    """LRN17: retention; the feature is the cap."""
    return maintain.compact(table(spark, sf_dir, "events").select("event_id", "ts"), 1000, 1000)


@register("select p_partkey as app_id, p_name as name, coalesce(n, 0) as uses from part left join (select user_id, count(*) as n from events group by 1) on user_id = p_partkey")
def synced_usage(spark, sf_dir):
    """LRN19: all uses replaced."""
    uses = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("app_id")).agg(F.count("*").alias("uses"))
    return L.replace_usage(roles.catalog(spark, sf_dir).select("app_id", "name", "uses"), uses)


@register("select cast(l_orderkey as varchar) as query, cast(l_partkey as varchar) as app, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as place, round(1 - (row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) - 1) / count(*) over (partition by l_orderkey), 6) as factor from lineitem")
def position_factors(spark, sf_dir):
    """WIN11: the place's share of the list."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    place = F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", place.alias("place"), F.count("*").over(w).alias("n"))
    return i.select(F.col("l_orderkey").cast("string").alias("query"), F.col("l_partkey").cast("string").alias("app"), "place", r6(1 - (F.col("place") - 1) / F.col("n")).alias("factor"))


@register(f"""select 'weights' as step, count(*) as before, count(*) as after from events union all select 'edges', count(*), least(500, count(*) filter (rn <= 20)) from (select row_number() over (partition by user_id order by count(*) desc, event_type) as rn from events group by user_id, event_type)
 union all select 'memory', count(*), least(220, count(*) filter (ts > {AS_OF} - interval 90 day)) from events union all select 'flags', count(*), least(200, count(*) filter (ts + interval 3 day > {AS_OF})) from events where event_type = 'error'""")
def maintenance_report(spark, sf_dir):
    """MNT1 to MNT5: one pass over all state tables; what each step kept."""
    e, now = table(spark, sf_dir, "events"), as_of(spark, sf_dir)
    q, a = F.col("user_id").cast("string"), F.col("event_type")
    weights = e.select(q.alias("query"), a.alias("app"), (F.col("value") / 100).alias("weight"), F.col("ts").alias("last_ts"))
    edges = e.groupBy(q.alias("from_key"), a.alias("to_key")).agg(F.count("*").cast("double").alias("weight"))
    flags = e.where("event_type = 'error'").select(q.alias("query"), a.alias("app"), (F.col("ts") + F.expr("interval 3 days")).alias("expire_ts"), F.col("ts").alias("created_ts"))
    return maintain.maintain(weights, edges, e.select("ts", "event_id"), flags, now)[1]


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a file source watches folders
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, by way of a table in the shared folder."""
    home = shared_folder(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/epoch={epoch}")  # a batch that is run again replaces itself

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{home}/out")


@register("select cast(date_trunc('hour', ts) as timestamp) as hour, event_type as app, count(*) as n from events group by 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """STM6, SNK3: hourly counts kept by a stream; the last state of each."""
    e = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("app"))
    out = _drained(spark, jobs.hourly_counts(e, "40 days"), "update")
    return out.groupBy("hour", "app").agg(F.max_by("n", "epoch").alias("n"))


@register("""select user, event_id, ts from (select sha256(cast(user_id as varchar)) as user, event_id, ts from events order by ts desc, event_id desc limit 200)""")
def stream_feedback_ring(spark, sf_dir):
    """SNK3, STM7: the last two hundred, users hashed; the feature is the cap."""
    store = tables.Store(spark, shared_folder(spark, "ring"))
    e = _stream(spark, sf_dir).select(F.col("user_id").alias("user"), "event_id", "ts")
    log = shared_folder(spark, "ring-log")
    e.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(jobs.ring(store, "feedback")).start().awaitTermination()
    return store.read("feedback").select("user", "event_id", "ts")


@register("""with s as (select cast(user_id as varchar) as pkg, max_by(event_type, (ts, event_id)) as action, max(ts) as ts from events group by 1) select pkg, ts from s where action <> 'error'""")
def stream_package_changes(spark, sf_dir):
    """SRC4, STM6: a catalogue kept by a stream of changes."""
    store = tables.Store(spark, shared_folder(spark, "packages"))
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("pkg"), F.when(F.col("event_type") == "error", "REMOVED").otherwise("ADDED").alias("action"), "ts")
    log = shared_folder(spark, "packages-log")
    e.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(jobs.merge_changes(store, "packages", ["pkg"])).start().awaitTermination()
    return store.read("packages", "pkg string, ts timestamp").select("pkg", "ts")


def _keystrokes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session"), (F.col("event_id") * 37 + F.floor(F.col("value"))).cast("long").alias("ts_ms"), (F.col("event_type") == "error").alias("is_backspace"))


@register()
def typing_speeds(spark, sf_dir):
    """STM1, STM2: intervals, their moving average, errors and waits of each session; tested against the stream and plain Python."""
    return jobs.typing_batch(_keystrokes(spark, sf_dir))


@register()
def orchestrated_inputs(spark, sf_dir):
    """STM3: how many of a session's inputs fire a search, as a fold a session; tested against plain Python."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [(int(t), q or "") for t, q in pdf.sort_values("turn")[["t", "q"]].itertuples(index=False)]
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "inputs": [len(keys)], "fired": [len(jobs.orchestrate(keys, 80.0, 100.0))]})

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", (F.col("turn") * 90).alias("t"), F.col("text").alias("q"))
    return c.groupBy("session").applyInPandas(run, "session string, inputs long, fired long")


# --- small operators --------------------------------------------------------------------------------------------------


@register(f"""with {APPS}, {RUNGS_SQL} select query_id, app_id, name = q or abbr = q as exact from rungs, apps where starts_with(name, q) or starts_with(abbr, q)""")
def trie_hits(spark, sf_dir):
    """IDX7: entries below a prefix, and those that end there."""
    t, q = I.trie(roles.apps(spark, sf_dir)), roles.queries_frame(spark, roles.RUNGS)
    exact = I.trie_search(t, q, exact=True).withColumn("exact", F.lit(True))
    return I.trie_search(t, q).join(exact, ["query_id", "app_id"], "left").select("query_id", "app_id", F.coalesce("exact", F.lit(False)).alias("exact"))


@register("""with t as (select distinct lower(p_type) as category, lower(p_type) as term from part union select distinct lower(p_type), lower(p_brand) from part union select distinct lower(p_type), p_name from part) select category, count(*) as n, min(term) as first, max(term) as last from t group by 1""")
def category_terms(spark, sf_dir):
    """IDX11: labels, keywords and names that stand for a category."""
    a = roles.apps(spark, sf_dir)
    cats = a.groupBy(F.col("cat").alias("category")).agg(F.collect_set(F.element_at("tags", 1)).alias("keywords")).withColumn("label", F.upper("category"))
    return I.meta_index(a, cats).groupBy("category").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@register("""select event_id, round(case when event_id % 2 = 1 then 0.15 else 0.1 + case event_id % 5 when 1 then 0.05 when 0 then 0.2 when 4 then 0.2 else 0 end end * case when user_id % 4 between 1 and 2 then 0.5 else 1 end, 6)::double as increment from events""")
def click_increments(spark, sf_dir):
    """LRN2."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(L.click_increment(F.col("event_id") % 5, F.col("event_id") % 2 == 0, F.col("user_id") % 4)).alias("increment"))


@register("""select cast(c_nationkey as varchar) as query, cast(c_custkey as varchar) as app, case when c_custkey % 3 = 0 or c_acctbal <= 0 then 0.0 else round(least(0.5, c_acctbal / 5000 * 0.8), 6) end::double as boost, c_custkey % 3 <> 0 and c_acctbal / 500 <= -0.3 as suppressed from customer""")
def personal_boosts(spark, sf_dir):
    """LRN20: boosts of candidates; a third has no affinity."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("query"), F.col("c_custkey").cast("string").alias("app"), "c_acctbal")
    # the weight is scaled so that some are suppressed
    known = c.where("c_custkey % 3 <> 0").select("query", "app", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 5000).otherwise(F.col("c_acctbal") / 500).alias("current_weight"), F.lit(0.8).alias("confidence"))
    return L.boosts_for(known, c).withColumn("boost", r6("boost"))


@register("""select query, new_app, ts from (select cast(o_custkey as varchar) as query, cast(o_orderkey as varchar) as new_app, o_orderdate as ts, row_number() over (partition by o_custkey order by o_orderdate desc, cast(o_orderkey as varchar) desc) as n from orders) where n <= 10""")
def healing_histories(spark, sf_dir):
    """LRN11: the last ten corrections of each query."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("query"), F.col("o_orderkey").cast("string").alias("new_app"), F.col("o_orderdate").alias("ts"))
    return L.healing_history(o)


@register(f"""select event_id, round(value * greatest(0.35, pow(0.5, (epoch_us({AS_OF}) - epoch_us(ts)) / 86400e6 / 30)), 6) as weight from events""")
def multiplied_weights(spark, sf_dir):
    """MTH2, MNT1: weights times the half-life factor."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("weight"), F.col("ts").alias("last_ts"))
    return maintain.multiplied_decay(e, as_of(spark, sf_dir)).select("event_id", r6("weight").alias("weight"))


@register("""with s as (select user_id, event_type as pkg, ts as started_at, ts + to_minutes(cast(1 + event_id % 3 as int)) as ended_at from events), l as (select lag(pkg) over w as from_pkg, pkg as to_pkg, started_at as ts, epoch_us(started_at) - epoch_us(lag(ended_at) over w) as us from s window w as (partition by user_id order by started_at, pkg))
 select from_pkg, to_pkg, count(*) as n, sum(floor(us / 1000))::bigint as delay from l where from_pkg <> to_pkg and floor(us / 1000) between 0 and 86400000 group by all""")
def session_moves(spark, sf_dir):
    """JN10: from the end of a session to the start of the user's next."""
    e = roles.usage(spark, sf_dir)
    s = e.select("user", F.col("app").alias("pkg"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_dt_interval(mins=(1 + F.col("event_id") % 3).cast("int"))).alias("ended_at"))
    return patterns.session_transitions(s, 86_400_000).groupBy("from_pkg", "to_pkg").agg(F.count("*").alias("n"), F.sum("delay_ms").alias("delay"))


@register("select user_id as pkg, max(ts) as last_seen from events group by 1 order by last_seen desc, pkg limit 40")
def kept_patterns(spark, sf_dir):
    """LRN16: the cap is the feature."""
    seen = roles.usage(spark, sf_dir).groupBy(F.col("user").alias("pkg")).agg(F.max("ts").alias("last_seen"))
    return patterns.keep_patterns(seen, 40)


@register("""select p_partkey as pkg, array_to_string(list_filter([case when p_partkey % 2 = 0 then 'time_frequent' end, case when p_partkey % 3 = 0 then 'transition_target' end, case when p_partkey % 5 = 0 then 'recent_click' end, case when p_partkey % 7 = 0 then 'preferred' end], lambda x: x is not null), ' ') as tags from part""")
def intent_tags(spark, sf_dir):
    """VEC5: the signals that an app has."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pkg"))
    tags = vector.intent_tags(p, *[p.where(F.col("pkg") % n == 0) for n in (2, 3, 5, 7)])
    return tags.select("pkg", F.array_join("tags", " ").alias("tags"))


@register("select vec_id, len(embedding) as dim, round(cast(embedding[1] as double), 4) as first from embeddings")
def slim_vectors(spark, sf_dir):
    """SNK2: vectors as slim JSON, read back."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    read = corpus.slim_vectors(v.select("vector", F.col("vec_id").alias("user")), F.col("user")).select(F.from_json("value", "dim int, vec array<double>, mem long").alias("x"))
    return read.select(F.col("x.mem").alias("vec_id"), F.col("x.dim").cast("long").alias("dim"), F.round(F.col("x.vec")[0], 4).alias("first"))


@register("""select k as key, count(*) as n, sum(cast(json_extract(props, '$.' || k) as bigint)) as total from events, unnest(json_keys(props)) t(k) group by 1""")
def json_counts(spark, sf_dir):
    """ARR1: maps of counts from JSON."""
    e = table(spark, sf_dir, "events").select(F.explode(corpus.json_to_counts(F.col("props"))).alias("key", "value"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register(f"""with {APPS}, {SEARCHES}, h as (select query_id, app_id, cast(600 + {USAGE} as bigint) as score from searches join apps on name = q or abbr = q) select * from (select *, row_number() over (partition by query_id order by score desc, app_id) as rank from h) where rank <= 30""")
def formatted_hits(spark, sf_dir):
    """RET3: base points and usage."""
    a = roles.catalog(spark, sf_dir)
    return retrieve.formatted(retrieve.exact_search(searches(spark), a), a, 600)

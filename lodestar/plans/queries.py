"""Registered queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import maths as M
from ..functions import text as X
from ..operators import index as I
from ..operators import learn as L
from ..operators import lexical, maintain, patterns, rank, retrieve, semantic, stats, vector
from . import roles
from .hints import broadcast_if_small
from .roles import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

#: SQL of the catalogue's role, as a common table expression.
APPS = """apps as (
  select p_partkey as app_id, p_name as name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') as abbr,
    lower(p_type) as cat, lower(p_brand) as tag, coalesce(uses, 0) as uses, coalesce(uses, 0) > 0 as installed, last_used
  from part left join (select l_partkey, count(*) as uses, max(l_shipdate) as last_used from lineitem group by 1) on l_partkey = p_partkey)"""
USAGE = "least(80, 2 * uses) + case when installed then 60 else 0 end"
SEARCHES = "searches as (select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(roles.SEARCHES)) + ") t(query_id, q))"
AS_OF = "(select max(ts) from events)"


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def as_of(spark: SparkSession, sf_dir: str):
    """The latest event's time as a literal: footer statistics answer the aggregate, and no plan joins for a constant."""
    return roles.moment(roles.usage(spark, sf_dir).agg(F.max("ts")).head()[0])


def searches(spark: SparkSession) -> DataFrame:
    return roles.queries_frame(spark, roles.SEARCHES)


def r6(c):
    return F.round(c, 6)


# --- text functions --------------------------------------------------------------------------------------------------


@register("""select p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) as normal,
 translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', '22233344455566677778889999') as digits,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') as initials from part""")
def normalized_names(spark, sf_dir):
    """PRJ1, PRJ2, STR20, STR29: normal form, keypad digits, initials."""
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.full_normalize(n).alias("normal"), X.t9(n).alias("digits"), X.initials(n).alias("initials"))


@register("""with q as (select event_id, cast(substr(event_type, 1, cast(event_id % 9 as int)) || repeat(substr(event_type, 1, 1), cast(event_id % 5 as int)) as varchar) as q from events),
 s as (select *, length(q) as n, list_max(list_transform(list_distinct(string_split(q, '')), lambda c: len(list_filter(string_split(q, ''), lambda d: d = c)))) as most from q)
 select event_id, case when n = 0 then 'empty' when n < 2 then 'too_short' when n > 40 then 'too_long' when not regexp_matches(q, '[a-zA-Z0-9]') then 'no_alnum_or_cjk'
  when n >= 3 and most / n >= 0.6 then 'repetition_too_high' when length(regexp_replace(q, '(a{3})a+|(e{3})e+|(v{3})v+|(c{3})c+|(s{3})s+|(p{3})p+', '\\1\\2\\3\\4\\5\\6', 'g')) < 2 then 'after_compress_too_short' end as reason,
  case when n between 2 and 40 and regexp_matches(q, '[a-zA-Z0-9]') and not (n >= 4 and most / n > 0.6) then q end as accepted from s""")
def sanitize_reasons(spark, sf_dir):
    """FLT1, FLT2, STR15: queries built from event types, with runs of their first letter."""
    first = F.substring("event_type", 1, 1)
    q = F.concat(F.substring(F.col("event_type"), F.lit(1), (F.col("event_id") % 9).cast("int")), F.repeat(first, (F.col("event_id") % 5).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", q.alias("q"))
    return rows.select("event_id", X.sanitize_reason(F.col("q")).alias("reason"), X.sanitize(F.col("q")).alias("accepted"))


_PAIRS = "pairs as (select distinct a.p_name as a, b.p_name as b from (select distinct p_name from part) a, (select distinct p_name from part) b)"


def name_pairs(spark, sf_dir) -> DataFrame:
    """Every pair of the distinct names: a vocabulary of bounded size."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    return n.select(F.col("p_name").alias("a")).crossJoin(broadcast_if_small(n.select(F.col("p_name").alias("b"))))


@register(f"""with {_PAIRS}, s as (select a, b, list_distinct(string_split(a, '')) as x, list_distinct(string_split(b, '')) as y,
  list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) as x2, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) as y2 from pairs)
 select a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) as jaccard,
  round(len(list_intersect(x2, y2)) / (len(x2) + len(y2) - len(list_intersect(x2, y2))), 6) as bigram_jaccard,
  round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) as overlap,
  len(list_filter(x, lambda c: not list_contains(y, c))) = 0 as disorder,
  case when abs(length(a) - length(b)) > (length(a) + length(b)) / 2 + 2 then abs(length(a) - length(b)) else levenshtein(a, b) end as distance from s""")
def name_similarities(spark, sf_dir):
    """STR1, STR2, STR3, STR11, STR13."""
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf_dir).select(
        "a", "b", r6(X.jaccard(a, b)).alias("jaccard"), r6(X.ngram_jaccard(a, b)).alias("bigram_jaccard"), r6(X.overlap_ratio(a, b)).alias("overlap"), X.disorder(a, b).alias("disorder"), X.edit_distance(a, b).cast("long").alias("distance")
    )


@register(f"""with {_PAIRS}, q as (select *, abbr || 'g' as s from (select *, a[1] || a[2] as abbr from pairs))
 select a, b, s, regexp_matches(b, s[1] || '.*' || s[2] || '.*' || s[3]) as is_subsequence,
  contains(b, s[2] || s[1] || s[3]) or contains(b, s[1] || s[3] || s[2]) as adjacent_swap from q""")
def subsequences(spark, sf_dir):
    """STR9, STR10."""
    s = F.concat(F.substring("a", 1, 2), F.lit("g"))
    rows = name_pairs(spark, sf_dir).withColumn("s", s)
    return rows.select("a", "b", "s", X.is_subsequence(F.col("s"), F.col("b")).alias("is_subsequence"), X.adjacent_swap(F.col("s"), F.col("b")).alias("adjacent_swap"))


@register()
def pair_scores(spark, sf_dir):
    """STR4, STR6, STR7, STR8, STR12, STR14, STR16, STR26, RET38, RET39: tested against plain Python."""
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf_dir).select(
        "a", "b", X.contain_ratio(a, b).alias("contained"), X.gaussian_factor(a, b).alias("keys"), X.typing_factor(a).alias("typing"), X.subsequence_score(X.initials(a), b).alias("subsequence"), A.lcs_udf(a, b).alias("lcs"),
        A.keyboard_distance_udf(a, b).alias("keyboard"), X.soundex(a).alias("soundex"), X.continuity(X.initials(a), b).alias("continuity"), retrieve.scramble_score(a, b).alias("scramble"),
        X.syllable_match(X.initials(a), F.split(a, " ")).alias("syllables"), retrieve.char_subset_score(a, b).alias("subset"),
    )


@register()
def word_forms(spark, sf_dir):
    """STR16 to STR18, STR21: sounds, subword parts and keypad digits of every distinct word of the documents, and the stems of those in English ones."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    words = words.groupBy("word").agg(F.coalesce(F.bool_or(F.col("lang") == "en"), F.lit(False)).alias("english"))
    merges = [("t", "h"), ("e", "r"), ("i", "n"), ("th", "e"), ("in", "g"), ("o", "n"), ("ti", "on")]
    w = F.col("word")
    return words.select("word", A.porter_udf(F.when(F.col("english"), w)).alias("stem"), X.soundex(w).alias("soundex"), A.bpe_udf(merges)(w).alias("parts"), X.t9(w).alias("digits"))


@register("""select doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) as words, len(regexp_extract_all(text, '[0-9]+')) as numbers,
 case when regexp_matches(lower(text), '[a-z]') then 'en' else 'unknown' end as language,
 case when regexp_matches(trim(text), '^[2-9]+$') then 'NUMERIC_T9' when regexp_matches(text, '[A-Za-z]') then 'ENGLISH' else 'MIXED' end as input from documents""")
def document_tokens(spark, sf_dir):
    """PRJ3, PRJ4, STR22: Latin words, numbers and the script of every document."""
    tokens = lambda p: F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", tokens("[a-z]+").alias("words"), tokens("[0-9]+").alias("numbers"), X.detect_language(F.col("text"), ["ni", "hao", "wo", "men"]).alias("language"), X.input_language(F.col("text")).alias("input"))


INTENTS = {"ask": ["what", "which", "que", "wie"], "thing": ["thing", "cosa"], "of": [" of ", " de ", " von "]}


@register("""select conv_id, turn, array_to_string(list_filter([case when regexp_matches(lower(trim(text)), 'what|which|que|wie') then 'ask' end, case when regexp_matches(lower(trim(text)), 'thing|cosa') then 'thing' end,
 case when regexp_matches(lower(trim(text)), ' of | de | von ') then 'of' end], lambda x: x is not null), ',') as intents from conversations""")
def conversation_intents(spark, sf_dir):
    """STR24: intents of every turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.intents(F.col("text"), INTENTS), ",").alias("intents"))


@register(f"""with {_PAIRS} select a, b, (length(a) >= 2 and length(b) >= 2 and substr(a, 1, 2) = substr(b, 1, 2)) or
 len(list_filter(string_split(a, ''), lambda c: contains(b, c))) / greatest(length(a), length(b)) >= 0.5 as similar from pairs""")
def similar_queries(spark, sf_dir):
    """STR25, JN9."""
    return name_pairs(spark, sf_dir).select("a", "b", X.is_similar(F.col("a"), F.col("b")).alias("similar"))


# --- numbers and time ------------------------------------------------------------------------------------------------


@register("""with o as (select max(o_orderdate) as now from orders) select o_orderkey,
 case when now <= o_orderdate then 1.0 else round(greatest(0.05, pow(0.5, epoch_us(now) / 86400e6 / 30 - epoch_us(o_orderdate) / 86400e6 / 30)), 6) end as half_life,
 case when date_diff('day', o_orderdate, now) < 1 then 28 when date_diff('day', o_orderdate, now) < 3 then 18 when date_diff('day', o_orderdate, now) < 7 then 10 when date_diff('day', o_orderdate, now) < 30 then 4 else 0 end as last_used,
 round(greatest(0, 1 - least(1, date_diff('day', o_orderdate, now) / 15)), 6) as blend from orders, o""")
def order_decay(spark, sf_dir):
    """MTH2, MTH4, MTH6."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    now = roles.moment(orders.agg(F.max("o_orderdate")).head()[0])
    t = F.col("o_orderdate")
    return orders.select("o_orderkey", r6(M.half_life(t, now)).alias("half_life"), M.last_used_boost(t, now).alias("last_used"), r6(M.blend_weight(t, now, F.lit(False))).alias("blend"))


@register("""select event_id, least(90, 18 * (event_id % 5) + 4 * (event_id % 17)) as temporal, cast(greatest(0, floor((greatest(0, least(1, value / 100)) - 0.5) * 220 + 0.5)) as bigint) as weight,
 case when event_id % 3 <= 0 then 0 when event_id % 13 <= 1 then 1 when event_id % 13 <= 3 then 2 when event_id % 13 <= 6 then 3 when event_id % 13 <= 10 then 4 else 5 end as heat,
 case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 21 then 'evening' else 'night' end as part, cast(isodow(ts) - 1 as int) as weekday,
 cast(json_extract(props, '$.k') as bigint) as k from events""")
def event_points(spark, sf_dir):
    """MTH1, MTH7, MTH8, AGG5's levels, DAT1, JSN: points and time parts of every event."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    heat = F.when(i % 3 <= 0, 0).otherwise(M.heat_level(F.when(i % 13 <= 0, 1).otherwise(i % 13)))
    return e.select(
        "event_id", M.temporal_boost(i % 5, i % 17).alias("temporal"), M.weight_boost(F.col("value") / 100).alias("weight"), heat.alias("heat"), M.day_part(F.col("ts"), "late_night").alias("part"), F.weekday("ts").alias("weekday"),
        F.from_json("props", "k long")["k"].alias("k"),
    )


@register("""with m as (select event_type, min(value) as lo, max(value) as hi from events group by 1)
 select event_id, case when hi = lo then 0.5 else round((value - lo) / (hi - lo), 6) end as scaled from events join m using (event_type)""")
def scaled_values(spark, sf_dir):
    """PRJ8, WIN10: min-max within a type, by an aggregate of a few rows rather than a window over a hot key."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(F.broadcast(m), "event_type").select("event_id", r6(M.min_max(F.col("value"), F.col("lo"), F.col("hi"))).alias("scaled"))


# --- indexes ---------------------------------------------------------------------------------------------------------


@register(f"""with {APPS} select 'initials' as kind, k as key, count(*) as n from apps, unnest(list_distinct(list_transform(range(1, least(4, length(abbr)) + 1), lambda i: substr(abbr, 1, i)))) t(k) group by 2
 union all select 'prefix', k, count(distinct app_id) from apps, unnest([substr(name, 1, 2), substr(name, 1, 3), substr(abbr, 1, 2)]) t(k) group by 2
 union all select 'char', k, count(distinct app_id) from apps, unnest(string_split(name, '')) t(k) group by 2
 union all select 't9', k, count(distinct app_id) from (select app_id, translate(name, 'abcdefghijklmnopqrstuvwxyz ', '22233344455566677778889999') as d from apps), unnest([d[1], substr(d, 1, 2), substr(d, 1, 3), substr(d, 1, 4)]) t(k) group by 2""")
def posting_counts(spark, sf_dir):
    """IDX1, IDX3, IDX4, IDX5, SET1."""
    a = roles.apps(spark, sf_dir)
    rows = I.initials_index(a).unionByName(I.prefix_index(a)).unionByName(I.char_index(a)).unionByName(I.keypad_index(a))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"))


@register(f"""with {APPS}, w as (select distinct app_id, w from apps, unnest([name, abbr]) t(w)), p as (select app_id, substr(w, 1, i) as prefix, i = length(w) as terminal from w, unnest(range(1, length(w) + 1)) t(i))
 select prefix, count(distinct app_id) as n, count(distinct case when terminal then app_id end) as terminals from p group by 1""")
def trie_nodes(spark, sf_dir):
    """IDX6, IDX7: nodes of the trie with the apps below and at them."""
    return I.trie(roles.apps(spark, sf_dir)).groupBy("prefix").agg(F.count("*").alias("n"), F.count_if("is_terminal").alias("terminals"))


@register(f"""with {APPS}, {SEARCHES}, w as (select distinct app_id, w from apps, unnest(string_split(name, ' ')) t(w)),
 s as (select query_id, app_id, min(case when starts_with(w, q) then 1 when regexp_matches(w, array_to_string(string_split(replace(q, '#', ''), ''), '.*')) and not contains(q, '#') then 4 end) as stage
  from searches, w group by all having stage is not null)
 select query_id, stage, count(*) as n from (select *, min(stage) over (partition by query_id) as first from s) where stage = first group by all""")
def tree_cascade(spark, sf_dir):
    """IDX8, IDX9, IDX10."""
    found = I.tree_search(I.tree(roles.apps(spark, sf_dir)), searches(spark))
    return found.groupBy("query_id", "stage").agg(F.count("*").alias("n"))


@register(f"""with {APPS} select cat as category, count(*) as n, min(app_id) as first, max(app_id) as last from apps group by 1""")
def category_sizes(spark, sf_dir):
    """IDX11 to IDX13, RET29."""
    a = roles.apps(spark, sf_dir)
    clusters = spark.createDataFrame([("economy", "economy")], "name string, canonical string")
    return I.category_index(a, clusters).select("category", "n", F.array_min("app_ids").alias("first"), F.array_max("app_ids").alias("last"))


@register("""with t as (select doc_id, w from documents, unnest(regexp_extract_all(lower(text), '[a-z]+')) x(w)), l as (select doc_id, count(*) as len from t group by 1), c as (select doc_id, w, count(*) as tf from t group by all),
 d as (select w, count(*) as df from c group by 1 order by df desc, w limit 100), n as (select count(*) as n from documents)
 select w as term, count(*) as n, round(sum(tf / len * (ln((n + 1) / (df + 1)) + 1)), 4) as total, round(max(tf / len * (ln((n + 1) / (df + 1)) + 1)), 6) as largest from c join d using (w) join l using (doc_id), n group by 1""")
def tfidf_terms(spark, sf_dir):
    """IDX14: weights of the terms in most documents, summed up."""
    index = I.tfidf_index(table(spark, sf_dir, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return index.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"), r6(F.max("weight")).alias("largest"))


@register("select count(*) as rows, count(distinct p_partkey) as apps from part")
def dataset_fingerprint(spark, sf_dir):
    """PRJ7, IDX17: the fingerprint is no part of the result, as its value isn't contractual."""
    a = roles.apps(spark, sf_dir)
    return I.fingerprint(a).select("rows").crossJoin(a.agg(F.count_distinct("app_id").alias("apps")))


# --- lexical and vector retrieval ------------------------------------------------------------------------------------

_TOKENS = "list_concat(regexp_extract_all(lower(text), '[a-z]+'), regexp_extract_all(lower(text), '[0-9]+'))"


@register(f"""with d as (select doc_id, {_TOKENS} as t from documents), len as (select doc_id, len(t) as len from d), s as (select count(*) as n, avg(len) as avgdl from len),
 q as (select distinct item_id as query_id, w from benchmark, unnest({_TOKENS}) x(w)),
 tf as (select doc_id, w, count(*) as tf from d, unnest(t) x(w) where w in (select w from q) group by all), df as (select w, count(*) as df from tf group by 1),
 sc as (select query_id, doc_id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) as score
  from q join tf using (w) join df using (w) join len using (doc_id), s group by all)
 select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 10""")
def bm25_topk(spark, sf_dir):
    """IDX15, VEC1: the best ten documents of every benchmark passage."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = lexical.bm25(table(spark, sf_dir, "documents"), q)
    return found.select("query_id", "id", r6("score").alias("score"), "rank")


@register(f"""with {APPS}, {SEARCHES}, t as (select app_id, w from apps, unnest(string_split(name, ' ')) x(w)), c as (select app_id, w, count(*) as tf from t group by all), l as (select app_id, count(*) as len from t group by 1),
 d as (select w, count(*) as df from c group by 1 order by df desc, w limit 100), n as (select count(*) as n from apps), q as (select distinct query_id, w from searches, unnest(string_split(q, ' ')) x(w))
 select query_id, app_id as id, round(30 * sum(tf / len * (ln((n + 1) / (df + 1)) + 1)), 6) as score from q join c using (w) join d using (w) join l using (app_id), n group by all""")
def tfidf_scores(spark, sf_dir):
    """RET11: the searches against the catalogue's names."""
    index = I.tfidf_index(roles.apps(spark, sf_dir), F.split("name", " "), "app_id")
    found = lexical.tfidf_search(index, searches(spark), F.split("q", " "))
    return found.withColumn("score", r6("score"))


@register("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), p as (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.v, b.v), 6) as score from v a, v b)
 select query_id, id, score, rank from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from p) where rank <= 10""")
def knn_topk(spark, sf_dir):
    """VEC2, VEC3, MTH5, JN8: the ten nearest of every vector by exact search."""
    v = table(spark, sf_dir, "embeddings")
    found = vector.knn(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")))
    return found.select("query_id", "id", r6("score").alias("score"), "rank")


@register("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), c as (select label, list(vec_id order by vec_id)[1] as q from embeddings group by 1),
 p as (select c.label, b.vec_id as id, 0.4 * list_cosine_similarity(a.v, b.v) + 0.6 * greatest(0, list_cosine_similarity(a.v, b.v)) as s from c join v a on a.vec_id = c.q, v b) select label as query_id, id, round(s, 6) as score from p""")
def blended_scores(spark, sf_dir):
    """VEC8, MTH4: two indexes' scores of each label's first vector, six days into a transition of fifteen."""
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).select(F.col("label").alias("query_id"), "q")
    scored = v.crossJoin(broadcast_if_small(first)).select("query_id", F.col("vec_id").alias("id"), M.cosine(F.col("q"), F.col("embedding")).alias("score"))
    new = scored.where("score > 0")
    return vector.blend(scored, new, 0.4).withColumn("score", r6("score"))


@register("""select part.p_partkey as id, round(greatest(0, least(0.3, 0.15 * (p_size / 50.0) + case when p_size % 2 = 0 then 0.05 else 0 end + case when p_type = 'PROMO' then 0.10 else 0 end + (p_retailprice / 2000 - 0.5) * 0.04)), 6) as boost from part""")
def result_boosts(spark, sf_dir):
    """VEC10."""
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("query_id"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("semantic"), (F.col("p_size") % 2 == 0).alias("synonym"), (F.col("p_type") == "PROMO").alias("intent"), (F.col("p_retailprice") / 2000).alias("popularity"))
    return vector.boost(p).select("id", r6("boost").alias("boost"))


@register()
def document_vectors(spark, sf_dir):
    """VEC4 to VEC6, UDF2: every part's document embedded by the hashing port in 512 dimensions."""
    a = roles.apps(spark, sf_dir).select(F.col("app_id").alias("pkg"), F.col("name").alias("label"), F.lit("").alias("pinyin"), F.col("abbr").alias("initials"), F.split("name", " ").alias("syllables"))
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pkg"), F.lower("p_type").alias("phrase"))
    return vector.rebuild(vector.document_text(a, tags), A.hash_embedder)


# --- retrieval -------------------------------------------------------------------------------------------------------


@register(f"""with {APPS}, {SEARCHES}, h as (select query_id, app_id, min(case when name = q or abbr = q then 0 when starts_with(name, q) or starts_with(abbr, q) then 1 end) as tier from searches, apps group by all having tier is not null),
 t as (select h.query_id, h.app_id, tier, cast((case tier when 0 then 1000 else 800 end) + {USAGE} as bigint) as score from (select *, min(tier) over (partition by query_id) as first from h) h join apps using (app_id) where tier = first)
 select query_id, app_id, tier, score, rank from (select *, row_number() over (partition by query_id order by score desc, app_id) as rank from t) where rank <= 30""")
def tiered_search(spark, sf_dir):
    """RET1, RET2, RET3, RET12, RET14, WIN1, JN1, JN6: exact hits, else prefix hits, of each search."""
    a, q = roles.catalog(spark, sf_dir), searches(spark)
    low = q.select("query_id", X.lowered(F.col("q")).alias("q"))
    exact = retrieve.exact_search(low, a).withColumn("tier", F.lit(0))
    hits = retrieve.first_tier(exact.unionByName(retrieve.prefix_search(low, a).withColumn("tier", F.lit(1))))
    scored = hits.join(a.select("app_id", "uses", "installed"), "app_id").select("query_id", "app_id", "tier", (F.when(F.col("tier") == 0, 1000).otherwise(800) + retrieve.usage_score()).cast("long").alias("score"))
    return retrieve.top(scored, 30, F.desc("score"), F.asc("app_id"))


@register()
def tiered_search_fuzzy(spark, sf_dir):
    """RET4 to RET7, RET14: with the fuzzy tier for searches without exact or prefix hits; tested against plain Python."""
    return retrieve.tiered_search(searches(spark), roles.catalog(spark, sf_dir))


@register(f"""with {APPS}, {SEARCHES}, c as (select query_id, q, app_id, name, abbr, cat, tag, list_distinct(string_split(q, '')) as x, list_distinct(string_split(name || name || abbr, '')) as y from searches, apps),
 d as (select *, case when name = q or abbr = q then 1000.0 when starts_with(name, q) or starts_with(abbr, q) then 800.0 when contains(name, q) or contains(abbr, q) then 600.0 end as named,
  len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) as jac from c)
 select query_id, count(*) as n, sum(case when named is not null then named else 0 end) as named, round(sum(case when named is null and jac > 0.5 then 400 * jac else 0 end), 3) as by_chars,
  sum(case when contains(cat, q) then 80 else 0 end) as by_category, sum(case when contains(tag, q) then 50 else 0 end) as by_tag from d group by 1""")
def mece_dimensions(spark, sf_dir):
    """RET4: the dimensions of the match score, summed over every pair."""
    q = searches(spark)
    pairs = roles.apps(spark, sf_dir).crossJoin(broadcast_if_small(q))
    low, x = retrieve.low, F.col("q")
    exact, starts, inside = (retrieve.any_field(f) for f in (lambda f: f == x, lambda f: (f != "") & f.startswith(x), lambda f: f.contains(x)))
    named = F.when(exact, 1000.0).when(starts, 800.0).when(inside, 600.0)
    jac = retrieve.char_jaccard(x)
    rows = pairs.select("query_id", named.alias("named"), jac.alias("jac"), low("cat").contains(x).alias("cat"), F.exists("tags", lambda t: t.contains(x)).alias("tag"))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("named", F.lit(0.0))).alias("named"), F.round(F.sum(F.when(F.col("named").isNull() & (F.col("jac") > 0.5), 400 * F.col("jac")).otherwise(0.0)), 3).alias("by_chars"),
        F.sum(F.when(F.col("cat"), 80).otherwise(0)).alias("by_category"), F.sum(F.when(F.col("tag"), 50).otherwise(0)).alias("by_tag"),
    )


@register()
def union_pipeline(spark, sf_dir):
    """RET9 to RET13, SRT1, SET2: union mode with category and TF-IDF supplements; tested against plain Python."""
    a, q = roles.catalog(spark, sf_dir), searches(spark)
    keywords = a.select(F.explode(F.array_distinct(X.chars(F.col("cat")))).alias("key"), "app_id")
    tfidf = lexical.tfidf_search(I.tfidf_index(roles.apps(spark, sf_dir), F.split("name", " "), "app_id"), q, F.split("q", " ")).withColumnRenamed("id", "app_id")
    return retrieve.union_pipeline(q, a, retrieve.meta_chars(q, keywords), tfidf)


def _values(name: str, texts: list[str]) -> str:
    return f"{name} as (select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(texts)) + ") t(query_id, q))"


_RUNGS = RUNGS_SQL = _values("rungs", roles.RUNGS)
#: The forms of the names of :func:`roles.named`, and the terms of the categories.
_FORMS = """f as (select app_id, uses, cat, name, cat || split_part(name, ' ', 2) as py, cat[1] || split_part(name, ' ', 2)[1] as abbr, split_part(name, ' ', 1) as en from apps)"""
_TERMS = """terms as (select distinct lower(p_brand) as term, p_type as category, 'keyword' as kind from part union select distinct lower(p_type), p_type, 'label' from part
  union select distinct lower(p_type)[1:4], p_type, 'root' from part union select distinct right(lower(p_type), 2), p_type, 'initials' from part)"""


def _category_sql(q: str) -> str:
    """Points of terms for the queries of the table ``q``."""
    return f"""(select query_id, category, max(points) as score from (select query_id, category, case kind when 'keyword' then case when term = q then 100 when starts_with(term, q) then 90 when contains(term, q) then 70 end
  when 'root' then case when term = q then 94 when starts_with(term, q) or starts_with(q, term) then 82 when contains(term, q) or contains(q, term) then 66 end
  when 'label' then case when term = q then 95 when contains(term, q) then 75 end else case when term = q then 85 when starts_with(term, q) then 80 end end as points from {q}, terms) where points is not null group by all)"""


def _scramble_sql(t: str, guard: int) -> str:
    """The scramble of q in the column ``t``; ASCII texts of up to 32 characters."""
    share = f"(len(list_intersect(string_split(q, ''), string_split({t}, ''))) / len(list_distinct(string_split(q, ''))))"
    hit = f"list_sum(list_transform(list_distinct(string_split(q, '')), lambda c: least(length(q) - length(replace(q, c, '')), length({t}) - length(replace({t}, c, '')))))"
    r = f"({hit} / length(q))"
    bands = f"case when {r} >= 0.9 then 250 * {r} * (1 + {hit} / length({t}) * 0.5) when {r} >= 0.7 then 200 * {r} * (1 + {hit} / length({t}) * 0.3) when {r} >= 0.5 then 150 * {r} when {r} >= 0.3 then 100 * {r} else 80 * {r} end"
    missing = f"len(list_filter(string_split(q, ''), lambda c: not contains({t}, c))) > 0"
    return f"case when length({t}) = 0 or length(q) > {guard} * length({t}) then 0 when {missing} then floor(round(0.6 * case when {share} >= 0.5 then floor(round(120 * {share}, 4)) else 0 end, 4)) else least(300, floor(round({bands}, 4))) end"


@register(f"""with {APPS}, {_RUNGS}, {_FORMS}, {_TERMS}, m as {_category_sql("rungs")},
 p as (select r.query_id, q, length(q) as n, f.*, coalesce(m.score, 0) as points from rungs r cross join f left join m on m.query_id = r.query_id and lower(category) = cat),
 i as (select *, case when contains(name, q) then 150 + 5 * n when contains(py, q) then 120 + 4 * n else 0 end as inside from p),
 e as (select *, case when inside < 380 and en = q then 380 when inside < 300 and starts_with(en, q) then 300 + 4 * n else inside end as english from i),
 c as (select *, case when english < 200 and points > 0 then greatest(english, 30, cast(floor(points * 0.5) as int)) else english end as meta from e),
 z as (select *, case when meta < 150 and n >= 2 then greatest(meta, {", ".join(_scramble_sql(t, 2) for t in ("name", "py", "abbr", "en"))}) else meta end as rest from c),
 s as (select query_id, app_id, uses, case when n = 1 then case when starts_with(abbr, q) then 350 when starts_with(name, q) then 300 when starts_with(py, q) then 250 when contains(name, q) then 150 when contains(py, q) then 120 else 0 end
  when name = q then 1000 when starts_with(name, q) then 800 + 6 * n when py = q then 600 when starts_with(py, q) then 500 + 5 * n when abbr = q then 400 when starts_with(abbr, q) then 350 + 4 * n else rest end as raw from z),
 t as (select query_id, app_id, cast(least(1200, floor(raw * (1 + cast(0.015 as double) * least(uses, 100)))) as bigint) as score from s where raw > 0)
 select query_id, app_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, app_id) as rank from t where score >= 25) where rank <= 30""")
def ladder_search(spark, sf_dir):
    """RET15 to RET18, RET21, RET35, FLT5: every rung of the ladder, over names whose syllables, initials and English names differ."""
    return retrieve.ladder_search(roles.queries_frame(spark, roles.RUNGS), roles.named(spark, sf_dir), roles.category_terms(spark, sf_dir))


@register()
def tolerant_search(spark, sf_dir):
    """RET19, RET20, RET33 to RET35, RET37, RET40: near misses, typing and scrambles; tested against the rules in plain Python."""
    return retrieve.tolerant_search(searches(spark), roles.named(spark, sf_dir), roles.category_terms(spark, sf_dir))


@register()
def language_search(spark, sf_dir):
    """RET22, RET23, RET36: scorers by script; tested against the rules in plain Python."""
    return retrieve.language_search(roles.queries_frame(spark, [*roles.RUNGS, "7464", "222", "\u7ea2 ring"]), roles.named(spark, sf_dir))


@register()
def append_search(spark, sf_dir):
    """RET26: several names run together; tested against the rules in plain Python."""
    return retrieve.append_search(roles.queries_frame(spark, roles.RUN_TOGETHER), roles.named(spark, sf_dir), roles.category_terms(spark, sf_dir))


@register(f"""with {APPS}, {_RUNGS}, {_FORMS}, d as (select distinct q, name, py, abbr, en from rungs, f), c as (select *, {_scramble_sql("name", 4)} as a1, {_scramble_sql("py", 4)} as a2, {_scramble_sql("abbr", 4)} as a3, {_scramble_sql("en", 4)} as a4 from d),
 x as (select *, greatest(a1, a2, a3, a4) as mixed, list_distinct(string_split(q, '')) as qs, list_distinct(string_split(name, '')) as ns, list_distinct(string_split(py, '')) as ps, list_distinct(string_split(abbr, '')) as hs,
  list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) as q2, list_distinct(list_transform(range(1, length(py)), lambda i: substr(py, i, 2))) as p2,
  case when abs(length(q) - length(py)) > (length(q) + length(py)) // 2 + 2 then abs(length(q) - length(py)) else levenshtein(q, py) end as d, greatest(length(py) // 2, 3) as most from c),
 y as (select *, len(list_intersect(qs, ns)) / greatest(len(qs), len(ns)) as o, len(list_intersect(qs, ps)) / greatest(len(qs), len(ps)) as op, len(list_intersect(q2, p2)) / (len(q2) + len(p2) - len(list_intersect(q2, p2))) as g,
  len(list_intersect(qs, hs)) / (len(qs) + len(hs) - len(list_intersect(qs, hs))) as j from x),
 z as (select *, d <= most and d > 0 and op >= 0.5 as s1, length(q) > 1 and g >= 0.35 as s2, length(q) > 1 and length(abbr) > 1 and j >= 0.6 as s3, o >= 0.4 as s4, mixed >= 50 as s5 from y)
 select q, name, py, cast(mixed as bigint) as mixed, cast(case when s1::int + s2::int + s3::int + s4::int + s5::int >= 2 then floor(round(case when s1 then 120 + (1 - d / most) * 80 else 0 end + case when s2 then 80 + g * 80 else 0 end
  + case when s3 then 60 + j * 60 else 0 end + case when s4 then 50 + o * 50 else 0 end + case when s5 then mixed * 0.5 else 0 end, 4)) else 0 end as bigint) as combined from z""")
def scramble_scores(spark, sf_dir):
    """RET21, RET22: scrambles and the sum of signals of every pair of a search and a name."""
    q = F.col("q")
    pairs = retrieve.mixed(retrieve.asked_forms(roles.queries_frame(spark, roles.RUNGS), roles.named(spark, sf_dir)))
    return pairs.select("q", F.col("f_name").alias("name"), F.col("f_py").alias("py"), F.col("mixed").cast("long").alias("mixed"), retrieve.combined_score(q).cast("long").alias("combined"))


@register(f"""with {_RUNGS}, {_TERMS}, m as {_category_sql("rungs")} select query_id, category, score from m""")
def category_matches(spark, sf_dir):
    """RET27, JN7."""
    return retrieve.match_category(roles.queries_frame(spark, roles.RUNGS), roles.category_terms(spark, sf_dir))


@register(f"""with {APPS}, {_RUNGS}, k as (select distinct name as term, cat as category, 'app' as kind from apps union select distinct cat, cat, 'label' from apps union select distinct tag, cat, 'keyword' from apps), t as (select distinct term, category from k),
 a as (select query_id, w as action from rungs, unnest(string_split(q, ' ')) x(w)), g as (select query_id, case when contains(q, 'ring') then 'BUY' when contains(q, 'bolt') then 'WORK' end as intent from rungs), i as (select * from (values ('BUY', 'promo', 74), ('BUY', 'economy', 74), ('WORK', 'standard', 70)) x(intent, category, points)),
 x as (select query_id, synonym, score from rungs join (values ('red ring', 'promo', 0.9), ('blue', 'blue gear', 0.85), ('er', 'economy ring', 0.6)) z(q, synonym, score) using (q)),
 p as (select query_id, category, case when term = q then 120 when contains(term, q) or contains(q, term) then 56 when len(list_filter(string_split(term, ''), lambda c: contains(q, c))) >= ceil(greatest(2, round(0.6 * length(term), 4))) then 24 end as points from rungs, t
  union all select query_id, category, 70 from a join (select distinct term, category from k where kind = 'keyword') on action = term union all select query_id, category, points from g join i using (intent)
  union all select query_id, category, case when synonym = term then floor(80 * score + 0.5) when contains(synonym, term) or contains(term, synonym) then floor(38 * score + 0.5) end from x, t),
 y as (select query_id, category, sum(points) as points from p where points is not null group by all),
 m as (select *, row_number() over (partition by cat order by uses desc, app_id) - 1 as nth from apps), s as (select query_id, app_id, category, cast(greatest(20, points - 2 * nth) + {USAGE} as bigint) as score from m join y on cat = category where nth < 20)
 select query_id, app_id, category, score, rank from (select *, row_number() over (partition by query_id order by score desc, app_id) as rank from s) where rank <= 20""")
def meta_search(spark, sf_dir):
    """RET8, LIM1: terms, actions, intents and expansions."""
    a = roles.catalog(spark, sf_dir)
    of = lambda c, kind: a.select(c.alias("term"), F.col("cat").alias("category"), F.lit(kind).alias("kind")).distinct()
    terms = of(F.col("name"), "app").unionByName(of(F.col("cat"), "label")).unionByName(of(F.element_at("tags", 1), "keyword"))
    q = roles.queries_frame(spark, roles.RUNGS)
    actions = q.select("query_id", F.explode(F.split("q", " ")).alias("action"))
    intents = q.select("query_id", F.when(F.col("q").contains("ring"), "BUY").when(F.col("q").contains("bolt"), "WORK").alias("intent")).where("intent is not null")
    near = spark.createDataFrame([("red ring", "promo", 0.9), ("blue", "blue gear", 0.85), ("er", "economy ring", 0.6)], "q string, synonym string, score double")
    points = [("BUY", "promo", 74), ("BUY", "economy", 74), ("WORK", "standard", 70)]
    found = retrieve.meta_search(q, a, terms, actions=actions, intents=intents, expansions=q.join(near, "q").select("query_id", "synonym", "score"), intent_points=points)
    return found.withColumn("score", F.col("score").cast("long"))


@register(f"""with {_RUNGS}, {_TERMS}, t as (select term, category as label, case kind when 'keyword' then 'word' else kind end as kind, length(category) as priority from terms where kind <> 'root'),
 h as (select query_id, label, priority, case kind when 'word' then case when term = q then 100 when starts_with(term, q) then 80 when contains(term, q) and length(q) >= 2 then 65 end
  when 'label' then case when term = q then 95 when contains(term, q) and length(q) >= 2 then 90 end else case when not regexp_full_match(q, '[a-z]{{2,8}}') then null when term = q then 70 when starts_with(term, q) then 60 end end as strength from rungs, t),
 s as (select query_id, label, cast(max(100 + floor(0.6 * strength) + floor(0.4 * priority)) as bigint) as score from h where strength is not null group by all)
 select query_id, label, score, row_number() over (partition by query_id order by score desc, label) as rank from s""")
def tag_search(spark, sf_dir):
    """RET28, SRT3."""
    kind = F.when(F.col("kind") == "keyword", "word").otherwise(F.col("kind")).alias("kind")
    tags = roles.category_terms(spark, sf_dir).where("kind <> 'root'").select(F.col("category").alias("label"), "term", kind, F.length("category").alias("priority"))
    return retrieve.tag_search(roles.queries_frame(spark, roles.RUNGS), tags)


@register(f"""with {APPS}, {SEARCHES} select query_id, exists (select 1 from apps where cat = q) as is_category from searches""")
def category_queries(spark, sf_dir):
    """RET29, JN5."""
    return retrieve.is_category(searches(spark), roles.apps(spark, sf_dir))


@register("""with p as (select distinct cast(user_id % 10 as varchar) as query, user_id from events where event_type = 'error'), c as (select user_id, event_type as app from events where event_type <> 'error'),
 n as (select query, app, count(*) as n from p join c using (user_id) group by all) select query, app, n, rank from (select *, row_number() over (partition by query order by n desc, app) as rank from n) where rank <= 5""")
def unknown_suggestions(spark, sf_dir):
    """RET30, AGG23."""
    e = roles.usage(spark, sf_dir)
    pending = e.where("app = 'error'").select((F.col("user") % 10).cast("string").alias("query"), "user")
    return retrieve.unknown_suggestions(pending, e.where("app <> 'error'").select("user", "app"))

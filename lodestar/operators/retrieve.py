"""Retrieval: many queries against the catalogue in one plan.

Queries are (query_id, q), apps have app_id, name, py, en, abbr, cat, tags, uses and installed. Every score is a column
expression; every tier or source keeps its ordinal, so "the first tier that finds anything" is a window over the hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import maths as M
from ..functions import text as X
from ..plans.hints import asked_of, broadcast_if_small
from . import index as I

FIELDS = ("name", "py", "en", "abbr")
#: Points of a match in the union pipeline.
UNION_SCORES = {"initial": 120, "t9": 100, "prefix": 80, "adjacent_swap": 60, "char": 56, "meta": 56, "trie": 50, "disorder": 38}


def top(df: DataFrame, k: int, *order: Column, group: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def best(df: DataFrame, *, score: str = "score") -> DataFrame:
    """One row per query and app: that of the highest score, the smaller remaining columns on ties."""
    rest = [c for c in df.columns if c not in ("query_id", "app_id", score)]
    key = F.struct(F.col(score), *[(-F.col(c) if dict(df.dtypes)[c] in ("int", "bigint") else F.col(c)).alias(f"_{c}") for c in rest]) if rest else F.col(score)
    row = F.struct(F.col(score), *[F.col(c) for c in rest])
    return df.groupBy("query_id", "app_id").agg(F.max_by(row, key).alias("x")).select("query_id", "app_id", "x.*")


def clean(queries: DataFrame) -> DataFrame:
    """The queries that the sanitiser lets through, lower case."""
    return queries.select("query_id", F.lower(X.sanitize(F.col("q"))).alias("q")).where("q is not null")


def low(name: str) -> Column:
    return X.lowered(F.col(name))


def any_field(test) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(test(low(f)), F.lit(False)) for f in FIELDS))


def usage_score() -> Column:
    """Points for launches and for being installed."""
    return M.launch_boost(F.col("uses")) + M.installed_boost(F.col("installed"))


# --- tiers -----------------------------------------------------------------------------------------------------------


def words(apps: DataFrame) -> DataFrame:
    """(app_id, word) of the catalogue's names."""
    rows = apps.select("app_id", F.explode(F.array_distinct(F.array(*[low(f) for f in FIELDS]))).alias("word"))
    return rows.where("word <> ''")


def exact_search(queries: DataFrame, apps: DataFrame) -> DataFrame:
    """(query_id, app_id): some name equals the query. An equi-join."""
    q = queries.select("query_id", low("q").alias("word"))
    return words(apps).join(asked_of(q), "word").select("query_id", "app_id").distinct()


def prefix_search(queries: DataFrame, apps: DataFrame) -> DataFrame:
    """(query_id, app_id): some name starts with the query. The join is on the first two characters, or one of a single one."""
    q = queries.select("query_id", low("q").alias("q")).where("q <> ''")
    first = [(n, q.where(F.length("q") == 1) if n == 1 else q.where(F.length("q") >= 2)) for n in (1, 2)]
    keyed = [x.withColumn("start", F.substring("q", 1, n)).withColumn("n", F.lit(n)) for n, x in first]
    asked = keyed[0].unionByName(keyed[1])
    w = words(apps).select("app_id", "word", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("start")) for n in (1, 2)])).alias("s"))
    w = w.select("app_id", "word", "s.n", "s.start")
    return w.join(asked_of(asked), ["n", "start"]).where(F.col("word").startswith(F.col("q"))).select("query_id", "app_id").distinct()


def formatted(hits: DataFrame, apps: DataFrame, base: int, k: int = 30) -> DataFrame:
    """(query_id, app_id, score, rank): base points plus usage, best ``k``, ties by app_id."""
    scored = hits.join(apps.select("app_id", "uses", "installed"), "app_id").select("query_id", "app_id", (F.lit(base) + usage_score()).cast("long").alias("score"))
    return top(scored, k, F.desc("score"), F.asc("app_id"))


def tiered_search(queries: DataFrame, apps: DataFrame, k: int = 30, t9: bool = True) -> DataFrame:
    """(query_id, app_id, tier, score, rank): exact hits if there are any, else prefix hits, else fuzzy ones."""
    q = queries.select("query_id", low("q").alias("q"))
    exact = exact_search(q, apps).withColumn("tier", F.lit(0)).withColumn("base", F.lit(1000))
    prefix = prefix_search(q, apps).withColumn("tier", F.lit(1)).withColumn("base", F.lit(800))
    named = exact.unionByName(prefix)
    scored = named.join(apps.select("app_id", "uses", "installed"), "app_id").select("query_id", "app_id", "tier", (F.col("base") + usage_score()).cast("long").alias("score"))
    # what exact or prefix search settles isn't scored again
    open_ = q.join(named.select("query_id").distinct(), "query_id", "left_anti")
    fuzzy = fuzzy_search(open_, apps, t9=t9).select("query_id", "app_id", F.lit(2).alias("tier"), "score")
    return top(first_tier(scored.unionByName(fuzzy)), k, F.desc("score"), F.asc("app_id"))


def first_tier(hits: DataFrame, tier: str = "tier") -> DataFrame:
    """The rows of each query's first tier."""
    return hits.withColumn("_t", F.min(tier).over(Window.partitionBy("query_id"))).where(F.col("_t") == F.col(tier)).drop("_t")


def is_candidate(q: Column) -> Column:
    """Whether an app shares a keypad prefix, a short prefix or a character with the query, as the indexes of these say."""
    key = F.substring(q, 1, 3)
    letters = X.chars(F.concat(low("name"), low("py"), low("en")))
    return I.keypad().startswith(F.substring(q, 1, 4)) | ((F.length(key) >= 2) & any_field(lambda f: f.startswith(key))) | F.arrays_overlap(letters, X.chars(q))


def mece_score(q: Column, use_t9: Column | None = None, extended: bool = True) -> Column:
    """Best of the match dimensions; 0 for none.

    Exact 1000, prefix 800, contains 600; only without those the best of subsequence (400 at most), characters (400 times
    their Jaccard similarity over a half), initials 250; keypad 700 and 500; category 80, tag 50.
    """
    exact, starts, inside = (any_field(f) for f in (lambda f: f == q, lambda f: (f != "") & f.startswith(q), lambda f: f.contains(q)))
    sub = F.coalesce(*[F.when(s > 0, s) for s in (X.subsequence_score(q, low(f)) for f in ("name", "py", "en"))], F.lit(0))
    jac = char_jaccard(q)
    fuzzy = F.greatest(
        F.least(F.lit(400.0), sub.cast("double")),
        F.when(jac > 0.5, 400 * jac).otherwise(0.0) if extended else F.lit(0.0),
        F.when(X.is_subsequence(q, I.initials_key()) | X.is_subsequence(q, X.initials(low("en"))), 250.0).otherwise(0.0),
    )
    named = F.when(exact, 1000.0).when(starts, 800.0).when(inside, 600.0).otherwise(fuzzy)
    parts = [named]
    if use_t9 is not None:
        digits = X.t9(F.concat(X.text(F.col("name")), low("py"), low("en")))
        parts.append(F.when(use_t9 & digits.startswith(q), 700.0).when(use_t9 & digits.contains(q), 500.0).otherwise(0.0))
    if extended:
        parts.append(F.when(low("cat").contains(q), 80.0).otherwise(0.0))
        parts.append(F.when(F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: X.lowered(t).contains(q)), 50.0).otherwise(0.0))
    return F.greatest(*parts) if len(parts) > 1 else named


def char_jaccard(q: Column) -> Column:
    """Jaccard similarity of the query's characters and those of all the app's names."""
    return X.jaccard(q, F.concat(*[F.lower(X.text(F.col(f))) for f in FIELDS]))


def keyboard_factor(q: Column, score: Column) -> Column:
    """A Latin query's score times how near its first keys are to the name's."""
    name = low("name")
    target = F.when(F.col("name").rlike(r"^[A-Za-z0-9\s]+$"), name).when(low("py") != "", low("py")).when(low("en") != "", low("en")).otherwise(name)
    typed = q.rlike("^[a-z]+$") & (F.length(q) >= 2) & (score > 0)
    return F.when(typed, M.half_up(score * X.gaussian_factor(q, target)).cast("double")).otherwise(score)


def fuzzy_search(queries: DataFrame, apps: DataFrame, k: int | None = None, t9: bool = True) -> DataFrame:
    """(query_id, app_id, score, rank): scored candidates, with keyboard and character factors and usage points."""
    q = queries.select("query_id", low("q").alias("q")).where("q <> ''")
    # every distinct set of names, category and tags meets every distinct query once; it is joined back to its apps for their usage
    of = [*FIELDS, "cat", "tags"]
    named = apps.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in (*FIELDS, "cat")} | {"tags": F.coalesce(F.col("tags"), F.array().cast("array<string>"))})
    pairs = named.select(*of).distinct().crossJoin(broadcast_if_small(q.select("q").distinct())).where(is_candidate(F.col("q")))
    use_t9 = F.col("q").rlike("^[2-9]+$") & F.lit(t9)
    scored = pairs.withColumn("s", mece_score(F.col("q"), use_t9)).where("s > 0")
    scored = scored.withColumn("s", keyboard_factor(F.col("q"), F.col("s"))).where("s > 0").withColumn("near", char_jaccard(F.col("q")))
    hits = scored.select(*of, "q", "s", "near").join(broadcast_if_small(q), "q")
    total = M.half_up((F.col("s") + usage_score()) * (1 + F.col("near") * 0.2))
    scored = named.select("app_id", "uses", "installed", *of).join(broadcast_if_small(hits), of).select("query_id", "app_id", total.alias("score"))
    return scored if k is None else top(scored, k, F.desc("score"), F.asc("app_id"))


# --- the union pipeline ----------------------------------------------------------------------------------------------


def union_fuzzy(queries: DataFrame, apps: DataFrame, weights: DataFrame | None = None, as_of: Column | None = None, half_life: float = 30.0) -> DataFrame:
    """(query_id, app_id, match, score): the best of seven kinds of match, then the learned weight, its decay and usage.

    ``weights``: (q, app_id, weight, last_ts).
    """
    q = clean(queries)
    asked = broadcast_if_small(q)
    x = F.col("q")
    # every distinct set of names meets every distinct query once; the first kind that holds is the one of most points
    named = apps.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in FIELDS})
    pairs = named.select(*FIELDS).distinct().crossJoin(broadcast_if_small(q.select("q").distinct()))
    letters = F.array_distinct(X.chars(F.concat(low("name"), low("py"), low("en"))))
    starts = any_field(lambda f: (f != "") & f.startswith(x))
    kinds = {
        "initial": I.initials_key() == x,
        "t9": (F.length(x) <= 4) & I.keypad().startswith(x),
        "prefix": (F.length(x) <= 4) & starts,
        "adjacent_swap": any_field(lambda f: X.adjacent_swap(x, f)),
        "char": F.arrays_overlap(letters, X.chars(x)),
        "trie": starts,
        "disorder": any_field(lambda f: X.disorder(x, f)),
    }
    match = F.coalesce(*[F.when(kinds[kind], F.lit(kind)) for kind in sorted(kinds, key=lambda kind: -UNION_SCORES[kind])])
    points = F.create_map(*[y for k, v in UNION_SCORES.items() for y in (F.lit(k), F.lit(v))])
    hits = pairs.withColumn("match", match).where("match is not null").withColumn("score", F.element_at(points, F.col("match")).cast("double")).join(asked, "q")
    # the names' estimate is that of compressed files: without a hint they would be broadcast
    rows = named.select("app_id", *FIELDS).join(asked_of(hits), list(FIELDS)).select("query_id", "app_id", "match", "score")
    if weights is not None:
        known = weights.select(F.lower("q").alias("q"), "app_id", "weight", "last_ts").join(asked, "q").drop("q")
        age = M.days_between(F.col("last_ts"), as_of)
        decay = F.when(F.col("last_ts").isNull() | (age <= 0), 1.0).otherwise(F.greatest(F.lit(0.35), F.pow(F.lit(0.5), age / half_life)))
        rows = rows.join(known, ["query_id", "app_id"], "left")
        rows = rows.select("query_id", "app_id", "match", ((F.col("score") + F.coalesce("weight", F.lit(0.0))) * decay).alias("score"))
    with_use = rows.join(apps.select("app_id", "uses", "installed"), "app_id")
    return with_use.select("query_id", "app_id", "match", (F.col("score") + usage_score()).alias("score"))


def union_pipeline(queries: DataFrame, apps: DataFrame, meta: DataFrame, tfidf: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, app_id, source, is_extra, score, rank): fuzzy hits, raised by half the points of each category hit (meta:
    (query_id, app_id) with repeats), then what only TF-IDF (query_id, app_id, score) or the trie finds; by score, then launches."""
    fuzzy = union_fuzzy(queries, apps)
    bonus = meta.groupBy("query_id", "app_id").agg((F.count("*") * UNION_SCORES["meta"] * 0.5).alias("bonus"))
    rows = fuzzy.join(bonus, ["query_id", "app_id"], "left").select("query_id", "app_id", F.lit(0).alias("priority"), (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    if tfidf is not None:
        rows = rows.unionByName(tfidf.select("query_id", "app_id", F.lit(1).alias("priority"), "score"))
    trie = prefix_search(clean(queries), apps).select("query_id", "app_id", F.lit(2).alias("priority"), F.lit(float(UNION_SCORES["trie"])).alias("score"))
    rows = rows.unionByName(trie)
    first = F.row_number().over(Window.partitionBy("query_id", "app_id").orderBy("priority"))
    rows = rows.withColumn("n", first).where("n = 1").join(apps.select("app_id", "uses"), "app_id")
    source = F.element_at(F.array(F.lit("fuzzy"), F.lit("tfidf"), F.lit("trie")), F.col("priority") + 1)
    rows = rows.select("query_id", "app_id", source.alias("source"), (F.col("priority") > 0).alias("is_extra"), "score", "uses")
    return top(rows, k or 1 << 30, F.desc("score"), F.desc("uses"), F.asc("app_id")).drop("uses")


# --- the ladder ------------------------------------------------------------------------------------------------------

#: A name's forms in lower case: name, syllables without spaces, English name, initials, category.
FORM = ("f_name", "f_py", "f_en", "f_abbr", "f_cat")


def formed(apps: DataFrame) -> DataFrame:
    """The catalogue with its names' forms; equal ones are scored once."""
    t = {f: F.coalesce(low(f), F.lit("")) for f in FIELDS}
    flat = F.regexp_replace(t["py"], r"\s+", "")
    return apps.select("*", t["name"].alias("f_name"), flat.alias("f_py"), t["en"].alias("f_en"), t["abbr"].alias("f_abbr"), F.coalesce(low("cat"), F.lit("")).alias("f_cat"))


def asked_forms(queries: DataFrame, apps: DataFrame) -> DataFrame:
    """(q, forms) of each distinct query and each distinct form: the stated queries go past all names, in blocks."""
    # adaptive execution would read few forms in one task, however many queries each of them meets
    blocks = int(apps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formed(apps).select(*FORM).distinct().repartition(blocks).crossJoin(broadcast_if_small(queries.select("q").distinct()))


def to_apps(scored: DataFrame, queries: DataFrame, apps: DataFrame, *more: str) -> DataFrame:
    """(query_id, app_id, score and more) of scored forms (q, forms, score), for every app of that form and every query of that text."""
    asked = broadcast_if_small(queries.select("query_id", "q"))
    by = scored.join(asked, "q").select("query_id", *FORM, "score", *more)
    return formed(apps).select("app_id", *FORM).join(asked_of(by), list(FORM)).select("query_id", "app_id", "score", *more)


def best_of_forms(by: DataFrame, apps: DataFrame, score: Column) -> DataFrame:
    """(query_id, app_id, score): the best ``score`` of an app for each query, an expression of ``uses`` and of the columns of ``by`` (query_id, forms, ...), once for
    each query and form. An app of one form and one number of uses meets a query once; only of others are pairs brought together."""
    each = formed(apps).groupBy("app_id").agg(F.collect_set(F.struct("uses", *FORM)).alias("rows"))
    each = each.select("app_id", F.size("rows").alias("n"), F.explode("rows").alias("row")).select("app_id", "n", "row.*")
    one, many = (each.where(c).join(broadcast_if_small(by), list(FORM)).select("query_id", "app_id", score.alias("score")).where("score is not null") for c in ("n = 1", "n > 1"))
    return one.unionByName(many.groupBy("query_id", "app_id").agg(F.max("score").alias("score")))


def _whole(points: Column) -> Column:
    """Points without their fraction; the rounding takes back what binary fractions lose."""
    return F.floor(F.round(points, 4)).cast("int")


def scramble_score(q: Column, t: Column, guard: int = 4) -> Column:
    """:func:`lodestar.functions.arrow.scramble`."""
    return A.scrambled_udf(guard)(q, t)


def mixed(pairs: DataFrame, guard: int = 4) -> DataFrame:
    """``pairs`` with the best scramble of the name, its syllables, initials and English name as ``mixed``."""
    return pairs.withColumn("mixed", A.scrambled_udf(guard)("q", *FORM[:4]))


def ladder_score(q: Column, category: Column | None = None) -> Column:
    """Points by the forms: exact 1000, prefix 800 + 6n, syllables equal 600 or prefix 500 + 5n, initials equal 400 or prefix
    350 + 4n; else the best of name contains 150 + 5n, or syllables contain 120 + 4n; English name equal 380, or prefix 300 + 4n; under 200 the
    half of the category's points, 30 at least; under 150 the scramble (:func:`mixed`) of two characters and more. 0 for none. n: the query's length."""
    n = F.length(q)
    name, py, en, abbr = (F.col(f) for f in FORM[:4])
    inside = F.when(name.contains(q), 150 + 5 * n).when(py.contains(q), 120 + 4 * n).otherwise(0)
    half = F.lit(0) if category is None else F.when(category > 0, F.greatest(F.lit(30), F.floor(category * 0.5).cast("int"))).otherwise(0)
    english = X.let(inside, lambda i: F.when((i < 380) & (en == q), 380).when((i < 300) & en.startswith(q), 300 + 4 * n).otherwise(i))
    meta = X.let(english, lambda e: F.when(e < 200, F.greatest(e, half)).otherwise(e))
    low_ = X.let(meta, lambda m: F.when((m < 150) & (n >= 2), F.greatest(m, F.col("mixed"))).otherwise(m))
    return (
        F.when(name == q, 1000)
        .when(name.startswith(q), 800 + 6 * n)
        .when(py == q, 600)
        .when(py.startswith(q), 500 + 5 * n)
        .when(abbr == q, 400)
        .when(abbr.startswith(q), 350 + 4 * n)
        .otherwise(low_)
    )


def single_char_score(q: Column) -> Column:
    """Points of a query of one character: initials start 350, name 300, syllables 250; name contains 150, syllables 120; else 0."""
    name, py, _, abbr = (F.col(f) for f in FORM[:4])
    return F.when(abbr.startswith(q), 350).when(name.startswith(q), 300).when(py.startswith(q), 250).when(name.contains(q), 150).when(py.contains(q), 120).otherwise(0)


def ladder_forms(queries: DataFrame, apps: DataFrame, terms: DataFrame | None = None, guard: int = 2) -> DataFrame:
    """(q, forms, score) by the ladder; ``terms`` are those of :func:`match_category`, whose categories are the apps'."""
    pairs = asked_forms(queries, apps)
    if terms is None:
        return mixed(pairs, guard).withColumn("score", ladder_score(F.col("q"))).drop("mixed")
    found = match_category(queries.select(F.col("q").alias("query_id"), "q").distinct(), terms)
    found = found.groupBy(F.col("query_id").alias("q"), F.lower("category").alias("f_cat")).agg(F.max("score").alias("points"))
    return pairs.join(broadcast_if_small(found), ["q", "f_cat"], "left").transform(mixed, guard).withColumn("score", ladder_score(F.col("q"), F.col("points"))).drop("points", "mixed")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", low("q").alias("q")).where("q <> ''")


def ladder_search(queries: DataFrame, apps: DataFrame, terms: DataFrame | None = None, least: int = 25, k: int = 30) -> DataFrame:
    """(query_id, app_id, score, rank): ladder points, raised by launches, from ``least`` points on; one character by its own rule."""
    q = _asked(queries)
    one = asked_forms(q.where(F.length("q") == 1), apps).withColumn("score", single_char_score(F.col("q")))
    more = ladder_forms(q.where(F.length("q") > 1), apps, terms)
    found = to_apps(one.unionByName(more.select(one.columns)).where("score > 0"), q, apps).join(apps.select("app_id", "uses"), "app_id")
    scored = found.select("query_id", "app_id", M.usage_weight(F.col("score"), F.col("uses")).alias("score")).where(F.col("score") >= least)
    return top(scored, k, F.desc("score"), F.asc("app_id"))


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``found``, and of ``fallback`` for the queries without any."""
    return found.unionByName(fallback.join(found.select("query_id").distinct(), "query_id", "left_anti"))


def supplemented(found: DataFrame, more: DataFrame, fewer_than: int) -> DataFrame:
    """Rows of ``found``; queries with fewer than so many also get their rows of ``more`` that it lacks."""
    poor = more.join(found.groupBy("query_id").count().where(F.col("count") >= fewer_than).select("query_id"), "query_id", "left_anti")
    return found.unionByName(poor.join(found.select("query_id", "app_id"), ["query_id", "app_id"], "left_anti"))


def variants(q: Column) -> Column:
    """A query and its near misses: runs undone, each key or two neighbouring ones replaced by touching ones, one letter of three and more left out,
    two letters swapped."""
    n, letters = F.length(q), X.chars(q)
    touch = F.create_map(*[x for k, v in X.NEIGHBOURS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    none = F.array().cast("array<string>")
    beside = lambda i: F.coalesce(F.element_at(touch, F.element_at(letters, i)), none)
    place = F.when(n > 0, F.sequence(F.lit(1), n))
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1))
    head, tail = (lambda i: F.substring(q, F.lit(1), i - 1)), (lambda i: F.substring(q, i + 1, n))
    sub = F.flatten(F.transform(place, lambda i: F.transform(beside(i), lambda y: F.concat(head(i), y, tail(i)))))
    two = F.flatten(F.transform(pairs, lambda i: F.flatten(F.transform(beside(i), lambda y: F.transform(beside(i + 1), lambda z: F.concat(head(i), y, z, tail(i + 1)))))))
    drop = F.when(n > 2, F.transform(place, lambda i: F.concat(head(i), tail(i))))
    swap = F.transform(pairs, lambda i: F.concat(head(i), F.substring(q, i + 1, F.lit(1)), F.substring(q, i, F.lit(1)), F.substring(q, i + 2, n)))
    every = F.concat(F.array(q, F.regexp_replace(q, r"(.)\1+", "$1")), *[F.coalesce(x, none) for x in (sub, two, drop, swap)])
    return F.array_distinct(every)


def char_subset_score(q: Column, t: Column) -> Column:
    """5 and a tenth of the continuity where the target has all characters of the query, else up to 4 by their share; 0 for longer queries."""
    shared = X.multiset_overlap(q, t)
    partial = F.least(F.lit(4), F.floor(shared * 10 / F.length(q)).cast("int"))
    return F.when((F.length(q) == 0) | (F.length(q) > F.length(t)), 0).when(shared == F.length(q), 5 + F.floor(X.continuity(q, t) / 10).cast("int")).otherwise(partial)


def _near(distance: Column, longest: Column, base: int, most: int) -> Column:
    """Points for a distance up to half the longer length and one: ``base`` and up to ``most`` by closeness; 0 beyond."""
    limit = F.floor(longest / 2).cast("int") + 1
    return F.when(distance <= limit, base + _whole((1 - distance / (limit + 1)) * most)).otherwise(0)


def with_distances(pairs: DataFrame, *forms: str) -> DataFrame:
    """``pairs`` with d_name and so on, the keyboard distances of q to the forms: Python reads each distinct pair of texts once."""
    out = pairs
    for f in forms:
        out = out.withColumn(f.replace("f_", "d_"), A.keyboard_distance_udf(F.col("q"), F.col(f)))
    return out


def typing_score(q: Column) -> Column:
    """Points by keyboard distance of the name (100 and up to 120), syllables (90, 100) and initials (80, 90), the name's shared
    characters (100 times) and contained order (90 times), these two from a half on; needs :func:`with_distances`."""
    n = F.length(q)
    near = [_near(F.col(f.replace("f_", "d_")), F.greatest(n, F.length(f)), base, most) for f, base, most in (("f_name", 100, 120), ("f_py", 90, 100), ("f_abbr", 80, 90))]
    share, order = X.overlap_ratio(q, F.col("f_name")), X.contain_ratio(q, F.col("f_name"))
    return F.greatest(*near, F.when(share >= 0.5, _whole(100 * share)).otherwise(0), F.when(order >= 0.5, _whole(90 * order)).otherwise(0))


def combined_score(q: Column) -> Column:
    """Sum of the signals where two of them hold: syllables within half their length (three at least) by edits and with half the characters
    shared, 120 and up to 80; pairs of the syllables from 0.35 on, 80 and 80 times; initials from 0.6, 60 and 60; shared characters of the name from
    0.4, 50 and 50; half the scramble (:func:`mixed`) from 50 on."""
    name, py, _, abbr = (F.col(f) for f in FORM[:4])
    parts = F.struct(
        X.edit_distance(q, py).alias("d"), F.greatest(F.floor(F.length(py) / 2).cast("int"), F.lit(3)).alias("most"), X.overlap_ratio(q, py).alias("near"), X.ngram_jaccard(q, py).alias("pairs"),
        X.jaccard(q, abbr).alias("first"), X.overlap_ratio(q, name).alias("share"), F.col("mixed"),
    )

    def summed(s: Column) -> Column:
        signals = [
            ((s["d"] <= s["most"]) & (s["d"] > 0) & (s["near"] >= 0.5), 120 + (1 - s["d"] / s["most"]) * 80),
            (s["pairs"] >= 0.35, 80 + s["pairs"] * 80),
            ((F.length(q) >= 2) & (F.length(abbr) >= 2) & (s["first"] >= 0.6), 60 + s["first"] * 60),
            (s["share"] >= 0.4, 50 + s["share"] * 50),
            (s["mixed"] >= 50, s["mixed"] * 0.5),
        ]
        count = sum((F.when(c, 1).otherwise(0) for c, _ in signals[1:]), F.when(signals[0][0], 1).otherwise(0))
        total = sum((F.when(c, p).otherwise(0.0) for c, p in signals[1:]), F.when(signals[0][0], signals[0][1]).otherwise(0.0))
        return F.when((F.length(q) > 0) & (count >= 2), _whole(total)).otherwise(0)

    return X.let(parts, summed)


def language_score(q: Column, package: Column) -> Column:
    """Best of the scorers that fit the query's script: keypad digits, CJK characters or Latin letters, all of them for mixed ones."""
    n = F.length(q)
    name, py, en, abbr = (F.col(f) for f in FORM[:4])

    def hit(c, points):
        return F.when(c, points).otherwise(0)

    def near(f, base, most):
        return _near(F.col(f.replace("f_", "d_")), F.greatest(n, F.length(f)), base, most)

    def named(c):
        return F.when(en != "", c).otherwise(0)

    english = F.greatest(named(near("f_en", 200, 150)), named(hit(en.startswith(q), 350 + 4 * n)), named(hit(en.contains(q), 180 + 3 * n)), typing_score(q), hit(package.contains(q), 100 + 2 * n))
    chinese = F.greatest(
        hit(name.contains(q), 220 + 4 * n),
        hit(name.startswith(q), 380 + 5 * n),
        near("f_name", 200, 120),
        hit(py.startswith(q), 280 + 4 * n),
        hit(py.contains(q), 180 + 3 * n),
        hit(abbr.startswith(q), 220 + 4 * n),
        hit(abbr == q, F.lit(320)),
        combined_score(q),
        F.col("mixed"),
    )
    digits = F.col("f_t9")
    keypad = F.greatest(hit(digits.contains(q), 280 + 4 * n), hit(digits.startswith(q), 380 + 5 * n), near("f_t9", 200, 120), named(near("f_en", 150, 100)))
    kind = X.input_language(q)
    return F.when(kind == "NUMERIC_T9", keypad).when(kind == "CHINESE", chinese).when(kind == "ENGLISH", english).otherwise(F.greatest(english, chinese, keypad))


def language_search(queries: DataFrame, apps: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, app_id, score, rank) by :func:`language_score`, from 20 points on; packages are the ids."""
    q = _asked(queries)
    pairs = with_distances(mixed(asked_forms(q, apps)).withColumn("f_t9", X.t9(F.col("f_name"))), "f_name", "f_py", "f_en", "f_abbr", "f_t9")
    scored = pairs.withColumn("score", language_score(F.col("q"), F.lit("")))
    found = to_apps(scored.where("score > 0"), q, apps)
    # an id that contains the query has points of its own, for all but keypad and CJK queries
    package = F.lower(F.col("app_id").cast("string"))
    latin = q.where(X.input_language(F.col("q")).isin("ENGLISH", "MIXED"))
    by_id = apps.select("app_id").join(broadcast_if_small(latin), package.contains(F.col("q"))).select("query_id", "app_id", (100 + 2 * F.length("q")).alias("score"))
    rows = found.unionByName(by_id).groupBy("query_id", "app_id").agg(F.max("score").alias("score")).where("score >= 20")
    return top(rows, k, F.desc("score"), F.asc("app_id"))


def tolerant_search(queries: DataFrame, apps: DataFrame, terms: DataFrame | None = None, meta: DataFrame | None = None, k: int = 30) -> DataFrame:
    """(query_id, app_id, score, rank): the ladder over the query's near misses from 20 points, typing from 20 and scrambles from 30, the
    best of them per app; queries with under three hits also get those of ``meta`` (query_id, app_id, score)."""
    q = _asked(queries)
    near = q.select("query_id", F.explode(variants(F.col("q"))).alias("q"))
    ladder = ladder_forms(near, apps, terms, guard=4).where("score > 0")
    # of a query's near misses, each form keeps the best: launches raise all of its apps alike
    misses = ladder.join(broadcast_if_small(near), "q").select("query_id", *FORM, F.col("score").alias("miss"), F.lit(None).cast("long").alias("score"))
    pairs = with_distances(mixed(asked_forms(q, apps)), "f_name", "f_py", "f_abbr")
    typed, any_order = X.let(typing_score(F.col("q")), lambda p: F.when(p >= 20, p).otherwise(0)), F.when(F.col("mixed") >= 30, F.col("mixed")).otherwise(0)
    score = F.greatest(typed, any_order)
    rest = pairs.withColumn("score", score).where("score > 0").join(broadcast_if_small(q), "q").select("query_id", *FORM, F.lit(None).cast("int").alias("miss"), F.col("score").cast("long").alias("score"))
    by = misses.unionByName(rest).groupBy("query_id", *FORM).agg(F.max("miss").alias("miss"), F.max("score").alias("score"))
    raised = M.usage_weight(F.col("miss"), F.col("uses")).cast("long")
    rows = best_of_forms(by, apps, F.greatest(F.when(raised >= 20, raised), F.col("score")))
    if meta is not None:
        rows = supplemented(rows, meta.select("query_id", "app_id", F.col("score").cast("long").alias("score")), 3)
    return top(rows, k, F.desc("score"), F.asc("app_id"))


def append_search(queries: DataFrame, apps: DataFrame, terms: DataFrame | None = None, per_part: int = 5, k: int = 30) -> DataFrame:
    """(query_id, app_id, part, score, rank): a query of several names run together.

    From the left, the run of up to ten characters that scores most for any app, 200 at least, is a part, a longer one before a shorter; where none
    does, one character is. Each part's best apps (``per_part``, from 25 points) count, the last part's with 500 points more and
    first, every app once. A query of one part is an ordinary search, its part null.
    """
    q = _asked(queries)
    starts = F.sequence(F.lit(1), F.length("q"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.length("q") - i + 1)), lambda n: F.substring(F.col("q"), i, n))))
    asked = q.select("query_id", F.explode(F.array_distinct(runs)).alias("run"))
    scored = ladder_forms(asked.select(F.col("run").alias("q")).distinct(), apps, terms).where("score > 0")
    most = formed(apps).groupBy(*FORM).agg(F.max("uses").alias("uses"))
    best_ = scored.join(broadcast_if_small(most), list(FORM)).groupBy(F.col("q").alias("run")).agg(F.max(M.usage_weight(F.col("score"), F.col("uses"))).alias("points")).where("points >= 200")
    known = asked.join(broadcast_if_small(best_), "run").groupBy("query_id").agg(F.collect_list(F.struct("run", "points")).alias("known"))
    parted = q.join(known, "query_id", "left").select("query_id", "q", A.segment_udf("q", "known.run", "known.points").alias("parts"))
    many = parted.where(F.size("parts") > 1).select("query_id", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "q"))
    parts = many.select(F.struct("query_id", "part", (F.col("part") == F.col("n") - 1).alias("last")).alias("query_id"), "q")
    found = to_apps(ladder_forms(parts, apps, terms).where("score > 0"), parts, apps).join(apps.select("app_id", "uses"), "app_id")
    found = found.select("query_id", "app_id", M.usage_weight(F.col("score"), F.col("uses")).cast("long").alias("score")).where("score >= 25")
    each = top(found, per_part, F.desc("score"), F.asc("app_id")).select("query_id.*", "app_id", (F.col("score") + F.when(F.col("query_id.last"), 500).otherwise(0)).alias("score"))
    once = F.row_number().over(Window.partitionBy("query_id", "app_id").orderBy(F.desc("last"), F.desc("score"), "part"))
    kept = top(each.withColumn("m", once).where("m = 1"), k, F.desc("last"), F.desc("score"), F.asc("app_id")).select("query_id", "app_id", "part", "score", "rank")
    plain = ladder_search(parted.where(F.size("parts") <= 1).select("query_id", "q"), apps, terms, k=k)
    return kept.unionByName(plain.select("query_id", "app_id", F.lit(None).cast("int").alias("part"), F.col("score").cast("long").alias("score"), "rank"))


# --- categories ------------------------------------------------------------------------------------------------------


def match_category(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, category, score): the best of the ways that a term (term, category, kind) meets the query.

    A "keyword" equal 100, prefix 90, contained 70; a "root" word of the small dictionary equal 94, a prefix of the query or the query its prefix 82,
    either in the other 66; a category's "label" equal 95, contained 75, its "initials" equal 85, prefix 80.
    """
    q = queries.select("query_id", low("q").alias("q")).where("q <> ''")
    # the terms are the categories' vocabulary, the queries the larger side
    t, x, kind = F.col("term"), F.col("q"), F.col("kind")
    pairs = q.join(broadcast_if_small(terms.where("term <> ''")), t.contains(x) | ((kind == "root") & x.contains(t)))
    points = (
        F.when(kind == "keyword", F.when(t == x, 100).when(t.startswith(x), 90).otherwise(70))
        .when(kind == "root", F.when(t == x, 94).when(t.startswith(x) | x.startswith(t), 82).otherwise(66))
        .when(kind == "label", F.when(t == x, 95).otherwise(75))
        .when(kind == "initials", F.when(t == x, 85).when(t.startswith(x), 80))
    )
    return pairs.withColumn("points", points).where("points is not null").groupBy("query_id", "category").agg(F.max("points").alias("score"))


#: Points that an intent of the query gives a category.
INTENT_POINTS = [
    ("CONTACT", "communication", 88), ("SEND", "communication", 66), ("SEND", "office", 66), ("CONSUME", "video", 58), ("CONSUME", "music", 58), ("CONSUME", "reading", 58), ("TRAVEL", "maps", 88), ("BUY", "shopping", 74), ("BUY", "finance", 74),
    ("WORK", "office", 70), ("SEARCH", "browser", 75), ("HEALTH", "health", 80), ("HEALTH", "system", 80), ("LEARN", "education", 72), ("LEARN", "reading", 72), ("OPEN", "system", 50), ("INSTALL", "system", 60),
]


def meta_points(queries: DataFrame, terms: DataFrame, actions: DataFrame | None = None, intents: DataFrame | None = None, expansions: DataFrame | None = None, intent_points: list[tuple[str, str, int]] = INTENT_POINTS) -> DataFrame:
    """(query_id, category, points) by the categories' terms (term, category, kind): equal 120, one in the other 56, else 24 if the query has
    0.6 of the term's characters, two at least. A category's keyword among the query's actions (query_id, action) counts 70, its intents
    (query_id, intent) as the table says, and terms equal to an expansion (query_id, synonym, score) 80 times its score, or in it or around it 38 times."""
    q = _asked(queries)
    own = terms.select(F.lower("term").alias("term"), "category").where("term <> ''").distinct()
    own = broadcast_if_small(own)
    t, x = F.col("term"), F.col("q")
    # the stated queries go past the categories' vocabulary
    hit = F.size(F.filter(X.chars(t), lambda c: x.contains(c))) >= F.ceil(F.greatest(F.lit(2.0), F.round(0.6 * F.length(t), 4)))
    points = F.when(t == x, 120).when(t.contains(x) | x.contains(t), 56).when(hit, 24)
    rows = q.crossJoin(own).select("query_id", "category", points.alias("points"))
    if actions is not None:
        keys = terms.where("kind = 'keyword'").select(F.lower("term").alias("action"), "category").distinct()
        rows = rows.unionByName(actions.select("query_id", F.lower("action").alias("action")).join(broadcast_if_small(keys), "action").select("query_id", "category", F.lit(70).alias("points")))
    if intents is not None:
        table = queries.sparkSession.createDataFrame(intent_points, "intent string, category string, points int")
        rows = rows.unionByName(intents.join(F.broadcast(table), "intent").select("query_id", "category", "points"))
    if expansions is not None:
        e, score = F.lower("synonym"), F.col("score")
        near = F.when(e == t, F.floor(80 * score + 0.5)).when(e.contains(t) | t.contains(e), F.floor(38 * score + 0.5)).cast("int")
        rows = rows.unionByName(expansions.where("synonym <> ''").crossJoin(own).select("query_id", "category", near.alias("points")))
    return rows.where("points is not null").groupBy("query_id", "category").agg(F.sum("points").cast("int").alias("points"))


def meta_search(queries: DataFrame, apps: DataFrame, terms: DataFrame, k: int = 20, **more) -> DataFrame:
    """(query_id, app_id, category, score, rank): the points of an app's category (:func:`meta_points`), 2 less for each of its apps before, 20 at least,
    and usage."""
    scored = meta_points(queries, terms, **more)
    member = apps.select("app_id", "cat", "uses", "installed").withColumn("nth", F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("uses"), "app_id")) - 1)
    # of a category no more than k apps can be among the best k
    joined = member.where(F.col("nth") < k).join(broadcast_if_small(scored), F.col("cat") == F.col("category"))
    total = F.greatest(F.lit(20), F.col("points") - 2 * F.col("nth")) + usage_score()
    return top(joined.select("query_id", "app_id", "category", total.alias("score")), k, F.desc("score"), F.asc("app_id"))


def meta_chars(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, app_id) once for each character of the query that is a keyword (key, app_id) of the app: repeats count."""
    each = clean(queries).select("query_id", F.explode(X.chars(F.col("q"))).alias("key"))
    return keywords.join(broadcast_if_small(each), "key").select("query_id", "app_id")


def tag_search(queries: DataFrame, tags: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, label, score, rank): clusters (label, term, kind, priority) by strength of the match.

    A "word" equal 100, prefix 80, contained 65; the cluster's "label" equal 95, contained 90; its "initials" equal 70, prefix 60, for queries
    of two to eight letters. What is contained must have two characters. score = 100 + floor(0.6 strength) + floor(0.4 priority), ties by label.
    """
    q = queries.select("query_id", low("q").alias("q")).where("q <> ''")
    t, x, kind, two = F.col("term"), F.col("q"), F.col("kind"), F.length("q") >= 2
    letters = F.length(x).between(2, 8) & x.rlike(r"^\p{L}+$")
    strength = (
        F.when(kind == "word", F.when(t == x, 100).when(t.startswith(x), 80).when(t.contains(x) & two, 65))
        .when(kind == "label", F.when(t == x, 95).when(t.contains(x) & two, 90))
        .when((kind == "initials") & letters, F.when(t == x, 70).when(t.startswith(x), 60))
    )
    hits = q.join(broadcast_if_small(tags.where("term <> ''")), t.contains(x)).withColumn("strength", strength).where("strength is not null")
    score = 100 + F.floor(0.6 * F.col("strength")) + F.floor(0.4 * F.col("priority"))
    return top(hits.groupBy("query_id", "label").agg(F.max(score).alias("score")), k, F.desc("score"), F.asc("label"))


def apps_by_category(apps: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, app_id) of the asked categories (category)."""
    asked = categories.select(F.lower("category").alias("category")).distinct()
    return apps.select(F.lower("cat").alias("category"), "app_id").join(broadcast_if_small(asked), "category", "left_semi")


def is_category(queries: DataFrame, apps: DataFrame) -> DataFrame:
    """(query_id, is_category): whether the query names a category."""
    known = apps.select(low("cat").alias("c")).distinct()
    q = queries.select("query_id", low("q").alias("q"))
    return q.join(broadcast_if_small(known), q["q"] == known["c"], "left").select("query_id", F.col("c").isNotNull().alias("is_category"))


# --- suggestions -----------------------------------------------------------------------------------------------------


def unknown_suggestions(pending: DataFrame, clicks: DataFrame, k: int = 5) -> DataFrame:
    """(query, app, n, rank): the apps that users clicked along with an unknown query. pending: (query, user); clicks: (user, app)."""
    together = pending.select("query", "user").distinct().join(clicks, "user").groupBy("query", "app").agg(F.count("*").alias("n"))
    return top(together, k, F.desc("n"), F.asc("app"), group="query")


def route(edges: DataFrame, rules: DataFrame, unknowns: DataFrame, share: float = 0.8, k: int = 6) -> DataFrame:
    """(from_key, to_key, source, rank): context rules first, then edges with ``share`` of the weight, then unknown apps; each target once."""
    part = F.col("weight") / F.sum("weight").over(Window.partitionBy("from_key"))
    strong = edges.withColumn("share", part).where(F.col("share") >= share)
    kinds = (
        rules.select("from_key", "to_key", F.lit(0).alias("source"), F.lit(1.0).alias("w")),
        strong.select("from_key", "to_key", F.lit(1).alias("source"), F.col("share").alias("w")),
        unknowns.select("from_key", "to_key", F.lit(2).alias("source"), F.lit(0.0).alias("w")),
    )
    rows = reduce(DataFrame.unionByName, kinds)
    once = F.row_number().over(Window.partitionBy("from_key", "to_key").orderBy("source", F.desc("w")))
    rows = rows.withColumn("n", once).where("n = 1").drop("n")
    return top(rows, k, F.asc("source"), F.desc("w"), F.asc("to_key"), group="from_key").drop("w")


def merged(*sources: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, app_id, score, source, rank): each app from the first source that has it, in the sources' order."""
    rows = reduce(DataFrame.unionByName, (s.select("query_id", "app_id", "score", F.lit(i).alias("source")) for i, s in enumerate(sources)))
    once = F.row_number().over(Window.partitionBy("query_id", "app_id").orderBy("source", F.desc("score")))
    rows = rows.withColumn("n", once).where("n = 1").drop("n")
    return top(rows, k, F.asc("source"), F.desc("score"), F.asc("app_id"))


def without_blocked(hits: DataFrame, flags: DataFrame, as_of: Column) -> DataFrame:
    """Hits (query, app) without a block flag (query, app, expire_ts) that still holds; expire_ts null never expires."""
    live = flags.where(F.col("expire_ts").isNull() | (F.col("expire_ts") > as_of)).select("query", "app").distinct()
    return hits.join(live, ["query", "app"], "left_anti")

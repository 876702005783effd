"""Index construction: every index is a table of (key, app_id), so a lookup is an equi-join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.hints import asked_of, broadcast_if_small


Of = Callable[[str], Column]  #: a field of a row, by its name
NAMES = ("name", "py", "en", "abbr")


def by_app(apps: DataFrame) -> DataFrame:
    """(app_id, rows): each app once, with the distinct names of its rows. What is exploded of an app is distinct within it then, so keys neither
    have to be shuffled nor held to find repeated ones; indexes that are made of the same apps share this exchange."""
    names = F.struct(*[X.text(F.col(f)).alias(f) for f in NAMES])
    return apps.groupBy("app_id").agg(F.collect_set(names).alias("rows"))


def exploded(apps: DataFrame, kind: str, keys: Callable[[Of], Column]) -> DataFrame:
    """(kind, key, app_id), distinct and without empty keys; ``keys``: the keys of one row."""
    all_ = F.array_distinct(F.flatten(F.transform("rows", lambda r: keys(lambda f: r[f]))))
    rows = by_app(apps).select(F.lit(kind).alias("kind"), F.explode(all_).alias("key"), "app_id")
    return rows.where("key <> ''")


def _fields(*names: str, of: Of = F.col) -> Column:
    return F.array(*[X.lowered(of(n)) for n in names])


def _all_prefixes(fields: Column, least: int, most: int) -> Column:
    return F.flatten(F.transform(fields, lambda f: X.prefixes(f, least, most)))


def initials_key(of: Of = F.col) -> Column:
    """The abbreviation, else the first letters of the syllables, else the syllables."""
    py = X.lowered(of("py"))
    return F.when(X.lowered(of("abbr")) != "", X.lowered(of("abbr"))).when(py.contains(" "), X.initials(py)).otherwise(py)


def initials_index(apps: DataFrame) -> DataFrame:
    """Prefixes of one to four initials."""
    return exploded(apps, "initials", lambda of: X.prefixes(initials_key(of), 1, 4))


def syllable_index(apps: DataFrame) -> DataFrame:
    """Prefixes of one to six letters of the full syllables."""
    return exploded(apps, "syllables", lambda of: X.prefixes(X.lowered(of("py")), 1, 6))


def keypad(of: Of = F.col) -> Column:
    return X.t9(F.concat(X.text(of("name")), X.text(of("py")), X.text(of("en"))))


def keypad_index(apps: DataFrame) -> DataFrame:
    """Prefixes of one to four digits of name, syllables and English name."""
    return exploded(apps, "t9", lambda of: X.prefixes(keypad(of), 1, 4))


def prefix_index(apps: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """Short prefixes of every name."""
    return exploded(apps, "prefix", lambda of: _all_prefixes(_fields(*NAMES, of=of), least, most))


def char_index(apps: DataFrame) -> DataFrame:
    """Distinct characters of name, syllables and English name."""
    return exploded(apps, "char", lambda of: X.chars(F.concat(*[X.lowered(of(f)) for f in ("name", "py", "en")])))


def trie(apps: DataFrame) -> DataFrame:
    """(prefix, app_id, is_terminal): a trie as a table; an exact lookup asks for terminal rows, a prefix lookup for all."""
    words = by_app(apps).select("app_id", F.array_distinct(F.flatten(F.transform("rows", lambda r: _fields(*NAMES, of=lambda f: r[f])))).alias("words"))
    rows = words.select("app_id", "words", F.explode(F.array_distinct(_all_prefixes(F.col("words"), 1, 1 << 20))).alias("prefix"))
    return rows.select("prefix", "app_id", F.array_contains("words", F.col("prefix")).alias("is_terminal"))


def trie_insert(index: DataFrame, apps: DataFrame) -> DataFrame:
    both = index.unionByName(trie(apps))
    return both.groupBy("prefix", "app_id").agg(F.max("is_terminal").alias("is_terminal"))


def trie_remove(index: DataFrame, app_ids: DataFrame) -> DataFrame:
    return index.join(app_ids.select("app_id").distinct(), "app_id", "left_anti")


def trie_search(index: DataFrame, queries: DataFrame, exact: bool = False) -> DataFrame:
    """(query_id, app_id) of the entries that equal the query, or start with it."""
    asked = queries.select("query_id", X.lowered(F.col("q")).alias("prefix")).where("prefix <> ''")
    hits = index.join(asked_of(asked), "prefix")
    return hits.where("is_terminal" if exact else "true").select("query_id", "app_id").distinct()


def tree(apps: DataFrame, shortcuts: DataFrame | None = None) -> DataFrame:
    """(tree, word, app_id): shortcuts (key, app_id), English words, syllables and CJK names."""
    english = exploded(apps, "english", lambda of: F.split(X.lowered(of("en")), r"\s+"))
    syllables = exploded(apps, "syllables", lambda of: F.array(F.regexp_replace(X.lowered(of("py")), " ", "")))
    hanzi = exploded(apps.where(F.col("name").rlike(f"[{X.CJK}]")), "hanzi", lambda of: F.array(X.normalize(of("name"))))
    rows = english.unionByName(syllables).unionByName(hanzi)
    if shortcuts is not None:
        rows = rows.unionByName(shortcuts.select(F.lit("shortcut").alias("kind"), X.lowered(F.col("key")).alias("key"), "app_id"))
    return rows.select(F.col("kind").alias("tree"), F.col("key").alias("word"), "app_id")


def tree_search(words: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, stage, app_id, priority): the first stage of the cascade that finds anything for a query.

    Shortcut, English prefix, syllable prefix, CJK prefix, then English and syllable subsequence.
    """
    q = queries.select("query_id", X.lowered(F.col("q")).alias("q")).where("q <> ''")
    # each distinct word meets the queries once. A prefix or subsequence of a word starts with some character of it: an equi-join on the query's first
    letters = words.select("tree", "word").distinct().withColumn("letter", F.explode(F.array_distinct(X.chars(F.col("word")))))
    both = letters.join(asked_of(q.withColumn("letter", F.substring("q", 1, 1))), "letter").drop("letter")
    starts, inside = F.col("word").startswith(F.col("q")), X.is_subsequence(F.col("q"), F.col("word"))
    stage = (
        F.when((F.col("tree") == "shortcut") & (F.col("word") == F.col("q")), 0)
        .when((F.col("tree") == "english") & starts, 1)
        .when((F.col("tree") == "syllables") & starts, 2)
        .when((F.col("tree") == "hanzi") & starts, 3)
        .when((F.col("tree") == "english") & inside, 4)
        .when((F.col("tree") == "syllables") & inside, 5)
    )
    hits = both.select("query_id", "tree", "word", stage.alias("stage")).where("stage is not null")
    first = F.min("stage").over(Window.partitionBy("query_id"))
    hits = hits.withColumn("first", first).where("stage = first").drop("first")
    # merged: the words' estimate is that of compressed files, and they aren't to be broadcast
    hits = words.join(hits.hint("merge"), ["tree", "word"]).groupBy("query_id", "stage", "app_id").count()
    return hits.select("query_id", "stage", "app_id", F.when(F.col("stage") == 0, 1000).otherwise(0).alias("priority"))


def meta_index(apps: DataFrame, categories: DataFrame) -> DataFrame:
    """(term, category): the terms, lower case, that stand for a category: its label, keywords, and its apps' names.

    ``categories``: (category, label, keywords array).
    """
    own = categories.select("category", F.explode(F.concat(F.array("label"), "keywords")).alias("term"))
    names = apps.select(F.col("cat").alias("category"), F.col("name").alias("term"))
    return own.unionByName(names).select(X.lowered(F.col("term")).alias("term"), "category").where("term <> ''").distinct()


def classify(apps: DataFrame, rules: DataFrame) -> DataFrame:
    """(app_id, category) by rules (category, kind, pattern): an equal label, a contained package hint, or a contained keyword
    of two letters and more."""
    a = apps.select("app_id", X.lowered(F.col("name")).alias("label"), F.lower(F.col("app_id").cast("string")).alias("package"))
    r = rules.select("category", "kind", F.lower("pattern").alias("pattern"))
    equal = a.join(r.where("kind = 'label'"), F.col("label") == F.col("pattern"))
    hint = a.join(broadcast_if_small(r.where("kind = 'package'")), F.col("package").contains(F.col("pattern")))
    word = a.join(broadcast_if_small(r.where("kind = 'keyword' and length(pattern) >= 2")), F.col("label").contains(F.col("pattern")))
    return equal.select("app_id", "category").union(hint.select("app_id", "category")).union(word.select("app_id", "category")).distinct()


def category_index(apps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(category, app_ids, n): clusters (name, canonical) give the category's canonical name."""
    joined = apps.join(clusters, F.lower(apps["cat"]) == F.lower(clusters["name"]), "left")
    named = joined.select(F.coalesce("canonical", "cat").alias("category"), apps["app_id"])
    return named.groupBy("category").agg(F.sort_array(F.collect_set("app_id")).alias("app_ids"), F.count_distinct("app_id").alias("n"))


def term_counts(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, term, tf, len): one shuffle on (id, term), counted before it as far as possible."""
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    return rows.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def tfidf_index(docs: DataFrame, tokens: Column, id_col: str = "doc_id", top_terms: int | None = 100) -> DataFrame:
    """(term, id, weight), weight = tf / len * (ln((n + 1) / (df + 1)) + 1), of the ``top_terms`` terms in most documents.

    With ``top_terms``, only these are counted by document; of the others, how many documents have them.
    """
    n = docs.agg(F.count("*").alias("n"))
    df = term_counts(docs, tokens, id_col).groupBy("term").agg(F.count("*").alias("df")) if top_terms is None else document_frequencies(docs, tokens, id_col)
    if top_terms is not None:
        df = df.orderBy(F.desc("df"), "term").limit(top_terms)
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if top_terms is None:
        counts = term_counts(docs, tokens, id_col).join(idf, "term")
        return counts.select("term", "id", (F.col("tf") / F.col("len") * F.col("idf")).alias("weight"))
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    # no more than top_terms rows; what they leave out isn't counted or moved
    counts = rows.join(F.broadcast(idf), "term").groupBy("id", "len", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    return counts.select("term", "id", (F.col("tf") / F.col("len") * F.col("idf")).alias("weight"))


def document_frequencies(docs: DataFrame, tokens: Column, id_col: str, most: int = 1 << 20) -> DataFrame:
    """(term, df): how many documents (id, len) of :func:`term_counts` have a term.

    A row whose id no other row has is a document by itself, and its terms are counted where it lies. The others' are brought together by
    document first; of more than ``most`` ids that occur again, all rows are.
    """
    same = docs.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_again")
    again = same.limit(most + 1).count()
    terms = []
    if again <= most:
        met = F.col(id_col).eqNullSafe(F.col("_again"))
        once = docs.join(F.broadcast(same), met, "left_anti") if again else docs
        terms.append(once.select(F.explode(F.array_distinct(tokens)).alias("term")))
        docs = docs.join(F.broadcast(same), met, "left_semi")
    if again:
        terms.append(term_counts(docs, tokens, id_col).select("term"))
    return reduce(DataFrame.union, terms).groupBy("term").agg(F.count("*").alias("df"))


def fingerprint(apps: DataFrame) -> DataFrame:
    """One row (rows, fingerprint) that changes with any name; it doesn't depend on the order."""
    h = F.xxhash64("app_id", "name", "abbr", "en")
    return apps.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("fingerprint"))


def changed(apps: DataFrame, known: str | int | None) -> bool:
    """Whether an index built for the fingerprint ``known`` is out of date."""
    return fingerprint(apps).head()["fingerprint"] != known

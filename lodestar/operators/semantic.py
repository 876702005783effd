"""Synonyms and gram vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.hints import broadcast_if_small


def first_by(df: DataFrame, group: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def expand(terms: DataFrame, synonyms: DataFrame, k: int = 10) -> DataFrame:
    """(term, synonym, score, source, rank) by synonyms (term, synonym): direct ones 0.9, the keys that have the term as a synonym 0.85, the keys of
    which one contains the other 0.6; each synonym once, by its first source."""
    t, s = terms.select("term").distinct(), synonyms.select(F.col("term").alias("a"), F.col("synonym").alias("b"))
    direct = t.join(s, F.col("term") == F.col("a")).select("term", F.col("b").alias("synonym"), F.lit(0.9).alias("score"), F.lit(0).alias("source"))
    reverse = t.join(s, F.col("term") == F.lower("b")).where("term <> a").select("term", F.col("a").alias("synonym"), F.lit(0.85).alias("score"), F.lit(1).alias("source"))
    keys = s.select("a").distinct()
    near = broadcast_if_small(t).join(keys, (F.col("term") != F.col("a")) & (F.col("a").contains(F.col("term")) | F.col("term").contains(F.col("a"))))
    contains = near.select("term", F.col("a").alias("synonym"), F.lit(0.6).alias("score"), F.lit(2).alias("source"))
    one = first_by(direct.unionByName(reverse).unionByName(contains), ["term", "synonym"], "source")
    rank = F.row_number().over(Window.partitionBy("term").orderBy("source", F.desc("score"), "synonym"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def expand_sharded(terms: DataFrame, shards: DataFrame, local: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`expand`, with shards (initial, term, synonym, raw) looked up by the term's first letter: direct 0.95, raw 0.92; they win
    over the local table."""
    keyed = terms.select("term", F.upper(F.substring("term", 1, 1)).alias("initial")).distinct()
    score = F.when(F.col("raw"), 0.92).otherwise(0.95)
    far = keyed.join(shards, ["initial", "term"]).select("term", "synonym", score.alias("score"), F.lit(-1).alias("source"))
    near = expand(terms, local, 1 << 20).drop("rank")
    one = first_by(far.unionByName(near).where("term <> synonym"), ["term", "synonym"], "source", F.desc("score"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy("source", F.desc("score"), "synonym"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def gram_vectors(terms: DataFrame) -> DataFrame:
    """(term, gram, w): tf / len * (ln((N + 1) / (df + 1)) + 1) over boundary grams, unit length."""
    grams = terms.select("term", X.boundary_grams(F.col("term")).alias("g")).where(F.size("g") > 0)
    tf = grams.select("term", F.size("g").alias("len"), F.explode("g").alias("gram")).groupBy("term", "len", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    n = grams.agg(F.count("*").alias("n"))
    w = F.col("tf") / F.col("len") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    rows = tf.join(df, "gram").crossJoin(F.broadcast(n)).select("term", "gram", w.alias("w"))
    return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("term"))))


def similar(vectors: DataFrame, asked: DataFrame, least: float = 0.2, k: int = 10) -> DataFrame:
    """(term, other, score, rank): cosines from ``least`` up with the terms that share a gram."""
    a = vectors.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi").select("term", "gram", F.col("w").alias("wa"))
    b = vectors.select(F.col("term").alias("other"), "gram", F.col("w").alias("wb"))
    score = a.join(b, "gram").where("term <> other").groupBy("term", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("score", 9)), "other"))
    return score.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)

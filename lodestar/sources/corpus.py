"""Synonym files, seed catalogues, vector stores, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_synonyms(lines: DataFrame) -> DataFrame:
    """(code, words) of lines ``CODE= word word ...`` (column value); "=" and "#" groups are alike, comments and blanks are skipped."""
    parts = F.split(F.trim("value"), r"[=#@]\s*", 2)
    rows = lines.where(F.trim("value").rlike(r"^\w+[=#@]")).select(F.trim(F.get(parts, 0)).alias("code"), F.filter(F.split(F.trim(F.get(parts, 1)), r"\s+"), lambda w: w != "").alias("words"))
    return rows.where(F.size("words") > 0)


def synonym_pairs(groups: DataFrame) -> DataFrame:
    """(initial, term, synonym, raw): each ordered pair of a group, with the term's first letter as the shard."""
    each = groups.select("code", "words", F.explode("words").alias("term"))
    pairs = each.select("term", F.explode("words").alias("synonym")).where("term <> synonym").distinct()
    return pairs.select(F.upper(F.substring("term", 1, 1)).alias("initial"), "term", "synonym", F.lit(False).alias("raw"))


def import_synonyms(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Parse the text file and write the pairs partitioned by initial, so a lookup reads one shard."""
    synonym_pairs(parse_synonyms(spark.read.text(path))).write.mode("overwrite").partitionBy("initial").parquet(out)
    return spark.read.parquet(out)


def expand_seeds(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """Full records of compact seeds (name, cats, words) whose name isn't in the catalogue (name): id, primary category, document text."""
    new = seeds.join(existing.select(F.lower("name").alias("_n")).distinct(), F.lower(seeds["name"]) == F.col("_n"), "left_anti")
    doc = F.array_join(F.filter(F.concat(F.array("name"), F.coalesce("cats", F.array().cast("array<string>")), F.coalesce("words", F.array().cast("array<string>"))), lambda x: x != ""), " ")
    return new.select(F.substring(F.sha2(F.lower("name"), 256), 1, 16).alias("id"), "name", F.element_at("cats", F.when(F.size("cats") > 0, 1)).alias("cat"), "cats", doc.alias("document"))


def vector_store(entries: DataFrame, version: str, model: str, dims: int, updated_at: str) -> DataFrame:
    """(value): one JSON object an entry (id, package, document, vector, tags), each with the store's header, to be written as lines."""
    head = F.struct(F.lit(version).alias("version"), F.lit(model).alias("model"), F.lit(dims).alias("dimension"), F.lit(updated_at).alias("updatedAt"))
    return entries.select(F.to_json(F.struct(head.alias("store"), *entries.columns)).alias("value"))


def slim_vectors(vectors: DataFrame, memories: Column | None = None) -> DataFrame:
    """(value): {v, dim, vec, mem, cat} of users' vectors (user, vector)."""
    return vectors.select(F.to_json(F.struct(F.lit(1).alias("v"), F.size("vector").alias("dim"), F.col("vector").alias("vec"), (memories if memories is not None else F.lit(0)).alias("mem"), F.lit(0).alias("cat"))).alias("value"))


def lists_to_json(c: Column) -> Column:
    return F.to_json(c)


def json_to_list(c: Column) -> Column:
    """Array of strings; broken JSON is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_to_counts(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))

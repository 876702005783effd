"""The roles that tables play: catalogue, launches, events, documents, vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(value) -> Column:
    """A time as a literal that no time zone shifts."""
    return F.lit(None if value is None else str(value)).cast("timestamp_ntz")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, name, py, en, abbr, cat, tags, weight) of each part; one scan of the columns needed."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("name"),
        F.lit("").alias("py"),
        F.col("p_name").alias("en"),
        X.initials(F.col("p_name")).alias("abbr"),
        F.lower("p_type").alias("cat"),
        F.array(F.lower("p_brand")).alias("tags"),
        F.col("p_retailprice").alias("weight"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, uses, last_used) from the line items."""
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(F.col("l_partkey").alias("app_id")).agg(F.count("*").alias("uses"), F.max("l_shipdate").alias("last_used"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`apps` with uses, last_used and installed; an app without launches has none."""
    joined = apps(spark, sf_dir).join(launches(spark, sf_dir), "app_id", "left")
    return joined.withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("installed", F.col("uses") > 0)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`catalog` with syllables, initials and an English name that differ from the name: of "red ring" of type ECONOMY they
    are "economy ring", "er" and "red"."""
    kind, first, second = F.col("cat"), F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    c = catalog(spark, sf_dir)
    return c.withColumns({"py": F.concat_ws(" ", kind, second), "abbr": F.concat(F.substring(kind, 1, 1), F.substring(second, 1, 1)), "en": first})


def category_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, category, kind) of the types: their brands are keywords, four letters a root, the last two letters initials."""
    p = table(spark, sf_dir, "part")
    of = lambda term, kind: p.select(term.alias("term"), F.col("p_type").alias("category"), F.lit(kind).alias("kind")).distinct()
    kind = F.lower("p_type")
    return of(F.lower("p_brand"), "keyword").unionByName(of(kind, "label")).unionByName(of(F.substring(kind, 1, 4), "root")).unionByName(of(F.substring(kind, -2, 2), "initials"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user, app, value) of the events."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("user"), F.col("event_type").alias("app"), "value")


def queries_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(query_id, q) of the given texts. From Arrow they are local rows, whose size the optimizer knows; of a list it takes the largest size
    there is, and then rather broadcasts the catalogue, the estimate of which is that of compressed files."""
    rows = pa.table({"query_id": pa.array(range(len(texts)), pa.int64()), "q": pa.array(texts, pa.string())})
    return spark.createDataFrame(rows, "query_id long, q string")


#: Searches that meet each rung of the ladder over :func:`named`.
RUNGS = ["red ring", "blue", "economyring", "economyri", "er", "e", "omyri", "ed r", "red", "bluebolt", "gnir", "brand#1", "promo", "prom", "rde bolt", "reed ringg", "my", "zzz", "standard bolt", "qx"]
#: Names run together.
RUN_TOGETHER = ["redring", "bluegear", "economyringpromobolt", "hot", "zzz", "ersb", "red ringblue bolt"]
#: Searches over the catalogue: exact, prefix, inside, typing errors, initials, category, nothing.
SEARCHES = ["red ring", "blue", "gear", "rde bolt", "cold wid", "ngear", "sg", "large", "zzz", "hot rodd", "brand#1", "wigdet", "old anvil", "economy"]

"""The ten operators as queries over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"))


def op2_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lpf import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(_table(spark, sf_dir, "documents"))


def op5_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index holds every row; the rows whose id is divisible by 50 are searched for."""
    from .vamana import neighbours

    table = _table(spark, sf_dir, "embeddings")
    return neighbours(table, queries=table.where("vec_id % 50 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .icws import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import groups

    return groups(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feistel import shards

    return shards(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import write_shared

    return write_shared(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .feistel import sql

    return {"op9_sharding": sql()}

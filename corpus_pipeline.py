"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mixing, packing, pii, quality, setsketch
from lodestar.llm._util import remove, shared_dir


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return setsketch.deduplicate(docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: protected values and the terms that tell of them are generalised; every document stays."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as its source's share asks for, by default the root of its size."""
    return mixing.mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: whole texts in packs of equal capacity."""
    return packing.pack(docs)


STAGES = [
    ("quality", reject_bad),
    ("near_dedup", drop_near_duplicates),
    ("pii", remove_pii),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: The stages train, hash and draw; SQL can't express them, so tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage wrote goes when the next one has read it; the last one reads the fourth's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
        if before:
            remove(spark, before)
        before = f"{home}/{k}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

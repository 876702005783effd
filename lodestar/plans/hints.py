"""Broadcast behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 32 << 20


def is_small(df: DataFrame, limit: int = LIMIT) -> bool:
    """Whether the optimizer's estimate of the size is under ``limit`` bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def broadcast_if_small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's size estimate is under ``limit`` bytes, else as it is: then the join
    shuffles both sides, and adaptive execution may still broadcast or split skewed keys by the sizes that it meets."""
    return F.broadcast(df) if is_small(df, limit) else df


def asked_of(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` to be joined with rows made of the catalogue: broadcast if it is small, else both sides are shuffled and merged. Without that the
    optimizer may broadcast the other side, as its estimate is that of compressed files, before what is exploded from them."""
    return F.broadcast(df) if is_small(df, limit) else df.hint("merge")

"""Shared plumbing: the checkpoint folder, internal column names, bounded Arrow chunks."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without the setting (tests) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestar-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*cols, seed: int = 0):
    """Two 64-bit hashes of the values together: null, empty and shifted values differ, and 128 bits don't meet by chance."""
    flagged = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(seed), *flagged).alias("a"), F.xxhash64(F.lit(seed + 1), *flagged).alias("b"))


KEY = "struct<a:long,b:long>"  #: the type of :func:`row_key`


def sieve(hashes: DataFrame, most: int = 2**26):
    """A function of hashes (long): whether one may be among those in the only column of ``hashes``. True for all of these, and for few others.

    There is a bit for each value of a hash's last digits, 16 for each hash but ``most`` at most, so what is sent is bounded; with more
    hashes than that allows, more of the others get through. Whoever asks joins what is left.
    """
    size, n = min(2**16, most), hashes.count()
    while size < min(most, 16 * n):
        size *= 2
    at = hashes.select(F.col(hashes.columns[0]).bitwiseAND(F.lit(size - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    held = np.zeros(size // 64, np.int64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def may(hash: pa.Array) -> pa.Array:
        x = hash.to_numpy(zero_copy_only=False) & (size - 1)
        return pa.array((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return may


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(text: pa.Array, budget: int = 3_000_000):
    """(first, count) runs of rows holding about ``budget`` bytes of text each; one long text is a run of its own."""
    n = len(text)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i in range(n):
        if held and held + size[i] > budget:
            yield first, i - first
            first, held = i, 0
        held += int(size[i])
    yield first, n - first


def text_or_empty(col):
    return F.coalesce(col.cast("string"), F.lit(""))

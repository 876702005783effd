"""State tables on disk: versions, deltas, key-value JSON, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inject(apps: DataFrame, name: str = "apps") -> None:
    """Make ``apps`` the catalogue that SQL sees."""
    apps.createOrReplaceTempView(name)


def apply_delta(current: DataFrame, added: DataFrame, removed: DataFrame, key: str = "app_id", label: str = "name") -> DataFrame:
    """``current`` without the removed keys, added rows in place of equal keys, by label regardless of case."""
    gone = removed.select(key).union(added.select(key)).distinct()
    return current.join(gone, key, "left_anti").unionByName(added).orderBy(F.lower(label), key)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def changes(log: DataFrame, key: str = "pkg", order: str = "ts") -> DataFrame:
    """The last action of each key of a change log (key, action, ts, ...); REMOVED keys go."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")
    return last.where("action <> 'REMOVED'")


class Store:
    """Named tables below a path. A write makes a new version and then moves the pointer, so readers never see half a table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._base = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._base.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _pointer(self, name: str) -> str | None:
        p = self._path(name, "CURRENT")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        version = uuid.uuid4().hex
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.path}/{name}/{version}")
        stream = self._fs.create(self._path(name, f"CURRENT.{version}"), True)
        stream.write(bytearray(version.encode()))
        stream.close()
        old = self._pointer(name)
        self._fs.delete(self._path(name, "CURRENT"), False)
        self._fs.rename(self._path(name, f"CURRENT.{version}"), self._path(name, "CURRENT"))
        if old:
            self._fs.delete(self._path(name, old), True)

    def read(self, name: str, schema: str | T.StructType | None = None) -> DataFrame:
        version = self._pointer(name)
        if version is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        if not self._fs.exists(self._base):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._base) if s.isDirectory() and self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "CURRENT")))

    def export(self, path: str) -> None:
        """All tables, as plain Parquet below ``path``."""
        for name in self.names():
            self.read(name).write.mode("overwrite").parquet(f"{path}/{name}")

    def restore(self, path: str, names: list[str]) -> None:
        for name in names:
            self.write(name, self.spark.read.parquet(f"{path}/{name}"))


def json_values(kv: DataFrame, schema: str, fallback: str | None = None) -> DataFrame:
    """(key, value) of a key-value table of JSON texts; what doesn't parse is the fallback, JSON too, or null."""
    parsed = F.from_json("value", schema)
    return kv.select("key", parsed.alias("value") if fallback is None else F.coalesce(F.when(F.get_json_object("value", "$").isNotNull(), parsed), F.from_json(F.lit(fallback), schema)).alias("value"))


def signals(raw: DataFrame) -> DataFrame:
    """(pkg, ts_ms, event_type, prev_pkg) from a column ``value`` of JSON arrays of signals; broken ones give none."""
    kind = "array<struct<pkg:string,ts_ms:bigint,event_type:string,prev_pkg:string>>"
    return raw.select(F.explode(F.from_json("value", kind)).alias("s")).select("s.*").where("pkg is not null and ts_ms is not null")


def between(rows: DataFrame, start, end, by: str = "ts") -> DataFrame:
    return rows.where((F.col(by) >= start) & (F.col(by) < end))


def observed(rows: DataFrame, key: str = "pkg") -> DataFrame:
    return rows.select(key).distinct()


def usage_totals(rows: DataFrame, key: str = "pkg") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.max("ts").alias("last_used"))

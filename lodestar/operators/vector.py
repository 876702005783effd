"""Dense vectors: nearest neighbours by cosine, retrieval documents, index blending, boosts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..plans.hints import is_small


def load(vectors: DataFrame, order: str = "seq") -> DataFrame:
    """(id, v): rows with an id and a vector, the last of equal ids by ``order``, unit length."""
    ok = vectors.where((F.coalesce("id", F.lit("")) != "") & (F.size("v") > 0))
    return ok.groupBy("id").agg(F.max_by("v", order).alias("v")).select("id", M.l2_normalize(F.col("v")).alias("v"))


def _packed(rows: DataFrame, kind: str, block: int) -> DataFrame:
    """(ids, width, vs) of rows (id, v): up to ``block`` rows of equal length as one, their unit vectors as bytes."""

    def run(batches):
        for batch in batches:
            width = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for i in range(0, len(at), block):
                    some = batch.take(pa.array(at[i : i + block]))
                    x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([w], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "width", "vs"])

    return rows.where(F.size("v") > 0).select("id", F.col("v").cast("array<float>").alias("v")).mapInArrow(run, f"ids array<{kind}>, width int, vs binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` largest cosines of each query (query_id, v) by exact search, those equal to six digits by id.

    Queries and vectors are packed into blocks of bounded size; a block of the one meets each block of the other as one matrix product in single precision,
    keeps that block's ``k`` best of every query and what may tie with the last by what that can be off, and only those are scored in full precision and shuffled.
    """
    k = k or 10
    kind, q_kind = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    q = _packed(queries.select(F.col("query_id").alias("id"), "v"), q_kind, block).toDF("q_ids", "q_width", "q_vs")
    packs = _packed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), kind, block)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                w, q_w = batch.column(1)[r].as_py(), batch.column(4)[r].as_py()
                if w != q_w:
                    continue
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(-1, w) for c in (2, 5))
                ids, q_ids = batch.column(0)[r].values, batch.column(3)[r].values
                about = y.astype(np.float32) @ x.T.astype(np.float32)
                n = min(k, len(ids))
                last = np.partition(about, about.shape[1] - n, axis=1)[:, about.shape[1] - n]
                # unit vectors' products in single precision are off by less than half the slack, which also holds a tie's rounding
                slack = np.float32(2 * (w + 8) * 2.0**-23 + 2e-6)
                at, col = np.nonzero(about >= (last - slack)[:, None])
                score = np.einsum("ij,ij->i", y[at], x[col])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), ids.take(pa.array(col)), pa.array(score)], ["query_id", "id", "score"])

    found = packs.crossJoin(F.broadcast(q) if is_small(queries) else q).mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """:func:`knn` of the queries that have a vector; the others find nothing."""
    return knn(vectors, queries.where("v is not null"), k)


def document_text(apps: DataFrame, signals: DataFrame) -> DataFrame:
    """(pkg, document): label, syllables, initials, syllable list and the phrases of its signals (pkg, phrase), what is empty left out."""
    phrases = signals.groupBy("pkg").agg(F.sort_array(F.collect_set("phrase")).alias("phrases"))
    joined = apps.join(phrases, "pkg", "left")
    parts = F.concat(F.array("label", "pinyin", "initials"), F.coalesce("syllables", F.array().cast("array<string>")), F.coalesce("phrases", F.array().cast("array<string>")))
    return joined.select("pkg", F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " ").alias("document"))


def intent_tags(apps: DataFrame, frequent: DataFrame, targets: DataFrame, clicked: DataFrame, preferred: DataFrame) -> DataFrame:
    """(pkg, tags): which of the four signal tables (pkg) have the app."""
    out = apps.select("pkg")
    named = {"time_frequent": frequent, "transition_target": targets, "recent_click": clicked, "preferred": preferred}
    for name, table in named.items():
        out = out.join(table.select("pkg").distinct().withColumn(name, F.lit(name)), "pkg", "left")
    return out.select("pkg", F.array_compact(F.array(*named)).alias("tags"))


def rebuild(documents: DataFrame, embed, dims: int = 512) -> DataFrame:
    """(pkg, document, vector): embedded by the given Arrow function, cut or padded to ``dims``."""
    return documents.withColumn("vector", M.fit_dims(embed("document"), dims))


def indexes(entries: DataFrame) -> DataFrame:
    """(kind, key, pkgs) by package, category and intent tag, of entries (pkg, cat, tags)."""
    keys = F.concat(
        F.array(F.struct(F.lit("package").alias("kind"), F.col("pkg").alias("key")), F.struct(F.lit("category").alias("kind"), F.col("cat").alias("key"))),
        F.transform("tags", lambda t: F.struct(F.lit("intent").alias("kind"), t.alias("key"))),
    )
    rows = entries.select("pkg", F.explode(keys).alias("k")).where("k.key is not null")
    return rows.groupBy("k.kind", "k.key").agg(F.sort_array(F.collect_set("pkg")).alias("pkgs"))


def blend(old: DataFrame, new: DataFrame, weight: Column | float) -> DataFrame:
    """(query_id, id, score): ``weight`` of the old index's score and the rest of the new one's; a missing score is 0."""
    joined = old.select("query_id", "id", F.col("score").alias("a")).join(new.select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "full_outer")
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return joined.select("query_id", "id", (w * F.coalesce("a", F.lit(0.0)) + (1 - w) * F.coalesce("b", F.lit(0.0))).alias("score"))


def active_paths(state: DataFrame, as_of: Column) -> DataFrame:
    """(name, weight, paths) of transition states (name, started_at, finalized): both indexes are in use while the weight is between 0 and 1."""
    w = M.blend_weight(F.col("started_at"), as_of, F.col("finalized"))
    paths = F.when((w > 0) & (w < 1), F.array(F.lit("previous"), F.lit("current"))).when(w >= 1, F.array(F.lit("previous"))).otherwise(F.array(F.lit("current")))
    return state.select("name", w.alias("weight"), paths.alias("paths"))


def boost(hits: DataFrame, most: float = 0.3) -> DataFrame:
    """(query_id, id, boost) of (semantic, synonym, intent, popularity): 0.15 semantic, 0.05 for a synonym, 0.10 for the intent, 0.04 of
    the popularity over a half; within 0 and ``most``."""
    total = 0.15 * F.coalesce("semantic", F.lit(0.0)) + F.when(F.col("synonym"), 0.05).otherwise(0.0) + F.when(F.col("intent"), 0.10).otherwise(0.0) + (F.coalesce("popularity", F.lit(0.5)) - 0.5) * 0.04
    return hits.select("query_id", "id", M.clamp(total, 0.0, most).alias("boost"))

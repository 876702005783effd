"""Lexical ranking: BM25 and TF-IDF over posting tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.hints import broadcast_if_small, is_small
from .index import term_counts


def top(df: DataFrame, k: int, by: str = "score", group: str = "query_id", tie: str = "id") -> DataFrame:
    """The ``k`` rows of highest ``by`` in each group, with their rank from 1; those equal to six digits by ``tie``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(by, 6)), F.asc(tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of each query (query_id, q), over its distinct tokens.

    The query tokens are joined to the tokens before counting, so only terms that some query has are ever counted or
    shuffled. Document frequencies are counted map-side from the postings, of which a frequent term has many, and joined back. Where queries
    times terms are few enough (:func:`incidence`), blocks of documents meet all queries as one matrix product, and only each block's best are
    shuffled; else every pair of a document and a query is.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.lexical_tokens(F.col("q")))).alias("term"))
    words = asked.select("term").distinct()
    named = docs.where(F.col(id_col).isNotNull())
    stats = named.select(X.lexical_length(F.col(text_col)).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    # a token array per row makes lengths free and lets the explode be filtered at once
    tokens = named.select(F.col(id_col).alias("id"), X.lexical_tokens(F.col(text_col)).alias("tokens"))
    every = tokens.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    # it asks for tf, else the exchange of the frequencies would leave that out and be another one
    documents = F.count(F.when(F.col("tf") > 0, 1))
    if is_small(asked) and (said := incidence(asked)) is not None:
        numbered, has, ids = said
        # the same exchange gives both sides
        counts = every.join(F.broadcast(numbered), "term").groupBy("id", "len", "no").agg(F.count("*").alias("tf"))
        df = F.broadcast(counts.groupBy("no").agg(documents.alias("df")))
        parts = counts.join(df, "no").crossJoin(F.broadcast(stats)).select("id", "no", part.alias("part"))
        return top(best_by_block(parts, has, ids, dict(docs.dtypes)[id_col], dict(queries.dtypes)["query_id"], k), k)
    counts = every.join(broadcast_if_small(words), "term").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    # the same exchange gives both sides; there are no more frequencies than query terms
    df = counts.groupBy("term").agg(documents.alias("df"))
    terms = asked.join(F.broadcast(df) if is_small(words) else df, "term")
    terms = F.broadcast(terms) if is_small(asked) else terms
    scored = counts.join(terms, "term").crossJoin(F.broadcast(stats)).select("query_id", "id", part.alias("part"))  # one row of statistics
    return top(scored.groupBy("query_id", "id").agg(F.sum("part").alias("score")), k)


def incidence(asked: DataFrame, most: int = 1 << 24) -> tuple[DataFrame, np.ndarray, pa.Array] | None:
    """Of (query_id, term): the terms and their numbers (term, no), a matrix [no, query] of ones where a query has a term, and the queries' ids; none
    if it had over ``most`` places."""
    rows = asked.where("term is not null").distinct().limit(most + 1).toArrow()
    if len(rows) > most:
        return None
    query, term = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    if len(query.dictionary) * len(term.dictionary) > most or query.null_count:
        return None
    has = np.zeros((len(term.dictionary), len(query.dictionary)))
    has[term.indices.to_numpy(), query.indices.to_numpy()] = 1
    numbers = pa.table({"term": term.dictionary.cast(pa.string()), "no": pa.array(range(len(term.dictionary)), pa.int32())})
    return asked.sparkSession.createDataFrame(numbers, "term string, no int"), has, query.dictionary


def best_by_block(parts: DataFrame, has: np.ndarray, queries: pa.Array, kind: str, q_kind: str, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, score) of the summed parts (id, no, part) of each document's terms: of each block of documents the ``k`` best of every query, and what
    ties with the last to six digits. ``has``, ``queries``: of :func:`incidence`."""
    shared = parts.sparkSession.sparkContext.broadcast((has, queries))
    terms = max(1, len(has))
    block = max(1, min(block, (1 << 22) // terms))

    def scored(rows: pa.Table, first: np.ndarray):
        """Of whole documents, which begin at the rows ``first``."""
        has, queries = shared.value
        no, part = (rows.column(c).to_numpy() for c in ("no", "part"))
        ends = np.r_[first, len(no)]
        for at in range(0, len(first), block):
            own = ends[at : at + block + 1]
            some = slice(own[0], own[-1])
            x = np.bincount(np.repeat(np.arange(len(own) - 1), np.diff(own)) * terms + no[some], part[some], (len(own) - 1) * terms).reshape(-1, terms)
            score = (x @ has).T
            about = np.round(score, 6)
            n = min(k, about.shape[1])
            last = np.partition(about, about.shape[1] - n, axis=1)[:, about.shape[1] - n]
            # a document without any of a query's terms has no parts, and every part is above 0
            query, doc = np.nonzero((about >= last[:, None]) & (score > 0))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), rows.column("id").take(pa.array(own[doc])).combine_chunks(), pa.array(score[query, doc])], ["query_id", "id", "score"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            ids = rows.column("id").combine_chunks()
            first = np.r_[0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1]
            if len(first) > block:  # the last document may go on
                yield from scored(rows.slice(0, first[-1]), first[:-1])
                rows = rows.slice(first[-1])
            held = rows
        if held is not None:
            ids = held.column("id").combine_chunks()
            yield from scored(held, np.r_[0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1])

    ordered = parts.repartition("id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")


def tfidf_search(index: DataFrame, queries: DataFrame, tokens: Column, scale: float = 30.0) -> DataFrame:
    """(query_id, id, score): the summed weights of the query's tokens, times ``scale``."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("term"))
    hits = index.join(broadcast_if_small(asked), "term")
    return hits.groupBy("query_id", "id").agg((F.sum("weight") * scale).alias("score"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len, term, tf): the inverted index to keep, with document lengths beside."""
    return term_counts(docs, X.lexical_tokens(F.col(text_col)), id_col)

"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector's non-zero integer components are its terms. Candidates lie in blocks; a block's
postings of a term are the rows that have it, with their weights. For a chunk of queries,
term after term, each query weight times the postings' weights is scattered into a dense
score array (rows x queries). Then a partition selection keeps each query's k best of the
chunk, and a merge keeps the best of all blocks.

Work is a grid of candidate blocks and query blocks: every query meets every row exactly
once, both are dealt by a stored row number (a repeated id or vector is no hot block), and a
cell holds at most about ``ROWS`` candidates and ``QUERIES`` queries whatever the table's size. Cells give k
rows a query, which the merge ranks (Spark limits each group before it shuffles).

Defined results: vectors that are null or hold null or non-finite components take no part;
missing components of a shorter vector count as 0; a repeated id is a row of its own, and
no row with the query's own id is its candidate; ties go to the smaller id; no queries or
no candidates give no rows. Scores are exact in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROWS, QUERIES = 1 << 16, 1 << 14
CHUNK_ROWS, CHUNK_QUERIES = 1 << 12, 64


def integer_vectors(df: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of each component x as double."""
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return df.where(F.col(id).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id).cast("long").alias("id"), v.alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    n = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), n), np.int64)
    lens = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors):
        out[np.arange(n) < lens[:, None]] = np.concatenate([np.asarray(v, np.int64) for v in vectors])
    return out


def accumulate(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores (rows x queries), term at a time. 32-bit sums where no score can exceed
    them, else 64-bit."""
    bound = sum(int(np.abs(rows[:, t]).max(initial=0)) * int(np.abs(queries[:, t]).max(initial=0)) for t in range(min(rows.shape[1], queries.shape[1])))
    kind = np.int32 if bound < 2 ** 31 else np.int64
    rows, queries = rows.astype(kind), queries.astype(kind)
    scores = np.zeros((len(rows), len(queries)), kind)
    for t in range(min(rows.shape[1], queries.shape[1])):
        posting = np.flatnonzero(rows[:, t])
        asks = np.flatnonzero(queries[:, t])
        if not len(posting) or not len(asks):
            continue
        weight, ask = rows[posting, t][:, None], queries[asks, t][None, :]
        if 2 * len(posting) > len(rows) and 2 * len(asks) > len(queries):
            scores += rows[:, t][:, None] * queries[:, t][None, :]     # nearly every cell
        else:
            scores[np.ix_(posting, asks)] += weight * ask
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of each query's k best rows. ids ascend, so the earlier row
    wins a tie; a query's own id is left out."""
    n = len(ids)
    found_q, found_r = [], []
    for q in range(scores.shape[1]):
        s = scores[:, q]
        mine = slice(*np.searchsorted(ids, [own[q], own[q] + 1]))
        at = np.arange(n)
        if mine.stop > mine.start:
            at = np.delete(at, mine)
            s = s[at]
        if len(s) > k:
            cut = -np.partition(-s.astype(np.int64), k - 1)[k - 1]
            above = np.flatnonzero(s > cut)
            level = np.flatnonzero(s == cut)[:k - len(above)]
            at = at[np.concatenate([above, level])]
        found_q.append(np.full(len(at), q))
        found_r.append(at)
    return np.concatenate(found_q), np.concatenate(found_r)


def _best(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for q0 in range(0, len(asked), CHUNK_QUERIES):
        own, q = asked[q0:q0 + CHUNK_QUERIES], queries[q0:q0 + CHUNK_QUERIES]
        query, vec, score = (np.zeros(0, np.int64) for _ in range(3))
        for r0 in range(0, len(ids), CHUNK_ROWS):
            chunk = ids[r0:r0 + CHUNK_ROWS]
            s = accumulate(rows[r0:r0 + CHUNK_ROWS], q)
            at_q, at_r = select(s, chunk, own, k)
            query = np.concatenate([query, at_q])
            vec = np.concatenate([vec, chunk[at_r]])
            score = np.concatenate([score, s[at_r, at_q].astype(np.int64)])
            best = np.lexsort((vec, ~score, query))          # ~: descending without overflow
            query, vec, score = query[best], vec[best], score[best]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            query, vec, score = query[nth < k], vec[nth < k], score[nth < k]
        yield pd.DataFrame({"q": query + q0, "query_id": own[query], "vec_id": vec, "score": score})


def block(row: str, blocks: int) -> Column:
    """Block of a numbered row."""
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
               scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query`` holds."""
    asks = integer_vectors(df.where(is_query), id, vector, scale)
    rows = integer_vectors(df, id, vector, scale)
    spark = df.sparkSession
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    n_rows, n_asks = rows.count(), asks.count()
    blocks = max(-(-n_rows // ROWS), min(spark.sparkContext.defaultParallelism * 2, -(-n_rows // CHUNK_ROWS)), 1)
    ask_blocks = max(-(-n_asks // QUERIES), 1)
    asks = stored(asks.withColumn("qid", F.monotonically_increasing_id()), "topk-queries")
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", block("row", blocks).alias("b"), deal(ask_blocks).alias("qb"))
    right = asks.withColumn("qb", block("qid", ask_blocks)).withColumn("b", deal(blocks))

    def cell(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": queries["qid"].to_numpy()[part["q"]], "query_id": part["query_id"], "vec_id": part["vec_id"], "score": part["score"]})
                 for part in _best(cands["id"].to_numpy(np.int64), _matrix(cands["v"]), queries["id"].to_numpy(np.int64), _matrix(queries["v"]), k)]
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "score": []})

    best = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(cell, "qid bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

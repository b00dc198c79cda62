"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size. In a block every dimension has its list of components in sorted order.
A query reads all lists in step, from the end that is best for the sign of its weight, and scores each vector it meets in
full. What no list has shown yet scores at most the product of the query with the components at the current depth; the
query stops in this block when that bound is below its kth score (a tie may still win by its id). The best k of every
block meet in a window per query. Queries are the stated set; they come in packs, and each pack meets each block once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pin

K = 5
SCALE = 256
QUERY_EVERY = 50
BLOCK = 8192
PACK = 256
_LONG = 2**63 - 1
_FLOAT_EXACT = 2**53


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): components as floor(scale * x), in double; of repeated ids the smallest vector counts."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    return vectors.where(fine).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", F.size("v").alias("dim"), "v")


class SortedLists:
    """The vectors of a block and, per dimension, their order by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.largest = int(np.abs(vectors.astype(object)).max()) if vectors.size else 0
        self.floats = vectors.astype(np.float64) if self.largest < _FLOAT_EXACT else None

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best vectors other than the query's own, ties to the smaller id."""
        n, dims = self.vectors.shape
        exact = dims * self.largest * max(1, int(np.abs(query.astype(object)).max())) if dims else 0
        quick = self.floats is not None and exact < _FLOAT_EXACT
        rows = self.floats if quick else self.vectors.astype(object)
        weights = query.astype(np.float64) if quick else query.astype(object)
        used = np.flatnonzero(query != 0)
        if not len(used):  # every score is 0
            ids = np.sort(self.ids[self.ids != query_id])[:k]
            return [(0, int(i)) for i in ids]
        best_first = query > 0
        falling = self.order[::-1]
        seen = self.ids == query_id
        scores, ids = np.empty(0, rows.dtype), np.empty(0, np.int64)
        depth, step = 0, 4
        while depth < n:
            end = min(n, depth + step)
            part = np.where(best_first, falling[depth:end], self.order[depth:end])[:, used]
            met = np.zeros(n, bool)
            met[part] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            scores, ids = np.concatenate([scores, rows[new] @ weights]), np.concatenate([ids, self.ids[new]])
            if len(ids) > k:
                keep = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[keep], ids[keep]
            bound = (rows[part[-1], used] * weights[used]).sum()
            if len(ids) == k and bound < scores.min():
                break
            depth, step = end, step * 2
        keep = np.lexsort((ids, -scores))[:k]
        return [(max(-_LONG - 1, min(_LONG, int(s))), int(i)) for s, i in zip(scores[keep], ids[keep], strict=True)]


def _matrix(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    return ids, np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)


def _search(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lists = None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if at != (row.dim, row.block):  # the packs of a block mostly follow each other
                    at, lists = (row.dim, row.block), SortedLists(*_matrix(row.vectors, row.dim))
                out = [(q, i, s) for q, v in zip(*_matrix(row.queries, row.dim), strict=True) for s, i in lists.best(int(q), v, k)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _dealt(rows: DataFrame, size: int, name: str, to: str) -> DataFrame:
    """Rows of a dimension gathered into groups of about ``size``."""
    groups = {r["dim"]: max(1, math.ceil(r["n"] / size)) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    count = F.lit(1)
    for dim, n in groups.items():
        count = F.when(F.col("dim") == dim, n).otherwise(count)
    place = F.pmod(F.xxhash64("vec_id"), count).cast("int")
    return rows.groupBy("dim", place.alias(name)).agg(F.collect_list(F.struct("vec_id", "v")).alias(to))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other vectors by integer inner product.

    Ties go to the smaller vec_id; a query with fewer candidates gets them all. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id; of rows that repeat an id the smallest vector counts;
    only vectors of equal length are compared; scores beyond a long are held at its ends. Further columns are ignored.
    """
    rows = pin(whole_vectors(vectors, scale))
    blocks = pin(_dealt(rows, BLOCK, "block", "vectors"))
    packs = pin(_dealt(rows.where(is_query), PACK, "pack", "queries"))
    meets = packs.join(blocks.select("dim", "block"), "dim")
    found = blocks.join(meets, ["dim", "block"]).select("dim", "block", "vectors", "queries").mapInPandas(
        _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT vec_id, i, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

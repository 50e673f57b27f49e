"""Exact top-k search by inner product, term at a time.

A vector is a sparse row of weights by term (its dimension). For each term, a tile's candidates form a posting list; a
query's weight scatters the weighted postings into the query's dense array of scores. After the last term a partial
selection keeps k candidates of each query, and the tiles' selections are merged.

Queries are dealt to blocks of bounded size, candidates to others; a tile is a block of each. Both block counts grow with the tables, so
that no task holds more than a tile.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """key and vec (array<long>): floor(scale * x) for each component x as double.

    Vectors null, or with a null or non-finite component, take no part; equal rows count once. An empty vector scores 0.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).alias("key"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec")).distinct()


def _postings(vecs: pd.Series, dims: int) -> np.ndarray:
    """A row for each term, the weights of all vectors in it; a shorter vector has no weight in further terms."""
    if all(len(v) == dims for v in vecs):
        return np.stack(vecs.to_list()).astype(np.int64).T.copy() if len(vecs) else np.zeros((dims, 0), np.int64)
    out = np.zeros((dims, len(vecs)), np.int64)
    for i, v in enumerate(vecs):
        out[: len(v), i] = v
    return out


def _tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    dims = max(queries["vec"].map(len).max(), candidates["vec"].map(len).max())
    weights, postings = _postings(queries["vec"], dims), _postings(candidates["vec"], dims)
    query_keys, keys = queries["key"].to_numpy(), candidates["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, postings = keys[order], postings[:, order]
    parts = []
    scores = np.empty(len(keys), np.int64)
    product = np.empty(len(keys), np.int64)
    for q, own in enumerate(query_keys):
        scores[:] = 0
        for term in np.flatnonzero(weights[:, q]):
            np.multiply(postings[term], weights[term, q], out=product)
            scores += product
        others = np.ones(len(keys), bool)
        others[np.searchsorted(keys, own, "left") : np.searchsorted(keys, own, "right")] = False
        at = np.flatnonzero(others)
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= least]
        best = at[np.argsort(-scores[at], kind="stable")[:k]]  # keys ascend, so ties go to the smaller
        parts.append(pd.DataFrame({"query": own, "key": keys[best], "score": scores[best]}))
    return pd.concat(parts)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """queries and candidates as of quantised() -> query, rank (int, from 1), key, score (long): the k highest of each query, ties to the smaller key.

    A query's own key is no candidate of it. Fewer candidates than k: all. Repeated queries count once.
    A key with several vectors is one query, ranked by the scores of all of them, and as a candidate has a row for each.
    """
    n_queries, n_candidates = queries.count(), candidates.count()
    across, down = -(-n_queries // query_block) or 1, -(-n_candidates // candidate_block) or 1
    block = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("key", "vec", block(across, 1).alias("a")).select("key", "vec", "a", every(down).alias("b"))
    right = candidates.select("key", "vec", block(down, 2).alias("b")).select("key", "vec", every(across).alias("a"), "b")

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _tile(q, c, k) if len(q) and len(c) else pd.DataFrame({"query": [], "key": [], "score": []})

    kind = candidates.schema["key"].dataType.simpleString()
    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(tile, f"query {kind}, key {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "score")

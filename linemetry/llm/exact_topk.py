"""Exact top-k by exhaustive term-at-a-time accumulation.

A vector's non-zero components are its terms, with integer weights. A block of rows keeps a
posting list for each term: rows and weights. Queries go through the terms one at a time and
scatter query weight times posting weight into dense score arrays, one for each query of a
batch; the best k of an array are then found by partition selection and merged over blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._grid import finite, nearest

#: Queries whose score arrays are filled together, and rows of an array: both stay in cache.
BATCH, STRIPE = 32, 2048
#: Below any score's key; its negative is a number too.
LOWEST = np.iinfo(np.int64).min + 1
#: Rows and queries of a cell on average, and cells at least (for parallel work).
BLOCK_ROWS, BLOCK_QUERIES, LEAST_CELLS = 8192, 2048, 24


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows) of integer weights; term at a time over non-zero postings."""
    scores = np.zeros((len(queries), len(rows)), dtype=_kind_of(queries, rows))
    weights = np.ascontiguousarray(rows.T).astype(scores.dtype)
    asked = queries.astype(scores.dtype)
    product = np.empty_like(scores)
    for term in range(queries.shape[1]):
        posting = np.flatnonzero(weights[term])
        with_term = np.flatnonzero(asked[:, term])
        if not len(posting) or not len(with_term):
            continue
        if 4 * len(posting) >= 3 * len(rows) and 4 * len(with_term) >= 3 * len(queries):
            # a nearly full list is kept as an array over all rows: zeros add nothing
            np.multiply(asked[:, term, None], weights[term], out=product)
            scores += product
        else:
            scores[np.ix_(with_term, posting)] += asked[with_term, term, None] * weights[term, posting]
    return scores


def _kind_of(queries: np.ndarray, rows: np.ndarray) -> type:
    """A type in which no score overflows; integers where they are exact in it."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    return np.int32 if most < 2**31 else np.int64 if most < 2**62 else np.float64


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, of equal ones the first; places of `own` come last."""
    n = scores.shape[1]
    if scores.dtype != np.float64 and np.abs(scores).max(initial=0) < 2**50:
        # one key orders by score, then by smaller place
        key = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        key[own] = LOWEST
        return np.argpartition(-key, k - 1, axis=1)[:, :k]
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, own), axis=1)[:, :k]


def _kernel(k: int):
    def run(numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out_q, out_v, out_s = [], [], []
        for a in range(0, len(queries), BATCH):
            number, of, batch = numbers[a : a + BATCH], query_ids[a : a + BATCH], queries[a : a + BATCH]
            held_v, held_s, held_t = [], [], []
            for b in range(0, len(rows), STRIPE):
                own = ids[b : b + STRIPE]
                scores = accumulate(batch, rows[b : b + STRIPE])
                mine = of[:, None] == own[None, :]  # a query's own row takes no place
                top = _best(scores, mine, k) if k < len(own) else np.broadcast_to(np.arange(len(own)), scores.shape)
                taken = ~np.take_along_axis(mine, top, axis=1)
                held_v.append(own[top])
                held_s.append(np.take_along_axis(scores, top, axis=1))
                held_t.append(taken)
            value, found, taken = np.concatenate(held_s, axis=1), np.concatenate(held_v, axis=1), np.concatenate(held_t, axis=1)
            order = np.lexsort((found, -value.astype(np.result_type(value, np.int64)), ~taken), axis=1)[:, :k]
            value, found, real = (np.take_along_axis(x, order, axis=1) for x in (value, found, taken))
            out_q.append(np.broadcast_to(number[:, None], value.shape)[real])
            out_v.append(found[real])
            out_s.append(value[real].astype(np.float64))
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)

    return run


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """floor(scale * x) of every component, as integers in doubles."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return wide.where(finite("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("embedding"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of
    floor(scale * x), ties to the smaller vec_id; all candidates if there are fewer.

    `vectors` and `queries` are (vec_id, embedding). Vectors that are null, empty or hold a null
    or non-finite component take no part; zero vectors do. Vectors of another length than a
    query's aren't its candidates, nor are rows with its vec_id. Every row of `queries` is a query
    of its own, so a repeated vec_id gives its ranks once for each; rows of `vectors` that repeat
    a vec_id are a candidate each. Rows with a null vec_id take no part. Scores are exact below
    2**53; from there on they are rounded to doubles, and those beyond 64 bits are the largest or
    smallest long. Other columns, whatever their names, are ignored; without queries or vectors the result is empty.
    """
    out = nearest(quantised(vectors, scale), quantised(queries, scale), k, _kernel(k), False, BLOCK_ROWS, BLOCK_QUERIES, LEAST_CELLS)
    return out.select("query_id", "rank", "vec_id", F.when(F.col("value") >= 2.0**63, 2**63 - 1).when(F.col("value") <= -(2.0**63), -(2**63)).otherwise(F.when(F.abs("value") < 2.0**63, F.col("value")).cast("long")).alias("score"))

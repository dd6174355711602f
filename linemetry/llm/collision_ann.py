"""Approximate nearest neighbours by collision counting with query-centred windows.

Every row is projected on single directions, each with its own sorted array; the directions are
those of random rotations. A query opens a window around its own projection in every array and
widens it in steps (virtual rehashing); a row collides once for every array and step whose window
holds it. Half widths grow like the square root of the step, so a row's collisions tell its
squared distance up to the steps' coarseness. The k rows that collide most are verified by their
true distance; their k-th best distance gives the collision threshold, and all rows that reach it
are verified. The search ends when the last window is wide enough for that distance to be told;
else windows are laid out anew, RATIO times as wide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._grid import finite, nearest

#: Directions (whole rotations where a vector is shorter), steps of a layout, widening of layouts.
DIRECTIONS, STEPS, RATIO = 64, 16, 1.5
#: The last window holds a share P(|N(0,1)| <= REACH) of the projections of rows at the k-th
#: distance; the threshold allows for MARGIN standard deviations of the distance that is told.
REACH, MARGIN = 2.3, 5.0
#: Rows and queries of a cell on average, and cells at least (for parallel work): large blocks,
#: since each verifies at least k rows.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_CELLS = 1 << 16, 1 << 12, 24
SEED = 20240607


def rotations(dim: int, directions: int, seed: int) -> np.ndarray:
    """Unit directions as columns: of one rotation where `dim` is larger, else of several whole ones."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-directions // dim))]
    return np.concatenate(parts, axis=1)[:, : directions if directions < dim else None]


class Index:
    """Sorted arrays of a block's projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, directions: int, seed: int) -> None:
        self.ids, self.rows = ids, rows
        self.lines = rotations(rows.shape[1], directions, seed)
        projected = (rows @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.arrays = np.take_along_axis(projected, self.order, axis=1)
        self.order = self.order.astype(np.int32)
        # squared distances are told by m directions out of dim; the rest is noise
        self.scale = rows.shape[1] / self.lines.shape[1]
        self.noise = 2 * max(0.0, 1 / self.lines.shape[1] - 1 / rows.shape[1])
        self.width = float(np.median(self.arrays[:, -1] - self.arrays[:, 0])) * 0.05 or 1.0
        self.verified = 0

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """Collisions of each row, over all arrays and steps, with a last half width `width`."""
        hits = np.zeros(len(self.ids), dtype=np.int32)
        half = width * np.sqrt(np.arange(1, STEPS + 1) / STEPS)
        gain = np.concatenate([np.arange(1, STEPS + 1), np.arange(STEPS - 1, 0, -1)]).astype(np.int32)
        for array, order, c in zip(self.arrays, self.order, centre, strict=True):
            low, high = np.searchsorted(array, c - half[::-1], side="left"), np.searchsorted(array, c + half, side="right")
            edges = np.concatenate([low, high])  # between them one step more, then one less
            hits[order[edges[0] : edges[-1]]] += np.repeat(gain, np.diff(edges))
        return hits

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest k found."""
        others = self.ids != query_id
        k = min(k, int(others.sum()))
        if not k:
            return self.ids[:0], np.zeros(0)
        centre, m, width = query @ self.lines, self.lines.shape[1], self.width
        distance = np.full(len(self.ids), np.inf)

        def verify(at: np.ndarray) -> None:
            self.verified += len(at)
            distance[at] = np.sqrt(((self.rows[at] - query) ** 2).sum(axis=1))

        while True:
            hits = np.where(others, self.collisions(centre, width), -1)
            most = np.argpartition(-hits, k - 1)[:k]
            verify(most[np.isinf(distance[most])])
            reached = np.partition(distance, k - 1)[k - 1]
            told = width * np.sqrt(self.scale * m)
            if reached * REACH <= told or not width or ((hits[others] > 0).all() and told > 8 * reached):
                break
            width *= RATIO
        unit = self.scale * width * width / STEPS  # of squared distance for a collision missed
        spread = np.sqrt(unit * unit * m / 12 + reached**4 * self.noise)
        # told squared distance: unit * (m * (STEPS + 0.5) - hits) <= reached**2 + MARGIN * spread
        threshold = m * (STEPS + 0.5) - (reached**2 + MARGIN * spread) / max(unit, np.finfo(np.float64).tiny)
        # never above what the best k have, so that equal rows share their fate
        threshold = min(threshold, hits[distance <= reached].min())
        verify(np.flatnonzero(others & (hits >= threshold) & np.isinf(distance)))
        # the next query begins one layout below
        self.width = max(width / RATIO, np.finfo(np.float64).tiny)
        top = np.flatnonzero(np.isfinite(distance))
        top = top[np.lexsort((self.ids[top], distance[top]))[:k]]
        return self.ids[top], distance[top]


def _kernel(k: int, directions: int, seed: int):
    def run(numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = Index(ids, rows, directions, seed)
        found = [(n, *index.search(i, q, k)) for n, i, q in zip(numbers, query_ids, queries, strict=True)]
        return np.repeat([n for n, *_ in found], [len(v) for _, v, _ in found]), np.concatenate([v for _, v, _ in found]), np.concatenate([d for *_, d in found])

    return run


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, directions: int = DIRECTIONS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found, by Euclidean
    distance in double precision on the original vectors, ties to the smaller vec_id.

    `vectors` and `queries` are (vec_id, embedding). Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do rows with a null vec_id; vectors of another
    length than a query's aren't its candidates; rows with a query's vec_id aren't either. Every
    row of `queries` is a query of its own, so a repeated vec_id gives its ranks once for each;
    rows of `vectors` that repeat a vec_id are a candidate each. Every row is indexed, in blocks;
    a query asks every block. An empty table gives an empty result. Other columns, whatever their
    names, are ignored.
    """
    usable = finite("embedding") & F.exists("embedding", lambda x: x != 0)
    clean = lambda df: df.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    out = nearest(clean(vectors), clean(queries), k, _kernel(k, directions, seed), True, BLOCK_ROWS, BLOCK_QUERIES, LEAST_CELLS)
    return out.withColumnRenamed("value", "score")

"""Skeletons as graphs: nodes, and the branches between them in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import STRIDE, labelled, thinned
from .raster import RING, label_components, neighbour_count


def nodes(skeleton: DataFrame) -> DataFrame:
    """(image_id, node_id, y, x, pixels, junction): a node is an 8-connected group of pixels that don't have
    just two neighbours; (y, x) is its centre, and it is a junction if a pixel has three or more.
    node_id is the smallest y * 65536 + x of its pixels."""
    counted = neighbour_count(skeleton).where("neighbours <> 2")
    grouped = label_components(counted).groupBy("image_id", F.col("comp_id").alias("node_id"))
    return grouped.agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("pixels"), F.bool_or(F.col("neighbours") >= 3).alias("junction"))


def neighbour_table(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(n, 8) numbers of each pixel's neighbours in row order, -1 where there is none. Pixels are sorted by (y, x)."""
    key = y * STRIDE + x
    near = key[:, None] + np.array([a * STRIDE + b for a, b in RING])[None, :]
    at = np.minimum(np.searchsorted(key, near), len(key) - 1)
    return np.where(key[at] == near, at, -1)


def walked(y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The branches of one skeleton, as numbers of its pixels (sorted by y, x): chains of pixels with two neighbours,
    between the node pixels at their ends, from the smaller end on; and rings without nodes of three
    pixels or more, closed by their first pixel. In order of their first two pixels, rings last.

    Walking is pointer jumping: a step is a pixel and the side it is entered from, and all steps learn
    at once how far the end of their chain is, in as many rounds as the logarithm of the longest.
    """
    if not len(y):
        return []
    near = neighbour_table(y, x)
    inner = (near >= 0).sum(axis=1) == 2
    pixel = np.flatnonzero(inner)
    number = np.full(len(y), -1)
    number[pixel] = np.arange(len(pixel))
    ends = near[pixel][near[pixel] >= 0].reshape(-1, 2)
    # step 2 v + side: pixel v entered from ends[v, side], left by the other one
    steps = np.arange(2 * len(pixel))
    v, side = steps // 2, steps % 2
    onward = ends[v, 1 - side]
    to = number[onward]
    goes = to >= 0
    follow = np.where(goes, 2 * to + (ends[np.maximum(to, 0), 1] == pixel[v]), steps)
    far, jump = goes.astype(np.int64), follow.copy()
    for _ in range(max(1, int(np.ceil(np.log2(len(steps) + 1))))):
        far, jump = far + far[jump], jump[jump]
    last = ~goes[jump]  # its chain has an end, it isn't a ring
    entered = ends[v, side]
    starts = steps[last & (number[entered] < 0)]
    # of a chain's two directions the one from the smaller end; if both ends are the same, from the smaller neighbour
    begin, first, stop, final = entered[starts], pixel[v[starts]], onward[jump[starts]], pixel[v[jump[starts]]]
    forward = (begin < stop) | (begin == stop) & (first <= final)
    single = (begin == stop) & (first == final)
    starts = starts[forward & (~single | (side[starts] == 0))]
    starts = starts[np.lexsort((pixel[v[starts]], entered[starts]))]
    chain = np.full(len(steps), -1)
    chain[jump[starts]] = np.arange(len(starts))
    of = np.where(last, chain[jump], -1)
    own = np.flatnonzero(of >= 0)
    own = own[np.lexsort((-far[own], of[own]))]
    cuts = np.searchsorted(of[own], np.arange(len(starts) + 1))
    found = [np.concatenate([[entered[s]], pixel[v[own[a:b]]], [onward[jump[s]]]]) for s, a, b in zip(starts, cuts[:-1], cuts[1:], strict=True)]
    for s in _ring_starts(steps, follow, last, v):
        ring, at = [], s
        while not ring or at != s:
            ring.append(at)
            at = follow[at]
        if len(ring) >= 3:
            found.append(np.append(pixel[v[ring]], pixel[v[s]]))
    return found


def _ring_starts(steps: np.ndarray, follow: np.ndarray, last: np.ndarray, v: np.ndarray) -> list[int]:
    """The first pixel's step of every ring: entered from its first neighbour, so left by the other one."""
    open_ = steps[~last]
    if not len(open_):
        return []
    least, jump = v.copy(), follow.copy()
    for _ in range(int(np.ceil(np.log2(len(steps) + 1)))):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    return [int(s) for s in open_ if least[s] == v[s] and s % 2 == 0]


def branches(skeleton: DataFrame, by: str = "image_id") -> DataFrame:
    """(`by`, branch, i, y, x) of `skeleton` (`by`, y, x): the points of each branch in order. One image
    (or component) is a group; pixels that repeat count once; isolated pixels have no branch."""

    def run(table: pa.Table) -> pa.Table:
        key = np.unique(table.column("y").to_numpy() * STRIDE + table.column("x").to_numpy())
        y, x = key // STRIDE, key % STRIDE
        paths = walked(y, x)
        sizes = [len(p) for p in paths]
        flat = np.concatenate([np.zeros(0, np.int64), *paths])
        of = pa.array([table.column(by)[0].as_py()] * len(flat), pa.int64())
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]])
        return pa.table([of, pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(place), pa.array(y[flat]), pa.array(x[flat])], [by, "branch", "i", "y", "x"])

    return skeleton.select(F.col(by).cast("long").alias(by), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).groupBy(by).applyInArrow(run, f"{by} long, branch long, i long, y long, x long")


def graph(mask: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Of one component's mask: the branches of its skeleton as (n, 2) arrays of (y, x); the centres (y, x) of its
    junctions; and their number. A node is an 8-connected group of skeleton pixels that don't have
    just two neighbours, a junction one with a pixel of three or more."""
    thin = thinned(mask)
    y, x = np.nonzero(thin)
    if not len(y):
        return [], np.zeros((0, 2)), 0
    degree = (neighbour_table(y, x) >= 0).sum(axis=1)
    node = np.zeros(mask.shape, dtype=bool)
    node[y, x] = degree != 2
    of = labelled(node).grid(mask.shape)
    group = of[y, x]
    at = np.flatnonzero(group >= 0)
    names, where = np.unique(group[at], return_inverse=True)
    size = np.bincount(where, minlength=len(names))
    centres = np.stack([np.bincount(where, weights=c[at], minlength=len(names)) / np.maximum(size, 1) for c in (y, x)], axis=1)
    junction = np.bincount(where, weights=degree[at] >= 3, minlength=len(names)) > 0
    return [np.stack([y[p], x[p]], axis=1) for p in walked(y, x)], centres[junction], int(junction.sum())

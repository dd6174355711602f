"""Distances to the edge and widths across a path, sampled between pixels, on rasters in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import PLACE, SIDE, Window, over_points, pasted
from .polyline import tangents

#: The step of the search across a path, and the least and greatest radius (pixels).
STEP, LEAST, MOST = 0.25, 3.0, 64.0


def down_columns(mask: np.ndarray) -> np.ndarray:
    """Of every set cell the distance to the nearest one in its column that isn't set; without any, more than
    any distance in the grid."""
    h, w = mask.shape
    out = np.where(mask, h + w + 65536, 0).astype(np.int64)
    for y in range(1, h):
        np.minimum(out[y], out[y - 1] + 1, out=out[y])
    for y in range(h - 2, -1, -1):
        np.minimum(out[y], out[y + 1] + 1, out=out[y])
    return out


#: Steps to both sides that are tried for each cell before whole rows are; and tries for each cell of the raster at most.
NEAR, TRIES = 48, 2


def along_rows(column: np.ndarray) -> np.ndarray:
    """Squared distances from distances down the columns. Cells of thin lines find theirs within NEAR steps; rows
    with cells that don't are taken whole. So time is linear in the cells."""
    h, w = column.shape
    wide = np.full((h, w + 2 * NEAR), np.inf)
    wide[:, NEAR : NEAR + w] = column
    wide *= wide
    flat = wide.ravel()
    live = np.flatnonzero((flat > 1) & (flat < np.inf))
    best = flat[live]
    out, tries = wide.copy().ravel(), 0
    for k in range(1, NEAR + 1):
        tries += len(live)
        if tries > TRIES * h * w:
            break
        np.minimum(best, np.minimum(flat[live - k], flat[live + k]) + k * k, out=best)
        done = best <= (k + 1) ** 2
        out[live[done]] = best[done]
        live, best = live[~done], best[~done]
    out = out.reshape(wide.shape)[:, NEAR : NEAR + w]
    left = np.unique(live // wide.shape[1])
    if len(left):
        out[left] = envelopes(column[left])
    return out


def envelopes(column: np.ndarray) -> np.ndarray:
    """The same for whole rows: the lower envelope of the parabolas over their cells (Meijster, Roerdink and
    Hesselink 2000), for all rows at once and in time linear in their length."""
    h, w = column.shape
    squares = np.ascontiguousarray(column.T).astype(np.float64) ** 2
    rows = np.arange(h)
    # stacks of each row: the cell whose parabola is lowest, its value there, and from where on; the top is kept apart
    stack = [np.zeros(w * h) for _ in range(3)]
    depth, site, value, start = np.zeros(h, dtype=np.int64), np.zeros(h), squares[0].copy(), np.zeros(h)
    for u in range(1, w):
        new = squares[u]
        live = np.flatnonzero((start - site) ** 2 + value > (start - u) ** 2 + new)
        gone = live[:0]
        while len(live):
            depth[live] -= 1
            empty = depth[live] < 0
            gone = np.concatenate([gone, live[empty]])
            live = live[~empty]
            at = depth[live] * h + live
            site[live], value[live], start[live] = (x[at] for x in stack)
            live = live[(start[live] - site[live]) ** 2 + value[live] > (start[live] - u) ** 2 + new[live]]
        site[gone] = -1  # before the row: the new parabola begins it
        from_ = np.floor((u * u - site * site + new - value) / (2 * (u - site))) + 1
        from_[gone] = 0
        put = rows if from_.max() < w and not len(gone) else np.flatnonzero(from_ < w)
        held = put[depth[put] >= 0] if len(gone) else put
        at = depth[held] * h + held
        for x, top in zip(stack, (site, value, start), strict=True):
            x[at] = top[held]
        depth[put] += 1
        site[put], value[put], start[put] = u, new[put], from_[put]
    out = np.empty((w, h))
    for u in range(w - 1, -1, -1):
        out[u] = (u - site) ** 2 + value
        back = np.flatnonzero((start == u) & (depth > 0))
        if len(back):
            depth[back] -= 1
            at = depth[back] * h + back
            site[back], value[back], start[back] = (x[at] for x in stack)
    return out.T


def edge_distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every set cell to the nearest one that isn't set; at most the diagonal."""
    out = np.zeros(mask.shape)
    some = np.flatnonzero(mask.any(axis=1))
    if len(some):
        out[some] = np.minimum(np.sqrt(along_rows(down_columns(mask)[some])), float(np.hypot(*mask.shape)))
    return out


def _one_piece(table: pa.Table, y: int, x: int, by: int, bx: int, values: np.ndarray) -> list:
    image, height, width = (table.column(c)[0].as_py() for c in ("image_id", "height", "width"))
    return [image, height, width, by, bx, y, x, *values.shape, values.ravel()]


def _pieces(rows: list[list]) -> pa.Table:
    names = [f.split()[0] for f in PLACE.split(", ")]
    columns = list(zip(*rows, strict=True))
    ends = np.cumsum([0, *map(len, columns[-1])])
    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns[-1])))
    return pa.table([pa.array(list(c), pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(columns[:-1])] + [values], [*names, "values"])


def distances(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """Blocks of the distance of every set cell to the nearest one of its image that isn't set, from blocks of
    masks (values: 0 or 1). Exact, at most the image's diagonal; blocks that are missing aren't set.

    A task holds a column of blocks, then a row of blocks with what the columns have told; so two
    shuffles of blocks, and never an image."""

    def columns(table: pa.Table) -> pa.Table:
        height, width, bx = (table.column(c)[0].as_py() for c in ("height", "width", "bx"))
        left, right = bx * side, min(width, (bx + 1) * side)
        down = down_columns(pasted(table, "values", 0, left, (height, right - left)).astype(bool))
        blocks = sorted(set(table.column("by").to_pylist()))
        return _pieces([_one_piece(table, by * side, left, by, bx, down[by * side : (by + 1) * side].astype(np.int32)) for by in blocks])

    def rows(table: pa.Table) -> pa.Table:
        height, width, by = (table.column(c)[0].as_py() for c in ("height", "width", "by"))
        top, bottom = by * side, min(height, (by + 1) * side)
        down = pasted(table, "values", top, 0, (bottom - top, width))
        found = np.minimum(np.sqrt(along_rows(down)), float(np.hypot(height, width)))
        blocks = sorted(set(table.column("bx").to_pylist()))
        return _pieces([_one_piece(table, top, bx * side, by, bx, found[:, bx * side : (bx + 1) * side]) for bx in blocks])

    down = masks.select(*[f.split()[0] for f in PLACE.split(", ")], "values").groupBy("image_id", "bx").applyInArrow(columns, f"{PLACE}, values array<int>")
    return down.groupBy("image_id", "by").applyInArrow(rows, f"{PLACE}, values array<double>")


def sample(grid: np.ndarray, y: np.ndarray, x: np.ndarray, beyond: float | None) -> np.ndarray:
    """Bilinear values at (y, x). beyond: the value outside the grid, None: that of the nearest pixel."""
    h, w = grid.shape
    if beyond is None:
        y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    top, left = np.floor(y).astype(int), np.floor(x).astype(int)
    down, right = y - top, x - left

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        return np.where(inside, grid[np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)], 0.0 if beyond is None else beyond)

    upper = at(top, left) * (1 - right) + at(top, left + 1) * right
    lower = at(top + 1, left) * (1 - right) + at(top + 1, left + 1) * right
    found = upper * (1 - down) + lower * down
    return found if beyond is None else np.where((y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1), found, beyond)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(float) for c in names]


def sampled(points: DataFrame, pieces: DataFrame, images: DataFrame, beyond: float | None = 0.0, side: int = SIDE) -> DataFrame:
    """`points` (image_id, y, x, ..) with the bilinear value of the blocks' `values` as `sampled`; pieces need a halo of
    1. images: (image_id, height, width). Outside the image: `beyond`, or with None the nearest pixel's value."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields]
    names = points.columns

    def kernel(table: pa.Table, w: Window) -> pa.Table:
        y, x = _columns(table, "y", "x")
        inside = (y >= 0) & (y <= w.height - 1) & (x >= 0) & (x <= w.width - 1)
        found = sample(w.cells["values"].astype(float), np.clip(y, 0, w.height - 1) - w.y, np.clip(x, 0, w.width - 1) - w.x, None)
        return table.select(names).append_column("sampled", pa.array(found if beyond is None else np.where(inside, found, beyond)))

    with_size = points.join(images.select("image_id", "height", "width"), "image_id")
    return over_points(with_size, pieces, kernel, ", ".join([*kept, "sampled double"]), side, 1).select(*names, "sampled")


def widths_from_distance(points: DataFrame, distance_pieces: DataFrame, images: DataFrame, side: int = SIDE) -> DataFrame:
    """`points` with width_px: twice the distance to the edge there, clipped to the image."""
    return sampled(points, distance_pieces, images, None, side).withColumn("width_px", 2 * F.col("sampled")).drop("sampled")


def edge_offset(values: np.ndarray, offsets: np.ndarray, threshold: np.ndarray, radius: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the values along each row first fall below its threshold, by linear interpolation with the value
    before (1 at the start). Offsets beyond the radius end the search there; where all up to the
    row's last one stay above, the radius."""
    n, steps = values.shape
    if not steps:
        return radius.copy()
    ends = ((values < threshold[:, None]) | (offsets > radius[:, None])) & (offsets <= last[:, None])
    first, rows = ends.argmax(axis=1), np.arange(n)
    before = np.concatenate([np.ones((n, 1)), values], axis=1)[rows, first]
    start = np.concatenate([[0.0], offsets])[first]
    fall = before - values[rows, first]
    steep = np.abs(fall) > 1e-9
    part = np.clip(np.where(steep, (before - threshold) / np.where(steep, fall, 1.0), 0.0), 0.0, 1.0)
    return np.maximum(np.where(ends.any(axis=1), start + part * (offsets[first] - start), radius), 0.0)


def across(w: Window, y: np.ndarray, x: np.ndarray, ty: np.ndarray, tx: np.ndarray, radius: np.ndarray, last: np.ndarray, threshold: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
    """Widths at right angles to the tangents (ty, tx). Outside a point's box (y0, x0, y1, x1; half-open) values are 0."""
    offsets = STEP * np.arange(1, int(round(last.max(initial=0.0) / STEP)) + 1)
    grid, (y0, x0, y1, x1) = w.cells["values"].astype(float), (c[:, None] for c in box)
    total = np.zeros(len(y))
    for s in (1, -1):
        sy, sx = y[:, None] + s * tx[:, None] * offsets, x[:, None] - s * ty[:, None] * offsets
        inside = (sy >= y0) & (sy <= y1 - 1) & (sx >= x0) & (sx <= x1 - 1)
        values = np.where(inside, sample(grid, sy - w.y, sx - w.x, None), 0.0)
        total += edge_offset(values, offsets, threshold, radius, last)
    return total


#: Cells around a block that widths of its points may read: the greatest radius, a step and a pixel.
REACH = int(MOST) + 2


def widths_perpendicular(points: DataFrame, pieces: DataFrame, images: DataFrame, side: int = SIDE) -> DataFrame:
    """`points` with width_px: sub-pixel widths across the path, from the probabilities in `pieces`, which need a
    halo of REACH.

    points: (path_id, i, image_id, y, x, ..) with `coarse` (a width that tells how far to search) and `threshold`;
    optional y0, x0, y1, x1: the half-open box beyond which probabilities count as 0 (else the
    image). A path_id belongs to one path of all images. The search is as deep as the path's
    widest point needs; a point's own radius ends it before.
    """
    names = points.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    radius = F.least(F.greatest(1.5 * F.col("coarse") + 2, F.lit(LEAST)), F.lit(MOST))
    turned = points.withColumn("radius_", radius).withColumn("last_", F.ceil(F.max("radius_").over(W.partitionBy("path_id")) / STEP) * STEP)
    turned = turned.join(tangents(points), ["path_id", "i"]).join(images.select("image_id", "height", "width"), "image_id")
    has_box = "y0" in names

    def kernel(table: pa.Table, w: Window) -> pa.Table:
        y, x, ty, tx, radius, last, threshold = _columns(table, "y", "x", "ty", "tx", "radius_", "last_", "threshold")
        box = _columns(table, "y0", "x0", "y1", "x1") if has_box else [np.full(len(y), float(v)) for v in (0, 0, w.height, w.width)]
        found = across(w, y, x, ty, tx, radius, last, threshold, box)
        return table.select(names).append_column("width_px", pa.array(found))

    return over_points(turned.withColumn("last_", F.col("last_").cast("double")), pieces, kernel, f"{kept}, width_px double", side, REACH)

"""Rasters as tiled blocks with halos.

A piece is a rectangle of cells, row by row, that belongs to a block's window: (image_id, height, width,
by, bx, y, x, h, w, values). Height and width are the image's, so images of any sizes share a table;
(by, bx) numbers the block, (y, x) is the piece's first cell. A block's window is the block and a halo
around it, as far as the image goes. Windows are put together from pieces in one shuffle by (image_id,
by, bx), where a halo costs its own cells only; a task never holds more than a window, however
large the image is. Cells that no piece covers are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Cells along the side of a block.
SIDE = 512
#: comp_id is y * STRIDE + x of a component's first pixel; sides of images are below it.
STRIDE = 65536
PLACE = "image_id long, height int, width int, by int, bx int, y int, x int, h int, w int"
BLOCK = ["image_id", "by", "bx"]


@dataclass
class Window:
    image: int
    height: int
    width: int
    by: int
    bx: int
    y: int
    x: int
    cells: dict[str, np.ndarray]
    own: tuple[slice, slice]
    of: dict  # further columns of the image

    @property
    def corner(self) -> tuple[int, int]:
        """Where the block itself begins in the image."""
        return self.y + self.own[0].start, self.x + self.own[1].start

    def inside(self, grid: np.ndarray) -> np.ndarray:
        """The block's own cells of a grid over the window."""
        return grid[self.own]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def pasted(table: pa.Table, name: str, top: int, left: int, shape: tuple[int, ...]) -> np.ndarray:
    """The cells of a table's pieces on a grid whose first cell is (top, left); a third side holds a cell's channels."""
    ends, flat = _flat(table.column(name))
    grid = np.zeros(shape, dtype=flat.dtype)
    place = np.stack([table.column(c).to_numpy() for c in ("y", "x", "h", "w")], axis=1).tolist()
    for (y, x, h, w), a, b in zip(place, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        grid[y - top : y - top + h, x - left : x - left + w] = flat[a:b].reshape(h, w, *shape[2:])
    return grid


def window_of(table: pa.Table, side: int, halo: int, values: tuple[str, ...], of: pa.Table | None = None, keep: tuple[str, ...] = ()) -> Window:
    """The window of the pieces of one block, which the first row of `of` (or of the pieces) names."""
    image, height, width, by, bx = ((of or table).column(c)[0].as_py() for c in ("image_id", "height", "width", "by", "bx"))
    top, left = max(0, by * side - halo), max(0, bx * side - halo)
    bottom, right = min(height, (by + 1) * side + halo), min(width, (bx + 1) * side + halo)
    cells = {name: pasted(table, name, top, left, (bottom - top, right - left)) for name in values}
    own = (slice(by * side - top, min(height, (by + 1) * side) - top), slice(bx * side - left, min(width, (bx + 1) * side) - left))
    return Window(image, height, width, by, bx, top, left, cells, own, {c: table.column(c)[0].as_py() for c in keep})


def over_windows(pieces: DataFrame, kernel: Callable[[Window], pa.Table], schema: str, side: int = SIDE, halo: int = 0, values: tuple[str, ...] = ("values",), keep: tuple[str, ...] = ()) -> DataFrame:
    """`kernel` of every window; keep: columns of the image that it needs."""

    def run(table: pa.Table) -> pa.Table:
        return kernel(window_of(table, side, halo, values, keep=keep))

    return pieces.groupBy(*BLOCK).applyInArrow(run, schema)


def over_blocks(blocks: DataFrame, kernel: Callable[[Window], pa.Table], schema: str, side: int = SIDE, values: tuple[str, ...] = ("values",)) -> DataFrame:
    """`kernel` of every block where each is one row: without a shuffle."""
    names = [*(f.split()[0] for f in PLACE.split(", ")), *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from kernel(window_of(pa.Table.from_batches([b.slice(i, 1)]), side, 0, values)).to_batches()

    return blocks.select(*names).mapInArrow(run, schema)


def strips_to_pieces(strips: DataFrame, images: DataFrame, side: int = SIDE, halo: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of strips (image_id, y, x, values): runs of cells within a row, of images (image_id, height,
    width, and what `keep` names). A strip goes to every window that it crosses, cut to it."""
    s = strips.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "values").join(images.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), *keep), "image_id")

    def blocks(first: Column, last: Column, length: str) -> Column:
        low = F.greatest(F.lit(0), F.floor((first - halo) / side).cast("int"))
        return F.explode(F.sequence(low, F.least(F.floor((F.col(length) - 1) / side).cast("int"), F.floor((last + halo) / side).cast("int"))))

    s = s.where(F.size("values") > 0).withColumn("by", blocks(F.col("y"), F.col("y"), "height")).withColumn("bx", blocks(F.col("x"), F.col("x") + F.size("values") - 1, "width"))
    start = F.greatest(F.col("x"), F.col("bx") * side - halo)
    stop = F.least(F.col("x") + F.size("values"), (F.col("bx") + 1) * side + halo, F.col("width"))
    s = s.withColumns({"start": start, "stop": stop})
    cut = F.slice("values", F.col("start") - F.col("x") + 1, F.col("stop") - F.col("start"))
    return s.select("image_id", "height", "width", "by", "bx", "y", F.col("start").alias("x"), F.lit(1).alias("h"), (F.col("stop") - F.col("start")).alias("w"), cut.alias("values"), *keep)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def over_points(points: DataFrame, pieces: DataFrame, kernel: Callable[[pa.Table, Window], pa.Table], schema: str, side: int = SIDE, halo: int = 0) -> DataFrame:
    """`kernel` of the points (.., image_id, y, x, height, width) whose pixel lies in a block, and its window. Points
    outside their image go to the nearest block; a window without pieces is 0."""
    near = lambda c, length: (F.least(F.greatest(F.floor(c), F.lit(0)), F.col(length) - 1) / side).cast("int")
    placed = points.withColumns({"by": near("y", "height"), "bx": near("x", "width")})

    none = arrow_schema(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(left, window_of(right, side, halo, ("values",), left)).cast(none.schema) if len(left) else none

    return placed.groupBy(*BLOCK).cogroup(pieces.groupBy(*BLOCK)).applyInArrow(run, schema)


def block_table(w: Window, **grids: np.ndarray) -> pa.Table:
    """A block's own cells as one piece."""
    y, x = w.corner
    h, n = next(iter(grids.values())).shape
    place = [w.image, w.height, w.width, w.by, w.bx, y, x, h, n]
    kinds = [pa.int64(), *[pa.int32()] * 8]
    names = [f.split()[0] for f in PLACE.split(", ")]
    columns = [pa.array([v], k) for v, k in zip(place, kinds, strict=True)]
    for name, grid in grids.items():
        flat = pa.array(np.ascontiguousarray(grid).ravel())
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        names.append(name)
    return pa.table(columns, names)


def pixel_table(w: Window, mask: np.ndarray, **grids: np.ndarray) -> pa.Table:
    """(image_id, y, x, ..) of the set cells among the block's own."""
    y, x = np.nonzero(mask)
    columns = [pa.array(np.full(len(y), w.image)), pa.array(y + w.corner[0]), pa.array(x + w.corner[1]), *[pa.array(g[y, x]) for g in grids.values()]]
    return pa.table(columns, ["image_id", "y", "x", *grids])


def with_halo(blocks: DataFrame, side: int, halo: int, values: str = "values") -> DataFrame:
    """Pieces of blocks (one piece each): every block, and what its neighbours' halos need of it."""
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            ends, flat = _flat(pa.chunked_array([b.column(values)]))
            for i, place in enumerate(zip(*[b.column(c).to_pylist() for c in ("image_id", "height", "width", "by", "bx", "y", "x", "h", "w")], strict=True)):
                image, height, width, by, bx, y, x, h, w = place
                grid = flat[ends[i] : ends[i + 1]].reshape(h, w)
                for oy in range(max(0, (y - halo) // side), min((height - 1) // side, (y + h - 1 + halo) // side) + 1):
                    for ox in range(max(0, (x - halo) // side), min((width - 1) // side, (x + w - 1 + halo) // side) + 1):
                        t, l = max(y, oy * side - halo), max(x, ox * side - halo)
                        part = grid[t - y : (oy + 1) * side + halo - y, l - x : (ox + 1) * side + halo - x]
                        if part.size:
                            rows.append((image, height, width, oy, ox, t, l, *part.shape))
                            parts.append(part.ravel())
            columns = [pa.array(list(c), pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64() if k == 0 else pa.int32()) for k in range(9)]
            whole = np.concatenate(parts) if parts else flat[:0]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(whole))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["image_id", "height", "width", "by", "bx", "y", "x", "h", "w", values])

    return blocks.select(*[f.split()[0] for f in PLACE.split(", ")], values).mapInArrow(run, f"{PLACE}, {values} {fields[values]}")


# stencils on grids


def shifted(grid: np.ndarray, dy: int, dx: int, beyond: bool | int = 0) -> np.ndarray:
    """out[y, x] = grid[y + dy, x + dx], `beyond` outside."""
    h, w = grid.shape
    out = np.full_like(grid, beyond)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = grid[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def dilated3(mask: np.ndarray) -> np.ndarray:
    wide = mask | shifted(mask, 0, 1) | shifted(mask, 0, -1)
    return wide | shifted(wide, 1, 0) | shifted(wide, -1, 0)


def closed3(mask: np.ndarray) -> np.ndarray:
    """Dilation, then erosion by 3x3; what lies outside the grid is ignored."""
    return ~dilated3(~dilated3(mask))


def disc_dilated(mask: np.ndarray) -> np.ndarray:
    """By a disc of radius two: three rows of five cells, and one cell above and below."""
    five = mask.copy()
    for d in (-2, -1, 1, 2):
        five |= shifted(mask, 0, d)
    return five | shifted(five, 1, 0) | shifted(five, -1, 0) | shifted(mask, 2, 0) | shifted(mask, -2, 0)


def neighbours8(mask: np.ndarray) -> np.ndarray:
    m = mask.astype(np.int8)
    wide = m + shifted(m, 0, 1) + shifted(m, 0, -1)
    return wide + shifted(wide, 1, 0) + shifted(wide, -1, 0) - m


@dataclass
class Labels:
    """Runs of set cells by rows (y, x0 to x1), and for each the number of its component's first run."""

    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    root: np.ndarray

    def grid(self, shape: tuple[int, int]) -> np.ndarray:
        """Number of the component's first run, -1 where no cell is set."""
        out = np.full(shape, -1, dtype=np.int64)
        size = self.x1 - self.x0
        at = np.repeat(self.y * shape[1] + self.x0 - np.cumsum(size) + size, size) + np.arange(size.sum())
        out.ravel()[at] = np.repeat(self.root, size)
        return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each by links a-b: roots hook on smaller ones, then paths are halved."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not (root[root] == root).all():
            root = root[root]


def labelled(mask: np.ndarray, connected: int = 8) -> Labels:
    """8- or 4-connected components of a grid."""
    h, w = mask.shape
    edge = np.zeros((h, w + 2), dtype=np.int8)
    edge[:, 1:-1] = mask
    change = np.diff(edge, axis=1)
    y, x0 = np.nonzero(change == 1)
    x1 = np.nonzero(change == -1)[1]
    reach, stride = connected == 8, w + 2
    # runs of the next row that touch a run: those that end after its start and start before its end
    low = np.searchsorted(y * stride + x1, (y + 1) * stride + x0 - reach, side="right")
    high = np.searchsorted(y * stride + x0, (y + 1) * stride + x1 + reach, side="left")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return Labels(y, x0, x1, joined(np.arange(len(y)), a, b))


def without_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Holes of at most `most` cells (4-connected) filled."""
    holes = labelled(~mask, 4)
    size = np.bincount(holes.root, weights=holes.x1 - holes.x0, minlength=len(holes.root))
    of = holes.grid(mask.shape)
    return mask | (of >= 0) & (np.append(size, 0)[of] <= most)


def thinned(grid: np.ndarray) -> np.ndarray:
    """Centre lines of a mask (Zhang and Suen 1984)."""
    grid = np.pad(grid, 1)
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            # only set cells with an unset neighbour can go
            y, x = np.nonzero(grid)
            n = np.stack([grid[y + a, x + b] for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]).astype(np.int8)
            total, turns = n.sum(axis=0), ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(axis=0)
            up, right, down, left = n[0] > 0, n[2] > 0, n[4] > 0, n[6] > 0
            free = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
            drop = (total >= 2) & (total <= 6) & (turns == 1) & free
            changed |= bool(drop.any())
            grid[y[drop], x[drop]] = False
    return grid[1:-1, 1:-1]


# operators over blocks


def _thresholded(w: Window, threshold: float) -> np.ndarray:
    return w.cells["values"] >= threshold


def masks(pieces: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """Blocks of 1 where the value is at or above the threshold, else 0."""
    return over_windows(pieces, lambda w: block_table(w, values=w.inside(_thresholded(w, threshold)).astype(np.int8)), f"{PLACE}, values array<tinyint>", side)


def pixels_of(blocks: DataFrame) -> DataFrame:
    """(image_id, y, x, value) of every cell of pieces that don't overlap."""
    cell = blocks.select("image_id", "y", "x", "w", F.posexplode("values").alias("at", "value"))
    return cell.select("image_id", (F.col("y") + F.floor(F.col("at") / F.col("w"))).cast("long").alias("y"), (F.col("x") + F.col("at") % F.col("w")).cast("long").alias("x"), "value")


def dilate(pieces: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """(image_id, y, x) within a disc of radius two of cells at or above the threshold. Pieces need a halo of 2."""
    return over_windows(pieces, lambda w: pixel_table(w, w.inside(disc_dilated(_thresholded(w, threshold)))), "image_id long, y long, x long", side, 2)


def close3x3(pieces: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """(image_id, y, x) of the cells at or above the threshold, closed by 3x3. Pieces need a halo of 2."""
    return over_windows(pieces, lambda w: pixel_table(w, w.inside(closed3(_thresholded(w, threshold)))), "image_id long, y long, x long", side, 2)


def neighbour_count(pieces: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """(image_id, y, x, neighbours): set cells among the 8 neighbours of each set cell. Pieces need a halo of 1."""

    def kernel(w: Window) -> pa.Table:
        mask = _thresholded(w, threshold)
        return pixel_table(w, w.inside(mask), neighbours=w.inside(neighbours8(mask)).astype(np.int64))

    return over_windows(pieces, kernel, "image_id long, y long, x long, neighbours long", side, 1)


def hole_size(min_area: int) -> int:
    """Cells of the largest hole that cleaning fills; 0: none."""
    return max(4, min_area // 4) if min_area > 1 else 0


def clean_halo(min_area: int) -> int:
    """A hole of n cells that touches a cell lies within n of it, so this many cells around a block decide."""
    return hole_size(min_area) + 2


def cleaned(w: Window, mask: np.ndarray, min_area: int) -> np.ndarray:
    """The block's own cells with small holes filled, then closed by 3x3."""
    most = hole_size(min_area)
    return w.inside(closed3(without_holes(mask, most) if most else mask))


def clean_mask(pieces: DataFrame, threshold: float, min_area: int = 40, side: int = SIDE) -> DataFrame:
    """(image_id, y, x) of the cleaned mask: holes filled (if min_area is above 1), then closed by 3x3. Specks
    stay: components drop them. Pieces need a halo of `clean_halo`."""
    return over_windows(pieces, lambda w: pixel_table(w, cleaned(w, _thresholded(w, threshold), min_area)), "image_id long, y long, x long", side, clean_halo(min_area))


def mask_counts(pieces: DataFrame, thresholds: tuple[float, ...], truth: float, side: int = SIDE) -> DataFrame:
    """(image_id, threshold, tp, fp, fn, pred_hit, truth_hit) of the masks at or above each threshold against those
    at or above `truth`; hits are cells within two of the other mask. All thresholds are read from
    one window; sums of blocks are added up per image. Pieces need a halo of 2."""

    def kernel(w: Window) -> pa.Table:
        real = _thresholded(w, truth)
        near = w.inside(disc_dilated(real))
        own, rows = w.inside(real), []
        for t in thresholds:
            wide = _thresholded(w, t)
            pred = w.inside(wide)
            rows.append((w.image, t, int((pred & own).sum()), int((pred & ~own).sum()), int((~pred & own).sum()), int((pred & near).sum()), int((own & w.inside(disc_dilated(wide))).sum())))
        names = ["image_id", "threshold", "tp", "fp", "fn", "pred_hit", "truth_hit"]
        return pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)], names)

    counts = over_windows(pieces, kernel, "image_id long, threshold double, tp long, fp long, fn long, pred_hit long, truth_hit long", side, 2)
    return counts.groupBy("image_id", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "pred_hit", "truth_hit")])


def tolerant(counts: DataFrame) -> DataFrame:
    """`counts` of `mask_counts` with precision, recall and tolerant_f1, at a tolerance of two cells."""
    p, r = F.col("pred_hit") / (F.col("tp") + F.col("fp") + 1e-7), F.col("truth_hit") / (F.col("tp") + F.col("fn") + 1e-7)
    return counts.withColumns({"precision": p, "recall": r}).withColumn("tolerant_f1", F.when(F.col("precision") + F.col("recall") < 1e-7, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def skeleton_lengths(pieces: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(image_id, threshold, area, length): cells and centre-line cells of the masks at or above each threshold. Thinning
    reaches as far as a line is wide, so an image is one group here: its rows are read once for all
    thresholds, and its size is that of evaluation images (pieces without halo, of any side)."""

    def run(table: pa.Table) -> pa.Table:
        image, height, width = (table.column(c)[0].as_py() for c in ("image_id", "height", "width"))
        grid, rows = pasted(table, "values", 0, 0, (height, width)), []
        for t in thresholds:
            mask = grid >= t
            rows.append((image, t, int(mask.sum()), int(thinned(mask).sum()) if mask.any() else 0))
        return pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)], ["image_id", "threshold", "area", "length"])

    return pieces.groupBy("image_id").applyInArrow(run, "image_id long, threshold double, area long, length long")


PARTS = "image_id long, part long, comp_id long, area long, y0 long, x0 long, y1 long, x1 long, total double"


def _parts(w: Window, mask: np.ndarray, value: np.ndarray) -> pa.Table:
    """Components of a block's own cells. Those that reach a border to another block have `part` -1 and their
    border cells; all others are whole, and have the block's number."""
    found = labelled(mask)
    y0, x0 = w.corner
    names = [f.split()[0] for f in PARTS.split(", ")]
    if not len(found.root):
        kinds = [pa.float64() if n == "total" else pa.int64() for n in names]
        return pa.table([*[pa.array([], k) for k in kinds], pa.array([], pa.list_(pa.int64()))], [*names, "border"])
    heads = np.flatnonzero(found.root == np.arange(len(found.root)))
    order = np.argsort(found.root, kind="stable")
    starts = np.searchsorted(found.root[order], heads)
    y, a, b = found.y[order], found.x0[order], found.x1[order]
    sums = np.zeros((value.shape[0], value.shape[1] + 1))
    np.cumsum(value, axis=1, out=sums[:, 1:])
    at = lambda f, v: f.reduceat(v, starts)
    columns = {"area": at(np.add, b - a), "y0": at(np.minimum, y) + y0, "x0": at(np.minimum, a) + x0, "y1": at(np.maximum, y) + y0 + 1, "x1": at(np.maximum, b) + x0, "total": at(np.add, sums[y, b] - sums[y, a])}
    h, n = mask.shape
    inner = np.zeros((h, n), dtype=bool)  # cells next to another block
    inner[0] |= y0 > 0
    inner[-1] |= y0 + h < w.height
    inner[:, 0] |= x0 > 0
    inner[:, -1] |= x0 + n < w.width
    grid = found.grid(mask.shape)
    by, bx = np.nonzero(inner & mask)
    of = np.searchsorted(heads, grid[by, bx])
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(heads) + 1))
    border = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((by[order] + y0) * STRIDE + bx[order] + x0))
    part = np.where(np.diff(ends) > 0, -1, w.by * (w.width // 1 + 1) + w.bx)
    label = (found.y[heads] + y0) * STRIDE + found.x0[heads] + x0
    return pa.table([pa.array(np.full(len(heads), w.image)), pa.array(part), pa.array(label), *[pa.array(c) for c in columns.values()], border], ["image_id", "part", "comp_id", *columns, "border"])


def _merged(table: pa.Table) -> pa.Table:
    """Parts of an image's components put together where their border cells touch."""
    names = ["image_id", "part", "comp_id", "area", "y0", "x0", "y1", "x1", "total"]
    if table.column("part")[0].as_py() != -1:
        return table.select(names)
    ends, cells = _flat(table.column("border"))
    owner = np.repeat(np.arange(len(table)), np.diff(ends))
    order = np.argsort(cells)
    cells, owner = cells[order], owner[order]
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for step in (1, STRIDE - 1, STRIDE, STRIDE + 1):
        near = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        hit = np.flatnonzero(cells[near] == cells + step)
        links.append((owner[hit], owner[near[hit]]))
    label = table.column("comp_id").to_numpy()
    order = np.argsort(label)  # so that the smallest number is the smallest label
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    root = joined(np.arange(len(order)), *(place[np.concatenate(z)] for z in zip(*links, strict=True)))
    by = np.argsort(root, kind="stable")
    heads, starts = np.unique(root[by], return_index=True)
    column = lambda c: table.column(c).to_numpy()[order][by]
    out = [pa.array(column("image_id")[starts]), pa.array(column("part")[starts]), pa.array(label[order][heads])]
    for c, f in (("area", np.add), ("y0", np.minimum), ("x0", np.minimum), ("y1", np.maximum), ("x1", np.maximum), ("total", np.add)):
        out.append(pa.array(f.reduceat(column(c), starts)))
    return pa.table(out, names)


def components(pieces: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """(image_id, comp_id, area, y0, x0, y1, x1, score) of the 8-connected components of the cells at or above the
    threshold: half-open boxes and mean values. comp_id is the smallest y * 65536 + x of a component.

    Every block labels its own cells. Only components that reach a block's border go on to the
    image, as one row with their border cells; there their parts are joined. So a group holds at most
    the cells along block borders, 2 / side of the image's, which the upload rules bound.
    """
    return merged_components(over_windows(pieces, lambda w: _parts(w, w.inside(_thresholded(w, threshold)), w.inside(w.cells["values"])), f"{PARTS}, border array<long>", side))


def merged_components(parts: DataFrame) -> DataFrame:
    whole = parts.groupBy("image_id", "part").applyInArrow(_merged, PARTS)
    return whole.select("image_id", "comp_id", "area", "y0", "x0", "y1", "x1", (F.col("total") / F.col("area")).alias("score"))

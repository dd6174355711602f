"""Prediction by segmenters: overlapping tiles of images of any size, blended back in blocks; and a ridge
filter that needs no learned weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as blk

#: A tile (tile, tile) or (tile, tile, channels) to probabilities (tile, tile).
Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Segmenter:
    """What predicts, and what a response says of it. threshold: the model's own, -1 without one."""

    name: str
    kind: str
    trained: bool
    predict: Predict
    tile: int = 512
    overlap: int = 64
    threshold: float = -1.0
    channels: int = 1
    note: str = ""


class Registry:
    """Segmenters by name. One that can't be made, or isn't there, is stood in for by the fallback, which answers
    but isn't trained."""

    def __init__(self, fallback: Segmenter) -> None:
        self.fallback, self.made, self.failed = fallback, {fallback.name: fallback}, {}

    def register(self, name: str, make: Callable[[], Segmenter]) -> None:
        try:
            self.made[name] = make()
            self.failed.pop(name, None)
        except Exception as error:  # whatever a model file may do: the others go on
            self.failed[name] = f"{type(error).__name__}: {error}"

    def get(self, name: str) -> Segmenter:
        return self.made.get(name, self.fallback)

    def others(self) -> list[str]:
        return sorted(n for n in self.made if n != self.fallback.name)


def tile_starts(first: Column, last: Column, length: Column, tile: int, overlap: int) -> Column:
    """The starts of the tiles that meet first..last on an axis. Tiles follow each other by tile - overlap as
    long as they fit; if they don't reach the end, one more is set there."""
    step, end = max(1, tile - overlap), F.greatest(F.lit(0), length - tile).cast("int")
    fit = F.floor(end / step).cast("int")  # number of the last one that fits
    low = F.greatest(F.lit(0), F.ceil((first - (tile - 1)) / step).cast("int"))
    high = F.least(fit, F.floor(last / step).cast("int"))
    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return F.when((end > fit * step) & (last >= end), F.concat(regular, F.array(end))).otherwise(regular)


def bell(size: int) -> np.ndarray:
    """Raised cosine without its zeros at the ends."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, size + 1) / (size + 1))


def predicted(strips: DataFrame, images: DataFrame, segmenter: Segmenter, side: int = blk.SIDE) -> DataFrame:
    """Blocks of the segmenter's probabilities of strips (image_id, y, x, values; channels side by side) of images
    (image_id, height, width).

    Strips are cut to the tiles that they meet; a task predicts a tile, which at an image's edge is
    filled up by reflection. What tiles say goes to blocks, weighted by a raised cosine of the
    place in the tile (0.001 at least): sum(p w) / sum(w). Cells without strips count as 0.
    """
    tile, n, overlap, predict = segmenter.tile, segmenter.channels, segmenter.overlap, segmenter.predict
    s = strips.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "values").join(images.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")), "image_id")
    s = s.withColumn("n", F.floor(F.size("values") / n).cast("int")).where("n > 0")
    s = s.withColumn("ty", F.explode(tile_starts(F.col("y"), F.col("y"), F.col("height"), tile, overlap))).withColumn("tx", F.explode(tile_starts(F.col("x"), F.col("x") + F.col("n") - 1, F.col("width"), tile, overlap)))
    s = s.withColumns({"start": F.greatest("x", "tx"), "stop": F.least(F.col("x") + F.col("n"), F.col("tx") + tile, F.col("width"))}).where("stop > start")
    s = s.withColumn("part", F.slice("values", (F.col("start") - F.col("x")) * n + 1, (F.col("stop") - F.col("start")) * n).cast("array<double>"))
    cut = s.select("image_id", "height", "width", "ty", "tx", "y", F.col("start").alias("x"), F.lit(1).alias("h"), (F.col("stop") - F.col("start")).alias("w"), F.col("part").alias("values"))
    schema = f"{blk.PLACE}, values array<double>, ty int, tx int"
    of = blk.arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        image, height, width, ty, tx = (table.column(c)[0].as_py() for c in ("image_id", "height", "width", "ty", "tx"))
        h, w = min(tile, height - ty), min(tile, width - tx)
        patch = blk.pasted(table, "values", ty, tx, (h, w) if n == 1 else (h, w, n))
        if h < tile or w < tile:
            patch = np.pad(patch, [(0, tile - h), (0, tile - w), (0, 0)][: patch.ndim], mode="reflect")
        p = np.asarray(predict(patch), dtype=np.float64)[:h, :w]
        rows = {f.name: [] for f in of}
        for by in range(ty // side, (ty + h - 1) // side + 1):
            for bx in range(tx // side, (tx + w - 1) // side + 1):
                y, x = max(ty, by * side), max(tx, bx * side)
                part = p[y - ty : (by + 1) * side - ty, x - tx : (bx + 1) * side - tx]
                for k, v in zip(rows, (image, height, width, by, bx, y, x, *part.shape, part.ravel(), ty, tx), strict=True):
                    rows[k].append(v)
        return pa.table(rows, schema=of)

    weight = np.maximum(np.outer(bell(tile), bell(tile)), 1e-3)

    def blend(table: pa.Table) -> pa.Table:
        w = blk.window_of(table.slice(0, 0), side, 0, (), table)
        shape = w.own[0].stop - w.own[0].start, w.own[1].stop - w.own[1].start
        total, weights = np.zeros(shape), np.zeros(shape)
        ends, flat = blk._flat(table.column("values"))
        for i, (y, x, h, n_, ty, tx) in enumerate(zip(*[table.column(c).to_pylist() for c in ("y", "x", "h", "w", "ty", "tx")], strict=True)):
            at = slice(y - w.y, y - w.y + h), slice(x - w.x, x - w.x + n_)
            share = weight[y - ty : y - ty + h, x - tx : x - tx + n_]
            total[at] += flat[ends[i] : ends[i + 1]].reshape(h, n_) * share
            weights[at] += share
        return blk.block_table(w, values=total / np.maximum(weights, 1e-6))

    tiles = cut.groupBy("image_id", "ty", "tx").applyInArrow(run, schema)
    return tiles.groupBy(*blk.BLOCK).applyInArrow(blend, f"{blk.PLACE}, values array<double>")


def block_strips(blocks: DataFrame) -> DataFrame:
    """Blocks as strips (image_id, y, x, values), a row of a block each."""
    row = F.explode(F.sequence(F.lit(0), F.col("h") - 1))
    r = blocks.withColumn("r", row)
    return r.select("image_id", (F.col("y") + F.col("r")).alias("y"), "x", F.slice("values", F.col("r") * F.col("w") + 1, F.col("w")).alias("values"))


# a segmenter without weights: dark ridges against their surroundings


def gaussian(sigma: float, order: int = 0, reach: float = 4.0) -> np.ndarray:
    """Taps of a Gaussian, or of its first or second derivative."""
    x = np.arange(-int(reach * sigma + 0.5), int(reach * sigma + 0.5) + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g = g / g.sum()
    return g if order == 0 else -x / sigma**2 * g if order == 1 else (x * x / sigma**4 - 1 / sigma**2) * g


#: Rows or columns that are filtered by one product.
STRIP = 64


def filtered(image: np.ndarray, down: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Convolution with taps down the columns and along the rows; beyond its edges the image is mirrored."""
    out = image
    for axis, taps in ((0, down), (1, along)):
        half, length = len(taps) // 2, out.shape[axis]
        at = np.abs(np.arange(-half, length + half))
        if length > 1:  # mirrored as often as it takes, without the edge itself
            at = at % (2 * length - 2)
            at = np.where(at >= length, 2 * length - 2 - at, at)
        else:
            at = np.zeros_like(at)
        wide, total = np.take(out, at, axis=axis), np.zeros(out.shape)
        if np.isfinite(out).all():  # a strip is a product with the taps as a band; its zeros would spread what isn't finite
            for a in range(0, length, STRIP):
                n = min(STRIP, length - a)
                band = np.zeros((n, n + len(taps) - 1))
                for i in range(n):
                    band[i, i : i + len(taps)] = taps[::-1]
                if axis == 0:
                    total[a : a + n] = band @ wide[a : a + band.shape[1]]
                else:
                    total[:, a : a + n] = wide[:, a : a + band.shape[1]] @ band.T
        else:
            for i, t in enumerate(taps[::-1]):
                total = total + t * (wide[i : i + length] if axis == 0 else wide[:, i : i + length])
        out = total
    return out


def equalised(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast limited adaptive equalisation (Pizer et al. 1987) of bytes: each tile's histogram, cut at `clip` times its mean
    and what is cut spread evenly, makes its levels; between tile centres levels are interpolated."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    tile = padded.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(t, minlength=256) for t in tile]).astype(np.int64)
    most = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for row, rest in zip(counts, over % 256, strict=True):  # what is left goes to levels at equal steps
        if rest:
            row[:: max(1, 256 // rest)][:rest] += 1
    levels = np.clip(np.rint(np.cumsum(counts, axis=1) * (255.0 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda v: np.clip(v, 0, tiles - 1)
    get = lambda a, b: levels[at(a)[:, None], at(b)[None, :], gray]
    top = get(y0, x0) * (1 - fx) + get(y0, x0 + 1) * fx
    bottom = get(y0 + 1, x0) * (1 - fx) + get(y0 + 1, x0 + 1) * fx
    return np.clip(np.rint(top * (1 - fy) + bottom * fy), 0, 255).astype(np.uint8)


def ridges(image: np.ndarray, sigmas: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0, 4.0)) -> np.ndarray:
    """How much of a bright ridge each cell is on: the greatest, over widths, of the curvature across it (the negative
    of the smaller eigenvalue of the Hessian, times the width squared), 0 where it isn't one."""
    best = np.zeros(image.shape)
    for s in sigmas:
        g, g1, g2 = (gaussian(s, k) for k in range(3))
        yy, xx, xy = filtered(image, g2, g), filtered(image, g, g2), filtered(image, g1, g1)
        smaller = (yy + xx) / 2 - np.hypot((yy - xx) / 2, xy)
        np.maximum(best, -smaller * s * s, out=best)
    return best


def dark_ridges(tile: np.ndarray) -> np.ndarray:
    """Probabilities of dark lines in a tile of bytes, gray or (red, green, blue): lighting taken out, contrast
    equalised, ridges from their 60th to their 99.5th percentile to 0..1; 0 where there is no range."""
    gray = tile if tile.ndim == 2 else tile @ np.array([0.299, 0.587, 0.114])
    gray = np.clip(np.rint(gray), 0, 255)
    flat = np.clip(gray - np.rint(filtered(gray, gaussian(25.0, reach=3.0), gaussian(25.0, reach=3.0))) + 128, 0, 255).astype(np.uint8)
    ridge = ridges((255 - equalised(flat)) / 255.0)
    low, high = np.percentile(ridge, [60.0, 99.5])
    if ridge.max() <= 1e-9 or high - low < 1e-9:
        return np.zeros(gray.shape)
    return np.clip((ridge - low) / (high - low), 0.0, 1.0)


CLASSIC = Segmenter("classic-ridge", "classic", False, dark_ridges, note="no learned weights: results are a makeshift")

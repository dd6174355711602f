"""Images brought to another size by the mean over areas, for any factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _flat

#: Rows of the result that a task makes together.
BAND = 64


def shares(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(result cell, cell, share): how much of each result cell lies over each cell, where `size` cells become `to`."""
    edges = np.unique(np.concatenate([np.arange(size + 1) * to, np.arange(to + 1) * size]))  # in parts of size * to
    start, length = edges[:-1], np.diff(edges)
    return start // size, start // to, length / size


def area_resampled(strips: DataFrame, images: DataFrame) -> DataFrame:
    """Strips (image_id, y, x, values; whole rows of the result) of the images (image_id, height, width, to_height,
    to_width), each cell the mean over its area: two sparse products, along the rows and down the columns.

    strips: (image_id, y, x, values). A group is BAND rows of the result and the rows that they lie
    over; a row at its border goes to both. Cells without strips count as 0."""
    s = strips.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("int").alias("x"), F.col("values").cast("array<double>").alias("values"))
    s = s.join(images.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("height", "width", "to_height", "to_width")]), "image_id")
    first = F.floor(F.col("y") * F.col("to_height") / F.col("height") / BAND + 1e-12)
    last = F.floor(((F.col("y") + 1) * F.col("to_height") - 1) / F.col("height") / BAND + 1e-12)
    s = s.withColumn("band", F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))))

    def run(table: pa.Table) -> pa.Table:
        image, height, width, to_height, to_width, band = (table.column(c)[0].as_py() for c in ("image_id", "height", "width", "to_height", "to_width", "band"))
        top, bottom = band * BAND, min(to_height, (band + 1) * BAND)
        out_y, in_y, share_y = shares(height, to_height)
        own = (out_y >= top) & (out_y < bottom)
        out_y, in_y, share_y = out_y[own], in_y[own], share_y[own]
        low = int(in_y[0])
        rows = np.zeros((int(in_y[-1]) - low + 1, width))
        ends, flat = _flat(table.column("values"))
        for y, x, a, b in zip(table.column("y").to_pylist(), table.column("x").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if 0 <= y - low < len(rows):
                rows[y - low, x : x + b - a] = flat[a:b]
        out_x, in_x, share_x = shares(width, to_width)
        heads = np.searchsorted(out_x, np.arange(to_width))
        along = np.add.reduceat(rows[:, in_x] * share_x, heads, axis=1)
        found = np.add.reduceat(along[in_y - low] * share_y[:, None], np.searchsorted(out_y, np.arange(top, bottom)), axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(bottom - top + 1) * to_width, pa.int32()), pa.array(found.ravel()))
        return pa.table([pa.array(np.full(bottom - top, image)), pa.array(np.arange(top, bottom, dtype=np.int32)), pa.array(np.zeros(bottom - top, np.int32)), lists], ["image_id", "y", "x", "values"])

    return s.groupBy("image_id", "band").applyInArrow(run, "image_id long, y int, x int, values array<double>")

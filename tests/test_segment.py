"""Tiled prediction of images of any size, the ridge filter's parts, the registry and evaluation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemetry.operators import blocks, instances, segment
from test_analysis import line, rasters


def predicted(spark, grids, model, side=512):
    strips, sizes = rasters(spark, grids)
    out = {k: np.full(g.shape[:2], np.nan) for k, g in grids.items()}
    for r in segment.predicted(strips, sizes, model, side).collect():
        out[r.image_id][r.y : r.y + r.h, r.x : r.x + r.w] = np.array(r["values"]).reshape(r.h, r.w)
    return out


SHAPES = [(100, 100), (256, 256), (300, 300), (512, 256), (700, 513), (128, 900)]


@pytest.mark.parametrize("side", [200, 512])
def test_every_cell_is_covered(spark, side):
    grids = {i: np.zeros(s) for i, s in enumerate(SHAPES)}
    found = predicted(spark, grids, segment.Segmenter("flat", "test", True, lambda t: np.full(t.shape, 0.7), 256, 64), side)
    assert all(abs(f - 0.7).max() < 1e-4 for f in found.values())


def test_tiles_leave_no_seam_and_are_mirrored(spark):
    ramp = {1: np.add.outer(np.arange(150.0), np.arange(90.0)), 2: np.add.outer(np.arange(40.0), np.arange(70.0))}
    seen = []

    def itself(tile):
        seen.append(tile.shape)
        return tile

    found = predicted(spark, ramp, segment.Segmenter("same", "test", True, itself, 64, 16), 50)
    assert all(abs(found[k] - g).max() < 1e-9 for k, g in ramp.items())
    corner = predicted(spark, {2: ramp[2]}, segment.Segmenter("last", "test", True, lambda t: np.full(t.shape, t[63, 0]), 64, 16))[2]
    assert corner[0, 0] == ramp[2][39 - (63 - 39), 0]  # 24 rows are missing: row 63 mirrors row 15


def test_blending_is_weighted(spark):
    """Each tile says its first value; where two overlap, what they say is weighted by the place in each."""
    grid = {1: np.tile(np.arange(48.0), (32, 1))}
    found = predicted(spark, grid, segment.Segmenter("first", "test", True, lambda t: np.full(t.shape, t[0, 0]), 32, 16))[1]
    w = np.maximum(segment.bell(32)[:, None] * segment.bell(32), 1e-3)
    assert abs(found[:, :16]).max() == 0 and abs(found[:, 32:] - 16).max() < 1e-9
    assert found[:, 16:32] == pytest.approx(16 * w[:, :16] / (w[:, :16] + w[:, 16:]))


def test_channels(spark):
    rows = [(1, y, 0, [float(v) for x in range(20) for v in (x, 10 * y, 7)]) for y in range(12)]
    strips = spark.createDataFrame(rows, "image_id long, y int, x int, values array<double>")
    sizes = spark.createDataFrame([(1, 12, 20)], "image_id long, height int, width int")
    model = segment.Segmenter("sum", "test", True, lambda t: t.sum(axis=2), 16, 4, channels=3)
    found = {(r.y, r.x): r.value for r in blocks.pixels_of(segment.predicted(strips, sizes, model)).collect()}
    assert all(found[y, x] == pytest.approx(x + 10 * y + 7) for y in range(12) for x in range(20))


def test_filters_by_force():
    rng = np.random.default_rng(0)
    image = rng.random((9, 14))
    mirror = lambda i, n: n - 1 - abs(n - 1 - (abs(i) % (2 * n - 2)))
    for s, k in ((1.0, 0), (1.5, 1), (2.0, 2), (5.0, 0)):
        a, b = segment.gaussian(s, k), segment.gaussian(s)
        ra, rb = len(a) // 2, len(b) // 2
        exact = np.array([[sum(a[ra + i] * b[rb + j] * image[mirror(y - i, 9), mirror(x - j, 14)] for i in range(-ra, ra + 1) for j in range(-rb, rb + 1)) for x in range(14)] for y in range(9)])
        assert np.allclose(segment.filtered(image, a, b), exact)
    assert segment.gaussian(3.0).sum() == pytest.approx(1) and (segment.gaussian(3.0, 1) * np.arange(-12, 13)).sum() == pytest.approx(-1, abs=0.01)


def test_equalising():
    flat = np.full((64, 64), 90, np.uint8)
    assert len(np.unique(segment.equalised(flat))) == 1
    rng = np.random.default_rng(1)
    dull = np.clip(rng.normal(128, 5, (96, 120)), 0, 255).astype(np.uint8)
    out = segment.equalised(dull)
    assert out.std() > 2 * dull.std() and np.corrcoef(dull.ravel(), out.ravel())[0, 1] > 0.9
    assert segment.equalised(np.zeros((5, 3), np.uint8)).shape == (5, 3)


def test_a_dark_line_answers_on_its_centre():
    rng = np.random.default_rng(2)
    shade = np.add.outer(np.zeros(160), np.linspace(120, 200, 160))
    tile = np.clip(shade - 70 * line(160, 160, (80, 0), (80, 159), 4) + rng.normal(0, 2, (160, 160)), 0, 255)
    p = segment.dark_ridges(tile)
    assert p.min() >= 0 and p.max() <= 1
    assert (abs(p[:, 20:140].argmax(axis=0) - 80) <= 1).mean() > 0.95
    assert p[79:82, 20:140].mean() > 3 * p[:60, 20:140].mean()
    assert abs(p - segment.dark_ridges(np.repeat(tile[:, :, None], 3, axis=2))).max() < 0.2
    assert segment.dark_ridges(np.full((64, 64), 100.0)).max() == 0
    bright = segment.ridges(line(80, 80, (40, 0), (40, 79), 4))
    assert bright[40].mean() > 5 * max(bright[20].mean(), 1e-9) and segment.ridges(1 - line(80, 80, (40, 0), (40, 79), 4))[40, 40] < bright[40, 40] / 5


def test_ridge_segments_of_drawn_lines(spark):
    image = 180 - 120 * line(150, 220, (30, 20), (120, 200), 4)
    found = predicted(spark, {1: image}, segment.CLASSIC)[1]
    on = line(150, 220, (30, 20), (120, 200), 2) > 0.9
    assert found[on].mean() > 0.6 and found[~(line(150, 220, (30, 20), (120, 200), 14) > 0)].mean() < 0.2


def test_registry():
    r = segment.Registry(segment.CLASSIC)

    def broken():
        raise FileNotFoundError("no weights")

    r.register("net", lambda: segment.Segmenter("net", "onnx", True, lambda t: t, threshold=0.9))
    r.register("lost", broken)
    assert r.get("net").threshold == 0.9 and not r.get("lost").trained and r.get("lost") is segment.CLASSIC and r.get("never") is segment.CLASSIC
    assert r.others() == ["net"] and "no weights" in r.failed["lost"]


def test_evaluation_of_all_thresholds(spark):
    """One pass equals a run for each threshold; the bias is of widths, not of areas."""
    grids = {1: line(80, 120, (40, 10), (40, 110), 6), 2: line(80, 90, (20, 10), (70, 80), 4), 3: np.zeros((40, 40))}
    strips, sizes = rasters(spark, grids)
    pieces = lambda halo: blocks.strips_to_pieces(strips, sizes, 32, halo)
    grid = (0.2, 0.5, 0.8)
    counts = blocks.tolerant(blocks.mask_counts(pieces(2), grid, 0.5, 32))
    one = [blocks.tolerant(blocks.mask_counts(pieces(2), (t,), 0.5, 32)) for t in grid]
    assert sorted(map(tuple, counts.collect())) == sorted(tuple(r) for c in one for r in c.collect())
    areas = blocks.skeleton_lengths(pieces(0), (*grid, 0.5))
    rows = {(r.image_id, r.threshold): r.width_bias for r in instances.with_width_bias(counts, areas, 0.5).collect()}
    for k in (1, 2):
        per = {t: (grids[k] >= t).sum() / blocks.thinned(grids[k] >= t).sum() for t in grid}
        assert all(rows[k, t] == pytest.approx(per[t] / per[0.5]) for t in grid)
        assert rows[k, 0.5] == 1
    assert math.isnan(rows[3, 0.5])
    found = instances.choose_threshold(instances.running(instances.with_width_bias(counts, areas, 0.5))).first()
    assert found.threshold == 0.5 and found.tolerant_f1 > 0.99

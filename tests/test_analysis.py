"""Blocks against whole images, distances and walks against brute force, and the whole analysis on drawn lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemetry.operators import analysis, blocks, instances, response, skeleton, width
from linemetry.operators.raster import RING


def rasters(spark, grids):
    """Strips and sizes of {image_id: grid}; rows are cut into runs of 37 cells."""
    rows = [(k, y, x, g[y, x : x + 37].tolist()) for k, g in grids.items() for y in range(len(g)) for x in range(0, g.shape[1], 37)]
    sizes = [(k, *g.shape) for k, g in grids.items()]
    return spark.createDataFrame(rows, "image_id long, y int, x int, values array<double>"), spark.createDataFrame(sizes, "image_id long, height int, width int")


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(4)
    soft = lambda h, w: sum(np.roll(rng.random((h, w)), (a, b), (0, 1)) for a in (0, 1) for b in (0, 1)) / 4
    return {1: soft(41, 70), 2: soft(33, 32), 3: soft(5, 120), 4: np.zeros((40, 40))}


def flooded(mask, near):
    """Components by search from pixel to pixel."""
    label, out = np.full(mask.shape, -1), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x] < 0:
            label[y, x], cells = len(out), [(y, x)]
            for a, b in cells:
                for dy, dx in near:
                    p = (a + dy, b + dx)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and label[p] < 0:
                        label[p] = len(out)
                        cells.append(p)
            out.append(cells)
    return out


def cleaned_by_force(mask, most):
    mask = mask.copy()
    for hole in flooded(~mask, [(0, 1), (1, 0), (0, -1), (-1, 0)]) if most else []:
        if len(hole) <= most:
            mask[tuple(np.array(hole).T)] = True
    h, w = mask.shape
    square = lambda f, m: np.array([[f(m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]) for x in range(w)] for y in range(h)])
    return square(np.all, square(np.any, mask))


def cells(df):
    return sorted((r.image_id, r.y, r.x) for r in df.collect())


@pytest.mark.parametrize("side", [7, 16, 512])
def test_blocks_equal_whole_images(spark, noise, side):
    strips, sizes = rasters(spark, noise)
    pieces = lambda halo: blocks.strips_to_pieces(strips, sizes, side, halo)
    masks = {k: g >= 0.5 for k, g in noise.items()}
    expected = lambda f: sorted((k, y, x) for k, m in masks.items() for y, x in zip(*map(lambda v: v.tolist(), np.nonzero(f(m))), strict=True))
    assert cells(blocks.close3x3(pieces(2), 0.5, side)) == expected(lambda m: cleaned_by_force(m, 0))
    assert cells(blocks.clean_mask(pieces(blocks.clean_halo(20)), 0.5, 20, side)) == expected(lambda m: cleaned_by_force(m, 5))
    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) < 2 or b == 0]
    grown = lambda m: np.array([[any(0 <= y + a < len(m) and 0 <= x + b < m.shape[1] and m[y + a, x + b] for a, b in disc) for x in range(m.shape[1])] for y in range(len(m))])
    assert cells(blocks.dilate(pieces(2), 0.5, side)) == expected(grown)
    counted = {(r.image_id, r.y, r.x): r.neighbours for r in blocks.neighbour_count(pieces(1), 0.5, side).collect()}
    assert counted == {(k, y, x): int(m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].sum()) - 1 for k, m in masks.items() for y, x in zip(*map(lambda v: v.tolist(), np.nonzero(m)), strict=True)}
    found = sorted(tuple(r)[:7] + (round(r.score, 9),) for r in blocks.components(pieces(0), 0.5, side).collect())
    parts = []
    for k, m in masks.items():
        for c in flooded(m, RING):
            y, x = np.array(c).T
            parts.append((k, min(a * 65536 + b for a, b in c), len(c), y.min(), x.min(), y.max() + 1, x.max() + 1, round(noise[k][y, x].mean(), 9)))
    assert found == sorted(tuple(p) for p in parts)
    scores = {r.image_id: r for r in blocks.tolerant(blocks.mask_counts(pieces(2), (0.5,), 0.55, side)).collect()}
    for k, m in masks.items():
        truth = noise[k] >= 0.55
        r = scores.get(k)
        assert (r.tp, r.fp, r.fn, r.pred_hit, r.truth_hit) == ((m & truth).sum(), (m & ~truth).sum(), (~m & truth).sum(), (m & grown(truth)).sum(), (truth & grown(m)).sum())


def test_halos_are_exchanged(spark, noise):
    """Blocks with what their neighbours need equal windows cut from strips."""
    strips, sizes = rasters(spark, noise)
    own = blocks.over_windows(blocks.strips_to_pieces(strips, sizes, 16), lambda w: blocks.block_table(w, values=w.inside(w.cells["values"])), f"{blocks.PLACE}, values array<double>", 16)
    shown = lambda p: sorted((r.image_id, r.y, r.x, r.value) for r in blocks.over_windows(p, lambda w: blocks.block_table(w, values=w.inside(blocks.shifted(w.cells["values"], 3, -3) + blocks.shifted(w.cells["values"], -3, 2))), f"{blocks.PLACE}, values array<double>", 16, 3).transform(blocks.pixels_of).collect())
    assert shown(blocks.with_halo(own, 16, 3)) == shown(blocks.strips_to_pieces(strips, sizes, 16, 3))


@pytest.mark.parametrize("side", [9, 512])
def test_distances(spark, noise, side):
    grids = {k: (g >= 0.42).astype(float) for k, g in noise.items()} | {9: np.ones((20, 31))}
    strips, sizes = rasters(spark, grids)
    found = {(r.image_id, r.y, r.x): r.value for r in blocks.pixels_of(width.distances(blocks.masks(blocks.strips_to_pieces(strips, sizes, side), 0.5, side), side)).collect()}
    for k, g in grids.items():
        ys, xs = np.nonzero(g < 0.5)
        for y in range(len(g)):
            for x in range(g.shape[1]):
                near = math.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()) if len(ys) else math.hypot(*g.shape)
                assert found[k, y, x] == pytest.approx(near if g[y, x] else 0)


def test_distances_of_wide_masks():
    """Cells far from the edge are found by whole rows."""
    mask = np.ones((150, 400), dtype=bool)
    mask[70, 3] = mask[10, 390] = False
    y, x = np.mgrid[:150, :400]
    near = np.minimum(np.hypot(y - 70, x - 3), np.hypot(y - 10, x - 390))
    assert np.allclose(width.edge_distance(mask), near)
    assert np.allclose(width.envelopes(width.down_columns(mask)), near**2)


def walked_by_force(pixels):
    """From node to node, pixel by pixel."""
    near = {p: [q for q in ((p[0] + a, p[1] + b) for a, b in RING) if q in pixels] for p in pixels}
    inner = {p for p in pixels if len(near[p]) == 2}
    left, found = set(inner), []

    def chain(here, before):
        path = []
        while here in left:
            left.discard(here)
            path.append(here)
            before, here = here, [q for q in near[here] if q != before][0]
        return [*path, here]

    for node in sorted(pixels - inner):
        found += [[node, *chain(q, node)] for q in near[node] if q in left]
    for start in sorted(left):
        if start in left:
            ring = chain(start, near[start][0])[:-1]
            found += [[*ring, ring[0]]] if len(ring) >= 3 else []
    return found


def test_walks():
    rng = np.random.default_rng(8)
    for t in range(300):
        mask = rng.random(rng.integers(1, 14, 2)) < rng.choice([0.2, 0.35, 0.5])
        mask = blocks.thinned(mask) if t % 2 else mask
        y, x = np.nonzero(mask)
        assert [list(zip(y[p].tolist(), x[p].tolist(), strict=True)) for p in skeleton.walked(y, x)] == walked_by_force(set(zip(y.tolist(), x.tolist(), strict=True)))


# drawn lines


def line(height, wide, a, b, thick):
    """Probabilities of a line of exact width from a to b, (y, x): half at its edges."""
    y, x = np.mgrid[:height, :wide].astype(float)
    dy, dx = b[0] - a[0], b[1] - a[1]
    t = np.clip(((y - a[0]) * dy + (x - a[1]) * dx) / (dy * dy + dx * dx), 0, 1)
    return np.clip(thick / 2 + 0.5 - np.hypot(y - a[0] - t * dy, x - a[1] - t * dx), 0, 1)


DRAWN = {
    1: line(120, 260, (60, 20), (60, 240), 6), 2: line(200, 200, (30, 30), (170, 170), 4), 3: np.maximum(line(160, 260, (40, 20), (40, 240), 6), line(160, 260, (40, 130), (140, 130), 6)),
    4: np.zeros((64, 64)), 5: np.maximum(line(140, 300, (30, 20), (30, 280), 8), line(140, 300, (100, 20), (100, 280), 3)), 6: line(100, 150, (50, 0), (50, 149), 5),
}


@pytest.fixture(scope="module")
def drawn(spark):
    strips, sizes = rasters(spark, DRAWN)
    images = sizes.withColumns({"threshold": F.lit(0.5), "factor": F.when(F.col("image_id") == 2, 2.0).otherwise(1.0), "method": F.lit("perpendicular"), "trained": F.col("image_id") != 1})
    scales = spark.createDataFrame([(1, 0.1, None, None, ["old"]), (3, 0.2, None, None, None), (5, 0.05, None, [(0.0, 0.0), (0.0, 60.0), (60.0, 60.0), (60.0, 0.0)], None)], "image_id long, mm_per_px double, h array<double>, corners array<struct<y double, x double>>, warnings array<string>")
    a = analysis.analyse(strips, images, scales, side=64)  # lines cross many blocks
    return a, a.points.toPandas(), a.instances.toPandas().set_index("image_id"), {r.image_id: r for r in a.summaries.collect()}, {r.image_id: r.warnings for r in a.notes.collect()}, images


def test_widths_lengths_and_places(drawn):
    _, points, found, *_ = drawn
    for image, thick, length, factor in ((1, 6, 220, 1), (2, 4, 140 * math.sqrt(2), 2)):
        own, row = points[points.image_id == image], found.loc[image]
        middle = own.sort_values("i").iloc[2:-2]
        assert abs(middle.width_px / factor - thick).max() < 0.8 and row.width_mean_px / factor == pytest.approx(thick, abs=0.5)
        assert row.length_px / factor == pytest.approx(length, abs=8) and row.tortuosity < 1.05
        off = abs(own.y - 60) if image == 1 else abs(own.y - own.x) / math.sqrt(2) / factor
        assert off.max() < 1.5
    assert found.loc[1].orientation_class == "horizontal" and found.loc[2].orientation_class == "diagonal" and found.loc[2].orientation == pytest.approx(-45, abs=3)
    assert found.loc[1].pattern == "linear" and not found.loc[1].touches_border and found.loc[6].touches_border


def test_uniform_spacing(drawn):
    points = drawn[1]
    for _, path in points[points.image_id.isin([1, 3])].sort_values("i").groupby(["image_id", "comp_id", "branch"]):
        steps = np.hypot(path.y.diff(), path.x.diff()).dropna()
        assert abs(steps - 3).max() < 0.45


def test_a_junction_is_left_out(drawn):
    """Three paths meet; where they do widths are too large, and don't count."""
    points, found = drawn[1], drawn[2].loc[3]
    own = points[points.image_id == 3]
    assert own.branch.nunique() == 3 and found.nodes == 1 and found.pattern == "branched"
    assert own.at_junction.any() and own[own.at_junction].width_px.max() > 7
    assert found.width_max_px < 6.8 and found.excluded == own.at_junction.sum()
    assert np.hypot(own[own.at_junction].y - 40, own[own.at_junction].x - 130).max() < 25


def test_scales_markers_and_summaries(drawn):
    _, points, found, summaries, notes, _ = drawn
    assert found.loc[1].width_max_mm == pytest.approx(found.loc[1].width_max_px * 0.1) and found.loc[1].length_mm == pytest.approx(found.loc[1].length_px * 0.1)
    assert found.loc[2].width_max_mm == -1 and found.loc[2].length_mm == -1 and found.loc[2].severity == "unknown"
    five = found.loc[5].sort_values("rank")
    assert five.width_mean_px.tolist() == pytest.approx([8, 3], abs=0.8)  # the widest is first; what lies beyond a box counts as 0
    assert points[(points.image_id == 5) & (points.y < 50)].x.min() > 60  # the marker was blanked
    assert summaries[4]["count"] == 0 and summaries[4].severity == "none" and summaries[5]["count"] == 2
    assert notes[1] == ["old", "the model is not trained"] and notes[2] == ["image reduced by 2.00", "no scale"]
    assert notes[5] == ["the marker was left out"] and notes[6] == ["1 of 1 reach the border", "no scale"]


def test_limits_and_methods(spark):
    strips, sizes = rasters(spark, {5: DRAWN[5]})
    images = sizes.withColumns({"threshold": F.lit(0.5), "factor": F.lit(1.0), "method": F.lit("distance_transform"), "trained": F.lit(True)})
    none = spark.createDataFrame([], "image_id long, mm_per_px double, h array<double>, corners array<struct<y double, x double>>, warnings array<string>")
    a = analysis.analyse(strips, images, none, analysis.Options(max_instances=1))
    (row,) = a.instances.collect()
    assert row.width_mean_px == pytest.approx(10, abs=0.5)  # nine rows are set, and the next one is five away
    assert a.notes.first().warnings[0] == "2 found, 1 reported"
    assert analysis.analyse(strips.where("false"), images, none).summaries.first()["count"] == 0


def test_a_response_is_whole(spark, drawn):
    a, *_, images = drawn
    asked = images.select("image_id", F.lit("q").alias("request_id"), "width", "height", F.lit("m").alias("model_name"), F.lit("classic").alias("model_kind"), "trained", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("mm_per_px"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("note"), F.lit(12.34).alias("duration_ms"))
    paths = a.paths.withColumnRenamed("length", "length_px")
    items = response.path_items(a.points.drop("path").select(F.col("path_id").alias("path"), "i", "y", "x", "width_px", "width_mm", "at_junction"), paths.select("instance_id", "path_id", "path", "length_px", "length_mm", "is_loop"), "path")
    with_paths = response.responses(asked, a.summaries, response.instance_items(a.instances, items), a.notes).where("image_id in (3, 4)")
    bodies = {r.image_id: r.body for r in with_paths.collect()}
    assert all("null" not in b and b.count('"paths"') == b.count('"label"') for b in bodies.values())
    read = {r.image_id: r.r for r in response.parsed(with_paths).collect()}
    assert read[4].instances["items"] == [] and read[4].summary.severity == "none" and read[4].summary.total_length_mm == -1
    (item,) = read[3].instances["items"]
    assert len(item.paths["items"]) == 3 and all(len(p.path_yx) == 2 * p.point_count == 2 * len(p.width_px) for p in item.paths["items"])
    assert read[3].contract_version == "1.1" and read[3].scale.source == "none" and read[3].scale.mm_per_px == -1 and read[3].duration_ms == 12.3
    without = response.parsed(response.responses(asked, a.summaries, response.instance_items(a.instances), a.notes)).where("image_id = 3").first().r
    assert without.instances["items"][0].paths["items"] == [] and without.instances["items"][0].branch_count == 1


def test_measure(spark):
    strips, sizes = rasters(spark, DRAWN)
    found = {r.image_id: r for r in analysis.measure(strips, sizes.withColumn("threshold", F.lit(0.5)), side=64).collect()}
    assert set(found) == {1, 2, 3, 5, 6} and found[5].instances == 2
    assert found[1].width_mean == pytest.approx(6, abs=1) and found[1].length == pytest.approx(220, abs=8)


def test_largest_first(spark, noise):
    strips, sizes = rasters(spark, noise)
    found = blocks.components(blocks.strips_to_pieces(strips, sizes), 0.5)
    top = instances.largest(found, 3, 2).orderBy("image_id", "rank").collect()
    assert all(a.area >= b.area for a, b in zip(top, top[1:], strict=False) if a.image_id == b.image_id) and max(r["rank"] for r in top) == 2

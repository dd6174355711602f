import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemetry.functions import classify
from linemetry.operators import blocks, instances, polyline, raster, skeleton, width
from linemetry.sources import images


def pixels(spark, cells):
    return spark.createDataFrame([(0, y, x, 1.0) for y, x in cells], "image_id long, y long, x long, p double")


def test_skeleton_of_a_bar_is_thin(spark):
    bar = pixels(spark, [(y, x) for y in range(10, 15) for x in range(5, 45)])
    found = raster.skeletonise(bar).collect()
    assert 25 <= len(found) <= 45
    assert max(abs(r.y - 12) for r in found) <= 2


def test_tiles_cover_every_pixel_exactly(spark):
    flat = spark.createDataFrame([(0, y, x, 0.7) for y in range(40) for x in range(33)], "image_id long, y long, x long, p double")
    out = raster.tile_blend(flat, 16, 4, 40, 33).collect()
    assert len(out) == 40 * 33 and max(abs(r.p - 0.7) for r in out) < 1e-9


def test_paths(spark):
    line = spark.createDataFrame([(1, i, 3.0 * i, 4.0 * i) for i in range(5)] + [(2, 0, 0.0, 0.0)], "path_id long, i long, x double, y double")
    out = {r.path_id: r for r in polyline.shapes(line).collect()}
    assert out[1].length == 20 and out[1].tortuosity == 1 and abs(out[1].orientation + math.degrees(math.atan2(4, 3))) < 1e-9
    assert out[2].length == 0 and out[2].orientation == 0
    even = [(r.x, r.y) for r in polyline.resample_uniform(line.where("path_id = 1"), 3.0).orderBy("j").collect()]
    assert len(even) == 8 and even[0] == (0, 0) and abs(even[-1][0] - 12) < 1e-9
    assert abs(math.dist(even[0], even[1]) - 20 / 7) < 1e-9


def test_scalars(spark):
    df = spark.createDataFrame([(None, -900.0, 90.0), (0.1, 900.0, 22.5), (0.6, 0.0, -67.5)], "mm double, v double, deg double")
    rows = df.select(classify.severity(F.col("mm")), classify.sigmoid(F.col("v")), classify.orientation_class(F.col("deg"))).collect()
    assert [tuple(r) for r in rows] == [("unknown", 0.0, "vertical"), ("fine", 1.0, "horizontal"), ("severe", 0.5, "vertical")]
    lidar = spark.range(1).select(*classify.lidar_scale(F.lit(500.0), F.lit(1000.0), F.lit(60.0))).first()
    assert abs(lidar[0] - 1.0) < 1e-9 and lidar[1] == 0.4


def test_widths_of_bars(spark):
    bar = lambda n: pixels(spark, [(y, x) for y in range(10, 10 + n) for x in range(5, 65)])
    wide = raster.annotation_widths(bar(6)).first()
    assert wide.area == 360 and abs(wide.width_px - 6) < 1
    assert raster.annotation_widths(pixels(spark, [(0, x) for x in range(39)])).first().width_px == 0.0
    assert 1.7 < raster.width_bias(bar(6), bar(3)).first().width_bias < 2.3
    assert math.isnan(raster.width_bias(bar(3), bar(3).where("y < 0")).first().width_bias)


def band(spark, thickness, soft=False):
    """Strips and size of a horizontal band in the middle of an image of 64 x 64: hard, or with a slope of one pixel."""
    value = lambda y: min(1.0, max(0.0, thickness / 2 + 0.5 - abs(y - 32))) if soft else float(abs(y - 32) * 2 < thickness)
    strips = spark.createDataFrame([(0, y, 0, [value(y)] * 64) for y in range(64)], "image_id long, y int, x int, values array<double>")
    return strips, spark.createDataFrame([(0, 64, 64)], "image_id long, height int, width int")


def edges(strips, size, side):
    return blocks.with_halo(width.distances(blocks.masks(blocks.strips_to_pieces(strips, size, side), 0.5, side), side), side, 1)


@pytest.mark.parametrize("thickness", [2.0, 3.0, 4.5, 7.0, 11.0])
def test_perpendicular_widths_of_soft_bands(spark, thickness):
    strips, size = band(spark, thickness, soft=True)
    points = spark.createDataFrame([(0, 1, i, 32.0, 10.0 + 4 * i) for i in range(11)], "image_id long, path_id long, i long, y double, x double")
    for side in (16, 512):
        coarse = width.widths_from_distance(points, edges(strips, size, side), size, side).withColumnRenamed("width_px", "coarse").withColumn("threshold", F.lit(0.5))
        found = width.widths_perpendicular(coarse, blocks.strips_to_pieces(strips, size, side, width.REACH), size, side).collect()
        assert len(found) == 11 and all(abs(r.width_px - thickness) < 0.4 for r in found)


@pytest.mark.parametrize("thickness", [3, 5, 9, 15])
def test_distance_widths_of_bands(spark, thickness):
    strips, size = band(spark, thickness)
    points = spark.createDataFrame([(0, 32.0, 30.0)], "image_id long, y double, x double")
    assert abs(width.widths_from_distance(points, edges(strips, size, 16), size, 16).first().width_px - thickness) <= 1.0


def test_edge_distance_by_force():
    rng = np.random.default_rng(1)
    for fill in (0.0, 0.3, 0.9, 1.0):
        mask = rng.random((13, 17)) < fill
        out = np.argwhere(~mask)
        for y, x in np.ndindex(mask.shape):
            exact = min((math.hypot(y - a, x - b) for a, b in out), default=math.hypot(13, 17)) if mask[y, x] else 0.0
            assert abs(width.edge_distance(mask)[y, x] - min(exact, math.hypot(13, 17))) < 1e-9


def test_edge_offset():
    offsets, three = np.array([0.25, 0.5, 0.75]), np.array([0.75])
    found = lambda values, radius: width.edge_offset(np.array([values]), offsets, np.array([0.5]), np.array([radius]), three)[0]
    assert found([0.9, 0.6, 0.2], 3.0) == pytest.approx(0.5 + 0.25 * 0.25)
    assert found([0.9, 0.9, 0.9], 3.0) == 3.0
    assert found([0.9, 0.9, 0.9], 0.6) == 0.5  # flat: the offset before
    assert found([0.0, 0.0, 0.0], 3.0) == pytest.approx(0.125)
    assert width.edge_offset(np.array([[0.9, 0.6, 0.2]]), offsets, np.array([0.5]), np.array([3.0]), np.array([0.5]))[0] == 3.0  # no deeper than its path


def walk(cells):
    y, x = np.array(sorted(cells)).T
    return [list(zip(y[p].tolist(), x[p].tolist(), strict=True)) for p in skeleton.walked(y, x)]


def test_branches_of_shapes(spark):
    cross = {(20, x) for x in range(5, 36)} | {(y, 20) for y in range(21, 40)}
    paths = walk(cross)
    assert len(paths) == 3 and sum(len(p) for p in paths) >= len(cross) - 4
    for p in paths:
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(p, p[1:], strict=False))
    ring = {(y, x) for y in range(10, 21) for x in (10, 20)} | {(y, x) for y in (10, 20) for x in range(10, 21)}
    corners = {(10, 10), (10, 20), (20, 10), (20, 20)}
    (closed,) = walk(ring - corners)
    assert closed[0] == closed[-1] and set(closed) == ring - corners and len(closed) == len(ring - corners) + 1
    assert walk({(3, 3)}) == [] and walk({(3, 3), (3, 4)}) == []
    df = spark.createDataFrame([(0, y, x) for y, x in cross], "image_id long, y long, x long")
    assert skeleton.branches(df).select("branch").distinct().count() == 3
    found = skeleton.nodes(df).collect()
    assert sum(r.junction for r in found) == 1 and len(found) == 4
    assert skeleton.branches(df.limit(0)).count() == 0


def test_uniform_steps_of_short_paths(spark):
    p = spark.createDataFrame([("a", 0, 1.0, 1.0), ("b", 0, 2.0, 2.0), ("b", 1, 2.0, 2.0), ("c", 0, 0.0, 0.0), ("c", 1, 0.0, 1.0)], "path_id string, i long, y double, x double")
    found = sorted(tuple(r) for r in polyline.resample_uniform(p, 3.0).select("path_id", "j", "y", "x").collect())
    assert found == [("a", 0, 1.0, 1.0), ("b", 0, 2.0, 2.0), ("b", 1, 2.0, 2.0), ("c", 0, 0.0, 0.0), ("c", 1, 0.0, 1.0)]
    assert polyline.resample_uniform(p, 0.0).count() == 5


def test_tangents_of_short_paths(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 2.0), (3, 0, 0.0, 0.0), (3, 1, 0.0, 1.0), (3, 2, 1.0, 1.0), (4, 0, 1.0, 1.0), (4, 1, 1.0, 1.0)], "path_id long, i long, y double, x double")
    out = {(r.path_id, r.i): (round(r.ty, 6), round(r.tx, 6)) for r in polyline.tangents(df).collect()}
    half = round(math.sqrt(0.5), 6)
    assert out[1, 0] == (0.0, 1.0) and out[2, 0] == out[2, 1] == (0.0, 1.0) and out[4, 0] == (0.0, 0.0)
    assert (out[3, 0], out[3, 1], out[3, 2]) == ((0.0, 1.0), (half, half), (1.0, 0.0))


def test_rdp():
    keep = polyline.simplified(np.array([[0, 0], [0.1, 1], [0, 2], [5, 3], [0, 4]], dtype=float), 1.0)
    assert keep.tolist() == [True, False, True, True, True]
    assert polyline.simplified(np.array([[0, 0], [3, 0], [0, 0]], dtype=float), 1.0).tolist() == [True, True, True]  # radial where the chord is a point


def test_scales(spark):
    df = spark.createDataFrame([(1, None, None, 500.0, 1000.0, None), (2, 120.0, 0.6, None, None, None), (3, 6.0, None, 500.0, 1000.0, 80.0), (4, None, -1.0, None, None, None)], "image_id long, marker_px double, explicit double, depth double, focal double, tilt double")
    out = {r.image_id: r for r in instances.resolve_scale(df).collect()}
    assert (out[1].source, out[1].mm_per_px, out[1].confidence, out[1].warnings) == ("lidar", 0.5, 0.6, [])
    assert (out[2].source, out[2].mm_per_px, out[2].disagree, len(out[2].warnings)) == ("aruco", 0.5, True, 2)
    assert (out[3].source, len(out[3].warnings), out[4].source) == ("none", 2, "none")


def test_marker_map_of_a_square(spark):
    square = [(100.0, 50.0), (220.0, 50.0), (220.0, 170.0), (100.0, 170.0)]
    df = spark.createDataFrame([(1, 7, square), (1, 8, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)])], "image_id long, marker_id long, corners array<struct<x:double,y:double>>")
    (m,) = instances.marker_scale(instances.pick_marker(df), 60.0).collect()
    assert (m.marker_id, m.side_px, m.mm_per_px, m.confidence, m.note) == (7, 120.0, 0.5, 1.0, "frontal")
    x, y, w = (m.h[0] * 220 + m.h[1] * 170 + m.h[2], m.h[3] * 220 + m.h[4] * 170 + m.h[5], m.h[6] * 220 + m.h[7] * 170 + m.h[8])
    assert (round(x / w, 9), round(y / w, 9)) == (60.0, 60.0)
    assert instances.pick_marker(df, 8).first().marker_id == 8 and instances.pick_marker(df, 9).count() == 0


def test_reports_and_requests(spark, tmp_path):
    images.write_report(spark.createDataFrame([(1.5, float("nan"), "x")], "a double, b double, c string"), str(tmp_path / "report"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "report")).collect()] == [{"a": 1.5, "c": "x"}]
    df = spark.createDataFrame([(None, 0.0), (0.0, 0.7), (-1.0, 0.7)], "asked double, model double")
    assert [r[0] for r in df.select(classify.threshold_of(F.col("asked"), F.col("model"))).collect()] == [0.5, 0.0, 0.7]


def test_stream_of_files(spark, tmp_path):
    from linemetry import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"")
    (tmp_path / "in" / "b.png").write_bytes(b"x" * 100)
    (tmp_path / "in" / "c.png").write_bytes(b"x")
    stream = streaming.dropped_files(spark, str(tmp_path / "in"), max_bytes=50).writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted((r.length, r.reject_reason) for r in spark.table("files").collect()) == [(1, None), (100, "too large")]  # the source itself skips empty files

"""Headers of drawn files, the ways an image may lie, and areas of any factor."""

import struct
import zlib

import numpy as np
import pytest

from linemetry.operators import resample
from linemetry.sources import headers
from test_analysis import rasters


def exif(orientation, order="<", kind=3):
    value = struct.pack(order + ("HH" if kind == 3 else "I"), *((orientation, 0) if kind == 3 else (orientation,)))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2) + struct.pack(order + "HHI", 0x0100, 4, 1) + struct.pack(order + "I", 5) + struct.pack(order + "HHI", 0x0112, kind, 1) + value + bytes(4)


def png(height, width, meta=None):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", meta) if meta else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(height, width, meta=None, frame=0xC0):
    segment = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + (segment(0xE1, b"Exif\0\0" + meta) if meta else b"") + b"\xff" + segment(0xDB, bytes(65)) + segment(frame, b"\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\0") + segment(0xDA, bytes(6)) + b"data\xff\xd9"


@pytest.mark.parametrize("orientation", range(1, 9))
def test_all_orientations(orientation):
    for order in "<>":
        for kind in (3, 4):
            assert headers.header(png(40, 50, exif(orientation, order, kind))) == ("png", 40, 50, orientation)
            assert headers.header(jpeg(40, 50, exif(orientation, order, kind), 0xC2)) == ("jpeg", 40, 50, orientation)
    # a corner and its neighbours go where the standard says: (first row's side, first column's side)
    meant = np.arange(12).reshape(3, 4)
    stored = {1: meant, 2: meant[:, ::-1], 3: meant[::-1, ::-1], 4: meant[::-1], 5: meant.T, 6: meant.T[::-1], 7: meant.T[::-1, ::-1], 8: meant.T[:, ::-1]}[orientation]
    assert (headers.upright(stored, orientation) == meant).all()


def test_broken_headers():
    for whole in (png(40, 50, exif(6)), jpeg(40, 50, exif(6))):
        for n in range(0, 40):
            kind, height, width, orientation = headers.header(whole[:n])
            assert height is None or (height, width) == (40, 50)
    assert headers.header(b"GIF89a" + bytes(99)) == (None, None, None, 1)
    assert headers.header(jpeg(40, 50, b"II*\0" + b"\xff" * 20))[3] == 1 and headers.header(png(40, 50, exif(9)))[3] == 1


def test_files_are_judged_by_their_headers(spark):
    files = {
        "a": png(40, 50), "b": jpeg(100, 60, exif(6)), "c": b"", "d": None, "e": png(40, 50)[:20], "f": png(10, 50), "g": b"no image", "h": jpeg(64, 64, exif(8)), "i": bytes(5000), "j": jpeg(60000, 60000),
    }
    df = spark.createDataFrame(list(files.items()), "name string, content binary")
    found = {r.name: r for r in headers.inspected(df, max_bytes=4000 + len(files["a"])).collect()}
    assert {k: r.reject_reason for k, r in found.items()} == {"a": None, "b": None, "c": "empty", "d": "empty", "e": "not an image", "f": "too small", "g": "not an image", "h": None, "i": "too many bytes", "j": "too many pixels"}
    assert (found["b"].height, found["b"].width, found["b"].exif_rotated) == (60, 100, True) and not found["h"].exif_rotated and found["a"].format == "png"
    assert headers.inspected(df.where("false")).count() == 0


@pytest.mark.parametrize("shape, to", [((70, 100), (35, 50)), ((70, 100), (33, 47)), ((200, 90), (150, 89)), ((5, 6), (5, 6)), ((130, 40), (1, 1))])
def test_areas(spark, shape, to):
    grid = np.random.default_rng(3).random(shape)
    strips, sizes = rasters(spark, {1: grid})
    images = sizes.selectExpr("*", f"{to[0]} AS to_height", f"{to[1]} AS to_width")
    rows = {r.y: r["values"] for r in resample.area_resampled(strips, images).collect()}
    found = np.array([rows[y] for y in range(to[0])])
    fine = np.repeat(np.repeat(grid, to[0], axis=0), to[1], axis=1)  # each cell of the result is a block of it
    exact = fine.reshape(to[0], shape[0], to[1], shape[1]).mean(axis=(1, 3))
    assert found.shape == to and np.allclose(found, exact) and found.mean() == pytest.approx(grid.mean())

"""Headers of image files: what they are and how large, without decoding; and their orientation."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import MAX_BYTES, MAX_PIXELS, reject_reason

#: Bytes of a file that are looked at: headers and metadata stand before the pixels.
HEAD_BYTES = 1 << 18
#: The tag of the orientation in Exif data, and the markers of JPEG that hold sizes.
ORIENTATION, FRAMES = 0x0112, frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})


def exif_orientation(data: bytes) -> int:
    """1 to 8 from Exif data (TIFF), 1 if there is none or it is broken."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        (entries,) = struct.unpack_from(order + "H", data, at)
        for i in range(entries if magic == 42 else 0):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if tag == ORIENTATION:
                (value,) = struct.unpack_from(order + {3: "H", 4: "I"}[kind], data, at + 10 + 12 * i)
                return value if count == 1 and 1 <= value <= 8 else 1
    except (KeyError, struct.error):
        pass
    return 1


def png_header(data: bytes) -> tuple[int, int, int] | None:
    """(height, width, orientation) of a PNG file's beginning, None if it has no header."""
    if len(data) < 33 or data[12:16] != b"IHDR":
        return None
    width, height = struct.unpack_from(">II", data, 16)
    at, orientation = 33, 1
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind in (b"IDAT", b"IEND"):
            break
        if kind == b"eXIf":
            orientation = exif_orientation(data[at + 8 : at + 8 + size])
        at += 12 + size
    return (height, width, orientation) if height and width else None


def jpeg_header(data: bytes) -> tuple[int, int, int] | None:
    """The same of a JPEG file; sizes stand in the first frame, Exif data in a segment before it."""
    at, orientation = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:  # padding and markers without a segment
            at += 1 if marker == 0xFF else 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if marker in FRAMES:
            if at + 9 > len(data):
                return None
            height, width = struct.unpack_from(">HH", data, at + 5)
            return (height, width, orientation) if height and width else None
        if marker in (0xD9, 0xDA) or size < 2:
            return None
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            orientation = exif_orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    return None


def header(data: bytes) -> tuple[str | None, int | None, int | None, int]:
    """(format, height, width, orientation) as stored; height and width are None if the file isn't a whole PNG or JPEG header."""
    for name, magic, read in (("png", b"\x89PNG\r\n\x1a\n", png_header), ("jpeg", b"\xff\xd8", jpeg_header)):
        if data.startswith(magic):
            return (name, *(read(data) or (None, None, 1)))
    return None, None, None, 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image as it is meant to be seen: the eight ways that Exif knows."""
    if orientation >= 5:  # stored by columns
        image = image.swapaxes(0, 1)
    down, across = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[orientation]
    return image[::down, ::across]


def inspected(files: DataFrame, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """`files` (.., content) with length, format, height and width (upright), orientation, exif_rotated (the size has
    changed by turning it) and reject_reason, null if the file is taken. Only the first HEAD_BYTES of
    a file go to Python, none of those that are empty or too large; nothing is decoded. Null
    content is empty."""
    names = [f"`{c}`" for c in files.columns]
    length = F.coalesce(F.octet_length("content"), F.lit(0))
    head = F.when((length > 0) & (length <= max_bytes), F.substring("content", 1, HEAD_BYTES))
    numbered = files.withColumns({"length": length, "head_": head})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("head_").schema.fields), "format string, h_ int, w_ int, orientation int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(x.as_py() or b"") for x in b.column(b.num_columns - 1)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            extra = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], [*b.schema.names[:-1], "format", "h_", "w_", "orientation"])

    turned = F.col("orientation") >= 5
    out = numbered.mapInArrow(run, schema)
    out = out.withColumns({"height": F.when(turned, F.col("w_")).otherwise(F.col("h_")), "width": F.when(turned, F.col("h_")).otherwise(F.col("w_"))})
    out = out.withColumn("exif_rotated", F.coalesce(turned & (F.col("h_") != F.col("w_")), F.lit(False)))
    out = out.withColumn("reject_reason", reject_reason(F.col("length"), F.col("height"), F.col("width"), max_bytes, max_pixels))
    return out.select(*names, "length", "format", "height", "width", "orientation", "exif_rotated", "reject_reason")

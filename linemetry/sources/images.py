"""Images as they come in: what is rejected, names, payloads, sidecar files, sizes to work at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of an upload (bytes, pixels, least side) and mean and spread of colours.
MAX_BYTES, MAX_PIXELS, LEAST_SIDE = 30 * 2**20, 200_000_000, 32
COLOUR_MEAN, COLOUR_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: What a sidecar file may hold.
SIDECAR = "name string, mean array<double>, std array<double>, tile int, tile_overlap int, threshold double, note string"
#: Words in a name that mark an image without a line.
NO_LINE = ("noncrack", "non-crack", "non_crack")


def reject_reason(length: Column, height: Column, width: Column, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> Column:
    """Why an upload isn't taken, null if it is."""
    pixels = height.cast("long") * width
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, "empty").when(length > max_bytes, "too many bytes").when(height.isNull() | width.isNull(), "not an image")
        .when(pixels > max_pixels, "too many pixels").when((height < LEAST_SIDE) | (width < LEAST_SIDE), "too small")
    )


def split_rejected(images: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Images that are taken, and the others with their reason; none stops the job."""
    marked = images.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def payload(value: Column) -> Column:
    """Bytes of a column that holds PNG or JPEG bytes or their base64; null where it is neither."""
    magic = F.hex(F.substring(value.cast("binary"), 1, 8))
    image = (magic == "89504E470D0A1A0A") | F.startswith(magic, F.lit("FFD8FF"))
    return F.when(image, value.cast("binary")).otherwise(F.try_to_binary(value.cast("string"), F.lit("base64")))


def name_of(raw: Column, content: Column, number: Column) -> Column:
    """A file name: six digits, then the cleaned stem of the given name (60 characters at most), or ten
    digits of the content's SHA-1 where the name has fewer than four characters or mostly others
    than letters, digits, - and ."""
    base = F.trim(F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"([^/]*)/*$", 1))
    stem = F.when(F.regexp_like(base, F.lit(r"^.+\.[^.]+$")), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    clean = F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N}\-_.]", "_"), F.lit("_"))
    fits = (F.length(clean) >= 4) & (F.length(clean) - F.length(F.replace(clean, F.lit("_"), F.lit(""))) < F.length(clean) / 2)
    return F.concat(F.lpad(number.cast("string"), 6, "0"), F.lit("_"), F.when(fits, F.left(clean, F.lit(60))).otherwise(F.left(F.sha1(content.cast("binary")), F.lit(10))))


def sidecar(text: Column) -> Column:
    """A struct of SIDECAR from JSON text; what is missing or wrong has its default."""
    read = F.from_json(text, SIDECAR)
    tile = F.coalesce(read.tile, F.lit(512))
    overlap = F.coalesce(read.tile_overlap, F.greatest(F.lit(32), F.floor(tile / 8).cast("int")))
    colours = [F.coalesce(read[c], F.array(*map(F.lit, default))).alias(c) for c, default in (("mean", COLOUR_MEAN), ("std", COLOUR_STD))]
    return F.struct(F.coalesce(read["name"], F.lit("")).alias("name"), *colours, tile.alias("tile"), overlap.alias("tile_overlap"), F.coalesce(read.threshold, F.lit(-1.0)).alias("threshold"), F.coalesce(read.note, F.lit("")).alias("note"))


def working_size(height: Column, width: Column, most: int) -> Column:
    """A struct of height, width and factor to work at: long sides above `most` (if it is positive) are
    brought down to it, half to even, and no side below 32."""
    long_side = F.greatest(height, width)
    if most <= 0:
        return F.struct(height.cast("int").alias("height"), width.cast("int").alias("width"), F.lit(1.0).alias("factor"))
    ratio = F.lit(most) / long_side
    to = lambda side: F.when(long_side <= most, side).otherwise(F.greatest(F.lit(32), F.rint(side * ratio))).cast("int")
    return F.struct(to(height).alias("height"), to(width).alias("width"), F.when(long_side <= most, 1.0).otherwise(width / to(width)).alias("factor"))


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images (stem, ..) that have a mask (stem)."""
    return images.join(masks.select("stem"), "stem", "left_semi")


def first_names(names: DataFrame, most: int) -> DataFrame:
    """The first `most` names in order; 0: all."""
    return names.orderBy("name").limit(most) if most > 0 else names


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Of (name, image, mask; payloads as bytes, mask_pixels): written, skipped (a payload is missing), and of the
    written those named as having no line, and those whose mask is empty."""
    whole = F.col("image").isNotNull() & F.col("mask").isNotNull()
    named = F.lit(False)
    for hint in NO_LINE:
        named = named | F.contains(F.lower("name"), F.lit(hint))
    return rows.agg(F.count_if(whole).alias("written"), F.count_if(~whole).alias("skipped"), F.count_if(whole & named).alias("noncrack"), F.count_if(whole & (F.col("mask_pixels") == 0)).alias("empty_mask"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, in place of an older one; NaN becomes null."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in report.schema.fields]
    report.select(*clean).write.mode("overwrite").json(path)

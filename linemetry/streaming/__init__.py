"""Folders of images as streams: files as they arrive, and images that are measured once each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import analysis, response, segment
from ..sources.images import reject_reason

#: A gray image as a row: bytes, row by row.
IMAGE = "image_id long, height int, width int, pixels binary"


def dropped_files(spark: SparkSession, folder: str, max_bytes: int = 30 * 2**20) -> DataFrame:
    """path, length and reject_reason of files as they arrive; what is too large isn't read on."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large")
    return files.select("path", "length", reason.alias("reject_reason"))


def arriving(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """A stream of IMAGE rows from the Parquet files of a folder, some files at a time."""
    return spark.readStream.schema(IMAGE).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def gray_strips(images: DataFrame) -> DataFrame:
    """IMAGE rows as strips (image_id, y, x, values), a row each. Images whose bytes don't fill them give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, height, width, pixels in zip(*(b.column(c).to_pylist() for c in ("image_id", "height", "width", "pixels")), strict=True):
                if pixels is None or not height or len(pixels) != height * width:
                    continue
                flat = pa.array(np.frombuffer(pixels, np.uint8).astype(np.float64))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(height + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(height, image)), pa.array(np.arange(height, dtype=np.int32)), pa.array(np.zeros(height, np.int32)), rows], ["image_id", "y", "x", "values"])

    return images.select("image_id", "height", "width", "pixels").mapInArrow(run, "image_id long, y int, x int, values array<double>")


def answered(images: DataFrame, model: segment.Segmenter, options: analysis.Options = analysis.Options()) -> DataFrame:
    """(image_id, body) of IMAGE rows: predicted, analysed, and answered without a scale."""
    spark = images.sparkSession
    blocks = segment.predicted(gray_strips(images), images, model)
    sizes = images.select("image_id", "height", "width").withColumns({"threshold": F.lit(model.threshold if model.threshold > 0 else 0.5), "factor": F.lit(1.0), "method": F.lit("perpendicular"), "trained": F.lit(model.trained)})
    none = spark.createDataFrame([], "image_id long, mm_per_px double, h array<double>, corners array<struct<y double, x double>>, warnings array<string>")
    a = analysis.analyse(segment.block_strips(blocks), sizes, none, options)
    unknown = F.lit(None)
    asked = sizes.select("image_id", F.col("image_id").cast("string").alias("request_id"), "width", "height", F.lit(model.name).alias("model_name"), F.lit(model.kind).alias("model_kind"), "trained", unknown.cast("string").alias("source"), unknown.cast("double").alias("mm_per_px"), unknown.cast("double").alias("confidence"), F.lit("no scale").alias("note"), unknown.cast("double").alias("duration_ms"))
    paths = a.paths.withColumnRenamed("length", "length_px").select("instance_id", "path_id", "path", "length_px", "length_mm", "is_loop")
    items = response.path_items(a.points.select(F.col("path_id").alias("path"), "i", "y", "x", "width_px", "width_mm", "at_junction"), paths, "path")
    return response.responses(asked, a.summaries, response.instance_items(a.instances, items), a.notes)


def measured(images: DataFrame, model: segment.Segmenter, sink: str, checkpoint: str, options: analysis.Options = analysis.Options()) -> StreamingQuery:
    """Start answering a stream of IMAGE rows: all that is there, then the query ends.

    Rows that the upload rules reject give no answer. An image whose size and bytes were seen before is dropped: the
    stream's state holds a digest for each image, in the checkpoint. A batch's answers go to `sink`/batch=n
    and replace what a run that was stopped has left there, so after any restart with the same
    checkpoint every different image has one answer: none is lost, and none doubled."""
    taken = images.where(reject_reason(F.octet_length("pixels"), F.col("height"), F.col("width")).isNull())
    digest = F.sha2(F.concat(F.format_string("%d %d ", "height", "width").cast("binary"), F.col("pixels")), 256)

    def answer(batch: DataFrame, number: int) -> None:
        answered(batch.drop("digest"), model, options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return taken.withColumn("digest", digest).dropDuplicates(["digest"]).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The tables of the driver read as rasters, polylines, width samples and scale offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import sigmoid

SIDE = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, p): 64 vectors make an image, a component is a pixel."""
    pixels = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return pixels.select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), (F.col("vec_id") % SIDE).alias("y"), F.col("x").cast("long").alias("x"), sigmoid(F.col("v").cast("double") * 8).alias("p"))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, values): the same rasters by rows, a vector each."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), (F.col("vec_id") % SIDE).cast("int").alias("y"), F.lit(0).alias("x"), F.transform("embedding", lambda v: sigmoid(v.cast("double") * 8)).alias("values"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, height, width) of the rasters; the last image may be lower than the others."""
    e = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / SIDE).alias("image_id"))
    return e.agg((F.max(F.col("vec_id") % SIDE) + 1).cast("int").alias("height"), F.max(F.size("embedding")).alias("width"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, i, x, y): a user's events in order of time; x in hours, y the value."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("path_id"), at.cast("long").alias("i"), hours.alias("x"), F.col("value").alias("y"))


def width_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, sample_id, width_px, mm_per_px, at_junction) from order lines."""
    scale = (F.col("l_discount") + 0.0) * 0.2
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("sample_id"), F.col("l_quantity").alias("width_px"), scale.alias("mm_per_px"), (F.col("l_returnflag") == "R").alias("at_junction"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, path_id, length, length_mm, orientation, tortuosity) from order lines; -1: no scale."""
    price = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("path_id"), price.alias("length"), F.when(F.col("l_tax") == 0, -1.0).otherwise(price * F.col("l_tax")).alias("length_mm"), (F.col("l_quantity") - 25).alias("orientation"), (1 + F.col("l_discount") + 0.0).alias("tortuosity"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, samples, path_rows): both of the above as arrays, from one shuffle of the order lines. They are in the
    order of the table's rows, so sums over them have the same last bit whatever the partitions."""
    table = read(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("row"), F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_returnflag") == "R").alias("returned"))
    of = table.repartition("instance_id").groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("row", "number", "quantity", "price", "discount", "tax", "returned"))).alias("rows"))
    sample = lambda r: F.struct(r.number.alias("sample_id"), r.quantity.alias("width_px"), ((r.discount + 0.0) * 0.2).alias("mm_per_px"), r.returned.alias("at_junction"))
    path = lambda r: F.struct(r.number.alias("path_id"), r.price.alias("length"), F.when(r.tax == 0, -1.0).otherwise(r.price * r.tax).alias("length_mm"), (r.quantity - 25).alias("orientation"), (1 + r.discount + 0.0).alias("tortuosity"))
    return of.select("instance_id", F.transform("rows", sample).alias("samples"), F.transform("rows", path).alias("path_rows"))


def scale_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, explicit, depth, focal, tilt, marker_px): offers of each source, null if none."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("image_id"),
        F.when(key % 3 == 0, F.col("o_totalprice") / 1e6).alias("explicit"),
        F.when(key % 2 == 0, F.col("o_totalprice") / 100).alias("depth"),
        F.lit(1000.0).alias("focal"),
        F.when(key % 10 == 0, None).when(key % 5 == 0, -1.0).otherwise((F.col("o_custkey") % 90).cast("double")).alias("tilt"),
        F.when(key % 7 == 0, 5.0 + F.col("o_custkey") % 100).alias("marker_px"),
    )

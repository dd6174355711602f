"""Instances: width statistics, ranking, scale resolution and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import lidar_scale, severity, to_mm


def width_summary(samples: DataFrame) -> DataFrame:
    """Per instance: greatest, mean and 95th percentile of the widths away from junctions (of all
    where none is away), in pixels and mm, of values that are known (not negative); -1 where none
    is; how many were excluded, and the severity of the greatest width in mm."""
    s = samples.withColumn("width_mm", to_mm(F.col("width_px"), F.col("mm_per_px")))
    none_away = F.count_if(~F.col("at_junction")).over(Window.partitionBy("instance_id")) == 0
    kept = s.withColumn("used", ~F.col("at_junction") | none_away)
    known = {u: F.when(F.col("used") & (F.col(f"width_{u}") >= 0), F.col(f"width_{u}")) for u in ("px", "mm")}
    stats = [F.coalesce(x, F.lit(-1.0)).alias(f"width_{n}_{u}") for u, v in known.items() for n, x in (("max", F.max(v)), ("mean", F.avg(v)), ("p95", F.percentile(v, F.lit(0.95))))]
    out = kept.groupBy("instance_id").agg(*stats, F.count_if("at_junction").alias("excluded"))
    return out.withColumn("severity", severity(F.col("width_max_mm")))


def instance_totals(paths: DataFrame) -> DataFrame:
    """Per instance of (instance_id, path_id, length, length_mm, orientation, tortuosity): paths, total length,
    total in mm (-1 if one is unknown), direction and tortuosity of the longest path (the first of equals)."""
    trunk = F.max_by(F.struct("orientation", "tortuosity"), F.struct("length", (-F.col("path_id")).alias("first"))).alias("trunk")
    unknown = F.bool_or(F.coalesce(F.col("length_mm") < 0, F.lit(True)))
    out = paths.groupBy("instance_id").agg(F.count("*").alias("paths"), F.sum("length").alias("length_px"), F.when(unknown, -1.0).otherwise(F.sum("length_mm")).alias("length_mm"), trunk)
    return out.select("instance_id", "paths", "length_px", "length_mm", F.col("trunk.orientation").alias("orientation"), F.col("trunk.tortuosity").alias("tortuosity"))


def with_width_figures(rows: DataFrame) -> DataFrame:
    """`rows` (.., samples: array of width_px, mm_per_px, at_junction) with the columns of `width_summary` in place of
    the samples, for an instance a row: nothing is shuffled, and sums go in the order of the samples."""
    away = F.filter("samples", lambda s: ~s.at_junction)
    r = rows.withColumn("away", away).withColumn("used", F.when(F.size("away") == 0, F.col("samples")).otherwise(F.col("away")))
    known = {"px": F.transform("used", lambda s: s.width_px), "mm": F.transform("used", lambda s: to_mm(s.width_px, s.mm_per_px))}
    r = r.withColumns({u: F.filter(v, lambda w: w >= 0) for u, v in known.items()})
    stats = {}
    for u in known:
        ordered, place = F.sort_array(u), 0.95 * (F.size(u) - 1)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        between = F.when(low == high, F.get(ordered, low)).otherwise((high - place) * F.get(ordered, low) + (place - low) * F.get(ordered, high))
        mean = F.try_divide(F.aggregate(u, F.lit(0.0), lambda a, w: a + w), F.size(u))
        stats |= {f"width_{n}_{u}": F.coalesce(F.when(F.size(u) > 0, x), F.lit(-1.0)) for n, x in (("max", F.array_max(u)), ("mean", mean), ("p95", between))}
    r = r.withColumns(stats).withColumn("excluded", F.size(F.filter("samples", lambda s: s.at_junction)).cast("long"))
    return r.withColumn("severity", severity(F.col("width_max_mm"))).drop("samples", "away", "used", *known)


def with_totals(rows: DataFrame) -> DataFrame:
    """`rows` (.., path_rows: array of path_id, length, length_mm, orientation, tortuosity) with the columns of `instance_totals`,
    for an instance a row: nothing is shuffled, and sums go in the order of the paths."""

    def total(c: str) -> Column:
        some = F.filter(F.transform("path_rows", lambda p: p[c]), lambda v: v.isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v))

    trunk = F.array_max(F.transform("path_rows", lambda p: F.struct(p.length.alias("length"), (-p.path_id).alias("first"), p.orientation.alias("orientation"), p.tortuosity.alias("tortuosity"))))
    unknown = F.exists("path_rows", lambda p: F.coalesce(p.length_mm < 0, F.lit(True)))
    r = rows.withColumns({"paths": F.size("path_rows").cast("long"), "length_px": total("length"), "length_mm": F.when(unknown, -1.0).otherwise(total("length_mm")), "trunk": trunk})
    return r.withColumns({c: F.col(f"trunk.{c}") for c in ("orientation", "tortuosity")}).drop("trunk")


def largest(components: DataFrame, min_area: int = 40, max_instances: int | None = None) -> DataFrame:
    """Components of `min_area` or more with their rank by area in the image, the largest first; at most
    `max_instances` of each."""
    out = components.where(F.col("area") >= min_area)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "comp_id")))
    return out.where(F.col("rank") <= max_instances) if max_instances is not None else out


def ranked(instances: DataFrame, group: str) -> DataFrame:
    """Numbers from 0 by greatest width, then length."""
    order = Window.partitionBy(group).orderBy(F.desc("width_max_px"), F.desc("length_px"), "instance_id")
    return instances.withColumn("rank", F.row_number().over(order) - 1)


def image_summary(images: DataFrame, instances: DataFrame, **more: Column) -> DataFrame:
    """Per image: instances, greatest widths, total lengths (in mm -1 if one is unknown), instances at the
    border and severity; images without any stay, with severity none. more: further aggregates of the same grouping, by name."""
    mm = F.when(F.col("width_max_mm") >= 0, F.col("width_max_mm"))
    unknown = F.bool_or(F.coalesce(F.col("length_mm") < 0, F.lit(True)))
    n = instances.groupBy("image_id").agg(
        F.count("*").alias("count"), F.max("width_max_px").alias("width_max_px"), F.max(mm).alias("width_max_mm"), F.sum("length_px").alias("total_px"),
        F.when(~unknown, F.sum("length_mm")).alias("total_mm"), F.count_if("touches_border").alias("at_border"),
        *[v.alias(c) for c, v in more.items()],
    )
    out = images.select("image_id").distinct().join(n, "image_id", "left")
    or_ = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("image_id", or_("count", 0), or_("width_max_px", -1.0), or_("width_max_mm", -1.0), or_("total_px", 0.0), F.when(F.col("count").isNull(), 0.0).otherwise(F.coalesce("total_mm", F.lit(-1.0))).alias("total_mm"), or_("at_border", 0), F.when(F.col("count").isNull(), "none").otherwise(severity(F.col("width_max_mm"))).alias("severity"), *more)


#: Sources of a scale, by rank.
SOURCES = ("aruco", "explicit", "lidar")


def resolve_scale(offers: DataFrame, marker_mm: float = 60.0) -> DataFrame:
    """Of (image_id, marker_px, explicit, depth, focal, tilt): the scale by rank of its source, its
    confidence (of a marker its `marker_confidence`, if offers have it; else it is taken as seen from the front), how many offers hold, whether another one
    differs (chosen / other above 1.15 or below 0.87), and the warnings in order: offers that don't hold,
    several offers, each that differs. A marker's map `h` stays, if offers have it and the marker is used. Offers that are null or not positive aren't made."""
    lidar, sure = lidar_scale(F.col("depth"), F.col("focal"), F.col("tilt"))
    made = {"aruco": F.col("marker_px") > 0, "lidar": (F.col("depth") > 0) & (F.col("focal") > 0)}
    o = offers.select("*", F.when(F.col("marker_px") >= 12, marker_mm / F.col("marker_px")).alias("aruco_mm"), F.when(F.col("explicit") > 0, F.col("explicit")).alias("explicit_mm"), lidar.alias("lidar_mm"), sure.alias("sure"))
    of = {s: F.col(f"{s}_mm") for s in SOURCES}
    chosen = F.coalesce(*of.values())
    source = F.coalesce(*[F.when(of[s].isNotNull(), s) for s in SOURCES], F.lit("none"))
    offered = sum((of[s].isNotNull().cast("int") for s in SOURCES), F.lit(0))
    ratio = {s: F.when(of[s].isNotNull(), chosen / F.greatest(of[s], F.lit(1e-9))) for s in SOURCES}
    off = {s: F.coalesce((source != s) & ((ratio[s] > 1.15) | (ratio[s] < 0.87)), F.lit(False)) for s in SOURCES}
    names = F.concat_ws(", ", *[F.when(of[s].isNotNull(), s) for s in SOURCES])
    warnings = [
        F.when(made["aruco"] & of["aruco"].isNull(), F.format_string("marker of %.0f px is too small", "marker_px")),
        F.when(made["lidar"] & of["lidar"].isNull(), F.format_string("tilt of %.0f degrees is too steep", "tilt")),
        F.when(offered > 1, F.format_string("several scales offered (%s); %s is used", names, source)),
        *[F.when(off[s], F.format_string(f"{s} differs by %.0f percent", F.abs(1 - ratio[s]) * 100)) for s in SOURCES],
    ]
    seen = F.coalesce("marker_confidence", F.lit(1.0)) if "marker_confidence" in offers.columns else F.lit(1.0)
    confidence = F.when(source == "lidar", F.col("sure")).when(source == "none", 0.0).when(source == "aruco", seen).otherwise(1.0)
    maps = [F.when(source == "aruco", F.col("h")).alias("h")] if "h" in offers.columns else []
    return o.select("image_id", *maps, source.alias("source"), F.coalesce(chosen, F.lit(-1.0)).alias("mm_per_px"), confidence.alias("confidence"), offered.alias("offers"), (off["aruco"] | off["explicit"] | off["lidar"]).alias("disagree"), F.filter(F.array(*warnings), lambda w: w.isNotNull()).alias("warnings"))


def match_outcome(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """missed, invented and compared instances by a full outer join on the key."""
    j = truth.select(key, F.lit(1).alias("t")).join(pred.select(key, F.lit(1).alias("p")), key, "full")
    return j.agg(F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("invented"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("compared"))


def error_stats(pairs: DataFrame) -> DataFrame:
    """Error statistics of (truth, pred)."""
    err = F.col("pred") - F.col("truth")
    return pairs.agg(F.median(err).alias("median_err"), F.avg(err).alias("mean_err"), F.median(F.abs(err)).alias("median_abs"), F.percentile(F.abs(err), F.lit(0.9)).alias("p90_abs"), F.median(err / F.greatest(F.col("truth"), F.lit(1e-6))).alias("median_rel"), F.median("truth").alias("median_truth"))


def filter_linear(names: DataFrame, widths: DataFrame, max_width: float, keep_negatives: bool = True) -> DataFrame:
    """Names whose annotation width is unknown, or 0 (if negatives are kept), or at most the limit."""
    j = names.join(widths, "name", "left")
    w = F.col("width")
    return j.where(w.isNull() | F.when(w == 0, F.lit(keep_negatives)).otherwise(w <= max_width) | F.lit(max_width <= 0)).select(*names.columns)


def running(per_image: DataFrame) -> DataFrame:
    """Of (threshold, image_id, tp, fp, fn, tolerant_f1, width_bias): per threshold iou, f1, precision and
    recall of all pixels together; of images with truth the mean tolerant F1 (0 without any) and the
    median of the finite width biases (null without any)."""
    real = (F.col("tp") + F.col("fn")) > 0
    bias = F.when(real & ~F.isnan("width_bias") & (F.abs("width_bias") < float("inf")), F.col("width_bias"))
    n = per_image.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.coalesce(F.avg(F.when(real, F.col("tolerant_f1"))), F.lit(0.0)).alias("tolerant_f1"), F.median(bias).alias("width_bias"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("threshold", (tp / (tp + fp + fn + 1e-7)).alias("iou"), (2 * tp / (2 * tp + fp + fn + 1e-7)).alias("f1"), (tp / (tp + fp + 1e-7)).alias("precision"), (tp / (tp + fn + 1e-7)).alias("recall"), "tolerant_f1", "width_bias")


def with_width_bias(counts: DataFrame, areas: DataFrame, truth: float) -> DataFrame:
    """`counts` (image_id, threshold, ..) with width_bias: cells per centre-line cell of the mask at the threshold over that
    of the true mask, from areas (image_id, threshold, area, length), NaN where one of them is empty."""
    real = areas.where(F.col("threshold") == truth).select("image_id", F.col("area").alias("true_area"), F.col("length").alias("true_length")).distinct()
    j = counts.join(areas.distinct(), ["image_id", "threshold"], "left").join(real, "image_id", "left")
    some = (F.col("area") >= 1) & (F.col("length") >= 1) & (F.col("true_area") >= 1) & (F.col("true_length") >= 1)
    bias = F.try_divide(F.col("area") * F.col("true_length"), F.col("length") * F.col("true_area"))
    return j.withColumn("width_bias", F.when(some, bias).otherwise(F.lit(float("nan")))).drop("area", "length", "true_area", "true_length")


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """Of (threshold, tolerant_f1, width_bias), a short grid: one row with the threshold whose bias is nearest
    to 1 (missing, 0 and not finite: 9.9 away) among those within 0.02 of the best tolerant F1, ties to
    the smallest; that shortlist; and the threshold of the best tolerant F1 alone."""
    b = F.col("width_bias")
    miss = F.when(b.isNull() | (b == 0) | F.isnan(b) | (F.abs(b) == float("inf")), 9.9).otherwise(F.abs(b - 1))
    rows = F.sort_array(F.collect_list(F.struct("threshold", "tolerant_f1", "width_bias", miss.alias("miss"))))
    best = F.array_max(F.transform("rows", lambda r: r.tolerant_f1))
    short = F.filter("rows", lambda r: r.tolerant_f1 >= F.col("best") - 0.02)
    near = F.array_min(F.transform("short", lambda r: F.struct(r.miss, r.threshold, r.tolerant_f1, r.width_bias)))
    out = sweep.agg(rows.alias("rows")).withColumn("best", best).withColumn("short", short).withColumn("near", near)
    alone = F.filter("rows", lambda r: r.tolerant_f1 == F.col("best"))[0].threshold
    return out.select("near.threshold", "near.tolerant_f1", "near.width_bias", F.transform("short", lambda r: r.threshold).alias("shortlist"), alone.alias("f1_only_threshold"))


def measured(widths: DataFrame, lengths: DataFrame, instances: DataFrame) -> DataFrame:
    """Per image, of width samples (image_id, width_px), path lengths (image_id, length) and instances
    (image_id): greatest, mean and 95th percentile of all widths, total length and instances."""
    w = widths.groupBy("image_id").agg(F.max("width_px").alias("width_max"), F.avg("width_px").alias("width_mean"), F.percentile("width_px", F.lit(0.95)).alias("width_p95"))
    total = lengths.groupBy("image_id").agg(F.sum("length").alias("length"))
    return w.join(total, "image_id").join(instances.groupBy("image_id").agg(F.count("*").alias("instances")), "image_id")


def widest_sample(samples: DataFrame) -> DataFrame:
    """Per instance the sample of the greatest width, at junctions too; the first of equals."""
    return samples.groupBy("instance_id").agg(F.max_by(F.struct("sample_id", "width_px"), F.struct("width_px", (-F.col("sample_id")).alias("first"))).alias("w")).select("instance_id", "w.sample_id", "w.width_px")


def labelled(instances: DataFrame, most: int) -> DataFrame:
    """`instances` (image_id, rank, ..) with `shown` for the first `most` of each image, and how many are hidden."""
    hidden = F.count_if(F.col("rank") >= most).over(Window.partitionBy("image_id"))
    return instances.withColumns({"shown": F.col("rank") < most, "hidden": hidden})


def train_split(names: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """`names` (name) with `training`: false for the last int(n * share) of a seeded order, counted by
    a rank within hash ranges, so no task orders all names."""
    drawn = names.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}/"), "name"))).withColumn("range", F.conv(F.left("draw", F.lit(4)), 16, 10).cast("int"))
    sizes = drawn.groupBy("range").agg(F.count("*").alias("n"))  # at most 65,536 ranges
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("draw", "name"))
    joined = drawn.join(F.broadcast(sizes), "range").withColumn("place", place)
    return joined.withColumn("training", F.col("place") <= F.floor(F.col("all") * (1 - share))).drop("draw", "range", "before", "all", "place")


def pick_marker(markers: DataFrame, wanted: int = -1) -> DataFrame:
    """Per image the marker of the wanted id, or the one of the largest area if none is wanted. markers:
    (image_id, marker_id, corners: four structs x, y in order)."""
    if wanted >= 0:
        return markers.where(F.col("marker_id") == wanted).groupBy("image_id").agg(F.min_by(F.struct(*[c for c in markers.columns if c != "image_id"]), "marker_id").alias("m")).select("image_id", "m.*")
    twice = sum((F.col("corners")[i].x * F.col("corners")[(i + 1) % 4].y - F.col("corners")[(i + 1) % 4].x * F.col("corners")[i].y for i in range(4)), F.lit(0.0))
    of = F.struct(*[c for c in markers.columns if c != "image_id"])
    return markers.groupBy("image_id").agg(F.max_by(of, F.struct(F.abs(twice), (-F.col("marker_id")).alias("first"))).alias("m")).select("image_id", "m.*")


def marker_scale(markers: DataFrame, marker_mm: float) -> DataFrame:
    """`markers` (.., corners) with side_px, spread, mm_per_px (null where the mean side is below 12
    px), confidence, note and h: the nine numbers of the projective map of the corners to a square of
    marker_mm, by rows."""
    c = lambda i, f: F.col("corners")[i][f]
    sides = F.array(*[F.hypot(c((i + 1) % 4, "x") - c(i, "x"), c((i + 1) % 4, "y") - c(i, "y")) for i in range(4)])
    m = markers.withColumn("sides", sides).withColumn("side_px", F.aggregate("sides", F.lit(0.0), lambda a, x: a + x) / 4)
    m = m.withColumn("spread", (F.array_max("sides") - F.array_min("sides")) / F.greatest("side_px", F.lit(1e-6)))
    # the unit square goes to the corners by [a b c; d e f; g h 1]; its inverse, scaled, is asked for
    x, y = [c(i, "x") for i in range(4)], [c(i, "y") for i in range(4)]
    dx, dy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    u1, v1, u2, v2 = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    det = u1 * v2 - u2 * v1
    m = m.withColumns({"g": F.try_divide(dx * v2 - u2 * dy, det), "h_": F.try_divide(u1 * dy - dx * v1, det)})
    g, h = F.col("g"), F.col("h_")
    a, b, cc, d, e, f = x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0]
    inverse = [e - f * h, cc * h - b, b * f - cc * e, f * g - d, a - cc * g, cc * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    last = inverse[8]
    matrix = F.array(*[F.try_divide(v * (marker_mm if i < 6 else 1.0), last) for i, v in enumerate(inverse)])
    known = F.col("side_px") >= 12
    note = F.when(~known, "too small").when(F.col("spread") > 0.02, "perspective").otherwise("frontal")
    return m.select(*markers.columns, "side_px", "spread", F.when(known, marker_mm / F.col("side_px")).alias("mm_per_px"), F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.2), 1 - F.col("spread")))).alias("confidence"), note.alias("note"), F.when(known, matrix).alias("h"))

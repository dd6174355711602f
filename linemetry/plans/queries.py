"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import blocks as blk
from ..operators import instances as inst
from ..operators import polyline as line
from ..operators import raster as ras
from ..sources import adapters as src
from ..sources import images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RASTER = "raster AS (SELECT vec_id // 64 AS image_id, vec_id % 64 AS y, i - 1 AS x, CASE WHEN v >= 0 THEN 1 / (1 + exp(-8 * v)) ELSE exp(8 * v) / (1 + exp(8 * v)) END AS p FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"
MASK = f"{RASTER}, mask AS (SELECT * FROM raster WHERE p >= 0.7)"
POINTS = "points AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, value AS y FROM events)"
SEGMENTS = f"{POINTS}, seg0 AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM points WINDOW w AS (PARTITION BY path_id ORDER BY i)), segs AS (SELECT *, coalesce(sqrt((x - x0) ** 2 + (y - y0) ** 2), 0) AS seg FROM seg0), s AS (SELECT *, sum(seg) OVER (PARTITION BY path_id ORDER BY i) AS s FROM segs)"
SEVERITY = "CASE WHEN {0} IS NULL OR {0} < 0 THEN 'unknown' WHEN {0} < 0.1 THEN 'hairline' WHEN {0} < 0.2 THEN 'fine' WHEN {0} < 0.3 THEN 'moderate' WHEN {0} < 0.5 THEN 'wide' ELSE 'severe' END"
SAMPLES = "samples AS (SELECT l_orderkey AS instance_id, l_linenumber AS sample_id, l_quantity AS width_px, (l_discount + 0.0) * 0.2 AS mm_per_px, l_returnflag = 'R' AS at_junction FROM lineitem)"
KNOWN_PX, KNOWN_MM = "FILTER (WHERE used AND width_px >= 0)", "FILTER (WHERE used AND width_mm >= 0)"
WIDTHS = f"""{SAMPLES}, used AS (SELECT *, CASE WHEN mm_per_px > 0 THEN width_px * mm_per_px ELSE -1 END AS width_mm, NOT at_junction OR count(*) FILTER (WHERE NOT at_junction) OVER (PARTITION BY instance_id) = 0 AS used FROM samples),
summary AS (SELECT instance_id, coalesce(max(width_px) {KNOWN_PX}, -1) AS width_max_px, coalesce(avg(width_px) {KNOWN_PX}, -1) AS width_mean_px, coalesce(quantile_cont(width_px, 0.95) {KNOWN_PX}, -1) AS width_p95_px, coalesce(max(width_mm) {KNOWN_MM}, -1) AS width_max_mm, coalesce(avg(width_mm) {KNOWN_MM}, -1) AS width_mean_mm, coalesce(quantile_cont(width_mm, 0.95) {KNOWN_MM}, -1) AS width_p95_mm, count(*) FILTER (WHERE at_junction) AS excluded FROM used GROUP BY instance_id)"""
PATHS = "paths AS (SELECT l_orderkey AS instance_id, l_linenumber AS path_id, l_extendedprice AS length, CASE WHEN l_tax = 0 THEN -1 ELSE l_extendedprice * l_tax END AS length_mm, l_quantity - 25 AS orientation, 1 + l_discount + 0.0 AS tortuosity FROM lineitem)"
TOTALS = f"{PATHS}, longest AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY length DESC, path_id) AS place FROM paths), totals AS (SELECT instance_id, count(*) AS paths, sum(length) AS length_px, CASE WHEN min(length_mm) >= 0 THEN sum(length_mm) ELSE -1 END AS length_mm, max(orientation) FILTER (WHERE place = 1) AS orientation, max(tortuosity) FILTER (WHERE place = 1) AS tortuosity FROM longest GROUP BY 1)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places: sums over shuffled rows aren't stable to the last bit."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def pieces(spark: SparkSession, d: str, halo: int = 0) -> DataFrame:
    return blk.strips_to_pieces(src.strips(spark, d), src.sizes(spark, d), halo=halo)


def mask(spark: SparkSession, d: str) -> DataFrame:
    return ras.threshold_mask(src.raster(spark, d), 0.7)


@query(f"WITH {MASK} SELECT image_id, y, x, round(p, 6) AS p FROM mask")
def threshold_mask(spark, d):
    return rounded(mask(spark, d), "p")


@query(f"WITH {RASTER} SELECT image_id, y, x, round(p, 6) AS p FROM raster")
def sigmoid(spark, d):
    return rounded(src.raster(spark, d), "p")


@query(f"""WITH RECURSIVE {MASK},
k AS (SELECT image_id, y * 65536 + x AS a FROM mask),
e AS (SELECT a.image_id, a.a, b.a AS b FROM k a JOIN (SELECT unnest([-65537, -65536, -65535, -1, 0, 1, 65535, 65536, 65537]) AS o) ON true JOIN k b ON b.image_id = a.image_id AND b.a = a.a + o),
reach AS (SELECT image_id, a, b FROM e UNION SELECT r.image_id, r.a, e.b FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.b),
labels AS (SELECT image_id, a, min(b) AS comp_id FROM reach GROUP BY ALL),
comps AS (SELECT m.image_id, comp_id, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, round(avg(p), 6) AS score FROM mask m JOIN labels l ON l.image_id = m.image_id AND l.a = y * 65536 + x GROUP BY ALL HAVING count(*) >= 8),
ranks AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp_id)::INT AS rank FROM comps)
SELECT * FROM ranks WHERE rank <= 200""")
def components(spark, d):
    return rounded(inst.largest(blk.components(pieces(spark, d), 0.7), min_area=8, max_instances=200), "score")


@query(f"WITH {MASK} SELECT a.image_id, a.y, a.x, (SELECT count(*) FROM mask b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1) - 1 AS neighbours FROM mask a")
def neighbours(spark, d):
    return blk.neighbour_count(pieces(spark, d, 1), 0.7)


@query(f"""WITH {MASK}, o AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
grown AS (SELECT DISTINCT r.image_id, r.y, r.x FROM raster r, o, mask m WHERE m.image_id = r.image_id AND m.y = r.y + a AND m.x = r.x + b),
holes AS (SELECT image_id, y, x FROM raster EXCEPT SELECT * FROM grown),
eaten AS (SELECT DISTINCT image_id, y + a AS y, x + b AS x FROM holes, o)
SELECT * FROM grown EXCEPT SELECT * FROM eaten""")
def close3x3(spark, d):
    return blk.close3x3(pieces(spark, d, 2), 0.7)


@query(f"""WITH {RASTER}, t AS (SELECT ty, tx FROM (SELECT unnest([0, 16, 32]) AS ty), (SELECT unnest([0, 16, 32]) AS tx)),
w AS (SELECT image_id, y, x, p, greatest(1e-3, (0.5 - 0.5 * cos(2 * pi() * (y - ty + 1) / 33)) * (0.5 - 0.5 * cos(2 * pi() * (x - tx + 1) / 33))) AS w FROM raster JOIN t ON y >= ty AND y < ty + 32 AND x >= tx AND x < tx + 32)
SELECT image_id, y, x, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS p, count(*) AS tiles FROM w GROUP BY ALL""")
def tile_blend(spark, d):
    return rounded(ras.tile_blend(src.raster(spark, d), 32, 16, 64, 64), "p")


@query(f"""WITH {RASTER}, n AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE p >= threshold AND p >= 0.7) AS tp, count(*) FILTER (WHERE p >= threshold AND p < 0.7) AS fp, count(*) FILTER (WHERE p < threshold AND p >= 0.7) AS fn FROM raster, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold) GROUP BY ALL)
SELECT *, round(tp / (tp + fp + fn + 1e-7), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-7), 6) AS f1 FROM n""")
def threshold_sweep(spark, d):
    return rounded(ras.confusion(src.raster(spark, d), 0.7, (0.5, 0.6, 0.7, 0.8, 0.9)), "iou", "f1")


@query(f"""WITH {RASTER}, o AS (SELECT a, b FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS b) WHERE abs(a) < 2 OR b = 0),
pred AS (SELECT image_id, y, x FROM raster WHERE p >= 0.7), truth AS (SELECT image_id, y, x FROM raster WHERE p >= 0.8),
ph AS (SELECT p.image_id, count(*) AS n FROM pred p WHERE EXISTS (SELECT 1 FROM truth t, o WHERE t.image_id = p.image_id AND t.y + a = p.y AND t.x + b = p.x) GROUP BY 1),
th AS (SELECT t.image_id, count(*) AS n FROM truth t WHERE EXISTS (SELECT 1 FROM pred p, o WHERE p.image_id = t.image_id AND p.y + a = t.y AND p.x + b = t.x) GROUP BY 1),
r AS (SELECT i.image_id, coalesce(ph.n, 0) / (coalesce(pn, 0) + 1e-7) AS p, coalesce(th.n, 0) / (coalesce(tn, 0) + 1e-7) AS r FROM (SELECT image_id, count(*) AS pn FROM pred GROUP BY 1) i LEFT JOIN (SELECT image_id, count(*) AS tn FROM truth GROUP BY 1) USING (image_id) LEFT JOIN ph USING (image_id) LEFT JOIN th USING (image_id))
SELECT image_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r < 1e-7 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS tolerant_f1 FROM r""")
def tolerant_f1(spark, d):
    scores = blk.tolerant(blk.mask_counts(pieces(spark, d, 2), (0.7,), 0.8))
    return rounded(scores, "precision", "recall", "tolerant_f1").select("image_id", "precision", "recall", "tolerant_f1")


@query()
def skeleton(spark, d):
    return rounded(ras.skeletonise(mask(spark, d)), "p")


@query(f"""WITH {SEGMENTS}, n AS (SELECT path_id, count(*) AS point_count, sum(seg) AS length, arg_min(x, i) AS xa, arg_min(y, i) AS ya, arg_max(x, i) AS xb, arg_max(y, i) AS yb, covar_samp(x, y) AS c, var_samp(x) AS vx, var_samp(y) AS vy FROM s GROUP BY 1),
a AS (SELECT *, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) AS chord, CASE WHEN point_count < 2 THEN 0 ELSE -0.5 * degrees(atan2(2 * c, vx - vy)) END AS angle FROM n)
SELECT path_id, point_count, round(length, 6) AS length, round(CASE WHEN chord < 1e-6 OR point_count < 2 THEN 1 ELSE greatest(1, length / chord) END, 6) AS tortuosity, round(CASE WHEN angle >= 90 THEN angle - 180 ELSE angle END, 6) AS orientation, chord < 1e-6 AS is_loop FROM a""")
def path_shapes(spark, d):
    return rounded(line.shapes(src.polylines(spark, d)), "length", "tortuosity", "orientation")


@query(f"""WITH {SEGMENTS}, t AS (SELECT path_id, max(s) AS total, greatest(2, round_even(max(s) / 50, 0) + 1)::BIGINT AS n FROM s GROUP BY 1),
j AS (SELECT path_id, total / (n - 1) AS unit, unnest(range(0, n)) AS j FROM t)
SELECT j.path_id, j.j, round(CASE WHEN j.j = 0 THEN b.x ELSE b.x0 + (b.x - b.x0) * least(1, greatest(0, (j.j * unit - (b.s - b.seg)) / b.seg)) END, 4) AS x, round(CASE WHEN j.j = 0 THEN b.y ELSE b.y0 + (b.y - b.y0) * least(1, greatest(0, (j.j * unit - (b.s - b.seg)) / b.seg)) END, 4) AS y
FROM j JOIN s b ON b.path_id = j.path_id AND ((j.j = 0 AND b.i = 0) OR (j.j > 0 AND b.i > 0 AND floor((b.s - b.seg) / unit + 1e-9) < j.j AND floor(b.s / unit + 1e-9) >= j.j))""")
def resample_uniform(spark, d):
    return line.resample_uniform(src.polylines(spark, d), 50.0).select("path_id", "j", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


TANGENTS = """e AS (SELECT path_id, i, y, x, count(*) OVER (PARTITION BY path_id) AS n, least(2, greatest(1, count(*) OVER (PARTITION BY path_id) // 2)) AS k, row_number() OVER (PARTITION BY path_id ORDER BY i) - 1 AS place FROM points),
t0 AS (SELECT e.path_id, e.i, e.n, h.y - l.y AS dy, h.x - l.x AS dx, h1.y - l1.y AS dy1, h1.x - l1.x AS dx1 FROM e JOIN e l ON l.path_id = e.path_id AND l.place = greatest(e.place - e.k, 0) JOIN e h ON h.path_id = e.path_id AND h.place = least(e.place + e.k, e.n - 1)
  JOIN e l1 ON l1.path_id = e.path_id AND l1.place = greatest(e.place - 1, 0) JOIN e h1 ON h1.path_id = e.path_id AND h1.place = least(e.place + 1, e.n - 1)),
t1 AS (SELECT path_id, i, n, CASE WHEN sqrt(dy * dy + dx * dx) < 1e-9 THEN dy1 ELSE dy END AS dy, CASE WHEN sqrt(dy * dy + dx * dx) < 1e-9 THEN dx1 ELSE dx END AS dx FROM t0),
tangents AS (SELECT path_id, i, CASE WHEN n = 1 THEN 0 ELSE dy / CASE WHEN sqrt(dy * dy + dx * dx) < 1e-9 THEN 1 ELSE sqrt(dy * dy + dx * dx) END END AS ty, CASE WHEN n = 1 THEN 1 ELSE dx / CASE WHEN sqrt(dy * dy + dx * dx) < 1e-9 THEN 1 ELSE sqrt(dy * dy + dx * dx) END END AS tx FROM t1)"""


@query(f"WITH {POINTS}, {TANGENTS} SELECT path_id, i, round(ty, 6) + 0.0 AS ty, round(tx, 6) + 0.0 AS tx FROM tangents")
def tangents(spark, d):
    return rounded(line.tangents(src.polylines(spark, d)), "ty", "tx").withColumns({c: F.col(c) + 0.0 for c in ("ty", "tx")})


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, (i % 7 + 1) * 0.1 AS scale FROM s), l AS (SELECT *, seg * (scale + lag(scale) OVER (PARTITION BY path_id ORDER BY i)) / 2 AS mm FROM m)
SELECT path_id, round(CASE WHEN count(*) >= 2 THEN sum(mm) END, 6) AS length_mm FROM l GROUP BY 1""")
def length_mm(spark, d):
    return rounded(line.length_mm(src.polylines(spark, d).withColumn("scale", (F.col("i") % 7 + 1) * 0.1), "scale"), "length_mm")


@query(f"""WITH {POINTS}, j AS (SELECT path_id, x AS jx, y AS jy FROM points WHERE i % 10 = 0)
SELECT p.path_id, p.i, min(sqrt((x - jx) ** 2 + (y - jy) ** 2)) <= greatest((p.i % 20) * 1.5, 2.0) AS at_junction FROM points p JOIN j ON j.path_id = p.path_id GROUP BY p.path_id, p.i""")
def junction_mask(spark, d):
    points = src.polylines(spark, d)
    junctions = points.where("i % 10 = 0").select("path_id", F.col("x").alias("jx"), F.col("y").alias("jy"))
    return line.junction_mask(points.withColumn("width", (F.col("i") % 20).cast("double")), junctions)


@query(f"WITH {WIDTHS} SELECT instance_id, {', '.join(f'round(width_{n}_{u}, 6) AS width_{n}_{u}' for n in ('max', 'mean', 'p95') for u in ('px', 'mm'))}, excluded, {SEVERITY.format('width_max_mm')} AS severity FROM summary")
def width_summary(spark, d):
    return rounded(inst.width_summary(src.width_samples(spark, d)), *[f"width_{n}_{u}" for n in ("max", "mean", "p95") for u in ("px", "mm")])


@query(f"WITH {TOTALS} SELECT instance_id, paths, round(length_px, 4) AS length_px, round(length_mm, 4) AS length_mm, orientation, tortuosity FROM totals")
def instance_totals(spark, d):
    return inst.instance_totals(src.paths(spark, d)).withColumns({c: F.round(c, 4) for c in ("length_px", "length_mm")})


def instances(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, instance_id, ..): every order is an instance in the image of its customer."""
    o = src.read(spark, d, "orders")
    key, y0, x0 = F.col("o_orderkey"), F.col("o_orderkey") % 8, F.col("o_orderkey") % 9 + 1
    box = classify.touches_border(y0, x0, y0 + 50 + F.col("o_custkey") % 10, x0 + 40, 64, 64)
    named = o.select(key.alias("instance_id"), F.col("o_custkey").alias("image_id"), box.alias("touches_border"))
    return inst.with_totals(inst.with_width_figures(src.lines(spark, d).join(named, "instance_id")))


INSTANCES = f"{WIDTHS}, {TOTALS}, instances AS (SELECT *, o_custkey AS image_id, o_orderkey % 8 = 0 OR o_orderkey % 8 + 50 + o_custkey % 10 >= 64 OR o_orderkey % 9 + 1 + 40 >= 64 AS touches_border FROM summary JOIN totals USING (instance_id) JOIN orders ON o_orderkey = instance_id)"


@query(f"WITH {INSTANCES} SELECT instance_id, image_id, row_number() OVER (PARTITION BY image_id ORDER BY width_max_px DESC, length_px DESC, instance_id) - 1 AS rank FROM instances")
def instance_rank(spark, d):
    return inst.ranked(instances(spark, d), "image_id").select("instance_id", "image_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {INSTANCES}, n AS (SELECT image_id, count(*) AS count, max(width_max_px) AS px, max(width_max_mm) FILTER (WHERE width_max_mm >= 0) AS mm, sum(length_px) AS total, CASE WHEN min(length_mm) >= 0 THEN sum(length_mm) ELSE -1 END AS total_mm, count(*) FILTER (WHERE touches_border) AS at_border FROM instances GROUP BY 1)
SELECT c_custkey AS image_id, coalesce(count, 0) AS count, coalesce(px, -1) AS width_max_px, round(coalesce(mm, -1), 6) AS width_max_mm, round(coalesce(total, 0), 4) AS total_px, round(CASE WHEN count IS NULL THEN 0 ELSE total_mm END, 4) AS total_mm, coalesce(at_border, 0) AS at_border, CASE WHEN count IS NULL THEN 'none' ELSE {SEVERITY.format('mm')} END AS severity FROM customer LEFT JOIN n ON image_id = c_custkey""")
def image_summary(spark, d):
    images = src.read(spark, d, "customer").select(F.col("c_custkey").alias("image_id"))
    return rounded(inst.image_summary(images, instances(spark, d)), "width_max_mm").withColumns({c: F.round(c, 4) for c in ("total_px", "total_mm")})


@query("""WITH o AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 7 = 0 THEN 5 + o_custkey % 100 END AS marker, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e6 END AS given, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey % 90 END AS tilt, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 100 END AS depth FROM orders),
s AS (SELECT *, CASE WHEN marker >= 12 THEN 60.0::DOUBLE / marker END AS aruco, CASE WHEN given > 0 THEN given END AS explicit,
  CASE WHEN depth > 0 AND tilt >= 75 THEN NULL WHEN depth > 0 AND tilt >= 0 THEN depth / 1000 / greatest(cos(radians(tilt)), 1e-3) WHEN depth > 0 THEN depth / 1000 END AS lidar, CASE WHEN tilt >= 45 THEN 0.4 WHEN tilt >= 0 THEN 0.7 ELSE 0.6 END AS sure FROM o),
c AS (SELECT *, coalesce(aruco, explicit, lidar) AS chosen, CASE WHEN aruco IS NOT NULL THEN 'aruco' WHEN explicit IS NOT NULL THEN 'explicit' WHEN lidar IS NOT NULL THEN 'lidar' ELSE 'none' END AS source, (aruco IS NOT NULL)::INT + (explicit IS NOT NULL)::INT + (lidar IS NOT NULL)::INT AS offers FROM s),
r AS (SELECT *, source <> 'explicit' AND explicit IS NOT NULL AND (chosen / greatest(explicit, 1e-9) > 1.15 OR chosen / greatest(explicit, 1e-9) < 0.87) AS e_off, source <> 'lidar' AND lidar IS NOT NULL AND (chosen / greatest(lidar, 1e-9) > 1.15 OR chosen / greatest(lidar, 1e-9) < 0.87) AS l_off FROM c)
SELECT image_id, source, round(coalesce(chosen, -1), 9) AS mm_per_px, CASE source WHEN 'none' THEN 0 WHEN 'lidar' THEN sure ELSE 1 END::DOUBLE AS confidence, offers, e_off OR l_off AS disagree,
  concat_ws('; ', CASE WHEN marker < 12 THEN 'marker of ' || marker || ' px is too small' END, CASE WHEN depth > 0 AND tilt >= 75 THEN 'tilt of ' || tilt || ' degrees is too steep' END,
    CASE WHEN offers > 1 THEN 'several scales offered (' || concat_ws(', ', CASE WHEN aruco IS NOT NULL THEN 'aruco' END, CASE WHEN explicit IS NOT NULL THEN 'explicit' END, CASE WHEN lidar IS NOT NULL THEN 'lidar' END) || '); ' || source || ' is used' END,
    CASE WHEN e_off THEN printf('explicit differs by %.0f percent', abs(1 - chosen / explicit) * 100) END, CASE WHEN l_off THEN printf('lidar differs by %.0f percent', abs(1 - chosen / lidar) * 100) END) AS warnings FROM r""")
def scale_priority(spark, d):
    # nine places: prices have ties at six
    return inst.resolve_scale(src.scale_offers(spark, d)).withColumn("mm_per_px", F.round("mm_per_px", 9)).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""WITH {POINTS}, j AS (SELECT path_id, i, 1 + 0.0001 * x + 0.0002 * y AS w, (1.2 * x + 0.1 * y + 3) / (1 + 0.0001 * x + 0.0002 * y) AS u, (0.2 * x + 0.9 * y - 2) / (1 + 0.0001 * x + 0.0002 * y) AS v FROM points)
SELECT path_id, i, round(sqrt(greatest(abs((1.2 - u * 0.0001) / w * (0.9 - v * 0.0002) / w - (0.1 - u * 0.0002) / w * (0.2 - v * 0.0001) / w), 1e-18)), 6) AS mm_per_px FROM j""")
def homography_scale(spark, d):
    h = [F.lit(v) for v in (1.2, 0.1, 3.0, 0.2, 0.9, -2.0, 0.0001, 0.0002, 1.0)]
    return rounded(src.polylines(spark, d).select("path_id", "i", classify.homography_scale(h, F.col("x"), F.col("y")).alias("mm_per_px")), "mm_per_px")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 0 THEN 'unknown' WHEN n >= 6 AND n / greatest(p_retailprice, 1) >= 0.004 AND p_retailprice / greatest(a, 1) >= 0.06 THEN 'map' WHEN n >= 1 THEN 'branched' ELSE 'linear' END AS pattern FROM (SELECT *, p_partkey % 12 AS n, p_size * 500.0 AS a FROM part)")
def pattern(spark, d):
    return src.read(spark, d, "part").select("p_partkey", classify.pattern(F.col("p_partkey") % 12, F.col("p_retailprice"), F.col("p_size") * 500.0).alias("pattern"))


@query("""SELECT count(*) FILTER (WHERE p.k IS NULL) AS missed, count(*) FILTER (WHERE t.k IS NULL) AS invented, count(*) FILTER (WHERE t.k IS NOT NULL AND p.k IS NOT NULL) AS compared
FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0) t FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') p ON t.k = p.k""")
def match_outcome(spark, d):
    truth = src.read(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"))
    return inst.match_outcome(truth, src.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct(), "k")


@query("""WITH e AS (SELECT l_quantity AS t, l_quantity * (1 + l_tax - l_discount) AS p FROM lineitem)
SELECT round(median(p - t), 6) AS median_err, round(avg(p - t), 6) AS mean_err, round(median(abs(p - t)), 6) AS median_abs, round(quantile_cont(abs(p - t), 0.9), 6) AS p90_abs, round(median((p - t) / greatest(t, 1e-6)), 6) AS median_rel, median(t) AS median_truth FROM e""")
def error_stats(spark, d):
    pairs = src.read(spark, d, "lineitem").select(F.col("l_quantity").alias("truth"), (F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("pred"))
    return rounded(inst.error_stats(pairs), "median_err", "mean_err", "median_abs", "p90_abs", "median_rel")


@query("SELECT p_name AS name, p_partkey FROM part LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS w FROM part WHERE p_partkey % 4 > 0) ON k = p_partkey WHERE w IS NULL OR w = 0 OR w <= 20")
def filter_linear(spark, d):
    part = src.read(spark, d, "part")
    widths = part.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).alias("width"))
    names = part.select(F.col("p_partkey").alias("name"), F.col("p_name"))
    return inst.filter_linear(names, widths, 20.0).select(F.col("p_name").alias("name"), F.col("name").alias("p_partkey"))


@query("SELECT o_orderkey AS stem FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_pairs(spark, d):
    masks = src.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("stem"))
    return images.paired(src.read(spark, d, "orders").select(F.col("o_orderkey").alias("stem")), masks)


@query("""SELECT doc_id, CASE WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too many bytes' WHEN n_chars % 13 = 0 THEN 'not an image' WHEN (n_chars % 100) * (n_chars % 77) > 5000 THEN 'too many pixels' WHEN n_chars % 100 < 32 OR n_chars % 77 < 32 THEN 'too small' END AS reject_reason FROM documents""")
def decode_rules(spark, d):
    n = F.col("n_chars")
    reason = images.reject_reason(n, F.when(n % 13 > 0, n % 100), n % 77, 5000, 5000)
    taken, rejected = images.split_rejected(src.read(spark, d, "documents"), reason)
    return taken.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("doc_id", "reject_reason"))


@query(r"""WITH n AS (SELECT page_id, html, trim(regexp_extract(trim(coalesce(url, '')), '([^/]*)/*$', 1)) AS base FROM pages), s AS (SELECT *, CASE WHEN regexp_full_match(base, '.+\.[^.]+') THEN regexp_replace(base, '\.[^.]+$', '') ELSE base END AS stem FROM n),
t AS (SELECT *, trim(regexp_replace(stem, '[^\p{L}\p{N}\-_.]', '_', 'g'), '_') AS c FROM s)
SELECT page_id, lpad(page_id::VARCHAR, 6, '0') || '_' || CASE WHEN length(c) >= 4 AND length(c) - length(replace(c, '_', '')) < length(c) / 2.0 THEN left(c, 60) ELSE left(sha1(html), 10) END AS name FROM t""")
def name_of(spark, d):
    return src.read(spark, d, "pages").select("page_id", images.name_of(F.col("url"), F.col("html"), F.col("page_id")).alias("name"))


@query()
def annotation_widths(spark, d):
    return rounded(ras.annotation_widths(mask(spark, d)), "width_px")


@query()
def width_bias(spark, d):
    r = src.raster(spark, d)
    return rounded(ras.width_bias(ras.threshold_mask(r, 0.7), ras.threshold_mask(r, 0.8)), "width_bias")

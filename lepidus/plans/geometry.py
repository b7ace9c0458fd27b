"""Plans over shapes: an embedding's 64 numbers are 32 interleaved points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.functions import geometry
from lepidus.operators import shapes
from lepidus.plans import Tables, query

PTS = "pts AS (SELECT vec_id AS shape_id, k AS i, embedding[2 * k + 1]::DOUBLE AS x, embedding[2 * k + 2]::DOUBLE AS y FROM embeddings, range(32) r(k))"
ARC = f"""{PTS}, nxt AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY i)),
 st AS (SELECT *, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS step FROM nxt), arc AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY shape_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM st)"""
CEN = f"""{PTS}, mid AS (SELECT shape_id, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM pts WINDOW w AS (PARTITION BY shape_id)),
 cen AS (SELECT shape_id, i, x / sqrt(sum(x * x + y * y) OVER w) AS x, y / sqrt(sum(x * x + y * y) OVER w) AS y FROM mid WINDOW w AS (PARTITION BY shape_id)), ref AS (SELECT i, x AS rx, y AS ry FROM cen WHERE shape_id = 0)"""
PRO = f"{CEN}, pro AS (SELECT shape_id, sum(x * rx) AS a11, sum(x * ry) AS a12, sum(y * rx) AS a21, sum(y * ry) AS a22 FROM cen JOIN ref USING (i) GROUP BY 1)"
PCA = f"""{PTS}, cov AS (SELECT shape_id, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, count(*) AS n FROM pts GROUP BY 1),
 pca AS (SELECT shape_id, atan2(2 * sxy, sxx - syy) / 2 AS angle, (sxx + syy) / 2 + sqrt(((sxx - syy) / 2) ** 2 + sxy * sxy) AS l1, (sxx + syy) / 2 - sqrt(((sxx - syy) / 2) ** 2 + sxy * sxy) AS l2, n FROM cov)"""


def points(t: Tables) -> DataFrame:
    return shapes.from_array(t.embeddings, "vec_id", "embedding")


def outlines(t: Tables, scale: float = 40.0) -> DataFrame:
    """Each shape's points in order of their angle around the middle: a ring that doesn't cross itself."""
    return shapes.by_angle(points(t)).select("shape_id", "i", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


@query("w08_arc_length", f"WITH {ARC} SELECT shape_id, i, round(step, 6) AS step, round(cum, 6) AS cum FROM arc")
def _(t: Tables) -> DataFrame:
    return shapes.arc_length(points(t)).select("shape_id", "i", *_r("step", "cum"))


@query("g05_area_perimeter", f"WITH {ARC} SELECT shape_id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area, round(sum(step), 6) AS perimeter FROM arc GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return shapes.area_perimeter(points(t)).select("shape_id", *_r("area", "perimeter"))


@query(
    "g06_equivalent_diameter",
    f"WITH {ARC}, b AS (SELECT shape_id, abs(sum(x * ny - nx * y)) / 2 AS area, (max(x) - min(x)) * (max(y) - min(y)) AS box FROM arc GROUP BY 1) SELECT shape_id, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter, round(area / box, 6) AS extent FROM b",
)
def _(t: Tables) -> DataFrame:
    box = points(t).groupBy("shape_id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"))
    a = shapes.area_perimeter(points(t)).join(box, "shape_id")
    return a.select("shape_id", F.round(F.sqrt(4 * F.col("area") / F.pi()), 6).alias("equivalent_diameter"), F.round(F.try_divide("area", "box"), 6).alias("extent"))


@query("g06_hull")
def _(t: Tables) -> DataFrame:
    h = shapes.hull(points(t)).join(shapes.area_perimeter(points(t)), "shape_id")
    return h.select("shape_id", "hull_points", *_r("hull_area"), F.round(F.try_divide("area", "hull_area"), 6).alias("solidity"))


@query("g07_axis_lengths", f"WITH {PCA} SELECT shape_id, round(2 * sqrt(l1) * sqrt(n), 6) AS major, round(2 * sqrt(greatest(l2, 0)) * sqrt(n), 6) AS minor, round(degrees(angle), 4) AS orientation FROM pca")
def _(t: Tables) -> DataFrame:
    a = shapes.principal(points(t))
    axis = lambda c: F.round(2 * F.sqrt(F.greatest(F.col(c), F.lit(0.0))) * F.sqrt("n"), 6)
    return a.select("shape_id", axis("l1").alias("major"), axis("l2").alias("minor"), F.round(F.degrees("angle"), 4).alias("orientation"))


@query(
    "g03_g04_length_height",
    f"""WITH {PCA}, uv AS (SELECT shape_id, x * cos(angle) + y * sin(angle) AS u, y * cos(angle) - x * sin(angle) AS v FROM pts JOIN pca USING (shape_id)),
 e AS (SELECT *, min(u) OVER (PARTITION BY shape_id) AS u0, max(u) OVER (PARTITION BY shape_id) AS u1 FROM uv),
 b AS (SELECT shape_id, CASE WHEN u >= u1 THEN 20 ELSE floor((u - u0) / ((u1 - u0) / 19)) + 1 END AS bin, max(v) - min(v) AS h, min(u0) AS u0, max(u1) AS u1 FROM e GROUP BY ALL)
 SELECT shape_id, round(max(u1) - min(u0), 6) AS length, round(greatest(max(h), 0), 6) AS height FROM b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return shapes.length_height(points(t), 20).select("shape_id", *_r("length", "height"))


def _reference(t: Tables) -> DataFrame:
    return shapes.centred(points(t).where("shape_id = 0")).select("i", F.col("x").alias("rx"), F.col("y").alias("ry"))


@query("g08_procrustes", f"WITH {PRO} SELECT shape_id, round(2 - 2 * sqrt((a11 + a22) ** 2 + (a12 - a21) ** 2), 6) AS distance FROM pro")
def _(t: Tables) -> DataFrame:
    return shapes.procrustes(points(t), _reference(t)).select("shape_id", *_r("distance"))


@query("g09_reflection", f"WITH {PRO} SELECT shape_id, round(1 - greatest((a11 + a22) ** 2 + (a12 - a21) ** 2, (a11 - a22) ** 2 + (a12 + a21) ** 2), 6) AS disparity FROM pro")
def _(t: Tables) -> DataFrame:
    return shapes.procrustes(points(t), _reference(t)).select("shape_id", *_r("disparity"))


@query(
    "g10_aligned",
    f"WITH {PRO}, ang AS (SELECT shape_id, atan2(a12 - a21, a11 + a22) AS a FROM pro) SELECT shape_id, i, round(x * cos(a) - y * sin(a), 6) AS x, round(x * sin(a) + y * cos(a), 6) AS y FROM cen JOIN ang USING (shape_id)",
)
def _(t: Tables) -> DataFrame:
    c = shapes.centred(points(t)).join(shapes.procrustes(points(t), _reference(t)), "shape_id")
    co, si = F.cos("angle"), F.sin("angle")
    return c.select("shape_id", "i", F.round(F.col("x") * co - F.col("y") * si, 6).alias("x"), F.round(F.col("x") * si + F.col("y") * co, 6).alias("y"))


@query(
    "j15_best_shift",
    f"""WITH {CEN}, s AS (SELECT shape_id, (cen.i - ref.i + 32) % 32 AS shift, sum(x * rx) AS a11, sum(x * ry) AS a12, sum(y * rx) AS a21, sum(y * ry) AS a22 FROM cen, ref GROUP BY ALL),
 d AS (SELECT shape_id, shift, round(2 - 2 * sqrt((a11 + a22) ** 2 + (a12 - a21) ** 2), 9) AS distance FROM s) SELECT shape_id, min({{'d': distance, 's': shift}}).s AS shift, round(min(distance), 6) AS distance FROM d GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return shapes.best_shift(points(t), _reference(t), 32).select("shape_id", "shift", *_r("distance"))


@query(
    "j15_best_flip",
    f"""WITH {CEN}, s AS (SELECT shape_id, (cen.i - ref.i + 32) % 32 AS shift, sum(x * rx) AS a11, sum(x * ry) AS a12, sum(y * rx) AS a21, sum(y * ry) AS a22 FROM cen, ref GROUP BY ALL),
 d AS (SELECT shape_id, shift, flip::INT AS flip, round(2 - 2 * sqrt((fx * a11 + fy * a22) ** 2 + (fx * a12 - fy * a21) ** 2), 9) AS distance FROM s, (VALUES (0, 1, 1), (1, -1, 1), (2, 1, -1), (3, -1, -1)) f(flip, fx, fy))
 SELECT shape_id, min({{'d': distance, 'f': flip, 's': shift}}).f AS flip, min({{'d': distance, 'f': flip, 's': shift}}).s AS shift, round(min(distance), 6) AS distance FROM d GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return shapes.best_flip(points(t), _reference(t), 32).select("shape_id", "flip", "shift", *_r("distance"))


@query(
    "w16_reindexed",
    f"""WITH {PTS}, ref AS (SELECT i, x AS rx, y AS ry FROM pts WHERE shape_id = 0), d AS (SELECT shape_id, (pts.i - ref.i + 32) % 32 AS shift, round(sum(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))), 9) AS distance FROM pts, ref GROUP BY ALL)
 SELECT shape_id, min({{'d': distance, 's': shift}}).s AS shift, round(min(distance), 6) AS distance FROM d GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    ref = points(t).where("shape_id = 0").select("i", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return shapes.reindexed(points(t), ref, 32).select("shape_id", "shift", *_r("distance"))


@query(
    "g11_resampled",
    f"""WITH {ARC}, tot AS (SELECT *, sum(step) OVER (PARTITION BY shape_id) / 19 AS gap FROM arc), s AS (SELECT DISTINCT shape_id, k, gap FROM tot, range(20) r(k)),
 place AS (SELECT a.shape_id, s.k AS i, x, y, nx, ny, step, (s.k * s.gap - cum) / step AS part, row_number() OVER (PARTITION BY a.shape_id, s.k ORDER BY a.i DESC) AS rn FROM s JOIN tot a ON a.shape_id = s.shape_id AND s.k * s.gap >= a.cum - 1e-12)
 SELECT shape_id, i, round(x + part * (nx - x), 6) AS x, round(y + part * (ny - y), 6) AS y FROM place WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    return shapes.resampled(points(t), 20).select("shape_id", "i", *_r("x", "y"))


FEW = ARC.replace("range(32) r(k))", "range(32) r(k) WHERE k < 10 + vec_id % 5)")


@query(
    "g33_equal_counts",
    f"""WITH {FEW}, tot AS (SELECT *, sum(step) OVER (PARTITION BY shape_id) / 9 AS gap FROM arc), s AS (SELECT DISTINCT shape_id, k, gap FROM tot, range(10) r(k)),
 place AS (SELECT a.shape_id, s.k AS i, x, y, nx, ny, step, (s.k * s.gap - cum) / step AS part, row_number() OVER (PARTITION BY a.shape_id, s.k ORDER BY a.i DESC) AS rn FROM s JOIN tot a ON a.shape_id = s.shape_id AND s.k * s.gap >= a.cum - 1e-12)
 SELECT shape_id, i, round(x + part * (nx - x), 6) AS x, round(y + part * (ny - y), 6) AS y FROM place WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    p = points(t).where("i < 10 + shape_id % 5")
    least = p.groupBy("shape_id").count().agg(F.min("count")).first()[0]  # one number, 10 here
    return shapes.resampled(p, least).select("shape_id", "i", *_r("x", "y"))


@query(
    "g13_back_transform",
    f"""WITH {CEN}, j AS (SELECT shape_id, cen.x, cen.y, pts.x AS tx, pts.y AS ty FROM cen JOIN pts USING (shape_id, i)),
 g AS (SELECT shape_id, avg(x) AS mx, avg(y) AS my, avg(tx) AS mtx, avg(ty) AS mty, (covar_pop(x, tx) + covar_pop(y, ty)) / (var_pop(x) + var_pop(y)) AS a, (covar_pop(x, ty) - covar_pop(y, tx)) / (var_pop(x) + var_pop(y)) AS b FROM j GROUP BY 1)
 SELECT shape_id, round(sqrt(a * a + b * b), 6) AS scale, round(mtx - a * mx + b * my, 6) AS dx, round(mty - b * mx - a * my, 6) AS dy FROM g""",
)
def _(t: Tables) -> DataFrame:
    p = points(t)
    return shapes.back_transform(shapes.centred(p), p).select("shape_id", *_r("scale", "dx", "dy"))


@query("a18_mean_shape")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(shapes.mean_shape(points(t)).round(6))


@query(
    "w07_repeated_points",
    """WITH RECURSIVE pts AS (SELECT vec_id AS shape_id, k AS i, round(embedding[2 * k + 1]::DOUBLE, 1) AS x, round(embedding[2 * k + 2]::DOUBLE, 1) AS y FROM embeddings, range(32) r(k)),
 f AS (SELECT shape_id, i, x, y, x AS lx, y AS ly, 1 AS kept FROM pts WHERE i = 0
 UNION ALL SELECT p.shape_id, p.i, p.x, p.y, CASE WHEN far THEN p.x ELSE lx END, CASE WHEN far THEN p.y ELSE ly END, kept + far::INT FROM (SELECT p.*, f.lx, f.ly, f.kept, sqrt((p.x - f.lx) ** 2 + (p.y - f.ly) ** 2) >= 0.15 AS far FROM f JOIN pts p ON p.shape_id = f.shape_id AND p.i = f.i + 1) p)
 SELECT shape_id, max(kept) AS n FROM f GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.round(F.get("embedding", 2 * k).cast("double"), 1).alias("x"), F.round(F.get("embedding", 2 * k + 1).cast("double"), 1).alias("y")))
    return t.embeddings.select(F.col("vec_id").alias("shape_id"), F.size(geometry.kept_points(each, 0.15)).alias("n"))


@query(
    "w09_bending_energy",
    f"""WITH {PTS}, d AS (SELECT shape_id, i, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY i)),
 e AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM d WINDOW w AS (PARTITION BY shape_id ORDER BY i)),
 a AS (SELECT shape_id, acos(greatest(-1, least(1, (dx * ex + dy * ey) / nullif(sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey), 0)))) AS angle FROM e WHERE ex IS NOT NULL),
 l AS (SELECT shape_id, sum(sqrt(dx * dx + dy * dy)) AS len FROM d WHERE dx IS NOT NULL GROUP BY 1) SELECT shape_id, round(sum(angle * angle) / max(len) ** 2, 6) AS energy FROM a JOIN l USING (shape_id) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    d = points(t).withColumn("dx", F.lead("x").over(shapes.ring()) - F.col("x")).withColumn("dy", F.lead("y").over(shapes.ring()) - F.col("y"))
    d = d.withColumn("ex", F.lead("dx").over(shapes.ring())).withColumn("ey", F.lead("dy").over(shapes.ring())).withColumn("l", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    cos = F.try_divide(F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey"), F.col("l") * F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    return d.groupBy("shape_id").agg(F.round(F.try_divide(F.sum(angle * angle), F.pow(F.sum("l"), F.lit(2))), 6).alias("energy"))


@query("w13_ordered_keypoints", "SELECT vec_id, list_transform(list_sort(list_transform(range(64), lambda k: {'o': round(embedding[k + 1], 4), 'k': k})), lambda s: s.k) AS sequence FROM embeddings")
def _(t: Tables) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda k: F.struct(F.round(F.get("embedding", k.cast("int")), 4).alias("o"), k.alias("k")))
    return t.embeddings.select("vec_id", F.transform(F.array_sort(pairs), lambda s: s["k"]).alias("sequence"))


@query(
    "w16_nearest_order",
    f"""WITH RECURSIVE {PTS}, f AS (SELECT shape_id, 0 AS rank, i, x, y, [i] AS seen FROM pts WHERE i = 0 UNION ALL SELECT shape_id, rank, i, x, y, list_append(seen, i) FROM (
 SELECT f.shape_id, f.rank + 1 AS rank, p.i, p.x, p.y, f.seen, row_number() OVER (PARTITION BY f.shape_id ORDER BY (p.x - f.x) ** 2 + (p.y - f.y) ** 2, p.i) AS k FROM f JOIN pts p ON p.shape_id = f.shape_id AND NOT list_contains(f.seen, p.i)) WHERE k = 1) SELECT shape_id, i, rank FROM f""",
)
def _(t: Tables) -> DataFrame:
    return shapes.nearest_order(points(t))


@query("t06_extreme_points", f"WITH {PTS} SELECT shape_id, max_by(i, {{'a': x + y, 'b': i}}) AS farthest, min_by(i, {{'a': x + y, 'b': i}}) AS closest FROM pts GROUP BY 1")
def _(t: Tables) -> DataFrame:
    key = F.struct((F.col("x") + F.col("y")).alias("a"), F.col("i").cast("long").alias("b"))
    i = F.col("i").cast("long")
    return points(t).groupBy("shape_id").agg(F.max_by(i, key).alias("farthest"), F.min_by(i, key).alias("closest"))


@query("t07_diameter", f"WITH {PTS} SELECT a.shape_id, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS diameter FROM pts a JOIN pts b ON a.shape_id = b.shape_id AND a.i < b.i GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # all pairs of one shape meet inside its row: no join
    p = points(t).groupBy("shape_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))))))
    return p.select("shape_id", F.round(far, 6).alias("diameter"))


@query("g28_back_projection", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_suppkey - 50) * z / 797.3, 6) AS x, round((l_quantity - 25) * z / 797.3, 6) AS y FROM (SELECT *, CASE WHEN l_discount = 0 THEN 1e-6 ELSE l_discount END AS z FROM lineitem)")
def _(t: Tables) -> DataFrame:
    z = F.when(F.col("l_discount") == 0, F.lit(1e-6)).otherwise(F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_suppkey") - 50) * z / 797.3, 6).alias("x"), F.round((F.col("l_quantity") - 25) * z / 797.3, 6).alias("y"))


@query("g29_calibration", "SELECT l_orderkey, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS depth, round(avg(l_tax) / nullif(avg(l_discount) FILTER (l_returnflag = 'A'), 0), 5) AS factor FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    inside = F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_discount")))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(inside, 6).alias("depth"), F.round(F.try_divide(F.avg("l_tax"), inside), 5).alias("factor"))


@query("g34_label_region", "SELECT p_partkey, greatest(p_size - 50, 0) AS x0, greatest(p_partkey - 50, 0) AS y0, p_size + 50 AS x1, p_partkey AS y1 FROM part")
def _(t: Tables) -> DataFrame:
    zero = F.lit(0)
    return t.part.select("p_partkey", F.greatest(F.col("p_size") - 50, zero).alias("x0"), F.greatest(F.col("p_partkey") - 50, zero).alias("y0"), (F.col("p_size") + 50).alias("x1"), F.col("p_partkey").alias("y1"))


@query("g01_rasterised", None)
def _(t: Tables) -> DataFrame:
    return shapes.rasterised(outlines(t))


@query("g27_thinned", None)
def _(t: Tables) -> DataFrame:
    pixels = shapes.rasterised(outlines(t)).select(F.col("shape_id").alias("mask_id"), "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return shapes.thinned(pixels)


@query("j18_interpolated", "WITH e AS (SELECT user_id, value, floor(extract(epoch FROM ts))::BIGINT AS s, lead(floor(extract(epoch FROM ts))::BIGINT) OVER w AS s2, lead(value) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, k * 86400 + 1704067200 AS at_s, round(value + (k * 86400 + 1704067200 - s) / (s2 - s)::DOUBLE * (v2 - value), 6) AS v FROM e JOIN range(31) r(k) ON k * 86400 + 1704067200 >= s AND k * 86400 + 1704067200 < s2")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    e = e.withColumn("s2", F.lead("s").over(w)).withColumn("v2", F.lead("value").over(w)).where("s2 > s")
    first = F.lit(1704067200)
    lo, hi = F.ceil((F.col("s") - first) / 86400), F.ceil((F.col("s2") - first) / 86400) - 1
    k = e.withColumn("lo", F.greatest(lo, F.lit(0))).withColumn("hi", F.least(hi, F.lit(30))).where("hi >= lo").withColumn("k", F.explode(F.sequence("lo", "hi"))).withColumn("at_s", F.col("k") * 86400 + first)
    return k.select("user_id", "at_s", F.round(F.col("value") + (F.col("at_s") - F.col("s")) / (F.col("s2") - F.col("s")) * (F.col("v2") - F.col("value")), 6).alias("v"))

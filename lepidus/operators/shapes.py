"""Outlines and landmarks: arc length, resampling, measures, alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lepidus.functions import geometry
from lepidus.operators.lineage import bounded



def ring() -> WindowSpec:
    """Each shape's points in order."""
    return Window.partitionBy("shape_id").orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy("shape_id")


def from_array(df: DataFrame, id_: str, values: str) -> DataFrame:
    """(shape_id, i, x, y) from an interleaved array x0, y0, x1, y1, ..."""
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1), lambda k: F.struct(k.alias("i"), F.get(F.col(values), 2 * k).cast("double").alias("x"), F.get(F.col(values), 2 * k + 1).cast("double").alias("y")))
    return df.where(F.size(values) > 1).select(F.col(id_).alias("shape_id"), F.explode(each).alias("p")).select("shape_id", "p.i", "p.x", "p.y")


def by_angle(points: DataFrame) -> DataFrame:
    """Points renumbered by their angle around their shape's middle, ties by their number."""
    mid = points.withColumn("mx", F.avg("x").over(whole())).withColumn("my", F.avg("y").over(whole()))
    turn = F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx"))
    return mid.withColumn("i", (F.row_number().over(Window.partitionBy("shape_id").orderBy(turn, "i")) - 1).cast("int")).select("shape_id", "i", "x", "y")


def arc_length(points: DataFrame, closed: bool = True) -> DataFrame:
    """Points with ``step`` to the next (a closed ring's last to its first) and ``cum``, the length before them."""
    nx, ny = F.lead("x").over(ring()), F.lead("y").over(ring())
    if closed:
        nx, ny = F.coalesce(nx, F.first("x").over(ring())), F.coalesce(ny, F.first("y").over(ring()))
    out = points.withColumn("nx", nx).withColumn("ny", ny).withColumn("step", F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2))))
    return out.withColumn("cum", F.coalesce(F.sum("step").over(ring().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def resampled(points: DataFrame, n: int = 100) -> DataFrame:
    """n points at equal arc length, the first repeated as the last (a ring's ends meet).

    Each segment makes the samples that fall on it, so no join is needed and a shape's points stay where they are.
    A ring of no length repeats its point.
    """
    a = arc_length(points).withColumn("total", F.sum("step").over(whole())).withColumn("last", F.col("i") == F.max("i").over(whole()))
    gap = F.col("total") / (n - 1)
    lo = F.when(F.col("cum") == 0, F.lit(0)).otherwise(F.ceil(F.try_divide(F.col("cum"), gap) - 1e-9)).cast("int")
    hi = F.when(F.col("last"), F.lit(n - 1)).otherwise(F.ceil(F.try_divide(F.col("cum") + F.col("step"), gap) - 1e-9).cast("int") - 1)
    flat = F.col("total") == 0
    lo, hi = F.when(flat, F.when(F.col("last"), 0)).otherwise(lo), F.when(flat, n - 1).otherwise(hi)
    k = a.withColumn("gap", gap).withColumn("lo", lo).withColumn("hi", hi).where("step > 0 or (total = 0 and last)").where("hi >= lo")
    k = k.withColumn("k", F.explode(F.sequence("lo", "hi")))
    part = F.coalesce(F.try_divide(F.col("k") * F.col("gap") - F.col("cum"), "step"), F.lit(0.0))
    return k.select("shape_id", F.col("k").alias("i"), (F.col("x") + part * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + part * (F.col("ny") - F.col("y"))).alias("y"))


def area_perimeter(points: DataFrame) -> DataFrame:
    a = arc_length(points)
    return a.groupBy("shape_id").agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"), F.sum("step").alias("perimeter"), F.count("*").alias("n"))


def principal(points: DataFrame) -> DataFrame:
    """(shape_id, angle, l1, l2, n): the principal axes of each shape, from n - 1 covariances."""
    g = points.groupBy("shape_id").agg(F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"), F.count("*").alias("n"))
    angle, l1, l2 = geometry.axes(F.col("sxx"), F.col("syy"), F.col("sxy"))
    return g.select("shape_id", angle.alias("angle"), l1.alias("l1"), l2.alias("l2"), "n")


def _turned(points: DataFrame) -> DataFrame:
    p = points.join(principal(points), "shape_id")
    c, s = F.cos("angle"), F.sin("angle")
    return p.withColumn("u", F.col("x") * c + F.col("y") * s).withColumn("v", F.col("y") * c - F.col("x") * s)


def length_height(points: DataFrame, edges: int = 100) -> DataFrame:
    """(shape_id, length, height): extent along the first axis, and the greatest extent across it within one of edges - 1 equal bins along it.

    Bins are open at the right, but the greatest value has the last bin, numbered ``edges``, to itself.
    """
    t = _turned(points).withColumn("u0", F.min("u").over(whole())).withColumn("u1", F.max("u").over(whole()))
    width = (F.col("u1") - F.col("u0")) / (edges - 1)
    b = F.when(F.col("u") >= F.col("u1"), edges).otherwise(F.floor(F.try_divide(F.col("u") - F.col("u0"), width)) + 1)
    bins = t.withColumn("bin", b).groupBy("shape_id", "bin").agg((F.max("v") - F.min("v")).alias("h"), F.min("u0").alias("u0"), F.max("u1").alias("u1"))
    return bins.groupBy("shape_id").agg((F.max("u1") - F.min("u0")).alias("length"), F.greatest(F.max("h"), F.lit(0.0)).alias("height"))


def centred(points: DataFrame) -> DataFrame:
    """Points moved to their mean and scaled to unit norm."""
    m = points.withColumn("x", F.col("x") - F.avg("x").over(whole())).withColumn("y", F.col("y") - F.avg("y").over(whole()))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).over(whole()))
    return m.withColumn("_n", norm).select("shape_id", "i", F.try_divide("x", "_n").alias("x"), F.try_divide("y", "_n").alias("y"))


def procrustes(points: DataFrame, reference: DataFrame) -> DataFrame:
    """(shape_id, distance, disparity, angle) against one reference shape (i, rx, ry), centred and of unit norm: four sums a shape."""
    j = centred(points).join(bounded(reference), "i")
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    g = j.groupBy("shape_id").agg(s("x", "rx").alias("a11"), s("x", "ry").alias("a12"), s("y", "rx").alias("a21"), s("y", "ry").alias("a22"))
    a = [F.col(c) for c in ("a11", "a12", "a21", "a22")]
    return g.select("shape_id", geometry.rotation_distance(*a).alias("distance"), geometry.free_disparity(*a).alias("disparity"), F.atan2(a[1] - a[2], a[0] + a[3]).alias("angle"))


def best_shift(points: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """(shape_id, shift, distance): the circular shift of least distance; ties go to the smaller shift.

    Four sums for every shift of every shape; the reference, one row a point, is the side that is repeated.
    """
    turned = bounded(reference.select(F.col("i").alias("ri"), "rx", "ry"))
    j = centred(points).crossJoin(turned).withColumn("shift", F.pmod(F.col("i") - F.col("ri"), F.lit(n)))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    g = j.groupBy("shape_id", "shift").agg(s("x", "rx").alias("a11"), s("x", "ry").alias("a12"), s("y", "rx").alias("a21"), s("y", "ry").alias("a22"))
    d = F.round(geometry.rotation_distance(*[F.col(c) for c in ("a11", "a12", "a21", "a22")]), 9)
    return g.withColumn("distance", d).groupBy("shape_id").agg(F.min(F.struct("distance", "shift")).alias("b")).select("shape_id", "b.shift", "b.distance")


FLIPS = ((1, 1), (-1, 1), (1, -1), (-1, -1))


def best_flip(points: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """(shape_id, flip, shift, distance): over the four reflections of FLIPS and all circular shifts, the least distance; ties go to the earlier flip, then the smaller shift.

    A reflection only changes the signs of the four sums of a shift, so it costs no more rows.
    """
    turned = bounded(reference.select(F.col("i").alias("ri"), "rx", "ry"))  # one shape
    j = centred(points).crossJoin(turned).withColumn("shift", F.pmod(F.col("i") - F.col("ri"), F.lit(n)))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    g = j.groupBy("shape_id", "shift").agg(s("x", "rx").alias("a11"), s("x", "ry").alias("a12"), s("y", "rx").alias("a21"), s("y", "ry").alias("a22"))
    a = [F.col(c) for c in ("a11", "a12", "a21", "a22")]
    each = F.array(*[F.struct(F.round(geometry.rotation_distance(x * a[0], x * a[1], y * a[2], y * a[3]), 9).alias("distance"), F.lit(k).alias("flip"), "shift") for k, (x, y) in enumerate(FLIPS)])
    return g.select("shape_id", F.array_min(each).alias("b")).groupBy("shape_id").agg(F.min("b").alias("b")).select("shape_id", "b.flip", "b.shift", "b.distance")


def reindexed(points: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """(shape_id, shift, distance): the circular shift at which a shape's points, as they are, lie nearest to the reference's (i, rx, ry), by the sum of distances; ties go to the smaller shift."""
    ref = bounded(reference.select(F.col("i").alias("ri"), "rx", "ry"))  # one shape
    j = points.crossJoin(ref).withColumn("shift", F.pmod(F.col("i") - F.col("ri"), F.lit(n)))
    d = F.sum(F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))))
    g = j.groupBy("shape_id", "shift").agg(F.round(d, 9).alias("distance"))
    return g.groupBy("shape_id").agg(F.min(F.struct("distance", "shift")).alias("b")).select("shape_id", "b.shift", "b.distance")


def mean_shape(points: DataFrame, most: int = 100, tolerance: float = 1e-5) -> pd.DataFrame:
    """Generalised Procrustes mean (i, x, y): align all to the mean, average, until it moves less than ``tolerance``.

    The mean is one row a landmark, so it is what travels.  Shapes are centred and packed once, as arrays in order of their
    landmarks; each round is one pass over them, whose batches give a sum for each landmark.
    """
    packed = centred(points).where("x is not null and y is not null").groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = packed.agg(F.min_by("p", "shape_id").alias("p")).select(F.explode("p").alias("p"))
        mean = first.select("p.*").toPandas().sort_values("i", ignore_index=True)
        for _ in range(most):
            new = _turned_sums(packed, mean).groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"), (F.sum("y") / F.sum("n")).alias("y")).toPandas().sort_values("i", ignore_index=True)
            norm = float(np.sqrt((new[["x", "y"]] ** 2).to_numpy().sum()))
            new[["x", "y"]] /= norm or 1.0
            moved = float(np.sqrt(((new - mean)[["x", "y"]] ** 2).to_numpy().sum()))
            mean = new
            if moved < tolerance:
                break
        return mean
    finally:
        packed.unpersist()


def _turned_sums(packed: DataFrame, mean: pd.DataFrame) -> DataFrame:
    """(i, x, y, n): sums of the landmarks of all shapes (p), each shape turned to ``mean``, for each batch."""
    at, to = mean.i.to_numpy(), mean.x.to_numpy() + 1j * mean.y.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, each = np.diff(b.column(0).offsets.to_numpy()), b.column(0).flatten()
            i, x, y = (each.field(c).to_numpy(zero_copy_only=False) for c in ("i", "x", "y"))
            if not len(i):
                continue
            z, shape = x + 1j * y, np.repeat(np.arange(len(n)), n)
            k = np.minimum(np.searchsorted(at, i), len(at) - 1)
            turn = np.where(at[k] == i, z.conj() * to[k], 0)
            whole = np.bincount(shape, turn.real, len(n)) + 1j * np.bincount(shape, turn.imag, len(n))
            z = z * np.exp(1j * np.angle(whole))[shape]
            names, inverse, count = np.unique(i, return_inverse=True, return_counts=True)
            sums = [np.bincount(inverse, v, len(names)) for v in (z.real, z.imag)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *map(pa.array, sums), pa.array(count)], names=["i", "x", "y", "n"])

    return packed.select("p").mapInArrow(run, "i int, x double, y double, n long")


def each_shape(points: DataFrame, names: list[str], run: Callable[..., tuple], schema: str, key: str = "shape_id") -> DataFrame:
    """``run`` on the arrays ``names`` of each shape, in order of the first of them; it gives one array a column of ``schema``, whose first is the shape's key.  Shapes go to Python as rows, many to a batch."""
    packed = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_p")).select(key, *[F.col("_p").getField(n).alias(n) for n in names])
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(k, run(*arrays)) for k, *arrays in f.itertuples(index=False, name=None)]
            sizes = [len(m[0]) for _, m in made]
            values = [np.concatenate([np.asarray(m[c]) for _, m in made]) if made else [] for c in range(len(columns) - 1)]
            yield pd.DataFrame(dict(zip(columns, [np.repeat([k for k, _ in made], sizes), *values])))

    return packed.mapInPandas(go, schema)


def hull(points: DataFrame) -> DataFrame:
    """(shape_id, hull_area, hull_points) by a monotone chain."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple:
        p = sorted({*zip(x.tolist(), y.tolist())})

        def chain(ps: list) -> list:
            out: list = []
            for q in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        h = chain(p) + chain(p[::-1]) if len(p) > 1 else p
        return [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1]))) / 2], [len(h)]

    return each_shape(points, ["x", "y"], run, "shape_id long, hull_area double, hull_points int")


def nearest_order(points: DataFrame) -> DataFrame:
    """Greedy nearest-neighbour order of each shape's points from its first: (shape_id, i, rank)."""

    def run(i: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        xy, left, at, out = np.stack([x, y], axis=1), np.ones(len(x), bool), 0, []
        for _ in range(len(x)):
            out.append(at)
            left[at] = False
            d = np.where(left, ((xy - xy[at]) ** 2).sum(axis=1), np.inf)
            at = int(d.argmin())
        return i[out], np.arange(len(out), dtype=np.int32)

    return each_shape(points, ["i", "x", "y"], run, "shape_id long, i int, rank int")


def back_transform(points: DataFrame, target: DataFrame) -> DataFrame:
    """(shape_id, scale, angle, dx, dy): the similarity that takes each shape to its target of the same id by least squares, from sums alone."""
    j = points.join(target.select("shape_id", "i", F.col("x").alias("tx"), F.col("y").alias("ty")), ["shape_id", "i"])
    g = j.groupBy("shape_id").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("tx").alias("mtx"), F.avg("ty").alias("mty"), (F.var_pop("x") + F.var_pop("y")).alias("v"), (F.covar_pop("x", "tx") + F.covar_pop("y", "ty")).alias("c"), (F.covar_pop("x", "ty") - F.covar_pop("y", "tx")).alias("s")
    )
    a, b = F.try_divide("c", "v"), F.try_divide("s", "v")
    g = g.withColumn("a", a).withColumn("b", b)
    return g.select("shape_id", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("scale"), F.atan2("b", "a").alias("angle"), (F.col("mtx") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("dx"), (F.col("mty") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("dy"))


def rasterised(polygons: DataFrame) -> DataFrame:
    """(shape_id, y, x0, x1): the runs of pixels whose centre is inside each polygon, even-odd, of (shape_id, i, x, y)."""

    def run(i: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        nx, ny = np.roll(x, -1), np.roll(y, -1)
        out = []
        for row in range(int(np.floor(y.min())), int(np.ceil(y.max())) + 1):
            c = row + 0.5
            hit = (y <= c) != (ny <= c)
            at = np.sort(x[hit] + (c - y[hit]) / (ny[hit] - y[hit]) * (nx[hit] - x[hit]))
            for a, b in zip(at[::2], at[1::2]):
                lo, hi = int(np.ceil(a - 0.5)), int(np.ceil(b - 0.5)) - 1
                if hi >= lo:
                    out.append((row, lo, hi))
        o = np.array(out, np.int32).reshape(-1, 3)
        return o[:, 0], o[:, 1], o[:, 2]

    return each_shape(polygons, ["i", "x", "y"], run, "shape_id long, y int, x0 int, x1 int")


def thinned(masks: DataFrame) -> DataFrame:
    """(mask_id, skeleton_pixels, mean_width, algorithm, unbranched_pixels) of (mask_id, y, x) pixels.

    A mask is thinned by the rules of Zhang and Suen and by those of Guo and Hall, and the skeleton with more pixels counts
    (Guo and Hall's, if they are as many).  The width is twice the mean distance of its pixels to the ground;
    ``unbranched_pixels`` are those left when pixels with more than two neighbours are taken away until there are none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([_thin(m) for m in pdf.itertuples(index=False)], columns=["mask_id", "skeleton_pixels", "mean_width", "algorithm", "unbranched_pixels"])

    packed = masks.groupBy("mask_id").agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs"))
    return packed.mapInPandas(run, "mask_id long, skeleton_pixels int, mean_width double, algorithm string, unbranched_pixels int")


def _around(s: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, from above, clockwise."""
    p = np.pad(s, 1)
    return [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]


def skeleton(a: np.ndarray, rules: str) -> np.ndarray:
    """bool[h, w] thinned until nothing changes, by the rules "Zhang-Suen" or "Guo-Hall"."""
    s, changed = a.astype(bool), True
    while changed:
        changed = False
        for half in (0, 1):
            n = _around(s)
            if rules == "Zhang-Suen":
                count = sum(x.astype(np.int8) for x in n)
                turns = sum((~n[k] & n[(k + 1) % 8]).astype(np.int8) for k in range(8))
                up, right, down, left = n[0], n[2], n[4], n[6]
                edge = ~(up & right & down) & ~(right & down & left) if not half else ~(up & right & left) & ~(up & down & left)
                gone = s & (count >= 2) & (count <= 6) & (turns == 1) & edge
            else:
                turns = sum((~n[k] & (n[k + 1] | n[(k + 2) % 8])).astype(np.int8) for k in (0, 2, 4, 6))
                one = sum((n[k - 1] | n[k]).astype(np.int8) for k in (0, 2, 4, 6))
                two = sum((n[k] | n[k + 1]).astype(np.int8) for k in (0, 2, 4, 6))
                few = np.minimum(one, two)
                edge = ~((n[4] | n[5] | ~n[7]) & n[6]) if not half else ~((n[0] | n[1] | ~n[3]) & n[2])
                gone = s & (turns == 1) & (few >= 2) & (few <= 3) & edge
            if gone.any():
                s = s & ~gone
                changed = True
    return s


def unbranched(s: np.ndarray) -> np.ndarray:
    """A skeleton without the pixels that have more than two neighbours, taken away together until there are none."""
    while True:
        many = s & (sum(x.astype(np.int8) for x in _around(s)) > 2)
        if not many.any():
            return s
        s = s & ~many


def _thin(m) -> tuple[int, int, float, str, int]:
    ys, xs = np.array(m.ys), np.array(m.xs)
    a = np.zeros((np.ptp(ys) + 3, np.ptp(xs) + 3), bool)
    a[ys - ys.min() + 1, xs - xs.min() + 1] = True
    zhang, guo = skeleton(a, "Zhang-Suen"), skeleton(a, "Guo-Hall")
    s, name = (zhang, "Zhang-Suen") if zhang.sum() > guo.sum() else (guo, "Guo-Hall")
    at, ground = np.argwhere(s), np.argwhere(~a & np.logical_or.reduce(_around(a)))
    width = [np.sqrt(((at[k : k + 256, None] - ground[None]) ** 2).sum(-1).min(1)) for k in range(0, len(at), 256)]
    return m.mask_id, len(at), float(2 * np.concatenate(width).mean()) if len(at) else 0.0, name, int(unbranched(s).sum())

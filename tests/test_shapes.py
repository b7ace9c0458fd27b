"""Shapes whose measures are known by hand, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lepidus.operators import shapes

RECT = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]


def table(spark, *rings):
    return spark.createDataFrame([(s, i, x, y) for s, r in enumerate(rings) for i, (x, y) in enumerate(r)], "shape_id long, i int, x double, y double")


def turned(ring, a, k=1.0, dx=0.0, dy=0.0):
    return [(k * (x * math.cos(a) - y * math.sin(a)) + dx, k * (x * math.sin(a) + y * math.cos(a)) + dy) for x, y in ring]


def test_rectangle(spark):
    p = table(spark, RECT)
    r = shapes.area_perimeter(p).first()
    assert r.area == pytest.approx(2) and r.perimeter == pytest.approx(6)
    r = shapes.length_height(p).first()
    assert r.length == pytest.approx(2) and r.height == pytest.approx(1)
    h = shapes.hull(table(spark, [*RECT, (1.0, 0.5)])).first()
    assert h.hull_area == pytest.approx(2) and h.hull_points == 4


def test_arc_length_and_resampling(spark):
    p = table(spark, RECT)
    assert [r.cum for r in shapes.arc_length(p).orderBy("i").collect()] == pytest.approx([0, 2, 3, 5])
    got = [(r.x, r.y) for r in shapes.resampled(p, 7).orderBy("i").collect()]
    assert got == [pytest.approx(q) for q in [(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1), (0, 0)]]


def test_resampling_a_point_and_repeated_points(spark):
    got = shapes.resampled(table(spark, [(1.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (0.0, 0.0), (3.0, 0.0)]), 4).collect()
    assert sorted((r.i, r.x, r.y) for r in got if r.shape_id == 0) == [(k, 1.0, 1.0) for k in range(4)]
    assert sorted(r.i for r in got if r.shape_id == 1) == [0, 1, 2, 3]


def test_procrustes_ignores_place_size_and_turn(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    mirrored = [(-x, y) for x, y in ring]
    p = table(spark, ring, turned(ring, 1.1, 2.5, 7, -3), mirrored)
    ref = shapes.centred(p.where("shape_id = 0")).selectExpr("i", "x AS rx", "y AS ry")
    got = {r.shape_id: r for r in shapes.procrustes(p, ref).collect()}
    assert got[1].distance == pytest.approx(0, abs=1e-9) and got[1].disparity == pytest.approx(0, abs=1e-9)
    assert got[2].distance > 0.01 and got[2].disparity == pytest.approx(0, abs=1e-9)


def test_best_shift(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    p = table(spark, ring, turned(ring[2:] + ring[:2], 0.4))
    ref = shapes.centred(p.where("shape_id = 0")).selectExpr("i", "x AS rx", "y AS ry")
    got = {r.shape_id: (r.shift, r.distance) for r in shapes.best_shift(p, ref, 6).collect()}
    assert got[0][0] == 0 and got[1] == (4, pytest.approx(0, abs=1e-8))


def test_mean_of_one_shape_many_ways(spark):
    p = table(spark, *[turned(RECT, a, 1 + a) for a in (0.0, 0.5, 1.0)])
    m = shapes.mean_shape(p)
    c = shapes.centred(p.where("shape_id = 0")).orderBy("i").toPandas()
    assert m.x.tolist() == pytest.approx(c.x.tolist()) and m.y.tolist() == pytest.approx(c.y.tolist())


def test_back_transform(spark):
    p = table(spark, RECT)
    r = shapes.back_transform(p, table(spark, turned(RECT, 0.3, 2.0, 5.0, 6.0))).first()
    assert (r.scale, r.angle, r.dx, r.dy) == pytest.approx((2.0, 0.3, 5.0, 6.0))


def test_raster_and_skeleton(spark):
    runs = shapes.rasterised(table(spark, [(0.0, 0.0), (20.0, 0.0), (20.0, 5.0), (0.0, 5.0)]))
    assert sorted((r.y, r.x0, r.x1) for r in runs.collect()) == [(y, 0, 19) for y in range(5)]
    pixels = runs.selectExpr("shape_id AS mask_id", "y", "explode(sequence(x0, x1)) AS x")
    r = shapes.thinned(pixels).first()
    assert 10 <= r.skeleton_pixels <= 20 and 3 <= r.mean_width <= 6
    assert r.algorithm in ("Zhang-Suen", "Guo-Hall") and 0 < r.unbranched_pixels <= r.skeleton_pixels


def test_thinning_of_a_cross():
    a = np.zeros((31, 31), bool)
    a[14:17, 2:29] = a[2:29, 14:17] = True
    for rules in ("Zhang-Suen", "Guo-Hall"):
        s = shapes.skeleton(a, rules)
        assert (s <= a).all() and 40 <= s.sum() <= 60 and (shapes.skeleton(s, rules) == s).all()
        cut = shapes.unbranched(s)
        assert cut.sum() < s.sum() and (sum(x.astype(int) for x in shapes._around(cut))[cut] <= 2).all()


def test_reflections(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    mirrored = [(-x, y) for x, y in ring]
    p = table(spark, ring, turned(mirrored[2:] + mirrored[:2], 0.4))
    ref = shapes.centred(p.where("shape_id = 0")).selectExpr("i", "x AS rx", "y AS ry")
    got = {r.shape_id: (r.flip, r.shift, r.distance) for r in shapes.best_flip(p, ref, 6).collect()}
    assert got == {0: (0, 0, pytest.approx(0, abs=1e-8)), 1: (1, 4, pytest.approx(0, abs=1e-8))}
    moved = table(spark, ring, ring[2:] + ring[:2])
    assert {r.shape_id: (r.shift, r.distance) for r in shapes.reindexed(moved, moved.where("shape_id = 0").selectExpr("i", "x AS rx", "y AS ry"), 6).collect()} == {0: (0, 0.0), 1: (4, 0.0)}


def test_sums_of_turned_landmarks(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(50, 6)) + 1j * rng.normal(size=(50, 6))
    mean = pd.DataFrame({"i": range(6), "x": z[0].real, "y": z[0].imag})
    rows = [(k, i, float(v.real), float(v.imag)) for k, s in enumerate(z) for i, v in enumerate(s)]
    packed = spark.createDataFrame(rows, "s long, i int, x double, y double").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    got = shapes._turned_sums(packed, mean).groupBy("i").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("i").collect()
    turn = (z.conj() * z[0]).sum(axis=1)
    want = (z * (turn / abs(turn))[:, None]).sum(axis=0)
    assert np.allclose([r.x + 1j * r.y for r in got], want) and [r.n for r in got] == [50] * 6

"""Closed forms over planar point sets, as aggregate expressions and array folds.

Shapes are long tables (shape_id, i, x, y), i from 0 in order around the ring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axes(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column, Column]:
    """(angle of the first principal axis, greater and lesser eigenvalue) of a 2 x 2 covariance."""
    mid, half = (sxx + syy) / 2, F.sqrt(F.pow((sxx - syy) / 2, F.lit(2)) + sxy * sxy)
    return F.atan2(2 * sxy, sxx - syy) / 2, mid + half, mid - half


def rotation_distance(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    """Squared Procrustes distance, without reflection, of two centred shapes of unit norm whose cross products are a."""
    return 2 - 2 * F.sqrt(F.pow(a11 + a22, F.lit(2)) + F.pow(a12 - a21, F.lit(2)))


def free_disparity(a11: Column, a12: Column, a21: Column, a22: Column) -> Column:
    """1 - s**2, s the better of rotation and reflection, scale free."""
    s = F.greatest(F.pow(a11 + a22, F.lit(2)) + F.pow(a12 - a21, F.lit(2)), F.pow(a11 - a22, F.lit(2)) + F.pow(a12 + a21, F.lit(2)))
    return 1 - s


def kept_points(points: Column, least: float = 1e-3) -> Column:
    """An ordered array of (x, y) without the points closer than ``least`` to the last one kept: a fold, as it depends on what was kept."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        far = F.sqrt(F.pow(p["x"] - last["x"], F.lit(2)) + F.pow(p["y"] - last["y"], F.lit(2))) >= least
        return F.when((F.size(acc) == 0) | far, F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(points, F.slice(points, 1, 0), step)

"""Measurements: unit conversion, group statistics and record averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels_per_mm(value: Column, unit: Column, pixels: Column) -> Column:
    """Scale from a bar of ``pixels`` that stands for ``value`` mm, or micrometres; null for any other unit."""
    mm = F.when(unit == "mm", value).when(unit.isin("µm", "um"), value / 1000)
    return F.try_divide(pixels, mm)


def scale_text(text: Column) -> tuple[Column, Column]:
    """(number, unit) of a scale bar's label such as "0,5 mm"; nulls where there is none."""
    t = F.replace(text, F.lit(","), F.lit("."))
    found = r"(\d+(?:\.\d+)?)\s*(mm|µm|um)"
    number = F.nullif(F.regexp_extract(t, found, 1), F.lit(""))
    return number.try_cast("double") if hasattr(number, "try_cast") else number.cast("double"), F.nullif(F.regexp_extract(t, found, 2), F.lit(""))


def to_mm(pixels: Column, ppm: Column, power: int = 1) -> Column:
    """Pixels to mm (power 1) or mm2 (power 2); null without a scale."""
    return F.try_divide(pixels, F.pow(ppm, F.lit(power)))


def population(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation, least, greatest and number of each field, nulls left out, in one pass."""
    out = []
    for f in fields:
        c = F.col(f)
        out += [F.round(F.avg(c), 6).alias(f"{f}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{f}_std"), F.min(c).alias(f"{f}_min"), F.max(c).alias(f"{f}_max"), F.count(c).alias(f"{f}_n")]
    return df.groupBy(*by).agg(*out)


def averaged(df: DataFrame, by: Sequence[str], numeric: Sequence[str], other: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Means of numeric fields, and of others the first in order."""
    first = [F.min_by(F.col(c), F.struct(*order)).alias(c) for c in other]
    return df.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in numeric], *first)

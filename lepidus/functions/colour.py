"""Colour conversions as Column expressions (sRGB, D65)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _bend(t: Column) -> Column:
    return F.when(t > 216.0 / 24389.0, F.cbrt(t)).otherwise((24389.0 / 27.0 * t + 16.0) / 116.0)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of 8-bit sRGB."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = _bend((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = _bend(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = _bend((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def lab_bytes(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L*, a*, b* on the 0..255 scale of 8-bit images: L * 255 / 100, a + 128, b + 128, rounded."""
    l_, a, b_ = lab(r, g, b)
    clip = lambda c: F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(255.0)).cast("int")
    return clip(l_ * 2.55), clip(a + 128), clip(b_ + 128)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, 60.0 * F.try_divide(g - b, d)).when(top == g, 120.0 + 60.0 * F.try_divide(b - r, d)).otherwise(240.0 + 60.0 * F.try_divide(r - g, d))
    return F.when(hue < 0, hue + 360.0).otherwise(hue), F.coalesce(F.try_divide(255.0 * d, top), F.lit(0.0)), top


def bin_index(c0: Column, c1: Column, c2: Column, n: int = 8) -> Column:
    """Bin of an n x n x n histogram over three channels of 0..255."""
    w = 256 // n
    at = lambda c: F.least(F.floor(c / w), F.lit(n - 1))
    return (at(c0) * n + at(c1)) * n + at(c2)


def bin_centre(index: Column, n: int = 8) -> tuple[Column, Column, Column]:
    w = 256.0 / n
    return (F.floor(index / (n * n)) + 0.5) * w, (F.floor(index / n) % n + 0.5) * w, (index % n + 0.5) * w


def rgb(l_: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB in 0..255, cut off at its ends, of CIE L*, a*, b*: the inverse of lab()."""
    fy = (l_ + 16.0) / 116.0
    bend = lambda f: F.when(f > 6.0 / 29.0, f * f * f).otherwise((116.0 * f - 16.0) / (24389.0 / 27.0))
    x, y, z = bend(fy + a / 500.0) * 0.95047, bend(fy), bend(fy - b / 200.0) * 1.08883
    linear = (3.2404542 * x - 1.5371385 * y - 0.4985314 * z, -0.9692660 * x + 1.8760108 * y + 0.0415560 * z, 0.0556434 * x - 0.2040259 * y + 1.0572252 * z)
    out = []
    for v in linear:
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        out.append(255.0 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))
    return tuple(out)

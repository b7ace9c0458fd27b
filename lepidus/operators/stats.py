"""Standardising, principal components, MANOVA and paired tests."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, over their population deviation; a constant feature becomes 0."""
    aggs = [e for c in features for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    wide = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    return wide.select(*[c for c in df.columns if c not in features], *[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in features])


def moments(df: DataFrame, features: list[str], by: str | None = None) -> list:
    """Counts, sums and cross products, in one pass: as many numbers as features squared, whatever the rows."""
    aggs = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in features]]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in combinations_with_replacement(features, 2)]
    return (df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)).collect()


def _cross(row, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    p = np.zeros((len(features),) * 2)
    for (i, a), (j, b) in combinations_with_replacement(list(enumerate(features)), 2):
        p[i, j] = p[j, i] = row[f"p_{a}_{b}"]
    return row["n"], np.array([row[f"s_{c}"] for c in features]), p


def components(df: DataFrame, features: list[str], k: int = 2, scale: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(df with pc1..pck, share of variance): from the covariance, whose size is the features'; signs make each axis's largest loading positive."""
    z = standardised(df.na.drop(subset=features), features) if scale else df.na.drop(subset=features)
    n, s, p = _cross(moments(z, features)[0], features)
    mean = s / n
    values, axes = np.linalg.eigh((p - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    pcs = [sum((F.col(c) - float(mean[i])) * float(axes[i, j]) for i, c in enumerate(features)).alias(f"pc{j + 1}") for j in range(k)]
    return z.select("*", *pcs), values / values.sum()


def manova(df: DataFrame, group: str, features: list[str]) -> dict[str, float]:
    """Wilks' lambda, Pillai's trace, Hotelling-Lawley trace and Roy's root of features by group."""
    parts = [_cross(r, features) for r in moments(df.na.drop(subset=[group, *features]), features, group)]
    n = sum(p[0] for p in parts)
    mean = sum(p[1] for p in parts) / n
    within = sum(p - k * np.outer(s / k, s / k) for k, s, p in parts)
    between = sum(k * np.outer(s / k - mean, s / k - mean) for k, s, _ in parts)
    roots = np.linalg.eigvals(np.linalg.solve(within, between)).real.clip(0)
    return {"groups": float(len(parts)), "n": float(n), "wilks": float(np.prod(1 / (1 + roots))), "pillai": float((roots / (1 + roots)).sum()), "hotelling": float(roots.sum()), "roy": float(roots.max())}


def wilcoxon(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, w): signed-rank statistic, the lesser of the rank sums, zero differences left out, ties ranked by their mean."""
    d = pairs.select(by, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    tie = Window.partitionBy(by, "m")
    rank = F.rank().over(Window.partitionBy(by).orderBy("m")) + (F.count("*").over(tie) - 1) / 2
    r = d.withColumn("r", rank)
    up, down = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.least(up, down).alias("w"))


def wilcoxon_tests(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """wilcoxon() with ``ties``, the sum of t**3 - t over groups of t equal differences, and the two-sided p."""
    d = pairs.select(by, F.abs(F.col(a) - F.col(b)).alias("m")).where("m <> 0").groupBy(by, "m").agg(F.count("*").alias("t"))
    ties = d.groupBy(by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(*x) for x in zip(n.tolist(), w.tolist(), t.tolist())], dtype=float)

    return wilcoxon(pairs, by, a, b).join(ties, by).withColumn("p", p("n", "w", "ties"))


def wilcoxon_p(n: int, w: float, ties: int = 0) -> float:
    """Two-sided p of a rank sum: without ties and up to 50 pairs exact, the share of sign patterns at least as extreme; else by the normal distribution, its variance less for ties."""
    if ties or n > 50:
        var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        return float(min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)))) if var > 0 else 1.0
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k].copy() if k < len(ways) else ways[k:]
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    """How often an F of d1 and d2 degrees of freedom is greater."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def manova_tests(m: dict[str, float], features: int) -> list[tuple[str, float, float, float, float, float]]:
    """(statistic, value, df1, df2, F, p) of manova()'s four statistics, by the usual approximations to F."""
    p, q, v = features, m["groups"] - 1, m["n"] - m["groups"]
    s, u = min(p, q), (p * q - 2) / 4
    out = []

    def add(name: str, value: float, d1: float, d2: float, f: float) -> None:
        out.append((name, value, d1, d2, f, f_tail(f, d1, d2)))

    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d2, root = (v - (p - q + 1) / 2) * t - 2 * u, m["wilks"] ** (1 / t)
    add("wilks", m["wilks"], p * q, d2, (1 - root) / root * d2 / (p * q))
    d1, d2 = s * max(p, q), s * (v - p + s)
    add("pillai", m["pillai"], d1, d2, d2 / d1 * m["pillai"] / (s - m["pillai"]))
    half, n = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    if n > 1:
        b = (p + 2 * n) * (q + 2 * n) / 2 / (2 * n + 1) / (n - 1)
        d1, d2 = p * q, 4 + (p * q + 2) / (b - 1)
        add("hotelling", m["hotelling"], d1, d2, d2 / d1 * m["hotelling"] / ((d2 - 2) / 2 / n))
    else:
        d1, d2 = s * (2 * half + s + 1), 2 * (s * n + 1)
        add("hotelling", m["hotelling"], d1, d2, d2 / d1 / s * m["hotelling"])
    d1 = max(p, q)
    add("roy", m["roy"], d1, v - d1 + q, (v - d1 + q) / d1 * m["roy"])
    return out

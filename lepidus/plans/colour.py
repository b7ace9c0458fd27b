"""Plans over pixels: a pixel is a lineitem, its sample the order's customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.functions import colour as fc
from lepidus.functions.palette import NAMED
from lepidus.operators import colours
from lepidus.plans import Tables, query

PIX = "pix AS (SELECT o_custkey AS sample, l_partkey % 256 AS c0, l_suppkey * 37 % 256 AS c1, (l_quantity * 5)::INT AS c2, l_discount > 0 AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
HIST = f"{PIX}, hist AS (SELECT sample, bin, n, n / sum(n) OVER (PARTITION BY sample)::DOUBLE AS freq FROM (SELECT sample, (c0 // 32) * 64 + (c1 // 32) * 8 + c2 // 32 AS bin, count(*) AS n FROM pix WHERE inside GROUP BY ALL))"
_lin = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_f = "CASE WHEN {0} > 216.0 / 24389.0 THEN cbrt({0}) ELSE (24389.0 / 27.0 * {0} + 16.0) / 116.0 END"


def _lab(source: str, r: str, g: str, b: str, keep: str) -> str:
    """SQL of a table with columns l, a, q."""
    lin = ", ".join(f"{_lin.format(c)} AS _{k}" for k, c in zip("rgb", (r, g, b)))
    xyz = "(0.4124564 * _r + 0.3575761 * _g + 0.1804375 * _b) / 0.95047::DOUBLE AS _x, 0.2126729 * _r + 0.7151522 * _g + 0.0721750 * _b AS _y, (0.0193339 * _r + 0.1191920 * _g + 0.9503041 * _b) / 1.08883::DOUBLE AS _z"
    bent = ", ".join(f"{_f.format('_' + k)} AS f{k}" for k in "xyz")
    return f"(SELECT {keep}, 116.0 * fy - 16.0 AS l, 500.0 * (fx - fy) AS a, 200.0 * (fy - fz) AS q FROM (SELECT {keep}, {bent} FROM (SELECT {keep}, {xyz} FROM (SELECT {keep}, {lin} FROM {source}))))"


_named = {rgb: (k, n) for k, (n, rgb) in enumerate(NAMED.items())}
PAL = "(VALUES " + ", ".join(f"({k}, {rgb >> 16}::DOUBLE, {rgb >> 8 & 255}::DOUBLE, {rgb & 255}::DOUBLE, '{n}')" for rgb, (k, n) in _named.items()) + ") pal(pidx, pr, pg, pb, name)"


def pixels(t: Tables) -> DataFrame:
    p = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return p.select(F.col("o_custkey").alias("sample"), (F.col("l_partkey") % 256).alias("c0"), (F.col("l_suppkey") * 37 % 256).alias("c1"), (F.col("l_quantity") * 5).cast("int").alias("c2"), (F.col("l_discount") > 0).alias("inside"))


def inside(t: Tables) -> DataFrame:
    return pixels(t).where("inside")


@query("g24_masked_pixels", f"WITH {PIX} SELECT sample, count(*) AS n FROM pix WHERE inside GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return inside(t).groupBy("sample").agg(F.count("*").alias("n"))


@query("a11_histogram", f"WITH {HIST} SELECT sample, bin, n, round(freq, 8) AS freq FROM hist")
def _(t: Tables) -> DataFrame:
    return colours.histogram(inside(t), "sample").select("sample", "bin", "n", F.round("freq", 8).alias("freq"))


@query("t03_top_bins", f"WITH {HIST} SELECT sample, bin, n, row_number() OVER (PARTITION BY sample ORDER BY n DESC, bin DESC) AS rank FROM hist QUALIFY rank <= 5")
def _(t: Tables) -> DataFrame:
    return colours.top_bins(colours.histogram(inside(t), "sample"), "sample").select("sample", "bin", "n", "rank")


@query(
    "a04_group_bins",
    f"""WITH {HIST}, s AS (SELECT DISTINCT sample, c_mktsegment AS g FROM hist JOIN customer ON c_custkey = sample), bins AS (SELECT DISTINCT g, bin FROM hist JOIN s USING (sample)),
 dense AS (SELECT b.g, b.bin, coalesce(h.freq, 0) AS freq FROM bins b JOIN s USING (g) LEFT JOIN hist h ON h.sample = s.sample AND h.bin = b.bin)
 SELECT g, bin, round(avg(freq), 6) AS mean, round(stddev_samp(freq), 6) AS std, round(min(freq), 6) AS least, round(max(freq), 6) AS most FROM dense GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    h = colours.histogram(inside(t), "sample")
    s = h.select("sample").distinct().join(t.customer.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("g")), "sample")
    return colours.group_bins(h, "g", s, "sample").select("g", "bin", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")])


@query("a12_average_colour", f"WITH {PIX} SELECT sample, round_even(avg(c0), 0)::INT AS c0, round_even(avg(c1), 0)::INT AS c1, round_even(avg(c2), 0)::INT AS c2 FROM pix WHERE inside GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return colours.average(inside(t), "sample")


@query("g21_lab", f"WITH {PIX} SELECT sample, round(avg(l), 5) AS l, round(avg(a), 5) AS a, round(avg(q), 5) AS q FROM {_lab('pix', 'c0', 'c1', 'c2', 'sample')} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    l_, a, q = fc.lab(F.col("c0"), F.col("c1"), F.col("c2"))
    return pixels(t).groupBy("sample").agg(F.round(F.avg(l_), 5).alias("l"), F.round(F.avg(a), 5).alias("a"), F.round(F.avg(q), 5).alias("q"))


@query(
    "g21_hsv",
    f"""WITH {PIX}, m AS (SELECT *, greatest(c0, c1, c2) AS t, greatest(c0, c1, c2) - least(c0, c1, c2) AS d FROM pix),
 h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = c0 THEN 60.0::DOUBLE * (c1 - c2) / d WHEN t = c1 THEN 120 + 60.0::DOUBLE * (c2 - c0) / d ELSE 240 + 60.0::DOUBLE * (c0 - c1) / d END AS h FROM m)
 SELECT sample, round(avg(CASE WHEN h < 0 THEN h + 360 ELSE h END), 5) AS h, round(avg(CASE WHEN t = 0 THEN 0 ELSE 255.0::DOUBLE * d / t END), 5) AS s, round(avg(t), 5) AS v FROM h GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    h, s, v = fc.hsv(F.col("c0"), F.col("c1"), F.col("c2"))
    return pixels(t).groupBy("sample").agg(F.round(F.avg(h), 5).alias("h"), F.round(F.avg(s), 5).alias("s"), F.round(F.avg(v), 5).alias("v"))


@query("g22_bin_centres", f"WITH {HIST} SELECT DISTINCT bin, ((bin // 64 + 0.5) * 32)::DOUBLE AS c0, ((bin // 8 % 8 + 0.5) * 32)::DOUBLE AS c1, ((bin % 8 + 0.5) * 32)::DOUBLE AS c2 FROM hist")
def _(t: Tables) -> DataFrame:
    c0, c1, c2 = fc.bin_centre(F.col("bin"))
    return colours.histogram(inside(t), "sample").select("bin").distinct().select("bin", c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))


@query("g23_palette", f"SELECT name, pr::INT AS pr, pg::INT AS pg, pb::INT AS pb FROM {PAL}")
def _(t: Tables) -> DataFrame:
    return colours.palette(t.spark).select("name", "pr", "pg", "pb")


@query(
    "j13_nearest_colour",
    f"""WITH {PIX}, avgs AS (SELECT sample, round_even(avg(c0), 0) AS c0, round_even(avg(c1), 0) AS c1, round_even(avg(c2), 0) AS c2 FROM pix WHERE inside GROUP BY 1), s AS {_lab('avgs', 'c0', 'c1', 'c2', 'sample')}, p AS {_lab(PAL, 'pr', 'pg', 'pb', 'pidx, name')}
 SELECT sample, min_by(name, {{'d': round((s.l - p.l) ** 2 + (s.a - p.a) ** 2 + (s.q - p.q) ** 2, 6), 'k': pidx}}) AS name FROM s, p GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return colours.nearest_name(colours.average(inside(t), "sample"), "c0", "c1", "c2").select("sample", "name")


@query("a20_names_by_group", f"WITH {PIX}, n AS (SELECT DISTINCT c_mktsegment AS g, CASE WHEN c0 > 128 THEN 'red' ELSE 'dark' END AS name FROM pix JOIN customer ON c_custkey = sample WHERE inside) SELECT g, string_agg(name, ', ' ORDER BY name) AS names FROM n GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = inside(t).join(t.customer.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("g")), "sample")
    name = F.when(F.col("c0") > 128, "red").otherwise("dark")
    return p.groupBy("g").agg(F.array_join(F.sort_array(F.collect_set(name)), ", ").alias("names"))

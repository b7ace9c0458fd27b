"""Plans of group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators import stats
from lepidus.plans import Tables, query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("g14_standardised", "SELECT l_returnflag, round(sum((l_quantity - m) / s), 4) AS z_sum, round(sum(((l_quantity - m) / s) ** 2), 4) AS z_squares FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    z = stats.standardised(t.lineitem.select("l_returnflag", *FEATURES), FEATURES)
    return z.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("z_sum"), F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 4).alias("z_squares"))


@query("g14_components")
def _(t: Tables) -> DataFrame:
    pcs, _ = stats.components(t.lineitem.select("l_orderkey", "l_linenumber", *FEATURES), FEATURES)
    return pcs.select("l_orderkey", "l_linenumber", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query(
    "g14_two_components",
    """WITH z AS (SELECT l_orderkey, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem), r AS (SELECT sign(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
 SELECT l_orderkey, round(sum(abs(a + r * b) / sqrt(2)), 5) AS pc1, round(sum(abs(a - r * b) / sqrt(2)), 5) AS pc2 FROM z, r GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    # of two standardised features the axes are the diagonals, the sum first if they go together
    pcs, _ = stats.components(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return pcs.groupBy("l_orderkey").agg(F.round(F.sum(F.abs("pc1")), 5).alias("pc1"), F.round(F.sum(F.abs("pc2")), 5).alias("pc2"))


@query(
    "g19_manova_one_feature",
    """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, sum(l_quantity * l_quantity) - count(*) * avg(l_quantity) ** 2 AS w FROM lineitem GROUP BY 1), b AS (SELECT sum(n * (m - (SELECT avg(l_quantity) FROM lineitem)) ** 2) AS b, sum(w) AS w FROM g)
 SELECT round(w / (w + b), 8) AS wilks, round(b / (w + b), 8) AS pillai FROM b""",
)
def _(t: Tables) -> DataFrame:
    m = stats.manova(t.lineitem, "l_returnflag", ["l_quantity"])
    return t.spark.createDataFrame([(round(m["wilks"], 8), round(m["pillai"], 8))], "wilks double, pillai double")


@query("g19_manova")
def _(t: Tables) -> DataFrame:
    m = stats.manova(t.lineitem, "l_returnflag", FEATURES)
    return t.spark.createDataFrame([tuple(m.values())], ", ".join(f"{k} double" for k in m))


@query("g19_manova_tests")
def _(t: Tables) -> DataFrame:
    rows = stats.manova_tests(stats.manova(t.lineitem, "l_returnflag", FEATURES), len(FEATURES))
    return t.spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "statistic string, value double, df1 double, df2 double, f double, p double")


@query("w12_rank_tests")
def _(t: Tables) -> DataFrame:
    return stats.wilcoxon_tests(t.lineitem, "l_orderkey", "l_quantity", "l_suppkey")


@query(
    "w12_signed_ranks",
    """WITH d AS (SELECT l_orderkey, l_quantity - l_suppkey AS d, abs(l_quantity - l_suppkey) AS m FROM lineitem WHERE l_quantity <> l_suppkey), r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY m) + (count(*) OVER (PARTITION BY l_orderkey, m) - 1) / 2.0 AS r FROM d)
 SELECT l_orderkey, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM r GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return stats.wilcoxon(t.lineitem, "l_orderkey", "l_quantity", "l_suppkey")


@query("a16_metric_summary", "SELECT l_returnflag, round(avg(nullif(l_discount, 0)), 6) AS mean, round(stddev_samp(nullif(l_discount, 0)), 6) AS std, count(nullif(l_discount, 0)) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    d = F.nullif("l_discount", F.lit(0.0))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"), F.count(d).alias("n"))

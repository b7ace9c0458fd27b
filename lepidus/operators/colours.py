"""Pixels as a table (sample, c0, c1, c2): histograms, averages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.functions import colour
from lepidus.functions.palette import NAMED


def palette(spark: SparkSession) -> DataFrame:
    """(pidx, pr, pg, pb, name, pl, pa, pq): one row a distinct colour, of two names the later."""
    last = {rgb: (k, name) for k, (name, rgb) in enumerate(NAMED.items())}
    rows = [(k, rgb >> 16, rgb >> 8 & 255, rgb & 255, name) for rgb, (k, name) in last.items()]
    p = spark.createDataFrame(rows, "pidx int, pr int, pg int, pb int, name string")
    l_, a, b = colour.lab(F.col("pr"), F.col("pg"), F.col("pb"))
    return p.select("*", l_.alias("pl"), a.alias("pa"), b.alias("pq"))


def nearest_name(colours: DataFrame, r: str, g: str, b: str, out: str = "name") -> DataFrame:
    """Each row with the palette's nearest colour in L*a*b*, ties to the earlier.  Distinct colours are looked up once; the palette has a fixed size, so it may be broadcast."""
    key = [r, g, b]
    l_, a, q = colour.lab(F.col(r), F.col(g), F.col(b))
    each = colours.select(*key).distinct().select(*key, l_.alias("_l"), a.alias("_a"), q.alias("_q")).crossJoin(F.broadcast(palette(colours.sparkSession)))
    d = F.round((F.col("_l") - F.col("pl")) ** 2 + (F.col("_a") - F.col("pa")) ** 2 + (F.col("_q") - F.col("pq")) ** 2, 6)
    named = each.groupBy(*key).agg(F.min_by("name", F.struct(d, "pidx")).alias(out))
    return colours.join(named, key)


def histogram(pixels: DataFrame, sample: str, bins: int = 8) -> DataFrame:
    """(sample, bin, n, freq): the bins that occur."""
    n = pixels.groupBy(sample, colour.bin_index(F.col("c0"), F.col("c1"), F.col("c2"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(sample)))


def top_bins(hist: DataFrame, sample: str, k: int = 5) -> DataFrame:
    """The k greatest bins of each sample with ``rank``; ties go to the higher bin."""
    w = Window.partitionBy(sample).orderBy(F.desc("n"), F.desc("bin"))
    return hist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_bins(hist: DataFrame, group: str, samples: DataFrame, sample: str) -> DataFrame:
    """(group, bin, mean, std, least, most) over all samples of a group; a sample without the bin counts as 0.

    Sums and squares over the bins that occur, with the group's number of samples, stand for the dense table.
    """
    size = samples.groupBy(group).agg(F.count("*").alias("_k"))
    g = hist.join(samples.select(sample, group), sample).groupBy(group, "bin").agg(F.sum("freq").alias("_s"), F.sum(F.col("freq") ** 2).alias("_q"), F.min("freq").alias("_lo"), F.max("freq").alias("most"), F.count("*").alias("_n")).join(size, group)
    var = F.try_divide(F.col("_q") - F.col("_s") ** 2 / F.col("_k"), F.col("_k") - 1)
    return g.select(group, "bin", (F.col("_s") / F.col("_k")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.when(F.col("_n") < F.col("_k"), 0.0).otherwise(F.col("_lo")).alias("least"), "most")


def average(pixels: DataFrame, sample: str) -> DataFrame:
    """(sample, c0, c1, c2): mean colour, rounded half to even."""
    return pixels.groupBy(sample).agg(*[F.bround(F.avg(c), 0).cast("int").alias(c) for c in ("c0", "c1", "c2")])

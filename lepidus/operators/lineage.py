"""Tables written to the shared folder, which cut lineage, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset, a session of one machine (as in tests) gets a folder of its own; on a cluster, whose executors don't
    share a machine's folders, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lepidus")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, computed once and read again from the shared folder: its lineage is cut, and it outlives any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lepidus-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; else as it is, and the join is Spark's choice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node of its component.

    Alternating large stars and small stars: each round is two groupings over the edges left, and rounds grow with the
    logarithm of the longest path.  A node's least neighbour is an aggregate with partial sums, joined back, so the many
    edges of a hub aren't one task's.  Self-loops and repeated edges don't matter; no edges give no rows.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")
        small = large.join(low, "u").select(ends).select("x.u", "x.v").where("u <> v").distinct()
        old, e = e, written(small, "edges")
        forget(old)
        forget(large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = now

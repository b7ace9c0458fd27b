"""Extensions: arriving files and late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def measurements(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def windowed(events: DataFrame, time: str, by: str, value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and key; in a stream, windows close ``late`` after their end."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, size, slide).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def upsert(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, keep: int = 2) -> Callable[[], None]:
    """Keep at ``path`` the last row of each key; returns the function that takes in what has arrived.

    Each batch writes a version of its own, v<batch>, from the one that the pointer names, and then moves the pointer file,
    so a batch that breaks or runs twice leaves a whole table.  Versions before the last ``keep`` are deleted.  A pointer to a
    version that isn't there is an error: the table isn't begun anew over lost rows.
    """
    from lepidus.operators.coco import first_of

    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        now = current(spark, path)
        if now is not None and now >= n:  # this batch ran before, up to the pointer
            return
        rows = batch
        if now is not None:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v{now}").unionByName(batch)
        first_of(rows, key, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/v{n}")
        _point(spark, path, n)
        fs, at = _store(spark, path)
        for status in fs.listStatus(at(path)):
            name = status.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= n - keep:
                fs.delete(status.getPath(), True)

    def run() -> None:
        q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    return run


def _store(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def current(spark: SparkSession, path: str) -> int | None:
    """The version that the pointer of an upserted table names; None if there is no pointer yet."""
    fs, at = _store(spark, path)
    if not fs.exists(at(f"{path}/current")):
        return None
    n = int(spark.read.text(f"{path}/current").first().value)
    if not fs.exists(at(f"{path}/v{n}/_SUCCESS")):
        raise FileNotFoundError(f"{path}/current names v{n}, which isn't there")
    return n


def _point(spark: SparkSession, path: str, n: int) -> None:
    fs, at = _store(spark, path)
    out = fs.create(at(f"{path}/.current-{n}"), True)
    out.write(bytearray(str(n).encode()))
    out.close()
    if fs.exists(at(f"{path}/current")):
        fs.delete(at(f"{path}/current"), False)
    fs.rename(at(f"{path}/.current-{n}"), at(f"{path}/current"))


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert() keeps."""
    return spark.read.parquet(f"{path}/v{current(spark, path)}")

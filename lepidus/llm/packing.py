"""Operator 10: packing by shortest-pack-first over the length histogram.

Lengths are words (runs of non-blank bytes).  A text of more than ``CAPACITY`` words is cut into pieces of CAPACITY and one
of the rest, so whole texts are packed.  The histogram has at most CAPACITY entries, whatever the table's size, and is
all that the driver sees: lengths are placed longest first, each into the packs with the most room left among those it fits
(else into new ones), a whole count at a time, so what is placed are counts of packing patterns.  Patterns are joined back
to pieces by the piece's rank among those of its length: every slot of a pattern takes an interval of ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.llm.shared import written

CAPACITY = 2048
RANKED = 500_000  # pieces that one task ranks
WORD = r"[^\x00-\x20\x7f]+"


@dataclass(frozen=True)
class Plan:
    """Slots sorted by (length, first rank): a piece of that length and of rank first + k goes to pack base + k at offset."""

    key: np.ndarray  # length << 44 | first rank
    base: np.ndarray
    offset: np.ndarray
    packs: int


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern."""
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        free = capacity
        while left and free >= length:
            if not room[free]:
                free -= 1
                continue
            count, lengths = room[free].pop()
            if count > left:
                room[free].append((count - left, lengths))
                count = left
            left -= count
            room[free - length].append((count, (*lengths, length)))  # has less room now, so its turn may come again later
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                room[capacity - each * length].append((full, (length,) * each))
            if rest:
                room[capacity - rest * length].append((1, (length,) * rest))
    return [p for ps in room for p in ps]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    key, base, offset, pack, taken = [], [], [], 0, dict.fromkeys(histogram, 0)
    for count, lengths in patterns(histogram, capacity):
        at = 0
        for n in lengths:
            key.append(n << 44 | taken[n])
            base.append(pack)
            offset.append(at)
            taken[n] += count
            at += n
        pack += count
    k = np.array(key, np.int64)
    order = np.argsort(k)
    return Plan(k[order], np.array(base, np.int64)[order], np.array(offset, np.int32)[order], pack)


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, n_words) of every text with words."""
    n = docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).alias("n")).where("n > 0")
    p = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    return p.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pack_id, pack_offset, doc_id, piece, start, n_words): where each piece of each text goes.

    Null and empty texts and blanks have no words and aren't packed; a null doc_id is packed and stays null; each of
    repeated rows is packed; other columns are ignored; an empty table gives no rows.
    """
    all_ = written(pieces(docs, capacity), "pieces")
    spark = docs.sparkSession
    histogram = {r.n_words: r.n for r in all_.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    made = spark.sparkContext.broadcast(plan(histogram, capacity))
    salts = 1 + sum(histogram.values()) // RANKED
    salted = all_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("n_words", "salt").agg(F.count("*").alias("n"))
    before = before.select(F.col("n_words").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(Window.partitionBy("n_words").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("n_words", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("n_words") == F.col("l")) & (F.col("salt") == F.col("s"))).select("doc_id", "piece", "start", "n_words", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = made.value
        for b in batches:
            key = b.column(3).to_numpy().astype(np.int64) << 44 | b.column(4).to_numpy()
            slot = np.searchsorted(p.key, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(p.base[slot] + key - p.key[slot]), pa.array(p.offset[slot]), *b.columns[:4]], names=["pack_id", "pack_offset", "doc_id", "piece", "start", "n_words"])

    return ranked.mapInArrow(place, "pack_id long, pack_offset int, doc_id long, piece int, start int, n_words int")


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """pack() of ``docs``, at the production capacity."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

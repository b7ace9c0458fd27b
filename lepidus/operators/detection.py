"""How well predicted boxes find true ones: average precision after COCO's rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.operators.lineage import written

#: COCO's ten thresholds
THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


#: pairs of boxes that are met at once
PAIRS = 1 << 18


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x, y, width, height), row by row."""
    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, :2] + a[:, 2:], b[:, :2] + b[:, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=1)
    union = a[:, 2:].prod(axis=1) + b[:, 2:].prod(axis=1) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def taken(p: np.ndarray, n_p: np.ndarray, t: np.ndarray, n_t: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """bool[predictions, thresholds]: which find a true box, group by group (``n_p`` and ``n_t`` boxes each, predictions from the best score down).

    All groups go on together: first the pairs that overlap by the least threshold, a slice at a time, then the first
    predictions of all groups take their boxes, then the second ones.
    """
    limits = np.array(thresholds, float)
    of, first_p, first_t = np.repeat(np.arange(len(n_p)), n_p), np.cumsum(n_p) - n_p, np.cumsum(n_t) - n_t
    rank, many = np.arange(len(p)) - first_p[of], n_t[of]
    before, found, at = np.concatenate([[0], np.cumsum(many)]), [], 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        k = np.repeat(np.arange(at, to), many[at:to])
        j = np.arange(before[at], before[to]) - before[k] + first_t[of[k]]
        iou = overlaps(p[k], t[j])
        ok = iou >= limits.min()
        found.append((k[ok], j[ok], iou[ok]))
        at = to
    hits, free = np.zeros((len(p), len(limits)), bool), np.ones((len(t), len(limits)), bool)
    if not found:
        return hits
    k, j, iou = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((j, -iou, k, rank[k]))
    k, j, iou = k[order], j[order], iou[order]
    ends = np.concatenate([[0], np.flatnonzero(np.diff(rank[k])) + 1, [len(k)]]) if len(k) else [0]
    for a, b in zip(ends[:-1], ends[1:]):
        own = k[a:b]
        start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        ok = free[j[a:b]] & (iou[a:b, None] >= limits)
        best = np.minimum.reduceat(np.where(ok, np.arange(b - a)[:, None], b - a), start, axis=0)
        row, col = np.nonzero(best < b - a)
        hits[own[start[row]], col] = True
        free[j[a + best[row, col]], col] = False
    return hits


def _hits(predicted: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """matched() with a row for each prediction: (category_id, score, h0, h1, ...), a hit or not at each threshold."""
    box = lambda df, score, side: df.where(F.size("bbox") == 4).select("image_id", "category_id", F.col("bbox").cast("array<double>").alias("bbox"), score.cast("double").alias("score"), F.lit(side).alias("side"))
    both = box(predicted, F.col("score"), 1).unionByName(box(truth, F.lit(None), 0))
    packed = both.groupBy("image_id", "category_id").agg(F.collect_list(F.when(F.col("side") == 1, F.struct((-F.col("score")).alias("minus"), "bbox"))).alias("p"), F.collect_list(F.when(F.col("side") == 0, F.col("bbox"))).alias("t"))
    packed = packed.where(F.size("p") > 0).select("category_id", F.array_sort("p").alias("p"), F.array_sort("t").alias("t"))
    kind = predicted.schema["category_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda a: np.diff(a.offsets.to_numpy())
        boxes = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
        for b in batches:
            category, p, t = b.columns
            n, each = of(p), p.flatten()
            hits = taken(boxes(each.field("bbox")), n, boxes(t.flatten()), of(t), thresholds)
            score = pa.array(-each.field("minus").to_numpy(zero_copy_only=False).astype(float), mask=each.field("minus").is_null().to_numpy(zero_copy_only=False))
            columns = [category.take(pa.array(np.repeat(np.arange(len(n)), n))), score, *[pa.array(h) for h in hits.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["category_id", "score", *[f"h{k}" for k in range(len(thresholds))]])

    return packed.mapInArrow(run, f"category_id {kind}, score double, " + ", ".join(f"h{k} boolean" for k in range(len(thresholds))))


def matched(predicted: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(category_id, threshold, score, hit) of predictions (image_id, category_id, bbox, score) against boxes (image_id, category_id, bbox).

    In each image predictions take, from the best score down (ties by box), the free true box that they overlap most, if by the
    threshold at least.  Only the boxes of one category in one image meet.
    """
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{k}").alias("hit")) for k, t in enumerate(thresholds)])
    return _hits(predicted, truth, thresholds).select("category_id", "score", F.explode(each).alias("e")).select("category_id", "e.threshold", "score", "e.hit")


def average_precision(predicted: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(category_id, threshold, ap, n_truth): the mean, over 101 recalls, of the best precision at that recall or beyond; 0 for a category without predictions.

    Equal scores are one step, so the order of rows doesn't matter.  Steps are put in ranges of category and score, counted
    up within each range and shifted by the ranges before: a category isn't one task.
    """
    n = truth.where(F.size("bbox") == 4).groupBy("category_id").agg(F.count("*").alias("n_truth"))
    sums = ["m", *[f"h{k}" for k in range(len(thresholds))]]
    steps = written(_hits(predicted, truth, thresholds).groupBy("category_id", "score").agg(F.count("*").alias("m"), *[F.count_if(h).alias(h) for h in sums[1:]]), "steps")
    ranges = written(steps.repartitionByRange("category_id", F.desc("score")).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("category_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.groupBy("category_id", "range").agg(*[F.sum(c).alias(c) for c in sums]).select("category_id", "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    down = Window.partitionBy("category_id", "range").orderBy(F.desc("score"))
    curve = ranges.select("category_id", "range", *[F.sum(c).over(down).alias(c) for c in sums]).join(shift, ["category_id", "range"]).join(n, "category_id")
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"h{k}") + F.col(f"_h{k}")).alias("tp")) for k, t in enumerate(thresholds)])
    curve = curve.select("category_id", "n_truth", (F.col("m") + F.col("_m")).alias("all"), F.explode(each).alias("e")).select("category_id", "n_truth", "all", "e.*")
    # a step reaches recalls in hundredths; those beyond the step's before are served by the best from here on
    reach = F.floor(100 * F.col("tp") / F.col("n_truth") + 1e-9).alias("reach")
    top = curve.groupBy("category_id", "threshold", reach).agg(F.max(F.col("tp") / F.col("all")).alias("precision"))
    up = Window.partitionBy("category_id", "threshold").orderBy("reach")
    top = top.withColumn("best", F.max("precision").over(up.rowsBetween(0, Window.unboundedFollowing))).withColumn("before", F.coalesce(F.lag("reach").over(up), F.lit(-1)))
    got = top.groupBy("category_id", "threshold").agg((F.sum(F.col("best") * (F.col("reach") - F.col("before"))) / 101).alias("ap"))
    every = n.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return every.join(got, ["category_id", "threshold"], "left").select("category_id", "threshold", F.coalesce("ap", F.lit(0.0)).alias("ap"), "n_truth")

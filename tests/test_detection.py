"""Average precision against a plain computation."""

import numpy as np
import pytest

from lepidus.operators import detection


def plain(pred, truth, threshold):
    """101-point average precision of one category, scores distinct."""
    free = {i: [True] * len(t) for i, t in truth.items()}
    hits = []
    for score, image, box in sorted(pred, reverse=True):
        best, at = -1.0, None
        for k, t in enumerate(truth.get(image, [])):
            w = min(box[0] + box[2], t[0] + t[2]) - max(box[0], t[0])
            h = min(box[1] + box[3], t[1] + t[3]) - max(box[1], t[1])
            inter = max(0, w) * max(0, h)
            iou = inter / (box[2] * box[3] + t[2] * t[3] - inter)
            if free[image][k] and iou > best:
                best, at = iou, k
        hits.append(at is not None and best >= threshold)
        if hits[-1]:
            free[image][at] = False
    n = sum(map(len, truth.values()))
    tp = np.cumsum(hits)
    recall, precision = tp / n, tp / np.arange(1, len(hits) + 1)
    return float(np.mean([max([p for r, p in zip(recall, precision) if r >= k / 100 - 1e-12], default=0.0) for k in range(101)]))


def test_average_precision(spark):
    rng = np.random.default_rng(0)
    truth, pred = {}, []
    for image in range(30):
        boxes = rng.uniform(0, 60, (rng.integers(0, 6), 2))
        truth[image] = [(float(x), float(y), 20.0, 15.0) for x, y in boxes]
        for x, y, w, h in truth[image]:
            if rng.random() < 0.8:
                pred.append((float(rng.random()), image, (x + float(rng.normal(0, 2)), y + float(rng.normal(0, 2)), w, h)))
        pred.append((float(rng.random()), image, (200.0, 200.0, 5.0, 5.0)))
    p = spark.createDataFrame([(i, 1, list(b), s) for s, i, b in pred], "image_id int, category_id int, bbox array<double>, score double")
    t = spark.createDataFrame([(i, 1, list(b)) for i, bs in truth.items() for b in bs] + [(0, 2, [0.0, 0.0, 1.0, 1.0])], "image_id int, category_id int, bbox array<double>")
    got = {(r.category_id, r.threshold): r.ap for r in detection.average_precision(p, t).collect()}
    assert len(got) == 20 and all(got[2, k] == 0 for k in detection.THRESHOLDS)
    for k in detection.THRESHOLDS:
        assert got[1, k] == pytest.approx(plain(pred, truth, k))
    assert got[1, 0.5] > got[1, 0.9]
    assert detection.average_precision(p.where("false"), t.where("false")).count() == 0


def test_predictions_take_the_boxes_that_they_overlap_most(monkeypatch):
    """All groups at once, in slices of few pairs, as one prediction after the other does it; among them a box that only a low threshold takes away."""
    monkeypatch.setattr(detection, "PAIRS", 7)
    rng = np.random.default_rng(3)
    n_p, n_t = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    boxes = lambda n: np.column_stack([rng.integers(0, 12, (n, 2)), np.full((n, 2), 10)]).astype(float)
    p, t = boxes(n_p.sum()), boxes(n_t.sum())
    got, want = detection.taken(p, n_p, t, n_t, detection.THRESHOLDS), np.zeros((len(p), 10), bool)
    for g in range(200):
        a, b = n_p[:g].sum(), n_t[:g].sum()
        for c, threshold in enumerate(detection.THRESHOLDS):
            free = list(range(b, b + n_t[g]))
            for k in range(a, a + n_p[g]):
                iou = [float(detection.overlaps(p[k : k + 1], t[j : j + 1])[0]) for j in free]
                if iou and max(iou) >= threshold:
                    free.pop(iou.index(max(iou)))
                    want[k, c] = True
    assert (got == want).all() and (want[:, 1:] & ~want[:, :-1]).any()


def test_a_category_is_counted_up_in_ranges(spark):
    """Many ranges of one category give what one does; a prediction of no score is a last step."""
    rng = np.random.default_rng(4)
    rows = [(k, 1, [float(rng.integers(0, 4)), 0.0, 10.0, 10.0], float(rng.integers(0, 300)) if k else None) for k in range(1000)]
    p = spark.createDataFrame(rows, "image_id int, category_id int, bbox array<double>, score double")
    t = spark.createDataFrame([(k, 1, [0.0, 0.0, 10.0, 10.0]) for k in range(0, 1500)], "image_id int, category_id int, bbox array<double>")
    got = {}
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got[n] = {r.threshold: r.ap for r in detection.average_precision(p, t).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["1"] == pytest.approx(got["16"])
    by = {}
    for image, _, box, score in rows:
        by.setdefault(-1.0 if score is None else score, []).append((10 - box[0]) / (10 + box[0]) >= 0.7)
    tp = np.cumsum([sum(by[s]) for s in sorted(by, reverse=True)])
    precision = tp / np.cumsum([len(by[s]) for s in sorted(by, reverse=True)])
    assert got["16"][0.7] == pytest.approx(np.mean([max(precision[tp / 1500 >= k / 100 - 1e-12], default=0.0) for k in range(101)]))

"""Follow-the-regularised-leader (FTRL-proximal) logistic regression over hashed sparse features.

One model is small (``2**bits`` weights, most of them zero) and is trained in one task on a bounded, documented sample of
labelled rows; features are made in parallel before it, and scoring is a map over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lepidus.llm import _text

#: (texts' bytes, offsets) -> (text's number, hashed feature, value); for learning, no feature twice in a text
Featurizer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Ftrl:
    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5
    z: np.ndarray = field(default=None, repr=False)
    n: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        size = (1 << self.bits) + 1  # the last is the bias
        self.z = np.zeros(size) if self.z is None else self.z
        self.n = np.zeros(size) if self.n is None else self.n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def push(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """One update of the coordinates ``at`` (no repeats), whose weights are ``w``."""
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, twins: list[tuple[np.ndarray, np.ndarray]] = (), pull: float = 0.0) -> float:
        """Log loss of one row; each twin (a counterfactual copy) adds ``pull`` * (score - twin's score)**2 / 2.  The gradient of both comes in one update."""
        bias = np.array([len(self.z) - 1])
        at, x = np.concatenate([at, bias]), np.concatenate([x, [1.0]])
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        if not twins:
            self.push(at, (p - y) * x, w)
            return p
        union = np.unique(np.concatenate([at, *[t for t, _ in twins]]))
        wu = self.weights(union)
        own = np.zeros(len(union))
        own[np.searchsorted(union, at)] = x
        g = (p - y) * own
        for t, v in twins:
            other = np.zeros(len(union))
            other[np.searchsorted(union, np.concatenate([t, bias]))] = np.concatenate([v, [1.0]])
            g += pull * (wu @ (own - other)) * (own - other)
        self.push(union, g, wu)
        return p

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def sparse(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    ends = np.searchsorted(doc, np.arange(n + 1))
    return [(feature[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int, salt: int = 0) -> DataFrame:
    """(id, text, y) of at most ``at_most`` labelled documents: those lowest by a hash of the id, so a pure function of the ids.

    A doc_id with several labels counts once, with the greatest; null ids and null labels don't count.  A doc_id with several
    rows counts once, with the text of the lowest hash.  The label side is bounded by ``at_most``, which is why it alone may
    be broadcast.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(at_most).select(F.col("doc_id").alias("id"), "y")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "id")
    return rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "y")


def train(rows: DataFrame, featurize: Featurizer, model: Ftrl, epochs: int = 3, twins: Callable[[str], list[str]] | None = None, pull: float = 0.0, empty: float = 0.0) -> np.ndarray:
    """Weights of a model fitted to ``rows`` (id, text, y), ids distinct.  No rows give weights of 0 and ``empty`` as the bias.

    Rows are taken in the order of a hash of their ids, so the result doesn't depend on partitioning.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in _text.slices(batches, "text", rows=1024):
            texts, count = [], []
            for t in b.column(1).to_pylist():
                more = twins(t) if twins else []
                texts += [t, *more]
                count.append(1 + len(more))
            data, at = _text.utf8(pa.array(texts, pa.large_string()))
            owner, f, v = featurize(data, at)
            each = np.diff(np.searchsorted(owner, np.arange(len(texts) + 1)))
            cut = np.concatenate([[0], np.cumsum(count)])
            sizes = np.add.reduceat(each, cut[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _text.lists(each, np.array(count), pa.int32()), _text.lists(f, sizes, pa.int32()), _text.lists(v, sizes, pa.float32())], names=["id", "y", "sizes", "f", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for b in batches:
            for y, sizes, f, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                f, v, cut = f.values.to_numpy(), v.values.to_numpy(), np.cumsum(sizes)[:-1]
                # the sample stays in memory: ids of 4 bytes, and one value where all are the same
                v = v.astype(np.float32)
                values = [v[:1]] * len(sizes) if len(v) and v.min() == v.max() else np.split(v, cut)
                data.append((float(y), list(zip(np.split(f.astype(np.int32), cut), values))))
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(data)):
                y, all_ = data[k]
                wide = [(at.astype(np.int64), np.broadcast_to(v, at.shape).astype(float)) for at, v in all_]
                model.learn(*wide[0], y, wide[1:], pull)
        w = model.dense()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "w": pa.array(w[at], pa.float32())})

    made = rows.mapInArrow(features, "id long, y int, sizes array<int>, f array<int>, v array<float>")
    got = made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(fit, "at int, w float").toPandas()
    w = np.zeros((1 << model.bits) + 1, np.float32)
    w[got["at"].to_numpy()] = got["w"].to_numpy()
    if got.empty:
        w[-1] = empty
    return w


def score(docs: DataFrame, featurize: Featurizer, w: np.ndarray, name: str) -> DataFrame:
    """docs with one more column: the probability, from the sparse dot product of the row's features and ``w``."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b, data, at in _text.slices(batches, "text"):
            doc, f, v = featurize(data, at, w)
            s = np.bincount(doc, w[f] * v, len(at) - 1) + w[-1] if len(doc) else np.full(len(at) - 1, w[-1])
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))

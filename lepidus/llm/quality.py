"""Operator 5: quality classifier.

Hashed word n-grams, logistic regression trained with FTRL updates, scored as sparse dot products.  Words are maximal
runs of letters and digits, or of punctuation, in lower case; n-grams are of 1 and 2 words.  A repeat is a n-gram of its
own kind whatever its words are: "same as the last word" and "same as the word before that" each hash to one feature, so
stuttering text is seen though its words are new.  Values are relative frequencies within the text (times 10), which makes
long and short texts comparable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lepidus.llm import _text, ftrl

BITS = 20
MAX_TRAIN = 6000
KEEP = 0.5


def featurize(data: np.ndarray, at: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, doc = _text.tokens(_text.lower(data), at)
    h = _text.hashes(_text.lower(data), s, e)
    mask = np.uint64((1 << BITS) - 1)
    same = doc[1:] == doc[:-1]
    again = same & (h[1:] == h[:-1])
    two = np.where(again, np.uint64(1), _text.mix(h[1:] * np.uint64(3) + h[:-1], 2))[same]
    near = np.flatnonzero((doc[2:] == doc[:-2]) & (h[2:] == h[:-2])) if len(h) > 2 else np.zeros(0, np.int64)
    f = np.concatenate([h, two, np.full(len(near), 2, np.uint64)]) & mask
    d = np.concatenate([doc, doc[1:][same], doc[near]])
    size = np.maximum(_text.counts(doc, len(at) - 1), 1)
    return d, f.astype(np.int64), 10.0 / size[d]


def merged(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """featurize() with repeats of a feature in a text added up, as learning wants them."""
    d, f, v = featurize(data, at)
    key, where = np.unique(d * (1 << BITS) + f, return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(where, v, len(key))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = MAX_TRAIN) -> np.ndarray:
    return ftrl.train(ftrl.sample(docs, labels, "quality", at_most), merged, ftrl.Ftrl(BITS, alpha=0.5, l1=0.02, l2=0.1), epochs=4)


def classify(docs: DataFrame, labels: DataFrame, at_most: int = MAX_TRAIN, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality_score, keep) of every row of ``docs``.

    ``at_most`` bounds the labelled rows that the model is fitted to; scoring covers every row and whole texts.  A null or
    empty text has no features and gets the bias alone; a null doc_id is scored and stays null; repeated rows get equal
    scores; other columns are ignored; no labelled rows give 0.5 for all, which is kept.
    """
    w = fit(docs, labels, at_most)
    return ftrl.score(docs.select("doc_id", "text"), featurize, w, "quality_score").select("doc_id", F.round("quality_score", 6).alias("quality_score"), (F.col("quality_score") >= keep).alias("keep"))


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    name = _text.fresh(docs.columns, "quality")
    return ftrl.score(docs, featurize, fit(docs, labels), name).where(F.col(name) >= KEEP).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score and whether it is kept."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Model operators: the data around a model is Spark's, the model is injected.

A model is a function from a batch (pandas) to a batch, made once a task by ``make``.  No weights come with this library:
an operator without a model raises when it is called, it doesn't make results up.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]

SCHEMAS = {
    "segment": "image_id string, category_id long, segmentation array<array<double>>, bbox array<double>, area double, score double",
    "detect": "image_id string, category_id long, segmentation array<array<double>>, bbox array<double>, keypoints array<double>, score double",
    "depth": "image_id string, y int, x int, depth double",
    "ocr": "image_id string, text string, confidence double, bbox array<double>",
    "embed": "id string, pos int, embedding array<float>",
    "ask": "image string, question_index int, answer string",
    "write": "id string, text string",
    "reduce": "id string, x double, y double",
    "colour_segments": "image_id string, segment int, y int, x int",
}


def apply(rows: DataFrame, kind: str, make: Callable[[], Model] | None, columns: list[str] | None = None) -> DataFrame:
    """``rows`` through a model of a kind named in SCHEMAS."""
    if make is None:
        raise ValueError(f"no model for '{kind}': pass a function that makes one")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield model(f)

    return rows.select(*(columns or rows.columns)).mapInPandas(run, SCHEMAS[kind])


def patient(call: Callable[[str], str], tries: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A call tried again with growing, jittered pauses; after the last failure the answer is the error's text."""

    def ask(question: str) -> str:
        for k in range(tries):
            try:
                return call(question)
            except Exception as e:  # any failure of a remote model is an answer here
                if k == tries - 1:
                    return f"ERROR: {e}"
                sleep(first * 2**k + random.random() * 0.1)
        return "ERROR"

    return ask


def pending(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The part of a plan that has no result yet: how a broken run goes on."""
    return plan.join(done.select(*key), key, "left_anti")


def best_reading(readings: DataFrame) -> DataFrame:
    """Each image's reading of the highest confidence, ties to the lesser text."""
    return readings.groupBy("image_id").agg(F.max_by("text", F.struct("confidence", "text")).alias("text"), F.max("confidence").alias("confidence"))

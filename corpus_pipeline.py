"""The corpus pipeline: what is kept of ``documents``, stage by stage, each written as Parquet and read again by the next.

Rows that an operator can't judge go on as they are: a null or blank text has no features, no fingerprint and no passage, and
isn't packed.  A row without a doc_id is a document of its own, after those that have one.  Rows that share a doc_id are judged
each by its own text; repeated rows (id and text alike) go or stay together.  Very long texts are one row throughout; packing cuts them into
pieces.  Other columns are carried along, whatever their names, up to the last stage.  An empty table gives no rows.

What is left of cut texts may be near copies again.  So these are dropped from the uncut rows, and passages are cut anew where one
that was dropped had been the first to hold one, until no two texts are within the bits and no passage is repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lepidus.llm import packing, quality, simhash, suffix, toxicity
from lepidus.llm.shared import folder, forget, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages, as suffix.stage() cuts them, and without the near copies that cutting makes.

    A round drops at least one row.  A near copy stays for the next round if it was cut by a passage whose first place is in
    another one of the same round, as nothing would keep that passage then.
    """
    rows, keys = suffix.keyed(docs)
    place = ["first_doc_id", "first_sub"]
    firsts = lambda df: df.toDF(*place)
    while True:
        spans = written(suffix.found(rows, keys), "spans")
        left = written(suffix.without(rows, keys, spans), "cut")
        copies = simhash.copies(left, row=keys[1]).select(F.coalesce("id", F.lit(suffix.LAST)).alias(keys[0]), F.col("row").alias(keys[1]))
        copies = written(copies, "copies")
        links = spans.where("doc_id <> first_doc_id or sub <> first_sub").select(F.col("doc_id").alias(keys[0]), F.col("sub").alias(keys[1]), *place).distinct()
        gone = written(copies.join(links.join(firsts(copies), place), keys, "left_anti"), "gone")
        if not links.join(firsts(gone), place, "left_semi").head(1):
            return left.join(gone, keys, "left_anti").drop(*keys)
        for table in (left, spans, copies):
            forget(table)
        rows = rows.join(gone, keys, "left_anti")


#: (name, (spark, docs, sf_dir) -> DataFrame); all but the last return the columns of ``documents``
STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.stage(spark, docs, _labels(spark, sf_dir))),
    ("quality", lambda spark, docs, sf_dir: quality.stage(spark, docs, _labels(spark, sf_dir))),
    ("simhash", lambda spark, docs, sf_dir: simhash.stage(spark, docs)),
    ("suffix_array", lambda spark, docs, sf_dir: cut(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.stage(spark, docs)),
]

#: Trained classifiers and induced sorting aren't expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, pack_offset, doc_id, piece, start, n_words) of what all stages keep of ``documents``.  Every stage's table stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{folder(spark)}/lepidus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs

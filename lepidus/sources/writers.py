"""Writers.  What may grow is written by tasks in parallel; single documents are built by one aggregate."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lepidus.functions.strings import fixed


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, most: int = 10_000) -> DataFrame:
    """(shard, value): COCO objects as JSON text of about ``most`` images each, with their annotations and the categories these use, lists in order of id.

    Annotations of images that aren't listed are kept, as are categories that no annotation names (in the first object).
    """
    shards = max(1, -(-images.count() // most))
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(shards))
    i, a = images.withColumn("shard", of("id")), annotations.withColumn("shard", of("image_id"))
    used = a.select("shard", F.col("category_id").alias("id")).distinct()
    first = categories.join(used.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("shard"))
    c = used.unionByName(first).join(categories, "id")
    part = lambda df, name: df.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", *[x for x in df.columns if x not in ("id", "shard")]))).alias(name))
    all_ = part(i, "images").join(part(a, "annotations"), "shard", "full").join(part(c, "categories"), "shard", "full")
    return all_.select("shard", F.to_json(F.struct(*[F.coalesce(x, F.array()).alias(x) for x in ("images", "annotations", "categories")])).alias("value"))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(value): one COCO object as JSON text, lists in order of id; for a set that one reader can hold."""
    part = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in df.columns if c != "id"]))).alias(name))
    all_ = part(images, "images").crossJoin(part(annotations, "annotations")).crossJoin(part(categories, "categories"))  # one row each
    return all_.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, most: int = 10_000) -> None:
    """Compact documents under path/compact, one a file, and annotations as JSON lines under path/annotations, all gzipped: what is written is mostly repeated names."""
    docs = coco_documents(images, annotations, categories, most)
    docs.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/compact", compression="gzip")
    annotations.write.mode("overwrite").json(f"{path}/annotations", compression="gzip")


def write_each(rows: DataFrame, folder: str, name: str, content: str) -> None:
    """A file for each row, named by column ``name``, in a shared folder (a path, or an address of a file system that Arrow knows).  A file appears only when it is whole."""
    from pyarrow import fs

    address = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    address = address.replace("file:///", "file:/").replace("file:/", "file:///")

    def save(part: Iterator) -> None:
        store, at = fs.FileSystem.from_uri(address)
        for r in part:
            tmp = f"{at}/.{uuid.uuid4().hex}"
            with store.open_output_stream(tmp) as out:
                out.write(r[1].encode() if isinstance(r[1], str) else bytes(r[1]))
            store.move(tmp, f"{at}/{r[0]}")

    store, at = fs.FileSystem.from_uri(address)
    store.create_dir(at, recursive=True)
    rows.select(name, content).foreachPartition(save)


def metrics_csv(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text, so that CSV can hold them."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema])


def write_metrics(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    for kind, rows in (("csv", metrics_csv(df)), ("jsonl", df)):
        w = rows.write.mode("overwrite").partitionBy(*(partition or []))
        w.csv(f"{path}/{kind}", header=True) if kind == "csv" else w.json(f"{path}/{kind}")


def two_decimals(c: Column) -> Column:
    return F.coalesce(fixed(c, 2), F.lit("NaN"))


def group_statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """Numbers as text of two decimals, NaN where there is none."""
    return df.select(*[two_decimals(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def landmark_rows(points: DataFrame, n: int) -> DataFrame:
    """One row a shape: x1, y1, x2, y2, ... with a header in that order."""
    cols = [F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c.upper()}{k + 1}") for k in range(n) for c in ("x", "y")]
    return points.groupBy("shape_id").agg(*cols)


def tps(points: DataFrame) -> DataFrame:
    """(shape_id, value): a TPS record, LM=, one line a landmark, ID=."""
    line = F.concat(fixed(F.col("x"), 6), F.lit(" "), fixed(F.col("y"), 6))
    g = points.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda s: s["t"]).alias("l"))
    return g.select("shape_id", F.concat(F.lit("LM="), F.size("l").cast("string"), F.lit("\n"), F.array_join("l", "\n"), F.lit("\nID="), F.col("shape_id").cast("string")).alias("value"))


def keypoint_rows(annotations: DataFrame) -> DataFrame:
    """(id, k, x, y, v): keypoints as long rows."""
    from lepidus.operators.coco import points

    return annotations.select("id", F.explode(points(F.col("keypoints"))).alias("p")).select("id", "p.k", "p.x", "p.y", "p.v")


def word_frequencies(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word")


def colour_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, raw): the colour record with names, and with numbers only."""
    names = [c for c in records.columns if c.endswith("_name") and c != "sample_name" or c.endswith("_names")]
    return records.drop(*[c for c in records.columns if c.startswith("average_") and c not in names]), records.drop(*names)


def manifest(rows: DataFrame) -> DataFrame:
    """Run rows with their output path T_<temperature>/rep_<n>."""
    return rows.withColumn("output_json", F.format_string("T_%s/rep_%d/%s.json", fixed(F.col("temperature"), 2), "replicate", "image"))


def chat_lines(rows: DataFrame, question: str, answer: str, system: str | None = None, image_url: str | None = None) -> DataFrame:
    """(value): fine-tuning lines {"messages": [...]}; contents that are lists are JSON text within."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    user = F.col(question) if image_url is None else F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col(question).alias("value")), F.struct(F.lit("image_url").alias("type"), F.col(image_url).alias("value"))))
    parts = ([say("system", F.lit(system))] if system else []) + [say("user", user), say("assistant", F.col(answer))]
    return rows.select(F.to_json(F.struct(F.array(*parts).alias("messages"))).alias("value"))


def latex(texts: DataFrame, column: str = "value") -> DataFrame:
    """Texts with what LaTeX takes for commands escaped, and *name* as italics."""
    c = F.regexp_replace(column, r"([&%$#_{}])", r"\\$1")
    return texts.withColumn(column, F.regexp_replace(c, r"\*([^*\n]+)\*", r"\\textit{$1}"))


def flat_name(path: Column) -> Column:
    """A file's name with its parent's as prefix: what a flattened directory calls it."""
    parts = F.split(path, "/")
    return F.concat(F.element_at(parts, -2), F.lit("_"), F.element_at(parts, -1))


def rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with _reject_reason): the first rule that a row breaks."""
    why = F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules.items()])
    marked = rows.withColumn("_reject_reason", why)
    return marked.where("_reject_reason is null").drop("_reject_reason"), marked.where("_reject_reason is not null")


def mask_files(runs: DataFrame, name: str = "name") -> DataFrame:
    """(name, content): a PNG of each shape's pixel runs (name, y, x0, x1)."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lepidus.sources import png

        for f in frames:
            yield pd.DataFrame({name: f[name], "content": [png.encode(png.mask([(r["y"], r["x0"], r["x1"]) for r in rs])) for rs in f["runs"]]})

    packed = runs.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    return packed.mapInPandas(draw, f"{name} string, content binary")


def with_suffix(name: Column, suffix: str) -> Column:
    """A file name with ``suffix`` before its extension."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(suffix), F.regexp_extract(name, r"(\.[^./]*)$", 1))


def landmark_annotations(points: DataFrame, category_id: int = 1) -> DataFrame:
    """(id, image_id, category_id, keypoints, num_keypoints): each shape's landmarks as a COCO annotation, all visible."""
    xyv = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"], F.lit(2.0))))
    g = points.groupBy("shape_id").agg(xyv.alias("keypoints"))
    return g.select(F.col("shape_id").alias("id"), F.col("shape_id").cast("string").alias("image_id"), F.lit(category_id).cast("long").alias("category_id"), "keypoints", (F.size("keypoints") / 3).cast("int").alias("num_keypoints"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables (components, clusters, word counts, embeddings, overlap scores, similarity matrices, graph comparisons) as CSV with headers, each under path/<name>; complex columns are JSON text."""
    for name, df in tables.items():
        metrics_csv(df).write.mode("overwrite").csv(f"{path}/{name}", header=True)

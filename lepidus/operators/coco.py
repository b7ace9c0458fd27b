"""Annotation sets: cleaning, checking, merging and counting of images, annotations and categories.

Frames follow FIXTURES.md: images (id, file_name, width, height), annotations (id, image_id, category_id, bbox,
segmentation, keypoints, ...), categories (id, name, supercategory).  Order-dependent operators take explicit order columns
and never rely on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESERVED = ("Trash", "Select Label", "Custom")


def flat_names(images: DataFrame, column: str = "file_name") -> DataFrame:
    """Images whose name has no path separator."""
    return images.where(~F.col(column).rlike(r"[/\\]"))


def select_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame, image_id=None, category_name: str | None = None) -> DataFrame:
    """Annotations with their image and category name, optionally of one image or one exact category."""
    if image_id is not None:
        images = images.where(F.col("id") == image_id)
    if category_name is not None:
        categories = categories.where(F.col("name") == category_name)
    found = annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return found.join(names, "category_id", "inner" if category_name is not None else "left").withColumn("category_name", F.coalesce("category_name", F.lit("Unknown")))


def named(annotations: DataFrame, categories: DataFrame, missing: str | None = "Unknown") -> DataFrame:
    """Left join to the category's name; ``missing`` stands for none (None: such rows are dropped)."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    if missing is None:
        return annotations.join(names, "category_id")
    return annotations.join(names, "category_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit(missing)))


def without_categories(annotations: DataFrame, categories: DataFrame, exclude: Sequence[str], column: str = "name") -> tuple[DataFrame, DataFrame]:
    """(annotations, categories) without the excluded categories."""
    kept = categories.where(~F.coalesce(F.col(column).isin(*exclude), F.lit(False)))
    return annotations.join(kept.select(F.col("id").alias("category_id")), "category_id", "left_semi"), kept


def referenced(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select(F.col("image_id").alias("id")), "id", "left_semi")


def with_missing_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image, and one for each image that is only referred to, named after its id."""
    absent = annotations.select(F.col("image_id").alias("id")).distinct().join(images, "id", "left_anti")
    return images.unionByName(absent.withColumn("file_name", F.concat(F.col("id").cast("string"), F.lit(".jpg"))), allowMissingColumns=True)


def renumbered(categories: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """Categories with ``new_id`` 1..n in order.  A dimension table: one partition is right for it."""
    return categories.withColumn("new_id", F.row_number().over(Window.orderBy(*order)))


def boxed(annotations: DataFrame, rule: str = "extent") -> DataFrame:
    """Without empty boxes.  rule "extent": fewer than 4 numbers, or no width or height; "sum": the numbers add up to 0."""
    b = F.col("bbox")
    if rule == "sum":
        return annotations.where(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) != 0)
    return annotations.where((F.size(b) >= 4) & (F.get(b, F.lit(2)) > 0) & (F.get(b, F.lit(3)) > 0))


def segmented(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.coalesce(F.size("segmentation"), F.lit(0)) > 0)


def known(annotations: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Annotations whose ``key`` exists among the parents."""
    return annotations.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def dangling(annotations: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return annotations.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def with_defaults(annotations: DataFrame) -> DataFrame:
    """iscrowd 0 and area width * height where they are absent."""
    return annotations.withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0))).withColumn("area", F.coalesce("area", F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3))))


def points(keypoints: Column) -> Column:
    """[x, y, v, x, y, v, ...] as an array of (k, x, y, v), k from 1."""
    n = (F.size(keypoints) / 3).cast("int")
    at = lambda k, d: F.get(keypoints, (k - 1) * 3 + d)
    each = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), at(k, 0).alias("x"), at(k, 1).alias("y"), at(k, 2).alias("v")))
    return F.when(n > 0, each)


def keypoint_box(annotations: DataFrame, visible_only: bool = True) -> DataFrame:
    """bbox and area of the keypoints' extent (of the visible ones, or of all)."""
    p = points(F.col("keypoints"))
    if visible_only:
        p = F.filter(p, lambda s: s["v"] > 0)
    x, y = F.transform("_p", lambda s: s["x"]), F.transform("_p", lambda s: s["y"])
    out = annotations.withColumn("_p", p).withColumn("_x", x).withColumn("_y", y)
    w, h = F.array_max("_x") - F.array_min("_x"), F.array_max("_y") - F.array_min("_y")
    box = F.when(F.size("_p") > 0, F.array(F.array_min("_x"), F.array_min("_y"), w, h))
    return out.withColumn("bbox", box).withColumn("area", w * h).drop("_p", "_x", "_y")


def split_keypoints(annotations: DataFrame, category_offset: int = 0) -> DataFrame:
    """Annotations once for their segmentation and once for their keypoints, with ``part``; the latter may move to categories of their own."""
    seg = annotations.where(F.coalesce(F.size("segmentation"), F.lit(0)) > 0).withColumn("part", F.lit("segmentation"))
    key = annotations.where(F.coalesce(F.size("keypoints"), F.lit(0)) > 0).withColumn("part", F.lit("keypoints"))
    return seg.unionByName(key.withColumn("category_id", F.col("category_id") + category_offset))


def scored(annotations: DataFrame, least: float = 0.8, categories: Sequence | None = None) -> DataFrame:
    out = annotations.where(F.col("score") >= least)
    return out if categories is None else out.where(F.col("category_id").isin(*categories))


def violations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, rule) of each broken rule: references that dangle, and required values that are absent; no rows mean a valid set."""
    out = dangling(annotations, images, "image_id").select("id", F.lit("image").alias("rule"))
    out = out.unionByName(dangling(annotations, categories, "category_id").select("id", F.lit("category").alias("rule")))
    return out.unionByName(annotations.where("bbox is null or image_id is null or category_id is null").select("id", F.lit("null").alias("rule")))


def numbered(df: DataFrame, order: Sequence[str], block: Column, name: str = "new_id", first: int = 1) -> DataFrame:
    """Sequential numbers in ``order``, without sorting the table in one partition.

    ``block`` must not fall as rows go on in ``order``: blocks are numbered each on its own, and shifted by the rows in the
    blocks before, of which there are as many as blocks.
    """
    b = df.withColumn("_block", block)
    sizes = b.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_block"), F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return b.withColumn("_row", F.row_number().over(Window.partitionBy("_block").orderBy(*order))).join(before, "_block").withColumn(name, F.col("_row") + F.col("_before") + (first - 1)).drop("_block", "_row", "_before")


def per_image(annotations: DataFrame, order: Sequence[str], name: str = "ann_idx") -> DataFrame:
    return annotations.withColumn(name, F.row_number().over(Window.partitionBy("image_id").orderBy(*order)))


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_row = 1").drop("_row")


def unique_ids(annotations: DataFrame, order: Sequence[str], block: Column) -> DataFrame:
    """The first row of an id keeps it; the others get ids after the greatest."""
    marked = annotations.withColumn("_row", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    again = numbered(marked.where("_row > 1"), ["id", *order], block, "_extra").crossJoin(annotations.agg(F.max("id").alias("_max")))
    return marked.where("_row = 1").withColumn("new_id", F.col("id")).drop("_row").unionByName(again.withColumn("new_id", F.col("_max") + F.col("_extra")).drop("_row", "_extra", "_max"))


def after_max(new: DataFrame, old: DataFrame, order: Sequence[str], block: Column, key: str = "id") -> DataFrame:
    """``new`` with ids that go on after the greatest of ``old``."""
    return numbered(new, order, block, "_extra").crossJoin(old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_max"))).withColumn("new_id", F.col("_max") + F.col("_extra")).drop("_extra", "_max")


def merged_categories(categories: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One category for each trimmed name of several files, ids 1.. by first sight (source_file, pos)."""
    c = categories.withColumn("name", F.trim("name")).where(~F.col("name").isin(*skip) if skip else F.lit(True))
    seen = c.groupBy("name").agg(F.min(F.struct("source_file", "pos")).alias("at"))
    return seen.select("name", F.row_number().over(Window.orderBy("at")).alias("id"))


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` by ``mapping`` (source_file, old_id, new_id), within each file; ids that aren't mapped become null."""
    m = mapping.select("source_file", F.col("old_id").alias(column), "new_id")
    return rows.join(m, ["source_file", column], "left").drop(column).withColumnRenamed("new_id", column)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, on_missing: str | None = "Unassigned") -> DataFrame:
    """Left join to (key, group); ``on_missing`` names the group of rows without one (None: they are dropped)."""
    if on_missing is None:
        return rows.join(groups, key)
    return rows.join(groups, key, "left").withColumn("group", F.coalesce("group", F.lit(on_missing)))


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Every key of the dimension, with 0 where it was not counted."""
    return dimension.select(key).join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def by_image(annotations: DataFrame, images: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(file_name, annotations): one list of structs for each image file."""
    return annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("annotations"))

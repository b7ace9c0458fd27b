"""Readers.  Each gives the canonical frames of FIXTURES.md; bad input becomes rows or errors, never silence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.operators.assemble import first_by_prefix
from lepidus.operators.coco import numbered
from lepidus.operators.lineage import bounded, written

IMAGE = "id string, file_name string, width int, height int, area bigint"
ANNOTATION = "id bigint, image_id string, category_id bigint, segmentation array<array<double>>, bbox array<double>, area double, iscrowd int, keypoints array<double>, num_keypoints int, point_order array<int>, score double"
CATEGORY = "id bigint, name string, supercategory string, keypoints array<string>, skeleton array<array<int>>"


def _struct(ddl: str) -> str:
    return "array<struct<" + ", ".join(f"{c.strip().split(' ', 1)[0]}: {c.strip().split(' ', 1)[1]}" for c in ddl.split(", ")) + ">>"


def _file_name() -> Column:
    """The name of the file that a row is from; Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def coco(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO files, each row with its source_file and pos.  A file that isn't a COCO object raises when it is read."""
    schema = f"images {_struct(IMAGE)}, annotations {_struct(ANNOTATION)}, categories {_struct(CATEGORY)}"
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").withColumn("source_file", _file_name())
    checked = raw.where(F.when(F.col("images").isNull() | F.col("annotations").isNull() | F.col("categories").isNull(), F.raise_error(F.concat(F.lit("not a COCO file: "), "source_file")).isNotNull()).otherwise(True))
    out = []
    for part in ("images", "annotations", "categories"):
        out.append(checked.select("source_file", F.posexplode(part).alias("pos", "r")).select("r.*", "source_file", "pos"))
    return tuple(out)


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, supercategory): id 0 is reserved and left out, names trimmed; Trash and Custom are appended after the greatest id if they are missing."""
    t = spark.read.schema("id int, name string, supercategory string").csv(path, header=True) if not path.endswith(".json") else spark.read.schema("id int, name string, supercategory string").json(path, multiLine=True)
    return with_default_labels(t)


def with_default_labels(labels: DataFrame) -> DataFrame:
    t = labels.where("id <> 0").select("id", F.trim("name").alias("name"), F.trim("supercategory").alias("supercategory"))
    extra = t.sparkSession.createDataFrame([(1, "Trash"), (2, "Custom")], "k int, name string").join(t.select("name"), "name", "left_anti")
    extra = extra.withColumn("k", F.row_number().over(Window.orderBy("k"))).crossJoin(t.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")))
    return t.unionByName(extra.select((F.col("m") + F.col("k")).alias("id"), "name", F.col("name").alias("supercategory")))


def json_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a column of JSON lines: parsed rows beside the other columns, and lines that don't parse; blank lines are in neither."""
    some = lines.where(F.length(F.trim(column)) > 0)
    marked = some.withColumn("_r", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rest = [c for c in lines.columns if c != column]
    good = marked.where("_r is not null and _r._corrupt is null").select(*rest, "_r.*").drop("_corrupt")
    return good, marked.where("_r is null or _r._corrupt is not null").select(*rest, column)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return json_lines(spark.read.text(path), schema)


def grouping(spark: SparkSession, path: str) -> DataFrame:
    """(specimen, group) of a CSV, TSV, TXT or JSON file under any of the headers in use; of repeated specimens the last counts; an unknown kind of file gives no rows."""
    kind = path.rsplit(".", 1)[-1].lower()
    names = {"specimen": ("specimen_name", "specimen", "filename", "image"), "group": ("group_name", "group_label", "group")}
    if kind in ("csv", "tsv", "txt"):
        t = spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t")
        by = {c.lower(): c for c in t.columns}
        pick = {k: next((by[v] for v in vs if v in by), t.columns[i]) for i, (k, vs) in enumerate(names.items())}
        t = t.select(F.col(pick["specimen"]).alias("specimen"), F.col(pick["group"]).alias("group"))
    elif kind == "json":
        raw = spark.read.text(path, wholetext=True)
        pairs = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")).select("e.key", "e.value")
        rows = raw.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
        any_of = lambda vs: F.coalesce(*[F.col("m")[v] for v in vs])
        listed = rows.select(any_of(names["specimen"]).alias("specimen"), any_of(names["group"]).alias("group"))
        t = pairs.select(F.col("key").alias("specimen"), F.col("value").alias("group")).where("specimen is not null").unionByName(listed)
    else:
        return spark.createDataFrame([], "specimen string, group string")
    return last_wins(t.withColumn("_o", F.monotonically_increasing_id()), "specimen", "_o").drop("_o")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, all of which must exist."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def group_labels(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.csv(path, header=True), ["filename", "group_label"])


def lines(spark: SparkSession, path: str, lower: bool = False, distinct: bool = False) -> DataFrame:
    """(line): trimmed lines that aren't blank."""
    out = spark.read.text(path).select(F.trim("value").alias("line")).where(F.length("line") > 0)
    out = out.select(F.lower("line").alias("line")) if lower else out
    return out.distinct() if distinct else out


def answers(spark: SparkSession, folder: str, suffix: str = "_qa") -> DataFrame:
    """(species_name, qa map) of a folder of JSON files, named by their stems."""
    name = F.regexp_replace(F.regexp_replace(_file_name(), r"\.json$", ""), f"{suffix}$", "")
    return spark.read.text(f"{folder}/*.json", wholetext=True).select(name.alias("species_name"), F.from_json("value", "map<string,string>").alias("qa"))


def expert_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(base_name, description_taxo, image_path) of a TSV with base_name, answer and image_path; keys in lower case."""
    t = required(spark.read.csv(path, header=True, sep="\t"), ["base_name", "answer", "image_path"])
    return t.select(F.lower(F.trim("base_name")).alias("base_name"), F.col("answer").alias("description_taxo"), "image_path")


def generated_texts(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(base_name, description) of blocks between --- lines, and the blocks without a name or a description."""
    b = texts.select(F.posexplode(F.split(column, r"(?m)^-{3,}\s*$")).alias("pos", "block")).withColumn("block", F.trim(F.regexp_replace("block", r"^\s+|\s+$", ""))).where("block <> ''")
    name = F.lower(F.trim(F.regexp_extract("block", r"(?i)species description for\s+\*?([^\n:*]+?)\*?\s*:", 1)))
    text = F.trim(F.regexp_extract("block", r"(?is)(?:^|\n)\**description\**:\s*(.*?)(?:\n\s*\n\**[A-Z][\w ]+\**:|$)", 1))
    p = b.select("pos", "block", name.alias("base_name"), text.alias("description"))
    return p.where("base_name <> '' and description <> ''").select("base_name", "description"), p.where("base_name = '' or description = ''").select("pos", "block")


def two_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    t = required(spark.read.csv(path, header=True, sep="\t"), ["base_name", "description_taxo", "image_path", "description_gpt4"])
    return t.select("base_name", "description_taxo", "image_path"), t.select("base_name", F.col("description_gpt4").alias("description"))


def models(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.csv(path, header=True), ["base_name", "model_name", "description", "image_path"])


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """(model, pos, line): one text file a model, one line a species, blank lines left out; whole files, so positions are exact."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_replace(_file_name(), r"\.txt$", "").alias("model"), "value")
    return raw.select("model", F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))


HEAD = 1 << 18  # bytes of a file in which its sizes are looked for first


def _heads(paths: DataFrame, kind: str, read: Callable[[bytes], object], names: list[str]) -> DataFrame:
    """(path, ...) of files: what ``read`` finds in each one's first bytes, or, where that is nothing, in the whole file.  Only paths move through Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        from urllib.parse import quote

        from pyarrow import fs

        for f in frames:
            rows = []
            for path in f["path"]:
                store, at = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/"))
                with store.open_input_stream(at) as stream:
                    content = stream.read(HEAD)
                    got = read(content)
                    if got is None and len(content) == HEAD:
                        got = read(content + stream.read())
                rows.append((path, *(got or [None] * len(names))))
            yield pd.DataFrame(rows, columns=["path", *names]).astype(object)

    return paths.select("path").mapInPandas(run, f"path string, {kind}")


def images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff"), exclude: tuple[str, ...] = (), block: int = 10_000) -> DataFrame:
    """(id, path, file_name, width, height, format) of image files in a folder and below, numbered by path; sizes come from the file's header, and unreadable files are left out.

    Numbers are given in ranges of paths of about ``block`` files, each on its own.
    """
    from lepidus.sources.headers import size

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    for name in exclude:
        raw = raw.where(~F.contains("path", F.lit(f"/{name}/")))
    sized = written(_heads(raw, "width int, height int, format string", size, ["width", "height", "format"]).where("width is not null"), "images")
    parts = max(1, -(-sized.count() // block))
    ranged = written(sized.repartitionByRange(parts, "path").withColumn("_block", F.spark_partition_id()), "ranged")
    return numbered(ranged, ["path"], F.col("_block"), "id").select("id", "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "width", "height", "format")


def shots(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """(path, camera, focal_mm, width, height) of the image files in a folder and below that carry EXIF data: what intrinsics() takes."""
    from lepidus.sources.headers import exif

    def read(content: bytes) -> list | None:
        got = exif(content)
        return None if got is None else [got[k] for k in ("camera", "focal_mm", "width", "height")]

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    return _heads(raw, "camera string, focal_mm double, width int, height int", read, ["camera", "focal_mm", "width", "height"]).where("camera is not null")


def structured(texts: DataFrame, column: str = "value") -> DataFrame:
    """``texts`` with ``missing``: which of images, annotations and categories isn't a list in each JSON text (all of them where it doesn't parse), and ``ok`` where none is."""
    keys = ("images", "annotations", "categories")
    got = F.from_json(column, "map<string, string>")
    there = lambda k: F.coalesce(F.ltrim(got[k]).startswith("["), F.lit(False))
    missing = F.filter(F.array(*[F.when(~there(k), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    return texts.withColumn("missing", missing).withColumn("ok", F.size("missing") == 0)


def data_urls(files: DataFrame, mime: str = "image/jpeg") -> DataFrame:
    """(path, url) of (path, content)."""
    return files.select("path", F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("url"))


#: (make and model, sensor's width and height in mm, a pixel's in micrometers)
CAMERAS = [("Canon EOS 5D Mark IV", 36.0, 24.0, 6.36), ("Nikon D850", 35.9, 23.9, 4.35), ("Sony Alpha A7R IV", 35.7, 23.8, 3.76), ("Generic Full Frame", 36.0, 24.0, 5.9)]


def intrinsics(shots: DataFrame, cameras: DataFrame) -> DataFrame:
    """(.., fx, fy, cx, cy) of shots (camera, focal_mm, width, height): focal length in pixels by the sensor's size; null for a camera that isn't listed."""
    j = shots.join(bounded(cameras), "camera", "left")
    return j.select(*shots.columns, F.try_divide(F.col("focal_mm") * F.col("width"), "sensor_w").alias("fx"), F.try_divide(F.col("focal_mm") * F.col("height"), "sensor_h").alias("fy"), (F.col("width") / 2).alias("cx"), (F.col("height") / 2).alias("cy"))


def depth_maps(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, y, x, depth) of .npy files of two dimensions."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"stem": path.rsplit("/", 1)[-1].removesuffix(".npy"), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "depth": a.ravel().astype(float)})

    return spark.read.format("binaryFile").load(f"{folder}/*.npy").select("path", "content").mapInPandas(load, "stem string, y int, x int, depth double")


def class_names(raw: DataFrame, column: str = "value") -> DataFrame:
    """(index, name) of {"thing_classes": [...]} texts."""
    return raw.select(F.posexplode(F.from_json(column, "struct<thing_classes: array<string>>")["thing_classes"]).alias("index", "name"))


def materials(spark: SparkSession, path: str) -> DataFrame:
    """(species_name, files): label files of each species, in the sheet's order, blank fields left out."""
    t = required(spark.read.csv(path, header=True, sep="\t"), ["species_name", "label_jsonl_path"]).where("label_jsonl_path is not null and trim(label_jsonl_path) <> ''")
    return t.withColumn("_o", F.monotonically_increasing_id()).groupBy("species_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "label_jsonl_path"))), lambda s: s["label_jsonl_path"]).alias("files"))


def species_blocks(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(.., pos, block): blocks between lines of 80 signs #, beside the columns to keep."""
    b = texts.select(*keep, F.posexplode(F.split(column, "#{80}")).alias("pos", "block"))
    return b.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block <> ''")


def official_names(raw: DataFrame, column: str = "value") -> DataFrame:
    """(file_name) of a JSON list of strings or of objects with file_name."""
    a = F.from_json(column, "array<struct<file_name: string>>")
    b = F.from_json(column, "array<string>")
    objects = raw.select(F.explode(a).alias("o")).select("o.file_name").where("file_name is not null")
    return objects.unionByName(raw.select(F.explode(b).alias("file_name")).where(~F.col("file_name").startswith("{")))


def existing(rows: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows whose file is in the listing."""
    return rows.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def after_marker(texts: DataFrame, marker: str, column: str = "value") -> DataFrame:
    """(tail): what follows the marker; texts without it are left out."""
    return texts.where(F.contains(column, F.lit(marker))).select(F.trim(F.substring_index(column, marker, -1)).alias("tail"))


def mask_files(listing: DataFrame, annotations: DataFrame, categories: DataFrame, images: DataFrame, category: str) -> DataFrame:
    """(file_name, path): for each image with an annotation of the category, the first file (by path) whose name starts with the image's stem."""
    wanted = annotations.join(categories.where(F.col("name") == category).select(F.col("id").alias("category_id")), "category_id").select(F.col("image_id").alias("id")).distinct().join(images, "id")
    stem = wanted.select("file_name", F.substring_index("file_name", ".", 1).alias("stem"))
    files = listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return first_by_prefix(stem, files, "stem", "name", "path").select("file_name", "path")

"""Plans that write tables as files to the shared folder and read them back through the readers."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators import shapes, stats, text
from lepidus.operators.lineage import folder
from lepidus.plans import Tables, query
from lepidus.plans.geometry import PTS, outlines, points
from lepidus.plans.text import TOK, _tok
from lepidus.plans.views import annotations, categories, images
from lepidus.sources import readers, writers


def _at(t: Tables, name: str) -> str:
    return f"{folder(t.spark)}/lepidus-files-{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, at: str, sep: str = ",") -> str:
    df.write.csv(at, header=True, sep=sep)
    return at


def _sets(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = annotations(t).select(F.xxhash64("image_id", "num", "category_id", "price").alias("id"), F.col("image_id").cast("string").alias("image_id"), "category_id", "bbox")
    return images(t).select(F.col("id").cast("string").alias("id"), "file_name"), a, categories(t)


@query("s01_coco_files", "SELECT l_orderkey::VARCHAR AS image_id, count(*) AS n, sum(l_quantity) AS width FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    at = _at(t, "coco")
    writers.write_coco(*_sets(t), at, 5000)
    _, a, _ = readers.coco(t.spark, f"{at}/compact")
    return a.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(a["bbox"][2]).alias("width"))


@query("k02_annotation_lines", "SELECT l_partkey AS category_id, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    at = _at(t, "lines")
    writers.write_coco(*_sets(t), at, 5000)
    return t.spark.read.schema(readers.ANNOTATION).json(f"{at}/annotations").groupBy("category_id").agg(F.count("*").alias("n"))


@query("k03_metrics_files", "SELECT k AS kind, l_suppkey, n, round(m, 6) AS m FROM (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS m FROM lineitem GROUP BY 1), (VALUES ('csv'), ('jsonl')) v(k)")
def _(t: Tables) -> DataFrame:
    at = _at(t, "metrics")
    writers.write_metrics(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m")), at)
    schema = "l_suppkey bigint, n bigint, m double"
    both = t.spark.read.schema(schema).csv(f"{at}/csv", header=True).withColumn("kind", F.lit("csv")).unionByName(t.spark.read.schema(schema).json(f"{at}/jsonl").withColumn("kind", F.lit("jsonl")))
    return both.select("kind", "l_suppkey", "n", F.round("m", 6).alias("m"))


@query("s06_group_labels", "SELECT c_name AS filename, c_mktsegment AS group_label FROM customer")
def _(t: Tables) -> DataFrame:
    return readers.group_labels(t.spark, _csv(t.customer.select("c_custkey", F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("group_label")), _at(t, "labels")))


@query("s08_answer_files", "SELECT n_name AS species_name, 'Q1: region' AS question, n_regionkey::VARCHAR AS answer FROM nation")
def _(t: Tables) -> DataFrame:
    at = _at(t, "answers")
    writers.write_each(t.nation.select(F.concat("n_name", F.lit("_qa.json")).alias("name"), F.to_json(F.create_map(F.lit("Q1: region"), F.col("n_regionkey").cast("string"))).alias("content")), at, "name", "content")
    return readers.answers(t.spark, at).select("species_name", F.explode("qa").alias("question", "answer"))


@query("s09_expert_sheet", "SELECT lower(trim(c_name)) AS base_name, c_mktsegment AS description_taxo, 'images/' || c_custkey || '.jpg' AS image_path FROM customer")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.lit("images/"), "c_custkey", F.lit(".jpg")).alias("image_path")
    return readers.expert_sheet(t.spark, _csv(t.customer.select(F.col("c_name").alias("base_name"), F.col("c_mktsegment").alias("answer"), path, "c_nationkey"), _at(t, "experts"), "\t"))


@query("s10_generated_texts", "SELECT 'sp_' || item_id AS base_name, trim(text) AS description FROM benchmark")
def _(t: Tables) -> DataFrame:
    # ten descriptions to a file, set apart by dashes
    block = F.concat(F.lit("Species Description for *Sp_"), "item_id", F.lit("*:\n**Description**: "), F.trim("text"))
    files = t.benchmark.groupBy(F.floor(F.col("item_id") / 10)).agg(F.array_join(F.collect_list(block), "\n---\n").alias("value"))
    return readers.generated_texts(files)[0]


@query("s11_two_texts", "SELECT 'expert' AS kind, p_name AS base_name, p_brand AS description FROM part UNION ALL SELECT 'model', p_name, p_type FROM part")
def _(t: Tables) -> DataFrame:
    sheet = t.part.select(F.col("p_name").alias("base_name"), F.col("p_brand").alias("description_taxo"), F.lit("x.jpg").alias("image_path"), F.col("p_type").alias("description_gpt4"))
    expert, model = readers.two_texts(t.spark, _csv(sheet, _at(t, "two"), "\t"))
    return expert.select(F.lit("expert").alias("kind"), "base_name", F.col("description_taxo").alias("description")).unionByName(model.select(F.lit("model").alias("kind"), "base_name", "description"))


@query("s12_model_sheet", "SELECT p_name AS base_name, 'm' || p_size % 3 AS model_name, p_type AS description, 'x.jpg' AS image_path FROM part")
def _(t: Tables) -> DataFrame:
    sheet = t.part.select(F.concat(F.lit("m"), F.col("p_size") % 3).alias("model_name"), F.col("p_name").alias("base_name"), F.col("p_type").alias("description"), F.lit("x.jpg").alias("image_path"))
    return readers.models(t.spark, _csv(sheet, _at(t, "models"))).select("base_name", "model_name", "description", "image_path")


@query("s13_description_files", "SELECT r_name AS model, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    at = _at(t, "descriptions")
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), "\n\n").alias("content"))
    writers.write_each(n.select(F.concat("r_name", F.lit(".txt")).alias("name"), "content"), at, "name", "content")
    return readers.descriptions(t.spark, at).select("model", F.col("pos").cast("long").alias("pos"), "line")


def _runs(t: Tables) -> DataFrame:
    return shapes.rasterised(outlines(t, 20.0)).select("shape_id", (F.col("y") + 200).alias("y"), (F.col("x0") + 200).alias("x0"), (F.col("x1") + 200).alias("x1"))


@query("s14_k17_mask_images")
def _(t: Tables) -> DataFrame:
    """Masks as PNG files, found again with their sizes."""
    at = _at(t, "masks")
    name = writers.with_suffix(F.concat(F.lit("shape_"), "shape_id", F.lit(".png")), "_mask")
    writers.write_each(writers.mask_files(_runs(t).withColumn("name", name)), at, "name", "content")
    return readers.images(t.spark, at).select("id", "file_name", "width", "height", "format")


@query("s17_depth_maps", "SELECT 'depth_' || n_nationkey AS stem, y::INT AS y, x::INT AS x, (n_regionkey + 10 * y + x)::DOUBLE AS depth FROM nation, range(2) a(y), range(3) b(x)")
def _(t: Tables) -> DataFrame:
    @F.pandas_udf("binary")
    def depth(first: pd.Series) -> pd.Series:
        def one(v: int) -> bytes:
            out = io.BytesIO()
            np.save(out, v + 10.0 * np.arange(2)[:, None] + np.arange(3)[None])
            return out.getvalue()

        return first.map(one)

    at = _at(t, "depth")
    writers.write_each(t.nation.select(F.concat(F.lit("depth_"), "n_nationkey", F.lit(".npy")).alias("name"), depth("n_regionkey").alias("content")), at, "name", "content")
    return readers.depth_maps(t.spark, at)


@query("s19_material_sheet", "SELECT 'sp' || o_custkey AS species_name, count(*) AS n, min('f' || o_orderkey) AS first, max('f' || o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    file = F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.concat(F.lit("f"), "o_orderkey"))
    sheet = _csv(t.orders.select(F.concat(F.lit("sp"), "o_custkey").alias("species_name"), file.alias("label_jsonl_path")), _at(t, "materials"), "\t")
    return readers.materials(t.spark, sheet).select("species_name", F.size("files").cast("long").alias("n"), F.array_min("files").alias("first"), F.array_max("files").alias("last"))


@query("s20_species_blocks", r"SELECT doc_id, k::INT AS pos, md5(regexp_replace(text, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')) AS digest FROM documents, range(2) r(k) WHERE regexp_matches(text, '[^ \t\n\f\r]')")
def _(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", F.concat("text", F.lit("\n" + "#" * 80 + "\n"), "text").alias("value"))
    each = both.withColumn("value", F.concat(F.col("doc_id").cast("string"), F.lit("\n" + "#" * 80 + "\n"), "value"))
    # the first block tells whose text the others are
    b = readers.species_blocks(each.select("doc_id", "value"), keep=("doc_id",)).where("pos > 0")
    return b.select("doc_id", (F.col("pos") - 1).alias("pos"), F.md5("block").alias("digest"))


@query("s07_line_lists", "SELECT DISTINCT lower(trim(p_name)) AS line FROM part")
def _(t: Tables) -> DataFrame:
    at = _at(t, "lines")
    t.part.select(F.concat(F.lit(" "), "p_name", F.lit(" \n")).alias("value")).write.text(at)
    return readers.lines(t.spark, at, lower=True, distinct=True)


@query("s16_exif_intrinsics", "SELECT 'shot_' || n_nationkey || '.jpg' AS file_name, round((50 + n_nationkey) * 6000 / 35.9::DOUBLE, 6) AS fx, round((50 + n_nationkey) * 4000 / 23.9::DOUBLE, 6) AS fy, 3000.0::DOUBLE AS cx FROM nation")
def _(t: Tables) -> DataFrame:
    def jpeg(focal: int) -> bytes:
        text_ = b"Nikon\0" + b"D850\0"
        entries = [(0x010F, 2, 6, 200), (0x0110, 2, 5, 206), (0x8769, 4, 1, 60)]
        inner = [(0x920A, 5, 1, 220), (0xA002, 4, 1, 6000), (0xA003, 4, 1, 4000)]
        tiff = bytearray(240)
        tiff[:8] = b"II*\0" + struct.pack("<I", 8)
        for at, part in ((8, entries), (60, inner)):
            tiff[at : at + 2] = struct.pack("<H", len(part))
            for k, e in enumerate(part):
                tiff[at + 2 + 12 * k : at + 14 + 12 * k] = struct.pack("<HHII", *e)
        tiff[200 : 200 + len(text_)] = text_
        tiff[220:228] = struct.pack("<II", focal * 10, 10)
        body = b"Exif\0\0" + bytes(tiff)
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0\x00\x0b\x08\x0f\xa0\x17\x70\x01\x01\x11\x00\xff\xda"

    @F.pandas_udf("binary")
    def shot(k: pd.Series) -> pd.Series:
        return k.map(lambda v: jpeg(50 + int(v)))

    at = _at(t, "shots")
    writers.write_each(t.nation.select(F.concat(F.lit("shot_"), "n_nationkey", F.lit(".jpg")).alias("name"), shot("n_nationkey").alias("content")), at, "name", "content")
    cameras = t.spark.createDataFrame(readers.CAMERAS, "camera string, sensor_w double, sensor_h double, pixel double").drop("pixel")
    got = readers.intrinsics(readers.shots(t.spark, at), cameras)
    return got.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"), "cx")


@query("p26_structure", "SELECT doc_id % 4 AS kind, doc_id % 4 = 0 AS ok, count(*) AS n FROM documents GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct(F.array("doc_id").alias("images"), F.array("doc_id").alias("annotations"), F.array().alias("categories")))
    no_list = F.concat(F.lit('{"images": [1], "annotations": {"a": 1}, "categories": []}'))
    value = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, no_list).when(F.col("doc_id") % 4 == 2, F.lit('{"images": []}')).otherwise(F.lit("not json"))
    return readers.structured(t.documents.select((F.col("doc_id") % 4).alias("kind"), value.alias("value"))).groupBy("kind", "ok").agg(F.count("*").alias("n"))


@query("k05_tps_records", f"WITH {PTS} SELECT shape_id, 'LM=32' || chr(10) || string_agg(printf('%.6f %.6f', x, y), chr(10) ORDER BY i) || chr(10) || 'ID=' || shape_id AS value FROM pts GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return writers.tps(points(t))


_WIDE = ", ".join(f"embedding[{2 * k + 1}]::DOUBLE AS X{k + 1}, embedding[{2 * k + 2}]::DOUBLE AS Y{k + 1}" for k in range(32))


@query("k05_landmark_table", f"SELECT vec_id AS shape_id, {_WIDE} FROM embeddings")
def _(t: Tables) -> DataFrame:
    return writers.landmark_rows(points(t), 32)


@query("k06_back_transformed", f"WITH {PTS} SELECT shape_id AS id, list_transform(flatten(list([x, y, 2.0::DOUBLE] ORDER BY i)), lambda v: round(v, 4)) AS keypoints FROM pts GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # landmarks aligned and scaled, then taken back by each shape's own transform: where they were
    c = shapes.centred(points(t))
    back = c.join(shapes.back_transform(c, points(t)), "shape_id")
    co, si = F.cos("angle") * F.col("scale"), F.sin("angle") * F.col("scale")
    # what the transform's own rounding leaves of a zero has no sign
    noise = F.lit(1e-14) * (F.col("scale") + F.abs("dx") + F.abs("dy"))
    whole = lambda v: F.when(F.abs(v) < noise, 0.0).otherwise(v)
    p = back.select("shape_id", "i", whole(F.col("x") * co - F.col("y") * si + F.col("dx")).alias("x"), whole(F.col("x") * si + F.col("y") * co + F.col("dy")).alias("y"))
    # round() gives 0.0 for what is just below zero, SQL's -0.0
    return writers.landmark_annotations(p).select("id", F.transform("keypoints", lambda v: F.when(v < 0, -F.round(-v, 4)).otherwise(F.round(v, 4))).alias("keypoints"))


@query("k08_k10_result_tables", f"""WITH {TOK}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM tok) GROUP BY 1)
 SELECT 'words' AS name, (SELECT count(*) FROM w) AS n_rows, (SELECT sum(n) FROM w)::DOUBLE AS total UNION ALL SELECT 'components', count(*), round(sum(l_quantity), 4) FROM lineitem UNION ALL SELECT 'embeddings', count(*), sum(vec_id)::DOUBLE FROM embeddings""")
def _(t: Tables) -> DataFrame:
    at = _at(t, "tables")
    pcs, _ = stats.components(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    writers.write_tables({"words": text.word_counts(_tok(t), "w"), "components": pcs.select("l_orderkey", "size", "pc1", "pc2"), "embeddings": t.embeddings.select("vec_id", "embedding")}, at)
    read = lambda name: t.spark.read.csv(f"{at}/{name}", header=True)
    one = lambda name, c: read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.round(F.sum(F.col(c).cast("double")), 4).alias("total"))
    return one("words", "n").unionByName(one("components", "size")).unionByName(one("embeddings", "vec_id"))

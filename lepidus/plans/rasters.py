"""Plans over masks, solids and picture data, and the readers and writers that tables can stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.functions import colour as fc
from lepidus.operators import coco, detection, models, raster, shapes, vectors
from lepidus.plans import Tables, query
from lepidus.plans.geometry import outlines
from lepidus.plans.colour import HIST, PIX, inside, pixels
from lepidus.plans.views import ANN, CAT, IMG, annotations, categories, images
from lepidus.sources import readers, writers


def _polygons(t: Tables, scale: float = 40.0) -> DataFrame:
    return outlines(t, scale)


def _masks(t: Tables) -> DataFrame:
    return shapes.rasterised(_polygons(t)).select(F.col("shape_id").alias("mask_id"), "y", F.explode(F.sequence("x0", "x1")).alias("x"))


@query("g02_contours")
def _(t: Tables) -> DataFrame:
    return raster.contours(_masks(t), 6)


@query("g35_cleaned_masks")
def _(t: Tables) -> DataFrame:
    return raster.cleaned(_masks(t), 2)


@query("g12_warped")
def _(t: Tables) -> DataFrame:
    ring = _polygons(t, 1.0)
    inner = ring.select("shape_id", F.col("i").alias("k"), (F.col("x") * 0.5).alias("x"), (F.col("y") * 0.5).alias("y"))
    return raster.warped(inner, ring, ring.select("shape_id", "i", (F.col("x") * 2).alias("x"), F.col("y")))


def _colours(t: Tables) -> DataFrame:
    c = pixels(t).select("sample", "c0", "c1", "c2").distinct()
    l_, a, b = fc.lab(F.col("c0"), F.col("c1"), F.col("c2"))
    return c.select("sample", F.row_number().over(Window.partitionBy("sample").orderBy("c0", "c1", "c2")).alias("k"), l_.alias("l"), a.alias("a"), b.alias("b"))


@query("g18_lab_clusters")
def _(t: Tables) -> DataFrame:
    return vectors.hierarchical(_colours(t), "sample", "k", ["l", "a", "b"], way="average", height=30.0)


@query("g18_threshold_sweep")
def _(t: Tables) -> DataFrame:
    return vectors.sweep(_colours(t), "sample", "k", ["l", "a", "b"], [10.0, 20.0, 25.0, 30.0, 40.0])


@query("g18_dominant_clusters")
def _(t: Tables) -> DataFrame:
    return vectors.dominant(vectors.hierarchical(_colours(t), "sample", "k", ["l", "a", "b"], way="average", height=25.0), "sample")


@query("g25_shine", f"WITH {PIX} SELECT sample, count(*) AS n FROM pix WHERE greatest(c0, c1, c2) >= 240 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = pixels(t).withColumn("v", fc.hsv(F.col("c0"), F.col("c1"), F.col("c2"))[2])
    return raster.shiny(p).groupBy("sample").agg(F.count("*").alias("n"))


def _picture(t: Tables) -> DataFrame:
    h, s, v = fc.hsv(F.col("c0"), F.col("c1"), F.col("c2"))
    p = pixels(t).select(F.col("sample").alias("image"), (F.col("c0") % 24).cast("int").alias("y"), (F.col("c1") % 24).cast("int").alias("x"), h.alias("h"), s.alias("s"), v.cast("double").alias("v")).repartition("image")
    return coco.first_of(p, ["image", "y", "x"], ["h", "s", "v"])


@query("g25_equalised")
def _(t: Tables) -> DataFrame:
    return raster.equalised(_picture(t).select("image", "y", "x", "v"), tiles=2)


@query("g25_lightened")
def _(t: Tables) -> DataFrame:
    p = pixels(t).select(F.col("sample").alias("image"), (F.col("c0") % 24).cast("int").alias("y"), (F.col("c1") % 24).cast("int").alias("x"), "c0", "c1", "c2").repartition("image")
    return raster.lightened(coco.first_of(p, ["image", "y", "x"], ["c0", "c1", "c2"]), tiles=2)


@query("g25_segments")
def _(t: Tables) -> DataFrame:
    p = pixels(t).select(F.col("sample").alias("image"), (F.col("c0") % 24).cast("int").alias("y"), (F.col("c1") % 24).cast("int").alias("x"), "c0", "c1", "c2").repartition("image")
    return raster.segments(coco.first_of(p, ["image", "y", "x"], ["c0", "c1", "c2"]), least=5)


@query("g25_without_shine")
def _(t: Tables) -> DataFrame:
    return raster.without_shine(_picture(t).select("image", "y", "x", "v"))


@query("g26_scale_bars")
def _(t: Tables) -> DataFrame:
    return raster.scale_bars(_picture(t), aspect=1.0, narrowest=1)


@query("g30_solid_measures")
def _(t: Tables) -> DataFrame:
    e = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(k.alias("i"), *[F.get("embedding", 3 * k + d).cast("double").alias(c) for d, c in enumerate("xyz")]))
    return raster.solid_measures(t.embeddings.select(F.col("vec_id").alias("shape_id"), F.explode(e).alias("p")).select("shape_id", "p.*"))


@query("g31_valid_area")
def _(t: Tables) -> DataFrame:
    p = _polygons(t)
    ok = raster.valid_polygons(p).where("valid").select("shape_id")
    return shapes.area_perimeter(p.join(ok, "shape_id", "left_semi")).agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query("g32_label_points", "SELECT vec_id, k AS i FROM embeddings, range(0, 32, 6) r(k)")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"), F.lit(32 // 5).cast("long"))).alias("i"))


@query("m02_average_precision")
def _(t: Tables) -> DataFrame:
    # a prediction beside every second box: moved by its discount, scored by its price
    a = annotations(t).select("image_id", (F.col("category_id") % 20).alias("category_id"), "num", "disc", "price", F.array(F.col("supp").cast("double"), "qty", F.lit(40.0), F.lit(30.0)).alias("bbox"))
    b = F.col("bbox")
    p = a.where("num % 2 = 1").withColumn("bbox", F.array(b[0] + F.col("disc") * 100, b[1], b[2], b[3])).withColumn("score", F.col("price") / 100000)
    return detection.average_precision(p, a).select("category_id", "threshold", F.round("ap", 6).alias("ap"), "n_truth")


@query("r01_overlay_hues", f"WITH {CAT} SELECT supercategory, round((row_number() OVER (ORDER BY supercategory) - 1) / count(*) OVER ()::DOUBLE, 6) AS hue FROM (SELECT DISTINCT supercategory FROM categories)")
def _(t: Tables) -> DataFrame:
    c = categories(t).select("supercategory").distinct()  # categories are few
    n = c.agg(F.count("*").alias("n"))
    return c.crossJoin(n).select("supercategory", F.round((F.row_number().over(Window.orderBy("supercategory")) - 1) / F.col("n"), 6).alias("hue"))


@query("r09_replaced_annotations", f"WITH {ANN} SELECT image_id, num, price FROM ann WHERE image_id % 50 <> 0 UNION ALL SELECT image_id, num + 100, price FROM ann WHERE image_id % 50 = 0 AND qty > 25")
def _(t: Tables) -> DataFrame:
    a = annotations(t)
    redone = a.where("image_id % 50 = 0")
    old = coco.dangling(a, redone, "image_id", "image_id")
    return old.select("image_id", "num", "price").unionByName(redone.where("qty > 25").select("image_id", (F.col("num") + 100).alias("num"), "price"))


@query("r10_new_label", f"WITH {CAT} SELECT id, name FROM categories UNION ALL SELECT max(id) + 1, 'new label' FROM categories")
def _(t: Tables) -> DataFrame:
    new = t.spark.createDataFrame([("new label",)], "name string")
    made = coco.after_max(new, categories(t), ["name"], F.lit(0)).select(F.col("new_id").alias("id"), "name")
    return categories(t).select("id", "name").unionByName(made)


@query("r12_prompt_points", f"WITH {ANN} SELECT image_id, num, category_id, k, CASE v WHEN 2 THEN 1 ELSE 0 END AS label FROM (SELECT image_id, num, category_id, 1 AS k, num % 3 AS v FROM ann UNION ALL SELECT image_id, num, category_id, 2, 2 FROM ann) WHERE v > 0")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("keypoints", F.array("qty", "qty", (F.col("num") % 3).cast("double"), "qty", "qty", F.lit(2.0)))
    p = a.select("image_id", "num", "category_id", F.explode(coco.points(F.col("keypoints"))).alias("p")).where("p.v > 0")
    return p.select("image_id", "num", "category_id", "p.k", F.when(F.col("p.v") == 2, 1).otherwise(0).alias("label"))


@query("p01_projected_keys", "SELECT lower(trim(c_name)) AS base_name, c_mktsegment AS description FROM customer")
def _(t: Tables) -> DataFrame:
    return readers.required(t.customer, ["c_name", "c_mktsegment"]).select(F.lower(F.trim("c_name")).alias("base_name"), F.col("c_mktsegment").alias("description"))


@query("s18_class_names", "SELECT n_nationkey AS \"index\", n_name AS name FROM nation")
def _(t: Tables) -> DataFrame:
    doc = t.nation.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("thing_classes"))).alias("value"))
    return readers.class_names(doc)


@query("s21_official_names", "SELECT 'img_' || o_orderkey || '.jpg' AS file_name FROM orders")
def _(t: Tables) -> DataFrame:
    # a list for each specimen, of objects or of strings
    two = images(t).groupBy("specimen")
    objects = two.agg(F.to_json(F.collect_list(F.when(F.col("id") % 2 == 0, F.struct("file_name")))).alias("value"))
    plain = two.agg(F.to_json(F.collect_list(F.when(F.col("id") % 2 == 1, F.col("file_name")))).alias("value"))
    return readers.official_names(objects).unionByName(readers.official_names(plain))


@query(
    "s23_mask_files",
    f"""WITH {IMG}, {CAT}, {ANN}, m AS (SELECT split_part(file_name, '.', 1) || '_mask.png' AS path FROM images), w AS (SELECT DISTINCT file_name, split_part(file_name, '.', 1) AS stem FROM images JOIN ann ON image_id = images.id JOIN categories c ON c.id = category_id WHERE name = 'small ring')
 SELECT file_name, min(path) AS path FROM w JOIN m ON starts_with(path, stem) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    # the first by path: a stem may begin another's, as img_1 does img_10's
    listing = images(t).select(F.concat(F.substring_index("file_name", ".", 1), F.lit("_mask.png")).alias("path"))
    return readers.mask_files(listing, annotations(t).select("image_id", "category_id"), categories(t), images(t), "small ring").select("file_name", "path")


@query("k07_keypoint_rows", f"WITH {ANN} SELECT image_id AS id, k, CASE k WHEN 1 THEN qty ELSE supp::DOUBLE END AS x, num::DOUBLE AS v FROM ann, range(1, 3) r(k)")
def _(t: Tables) -> DataFrame:
    a = annotations(t).select(F.col("image_id").alias("id"), F.array("qty", "qty", F.col("num").cast("double"), F.col("supp").cast("double"), "qty", F.col("num").cast("double")).alias("keypoints"))
    return writers.keypoint_rows(a).select("id", F.col("k").cast("long").alias("k"), "x", "v")


@query(
    "k09_colour_records",
    f"""WITH {HIST}, r AS (SELECT sample AS sample_name, round(avg(c0), 4) AS average_red, count(*) AS pixels FROM pix WHERE inside GROUP BY 1)
 SELECT 'raw' AS kind, sample_name, average_red, NULL AS dominant_color_name, pixels FROM r UNION ALL SELECT 'readable', sample_name, NULL, CASE WHEN average_red > 128 THEN 'red' ELSE 'dark' END, pixels FROM r""",
)
def _(t: Tables) -> DataFrame:
    r = inside(t).groupBy(F.col("sample").alias("sample_name")).agg(F.round(F.avg("c0"), 4).alias("average_red"), F.count("*").alias("pixels"))
    readable, raw = writers.colour_records(r.withColumn("dominant_color_name", F.when(F.col("average_red") > 128, "red").otherwise("dark")))
    return raw.withColumn("kind", F.lit("raw")).unionByName(readable.withColumn("kind", F.lit("readable")), allowMissingColumns=True)


@query("k11_category_counts", f"WITH {ANN} SELECT category_id, count(*) AS n FROM ann GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return annotations(t).groupBy("category_id").agg(F.count("*").alias("n"))


@query("k14_latex", "SELECT item_id, replace(replace(text, '%', '\\%'), '&', '\\&') AS value FROM benchmark")
def _(t: Tables) -> DataFrame:
    return writers.latex(t.benchmark.select("item_id", F.col("text").alias("value")))


@query("m06_embedded_windows")
def _(t: Tables) -> DataFrame:
    from lepidus.functions import strings

    words = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.posexplode(strings.windows(strings.tokens(F.col("text")))).alias("pos", "words"))

    def make():
        import pandas as pd

        # stands in for a text encoder: letter counts, so that the plan around it can run
        return lambda f: pd.DataFrame({"id": f.id, "pos": f.pos, "embedding": [[float(" ".join(w).count(c)) for c in "abcdefgh"] for w in f.words]})

    return vectors.pooled(models.apply(words, "embed", make), "id", "pos", "embedding")

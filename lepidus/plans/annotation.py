"""Plans over annotation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lepidus.operators import coco, measure
from lepidus.plans import Tables, query
from lepidus.plans.views import ANN, CAT, GRP, IMG, NUM, ORDER, annotations, categories, groups, images



def block() -> Column:
    """Runs of image ids: never falls in ORDER."""
    return F.floor(F.col("image_id") / 512)


GONE = "supercategory IN ('Brand#3', 'Brand#7')"


@query(
    "a03_group_measurements",
    f"""WITH {IMG}, {ANN}, {GRP} SELECT coalesce("group", 'Unassigned') AS "group", round(avg(qty), 6) AS qty_mean, round(stddev_pop(qty), 6) AS qty_std, min(qty) AS qty_min, max(qty) AS qty_max, count(qty) AS qty_n,
 round(avg(price), 6) AS price_mean, round(stddev_pop(price), 6) AS price_std, min(price) AS price_min, max(price) AS price_max, count(price) AS price_n
 FROM ann JOIN images ON image_id = images.id LEFT JOIN grp USING (specimen) WHERE flag <> 'N' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    a = annotations(t).where("flag <> 'N'").join(images(t).select(F.col("id").alias("image_id"), "specimen"), "image_id")
    return measure.population(coco.with_groups(a, groups(t), "specimen"), ["group"], ["qty", "price"])


@query("s02_select_annotations", f"WITH {IMG}, {CAT}, {ANN} SELECT image_id, category_id, file_name, name AS category_name, qty FROM ann JOIN images i ON i.id = image_id JOIN categories c ON c.id = category_id WHERE name = 'small ring'")
def _(t: Tables) -> DataFrame:
    return coco.select_annotations(annotations(t), images(t), categories(t), category_name="small ring").select("image_id", "category_id", "file_name", "category_name", "qty")


@query("p02_flat_names", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def _(t: Tables) -> DataFrame:
    k = F.col("id")
    name = F.concat(F.when(k % 7 == 0, "sub/").when(k % 5 == 0, "sub\\").otherwise(""), "file_name")
    return coco.flat_names(images(t).withColumn("file_name", name)).select("id")


@query("p03_one_image", f"WITH {IMG}, {CAT}, {ANN} SELECT image_id, coalesce(name, 'Unknown') AS category_name, qty FROM ann JOIN images i ON i.id = image_id LEFT JOIN categories c ON c.id = category_id WHERE image_id = 77")
def _(t: Tables) -> DataFrame:
    return coco.select_annotations(annotations(t), images(t), categories(t), image_id=77).select("image_id", "category_name", "qty")


@query("p04_without_categories", f"WITH {CAT}, {ANN} SELECT supercategory, count(*) AS n FROM ann JOIN categories c ON c.id = category_id WHERE NOT ({GONE}) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kept, cats = coco.without_categories(annotations(t), categories(t), ["Brand#3", "Brand#7"], "supercategory")
    return coco.named(kept, cats.select("id", F.col("supercategory").alias("name"))).groupBy(F.col("category_name").alias("supercategory")).agg(F.count("*").alias("n"))


@query(
    "p05_renumbered_categories",
    f"WITH {CAT}, {ANN}, used AS (SELECT DISTINCT category_id FROM ann WHERE qty > 45) SELECT id, row_number() OVER (ORDER BY id) AS new_id, name FROM categories WHERE NOT ({GONE}) AND id IN (FROM used)",
)
def _(t: Tables) -> DataFrame:
    big = annotations(t).where("qty > 45")
    _, cats = coco.without_categories(big, categories(t), ["Brand#3", "Brand#7"], "supercategory")
    return coco.renumbered(coco.known(cats, big, "id", "category_id")).select("id", "new_id", "name")


@query(
    "p06_missing_images",
    f"WITH {IMG}, {ANN}, have AS (SELECT id, file_name FROM images WHERE id % 10 <> 0) FROM have UNION ALL SELECT DISTINCT image_id, image_id || '.jpg' FROM ann WHERE image_id NOT IN (SELECT id FROM have)",
)
def _(t: Tables) -> DataFrame:
    return coco.with_missing_images(images(t).where("id % 10 <> 0").select("id", "file_name"), annotations(t))


@query("p07_empty_boxes", f"WITH {ANN} SELECT image_id, num, category_id, supp, qty, disc FROM ann WHERE qty > 0 AND disc > 0")
def _(t: Tables) -> DataFrame:
    return coco.boxed(annotations(t)).select("image_id", "num", "category_id", "supp", "qty", "disc")


@query("p07_empty_boxes_sum", f"WITH {ANN} SELECT num, count(*) AS n FROM ann WHERE num + supp + qty + disc <> 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return coco.boxed(annotations(t), "sum").groupBy("num").agg(F.count("*").alias("n"))


@query("p08_empty_segmentations", f"WITH {ANN} SELECT image_id, num, count(*) AS n FROM ann WHERE tax > 0.04 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("segmentation", F.when(F.col("tax") > 0.04, F.array(F.array("qty", "price", "disc"))).when(F.col("tax") > 0.02, F.array().cast("array<array<double>>")))
    return coco.segmented(a).groupBy("image_id", "num").agg(F.count("*").alias("n"))


@query("p09_known_categories", f"WITH {CAT}, {ANN} SELECT flag, count(*) AS n FROM ann WHERE category_id IN (SELECT id FROM categories WHERE id % 3 = 0) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return coco.known(annotations(t), categories(t).where("id % 3 = 0"), "category_id").groupBy("flag").agg(F.count("*").alias("n"))


@query("p10_defaults", f"WITH {ANN} SELECT image_id, num, category_id, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS iscrowd, round(CASE WHEN flag = 'A' THEN price ELSE qty * disc END, 6) AS area FROM ann")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("iscrowd", F.when(F.col("flag") == "R", 1)).withColumn("area", F.when(F.col("flag") == "A", F.col("price")))
    return coco.with_defaults(a).select("image_id", "num", "category_id", "iscrowd", F.round("area", 6).alias("area"))


def keypoints() -> Column:
    return F.array(*[F.col(c).cast("double") for c in ("qty", "supp", "num", "supp", "qty", "half", "num", "qty", "num")])


@query(
    "p11_keypoint_boxes",
    f"""WITH {ANN}, k AS (SELECT image_id, num, category_id, supp, qty, num % 2 AS half FROM ann)
 SELECT image_id, num, category_id, least(qty, num, CASE WHEN half > 0 THEN supp ELSE qty END) AS x0, greatest(qty, num, CASE WHEN half > 0 THEN supp ELSE qty END) - least(qty, num, CASE WHEN half > 0 THEN supp ELSE qty END) AS w FROM k""",
)
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("half", F.col("num") % 2).withColumn("keypoints", keypoints())
    return coco.keypoint_box(a).select("image_id", "num", "category_id", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(2)).alias("w"))


@query("p12_split_keypoints", f"WITH {ANN} SELECT 'segmentation' AS part, category_id, count(*) AS n FROM ann WHERE tax > 0.04 GROUP BY ALL UNION ALL SELECT 'keypoints', category_id + 100000, count(*) FROM ann WHERE num % 2 = 1 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("segmentation", F.when(F.col("tax") > 0.04, F.array("qty"))).withColumn("keypoints", F.when(F.col("num") % 2 == 1, F.array("qty", "qty", "qty")))
    return coco.split_keypoints(a, 100000).groupBy("part", "category_id").agg(F.count("*").alias("n"))


@query("p13_scores", f"WITH {ANN} SELECT image_id, num, category_id, round(1 - disc, 6) AS score FROM ann WHERE round(1 - disc, 6) >= 0.95 AND category_id IN (1, 2, 3, 5, 8)")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("score", F.round(1 - F.col("disc"), 6))
    return coco.scored(a, 0.95, [1, 2, 3, 5, 8]).select("image_id", "num", "category_id", "score")


@query("p14_name_contains", f"WITH {CAT} SELECT id, name FROM categories WHERE contains(name, 'ring')")
def _(t: Tables) -> DataFrame:
    return categories(t).where(F.col("name").contains("ring")).select("id", "name")


@query(
    "p15_visible_keypoints",
    f"""WITH {ANN}, k AS (SELECT *, num % 2 AS half FROM ann), p AS (SELECT image_id, num, category_id, 1 AS k, qty AS x, supp AS y, num AS v FROM k UNION ALL SELECT image_id, num, category_id, 2, supp, qty, half FROM k UNION ALL SELECT image_id, num, category_id, 3, num, qty, num FROM k)
 SELECT image_id, num, category_id, k, x::DOUBLE AS x, y::DOUBLE AS y FROM p WHERE v > 0 AND k IN (1, 2)""",
)
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("half", F.col("num") % 2).withColumn("keypoints", keypoints())
    p = a.select("image_id", "num", "category_id", F.explode(coco.points(F.col("keypoints"))).alias("p"))
    return p.where("p.v > 0 and p.k in (1, 2)").select("image_id", "num", "category_id", "p.k", "p.x", "p.y")


@query("p16_complete_rows", f"WITH {ANN} SELECT flag, count(*) AS n, round(sum(price / nullif(disc, 0)), 2) AS total FROM ann WHERE disc <> 0 AND tax <> 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("r1", F.try_divide("price", "disc")).withColumn("r2", F.try_divide("price", "tax"))
    return a.na.drop(subset=["r1", "r2"]).groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("r1"), 2).alias("total"))


@query("p17_labelled_groups", f"WITH {IMG}, {GRP} SELECT \"group\", count(*) AS n FROM images JOIN grp USING (specimen) GROUP BY 1 HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    g = coco.with_groups(images(t), groups(t), "specimen", "Unknown").where("group is not null and group <> 'Unknown'")
    return g.groupBy("group").agg(F.count("*").alias("n")).where("n >= 2")


@query("p18_listed_species", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t: Tables) -> DataFrame:
    return coco.known(t.customer.withColumn("k", F.col("c_nationkey")), t.nation.where("n_regionkey = 2"), "k", "n_nationkey").select("c_custkey", "c_name")


@query("p19_millimetres", f"WITH {ANN} SELECT image_id, num, category_id, round(qty / ppm, 6) AS length_mm, round(sqrt(price) / (ppm * ppm), 6) AS area_mm2 FROM (SELECT *, coalesce(nullif(disc, 0) * 100, 5) AS ppm FROM ann)")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("ppm", F.coalesce(F.nullif("disc", F.lit(0.0)) * 100, F.lit(5.0)))
    return a.select("image_id", "num", "category_id", F.round(measure.to_mm(F.col("qty"), F.col("ppm")), 6).alias("length_mm"), F.round(measure.to_mm(F.sqrt("price"), F.col("ppm"), 2), 6).alias("area_mm2"))


@query("p20_pixels_per_mm", f"WITH {ANN} SELECT image_id, num, category_id, round(qty / CASE flag WHEN 'A' THEN num WHEN 'N' THEN num / 1000 END, 6) AS ppm FROM ann")
def _(t: Tables) -> DataFrame:
    unit = F.when(F.col("flag") == "A", "mm").when(F.col("flag") == "N", "um").otherwise("px")
    return annotations(t).select("image_id", "num", "category_id", F.round(measure.pixels_per_mm(F.col("num"), unit, F.col("qty")), 6).alias("ppm"))


@query("p21_coerced", "SELECT event_type, count(TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE)) AS n, sum(TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS DOUBLE)) AS total FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("double")
    return t.events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


@query("p22_violations", f"WITH {IMG}, {CAT}, {ANN}, n AS (SELECT * FROM ann) SELECT rule, count(*) AS n FROM (SELECT 'image' AS rule FROM n WHERE image_id NOT IN (SELECT id FROM images WHERE specimen % 5 <> 0) UNION ALL SELECT 'category' FROM n WHERE category_id NOT IN (SELECT id FROM categories WHERE supercategory <> 'Brand#1')) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("id", F.col("image_id"))
    return coco.violations(images(t).where("specimen % 5 <> 0"), a, categories(t).where("supercategory <> 'Brand#1'")).groupBy("rule").agg(F.count("*").alias("n"))


@query("p23_filled_sizes", f"WITH {IMG}, {ANN}, seen AS (SELECT image_id, max(qty) AS w FROM ann GROUP BY 1) SELECT id, coalesce(nullif(specimen % 50, 0), w) AS width FROM images LEFT JOIN seen ON id = image_id")
def _(t: Tables) -> DataFrame:
    seen = annotations(t).groupBy(F.col("image_id").alias("id")).agg(F.max("qty").alias("w"))
    return images(t).join(seen, "id", "left").select("id", F.coalesce(F.nullif(F.col("specimen") % 50, F.lit(0)).cast("double"), "w").alias("width"))


@query("p24_image_names", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages WHERE length(regexp_extract(url, '([^/]*)$', 1)) > 0")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).alias("name")).where("length(name) > 0")


@query("p25_fallback_chain", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'exif' WHEN p_size % 4 = 1 THEN 'scale' WHEN p_size % 4 = 2 THEN 'focal' END AS how, CASE WHEN p_size % 4 = 0 THEN p_retailprice WHEN p_size % 4 = 1 THEN p_size * 2.0 WHEN p_size % 4 = 2 THEN 35.0 END AS fx FROM part")
def _(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    made = lambda at, how, fx: F.when(k == at, F.struct(F.lit(how).alias("how"), fx.cast("double").alias("fx")))
    first = F.coalesce(made(0, "exif", F.col("p_retailprice")), made(1, "scale", F.col("p_size") * 2), made(2, "focal", F.lit(35.0)))
    return t.part.select("p_partkey", first.alias("f")).select("p_partkey", "f.how", "f.fx")


@query("j01_category_names", f"WITH {CAT}, {ANN} SELECT coalesce(name, 'Unknown') AS category_name, count(*) AS n FROM ann LEFT JOIN (FROM categories WHERE id % 7 <> 0) c ON c.id = category_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return coco.named(annotations(t), categories(t).where("id % 7 <> 0")).groupBy("category_name").agg(F.count("*").alias("n"))


@query("j02_image_annotations", f"WITH {IMG}, {ANN} SELECT id, specimen, num, category_id, qty FROM images JOIN ann ON id = image_id")
def _(t: Tables) -> DataFrame:
    return images(t).join(annotations(t), F.col("id") == F.col("image_id")).select("id", "specimen", "num", "category_id", "qty")


for _name, _missing in (("unassigned", "Unassigned"), ("unknown", "Unknown"), ("dropped", None)):
    _group = "\"group\"" if _missing is None else f"coalesce(\"group\", '{_missing}')"

    @query(f"j03_groups_{_name}", f"WITH {IMG}, {GRP} SELECT {_group} AS \"group\", count(*) AS n FROM images {'LEFT ' if _missing else ''}JOIN grp USING (specimen) GROUP BY 1")
    def _(t: Tables, missing: str | None = _missing) -> DataFrame:
        return coco.with_groups(images(t), groups(t), "specimen", missing).groupBy("group").agg(F.count("*").alias("n"))


@query("j04_zero_filled", f"WITH {ANN} SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT supp, count(*) AS n FROM ann WHERE category_id = 11 GROUP BY 1) ON supp = s_suppkey")
def _(t: Tables) -> DataFrame:
    n = annotations(t).where("category_id = 11").groupBy(F.col("supp").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return coco.zero_filled(n, t.supplier, "s_suppkey")


@query("j06_referenced_images", f"WITH {IMG}, {ANN} SELECT specimen, count(*) AS n FROM images WHERE id IN (SELECT image_id FROM ann) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return coco.referenced(images(t), annotations(t)).groupBy("specimen").agg(F.count("*").alias("n"))


@query("j07_orphan_images", f"WITH {IMG}, {ANN} SELECT id, file_name FROM images WHERE id NOT IN (SELECT image_id FROM ann)")
def _(t: Tables) -> DataFrame:
    return coco.dangling(images(t).withColumn("k", F.col("id")), annotations(t), "k", "image_id").select("id", "file_name")


@query(
    "j17_remapped_ids",
    f"WITH {NUM}, files AS (SELECT *, pos % 3 AS f FROM numbered), g AS (SELECT f, category_id, min(pos) AS seen FROM files GROUP BY ALL), m AS (SELECT f, category_id, row_number() OVER (PARTITION BY f ORDER BY seen) AS new_id FROM g) SELECT f AS source_file, new_id AS category_id, count(*) AS n FROM files JOIN m USING (f, category_id) GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    files = coco.numbered(annotations(t), ORDER, block(), "pos").withColumn("source_file", F.col("pos") % 3)
    seen = files.groupBy("source_file", "category_id").agg(F.min("pos").alias("at"))
    from pyspark.sql.window import Window

    m = seen.select("source_file", F.col("category_id").alias("old_id"), F.row_number().over(Window.partitionBy("source_file").orderBy("at")).alias("new_id"))
    return coco.remapped(files, m, "category_id").groupBy("source_file", "category_id").agg(F.count("*").alias("n"))


@query("j21_missing_parents", f"WITH {IMG}, {ANN} SELECT DISTINCT image_id AS id, image_id || '.jpg' AS file_name FROM ann WHERE image_id NOT IN (SELECT id FROM images WHERE specimen > 300)")
def _(t: Tables) -> DataFrame:
    some = images(t).where("specimen > 300").select("id", "file_name")
    return coco.with_missing_images(some, annotations(t)).join(some, ["id", "file_name"], "left_anti")


@query("w01_sequential_ids", f"WITH {NUM} SELECT image_id, num, category_id, supp, qty, price, pos AS new_id FROM numbered")
def _(t: Tables) -> DataFrame:
    return coco.numbered(annotations(t), ORDER, block()).select("image_id", "num", "category_id", "supp", "qty", "price", "new_id")


@query("w02_index_in_image", f"WITH {ANN} SELECT image_id, num, category_id, price, row_number() OVER (PARTITION BY image_id ORDER BY {', '.join(ORDER[1:])}) AS ann_idx FROM ann")
def _(t: Tables) -> DataFrame:
    return coco.per_image(annotations(t), ORDER[1:]).select("image_id", "num", "category_id", "price", "ann_idx")


@query("w03_first_mapping", f"WITH {NUM} SELECT supp, min_by(category_id, pos) AS first_id, max_by(category_id, pos) AS last_id FROM numbered GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = coco.numbered(annotations(t), ORDER, block(), "pos")
    return n.groupBy("supp").agg(F.min_by("category_id", "pos").alias("first_id"), F.max_by("category_id", "pos").alias("last_id"))


@query("w04_first_of_duplicates", f"WITH {ANN} SELECT image_id, num, category_id, supp, qty, price FROM ann QUALIFY row_number() OVER (PARTITION BY category_id, supp, num ORDER BY {', '.join(ORDER)}) = 1")
def _(t: Tables) -> DataFrame:
    return coco.first_of(annotations(t), ["category_id", "supp", "num"], ORDER).select("image_id", "num", "category_id", "supp", "qty", "price")


@query("w04_first_of_duplicates_image", f"WITH {ANN} SELECT image_id, num, category_id, supp, qty, price FROM ann QUALIFY row_number() OVER (PARTITION BY image_id, num ORDER BY {', '.join(ORDER)}) = 1")
def _(t: Tables) -> DataFrame:
    return coco.first_of(annotations(t), ["image_id", "num"], ORDER).select("image_id", "num", "category_id", "supp", "qty", "price")


@query(
    "w05_unique_ids",
    f"""WITH {ANN}, m AS (SELECT *, image_id * 8 + num AS id FROM ann), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(ORDER)}) AS k FROM m)
 SELECT id, category_id, price, id AS new_id FROM r WHERE k = 1 UNION ALL SELECT id, category_id, price, (SELECT max(id) FROM m) + row_number() OVER (ORDER BY id, {', '.join(ORDER)}) FROM r WHERE k > 1""",
)
def _(t: Tables) -> DataFrame:
    a = annotations(t).withColumn("id", F.col("image_id") * 8 + F.col("num"))
    return coco.unique_ids(a, ORDER, F.floor(F.col("id") / 4096)).select("id", "category_id", "price", "new_id")


@query("w06_after_max", f"WITH {ANN}, k AS (SELECT * FROM ann WHERE num = 7) SELECT image_id, category_id, price, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY {', '.join(ORDER)}) AS new_id FROM k")
def _(t: Tables) -> DataFrame:
    return coco.after_max(annotations(t).where("num = 7"), t.orders, ORDER, block(), "o_orderkey").select("image_id", "category_id", "price", "new_id")


@query("u01_union_all", f"WITH {ANN} SELECT source_file, count(*) AS n, count(score) AS scored FROM (SELECT 'a' AS source_file, NULL AS score FROM ann WHERE flag = 'A' UNION ALL SELECT 'b', disc FROM ann WHERE flag = 'R') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = annotations(t)
    one, two = a.where("flag = 'A'").withColumn("source_file", F.lit("a")), a.where("flag = 'R'").withColumn("source_file", F.lit("b")).withColumn("score", F.col("disc"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("source_file").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query(
    "u02_merged_categories",
    "WITH c AS (SELECT p_partkey % 3 AS f, p_partkey AS pos, trim('  ' || p_name || ' ') AS name FROM part), s AS (SELECT name, min({'f': f, 'pos': pos}) AS seen FROM c WHERE name <> 'red widget' GROUP BY 1) SELECT name, row_number() OVER (ORDER BY seen) AS id FROM s",
)
def _(t: Tables) -> DataFrame:
    c = t.part.select((F.col("p_partkey") % 3).alias("source_file"), F.col("p_partkey").alias("pos"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"))
    return coco.merged_categories(c, ["red widget"])


A1 = f"WITH {IMG}, {GRP}, {ANN}, n AS (SELECT specimen, coalesce(\"group\", 'Unassigned') AS \"group\", count(*) AS n FROM ann JOIN images ON id = image_id LEFT JOIN grp USING (specimen) WHERE category_id % 5 = 1 GROUP BY ALL)"


def _instances(t: Tables) -> DataFrame:
    a = annotations(t).where("category_id % 5 = 1").join(images(t).select(F.col("id").alias("image_id"), "specimen"), "image_id")
    return coco.with_groups(a, groups(t), "specimen").groupBy("specimen", "group").agg(F.count("*").alias("n"))


@query("a01_instances", A1 + " FROM n")
def _(t: Tables) -> DataFrame:
    return _instances(t)


@query("a02_instance_statistics", A1 + ' SELECT "group", round(avg(n), 6) AS n_mean, round(stddev_pop(n), 6) AS n_std, min(n) AS n_min, max(n) AS n_max, count(*) AS n_n FROM n GROUP BY 1')
def _(t: Tables) -> DataFrame:
    return measure.population(_instances(t), ["group"], ["n"])


@query("a05_averaged_records", f"WITH {ANN} SELECT supp, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price, min_by(flag, {{'a': image_id, 'b': num, 'c': category_id, 'd': price}}) AS flag FROM ann GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return measure.averaged(annotations(t), ["supp"], ["qty", "price"], ["flag"], ["image_id", "num", "category_id", "price"])


@query("a06_category_counts", f"WITH {CAT}, {ANN} SELECT id, count(image_id) AS n FROM categories LEFT JOIN ann ON id = category_id AND qty > 49 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = annotations(t).where("qty > 49").groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return coco.zero_filled(n, categories(t), "id")


@query("a07_by_locality", "SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown Locality') AS locality, count(*) AS n, max(len(list_value(o_orderkey))) AS one, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("Unknown Locality")).alias("locality")).agg(F.collect_list("o_orderkey").alias("records"))
    return g.select("locality", F.size("records").cast("long").alias("n"), F.lit(1).cast("long").alias("one"), F.aggregate("records", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("a13_largest", f"WITH {ANN} SELECT image_id, max_by(category_id, {{'a': price, 'b': category_id}}) AS category_id, max(price) AS price FROM ann GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return annotations(t).groupBy("image_id").agg(F.max_by("category_id", F.struct("price", "category_id")).alias("category_id"), F.max("price").alias("price"))


@query("a19_generated_names", f"WITH {ANN} SELECT 'kp' || k AS name FROM (SELECT unnest(range(1, max(num) + 1)) AS k FROM ann)")
def _(t: Tables) -> DataFrame:
    return annotations(t).agg(F.max("num").alias("n")).select(F.explode(F.sequence(F.lit(1), "n")).alias("k")).select(F.concat(F.lit("kp"), "k").alias("name"))


@query("a21_distinct_sets", f"WITH {CAT} SELECT supercategory, list_sort(list(DISTINCT name)) AS names FROM categories GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return categories(t).groupBy("supercategory").agg(F.sort_array(F.collect_set("name")).alias("names"))


@query("a23_by_image", f"WITH {IMG}, {ANN} SELECT file_name, count(*) AS n, max_by(price, {{'a': num, 'b': category_id, 'c': price}}) AS last_price FROM ann JOIN images ON id = image_id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = coco.by_image(annotations(t), images(t), ["num", "category_id", "price"])
    return g.select("file_name", F.size("annotations").cast("long").alias("n"), F.element_at("annotations", -1)["price"].alias("last_price"))


@query("t01_top_pairs", f"WITH {ANN} SELECT category_id, supp, count(*) AS w FROM ann GROUP BY ALL ORDER BY w DESC, category_id, supp LIMIT 50")
def _(t: Tables) -> DataFrame:
    return annotations(t).groupBy("category_id", "supp").agg(F.count("*").alias("w")).orderBy(F.desc("w"), "category_id", "supp").limit(50)


@query("t04_first_images", f"WITH {IMG} SELECT id, file_name FROM images ORDER BY file_name LIMIT 25")
def _(t: Tables) -> DataFrame:
    return images(t).select("id", "file_name").orderBy("file_name").limit(25)


@query("t05_sorted_names", f"WITH {IMG} SELECT file_name, row_number() OVER (PARTITION BY specimen ORDER BY file_name) AS k FROM images")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    return images(t).select("file_name", F.row_number().over(Window.partitionBy("specimen").orderBy("file_name")).alias("k"))

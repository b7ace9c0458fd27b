"""Plans that bring sources together, parse them and render them and the streaming extensions' batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators import assemble, coco, models
from lepidus.plans import Tables, query
from lepidus.sources import readers, writers
from lepidus.streaming import ingest


@query("s03_label_table", "WITH l AS (SELECT p_size AS id, trim(' ' || p_brand || ' ') AS name FROM part WHERE p_size <> 0) SELECT id, name FROM l UNION ALL SELECT m + k, name FROM (SELECT max(id) AS m FROM l), (VALUES (1, 'Trash'), (2, 'Custom')) d(k, name)")
def _(t: Tables) -> DataFrame:
    l_ = t.part.select(F.col("p_size").alias("id"), F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("name"), F.col("p_type").alias("supercategory"))
    return readers.with_default_labels(l_).select("id", "name")


@query("s04_json_lines", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def _(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("value"))
    return readers.json_lines(raw, "k bigint")[0]


@query("s04_malformed_lines", "SELECT event_id, substr(props, 1, 5) AS value FROM events WHERE event_id % 10 = 0")
def _(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("value"))
    return readers.json_lines(raw, "k bigint")[1]


@query("s05_last_group_wins", "SELECT o_custkey AS specimen, max_by(o_orderpriority, o_orderkey) AS \"group\" FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return readers.last_wins(t.orders.select(F.col("o_custkey").alias("specimen"), F.col("o_orderpriority").alias("group"), "o_orderkey"), "specimen", "o_orderkey").drop("o_orderkey")


@query("s07_lines", "SELECT DISTINCT lower(trim(line)) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0")
def _(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.lower(F.trim("line")).alias("line")).where("line <> ''").distinct()


@query("s15_data_urls", "SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS url FROM pages")
def _(t: Tables) -> DataFrame:
    files = t.pages.select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return readers.data_urls(files, "text/html").withColumnRenamed("path", "page_id")


@query("s16_intrinsics", "SELECT p_partkey, round(p_retailprice * 4000 / w, 6) AS fx, round(p_retailprice * 3000 / h, 6) AS fy FROM part LEFT JOIN (VALUES ('ECONOMY', 36.0::DOUBLE, 24.0::DOUBLE), ('PROMO', 17.4, 13.0)) c(camera, w, h) ON camera = p_type")
def _(t: Tables) -> DataFrame:
    cameras = t.spark.createDataFrame([("ECONOMY", 36.0, 24.0), ("PROMO", 17.4, 13.0)], "camera string, sensor_w double, sensor_h double")
    shots = t.part.select("p_partkey", F.col("p_type").alias("camera"), F.col("p_retailprice").alias("focal_mm"), F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    return readers.intrinsics(shots, cameras).select("p_partkey", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"))


@query("s19_grouped_files", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS files FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("files"))


@query("s22_existing_files", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    listing = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return readers.existing(t.lineitem, listing, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("s24_after_marker", "SELECT trim(split_part(html, '<article>', 2)) AS tail FROM pages WHERE contains(html, '<article>')")
def _(t: Tables) -> DataFrame:
    return readers.after_marker(t.pages.select(F.col("html").alias("value")), "<article>")


@query("k04_formatted_statistics", "SELECT l_suppkey, coalesce(printf('%.2f', avg(nullif(l_discount, 0))), 'NaN') AS mean FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # what the order of the sum leaves of a mean is rounded off, so that one half way between two texts has one of them
    g = t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(F.nullif("l_discount", F.lit(0.0))), 12).alias("mean"))
    return writers.group_statistics(g, ["mean"])


@query("k12_manifest_paths", "SELECT p_partkey, printf('T_%.2f/rep_%d/%s.json', p_size / 10.0::DOUBLE, p_partkey % 3, p_name) AS output_json FROM part")
def _(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") / 10).alias("temperature"), (F.col("p_partkey") % 3).alias("replicate"), F.col("p_name").alias("image"))
    return writers.manifest(rows).select("p_partkey", "output_json")


@query(
    "k13_chat_lines",
    """SELECT replace(to_json({'messages': [{'role': 'system', 'content': 'You describe insects.'}, {'role': 'user', 'content': q}, {'role': 'assistant', 'content': a}]})::VARCHAR, ',"content":null', '') AS value
 FROM (SELECT max_by(text, turn) FILTER (role = 'user') AS q, max_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)""",
)
def _(t: Tables) -> DataFrame:
    two = t.conversations.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    return writers.chat_lines(two, "q", "a", "You describe insects.")


@query("k16_rejects", "SELECT CASE WHEN l_discount = 0 THEN 'empty' ELSE 'heavy' END AS reason, count(*) AS n FROM lineitem WHERE l_discount = 0 OR l_quantity > 48 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    _, bad = writers.rejects(t.lineitem, {"empty": F.col("l_discount") == 0, "heavy": F.col("l_quantity") > 48})
    return bad.groupBy(F.col("_reject_reason").alias("reason")).agg(F.count("*").alias("n"))


NAMES = "n AS (SELECT s_suppkey, lower(replace(s_name, '#', '')) AS a FROM supplier), c AS (SELECT lower(replace(s_name, '#', '')) || '_wing' AS b FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT lower(replace(s_name, '#', '')) || '_leg' FROM supplier WHERE s_suppkey % 6 = 0)"


@query("j09_unique_containment", f"WITH {NAMES}, j AS (SELECT a, count(*) AS k, min(b) AS b FROM n JOIN c ON contains(b, a) OR contains(a, b) GROUP BY 1) SELECT s_suppkey, b FROM n LEFT JOIN (FROM j WHERE k = 1) USING (a)")
def _(t: Tables) -> DataFrame:
    n = t.supplier.select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit(""))).alias("a"))
    c = n.where("s_suppkey % 3 = 0").select(F.concat("a", F.lit("_wing")).alias("b")).unionByName(n.where("s_suppkey % 6 = 0").select(F.concat("a", F.lit("_leg")).alias("b")))
    return assemble.unique_containment(n, c, "a", "b").select("s_suppkey", "b")


@query("j10_unique_pairs", "WITH l AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1 HAVING count(*) = 1), r AS (SELECT o_custkey AS k, min(o_orderkey) AS p FROM orders WHERE o_orderkey % 9 = 1 GROUP BY 1 HAVING count(*) = 1) SELECT k, o, p FROM l JOIN r USING (k)")
def _(t: Tables) -> DataFrame:
    side = lambda m, name: t.orders.where(f"o_orderkey % 9 = {m}").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias(name))
    return assemble.unique_pairs(side(0, "o"), side(1, "p"), "k")


@query(
    "j11_zipped",
    """WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) AS pos, p_name AS name FROM part), d AS (SELECT 'm' || k AS model, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS pos, p_brand || k AS line FROM part, range(3) r(k) WHERE k < 2 OR p_partkey % 10 <> 0)
 SELECT model, pos, name, line FROM d JOIN n USING (pos) WHERE model <> 'm2'""",
)
def _(t: Tables) -> DataFrame:
    block = F.floor(F.col("p_partkey") / 512)
    names = coco.numbered(t.part.select("p_partkey", F.col("p_name").alias("name")), ["p_partkey"], block, "pos").select("pos", "name")
    each = lambda k, p: coco.numbered(p.select("p_partkey", F.concat("p_brand", F.lit(str(k))).alias("line")), ["p_partkey"], block, "pos").select(F.lit(f"m{k}").alias("model"), "pos", "line")
    # the third model has fewer lines than there are names
    return assemble.zipped(names, each(0, t.part).unionByName(each(1, t.part)).unionByName(each(2, t.part.where("p_partkey % 10 <> 0"))))


@query("j12_first_by_prefix", "SELECT 'img_' || c_custkey AS name, min('img_' || o_orderkey || '.jpg') AS file FROM orders JOIN customer ON ('img_' || o_orderkey || '.jpg').starts_with('img_' || c_custkey) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    names = t.customer.select(F.concat(F.lit("img_"), "c_custkey").alias("name"))
    files = t.orders.select(F.concat(F.lit("img_"), "o_orderkey", F.lit(".jpg")).alias("file"))
    return assemble.first_by_prefix(names, files, "name", "file")


@query("j16_grid", "SELECT s_suppkey AS image, item_id AS question_index, temperature, replicate, replicate + 6 AS seed FROM supplier, benchmark, (VALUES (0.0::DOUBLE), (0.7)) t(temperature), (VALUES (1), (2)) r(replicate)")
def _(t: Tables) -> DataFrame:
    images = t.supplier.select(F.col("s_suppkey").alias("image"))
    return assemble.grid(images, t.benchmark.select(F.col("item_id").alias("question_index")), [0.0, 0.7], 2, 7)


def _records(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey"), F.col("c_name").alias("species_name"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy("species_name", F.col("o_orderpriority").alias("category")).agg(F.struct((F.avg("o_totalprice") / 1000).alias("length_mm"), (F.max("o_totalprice") / 1000).alias("area_mm2")).alias("measurement"))
    col = o.where("o_orderstatus = 'F'").select("species_name", F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("pos"), F.struct(F.concat(F.lit("c"), F.col("o_orderkey") % 7).alias("name")).alias("colour"))
    qa = t.customer.where("c_custkey % 2 = 0").select(F.col("c_name").alias("species_name"), F.create_map(F.lit("Q1: shape"), "c_mktsegment").alias("qa"))
    mat = o.select("species_name", F.nullif("o_orderstatus", F.lit("P")).alias("locality"), F.create_map(F.lit("k"), F.col("o_orderkey").cast("string")).alias("record"))
    return assemble.species_records(m, col, qa, mat)


REC = """c AS (SELECT c_custkey, c_name AS species_name, c_mktsegment FROM customer), o AS (SELECT * FROM orders JOIN c ON o_custkey = c_custkey), m AS (SELECT species_name, o_orderpriority AS category, avg(o_totalprice) / 1000 AS length_mm FROM o GROUP BY ALL),
 col AS (SELECT species_name, o_orderpriority AS category, max_by('c' || o_orderkey % 7, o_orderkey) AS colour FROM o WHERE o_orderstatus = 'F' GROUP BY ALL), loc AS (SELECT species_name, coalesce(nullif(o_orderstatus, 'P'), 'Unknown Locality') AS locality, count(*) AS n FROM o GROUP BY ALL)"""


@query(
    "j08_species_records",
    f"""WITH {REC} SELECT m.species_name, count(*) AS n_categories, count(colour) AS n_colours, any_value(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS q1, (SELECT count(*) FROM loc WHERE loc.species_name = m.species_name) AS n_localities, round(sum(length_mm), 3) AS total
 FROM m LEFT JOIN col USING (species_name, category) JOIN c ON c.species_name = m.species_name GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    r = _records(t)
    lengths = F.aggregate("categories", F.lit(0.0), lambda a, x: a + x["measurement"]["length_mm"])
    named = F.size(F.filter("categories", lambda x: x["colour"].isNotNull()))
    return r.select("species_name", F.size("categories").cast("long").alias("n_categories"), named.cast("long").alias("n_colours"), F.col("qa")["Q1: shape"].alias("q1"), F.size("materials").cast("long").alias("n_localities"), F.round(lengths, 3).alias("total"))


@query("x14_prompts")
def _(t: Tables) -> DataFrame:
    return assemble.prompt(_records(t))


@query("x17_instructions", "SELECT item_id, 'Write a dichotomous key to these species:' || chr(10) || text AS text FROM benchmark")
def _(t: Tables) -> DataFrame:
    return assemble.instructions(t.benchmark, "text", "key")


@query("x20_chat_messages", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


@query("x21_system_messages", "SELECT conv_id, count(*) + 1 AS n, true AS modified FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 0 UNION ALL SELECT conv_id, count(*), false FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') > 0")
def _(t: Tables) -> DataFrame:
    m = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("messages"))
    return assemble.with_system(m, "messages", "You describe insects.").select("conv_id", F.size("messages").cast("long").alias("n"), "modified")


@query("x22_answer_maps", "SELECT conv_id, count(*) AS n, max_by(text, turn) AS last FROM (SELECT * FROM conversations WHERE role = 'user') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    q = t.conversations.where("role = 'user'").withColumn("question", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    m = assemble.answer_map(q, ["conv_id"], "turn", "question", "text")
    values = F.map_values("qa")
    return m.select("conv_id", F.size("qa").cast("long").alias("n"), F.element_at(values, -1).alias("last"))


@query("x23_output_paths", "SELECT p_partkey, printf('T_%.2f/rep_%d', p_size / 10.0::DOUBLE, p_partkey % 3) AS path FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.format_string("T_%.2f/rep_%d", F.col("p_size") / 10, F.col("p_partkey") % 3).alias("path"))


@query("m05_best_reading", "SELECT l_orderkey AS image_id, max_by(l_partkey, {'a': l_discount, 'b': l_partkey}) AS text, max(l_discount) AS confidence FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return models.best_reading(t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("text"), F.col("l_discount").alias("confidence")))


@query("m07_pending_runs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return models.pending(t.orders, done, ["o_orderkey"]).select("o_orderkey")


@query("k15_flat_names", "SELECT page_id, string_split(url, '/')[-2] || '_' || string_split(url, '/')[-1] AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", writers.flat_name(F.col("url")).alias("name"))


@query("ext_hourly_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ingest.windowed(t.events, "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("ext_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t: Tables) -> DataFrame:
    return ingest.sessions(t.events, "ts", "user_id").select("user_id", "start", "n")


@query("k01_coco_document", "SELECT count(*) AS images, (SELECT count(*) FROM lineitem) AS annotations, (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS categories FROM orders")
def _(t: Tables) -> DataFrame:
    from lepidus.plans.views import annotations, categories, images

    a = annotations(t).select(F.xxhash64("image_id", "num", "category_id", "price").alias("id"), "image_id", "category_id")
    doc = writers.coco_documents(images(t), a, categories(t), 2000)
    each = lambda name: F.from_json("value", f"{name} array<struct<id: bigint>>")[name]
    size = lambda name: F.sum(F.size(each(name))).cast("long").alias(name)
    return doc.agg(size("images"), size("annotations")).crossJoin(doc.select(F.explode(each("categories")).alias("c")).agg(F.countDistinct("c.id").alias("categories")))  # one row each

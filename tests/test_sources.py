import json
import math
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lepidus import plans
from lepidus.functions import strings
from lepidus.operators import assemble, coco, models
from lepidus.sources import headers, readers, writers
from lepidus.streaming import ingest


def png(w, h):
    body = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": "a", "file_name": "a.jpg", "width": 4, "height": 3}], "annotations": [{"id": 1, "image_id": "a", "category_id": 2, "bbox": [0, 0, 2, 0]}, {"id": 2, "image_id": "z", "category_id": 9, "bbox": [0, 0, 2, 2]}], "categories": [{"id": 2, "name": "wing", "supercategory": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    images, annotations, categories = readers.coco(spark, str(tmp_path / "a.json"))
    assert images.count() == 1 and annotations.count() == 2
    assert {(r.id, r.rule) for r in coco.violations(images, annotations, categories).collect()} == {(2, "image"), (2, "category")}
    assert [r.id for r in coco.boxed(annotations).collect()] == [2]
    writers.write_coco(images, annotations, categories, str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out/compact")).first().value)
    assert [a["id"] for a in back["annotations"]] == [1, 2]
    (tmp_path / "bad.json").write_text('{"images": []}')
    with pytest.raises(Exception, match="not a COCO file"):
        readers.coco(spark, str(tmp_path / "bad.json"))[0].collect()


def test_labels(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("id,name,supercategory\n0,elytra,s\n1, pronotum ,s\n2,smooth,t\n3,rough,t\n")
    assert {(r.id, r.name) for r in readers.label_table(spark, str(p)).collect()} == {(1, "pronotum"), (2, "smooth"), (3, "rough"), (4, "Trash"), (5, "Custom")}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = readers.read_json_lines(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]


@pytest.mark.parametrize("name,body", [("g.csv", "specimen_name,group\nx,1\ny,2\nx,3\n"), ("g.tsv", "a\tb\nx\t1\ny\t2\nx\t3\n"), ("g.json", '{"x": "3", "y": "2"}'), ("h.json", '[{"specimen": "x", "group_name": "3"}, {"filename": "y", "group_label": "2"}]'), ("g.bin", "")])
def test_grouping(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    got = {r.specimen: r.group for r in readers.grouping(spark, str(tmp_path / name)).collect()}
    assert got == ({} if name == "g.bin" else {"x": "3", "y": "2"})


def test_folders(spark, tmp_path):
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa/Sp_one_qa.json").write_text('{"Q1: a": "b"}')
    assert [(r.species_name, r.qa) for r in readers.answers(spark, str(tmp_path / "qa")).collect()] == [("Sp_one", {"Q1: a": "b"})]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/m1.txt").write_text("first\n\nsecond\n")
    assert [(r.model, r.pos, r.line) for r in readers.descriptions(spark, str(tmp_path / "d")).orderBy("pos").collect()] == [("m1", 0, "first"), ("m1", 1, "second")]
    (tmp_path / "im/sub").mkdir(parents=True)
    (tmp_path / "im/a.png").write_bytes(png(7, 5))
    (tmp_path / "im/sub/b.png").write_bytes(png(2, 3))
    (tmp_path / "im/c.png").write_bytes(b"broken")
    assert [(r.id, r.file_name, r.width, r.height) for r in readers.images(spark, str(tmp_path / "im")).orderBy("id").collect()] == [(1, "a.png", 7, 5), (2, "b.png", 2, 3)]
    np.save(tmp_path / "depth.npy", np.array([[1.0, 2.0]]))
    assert [(r.y, r.x, r.depth) for r in readers.depth_maps(spark, str(tmp_path)).orderBy("x").collect()] == [(0, 0, 1.0), (0, 1, 2.0)]


def test_headers():
    assert headers.size(png(7, 5)) == (7, 5, "png") and headers.size(b"") is None
    assert headers.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x03\x00\x09\x01\x01\x11\x00") == (9, 3, "jpeg")
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12)
    assert headers.size(tiff) == (11, 12, "tiff")


def test_generated_texts(spark):
    v = "Species Description for *Sp_a*:\nDescription: wings long\n---\nno name here\n---\nSpecies Description for Sp_b:\n"
    good, bad = readers.generated_texts(spark.createDataFrame([(v,)], "value string"))
    assert [(r.base_name, r.description) for r in good.collect()] == [("sp_a", "wings long")] and bad.count() == 2


def test_writers(spark, tmp_path):
    pts = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)], "shape_id long, i int, x double, y double")
    assert writers.tps(pts).first().value == "LM=2\n1.000000 2.000000\n3.000000 4.000000\nID=1"
    assert writers.landmark_rows(pts, 2).columns == ["shape_id", "X1", "Y1", "X2", "Y2"]
    rows = spark.createDataFrame([("q", "a")], "q string, a string")
    assert json.loads(writers.chat_lines(rows, "q", "a", "s").first().value) == {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    writers.write_metrics(spark.createDataFrame([(1, [1.0])], "a int, b array<double>"), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m/csv"), header=True).first().b == "[1.0]"
    assert writers.latex(spark.createDataFrame([("*A b* 5%",)], "value string")).first().value == "\\textit{A b} 5\\%"


def test_decimals_are_rounded_by_the_binary_value_halves_to_even(spark):
    v = [0.125, 0.375, -0.125, 0.045, 0.055, 1.005, 2.675, 0.995, 99.995, -0.001, -0.0, 0.0078125, -0.0234375, 0.9999995, 12345678.0078125, 4503599627370496.5, 5e-324, math.inf, -math.inf]
    v += [math.nextafter(x, side) for x in v if abs(x) < 2**63 for side in (-9e9, 9e9)] + [k / 128 for k in range(1, 300, 2)]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", *[strings.fixed(F.col("v"), k).alias(f"f{k}") for k in (2, 4, 6)])
    assert [(r.f2, r.f4, r.f6) for r in rows.collect()] == [("%.2f" % x, "%.4f" % x, "%.6f" % x) for x in v]
    assert spark.createDataFrame([(None,), (math.nan,)], "v double").select(strings.fixed(F.col("v"), 2).alias("t")).toPandas().t.tolist() == [None, "nan"]


def test_means_are_formatted_as_sql_does(spark, tmp_path):
    # supplier 1's mean is 0.055 but for the order of the sum, supplier 2 has nothing to average, 3's mean is just under a half, 4's is a half
    d = [(1, (k % 10 + 1) / 100) for k in range(600)] + [(2, 0.0)] + [(3, 0.045)] + [(4, 0.125), (5, 0.05), (5, 0.0)]
    pq.write_table(pa.table({"l_suppkey": [a for a, _ in d], "l_discount": [b for _, b in d]}), tmp_path / "lineitem.parquet")
    plans.load()
    got = {r.l_suppkey: r["mean"] for r in plans.QUERIES["k04_formatted_statistics"](spark, str(tmp_path)).collect()}
    assert got == {1: "0.06", 2: "NaN", 3: "0.04", 4: "0.12", 5: "0.05"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet' WHERE l_suppkey > 1")
    assert {k: v for k, v in got.items() if k > 1} == dict(con.execute(plans.SQL["k04_formatted_statistics"]).fetchall())


def test_models(spark):
    with pytest.raises(ValueError, match="no model"):
        models.apply(spark.range(1), "embed", None)

    def make():
        import pandas as pd

        return lambda f: pd.DataFrame({"id": f.id.astype(str), "pos": 0, "embedding": [[1.0]] * len(f)})

    assert models.apply(spark.range(2), "embed", make).count() == 2
    tries = []
    call = models.patient(lambda q: (tries.append(q), 1 / 0)[1], 3, sleep=lambda s: None)
    assert call("q").startswith("ERROR") and len(tries) == 3


def test_system_message(spark):
    c = spark.createDataFrame([(1, [("user", "x")]), (2, [("system", "s"), ("user", "x")])], "id int, messages array<struct<role: string, content: string>>")
    assert {r.id: (len(r.messages), r.modified) for r in assemble.with_system(c, "messages", "new").collect()} == {1: (2, True), 2: (2, False)}


def test_streaming(spark, data, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parque[t]")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.windowed(events, "ts", "event_type", "value").writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM hourly").first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
    run = ingest.upsert(events.select("user_id", "ts", "value"), str(tmp_path / "t"), ["user_id"], "ts", str(tmp_path / "c"))
    run()
    assert spark.read.parquet(str(tmp_path / "t/v0")).count() == spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()
    assert ingest.current(spark, str(tmp_path / "t")) == 0
    assert ingest.upserted(spark, str(tmp_path / "t")).count() == spark.read.parquet(str(tmp_path / "t/v0")).count()


def test_upserts_follow_the_pointer(spark, tmp_path):
    at = str(tmp_path / "t")
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(3, 1, "d")], [(2, 0, "old")]]):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.upsert(spark.readStream.schema("k int, t int, v string").parquet(str(tmp_path / "in")), at, ["k"], "t", str(tmp_path / "c"))()
        assert ingest.current(spark, at) == n
    assert sorted((r.k, r.v) for r in ingest.upserted(spark, at).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] == "v") == ["v2", "v3"]
    (tmp_path / "t/v3").rename(tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        ingest.current(spark, at)


def test_structure(spark):
    df = spark.createDataFrame([('{"images": [], "annotations": [{}], "categories": [1]}',), ('{"images": {}, "annotations": []}',), ("no",), (None,)], "value string")
    assert [(r.ok, r.missing) for r in readers.structured(df).collect()] == [(True, []), (False, ["images", "categories"]), (False, ["images", "annotations", "categories"]), (False, ["images", "annotations", "categories"])]


def test_masks_as_png(spark, tmp_path):
    from lepidus.sources import png as made

    runs = spark.createDataFrame([("a b.png", 0, 1, 2), ("a b.png", 2, 0, 3)], "name string, y int, x0 int, x1 int")
    writers.write_each(writers.mask_files(runs), str(tmp_path / "m"), "name", "content")
    want = np.array([[0, 255, 255, 0], [0, 0, 0, 0], [255, 255, 255, 255]])
    assert (made.decode((tmp_path / "m/a b.png").read_bytes()) == want).all()
    assert [(r.file_name, r.width, r.height) for r in readers.images(spark, str(tmp_path / "m")).collect()] == [("a b.png", 4, 3)]
    name = writers.with_suffix(F.col("n"), "_mask")
    assert [r[0] for r in spark.createDataFrame([("x.y/a.jpg",), ("b",)], "n string").select(name).collect()] == ["x.y/a_mask.jpg", "b_mask"]


def test_sheets(spark, tmp_path):
    (tmp_path / "g.csv").write_text("filename,group_label,x\na.jpg,G,1\n")
    assert readers.group_labels(spark, str(tmp_path / "g.csv")).collect() == [("a.jpg", "G")]
    (tmp_path / "e.tsv").write_text("base_name\tanswer\timage_path\n Sp A \tlong\ti.jpg\n")
    assert readers.expert_sheet(spark, str(tmp_path / "e.tsv")).collect() == [("sp a", "long", "i.jpg")]
    (tmp_path / "bad.tsv").write_text("base_name\tanswer\n")
    with pytest.raises(ValueError, match="image_path"):
        readers.expert_sheet(spark, str(tmp_path / "bad.tsv"))
    blocks = readers.species_blocks(spark.createDataFrame([("a\n" + "#" * 80 + "\n\n" + "#" * 80 + "\nb",)], "value string"))
    assert [(r.pos, r.block) for r in blocks.collect()] == [(0, "a"), (2, "b")]
    assert spark.range(1).select(assemble.substituted(F.lit("x [T] y"), "[T]", F.lit("z"))).first()[0] == "x z y"
    assert [r.word for r in writers.word_frequencies(spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")).collect()] == ["b", "a"]


def test_back_transformed_keeps_the_sign_of_zero(spark, tmp_path):
    plans.load()
    rows = [(k, [math.sin(k + j * j) / 4 for j in range(64)]) for k in range(3)]
    rows[1][1][5], rows[2][1][10], rows[2][1][11] = -3e-5, 3e-5, -0.25
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: list(map(repr, r.keypoints)) for r in plans.QUERIES["k06_back_transformed"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {k: list(map(repr, v)) for k, v in con.execute(plans.SQL["k06_back_transformed"]).fetchall()}
    assert got == want and want[1][7] == "-0.0" and want[2][15] == "0.0"


def test_landmark_records_have_the_decimals_of_sql(spark, tmp_path):
    # halves of the sixth decimal: 0.0078125 and its odd multiples
    e = np.array([[(2 * k + 1) / 128 * (-1) ** k for k in range(64)]], np.float32)
    pq.write_table(pa.table({"vec_id": [7], "embedding": list(e)}), tmp_path / "embeddings.parquet")
    plans.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    assert [tuple(r) for r in plans.QUERIES["k05_tps_records"](spark, str(tmp_path)).collect()] == con.execute(plans.SQL["k05_tps_records"]).fetchall()


def test_coco_files_are_compressed_one_document_each_and_read_back(spark, tmp_path):
    images = spark.createDataFrame([(str(k), f"{k}.jpg") for k in range(40)], "id string, file_name string")
    annotations = spark.createDataFrame([(k, str(k % 40), k % 3, [1.0, 2.0, float(k), 4.0]) for k in range(200)], "id long, image_id string, category_id long, bbox array<double>")
    categories = spark.createDataFrame([(k, f"c{k}", "s") for k in range(3)], "id long, name string, supercategory string")
    at = str(tmp_path / "coco")
    writers.write_coco(images, annotations, categories, at, 10)
    i, a, _ = readers.coco(spark, f"{at}/compact")
    assert sorted(r.id for r in i.collect()) == sorted(map(str, range(40))) and sorted((r.id, r.bbox[2]) for r in a.collect()) == [(k, float(k)) for k in range(200)]
    files = list((tmp_path / "coco/compact").glob("part-*"))
    assert len(files) == i.select("source_file").distinct().count() == 4 and all(f.suffix == ".gz" for f in [*files, *(tmp_path / "coco/annotations").glob("part-*")])
    assert spark.read.schema(readers.ANNOTATION).json(f"{at}/annotations").count() == 200

"""Plans over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators import vectors
from lepidus.plans import Tables, query

COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("g20_cosine_pairs", f"SELECT a.vec_id, round({COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query(
    "j14_neighbours",
    """WITH d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings a, embeddings b)
 SELECT id, neighbour, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour <> id, neighbour) AS rank FROM d QUALIFY rank <= 6""",
)
def _(t: Tables) -> DataFrame:
    return vectors.neighbours(t.embeddings, "vec_id", "embedding", 6).select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query(
    "a14_pooled",
    """WITH m AS (SELECT vec_id // 5 AS doc, k, avg(embedding[k + 1]::DOUBLE) AS x FROM embeddings, range(64) r(k) GROUP BY ALL), n AS (SELECT doc, k, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS x FROM m)
 SELECT doc, round(sum(x * (k + 1)), 5) AS mark, round(sum(x * x), 6) AS norm FROM n GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    p = vectors.pooled(t.embeddings.withColumn("doc", F.floor(F.col("vec_id") / 5)), "doc", "vec_id", "embedding")
    each = p.select("doc", F.posexplode("embedding").alias("k", "x"))
    return each.groupBy("doc").agg(F.round(F.sum(F.col("x") * (F.col("k") + 1)), 5).alias("mark"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("norm"))


@query(
    "a15_model_matrix",
    f"""WITH v AS (SELECT vec_id // 5 AS key, 'm' || vec_id % 5 AS model, embedding FROM embeddings WHERE vec_id % 23 <> 0), k AS (SELECT key FROM v GROUP BY 1 HAVING count(DISTINCT model) = 5), u AS (FROM v SEMI JOIN k USING (key))
 SELECT a.model AS a, b.model AS b, round(avg({COS}), 6) AS similarity FROM u a JOIN u b ON a.key = b.key GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    v = t.embeddings.where("vec_id % 23 <> 0").select(F.floor(F.col("vec_id") / 5).alias("key"), F.concat(F.lit("m"), F.col("vec_id") % 5).alias("model"), "embedding")
    return vectors.model_matrix(v, "key", "model", "embedding").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("j20_shared_keys", "WITH v AS (SELECT vec_id // 5 AS key, vec_id % 5 AS model FROM embeddings WHERE vec_id % 23 <> 0) SELECT key FROM v GROUP BY 1 HAVING count(DISTINCT model) = 5")
def _(t: Tables) -> DataFrame:
    v = t.embeddings.where("vec_id % 23 <> 0").select(F.floor(F.col("vec_id") / 5).alias("key"), (F.col("vec_id") % 5).alias("model"))
    return v.groupBy("key").agg(F.countDistinct("model").alias("n")).where("n = 5").select("key")


@query(
    "g16_density_clusters",
    """WITH RECURSIVE p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y FROM embeddings), near AS (SELECT a.id, b.id AS nid FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004),
 core AS (SELECT id FROM near GROUP BY 1 HAVING count(*) >= 4), links AS (SELECT id, nid FROM near SEMI JOIN core USING (id) WHERE nid IN (FROM core)),
 reach AS (SELECT id, id AS root FROM core UNION SELECT l.nid, r.root FROM reach r JOIN links l ON l.id = r.id), lab AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
 bord AS (SELECT n.id, min(cluster) AS cluster FROM near n JOIN lab ON lab.id = n.nid WHERE n.id NOT IN (FROM core) GROUP BY 1)
 SELECT p.id, coalesce(lab.cluster, bord.cluster, -1) AS cluster FROM p LEFT JOIN lab USING (id) LEFT JOIN bord USING (id)""",
)
def _(t: Tables) -> DataFrame:
    p = t.embeddings.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 4).alias("y"))
    return vectors.dbscan(p, "vec_id", ["x", "y"], 0.02, 4)


@query("g17_ward_clusters")
def _(t: Tables) -> DataFrame:
    f = [F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(64)]
    return vectors.hierarchical(t.embeddings.select("label", "vec_id", *f), "label", "vec_id", [f"f{k}" for k in range(64)])

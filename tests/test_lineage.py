"""Tables in the shared folder, and components over them."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lepidus import plans
from lepidus.operators import lineage, vectors


def test_a_cluster_must_name_its_folder():
    none = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.folder(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master)))


def test_tables_are_written_and_forgotten(spark):
    df = lineage.written(spark.range(5), "five")
    assert df.count() == 5
    lineage.forget(df)
    with pytest.raises(Exception):
        df.count()


def test_bounds_are_counted(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(lineage.bounded(spark.range(10), 10)) and "ResolvedHint" not in plan(lineage.bounded(spark.range(11), 10))


def test_components_of_random_graphs_and_hubs(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000, 1000 + k) for k in range(1, 500)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in lineage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in parent if v not in alone}


def test_density_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(c, 0.2, (25, 2)) for c in ((0, 0), (3, 0), (3, 3))] + [rng.uniform(-2, 6, (20, 2)), np.zeros((4, 2))]).round(3)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "id long, x double, y double")
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 0.25
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(p)), len(p))
    while True:
        low = np.where(core, np.where(near & core[None], label[None], len(p)).min(1), len(p))
        if (low == label).all():
            break
        label = low
    border = np.where(near & core[None], label[None], len(p)).min(1)
    want = np.where(core, label, np.where(border < len(p), border, -1))
    got = {r.id: r.cluster for r in vectors.dbscan(df, "id", ["x", "y"], 0.5, 5).collect()}
    assert [got[k] for k in range(len(p))] == want.tolist() and len(set(want)) >= 4


@pytest.mark.parametrize("d,eps,least", [(2, 0.3, 4), (2, 0.12, 3), (3, 0.6, 6)])
def test_density_clusters_of_full_and_sparse_cells_against_all_pairs(spark, d, eps, least):
    rng = np.random.default_rng(d)
    p = np.concatenate([rng.normal(0, 0.3, (300, d)), rng.normal(2, 0.2, (60, d)), rng.uniform(-3, 4, (120, d)), np.round(rng.normal(1, 0.4, (80, d)), 1)])
    names = [f"x{k}" for k in range(d)]
    got = {r.id: r.cluster for r in vectors.dbscan(spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], ["id", *names]), "id", names, eps, least).collect()}
    near = ((p[:, None] - p) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    cluster = np.where(core, np.arange(len(p)), len(p))
    while True:
        low = np.where(core, np.where(near & core, cluster, len(p)).min(axis=1), len(p))
        if (low == cluster).all():
            break
        cluster = low
    border = np.where(near & core, cluster, len(p)).min(axis=1)
    want = np.where(core, cluster, np.where(border < len(p), border, -1))
    assert [got[k] for k in range(len(p))] == want.tolist() and (want == -1).any() and (~core & (want >= 0)).any()


def test_pairs_of_a_crowd_are_not_listed(spark, monkeypatch):
    """1,500 points in a few full cells: what is written of pairs is no more than the points."""
    rows = []
    plain = vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, name="table": rows.append((name, (out := plain(df, name)).count())) or out)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, *map(float, rng.uniform(0, 1, 2))) for k in range(1500)], "id long, x double, y double")
    assert {r.cluster for r in vectors.dbscan(df, "id", ["x", "y"], 0.5, 4).collect()} == {0}
    assert max(n for _, n in rows) <= 1500


def test_neighbours_of_copies_and_near_ties_are_those_of_sql(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=(400, 8)).astype(np.float32)
    e[100:130] = e[5]
    e[130:160] = e[5] + np.float32(1e-7)
    con = duckdb.connect()
    con.register("v", pa.table({"vec_id": np.arange(400), "e": list(e)}))
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, e::FLOAT[] AS embedding FROM v")
    plans.load()
    want = sorted(con.execute(plans.SQL["j14_neighbours"]).fetchall())
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "vec_id long, embedding array<float>")
    for blocks in (1, 3):
        got = vectors.neighbours(df, "vec_id", "embedding", 6, blocks=blocks).collect()
        assert sorted((r.id, r.neighbour, round(r.distance, 6), r["rank"]) for r in got) == want

"""Queries without SQL run over whole tables: small tables whose ids go beyond any subset."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lepidus import plans
from lepidus.functions import colour as fc

plans.load()
IDS = (3, 150, 20_003)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """The same picture and the same outline under each of IDS."""
    at, rng = tmp_path_factory.mktemp("small"), np.random.default_rng(1)
    n, k = 60, len(IDS)
    one = {"l_partkey": rng.integers(1, 2000, n), "l_suppkey": rng.integers(1, 100, n), "l_quantity": rng.integers(1, 51, n).astype(float), "l_discount": rng.integers(0, 3, n) / 100}
    pq.write_table(pa.table({"l_orderkey": np.repeat(np.arange(k), n)} | {c: np.tile(v, k) for c, v in one.items()}), at / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": np.arange(k), "o_custkey": np.array(IDS)}), at / "orders.parquet")
    a = np.arange(32) * np.pi / 16
    ring = np.stack([np.cos(a), 0.5 * np.sin(a)], axis=1).ravel().astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.array(IDS), "embedding": [ring] * k}), at / "embeddings.parquet")
    return str(at), one


def by_id(df, id_):
    out = {}
    for r in df.collect():
        r = r.asDict()
        out.setdefault(r.pop(id_), []).append(tuple(r.values()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name,id_", [("g18_lab_clusters", "sample"), ("g25_equalised", "image"), ("g25_without_shine", "image"), ("g26_scale_bars", "image"), ("g27_thinned", "mask_id")])
def test_every_id_has_its_rows(spark, small, name, id_):
    got = by_id(plans.QUERIES[name](spark, small[0]), id_)
    assert sorted(got) == sorted(IDS) and got[IDS[0]] == got[IDS[1]] == got[IDS[2]]


def test_shine_is_replaced_in_every_picture(spark, small):
    c = [small[1]["l_partkey"] % 256, small[1]["l_suppkey"] * 37 % 256, small[1]["l_quantity"].astype(int) * 5]
    rows = spark.createDataFrame([tuple(map(int, r)) for r in zip(*c)], "c0 int, c1 int, c2 int")
    v = {}
    for r in rows.select("c0", "c1", *[x.alias(n) for x, n in zip(fc.hsv(*[rows[f"c{k}"] for k in range(3)]), "hsv")]).collect():
        at = (r.c0 % 24, r.c1 % 24)
        v[at] = min(v.get(at, (9e9,)), (r.h, r.s, float(r.v)))
    v = {at: x[2] for at, x in v.items()}
    want = []
    for (y, x), value in v.items():
        near = [w for (a, b), w in v.items() if abs(a - y) <= 3 and abs(b - x) <= 3 and w < 240]
        want.append((y, x, value if value < 240 else round(sum(near) / len(near), 9) if near else None))
    got = by_id(plans.QUERIES["g25_without_shine"](spark, small[0]), "image")
    for k in IDS:
        assert sorted((y, x, w if w is None else round(w, 9)) for y, x, w in got[k]) == sorted(want)


def test_colours_cluster_in_every_sample(spark, small):
    c = sorted(set(zip((small[1]["l_partkey"] % 256).tolist(), (small[1]["l_suppkey"] * 37 % 256).tolist(), (small[1]["l_quantity"].astype(int) * 5).tolist())))
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(c)], "k int, c0 int, c1 int, c2 int")
    lab = np.array([tuple(r)[1:] for r in rows.select("k", *fc.lab(rows.c0, rows.c1, rows.c2)).orderBy("k").collect()])
    d = np.sqrt(((lab[:, None] - lab) ** 2).sum(-1))
    parts = [[i] for i in range(len(lab))]
    while len(parts) > 1:
        low, i, j = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts[:i]))
        if low > 30:
            break
        parts[j] += parts.pop(i)
    want = np.array([next(n for n, p in enumerate(parts) if i in p) for i in range(len(lab))])
    got = by_id(plans.QUERIES["g18_lab_clusters"](spark, small[0]), "sample")
    for k in IDS:
        named = np.array([x for _, x in got[k]])
        assert ((named[:, None] == named) == (want[:, None] == want)).all()


def test_mean_shape_is_iterated_until_it_rests(spark, tmp_path):
    rng = np.random.default_rng(6)
    e = rng.normal(size=(20, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(20), "embedding": list(e)}), tmp_path / "embeddings.parquet")
    z = e[:, 0::2].astype(float) + 1j * e[:, 1::2]
    z -= z.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    mean, rounds = z[0], 0
    for rounds in range(1, 101):
        turn = (z.conj() * mean).sum(axis=1)
        new = (z * (turn / abs(turn))[:, None]).mean(axis=0)
        new /= np.linalg.norm(new)
        moved, mean = np.linalg.norm(new - mean), new
        if rounds == 8:
            early = mean
        if moved < 1e-5:
            break
    assert rounds > 8 and np.linalg.norm(early - mean) > 1e-3
    got = plans.QUERIES["a18_mean_shape"](spark, str(tmp_path)).toPandas().sort_values("i")
    assert np.allclose(got.x + 1j * got.y, mean, atol=1e-4)

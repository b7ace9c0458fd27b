import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lepidus.functions import strings
from lepidus.operators import assemble, graphs, stats, text, vectors


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd")))
def test_common_subsequence(a, b):
    assert text.lcs(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("is", "is")])
def test_stems(word, stem):
    assert text.porter(word) == stem


def test_rouge_of_itself_is_one(spark):
    p = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "b", "a"]), (2, ["a"], ["b"]), (3, [], ["b"])], "id long, r array<string>, c array<string>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in text.rouge_n(p, "id", "r", "c").collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert {r.id: r.f1 for r in text.rouge_l(p, "id", "r", "c").collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_strings(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert row(strings.canonical(F.lit("Ab-1_x.JPG"))) == "ab1_x"
    assert row(strings.json_block(F.lit('x ```json\n{"a": {"b": 1}\n``` y'))) == '{"a": {"b": 1}}'
    assert row(strings.json_block(F.lit("none"))) is None
    assert row(strings.wrapped(F.lit("aaa bbb ccc"), 7)) == "aaa bbb\nccc"
    assert row(strings.versioned(F.lit("a_V2.json"))) == "a_V3.json"
    assert row(strings.windows(F.array(*map(F.lit, "abcde")), 3, 2)) == [["a", "b", "c"], ["c", "d", "e"], ["e"]]
    assert row(strings.section(F.lit("Intro\nMeasurements:\n- a\n- b\n\nEnd"), "Measurements:")) == "- a\n- b"


def test_state_lines(spark):
    d = spark.createDataFrame([(1, "QA:\nq1\nq2\n\nother\nSize:\ns1")], "k long, t string")
    got = [(r.line, r.marker) for r in text.state_lines(d, "k", "t", "^(?:QA|Size):").orderBy("pos").collect()]
    assert got == [("QA:", "QA:"), ("q1", "QA:"), ("q2", "QA:"), ("", None), ("other", None), ("Size:", "Size:"), ("s1", "Size:")]


def test_batches(spark):
    d = spark.createDataFrame([("g", k, s) for k, s in enumerate([60, 30, 30, 200, 10])], "g string, k long, s long")
    assert [r.batch for r in text.batches(d, "g", "k", "s", 100).orderBy("k").collect()] == [0, 0, 1, 2, 3]


def test_graph_metrics(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 2), ("d", "d", 1)], "src string, dst string, w long")
    r = graphs.metrics(e).first()
    assert (r.nodes, r.edges) == (4, 5) and r.degree == pytest.approx(2.5) and r.clustering == pytest.approx((1 + 1 + 1 / 3 + 0) / 4)
    assert graphs.metrics(e.where("w > 9")).first().density is None


def test_clusters(spark):
    pts = [(k, 0.1 * k, 0.0) for k in range(6)] + [(10 + k, 5 + 0.1 * k, 0.0) for k in range(6)] + [(99, 50.0, 0.0)]
    got = {r.id: r.cluster for r in vectors.dbscan(spark.createDataFrame(pts, "i long, x double, y double"), "i", ["x", "y"]).collect()}
    assert {got[k] for k in range(6)} == {0} and {got[10 + k] for k in range(6)} == {10} and got[99] == -1
    df = spark.createDataFrame([("g", k, x) for k, x, _ in pts], "g string, i long, x double")
    labels = {r.i: r.cluster for r in vectors.hierarchical(df, "g", "i", ["x"], 3).collect()}
    assert len({labels[k] for k in range(6)}) == 1 and len(set(labels.values())) == 3


def test_wilcoxon(spark):
    d = spark.createDataFrame([("a", x, y) for x, y in [(1.0, 2.0), (5.0, 1.0), (3.0, 3.0), (4.0, 7.0)]], "g string, x double, y double")
    r = stats.wilcoxon(d, "g", "x", "y").first()
    assert (r.n, r.w) == (3, 3.0)
    assert stats.wilcoxon_p(3, 0) == pytest.approx(0.25)


def test_components(spark):
    d = spark.createDataFrame([(float(k), 2.0 * k, 1.0) for k in range(10)], "a double, b double, c double")
    out, share = stats.components(d, ["a", "b", "c"], 2)
    assert share[0] == pytest.approx(1) and out.agg(F.max(F.abs("pc2"))).first()[0] == pytest.approx(0, abs=1e-6)


def test_rank_tests():
    # worked by hand: W = 3 of 6 pairs without ties has 5 of 64 patterns at or below it
    assert stats.wilcoxon_p(6, 3) == pytest.approx(2 * 5 / 64)
    assert stats.wilcoxon_p(60, 60 * 61 / 4) == pytest.approx(1.0)
    n, w = 60, 700.0
    z = (w - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
    assert stats.wilcoxon_p(n, w) == pytest.approx(1 + math.erf(z / 2**0.5))


def test_manova_of_one_feature_is_an_f_test():
    # F of 2 and d degrees of freedom has the closed tail (1 + 2 F / d) ** (-d / 2)
    for f, d in ((0.5, 7), (3.0, 20), (9.0, 11)):
        assert stats.f_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2))
    m = {"groups": 3.0, "n": 24.0, "wilks": 0.7, "pillai": 0.3, "hotelling": 0.3 / 0.7, "roy": 0.3 / 0.7}
    rows = stats.manova_tests(m, 1)
    f = 0.3 / 0.7 * 21 / 2
    assert [r[4] for r in rows if r[0] != "hotelling"] == pytest.approx([f] * 3)
    assert [r[5] for r in rows if r[0] == "wilks"] == pytest.approx([stats.f_tail(f, 2, 21)])


@pytest.mark.parametrize("way", ["ward", "average"])
def test_linkage_against_all_pairs(way):
    x = np.random.default_rng(3).normal(size=(25, 3))
    parts, heights = [[k] for k in range(len(x))], []
    while len(parts) > 1:
        def far(p, q):
            if way == "average":
                return np.mean([np.linalg.norm(x[i] - x[j]) for i in p for j in q])
            return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0))

        h, i, j = min((far(p, q), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts[:i]))
        heights.append(h)
        parts[j] += parts.pop(i)
        if len(parts) == 4:
            four = sorted(map(sorted, parts))
    merges = vectors.linkage(x, way)
    assert [m[2] for m in merges] == pytest.approx(heights) and merges[-1][3] == 25
    labels = vectors.flat(merges, 25, 4)
    assert sorted(np.flatnonzero(labels == k).tolist() for k in range(4)) == four


def test_containment_and_prefixes(spark):
    a = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "zz"), (4, None), (5, "q"), (6, "ab")], "k int, a string")
    b = spark.createDataFrame([("xabcx",), ("zz",), ("yq",), ("qy",), (None,), ("b",)], "b string")
    got = {r.k: r.b for r in assemble.unique_containment(a, b, "a", "b").collect()}
    want = {}
    for r in a.collect():
        hits = [x.b for x in b.collect() if r.a and x.b and (r.a in x.b or x.b in r.a)]
        want[r.k] = hits[0] if len(hits) == 1 else None
    assert got == want
    names = spark.createDataFrame([("img_1",), ("img_12",), ("no",), ("",)], "n string")
    files = spark.createDataFrame([("img_12.png",), ("img_1.png",), ("img_13.png",)], "f string")
    assert {r.n: r.f for r in assemble.first_by_prefix(names, files, "n", "f").collect()} == {"img_1": "img_1.png", "img_12": "img_12.png", "": "img_1.png"}


def test_batches_are_those_of_a_fold(spark):
    rng = np.random.default_rng(4)
    sizes = [int(v) for v in rng.integers(0, 60, 3000)]
    sizes[:5] = [0, 0, 0, 500, 0]
    rows = [(("a", "b", None)[k % 3], k, s if k % 17 else None) for k, s in enumerate(sizes)]
    want = {}
    for g in ("a", "b", None):
        batch = held = 0
        for name, k, s in rows:
            if name == g:
                s = s or 0
                if held > 0 and held + s + 5 > 100:
                    batch, held = batch + 1, 0
                held += s
                want[k] = batch
    df = spark.createDataFrame(rows, "g string, k int, s int")
    assert {r.k: r.batch for r in text.batches(df, "g", "k", "s", 100, 5).collect()} == want


def test_triangles_of_a_dense_graph(spark):
    rng = np.random.default_rng(5)
    near = np.triu(rng.random((30, 30)) < 0.4, 1)
    edges = [(f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(near))]
    full = near | near.T
    want = {f"n{k}": int((full[k][:, None] & full[k][None] & near).sum()) for k in range(30)}
    got = {r.node: r.t for r in graphs.triangles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("way", ["ward", "average"])
def test_groups_clustered_together_are_as_each_alone(way):
    rng = np.random.default_rng(8)
    n = rng.integers(1, 60, 150)
    x = rng.normal(size=(n.sum(), 5))
    seen = 0
    for g, *m in vectors.merges(x, n, way):
        seen += len(g)
        for row, k in enumerate(g):
            own = x[n[:k].sum() :][: n[k]]
            h, a, z = vectors._chained(own, way)
            got = sorted(zip(*[v[row][: n[k] - 1].tolist() for v in m]))
            assert np.allclose([v[0] for v in got], np.sort(h)) and [v[1:] for v in got] == [v[1:] for v in sorted(zip(h.tolist(), a.tolist(), z.tolist()))]
            labels = vectors.flat(vectors.linkage(own, way), n[k], min(3, n[k]))
            assert (vectors.cut(n[g], *m, k=3)[row, : n[k]] == labels).all()
            at = float(np.median(h)) * 1.001 if n[k] > 1 else 1.0
            assert (vectors.cut(n[g], *m, height=at)[row, : n[k]] == vectors.flat(vectors.linkage(own, way), n[k], height=at)).all()
    assert seen == 150


def test_large_groups_are_paired_with_the_merges_of_chains():
    rng = np.random.default_rng(9)
    near = rng.normal(size=(900, 8))
    hub = np.concatenate([np.zeros((1, 2)), np.array([[np.cos(k), np.sin(k)] for k in range(400)]) * np.linspace(1, 3, 400)[:, None]])
    copies = np.concatenate([np.tile(near[:3], (100, 1)), near[3:200]])
    for x in (near, hub, copies):
        h, a, z = vectors._paired(x)
        want = vectors._chained(x, "ward")[0]
        assert len(h) == len(x) - 1 and np.allclose(np.sort(h), np.sort(want))
        m = [np.asarray(v)[None] for v in (h, a, z)]
        for k in (2, 3, 10):
            assert (vectors.cut(np.array([len(x)]), *m, k=k)[0] == vectors.flat(vectors.linkage(x), len(x), k)).all()
            plain = [np.asarray(v)[None] for v in vectors._chained(x, "ward")]
            assert (vectors.cut(np.array([len(x)]), *m, k=k) == vectors.cut(np.array([len(x)]), *plain, k=k)).all()

"""SimHash, suffix arrays, pivots: against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lepidus.llm import _text, induced, pivots, shared, simhash, suffix


def roots(n, edges):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


def near_groups(rows):
    """doc_id -> keep_id by comparing all with all."""
    rows = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text})
    fp, ok = zip(*(simhash.fingerprints(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in rows))
    fp, ok = np.concatenate(fp), np.concatenate(ok)
    edges = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp).sum(1) <= simhash.TAU) if i < j and ok[i] and ok[j]]
    root = roots(len(rows), edges)
    return {rows[i][0]: rows[r][0] for i, r in enumerate(root) if r != i}


def test_near_copies_are_found(spark, documents):
    want = near_groups(documents.collect())
    got = {r.doc_id: r.keep_id for r in simhash.groups(documents).collect()}
    assert got == want and len(want) > 10


def test_crowds_of_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"word{k}" for k in rng.integers(0, 10**6, 200)]
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(150)] + [(1000 + k, "just the same text here") for k in range(100)]
    rows += [(2000 + k, " ".join(f"lone{x}" for x in rng.integers(0, 10**6, 60))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in simhash.groups(df).collect()}
    assert got == near_groups(df.collect())
    assert sorted(r.doc_id for r in simhash.stage(spark, df).collect()) == [0, 1000, *range(2000, 2020)]


def test_simhash_takes_hard_rows(spark, hard, clashing, nothing):
    assert simhash.groups(hard).collect() == [] and simhash.groups(nothing).collect() == []
    kept = simhash.stage(spark, clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 127), max_size=simhash.TAU))
def test_chains_lose_no_pair_within_the_budget(bits):
    x = np.zeros(128, np.uint8)
    x[list(bits)] = 1
    assert simhash.chained(np.packbits(x).view(np.uint64).reshape(1, 2)).all()


def test_chains_followed_in_words_are_those_of_segments():
    x = np.random.default_rng(3).integers(0, 2**63, (4000, 2), dtype=np.uint64) & np.random.default_rng(4).integers(0, 2**63, (4000, 2), dtype=np.uint64)
    ones = np.bitwise_count(simhash._halves(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 16))).tolist()
    want = [any(all(sum(c[(s + i) % 32] for i in range(n + 1)) <= (n + 1) * simhash.TAU // 32 for n in range(simhash.FILTER)) for s in range(32)) for c in ones]
    got = simhash.chained(x).tolist()
    assert got == want and 0 < sum(want) < len(want)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, simhash.TAU), st.data())
def test_some_key_is_within_its_budget_and_its_half_ring_too(tau, data):
    flip = np.zeros((1, 128), np.uint8)
    flip[0, sorted(data.draw(st.sets(st.integers(0, 127), max_size=tau)))] = 1
    ones, t = np.bitwise_count(simhash.keys(np.packbits(flip).view(np.uint64).reshape(1, 2)))[0].tolist(), simhash.budgets(tau)
    assert any(all(sum(ones[(s + j) % 8] for j in range(n)) <= sum(t[(s + j) % 8] for j in range(n)) + n - 1 for n in range(1, 9)) for s in range(8) if t[s] >= 0)


def flipped(rng, fp, bits):
    """Each fingerprint with just ``bits`` of its bits changed."""
    flip = np.zeros((len(fp), 128), np.uint8)
    np.put_along_axis(flip, rng.permuted(np.tile(np.arange(128), (len(fp), 1)), axis=1)[:, :bits], 1, axis=1)
    return fp ^ np.packbits(flip, axis=1).view(np.uint64)


@pytest.mark.parametrize("bits", [16, 20, simhash.TAU])
def test_no_pair_within_the_bits_is_lost(bits):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (3000, 2), dtype=np.uint64) * np.uint64(2)
    both = np.concatenate([fp, flipped(rng, fp, bits)])
    half = np.arange(6000) // 3000
    assert simhash.grouped(both).tolist() == simhash.grouped(both, half).tolist() == list(range(3000)) * 2
    far = np.concatenate([fp, flipped(rng, fp, simhash.TAU + 1)])
    assert simhash.grouped(far).tolist() == list(range(6000))


def test_bits_spread_over_the_ring_are_met():
    # three bits in each key, all positions alike, and six in every other one
    fp = np.random.default_rng(5).integers(0, 2**63, (40, 2), dtype=np.uint64)
    for each in ([3] * 8, [6, 0] * 4, [0, 6] * 4, [2, 4] * 4, [4, 2, 3, 3] * 2, [16, 8] + [0] * 6, [2, 3, 3, 3, 3, 3, 3, 4]):
        other = fp ^ np.packbits([k < n for n in each for k in range(16)]).view(np.uint64)
        assert simhash.grouped(np.concatenate([fp, other])).tolist() == list(range(40)) * 2


@pytest.mark.parametrize("block", [simhash.BLOCK, 300])
def test_links_through_spark_are_those_of_all_with_all(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**63, (200, 2), dtype=np.uint64)
    chain = [flipped(rng, fp, simhash.TAU) for _ in range(3)]  # stars at just the threshold, then a crowd
    crowd = flipped(rng, np.repeat(fp[:1], 400, axis=0), 9)
    fp = np.unique(np.concatenate([fp, *chain, crowd]), axis=0)
    rows = [(1000 + k, int(a), int(b)) for k, (a, b) in enumerate(fp.view(np.int64).tolist())]
    got = [(r.a - 1000, r.b - 1000) for r in simhash.pairs(spark.createDataFrame(rows, "node long, f0 long, f1 long")).collect()]
    edges = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp).sum(1) <= simhash.TAU).tolist() if i < j]
    assert roots(len(fp), got) == roots(len(fp), edges) and 900 < len(fp) and len(got) < len(edges)


def test_long_runs_give_the_same_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    fp = np.repeat(centres, 30, axis=0)
    flips = rng.integers(0, 64, (len(fp), 8), dtype=np.uint64)
    for k in range(8):
        fp[:, k % 2] ^= np.uint64(1) << flips[:, k]
    a, b = simhash._linked(np.zeros(len(fp), np.int64), np.arange(len(fp)), fp, simhash.TAU)
    edges = [(i, j) for i in range(len(fp)) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.TAU]
    assert roots(len(fp), zip(a, b)) == roots(len(fp), edges) and len(a) < len(fp)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(values):
    t = np.array([*values, 0])
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    sa = induced.suffix_array(t)
    assert sa.tolist() == want
    p = induced.common_prefixes(t, sa)
    for r in range(1, len(t)):
        a, b = t[sa[r] :].tolist(), t[sa[r - 1] :].tolist()
        assert p[sa[r]] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def words(text):
    return [w for w in re.split("[\x00-\x20\x7f]+", text or "") if w]


def windows(rows, length):
    """{doc: {window's start: first place}} of windows that occurred before."""
    seen, want = {}, {}
    for i, w in sorted({(r.doc_id, tuple(words(r.text))) for r in rows if r.doc_id is not None}):
        for p in range(len(w) - length + 1):
            if (k := w[p : p + length]) in seen:
                want.setdefault(i, {})[p] = seen[k]
            else:
                seen[k] = (i, p)
    return want


def spread(rows, length):
    got = {}
    for r in rows:
        for q in range(r.n_words - length + 1):
            got.setdefault(r.doc_id, {})[r.start + q] = (r.first_doc_id, r.first_start + q)
    return got


def test_repeated_passages(spark, documents):
    got = spread(suffix.spans(documents).collect(), suffix.LENGTH)
    want = windows(documents.collect(), suffix.LENGTH)
    assert got == want and want


def test_sql_gives_the_same(spark, documents, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(suffix.SQL).fetchall())
    assert sorted(tuple(r) for r in suffix.spans(documents).collect()) == want and want

    vecs = table(spark, vectors(np.random.default_rng(2)))
    con.register("embeddings", vecs.toArrow())
    assert sorted(tuple(r) for r in pivots.classes(vecs).collect()) == sorted(con.execute(pivots.SQL).fetchall())


def test_repeats_within_stuttering_text(spark):
    rng = np.random.default_rng(3)
    texts = ["a b " * 40, "a b " * 25 + "c d " * 30, "x " * 100, " ".join(rng.choice(list("ab"), 300)), " ".join(rng.choice(list("ab"), 300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spread(suffix.spans(df, 8, 3).collect(), 8) == windows(df.collect(), 8)


def test_crowded_anchors_give_the_same(spark, documents):
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(60)
    rows = [(k, " ".join(fresh(20) + passage + fresh(20))) for k in range(40)] + [(100, " ".join(passage)), (101, " ".join(passage[:55] + fresh(3)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want = sorted(map(tuple, suffix.spans(df).collect()))
    assert sorted(map(tuple, suffix.spans(df, crowd=3).collect())) == want and {r[0] for r in want if r[0] < 1000} == {*range(1, 40), 100, 101}
    assert spread(suffix.spans(df, crowd=3).collect(), suffix.LENGTH) == windows(df.collect(), suffix.LENGTH)


def test_repeats_of_a_row_are_met_once(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(60)
    once = [(k, " ".join(fresh(20) + passage + fresh(20))) for k in range(1, 7)]
    often = once + [once[0], once[3]] * 300
    few, many = (spark.createDataFrame(rows, "doc_id long, text string").repartition(4) for rows in (once, often))
    wanted = suffix.repeated(suffix.marks(few)).select("anchor", "frag", "id", "sub", "at", "size")
    given = lambda df: suffix.contents(df, wanted)
    assert set(map(tuple, given(many).collect())) == set(map(tuple, given(few).collect()))
    # a row of each task at most, where each repeat gave one
    assert given(few).count() <= given(many).count() <= 8 * given(few).count()
    for crowd in (suffix.CROWD, 3):
        assert sorted(map(tuple, suffix.spans(many, crowd=crowd).collect())) == sorted(map(tuple, suffix.spans(few).collect()))


def test_rows_of_one_id_are_told_apart(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    p, a, b, c = fresh(60), fresh(60), fresh(90), fresh(80)
    df = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(a + p)), (2, " ".join(b + c))], "doc_id long, text string")
    got = sorted(words(r.text) for r in suffix.stage(spark, df).collect())
    assert got == sorted([p, a, b + c])
    one, other = " ".join(a), " ".join(b)
    df = spark.createDataFrame([(1, one), (2, one), (2, other), (3, other), (3, other), (4, " ".join(c)), (4, " ".join(c[:-1]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.stage(spark, df).collect())
    assert got[:2] == sorted([(1, one), (2, other)]) and [i for i, _ in got[2:]] == [4]
    assert sorted((r.doc_id, r.keep_id) for r in simhash.groups(df).collect()) == [(2, 1), (3, 2)]


def test_passages_are_cut_from_later_documents(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(60)
    rows = [(1, " ".join(fresh(30) + passage + fresh(5))), (2, " ".join(["start"] + passage + ["end"])), (3, " ".join(passage)), (4, " ".join(fresh(80)))]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (words(r.text), r.n_chars == len(r.text)) for r in suffix.stage(spark, df).collect()}
    assert got == {1: (words(rows[0][1]), True), 2: (["start", "end"], True), 4: (words(rows[3][1]), True)}


def test_suffix_takes_hard_rows(spark, hard, clashing, nothing):
    rows = suffix.spans(hard).collect()
    assert {r.doc_id for r in rows} == {5}  # the long text repeats itself
    assert suffix.spans(nothing).count() == 0
    kept = suffix.stage(spark, clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def vectors(rng, n=400, d=32):
    x = rng.normal(size=(n, d))
    x[100:140] = x[:40] + 0.05 * rng.normal(size=(40, d))
    x[140:170] = x[7] + 0.03 * rng.normal(size=(30, d))
    x[170] = x[171]
    return x.astype(np.float32)


def table(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(np.asarray(x, np.float32))}))


def all_links(x, block=2000):
    """How many others are near each row, and the least row of its class."""
    u, links, edges = pivots.unit(np.asarray(x, np.float32).astype(np.float64)), [], []
    for k in range(0, len(u), block):
        near = u[k : k + block] @ u.T >= pivots.COSINE
        links.append(near.sum(axis=1) - 1)
        i, j = np.nonzero(near)
        keep = i + k < j
        edges.append(np.stack([i[keep] + k, j[keep]], axis=1))
    parent = np.arange(len(u))
    for e in edges:
        pivots._merge(parent, e[:, 0], e[:, 1])
    return np.concatenate(links), parent


@pytest.mark.parametrize("most", [8192, 40])
def test_pivots_against_brute_force(spark, most):
    x = vectors(np.random.default_rng(0))
    got = pivots.classes(table(spark, x), most=most).toPandas().sort_values("vec_id")
    links, root = all_links(x)
    assert got.links.tolist() == links.tolist() and got.class_id.tolist() == root.tolist() and links.sum() > 800


def turned(rng, x, c):
    """Unit vectors at cosine ``c`` to those of ``x``, in random directions."""
    g = rng.normal(size=x.shape)
    return c * x + np.sqrt(1 - c * c) * pivots.unit(g - (g * x).sum(axis=1, keepdims=True) * x)


@pytest.mark.parametrize("n,cone", [(2000, 0.0), (12000, 1.5)])
def test_pivots_find_all_bands_and_crowds(spark, n, cone):
    rng = np.random.default_rng(5)
    one = lambda: pivots.unit(rng.normal(size=(1, 64)))
    x = pivots.unit(rng.normal(size=(n, 64)) + cone * (np.arange(64) == 0) * 8)
    parts = {"lone": x} | {f"mates {c}": turned(rng, x[k * 200 : (k + 1) * 200], c) for k, c in enumerate((0.905, 0.93, 0.97))}
    parts["crowd"] = turned(rng, np.repeat(one(), 1500, axis=0), 0.95)
    parts["narrow"] = pivots.unit(one() + 0.12 * rng.normal(size=(300, 6)) @ rng.normal(size=(6, 64)) / 3)
    parts["near copies"] = turned(rng, np.repeat(one(), 600, axis=0), 0.99)
    parts["copies"] = np.repeat(one(), 600, axis=0)
    x = np.concatenate(list(parts.values())).astype(np.float32)
    got = pivots.classes(table(spark, x)).toPandas().sort_values("vec_id")
    links, root = all_links(x)
    found, at = got.links.to_numpy(), 0
    assert (found <= links).all()
    for name, part in parts.items():
        own = slice(at, at + len(part))
        assert found[own].sum() >= {"crowd": 0.98, "near copies": 1, "copies": 1}.get(name, 0.95) * links[own].sum(), name  # in few directions, more is missed
        if name in ("crowd", "near copies", "copies"):
            assert (got.class_id.to_numpy()[own] == root[own]).mean() > 0.99
        at += len(part)


def test_pivots_take_hard_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [2.0, 0.01], 3), (3, None, 3), (4, [], 3), (5, [0.0, 0.0], 3), (6, [nan, 1.0], 3), (7, [1.0, 2.0, 3.0], 3), (8, [1.0, 2.0, 3.1], 3), (None, [1.0, 0.0], None), (9, [None, 1.0], 3), (10, [inf, 1.0], 3), (2, [0.0, 1.0], 3), (11, [-0.0, 3.0], 3), (12, [3e30, 1e30], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = sorted(map(tuple, pivots.classes(df).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[3] == [(3, 0)] and by[4] == [(4, 0)] and by[5] == [(5, 0)] and by[6] == [(6, 0)] and by[9] == [(9, 0)] and by[10] == [(10, 0)] and by[None] == [(None, 0)]
    assert by[7] == [(7, 1)] and by[8] == [(7, 1)] and by[11] == [(2, 1)]
    assert by[1] == [(1, 3), (1, 3)] and sorted(by[2]) == [(1, 3), (2, 1)] and by[12] == [(1, 3)]
    assert pivots.classes(df.where("vec_id is null")).count() == 1 and pivots.classes(df.where("false")).count() == 0


def test_word_hashes_are_of_content():
    a = np.frombuffer("the cat the cats éé".encode(), np.uint8)
    s, e, doc = _text.tokens(a, np.array([0, len(a)]))
    h = _text.hashes(a, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 4 and doc.tolist() == [0] * 5
    assert h[1] == _text.word("cat")

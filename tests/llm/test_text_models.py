"""Classifiers on held-out rows, BPE against a tokenizer, packing and licenses against brute force."""

import base64
import math
import re

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lepidus.llm import _text, bpe, licenses, packing, quality, toxicity


def split(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rest = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~rest), labels.where(rest)


@pytest.mark.parametrize("module,label,column,least", [(quality, "quality", "keep", 0.97), (toxicity, "toxic", "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, column, least):
    docs, seen, held = split(spark, "/root/testdata/sf0.1")
    got = module.classify(docs, seen).join(held.select("doc_id", F.col(label).alias("truth")), "doc_id")
    r = got.agg(F.avg((F.col(column).cast("int") == F.col("truth")).cast("int")).alias("a"), F.avg(F.when((F.col("truth") == (1 if label == "quality" else 0)), (F.col(column).cast("int") == F.col("truth")).cast("int"))).alias("clean")).first()
    assert r.a >= least and r.clean >= 0.99


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_hard_rows(spark, module, hard, clashing, nothing, labels):
    assert module.classify(hard, labels).count() == hard.count()
    assert module.classify(hard, labels.where("false")).count() == hard.count()
    assert module.classify(nothing, labels).count() == 0
    kept = module.stage(spark, clashing, labels.where("false"))
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    scores = [tuple(r)[1] for r in module.classify(hard, labels).where("doc_id = 1").collect()]
    assert len(scores) == 2 and scores[0] == scores[1]


class Plain:
    """FTRL as the paper has it, a coordinate at a time."""

    def __init__(self, model):
        self.m, self.z, self.n = model, {}, {}

    def w(self, i):
        z, m = self.z.get(i, 0.0), self.m
        l1 = 0.0 if i == "bias" else m.l1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((m.beta + math.sqrt(self.n.get(i, 0.0))) / m.alpha + m.l2)

    def score(self, x):
        return sum(self.w(i) * v for i, v in x.items())

    def learn(self, x, y, twins, pull):
        w = {i: self.w(i) for t in (x, *twins) for i in t}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        g = {i: (p - y) * v for i, v in x.items()}
        for t in twins:
            gap = {i: x.get(i, 0.0) - t.get(i, 0.0) for i in {*x, *t}}
            d = sum(w[i] * v for i, v in gap.items())
            for i, v in gap.items():
                g[i] = g.get(i, 0.0) + pull * d * v
        for i, v in g.items():
            n = self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + v - (math.sqrt(n + v * v) - math.sqrt(n)) / self.m.alpha * w[i]
            self.n[i] = n + v * v


def pieces(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+|[^a-z0-9_\x80-\U0010ffff\x00-\x20\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))


def plain_quality(text):
    w = [int(_text.word(t)) for t in pieces(text)]
    mask, f = (1 << quality.BITS) - 1, {}
    for k, h in enumerate(w):
        own = [h]
        if k:
            own.append(1 if h == w[k - 1] else int(_text.mix(np.array([h], np.uint64) * np.uint64(3) + np.array([w[k - 1]], np.uint64), 2)[0]))
        if k > 1 and h == w[k - 2]:
            own.append(2)
        for x in own:
            f[x & mask] = f.get(x & mask, 0.0) + 10.0 / len(w)
    return f | {"bias": 1.0}


def plain_toxicity(text):
    mask, f = (1 << toxicity.BITS) - 1, {"bias": 1.0}
    for t in pieces(text):
        raw = t.encode()
        f[int(_text.word(raw)) & mask] = 1.0
        for n in toxicity.STARTS:
            if len(raw) >= n:
                f[int(_text.mix(np.array([_text.word(raw[:n])], np.uint64), n)[0]) & mask] = 1.0
    return f


@pytest.mark.parametrize("module,label,features", [(quality, "quality", plain_quality), (toxicity, "toxic", plain_toxicity)])
def test_scores_are_those_of_plain_ftrl(spark, documents, data, module, label, features):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Women and a gay man. "), "text")).otherwise(F.col("text")).alias("text"))
    rows = module.ftrl.sample(docs, labels, label, 40)
    rows = rows.orderBy(F.xxhash64("id"), "id").collect()
    assert len(rows) == len({r.id for r in rows}) == 40
    model = module.ftrl.Ftrl(module.BITS, alpha=0.5, l1=0.02, l2=0.1) if module is quality else module.ftrl.Ftrl(module.BITS, alpha=0.3, l1=10.0, l2=0.1)
    model.l1 = min(model.l1, 0.5)  # few rows
    swap = toxicity.swapper() if module is toxicity else lambda t: []
    slow = Plain(model)
    data_ = [(features(r.text), r.y, [features(t) for t in swap(r.text)]) for r in rows]
    assert module is quality or sum(len(t) for _, _, t in data_) > 10
    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(data_)):
            slow.learn(*data_[k], toxicity.PULL)
    w = module.ftrl.train(spark.createDataFrame([(r.id, r.text, r.y) for r in rows], "id long, text string, y int"), module.merged if module is quality else module.featurize, model, epochs=4, twins=swap if module is toxicity else None, pull=toxicity.PULL)
    got = {r.doc_id: r.p for r in module.ftrl.score(docs, module.featurize, w, "p").collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-slow.score(features(r.text))))) < 1e-4


def test_the_training_bound_is_one_of_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "other") for k in range(2, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    assert quality.ftrl.sample(docs, labels, "quality", 2).count() <= 2
    every = quality.ftrl.sample(docs, labels, "quality", 1000).collect()
    assert sorted(r.id for r in every) == list(range(1, 50))


def mentions(rng, n, toxic_rate):
    """Sentences that mention a group; one group is insulted much more often than the others."""
    out = []
    for k in range(n):
        group = ["muslim", "christian", "hindu", "jewish"][k % 4]
        toxic = rng.random() < (toxic_rate if group == "muslim" else 0.05)
        fill = " ".join(f"f{x}" for x in rng.integers(0, 40, 8))
        out.append((k, f"the {group} people {'are scum and trash' if toxic else 'met today'} {fill}", int(toxic)))
    return out


def test_counterfactuals_lower_false_positives_on_neutral_mentions(spark):
    rows = mentions(np.random.default_rng(0), 800, 0.9)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, f"a {g} neighbour wrote f{k % 40}") for k, g in enumerate(["muslim", "christian", "hindu", "jewish"] * 5)], "doc_id long, text string")

    def gap(pull):
        w = toxicity.fit(docs, labels, pull=pull)
        s = toxicity.ftrl.score(neutral, toxicity.featurize, w, "p").withColumn("g", F.col("text").contains("muslim")).groupBy("g").agg(F.avg("p").alias("p")).collect()
        by = {r.g: r.p for r in s}
        return by[True] - by[False], by[True]

    plain, fair = gap(0.0), gap(toxicity.PULL)
    assert plain[0] > 0.02 and fair[0] < 0.5 * plain[0] and fair[1] < plain[1]


def test_twins_swap_within_groups():
    assert toxicity.swapper()("Women met a gay man") == ["Men met a lesbian girl", "Girls met a bisexual boy"]
    assert toxicity.swapper()("nothing here") == []


PIECES = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}, special_tokens={})


WHOLE = bpe.Vocabulary.of(bpe.read(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(WHOLE.ranks)


def test_each_vocabulary_has_its_own_coder():
    single = {bytes([k]): k for k in range(256)}
    a, b = bpe.Vocabulary.of(single | {b"ab": 256}), bpe.Vocabulary.of(single | {b"cd": 256})
    assert bpe.coder(a).encode("abcd").tolist() == [256, 99, 100]
    assert bpe.coder(b).encode("abcd").tolist() == [97, 98, 256]
    assert bpe.Vocabulary.of(dict(reversed(single.items()))).digest == bpe.Vocabulary.of(single).digest


def test_vocabularies_have_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MOST", 255)
    with pytest.raises(ValueError):
        bpe.Vocabulary.of({bytes([k]): k for k in range(256)})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_tokenizers(text):
    coder = bpe.coder(WHOLE)
    ids = coder.encode(text)
    assert ids.tolist() == PIECES.encode_ordinary(text)
    assert coder.decode(ids)[0].tobytes().decode() == text


def test_bpe_on_long_pieces(coder):
    for text in ("a" * 30_000, " " * 3000 + "x", "ab" * 9000, "é🎉" * 500):
        assert coder.encode(text).tolist() == PIECES.encode_ordinary(text)


def test_bpe_over_tables(spark, hard, clashing, nothing, documents):
    got = bpe.encode(clashing).collect()
    assert len(got) == clashing.count() and all(r.exact for r in got)
    assert all(r.ids is None and r.n_tokens is None for r in got if r.doc_id == 2) and [r.ids for r in got if r.doc_id == 3] == [[]]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(hard.where("doc_id is not null"))).collect()}
    assert back == {r.doc_id: r.text for r in hard.where("doc_id is not null").collect()}
    assert bpe.encode(nothing).count() == 0
    some = {r.doc_id: r for r in bpe.encode(documents).collect()}
    assert all(some[r.doc_id].ids == PIECES.encode_ordinary(r.text) for r in documents.collect())


def slow_pack(lengths, capacity):
    """One at a time: longest first, each into the pack with the most room left, if it fits there."""
    room = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(room)), key=lambda k: room[k], default=None)
        if best is None or room[best] < n:
            room.append(capacity - n)
        else:
            room[best] -= n
    return len(room), sum(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_patterns_hold_every_length_once(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    made = packing.patterns(histogram, 20)
    held = {}
    for count, ls in made:
        assert count > 0 and sum(ls) <= 20
        for n in ls:
            held[n] = held.get(n, 0) + count
    assert held == histogram
    assert sum(c for c, _ in made) <= slow_pack(lengths, 20)[0] + len(histogram)


def test_packs(spark, documents, clashing, nothing):
    rows = packing.pack(documents, 128).collect()
    words = {r.doc_id: len([w for w in __import__("re").split("[\x00-\x20\x7f]+", r.text or "") if w]) for r in documents.collect()}
    held, packs = {}, {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.n_words))
        packs.setdefault(r.pack_id, []).append((r.pack_offset, r.n_words))
    for i, n in words.items():
        at = 0
        for start, size in sorted(held.get(i, [])):
            assert start == at
            at += size
        assert at == n
    for p in packs.values():
        at = 0
        for offset, size in sorted(p):
            assert offset == at
            at += size
        assert at <= 128
    assert len(packs) == max(packs) + 1 and sum(words.values()) / (128 * len(packs)) > 0.97
    got = packing.pack(clashing).collect()
    assert sorted({str(r.doc_id) for r in got}) == ["1", "5", "6", "7", "None"] and sum(r.doc_id == 1 for r in got) == 2
    assert packing.pack(nothing).count() == 0


def test_ranks_over_several_salts(spark, documents, monkeypatch):
    want = sorted((r.pack_id, r.pack_offset, r.n_words) for r in packing.pack(documents, 256).collect())
    monkeypatch.setattr(packing, "RANKED", 7)
    got = packing.pack(documents, 256).collect()
    assert sorted((r.pack_id, r.pack_offset, r.n_words) for r in got) == want and len({(r.doc_id, r.piece) for r in got}) == len(got)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
    return row[-1]


def plain(text):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def slow_licenses(text, keys):
    """Every template around every place of its key phrase: {license: matches}, by words and plain tables."""
    h, out = plain(text), {}
    for (name, lines, phrases), key in zip(licenses.TEMPLATES, keys):
        w, ps = plain(" ".join(lines)), [plain(p) for p in phrases]
        stands = lambda p, t: [k for k in range(len(t) - len(p) + 1) if t[k : k + len(p)] == p]
        for p in stands(ps[key], h):
            at, room = p - next(iter(stands(ps[key], w)), 0), licenses.slack(len(w))
            lo, hi = max(0, at - room), min(len(h), at + len(w) + room)
            part = h[lo:hi]
            if all(stands(x, part) for x in ps) and (same := longest_common(w, part)) >= licenses.COVER * len(w):
                while longest_common(w, part[:-1]) == same:
                    part = part[:-1]
                while longest_common(w, part[1:]) == same:
                    part, lo = part[1:], lo + 1
                out.setdefault(name, []).append((lo, len(part), same))
    return {name: licenses.chosen(ms) for name, ms in out.items()}


def mutated(rng, n):
    """Templates with words replaced, left out or put in."""
    out = []
    for k in range(n):
        _, lines, _ = licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))]
        w = " ".join(lines).split()
        for _ in range(rng.integers(0, 2 + len(w) // 6)):
            i, way = int(rng.integers(len(w))), rng.integers(3)
            w[i : i + 1] = [["zzz"], [], [w[i], "zzz"]][way] if len(w) > 1 else w
        out.append((10_000 + k, "before it " + " ".join(w) + " after it"))
    return out


NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_licenses_against_brute_force(spark, documents):
    extra = mutated(np.random.default_rng(9), 1500) + [(30_000 + k, f"word word {' '.join(t)}, and more. {' '.join(t)}") for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    extra += [(20_000, "license license the of version 2.0 apache"), (20_001, "Licensed under the Apache License, Version 3.0."), (20_002, NOTICE.format("General Public")), (20_003, NOTICE.format("Lesser General Public")), (20_004, NOTICE.format("Affero General Public"))]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    index = licenses.Index(*licenses.frequencies(df))
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.license, []).append((r.start, r.n_words, r.in_place))
    for r in df.collect():
        assert got.get(r.doc_id, {}) == slow_licenses(r.text, index.keys)
    assert 20_000 not in got and 20_001 not in got
    assert [set(got[k]) for k in (20_002, 20_003, 20_004)] == [{"GPL-3.0-or-later"}, {"LGPL-3.0-or-later"}, {"AGPL-3.0-or-later"}]
    assert all(name in got[30_000 + k] for k, (name, _, _) in enumerate(licenses.TEMPLATES)) and len(got) > 900


def test_licenses_take_hard_rows(spark, clashing, nothing):
    assert licenses.scan(clashing).count() == 0 and licenses.scan(nothing).count() == 0

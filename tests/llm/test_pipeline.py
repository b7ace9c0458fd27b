"""The pipeline on small tables, stage by stage against the operators' own decisions."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lepidus.llm import entries, quality, simhash, suffix, toxicity


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, n = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        if name == "toxicity":
            assert ids(docs) == ids(before) - ids(toxicity.classify(before, labels).where("toxic"))
        if name == "quality":
            assert ids(docs) == ids(quality.classify(before, labels).where("keep"))
        if name == "simhash":
            assert ids(docs) == ids(before) - ids(simhash.groups(before))
        if name == "suffix_array":
            assert suffix.spans(docs).count() <= suffix.spans(before).count()
            assert ids(docs) <= ids(before)
    assert 0 < n["simhash"] <= n["quality"] <= n["toxicity"]
    assert corpus_pipeline.run(spark, data).count() == n["packing"]


def tables(spark, docs, labels, at):
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_run_takes_hard_rows(spark, hard, clashing, nothing, labels, tmp_path):
    none = labels.where("false")
    plain = corpus_pipeline.run(spark, tables(spark, hard, none, tmp_path / "a")).collect()
    # nothing is labelled, so nothing is rejected; repeated rows are packed each, the long text's own repeats are cut
    assert sorted({str(r.doc_id) for r in plain}) == ["1", "5", "6", "7", "None"] and sum(r.doc_id == 1 for r in plain) == 2
    held = sum(r.n_words for r in plain if r.doc_id == 5)
    assert held == 977 * 31  # the text is periodic: what comes after the first period is a repeat
    other = corpus_pipeline.run(spark, tables(spark, clashing, none, tmp_path / "b")).collect()
    place = lambda rows: sorted((str(r.doc_id), r.piece, r.start, r.n_words) for r in rows)
    assert place(other) == place(plain)
    assert corpus_pipeline.run(spark, tables(spark, nothing, none, tmp_path / "c")).count() == 0
    assert corpus_pipeline.run(spark, tables(spark, hard, labels, tmp_path / "d")).count() >= 0


def test_run_judges_rows_of_one_id_by_their_texts(spark, labels, tmp_path):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    p, a, b = words("p", 60), words("a", 70), words("b", 90)
    docs = spark.createDataFrame([(1, p), (2, f"{a} {p}"), (2, b), (3, b)], "doc_id long, text string")
    got = corpus_pipeline.run(spark, tables(spark, docs, labels.where("false"), tmp_path / "e")).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 60), (2, 70), (2, 90)]


def test_simhash_stage_leaves_no_two_rows_within_the_bits(spark, monkeypatch):
    # 400 pairs at just the threshold, fingerprints laid under the texts' numbers
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**63, (400, 2), dtype=np.uint64)
    flip = np.zeros((400, 128), np.uint8)
    np.put_along_axis(flip, rng.permuted(np.tile(np.arange(128), (400, 1)), axis=1)[:, : simhash.TAU], 1, axis=1)
    both = np.concatenate([fp, fp ^ np.packbits(flip, axis=1).view(np.uint64)]).view(np.int64).tolist()
    laid = spark.createDataFrame([(k, *v) for k, v in enumerate(both)], "n long, f0 long, f1 long")

    def fingerprinted(docs, f0="f0", f1="f1"):
        named = laid.select(F.col("n").alias("laid_n"), F.col("f0").alias(f0), F.col("f1").alias(f1))
        return docs.join(named, F.col("text").cast("long") == F.col("laid_n")).drop("laid_n")

    monkeypatch.setattr(simhash, "fingerprinted", fingerprinted)
    docs = spark.createDataFrame([(k, str(k)) for k in range(800)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == list(range(400))


def test_rows_without_an_id_and_texts_of_signs_are_judged_by_their_texts(spark, labels, tmp_path):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    x, y, p = words("x", 40), words("y", 200), words("p", 60)
    rows = [(None, x)] * 3 + [(5, x)]  # the one with an id stays
    rows += [(None, y), (None, y + " z"), (None, y)]  # one stays, whichever
    rows += [(8, "--- *** ---"), (9, "--- *** ---"), (10, "+++"), (None, "+++")]
    rows += [(None, f"{words('a', 70)} {p}"), (None, f"{words('b', 80)} {p}"), (12, f"{words('c', 90)} {p}")]  # 12 keeps the passage
    docs = spark.createDataFrame(rows + [(None, None), (None, ""), (None, " ")], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.run(spark, tables(spark, docs, labels.where("false"), tmp_path / "f")).collect()
    key = lambda v: (v[0] is None, v)
    got = sorted(((r.doc_id, r.n_words) for r in got), key=key)
    assert [v for v in got if v[0]] == [(5, 40), (8, 3), (10, 1), (12, 150)]
    n = [v[1] for v in got if v[0] is None]
    assert n[:2] == [70, 80] and n[2] in (200, 201) and len(n) == 3
    left = simhash.stage(spark, docs)
    assert left.columns == docs.columns and left.where("text is null or trim(text) = ''").count() == 3
    assert sorted((simhash.groups(docs).collect())) == [(9, 8)]
    assert {r.doc_id for r in suffix.spans(docs).collect()} == set()


def test_no_near_copies_are_left_by_cutting(spark, labels, tmp_path):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    p = [words(f"p{k}x", 60) for k in range(4)]
    # 10, 11 and 12 are alike only when their passages are cut, as 1, 2 and 3 have these
    rows = [(k, f"{words(f'own{k}x', 400)} {p[k]}") for k in (1, 2, 3)] + [(9 + k, f"{words('same', 30)} {p[k]}") for k in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.stage(spark, docs).count() == 6
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix_array"](spark, docs, "").collect()}
    assert got == dict(rows[:3]) | {10: words("same", 30)}
    ran = corpus_pipeline.run(spark, tables(spark, docs, labels.where("false"), tmp_path / "g"))
    assert sorted((r.doc_id, r.n_words) for r in ran.collect()) == [(1, 460), (2, 460), (3, 460), (10, 30)]


def test_a_passage_stays_when_its_first_row_goes(spark):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    p, r, stem = words("p", 200), words("r", 50), words("w", 1500)
    varied = lambda k: " ".join(f"v{k}" if i % 40 == 7 else w for i, w in enumerate(stem.split()))  # no 50 words alike
    # 3 is near to 2 once p is cut from it, and the first to hold r; 4 has r too; so is 5, cut by r and by p
    rows = [(1, f"{words('o', 100)} {p}"), (2, varied(2)), (3, f"{' '.join([p] * 30)} {varied(3)} {r}"), (4, f"{words('t', 100)} {r}")]
    rows += [(None, f"{' '.join([p] * 30)} {varied(5)} {r}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix_array"](spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 4: rows[3][1]}


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entries.queries()) == list(range(1, 11))

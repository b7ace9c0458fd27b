"""Operator 8: suffix-array dedup.

A passage is ``LENGTH`` or more consecutive words (white space divides words; case and signs count).  A word is repeated if
it stands in a passage that occurred before, "before" by (doc_id, position): in an earlier document, or earlier in the same.

No machine sees the corpus, so suffixes are sorted in shards, and what must meet is sent to the same shard by content.
Every window of LENGTH words has one anchor: the last least hash among the windows of ``GRAM`` words within it, which is
the same wherever these words stand.  Windows of one text with one anchor make a fragment.  (1) Anchors are found in every
text and counted by an aggregate with partial sums; those that occur once are done with.  (2) Fragments that are equal word
for word share their anchor and need no sorting: of each the first place is kept.  (3) For anchors with several distinct
fragments, one copy of each fragment's words goes to the anchor's shard, where a suffix array is made by induced sorting
(``induced``) and permuted common prefixes of LENGTH words or more give the windows that are equal.  (4) An anchor with more
than ``CROWD`` distinct fragments (a short passage that very many texts have, each among its own words) would be too much for
one shard: its fragments' windows meet by a hash of all their words, in an aggregate, which gives the same result.

Nothing is sampled or capped.  Words are told apart by hashes of 64 bits, spans of words by hashes of these.  A row is known
by its doc_id and a hash of its text, so rows that share a doc_id don't mix; stage() knows a row without one by a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lepidus.llm import _text, induced
from lepidus.llm.shared import forget, numbered, written

LENGTH = 50
GRAM = 20
SHARD = 400_000  # words to a shard's suffix array
CROWD = 8_000  # distinct fragments of an anchor that one shard takes
LAST = (1 << 63) - 1  # stands for the id that a row of the pipeline hasn't; the row's number is its sub
REMEMBERED = 100_000  # rows whose repeats a task passes over


def _last_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the position of its least, the last such one."""
    at, n, width = np.arange(len(g)), len(g), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] <= g[left], right, left)
        width += step
    return at[: max(0, n - w + 1)]


def _fragments(h: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Over the word hashes of several texts (text k is h[first[k]:first[k + 1]]): anchor, fragment's hash, start and size in words."""
    w = length - gram + 1
    g = _text.windows(h, gram)
    at = _last_least(g, w)  # windows that run over a text's end are dropped below
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = np.arange(len(at))
    inside = text[s] == text[s + length - 1] if len(s) else np.zeros(0, bool)
    s, at = s[inside], at[inside]
    if not len(s):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
    begin = s[cut]
    end = np.append(s[cut[1:] - 1], s[-1]) + length
    return g[at[cut]], _span_hash(h, begin, end), begin, end - begin


def _span_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _text._power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return _text.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64), 3)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, number of the first word of each text and, last, of all)."""
    s, e, _ = _text.tokens(data, at, _text.BLANKS)
    return _text.hashes(data, s, e), np.searchsorted(s, at)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text) of the rows that have an id; sub is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text).alias("sub"), text.alias("text"))


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, frag, id, sub, at, size) of every fragment of every text."""
    return _marks(_rows(docs), length, gram)


def _marks(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """marks() of what _rows() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in _text.slices(batches, "text"):
            h, first = _words(data, offsets)
            anchor, frag, begin, size = _fragments(h, first, length, gram)
            doc = np.searchsorted(first, begin, side="right") - 1
            ids, subs = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(frag.view(np.int64)), pa.array(ids), pa.array(subs), pa.array((begin - first[doc]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["anchor", "frag", "id", "sub", "at", "size"]
            )

    return rows.mapInArrow(run, "anchor long, frag long, id long, sub long, at int, size int")


def repeated(found: DataFrame) -> DataFrame:
    """Of ``found`` (marks), those whose anchor occurs twice or more, and whether it has several distinct fragments (``mixed``)."""
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("frag").alias("lo"), F.max("frag").alias("hi")).where("n > 1")
    return found.join(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchor")


def _shard(frag: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of the fragments of one shard: arrays (group, fragment's number, offset), sorted by group."""
    m, sizes = len(frag), np.array([len(f) for f in frag])
    _, rank = np.unique(np.concatenate(frag), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.empty(int(begin[-1]), np.int64)
    owner = np.repeat(np.arange(m), sizes + 1)
    offset = np.arange(len(t)) - begin[owner]
    end = begin[1:] - 1
    inner = np.ones(len(t), bool)
    inner[end] = False
    t[inner] = rank + m
    t[end] = np.arange(m)[::-1]  # one separator a fragment, each unlike all others; the last is the least
    sa = induced.suffix_array(t)
    lcp = induced.common_prefixes(t, sa)[sa]
    group = np.cumsum(lcp < length)
    fits = sizes[owner[sa]] - offset[sa] >= length
    return group[fits], owner[sa][fits], offset[sa][fits]


FOUND = "anchor long, frag long, j int, n int, id0 long, sub0 long, at0 int"


def classes(content: DataFrame, length: int = LENGTH) -> DataFrame:
    """For fragments of shared anchors (anchor, frag, id, sub, at, words): where each of their windows first occurred.

    (anchor, frag, j, n, id0, sub0, at0): windows j .. j + n - 1 of the fragment occurred first in id0 from word at0 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            group, own, off = _shard([x[5] for x in held], length)
            ids, subs, ats = (np.array([x[k] for x in held], np.int64) for k in (2, 3, 4))
            order = np.lexsort((ats[own] + off, subs[own], ids[own], group))
            group, own, off = group[order], own[order], off[order]
            new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
            id0, sub0, at0 = ids[own][first], subs[own][first], (ats[own] + off)[first]
            order = np.lexsort((off, own))
            own, off, id0, sub0, at0 = own[order], off[order], id0[order], sub0[order], at0[order]
            goes_on = (own[1:] == own[:-1]) & (off[1:] == off[:-1] + 1) & (id0[1:] == id0[:-1]) & (sub0[1:] == sub0[:-1]) & (at0[1:] == at0[:-1] + 1)
            cut = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(own) else np.zeros(0, np.int64)
            n = np.diff(np.append(cut, len(own)))
            anchor, frag = (np.array([x[k] for x in held], np.int64)[own[cut]] for k in (0, 1))
            values = [anchor, frag, off[cut].astype(np.int32), n.astype(np.int32), id0[cut], sub0[cut], at0[cut].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["anchor", "frag", "j", "n", "id0", "sub0", "at0"])

        total, last = 0, None
        for b in batches:
            for a, f, i, sub, at, w in zip(*(b.column(k).to_pylist() for k in range(6))):
                if total >= SHARD and a != last:
                    yield from out()
                    held.clear()
                    total = 0
                last = a
                held.append((a, f, i, sub, at, np.frombuffer(w, np.uint64)))
                total += len(w) // 8
        if held:
            yield from out()

    return content.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, FOUND)


def crowded(content: DataFrame, length: int = LENGTH) -> DataFrame:
    """What classes() gives, a window a row, from an aggregate over the windows' hashes: for anchors of very many fragments."""

    names = ["anchor", "frag", "id", "sub", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in _text.slices(batches, "words"):
            h, first = np.frombuffer(data.tobytes(), np.uint64), at // 8
            n = np.maximum(np.diff(first) - length + 1, 0)
            k = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            win = _text.windows(h, length)[first[k] + j].view(np.int64)
            own = b.select(names).take(pa.array(k))  # without the words, of which each window would get a copy
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array((own.column(4).to_numpy() + j).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(win)], names=["anchor", "frag", "id", "sub", "at", "j", "win"])

    each = written(content.mapInArrow(run, "anchor long, frag long, id long, sub long, at int, j int, win long"), "windows")
    first = each.groupBy("anchor", "win").agg(F.min(F.struct("id", "sub", "at")).alias("f"))
    return each.join(first, ["anchor", "win"]).select("anchor", "frag", "j", F.lit(1).alias("n"), F.col("f.id").alias("id0"), F.col("f.sub").alias("sub0"), F.col("f.at").alias("at0"))


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of ``wanted`` (anchor, frag, id, sub, at, size) from the texts: (anchor, frag, id, sub, at, words).

    Repeated rows of ``docs`` have the same words: a task gives those of one row and passes over the others it remembers, so
    an anchor gets a row from each task at most, not one from each repeat.
    """
    return _contents(_rows(docs), wanted)


def _contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """contents() of what _rows() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = np.zeros(b.num_rows, bool)
                for k, row in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    new[k] = row not in seen
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(row)
                yield b if new.all() else b.filter(pa.array(new))

        for b, data, offsets in _text.slices(unseen(batches), "text"):
            h, first = _words(data, offsets)
            asks = b.column(b.schema.get_field_index("asks"))
            at, size = asks.values.field("at").to_numpy(), asks.values.field("size").to_numpy()
            off = asks.offsets.to_numpy()
            k = np.repeat(np.arange(b.num_rows), np.diff(off))
            part = slice(off[0], off[-1])
            begin = first[k] + at[part]
            cut = [h[x : x + n].tobytes() for x, n in zip(begin, size[part])]
            f = asks.values.slice(off[0], off[-1] - off[0])
            yield pa.RecordBatch.from_arrays([f.field("anchor"), f.field("frag"), b.column(0).take(pa.array(k)), b.column(1).take(pa.array(k)), f.field("at"), pa.array(cut, pa.binary())], names=["anchor", "frag", "id", "sub", "at", "words"])

    asked = wanted.groupBy(F.col("id").alias("asked_id"), F.col("sub").alias("asked_sub")).agg(F.collect_list(F.struct("anchor", "frag", "at", "size")).alias("asks"))
    joined = rows.join(asked, (F.col("doc_id") == F.col("asked_id")) & (F.col("sub") == F.col("asked_sub"))).select("doc_id", "sub", "text", "asks")
    return joined.mapInArrow(run, "anchor long, frag long, id long, sub long, at int, words binary")


def _spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """spans() of what _rows() gives, with ``sub`` and the first row's, ``first_sub``."""
    found = written(_marks(docs, length, gram), "marks")
    rows = written(repeated(found), "repeated")
    forget(found)
    key, place = ["anchor", "frag"], F.struct("id", "sub", "at")
    leads = written(rows.groupBy(*key, "mixed").agg(F.min(place).alias("f"), F.first("size").alias("size")), "leads")
    plain = rows.where("not mixed").join(leads.where("not mixed").select(*key, "f"), key)
    plain = plain.select("id", "sub", F.col("at").alias("start"), (F.col("size") - length + 1).alias("n"), F.col("f.id").alias("id0"), F.col("f.sub").alias("sub0"), F.col("f.at").alias("at0"))
    wanted = leads.where("mixed").select(*key, "f.id", "f.sub", "f.at", "size")
    hot = written(wanted.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowds")
    some = bool(hot.head(1))
    same = classes(_contents(docs, wanted.join(hot, "anchor", "left_anti") if some else wanted), length)
    if some:
        same = same.unionByName(crowded(_contents(docs, wanted.join(hot, "anchor", "left_semi")), length))
    mixed = rows.where("mixed").select(*key, "id", "sub", "at").join(same, key).select("id", "sub", (F.col("at") + F.col("j")).alias("start"), "n", "id0", "sub0", "at0")
    both = plain.unionByName(mixed).where("id <> id0 or sub <> sub0 or start <> at0").distinct()
    # windows start .. start + n - 1 repeat those from at0 on: those that follow on along one diagonal are one span
    line = ["id", "sub", "id0", "sub0", "shift"]
    one = both.withColumn("shift", F.col("start") - F.col("at0"))
    along = Window.partitionBy(*line).orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    one = one.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    got = one.groupBy(*line, "part").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"))
    return got.select(F.col("id").alias("doc_id"), "sub", "start", (F.col("stop") - F.col("start") + length - 1).alias("n_words"), F.col("id0").alias("first_doc_id"), F.col("sub0").alias("first_sub"), (F.col("start") - F.col("shift")).alias("first_start"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first_start): every maximal passage that occurred before, and where.

    Null ids are left out (stage() takes their rows too), as are texts of under ``length`` words (null and empty ones
    too).  Of rows with the same doc_id and text, each passage has one place and isn't a repeat of itself; rows of one doc_id
    with different texts are told apart, and the one whose text has the lower hash comes before the other.  Of several
    earlier places the first counts, so a copied stretch may be several spans, which then overlap by up to length - 1 words.
    Other columns are ignored; an empty table gives no rows.
    """
    return _spans(_rows(docs), length, gram, crowd).drop("sub", "first_sub")


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns more, and their names: what a row is known by, (doc_id, hash of the text) or (LAST, a number of its own)."""
    row, *keys = (_text.fresh(docs.columns, c) for c in ("row", "known", "sub"))
    known, sub = F.coalesce("doc_id", F.lit(LAST)), F.coalesce(row, F.xxhash64(F.coalesce("text", F.lit(""))))
    return numbered(docs, row).withColumns(dict(zip(keys, (known, sub)))).drop(row), keys


def found(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, sub, start, n_words, first_doc_id, first_sub, first_start) of keyed rows, rows without an id after all that have one."""
    return _spans(rows.select(F.col(keys[0]).alias("doc_id"), F.col(keys[1]).alias("sub"), F.coalesce("text", F.lit("")).alias("text")))


def without(docs: DataFrame, keys: list[str], spans: DataFrame) -> DataFrame:
    """Keyed rows without the words of ``spans`` (found); a row of which nothing is left goes.  n_chars follows the text."""
    cut = _text.fresh(docs.columns, "cuts")
    cuts = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("sub").alias("cut_sub")).agg(F.collect_list(F.struct("start", "n_words")).alias(cut))
    own = (docs[keys[0]] == cuts["cut_id"]) & (docs[keys[1]] == cuts["cut_sub"])
    joined = docs.join(cuts, own, "left").select(*[docs[c] for c in docs.columns], cuts[cut])
    schema = StructType([*docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in _text.slices(batches, "text"):
            cuts = b.column(b.schema.get_field_index(cut)).to_pylist()
            rest = b.select(schema.names)
            if not any(cuts):
                yield pa.RecordBatch.from_arrays(rest.columns, names=schema.names)  # as below, whether or not a column can be null
                continue
            s, e, _ = _text.tokens(data, at, _text.BLANKS)
            first = np.searchsorted(s, at)
            texts, keep = rest.column(rest.schema.get_field_index("text")).to_pylist(), np.ones(len(cuts), bool)
            for k, c in enumerate(cuts):
                if c:
                    gone = np.zeros(first[k + 1] - first[k], bool)
                    for x in c:
                        gone[x["start"] : x["start"] + x["n_words"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    raw, out, done = data[at[k] : at[k + 1]].tobytes(), [], 0
                    for a, z in edge.reshape(-1, 2):
                        out.append(raw[done : s[first[k] + a] - at[k]])
                        done = int(e[first[k] + z - 1] - at[k])
                    texts[k] = b"".join([*out, raw[done:]]).decode().strip()
                    keep[k] = bool(texts[k])
            columns = list(rest.columns)
            columns[rest.schema.get_field_index("text")] = pa.array(texts, rest.schema.field("text").type)
            if "n_chars" in rest.schema.names:
                i = rest.schema.get_field_index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([len(t) if c else o for t, c, o in zip(texts, cuts, old)], rest.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the words that repeat an earlier passage; a row of which nothing is left goes.  n_chars follows the text.

    A row is cut by its own text's spans, whatever other rows its doc_id has; repeated rows are cut alike.  A row without an id
    is a document of its own, after all that have one.  Texts without a repeated passage stay as they are.
    """
    rows, keys = keyed(docs)
    return without(rows, keys, found(rows, keys)).drop(*keys)


SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x00-\x20\x7f]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
 p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d WHERE len(w) >= 50),
 h AS (SELECT doc_id, pos, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM p),
 f AS (SELECT doc_id, pos, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY h) AS f FROM h WHERE pos <= n - 50),
 r AS (SELECT doc_id, pos, f.d AS d0, pos - f.p AS shift FROM f WHERE f.d <> doc_id OR f.p <> pos),
 g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, d0, shift ORDER BY pos) AS k FROM r)
 SELECT doc_id, min(pos)::INT AS start, (count(*) + 49)::INT AS n_words, d0 AS first_doc_id, (min(pos) - shift)::INT AS first_start FROM g GROUP BY doc_id, d0, shift, k"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents that occurred before, and where."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

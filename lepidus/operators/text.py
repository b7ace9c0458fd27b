"""Texts: sections, word counts, co-occurrence, overlap scores, batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lepidus.functions import strings


def blocks(texts: DataFrame, key: str, text: str, mark: str = r"\n?-{3,}\n?", least: int = 1) -> DataFrame:
    """(key, pos, block): a text's blocks between marks, blanks trimmed, empty ones left out."""
    out = texts.select(key, F.posexplode(F.split(text, mark)).alias("pos", "block")).withColumn("block", F.trim("block"))
    return out.where(F.length("block") >= least)


def word_counts(docs: DataFrame, tokens: str, by: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*by, F.explode(tokens).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def cooccurrence(docs: DataFrame, left: str = "adjectives", right: str = "nouns") -> DataFrame:
    """(src, dst, w): every pair of a document, with multiplicity.

    Counted words are paired, not occurrences, so a document's pairs are as many as its distinct words allow.
    """
    bag = lambda c: F.transform(F.array_distinct(c), lambda w: F.struct(w.alias("w"), F.size(F.filter(c, lambda x: x == w)).alias("n")))
    pairs = docs.select(bag(F.col(left)).alias("l"), bag(F.col(right)).alias("r")).select(F.explode("l").alias("l"), "r").select("l", F.explode("r").alias("r"))
    return pairs.groupBy(F.col("l.w").alias("src"), F.col("r.w").alias("dst")).agg(F.sum(F.col("l.n") * F.col("r.n")).alias("w"))


def tagged(docs: DataFrame, key: str, text: str, tagger: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """(key, adjectives, nouns) by a tagger: tokens -> (adjectives, nouns).  The default goes by word endings, and stands in for a trained tagger."""
    words = strings.tokens(F.col(text))
    tagger = tagger or (lambda w: (F.filter(w, lambda x: x.rlike("(?:ed|ly|ish|ous|ive|al)$")), F.filter(w, lambda x: x.rlike("(?:ion|ness|ing|er|ment)$"))))
    adjectives, nouns = tagger(words)
    return docs.select(key, adjectives.alias("adjectives"), nouns.alias("nouns"))


def _grams(c: Column, n: int) -> Column:
    if n == 1:
        return c
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda k: k + n - 1 <= F.size(c)), lambda k: F.array_join(F.slice(c, k, n), " "))


def rouge_n(pairs: DataFrame, key: str, reference: str, candidate: str, n: int = 1) -> DataFrame:
    """(key, precision, recall, f1) of n-grams of token arrays, counts clipped; 0 where nothing overlaps."""
    side = lambda c, name: pairs.select(key, F.explode(_grams(F.col(c), n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))
    both = side(reference, "r").join(side(candidate, "c"), [key, "g"], "full")
    hit, r, c = F.sum(F.least(F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0)))), F.sum("r"), F.sum("c")
    s = both.groupBy(key).agg(hit.alias("h"), F.coalesce(r, F.lit(0)).alias("r"), F.coalesce(c, F.lit(0)).alias("c"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return s.select(key, zero(F.try_divide("h", "c")).alias("precision"), zero(F.try_divide("h", "r")).alias("recall"), zero(F.try_divide(2 * F.col("h"), F.col("r") + F.col("c"))).alias("f1"))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, in bit-parallel form: one integer operation a word of ``b``."""
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & where.get(w, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, precision, recall, f1) by longest common subsequence of token arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, r, c in zip(f.iloc[:, 0], f.iloc[:, 1], f.iloc[:, 2]):
                h = lcs(list(r), list(c)) if r is not None and c is not None else 0
                p, q = h / len(c) if h else 0.0, h / len(r) if h else 0.0
                out.append((k, p, q, 2 * p * q / (p + q) if h else 0.0))
            yield pd.DataFrame(out, columns=[key, "precision", "recall", "f1"])

    return pairs.select(key, reference, candidate).mapInPandas(run, f"{key} long, precision double, recall double, f1 double")


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """The Porter stem of a lower-case word, after the published description."""
    if len(w) <= 2:
        return w

    def shape(s: str) -> str:
        out = ""
        for k, ch in enumerate(s):
            vowel = ch in "aeiou" or (ch == "y" and k > 0 and out[k - 1] == "c")
            out += "v" if vowel else "c"
        return out

    def measure(s: str) -> int:
        f = shape(s)
        return sum(a == "v" and b == "c" for a, b in zip(f, f[1:]))

    vowel = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"
    cvc = lambda s: len(s) > 2 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    if measure(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def stemmed(docs: DataFrame, tokens: str, out: str = "stems") -> DataFrame:
    """Token arrays stemmed: distinct words are stemmed once a batch."""

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return col.map(lambda ws: None if ws is None else [known.setdefault(w, "") or known.__setitem__(w, porter(w)) or known[w] for w in ws])

    return docs.withColumn(out, run(F.col(tokens)))


def batches(items: DataFrame, group: str, order: str, size: str, budget: int, overhead: int = 0) -> DataFrame:
    """Items with ``batch``: a batch closes when what it holds, the item and the overhead pass the budget; null sizes count as 0.

    Where a batch closes depends on where it began, so a group is one sequence: sorted by Spark, which may spill, and walked
    through batch by batch with sums and binary search.  A task holds one Arrow batch at a time, whatever the group's size.
    """
    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, held = None, 0, 0
        for f in frames:
            if not f.num_rows:
                continue
            codes = pc.dictionary_encode(f.column(0), null_encoding="encode")
            code = codes.indices.to_numpy()
            sums = np.concatenate([[0], np.cumsum(f.column(2).to_numpy())])
            out = np.empty(f.num_rows, np.int32)
            edge = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [f.num_rows]])
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if (name := (codes.dictionary[int(code[a])].as_py(),)) != last:
                    last, number, held = name, 0, 0
                while a < z:
                    some = a if held > 0 else int(np.searchsorted(sums, sums[a] - held, side="right"))  # from here on something is held
                    full = int(np.searchsorted(sums[1:], budget - overhead - held + sums[a], side="right"))
                    stop = max(a, some, full)
                    if stop >= z:
                        out[a:z] = number
                        held += int(sums[z] - sums[a])
                        break
                    out[a:stop] = number
                    number, held, a = number + 1, int(sums[stop + 1] - sums[stop]), stop + 1
                    out[stop] = number
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(out)], names=["g", "o", "batch"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.repartition("g").sortWithinPartitions("g", "o").mapInArrow(run, f"g {kinds['g']}, o {kinds['o']}, batch int")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), "batch")


def state_lines(texts: DataFrame, key: str, text: str, markers: str) -> DataFrame:
    """(key, pos, line, marker): each line with the last line before it, or itself, that matches ``markers``; a blank line ends a section."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = F.nullif(F.regexp_extract("line", markers, 0), F.lit(""))
    mark = F.when(F.trim("line") == "", F.lit("")).otherwise(found)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("marker", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))

"""Operator 9: license scans with a positional rare-token index.

A license template is matched where its mandatory phrases all stand word for word and enough of its words (``COVER``) stand
in order, give or take words put in or left out, within a stretch of the template's length and a slack on either side.

The index holds, of each template's phrases, the one whose words are rarest over the whole table, and of that the ``RARE`` words
of the highest inverse document frequency, posted as (word, template, position).  A file's words that the index knows are
looked up and postings intersected by relative position (file's position less phrase's).  As a match must hold the phrase,
an alignment must have all its rare words: the index loses none.  Candidates are then verified: the other phrases, and the
longest common subsequence of template and stretch, found in bit-parallel form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lepidus.llm import _text
from lepidus.llm.templates import TEMPLATES

RARE = 4
COVER = 0.7


def slack(length: int) -> int:
    """Words by which a stretch may be longer than a template of ``length`` words, on either side."""
    return 2 + length // 5


def words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashed(raw, np.array([0, len(raw)]))[0]


def hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words: runs of letters and digits in lower case, text of each)."""
    data = _text.lower(data)
    s, e, doc = _text.tokens(data, at)
    word = _text.CLASSES[data[s]] == 1
    return _text.hashes(data, s[word], e[word]), doc[word]


def _common(masks: dict[int, int], n: int, stretch: list[int]) -> list[int]:
    """Longest common subsequence of a template of n words and the first 1, 2, ... words of a stretch."""
    full, out = (1 << n) - 1, []
    row = full
    for w in stretch:
        m = row & masks.get(w, 0)
        row = (row + m | row - m) & full
        out.append(n - row.bit_count())
    return out


def _masks(w: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(w):
        out[x] = out.get(x, 0) | 1 << k
    return out


def _starts(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase stands in h, word for word."""
    at = np.arange(len(h) - len(phrase) + 1)
    for k, w in enumerate(phrase):
        at = at[h[at + k] == w]
    return at


class Template:
    """A template's words, its phrases, and where each phrase stands in it (0 where it doesn't)."""

    def __init__(self, name: str, lines: tuple[str, ...], phrases: tuple[str, ...]) -> None:
        self.name, self.words, self.phrases = name, words(" ".join(lines)), [words(p) for p in phrases]
        at = [_starts(self.words, p) for p in self.phrases]
        self.at = [int(a[0]) if len(a) else 0 for a in at]
        w = self.words.tolist()
        self.masks, self.back = _masks(w), _masks(w[::-1])

    def key(self, idf: dict[int, float]) -> int:
        """The number of the phrase with the rarest words."""
        return max(range(len(self.phrases)), key=lambda k: (max(idf[int(w)] for w in self.phrases[k]), len(self.phrases[k]), -k))

    def match(self, h: np.ndarray, key: int, p: int) -> tuple[int, int, int] | None:
        """(start, words, words in order) of the match whose phrase ``key`` stands at p of the text h; its outermost words are common ones."""
        n = len(self.words)
        lo = max(0, p - self.at[key] - slack(n))
        part = h[lo : p - self.at[key] + n + slack(n)]
        if not all(len(_starts(part, x)) for x in self.phrases):
            return None
        own = part.tolist()
        ahead = _common(self.masks, n, own)
        same = ahead[-1]
        if same < COVER * n:
            return None
        stop = ahead.index(same) + 1
        start = stop - 1 - _common(self.back, n, own[:stop][::-1]).index(same)
        return lo + start, stop - start, same


def chosen(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of one license's matches (start, words, words in order), those with the most words in order; others that overlap them go."""
    taken: list[tuple[int, int, int]] = []
    for a, m, same in sorted(set(found), key=lambda x: (-x[2], x[1], x[0])):
        if all(a + m <= x or a >= x + y for x, y, _ in taken):
            taken.append((a, m, same))
    return sorted(taken)


class Index:
    def __init__(self, frequency: dict[int, int], n_docs: int, templates: tuple = TEMPLATES) -> None:
        idf = {w: float(np.log((n_docs + 1) / (n + 1))) for w, n in frequency.items()}
        self.templates = [Template(*t) for t in templates]
        self.keys = [t.key(idf) for t in self.templates]
        post = []
        for k, t in enumerate(self.templates):
            w = t.phrases[self.keys[k]]
            best = sorted(range(len(w)), key=lambda q: (-idf[int(w[q])], q))[:RARE]
            post += [(int(w[q]), k, q) for q in best]
        post.sort()
        self.word = np.array([p[0] for p in post], np.uint64)
        self.template, self.place = np.array([p[1] for p in post]), np.array([p[2] for p in post])
        self.need = np.bincount(self.template, minlength=len(self.templates))

    def scan(self, h: np.ndarray, doc: np.ndarray, n: int) -> list[tuple[int, str, int, int, int]]:
        """(text, license, start, words, words in order) of the matches."""
        lo = np.searchsorted(self.word, h, side="left")
        known = np.flatnonzero(self.word[np.minimum(lo, len(self.word) - 1)] == h)
        if not len(known):
            return []
        lo, count = lo[known], np.searchsorted(self.word, h[known], side="right") - lo[known]
        k = np.repeat(np.arange(len(known)), count)
        p = lo[k] + np.arange(len(k)) - (np.cumsum(count) - count)[k]
        at = known[k]
        start = at - self.place[p]
        first = np.searchsorted(doc, np.arange(n + 1))
        ok = start >= first[doc[at]]
        at, p, start = at[ok], p[ok], start[ok]
        # a template's postings each have a place of their own, so an alignment that has as many hits as postings has all
        key, hits = np.unique(np.stack([doc[at], self.template[p], start], axis=1), axis=0, return_counts=True)
        found: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
        for d, t, s in key[hits == self.need[key[:, 1]]].tolist():
            one, own = self.templates[t], h[first[d] : first[d + 1]]
            phrase = one.phrases[self.keys[t]]
            if np.array_equal(h[s : min(s + len(phrase), first[d + 1])], phrase) and (m := one.match(own, self.keys[t], s - int(first[d]))):
                found.setdefault((d, one.name), []).append(m)
        return sorted((d, name, *m) for (d, name), ms in found.items() for m in chosen(ms))


def frequencies(docs: DataFrame, templates: tuple = TEMPLATES) -> tuple[dict[int, int], int]:
    """({hash of a phrase's word: texts that have it}, texts), counted over every row."""
    vocabulary = np.unique(np.concatenate([words(p) for _, _, phrases in templates for p in phrases]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for b, data, at in _text.slices(batches, "text"):
            h, doc = hashed(data, at)
            k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            ok = vocabulary[k] == h
            pair = np.unique(doc[ok] * len(vocabulary) + k[ok])
            total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["w", "n"])

    got = {r.w: r.n for r in docs.select("text").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {int(v): got.get(k, 0) for k, v in enumerate(vocabulary)}, got.get(-1, 0)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, n_words, in_place) of every license notice in every text; positions are in words.

    ``in_place`` are the template's words that stand there in order.  Null and empty texts have none; a null doc_id stays
    null; repeated rows give repeated matches; other columns are ignored; an empty table gives no rows.  Of one license's
    matches that overlap, the one with the most words in order counts (then the shorter, then the first).
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(docs, templates), templates))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in _text.slices(batches, "text"):
            found = index.value.scan(*hashed(data, at), len(at) - 1)
            if found:
                d, name, start, n, same = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(name), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(same, pa.int32())], names=["doc_id", "license", "start", "n_words", "in_place"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, start int, n_words int, in_place int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of the documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

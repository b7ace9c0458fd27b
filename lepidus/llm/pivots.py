"""Operator 2: embedding near-dedup with a pivot-permutation index.

Pivots are a sample of the vectors, picked by a hash of their content, whose number grows with the square root of the table;
of pivots nearer to each other than ``APART`` one is kept, so a crowd has few however many were drawn from it.  Directions are
taken from the pivots' mean, so vectors in a narrow cone are told apart as well as those all around.

A vector is described by its nearest pivots in order of nearness.  The first is its home; the description goes on to the last
pivot that may be the home of a neighbour: those at least as near as a neighbour's home would be at the cosine asked for, less
``MARGIN`` standard deviations.  How many these are follows from the pivots around, not from a fixed number.  The inverted
list of a pivot holds all vectors that name it.  In a list those at home meet all others; pairs that share too few pivots
(``SHARE`` of the shorter description) are passed over, and the rest are verified by their exact cosine.

Equal vectors are one node with a weight, so copies are never paired with each other.  Vectors so near to their home's pivot
that any two of them must be neighbours (by the triangle inequality) are linked through sums, not pairs, so a crowd of near
copies costs no more than its size.  A list of more than ``LIST`` rows is dealt into blocks, each pair of blocks being a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lepidus.llm.shared import components, written

COSINE = 0.9
DENSITY = 8  # pivots are DENSITY * sqrt(rows)
APART = 0.8
MARGIN = 1.5  # either of a pair may find the other, so 0.99 of pairs at a cosine of just 0.9 are found
SHARE = 0.3  # neighbours share 0.7 or more of the shorter description in the driver's tables
LIST = 8192
BLOCK = 512
CELLS = 4_000_000  # entries of a matrix of similarities


def unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    norm = np.linalg.norm(wide, axis=1, keepdims=True)
    return np.divide(wide, norm, out=np.zeros_like(wide), where=norm > 0).astype(rows.dtype)


def matrix(column: pa.Array) -> np.ndarray:
    """float32[n, d] of a list column without nulls and of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def apart(pivots: np.ndarray, most: float = APART, block: int = 1024) -> np.ndarray:
    """The pivots, in order, that are less than ``most`` near to all that stay before them: their numbers."""
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(pivots), block):
        own = np.arange(lo, min(lo + block, len(pivots)))
        for k in range(0, len(kept), block):
            own = own[(pivots[own] @ pivots[kept[k : k + block]].T < most).all(axis=1)]
        near, fine = pivots[own] @ pivots[own].T >= most, np.ones(len(own), bool)
        for k in range(len(own)):
            if fine[k]:
                fine[k + 1 :] &= ~near[k, k + 1 :]
        kept = np.concatenate([kept, own[fine]])
    return kept


class Index:
    """Pivots as directions from their mean, numbered from ``base``, and how many dimensions they spread over (all, if evenly)."""

    def __init__(self, some: np.ndarray, base: int = 0) -> None:
        self.base, self.mean = base, some.mean(axis=0)
        from_mean = unit(some - self.mean)
        kept = apart(from_mean)
        self.pivots, self.raw = from_mean[kept], some[kept]
        spread = np.linalg.eigvalsh((self.pivots.T @ self.pivots).astype(np.float64))
        self.dims = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-12)))

    def posts(self, x: np.ndarray, cosine: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot) of unit vectors, each row's pivots nearest first, ties to the lower number; and whether a row is so near to its first that all such rows are neighbours."""
        w = x - self.mean
        s = unit(w) @ self.pivots.T
        a = s.max(axis=1)
        # the cosine of a pair as seen from the mean; at or below 0 any pivot may be a neighbour's home
        c = 1 - (1 - cosine) / np.maximum((w * w).sum(axis=1), 1e-12)
        floor = c * a - margin * np.sqrt(np.maximum(0, 1 - c * c) * np.maximum(0, 1 - a * a) / self.dims)
        floor = np.where((c <= 0) | (a <= 0), -2, np.minimum(floor, a))
        row, pivot = np.nonzero(s >= floor[:, None])
        order = np.lexsort((pivot, -s[row, pivot], row))
        row, pivot = row[order], pivot[order]
        home = pivot[np.searchsorted(row, np.arange(len(x)))]
        core = (x * self.raw[home]).sum(axis=1) >= sqrt((1 + cosine) / 2) + 1e-5
        return row, (pivot + self.base).astype(np.int32), core


def nodes(vectors: DataFrame) -> DataFrame:
    """(node, v, id, w, h0, h1) of the distinct vectors that can be compared: how many rows have it, the least id, and a hash of 128 bits."""
    good = keyed(vectors).where("h0 is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    return good.select(F.monotonically_increasing_id().alias("node"), "v", "id", "w", F.xxhash64("v").alias("h0"), F.xxhash64("v", F.lit(1)).alias("h1"))


def keyed(vectors: DataFrame) -> DataFrame:
    """(id, v, h0, h1) of every row; the hashes are null where the row can't be compared: no id, no vector, nulls, NaN or infinity in it, or all zeros."""
    v = F.transform(F.col("embedding").cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))  # -0 is 0
    rows = vectors.select(F.col("vec_id").alias("id"), v.alias("v"))
    inf = F.lit(float("inf")).cast("float")
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return rows.select("id", "v", F.when(fine, F.xxhash64("v")).alias("h0"), F.when(fine, F.xxhash64("v", F.lit(1))).alias("h1"))


def indexes(found: DataFrame, density: int) -> dict[int, Index]:
    """An index for each length of vectors; the sample is taken by hash, at a rate that gives about ``density`` times the root of their number."""
    sizes = {r.d: r.n for r in found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    rates = {d: min(1.0, max(64, density * isqrt(n)) / n) for d, n in sizes.items()}
    if not rates:
        return {}
    limit = F.create_map(*[F.lit(x) for d, r in rates.items() for x in (d, int(r * (1 << 32)))])
    some = found.where(F.pmod(F.xxhash64("v", F.lit(2)), F.lit(1 << 32)) < limit[F.size("v")]).orderBy(F.xxhash64("v", F.lit(2)), "node").select("v").toArrow()["v"].combine_chunks()
    lengths, out, base = some.value_lengths().to_numpy(), {}, 0
    for d in sorted(sizes):
        own = some.filter(pa.array(lengths == d))
        if not len(own):  # a sample may miss a length that has few rows
            own = found.where(F.size("v") == d).select("v").limit(64).toArrow()["v"].combine_chunks()
        out[d] = Index(unit(matrix(own)), base)
        base += len(out[d].pivots)
    return out


def _merge(parent: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
    """Join the sets of r[k] and s[k]; ``parent`` points at each one's least member."""
    while True:
        a, b = parent[r], parent[s]
        apart_ = a != b
        if not apart_.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart_], np.minimum(a, b)[apart_])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _compare(t: pa.Table, cosine: float, share: float) -> pa.RecordBatch:
    """(node, links, root) of one list, or of one pair of its blocks: how many rows each node is linked to here, and a node of its set."""
    col = lambda c: t.column(c).to_numpy()
    pivot, a, b = (int(t.column(c)[0].as_py()) for c in ("pivot", "a", "b"))
    kind, lab = col("kind"), col("lab")
    order = np.lexsort((kind, lab))
    t = t.take(pa.array(order))
    node, w, home, kind, lab = col("node"), col("w").astype(np.float64), col("home"), kind[order], lab[order]
    raw = matrix(t.column("v").combine_chunks())
    x = unit(raw)
    posts = t.column("posts").combine_chunks()
    size = posts.value_lengths().to_numpy().astype(np.int64)
    flat, owner = posts.flatten().to_numpy(), np.repeat(np.arange(len(node)), size)
    left = np.flatnonzero((kind < 2) & (lab == a))
    right = np.arange(len(node)) if a == b else np.flatnonzero(lab == b)
    # pivots that rows at home name; what others name beyond these isn't shared
    at_home = np.isin(owner, left)
    some, links, parent = np.unique(flat[at_home]), np.zeros(len(node)), np.arange(len(node))
    named = np.sort(owner[at_home] << 32 | flat[at_home])

    def marks(rows: np.ndarray) -> np.ndarray:
        m = np.zeros((len(rows), len(some)), np.float32)
        own = np.flatnonzero(np.isin(owner, rows))
        k = np.minimum(np.searchsorted(some, flat[own]), len(some) - 1)
        hit = some[k] == flat[own]
        m[np.searchsorted(rows, owner[own][hit]), k[hit]] = 1
        return m

    step = int(max(1, min(BLOCK, CELLS // max(1, len(some)))))
    for lo in range(0, len(left), step):
        i = left[lo : lo + step]
        mi = marks(i)
        for at in range(0, len(right), step):
            j = right[at : at + step]
            if a == b and j[-1] <= i[0]:
                continue
            need = np.ceil(share * np.minimum(size[i][:, None], size[j][None]))
            fine = mi @ marks(j).T >= np.maximum(need, 1)
            if a == b:
                fine &= (j[None] > i[:, None]) & ((kind[i] == 0)[:, None] | (kind[j] != 1)[None])
            fine &= x[i] @ x[j].T >= cosine - 1e-5
            r, s = np.nonzero(fine)
            r, s = i[r], j[s]
            # a pair that both homes' lists have counts in the list of the lower home
            both = np.flatnonzero((kind[s] == 2) & (home[s] < pivot))
            if len(both):
                key = r[both] << 32 | home[s[both]]
                seen = named[np.minimum(np.searchsorted(named, key), len(named) - 1)] == key
                r, s = np.delete(r, both[seen]), np.delete(s, both[seen])
            for k in range(0, len(r), 1 << 15):
                p, q = r[k : k + (1 << 15)], s[k : k + (1 << 15)]
                u, v = raw[p].astype(np.float64), raw[q].astype(np.float64)
                exact = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))) >= cosine
                p, q = p[exact], q[exact]
                links += np.bincount(p, w[q], len(node)) + np.bincount(q, w[p], len(node))
                _merge(parent, p, q)
    got = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got].astype(np.int64)), pa.array(node[parent[got]])], names=["node", "links", "root"])


def linked(found: DataFrame, cosine: float = COSINE, margin: float = MARGIN, density: int = DENSITY, share: float = SHARE, most: int = LIST) -> DataFrame:
    """(node, links, root) of nodes (node, v, w): parts, to be summed by node; roots are edges of the graph of neighbours that connect all its classes."""
    spark = found.sparkSession
    index = spark.sparkContext.broadcast(indexes(found, density))  # pivots: 8 times the square root of the rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths):
                own = whole.filter(pa.array(lengths == d))
                ix = index.value[int(d)]
                step = max(1, min(BLOCK, CELLS // len(ix.pivots)))
                for lo in range(0, own.num_rows, step):
                    b = own.slice(lo, step)
                    row, pivot, core = ix.posts(unit(matrix(b.column(1))), cosine, margin)
                    at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot[at[:-1]]), pa.array(core), pa.ListArray.from_arrays(pa.array(at), pa.array(pivot))], names=["node", "v", "w", "home", "core", "posts"])

    told = written(found.select("node", "v", "w").mapInArrow(describe, "node long, v array<float>, w long, home int, core boolean, posts array<int>"), "described")
    own = F.col("p") == F.col("home")
    near = told.select(F.explode("posts").alias("p"), "home", "core", "w", "node").groupBy("p")
    lists = near.agg(F.count_if(own & ~F.col("core")).alias("n0"), F.count_if(own & F.col("core")).alias("n1"), F.count_if(~own).alias("n2"), F.sum(F.when(own & F.col("core"), F.col("w"))).alias("cw"), F.min(F.when(own & F.col("core"), F.col("node"))).alias("rep"))
    lists = written(lists, "lists")
    long = {r.p: tuple(-(-n // most) for n in (r.n0, r.n1, r.n2)) for r in lists.where(F.col("n0") + F.col("n1") + F.col("n2") > most).collect()}
    numbers = np.array(sorted(long), np.int64)
    blocks = spark.sparkContext.broadcast((numbers, np.array([long[p] for p in numbers.tolist()], np.int64).reshape(-1, 3)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, parts = blocks.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                posts = b.column(5)
                row = np.repeat(np.arange(b.num_rows), posts.value_lengths().to_numpy())
                pivot = posts.flatten().to_numpy().astype(np.int64)
                home, core, node = b.column(3).to_numpy()[row], b.column(4).to_numpy(zero_copy_only=False)[row], b.column(0).to_numpy()[row]
                kind = np.where(home != pivot, 2, core.astype(np.int64))
                # blocks are numbered: rows at home, those of the core, visitors; two of the core need not meet, nor two visitors
                k = np.minimum(np.searchsorted(hot, pivot), max(len(hot) - 1, 0))
                split = hot[k] == pivot if len(hot) else np.zeros(len(pivot), bool)
                n = np.where(split[:, None], parts[k], [1, 0, 0]) if len(hot) else np.tile([1, 0, 0], (len(pivot), 1))
                first = np.concatenate([np.zeros((len(n), 1), np.int64), np.cumsum(n, axis=1)], axis=1)
                i = np.arange(len(pivot))
                slot = np.where(split, kind, 0)
                spread = (node * 0x9E3779B1 >> 16) & 0x7FFFFFFF
                lab = first[i, slot] + spread % np.maximum(n[i, slot], 1)
                partners = np.where(slot == 0, first[:, 3], np.where(slot == 1, n[:, 0] + n[:, 2], n[:, 0] + n[:, 1]))
                j = np.repeat(i, partners)
                other = np.arange(len(j)) - np.repeat(np.cumsum(partners) - partners, partners)
                other = np.where((slot[j] == 1) & (other >= n[j, 0]), other + n[j, 1], other)
                for z in range(0, len(j), 8192):
                    q, o = j[z : z + 8192], other[z : z + 8192]
                    t = b.take(pa.array(row[q]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pivot[q].astype(np.int32)), pa.array(np.minimum(lab[q], o)), pa.array(np.maximum(lab[q], o)), pa.array(lab[q]), pa.array(kind[q].astype(np.int32)), t.column(0), t.column(1), t.column(2), t.column(3), t.column(5)],
                        names=["pivot", "a", "b", "lab", "kind", "node", "v", "w", "home", "posts"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _compare(pa.Table.from_batches(list(batches)), cosine, share)

    posted = told.mapInArrow(post, "pivot int, a long, b long, lab long, kind int, node long, v array<float>, w long, home int, posts array<int>")
    met = posted.groupBy("pivot", "a", "b").applyInArrow(compare, "node long, links long, root long")
    core = told.where("core").join(lists, F.col("home") == F.col("p")).select("node", (F.col("cw") - F.col("w")).alias("links"), F.col("rep").alias("root"))
    return met.unionByName(core)


def classes(vectors: DataFrame, cosine: float = COSINE, margin: float = MARGIN, density: int = DENSITY, share: float = SHARE, most: int = LIST) -> DataFrame:
    """(vec_id, class_id, links) of every row: the least id of its class, and how many other rows are at ``cosine`` to it or nearer.

    A class is a connected component of such links.  Copies (rows with equal vectors) are in one class and count as links.
    Rows that keyed() can't compare have no links and are their own class (null ids stay null).  Vectors of different lengths
    are never neighbours.  Each of the rows of one id is a row of its own.  Other columns are ignored; an empty table gives no
    rows.
    """
    found = written(nodes(vectors), "vectors")
    parts = written(linked(found, cosine, margin, density, share, most), "links")
    root = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    named = found.select("node", "id", "w", "h0", "h1").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    each = named.join(least, "root").join(links, "node", "left").select("h0", "h1", "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    rows = keyed(vectors).select(F.col("id").alias("vec_id"), "h0", "h1")
    return rows.join(each, ["h0", "h1"], "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


#: All pairs compared; the search finds nearly all of them.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
 reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT p.b, root FROM reach JOIN p ON p.a = id)
 SELECT vec_id, class_id, coalesce(links, 0) AS links FROM v JOIN (SELECT id AS vec_id, min(root) AS class_id FROM reach GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS links FROM p GROUP BY 1) USING (vec_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class and its number of links."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

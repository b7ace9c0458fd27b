"""Operator 4: SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 128 bits: the signs of the sums of its distinct words' hashed bits, words of 4 bytes or more
counting twice.  Two texts are near copies if their fingerprints differ in at most ``TAU`` bits, and a group is a connected
component of such pairs.

The search is exact.  By the pigeonhole principle a pair within TAU has one of the 8 segments of 16 bits within that segment's
budget, budgets being whole numbers of which each, raised by one, make TAU + 1 together (``budgets``): rows meet that are equal in
a segment, or whose segments differ by a mask of at most as many bits.  The pigeonring principle says more: some such segment
has all its chains of l segments within their budgets' sum plus l - 1, so of the rows that meet only those pass whose chain of
half the ring, one word, is within that; then come the chains of 1 to ``FILTER`` of the 32 segments of 4 bits, each within
l * TAU / 32 bits, and the full Hamming check.  No true pair is lost by any of these.

Fingerprints are dealt into blocks and every pair of blocks is one task, so there is no bucket to cap.  Rows equal in a segment
are searched first, long runs breadth first.  Rows of one group of more than ``_LONG_RUN`` aren't compared with each other again,
so such a crowd of near copies isn't expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lepidus.llm import _text
from lepidus.llm.shared import components, numbered, written

TAU = 24
SEGMENTS = 32
CHAIN = 4  # segments in a key
KEYS = SEGMENTS // CHAIN
BLOCK = 1 << 20  # fingerprints that one side of a task holds at most
FILTER = 8  # segments to which the chains are followed
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_FIVES, _THREES, _LOW_HALF, _HIGH_BITS = (np.uint64(k * 0x0101010101010101) for k in (0x55, 0x33, 0x0F, 0x80))
_LONG_RUN = 64
_ROWS = 1 << 16  # rows looked at in one step


def fingerprints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint64[n, 2], whether the text has words).  Where a text has only signs, its runs of signs are its words."""
    n = len(at) - 1
    data = _text.lower(data)
    s, e, doc = _text.tokens(data, at)
    word = _text.CLASSES[data[s]] == 1
    word |= (np.bincount(doc[word], minlength=n) == 0)[doc]
    s, e, doc = s[word], e[word], doc[word]
    h = _text.hashes(data, s, e)
    key = (doc.astype(np.uint64) << np.uint64(47)) | ((h >> np.uint64(18)) << np.uint64(1)) | (e - s > 3).astype(np.uint64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    doc = (key >> np.uint64(47)).astype(np.int64)
    long = (key & np.uint64(1)) == 1
    h = key & np.uint64((1 << 47) - 1)
    h, doc = np.concatenate([h, h[long]]), np.concatenate([doc, doc[long]])
    raw = np.stack([_text.mix(h, 11), _text.mix(h, 12)], axis=1).view(np.uint8)
    base, total = doc * 256, np.bincount(doc, minlength=n)[:, None]
    bits = np.empty((n, 128), bool)
    for k in range(16):
        ones = np.bincount(base + raw[:, k], minlength=256 * n).reshape(n, 256) @ _BITS
        bits[:, 8 * k : 8 * k + 8] = 2 * ones > total
    return np.packbits(bits, axis=1).view(np.uint64), total[:, 0] > 0


def _halves(b: np.ndarray) -> np.ndarray:
    """uint8[n, 16] as its 32 segments."""
    return np.stack([b >> 4, b & 15], axis=2).reshape(len(b), SEGMENTS)


def keys(fp: np.ndarray) -> np.ndarray:
    """int64[n, KEYS]: the chains of ``CHAIN`` segments, end to end."""
    return fp.view(">u2").astype(np.int64)


def budgets(tau: int = TAU) -> list[int]:
    """Bits in which each key may differ: a pair within ``tau`` has one within its budget (-1: that key isn't needed)."""
    each, more = divmod(tau - KEYS + 1, KEYS)
    return [each + (k < more) for k in range(KEYS)]


@cache
def _masks(bits: int) -> np.ndarray:
    """The differences of keys that aren't equal and differ in at most ``bits`` bits."""
    x = np.arange(1, 1 << 4 * CHAIN)
    return x[np.bitwise_count(x) <= bits]


def _nibbles(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ones in each segment, a byte each: the even segments and the odd ones, each as the two words of their 16 bytes."""
    even, odd = [], []
    for k in (0, 1):
        v = np.ascontiguousarray(x[:, k])
        v = v - ((v >> np.uint64(1)) & _FIVES)
        v = (v & _THREES) + ((v >> np.uint64(2)) & _THREES)
        even.append((v >> np.uint64(4)) & _LOW_HALF)
        odd.append(v & _LOW_HALF)
    return even, odd


def _next(w: list[np.ndarray]) -> list[np.ndarray]:
    """The 16 bytes of two words turned by one."""
    return [(w[k] >> np.uint64(8)) | (w[1 - k] << np.uint64(56)) for k in (0, 1)]


def chained(x: np.ndarray, tau: int = TAU, follow: int = FILTER) -> np.ndarray:
    """Of XORed fingerprints uint64[n, 2]: whether some start has all its chains of 1 to ``follow`` segments within budget.

    Eight starts are followed in one word, a byte each: a sum beyond its budget sets the byte's high bit.
    """
    if len(x) > 4096:  # what the processor's cache holds
        return np.concatenate([chained(x[k : k + 4096], tau, follow) for k in range(0, len(x), 4096)])
    even, odd = _nibbles(x)
    out = np.zeros(len(x), bool)
    for now, after in ((even, odd), (odd, _next(even))):
        total, over = [np.zeros_like(w) for w in now], [np.zeros_like(w) for w in now]
        for k in range(follow):
            slack = np.uint64((127 - (k + 1) * tau // SEGMENTS) * 0x0101010101010101)
            for j in (0, 1):
                total[j] += now[j]
                over[j] |= total[j] + slack
            now, after = after, _next(now)
        for w in over:
            out |= (w & _HIGH_BITS) != _HIGH_BITS
    return out


def near(x: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Of XORed fingerprints: whether at most ``tau`` bits differ, chains first."""
    out = chained(x, tau)
    out[out] = np.bitwise_count(x[out]).sum(axis=1) <= tau
    return out


def _forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of one run: from each one reached, all not yet reached are looked at."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            hit = np.concatenate([near(fp[rest[lo : lo + (1 << 16)]] ^ fp[i], tau) for lo in range(0, len(rest), 1 << 16)])
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                a.append(np.full(len(new), i))
                b.append(new)
                reached.extend(new.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _linked(key: np.ndarray, node: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of sorted keys, whole runs."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    small = np.repeat((size > 1) & (size <= _LONG_RUN), size)
    at = np.flatnonzero(small)
    for step in range(1, min(_LONG_RUN, int(size.max(initial=1)))):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 18):
            i = at[lo : lo + (1 << 18)]
            ok = i[near(fp[i] ^ fp[i + step], tau)]
            a.append(node[ok])
            b.append(node[ok + step])
    for k in np.flatnonzero(size > _LONG_RUN):
        i, j = _forest(fp[start[k] : start[k] + size[k]], tau)
        a.append(node[start[k] + i])
        b.append(node[start[k] + j])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row's least row of its group, when a[k] and b[k] are linked besides what ``label`` has."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def grouped(fp: np.ndarray, side: np.ndarray | None = None, tau: int = TAU) -> np.ndarray:
    """Of distinct fingerprints: each one's least row of its group.

    With ``side`` (0 or 1 a row), pairs of one side may be passed over: other tasks look at them.
    """
    n = len(fp)
    key, label, all_rows = keys(fp), np.arange(n), np.arange(n)
    for k in range(KEYS):
        order = np.argsort(key[:, k], kind="stable")
        label = _labels(label, *_linked(key[order, k], order, fp[order], tau))
    near_in, ring = budgets(tau), np.tile(fp.view(np.uint8), 2)
    mine, others = (all_rows, all_rows) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for k in range(KEYS):
        masks = _masks(near_in[k]).astype(np.int32)
        if not len(masks):
            continue
        half = np.ascontiguousarray(ring[:, 2 * k : 2 * k + 8]).view(np.uint64)[:, 0]
        most = sum(near_in[(k + j) % KEYS] for j in range(KEYS // 2)) + KEYS // 2 - 1
        met = others[np.argsort(key[others, k], kind="stable")]
        size = np.bincount(key[met, k], minlength=1 << 4 * CHAIN)
        start = np.cumsum(size) - size
        # cells of equal keys, each crowd's its own, the largest first
        crowd = np.where(np.bincount(label, minlength=n)[label] > _LONG_RUN, label, -1)
        rows = mine[np.lexsort((crowd[mine], key[mine, k]))]
        edge = np.flatnonzero(np.concatenate([[True], (key[rows[1:], k] != key[rows[:-1], k]) | (crowd[rows[1:]] != crowd[rows[:-1]])])[: len(rows)])
        count = np.diff(np.append(edge, len(rows)))
        large = np.argsort(-count, kind="stable")
        edge, count = edge[large], count[large]
        value, own = key[rows[edge], k].astype(np.int32), crowd[rows[edge]]
        a, b, found = [], [], 0
        step = max(1, 4 * _ROWS // len(masks))
        for lo in range(0, len(edge), step):
            to = value[lo : lo + step, None] ^ masks
            many = size[to]
            if side is None:
                many[to < value[lo : lo + step, None]] = 0  # met from the other cell
            total = np.cumsum(many.sum(axis=1))
            first = 0
            while first < len(total):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _ROWS, side="right")))
                some = np.nonzero(many[first:last])
                width = many[first:last][some]
                j = met[_ranges(start[to[first:last][some]], width)]
                cell = np.repeat(some[0] + lo + first, width)
                first = last
                if (own[cell] >= 0).any():
                    new = (own[cell] < 0) | (crowd[j] != own[cell])
                    j, cell = j[new], cell[new]
                if not len(j):
                    continue
                at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                cell, width = cell[at], np.diff(np.append(at, len(j)))
                end, word = np.cumsum(width), half[j]
                for turn in range(int(count[cell[0]])):
                    cells = int(np.searchsorted(-count[cell], -turn))  # those that have so many rows
                    i = rows[edge[cell[:cells]] + turn]
                    hit = np.flatnonzero(np.bitwise_count(word[: end[cells - 1]] ^ np.repeat(half[i], width[:cells])) <= most)
                    if len(hit):
                        i, hit = i[np.searchsorted(end, hit, side="right")], j[hit]
                        ok = np.bitwise_count(fp[i] ^ fp[hit]).sum(axis=1) <= tau
                        a.append(i[ok])
                        b.append(hit[ok])
                        found += len(a[-1])
                        if found > 1 << 20:
                            a, b, found = *_tree(n, a, b), 0
        if a:
            label = _labels(label, np.concatenate(a), np.concatenate(b))
    return label


def _tree(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Fewer links of the same groups."""
    label = _labels(np.arange(n), np.concatenate(a), np.concatenate(b))
    rest = np.flatnonzero(label != np.arange(n))
    return [rest], [label[rest]]


def fingerprinted(docs: DataFrame, f0: str = "f0", f1: str = "f1") -> DataFrame:
    """``docs`` with the halves of each text's fingerprint; null where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in _text.slices(batches, "text", rows=4096):
            fp, some = fingerprints(data, at)
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp[:, 0], mask=~some), pa.array(fp[:, 1], mask=~some)], names=[*b.schema.names, f0, f1])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(f0, "long").add(f1, "long"))


def table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(id, row, f0, f1) of every row with at least one word and an id, or else a number of its own in the column ``row``."""
    number = F.col(row) if row else F.lit(None).cast("long")
    mine = docs.select("doc_id", "text", number.alias("row")).where("doc_id is not null or row is not null")
    return fingerprinted(mine).where("f0 is not null").select(F.col("doc_id").alias("id"), "row", "f0", "f1")


def blocks(n: int) -> int:
    """Blocks into which n fingerprints are dealt: at most ``BLOCK`` each, and up to 8 where that leaves 2**16 to each."""
    return max(1, -(-n // BLOCK), min(8, -(-n // (1 << 16))))


def pairs(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): links of the nodes of ``prints`` (node, f0, f1) that join all pairs within ``tau``, and no others, into groups."""
    n = blocks(prints.count())
    tasks = [(x, y) for x in range(n) for y in range(x, n)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [np.array([k for k, t in enumerate(tasks) if x in t]) for x in range(n)]
        for b in batches:
            block = (_text.mix(b.column(0).to_numpy().view(np.uint64), 5) % np.uint64(n)).astype(np.int64)
            for x in range(n):
                i = np.flatnonzero(block == x)
                for task in of[x].tolist():
                    side = pa.array(np.full(len(i), tasks[task][0] != x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), task, np.int32)), side, *b.take(pa.array(i)).columns], names=["task", "side", "node", "f0", "f1"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        all_tasks, *columns = (pa.chunked_array([b.column(k) for b in held]).to_numpy() for k in range(5))
        for task in np.unique(all_tasks).tolist():
            side, node, f0, f1 = (c[all_tasks == task] for c in columns)
            alone = tasks[task][0] == tasks[task][1]
            label = grouped(np.stack([f0, f1], axis=1).view(np.uint64), None if alone else side.astype(np.int8), tau)
            rest = np.flatnonzero(label != np.arange(len(label)))
            a, b = node[rest], node[label[rest]]
            for lo in range(0, len(a), _ROWS):
                x, y = a[lo : lo + _ROWS], b[lo : lo + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = prints.mapInArrow(deal, "task int, side boolean, node long, f0 long, f1 long")
    return dealt.repartitionById(len(tasks), F.col("task")).mapInArrow(meet, "a long, b long").distinct()


def copies(docs: DataFrame, tau: int = TAU, row: str | None = None) -> DataFrame:
    """(id, row, f0, f1, keep_id) of every text of table() that isn't its group's first; keep_id is the first's doc_id.

    First are those with an id, by (doc_id, fingerprint), then those without, by (row, fingerprint).
    """
    prints = written(table(docs, row), "prints")
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("least")
    nodes = prints.groupBy("f0", "f1").agg(least).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    root = components(pairs(nodes.select("node", "f0", "f1"), tau))
    named = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct("least", "f0", "f1")).alias("first"))
    each = named.join(first, "root").select("f0", "f1", F.col("first.least.id").alias("id0"), F.col("first.least.row").alias("row0"), F.col("first.f0").alias("f2"), F.col("first.f1").alias("f3"))
    gone = prints.join(each, ["f0", "f1"]).where("not (id <=> id0 and row <=> row0 and f0 = f2 and f1 = f3)")
    return gone.select("id", "row", "f0", "f1", F.col("id0").alias("keep_id")).distinct()


def groups(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, keep_id) of every document that is a near copy of another and isn't its group's least id, keep_id.

    Null ids (stage() groups their rows too) and texts without words (null, empty, only blanks) are in no group.  Repeated
    rows (same id, same words) are one document; rows of one doc_id with different texts are grouped each by its own text, and such a doc_id
    has a row for every group in which it isn't the least.  Texts with the same words have the same fingerprint and are one
    node of the search, however many they are.  Other columns are ignored; an empty table gives no rows.
    """
    return copies(docs, tau).where("id <> keep_id").select(F.col("id").alias("doc_id"), "keep_id").distinct()


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: one document of each group stays.

    A row goes or stays by its own text, whatever other rows its doc_id has.  A row without an id is a document of its own: it
    goes if its group has one with an id, or an earlier one without.  Rows that are in no group stay, null and blank texts among
    them; of several texts of one doc_id in one group one stays, and repeated rows of it stay repeated.
    """
    row = _text.fresh(docs.columns, "row")
    all_ = numbered(docs, row)
    f0, f1 = (_text.fresh(all_.columns, f) for f in ("f0", "f1"))
    gone = copies(all_, row=row).select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), F.col("f0").alias("gone_0"), F.col("f1").alias("gone_1"))
    mine = fingerprinted(all_, f0, f1)
    same = mine["doc_id"].eqNullSafe(gone["gone_id"]) & mine[row].eqNullSafe(gone["gone_row"]) & (mine[f0] == gone["gone_0"]) & (mine[f1] == gone["gone_1"])
    return mine.join(gone, same, "left_anti").drop(row, f0, f1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy, with the document that stays for its group."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

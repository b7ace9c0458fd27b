"""Operator 3: byte-pair encoding and decoding.

Encoding backtracks over longest matches: an Aho-Corasick automaton over the vocabulary finds the longest token at every
position of a piece in one pass; tokens are taken greedily, and one is kept only if it is compatible with the one before,
that is, if merging by rank the bytes of both leaves that boundary standing.  Otherwise its longest proper prefix that is a
token is tried, and where none is left the position is marked dead and the token before it is shortened.  Every position dies
at most once, so the work is linear, and the result is exactly what merging by rank gives.  Decoding gathers bytes through a
table of offsets into all tokens' bytes laid end to end.

Pieces are what the vocabulary's pattern splits a text into; the ids of pieces seen are remembered by each worker (bounded).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lepidus.llm import _text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 600_000
LONG = 64
MOST = 2_000_000


class Bpe:
    """``ranks`` maps a token's bytes to its id, which is also its merge rank; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pieces = regex.compile(pattern).findall
        names = {t.decode("latin-1"): i for t, i in ranks.items()}
        size = max(names.values()) + 1
        self.size = [0] * size
        self.prefix = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.match = ahocorasick.Automaton()
        laid, at = [b""] * size, np.zeros(size + 1, np.int64)
        for name, i in sorted(names.items(), key=lambda x: x[1]):
            self.size[i] = len(name)
            laid[i] = name.encode("latin-1")
            self.match.add_word(name, (i, len(name)))
            for cut in range(len(name) - 1, 0, -1):
                a = names.get(name[:cut])
                if a is None:
                    continue
                if self.prefix[i] < 0:
                    self.prefix[i] = a
                b = names.get(name[cut:])
                if b is not None and a < i and b < i and self.left[i] == i and self._compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a << 32 | b] = i
        self.match.make_automaton()
        self.compatible.clear()
        np.cumsum(self.size, out=at[1:])
        self.at, self.laid = at, np.frombuffer(b"".join(laid), np.uint8)
        self.whole = {n: np.int32(i).tobytes() for n, i in names.items()}
        self.seen = _Seen(self)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a merge by rank of both tokens' bytes ends in a and b, following the splits on either side of the boundary."""
        limit = 1 << 40
        merged, left, right = self.merged, self.left, self.right
        while True:
            both = merged.get(a << 32 | b)
            if both is not None and both < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        w = piece.decode("latin-1")
        n = len(w)
        if not n:
            return []
        longest = [0] * n
        for end, (i, m) in self.match.iter(w):
            longest[end - m + 1] = i
        live, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        size, known = self.size, self.compatible
        while True:
            end = at + size[token]
            if live[end]:
                if out:
                    pair = out[-1] << 32 | token
                    fine = known.get(pair)
                    if fine is None:
                        if len(known) > 2_000_000:
                            known.clear()
                        fine = known[pair] = self._compatible(out[-1], token)
                else:
                    fine = True
                if fine:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end]
                    continue
            shorter = self.prefix[token]
            if shorter < 0:
                live[at] = 0
                token = out.pop()
                at -= size[token]
            else:
                token = shorter

    def encode(self, text: str) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return np.frombuffer(b"".join(map(self.seen.__getitem__, self.pieces(text))), np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, how many of them each id gave)."""
        size = self.at[ids + 1] - self.at[ids]
        start = np.cumsum(size) - size
        return self.laid[np.repeat(self.at[ids] - start, size) + np.arange(int(size.sum()))], size


class _Seen(dict):
    """piece -> its ids' bytes."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        got = self.bpe.whole.get(raw.decode("latin-1"))
        if got is None:
            got = np.array(self.bpe.encode_piece(raw), np.int32).tobytes()
        if len(piece) <= LONG:
            self[piece] = got
        return got


def read(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(frozen=True)
class Vocabulary:
    """What the driver broadcasts: ranks of at most ``MOST`` tokens, and a digest of all of them by which workers know their coder."""

    ranks: dict[bytes, int]
    digest: str

    @staticmethod
    def of(ranks: dict[bytes, int]) -> Vocabulary:
        if len(ranks) > MOST:
            raise ValueError(f"a vocabulary of {len(ranks)} tokens; at most {MOST} are broadcast")
        h = hashlib.blake2b()
        for t, i in sorted(ranks.items()):
            h.update(len(t).to_bytes(4, "little") + t + i.to_bytes(8, "little"))
        return Vocabulary(ranks, h.hexdigest())


_made: dict[str, Bpe] = {}


def coder(vocabulary: Vocabulary) -> Bpe:
    """The coder of a vocabulary, made once a worker."""
    if vocabulary.digest not in _made:
        _made.clear()
        _made[vocabulary.digest] = Bpe(vocabulary.ranks)
    return _made[vocabulary.digest]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every row: the ids of the whole text, and whether decoding them gives it back.

    A null text has null ids and n_tokens and is exact; an empty one has an empty list.  A null doc_id stays null; repeated
    rows are encoded alike; other columns are ignored.  ``vocabulary`` is a file of lines "base64 rank", read by the driver and
    broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(read(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lepidus.llm import bpe as here  # the module's own memory, not a pickled copy

        own = here.coder(ranks.value)
        for b, data, at in _text.slices(batches, "text"):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            got = [own.encode(t) if t else np.zeros(0, np.int32) for t in texts]
            n = np.array([len(g) for g in got], np.int64)
            ids = np.concatenate(got)
            back, size = own.decode(ids)
            if len(back) == len(data) and np.array_equal(back, data):
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
                exact = np.diff(ends) == np.diff(at)
            else:
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
                exact = np.array([back[ends[k] : ends[k + 1]].tobytes() == data[at[k] : at[k + 1]].tobytes() for k in range(len(n))])
            null = np.array([t is None for t in texts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.int32(), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(n.astype(np.int32), mask=null), pa.array(exact)], names=["doc_id", "ids", "n_tokens", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, exact boolean")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse of encode().  Null ids give a null text; bytes that aren't UTF-8, as a cut list of ids may end with, are replaced."""
    ranks = tokens.sparkSession.sparkContext.broadcast(Vocabulary.of(read(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lepidus.llm import bpe as here

        own = here.coder(ranks.value)
        for b in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the vocabulary, and whether decoding gives its text back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Vectorised text primitives shared by the operators: Arrow string buffers in, numpy arrays out.

Texts are handled as UTF-8 bytes.  Work goes through in slices of about ``CHUNK`` bytes, so that memory doesn't follow
the size of an Arrow batch; a text longer than that is a slice of its own and is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
LONG = 256
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: 0 blank, 1 letter, digit or any byte of a non-ASCII character, 2 anything else
CLASSES = np.full(256, 2, np.uint8)
CLASSES[:33] = 0
CLASSES[127] = 0
CLASSES[48:58] = CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = CLASSES[ord("_")] = 1
#: 0 blank, 1 all else: words as white space divides them
BLANKS = (CLASSES > 0).astype(np.uint8)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_P, _PI)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK, rows: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``limit`` bytes of ``column``: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, min(first + rows, int(np.searchsorted(at, at[first] + limit, side="right")) - 1))
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def tokens(data: np.ndarray, at: np.ndarray, classes: np.ndarray = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text's number) of each maximal run of bytes of one class other than 0."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[at] = True
    b = np.flatnonzero(edge)
    keep = kind[b[:-1]] != 0
    s, e = b[:-1][keep], b[1:][keep]
    return s, e, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(s, at)))


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _LOW[data]


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(start, end) -> a 64-bit hash of each data[start:end]; equal bytes give equal hashes, wherever they stand.

    A polynomial modulo 2**64 can be made to collide by texts of 1024 bytes or more, so runs of over ``LONG`` bytes get a
    cryptographic digest instead.
    """
    n = len(data)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])

    def of(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        for k in np.flatnonzero(e - s > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    return of


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return hasher(data)(s, e)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values (len - k + 1 of them, none if there are fewer)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1], 1)


def word(text: str | bytes) -> np.uint64:
    """The hash of one word, as hashes() gives it."""
    d = np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)
    return hashes(d, np.array([0]), np.array([len(d)]))[0]


def fresh(taken: list[str], base: str) -> str:
    """A column name that isn't taken, whatever its case."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))

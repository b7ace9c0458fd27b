"""Operator 1: WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records up to ``FRAME`` bytes (a longer record is a
frame of its own), and a seek table in a skippable frame at the end, in the layout of the published seekable format: any
Zstandard reader unpacks the bundle from front to end, and one that knows the footer jumps to a frame.  The index maps a
record's identifier to its bundle, frame, and place within the unpacked frame.

Bundles are filled within input partitions, so no row moves; rows come in frames, not in bundles, which keeps a row small
whatever the bundle's size, and a bundle is its frames end to end.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.taskcontext import TaskContext

FRAME = 256 << 10
BUNDLE = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "bundle string, frame int, frame_offset long, frame_size long, raw_size long, data binary, page_ids array<long>, record_ids array<string>, offsets array<long>, lengths array<long>"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for the same capture only: pages of one address with other bodies are other records."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url or ""}')}"


def record(page_id: int | None, url: str | None, body: str | None, date: str = DATE) -> tuple[str, bytes]:
    """(identifier, bytes) of one resource record."""
    payload = (body or "").encode()
    digest = hashlib.sha1(payload).hexdigest()
    name = record_id(page_id, url, digest)
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Block-Digest: sha1:{digest}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (packed, unpacked) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, unpacked size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    at, out, p = 0, [], len(bundle) - 9 - n * each
    for k in range(n):
        packed, raw = struct.unpack_from("<II", bundle, p + k * each)
        out.append((at, packed, raw))
        at += packed
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, unpacking its frame only."""
    at, packed, raw = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=raw)[offset : offset + length]


def bundles(pages: DataFrame, frame: int = FRAME, bundle: int = BUNDLE, date: str = DATE) -> DataFrame:
    """One row a frame, in the columns of ``SCHEMA``; each bundle's last row is its seek table, with no records.

    Null html is an empty record, a null url leaves out its header line, a null page_id stays null in page_ids; repeated
    rows are repeated records with the same identifier; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        held: list[tuple[int | None, str, bytes]] = []
        sizes: list[tuple[int, int]] = []
        size = 0

        def row(data: bytes, raw: int) -> pa.RecordBatch:
            at, offsets = 0, []
            for _, _, r in held:
                offsets.append(at)
                at += len(r)
            one = {
                "bundle": (f"{part:06d}-{number:05d}", pa.string()),
                "frame": (len(sizes), pa.int32()),
                "frame_offset": (sum(s for s, _ in sizes), pa.int64()),
                "frame_size": (len(data), pa.int64()),
                "raw_size": (raw, pa.int64()),
                "data": (data, pa.binary()),
                "page_ids": ([p for p, _, _ in held], pa.list_(pa.int64())),
                "record_ids": ([n for _, n, _ in held], pa.list_(pa.string())),
                "offsets": (offsets, pa.list_(pa.int64())),
                "lengths": ([len(r) for _, _, r in held], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in one.values()], names=list(one))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                raw = b"".join(r for _, _, r in held)
                data = packer.compress(raw)
                yield row(data, len(raw))
                sizes.append((len(data), len(raw)))
                held.clear()
                size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            yield from flush()
            if sizes:
                yield row(seek_table(sizes), 0)
                sizes.clear()
                number += 1

        for b in batches:
            for page_id, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                name, r = record(page_id, url, html, date)
                if held and size + len(r) > frame:
                    yield from flush()
                    if sum(n for n, _ in sizes) >= bundle:
                        yield from close()
                held.append((page_id, name, r))
                size += len(r)
        yield from close()

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def index(frames: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle, frame, frame_offset, frame_size, offset, length) of each record of bundles()."""
    from pyspark.sql import functions as F

    each = F.explode(F.arrays_zip("record_ids", "page_ids", "offsets", "lengths")).alias("r")
    return frames.select("bundle", "frame", "frame_offset", "frame_size", each).select(
        F.col("r.record_ids").alias("record_id"), F.col("r.page_ids").alias("page_id"), "bundle", "frame", "frame_offset", "frame_size", F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length")
    )


def write(frames: DataFrame, folder: str) -> None:
    """Bundles as files ``<bundle>.warc.zst`` in a shared folder (a path, or an address of a file system that Arrow knows).

    A file appears under its name only when it is whole, so a task that is lost and run again does no harm.
    """
    from pyarrow import fs

    address = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def save(rows: Iterator) -> None:
        store, at = fs.FileSystem.from_uri(address)
        out, name, tmp = None, None, None

        def done() -> None:
            if out:
                out.close()
                store.move(tmp, f"{at}/{name}.warc.zst")

        for r in rows:
            if r.bundle != name:
                done()
                name, tmp = r.bundle, f"{at}/.{r.bundle}-{uuid.uuid4().hex}"
                out = store.open_output_stream(tmp)
            out.write(r.data)
        done()

    store, at = fs.FileSystem.from_uri(address)
    store.create_dir(at, recursive=True)
    frames.select("bundle", "frame", "data").repartition("bundle").sortWithinPartitions("bundle", "frame").foreachPartition(save)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in seekable bundles, a row a frame."""
    return bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))

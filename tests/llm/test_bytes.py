"""WARC bundles and Matroska: exact round trips."""

import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lepidus.llm import matroska, warc

PAGES = [(1, "http://a/", "<p>x</p>", 0), (2, "http://b/\r\nX: y", None, 0), (3, None, "", 0), (None, "http://c/", "z", 0), (None, None, None, 0), (1, "http://a/", "<p>x</p>", 0), (4, "http://d/", "long " * 100_000, 0)]


def bundles(rows):
    by = {}
    for r in rows:
        by.setdefault(r.bundle, []).append(r)
    return {b: sorted(rs, key=lambda r: r.frame) for b, rs in by.items()}


def check(rows, pages):
    want = sorted(warc.record(p, u, h) for p, u, h in pages)
    got = []
    for rs in bundles(rows).values():
        data = b"".join(r.data for r in rs)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        table = warc.read_seek_table(data)
        assert [(r.frame_offset, r.frame_size, r.raw_size) for r in rs[:-1]] == table and not rs[-1].page_ids
        assert len(whole) == sum(t[2] for t in table)
        for r in rs:
            got += [(n, warc.read_record(data, r.frame, o, m)) for n, o, m in zip(r.record_ids, r.offsets, r.lengths)]
    assert sorted(got) == want


def test_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = warc.bundles(pages, frame=20_000, bundle=30_000).collect()
    assert len(bundles(rows)) > 1
    check(rows, [(r.page_id, r.url, r.html) for r in pages.collect()])
    assert warc.index(warc.bundles(pages)).count() == pages.count()


def test_hard_pages(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, frame int").coalesce(1)
    check(warc.bundles(df, frame=1000).collect(), [p[:3] for p in PAGES])
    assert warc.bundles(df.where("false")).count() == 0
    frames = warc.bundles(df)
    warc.write(frames, str(tmp_path / "w"))
    files = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert files and all(f.endswith(".warc.zst") for f in files)
    assert b"X: y\r\n" not in warc.record(2, PAGES[1][1], None)[1].split(b"\r\n\r\n")[0].replace(b"%0D%0AX: y", b"")


def test_packets_are_the_text(spark, documents):
    files = matroska.media(documents)
    rows = matroska.packets(files).collect()
    media = {r.doc_id: bytes(r.media) for r in files.collect() if r.media is not None}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.packet)):
        assert r.fault is None and r.track == 1 and r.cued and r.timestamp_ns == r.packet * matroska.TICK_MS * 1_000_000
        got[r.doc_id] = got.get(r.doc_id, b"") + media[r.doc_id][r.start : r.start + r.size]
    assert got == {r.doc_id: r.text.encode() for r in documents.collect() if r.text}
    assert {r.lacing for r in rows} == {0, 1, 2, 3} and {r.keyframe for r in rows} == {True}  # text has no frames that refer to others
    assert sum(r.size for r in rows) == documents.agg(F.sum(F.octet_length("text"))).first()[0]


def el(kind, *parts):
    """An element as the specification has it: id, one byte of size, content."""
    content = b"".join(parts)
    assert len(content) < 127
    return bytes.fromhex(kind) + bytes([0x80 | len(content)]) + content


def hand_made():
    """Two tracks, a group that refers to another frame, Xiph lacing with an empty frame, a void element, a track number of two bytes, a time before its cluster's; cues of the first cluster only."""
    x = bytes.fromhex
    one = el("1F43B675", el("E7", x("03E8")), el("A3", x("81 0005 80"), b"abc"), el("EC", x("0000")), el("A0", el("A1", x("82 000A 00"), b"x"), el("FB", x("F6"))), el("A3", x("82 0014 82 02 01 02"), b"p", b"qr"))
    two = el("1F43B675", el("E7", x("00")), el("A3", x("4001 FFFE 00"), b"z"))
    front = el("1549A966", el("2AD7B1", x("0F4240"))) + el("1654AE6B", el("AE", el("D7", x("01"))), el("AE", el("D7", x("02")), el("23E383", x("1E8480"))))
    cues = el("1C53BB6B", el("BB", el("B3", x("03E8")), el("B7", el("F7", x("01")), el("F1", bytes([len(front)])))))
    return el("1A45DFA3", el("4282", b"matroska")) + x("18538067 01FFFFFFFFFFFFFF") + front + one + two + cues


def test_bytes_of_another_writer():
    b, ms = hand_made(), 1_000_000
    got, fault = matroska.parse(b)
    assert fault is None
    assert [(g[1], g[2], g[3], g[4], b[g[5] : g[5] + g[6]], g[7]) for g in got] == [
        (1, 1005 * ms, True, 0, b"abc", True),
        (2, 1010 * ms, False, 0, b"x", True),
        (2, 1020 * ms, True, 1, b"p", True),
        (2, 1022 * ms, True, 1, b"qr", True),
        (2, 1024 * ms, True, 1, b"", True),
        (1, -2 * ms, False, 0, b"z", False),
    ]


def test_two_captures_of_one_address_are_two_records(spark):
    df = spark.createDataFrame([(1, "http://a/", "one"), (1, "http://a/", "two"), (1, "http://a/", "one")], "page_id long, url string, html string")
    ids = [r.record_id for r in warc.index(warc.bundles(df)).collect()]
    assert len(ids) == 3 and len(set(ids)) == 2


def test_hard_media(spark, clashing, nothing):
    assert matroska.packets(matroska.media(nothing)).count() == 0
    got = matroska.packets(matroska.media(clashing)).where("fault is not null").count()
    assert got == 0
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray()), (None, bytearray(matroska.mux(b"ab")))], "doc_id long, media binary")
    rows = matroska.packets(bad).collect()
    assert {(r.doc_id, r.fault is None) for r in rows} == {(1, False), (None, True)}


@pytest.mark.parametrize("sizes,way", [([1, 300, 255, 7], 1), ([5, 5, 5], 2), ([5, 700, 2, 9000, 1], 3), ([0, 0, 3], 1), ([4, 0, 3], 3)])
def test_lacing(sizes, way):
    body = b"\x81\x00\x05" + bytes([way << 1]) + matroska._laced(sizes, way) + bytes(sum(sizes))
    track, time, _, got = matroska.frames(body, 0, len(body))
    assert (track, time) == (1, 5) and [s for _, s in got] == sizes


def test_damaged_bytes_are_faults_or_packets():
    m = matroska.mux("line one\nline two\nline three\n".encode() * 20)
    whole, fault = matroska.parse(m)
    assert fault is None
    for k in range(0, len(m), 11):
        got, _ = matroska.parse(m[:k])
        assert [g[:7] for g in got] == [w[:7] for w in whole[: len(got)]] or len(got) <= len(whole)
    rng = np.random.default_rng(0)
    for _ in range(500):
        b = bytearray(m)
        for _ in range(3):
            b[rng.integers(len(b))] = rng.integers(256)
        matroska.parse(bytes(b))


def test_unknown_sizes_and_scale():
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska._number(matroska.TIME, 10) + matroska._element(matroska.SIMPLE, b"\x82\x00\x01\x80abc")
    head = matroska._element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska._element(matroska.INFO, matroska._number(matroska.SCALE, 2_000_000))
    got, fault = matroska.parse(head + cluster + cluster)
    assert fault is None and [(g[1], g[2], g[3], g[6]) for g in got] == [(2, 22_000_000, True, 3)] * 2

"""Sizes of images from their first bytes."""

from __future__ import annotations

import struct


def size(content: bytes) -> tuple[int, int, str] | None:
    """(width, height, format) of PNG, JPEG or TIFF bytes; None if they aren't, or are cut short."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", content[16:24])
            return w, h, "png"
        if content[:2] == b"\xff\xd8":
            at = 2
            while at < len(content):
                if content[at] != 0xFF:
                    return None
                kind = content[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return w, h, "jpeg"
                at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
            return None
        if content[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if content[:2] == b"II" else ">"
            at = struct.unpack(e + "I", content[4:8])[0]
            n = struct.unpack(e + "H", content[at : at + 2])[0]
            tags = {}
            for k in range(n):
                tag, kind, _ = struct.unpack(e + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
                value = content[at + 10 + 12 * k : at + 14 + 12 * k]
                tags[tag] = struct.unpack(e + "H", value[:2])[0] if kind == 3 else struct.unpack(e + "I", value)[0]
            return tags[256], tags[257], "tiff"
    except (struct.error, IndexError, KeyError):
        return None
    return None


def _tags(b: bytes, at: int, e: str) -> dict[int, object]:
    """Entries of a TIFF directory: numbers, ratios and texts."""
    n = struct.unpack(e + "H", b[at : at + 2])[0]
    out: dict[int, object] = {}
    for k in range(n):
        tag, kind, count = struct.unpack(e + "HHI", b[at + 2 + 12 * k : at + 10 + 12 * k])
        value = b[at + 10 + 12 * k : at + 14 + 12 * k]
        if kind == 2:
            start = struct.unpack(e + "I", value)[0] if count > 4 else None
            raw = value[:count] if start is None else b[start : start + count]
            out[tag] = raw.split(b"\0")[0].decode("latin-1").strip()
        elif kind == 3:
            out[tag] = struct.unpack(e + "H", value[:2])[0]
        elif kind == 4:
            out[tag] = struct.unpack(e + "I", value)[0]
        elif kind == 5:
            start = struct.unpack(e + "I", value)[0]
            a, z = struct.unpack(e + "II", b[start : start + 8])
            out[tag] = a / z if z else None
    return out


def exif(content: bytes) -> dict[str, object] | None:
    """camera ("make model"), focal_mm, width and height of JPEG or TIFF bytes; None where there are no such data or they are broken."""
    try:
        if content[:2] == b"\xff\xd8":
            at = 2
            while content[at] == 0xFF and content[at + 1] != 0xDA:
                n = struct.unpack(">H", content[at + 2 : at + 4])[0]
                if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                    b = content[at + 10 : at + 2 + n]
                    break
                at += 2 + n
            else:
                return None
        elif content[:4] in (b"II*\0", b"MM\0*"):
            b = content
        else:
            return None
        e = "<" if b[:2] == b"II" else ">"
        tags = _tags(b, struct.unpack(e + "I", b[4:8])[0], e)
        if 0x8769 in tags:
            tags |= _tags(b, tags[0x8769], e)
        got = size(content) or (None, None, "")
        camera = f"{tags.get(0x010F, 'Unknown')} {tags.get(0x0110, 'Unknown')}".strip()
        return {"camera": camera, "focal_mm": tags.get(0x920A), "width": tags.get(0xA002, got[0]), "height": tags.get(0xA003, got[1])}
    except (struct.error, IndexError):
        return None

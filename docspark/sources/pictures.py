"""Pictures of help archives (P1-P10, S23, K8): to BMP, placeable WMF and PNG, and their hotspots."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from docspark.functions.numbers import HOTSPOTS
from docspark.sources.codecs import run_length, unpack_picture
from docspark.sources.container import text

# Fixed values of the formats.
DDB, DIB, METAFILE = 5, 6, 8
PLACEABLE = b"\xd7\xcd\xc6\x9a"
INFO_SIZES = (40, 12, 108, 124)
HOTSPOT = struct.Struct("<3B4HI")


class _End(Exception):
    """The picture ends within a number."""


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def plain(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise _End
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "little")

    def packed(self, slim: int) -> int:
        """Twice as wide as ``slim`` bytes if its lowest bit is set."""
        low = self.plain(slim)
        return (low | self.plain(slim) << 8 * slim if low & 1 else low) >> 1


@dataclass
class Picture:
    """The first picture of a container: its header, and where palette and payload are."""

    kind: int
    packed: int
    fields: dict[str, int]
    palette: bytes
    payload: bytes
    hotspots: bytes


def first_picture(data: bytes) -> Picture | None:
    """Header, palette, payload and hotspot block follow each other; the offsets in the header are ignored."""
    try:
        head = _Reader(data, 2)
        if not head.plain(2):
            return None
        r = _Reader(data, head.plain(4))
        kind, packed = r.plain(1), r.plain(1)
        f: dict[str, int] = {}
        if kind in (DIB, DDB):
            for name, slim in (("x", 2), ("y", 2), ("planes", 1), ("bits", 1), ("width", 2), ("height", 2), ("used", 2), ("important", 2), ("size", 2), ("spots", 2)):
                f[name] = r.packed(slim)
        elif kind == METAFILE:
            f["mapping"] = r.packed(1)
            f["width"], f["height"] = r.plain(2), r.plain(2)
            for name in ("inch", "size", "spots"):
                f[name] = r.packed(2)
        else:
            return None
        r.plain(8)
    except _End:
        return None
    f["colors"] = (f["used"] or 1 << f["bits"]) if kind == DIB and f["bits"] <= 8 else 0
    start = r.at + 4 * f["colors"]
    if start + f["size"] > len(data):
        return None
    stop = start + f["size"]
    return Picture(kind, packed, f, data[r.at : start], data[start:stop], data[stop : stop + f["spots"]])


def ddb_rows(data: bytes, width: int, height: int, bits: int) -> bytes | None:
    """Rows of whole 2-byte words, filled up with 0x20 to whole 4-byte words."""
    if width <= 0 or height <= 0:
        return None
    slim, wide = -(-width * bits // 16) * 2, -(-width * bits // 32) * 4
    if len(data) < slim * height:
        return None
    return b"".join(data[i * slim : (i + 1) * slim].ljust(wide, b"\x20") for i in range(height))


def to_bmp(data: bytes) -> bytes | None:
    """A bitmap picture as a BMP file; null for other or unsupported pictures."""
    p = first_picture(data)
    if p is None or p.kind == METAFILE:
        return None
    f, palette, colors = p.fields, p.palette, p.fields["colors"]
    if p.kind == DIB:
        pixels = unpack_picture(p.payload, p.packed & 3)
    else:
        if f["bits"] != 1 or p.packed & 2:
            return None
        pixels = ddb_rows(run_length(p.payload) if p.packed & 1 else p.payload, f["width"], f["height"], 1)
        palette, colors = bytes(4) + b"\xff\xff\xff\0", 2
    if pixels is None:
        return None
    start = 54 + len(palette)
    info = struct.pack("<IIIHHIIiiII", 40, f["width"], f["height"], f["planes"] & 0xFFFF, f["bits"] & 0xFFFF, 0, len(pixels), 0, 0, colors, 0)
    return struct.pack("<2sIHHI", b"BM", start + len(pixels), 0, 0, start) + info + palette + pixels


def placeable(width: int, height: int, metafile: bytes) -> bytes:
    """A metafile behind its placeable header; the checksum is the exclusive or of its ten words."""
    head = PLACEABLE + struct.pack("<5HHI", 0, 0, 0, width, height, 2540, 0)
    check = 0
    for (word,) in struct.iter_unpack("<H", head):
        check ^= word
    return head + struct.pack("<H", check) + metafile


def to_wmf(data: bytes) -> bytes | None:
    """A metafile picture as a placeable WMF file."""
    p = first_picture(data)
    if p is None or p.kind != METAFILE:
        return None
    return placeable(p.fields["width"], p.fields["height"], unpack_picture(p.payload, p.packed & 3))


def is_wmf(data: bytes) -> bool:
    """P5."""
    return data[:4] == PLACEABLE


def with_bmp_header(data: bytes) -> bytes:
    """A bitmap that starts with its information header gets a file header."""
    if data[:2] == b"BM" or len(data) < 4:
        return data
    size = int.from_bytes(data[:4], "little")
    if size not in INFO_SIZES:
        return data
    palette = 0
    if size == 12 and len(data) >= 12:
        bits = int.from_bytes(data[10:12], "little")
        palette = 3 << bits if bits <= 8 else 0
    elif size != 12 and len(data) >= 36:
        bits, used = int.from_bytes(data[14:16], "little"), int.from_bytes(data[32:36], "little")
        palette = 4 * (used or 1 << bits) if bits <= 8 else 0
    return struct.pack("<2sIHHI", b"BM", 14 + len(data), 0, 0, 14 + size + palette) + data


def picture_file(data: bytes | None) -> bytes | None:
    """An internal picture file as BMP or WMF, or its own bytes if it is neither."""
    if data is None or not data:
        return data
    if len(data) >= 2 and int.from_bytes(data[:2], "little") & 0xDFFF == 0x506C:
        return to_bmp(data) or to_wmf(data) or data
    return data if is_wmf(data) else with_bmp_header(data)


def hotspots(data: bytes) -> list[tuple] | None:
    """``(x, y, w, h, action, id0, id1, id2, hash, name, target)``; null without a picture, empty if broken."""
    p = first_picture(data)
    if p is None:
        return None
    block = p.hotspots
    if len(block) < 7 or len(block) < p.fields["spots"] or block[0] != 1:
        return []
    n, macros = struct.unpack_from("<HI", block, 1)
    end = 7 + n * HOTSPOT.size
    if end + macros > len(block):
        return []
    strings = block[end + macros :].split(b"\0")[:-1]
    if len(strings) < 2 * n:
        return []
    out = []
    for i in range(n):
        a, b, c, x, y, w, h, value = HOTSPOT.unpack_from(block, 7 + i * HOTSPOT.size)
        out.append((x, y, w, h, HOTSPOTS.get((a, b, c), "unknown"), a, b, c, value, text(strings[2 * i]), text(strings[2 * i + 1])))
    return out


def to_png(bmp: bytes) -> bytes | None:
    """K8: an uncompressed BMP of 1, 4, 8, 24 or 32 bits as PNG; null for others."""
    if len(bmp) < 54 or bmp[:2] != b"BM":
        return None
    start, size, width, height, _, bits, method = struct.unpack_from("<IIiiHHI", bmp, 10)
    if size < 40 or method or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        return None
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if start + rows * stride > len(bmp):
        return None
    lines = [bmp[start + i * stride : start + (i + 1) * stride] for i in range(rows)]
    if height > 0:
        lines.reverse()
    chunks = []
    if bits <= 8:
        used = int.from_bytes(bmp[46:50], "little") or 1 << bits
        table = bmp[14 + size : 14 + size + 4 * min(used, 1 << bits)]
        colors = b"".join(table[i + 2 : i + 3] + table[i + 1 : i + 2] + table[i : i + 1] for i in range(0, len(table) - 3, 4))
        if not colors:
            return None
        chunks.append((b"PLTE", colors))
        lines = [line[: -(-width * bits // 8)] for line in lines]
    else:
        step = bits // 8
        swapped = []
        for line in lines:
            out = bytearray(3 * width)
            for i in range(3):
                out[i::3] = line[2 - i : step * width : step]
            swapped.append(bytes(out))
        lines = swapped
    head = struct.pack(">IIBBBBB", width, rows, bits if bits <= 8 else 8, 3 if bits <= 8 else 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + line for line in lines))
    parts = [(b"IHDR", head), *chunks, (b"IDAT", body), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)

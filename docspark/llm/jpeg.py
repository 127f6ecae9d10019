"""Media columns: baseline JPEG, its DC-only luminance thumbnails, and bytes kept in such images.

Reading. Markers give dimensions, quantisation and Huffman tables, sampling and the scan. A scan
falls into independent segments at its restart markers; the segments of all images of a batch that
share tables are Huffman-decoded in lock step, one symbol of every segment per numpy step. Only DC
coefficients are kept: an 8 x 8 block of luminance becomes one thumbnail sample. Stored are
the dimensions and a difference hash of the thumbnail (is a cell over its left neighbour?).

Storing bytes. :func:`store` writes a byte as one flat block (quantiser 8, quantised DC = byte -
128), 576 blocks a row, so any decoder shows the bytes as pixels and the DC-only thumbnail is the
stored payload, without loss. Payloads over ``FRAME_ROWS`` rows continue in further images behind
the first.

Defined cases: bytes that are no complete baseline JPEG (null, empty, cut, progressive, bad codes)
have no dimensions and no hash but an ``error``; several images behind each other are all read;
equal bytes give equal values, repeated rows too; a null or empty text is stored as one row of bytes 255; a text of any
length is stored and read back frame by frame, so that beside it only one frame is expanded at a time; an
empty table gives no rows; existing columns of the added names are replaced, others kept (:func:`describe`) or
ignored (:func:`store_texts`).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.arrow import extended, pieces, put

ROW, FRAME_ROWS, RESTART = 576, 2304, 96

# The usual table for DC luminance (ITU-T T.81, K.3): codes by length, then categories.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
# End of block alone, as the code 0.
AC_BITS = bytes([1] + [0] * 15)
AC_VALUES = bytes([0])


class BadImage(ValueError):
    """Not a complete baseline JPEG."""


def codes(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """``(code, length, symbol)`` of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length, values[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length (0: no such code) times 256 plus symbol."""
    out = np.zeros(1 << 16, np.uint16)
    for code, length, symbol in codes(table[:16], table[16:]):
        if code >> length:
            raise BadImage("overfull Huffman table")
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@dataclass
class Image:
    """One image's headers and entropy-coded segments."""

    width: int
    height: int
    #: (identifier, horizontal and vertical sampling, DC quantiser, DC table, AC table) in scan order
    parts: list[tuple[int, int, int, int, bytes, bytes]]
    restart: int
    segments: list[np.ndarray] = field(repr=False)

    @property
    def mcus(self) -> tuple[int, int]:
        """Rows and columns of MCUs; a scan of a single part counts in its blocks."""
        h, v = (1, 1) if len(self.parts) == 1 else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @property
    def order(self) -> list[int]:
        """The part of every block of an MCU."""
        return [0] if len(self.parts) == 1 else [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]


def _segments(data: np.ndarray, start: int) -> tuple[list[np.ndarray], int]:
    """The scan's segments with stuffing removed, and where the next marker is."""
    at = start + np.flatnonzero(data[start:-1] == 255)
    after = data[at + 1]
    stop = np.flatnonzero((after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7)))
    if not len(stop):
        raise BadImage("no end of image")
    end = int(at[stop[0]])
    at, after = at[: stop[0]], after[: stop[0]]
    keep = np.ones(end - start, bool)
    keep[at[after == 0] + 1 - start] = False
    cuts = at[after >= 0xD0] - start
    keep[cuts] = keep[cuts + 1] = False
    scan = data[start:end]
    edges = [0, *cuts.tolist(), len(scan)]
    return [scan[a:b][keep[a:b]] for a, b in zip(edges, edges[1:], strict=False)], end


def parse(data: bytes | None) -> list[Image]:
    """The headers and segments of every image in ``data``."""
    if not data:
        raise BadImage("empty")
    raw, images, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise BadImage("no start of image")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[tuple[int, int], bytes] = {}
        frame, restart, image = None, 0, None
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > len(data) or data[at] != 255:
                raise BadImage("no marker")
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            if at + 2 > len(data):
                raise BadImage("cut header")
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            if size < 2 or len(body) != size - 2:
                raise BadImage("cut header")
            at += size
            try:
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                        body = body[1 + 64 * (1 + wide) :]
                elif marker == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                        if len(body) < 17 + n:
                            raise BadImage("cut Huffman table")
                        body = body[17 + n :]
                elif marker == 0xC0:
                    bits, height, width, n = struct.unpack(">BHHB", body[:6])
                    if bits != 8 or not height or not width:
                        raise BadImage("no dimensions or not 8 bits")
                    frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)})
                elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                    raise BadImage("not baseline")
                elif marker == 0xDD:
                    restart = int.from_bytes(body[:2], "big")
                elif marker == 0xDA:
                    if frame is None:
                        raise BadImage("scan before frame")
                    parts = []
                    for i in range(body[0]):
                        name, which = body[1 + 2 * i], body[2 + 2 * i]
                        h, v, q = frame[2][name]
                        parts.append((name, h, v, quant[q], tables[0, which >> 4], tables[1, which & 15]))
                    segments, at = _segments(raw, at)
                    if image is None:  # luminance comes with the first scan
                        image = Image(frame[0], frame[1], parts, restart, segments)
            except (IndexError, KeyError, struct.error) as e:
                raise BadImage("bad header") from e
        if image is None:
            raise BadImage("no scan")
        images.append(image)
    return images


def _decode(segments: list[np.ndarray], blocks: np.ndarray, order: list[int], tables: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The DC values of all segments behind each other, and which segments broke."""
    luts = np.stack([_lookup(t) for pair in tables for t in pair]).ravel()  # DC, AC, DC, AC, ...
    of = np.array(order, np.int64)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    padded = np.zeros(int(sizes.sum()) + 9 * len(segments) + 8, np.uint8)
    begin = np.cumsum(sizes + 9) - sizes - 9
    joined = np.concatenate(segments)
    padded[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(joined))] = joined
    n = len(padded) - 8
    window = np.zeros(n, np.uint64)  # the eight bytes from each byte on
    for i in range(8):
        window = window << np.uint64(8) | padded[i : n + i]
    first = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()), np.int32)
    bad = np.zeros(len(segments), bool)
    lane = np.flatnonzero(blocks)
    pos, last = begin[lane] * 8, (begin + sizes)[lane] * 8
    block, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    count, start = blocks[lane], first[lane]
    before = np.zeros((len(lane), len(tables)), np.int64)
    while len(lane):
        part = of[block % len(of)]
        dc = k == 0
        bits = window[pos >> 3] << (pos & 7).astype(np.uint64)
        found = luts[(((part << 1) | ~dc) << 16) + (bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = found >> 8, found & 255
        size = symbol & 15
        extra = (((bits << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        pos = pos + length + size
        wrong = (length == 0) | (pos > last)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        here = np.flatnonzero(dc)
        before[here, part[here]] += value[here]
        out[start[here] + block[here]] = before[here, part[here]]
        k = np.where(dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        over = k >= 64
        block, k = block + over, np.where(over, 0, k)
        bad[lane[wrong]] = True
        gone = wrong | (block >= count)
        if gone.any():
            stay = ~gone
            lane, pos, last, block, k, count, start, before = (x[stay] for x in (lane, pos, last, block, k, count, start, before))
    return out, bad


def thumbnails(images: list[Image]) -> list[np.ndarray | None]:
    """The DC-only luminance thumbnail (rows, columns of uint8) of every image; None where its codes are broken."""
    out: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        alike.setdefault((tuple(x.order), tuple(p[4:] for p in x.parts)), []).append(i)
    for (order, tables), members in alike.items():
        segments, blocks, spans = [], [], []
        for i in members:
            x = images[i]
            total = x.mcus[0] * x.mcus[1]
            per = x.restart or total
            counts = [min(per, total - a) * len(order) for a in range(0, total, per)]
            held = x.segments[: len(counts)]
            spans.append((len(segments), len(held), len(held) == len(counts)))
            segments += held
            blocks += counts[: len(held)]
        values, bad = _decode(segments, np.array(blocks, np.int64), list(order), [t for t in tables])
        ends = np.cumsum(blocks)
        for i, (a, n, whole) in zip(members, spans, strict=True):
            if not whole or bad[a : a + n].any():
                continue
            x = images[i]
            rows, columns = x.mcus
            own = values[(ends[a - 1] if a else 0) : ends[a + n - 1]].reshape(rows, columns, len(order))
            _, h, v, q, _, _ = x.parts[0]
            if len(x.parts) > 1:
                own = own[:, :, : h * v].reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
                high, wide = max(p[2] for p in x.parts), max(p[1] for p in x.parts)
                own = own[: -(-(-(-x.height * v // high)) // 8), : -(-(-(-x.width * h // wide)) // 8)]
            else:
                own = own[:, :, 0]
            out[i] = np.clip((own.astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits in hexadecimal: where, in 8 rows of 9 cells' means, a cell is over its left neighbour."""
    total = np.zeros(np.add(thumbnail.shape, 1), np.int64)
    total[1:, 1:] = thumbnail.astype(np.int64).cumsum(0).cumsum(1)

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(cells) * n // cells
        return a, np.maximum((np.arange(cells) + 1) * n // cells, a + 1)

    (r0, r1), (c0, c1) = edges(thumbnail.shape[0], 8), edges(thumbnail.shape[1], 9)
    sums = total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]
    cells = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()


def _features(images: list[Image], thumbs: list[np.ndarray | None]) -> str | None:
    """``WIDTHxHEIGHT:hash`` of every image, joined by ``+``."""
    if any(t is None for t in thumbs):
        return None
    return "+".join(f"{x.width}x{x.height}:{difference_hash(t)}" for x, t in zip(images, thumbs, strict=True))


def _part(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _part(0xDB, bytes([0]) + bytes([8] * 64)),
        _part(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])),
        _part(0xC4, bytes([0x00]) + DC_BITS + DC_VALUES),
        _part(0xC4, bytes([0x10]) + AC_BITS + AC_VALUES),
        _part(0xDD, struct.pack(">H", RESTART)),
        _part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a flat block, by DC difference + 255: category, its bits, end of block."""
    of = {symbol: (code, length) for code, length, symbol in codes(DC_BITS, DC_VALUES)}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = of[size]
        bits[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        sizes[d + 255] = length + size + 1
    return bits, sizes


_BITS, _SIZES = _block_codes()


def payload(text: str | None) -> bytes:
    """The text in UTF-8, filled up with bytes 255 to a positive multiple of 576."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (ROW * max(1, -(-len(data) // ROW)) - len(data))


def store(payloads: list[bytes]) -> list[bytes]:
    """Every payload (a positive multiple of 576 bytes) as JPEG images behind each other."""
    frames = [(i, x[a : a + ROW * FRAME_ROWS]) for i, x in enumerate(payloads) for a in range(0, len(x), ROW * FRAME_ROWS)]
    if not frames:
        return []
    samples = np.frombuffer(b"".join(x for _, x in frames), np.uint8).astype(np.int64).reshape(-1, RESTART)
    steps = np.diff(samples, axis=1, prepend=128) + 255
    sizes = _SIZES[steps]
    ends = np.cumsum(sizes, axis=1)
    length = (ends[:, -1] + 7) >> 3
    begin = np.cumsum(length) - length
    at = (begin[:, None] * 8 + ends - sizes).ravel()
    spread = _BITS[steps].ravel() << (24 - sizes.ravel() - (at & 7))
    n, at = int(length.sum()), at >> 3
    scan = sum(np.bincount(at + i, spread >> (16 - 8 * i) & 255, n + 2) for i in range(3))[:n].astype(np.uint8)
    scan[begin + length - 1] |= ((1 << (length * 8 - ends[:, -1])) - 1).astype(np.uint8)  # filled up with ones
    # stuffing behind every 255, and a marker behind every segment
    full = scan == 255
    segment = np.repeat(np.arange(len(length)), length)
    place = np.arange(n) + np.cumsum(full) - full + 2 * segment
    behind = np.cumsum(length + np.add.reduceat(full, begin, dtype=np.int64) + 2)
    out = np.zeros(int(behind[-1]), np.uint8)
    out[place] = scan
    per_frame = np.array([len(x) // RESTART for _, x in frames])
    last = np.cumsum(per_frame)
    out[behind - 2] = 255
    out[behind - 1] = 0xD0 + (np.arange(len(length)) - np.repeat(last - per_frame, per_frame)) % 8
    out[behind[last - 1] - 1] = 0xD9
    scans, media, a = out.tobytes(), [b""] * len(payloads), 0
    for (i, x), b in zip(frames, behind[last - 1].tolist(), strict=True):
        media[i] += _header(len(x) // ROW) + scans[a:b]
        a = b
    return media


def read_back(media: list[bytes]) -> list[tuple[bytes, str]]:
    """The stored payload and the features of every stored form."""
    images = [parse(x) for x in media]
    flat = thumbnails([y for x in images for y in x])
    out, a = [], 0
    for x in images:
        own = flat[a : a + len(x)]
        a += len(x)
        if any(t is None for t in own):
            raise BadImage("broken codes in a stored payload")
        out.append((b"".join(t.tobytes() for t in own), _features(x, own)))
    return out


MEDIA = {"width": "int", "height": "int", "n_images": "int", "thumb_hash": "string", "error": "string"}


def describe(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with dimensions (of the first image), number of images, features and error of its JPEG column."""

    def run(batches):
        for batch in pieces(batches, column, 2 << 20):
            found = []
            for data in batch.column(column).to_pylist():
                try:
                    images = parse(data)
                    said = _features(images, thumbnails(images))
                    if said is None:
                        raise BadImage("broken codes")
                    found.append((images[0].width, images[0].height, len(images), said, None))
                except BadImage as e:
                    found.append((None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield put(batch, {name: pa.array([x[i] for x in found], kind) for i, (name, kind) in enumerate(zip(MEDIA, kinds, strict=True))})

    return df.mapInArrow(run, extended(df, MEDIA))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store every text of ``docs(doc_id, text)`` and read it back: sizes, digests, features[, ``media``]."""
    names = [x.split()[0] for x in STORED.split(", ")] + ["media"] * with_media
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())[: len(names) - 1]

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            rows: list[_Stored] = []
            for new, media, back, feature in _frames(batch.column("text").to_pylist()):
                if new is not None:
                    rows.append(_Stored(new, with_media))
                rows[-1].add(media, back, feature)
            made = [pa.array(list(x), kind) for x, kind in zip(zip(*[r.values() for r in rows], strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED + ", media binary" * with_media)


def _frames(texts: list[str | None], most: int = 2 << 20) -> Iterator[tuple[int | None, bytes, bytes, str]]:
    """``(length of the text or None, stored image, bytes read back, feature)`` of every frame of every text in order; about ``most`` bytes, or one frame, at a time."""
    held: list[tuple[int | None, bytes]] = []

    def done():
        media = store([x for _, x in held])
        for (new, _), image, (back, feature) in zip(held, media, read_back(media), strict=True):
            yield new, image, back, feature
        held.clear()

    size = 0
    for text in texts:
        data = payload(text)
        new: int | None = len((text or "").encode("utf-8", "surrogatepass"))
        for a in range(0, len(data), ROW * FRAME_ROWS):
            part = data[a : a + ROW * FRAME_ROWS]
            if held and size + len(part) > most:
                yield from done()
                size = 0
            held.append((new, part))
            size, new = size + len(part), None
    yield from done()


class _Stored:
    """One text's row, frame by frame."""

    def __init__(self, n_bytes: int, with_media: bool):
        self.n_bytes, self.n_back, self.n_media, self.tail, self.features = n_bytes, 0, 0, b"", []
        self.back, self.media = hashlib.sha256(), hashlib.sha256()
        self.kept: list[bytes] | None = [] if with_media else None

    def add(self, media: bytes, back: bytes, feature: str) -> None:
        self.back.update(back)
        self.media.update(media)
        self.n_back, self.n_media, self.tail = self.n_back + len(back), self.n_media + len(media), back[-32:]
        self.features.append(feature)
        if self.kept is not None:
            self.kept.append(media)

    def values(self) -> tuple:
        said = (self.n_bytes, self.n_back, self.back.hexdigest(), zlib.crc32(self.tail), self.n_media, self.media.hexdigest(), "+".join(self.features))
        return said if self.kept is None else (*said, b"".join(self.kept))

"""JPEG reading against a scalar decoder, and exact round trips."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from docspark.llm import jpeg
from docspark.llm.queries import op3_media_columns


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += format(code, f"0{n}b") if n else ""

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


AC = bytes([0, 2, 1, 1] + [0] * 12), bytes([0x00, 0x01, 0xF0, 0x12])


def colour_image(rows, columns, rng, restart=0):
    """A 4:2:0 image of random DC (and some AC) coefficients, and its luminance DC values."""
    dc = {s: (c, n) for c, n, s in jpeg.codes(jpeg.DC_BITS, jpeg.DC_VALUES)}
    ac = {s: (c, n) for c, n, s in jpeg.codes(*AC)}
    luma = rng.integers(-60, 60, (2 * rows, 2 * columns))
    bits, scan, last, n = Bits(), b"", [0, 0, 0], 0
    for r in range(rows):
        for c in range(columns):
            if restart and n and n % restart == 0:
                scan += bits.done() + bytes([255, 0xD0 + (n // restart - 1) % 8])
                last = [0, 0, 0]
            n += 1
            for part, value in [(0, luma[2 * r + i, 2 * c + j]) for i in (0, 1) for j in (0, 1)] + [(1, rng.integers(-9, 9)), (2, 0)]:
                d = int(value) - last[part]
                last[part] = int(value)
                size = abs(d).bit_length()
                bits.put(*dc[size])
                bits.put(d if d >= 0 else d + (1 << size) - 1, size)
                if rng.random() < 0.5:
                    bits.put(*ac[0xF0])
                    bits.put(*ac[0x12])
                    bits.put(3, 2)
                bits.put(*ac[0x01])
                bits.put(1, 1)
                bits.put(*ac[0x00])
    scan += bits.done()
    part = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    head = b"\xff\xd8" + part(0xFE, b"a comment") + part(0xDB, bytes([0] + [4] * 64)) + part(0xDB, bytes([1] + [2] * 64))
    head += part(0xC0, struct.pack(">BHHB", 8, rows * 16 - 3, columns * 16 - 9, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += part(0xC4, bytes([0]) + jpeg.DC_BITS + jpeg.DC_VALUES + bytes([0x10]) + AC[0] + AC[1])
    if restart:
        head += part(0xDD, struct.pack(">H", restart))
    return head + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", luma


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_thumbnails(restart):
    rng = np.random.default_rng(restart)
    made = [colour_image(*rng.integers(1, 5, 2), rng, restart) for _ in range(6)]
    images = [jpeg.parse(d)[0] for d, _ in made]
    for thumb, image, (_, luma) in zip(jpeg.thumbnails(images), images, made, strict=True):
        expected = np.clip((luma * 4 + 4) // 8 + 128, 0, 255)[: -(-image.height // 8), : -(-image.width // 8)]
        assert np.array_equal(thumb, expected)


def test_round_trip_and_batch_independence():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(0, 256, 576 * int(n), dtype=np.uint8)) for n in (1, 2, 7)] + [b"\xff" * 576, b"\x00\xff" * 288, b"a" * 576 * 2500]
    together = jpeg.store(payloads)
    assert [x for p in payloads for x in jpeg.store([p])] == together
    assert [x for x, _ in jpeg.read_back(together)] == payloads
    assert len(jpeg.parse(together[-1])) == 2
    assert jpeg.store([]) == []


def scalar_samples(data):
    """A plain bit-by-bit decoder for the stored form."""
    image = jpeg.parse(data)[0]
    dc = {(n, c): s for c, n, s in jpeg.codes(jpeg.DC_BITS, jpeg.DC_VALUES)}
    out = []
    for segment in image.segments:
        bits = "".join(format(b, "08b") for b in segment)
        at, last = 0, 0
        for _ in range(jpeg.RESTART):
            n = 1
            while (n, int(bits[at : at + n], 2)) not in dc:
                n += 1
            size = dc[n, int(bits[at : at + n], 2)]
            at += n
            v = int(bits[at : at + size] or "0", 2)
            at += size
            last += v if not size or v >> (size - 1) else v - (1 << size) + 1
            assert bits[at] == "0"
            at += 1
            out.append(last + 128)
    return bytes(out)


def test_scalar_decoder_reads_the_same():
    payload = jpeg.payload("Grüße, ÿ und 日本 " * 50)
    assert scalar_samples(jpeg.store([payload])[0]) == payload


def test_defined_cases(spark):
    good = jpeg.store([jpeg.payload("x")])[0]
    flipped = good[:-20] + b"\xfe" * 10 + good[-10:]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate([good, good + good, None, b"", b"abc", good[:60], good[:-2], progressive, flipped])], "id int, media binary, thumb_hash string")
    rows = {r["id"]: r for r in jpeg.describe(df).collect()}
    assert (rows[0]["width"], rows[0]["height"], rows[0]["n_images"], rows[1]["n_images"]) == (4608, 8, 1, 2)
    assert rows[1]["thumb_hash"] == f"{rows[0]['thumb_hash']}+{rows[0]['thumb_hash']}"
    assert all(rows[i]["error"] and rows[i]["width"] is None and rows[i]["thumb_hash"] is None for i in range(2, 9))
    assert jpeg.describe(df.limit(0)).collect() == []


def test_texts(spark, sf_dir):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "é" * 576), (None, "a")], "doc_id long, text string")
    rows = jpeg.store_texts(docs, with_media=True).collect()
    assert [r["n_bytes"] for r in rows] == [0, 0, 1152, 1] and [r["payload_bytes"] for r in rows] == [576, 576, 1152, 576]
    assert rows[0]["payload_sha256"] == rows[1]["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"] == hashlib.sha256(rows[0]["media"]).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op3_media_columns(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        p = jpeg.payload(texts[r["doc_id"]])
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        media = jpeg.store([p])[0]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), brute_feature(p))


def brute_feature(payload):
    """Dimensions and difference hash of a payload of one frame, cell by cell."""
    rows = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    bits = ""
    for i in range(8):
        a = i * len(rows) // 8
        own = rows[a : max((i + 1) * len(rows) // 8, a + 1)]
        means = [sum(sum(r[64 * j : 64 * j + 64]) for r in own) / (64 * len(own)) for j in range(9)]
        bits += "".join("1" if y > x else "0" for x, y in zip(means, means[1:], strict=False))
    return f"4608x{8 * len(rows)}:{int(bits, 2):016x}"


def test_long_texts_frame_by_frame(spark):
    text = "".join(chr(32 + i * i % 90) for i in range(576 * 2304 * 2 + 700))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in jpeg.store_texts(docs, with_media=True).collect()}
    p = jpeg.payload(text)
    assert bytes(rows[1]["media"]) == jpeg.store([p])[0] == bytes(rows[3]["media"])
    assert rows[1]["payload_sha256"] == hashlib.sha256(p).hexdigest() and rows[1]["tail_crc32"] == zlib.crc32(p[-32:])
    assert rows[1]["feature"].count("+") == 2 and rows[1]["feature"] == jpeg.read_back([bytes(rows[1]["media"])])[0][1]

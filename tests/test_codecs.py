"""Byte decoders against fixed vectors and round trips."""

from __future__ import annotations

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.operators import decoding
from docspark.plans import fixture
from docspark.plans.fixture import literal_lz77
from docspark.sources import codecs, container, opcodes, pictures
from docspark.sources.codecs import HelpError


@pytest.mark.parametrize(
    ("data", "plain"),
    [(b"", b""), (b"\0ABCDEFGH", b"ABCDEFGH"), (b"\x08ABC\x02\0", b"ABCABC"), (b"\x10ABCD\x03\x10", b"ABCDABCD"), (b"\x01\x02\0", bytes(3)), (b"\x02A\0\0", b"AAAA"), (b"\x01\x02", b"")],
)
def test_lz77(data, plain):
    assert codecs.lz77(data) == plain


@given(st.binary(max_size=300))
def test_lz77_literals(data):
    assert codecs.lz77(literal_lz77(data)) == data


def spoken(data, phrases, hall):
    return b"".join(piece if idx is None else phrases[idx] for idx, piece, _ in codecs.tokens(data, hall))


_REPEATS = st.lists(st.sampled_from([b"a", b"ab", b"abc abc", bytes(7), b" " * 20, b"\x01\x02", b"the ", b"x" * 200]), max_size=40).map(b"".join)


@given(_REPEATS)
def test_packing_and_back(data):
    assert codecs.lz77(fixture.packed_lz77(data)) == data and codecs.run_length(fixture.packed_runs(data)) == data
    for method in range(4):
        assert codecs.unpack_picture(fixture.packed_picture(data, method), method) == data
    phrases = [b"the", b"ab", *(bytes([i]) for i in range(1, 16)), *(b"%03d" % i for i in range(500)), b"abc", b"x" * 40]
    assert spoken(fixture.packed_hall(data, phrases), phrases, True) == data
    assert spoken(fixture.packed_pairs(data, phrases), phrases, False) == data


@pytest.mark.parametrize(("kind", "compressed"), [("inline", False), ("compressed", True), ("indexed", True), ("hall", True)])
def test_phrase_files(kind, compressed):
    phrases = [bytes([65 + i % 26]) * (1 + i % 23) for i in range(300)]
    found, hall = codecs.phrase_table(fixture.phrase_files(kind, phrases), compressed)
    assert found == phrases and hall == (kind in ("indexed", "hall"))
    assert codecs.phrase_table(fixture.phrase_files("hall", phrases, lz77=False), True)[0] == phrases


@pytest.mark.parametrize(
    ("data", "phrases", "plain"),
    [(b"\x01\0\x01\x02", [b"hello", b" world"], b"hello world"), (b"\x01\x01!", [b"hello"], b"hello !"), (b"\x10\x80\xff\x20", [], b"\x10\x80\xff\x20"), (b"x\x01", [b"a"], b"x\x01")],
)
def test_pairs(data, phrases, plain):
    assert spoken(data, phrases, False) == plain


@pytest.mark.parametrize(("data", "plain"), [(b"\0\x02", b"helloworld"), (b"\x0bAB", b"AB"), (b"\x07\x17", b"   "), (b"\x0f\x1f", bytes(3))])
def test_hall(data, plain):
    assert spoken(data, [b"hello", b"world"], True) == plain


def test_phrase_tables():
    assert list(codecs.tokens(b"\x01", True)) == [(None, None, "phrase number without its second byte")] and list(codecs.tokens(b"\x0ba", True)) == [(None, None, "cut literal run")]
    assert codecs.phrases_inline(struct.pack("<4H", 2, 0, 2, 5) + b"abcde") == [b"ab", b"cde"]
    assert codecs.phrases_compressed(struct.pack("<2HI3H", 2, 0x100, 5, 6, 8, 11) + literal_lz77(b"abcde")) == [b"ab", b"cde"]
    assert codecs.phrases_indexed(struct.pack("<H", 2) + b"abcde", struct.pack("<3H", 0, 2, 5)) == [b"ab", b"cde"]
    index = struct.pack("<7I", 0, 2, 0, 2, 2, 0, 0) + bytes(4)
    assert codecs.phrases_hall(index, b"ab") == [b"a", b"b"]
    with pytest.raises(HelpError, match="cover"):
        codecs.phrases_hall(index, b"abc")
    with pytest.raises(HelpError):
        codecs.phrases_inline(struct.pack("<3H", 1, 5, 2))


@pytest.mark.parametrize(("data", "plain"), [(b"\x05A", b"AAAAA"), (b"\x83XYZ", b"XYZ"), (b"\x03A\x82BC\x02D", b"AAABCDD"), (b"\0\0\x03Z", b"ZZZ")])
def test_run_length(data, plain):
    assert codecs.run_length(data) == plain


def test_packed_numbers():
    at = opcodes.Bytes(b"\x08\x80")
    assert (at.scan_long(), at.at) == (4, 2)
    at = opcodes.Bytes(struct.pack("<I", (1000 + 0x40000000) << 1 | 1))
    assert (at.scan_long(), at.at) == (1000, 4)
    at = opcodes.Bytes(b"\x01\x80\x82")
    assert (at.scan_int(), at.scan_word(), at.at) == (0, 65, 3)


HEAD = bytes(9)


def plain(text):
    return ("text", text, False, False, None, None)


BOLD = [0, 1]
#: Commands, text, fonts' attributes, context names, and what they show.
SHOWN = [
    (b"\x80\0\0\x82", b"hello\0\0", [], [], [[plain("hello")]]),
    (b"\x80\0\0\x82" * 2, b"first\0\0\0second\0\0\0", [], [], [[plain("first")], [plain("second")]]),
    (b"\x80\4\0\xe3\xef\xbe\xad\xde\x89\x80\0\0\x82", b"\0\0click here\0\0\0", [], [], [[("link", "click here", False, False, "0xDEADBEEF", "jump")]]),
    (b"\xe6\x78\x56\x34\x12\x89\x82", b"\0\0\0", [], [0x12345678], [[("link", "ctx_12345678", False, False, "ctx_12345678", "popup")]]),
    (b"\x80\1\0\x80\0\0\x82", b"\0printf\0 function\0", BOLD, [], [[("text", "printf", True, False, None, None), plain(" function")]]),
    (b"\x80\1\0\x82", b"\0 x \0", BOLD, [], [[plain(" "), ("text", "x", True, False, None, None), plain(" ")]]),
    (b"\x80\1\0\x82\x81\x82", b"\0 \0y\0z\0", BOLD, [], [[plain(" ")], [("text", "y", True, False, None, None), plain(" "), ("text", "z", True, False, None, None)]]),
    (b"\x80\0\0\xff\x80\0\0", b"visible\0invisible\0", [], [], [[plain("visible")]]),
    (b"\x80\0\0\x86\x22\x08\x80\x02\0\0\7\0\x82\xff", b"\0\0\0", [], [], [("|bm7", "inline")]),
    (b"\x87\x22\x08\x80\x02\0\0\3\0\x82\xff", b"\0\0", [], [], [("|bm3", "left")]),
    (b"\x86\x22\x08\x80\x02\1\0\0\0\x82\xff", b"\0\0\0", [], [], []),
    (b"\x81\x83\x82", b"a\0b\0c\0", [], [], [[plain("a b\tc")]]),
    (b"\x89\x82\xe3\1\0\0\0\x81\x89\x89\x82", b"a\0drop\0in\0to\0b\0", [], [1], [[plain("a")], [plain("in "), ("link", "to", False, False, "ctx_00000001", "jump"), plain("b")]]),
    (b"\xe3\1", b"a\0", [], [], []),
    (b"\x82\x82\x82", b"a\0\xff\xfe\0", [], [], [[plain("a")], [plain("\ufffd\ufffd")]]),
]


def test_commands(spark):
    """Events as rows: the blocks of every record of one table."""
    rows = [(str(i), 0, 0x20, HEAD + commands, said) for i, (commands, said, *_) in enumerate(SHOWN)]
    fonts = [(str(i), k, a, None) for i, (_, _, attributes, _, _) in enumerate(SHOWN) for k, a in enumerate(attributes)]
    names = [(str(i), k, h, 0, None) for i, (_, _, _, hashes, _) in enumerate(SHOWN) for k, h in enumerate(hashes)]
    found = decoding.blocks(
        spark.createDataFrame(rows, "file string, rec_no int, record_type int, link_data1 binary, link_data2 binary"),
        spark.createDataFrame(fonts, "file string, idx int, attributes int, _error string"),
        spark.createDataFrame(names, "file string, ord int, hash long, topic_offset long, _error string"),
    ).collect()
    for i, (*_, expected) in enumerate(SHOWN):
        own = sorted((r for r in found if r["file"] == str(i)), key=lambda r: r["block_no"])
        assert [r["block_no"] for r in own] == list(range(len(expected))), i
        assert [(r["image"], r["placement"]) if r["kind"] == "image" else [tuple(x) for x in r["inlines"]] for r in own] == expected, i


def dib(bits=8, packed=0, pixels=b"\1\2\3\4" * 2, used=2, spots=b""):
    word = lambda n: struct.pack("<H", n << 1)
    head = bytes([6, packed]) + word(0) * 2 + bytes([2, bits << 1]) + word(4) + word(2) + word(used) + word(0) + word(len(pixels)) + word(len(spots)) + bytes(8)
    return struct.pack("<2HI", 0x706C, 1, 8) + head + bytes(4 * used) + pixels + spots


def test_pictures():
    bmp = pictures.to_bmp(dib())
    assert bmp[:2] == b"BM" and bmp[-8:] == b"\1\2\3\4" * 2 and struct.unpack_from("<ii", bmp, 18) == (4, 2)
    assert pictures.picture_file(dib(packed=1, pixels=b"\x08\x05"))[-8:] == b"\5" * 8
    assert pictures.ddb_rows(b"\xaa\x55\xff\0", 8, 2, 1) == b"\xaa\x55\x20\x20\xff\0\x20\x20"
    assert pictures.to_bmp(dib()[:-3]) is None and pictures.to_wmf(dib()) is None
    meta = struct.pack("<2HI", 0x706C, 1, 8) + bytes([8, 1, 2]) + struct.pack("<2H", 100, 50) + struct.pack("<3H", 0, 2 << 1, 0) + bytes(8) + b"\x03A"
    wmf = pictures.picture_file(meta)
    assert pictures.is_wmf(wmf) and len(wmf) == 25 and wmf[22:] == b"AAA"
    check = 0
    for (w,) in struct.iter_unpack("<H", wmf[:22]):
        check ^= w
    assert check == 0
    bare = bmp[14:]
    assert pictures.with_bmp_header(bare)[14:] == bare and struct.unpack_from("<I", pictures.with_bmp_header(bare), 10)[0] == 54 + 8
    assert pictures.picture_file(b"") == b"" and pictures.picture_file(None) is None


def test_png():
    bmp = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    png = pictures.to_png(bmp)
    data = png[png.index(b"IDAT") + 4 :]
    assert zlib.decompress(data[: -16]) == b"\0" + bytes([9, 8, 7, 12, 11, 10]) + b"\0" + bytes([3, 2, 1, 6, 5, 4])
    assert pictures.to_png(b"no") is None


def test_hotspots():
    records = pictures.HOTSPOT.pack(0xE3, 0, 0, 1, 2, 3, 4, 99) + pictures.HOTSPOT.pack(1, 2, 3, 0, 0, 0, 0, 0)
    block = struct.pack("<BHI", 1, 2, 0) + records + b"name\0target\0\0\0"
    found = pictures.hotspots(dib(spots=block))
    assert found[0] == (1, 2, 3, 4, "jump_visible", 0xE3, 0, 0, 99, "name", "target") and found[1][4] == "unknown"
    assert pictures.hotspots(dib(spots=block[:-1])) == [] and pictures.hotspots(b"") is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_end(data):
    codecs.lz77(data), codecs.run_length(data), pictures.hotspots(data), pictures.picture_file(data)
    list(opcodes.commands(0x20, data)), list(opcodes.commands(0x23, data)), list(codecs.tokens(data, True))
    assert b"".join(x or b"" for _, x, _ in codecs.tokens(bytes(b | 16 for b in data), False)) == bytes(b | 16 for b in data)
    container.walk(data, 0, len(data), 0, True), container.walk(data, 0, len(data), 0, False)


@given(st.one_of(_REPEATS, st.binary(max_size=200)), st.booleans())
def test_expanding_equals_the_tokens(data, hall):
    """In one loop, also over bytes that nobody packed, up to the first fault."""
    phrases = [b"the", b"ab", *(b"%03d" % i for i in range(140))]
    said, message = codecs.expand(data, hall, dict(enumerate(phrases)), len(phrases))
    want, fault = b"", None
    for idx, piece, wrong in codecs.tokens(data, hall):
        fault = wrong or (f"phrase {idx} of {len(phrases)}" if idx is not None and idx >= len(phrases) else None)
        if fault:
            break
        want += piece if idx is None else phrases[idx]
    assert (said, message) == (want, fault)

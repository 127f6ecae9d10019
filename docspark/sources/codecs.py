"""Byte codecs of help archives (D1-D6, D11, S14-S18): pure functions over bytes."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Mapping


class HelpError(ValueError):
    """An archive or one of its parts is malformed."""


def lz77(data: bytes) -> bytes:
    """A flag byte, lowest bit first, announces eight items: literals (0), or 16-bit back references (1)
    with 12 bits of distance less one and 4 bits of length less three. What lies before the start is zero; a
    cut reference ends the data."""
    out = bytearray()
    at, end = 0, len(data)
    while at < end:
        flags = data[at]
        at += 1
        if not flags:
            out += data[at : at + 8]
            at += 8
            continue
        for bit in range(8):
            if at >= end:
                break
            if not flags >> bit & 1:
                out.append(data[at])
                at += 1
                continue
            if at + 2 > end:
                return bytes(out)
            word = data[at] | data[at + 1] << 8
            at += 2
            source = len(out) - (word & 0xFFF) - 1
            length = (word >> 12) + 3
            if source < 0:
                zeros = min(length, -source)
                out += bytes(zeros)
                source, length = 0, length - zeros
            held = out[source : source + length]
            if 0 < len(held) < length:  # it goes on within itself
                held = (held * -(-length // len(held)))[:length]
            out += held
    return bytes(out)


def run_length(data: bytes) -> bytes:
    """A control byte repeats the next byte, or with its high bit set announces that many literals."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        n = control & 0x7F
        at += 1
        if control & 0x80:
            out += data[at : at + n]
            at += n
        elif n and at < len(data):
            out += data[at : at + 1] * n
            at += 1
    return bytes(out)


def unpack_picture(data: bytes, method: int) -> bytes:
    """Bit 1 is LZ77, bit 0 run lengths behind it."""
    plain = lz77(data) if method & 2 else data
    return run_length(plain) if method & 1 else plain


#: A piece of packed text: a phrase's number, or bytes as they are, or what is wrong with the rest.
Token = tuple[int | None, bytes | None, str | None]


def _pairs(data: bytes) -> Iterator[Token]:
    """D3: a byte of 1 to 15 and its successor name a phrase, odd values with a blank behind it."""
    for m in _PAIR.finditer(data):
        if m[1]:
            value = 256 * (m[1][0] - 1) + m[1][1]
            yield value >> 1, None, None
            if value & 1:
                yield None, b" ", None
        else:
            yield None, m[0], None


_PAIR = re.compile(rb"(?s)([\x01-\x0f].)|([^\x01-\x0f]+|.)")


def _hall(data: bytes) -> Iterator[Token]:
    """The low bits of a byte select a phrase, a literal run, blanks or NULs."""
    at = 0
    while at < len(data):
        b, n = data[at], (data[at] >> 3) + 1
        at += 1
        if b & 1 == 0:
            yield b >> 1, None, None
        elif b & 3 == 1:
            if at == len(data):
                yield None, None, "phrase number without its second byte"
                return
            yield 128 + (b >> 2) * 256 + data[at], None, None
            at += 1
        elif b & 7 == 3:
            if at + n > len(data):
                yield None, None, "cut literal run"
                return
            yield None, data[at : at + n], None
            at += n
        else:
            yield None, (b" " if b & 15 == 7 else b"\0") * ((b >> 4) + 1), None


def tokens(data: bytes, hall: bool) -> Iterator[Token]:
    """The tokens of packed text, by the kind of phrase table."""
    return _hall(data) if hall else _pairs(data)


def expand(data: bytes, hall: bool, table: Mapping[int, bytes], count: int) -> tuple[bytes, str | None]:
    """Packed text with the phrases of ``table`` in place of their numbers, up to its first fault, and this fault."""
    out: list[bytes] = []
    at, end = 0, len(data) if hall else 0
    try:
        known = [None if b & 1 else table.get(b >> 1) for b in range(256)] if hall else []
        known[7::16], known[15::16] = ([x * (i + 1) for i in range(len(known) // 16)] for x in (b" ", b"\0"))
        while at < end:
            b = data[at]
            at += 1
            piece = known[b]
            if piece is not None:
                out.append(piece)
            elif not b & 1:
                number = b >> 1
                raise KeyError(number)
            elif b & 3 == 1:
                if at == end:
                    return b"".join(out), "phrase number without its second byte"
                number = 128 + (b >> 2) * 256 + data[at]
                out.append(table[number])
                at += 1
            else:
                stop = at + (b >> 3) + 1
                if stop > end:
                    return b"".join(out), "cut literal run"
                out.append(data[at:stop])
                at = stop
        if not hall:
            for pair, said in _PAIR.findall(data):
                if pair:
                    number = 128 * (pair[0] - 1) + (pair[1] >> 1)
                    out.append(table[number])
                    if pair[1] & 1:
                        out.append(b" ")
                else:
                    out.append(said)
    except KeyError:
        return b"".join(out), f"phrase {number} of {count}"
    return b"".join(out), None


def _slices(offsets: list[int], data: bytes) -> list[bytes]:
    """The stretches between neighbouring offsets."""
    for a, b in zip(offsets, offsets[1:], strict=False):
        if not 0 <= a <= b <= len(data):
            raise HelpError(f"phrase from {a} to {b} of {len(data)} bytes")
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _words(data: bytes, at: int, n: int) -> list[int]:
    if at + 2 * n > len(data):
        raise HelpError("cut phrase offsets")
    return list(struct.unpack_from(f"<{n}H", data, at))


def phrases_inline(data: bytes) -> list[bytes]:
    """A count, offsets from the first one's end, and the phrases."""
    count = _words(data, 0, 1)[0]
    offsets = _words(data, 2, count + 1) if count else []
    return _slices(offsets, data[2 + 2 * len(offsets) :])


def phrases_compressed(data: bytes) -> list[bytes]:
    """An 8-byte header, offsets from the start of the offset table, LZ77 phrases."""
    count = _words(data, 0, 1)[0]
    if not count:
        return []
    table = 2 * (count + 1)
    offsets = [max(0, x - table) for x in _words(data, 8, count + 1)]
    return _slices(offsets, lz77(data[8 + table :]))


def phrases_indexed(data: bytes, index: bytes) -> list[bytes]:
    """Offsets in a file of their own, phrases behind a count."""
    count = _words(data, 0, 1)[0]
    return _slices(_words(index, 0, count + 1), data[2:])


def phrases_hall(index: bytes, image: bytes) -> list[bytes]:
    """Phrase lengths as unary and binary digits in 32-bit little-endian words, lowest bit first."""
    if len(index) < 28:
        raise HelpError("phrase index under 28 bytes")
    _, count, _, size, packed = struct.unpack_from("<5I", index)
    width = struct.unpack_from("<H", index, 24)[0] & 0xF
    plain = image if size == packed else lz77(image)
    at, end = 0, 8 * (len(index) - 28 - (len(index) - 28) % 4)

    def bit() -> int:
        nonlocal at
        if at == end:
            raise HelpError("phrase lengths end early")
        at += 1
        return index[28 + (at - 1 >> 3)] >> (at - 1 & 7) & 1

    offsets = [0]
    for _ in range(count):
        n = 1
        while bit():
            n += 1 << width
        n += bit()
        for power in range(1, 5):
            if width > power:
                n += bit() << power
        offsets.append(offsets[-1] + n)
    if offsets[-1] != len(plain):
        raise HelpError(f"phrases cover {offsets[-1]} of {len(plain)} bytes")
    return _slices(offsets, plain)


def phrase_table(files: dict[str, bytes], compressed: bool) -> tuple[list[bytes], bool]:
    """The phrases of an archive's internal files, and whether they expand the Hall way."""
    index, image, plain = (files.get(x) for x in ("|PhrIndex", "|PhrImage", "|Phrases"))
    if index is not None and image is not None:
        return phrases_hall(index, image), True
    if plain is None:
        return [], False
    if index is not None:
        return phrases_indexed(plain, index), True
    return (phrases_compressed(plain) if compressed and len(plain) >= 8 else phrases_inline(plain)), False

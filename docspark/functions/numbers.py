"""Packed integers, version geometry and code tables, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = 1 << 32


def _odd(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1)) == 1


def scan_word(two_bytes: Column) -> Column:
    """An odd value is 16 bits wide, an even one 8; half of it."""
    return F.when(_odd(two_bytes), F.shiftright(two_bytes, 1)).otherwise(F.shiftright(two_bytes.bitwiseAND(F.lit(0xFF)), 1))


def scan_int(two_bytes: Column) -> Column:
    """Like :func:`scan_word`, less the bias of its width."""
    return F.when(_odd(two_bytes), F.shiftright(two_bytes, 1) - 0x4000).otherwise(F.shiftright(two_bytes.bitwiseAND(F.lit(0xFF)), 1) - 0x40)


def scan_long(four_bytes: Column) -> Column:
    """32 or 16 bits wide, less its bias, modulo 2^32."""
    wide = F.shiftright(four_bytes, 1) - 0x40000000
    slim = F.shiftright(four_bytes.bitwiseAND(F.lit(0xFFFF)), 1) - 0x4000
    return F.pmod(F.when(_odd(four_bytes), wide).otherwise(slim), F.lit(_U32))


def packed_word(two_bytes: Column) -> Column:
    """16 or 8 bits wide, without bias."""
    return scan_word(two_bytes)


def packed_dword(four_bytes: Column) -> Column:
    """32 or 16 bits wide, without bias."""
    return F.when(_odd(four_bytes), F.shiftright(four_bytes, 1)).otherwise(F.shiftright(four_bytes.bitwiseAND(F.lit(0xFFFF)), 1))


def uses_lz77(minor: Column, flags: Column) -> Column:
    return (minor > 16) & flags.isin(4, 8)


def topic_block_size(minor: Column, flags: Column) -> Column:
    return F.when((minor <= 16) | (flags == 8), 2048).otherwise(4096)


def decompress_size(minor: Column) -> Column:
    return F.when(minor <= 16, 2048).otherwise(16384)


def crosses_block(next_block: Column, stream_offset: Column) -> Column:
    """FL3: the next record (a valid absolute position) lies in another block of 16384 bytes."""
    valid = (next_block >= 12) & (next_block < (1 << 31))
    return valid & (F.floor((next_block - 12) / 16384) != F.floor(stream_offset / 16384))


# The three identifying bytes of each hotspot action.
HOTSPOTS = {
    (0xC8, 0x00, 0x00): "macro_visible",
    (0xCC, 0x04, 0x00): "macro_invisible",
    (0xE2, 0x00, 0x00): "popup_visible",
    (0xE3, 0x00, 0x00): "jump_visible",
    (0xE6, 0x04, 0x00): "popup_invisible",
    (0xE7, 0x04, 0x00): "jump_invisible",
    (0xEA, 0x00, 0x00): "external_popup_visible",
    (0xEB, 0x00, 0x00): "external_jump_visible",
    (0xEE, 0x04, 0x00): "external_popup_invisible",
    (0xEF, 0x04, 0x00): "external_jump_invisible",
}


def hotspot_action(id0: Column, id1: Column, id2: Column) -> Column:
    """P10: the action of a triple, ``unknown`` for others."""
    code = id0 * 65536 + id1 * 256 + id2
    table = F.create_map(*[F.lit(x) for (a, b, c), name in HOTSPOTS.items() for x in (a * 65536 + b * 256 + c, name)])
    return F.coalesce(table[code.cast("int")], F.lit("unknown"))

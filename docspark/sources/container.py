"""The container of a help archive and its index files (S1-S12, S19-S22): from bytes to plain records."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from docspark.sources.codecs import HelpError, lz77

# Fixed values of the format.
MAGIC, TREE_MAGIC, SYSTEM_MAGIC = 0x00035F3F, 0x293B, 0x036C
TREE_HEADER, FILE_HEADER = 38, 9
TOPIC, TEXT, TABLE = 0x02, 0x20, 0x23


def number(data: bytes, at: int, size: int, what: str = "number") -> int:
    """A little-endian unsigned integer."""
    if at < 0 or at + size > len(data):
        raise HelpError(f"{what} at {at} lies past {len(data)} bytes")
    return int.from_bytes(data[at : at + size], "little")


def text(data: bytes) -> str:
    """UTF-8, broken bytes replaced."""
    return data.decode("utf-8", "replace")


def terminated(data: bytes, at: int) -> tuple[str, int]:
    """The string up to the next NUL, and what follows."""
    end = data.find(b"\0", at)
    if end < 0:
        raise HelpError(f"string at {at} has no end")
    return text(data[at:end]), end + 1


Entry = Callable[[bytes, int], tuple[tuple, int]]


def named_offset(data: bytes, at: int) -> tuple[tuple, int]:
    name, at = terminated(data, at)
    return (name, number(data, at, 4)), at + 4


def hash_offset(data: bytes, at: int) -> tuple[tuple, int]:
    return (number(data, at, 4), number(data, at + 4, 4)), at + 8


def offset_title(data: bytes, at: int) -> tuple[tuple, int]:
    title, end = terminated(data, at + 4)
    return (number(data, at, 4), title), end


def tree(data: bytes, leaf_header: int, entry: Entry, skip_key: Callable[[bytes, int], int]) -> Iterator[tuple]:
    """All leaf entries of a B-tree, in order, without recursion; a page is visited once."""
    if number(data, 0, 2) != TREE_MAGIC:
        raise HelpError("no B-tree")
    page_size, root, pages, levels = number(data, 4, 2), number(data, 0x1A, 2), number(data, 0x1E, 2), number(data, 0x20, 2)
    todo, seen = ([(root, levels)] if levels and pages else []), set()
    while todo:
        page, level = todo.pop()
        if page >= pages or page in seen:
            raise HelpError(f"B-tree page {page} of {pages}")
        seen.add(page)
        start = TREE_HEADER + page * page_size
        held = data[start : start + page_size]
        count = number(held, 2, 2, "B-tree page")
        if level <= 1:
            at = leaf_header
            for _ in range(count):
                found, at = entry(held, at)
                yield found
            continue
        children, at = [number(held, 4, 2)], 6
        for _ in range(count):
            at = skip_key(held, at)
            children.append(number(held, at, 2))
            at += 2
        todo += [(x, level - 1) for x in reversed(children)]


def _after_string(data: bytes, at: int) -> int:
    return terminated(data, at)[1]


@dataclass(frozen=True)
class InternalFile:
    """One entry of the directory."""

    ordinal: int
    name: str
    offset: int
    data: bytes
    raw: bytes


class Container:
    """An archive's internal files."""

    def __init__(self, data: bytes):
        if len(data) < 8:
            raise HelpError("under 8 bytes")
        if number(data, 0, 4) != MAGIC:
            raise HelpError(f"bad magic {number(data, 0, 4):#010x}")
        self.data = data
        listed = tree(data[number(data, 4, 4) + FILE_HEADER :], 8, named_offset, _after_string)
        #: names in directory order, repeats included
        self.listed: list[tuple[str, int]] = [*listed]
        self.offsets = dict(self.listed)

    def read(self, name: str, header: bool = False) -> bytes:
        """An internal file's bytes, with its 9-byte header if asked for."""
        if name not in self.offsets:
            raise HelpError(f"no internal file {name}")
        return self._at(self.offsets[name], header)

    def _at(self, offset: int, header: bool) -> bytes:
        used = number(self.data, offset + 4, 4, "internal file")
        start = offset + FILE_HEADER
        if start + used > len(self.data):
            raise HelpError(f"internal file at {offset} lies past the end")
        return self.data[offset if header else start : start + used]

    def get(self, name: str) -> bytes | None:
        return self.read(name) if name in self.offsets else None

    def files(self) -> Iterator[InternalFile]:
        for i, (name, offset) in enumerate(self.listed):
            raw = self._at(offset, True)
            yield InternalFile(i, name, offset, raw[FILE_HEADER:], raw)


@dataclass(frozen=True)
class System:
    """An archive's metadata and the geometry that follows from its version."""

    minor: int
    flags: int
    flags_ex: int | None
    title: str | None
    copyright: str | None
    root_topic_offset: int | None
    starting_topic: str | None

    @property
    def before_31(self) -> bool:
        return self.minor <= 16

    @property
    def compression(self) -> int:
        return self.flags if self.flags_ex is None else self.flags_ex

    @property
    def lz77(self) -> bool:
        return self.minor > 16 and self.compression in (4, 8)

    @property
    def block_size(self) -> int:
        return 2048 if self.before_31 or self.compression == 8 else 4096

    @property
    def decompress_size(self) -> int:
        return 2048 if self.before_31 else 16384


def system(data: bytes, minor: int | None = None) -> System:
    """The metadata file; the last record of a type counts, a cut one ends the list."""
    if number(data, 0, 2) != SYSTEM_MAGIC:
        raise HelpError("no metadata")
    own, flags = number(data, 2, 2), number(data, 4, 2)
    extended = own >= 10 and len(data) >= 12
    at, found = 12 if extended else 6, {}
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > len(data):
            break
        if kind != 3 or size >= 4:
            found[kind] = data[at + 4 : at + 4 + size]
        at += 4 + size
    said = {k: text(found[k].split(b"\0")[0]) for k in (1, 2, 4) if k in found}
    root = number(found[3], 0, 4) if 3 in found else None
    return System(own if minor is None else minor, flags, number(data, 10, 2) if extended else None, said.get(1), said.get(2), root, said.get(4))


def contexts(data: bytes) -> list[tuple[int, int]]:
    """``(hash, topic offset)``; inner keys are two bytes longer with flag 0x0400."""
    key = 6 if number(data, 2, 2) & 0x0400 else 4
    return [*tree(data, 8, hash_offset, lambda _, at: at + key)]


def titles(data: bytes, leaf_header: int = 4) -> list[tuple[int, str]]:
    """``(topic offset, title)`` by offset."""
    return sorted(tree(data, leaf_header, offset_title, lambda _, at: at + 4), key=lambda x: x[0])


def keywords(index: bytes, postings: bytes, leaf_header: int = 4) -> list[tuple[str, list[int]]]:
    """Keywords and the topic offsets in their posting lists."""
    out = []
    for word, at in tree(index, leaf_header, named_offset, _after_string):
        n = number(postings, at, 2, "posting list")
        out.append((word, [number(postings, at + 2 + 4 * i, 4, "posting list") for i in range(n)]))
    return out


def fonts(data: bytes) -> list[tuple[int, int, int, str]]:
    """``(attributes, half points, family, face)``; an inconsistent table is empty."""
    if len(data) < 8:
        raise HelpError("font table under 8 bytes")
    faces, count, faces_at, fonts_at = struct.unpack_from("<4H", data)
    if not faces or not count or not 8 <= faces_at < fonts_at <= len(data) or (fonts_at - faces_at) % faces:
        return []
    cell, width = (fonts_at - faces_at) // faces, (len(data) - fonts_at) // count
    if width < 5:
        return []
    names = [text(data[faces_at + i * cell : faces_at + (i + 1) * cell].split(b"\0")[0]) for i in range(faces)]
    out = []
    for i in range(count):
        attributes, half_points, family, face = struct.unpack_from("<BBBH", data, fonts_at + i * width)
        out.append((attributes, half_points, family, names[face] if face < faces else ""))
    return out


def blocks(data: bytes, size: int, packed: bool) -> list[tuple[int, int, int, bytes]]:
    """Fixed-size blocks of the topic file, each with three positions and its (decompressed) body."""
    out = []
    for at in range(0, len(data), size):
        held = data[at : at + size]
        if len(held) < 12:
            break
        body = held[12:]
        out.append((*struct.unpack_from("<3I", held), lz77(body) if packed else body))
    return out


def walk(data: bytes, start: int, own: int, entry: int, before_31: bool) -> tuple[list[tuple[int, int, int, int, int, int]], int | None]:
    """The records ``(position, size, length2, next, length1, kind)`` from ``entry`` on, while they begin within ``own`` bytes of ``data``, which is at ``start``.

    Behind them: where the chain goes on (elsewhere, or at one of these records), or null at its end.
    """
    at, out, seen = entry, [], set()
    while start <= at < start + own and at not in seen:
        if at - start + 21 > len(data):
            return out, None
        seen.add(at)
        size, length2, _, following, length1, kind = struct.unpack_from("<5IB", data, at - start)
        if size < 21:
            return out, None
        out.append((at, size, length2, following, length1, kind))
        if not before_31 and not 12 <= following < 1 << 31:
            return out, None
        at = at + following if before_31 else following - 12
    return out, at

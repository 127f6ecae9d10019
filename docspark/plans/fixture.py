"""Help archives made from rows: input for round trips, as no archive can be shipped."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np

from docspark.sources.container import TABLE, TEXT, TOPIC, TREE_MAGIC
from docspark.sources.pictures import DDB, DIB, HOTSPOT, METAFILE

_PAGE = 32768


def string_key(entry: bytes) -> bytes:
    """The key of an entry that starts with a string."""
    return entry[: entry.index(0) + 1]


def number_key(entry: bytes) -> bytes:
    """The key of an entry that starts with a 32-bit number."""
    return entry[:4]


def tree(entries: list[bytes], key: Callable[[bytes], bytes], leaf_header: int = 8, page: int = _PAGE) -> bytes:
    """A B-tree over sorted entries, as many levels high as pages of this size need."""

    def paged(items: list[bytes], head: int) -> list[list[bytes]]:
        out: list[list[bytes]] = [[]]
        for x in items:
            if sum(map(len, out[-1])) + len(x) > page - head:
                out.append([])
            out[-1].append(x)
        return out

    leaves = paged(entries, 8)
    pages = [struct.pack("<4H", 0, len(x), 0, 0)[:leaf_header] + b"".join(x) for x in leaves]
    level, levels = [(key(x[0]) if x else b"", i) for i, x in enumerate(leaves)], 1
    while len(level) > 1:
        above, levels = [], levels + 1
        at = 0
        while at < len(level):
            held, stop = level[at][1], at + 1
            body = b""
            while stop < len(level) and len(body) + len(level[stop][0]) + 2 <= page - 6:
                body += level[stop][0] + struct.pack("<H", level[stop][1])
                stop += 1
            above.append((level[at][0], len(pages)))
            pages.append(struct.pack("<3H", 0, stop - at - 1, held) + body)
            at = stop
        level = above
    head = struct.pack("<3H16s6HI", TREE_MAGIC, 2, page, b"", 0, 0, level[0][1], 0xFFFF, len(pages), levels, len(entries))
    return head + b"".join(x.ljust(page, b"\0") for x in pages)


def _packed_word(n: int) -> bytes:
    return struct.pack("<H", n << 1 | 1)


def _packed_long(n: int) -> bytes:
    return struct.pack("<I", ((n + 0x40000000) << 1 | 1) & 0xFFFFFFFF)


def literal_lz77(data: bytes) -> bytes:
    """LZ77 without references: a zero flag byte before every eight literals."""
    return b"".join(b"\0" + data[i : i + 8] for i in range(0, len(data), 8))


def packed_lz77(data: bytes) -> bytes:
    """LZ77 with references to the last place of the same three bytes, if it is near enough."""
    out, items, flags, last, at = bytearray(), bytearray(), 0, {}, 0
    n = 0
    while at < len(data):
        before, length = last.get(data[at : at + 3], -1), 0
        if before >= 0 and at - before <= 4096:
            limit = min(18, len(data) - at)
            while length < limit and data[before + length] == data[at + length]:
                length += 1
        if length >= 3:
            flags |= 1 << n
            items += struct.pack("<H", (at - before - 1) | (length - 3) << 12)
        else:
            length = 1
            items.append(data[at])
        for i in range(at, at + length):
            last[data[i : i + 3]] = i
        at, n = at + length, n + 1
        if n == 8:
            out += bytes([flags]) + items
            items, flags, n = bytearray(), 0, 0
    return bytes(out + (bytes([flags]) + items if n else b""))


_RUNS = re.compile(rb"(?s)(.)\1{2,126}|(?:(?!(.)\2\2).){1,127}")


def packed_runs(data: bytes) -> bytes:
    """Three or more equal bytes as a repeat, others as literals."""
    return b"".join(bytes([len(m[0])]) + m[1] if m[1] is not None else bytes([0x80 | len(m[0])]) + m[0] for m in _RUNS.finditer(data))


def packed_picture(data: bytes, method: int) -> bytes:
    """What :func:`docspark.sources.codecs.unpack_picture` undoes."""
    plain = packed_runs(data) if method & 1 else data
    return packed_lz77(plain) if method & 2 else plain


class Phrases:
    """A phrase table to pack by: at each place the longest phrase, found by its first bytes."""

    def __init__(self, phrases: list[bytes]):
        self.number = {x: i for x, i in zip(reversed(phrases), range(len(phrases) - 1, -1, -1), strict=True) if x}
        self.one, self.two = np.zeros(1 << 8, bool), np.zeros(1 << 16, bool)
        self.longer: dict[bytes, list[bytes]] = {}
        for x in sorted(self.number, key=len, reverse=True):
            if len(x) > 2:
                self.longer.setdefault(x[:3], []).append(x)
        self.one[[x[0] for x in self.number if len(x) == 1]] = True
        self.two[[x[0] << 8 | x[1] for x in self.number if len(x) == 2]] = True
        heads = np.frombuffer(b"".join(self.longer), np.uint8).reshape(-1, 3).astype(np.int32)
        self.three = np.sort(heads[:, 0] << 16 | heads[:, 1] << 8 | heads[:, 2])
        self.open = np.zeros(1 << 16, bool)
        self.open[self.three >> 8] = True

    def found(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """Start, end and number of the phrases in ``data``, from the left, none within another."""
        own = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int32)
        two = own[:-2] << 8 | own[1:-1]
        places = np.flatnonzero(self.open[two])
        codes = two[places] << 8 | own[places + 2]
        here = self.one[own[:-2]] | self.two[two]
        if len(self.three):
            here[places[self.three[np.minimum(np.searchsorted(self.three, codes), len(self.three) - 1)] == codes]] = True
        stop, number, longer = 0, self.number, self.longer
        for at in np.flatnonzero(here).tolist():
            if at < stop:
                continue
            for x in longer.get(data[at : at + 3], ()):
                if data.startswith(x, at):
                    break
            else:
                x = data[at : at + 2]
                if x not in number and (x := x[:1]) not in number:
                    continue
            stop = at + len(x)
            yield at, stop, number[x]


_UNNAMED = re.compile(rb"(?s)( {1,16})|(\0{1,16})|([^ \0]{1,32})")


def _unnamed(data: bytes) -> bytes:
    """Runs of blanks and NULs, and literals."""
    out = bytearray()
    for blanks, nuls, literal in _UNNAMED.findall(data):
        if literal:
            out.append((len(literal) - 1) << 3 | 3)
            out += literal
        else:
            out.append((len(blanks) - 1) << 4 | 7 if blanks else (len(nuls) - 1) << 4 | 15)
    return bytes(out)


def packed_hall(data: bytes, phrases: list[bytes] | Phrases) -> bytes:
    """Phrases by number, of one or two bytes; runs of blanks and NULs; what is left as literals."""
    held = phrases if isinstance(phrases, Phrases) else Phrases(phrases)
    out, last, short = [], 0, {}  # what lies between phrases is short, and comes again
    for at, stop, i in held.found(data):
        if last < at:
            between = data[last:at]
            if between not in short:
                short[between] = _unnamed(between)
            out.append(short[between])
        out.append(_NUMBERED[i])
        last = stop
    out.append(_unnamed(data[last:]))
    return b"".join(out)


#: Hall's numbers of phrases.
_NUMBERED = [bytes([i << 1]) if i < 128 else bytes([(i - 128) // 256 << 2 | 1, (i - 128) % 256]) for i in range(128 + 64 * 256)]


def packed_pairs(data: bytes, phrases: list[bytes] | Phrases) -> bytes:
    """Phrases as pairs of bytes, with a blank behind them in the odd ones; ``phrases`` has the bytes 1 to 15, which would read as pairs."""
    held = phrases if isinstance(phrases, Phrases) else Phrases(phrases)
    out, last = bytearray(), 0
    for at, stop, i in held.found(data):
        if at < last:  # a phrase that begins with the blank that the one before has taken
            continue
        blank = data.startswith(b" ", stop)
        out += data[last:at]
        out += (2 * i + blank + 256).to_bytes(2, "big")
        last = stop + blank
    return bytes(out + data[last:])


def phrase_files(kind: str, phrases: list[bytes], lz77: bool = True) -> dict[str, bytes]:
    """The internal files of a phrase table: ``inline``, ``compressed``, ``indexed`` or ``hall``."""
    plain, offsets = b"".join(phrases), [0]
    for x in phrases:
        offsets.append(offsets[-1] + len(x))
    words = struct.pack(f"<{len(offsets)}H", *offsets)
    if kind == "inline":
        return {"|Phrases": struct.pack("<H", len(phrases)) + words + plain}
    if kind == "compressed":
        moved = struct.pack(f"<{len(offsets)}H", *[x + len(words) for x in offsets])
        return {"|Phrases": struct.pack("<2HI", len(phrases), 0x100, len(plain)) + moved + packed_lz77(plain)}
    if kind == "indexed":
        return {"|PhrIndex": words, "|Phrases": struct.pack("<H", len(phrases)) + plain}
    width, bits = 2, []
    for x in phrases:
        bits += [1] * ((len(x) - 1) >> width) + [0] + [(len(x) - 1) >> i & 1 for i in range(width)]
    bits += [0] * (-len(bits) % 32)
    held = bytes(sum(b << i for i, b in enumerate(bits[at : at + 8])) for at in range(0, len(bits), 8))
    image = packed_lz77(plain) if lz77 else plain
    return {"|PhrIndex": struct.pack("<6I2H", 1, len(phrases), len(held), len(plain), len(image), 0, width, 0) + held, "|PhrImage": image}


#: Fonts of every archive: plain, bold, italic, both.
STYLES = {"text": 0, "bold": 1, "italic": 2, "both": 3}


def layout(flags: int = 0) -> bytes:
    """A paragraph's layout field with an operand for every flag, in one and two bytes by turns."""
    out = struct.pack("<H", flags)
    if flags & 1:
        out += _packed_long(70_000)
    for i in range(1, 7):
        if flags >> i & 1:
            out += struct.pack("<H", (i + 0x4000) << 1 | 1) if i % 2 else bytes([(i + 0x40) << 1])
    if flags & 0x0100:
        out += b"\x01\x02\x03"
    if flags & 0x0200:
        out += bytes([(2 + 0x40) << 1]) + _packed_word(300) + _packed_word(0x4000 + 5) + bytes([7 << 1])
    return out


def commands(runs: list[tuple]) -> tuple[bytes, list[str]]:
    """Commands and text segments of ``(style, s)``, ``("link" or "popup", s, hash)``, ``("image", n, placement)``, ``("break",)`` and ``("tab",)``."""
    out, segments = b"", []
    for r in runs:
        if r[0] in STYLES:
            style = STYLES[r[0]]
            if style:
                out, segments = out + bytes([0x80, style, 0, 0x80, 0, 0]), [*segments, "", r[1]]
            else:
                out, segments = out + b"\x80\0\0", [*segments, r[1]]
        elif r[0] in ("link", "popup"):
            out, segments = out + (b"\xe3" if r[0] == "link" else b"\xe6") + struct.pack("<I", r[2]) + b"\x89", [*segments, "", r[1]]
        elif r[0] == "image":
            place = {"inline": 0x86, "left": 0x87, "right": 0x88}[r[2] if len(r) > 2 else "inline"]
            out, segments = out + bytes([place]) + b"\x22" + struct.pack("<H", (5 + 0x4000) << 1) + b"\x00" + struct.pack("<2H", 0, r[1]), [*segments, ""]
        else:
            out, segments = out + (b"\x81" if r[0] == "break" else b"\x83"), [*segments, ""]
    return out, segments


def text_record(runs: list[tuple], flags: int = 0) -> tuple[bytes, bytes, int]:
    """Commands, text and count of a paragraph's record."""
    code, segments = commands(runs)
    count = sum(map(len, segments)) + 1
    return _packed_long(0) + _packed_word(count) + bytes(4) + layout(flags) + code + b"\x82\xff", "\0".join([*segments, "", ""]).encode(), count


def table_record(cells: list[tuple[list[tuple], int]], flags: int = 0) -> tuple[bytes, bytes, int]:
    """Commands, text and count of a table's record of ``(runs, layout flags)`` cells."""
    out, every = bytes([len(cells), flags]) + bytes(2) * (flags & 3 in (0, 2)) + bytes(4 * len(cells)), []
    for i, (runs, own) in enumerate(cells):
        code, segments = commands(runs)
        out += struct.pack("<H", i) + bytes(7) + layout(own) + code + b"\x82\xff"
        every += [*segments, "", ""]
    count = sum(map(len, every)) + 1
    return _packed_long(0) + _packed_word(count) + out + b"\xff\xff", "\0".join([*every, ""]).encode(), count


def picture(kind: int, width: int, height: int, bits: int, data: bytes, method: int = 0, colors: int = 0, spots: bytes = b"", further: bytes = b"") -> bytes:
    """An internal picture file; ``colors`` black palette entries; ``further`` is a second picture behind the first."""
    payload = packed_picture(data, method)
    word = lambda n: struct.pack("<H", n << 1) if n < 1 << 15 else struct.pack("<I", n << 1 | 1)
    head = bytes([kind, method])
    if kind == METAFILE:
        head += bytes([8 << 1]) + struct.pack("<2H", width, height) + word(len(data)) + word(len(payload)) + word(len(spots)) + bytes(8)
    else:
        assert kind in (DIB, DDB)
        head += word(0) * 2 + bytes([1 << 1, bits << 1]) + word(width) + word(height) + word(colors) + word(0) + word(len(payload)) + word(len(spots)) + bytes(8)
    first = head + bytes(4 * colors) + payload + spots
    return struct.pack("<2H2I", 0x706C, 2, 12, 12 + len(first)) + first + further if further else struct.pack("<2HI", 0x706C, 1, 8) + first


def hotspots(spots: list[tuple]) -> bytes:
    """A hotspot block of ``(ids, x, y, w, h, hash, name, target)``."""
    records = b"".join(HOTSPOT.pack(*ids, x, y, w, h, value) for ids, x, y, w, h, value, _, _ in spots)
    return struct.pack("<BHI", 1, len(spots), 3) + records + b"mac" + b"".join(f"{name}\0{target}\0".encode() for *_, name, target in spots)


def archive(
    topics: list[dict], title: str = "A title", minor: int = 21, lz77: bool = False, files: dict[str, bytes | None] | None = None, aliases: bool = False,
    phrases: tuple[str, list[bytes]] | None = None, copyright: str | None = None, starting: str | None = None, said_minor: int | None = None, loop: bool = False,
) -> bytes:
    """An archive of ``{"title": str, "hash": int, "paragraphs": [runs], "tables": [cells], "layout": flags}``.

    Every paragraph and table is a record of its own; ``phrases`` are the kind of phrase table and its phrases; ``said_minor`` is what
    the metadata claims instead of ``minor``; with ``loop`` the last record leads to the first; ``files`` replace those of their names, or take them away (null).
    """
    before_31, size = minor <= 16, 2048 if minor <= 16 else 16384
    room = (2036 if before_31 else 4084) * (8 if lz77 else 9) // 9
    bodies: list[bytearray] = [bytearray()]
    placed: list[tuple[int, int]] = []  # virtual offset, and where in its block
    plan, table = [], Phrases(phrases[1]) if phrases else None
    for t in topics:
        plan.append((TOPIC, b"", (t["title"] + "\0").encode(), 0, t))
        plan += [(TEXT, *text_record(p, t.get("layout", 0)), None) for p in t.get("paragraphs", ())]
        plan += [(TABLE, *table_record(x, i % 4), None) for i, x in enumerate(t.get("tables", ()))]
    for kind, one, two, _, _ in plan:
        held = two
        if phrases:
            packed = (packed_hall if phrases[0] in ("hall", "indexed") else packed_pairs)(two, table)
            held = packed if len(packed) < len(two) else two
        n = 21 + len(one) + len(held)
        if n > room:
            raise ValueError(f"a record of {n} bytes; {room} fit")
        if len(bodies[-1]) + n > room:
            bodies.append(bytearray())
        placed.append(((len(bodies) - 1) * size + len(bodies[-1]), len(bodies) - 1))
        bodies[-1] += struct.pack("<5IB", n, len(two), 0, 0, 21 + len(one), kind) + one + held
    contexts, running = [], 0
    for i, (kind, _, _, count, t) in enumerate(plan):
        at, block = placed[i]
        following = placed[i + 1][0] if i + 1 < len(plan) else None
        end = 12 if loop else 0x7FFFFFFF if before_31 else 0xFFFFFFFF
        link = end if following is None else following - at if before_31 else following + 12
        struct.pack_into("<I", bodies[block], at - block * size + 12, link)
        if kind == TOPIC:
            contexts.append((t["hash"], running))
            if aliases:
                contexts.append((t["hash"] ^ 0xFFFF, running))
        running += count
        if not before_31 and following is not None and following // 16384 != at // 16384:
            running = following // 16384 * 32768
    fixed = 2048 if before_31 else 4096
    firsts, lasts = [0xFFFFFFFF] * len(bodies), [0xFFFFFFFF] * len(bodies)
    for at, block in placed:
        firsts[block], lasts[block] = min(firsts[block], at + 12), at + 12
    held = b"".join((struct.pack("<3I", last, first, last) + (packed_lz77(bytes(b)) if lz77 else bytes(b))).ljust(fixed, b"\0") for b, first, last in zip(bodies, firsts, lasts, strict=True))
    system = struct.pack("<3H", 0x036C, said_minor or minor, 0) + (struct.pack("<IH", 0, 4 if lz77 else 0) if (said_minor or minor) >= 10 else b"")
    for kind, said in ((1, title), (2, copyright), (4, starting)):
        if said is not None:
            system += struct.pack("<2H", kind, len(said.encode()) + 1) + said.encode() + b"\0"
    fonts = struct.pack("<4H", 1, 4, 8, 28) + b"Helv".ljust(20, b"\0") + b"".join(struct.pack("<BBBH6s", i, 20, 3, 0, b"") for i in range(4))
    every = {"|SYSTEM": system, "|TOPIC": held, "|FONT": fonts, "|CONTEXT": tree([struct.pack("<2I", h, o) for h, o in sorted(contexts)], number_key), **(phrase_files(*phrases) if phrases else {}), **(files or {})}
    out, places = bytearray(8), []
    for name, data in every.items():
        if data is None:
            continue
        places.append((name, len(out)))
        out += struct.pack("<2IB", len(data) + 9, len(data), 0) + data
    start = len(out)
    directory = tree([n.encode() + b"\0" + struct.pack("<I", o) for n, o in sorted(places)], string_key, 8, 1024)
    out += struct.pack("<2IB", len(directory) + 9, len(directory), 0) + directory
    struct.pack_into("<2I", out, 0, 0x00035F3F, start)
    return bytes(out)

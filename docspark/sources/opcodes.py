"""The command streams of topic records (O1-O7, O14): from bytes to a list of commands; what they mean is joined in Spark."""

from __future__ import annotations

from collections.abc import Iterator

from docspark.sources.container import TABLE, TEXT

# Fixed values of the format: command bytes.
FONT, BLANK, PARAGRAPH, TAB, LINK_END, END = 0x80, 0x81, 0x82, 0x83, 0x89, 0xFF
PICTURES, JUMPS, POPUPS = (0x86, 0x87, 0x88), (0xE3, 0xCC), (0xE6, 0xC8)
#: The end of a table's cell, or of a record, which ends a paragraph; no command byte.
CELL = -1
#: Commands that say the next segment of text and no more than one character behind it; all that take a segment, links aside.
SAY = (BLANK, PARAGRAPH, TAB)
TAKE = (FONT, *SAY, *PICTURES, END)


class Cut(Exception):
    """The commands end within an operand."""


class Bytes:
    """A position in a byte string; a cut number has the bytes that are left and moves to the end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, size: int) -> int:
        held = self.data[self.at : self.at + size]
        self.at = min(self.at + size, len(self.data))
        return int.from_bytes(held, "little")

    def has(self, size: int) -> bool:
        return self.at + size <= len(self.data)

    def skip(self, size: int) -> None:
        self.at += size

    def _packed(self, wide: int, slim: int) -> tuple[int, bool]:
        left = len(self.data) - self.at
        odd = left > 0 and self.data[self.at] & 1
        size = wide if odd else slim
        if left < size:
            self.at = len(self.data)
            raise Cut
        return self.take(size) >> 1, bool(odd)

    def scan_long(self) -> int:
        try:
            value, odd = self._packed(4, 2)
        except Cut:
            return 0
        return (value - (0x40000000 if odd else 0x4000)) & 0xFFFFFFFF

    def scan_word(self) -> int:
        try:
            return self._packed(2, 1)[0]
        except Cut:
            return 0

    def scan_int(self) -> int:
        try:
            value, odd = self._packed(2, 1)
        except Cut:
            return 0
        return value - (0x4000 if odd else 0x40)


def offset_delta(link1: bytes) -> int:
    """How many characters a record counts for."""
    at = Bytes(link1)
    at.scan_long()
    return at.scan_word()


def _skip_layout(at: Bytes) -> None:
    """The paragraph layout that a 16-bit field announces."""
    flags = at.take(2) if at.has(2) else 0
    if flags & 0x0001:
        at.scan_long()
    for i in range(1, 7):
        if flags >> i & 1:
            at.scan_int()
    if flags & 0x0100:
        at.skip(3)
    if flags & 0x0200:
        for _ in range(max(0, at.scan_int())):
            if at.scan_word() & 0x4000:
                at.scan_word()


def _picture(at: Bytes) -> int | None:
    """The number of the picture that the operand names; embedded and unknown ones have none."""
    if not at.has(2):
        return None
    kind, size = at.take(1), at.scan_long()
    body, number = at.at, None
    if kind == 0x22:
        at.scan_word()
    if kind in (0x22, 0x03) and at.has(4) and at.take(2) == 0:
        number = at.take(2)
    at.at = min(body + size, len(at.data))
    return number


def _stream(at: Bytes) -> Iterator[tuple[int, int | None]]:
    """Commands with their operand, up to the end command; unknown bytes are skipped."""
    while at.at < len(at.data):
        code = at.take(1)
        if code == FONT:
            yield code, at.take(2) if at.has(2) else 0
        elif code in PICTURES:
            yield code, _picture(at)
        elif code in JUMPS or code in POPUPS:
            yield code, at.take(4)
        elif code in (*SAY, LINK_END, END):
            yield code, None
            if code == END:
                return


def commands(kind: int, link1: bytes) -> Iterator[tuple[int, int | None]]:
    """The commands of a text or table record, each cell closed by ``CELL``."""
    if not link1 or kind not in (TEXT, TABLE):
        return
    at = Bytes(link1)
    at.scan_long()
    at.scan_word()
    if kind == TEXT:
        at.skip(4)
        _skip_layout(at)
        yield from _stream(at)
        yield CELL, None
        return
    columns, flags = at.take(1), at.take(1)
    if flags & 3 in (0, 2):
        at.skip(2)
    at.skip(4 * columns)
    while at.at + 2 <= len(link1):
        column = at.take(2)
        if column >= 0x8000:  # no further cell
            break
        at.skip(3 + 4)
        if not at.has(2):
            break
        _skip_layout(at)
        yield from _stream(at)
        yield CELL, None

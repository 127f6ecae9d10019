"""The index trees of help archives as a data source that seeks.

``spark.read.format("helpindex").option("table", t).load(path)`` reads the directory (``t`` = ``files``), ``context``, ``keywords`` or ``titles`` of the archive at ``path``, or of
all below it. Conditions on the table's key (``name``, ``hash``, ``keyword``, ``topic_offset``) are pushed down: a tree is
walked from its root to those leaves that can hold such keys, by range reads of single pages; the rest of the archive is not read. A partition is
a sub-tree below a root. An inner page whose keys do not ascend is walked whole, so a tree in another order costs time and no row.

Paths are opened by ``pyarrow.fs`` in tasks, so they must be in a file system that it knows and that all executors see. ``pages_read`` is how many
pages a row's partition had read by then. A broken archive gives the rows before the fault and one with ``_error``, or raises with ``mode`` ``FAILFAST``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from docspark.sources import container as c
from docspark.sources.codecs import HelpError

Range = tuple[object, object]  # both ends belong to it; null is open
_PLANNED_FILES = 256


def _string(data: bytes, at: int) -> tuple[str, int]:
    return c.terminated(data, at)


def _number(skip: int) -> Callable[[bytes, int], tuple[int, int]]:
    return lambda data, at: (c.number(data, at, 4), at + skip)


@dataclass(frozen=True)
class Kind:
    """One of the trees: its internal file, its key's column, and how leaves and inner pages are read."""

    file: str | None
    key: str
    schema: str
    leaf_header: int
    entry: Callable[[bytes, int], tuple[tuple, int]]
    inner: Callable[[bytes, int], tuple[object, int]]


KINDS = {
    "files": Kind(None, "name", "name string, offset bigint, used_space bigint", 8, c.named_offset, _string),
    "context": Kind("|CONTEXT", "hash", "hash bigint, topic_offset bigint", 8, c.hash_offset, _number(4)),
    "keywords": Kind("|KWBTREE", "keyword", "keyword string, topic_offsets array<bigint>", 4, c.named_offset, _string),
    "titles": Kind("|TTLBTREE", "topic_offset", "topic_offset bigint, title string", 4, c.offset_title, _number(4)),
}


def _order(key: object) -> object:
    return key.encode("utf-8", "surrogatepass") if isinstance(key, str) else key


def meets(low: object, high: object, wanted: list[Range]) -> bool:
    """Whether some key between ``low`` and ``high`` (null is open) is wanted."""
    return any((a is None or high is None or _order(a) <= _order(high)) and (b is None or low is None or _order(low) <= _order(b)) for a, b in wanted)


class Tree:
    """A tree in an open file; counts the pages it reads."""

    def __init__(self, file, start: int, kind: Kind):
        self.file, self.start, self.kind, self.pages_read = file, start, kind, 0
        head = file.read_at(c.TREE_HEADER, start)
        if c.number(head, 0, 2) != c.TREE_MAGIC:
            raise HelpError("no B-tree")
        self.inner = kind.inner
        if kind.file == "|CONTEXT" and c.number(head, 2, 2) & 0x0400:
            self.inner = _number(6)
        self.page_size, self.root, self.pages, self.levels = c.number(head, 4, 2), c.number(head, 0x1A, 2), c.number(head, 0x1E, 2), c.number(head, 0x20, 2)

    def _page(self, number: int) -> bytes:
        if number >= self.pages:
            raise HelpError(f"B-tree page {number} of {self.pages}")
        self.pages_read += 1
        return self.file.read_at(self.page_size, self.start + c.TREE_HEADER + number * self.page_size)

    def children(self, number: int, wanted: list[Range]) -> list[int]:
        """The pages below an inner page that can hold wanted keys."""
        held = self._page(number)
        below, keys, at = [c.number(held, 4, 2)], [], 6
        for _ in range(c.number(held, 2, 2, "B-tree page")):
            key, at = self.inner(held, at)
            keys.append(key)
            below.append(c.number(held, at, 2))
            at += 2
        if any(_order(a) > _order(b) for a, b in zip(keys, keys[1:], strict=False)):
            return below
        return [page for page, low, high in zip(below, [None, *keys], [*keys, None], strict=True) if meets(low, high, wanted)]

    def leaves(self, number: int, level: int, wanted: list[Range], seen: set[int]) -> Iterator[tuple]:
        """The wanted entries below a page; a page is visited once."""
        todo = [(number, level)]
        while todo:
            page, level = todo.pop()
            if page in seen:
                raise HelpError(f"B-tree page {page} of {self.pages}")
            seen.add(page)
            if level > 1:
                todo += [(x, level - 1) for x in reversed(self.children(page, wanted))]
                continue
            held, at = self._page(page), self.kind.leaf_header
            for _ in range(c.number(held, 2, 2, "B-tree page")):
                found, at = self.kind.entry(held, at)
                if meets(found[0], found[0], wanted):
                    yield found

    def subtrees(self, wanted: list[Range]) -> list[tuple[int, int]]:
        """``(page, level)`` of what is to be walked: the wanted pages below the root."""
        if not self.levels or not self.pages:
            return []
        if self.levels == 1:
            return [(self.root, 1)]
        return [(page, self.levels - 1) for page in self.children(self.root, wanted)]


def _internal(file, name: str | None) -> int | None:
    """Where an internal file's (null: the directory's) bytes begin; null where there is none. Only pages on the way are read."""
    head = file.read_at(8, 0)
    if len(head) < 8:
        raise HelpError("under 8 bytes")
    if c.number(head, 0, 4) != c.MAGIC:
        raise HelpError(f"bad magic {c.number(head, 0, 4):#010x}")
    directory = c.number(head, 4, 4) + c.FILE_HEADER
    if name is None:
        return directory
    tree, at = Tree(file, directory, KINDS["files"]), None
    for page, level in tree.subtrees([(name, name)]):
        for _, offset in tree.leaves(page, level, [(name, name)], set()):
            at = offset + c.FILE_HEADER
    return at


@dataclass
class _Part(InputPartition):
    """Sub-trees of one archive, or (null) all that is wanted of several."""

    paths: list[str]
    start: int | None = None
    subtree: tuple[int, int] | None = None

    def __post_init__(self):
        super().__init__(0)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.kind = options, KINDS[options.get("table", "files").lower()]
        self.wanted: list[Range] = [(None, None)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == (self.kind.key,) and getattr(f, "value", None) is not None
            if own and isinstance(f, EqualTo | In):
                values = list(f.value) if isinstance(f, In) else [f.value]
                self.wanted = [(v, v) for v in dict.fromkeys(values) if v is not None and meets(v, v, self.wanted)]
            elif own and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                up = isinstance(f, GreaterThan | GreaterThanOrEqual)
                self.wanted = [x for a, b in self.wanted if (x := self._within(a, b, f.value, up)) is not None]
                if isinstance(f, GreaterThan | LessThan):
                    yield f  # Spark leaves the end itself out
            else:
                yield f

    @staticmethod
    def _within(a: object, b: object, value: object, up: bool) -> Range | None:
        if up:
            a = value if a is None or _order(a) < _order(value) else a
        else:
            b = value if b is None or _order(b) > _order(value) else b
        return None if a is not None and b is not None and _order(a) > _order(b) else (a, b)

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.options["path"])
        info = fs.get_file_info(root)
        if info.type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            paths = sorted(x.path for x in found if x.is_file and x.path.lower().endswith(".hlp"))
        else:
            paths = [root]
        if not self.wanted:
            return []
        if len(paths) > _PLANNED_FILES:  # each task looks at its own archives' roots
            return [_Part(paths[i : i + 16]) for i in range(0, len(paths), 16)]
        out: list[InputPartition] = []
        for path in paths:
            try:
                with fs.open_input_file(path) as file:
                    start = _internal(file, self.kind.file)
                    if start is not None:
                        out += [_Part([path], start, x) for x in Tree(file, start, self.kind).subtrees(self.wanted)]
            except HelpError:
                out.append(_Part([path]))  # its task tells what is wrong
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        fs, _ = _open(self.options["path"])
        width = len(_columns(self.kind.schema))
        for path in partition.paths:
            try:
                with fs.open_input_file(path) as file:
                    yield from self._rows(path, file, partition)
            except HelpError as e:
                if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                    raise
                yield (path, *[None] * width, None, str(e))

    def _rows(self, path: str, file, partition: _Part) -> Iterator[tuple]:
        start = _internal(file, self.kind.file) if partition.start is None else partition.start
        if start is None:
            return
        tree, seen = Tree(file, start, self.kind), set()
        postings = _internal(file, "|KWDATA") if self.kind.file == "|KWBTREE" else None
        for page, level in tree.subtrees(self.wanted) if partition.subtree is None else [partition.subtree]:
            for key, value in tree.leaves(page, level, self.wanted, seen):
                if self.kind.file is None:
                    row = key, value, c.number(file.read_at(c.FILE_HEADER, value), 4, 4, "internal file")
                elif self.kind.file == "|KWBTREE":
                    if postings is None:
                        return
                    n = c.number(file.read_at(2, postings + value), 0, 2, "posting list")
                    held = file.read_at(4 * n, postings + value + 2)
                    row = key, [c.number(held, 4 * i, 4, "posting list") for i in range(n)]
                else:
                    row = key, value
                yield (path, *row, tree.pages_read, None)


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


class HelpIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helpindex"

    def schema(self) -> str:
        return f"file string, {KINDS[self.options.get('table', 'files').lower()].schema}, pages_read int, _error string"

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options))


def read(spark: SparkSession, path: str, table: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``table`` (``files``, ``context``, ``keywords`` or ``titles``) of the archives at ``path``; Spark is told to push conditions down."""
    spark.dataSource.register(HelpIndex)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("helpindex").option("table", table).option("mode", mode).load(path)

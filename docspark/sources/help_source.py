"""Decoded tables of help archives as DataFrames.

Archives are read by ``binaryFile`` from any store that Spark reads, one archive a row, and decoded in the
partition that read it. ``decode`` gives one table lazily, from the parts of an archive that it needs; ``tables``
decodes every archive once, for all tables, into the shared folder. Relations between the tables
(identifiers, topics, pages) are left to Spark.

``mode`` is ``PERMISSIVE`` (a broken archive gives the rows before the fault and one row with ``_error``) or
``FAILFAST``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from docspark.functions.text import FORMATS
from docspark.operators import decoding
from docspark.operators.relational import unbroadcast
from docspark.sources import container as c
from docspark.sources import pictures
from docspark.sources.codecs import HelpError, phrase_table
from docspark.storage import Workspace


class Archive:
    """One archive, its parts decoded when first needed."""

    def __init__(self, data: bytes, minor: int | None, segment_blocks: int):
        self.container = c.Container(data)
        self.minor, self.segment_blocks = minor, segment_blocks
        self._held: dict[str, object] = {}

    def _once(self, name: str, make: Callable):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    @property
    def info(self) -> c.System:
        return self._once("info", lambda: c.system(self.container.read("|SYSTEM"), self.minor))

    @property
    def phrases(self) -> tuple[list[bytes], bool]:
        names = ("|PhrIndex", "|PhrImage", "|Phrases")
        return self._once("phrases", lambda: phrase_table({n: d for n in names if (d := self._readable(n)) is not None}, self.info.minor > 16))

    def _readable(self, name: str) -> bytes | None:
        try:
            return self.container.get(name)
        except HelpError:
            if name == "|Phrases":
                raise
            return None

    @property
    def fonts(self) -> list[tuple]:
        return self._once("fonts", lambda: c.fonts(d) if (d := self.container.get("|FONT")) is not None else [])

    @property
    def contexts(self) -> list[tuple[int, int]]:
        return self._once("contexts", lambda: c.contexts(d) if (d := self.container.get("|CONTEXT")) is not None else [])

    @property
    def blocks(self) -> list[tuple]:
        return self._once("blocks", lambda: c.blocks(self.container.read("|TOPIC"), self.info.block_size, self.info.lz77))


def _internal_files(a: Archive) -> Iterator[tuple]:
    for f in a.container.files():
        yield f.ordinal, f.name, f.offset, len(f.data), f.raw[: c.FILE_HEADER], f.data


def _system(a: Archive) -> Iterator[tuple]:
    i = a.info
    yield i.minor, i.flags, i.flags_ex, i.title, i.copyright, i.root_topic_offset, i.starting_topic, a.phrases[1]


def _phrases(a: Archive) -> Iterator[tuple]:
    yield from enumerate(a.phrases[0])


def _fonts(a: Archive) -> Iterator[tuple]:
    for i, (attributes, half_points, family, name) in enumerate(a.fonts):
        yield i, attributes, half_points, family, name, bool(attributes & 1), bool(attributes & 2), bool(attributes & 4)


def _contexts(a: Archive) -> Iterator[tuple]:
    for i, (value, offset) in enumerate(a.contexts):
        yield i, value, offset


def _titles(a: Archive) -> Iterator[tuple]:
    data = a.container.get("|TTLBTREE")
    yield from c.titles(data) if data is not None else ()


def _keywords(a: Archive) -> Iterator[tuple]:
    index, postings = a.container.get("|KWBTREE"), a.container.get("|KWDATA")
    if index is not None and postings is not None:
        for i, (word, offsets) in enumerate(c.keywords(index, postings)):
            yield i, word, offsets


def _topic_blocks(a: Archive) -> Iterator[tuple]:
    for i, held in enumerate(a.blocks):
        yield (i, *held)


def _segments(a: Archive) -> Iterator[tuple]:
    """Slices of the topic file, with one block of the next slice each."""
    info, data = a.info, a.container.read("|TOPIC")
    step = a.segment_blocks * info.block_size
    for seg, at in enumerate(range(0, len(data), step)):
        yield seg, a.segment_blocks, data[at : at + step + info.block_size], info.block_size, info.decompress_size, info.lz77, info.before_31, a.phrases[1], len(a.phrases[0])


def _images(a: Archive) -> Iterator[tuple]:
    for name in dict.fromkeys(n for n, _ in a.container.listed if n.startswith("|bm")):
        data = pictures.picture_file(a.container.read(name))
        yield name, "wmf" if pictures.is_wmf(data) else "bmp" if data[:2] == b"BM" else "raw", data


def _hotspots(a: Archive) -> Iterator[tuple]:
    for name in dict.fromkeys(n for n, _ in a.container.listed if n.startswith("|bm")):
        for i, spot in enumerate(pictures.hotspots(a.container.read(name)) or ()):
            yield (name, i, *spot)


#: Every table: its columns behind ``file``, and what decodes it.
TABLES: dict[str, tuple[str, Callable[[Archive], Iterator[tuple]]]] = {
    "internal_files": ("ord int, name string, offset bigint, used_space bigint, header binary, data binary", _internal_files),
    "system": ("minor_version int, flags int, flags_ex int, title string, copyright string, root_topic_offset bigint, starting_topic string, hall boolean", _system),
    "phrases": ("idx int, bytes binary", _phrases),
    "fonts": ("idx int, attributes int, half_points int, font_family int, name string, is_bold boolean, is_italic boolean, is_underline boolean", _fonts),
    "context": ("ord int, hash bigint, topic_offset bigint", _contexts),
    "titles": ("topic_offset bigint, title string", _titles),
    "raw_keywords": ("ord int, keyword string, topic_offsets array<bigint>", _keywords),
    "topic_blocks": ("block_no int, last_topic_link bigint, first_topic_link bigint, last_topic_header bigint, data binary", _topic_blocks),
    "segments": ("seg int, own_blocks int, raw binary, block_size int, decompress_size int, lz77 boolean, before_31 boolean, hall boolean, phrases int", _segments),
    "images": ("filename string, format string, data binary", _images),
    "hotspots": ("image string, ord int, x int, y int, w int, h int, action string, id0 int, id1 int, id2 int, hash bigint, name string, target string", _hotspots),
}
#: Tables that Spark makes of others (:mod:`docspark.operators.decoding`): their columns, and what they are made of.
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "records": ("rec_no int, record_type int, link_data1 binary, link_data2 binary, data_len2 bigint, next_block bigint, stream_offset bigint, delta int, before_31 boolean, title string", ("segments", "phrases")),
    "blocks": (f"rec_no int, block_no int, kind string, inlines {decoding.RUNS}, image string, placement string", ("segments", "phrases", "fonts", "context")),
}
#: Blocks of a topic file that one task decompresses and walks: 1 MB of them, up to 4 MB when unpacked.
SEGMENT_BLOCKS = 256
_BATCH_ROWS, _BATCH_BYTES = 2000, 8 << 20


def _kind(table: str) -> StructType:
    return StructType.fromDDL(f"file string, {(TABLES | DERIVED)[table][0]}, _error string")


def _rows(archive: Archive, path: str, table: str, width: int, mode: str) -> Iterator[tuple]:
    try:
        for row in TABLES[table][1](archive):
            yield path, *row, None
    except HelpError as e:
        if mode.upper() == "FAILFAST":
            raise
        yield path, *[None] * width, str(e)


def _archive(content: bytes | None, minor: int | None, segment_blocks: int) -> Archive:
    """The archive, or one whose every part tells the same fault."""
    try:
        return Archive(content or b"", minor, segment_blocks)
    except HelpError as e:
        broken = Archive.__new__(Archive)
        broken.container, broken.minor, broken.segment_blocks, broken._held = _Broken(e), minor, segment_blocks, {}
        return broken


def rows_of(path: str, content: bytes | None, table: str, minor: int | None, mode: str = "PERMISSIVE") -> Iterator[tuple]:
    """The rows of one of ``TABLES`` of one archive, ``file`` first and ``_error`` last."""
    return _rows(_archive(content, minor, SEGMENT_BLOCKS), path, table, len(schema_of(table)) - 2, mode)


def schema_of(table: str) -> StructType:
    """The schema of one of ``TABLES``, made without a session: table functions are analysed in a worker."""
    kinds = {"int": IntegerType(), "bigint": LongType(), "string": StringType(), "boolean": BooleanType(), "binary": BinaryType(), "array<bigint>": ArrayType(LongType())}
    columns = [x.split() for x in f"file string, {TABLES[table][0]}, _error string".split(", ")]
    return StructType([StructField(name, kinds[kind]) for name, kind in columns])


class _Broken:
    """A container that cannot be opened."""

    def __init__(self, fault: HelpError):
        self.fault = fault

    def __getattr__(self, name: str):
        raise self.fault


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    made = []
    for values, f in zip(zip(*held, strict=True), schema, strict=True):
        if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type):
            names = [x.name for x in f.type.value_type]
            values = [None if v is None else [dict(zip(names, x, strict=True)) for x in v] for v in values]
        made.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _decoded(batches: Iterator[pa.RecordBatch], schemas: dict[str, pa.Schema], minor: int | None, mode: str, segment_blocks: int = SEGMENT_BLOCKS) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Batches of rows of the tables in ``schemas``, each archive opened once."""
    held: dict[str, list[tuple]] = {name: [] for name in schemas}
    size = dict.fromkeys(schemas, 0)
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            archive = _archive(content, minor, segment_blocks)
            for name in schemas:
                for row in _rows(archive, path, name, len(schemas[name]) - 2, mode):
                    held[name].append(row)
                    size[name] += sum(len(x) for x in row if isinstance(x, bytes))
                    if len(held[name]) >= _BATCH_ROWS or size[name] >= _BATCH_BYTES:
                        yield name, _batch(held[name], schemas[name])
                        held[name], size[name] = [], 0
    for name, rows in held.items():
        if rows:
            yield name, _batch(rows, schemas[name])


def decode(archives: DataFrame, table: str, format_version: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """``table`` of every row of ``archives(path, content)``, with ``file`` and ``_error``. Records and blocks take several passes, so no stream has them."""
    if table in DERIVED:
        if archives.isStreaming:
            raise ValueError(f"{table} are made in several passes over stored archives")
        return tables(archives, format_version, mode, (table,))[table]
    minor, kind = FORMATS[format_version] if format_version else None, _kind(table)
    schemas = {table: to_arrow_schema(kind)}

    def run(batches):
        for _, batch in _decoded(batches, schemas, minor, mode):
            yield batch

    return archives.select("path", "content").mapInArrow(run, kind)


def _parts(archives: DataFrame, minor: int | None, mode: str, names: tuple[str, ...], segment_blocks: int, work: Workspace) -> dict[str, DataFrame]:
    """The tables ``names``: every archive is opened once, and gives one file a table and task."""
    kinds = {name: _kind(name) for name in names}
    schemas = {name: to_arrow_schema(kind) for name, kind in kinds.items()}
    schema = StructType.fromDDL("tbl string, " + ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for name, batch in _decoded(batches, schemas, minor, mode, segment_blocks):
            n = batch.num_rows
            made = [pa.array([name] * n, pa.string())]
            made += [pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)) if f.name == name else pa.nulls(n, f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    found = work.table(archives.select("path", "content").mapInArrow(run, schema), "parts", by=["tbl"])
    return {name: unbroadcast(found.where(F.col("tbl") == name).select(f"{name}.*")) for name in names}


def _with_faults(rows: DataFrame, faults: DataFrame, table: str, mode: str) -> DataFrame:
    """``rows`` of a derived table, and a row with ``_error`` for each of ``faults(file, message)``."""
    kind = _kind(table)
    message = F.col("message") if mode.upper() != "FAILFAST" else F.raise_error(F.concat(F.lit("HelpError: "), "message"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:-1]]
    return rows.select(*kind.names[:-1], F.lit(None).cast("string").alias("_error")).unionByName(faults.select("file", *nothing, message.cast("string").alias("_error")))


def tables(archives: DataFrame, format_version: str | None = None, mode: str = "PERMISSIVE", names: tuple[str, ...] = (*TABLES, *DERIVED), segment_blocks: int = SEGMENT_BLOCKS) -> dict[str, DataFrame]:
    """The tables ``names`` of ``archives(path, content)``: every archive is opened once, records and blocks are made of its parts by Spark."""
    work = Workspace(archives.sparkSession, "help")
    wanted = dict.fromkeys(x for name in names for x in (DERIVED[name][1] if name in DERIVED else (name,)))
    found = _parts(archives, FORMATS[format_version] if format_version else None, mode, tuple(wanted), segment_blocks, work)
    if any(name in DERIVED for name in names):
        record, first = decoding.records(found["segments"].where("_error is null"), found["phrases"], work)
        faults = found["segments"].where("_error is not null").select("file", F.col("_error").alias("message")).unionByName(first.select("file", "message"))
        found["records"] = unbroadcast(_with_faults(record, faults, "records", mode))
        if "blocks" in names:
            unread = found["fonts"].where("_error is not null").select("file", F.col("_error").alias("message")).unionByName(found["context"].where("_error is not null").select("file", F.col("_error").alias("message")))
            own = record.join(unread.select("file").distinct(), "file", "left_anti")
            every = faults.unionByName(unread).groupBy("file").agg(F.min("message").alias("message"))
            found["blocks"] = unbroadcast(_with_faults(work.table(decoding.blocks(own, found["fonts"], found["context"]), "blocks"), every, "blocks", mode))
    return {name: found[name] for name in names}


def read(spark: SparkSession, path: str, table: str, format_version: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """``table`` of every ``.hlp`` file below ``path``."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hlp,HLP}").option("recursiveFileLookup", "true").load(path)
    return decode(archives, table, format_version, mode)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Contents files (``.cnt``): directives, headings and links, one line a row."""
    lines = spark.read.format("text").option("pathGlobFilter", "*.{cnt,CNT}").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    line = lines.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line <> ''")
    body = F.regexp_replace("line", r"^[0-9]+ ", "")
    parts = F.split(F.regexp_replace(body, r"\\=", "\u0001"), "=", 2)
    restored = lambda x: F.replace(x, F.lit("\u0001"), F.lit("="))
    kind = F.when(F.col("line").startswith(":"), "directive").when(F.size(parts) == 2, "link").otherwise("heading")
    return line.select(
        "file", "line_no", kind.alias("kind"), F.expr("try_cast(regexp_extract(line, '^([0-9]+) ', 1) as int)").alias("level"),
        restored(parts[0]).alias("text"), restored(F.get(parts, F.lit(1))).alias("target"),
    )

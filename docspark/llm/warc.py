"""WARC archives as a PySpark Python data source, with deduplicated writing of pages.

Reading (``spark.read.format("warc")``). A file is one partition, small files share one
(``partitionBytes``). The reader parses a record's headers first; conditions on ``record_type``, ``target_uri``
and ``record_id`` that Spark pushes down (``spark.sql.python.filterPushdown.enabled``) are decided on
the headers, and an unwanted record's payload is neither decompressed nor decoded: plain
records are skipped by ``Content-Length``, gzip members by the skip-lengths field ``sl`` that the writer
leaves in the member's header (members without it have to be inflated up to their end). Option
``payload=false`` skips payloads of all records.

Writing (``df.write.format("warc")``). Every task writes files of its own, rolled at ``fileBytes``, into the
job's hidden folder; when the job commits, the driver moves the files of the tasks that succeeded out of it and
removes the rest, so a failed or repeated task leaves nothing behind. One gzip member a record
(``compression=none``: plain).

Paths may be in any file system that ``pyarrow.fs`` opens and that all executors see.

Defined cases: a null payload is empty; headers of unusual case and unknown headers are kept in
``headers``, the values of a repeated one joined by ", " (the first counts where one is needed); a cut or broken
record raises an error unless ``mode=PERMISSIVE``, which ends that file there; an empty folder gives no
rows; a payload may have any length that fits into memory once, and is compared whole by SHA-256; of rows that
repeat the largest identifier all are responses; further columns of pages are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from docspark.storage import Workspace

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, headers map<string,string>, payload binary"
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
_FILTERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id"}
_HEAD = struct.Struct("<4sIBBH2sHII")  # a gzip member's header with one extra field of two lengths
_BATCH_BYTES = 8 << 20


class BadRecord(ValueError):
    """Not a whole WARC record."""


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pa.fs.LocalFileSystem(), path


def _safe(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build(record_id: str, record_type: str, uri: str | None, date: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response or revisit record of an HTTP answer; a revisit has the answer's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type != "revisit" else b"")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _safe(uri)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if record_type == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{refers_to}>"))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """The record as one gzip member whose header tells its compressed and plain lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = _HEAD.size + len(body) + 8
    lengths = (total, len(record)) if max(total, len(record)) < 1 << 32 else (0, 0)
    return _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, *lengths) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Source:
    """Records of one open file: headers first, bodies on demand."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def _read(self, at: int, n: int) -> bytes:
        return bytes(self.file.read_at(max(0, min(n, self.size - at)), at))

    def records(self) -> Iterator[tuple[_Headers, callable]]:
        """Headers and a function that gives the block; the next step goes on behind the record either way."""
        while self.at < self.size:
            first = self._read(self.at, 2)
            yield from self._gzip() if first == b"\x1f\x8b" else self._plain()

    def _plain(self):
        start, size = self.at, 4096
        while True:
            held = self._read(start, size)
            lead = len(held) - len(held.lstrip(b"\r\n"))
            end = held.find(b"\r\n\r\n", lead)
            if end >= 0 or len(held) < size:
                break
            size *= 4
        if lead == len(held):
            self.at = self.size
            return
        if end < 0:
            raise BadRecord("cut headers")
        headers = _headers(held[lead:end])
        body, length = start + end + 4, _length(headers)
        if body + length > self.size:
            raise BadRecord("cut block")
        yield headers, lambda: self._read(body, length)
        self.at = body + length

    def _gzip(self):
        start = self.at
        head = self._read(start, _HEAD.size)
        total = 0
        if len(head) == _HEAD.size and head[3] == 4 and head[12:14] == b"sl":
            total = _HEAD.unpack(head)[7]
        inflate, plain, at, step = zlib.decompressobj(31), bytearray(), start, min(total or 65536, 65536)
        while (end := plain.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            held = inflate.unconsumed_tail or self._read(at, step)
            if not inflate.unconsumed_tail:
                at += len(held)
            if not held:
                raise BadRecord("cut gzip member")
            plain += inflate.decompress(held, 4096)
        if end < 0:
            if plain.strip():
                raise BadRecord("no WARC headers")
            self.at = at - len(inflate.unused_data)
            return
        headers = _headers(bytes(plain[:end]).lstrip(b"\r\n"))
        length, done = _length(headers), False

        def rest() -> bytes:
            nonlocal at, done
            done = True
            while not inflate.eof:
                held = inflate.unconsumed_tail or self._read(at, 1 << 20)
                if not inflate.unconsumed_tail:
                    at += len(held)
                if not held:
                    raise BadRecord("cut gzip member")
                plain.extend(inflate.decompress(held))
            block = bytes(plain[end + 4 : end + 4 + length])
            if len(block) < length:
                raise BadRecord("cut block")
            return block

        yield headers, rest
        if total and not done:
            self.at = start + total
        else:
            if not done:
                rest()
            self.at = at - len(inflate.unused_data)


class _Headers(dict):
    """A record's headers by lower-case name, the first of each; ``all`` has every value."""

    def __init__(self):
        super().__init__()
        self.all: dict[str, str] = {}


def _headers(raw: bytes) -> _Headers:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC version line")
    out = _Headers()
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out.setdefault(name, value)
            out.all[name] = f"{out.all[name]}, {value}" if name in out.all else value
    return out


def _length(headers: dict[str, str]) -> int:
    try:
        return int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise BadRecord("no Content-Length") from e


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _hex(digest: str | None) -> str | None:
    """``sha1:`` in base 32 (or hexadecimal) as bare lower-case hexadecimal."""
    name, _, value = (digest or "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """An HTTP answer's body and the length its headers tell; other blocks are their own payload."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return body, int(value)
    return body, None


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.partition_bytes = int(options.get("partitionbytes", 64 << 20))
        self.wanted: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and len(name) == 1 and name[0] in _FILTERS:
                kind = "starts" if isinstance(f, StringStartsWith) else "any" if isinstance(f, IsNotNull) else "is"
                values = () if kind == "any" else tuple(f.value) if isinstance(f, In) else (f.value,)
                self.wanted.append((_FILTERS[name[0]], kind, values))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = re.compile(r"/[._][^/]*")
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not hidden.search(x.path, len(path.rstrip("/"))))
        parts: list[_Files] = []
        held = self.partition_bytes
        for name, size in files:
            if held + size > self.partition_bytes:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(name)
            held += size
        return parts or [_Files([])]

    def _skipped(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.wanted:
            said = headers.get(name)
            said = _bare(said) if name == "warc-record-id" else said
            if said is None or (kind == "is" and said not in values) or (kind == "starts" and not said.startswith(values)):
                return True
        return False

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                try:
                    for headers, block in _Source(file, file.size()).records():
                        if self._skipped(headers):
                            continue
                        row, size = self._row(headers, block)
                        rows.append(row)
                        held += size
                        if held > _BATCH_BYTES or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                except (BadRecord, zlib.error):
                    if not self.permissive:
                        raise
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _row(self, headers: _Headers, block) -> tuple[dict, int]:
        revisit = headers.get("warc-type") == "revisit"
        payload = told = None
        if revisit or self.with_payload:
            payload, told = _payload(headers, block())
        size = told if revisit or payload is None else len(payload)
        body = payload if self.with_payload and not revisit else None
        row = {
            "record_id": _bare(headers.get("warc-record-id")), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"), "refers_to": _bare(headers.get("warc-refers-to")), "payload_bytes": size,
            "payload_digest": _hex(headers.get("warc-payload-digest")), "headers": list(headers.all.items()), "payload": body,
        }
        return row, 1024 + len(body or b"")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns ``record_id, record_type, target_uri, date, payload, payload_digest, payload_bytes, refers_to``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip").lower() == "gzip"
        self.file_bytes = int(options.get("filebytes", 128 << 20))
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _open(self.path)
        fs.create_dir(f"{path}/{self.job}", recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                record = build(r["record_id"], r["record_type"], r["target_uri"], r["date"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"])
                data = member(record) if self.gzip else record
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = fs.open_output_stream(f"{path}/{self.job}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, path = _open(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.move(f"{path}/{self.job}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove the job's folder with what failed tasks left in it."""
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/{self.job}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; choose a new folder")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark push conditions down to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def to_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2026-01-01T00:00:00Z", salts: int = 16) -> DataFrame:
    """WARC records of ``pages(page_id, url, html)``, one a row.

    Of records with equal payloads of at least ``least_bytes`` that with the largest identifier is the
    response, the others revisit it (rows that repeat that identifier are responses too; where all
    identifiers are null, all are responses). Equal means equal SHA-256; shorter ones are responses. The
    pages of one payload, however many, are dealt over ``salts`` join keys.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("key", F.sha2("payload", 256))
    best = own.where(F.col("payload_bytes") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = dealt.join(best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["key", "salt"], "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    urn = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("null")))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.sha1("payload").alias("payload_digest"), "payload_bytes", F.when(revisit, urn(F.col("best"))).alias("refers_to"),
    )


def archive(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write ``pages`` as archives below ``path`` (default: a new folder in the shared one); the folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or Workspace(spark, "warc").folder("archives")
    to_records(pages).write.format("warc").options(**options).mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of all archives below ``path``."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


#: Written and read back, in DuckDB SQL.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS k FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY k) END AS best FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best IS NULL OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id <> best THEN best END AS refers_to FROM r
"""

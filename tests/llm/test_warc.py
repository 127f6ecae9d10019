from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docspark.llm import warc
from docspark.llm.queries import op8_warc

BIG = "<p>é</p>" * 200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, BIG), (4, "http://b/", "small"), (5, "http://c/", "small"), (6, "http://d/", None), (7, "http://e/", ""), (None, "http://f/", BIG), (3, None, BIG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, pages, compression, tmp_path):
    path = warc.archive(pages, f"{tmp_path}/out", compression=compression, fileBytes="1500")
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in rows)
    urn = "urn:page:"
    assert kinds == sorted(
        [(urn + "1", "revisit", urn + "3"), (urn + "2", "revisit", urn + "3"), (urn + "null", "revisit", urn + "3")]
        + [(urn + x, "response", None) for x in "334567"]
    )
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() and r["payload_bytes"] == len(r["payload"])
        else:
            assert r["payload"] is None and r["payload_bytes"] == len(BIG.encode()) and r["headers"]["warc-profile"]
    assert {r["target_uri"] for r in rows if r["record_id"].endswith(":2")} == {"http://a/2%0D%0AX: y"}


def test_pushdown_skips_payloads(spark, pages, tmp_path, monkeypatch):
    path = warc.archive(pages, f"{tmp_path}/out")
    wanted = warc.read(spark, path).where((F.col("record_type") == "revisit") & F.col("record_id").isin("urn:page:1", "urn:page:4"))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" +-:*()0123456789").startswith("Filter") and ("record_type" in line or "record_id" in line)]
    assert [r["record_id"] for r in wanted.collect()] == ["urn:page:1"]
    starts = warc.read(spark, path).where(F.col("target_uri").startswith("http://a/")).collect()
    assert sorted(r["record_id"] for r in starts) == ["urn:page:1", "urn:page:2"]
    # the reader alone: unwanted blocks are never asked for
    reader = warc.WarcReader({"path": path})
    pushed = [warc.IsNotNull(("record_type",)), warc.EqualTo(("record_type",), "revisit")]
    assert list(reader.pushFilters([*pushed, warc.EqualTo(("date",), "x"), warc.IsNotNull(("date",))])) == [warc.EqualTo(("date",), "x"), warc.IsNotNull(("date",))]
    asked = []
    plain = warc._payload
    monkeypatch.setattr(warc, "_payload", lambda headers, block: asked.append(headers["warc-type"]) or plain(headers, block))
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(rows) == 3 and set(asked) == {"revisit"}
    bare = warc.WarcReader({"path": path, "payload": "false", "partitionbytes": "1"})
    assert all(len(p.paths) == 1 for p in bare.partitions())
    assert all(r["payload"] is None for p in bare.partitions() for batch in bare.read(p) for r in batch.to_pylist())


def record(uri, block):
    return f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/plain\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    blocks = {"a": b"one\r\n\r\nWARC/1.0\r\n", "b": b"", "c": bytes(range(256)) * 300}
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(record(k, v)) for k, v in blocks.items()))
    (tmp_path / "y.warc").write_bytes(b"".join(record(k, v) for k, v in blocks.items()))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r["target_uri"], bytes(r["payload"])) for r in rows) == sorted([*blocks.items(), *blocks.items()])
    only = warc.read(spark, str(tmp_path)).where("target_uri = 'c'").collect()
    assert [bytes(r["payload"]) for r in only] == [blocks["c"]] * 2


def test_repeated_headers_are_kept(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record("a", b"x").replace(b"Content-Type:", b"WARC-Concurrent-To: <u:1>\r\nwarc-concurrent-to: <u:2>\r\nWARC-Target-URI: b\r\nContent-Type:"))
    row = warc.read(spark, str(tmp_path)).first()
    assert row["target_uri"] == "a" and row["headers"]["warc-concurrent-to"] == "<u:1>, <u:2>" and row["headers"]["warc-target-uri"] == "a, b"


def test_failed_writes_leave_nothing(spark, tmp_path):
    bad = spark.range(4).select(F.lit("i").alias("record_id"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("target_uri"), F.lit("d").alias("date"), F.lit(b"x").alias("payload"), F.when(F.col("id") < 3, "00").otherwise("no").alias("payload_digest"), F.lit(1).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_to"))
    warc.register(spark)
    with pytest.raises(Exception, match="non-hexadecimal"):
        bad.write.format("warc").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    bad.where("id < 3").write.format("warc").mode("append").save(str(tmp_path / "out"))
    assert all(x.name.startswith("part-") for x in (tmp_path / "out").iterdir()) and warc.read(spark, str(tmp_path / "out")).count() == 3


def test_broken_archives(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(record("a", b"x") + record("b", b"yyyy")[:-6])
    (tmp_path / "y.warc.gz").write_bytes(warc.member(record("c", b"z")) + warc.member(record("d", b"w" * 5000))[:-30])
    with pytest.raises(Exception, match="cut"):
        warc.read(spark, str(tmp_path)).collect()
    rows = warc.read(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sorted(r["target_uri"] for r in rows) == ["a", "c"]
    (tmp_path / "empty").mkdir()
    assert warc.read(spark, str(tmp_path / "empty")).collect() == []


def test_members_are_plain_gzip(tmp_path):
    data = record("a", b"hello" * 100)
    assert gzip.decompress(warc.member(data)) == data


def test_query_equals_sql(spark, sf_dir):
    found = op8_warc(spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    said = con.sql(warc.ORACLE)
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, found.select(*said.columns).collect()), key=key) == sorted(said.fetchall(), key=key)


def test_empty_table(spark, pages):
    path = warc.archive(pages.limit(0))
    assert not [x for x in Path(path.removeprefix("file:")).iterdir() if x.name.endswith(".gz")] and warc.read(spark, path).collect() == []

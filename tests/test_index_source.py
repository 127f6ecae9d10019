"""Seeking in the trees of archives."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from docspark.functions import table_functions
from docspark.operators import postings
from docspark.plans.fixture import archive, number_key, string_key, tree
from docspark.sources import help_source, index_source
from docspark.storage import Workspace


def keyworded(n, seed):
    words = sorted({f"{chr(97 + i * 7 % 26)}word {i * seed % 9973:05d} ü" for i in range(n)}, key=str.encode)
    posts, entries = b"", []
    for i, w in enumerate(words):
        entries.append(w.encode() + b"\0" + struct.pack("<I", len(posts)))
        posts += struct.pack(f"<H{i % 4}I", i % 4, *range(i, i + i % 4))
    titles = [struct.pack("<I", 5 * i) + f"title {i}".encode() + b"\0" for i in range(n)]
    context = [struct.pack("<2I", h * 7_000_003 % (1 << 32), h) for h in sorted(range(n), key=lambda h: h * 7_000_003 % (1 << 32))]
    files = {"|KWBTREE": tree(entries, string_key, 4, 512), "|KWDATA": posts, "|TTLBTREE": tree(titles, number_key, 4, 512), "|CONTEXT": tree(context, number_key, 8, 512)}
    files |= {f"|f{i:04d}": bytes(i % 7) for i in range(400)}
    return archive([{"title": "t", "hash": 1}], files=files)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("archives")
    (place / "below").mkdir()
    (place / "a.hlp").write_bytes(keyworded(5000, 17))
    (place / "below" / "b.HLP").write_bytes(keyworded(1000, 29))
    (place / "one.hlp").write_bytes(archive([{"title": "t", "hash": 77}]))
    (place / "note.txt").write_bytes(b"no archive")
    return place


TABLES = {
    "keywords": ("raw_keywords", ["file", "keyword", "topic_offsets"], ["keyword = 'hword 00017 ü'", "keyword in ('bword 00255 ü', 'zz', 'aword 00000 ü')", "keyword >= 'x' and keyword < 'yword 02'", "keyword > 'zword'", "keyword < 'bword 0' and keyword >= 'aword 09'"]),
    "context": ("context", ["file", "hash", "topic_offset"], ["hash = 7000003", "hash in (0, 5, 14000006)", "hash between 1000000000 and 1010000000", "hash < 0", "hash = 77"]),
    "titles": ("titles", ["file", "topic_offset", "title"], ["topic_offset = 400", "topic_offset > 24000", "topic_offset <= 15", "topic_offset in (1, 2, 3)"]),
    "files": ("internal_files", ["file", "name", "offset", "used_space"], ["name = '|KWDATA'", "name like '|f01%'", "name >= '|f03' and name <= '|f0305'"]),
}


@pytest.mark.parametrize("table", TABLES)
def test_rows_equal_the_full_scan(spark, folder, table):
    whole, columns, conditions = TABLES[table]
    name = F.regexp_extract("file", "([^/]+)$", 1)
    scanned = help_source.read(spark, str(folder), whole).where("_error is null").withColumn("file", name).select(columns).cache()
    found = index_source.read(spark, str(folder), table)
    assert sorted(map(str, found.withColumn("file", name).select(columns).collect())) == sorted(map(str, scanned.collect()))
    for condition in conditions:
        own = found.where(condition).withColumn("file", name).select(columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, scanned.where(condition).collect())), condition


def test_a_condition_reads_few_pages(spark, folder):
    """A word of 5000 in a tree of some hundred pages: the pages on its way; and the tree's root splits the work."""
    path = str(folder / "a.hlp")
    whole = index_source.read(spark, path, "keywords")
    pages = whole.groupBy(F.spark_partition_id()).agg(F.max("pages_read").alias("n")).agg(F.sum("n"), F.count("*")).first()
    one = index_source.read(spark, path, "keywords").where("keyword = 'hword 00017 ü'").collect()
    assert len(one) == 1 and pages[0] > 100 and pages[1] > 2 and one[0]["pages_read"] * 10 < pages[0]


def test_inner_pages_out_of_order_are_walked_whole(tmp_path, spark):
    """Keys that do not ascend cannot lead; nothing is lost."""
    entries = [struct.pack("<2I", h, h) for h in [*range(500, 1000), *range(500)]]
    (tmp_path / "x.hlp").write_bytes(archive([{"title": "t", "hash": 1}], files={"|CONTEXT": tree(entries, number_key, 8, 256)}))
    assert [r["topic_offset"] for r in index_source.read(spark, str(tmp_path), "context").where("hash = 123").collect()] == [123]


def test_many_archives_plan_in_their_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(index_source, "_PLANNED_FILES", 1)
    reader = index_source.IndexReader({"path": str(folder), "table": "context"})
    parts = reader.partitions()
    assert len(parts) == 1 and parts[0].subtree is None and len(list(reader.read(parts[0]))) == 6001


def test_broken_archives_tell_their_fault(spark, tmp_path):
    (tmp_path / "a.hlp").write_bytes(b"nothing at all")
    (tmp_path / "b.hlp").write_bytes(archive([{"title": "t", "hash": 5}]))
    rows = index_source.read(spark, str(tmp_path), "context").collect()
    assert sorted((r["hash"] or 0, bool(r["_error"])) for r in rows) == [(0, True), (5, False)]
    with pytest.raises(Exception, match="bad magic"):
        index_source.read(spark, str(tmp_path), "context", "FAILFAST").collect()


def test_posting_blocks_and_search(spark):
    """A word in a third of all rows makes small blocks; few of them are opened for a rare word."""
    rows = spark.range(60_000).select(F.col("id").alias("entry"), F.explode(F.filter(F.array(F.when(F.col("id") % 3 == 0, "often"), F.when(F.col("id") % 7777 == 0, "rare"), F.when(F.col("id") % 2 == 0, "even"), F.lit("all")), lambda x: x.isNotNull())).alias("word"))
    work = Workspace(spark, "t")
    blocks = work.table(postings.blocked(rows.unionByName(rows.where("entry < 5")), work, 500), "blocks")
    assert blocks.agg(F.max("count")).first()[0] == 500 and blocks.where("word = 'often'").count() == 40
    asked = spark.createDataFrame([(1, "often"), (1, "rare"), (2, "often"), (2, "even"), (3, "rare"), (4, "rare"), (4, "none"), (5, "all"), (5, "rare"), (5, "even")], "query long, word string")
    found, opened = postings.with_all(blocks, asked, work)
    said = {}
    for r in found.collect():
        said.setdefault(r["query"], set()).add(r["entry"])
    rare = set(range(0, 60_000, 7777))
    assert said == {1: {x for x in rare if x % 3 == 0}, 2: set(range(0, 60_000, 6)), 3: rare, 5: {x for x in rare if x % 2 == 0}}
    _, opened = postings.with_all(blocks, asked.where("query in (1, 5)"), work)
    assert opened.count() <= 3 * len(rare) < blocks.count()


def test_table_function_in_sql(spark):
    table_functions.register(spark)
    spark.createDataFrame([("a.hlp", archive([{"title": "t", "hash": 5}], minor=21)), ("b.hlp", b"no")], "path string, content binary").createOrReplaceTempView("help_few")
    rows = spark.sql("SELECT t.file, t.hash, t._error FROM help_few, LATERAL help_table(path, content, 'context') t ORDER BY t.file").collect()
    assert [tuple(r) for r in rows] == [("a.hlp", 5, None), ("b.hlp", None, "under 8 bytes")]
    assert spark.sql("SELECT t.minor_version FROM help_few, LATERAL help_table(path, content, 'system', '3.0') t WHERE t._error IS NULL").first()[0] == 15
    with pytest.raises(Exception, match="no table"):
        spark.sql("SELECT t.* FROM help_few, LATERAL help_table(path, content, 'nothing') t")

"""Archives made from rows, decoded, assembled and exported."""

from __future__ import annotations

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from docspark.operators import relational
from docspark.plans import help_file, rst
from docspark.plans.fixture import archive, literal_lz77, number_key, string_key, tree
from docspark.sources import container, help_source
from docspark.sources.codecs import HelpError
from docspark.streaming.watch import arriving

BMP = struct.pack("<2sIHHI", b"BM", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def sample(n=60, seed=1):
    r = random.Random(seed)
    topics = []
    for i in range(n):
        paragraphs = [[("text", f"topic {i} part {k} " + "x" * r.randrange(900)), ("bold", "loud"), ("link", f"to {(i * 7) % n}", 1000 + (i * 7) % n)] for k in range(r.randrange(1, 6))]
        topics.append({"title": f"Title {i}", "hash": 1000 + i, "paragraphs": paragraphs})
    topics[0]["paragraphs"].append([("image", 0)])
    topics[1]["paragraphs"].append([("link", "", 0xDEADBEEF)])
    return topics


@pytest.fixture(scope="module")
def archives(spark):
    made = [("dir/a.hlp", archive(sample(), lz77=True, files={"|bm0": BMP, "|bm9": b"raw"}, aliases=True)), ("dir/b.hlp", archive(sample(40, 2), minor=15)), ("dir/c.hlp", archive(sample(50, 3), minor=21))]
    return spark.createDataFrame([*made, ("dir/broken.hlp", b"nothing"), ("dir/empty.hlp", None)], "path string, content binary")


@pytest.fixture(scope="module")
def found(archives):
    return help_file.assemble(archives)


def test_every_topic_its_identifier_and_aliases(found):
    rows = found.topics.orderBy("file", "topic_no").collect()
    assert len(rows) == 150
    for file, n in (("dir/a.hlp", 60), ("dir/b.hlp", 40), ("dir/c.hlp", 50)):
        own = [r for r in rows if r["file"] == file]
        if file != "dir/a.hlp":
            assert [r["id"] for r in own] == [f"ctx_{1000 + i:08x}" for i in range(n)]
            assert all(r["aliases"] == [] for r in own)
        else:
            assert [{r["id"], *r["aliases"]} for r in own] == [{f"ctx_{1000 + i:08x}", f"ctx_{(1000 + i) ^ 0xFFFF:08x}"} for i in range(n)]
        assert [r["title"] for r in own] == [f"Title {i}" for i in range(n)]


def test_bodies_and_links(found):
    texts = {}
    for r in found.bodies.where("kind = 'paragraph'").orderBy("file", "rec_no", "block_no").collect():
        texts.setdefault((r["file"], r["topic_no"]), []).append("".join(x["text"] for x in r["inlines"]))
    for file, topics in (("dir/a.hlp", sample()), ("dir/b.hlp", sample(40, 2)), ("dir/c.hlp", sample(50, 3))):
        for i, t in enumerate(topics):
            expected = ["".join("0xDEADBEEF" if run == ("link", "", 0xDEADBEEF) else str(run[1]) for run in p) for p in t["paragraphs"] if p[0][0] != "image"]
            assert texts[file, i] == expected
    back = {(r["file"], r["target"]): r["n_links"] for r in help_file.backlinks(found.links).collect()}
    assert sum(back.values()) == found.links.count()
    assert [r["target"] for r in help_file.dangling(found.links, found.topics).select("target").distinct().collect()] == ["0xDEADBEEF"]


def test_summary_images_and_tables(found, archives):
    said = {r["file"]: (r["title"], r["root_topic"]) for r in found.summary.collect()}
    assert said["dir/b.hlp"] == ("A title", "ctx_000003e8") and len(said) == 3
    assert [(r["filename"], r["format"]) for r in found.images.collect()] == [("|bm0", "bmp")]
    assert found.keyword_index.collect() == []
    tables = help_source.tables(archives)
    for name, df in tables.items():
        rows = df.collect()
        assert {r["file"] for r in rows if r["_error"]} >= {"dir/broken.hlp", "dir/empty.hlp"}, name
    with pytest.raises(Exception, match="HelpError"):
        help_source.decode(archives, "system", mode="FAILFAST").collect()
    assert help_source.decode(archives, "system", "3.0").where("_error is null").agg(F.max("minor_version")).first()[0] == 15
    assert help_file.dump(tables["records"]).count() == 40


def test_export(found, spark, tmp_path):
    files = {(r["file"], r["path"]): bytes(r["content"]) for r in rst.files(found).collect()}
    page = files["dir/a.hlp", "ctx_000003e8.rst"].decode()
    assert page.startswith(".. _ctx_000003e8:\n\nTitle 0\n=======\n\ntopic 0 part 0 ")
    assert "**loud**\\ :ref:`to 0 <ctx_000003e8>`\n" in page and ".. image:: _images/bm0.png\n" in page
    assert files["dir/a.hlp", "_images/bm0.png"].startswith(b"\x89PNG")
    assert b"See :ref:`ctx_000003e8`.\n" in files["dir/a.hlp", "ctx_0000fc17.rst"]
    assert files["dir/c.hlp", "index.rst"].decode().count("   ctx_") == 50 and b"project = 'A title'" in files["dir/c.hlp", "conf.py"]
    counts = {r["file"]: tuple(r)[1:] for r in rst.summary(found).collect()}
    assert counts == {"dir/a.hlp": (60, 60, 1), "dir/b.hlp": (40, 0, 0), "dir/c.hlp": (50, 0, 0)}
    assert rst.progress(found).where("i = n").count() == 3
    both = rst.files(found).where("file = 'dir/a.hlp'")
    rst.write(both.unionByName(both.withColumn("file", F.lit("dir/b/a.hlp"))), str(tmp_path / "out"), "dir/")
    assert (tmp_path / "out" / "a" / "ctx_000003e8.rst").read_text() == page == (tmp_path / "out" / "b" / "a" / "ctx_000003e8.rst").read_text()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a", "b"]
    with pytest.raises(Exception, match="leaves"):
        rst.write(both.withColumn("path", F.lit("../x")), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").rglob("*"))


def test_rendering(spark):
    runs = "array<struct<kind:string,text:string,bold:boolean,italic:boolean,target:string,link_kind:string>>"
    cases = [
        ([("text", " \tlead a*b", False, False, None, None)], "lead a\\*b\n"),
        ([("text", "b", True, True, None, None), ("link", "see", False, False, "my topic", "popup")], "***b***\\ :ref:`see <my_topic>`\n"),
        ([("text", "x\n-----\n--=--\n****", False, False, None, None)], "x\n\\-----\n--=--\n\\*\\*\\*\\*\n"),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, r {runs}")
    assert [r[0] for r in df.orderBy("i").select(rst.paragraph(F.col("r"))).collect()] == [x for _, x in cases]
    row = spark.createDataFrame([([["a", "b"], ["c"]],)], "r array<array<string>>").select(rst.table(F.col("r"))).first()
    assert row[0] == ".. list-table::\n   :widths: auto\n\n   * - a\n     - b\n   * - c\n"
    said = spark.createDataFrame([("|bm1", "right", "wmf")], "n string, p string, f string").select(rst.picture(F.col("n"), F.col("p"), F.col("f"))).first()[0]
    assert said == rst.WMF_NOTE + ".. figure:: _images/bm1.wmf\n   :align: right\n\n"


def test_running_offset_and_asof_against_loops(spark):
    r = random.Random(4)
    rows, entries, expected_run, expected = [], [], [], set()
    for f in range(6):
        run, marks = 0, []
        for i in range(80):
            mark = r.random() < 0.3
            delta = 0 if mark else r.randrange(50)
            base = r.randrange(4) * 100 if r.random() < 0.1 else None
            rows.append((f, i, mark, delta, base))
            expected_run.append(((f, i), run))
            if mark:
                marks.append((i, run))
            run += delta
            if base is not None:
                run = base
        own = sorted((r.randrange(900), k) for k in range(40))
        entries += [(f, at, k) for at, k in own]
        for i, run in marks:
            while own and own[0][0] <= run:
                expected.add((f, own.pop(0)[1], i))
    df = relational.running_offset(spark.createDataFrame(rows, "f int, i int, mark boolean, d long, b long"), ["f"], "i", "d", "b")
    assert {(x["f"], x["i"]): x["run"] for x in df.collect()} == dict(expected_run)
    marks = df.where("mark").select("f", F.col("i").cast("long").alias("i"), "run")
    found = relational.forward_asof(spark.createDataFrame(entries, "f int, at long, k int"), marks, ["f"], "at", "run", "i")
    assert {(x["f"], x["k"], x["i"]) for x in found.collect()} == expected


def test_asof_of_one_large_key_takes_linear_time(spark):
    entries = spark.range(100_000).select(F.lit(1).alias("f"), (F.col("id") * 7919 % 1_000_000).alias("at"), F.col("id").alias("k"))
    marks = spark.range(1000).select(F.lit(1).alias("f"), (F.col("id") * 1000).alias("run"), F.col("id").alias("i"))
    began = time.time()
    found = relational.forward_asof(entries, marks, ["f"], "at", "run", "i")
    wrong = found.where(F.col("i") != F.ceil(F.col("at") / 1000)).count()
    assert wrong == 0 and time.time() - began < 20


def test_trees_and_indexes():
    entries = [struct.pack("<2I", i, 2 * i) for i in range(9000)]
    assert container.contexts(tree(entries, number_key, page=2048)) == [(i, 2 * i) for i in range(9000)]
    words = [f"w{i:05d}".encode() + b"\0" + struct.pack("<I", 6 * i) for i in range(5)]
    posts = b"".join(struct.pack("<HI", 1, i) for i in range(5))
    assert container.keywords(tree(words, string_key, 4), posts) == [(f"w{i:05d}", [i]) for i in range(5)]
    with pytest.raises(HelpError):
        container.keywords(tree(words, string_key, 4), posts[:-1])
    assert container.titles(tree([struct.pack("<I", 9) + b"b\0", struct.pack("<I", 3) + b"a\0"], number_key, 4)) == [(3, "a"), (9, "b")]
    held = container.Container(archive(sample(5)))
    assert len(held.read("|SYSTEM", header=True)) == len(held.read("|SYSTEM")) + 9
    with pytest.raises(HelpError):
        held.read("|NONE")
    assert container.walk(struct.pack("<5IB", 21, 0, 0, 0, 21, 2), 0, 21, 0, True) == ([(0, 21, 0, 0, 21, 2)], 0)


def test_phrases_expand_in_records(spark):
    topics = [{"title": "T", "hash": 5, "paragraphs": [[("text", "plain")]]}]
    made = archive(topics, minor=21, files={"|Phrases": struct.pack("<2HI3H", 2, 0x100, 5, 6, 8, 11) + literal_lz77(b"abcde")})
    df = spark.createDataFrame([("p.hlp", made)], "path string, content binary")
    assert [bytes(r["bytes"]) for r in help_source.decode(df, "phrases").orderBy("idx").collect()] == [b"ab", b"cde"]
    assert help_file.assemble(df).topics.first()["title"] == "T"


def test_files_streams_and_contents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hlp").write_bytes(archive(sample(4)))
    (tmp_path / "in" / "b.cnt").write_bytes(b":Base a.hlp\r\n1 Heading\r\n2 A \\= b=ctx_1\r\n")
    assert help_source.read(spark, str(tmp_path / "in"), "system").first()["title"] == "A title"
    rows = help_source.contents(spark, str(tmp_path / "in")).orderBy("line_no").collect()
    assert [(r["kind"], r["level"], r["text"], r["target"]) for r in rows] == [("directive", None, ":Base a.hlp", None), ("heading", 1, "Heading", None), ("link", 2, "A = b", "ctx_1")]
    query = arriving(spark, str(tmp_path / "in"), "context").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 4


def test_command_line(spark, tmp_path, capsys):
    """What can be read is exported; a broken archive is told and makes the status 1."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hlp").write_bytes(archive(sample(4)))
    assert rst.main([str(tmp_path / "in"), str(tmp_path / "dry"), "--dry-run"]) == 0
    assert not (tmp_path / "dry").exists() and "a.hlp: 4 topics, 0 aliases, 0 images" in capsys.readouterr().out
    (tmp_path / "in" / "broken.hlp").write_bytes(b"nothing at all")
    (tmp_path / "in" / "fonts.hlp").write_bytes(archive(sample(2), files={"|FONT": b"12"}))
    assert rst.main([str(tmp_path / "in"), str(tmp_path / "out"), "--verbose", "--format-version", "3.1"]) == 1
    said = capsys.readouterr()
    assert "broken.hlp" in said.err and "bad magic" in said.err and "font table under 8 bytes" in said.err and "[4/4]" in said.err
    assert (tmp_path / "out" / "a" / "index.rst").read_text().count("   ctx_") == 4


def test_decoded_tables_never_go_through_the_driver_by_the_size_of_their_files(spark):
    """Their rows are many times what their compressed files take, and :func:`dealt_join` repeats them 16 times."""
    from docspark.operators.relational import dealt_join

    df = spark.createDataFrame([("a.hlp", archive([{"title": "t", "hash": 1, "paragraphs": [[("text", "x")]]}]))], "path string, content binary")
    t = help_source.tables(df, names=("context", "records", "blocks", "images"))
    other = spark.createDataFrame([("a.hlp",)], "file string").repartition(2)
    plan = lambda x: x._jdf.queryExecution().sparkPlan().toString()
    for name, table in t.items():
        for both in (other.join(table, "file"), table.join(other, "file")):
            assert "SortMergeJoin" in plan(both) and "Broadcast" not in plan(both), name
    few = spark.createDataFrame([(1, 2)], "k int, v int")
    assert "Broadcast" not in plan(dealt_join(few, few.withColumnRenamed("v", "w"), ["k"], ["v"], "left"))


def test_searches_send_no_postings_through_the_driver(spark, sf_dir):
    from docspark.queries import QUERIES

    plan = QUERIES["posting_search"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

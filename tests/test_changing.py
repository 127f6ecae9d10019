"""Replaced archives in a stream against a batch run over the newest versions."""

from __future__ import annotations

import os
import struct

import pytest
from pyspark.sql import functions as F

from docspark.plans import help_file
from docspark.plans.fixture import archive, string_key, tree
from docspark.sources import help_source
from docspark.streaming import changing


def made(targets: list[int], words: dict[str, list[int]]) -> bytes:
    """An archive of a topic for each of ``targets``, which it links to, and of keywords."""
    entries, posts = [], b""
    for word in sorted(words):
        entries.append(word.encode() + b"\0" + struct.pack("<I", len(posts)))
        posts += struct.pack(f"<H{len(words[word])}I", len(words[word]), *words[word])
    topics = [{"title": f"T{i}", "hash": 1000 + i, "paragraphs": [[("text", "see "), ("link", "there", 1000 + t), ("link", "again", 1000 + t)]]} for i, t in enumerate(targets)]
    return archive(topics, files={"|KWBTREE": tree(entries, string_key, 4), "|KWDATA": posts})


def placed(folder, version: int, name: str, content: bytes) -> None:
    place = folder / str(version) / name
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_bytes(content)
    os.utime(place, (1_600_000_000 + 1000 * version,) * 2)


@pytest.fixture(scope="module")
def rocks(spark):
    """The session with the state store that keyed state needs."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def advance(spark, folder, store) -> None:
    for start in (lambda: changing.decode_arrivals(spark, f"{folder}/*", store, parts=3), lambda: changing.follow(spark, store)):
        query = start()
        assert query.awaitTermination(240)
        assert query.exception() is None


def batch(spark, newest: list[tuple[str, bytes]]) -> tuple[set, set]:
    """Back-links and keywords of archives by name, decoded together."""
    archives = spark.createDataFrame(newest, "path string, content binary")
    t = help_source.tables(archives, names=("context", "records", "blocks", "raw_keywords"))
    links = help_file.backlinks(help_file.links(help_file.bodies(t["records"], t["blocks"])))
    words = t["raw_keywords"].where("_error is null").select("file", "keyword", F.size("topic_offsets").alias("n"))
    return {tuple(r) for r in links.collect()}, {tuple(r) for r in words.collect()}


def held(spark, store) -> tuple[set, set]:
    return {tuple(r) for r in changing.backlinks(spark, store).collect()}, {tuple(r) for r in changing.keywords(spark, store).collect()}


def test_replaced_archives_take_their_entries_back(rocks, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    a2, a3 = made([1, 2, 0], {"apple": [5, 9], "pear": [7]}), made([2, 2, 2, 0], {"apple": [5], "quince": [8, 8]})
    b2, b4 = made([1, 0], {"apple": [3]}), made([0, 0], {})
    placed(folder, 2, "a.hlp", a2)
    placed(folder, 2, "b.hlp", b2)
    advance(rocks, folder, store)
    assert held(rocks, store) == batch(rocks, [("a.hlp", a2), ("b.hlp", b2)])
    assert len(held(rocks, store)[0]) == 5

    placed(folder, 3, "a.hlp", a3)
    placed(folder, 1, "b.hlp", a2)  # late: older than what is held
    advance(rocks, folder, store)
    assert held(rocks, store) == batch(rocks, [("a.hlp", a3), ("b.hlp", b2)])

    placed(folder, 4, "b.hlp", b4)
    placed(folder, 5, "a.hlp", b"nothing at all")  # cannot be read: its entries go
    advance(rocks, folder, store)
    assert held(rocks, store) == batch(rocks, [("b.hlp", b4)])

    # entries that are delivered again change nothing
    rocks.read.parquet(f"{store}/entries/*").write.parquet(f"{store}/entries/again")
    advance(rocks, folder, store)
    assert held(rocks, store) == batch(rocks, [("b.hlp", b4)])


def test_nothing_has_arrived(rocks, tmp_path):
    (tmp_path / "in" / "1").mkdir(parents=True)
    advance(rocks, tmp_path / "in", str(tmp_path / "store"))
    assert held(rocks, str(tmp_path / "store")) == (set(), set())

"""Record chains, phrases and blocks as Spark rows, against loops over whole archives."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from docspark.operators import decoding
from docspark.plans import help_file
from docspark.plans.fixture import archive, packed_lz77
from docspark.sources import container as c
from docspark.sources import help_source
from docspark.storage import Workspace

ARCHIVES = "path string, content binary"


def chain(topic, block_size, size, packed, before_31):
    """The records of a topic file by one loop over its whole stream, and where the chain returns, if it does."""
    stream = b"".join(body.ljust(size, b"\0") for *_, body in c.blocks(topic, block_size, packed))
    at, seen, out = 0, set(), []
    while at + 21 <= len(stream):
        if at in seen:
            return out, f"record chain returns to {at}"
        seen.add(at)
        held, length2, _, following, length1, kind = struct.unpack_from("<5IB", stream, at)
        if held < 21:
            break
        end = min(at + held, len(stream))
        cut = min(at + max(length1, 21), end)
        out.append((at, kind, stream[at + 21 : cut], stream[cut:end], length2, following))
        if before_31:
            at += following
        elif 12 <= following < 1 << 31:
            at = following - 12
        else:
            break
    return out, None


def decoded(spark, topics, segment_blocks, **options):
    """What Spark makes of them, one archive a topic file."""
    made = [(str(i), archive([{"title": "t", "hash": 1}], files={"|TOPIC": t}, **options)) for i, t in enumerate(topics)]
    rows = help_source.tables(spark.createDataFrame(made, ARCHIVES), names=("records",), segment_blocks=segment_blocks)["records"].collect()
    out = []
    for i in range(len(topics)):
        own = sorted((r for r in rows if r["file"] == str(i) and r["_error"] is None), key=lambda r: r["rec_no"])
        assert [r["rec_no"] for r in own] == list(range(len(own)))
        errors = [r["_error"] for r in rows if r["file"] == str(i) and r["_error"] is not None]
        assert len(errors) <= 1
        out.append(([(r["stream_offset"], r["record_type"], bytes(r["link_data1"]), bytes(r["link_data2"]), r["data_len2"], r["next_block"]) for r in own], errors[0] if errors else None))
    return out


def jumbled(seed, before_31, n_blocks, guesses):
    """A topic file whose records lie anywhere, are of any length, and follow each other in any order, sometimes in a circle."""
    r = random.Random(seed)
    body, size, block = (2036, 2048, 2048) if before_31 else (4084, 16384, 4096)
    bodies = [bytearray(r.randbytes(body)) for _ in range(n_blocks)]
    places = sorted({0, *(b * size + r.randrange(0, body - 21) for b in range(n_blocks) for _ in range(r.randrange(4)))})
    places = [p for i, p in enumerate(places) if i == 0 or p - places[i - 1] >= 21]
    order = [0, *places[1:]]
    if r.random() < 0.4:
        rest = order[1:]
        r.shuffle(rest)
        order = [0, *rest]
    if before_31:
        order.sort()
    for i, at in enumerate(order):
        following = order[i + 1] if i + 1 < len(order) else r.choice([None, order[r.randrange(len(order))]])
        if before_31:
            link = 0x7FFFFFFF if following is None or following < at else following - at
        else:
            link = 0xFFFFFFFF if following is None else following + 12
        struct.pack_into("<5IB", bodies[at // size], at % size, 21 + r.choice([0, 5, 300, 5000, 40_000]), 7, 0, link, 21 + r.choice([0, 3, 100, 6000]), r.choice([2, 1, 3]))
    out = b""
    for b, held in enumerate(bodies):
        first = min((p for p in places if p // size == b), default=-1) + 12
        named = first if guesses == "right" else r.choice([0, b * size + 12 + r.randrange(body), 0xFFFFFFFF])
        out += struct.pack("<3I", 0, named & 0xFFFFFFFF, 0) + bytes(held)
    assert len(out) == n_blocks * block
    return out


@pytest.mark.parametrize(("segment_blocks", "guesses", "before_31"), [(1, "right", False), (2, "wrong", False), (2, "wrong", True), (64, "right", True)])
def test_chains_equal_one_loop(spark, segment_blocks, guesses, before_31):
    topics = [jumbled(seed, before_31, 1 + seed % 9, guesses) for seed in range(24)]
    options = {"minor": 15 if before_31 else 21}
    expected = [chain(t, 2048 if before_31 else 4096, 2048 if before_31 else 16384, False, before_31) for t in topics]
    assert before_31 or sum(e is not None for _, e in expected) > 2
    assert decoded(spark, topics, segment_blocks, **options) == expected


def test_blocks_that_unpack_to_more_than_their_size_move_what_follows(spark):
    """A block of 4084 packed bytes that gives over 16384."""
    first = struct.pack("<5IB", 40, 3, 0, 20000 + 12, 24, 2) + b"abctitle" + bytes(20000 - 29)
    second = struct.pack("<5IB", 30, 3, 0, 0xFFFFFFFF, 21, 2) + b"last title"
    topic = b"".join((struct.pack("<3I", 0, 12, 0) + packed_lz77(x)).ljust(4096, b"\0") for x in (first, second))
    want = chain(topic, 4096, 16384, True, False)
    for segment_blocks in (1, 2, 256):
        assert decoded(spark, [topic], segment_blocks, minor=21, lz77=True) == [want]


def test_one_archive_of_many_segments_gives_the_same_topics(spark):
    topics = [{"title": f"Title {i}", "hash": 1 + i, "paragraphs": [[("text", f"part {i} {k} " + "x" * 700), ("link", "on", 2 + i)] for k in range(4)]} for i in range(300)]
    for options in ({"minor": 15}, {"minor": 21}, {"minor": 21, "lz77": True}):
        df = spark.createDataFrame([("a.hlp", archive(topics, **options))], ARCHIVES)
        small, large = (help_source.tables(df, names=("records", "blocks", "context"), segment_blocks=n) for n in (4, 256))
        for name in ("records", "blocks"):
            assert sorted(map(repr, small[name].collect())) == sorted(map(repr, large[name].collect()))
        assert help_file.topics(small["records"], small["context"]).count() == 300


def test_a_segment_is_a_row_and_rows_are_many_tasks(spark):
    topics = [{"title": f"Title {i}", "hash": 1 + i, "paragraphs": [[("text", "x" * 900)] * 3]} for i in range(200)]
    df = spark.createDataFrame([("a.hlp", archive(topics))], ARCHIVES)
    segments = help_source._parts(df, None, "PERMISSIVE", ("segments",), 8, Workspace(spark, "t"))["segments"]
    assert segments.count() > 15 and segments.agg(F.max(F.length("raw"))).first()[0] == 9 * 4096


def test_ranks_by_doubling(spark):
    """A list of 1000 nodes in ten joins; nodes that the chain does not reach have no rank."""
    order = list(range(1, 1000))
    random.Random(3).shuffle(order)
    order = [0, *order]
    rows = [("a", order[i], order[i + 1] if i + 1 < len(order) else None, i % 3) for i in range(len(order))] + [("a", 5000, 3, 1), ("b", 0, None, 4), ("c", 0, 7, 2), ("c", 7, 0, 1), ("d", 0, 99, 2)]
    nodes = spark.createDataFrame(rows, "file string, entry long, exit long, n int")
    found = {(r["file"], r["entry"]): r["rank"] for r in decoding.ranked(nodes, Workspace(spark, "t")).collect()}
    total, want = 0, {("b", 0): 0, ("c", 0): 0, ("c", 7): 2, ("d", 0): 0, ("d", 99): 2}
    for i, entry in enumerate(order):
        want["a", entry] = total
        total += i % 3
    assert found == want


def test_phrases_are_a_strict_join(spark):
    rows = [("a", 0, b"\x01\x00\x01\x03!", False, 2), ("a", 1, b"\x01\x09", False, 2), ("b", 0, b"\x00\x0bAB\x07", True, 1), ("b", 1, b"\x00\x02\x0b", True, 1), ("c", 0, b"\xff\x10", False, 1)]
    table = [("a", 0, b"one"), ("a", 1, b"t\xe9o"), ("b", 0, b"hall")]
    found = decoding.expanded(spark.createDataFrame(rows, "file string, rec_no long, link2 binary, hall boolean, phrases int"), spark.createDataFrame(table, "file string, idx int, bytes binary"))
    got = {(r["file"], r["rec_no"]): (bytes(r["link2"]), r["message"]) for r in found.collect()}
    assert got["a", 0] == (b"onet\xe9o !", None) and got["b", 0] == (b"hallAB ", None) and got["c", 0] == (b"\xff\x10", None)
    assert got["a", 1][1] == "phrase 4 of 2" and got["b", 1][1] == "phrase 1 of 1"


def test_phrases_meet_records_and_not_tokens(spark):
    """A file's packed records meet its table in one shuffle of both, whatever the number of tokens; other columns stay."""
    rows = spark.createDataFrame([("a", k, b"\x01\x00" * 5000, False, 1, f"kept {k}") for k in range(3000)], "file string, rec_no long, link2 binary, hall boolean, phrases int, further string")
    found = decoding.expanded(rows, spark.createDataFrame([("a", 0, b"one")], "file string, idx int, bytes binary"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Generate" not in plan and "array_join" not in plan
    got = found.collect()
    assert len(got) == 3000 and all(bytes(r["link2"]) == b"one" * 5000 and r["message"] is None and r["further"] == f"kept {r['rec_no']}" for r in got)


def test_a_text_with_a_table_beside_it_is_not_shuffled(spark, sf_dir):
    """phrase_roundtrip and hall_roundtrip dealt a row a token over the disk."""
    from docspark.queries import QUERIES

    for name in ("phrase_roundtrip", "hall_roundtrip"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_what_lies_between_segments_and_records_is_deleted(spark):
    """Streams, walks and chains took the disk of several copies of the text while blocks were made."""
    from pathlib import Path

    place = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(place.glob("*/*"))
    df = spark.createDataFrame([("a.hlp", archive([{"title": "t", "hash": 1, "paragraphs": [[("text", "x" * 900)]] * 50}]))], ARCHIVES)
    found = help_source.tables(df, names=("records",))["records"]
    kept = {p.name.partition("-")[2] for p in set(place.glob("*/*")) - before if any(p.glob("**/*.parquet"))}
    assert kept == {"parts", "faults", "records"} and found.count() == 51


def test_a_bad_token_ends_its_archive_by_name(spark):
    topics = [{"title": "first", "hash": 1, "paragraphs": [[("text", "the words the words the words")], [("text", "x" * 50 + "the words " * 9)]]}]
    good = archive(topics, minor=15, phrases=("inline", [*(bytes([b]) for b in range(1, 16)), b"the words"]))
    bad = archive(topics, minor=15, phrases=("inline", [*(bytes([b]) for b in range(1, 16)), b"the words"]), files={"|Phrases": struct.pack("<3H", 1, 0, 2) + b"th"})
    df = spark.createDataFrame([("good.hlp", good), ("bad.hlp", bad)], ARCHIVES)
    rows = help_source.decode(df, "records").collect()
    assert [r["_error"] for r in rows if r["file"] == "bad.hlp" and r["_error"]] == ["phrase 15 of 1"]
    assert len([r for r in rows if r["file"] == "good.hlp"]) == 3 and len([r for r in rows if r["file"] == "bad.hlp"]) == 2
    with pytest.raises(Exception, match="phrase 15 of 1"):
        help_source.decode(df, "records", mode="FAILFAST").collect()

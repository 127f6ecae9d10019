from __future__ import annotations

import sys
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docspark.llm import packing
from docspark.llm.queries import op6_best_fit_packing, vocabulary
from docspark.storage import Workspace

PATH = vocabulary("word_bpe_49k.json")


def check_packed(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def naive_place(lengths, capacity):
    """The rule itself: try every bin, and take the placement with the least sum of squares."""
    gaps, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s, best = lengths[i], None
        for b in [*range(len(gaps)), len(gaps)]:
            gap = gaps[b] if b < len(gaps) else capacity
            if gap < s:
                continue
            after = [*gaps]
            if b == len(gaps):
                after.append(gap - s)
            else:
                after[b] -= s
            counts = defaultdict(int)
            for g in after:
                counts[g] += g > 0
            key = (sum(n * n for n in counts.values()), gap - s, b == len(gaps))
            if best is None or key < best[0]:
                best = key, after, gap
        gaps = best[1]
        out.append((i, best[2]))
    return gaps, dict(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=14))
def test_place_follows_the_rule(lengths):
    chosen, offset, gaps = packing.place(np.array(lengths, np.int64), 20)
    expected, gap_before = naive_place(lengths, 20)
    assert sorted(gaps) == sorted(expected)
    assert [20 - o for o in offset.tolist()] == [gap_before[i] for i in range(len(lengths))]
    check_packed([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(chosen.tolist(), offset.tolist(), lengths, strict=True)], 20)


def test_many_groups_lose_no_piece_and_few_sequences(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(1 + rng.exponential(900, 4000).astype(int), 4096).tolist()
    parts = spark.createDataFrame([(None if i % 3 == 0 else i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    work = Workspace(spark, "test")
    rows = packing.pack(work.table(parts, "parts"), work, group_rows=500).collect()
    assert sorted(r["ids_crc32"] for r in rows) == list(range(4000))
    assert check_packed(rows, 4096) <= 1.01 * sum(lengths) / 4096 + 1


def test_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(PATH)
    rows = op6_best_fit_packing(spark, sf_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(docs) == len(by)
    total = 0
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, min(4096, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 4096))]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert check_packed(rows, 4096) <= 1.05 * total / 4096 + 1


def test_defined_cases(spark):
    long_text = "word " * 9000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a\x1cb c  D\x85e <|endoftext|>x 12'll", 0), (3, "dup", 0), (3, "dup", 0), (4, long_text, 0)], "doc_id long, text string, length int")
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.best_fit(docs, PATH).collect()
    check_packed(rows, 4096)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    expected = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in ("a\x1cb c  D\x85e <|endoftext|>x 12'll", "dup", "dup"))
    assert sorted(r["length"] for r in rows if r["doc_id"] == 3) == expected
    assert sorted(r["length"] for r in rows if r["doc_id"] == 4) == [809, 4096, 4096]
    assert packing.best_fit(docs.limit(0), PATH).collect() == []
    keyed = docs.where("doc_id <> 3")
    held = packing.sequences(keyed, packing.best_fit(keyed, PATH), PATH).collect()
    assert sum(len(r["ids"]) for r in held) == 9003 and all(len(r["ids"]) <= 4096 for r in held)


def test_remembered_chunks_are_bounded_and_change_no_ids():
    rng = np.random.default_rng(5)
    batches = [[" ".join(f"{''.join(chr(97 + c) for c in w)}{','[: w[0] % 2]}" for w in rng.integers(0, 26, (200, 5)))] for _ in range(30)]
    few, many = packing.chunks(PATH, 300), packing.chunks(PATH)
    assert few is packing.chunks(PATH, 300) and few is not many
    for texts in batches:
        for a, b in zip(packing.document_ids(texts, few), packing.document_ids(texts, many), strict=True):
            assert a.tolist() == b.tolist()
        assert len(few.at) <= 300 + 200 and len(few.encode_new.known) <= 200 + 201
    assert len(many.at) > 5000


odd = st.text(st.sampled_from("abEthÉßıİȺœ日本\u0301 \t\n\x1c\x1f\x85\xa0\u2003\u3000\u200b\x00'.,!<|>&#7½"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | odd | odd.map(lambda x: x + " it's I'LL <|endoftext|>x e\u0301,"), max_size=5))
def test_ids_are_the_tokenizers(texts):
    expected = [[*packing.chunks(PATH, 300).encode_new.tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert [x.tolist() for x in packing.document_ids(texts, packing.chunks(PATH, 300))] == expected


def test_new_words_are_not_handled_one_by_one():
    """Python calls a batch, not calls a distinct word: those took most of the time."""
    words = np.random.default_rng(6).integers(0, 26, (20_000, 7))
    texts = [" ".join("".join(chr(97 + c) for c in w) + ","[: w[0] % 2] for w in words[i : i + 200]) for i in range(0, len(words), 200)]
    tokenizer, calls = packing.chunks(PATH, 400), 0
    list(packing.document_ids(["warm"], tokenizer))

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        found = list(packing.document_ids(texts, tokenizer))
    finally:
        sys.setprofile(before)
    assert len(found) == 100 and calls < len(words) / 4

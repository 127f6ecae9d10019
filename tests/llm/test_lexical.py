from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from docspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10, once=True):
    counted = [(i, Counter(split(t))) for i, t in docs]
    held = [c for _, c in counted if c]
    n_docs, length = len(held), sum(sum(c.values()) for c in held)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, own in counted:
            score = 0
            for term, times in Counter(split(text)).items():
                if own[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(term in c for c in held) + 1)))
                    norm = 10 + 90 * sum(own.values()) * n_docs // length
                    score += (1 if once else times) * w * ((10**9 * own[term]) // (1000 * own[term] + 8 * norm))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "Alpha beta, gamma! Alpha"), (2, "alpha ALPHA\talpha"), (3, None), (4, ""), (5, "?! --"), (6, "Ärger Ärger ärger_été"), (7, "beta\x00beta gamma"), (7, "beta\x00beta gamma"),
    (None, "beta gamma 12"), (9, "delta " * 5000 + "beta"), (10, "beta gamma 12"), (8, "beta gamma 12"), *((100 + i, f"common word{i % 7} beta") for i in range(300)),
]
ITEMS = [(1, "alpha beta beta"), (2, None), (3, "nothing here"), (4, "Ärger"), (5, "ÉTÉ été 12"), (5, "gamma"), (6, "common word3"), (6, "common word3"), (None, "delta delta")]


@pytest.mark.parametrize(("once", "block_bytes", "k"), [(True, 1 << 24, 10), (False, 8, 3), (True, 20, 1)])
def test_equals_brute_force(spark, once, block_bytes, k, monkeypatch):
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, score int").repartition(5)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, block int")
    found = lexical.search(docs, items, k, once, block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(DOCS, ITEMS, k, once)


def test_small_blocks_of_postings(spark, monkeypatch):
    """A product in blocks of one document each finds the same."""
    monkeypatch.setattr(lexical, "_POSTINGS", 1)
    batches = []
    for batch in lexical._blocks(iter([batch_of([[0, 1], [], [2], [0]])])):
        batches.append(batch.num_rows)
    assert batches == [1, 2, 1] or sum(batches) == 4


def batch_of(lists):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["terms"])


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id in (3, 4, 5)"), items).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    found = lexical.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = sorted(map(tuple, found.collect()))
    assert rows and rows == sorted(con.sql(lexical.ORACLE).fetchall())

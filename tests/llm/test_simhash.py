from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docspark.llm import simhash
from docspark.llm.queries import op7_simhash_near_dedup
from docspark.storage import Workspace


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least index reachable over links of at most 2 bits, by union-find over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one  TWO", "a b c", "a b c d a b c d", "Ä ä\xa0x Z\x0by", "x " * 400])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups_of(spark, prints, dense):
    nodes = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    edges = simhash.links(nodes, Workspace(spark, "test"), dense).collect()
    index = {x: i for i, x in enumerate(sorted(set(prints)))}
    order = sorted(index)
    parent = list(range(len(order)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        i, j = root(index[a]), root(index[b])
        parent[max(i, j)] = min(i, j)
    return order, [root(i) for i in range(len(order))]


@pytest.mark.parametrize("dense", [1, 4, 32])
def test_links_lose_nothing(spark, dense):
    """Families of chains and crowds, close to each other and far away, with and without the dense way."""
    r = random.Random(dense)
    prints = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(25):
            prints.append(x)
            for _ in range(r.choice([1, 2, 2, 3])):
                x ^= 1 << r.randrange(64)
    center = r.getrandbits(64)
    prints += [center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)]
    order, found = groups_of(spark, prints, dense)
    assert found == brute_components(order)


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op7_simhash_near_dedup(spark, sf_dir).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    for (i, _), p, root in zip(docs, prints, brute_components(prints), strict=True):
        assert (rows[i]["fingerprint"], rows[i]["component_id"]) == (f"{p:016x}", docs[root][0])


def test_defined_cases(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(5, None, 1, "a"), (4, "", 2, "b"), (9, text, 3, "c"), (9, text, 3, "c"), (None, text.upper(), 4, "d"), (None, "alone here", 5, "e")], "doc_id long, text string, fp int, component_id string")
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    said = sorted((r["doc_id"] or -1, r["component_id"]) for r in found if r["component_id"] is not None)
    assert said == [(-1, 9), (4, 4), (5, 4), (9, 9), (9, 9)]
    assert [r["component_id"] for r in found].count(None) == 1
    assert {r["f"] for r in found if r["doc_id"] in (4, 5)} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "alone here"), (4, ""), (9, text)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []

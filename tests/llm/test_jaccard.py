from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline
import pytest

from docspark.llm import jaccard
from pyspark.sql import functions as F


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows, similarity=Fraction(4, 5)):
    """Least identifiers of the components over all pairs."""
    rows = sorted(rows)
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= similarity * union:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if root(i) == i]


def families(seed):
    """Chains and crowds of edited copies, with common lines, of all sizes."""
    r = random.Random(seed)
    common = " ".join(f"line{i}" for i in range(40))
    texts = ["", None, "one", "One", "two words"]
    for size, n in ((12, 30), (60, 60), (200, 60), (35, 120)):
        start = [f"w{r.randrange(10**6)}" for _ in range(size)]
        own = list(start)
        for k in range(n):
            own = list(start) if k % 2 else own
            for _ in range(r.randrange(3)):
                own[r.randrange(size)] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(3, 60))) for _ in range(120)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("dense", "frequent"), [(2, 500_000), (32, 50)])
def test_equals_all_pairs(spark, dense, frequent):
    rows = families(dense)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs, dense=dense, most_frequent=frequent).collect()) == brute_kept(rows)


def test_stage_removes_copies_that_fingerprints_tell_apart(spark, sf_dir):
    """Two of 300 words changed: a five-word similarity of 0.93, more than 2 bits apart."""
    r = random.Random(3)
    rows = []
    for i in range(20):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        words[100], words[200] = "changed", "words"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = corpus_pipeline.STAGES[1][1]
    assert sorted(x["doc_id"] for x in stage(spark, docs, sf_dir).collect()) == list(range(0, 40, 2))


def closest(seed, sizes):
    """Families of so many long texts, each with one of 900 words changed: fingerprints mostly within 2 bits."""
    r = random.Random(seed)
    texts = []
    for n in sizes:
        start = [f"w{r.randrange(10**6)}" for _ in range(900)]
        for k in range(n):
            own = list(start)
            if k:
                own[r.randrange(900)] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_closest_copies_are_simhashs_alone(spark, monkeypatch):
    """Without SimHash's pairs, copies within 2 bits stay: no later step finds them once more."""
    rows = closest(5, [2] * 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == brute_kept(rows)
    whole, seen = jaccard.near_prints, []

    def none(nodes, work):
        pairs, placed = whole(nodes, work)
        seen.append(pairs.count())
        return pairs.limit(0), placed

    monkeypatch.setattr(jaccard, "near_prints", none)
    kept = jaccard.keep_one(docs).count()
    assert kept == 20 + seen[0] > 20


@pytest.mark.parametrize("prints", ["fp", "pmod(node, 3)", "pmod(node, 40)", "pmod(node, 1000) * 4398046511104", "node & 1152921504606846975", "pmod(node, 64)"])
def test_fingerprints_lose_no_link(spark, monkeypatch, prints):
    """Crowded and lone, equal and close fingerprints, whatever their texts are: SimHash and what follows give all links together."""
    rows = closest(6, [2, 3, 5, 8, 70]) + [(i + 1000, t) for i, t in families(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard._prefixes
    monkeypatch.setattr(jaccard, "_prefixes", lambda *a: whole(*a).withColumn("fp", F.expr(prints).cast("long")))
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == brute_kept(rows)


def test_defined_cases(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(5, None, 1), (4, "", 2), (9, text, 3), (9, text, 3), (None, text.upper(), 4), (None, "alone here", 5)], "doc_id long, text string, node int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "alone here"), (4, ""), (9, text)]
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_stage_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])

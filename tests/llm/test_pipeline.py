from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from docspark.llm import language_id, packing, pii, simhash, url_filter
from docspark.llm.queries import vocabulary
from tests.llm.test_jaccard import brute_kept
from tokenizers import Tokenizer


def test_against_brute_force(spark, sf_dir):
    """Rejected, duplicate and redacted documents by plain Python; packing by its sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.fit(docs)
    kept = sorted((r["doc_id"], r["text"]) for r in docs.collect() if profiles.detect(r["text"])[0] != "und" and profiles.detect(r["text"])[1] >= 0.05)
    stay = set(brute_kept(kept))
    left = {i: t for i, t in kept if i in stay}
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    held, length = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        held[r["sequence_id"]] += r["length"]
        length[r["doc_id"]] += r["length"]
    assert max(held.values()) <= 4096
    assert set(length) == set(left)
    for i, n in length.items():
        text = pii.redact(left[i], pii.base_spans(left[i]))
        assert n == 1 + len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_stages_keep_columns_and_defined_cases(spark, sf_dir):
    text = "the cat sat on the mat and wrote to a@b.example.org about it"
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", None, None, None), (None, "12345", "en", "s", 5), (5, "der Hund schläft", "de", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(1, text.replace("a@b.example.org", "[EMAIL]")), (5, "der Hund schläft")]
    assert simhash.keep_one(docs).count() == 2
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf_dir)
    assert nothing.collect() == []


CLASHES = ["__lang", "__score", "lang_pred", "score", "__id", "__hash", "own_id", "added", "__added", "__node", "node", "root", "token", "tokens", "rules", "salt", "__salt", "gone_id", "gone_hash", "prefix", "fp", "sketch", "KEY"]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns_of_any_name(spark, sf_dir, number):
    """Helper columns give way to the table's own."""
    r = random.Random(number)
    rows = [(i, " ".join(r.choice(["the", "and", "cat", "sat", "here", "well"]) for _ in range(30)) + " a@b.example.org", "en", "s", 5, *(f"{c}{i}" for c in CLASHES)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    found = corpus_pipeline.STAGES[number][1](spark, docs, sf_dir)
    assert found.columns == docs.columns
    kept = found.collect()
    assert len(kept) == 12
    for row in kept:
        assert [row[c] for c in CLASHES] == [f"{c}{row['doc_id']}" for c in CLASHES]


def test_url_filter_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<link rel=canonical href=/y>", *CLASHES)], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in [*CLASHES]))
    for literal in (200, 0):
        row = url_filter.filter_urls(pages, url_filter.rules_table(spark), most_literal=literal).first()
        assert row["verdict"] == "block" and row["rule"] == "net/" and [row[c] for c in CLASHES] == CLASHES


def test_stages_read_very_long_texts(spark, sf_dir):
    """Half a million words in one row, with an address at its end."""
    text = "the cat sat on the mat and the dog ran " * 50_000 + "to a@b.example.org"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text + " now", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    (row,) = docs.collect()
    assert row["doc_id"] == 1 and row["text"].endswith("to [EMAIL]") and len(row["text"]) == len(text) - len("a@b.example.org") + len("[EMAIL]")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).agg({"length": "sum"}).first()[0] > 400_000


def test_stages_hold_little_beside_the_heap(spark, sf_dir, monkeypatch):
    """Packing remembers few chunks, and no stage makes rows in Python, which would start a second set of workers."""
    asked, made = [], packing.tokenise
    monkeypatch.setattr(packing, "tokenise", lambda *a, **k: asked.append(k.get("remembered", 300_000)) or made(*a, **k))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).cache()
    docs.count()

    def refused(*_, **__):
        raise AssertionError("rows made in Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    assert docs.count() and asked and max(asked) <= 50_000

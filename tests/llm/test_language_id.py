from __future__ import annotations

import zlib

from docspark.llm import language_id
from docspark.llm.queries import op2_language_id


def brute_profile(text, size):
    from collections import Counter

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        counts.update(w)
        padded = f" {w} "
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def test_ngrams_match_brute_force():
    text = "Êtes-vous là ? Ou là-bas, 3 fois."
    counted = brute_profile(text, 400)

    def key(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    from collections import Counter

    assert Counter(language_id.ngrams(text).tolist()) == {key(g): n for g, n in counted.items()}


def brute_detect(lists, text, size):
    """The definition by dictionaries: ranks by count, then code points; the first language of least distance."""
    order = lambda counts: sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:size]
    own = order(brute_profile(text or "", size))
    if not own or not lists:
        return "und", 0.0
    best = None
    for lang in sorted(lists):
        place = {g: i for i, g in enumerate(lists[lang])}
        distance = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))
        if best is None or distance < best[0]:
            best = (distance, lang)
    return best[1], 1 - best[0] / (size * len(own))


def test_fitting_and_detection_by_the_definition(spark, sf_dir):
    """All labelled rows of the training fold (fewer than are drawn from at most), n-grams by dictionaries."""
    from collections import Counter

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    totals = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            totals.setdefault(r["lang"], Counter()).update(brute_profile(r["text"], 400))
    lists = {x: sorted(c, key=lambda g: (-c[g], [0] * (3 - len(g)) + [ord(a) for a in g]))[:400] for x, c in totals.items()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op2_language_id(spark, sf_dir).collect()}
    for r in rows:
        lang, score = brute_detect(lists, r["text"], 400)
        assert found[r["doc_id"]][0] == lang and abs(found[r["doc_id"]][1] - score) < 1e-12


def test_long_texts_are_counted_in_parts():
    import numpy as np

    text = ("the quick brown fox, " * 700 + "x" * 5000 + " ") * 3
    keys, counts = np.unique(language_id.ngrams(text), return_counts=True)
    parts = list(language_id.blocks(text, 1000))
    assert "".join(parts) == text and len(parts) > 20
    found = language_id.added([np.unique(language_id.ngrams(x), return_counts=True) for x in parts])
    assert (found[0] == keys).all() and (found[1] == counts).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in tested) > 0.95 * len(tested)


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", "x"), (2, "der Hund und die Katze", "de", "x"), (3, "the", None, "y"), (4, None, "en", "z"), (5, "12 +-", "de", "z"), (6, "", "en", "z"), (6, "", "en", "z"), (None, "und", "de", "z")],
        "doc_id long, text string, lang string, lang_pred string",
    )
    found = language_id.detect(docs, language_id.fit(docs))
    assert found.columns.count("lang_pred") == 1
    said = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in found.collect()}
    assert found.count() == 8
    assert said[4, None] == said[5, "12 +-"] == said[6, ""] == ("und", 0.0)
    assert said[3, "the"][0] == "en"
    assert language_id.fit(docs.limit(0)).detect("the") == ("und", 0.0)
    assert language_id.detect(docs.limit(0), language_id.fit(docs)).collect() == []
    kept = language_id.keep_identified(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None}

from __future__ import annotations

import hashlib
import random
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from docspark.llm import order_minhash as o
from docspark.llm import queries

TOKEN = regex.compile(r"[\p{Alphabetic}\p{M}\p{N}--\p{Ideographic}]+|\p{Ideographic}|[^ \t\n\x0b\f\r\p{Alphabetic}\p{M}\p{N}]+", regex.V1)


def hashed(values):
    """Spark's chained XXH64 of strings, longs and ints, as an unsigned number."""
    seed = 42
    for kind, x in values:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.encode() if kind == "s" else x.to_bytes(8 if kind == "l" else 4, "little"), seed)
    return seed


def places(text, k=3, length=2, orders=64):
    """The fingerprint by its definition: each order ranks all elements by their distance from its start on the ring."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return None
    seen, elements = Counter(), []
    for i in range(max(1, len(tokens) - k + 1)):
        own = hashed([("s", t) for t in tokens[i : i + k]]) % 2**31
        point = own if not seen[own] else hashed([("l", own), ("i", seen[own])]) % 2**31
        seen[own] += 1
        elements.append((point, i))
    out = []
    for j in range(orders):
        start = j * (2**31 // orders)
        chosen = sorted(elements, key=lambda e: ((e[0] - start) % 2**31, e[1]))[:length]
        out.append(hashed([("l", point) for point, _ in sorted(chosen, key=lambda e: e[1])]) % 2**16)
    return out


def like(x, y):
    return float(x == y) if x is None or y is None else sum(a == b for a, b in zip(x, y, strict=True)) / len(x)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        own, changed, other = places(text), places(edited), places(following)
        hexes = ["".join(f"{x:04x}" for x in y or []) for y in (own, changed)]
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), *hexes, like(own, changed), like(own, other)))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, next_id string").write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op11_order_minhash(spark, path).collect()), key=str)


def test_equals_its_definition(spark, tmp_path):
    r = random.Random(2)
    words = ["the", "Haus", "été", "x1", "--", "日本", "a", "b", "c", "naïve?", "𝒳y"]
    texts = ["", None, " \n", "one", "one two", "a a a a a a a a a a", "日本語のテキスト", "?!", "a b " * 300, "\x00 b\tc"]
    texts += [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    rows = [*enumerate(texts, -5), (None, "no name a b c d")]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op11_order_minhash(spark, sf_dir).collect()), key=str)
    assert got == expected(rows)
    some = [x for x in got if x[1] > 200]
    assert sum(x[5] for x in some) / len(some) > 0.2 and sum(x[6] for x in some) / len(some) < 0.01


def test_repeated_rows_follow_each_other(spark, tmp_path):
    rows = [(3, "a b c d e f g")] * 3 + [(2, "h i j k"), (None, "l m n o"), (None, None), (None, "l m n o")]
    got = found(spark, rows, tmp_path)
    assert len(got) == 7 and Counter(x[0] for x in got) == {3: 3, None: 3, 2: 1}
    assert sorted(x[6] for x in got if x[0] == 3) == [0.0, 1.0, 1.0]
    assert sorted(x[6] for x in got if x[0] is None)[-1] == 1.0


def test_single_row_and_empty_table(spark, tmp_path):
    assert found(spark, [(1, "a b c d e f")], tmp_path / "one")[0][6] == 1.0
    assert found(spark, [], tmp_path / "none") == []


def test_moved_passages_lower_the_likeness(spark):
    """The same k-mers in another order: less alike than by k-mers alone, and less the more tuples look at order."""
    words = [f"w{i}" for i in range(600)]
    moved = words[300:] + words[:300]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved)), (3, "  ".join(words))], "doc_id long, text string")
    for length, low, high in ((1, 0.9, 1.0), (2, 0.3, 0.8), (4, 0.0, 0.4)):
        of = {r["doc_id"]: r["places"] for r in o.fingerprints(docs, length=length).collect()}
        assert of[1] == of[3]
        assert low <= like(of[1], of[2]) <= high


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, "z")], "doc_id long, text string, __places int, places_ string")
    row = o.fingerprints(docs).first()
    assert row["text"] == "a b c d" and row["__places"] == 5 and row["places_"] == "z"
    assert o.fingerprints(docs).select(o.fingerprint(F.col("places"))).first()[0] == "".join(f"{x:04x}" for x in places("a b c d"))

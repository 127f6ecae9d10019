from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import ann
from docspark.llm.queries import op9_nearest_neighbours
from docspark.storage import Workspace


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = [(v, s) for s, v in sorted((s, v) for s, v in zip(d.tolist(), ids, strict=True) if v != q)[:k]]
    return out


def recall(rows, expected):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, near in expected.items():
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in near})
    return hits / sum(map(len, expected.values()))


def scores_are_exact(rows, ids, x):
    place = {v: i for i, v in enumerate(ids)}
    return all(r["score"] == pytest.approx(float(np.sqrt(((x[place[r["query_id"]]] - x[place[r["vec_id"]]]) ** 2).sum())), abs=1e-12) for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], float)
    rows = op9_nearest_neighbours(spark, sf).collect()
    assert recall(rows, brute(ids, x, [i for i in ids if i % 100 == 0])) >= 0.9
    assert scores_are_exact(rows, ids, x)


def test_rounds_make_the_graph(spark):
    """On 20,000 vectors without structure, with the query's own settings: the rounds find most of what the start alone misses."""
    x = np.random.default_rng(3).standard_normal((20_000, 48))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    expected = brute(list(range(len(x))), x, range(0, len(x), 200))
    found = {rounds: ann.nearest(table, F.col("vec_id") % 200 == 0, rounds=rounds).collect() for rounds in (0, None)}
    assert scores_are_exact(found[None], list(range(len(x))), x)
    assert recall(found[None], expected) >= 0.95
    assert 1 - recall(found[None], expected) <= (1 - recall(found[0], expected)) / 3


def test_endless_rounds_are_an_error(spark):
    work = Workspace(spark, "test")
    codes = ann._codes(spark.range(200).select(F.col("id").alias("u"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v")))
    with pytest.raises(RuntimeError):
        ann.graph(work.table(codes, "codes"), work, 200, 3, 8, 4, 16, -1.0, most_rounds=2)


def test_recall_with_hubs_and_several_steps_of_gathering(spark, monkeypatch):
    rng = np.random.default_rng(5)
    around = rng.standard_normal((400, 16))
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    x = np.vstack([np.full((1, 16), 9.0), 9 + 3 * around, rng.standard_normal((900, 16)), 0.01 * rng.standard_normal((200, 16)) + 1])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann._gathered, "__defaults__", (2,))
    monkeypatch.setattr(ann, "_PART_BYTES", 1 << 15)
    rows = ann.nearest(table, F.col("vec_id") % 20 == 0, degree=16, sample=8, leaf=20).collect()
    assert recall(rows, brute(list(range(len(x))), x, range(0, len(x), 20))) >= 0.9


def test_dimensions_are_searched_apart(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (100, [5.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = ann.nearest(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == [(0, 1, 1, 1.0), (100, 1, 2, 4.0)]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.0, 2.0], 3), (100, [1.0, 0.1], 4), (100, [1.0, 0.1], 4), (200, None, 5), (300, [0.0, 0.0], 6), (4, [nan, 1.0], 7), (5, [1.0, inf], 8), (6, [None, 1.0], 9), (None, [1.0, 0.0], 1), (8, [], 1)]
    rows += [(i, [3.0, 3.0], 0) for i in range(10, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = ann.nearest(table, F.col("vec_id") % 100 == 0, k=4)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    said = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        said.setdefault(r["query_id"], []).append(r["vec_id"])
    assert said == {0: [1, 100, 2, 10], 100: [0, 1, 2, 10]}
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []

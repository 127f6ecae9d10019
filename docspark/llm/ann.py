"""Approximate nearest neighbours: an NN-descent graph by Spark joins, searched greedily.

Graph (Dong, Moses, Li, "Efficient k-nearest neighbor graph construction for generic similarity measures",
WWW 2011). Every distinct vector starts with neighbours from random cells and a few from one random-hyperplane
partition; neighbours of neighbours do the rest. In every round

* each node samples ``sample`` of its neighbours that are new since they were last joined, and as many
  new and old reverse neighbours (least by a hash; Spark limits hubs before it shuffles them);
* around each node, new members are compared with new and old ones ("local join"). Nodes are dealt over
  parts by a hash; neighbourhoods travel as identifiers, and a part gets every member's code once;
* a member keeps the ``degree`` nearest of its old neighbours and those that beat its farthest one.

Rounds go on until under ``delta`` of all edges were replaced, and raise an error if that never happens.

Search. A query starts from its own place in the graph. The beam of its ``beam`` nearest known vectors is
kept; all its unexpanded members are expanded over edges in both directions (the nearest ``degree`` reverse
ones) at once, until none is left. ``beam`` is ``16 * log2(n)`` unless given, as larger graphs are
searched wider. The ``rescore`` nearest of the beam are ranked by exact distance in double precision.

Within graph and beam, vectors travel as 8-bit codes with a scale each; results use the original ones.
Equal vectors are one graph node, which stands for its least ``k + 1`` identifiers.

Defined cases: rows with a null identifier, and vectors that are null, zero, or hold null or non-finite
components, take no part; vectors of different dimensions have no distance, so each dimension is searched on
its own; repeated rows count once; ties go to the smaller identifier; an empty table gives no rows;
fewer candidates than ``k`` are all returned if the search reaches them; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.storage import Workspace

_FOUND = "u long, part long, new_ws array<long>, new_ds array<float>"
_GRAPH = "u long, code binary, ws array<long>, ds array<float>, state array<tinyint>, entered int"
_OLD, _JOINED, _NEW = 0, 1, 2  # an edge's state: joined before, to be joined now, new
_PART_BYTES, _CHUNK_VALUES = 16 << 20, 1 << 23


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, v)``: the distinct usable rows of ``rows(vec_id, embedding)``, vectors as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return own.where(~bad & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def _codes(vectors: DataFrame) -> DataFrame:
    """``(u, code)`` of ``vectors(u, v)``: signed bytes and, behind them, the scale."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            scale = (np.abs(x).max(1, keepdims=True) / 127).astype("<f4")
            scale[scale == 0] = np.finfo("<f4").tiny
            code = np.hstack((np.clip(np.rint(x / scale), -127, 127).astype(np.int8).view(np.uint8), scale.view(np.uint8).reshape(-1, 4)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array([r.tobytes() for r in code], pa.binary())], ["u", "code"])

    return vectors.mapInArrow(run, "u long, code binary")


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _decoded(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a binary column of codes of one width."""
    codes = _flat(codes)
    if not len(codes):
        return np.empty((0, 1), np.float32)
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(codes), -1)
    return raw[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, -4:]).view("<f4")


def _padded(lists: pa.Array | pa.ChunkedArray, width: int, fill, dtype) -> np.ndarray:
    """A list column as rows of ``width`` values; null lists are empty."""
    lists = _flat(lists)
    sizes = np.minimum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), width)
    out = np.full((len(lists), width), fill, dtype)
    values = lists.flatten()
    out[np.arange(width)[None, :] < sizes[:, None]] = values.to_numpy(zero_copy_only=False)
    return out


def _lists(values: np.ndarray, keep: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The kept values of every row as a list column."""
    offsets = np.concatenate(([0], np.cumsum(keep.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[keep], kind))


def _mixed(u: np.ndarray, w: np.ndarray, seed: int) -> np.ndarray:
    """A hash of every pair: random order that a repeated task finds again."""
    h = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (w.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _best(u: np.ndarray, w: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each ``u``'s ``most`` nearest distinct ``w``, by ``u`` and distance."""
    order = np.lexsort((w, d, u))
    u, w, d = u[order], w[order], d[order]
    repeated = np.zeros(len(u), bool)  # a repeated pair has equal distances, so it stands next to the first
    repeated[1:] = (u[1:] == u[:-1]) & (w[1:] == w[:-1])
    u, w, d = u[~repeated], w[~repeated], d[~repeated]
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    rank = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))
    keep = rank < most
    return u[keep], w[keep], d[keep]


def _by_row(rows: int, u: np.ndarray, w: np.ndarray, d: np.ndarray) -> list[pa.Array]:
    """List columns of ``w`` and ``d`` for the rows that ``u`` (ascending) numbers."""
    offsets = pa.array(np.searchsorted(u, np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(d, pa.float32()))]


def _nested(batch: pa.RecordBatch, ws: str, ds: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` nearest of every row's lists of lists."""
    outer, inner = batch.column(ws), batch.column(ws).flatten()
    if not len(inner):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    sizes = outer.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.repeat(np.arange(batch.num_rows), sizes), inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return _best(of, inner.flatten().to_numpy(), batch.column(ds).flatten().flatten().to_numpy(), most)


def _gathered(found: DataFrame, pairs: list[tuple[str, str]], most: int, n_parts: int, fan: int = 256) -> DataFrame:
    """``found(u, part, lists of nodes, lists of distances, ...)`` as one row a ``u``, with lists of lists.

    Up to ``fan`` parts are gathered at a time and reduced to each ``u``'s ``most`` nearest before the next
    step, so that not even a hub's row grows with the number of parts.
    """
    lists = [F.collect_list(c).alias(c) for pair in pairs for c in pair]
    schema = "u long, part long, " + ", ".join(f"{w} array<long>, {d} array<float>" for w, d in pairs)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = [x for w, d in pairs for x in _by_row(batch.num_rows, *_nested(batch, w, d, most))]
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("part"), *made], ["u", "part", *[c for pair in pairs for c in pair]])

    while n_parts > fan:
        found = found.groupBy("u", F.floor(F.col("part") / fan).alias("part")).agg(*lists).mapInArrow(run, schema)
        n_parts = -(-n_parts // fan)
    return found.groupBy("u").agg(*lists)


# the start


def _spread(rows: DataFrame, key: list[str], block: int) -> DataFrame:
    """``rows(key..., u, ...)`` with a ``part`` that splits the members of large keys evenly."""
    large = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    part = F.coalesce(F.pmod(F.xxhash64("u"), F.ceil(F.col("__n") / block)), F.lit(0))
    return rows.join(large, key, "left").withColumn("part", part).drop("__n")


def _start(codes: DataFrame, n: int, dim: int, degree: int, leaf: int, seed: int) -> DataFrame:
    """Lists of the nearest of a hyperplane cell of about ``leaf`` vectors, and of all of two random cells, per node and cell."""
    bits = max(0, min(48, int(np.round(np.log2(max(1.0, n / leaf))))))
    few = max(1, degree // 4)

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, bits)).astype(np.float32)
        for batch in batches:
            if batch.num_rows:
                leaves = (_decoded(batch.column("code")) @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int64)), batch.column("u"), batch.column("code")], ["cell", "u", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            ids, x = flat.field("u").to_numpy(), _decoded(flat.field("code"))
            ends = np.cumsum(members.value_lengths().to_numpy())
            kinds, rows, found = [], [], []
            for kind, a, b in zip(batch.column("kind").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own, first = np.unique(ids[a:b], return_index=True)
                m = min(len(own) - 1, degree if kind else degree - few)
                if m < 1:
                    continue
                y = x[a:b][first]
                s = np.einsum("ij,ij->i", y, y)
                d = np.maximum(s[:, None] + s[None, :] - 2 * (y @ y.T), 0)
                np.fill_diagonal(d, np.inf)
                chosen = np.argpartition(d, m - 1, axis=1)[:, :m]
                kinds.append(np.full(len(own), kind))
                rows.append(own)
                found.append((np.full(len(own), m), own[chosen].ravel(), np.take_along_axis(d, chosen, 1).ravel()))
            if rows:
                sizes, w, d = (np.concatenate(x) for x in zip(*found, strict=True))
                lists = _by_row(len(sizes), np.repeat(np.arange(len(sizes)), sizes), w, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows), pa.int64()), pa.array(np.concatenate(kinds), pa.int64()), *lists], ["u", "part", "new_ws", "new_ds"])

    cells = codes.mapInArrow(run, "cell long, u long, code binary").withColumn("kind", F.lit(0))
    for k in (1, 2):
        drawn = F.pmod(F.xxhash64("u", F.lit(seed + k)), F.lit(max(1, n // degree)))
        cells = cells.unionByName(codes.select(drawn.alias("cell"), "u", "code", F.lit(k).alias("kind")))
    dealt = _spread(cells, ["kind", "cell"], 4 * leaf)
    return dealt.groupBy("kind", "cell", "part").agg(F.collect_list(F.struct("u", "code")).alias("members")).mapInArrow(near, _FOUND)


# the rounds


def _merged(nodes: DataFrame, degree: int, sample: int, seed: int) -> DataFrame:
    """The next graph of ``nodes(u, code, ws, ds, state)`` and what was found, with the edges to be joined now."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("u").to_numpy()
            new_ws, new_ds = _by_row(batch.num_rows, *_nested(batch, "new_ws", "new_ds", degree))
            w = np.hstack([_padded(x, degree, -1, np.int64) for x in (batch.column("ws"), new_ws)])
            d = np.hstack([_padded(x, degree, np.inf, np.float32) for x in (batch.column("ds"), new_ds)])
            state = np.hstack((_padded(batch.column("state"), degree, _OLD, np.int8), np.full((len(u), degree), _NEW, np.int8)))
            state[state == _JOINED] = _OLD
            entered = np.arange(2 * degree)[None, :] >= degree
            # a known neighbour that was found again counts once
            order = np.argsort(np.where(np.isinf(d), np.int64(np.iinfo(np.int64).max), w), axis=1, kind="stable")
            ws, ds = np.take_along_axis(w, order, 1), np.take_along_axis(d, order, 1)
            again = np.zeros(ws.shape, bool)
            again[:, 1:] = (ws[:, 1:] == ws[:, :-1]) & ~np.isinf(ds[:, 1:])
            np.put_along_axis(d, order, np.where(again, np.inf, ds), 1)
            near = np.argsort(d, axis=1, kind="stable")[:, :degree]
            w, d, state = (np.take_along_axis(x, near, 1) for x in (w, d, state))
            entered = np.take_along_axis(np.broadcast_to(entered, (len(u), 2 * degree)), near, 1)
            held = ~np.isinf(d)
            fresh = held & (state == _NEW)
            draw = np.where(fresh, _mixed(u[:, None], w, seed), np.uint64(0xFFFFFFFFFFFFFFFF))
            chosen = np.argsort(draw, axis=1)[:, :sample]
            now = np.zeros(state.shape, bool)
            np.put_along_axis(now, chosen, True, 1)
            state[now & fresh] = _JOINED
            made = [_lists(w, held, pa.int64()), _lists(d, held, pa.float32()), _lists(state, held, pa.int8()), pa.array((held & entered).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("code"), *made], ["u", "code", "ws", "ds", "state", "entered"])

    return nodes.mapInArrow(run, _GRAPH)


def _around(nodes: DataFrame, n_tasks: int, sample: int, seed: int) -> DataFrame:
    """``(center, new, old)``: the neighbourhoods that have something new to join."""
    pairs = [("new", "new_at"), ("old", "old_at")]

    def reverse(batches):
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ws, state = batch.column("ws"), batch.column("state").flatten().to_numpy()
            w, u = ws.flatten().to_numpy(), np.repeat(batch.column("u").to_numpy(), ws.value_lengths().to_numpy(zero_copy_only=False))
            centers, at = np.unique(w, return_inverse=True)
            drawn = (_mixed(w, u, seed) >> np.uint64(40)).astype(np.float32)  # the least are sampled
            lists = [x for s in (_JOINED, _OLD) for x in _by_row(len(centers), *_best(at[state == s], u[state == s], drawn[state == s], sample))]
            yield pa.RecordBatch.from_arrays([pa.array(centers, pa.int64()), pa.array(np.full(len(centers), task)), *lists], ["u", "part", *pairs[0], *pairs[1]])

    schema = "u long, part long, new array<long>, new_at array<float>, old array<long>, old_at array<float>"
    sampled = _gathered(nodes.select("u", "ws", "state").mapInArrow(reverse, schema), pairs, sample, n_tasks)

    def merge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ws, states = batch.column("ws"), batch.column("state").flatten().to_numpy()
            of, w = np.repeat(np.arange(batch.num_rows), ws.value_lengths().to_numpy(zero_copy_only=False)), ws.flatten().to_numpy()
            made = []
            for s, pair in ((_JOINED, pairs[0]), (_OLD, pairs[1])):
                v, x, _ = _nested(batch, *pair, sample)
                u, x = np.concatenate((of[states == s], v)), np.concatenate((w[states == s], x))
                u, x, _ = _best(u, x, np.zeros(len(u), np.float32), len(u) + 1)  # each once
                made.append(_by_row(batch.num_rows, u, x, np.zeros(len(u)))[0])
            yield pa.RecordBatch.from_arrays([batch.column("u"), *made], ["center", "new", "old"])

    joined = nodes.select("u", "ws", "state").join(sampled, "u", "left").mapInArrow(merge, "center long, new array<long>, old array<long>")
    return joined.where(F.size("new") > 0)


def _local_join(around: DataFrame, nodes: DataFrame, n: int, dim: int, degree: int, sample: int) -> DataFrame:
    """Of pairs of a neighbourhood, one of them new, those that beat ``u``'s farthest neighbour, gathered by ``u``; at most ``degree`` a part."""
    width = [2 * sample, degree + sample]
    per_part = max(32, _PART_BYTES // (sum(width) * dim))
    slots = nodes.sparkSession.sparkContext.defaultParallelism
    n_parts = max(-(-n // per_part), min(4 * slots, n // 64), 1)  # any number gives the same rows
    part = lambda x: F.pmod(F.xxhash64(x), F.lit(n_parts))
    dealt = around.withColumn("part", part("center"))
    wanted = dealt.select("part", F.explode(F.concat("new", "old")).alias("u")).distinct()
    bound = F.when(F.size("ds") >= degree, F.array_max("ds")).otherwise(F.lit(float("inf"))).cast("float")
    coded = wanted.join(nodes.select("u", "code", bound.alias("bound")), "u").select(F.col("part").alias("of"), "u", "code", "bound")

    def run(lists: pa.Table, members: pa.Table) -> pa.Table:
        number = lists.column("part")[0].as_py()
        ids = members.column("u").to_numpy()
        by_id = np.argsort(ids)
        ids, x, far = ids[by_id], _decoded(members.column("code"))[by_id], members.column("bound").to_numpy()[by_id]
        square = np.einsum("ij,ij->i", x, x)
        new, old = (_padded(lists.column(c), w, -1, np.int64) for c, w in zip(("new", "old"), width, strict=True))
        chunk = max(1, _CHUNK_VALUES // (sum(width) * dim))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for at in range(0, len(new), chunk):
            a = new[at : at + chunk]
            b = np.hstack((a, old[at : at + chunk]))
            there = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :])
            i, j = np.minimum(np.searchsorted(ids, a), len(ids) - 1), np.minimum(np.searchsorted(ids, b), len(ids) - 1)
            d = np.maximum(square[i][:, :, None] + square[j][:, None, :] - 2 * (x[i] @ x[j].transpose(0, 2, 1)), 0)
            c, p, q = np.nonzero(there & (d < far[i][:, :, None]))
            found.append((i[c, p], j[c, q], d[c, p, q]))
            late = a.shape[1]  # of two new members, both orders were compared
            c, p, q = np.nonzero(there[:, :, late:] & (d[:, :, late:] < far[j[:, late:]][:, None, :]))
            found.append((j[c, q + late], i[c, p], d[c, p, q + late]))
            if sum(len(f[0]) for f in found) > 1 << 21:
                found = [_best(*(np.concatenate(f) for f in zip(*found, strict=True)), degree)]
        u, w, d = _best(*(np.concatenate(f) for f in zip(*found, strict=True)), degree)
        own = np.unique(u)
        made = _by_row(len(own), np.searchsorted(own, u), ids[w], d)
        return pa.table([pa.array(ids[own], pa.int64()), pa.array(np.full(len(own), number), pa.int64()), *made], ["u", "part", "new_ws", "new_ds"])

    found = dealt.groupBy("part").cogroup(coded.groupBy("of")).applyInArrow(run, _FOUND)
    return _gathered(found, [("new_ws", "new_ds")], degree, n_parts)


def graph(
    codes: DataFrame, work: Workspace, n: int, dim: int, degree: int, sample: int, leaf: int, delta: float, rounds: int | None = None, seed: int = 7, most_rounds: int = 100
) -> DataFrame:
    """``(u, code, ws, ds, ...)``: every node's nearest known neighbours. ``rounds`` sets their number instead of the fixed point."""
    empty = {"ws": "array<long>", "ds": "array<float>", "state": "array<tinyint>"}
    fresh = codes.withColumns({c: F.array().cast(t) for c, t in empty.items()})
    begun = _gathered(_start(codes, n, dim, degree, leaf, seed), [("new_ws", "new_ds")], degree, 3)
    nodes = work.table(_merged(fresh.join(begun, "u", "left"), degree, sample, seed), "graph", n)
    for turn in range(most_rounds if rounds is None else rounds):
        found = _local_join(_around(nodes, work.files(n), sample, seed + turn), nodes, n, dim, degree, sample)
        following = work.table(_merged(nodes.drop("entered").join(found, "u", "left"), degree, sample, seed + turn + 1), "graph", n)
        work.drop(nodes)
        nodes = following
        if rounds is None and (nodes.agg(F.sum("entered")).first()[0] or 0) <= delta * n * degree:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"edges still change after {most_rounds} rounds")
    return nodes


# the search


def _search(start: DataFrame, nodes: DataFrame, work: Workspace, n: int, n_queries: int, degree: int, beam: int, most_hops: int = 256) -> DataFrame:
    """``(query, nodes, ds)``: the final beam of every node of ``start(query)``, nearest first, the query included."""
    edges = nodes.select("u", F.explode(F.arrays_zip("ws", "ds")).alias("e")).select("u", F.col("e.ws").alias("w"), F.col("e.ds").alias("d"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy("d", "u"))
    reverse = edges.withColumn("__rank", rank).where(F.col("__rank") <= degree).select(F.col("w").alias("node"), F.col("u").alias("next"))
    both = edges.select(F.col("u").alias("node"), F.col("w").alias("next")).unionByName(reverse)
    adjacent = work.table(both.groupBy("node").agg(F.collect_set("next").alias("next")), "adjacent", n)
    codes = nodes.select(F.col("u").alias("node"), "code")
    schema = "query long, code binary, nodes array<long>, ds array<float>, expanded array<boolean>, open int"
    n_parts = max(1, -(-n_queries // 16))
    part = F.pmod(F.xxhash64("query"), F.lit(n_parts))
    begun = start.join(codes, F.col("query") == F.col("node"))
    state = begun.select("query", "code", F.array("query").alias("nodes"), F.array(F.lit(0.0).cast("float")).alias("ds"), F.array(F.lit(False)).alias("expanded"), F.lit(1).alias("open"))
    state = work.table(state, "beam", n_queries)

    def run(beams: pa.Table, reached: pa.Table) -> pa.Table:
        rows = []
        query, node, x = reached.column("by").to_numpy(), reached.column("node").to_numpy(), _decoded(reached.column("code"))
        own_x = _decoded(beams.column("code"))
        for r, y in zip(beams.select(["query", "code", "nodes", "ds"]).to_pylist(), own_x, strict=True):
            mine = query == r["query"]
            mine[mine] = ~np.isin(node[mine], r["nodes"])
            w = np.concatenate((np.array(r["nodes"], np.int64), node[mine]))
            d = np.concatenate((np.array(r["ds"], np.float32), ((x[mine] - y) ** 2).sum(1) if mine.any() else np.empty(0, np.float32)))
            near = np.lexsort((w, d))[:beam]
            done = near < len(r["nodes"])  # all former members have been expanded
            rows.append((r["query"], r["code"], w[near], d[near], done, int((~done).sum())))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.int32())
        names = ("query", "code", "nodes", "ds", "expanded", "open")
        return pa.table({c: pa.array(list(v), t) for c, v, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    for _ in range(most_hops):
        frontier = state.where("open > 0").select("query", F.explode(F.arrays_zip("nodes", "expanded")).alias("e")).where("not e.expanded").select("query", F.col("e.nodes").alias("node"))
        reached = frontier.join(adjacent, "node").select("query", F.explode("next").alias("node")).distinct().join(codes, "node")
        reached = reached.select(part.alias("of"), F.col("query").alias("by"), "node", "code")
        following = state.withColumn("part", part).groupBy("part").cogroup(reached.groupBy("of")).applyInArrow(run, schema)
        following = work.table(following, "beam", n_queries)
        work.drop(state)
        state = following
        if not state.where("open > 0").limit(1).count():
            return state.select("query", "nodes", "ds")
    raise RuntimeError(f"beams still change after {most_hops} hops")


def _exact(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _of_dimension(own: DataFrame, is_query: Column, k: int, dim: int, degree: int, sample: int, leaf: int, delta: float, rounds: int | None, beam: int | None, rescore: int) -> DataFrame:
    """:func:`nearest` of ``own(vec_id, v, h)``, all of one dimension."""
    work = Workspace(own.sparkSession, "ann")
    nodes = work.table(own.groupBy("h", "v").agg(F.min("vec_id").alias("u")), "nodes")
    n = nodes.count()
    a, b = own.alias("a"), nodes.alias("b")
    member = work.table(a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.v") == F.col("b.v"))).select(F.col("a.vec_id").alias("vec_id"), F.col("b.u").alias("u")), "members", n)
    codes = work.table(_codes(nodes.select("u", "v")), "codes", n)
    found = graph(codes, work, n, dim, degree, sample, leaf, delta, rounds)
    queries = member.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("u").alias("query"))
    start = work.table(queries.select("query").distinct(), "start")
    width = max(beam or 16 * max(1, n).bit_length(), k + 1)
    beams = _search(start, found, work, n, max(1, start.count()), degree, width)
    near = beams.select("query", F.explode(F.slice("nodes", 1, max(rescore, k + 1))).alias("node"))
    left, right = nodes.select(F.col("u").alias("query"), F.col("v").alias("a")), nodes.select(F.col("u").alias("node"), F.col("v").alias("b"))
    scored = near.join(right, "node").join(left, "query").select("query", "node", _exact(F.col("a"), F.col("b")).alias("score"))
    few = F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))
    named = member.withColumn("__r", few).where(F.col("__r") <= k + 1).select(F.col("u").alias("node"), "vec_id")
    pairs = queries.join(scored, "query").join(named, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return work.finish(out, "nearest")


def nearest(
    rows: DataFrame, is_query: Column, k: int = 10, *, degree: int = 32, sample: int = 12, leaf: int = 64, delta: float = 0.04, rounds: int | None = None, beam: int | None = None, rescore: int = 60
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found rows of every row of ``rows(vec_id, embedding)`` where ``is_query`` (on ``vec_id``) holds."""
    work = Workspace(rows.sparkSession, "ann")
    own = work.table(usable(rows).withColumns({"h": F.xxhash64("v"), "dim": F.size("v")}), "vectors")
    dims = [r["dim"] for r in own.groupBy("dim").count().orderBy("dim").limit(65).collect()]
    if len(dims) > 64:
        raise ValueError("vectors of over 64 dimensions; search them table by table")
    parts = [_of_dimension(own.where(F.col("dim") == d).drop("dim"), is_query, k, d, degree, sample, leaf, delta, rounds, beam, rescore) for d in dims]
    work.close()
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)

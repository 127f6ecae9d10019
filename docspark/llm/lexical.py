"""Ranked lexical search as a blocked sparse matrix product.

The scores of all items against all documents are the product of two sparse matrices: items by terms,
which holds multiplicities (or ones), and terms by documents, which holds integer impacts. Neither product nor impacts
are ever made whole:

* Items fall into blocks of about ``block_bytes`` of text, so that a block's vocabulary fits a worker. A block is the
  only thing that is sent to the workers; there is one block unless items hold more text than that.
* For a block, one pass over the whole documents counts terms; only counts of the block's terms are written to the shared
  folder, together with each document's length. The numbers of documents and terms and the document frequencies follow from
  that table by aggregates that Spark combines before it shuffles.
* A batch of that table is a block of the second matrix. Its postings are turned into term rows, and every row of the first
  matrix merges the rows of its terms (Gustavson, "Two fast algorithms for sparse matrices", 1978) in an array of 64-bit integers
  with one place a document. The best ``k`` of each block are merged with those before it, so a task emits ``k`` rows an item, and Spark
  ranks these, again with a limit a task before the shuffle.

No row is keyed by a term, so frequent terms make no hot key; documents never meet in pairs.

Defined cases: a null text, or one without terms, is no document of the statistics and is never found; items without terms,
or whose terms no document has, give no rows; identical rows of items are one item, rows of one identifier and different texts are ranked
each on its own; repeated documents are each found, equal scores go by ascending ``doc_id``, null last; empty tables give no rows; further columns are
ignored; texts are read whole, a document's postings are at most the block's terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.arrow import pieces
from docspark.storage import Workspace

K = 10
#: A document's length counts 90 % of the normaliser, as in the contract: 100 - 90 + 90 * n / average.
FLAT, SLOPE = 10, 90
_POSTINGS = 1 << 21
_FOLD = bytes(c | 0x20 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The UTF-8 terms: maximal runs of ASCII letters and digits and all other characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(documents: int, frequency: int) -> int:
    """A term's weight by the number of all documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Items:
    """A block of items: the rows of the first matrix over the block's own vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str | None]], once: bool):
        self.ids = [item for item, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for _, text in rows:
            counted = Counter(terms(text))
            at = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counted], np.int64)
            self.rows.append((at, np.array([1 if once else n for n in counted.values()], np.int64)))


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tf)`` per document: its length and the counts of the vocabulary's terms."""

    def run(batches):
        for batch in pieces(batches, "text"):
            sizes, offsets, found, counts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                all_terms = terms(text)
                own = Counter(map(vocabulary.get, all_terms))
                own.pop(None, None)
                sizes.append(len(all_terms))
                found.extend(own)
                counts.extend(own.values())
                offsets.append(len(found))
            offsets = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``_POSTINGS`` postings, or one document."""
    for batch in batches:
        ends, start = np.cumsum(pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _POSTINGS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [np.empty((3, 0), np.int64)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        if len(scores) > self.k:  # all that tie with the last place compete for it
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= last
            scores, ids, nameless = scores[keep], ids[keep], nameless[keep]
        every = np.concatenate((self.held[item], np.stack((scores, ids, nameless))), axis=1)
        self.held[item] = every[:, np.lexsort((every[1], every[2], -every[0]))[: self.k]]


def _product(counts: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: the best ``k`` documents of each item in each task."""

    def run(batches):
        best = Best(len(items.ids), k)
        for batch in _blocks(batches):
            lists, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            term = lists.flatten().to_numpy()
            norm = np.array([FLAT + SLOPE * n * documents // length if n else FLAT for n in batch.column("n").to_pylist()], np.int64)
            tf = tf.astype(np.int64)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[own]))
            by_term = np.argsort(term, kind="stable")
            own, impact = own[by_term], impact[by_term]
            starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(weights)))))
            nameless = pa.compute.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            total = np.zeros(batch.num_rows, np.int64)
            for item, (row, times) in enumerate(items.rows):
                for a, b, n in zip(starts[row], starts[row + 1], times, strict=True):
                    total[own[a:b]] += n * impact[a:b]  # a term row names a document once
                found = np.flatnonzero(total)
                if len(found):
                    best.add(item, total[found], ids[found], nameless[found])
                    total[found] = 0
        for item, (scores, ids, nameless) in enumerate(best.held):
            if len(scores):
                n = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int32()), pa.array([items.ids[item]] * n, pa.int64()), pa.array(ids, mask=nameless.astype(bool)), pa.array(scores)],
                    ["item", "item_id", "doc_id", "score"],
                )

    return counts.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, once: bool = True, block_bytes: int = 1 << 24) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` documents of the highest scores above zero.

    ``once`` counts each of an item's terms once, otherwise as often as the item has it.
    """
    work = Workspace(docs.sparkSession, "lexical")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = wanted.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    blocks = 1 + size // block_bytes
    wanted = work.table(wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items", 0)
    ranked = None
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in range(blocks):
        own = Items([(r["item_id"], r["text"]) for r in wanted.where(F.col("block") == block).sort("item_id", "text").collect()], once)
        if not own.vocabulary:
            continue
        counts = work.table(_counts(docs, own.vocabulary), "counts")
        all_ = counts.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        found = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most the block's vocabulary
        weights = np.zeros(len(own.vocabulary), np.int64)
        weights[found.column("term").to_numpy()] = [weight(all_["documents"], n) for n in found.column("count").to_pylist()]
        best = _product(counts, own, weights, all_["documents"], all_["length"] or 1, k)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = work.table(best.select("item_id", "rank", "doc_id", "score"), "best", 0)
        work.drop(counts)
        ranked = best if ranked is None else ranked.unionByName(best)
    if ranked is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return ranked


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents),
  size as (select count(*) as docs, sum(len(ts)) as long_ from d where len(ts) > 0),
  words as (select r, doc_id, len(ts) as n, unnest(ts) as term from d),
  counted as (select r, doc_id, n, term, count(*) as tf from words group by all),
  known as (select term, count(*) as df from counted group by term),
  asked as (select distinct i, item_id, unnest(ts) as term from
    (select row_number() over () as i, item_id, {_TERMS} as ts from (select distinct item_id, text from benchmark))),
  scored as (
    select i, item_id, r, doc_id, sum(cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
      * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // long_)))) as score
    from asked join known using (term) join counted using (term) cross join size group by all),
  ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 10
"""

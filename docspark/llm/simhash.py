"""Near-duplicate groups from 64-bit SimHash fingerprints, found by a segment-popcount grid join.

A document's words (maximal runs without ASCII white space, A-Z lower-cased) give three-word
shingles; every shingle is hashed by XXH64, and a fingerprint bit is 1 where over half the hashes
have it. Two fingerprints are linked at ``max_distance`` = 2 or fewer differing bits.

Finding the links. A fingerprint is embedded as the vector of bit counts of its sixteen 4-bit
segments. A differing bit changes one count by one, so the Manhattan distance of two embeddings is
a lower bound of the Hamming distance: linked fingerprints lie at most 2 apart on that grid, and
then share a grid point at most 1 away from both. Every distinct fingerprint is therefore listed
under its own grid point and those next to it (33 at most), an equi-join on the grid point brings
candidates together, and ``bit_count(a ^ b)`` verifies them inside the join condition, so that
rejected candidates never become rows.

Dense points. A big family of near copies crowds the same grid points, where joining all members
with each other would be quadratic. Members of points with over ``dense`` fingerprints take an exact
linear way: two fingerprints differ in at most 2 bits if and only if some 64-bit word is at most one
bit away from both, so each is listed under itself and its 64 one-bit neighbours and tied to the
least fingerprint listed there. No link is lost, and no pairs are formed.

Exact copies meet before all that (one row per distinct fingerprint), components come from
:mod:`docspark.llm.components`, and only identifiers and fingerprints are shuffled, never texts. The
documents of a crowded fingerprint, and the fingerprints of a giant component, are dealt over salts.

Defined cases: fewer than three words are one shingle; no words, or a null text, give fingerprint
zero, which is linked like any other; null identifiers never name a component unless it has no
other; repeated rows are repeated in the result; an empty table gives no rows; further columns
are ignored; a text of any length is hashed shingle by shingle, in blocks of 65,536 hashes.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docspark.llm.arrow import pieces
from docspark.llm.components import connected_components
from docspark.llm.names import free
from docspark.llm.skew import salted_join, spread_join
from docspark.storage import Workspace

WORDS, SEED, MAX_DISTANCE = 3, 42, 2
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    """The hash of every shingle of ``words`` words; fewer words are one, no words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxh64_intdigest(whole, seed)]
    ends = list(accumulate((len(x) + 1 for x in tokens), initial=-1))  # ends[i]: end of word i - 1
    return [xxh64_intdigest(whole[a + 1 : b], seed) for a, b in zip(ends, ends[words:], strict=False)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    return print_of(shingle_hashes(text, words, seed))


def print_of(hashes) -> int:
    """The fingerprint of unsigned hashes: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[i : i + _BLOCK], ">u8")
        ones += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp)`` per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for batch in pieces(batches, "text"):
            prints = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return chosen.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _counts(fp: Column) -> Column:
    """The bit counts of the sixteen 4-bit segments, one per hexadecimal digit."""
    lowest = F.lit(0x1111111111111111)
    first, second, third, fourth = (F.shiftrightunsigned(fp, i).bitwiseAND(lowest) for i in range(4))
    return first + second + third + fourth


_NEXT = """filter(flatten(transform(sequence(0, 15), i -> array(
    if(shiftright(own, 4 * i) % 16 < 4, own + shiftleft(1L, 4 * i), null),
    if(shiftright(own, 4 * i) % 16 > 0, own - shiftleft(1L, 4 * i), null)))), x -> x is not null)"""


def _cells(nodes: DataFrame) -> DataFrame:
    own = nodes.select("fp", _counts(F.col("fp")).alias("own"))
    return own.select("fp", "own", F.explode(F.concat(F.array("own"), F.expr(_NEXT))).alias("cell"))


def close(nodes: DataFrame, work: Workspace, dense: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(a, b)`` of linked fingerprints, ``(a, b)`` of ties among crowded ones, and the crowded ``fp``.

    The first hold every link but those between two crowded fingerprints, which the ties join.
    """
    sizes = work.table(_cells(nodes).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    sparse = work.table(_cells(nodes).join(sizes.where(F.col("n") <= dense).select("cell"), "cell"), "sparse")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE
    # two fingerprints of one grid point meet there, not at its neighbours once more
    once = (F.col("a.own") != F.col("b.own")) | (F.col("a.cell") == F.col("a.own"))
    a, b = sparse.alias("a"), sparse.alias("b")
    found = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & once & near)
    found = found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = salted_join(_cells(nodes), sizes.where(F.col("n") > dense).select("cell"), ["cell"], ["fp"], "left_semi").select("fp").distinct()
    flips = F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"))
    listed = work.table(crowd.select("fp", F.explode(flips).alias("word")), "dense")
    hubs = listed.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    tied = listed.join(hubs, "word").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return found, tied, listed.where("word = fp").select("fp")


def links(nodes: DataFrame, work: Workspace, dense: int = 32) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that join exactly what ``MAX_DISTANCE`` links."""
    found, tied, _ = close(nodes, work, dense)
    return found.unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, dense: int = 32) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` per row of ``docs(doc_id, text)``.

    ``component_id`` is the least identifier reachable over links, the row's own included.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, words), "prints")
    nodes = work.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    components = connected_components(links(nodes.select("fp"), work, dense), work)
    of = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    of = work.table(of, "members")
    sizes = of.agg(F.count("*").alias("nodes"), F.sum("copies").alias("rows")).first()
    named = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    member = work.table(spread_join(of, named, "root", ["fp"], "__n", sizes["nodes"]).select("fp", "copies", "component_id"), "named")
    return spread_join(prints, member, "fp", ["doc_id", "text_hash"], "copies", sizes["rows"] or 0).select("doc_id", "text_hash", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least identifier.

    Rows of equal identifier and text are repeats, of which one stays.
    """
    kept_id, kept_hash = free(docs.columns, "kept_id", "kept_hash")
    found = near_duplicates(docs, words)
    group = F.coalesce("component_id", "fp")  # a group without any identifier goes by a fingerprint
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    kept = found.groupBy(F.col("component_id").isNull().alias("nameless"), group.alias("g")).agg(best.alias("b"), F.count("*").alias("n"))
    kept = Workspace(docs.sparkSession, "simhash").table(kept.select(F.col("b.doc_id").alias(kept_id), F.col("b.text_hash").alias(kept_hash), "n"), "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(docs["text"]) == F.col(kept_hash))
    out = docs.join(kept, same, "left_semi")
    repeats = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).groupBy("id", "hash").count().where("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if repeats.limit(1).count() else out

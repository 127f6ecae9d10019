"""Near copies by SimHash and the exact Jaccard similarity of word shingles.

A document is the set of its ``words``-word shingles (words and hashes as in :mod:`docspark.llm.simhash`;
fewer words are one shingle). Two documents are linked where their sets' Jaccard similarity is at least
``similarity``; components of links are groups.

SimHash comes first. Sets whose fingerprints over the same shingles differ in at most two bits are found by
the segment-popcount grid of :mod:`docspark.llm.simhash` and compared exactly. These pairs are SimHash's alone: all of them
are listed, and what follows leaves them out. Only crowded fingerprints (in a grid point of over 32, or of over
``_COPIES`` sets), whose pairs would be quadratic, are tied to one each instead; their other pairs are left to what
follows. SimHash cannot see all links: at a similarity of 0.8, fingerprints differ in about 10 of 64 bits, and no grid is
selective at that radius.

The links further apart (Chaudhuri, Ganti, Kaushik, "A primitive operator for similarity joins in data
cleaning", ICDE 2006; Xiao et al., "Efficient similarity joins for near duplicate detection", WWW 2008). In any
one order of all shingles, two sets of similarity ``s`` share one of the first ``n - ceil(s * n) + 1`` of each.
Only these prefixes are shuffled. At the first shared shingle, sizes and places bound the overlap from
above. Every node also has a sketch: whether an odd number of its hashes ends in each value of 9 bits; two sets
differ in at least as many members as their sketches in bits. Pairs that either bound rules out are
dropped, the others are compared exactly. No linked pair is lost.
The order puts shingles that are frequent in a sample last; the sample and ``most_frequent`` affect time only.

Crowded shingles. Members of a family of near copies share most shingles, and all their pairs would be
quadratic. While some shingle has members of over ``dense`` groups, and links unite groups, members are compared with a few
hubs each, the smallest set among them; in the end only pairs of different groups are left. Those of shingles that are still crowded (a cloud
around a text, each a little too far from it) are tried against folded sketches within the join. The members
of a shingle are dealt over salts.

Defined cases: no words, or a null text, give the empty set, which is equal to itself only; the row of the
least identifier stays, null being the last; repeated rows are one; an empty table gives no rows; texts of any
length are hashed whole; other columns stay as they are.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docspark.llm import simhash
from docspark.llm.arrow import pieces
from docspark.llm.components import connected_components
from docspark.llm.names import free
from docspark.llm.skew import salted_join, spread_join
from docspark.storage import Workspace

WORDS, SIMILARITY = 5, 0.8
_SAMPLE, _FREQUENT, _BROADCAST, _BITS, _HUBS, _DEALT, _COPIES = 8, 3, 500_000, 512, 6, 2000, 4


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes in ascending order, as signed longs."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64).view(np.int64))


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _frequent(docs: DataFrame, words: int, most: int) -> np.ndarray:
    """The most frequent shingles of a sample, by ascending number of documents."""

    def run(batches):
        for batch in pieces(batches, "text"):
            found = [shingle_set(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["token"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= _FREQUENT)
    found = counted.orderBy(F.desc("count"), "token").limit(most).select("token").toArrow()
    return found.column("token").to_numpy()[::-1].copy()


def _prefixes(docs: DataFrame, words: int, similarity: Fraction, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, node, n, sketch, bits, fp, prefix)`` per row; equal sets are one node; ``bits`` is the sketch folded to four longs."""

    def run(batches):
        by_value = np.argsort(frequent)
        values = frequent[by_value]
        for batch in pieces(batches, "text"):
            nodes, sizes, sketches, bits, prints, prefixes = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, words)
                n = len(own)
                prints.append(simhash.print_of(own.view(np.uint64)))
                nodes.append(_node(own))
                sizes.append(n)
                odd = (np.bincount(own & (_BITS - 1), minlength=_BITS) & 1).astype(bool)
                sketches.append(np.packbits(odd).tobytes())
                bits.append(np.packbits(odd[: _BITS // 2] ^ odd[_BITS // 2 :]).view(np.int64))
                rank = np.full(n, -1)
                if len(values):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    known = values[at] == own
                    rank[known] = by_value[at[known]]
                need = -(-similarity.numerator * n // similarity.denominator)
                prefixes.append(own[np.argsort(rank, kind="stable")][: n - need + 1])
            offsets = np.cumsum([0, *map(len, prefixes)])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes)))
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64)), listed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "node", "n", "sketch", "bits", "fp", "prefix"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return chosen.mapInArrow(run, "doc_id long, text_hash long, node long, n int, sketch binary, bits array<long>, fp long, prefix array<long>")


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST else rows


def _beyond() -> Column:
    """Whether the pair is not SimHash's: its fingerprints ``f`` and ``g`` are further apart, or one is crowded (null)."""
    return F.coalesce(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) > simhash.MAX_DISTANCE, F.lit(True))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: Fraction, work: Workspace, where: Column | None = None) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar enough; of those that ``where`` lets pass, if given."""

    def alike(batches):
        p, q = similarity.numerator, similarity.denominator
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
                differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(differ * (p + q) <= batch.column("n").to_numpy() * (q - p)))

    x, y = (nodes.select(F.col("node").alias(c), F.col("sketch").alias(s), F.col("n").cast("long").alias(n), F.col("fp").alias(f)) for c, s, n, f in (("a", "x", "m", "f"), ("b", "y", "n", "g")))
    met = pairs.join(x, "a").join(y, "b")
    sketched = (met if where is None else met.where(where)).select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("n"))
    pairs = work.table(sketched.mapInArrow(alike, "a long, b long"), "alike")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = work.table(nodes.join(ends, "node", "left_semi").select("text_hash").distinct(), "wanted")

    def sets(batches):
        for batch in pieces(batches, "text"):
            own = [shingle_set(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["node", "tokens"])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(_small(wanted), "text_hash", "left_semi")
    own = work.table(texts.select("text").mapInArrow(sets, "node long, tokens array<long>").dropDuplicates(["node"]), "sets")

    # common / (x + y - common) >= p / q
    p, q = similarity.numerator, similarity.denominator
    enough = F.size(F.array_intersect("x", "y")).cast("long") * (p + q) >= (F.size("x") + F.size("y")).cast("long") * p
    joined = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    found = work.table(joined.where(enough).select("a", "b"), "links")
    for done in (pairs, wanted, own):
        work.drop(done)
    return found


def _possible(similarity: Fraction) -> Column:
    """Whether a shared shingle, if it is the first, leaves room for the overlap that ``x`` and ``y`` need."""
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")).cast("long")
    p, q = similarity.numerator, similarity.denominator
    return room * (p + q) >= (F.col("x.n") + F.col("y.n")).cast("long") * p


def _grouped(tokens: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """``tokens`` with each node's present ``root``; shingles within one group only are left out."""
    roots = connected_components(links, work)
    known = tokens.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = work.table(known, "rooted")
    open_ = known.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    out = work.table(known.join(open_, "token", "left_semi"), "open")
    for done in (known, tokens):
        work.drop(done)
    return out


def near_prints(nodes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of nodes of close fingerprints, and ``nodes``, in which the ``fp`` of crowded ones is null.

    All pairs of nodes that are not crowded are there; crowded ones go with the least node of their fingerprint, and of the close ones.
    """
    prints = work.table(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("copies")), "prints")
    close, tied, crowd = simhash.close(prints.select("fp"), work)
    marked = prints.join(crowd.withColumn("dense", F.lit(True)), "fp", "left")
    crowded = F.coalesce("dense", F.lit(False)) | (F.col("copies") > _COPIES)
    marked = marked.select("fp", "hub", "copies", crowded.alias("crowded"), (F.col("copies") > 1).alias("several"))
    placed = work.table(spread_join(nodes, marked, "fp", ["node"], "copies", nodes.count()), "placed")
    ends = work.table(placed.where("not crowded or node = hub").select("fp", "node"), "ends")
    one, two = (ends.select(F.col("fp").alias(x), F.col("node").alias(f"of_{x}")) for x in ("a", "b"))
    tied = tied.select(F.col("b").alias("a"), F.col("a").alias("b"))  # the smaller first, as in the links
    other = close.unionByName(tied).distinct().join(one, "a").join(two, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    few = placed.where("several and not crowded")
    same = few.select("fp", F.col("node").alias("a")).join(few.select("fp", F.col("node").alias("b")), "fp").where("a < b").select("a", "b")
    hubs = placed.where("several and crowded and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = other.unionByName(same).unionByName(hubs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = work.table(pairs, "near")
    for done in (prints, ends):
        work.drop(done)
    return near, placed.withColumn("fp", F.when(~F.col("crowded"), F.col("fp"))).select(*nodes.columns)


def shared_tokens(nodes: DataFrame, work: Workspace) -> DataFrame:
    """``(node, n, pos, token, root)``: the places of the prefixes' shingles that several nodes have."""
    index = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = index.groupBy("token").count().where("count > 1").select("token")
    return work.table(index.join(shared, "token", "left_semi").withColumn("root", F.col("node")), "tokens")


def _met(tokens: DataFrame, nodes: DataFrame, work: Workspace, similarity: Fraction, dense: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different groups that share a shingle and may be alike.

    Under shingles of over ``dense`` groups, the sketches are compared in the join itself, so that pairs which they rule out are no rows; a shingle's
    members are dealt over a part for every 2000 of them there.
    """
    fit = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _possible(similarity)
    sizes = tokens.groupBy("token").agg(F.count_distinct("root").alias("groups"), F.count("*").alias("members"))
    crowded = work.table(sizes.where(F.col("groups") > dense).select("token", F.ceil(F.col("members") / _DEALT).cast("int").alias("parts")), "crowded")
    one = F.struct("node", "n", "pos", "root")
    few = tokens.join(crowded.select("token"), "token", "left_anti")
    ends = F.col("x.node").alias("a"), F.col("y.node").alias("b")
    pairs = few.select("token", one.alias("x")).join(few.select("token", one.alias("y")), "token").where(fit).select(*ends)
    many = salted_join(tokens, crowded, ["token"], ["node"]).join(nodes.select("node", "bits"), "node").select("token", "parts", F.struct("node", "n", "pos", "root", "bits").alias("x"))
    p, q = similarity.numerator, similarity.denominator
    differ = sum(F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(4)).cast("long")
    near = differ * (p + q) <= (F.col("x.n") + F.col("y.n")).cast("long") * (q - p)
    dealt = many.select("token", "x", F.pmod(F.xxhash64("x.node"), F.col("parts")).cast("int").alias("part"))
    copied = many.select("token", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(copied, ["token", "part"]).where(fit & near)
    return pairs.unionByName(met.select(*ends)).distinct()


def links(docs: DataFrame, nodes: DataFrame, tokens: DataFrame, work: Workspace, words: int, similarity: Fraction, dense: int = 32) -> DataFrame:
    """Edges ``(a, b)`` that join exactly the nodes whose similarity is high enough, over other nodes or directly."""
    near, placed = near_prints(nodes, work)
    work.drop(nodes)
    nodes, found = placed, near.limit(0)
    if near.limit(1).count():
        found = _verified(near, nodes, docs, words, similarity, work)
        if found.limit(1).count():
            tokens = _grouped(tokens, found, work)
    for turn in range(100):
        crowded = tokens.select("token", "root").distinct().groupBy("token").count().where(F.col("count") > dense).select("token")
        crowd = work.table(salted_join(tokens, crowded, ["token"], ["node"], "left_semi"), "crowd")
        members = crowd.select("node").distinct().count()
        if not members:
            break
        one = F.struct("node", "n", "pos", "root")
        # the smallest set is the most alike to all others that a passage fills; others by chance, other ones each turn
        picks = [F.min_by(one, F.struct("n", "node")), *[F.min_by(one, F.xxhash64("node", F.lit(turn * _HUBS + i))) for i in range(_HUBS - 1)]]
        hubs = crowd.groupBy("token").agg(*[p.alias(f"y{i}") for i, p in enumerate(picks)])
        hubs = hubs.select("token", F.explode(F.array_distinct(F.array(*[f"y{i}" for i in range(_HUBS)]))).alias("y"))
        fit = (F.col("x.root") != F.col("y.root")) & _possible(similarity)
        met = salted_join(crowd.select("token", "node", F.struct("node", "n", "pos", "root").alias("x")), hubs, ["token"], ["node"]).where(fit)
        met = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = work.table(met.distinct(), "pairs")
        new = _verified(pairs, nodes, docs, words, similarity, work, _beyond())
        n = new.count()
        if n:
            found = found.unionByName(new)
            tokens = _grouped(tokens, found, work)
        work.drop(crowd)
        work.drop(pairs)
        if turn and n < members / 5:  # hubs unite little more: what is left is compared under its sketches
            break
    pairs = work.table(_met(tokens, nodes, work, similarity, dense), "pairs")
    found = found.unionByName(_verified(pairs, nodes, docs, words, similarity, work, _beyond()))
    for done in (tokens, pairs):
        work.drop(done)
    return found


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, dense: int = 32, most_frequent: int = 500_000) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least identifier."""
    work, share = Workspace(docs.sparkSession, "jaccard"), Fraction(str(similarity))
    prints = work.table(_prefixes(docs, words, share, _frequent(docs, words, most_frequent)), "prints")
    whole = work.table(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "bits", "fp", "prefix")], F.min("text_hash").alias("text_hash")), "whole")
    tokens, nodes = shared_tokens(whole, work), work.table(whole.drop("prefix"), "nodes")
    work.drop(whole)
    named = work.table(prints.select("doc_id", "text_hash", "node"), "documents")
    work.drop(prints)
    roots = connected_components(links(docs, nodes, tokens, work, words, share, dense), work)
    rows = named.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    rows = work.table(rows, "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("b"), F.count("*").alias("n")).where("n > 1")
    other = ~F.col("doc_id").eqNullSafe(F.col("b.doc_id")) | (F.col("text_hash") != F.col("b.text_hash"))
    gone_id, gone_hash = free(docs.columns, "gone_id", "gone_hash")
    gone = rows.join(best, "root").where(other).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    gone = _small(work.table(gone, "gone"))
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_hash)), "left_anti")
    repeats = rows.groupBy("doc_id", "text_hash").count().where("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if repeats.limit(1).count() else out

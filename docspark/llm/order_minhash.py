"""Order MinHash fingerprints, which lose likeness when passages move, not only when they change.

A text's tokens are maximal runs of letters, marks and digits of alphabetic scripts, single ideographs, and runs of other
characters without white space. Its k-mers are ``k`` = 3 neighbouring tokens (fewer are one k-mer), numbered by
occurrence, so that a k-mer's second place is another element than its first. As in Marçais, DeBlasio, Pandey, Kingsford,
"Locality-sensitive hashing for the edit distance" (ISMB 2019), each of ``orders`` random orders of the elements selects
the ``length`` = 2 minimal ones; these are put into text order, and the tuple's hash is one place of the fingerprint. The share of
equal places estimates how alike two texts are as multisets of k-mers and in the order of these.

The orders are rotations of one ring: an element's hash is its point there, and order ``j`` ranks elements by their distance
from the ``j``-th of ``orders`` evenly spaced starts. One sort per text then serves all orders, and short texts fill all places.

Plan: columns and joins only. All arrays are made from one row's text, by sorts of packed 64-bit integers (hash before
place). The next text by descending identifier is found on identifiers and hashes alone: they are dealt by ranges,
written with their range, and each range ends at the first key of the following one (a row a range). Each text sends as many
code points as the text before it needs; whole texts are shuffled once. No key is shared: equal rows are numbered by a count.

Defined cases: a null text is empty; texts without tokens have the empty fingerprint, which is as likely (1) as another empty one and unlike (0) any other;
identifiers descend, null comes last; rows of equal identifier go by the text's hash, equal rows follow each other and then lead to the next;
a single row follows itself; an empty table gives no rows; further columns are ignored. A text is one row and its arrays take about a hundred bytes a
token; there is no limit but Spark's own on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.storage import Workspace

K, LENGTH, ORDERS = 3, 2, 64
_TOKEN = r"[\p{IsAlphabetic}\p{M}\p{N}&&[^\p{IsIdeographic}]]+|\p{IsIdeographic}|[^\s\p{IsAlphabetic}\p{M}\p{N}]+"
_KEY = ["doc_id", "text_hash"]


def signatures(df: DataFrame, texts: dict[str, str], k: int = K, length: int = LENGTH, orders: int = ORDERS) -> DataFrame:
    """``df`` with a fingerprint for each of ``texts`` (new name by column): an array of 16-bit tuple hashes, one an order, or null.

    The columns in ``texts`` are dropped.
    """
    span = (1 << 31) // orders  # of the ring between two starts
    kmer = ", ".join(f"get({{0}}, i + {j})" for j in range(k))
    steps = [
        f"regexp_extract_all({{0}}, r'{_TOKEN}', 0)",
        # k-mers: hash (31 bits) before place (odd), sorted, so that equal ones are neighbours in text order
        f"""sort_array(transform(if(size({{0}}) = 0, array(), sequence(0, greatest(0, size({{0}}) - {k}))),
            i -> shiftleft(xxhash64({kmer}) & 2147483647L, 32) | shiftleft(i, 1) | 1))""",
        # where second and further occurrences are
        """struct({0} as s, if(size({0}) < 2, array(), filter(sequence(1, size({0}) - 1), i -> shiftright(get({0}, i), 32) = shiftright(get({0}, i - 1), 32))) as q)""",
        # where those of one k-mer begin: its first occurrence lies between
        """struct({0}.s as s, {0}.q as q, if(size({0}.q) = 0, array(), filter(sequence(0, size({0}.q) - 1), j -> j = 0 or get({0}.q, j) > get({0}.q, j - 1) + 1)) as b)""",
        # the ring: a first occurrence lies at its k-mer's hash, others at a hash with their number; the starts of the orders (even) among them
        f"""sort_array(concat(
            if(size({{0}}.q) = 0, {{0}}.s, filter({{0}}.s, (x, i) -> i = 0 or shiftright(x, 32) <> shiftright(get({{0}}.s, i - 1), 32))),
            flatten(transform({{0}}.b, (first, j) -> transform(sequence(0, coalesce(get({{0}}.b, j + 1), size({{0}}.q)) - first - 1), o ->
                shiftleft(xxhash64(shiftright(get({{0}}.s, get({{0}}.q, first + o)), 32), o + 1) & 2147483647L, 32) | (get({{0}}.s, get({{0}}.q, first + o)) & 4294967295L)))),
            transform(sequence(0L, {orders - 1}L), j -> shiftleft(j * {span}L, 32))))""",
        "struct(filter({0}, x -> (x & 1) = 1) as points, filter(sequence(0, size({0}) - 1), i -> (get({0}, i) & 1) = 0) as starts)",
        # the next points of each start, place before hash, in text order; of these the hashes
        f"""if(size({{0}}.points) = 0, null, transform({{0}}.starts, (i, j) -> cast(xxhash64(transform(sort_array(transform(sequence(0, least({length}, size({{0}}.points)) - 1),
            t -> shiftleft(get({{0}}.points, (i - j + t) % size({{0}}.points)), 32) | shiftright(get({{0}}.points, (i - j + t) % size({{0}}.points)), 32))),
            x -> x & 4294967295L)) & 65535 as int)))""",
    ]
    # each step names the one before it more than once, which keeps Spark from nesting it into a lambda
    for number, step in enumerate(steps):
        last = number == len(steps) - 1
        made = {new: new if last else f"__step{number}_{new}" for new in texts}
        rest = [c for c in df.columns if c not in texts.values()]
        df = df.select(*rest, *[F.expr(step.replace("{0}", f"`{old}`")).alias(made[new]) for new, old in texts.items()])
        texts = made
    return df


def fingerprint(places: Column) -> Column:
    """Four hexadecimal digits a place; the empty string for texts without tokens."""
    return F.coalesce(F.array_join(F.transform(places, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), ""), F.lit(""))


def likeness(x: Column, y: Column) -> Column:
    """The share of equal places of two fingerprints (arrays)."""
    equal = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, hit: n + hit) / F.size(x)
    return F.when(x.isNull() | y.isNull(), (x.isNull() & y.isNull()).cast("double")).otherwise(equal)


def _followers(keys: DataFrame, rows: int, work: Workspace) -> DataFrame:
    """``keys(doc_id, text_hash, ...)``, one row a key, with the key behind it by descending ``doc_id`` (``next_id``, ``next_hash``)."""
    order = ["nameless", "down", "text_hash"]  # ~doc_id ascends where doc_id descends
    keyed = keys.withColumns({"nameless": F.col("doc_id").isNull(), "down": F.bitwise_not("doc_id")})
    ranged = keyed.repartitionByRange(work.files(rows), *order)
    ranged = work.table(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    following = lambda w: F.lead(F.struct(*order)).over(w)
    inside = ranged.withColumn("own", following(Window.partitionBy("range").orderBy(*order)))
    first = ranged.groupBy("range").agg(F.min(F.struct(*order)).alias("first"))  # a row a range
    every = Window.orderBy("range")
    first = first.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("other"))
    found = inside.join(F.broadcast(first), "range").withColumn("next", F.coalesce("own", "other"))
    return found.select(*keys.columns, F.bitwise_not("next.down").alias("next_id"), F.col("next.text_hash").alias("next_hash"))


def edited_texts(docs: DataFrame, work: Workspace) -> DataFrame:
    """``(doc_id, text_hash, n, next_id, next_hash, times, text, edited)``: the last third of each text replaced by the next text's start.

    Equal rows are one row here, ``times`` many of which lead to the same next one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    keys = work.table(texts.groupBy("doc_id", "text_hash").agg(F.first(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies")), "keys")
    size = keys.agg(F.count("*").alias("rows"), F.sum("n").alias("chars"), F.max("copies").alias("copies")).first()
    links = _followers(keys, size["rows"], work).withColumn("times", F.lit(1).cast("long"))
    if (size["copies"] or 0) > 1:  # all but the last of equal rows lead to themselves
        texts = texts.dropDuplicates(_KEY)
        again = keys.where("copies > 1").select(*keys.columns, F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), (F.col("copies") - 1).alias("times"))
        links = links.unionByName(again)
    links = work.table(links.drop("copies"), "links")
    # the fingerprints of a text cost far more than its bytes: tasks of about 32 million code points
    parts = max(4 * work.spark.sparkContext.defaultParallelism, (size["chars"] or 0) >> 25)
    key = ["nameless", "id", "hash"]
    by = lambda i, h: [F.col(i).isNull().alias("nameless"), F.coalesce(i, F.lit(0).cast("long")).alias("id"), F.col(h).alias("hash")]
    # both joins read one and the same shuffle of the texts
    own = texts.select(*by(*_KEY), "text").repartition(parts, *key)
    starts = links.select(*links.columns, *by("next_id", "next_hash")).repartition(parts, *key).join(own, key)
    starts = starts.select(*links.columns, *by(*_KEY), F.expr("left(text, cast(n div 3 as int))").alias("start")).repartition(parts, *key)
    return starts.join(own, key).select(*links.columns, "text", F.concat(F.expr("left(text, cast(n - n div 3 as int))"), "start").alias("edited"))


def fingerprints(docs: DataFrame, k: int = K, length: int = LENGTH, orders: int = ORDERS) -> DataFrame:
    """``(doc_id, text, places)`` per row of ``docs(doc_id, text)``, further columns kept: each text's fingerprint."""
    name = "__places"
    while name in docs.columns:
        name += "_"
    held = docs.withColumn(name, F.coalesce("text", F.lit("")))
    return signatures(held, {"places": name}, k, length, orders)


def compare_edited(docs: DataFrame, k: int = K, length: int = LENGTH, orders: int = ORDERS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, own, edited, next)`` per row of ``docs``: the fingerprints of its text, of its edited text, and of the next."""
    work = Workspace(docs.sparkSession, "orders")
    texts = edited_texts(docs, work).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    made = work.table(signatures(texts, {"own": "text", "changed": "edited"}, k, length, orders), "fingerprints")
    following = made.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("own").alias("next")).dropDuplicates(["of_id", "of_hash"])
    found = made.join(following, F.col("next_id").eqNullSafe(F.col("of_id")) & F.col("next_hash").eqNullSafe(F.col("of_hash")))
    found = found.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", "own", F.col("changed").alias("edited"), "next", "times")
    repeated = F.explode(F.expr("sequence(1L, times)"))
    return found.select(*found.columns, repeated.alias("copy")).drop("copy", "times")

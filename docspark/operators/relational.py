"""Relational operators of document assembly, as DataFrame plans.

Every operator takes its partitioning keys, so the same plan serves one archive or millions; all
windows are partitioned by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.text import MASK32, unresolved_name


def running_offset(rows: DataFrame, keys: list[str], order: str, delta: str, base: str, out: str = "run") -> DataFrame:
    """Before each row, the last non-null ``base`` of earlier rows plus the deltas since then."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretch = Window.partitionBy(*keys, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("__g", F.coalesce(F.count(F.col(base)).over(earlier), F.lit(0)))
    marked = marked.withColumn("__b", F.coalesce(F.last(base, ignorenulls=True).over(earlier), F.lit(0).cast("long")))
    total = F.col("__b") + F.coalesce(F.sum(delta).over(stretch), F.lit(0))
    return marked.withColumn(out, F.least(total, F.lit(MASK32))).drop("__g", "__b")


def forward_asof(entries: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, mark: str) -> DataFrame:
    """Every entry of ``entries(keys, at, ...)`` with the first mark, in the order ``mark``, whose running
    maximum of ``mark_at`` reaches the entry; entries above all marks are dropped."""
    order = Window.partitionBy(*keys).orderBy(mark)
    reach = marks.select(*keys, F.col(mark).alias("__mark"), F.max(mark_at).over(order).alias("__at"))
    held = entries.select(*keys, F.struct(*entries.columns).alias("__entry"), F.col(at).alias("__at"))
    both = held.withColumn("__mark", F.lit(None).cast("long")).unionByName(reach.withColumn("__mark", F.col("__mark").cast("long")), allowMissingColumns=True)
    # from the largest offset down, so that the frame only grows and every row costs the same
    falling = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.col("__mark").isNotNull().desc(), F.desc("__mark")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(mark, F.last("__mark", ignorenulls=True).over(falling))
    return found.where(F.col("__entry").isNotNull() & F.col(mark).isNotNull()).select("__entry.*", mark)


def spans(rows: DataFrame, keys: list[str], order: str, starts: Column, out: str = "span") -> DataFrame:
    """The number of the span that ``starts`` opened last; rows before the first one go."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.count_if(starts).over(so_far) - 1).where(F.col(out) >= 0)


def merge_runs(rows: DataFrame, keys: list[str], order: str, same: str, text: str, separator: str = "") -> DataFrame:
    """Neighbouring rows of equal ``same`` as one, with their texts joined."""
    line = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(same).over(line).eqNullSafe(F.col(same)) & (F.row_number().over(line) > 1), 0).otherwise(1)
    numbered = rows.withColumn("__c", change).withColumn("run", F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).cast("string").alias("t"))))
    return numbered.groupBy(*keys, "run").agg(F.first(same).alias(same), F.count("*").alias("n"), F.array_join(F.transform(pieces, lambda x: x["t"]), separator).alias(text))


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``left`` joined with ``right``, a row a key: a key's left rows, which may be a third of all, are dealt over ``salts`` tasks by the columns ``by``.

    ``right`` is ``salts`` times as large as Spark believes, so that it must not be broadcast by its size.
    """
    salt = "salt"
    while salt in [*left.columns, *right.columns]:
        salt += "_"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return dealt.join(unbroadcast(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))), [*on, salt], how).drop(salt)


def unbroadcast(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that never sends them through the driver: Spark takes a stored table to be as large as its compressed files, a tenth or a hundredth of its rows."""
    return rows.hint("merge")


def resolve(links: DataFrame, names: DataFrame, keys: list[str], value: str, name: str, out: str = "target") -> DataFrame:
    """The name of every ``value``, or its hexadecimal form where ``names`` has none."""
    return links.join(names.select(*keys, value, F.col(name).alias("__n")), [*keys, value], "left").withColumn(out, F.coalesce("__n", unresolved_name(F.col(value)))).drop("__n")


def inverted_index(rows: DataFrame, keys: list[str], words: str, order: list[str], entry: str) -> DataFrame:
    """A1: word to entries in ``order``, repeats kept, words by their bytes."""
    said = rows.select(*keys, F.struct(*order).alias("__o"), F.col(entry).alias("__e"), F.posexplode(words).alias("__p", "word"))
    listed = F.sort_array(F.collect_list(F.struct("__o", "__p", "__e")))
    return said.groupBy(*keys, "word").agg(F.transform(listed, lambda x: x["__e"]).alias("entries")).orderBy(*keys, "word")


def first_and_rest(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A3: the first value of every key, and the remaining ones in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"])
    return rows.groupBy(*keys).agg(listed.alias("__l")).select(*keys, F.get("__l", F.lit(0)).alias("first"), F.slice("__l", 2, 1_000_000_000).alias("rest"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def last_value(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of every key's last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def carried(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-null value of earlier rows."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(earlier))


def slices(rows: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Running start and end of stretches that follow each other."""
    line = Window.partitionBy(*keys).orderBy(order)
    ended = rows.withColumn("stop", F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return ended.withColumn("start", F.col("stop") - F.col(size)).withColumn("next_start", F.lead("start").over(line))

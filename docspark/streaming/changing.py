"""Back-links and keywords of archives that are replaced while a stream runs.

An archive is known by its name, the last part of its path; a later file of that name (greater modification time, then
path) replaces it. Spark's file source takes a path once, so versions come below folders of their own (``in/*/a.hlp``).

Two queries, both started again from their checkpoints. ``decode_arrivals`` writes the entries (links and keywords) of every
archive that arrives. ``follow`` keeps the entries of each archive's newest version as keyed state and emits changes: +1 for an
entry that comes, -1 for one that goes. An archive's entries are dealt over ``parts`` keys, so that a large one is not one
task's; every part is told each version, also those that have none of its entries. The held entries are a map in the state store and are not
loaded whole. The tables that users read (``backlinks``, ``keywords``) are sums of changes.

Defined cases: versions that arrive late, after a newer one, change nothing; an entry that is delivered again (a batch run twice) is one;
several versions in a batch leave the newest; an archive that cannot be read has no entries, so its old ones go; a file that is
deleted is not seen by Spark's source and stays; entries are counted as they are in the archive, repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docspark.plans import help_file
from docspark.sources import help_source
from docspark.streaming.watch import FILES

PARTS = 32
_ENTRIES = "name string, part int, version string, place string, kind string, key string, entry string"
_CHANGES = "name string, kind string, key string, entry string, change int"


def named(files: DataFrame) -> DataFrame:
    """``(path, name, version)`` of ``files``."""
    version = F.concat(F.lpad(F.unix_micros("modificationTime").cast("string"), 20, "0"), F.lit(" "), "path")
    return files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), version.alias("version"))


def entries(archives: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every link and keyword of ``archives(path, modificationTime, content)``, and a row without a place for each part."""
    found = help_source.tables(archives.select("path", "content"), names=("context", "records", "blocks", "raw_keywords"))
    links = help_file.links(help_file.bodies(found["records"], found["blocks"]))
    place = F.concat_ws(":", F.lit("link"), "rec_no", "block_no", "run_no")
    linked = links.select("file", place.alias("place"), F.lit("link").alias("kind"), F.col("target").alias("key"), F.col("topic_no").cast("string").alias("entry"))
    words = found["raw_keywords"].where("_error is null").select("file", "ord", "keyword", F.posexplode("topic_offsets").alias("i", "offset"))
    worded = words.select("file", F.concat_ws(":", F.lit("keyword"), "ord", "i").alias("place"), F.lit("keyword").alias("kind"), F.col("keyword").alias("key"), F.col("offset").cast("string").alias("entry"))
    own = named(archives)
    held = own.join(linked.unionByName(worded), own["path"] == F.col("file")).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    told = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    columns = ("name", "part", "version", "place", "kind", "key", "entry")
    return held.select(*columns).unionByName(told.select("name", "part", "version"), allowMissingColumns=True)


def decode_arrivals(spark: SparkSession, folder: str, store: str, parts: int = PARTS) -> StreamingQuery:
    """Write the entries of all archives that are new below ``folder`` since the last call."""

    def decoded(batch: DataFrame, number: int) -> None:
        # a batch that is run again adds its entries again, which follow() takes as the same
        entries(batch, parts).write.mode("append").parquet(f"{store}/entries/{number}")

    # one empty file, so that both queries and the tables work before anything has arrived
    spark.createDataFrame([], _ENTRIES).write.mode("ignore").parquet(f"{store}/entries/start")
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{hlp,HLP}").load(folder)
    return files.writeStream.foreachBatch(decoded).option("checkpointLocation", f"{store}/decoded").trigger(availableNow=True).start()


class _Newest(StatefulProcessor):
    """One part of one archive: the entries of its newest version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version string")
        self.held = handle.getMapState("held", "place string", "kind string, key string, entry string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        name = key[0]
        newest = self.version.get()[0] if self.version.exists() else ""
        for row in rows:
            if row["version"] < newest:
                continue
            if row["version"] > newest:
                newest = row["version"]
                self.version.update((newest,))
                for kind, word, entry in self.held.values():
                    yield Row(name=name, kind=kind, key=word, entry=entry, change=-1)
                self.held.clear()
            place = row["place"]
            if place is not None and not self.held.containsKey((place,)):
                self.held.updateValue((place,), (row["kind"], row["key"], row["entry"]))
                yield Row(name=name, kind=row["kind"], key=row["key"], entry=row["entry"], change=1)

    def close(self) -> None:
        pass


def follow(spark: SparkSession, store: str) -> StreamingQuery:
    """Turn the entries that are new in ``store`` into changes; needs the RocksDB state store."""
    rows = spark.readStream.schema(_ENTRIES).parquet(f"{store}/entries/*")
    changes = rows.groupBy("name", "part").transformWithState(_Newest(), _CHANGES, "append", "none")
    return changes.writeStream.format("parquet").option("checkpointLocation", f"{store}/followed").option("path", f"{store}/changes").trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """``(name, key, entry, n)``: the entries of the newest versions."""
    changes = spark.read.schema(_CHANGES).parquet(f"{store}/changes").where(F.col("kind") == kind)
    return changes.groupBy("name", "key", "entry").agg(F.sum("change").alias("n")).where("n > 0")


def backlinks(spark: SparkSession, store: str) -> DataFrame:
    """``(name, target, n_links, n_topics)``, as :func:`docspark.plans.help_file.backlinks` of the newest versions."""
    found = current(spark, store, "link").withColumnRenamed("key", "target")
    return found.groupBy("name", "target").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_topics"))


def keywords(spark: SparkSession, store: str) -> DataFrame:
    """``(name, keyword, n_offsets)`` of the newest versions."""
    return current(spark, store, "keyword").groupBy("name", F.col("key").alias("keyword")).agg(F.sum("n").alias("n_offsets"))

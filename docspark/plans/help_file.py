"""From decoded tables to topics, links, keywords and pictures (the reading pipeline)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.numbers import crosses_block
from docspark.functions.text import context_name, id_or_default, title_or_default
from docspark.operators import relational
from docspark.sources import help_source
from docspark.sources.container import TABLE, TEXT, TOPIC


def context_names(context: DataFrame) -> DataFrame:
    """A2: ``(file, hash, topic_offset, name)``, the last entry of a hash."""
    last = relational.last_value(context.where("_error is null"), ["file", "hash"], "topic_offset", ["ord"])
    return last.withColumn("name", context_name(F.col("hash")))


def located(records: DataFrame) -> DataFrame:
    """Records with the running topic offset before each of them."""
    base = F.when(~F.col("before_31") & crosses_block(F.col("next_block"), F.col("stream_offset")), F.floor((F.col("next_block") - 12) / 16384).cast("long") * 32768)
    counted = F.when(F.col("record_type").isin(TEXT, TABLE), F.col("delta").cast("long")).otherwise(F.lit(0).cast("long"))
    return relational.running_offset(records.where("_error is null").withColumn("base", base).withColumn("counted", counted), ["file"], "rec_no", "counted", "base")


def headed(records: DataFrame, context: DataFrame) -> DataFrame:
    """The topic record ``(file, rec_no)`` of every context entry ``(topic_offset, hash, name)``."""
    heads = located(records).where(F.col("record_type") == TOPIC)
    return relational.forward_asof(context_names(context), heads.select("file", "rec_no", "run"), ["file"], "topic_offset", "run", "rec_no")


def dump(records: DataFrame, context: DataFrame | None = None, hashes: DataFrame | None = None, limit: int = 40) -> DataFrame:
    """S25, FL8, L6: records as hexadecimal: those of the topics that ``hashes(hash)`` name, or the first ``limit`` of all."""
    shown = records.where("_error is null").select("file", "rec_no", "record_type", F.hex("link_data1").alias("link_data1"), F.hex("link_data2").alias("link_data2"))
    if hashes is None:
        return shown.orderBy("file", "rec_no").limit(limit)
    wanted = headed(records, context).join(hashes.select("hash").distinct(), "hash").select("file", F.col("rec_no").alias("head_no"), "hash")
    numbered = relational.carried(records.where("_error is null").withColumn("__own", F.when(F.col("record_type") == TOPIC, F.col("rec_no"))), ["file"], "rec_no", "__own", "__before")
    spans = numbered.select("file", "rec_no", F.coalesce("__own", "__before").alias("head_no"))
    return shown.join(spans, ["file", "rec_no"]).join(wanted, ["file", "head_no"]).drop("head_no")


def topics(records: DataFrame, context: DataFrame) -> DataFrame:
    """``(file, topic_no, id, aliases, title, keywords, browse_seq)`` in chain order.

    Ties of context offsets go by hash.
    """
    heads = located(records).where(F.col("record_type") == TOPIC)
    named = relational.first_and_rest(headed(records, context), ["file", "rec_no"], ["topic_offset", "hash"], "name")
    ordinal = relational.spans(heads.select("file", F.col("rec_no").cast("long").alias("rec_no"), "title"), ["file"], "rec_no", F.lit(True), "topic_no")
    joined = ordinal.join(named, ["file", "rec_no"], "left")
    nothing = F.array().cast("array<string>")
    return joined.select("file", "topic_no", "rec_no", id_or_default(F.col("first")).alias("id"), F.coalesce("rest", nothing).alias("aliases"), title_or_default(F.col("title")).alias("title"), nothing.alias("keywords"), F.lit(None).cast("int").alias("browse_seq"))


def bodies(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with the topic they belong to; records before the first topic go."""
    heads = relational.spans(records.where("_error is null").select("file", "rec_no", "record_type"), ["file"], "rec_no", F.col("record_type") == TOPIC, "topic_no")
    return blocks.where("_error is null").join(heads.select("file", "rec_no", "topic_no"), ["file", "rec_no"]).drop("_error")


def links(body: DataFrame) -> DataFrame:
    """Every link of every topic."""
    runs = body.select("file", "topic_no", "rec_no", "block_no", F.posexplode("inlines").alias("run_no", "r")).where("r.kind = 'link'")
    return runs.select("file", "topic_no", "rec_no", "block_no", "run_no", F.col("r.text").alias("text"), F.col("r.target").alias("target"), F.col("r.link_kind").alias("link_kind"))


def backlinks(link: DataFrame) -> DataFrame:
    """How many links lead to each target."""
    return link.groupBy("file", "target").agg(F.count("*").alias("n_links"), F.count_distinct("topic_no").alias("n_topics"))


def dangling(link: DataFrame, topic: DataFrame) -> DataFrame:
    """Links whose target is no topic's identifier or alias."""
    known = topic.select("file", F.explode(F.concat(F.array("id"), "aliases")).alias("target"))
    return link.join(known, ["file", "target"], "left_anti")


def keyword_index(topic: DataFrame) -> DataFrame:
    """A1: ``(file, keyword, topic_ids)``."""
    found = relational.inverted_index(topic, ["file"], "keywords", ["topic_no"], "id")
    return found.select("file", F.col("word").alias("keyword"), F.col("entries").alias("topic_ids"))


def images(body: DataFrame, pictures: DataFrame) -> DataFrame:
    """Pictures that some topic shows, by the first reference."""
    order = ["topic_no", "rec_no", "block_no"]
    shown = relational.first_rows(body.where("kind = 'image'").select("file", F.col("image").alias("filename"), *order), ["file", "filename"], order)
    return pictures.where("_error is null").join(shown.select("file", "filename"), ["file", "filename"], "left_semi").drop("_error")


def summary(system: DataFrame, topic: DataFrame) -> DataFrame:
    """Title, copyright and root topic of every archive."""
    first = topic.groupBy("file").agg(F.min_by("id", "topic_no").alias("first"))
    joined = system.where("_error is null").join(first, "file", "left")
    return joined.select("file", title_or_default(F.col("title")).alias("title"), "copyright", F.coalesce("starting_topic", "first", F.lit("")).alias("root_topic"))


@dataclass
class HelpFiles:
    """The assembled tables of some archives."""

    summary: DataFrame
    topics: DataFrame
    bodies: DataFrame
    links: DataFrame
    keyword_index: DataFrame
    images: DataFrame
    errors: DataFrame


def errors(tables: dict[str, DataFrame]) -> DataFrame:
    """``(file, part, message)`` of everything that could not be read, from the same pass as the tables."""
    every = None
    for part, table in tables.items():
        own = table.where("_error is not null").select("file", F.lit(part).alias("part"), F.col("_error").alias("message"))
        every = own if every is None else every.unionByName(own)
    return every


def assemble(archives: DataFrame, format_version: str | None = None, mode: str = "PERMISSIVE") -> HelpFiles:
    """All tables of ``archives(path, content)``, each archive decoded once."""
    t = help_source.tables(archives, format_version, mode, ("system", "context", "records", "blocks", "images"))
    topic, body = topics(t["records"], t["context"]), bodies(t["records"], t["blocks"])
    return HelpFiles(summary(t["system"], topic), topic, body, links(body), keyword_index(topic), images(body, t["images"]), errors(t))


def register(found: HelpFiles, prefix: str = "help_") -> None:
    """Temporary views for SQL."""
    for name, df in vars(found).items():
        df.createOrReplaceTempView(f"{prefix}{name}")

"""The corpus pipeline: language ID, near-dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All stages but the last keep the columns of documents.

Defined cases of every stage: an empty table gives none; a null ``text`` has no language (its row goes in
the first stage; a later stage given one keeps it, as the empty text to near-dedup and packing, and null
to redaction); nulls in all other columns change nothing, but that near-dedup prefers rows with an
identifier; texts are read whole, of any length; repeated rows are one to near-dedup and as many rows
to the other stages; further columns stay until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import jaccard, language_id, packing, pii
from docspark.llm.arrow import small_batches
from docspark.llm.queries import vocabulary_there
from docspark.storage import Workspace

REMEMBERED = 50_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without any letter, or far from every profile, go.

    Equal distances go to the language that sorts first; where nothing can be learned, all rows go.
    """
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs), min_score=0.05)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    SimHash finds the closest copies; the links that its distance of 2 bits cannot see are found exactly by prefixes.
    The document of the least identifier stays.
    """
    small_batches(spark)
    return jaccard.keep_one(docs)


def anonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind; overlapping finds are one, of the first's kind."""
    small_batches(spark)
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a text without tokens is its end token.

    Workers remember fewer chunks than by default: they stand beside the heap that near-dedup has left, and keep their size.
    """
    small_batches(spark)
    return packing.best_fit(docs, vocabulary_there("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("language ID", identify), ("SimHash near-dedup", deduplicate), ("PII", anonymise), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        following = work.table(stage(spark, docs, sf_dir), f"stage{number}")
        work.drop(docs)
        docs = following
    return docs


QUERIES = {"pipeline": run}
#: SQL cannot express profiles, fingerprints, contexts and packing; tests compare with brute force.
ORACLE_SQL: str | None = None
ORACLE: dict[str, str] = {}

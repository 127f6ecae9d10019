"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import ann, conversation, html_extract, jpeg, language_id, lexical, order_minhash, packing, pii, simhash, url_filter, warc, wfst


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer file, where its package is installed here."""
    return str(public_tokenizers.path(name))


def vocabulary_there(name: str) -> Callable[[], str]:
    """The same, found by each worker where it runs."""
    return partial(public_tokenizers.path, name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: every document encoded by the byte-pair model and decoded again."""
    return wfst.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_there("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: the language of every document, learned from the training fold."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.detect(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: every text stored as a JPEG's samples and read back, with its thumbnail's hash."""
    return jpeg.store_texts(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: every page's verdict by rules and by its aliases."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.filter_urls(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: every page's main text by the winning container paths of its host."""
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: all documents in sequences of at most 4096 tokens."""
    return packing.best_fit(_table(spark, sf_dir, "documents"), vocabulary_there("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: every document's fingerprint and group of near duplicates."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: every page written into WARC archives and read back."""
    found = warc.read(spark, warc.archive(_table(spark, sf_dir, "pages")))
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?[0-9]+)$", 1)
    page = lambda name: F.when(number(name) != "", number(name).cast("long"))
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return found.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: the ten nearest neighbours of every row whose identifier is divisible by 100."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: personal data in every document, by base patterns and trusted contexts."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: every document's fingerprint, that of its edited text, and their likeness."""
    found = order_minhash.compare_edited(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.fingerprint(own).alias("fingerprint"), order_minhash.fingerprint(edited).alias("edited_fingerprint"),
        order_minhash.likeness(own, edited).alias("near_edited"), order_minhash.likeness(own, following).alias("near_next"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the ten best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: every damaged conversation's cheapest repair."""
    return conversation.digests(conversation.repair(conversation.damage(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_media_columns": op3_media_columns,
    "op4_url_filters": op4_url_filters,
    "op5_html_extraction": op5_html_extraction,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_warc": op8_warc,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_pii": op10_pii,
    "op11_order_minhash": op11_order_minhash,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL for the operators that SQL can express.
ORACLE: dict[str, str] = {
    "op4_url_filters": url_filter.ORACLE,
    "op8_warc": warc.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
}

"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent letter n-grams (n = 1 to 3, words padded by one blank) of a
language in order of frequency. A document gets the language whose profile its own list is least
out of place with: the sum over its n-grams of the distance between the two ranks, or of the
profile's length where the language lacks the n-gram.

Fitting reads a bounded number of labelled documents per language (``docs_per_language``, in
expectation, chosen by a hash of the identifier), counts their n-grams in Spark and keeps
``profile_size`` n-grams a language, so what the driver holds is bounded by ``max_languages`` times
``profile_size``. Detection is one pass over the documents without a shuffle.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every text
when nothing could be learned. Equal distances go to the language that sorts first. Whole texts count, of any
length, a quarter of a million characters at a time. Repeated rows are told alike and, in fitting, count as
often as they come; an empty table gives no rows. Existing columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.arrow import extended, pieces, put
from docspark.llm.names import free

UNDETERMINED = "und"
_BLANK = 32
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Every n-gram of the text's words as a 63-bit key (21 bits a character), repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    c = np.concatenate(([_BLANK], codes[keep], [_BLANK])).astype(np.int64)
    inside = c != _BLANK
    one = c[inside]
    two = ((c[:-1] << 21) | c[1:])[inside[:-1] | inside[1:]]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside[1:-1]]
    return np.concatenate((one, two, three))


_BLOCK = 1 << 18


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut between words only, so that their n-grams add up."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts over all parts."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text in ascending order, and how often they come."""
    return added([np.unique(ngrams(x), return_counts=True) for x in blocks(text or "")])


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent of ascending keys, most frequent first, equal counts by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams per language: ``ranks[l, i]`` is the rank of ``grams[i]``, or ``size``."""

    languages: list[str]
    grams: np.ndarray = field(repr=False)
    ranks: np.ndarray = field(repr=False)
    size: int

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(k for k, v in lists.items() if v)
        grams = np.unique(np.concatenate([np.asarray(lists[x], np.int64) for x in languages])) if languages else np.empty(0, np.int64)
        ranks = np.full((len(languages), len(grams) + 1), size, np.int32)  # the last column: unknown n-grams
        for i, x in enumerate(languages):
            ranks[i, np.searchsorted(grams, lists[x])] = np.arange(len(lists[x]))
        return cls(languages, grams, ranks, size)

    def detect(self, text: str | None) -> tuple[str, float]:
        keys, counts = counted(text)
        if not len(keys) or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[:, at]
        places = np.where(ranks < self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)), self.size).sum(1)
        best = int(places.argmin())
        return self.languages[best], float(1.0 - places[best] / (self.size * len(own)))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the identifier's decimal text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(batches):
    for batch in pieces(batches, "text", 1 << 20):
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(counted(text))
        for lang, parts in by.items():
            keys, counts = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, profile_size: int = 400, docs_per_language: int = 2000, max_languages: int = 512) -> Profiles:
    """Profiles from ``docs(doc_id, text, lang)``; rows of the evaluation fold or with nulls teach nothing."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if that many profiles fit into memory")
    if not counted:
        return Profiles.of({}, profile_size)
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, docs_per_language / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where((draw < share[F.col("lang")]) & F.col("text").isNotNull()).select("lang", "text")
    totals = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    lists: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of(lists, profile_size)


def detect(docs: DataFrame, profiles: Profiles, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with a language and a score (1: every n-gram in the profile's place); only ``text`` is looked at."""

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            found = [profiles.detect(x) for x in batch.column("text").to_pylist()]
            yield put(batch, {lang_col: pa.array([x for x, _ in found], pa.string()), score_col: pa.array([s for _, s in found], pa.float64())})

    return docs.mapInArrow(run, extended(docs, {lang_col: "string", score_col: "double"}))


def keep_identified(docs: DataFrame, profiles: Profiles, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with a language of at least ``min_score``, in their own columns; ``und`` rows go."""
    lang, score = free(docs.columns, "lang_pred", "score")
    judged = detect(docs, profiles, lang, score)
    return judged.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)

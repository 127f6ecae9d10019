"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

A document is tokenised whole, gets an end token, and is cut only where it is longer than a
sequence. Each piece is placed where the sum over all gaps of (number of open sequences with that
gap) squared becomes smallest (Csirik et al., "On the Sum-of-Squares Algorithm for Bin Packing",
JACM 2006); the longest pieces go first, and equal sums prefer the smaller gap that remains.

On Spark, tokenising is one pass that writes (identifier, piece, length, checksum) only. Pieces are
dealt evenly over groups of about ``group_rows``, independent of any key, and packed group by group.
What a group packs to within ``slack`` tokens of full is final; the pieces of its looser sequences
are dealt again over as many fewer groups, with twice the slack each time, until they fit into one
group. No task ever holds more than about ``group_rows`` pieces.

Tokenising. ``word_bpe_49k`` drops white space before it splits words, so that a text's ids are the
concatenated ids of its white-space-separated chunks. Arrow cuts a batch's texts, finds its distinct chunks and parts
their words from marks; the tokenizer encodes the distinct ones (plain words by its model alone, many in a call: a token
that ends a word says so), and numpy gathers the ids of all documents. A worker remembers about
``remembered`` chunks, and two thirds as many words, between batches; that affects time and memory only.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as often as
they come; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.arrow import caches, pieces
from docspark.llm.chunks import Chunks, gather
from docspark.storage import Workspace

CAPACITY, END = 4096, 1
_ODD = "\x1c\x1d\x1e\x1f"  # white space to str.split, but not to Unicode
_WHITE = "[\t-\r \x85\xa0  -     　]+"
_REMEMBERED = 300_000
_loaded: dict[tuple[str, int], Chunks] = {}


def cut(texts: pa.Array) -> pa.Array:
    """The white-space-separated chunks of each text, by Unicode's white space; empty ones may be among them."""
    if pc.any(pc.match_substring_regex(texts, f"[{_ODD}]")).as_py():
        return pc.split_pattern_regex(texts, _WHITE)
    return pc.utf8_split_whitespace(texts)


def _strings(column: pa.Array) -> list[str]:
    """``to_pylist`` of a column without nulls, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Words:
    """Ids of chunks. Latin words go to the tokenizer's model at once, as its normaliser and pre-tokenizer would hand them over."""

    # Latin letters only, whose lower case is one letter again (so not U+0130), and ASCII marks behind them;
    # not the apostrophe of contractions and not "<" of special tokens
    plain = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[!-&(-/:;=-@[-`{-~]*)$"

    def __init__(self, tokenizer, limit: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = tokenizer, limit
        self.bare = Tokenizer(tokenizer.model)  # takes words that are mapped already, with a space between
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for token, at in tokenizer.get_vocab().items():
            self.last[at] = token.endswith("</w>")
        self._forget()
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.alphabet = letters | {ord(" "): " "}  # which stands between words

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids))

    def _words(self, words: list[str]) -> None:
        found = []
        for i in range(0, len(words), 256):
            joined = " ".join(words[i : i + 256])
            mapped = joined if joined.isascii() else joined.encode().decode("latin-1").translate(self.alphabet)
            found.append(np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(found)
        counts = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(counts) != len(words):
            raise ValueError("the tokenizer's model does not end each word with a token of its own")
        self._add(words, ids, counts)

    def _others(self, others: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self._add(others, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)

    def _numbers(self, texts: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        of = texts.dictionary_encode()
        names = _strings(of.dictionary)
        new = [x for x in names if x not in self.known]
        if new:
            learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return numbers[of.indices.to_numpy()]

    def __call__(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks behind each other, and where each chunk's end."""
        if len(self.known) > self.limit:
            self._forget()
        parts = pc.extract_regex(new, self.plain)
        other = parts.is_null()
        parts, at = parts.drop_null(), other.to_numpy(zero_copy_only=False)
        numbers = np.zeros((len(new), 2), np.int64)  # word and marks
        numbers[~at, 0] = self._numbers(pc.utf8_lower(parts.field("word")), self._words)
        numbers[~at, 1] = self._numbers(parts.field("marks"), self._words)
        numbers[at, 0] = self._numbers(new.filter(other), self._others)
        ids, ends = gather(self.ids, self.starts, numbers.ravel())
        return ids, ends[1::2]


class _Texts(Chunks):
    """Chunks of a column: Arrow cuts the texts and finds a batch's distinct chunks, numpy gathers the ids."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > self.limit:
            self._forget()
        split = self.split(texts)
        of = split.flatten().dictionary_encode()
        names, known = _strings(of.dictionary), len(self.at)
        numbers = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            ids, ends = self.encode_new(of.dictionary.take(pa.array(new)))
            numbers[new] = range(known, known + len(new))
            self.at.update(zip([names[i] for i in new.tolist()], range(known, known + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + ends))
            self.ids = np.concatenate((self.ids, ids))
        ids, ends = gather(self.ids, self.starts, numbers[of.indices.to_numpy()])
        upto = np.concatenate(([0], ends))[np.cumsum([0, *pc.list_value_length(split).to_pylist()])]
        return ids, np.diff(upto)


def chunks(path: str | Callable[[], str], remembered: int = _REMEMBERED) -> Chunks:
    """The tokenizer, loaded once a worker; a function gives the path where it is called."""
    key = path() if callable(path) else path, remembered
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[key] = _Texts(cut, _Words(Tokenizer.from_file(key[0]), remembered * 2 // 3), remembered)
    return _loaded[key]


def document_ids(texts: list[str | None] | pa.Array, tokenizer: Chunks) -> Iterator[np.ndarray]:
    """Every document's ids with the end token."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    ids, counts = tokenizer.encode(column.fill_null(""))
    at = 0
    for n in counts.tolist():
        yield np.append(ids[at : at + n], np.uint32(END))
        at += n


def tokenise(docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY, with_ids: bool = False, remembered: int = _REMEMBERED) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of ``docs(doc_id, text)``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20, "packing"):
            tokenizer = chunks(path, remembered)
            caches["packing"] = _loaded.clear
            rows, of, held = [], [], []
            for row, ids in enumerate(document_ids(batch.column("text"), tokenizer)):
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                    of.append(row)
                    if with_ids:
                        held.append(part)
            k, start, n, crc = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
            extra = [pa.array(held, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), k, start, n, crc, *extra], names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sum-of-squares packing: each length's bin and offset, and every bin's remaining gap."""
    open_with = np.zeros(capacity + 1, np.int64)  # the number of open bins by gap
    squares = np.empty(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    chosen, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # the change of the sum when a bin of gap g comes to gap g - s; full bins count for nothing
        n = capacity + 1 - s
        change = squares[:n]
        np.subtract(open_with[:n], open_with[s:], out=change)
        change *= 2
        change += 2
        change[0] = 1 - 2 * open_with[s]
        change[open_with[s:] == 0] = 1 << 60
        change[n - 1] = 2 * open_with[capacity - s] + 1 if s < capacity else 0  # a new bin
        gap = int(change.argmin()) + s
        if gap == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = bins[gap].pop()
            open_with[gap] -= 1
        chosen[i], offset[i] = b, capacity - gap
        gaps[b] = gap - s
        if gap > s:
            bins[gap - s].append(b)
            open_with[gap - s] += 1
    return chosen, offset, gaps


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean"


def _packer(capacity: int, slack: int, base: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        at, offset, gaps = place(group["length"].to_numpy(), capacity)
        out = group.drop(columns="__group")
        out["sequence_id"] = at + ((base + int(group["__group"].iloc[0])) << 32)
        out["offset"], out["final"] = offset, np.asarray(gaps)[at] <= slack
        return out

    return run


def pack(parts: DataFrame, work: Workspace, capacity: int = CAPACITY, group_rows: int = 50_000, slack: int = 8) -> DataFrame:
    """``parts`` (a written table, so that its rows stay where they are) with ``sequence_id`` and ``offset``."""
    columns, rest, done, base = list(parts.columns), parts, [], 0
    while True:
        n = rest.count()
        n_groups = max(1, -(-n // group_rows))
        deal = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n_groups))
        packer = _packer(capacity, slack if n_groups > 1 else capacity, base)
        packed = work.table(rest.withColumn("__group", deal).groupBy("__group").applyInPandas(packer, _PLACED), "packed")
        done.append(packed.where("final"))
        if n_groups == 1:
            break
        base, slack = base + n_groups, 2 * slack
        rest = packed.where("not final").select(*columns)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("final")


def best_fit(docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY, remembered: int = _REMEMBERED, **options) -> DataFrame:
    """The packed pieces of ``docs``."""
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.table(tokenise(docs, path, capacity, remembered=remembered), "pieces"), work, capacity, **options)


def sequences(docs: DataFrame, packed: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, doc_ids, ids)``; ``doc_id`` must be a key of ``docs``."""
    joined = tokenise(docs, path, capacity, with_ids=True).select("doc_id", "piece", "ids").join(packed, ["doc_id", "piece"])
    held = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return held.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))

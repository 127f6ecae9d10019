"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

Three machines are compiled from a model file into arc tables and composed with every input on the fly:

* the normaliser rewrites characters by longest match (the model's compiled character map, or given rules), removes extra
  blanks if the model does, and writes the dummy prefix and the escaped blanks;
* the pieces are a tree of characters from and to one state, which writes a piece's id at its last character;
* byte fallback reads a character that no piece covers and writes its UTF-8 bytes' ids.

The encoding is the path of least total weight in the tropical semiring. For a unigram model a piece weighs
minus its score, a fallback more than any piece; arcs are relaxed position by position. A byte-pair model ranks
merges and not segmentations, so its scores cannot be added up: the least-weight path by them is *not* its
encoding. Its pieces remember the last piece, and the arc to the next piece weighs zero where merging the
characters of both leaves exactly this pair, and infinitely much otherwise. A sequence is the merge result of its
characters if and only if all neighbours fit in this way, so that one path of finite weight is left. With
all finite weights equal, the shortest-path queue may be a stack, and the search goes depth first, longer
pieces first. An arc's weight is computed when it is first met and kept.

What runs where: ``op1_sentencepiece`` encodes by the public byte-pair model, so its path is found by that depth-first search over arcs of weight
zero or infinity; weights are added up and relaxed in order (the tropical search) for unigram models only. The normaliser's table is applied to the
text before the search, not composed state by state.

Words (runs that start with blanks) never share a piece, so a batch's distinct words are encoded
once (:mod:`docspark.llm.chunks`). Nothing is shuffled.

Defined cases: null and empty texts have no ids and decode to the empty text; decoding gives the normalised text
back but for a literal U+2581, which becomes a blank; texts may be of any length; of equal unigram weights the
path with the shorter last piece is taken; repeated rows are encoded as often as they come; an empty table gives
no rows; only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.arrow import caches, pieces
from docspark.llm.chunks import Chunks

BLANK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _USER = 1, 4


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of UTF-8 keys, and the texts that its values point to."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    rules: dict[str, str] = {}

    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        below = at ^ children(units[at])
        if units[at] >> 8 & 1:  # a key ends here
            start = units[below] & 0x7FFFFFFF
            rules[key.decode()] = texts[start : texts.index(0, start)].decode()
        for c in range(1, 256):
            if below ^ c < len(units) and units[below ^ c] & 0x800000FF == c:
                todo.append((below ^ c, key + bytes([c])))
    return rules


class Model:
    """A SentencePiece model's machines."""

    def __init__(self, entries: list[tuple[str, float, int]], kind: int, *, byte_fallback: bool = True, dummy_prefix: bool = True, rules: dict[str, str] | None = None, one_blank: bool = False):
        self.names = [x for x, _, _ in entries]
        self.kind = kind
        self.dummy_prefix = dummy_prefix
        self.one_blank = one_blank
        self._compile_rules(rules or {})
        self.ids = {x: i for i, (x, _, type_) in enumerate(entries) if type_ in (_NORMAL, _USER)}
        self.scores = [s for _, s, _ in entries]
        self.byte_ids = [self.names.index(f"<0x{b:02X}>") for b in range(256)] if byte_fallback else None
        self.unknown = next((i for i, x in enumerate(entries) if x[2] == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.costs = [-s for s in self.scores]
        self.fallback_cost = max((self.costs[i] for i in self.ids.values()), default=0.0) + 10.0
        if kind == BPE:  # pieces that merging never makes are on no path
            self.ids = {x: i for x, i in self.ids.items() if self.merge(x) == [x]}
        self._fits: dict[int, bool] = {}
        self._compile()
        many = [x for x, (_, _, type_) in zip(self.names, entries, strict=True) if type_ in (_NORMAL, _USER) and len(x) > 1]
        #: whether blanks stand at the start of pieces only, so that words are independent
        self.by_words = not any(BLANK in x.lstrip(BLANK) for x in many)
        joined = "".join(map(re.escape, sorted({c for x in many for c in x} - {BLANK})))
        self._words = re.compile(f"{BLANK}+[{joined}]*|[{joined}]+|[^{BLANK}{joined}]+" if joined else f"{BLANK}+|[^{BLANK}]+")
        self._bytes = [self._written(i, entries[i][2]) for i in range(len(entries))]
        self.chunks = Chunks(self.split, lambda new: [self.path(x) for x in new], 150_000)

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type not in (UNIGRAM, BPE) or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("models of whole words or characters, and with blanks that are not escaped or stand behind words, are not supported")
        entries = [(p.piece, p.score, p.type) for p in proto.pieces]
        rules = character_map(norm.precompiled_charsmap)
        return cls(entries, trainer.model_type, byte_fallback=trainer.byte_fallback, dummy_prefix=norm.add_dummy_prefix, rules=rules, one_blank=norm.remove_extra_whitespaces)

    # the normaliser

    def _compile_rules(self, rules: dict[str, str]) -> None:
        self._rules: dict = {}
        for read, written in rules.items():
            node = self._rules
            for c in read:
                node = node.setdefault(c, {})
            node[""] = written
        self._first = re.compile("[" + "".join(map(re.escape, sorted({x[0] for x in rules if x}))) + "]") if any(rules) else None

    def _rewritten(self, text: str) -> str:
        """Every longest match of the rules' tree replaced, from left to right."""
        if self._first is None:
            return text
        out, at = [], 0
        while (m := self._first.search(text, at)) is not None:
            out.append(text[at : m.start()])
            node, k, written, at = self._rules, m.start(), text[m.start()], m.start() + 1
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    written, at = node[""], k
            out.append(written)
        return "".join(out) + text[at:]

    def normalise(self, text: str) -> str:
        """The normaliser's output; no dummy prefix for the empty text."""
        out = self._rewritten(text)
        if self.one_blank:
            out = " ".join([x for x in out.split(" ") if x])
        out = out.replace(" ", BLANK)
        out = BLANK + out if out and self.dummy_prefix else out
        return out.rstrip(BLANK) if self.one_blank else out

    def split(self, text: str) -> list[str]:
        """The normalised text in independent words."""
        whole = self.normalise(text)
        return self._words.findall(whole) if self.by_words else [whole] * bool(whole)

    # pieces and fallback

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of the characters: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -at, at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None), default=None)
            if best is None:
                break
            at = best[2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves this pair of pieces (or of uncovered characters, as -1 - code point)."""
        pair = [self.names[x] if x >= 0 else chr(-1 - x) for x in (before, piece)]
        return self.merge("".join(pair)) == pair

    def _compile(self) -> None:
        """The pieces' trie, and every piece's length and longest shorter piece that starts alike."""
        self._trie: dict = {}
        self._length, self._shorter = [0] * len(self.names), [None] * len(self.names)
        for piece, i in self.ids.items():
            node = self._trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
            self._length[i] = len(piece)
            heads = (self.ids.get(piece[:n]) for n in range(len(piece) - 1, 0, -1))
            self._shorter[i] = next((x for x in heads if x is not None), -1 - ord(piece[0]) if len(piece) > 1 else None)

    def _merged(self, word: str) -> list[int]:
        """The path of finite weight, depth first with longer pieces first.

        The last piece of a merged prefix is unique, so a position that led nowhere is a dead end for all.
        """
        known, length, shorter, trie, n = self._fits, self._length, self._shorter, self._trie, len(word)
        if len(known) > 1_000_000:
            known.clear()
        dead: set[int] = set()
        out: list[int] = []
        at, last, fresh = 0, None, True
        while at < n:
            if fresh:  # the longest piece from here on
                i, node, k = -1 - ord(word[at]), trie, at
                while k < n and (node := node.get(word[k])) is not None:
                    k += 1
                    i = node.get("", i)
            while i is not None:
                end = at + (length[i] if i >= 0 else 1)
                if end not in dead:
                    if last is None:
                        break
                    key = last << 22 ^ i
                    fit = known.get(key)
                    if fit is None:
                        fit = known[key] = self.fits(last, i)
                    if fit:
                        break
                i = shorter[i] if i >= 0 else None
            fresh = i is not None
            if fresh:
                out.append(i)
                at, last = end, i
            else:
                dead.add(at)
                i = out.pop()
                at -= length[i] if i >= 0 else 1
                i, last = shorter[i] if i >= 0 else None, out[-1] if out else None
        return out

    def _lightest(self, word: str) -> list[int]:
        """The path of least total weight: the arcs from every position are relaxed in turn."""
        trie, costs, n = self._trie, self.costs, len(word)
        weight, step = [0.0] + [float("inf")] * n, [(0, 0)] * (n + 1)
        for start in range(n):
            arcs = [(start + 1, -1 - ord(word[start]), self.fallback_cost)]
            node, k = trie, start
            while k < n and (node := node.get(word[k])) is not None:
                k += 1
                if "" in node:
                    if k == start + 1:  # a character that a piece covers needs no fallback
                        arcs.clear()
                    arcs.append((k, node[""], costs[node[""]]))
            for end, i, cost in arcs:
                if weight[start] + cost < weight[end]:
                    weight[end], step[end] = weight[start] + cost, (start, i)
        out, at = [], n
        while at:
            at, i = step[at]
            out.append(i)
        return out[::-1]

    def path(self, word: str) -> list[int]:
        """The ids on the shortest path of the composition with ``word``."""
        found = self._merged(word) if self.kind == BPE else self._lightest(word)
        if min(found, default=0) >= 0:
            return found
        if self.byte_ids is None:
            return [i if i >= 0 else self.unknown for i in found]
        out: list[int] = []
        for i in found:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.chunks.encode([text or ""])[0].tolist()

    # decoding: the inverted machines, whose only path spells the pieces

    def _written(self, i: int, type_: int) -> bytes:
        if type_ == 6:
            return bytes([int(self.names[i][3:5], 16)])
        if type_ == 3:
            return b""
        return (" ⁇ " if type_ == 2 else self.names[i].replace(BLANK, " ")).encode()

    def decode(self, ids) -> str:
        """The text of the ids, without the dummy prefix."""
        written = self._bytes
        text = b"".join([written[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    """The model, compiled once a worker."""
    return Model.load(path)


CODED = "doc_id long, n_ids long, n_fallback long, ids_crc32 long, decoded_sha256 string, same boolean"


def encode_documents(docs: DataFrame, path: str | Callable[[], str], with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs(doc_id, text)``: counts, checksums[, ``ids``, ``decoded``].

    ``path`` is the model's path, or a function that each worker calls for it.
    """
    names = [x.split()[0] for x in CODED.split(", ")] + ["ids", "decoded"] * with_ids
    sub = 1 << 20

    def run(batches):
        for batch in pieces(batches, "text", sub, "wfst"):
            m = model(path() if callable(path) else path)
            caches["wfst"] = model.cache_clear
            is_byte = np.zeros(len(m.names), bool)
            is_byte[m.byte_ids or []] = True
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, counts = m.chunks.encode(texts)
            ends = np.cumsum(counts)
            rows, held = [], []
            for text, a, b in zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True):
                own = ids[a:b]
                back = m.decode(own.tolist())
                rows.append((b - a, int(is_byte[own].sum()), zlib.crc32(own.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                if with_ids:
                    held.append((own, back))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            extra = [pa.array([x for x, _ in held], pa.list_(pa.int64())), pa.array([x for _, x in held], pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *extra], names)

    schema = CODED + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

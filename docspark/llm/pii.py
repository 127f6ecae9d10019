"""Personal data by base patterns and bootstrapped contextual extraction.

Base. E-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers are found by
fixed patterns, leftmost and without overlap per kind.

Bootstrapping (after Riloff and Jones, "Learning Dictionaries for Information Extraction by Multi-Level
Bootstrapping", AAAI 1999). Base finds are the seed instances. Every mention of an instance induces lexical
patterns of the words beside it, digits generalised: the last word before it, the last two, the word on each
side, and the two behind it. Identifier-like strings that no base pattern matches (groups of 6 to 19 digits;
addresses with "at" and "dot" spelled out) are further instances, of yet unknown kind. Over the
bipartite graph of patterns and instances Spark alternates

* pattern confidence in a kind: the lower end of Wilson's 99 % interval of the share that the kind has in the
  believed instances of the pattern, so that instances of other kinds count against it, few instances give little
  confidence, and instances of which nothing is known yet do not count;
* instance belief in a kind: 1 for seeds, else ``1 - product(1 - confidence)`` over its trusted patterns.

A pattern is trusted, from then on, with ``least_confidence``, if at least ``least_share`` of all its distinct
instances are believed: a word that any number may follow says nothing (one in ten random numbers passes as a
card). Rounds go on until no pattern is added. In the end every unknown mention with a trusted pattern becomes a span of that pattern's kind, if it is
of a form that the kind allows; base spans always stay.

Texts are scanned once; the graph holds only mentions, distinct edges and distinct nodes, aggregated
before they are shuffled, and is written to the shared folder between rounds. Joins are salted, as one word may
stand beside a third of all mentions.

Defined cases: a null text is empty and has no spans; offsets count code points; texts, runs of one
character class and words may be of any length and take linear time; equal confidences go to the kind listed
first; repeated rows are repeated in the result; an empty table gives no rows; existing columns of added names
are replaced, further ones ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.arrow import extended, pieces, put
from docspark.llm.names import free
from docspark.llm.skew import salted_join
from docspark.storage import Workspace

KINDS = ("email", "ip", "card", "phone")

# The base patterns. An e-mail's part before "@" is found from the "@" backwards.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Identifier-like strings that may be personal data: digit groups, and spelled-out addresses.
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][0-9().\x20/-]*[0-9](?![\w])")
_AT = re.compile(r"[(\[{] ?at ?[)\]}]| at (?=[A-Za-z0-9-]+ dot )", re.I)
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]+(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]+)+", re.I)
_CONTEXT = re.compile(r"[^\W\d_]+|\d+|[:=#]")
_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The check-digit test of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    text = text or ""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-like strings outside ``taken``: ``(form, start, end)`` with form ``number`` or ``address``."""
    found = []
    for m in _NUMBER.finditer(text):
        if 6 <= len(_DIGIT.sub("", m[0])) <= 19:
            found.append(("number", *m.span()))
    done = 0
    for m in _AT.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        b = _AFTER_AT.match(text, m.end()) if start < stop else None
        if b:
            found.append(("address", start, b.end()))
            done = b.end()
    if not found:
        return found
    spans = sorted((a, b) for _, a, b in taken)
    out, i = [], 0
    for form, a, b in sorted(found, key=lambda x: x[1:]):
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if i == len(spans) or spans[i][0] >= b:
            out.append((form, a, b))
    return out


def _words(text: str, start: int, stop: int, step: int) -> list[str]:
    """The two words next to a mention, before (``step`` -1, nearest last) or behind it (1, nearest first), digits as 0."""
    size = 64
    while True:  # wider until both words are whole
        if step < 0:
            low = max(0, start - size)
            words, whole = _CONTEXT.findall(text[low:start]), low == 0
            near = words[-2:]
        else:
            words, whole = _CONTEXT.findall(text[stop : stop + size]), stop + size >= len(text)
            near = words[:2]
        if whole or len(words) > 2:
            return ["0" if x[0].isdecimal() else x.lower() for x in near]
        size *= 4


def contexts(text: str, start: int, stop: int) -> list[str]:
    """The patterns of a mention, which they write as ``_``."""
    left, right = _words(text, start, stop, -1), _words(text, start, stop, 1)
    out = []
    if left:
        out.append(f"{left[-1]} _")
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    return out


def encode_spans(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda x: (order[x[0]], x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SCAN = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "mentions array<struct<kind:string,instance:string,start:long,stop:long,patterns:array<string>>>"
)
_MENTION = pa.struct([("kind", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.string()))])


def _instance(form: str, text: str) -> str:
    return _DIGIT.sub("", text) if form in ("card", "phone", "number") else text.lower()


def scan(docs: DataFrame) -> DataFrame:
    """Base finds and mentions per row of ``docs(doc_id, text)``, with a hash of the text and without the text."""
    names = [x.split()[0] for x in _SCAN.split(", ")]

    def run(batches):
        for batch in pieces(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                said = encode_spans(base)
                listed = [(k, k, a, b) for k, a, b in base] + [(None, f, a, b) for f, a, b in candidates(text, base)]
                mentions = [{"kind": k, "instance": _instance(f, text[a:b]), "start": a, "stop": b, "patterns": contexts(text, a, b)} for k, f, a, b in listed]
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(said.encode()).hexdigest(), said, mentions))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(_MENTION)]
            made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", *names])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return chosen.mapInArrow(run, f"doc_id long, text_hash long, {_SCAN}")


def wilson(part: Column, whole: Column) -> Column:
    """The lower end of the 99 % interval of a share."""
    z = 2.576
    share = part / whole
    spread = F.sqrt(share * (1 - share) / whole + z * z / (4 * whole * whole))
    return F.when(whole > 0, (share + z * z / (2 * whole) - z * spread) / (1 + z * z / whole)).otherwise(0.0)


def scored(edges: DataFrame, heard: DataFrame) -> DataFrame:
    """``(pattern, kind, confidence, share)`` of every pattern in its best kind.

    ``edges(instance, pattern, seed kinds)`` has beliefs of seeds, ``heard(instance, kinds)`` of others.
    """
    others = heard.select("instance", *[F.col(k).alias(f"__{k}") for k in KINDS])
    joined = salted_join(edges, others, ["instance"], ["pattern"], "left")
    sums = joined.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(F.greatest(F.col(k), F.coalesce(f"__{k}", F.lit(0.0)))).alias(k) for k in KINDS])
    known = F.col(KINDS[0]) + F.col(KINDS[1]) + F.col(KINDS[2]) + F.col(KINDS[3])
    rounded = lambda x: F.round(x, 9)  # noqa: E731  sums of doubles depend on their order
    options = F.array(*[F.struct(rounded(wilson(F.col(k), known)).alias("confidence"), F.lit(-i).alias("order"), F.lit(k).alias("kind"), rounded(F.col(k) / F.col("n")).alias("share")) for i, k in enumerate(KINDS)])
    best = sums.select("pattern", F.array_max(options).alias("b"))
    return best.select("pattern", "b.kind", "b.confidence", "b.share")


def beliefs(edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(instance, kinds)``: what trusted patterns make believe of the instances that are no seeds."""
    lost = [F.sum(F.when(F.col("kind") == k, F.log1p(-F.col("confidence"))).otherwise(0.0)).alias(k) for k in KINDS]
    unknown = edges.where(" + ".join(KINDS) + " = 0").select("instance", "pattern")
    held = salted_join(unknown, trusted, ["pattern"], ["instance"]).groupBy("instance").agg(*lost)
    return held.select("instance", *[(1.0 - F.exp(k)).alias(k) for k in KINDS])


def graph(mentions: DataFrame, work: Workspace) -> DataFrame:
    """The distinct ``(instance, pattern)`` pairs with the seed kinds (0 or 1) of the instance."""
    pairs = work.table(mentions.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pairs")
    flags = [F.max(F.when(F.col("kind") == k, 1.0)).alias(k) for k in KINDS]
    seeds = mentions.where("kind is not null").groupBy("instance").agg(*flags)
    return work.table(salted_join(pairs, seeds, ["instance"], ["pattern"], "left").na.fill(0.0, list(KINDS)), "edges")


def bootstrap(edges: DataFrame, work: Workspace, least_confidence: float = 0.7, least_share: float = 0.2, most_rounds: int = 1000) -> DataFrame:
    """``(pattern, kind, confidence)`` of all patterns that come to be trusted; raises where there is no end."""
    # no rows made in Python: those come from Python workers of their own, which stay beside the others
    trusted, n = edges.select("pattern", F.lit("").alias("kind"), F.lit(0.0).alias("confidence")).limit(0), 0
    for _ in range(most_rounds):
        fit = scored(edges, beliefs(edges, trusted)).where((F.col("confidence") >= least_confidence) & (F.col("share") >= least_share))
        new = fit.drop("share").join(trusted.select("pattern"), "pattern", "left_anti")
        trusted = work.table(trusted.unionByName(new), "trusted")
        count = trusted.count()
        if count == n:
            return trusted
        n = count
    raise RuntimeError(f"patterns are still added after {most_rounds} rounds")


def discover(scanned: DataFrame, work: Workspace, **options) -> DataFrame:
    """``(doc_id, text_hash, added)``: the spans that trusted patterns add, per distinct document that has any."""
    mentions = scanned.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    trusted = bootstrap(graph(mentions, work), work, **options)
    unknown = mentions.where("kind is null").select("doc_id", "text_hash", "instance", "start", "stop", F.explode("patterns").alias("pattern"))
    spelled = F.col("instance").rlike("[a-z]")  # an address with letters can only be an e-mail, digits only the rest
    fitting = salted_join(unknown, trusted, ["pattern"], ["doc_id", "start"]).where(spelled == (F.col("kind") == "email"))
    order = F.struct("confidence", *[F.when(F.col("kind") == k, 1).otherwise(0).alias(k) for k in KINDS], "kind")
    spans = fitting.groupBy("doc_id", "text_hash", "start", "stop").agg(F.max(order).alias("b")).select("doc_id", "text_hash", F.struct(F.col("b.kind").alias("kind"), "start", "stop").alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("span")).alias("added"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def find(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row of ``docs``."""
    work = Workspace(docs.sparkSession, "pii")
    scanned = work.table(scan(docs), "scan")
    added = work.table(discover(scanned, work, **options), "added")
    joined = scanned.join(added, _same(scanned, added), "left").select(scanned["*"], "added")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    part = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    base = F.transform(part, lambda p: F.struct(order[p[0]].alias("order"), p[1].cast("long").alias("start"), p[2].cast("long").alias("stop"), p[0].alias("kind")))
    more = F.coalesce(F.transform("added", lambda s: F.struct(order[s["kind"]].alias("order"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))), F.array().cast("array<struct<order:int,start:bigint,stop:bigint,kind:string>>"))
    text = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return joined.select("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.greatest(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def redact_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars`` follows, if it is there.

    Base spans are found again while replacing; only documents with added spans are looked up, by
    identifier and hash of the text. A null text stays null.
    """
    work = Workspace(docs.sparkSession, "pii")
    added = work.table(discover(work.table(scan(docs), "scan"), work, **options), "added")
    own_id, own_hash, of_id, of_hash, more = free(docs.columns, "own_id", "own_hash", "of_id", "of_hash", "added")
    key = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    of = added.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("added").alias(more))
    joined = key.join(of, F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_hash) == F.col(of_hash)), "left").drop(own_id, own_hash, of_id, of_hash)
    counted = "n_chars" in docs.columns

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(more).to_pylist(), strict=True):
                texts.append(None if text is None else redact(text, base_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in spans or ()]))
            made = {"text": pa.array(texts, pa.string())}
            if counted:
                made["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield put(batch, made).select(out)

    out = [c for c in joined.columns if c not in ("text", "n_chars", more)] + ["text"] + ["n_chars"] * counted
    schema = extended(joined.drop(more), {"text": "string"} | ({"n_chars": "bigint"} if counted else {}))
    return joined.mapInArrow(run, schema).select(*docs.columns)

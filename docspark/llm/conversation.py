"""Conversation structure repair: cheapest edits that make roles ``(s?(ua)+)?``, by Dial's bucket queue.

A conversation's rows, by turn, are the columns of a small graph: a node is a place between rows with what the kept rows so far end in
(nothing, a system, user or assistant row). Arcs are edits: Keep 0, Rerole to the role that is due 1, Delete 2, Insert the role that is due with an empty text 5;
a truncated row that stays costs 5 more, blank and duplicate rows must go. Costs are small integers, so Dial's buckets (Dial, "Algorithm 360: shortest-path forest with
topological ordering", CACM 1969) give all distances to the end without a heap. The audit then walks from the start along tight arcs, taking the
ASCII-least letter; no node has two tight arcs of one letter, so the walk is the least of all cheapest audits.

Plan. Rows are dealt by ranges of (conversation, turn, ...) and sorted, and one pass over each part repairs the conversations that lie within it. The first and
last conversation of a part, and one of more than ``piece_rows`` rows or ``piece_chars`` code points, may go on elsewhere: they are written as pieces with
the 4 x 4 distances between the states at both ends. Distances to the end of the whole conversation follow from these (min-plus, last piece first), each piece walks from all
four states at once, the states at which pieces really start follow first piece first, and each piece then makes its share of audit and rows. So no
conversation is gathered, however long; what streams through one task is one row of numbers a piece. Equal rows are one row with a count; whether role and text
were seen before is found on hashes, where the rows of a frequent text are dealt over salts.

Defined cases: rows go by turn, null first, then by role and text; equal rows are repeats; a null role or text is one space in :func:`damage` and in :func:`repair`, where a role of
any other initial cannot be kept; a conversation without rows has zeros and an empty audit; a null ``conv_id`` is a conversation of its own; an empty table gives no rows; further
columns are ignored; texts are of any length, one row is never split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.skew import salted_join
from docspark.storage import Workspace

START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = (START, SYSTEM, USER, ASSISTANT)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: The state after the role that is due, by state; its role.
_DUE = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_BUCKETS, _FAR = 32, 1 << 60
#: What is left to pay in each state when there are no more rows.
_ENDS = [0, 2 * INSERT, INSERT, 0]
_SPACE = " \t\n\x0b\x0c\r"
GOOD, BAD, CUT = range(3)

Row = tuple[str, str, int, int]  # role, text, kind, further equal rows (all deleted)


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of that initial is kept, if it may be."""
    due = _BY_INITIAL.get(initial)
    return due if due is not None and (due == _DUE[state] or (due == SYSTEM and state == START)) else None


def _arcs(initial: str, kind: int) -> list[tuple[int, int, int]]:
    """``(from, to, cost)`` across a row."""
    arcs = [(s, s, DELETE) for s in _STATES]
    if kind != BAD:
        stay = TRUNCATED if kind == CUT else 0
        arcs += [(s, _DUE[s], REROLE + stay) for s in _STATES]
        arcs += [(s, t, stay) for s in _STATES if (t := _kept(s, initial)) is not None]
    return arcs


_INTO: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}


def _into(initial: str, kind: int) -> list[list[tuple[int, int]]]:
    """The same by state reached; initials that no role has are one."""
    key = (initial if initial in _BY_INITIAL else "", kind)
    if key not in _INTO:
        _INTO[key] = [[(s, c) for s, t, c in _arcs(*key) if t == state] for state in _STATES]
    return _INTO[key]


def distances(rows: list[Row], ends: list[int]) -> list[list[int]]:
    """The cost from every place and state to the end, where ``ends`` is left to pay: Dial's buckets, settled backwards."""
    n, least = len(rows), min(ends)
    found = [[_FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(_BUCKETS)]
    waiting = 0
    for state, cost in enumerate(ends):
        if cost < _FAR:
            found[n][state] = cost - least
            buckets[(cost - least) % _BUCKETS].append((n, state))
            waiting += 1
    into = [_into(role[:1], kind) for role, _, kind, _ in rows]
    now = 0
    while waiting:
        bucket = buckets[now % _BUCKETS]
        while bucket:
            place, state = bucket.pop()
            waiting -= 1
            if found[place][state] != now:  # settled at less
                continue
            back = [(place - 1, s, c) for s, c in into[place - 1][state]] if place else []
            if place < n:  # insertions at the end are the following piece's, or already in ``ends``
                back += [(place, s, INSERT) for s in _STATES if _DUE[s] == state]
            for p, s, cost in back:
                if now + cost < found[p][s]:
                    found[p][s] = now + cost
                    buckets[(now + cost) % _BUCKETS].append((p, s))
                    waiting += 1
        now += 1
    return [[x + least if x < _FAR else _FAR for x in place] for place in found]


def walk(rows: list[Row], found: list[list[int]], state: int, last: bool) -> tuple[str, list[dict], int]:
    """The least audit along tight arcs, the rows it leaves, and the state behind them."""
    audit, left = [], []
    for place, (role, text, kind, more) in enumerate(rows):
        into = found[place + 1]
        while True:
            here, due = found[place][state], _DUE[state]
            stay = TRUNCATED if kind == CUT else 0
            if into[state] + DELETE == here:
                audit.append("D")
            elif found[place][due] + INSERT == here:
                audit.append("I")
                left.append({"role": _ROLE[due], "text": ""})
                state = due
                continue
            elif (kept := _kept(state, role[:1])) is not None and into[kept] + stay == here:
                audit.append("K")
                left.append({"role": role, "text": text})
                state = kept
            else:
                audit.append("R")
                left.append({"role": _ROLE[due], "text": text})
                state = due
            break
        audit.append("D" * more)
    while last and state in (SYSTEM, USER):
        state = _DUE[state]
        audit.append("I")
        left.append({"role": _ROLE[state], "text": ""})
    return "".join(audit), left, state


# Passes over sorted parts

_KEY = "nameless boolean, conv long, part int, piece int"
_TURNS = "array<struct<role: string, text: string>>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SUMS = "first_turn long, last_turn long, turns long, head string, tail string, fixed long, blank long, duplicate long, truncated long, illegal long"
_PIECE = f"{_KEY}, whole boolean, {_SUMS}, costs array<long>, rows array<struct<role: string, text: string, kind: int, more: long>>, gaps long, cost long, audit string, repaired {_TURNS}"
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_LONGS = ["first_turn", "last_turn", "turns", "fixed", *_COUNTS, "gaps", "cost"]
_TYPES = {
    **dict.fromkeys(_LONGS, pa.int64()), "nameless": pa.bool_(), "whole": pa.bool_(), "last": pa.bool_(), "conv": pa.int64(), "part": pa.int32(), "piece": pa.int32(), "number": pa.int32(), "pieces": pa.int32(),
    "head": pa.string(), "tail": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string(), "costs": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "stops": pa.list_(pa.int32()), "start": pa.int32(),
    "rows": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("kind", pa.int32()), ("more", pa.int64())])), "repaired": pa.list_(_TURN),
}


def _columns(ddl: str) -> list[str]:
    """Top-level column names of a schema in DDL."""
    out, depth, start = [], 0, 0
    for at, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:at].split()[0])
            start = at + 1
    return out


def _batches(rows: Iterable[dict], names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of the columns ``names`` as batches of bounded text; a row's ``size`` is what it weighs."""
    schema = pa.schema([(n, _TYPES[n]) for n in names])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.get("size", 0) + 200
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Open:
    """The rows of one conversation that one pass has met since the last piece."""

    def __init__(self, nameless: bool, conv: int, part: int):
        self.key = {"nameless": nameless, "conv": conv, "part": part}
        self.piece = 0
        self._clear()

    def _clear(self) -> None:
        self.rows: list[Row] = []
        self.chars = self.fixed = self.turns = 0
        self.first_turn = self.last_turn = self.head = self.tail = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str, seen: bool, copies: int) -> None:
        bare, initial = text.rstrip(_SPACE), role[:1]
        more = copies - 1
        if not bare:
            kind = BAD
            self.counts["blank"] += copies
        else:
            kind = BAD if seen else GOOD if bare[-1] in ".!?" else CUT
            self.counts["duplicate"] += more + seen
            self.counts["truncated"] += kind == CUT
        self.rows.append((role, text, kind, more))
        self.chars += len(text)
        self.fixed += DELETE * more
        self.counts["illegal"] += more + (self.tail is not None and self.tail + initial not in _LEGAL)
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def whole(self) -> dict:
        """The repaired conversation."""
        found = distances(self.rows, _ENDS)
        audit, left, _ = walk(self.rows, found, START, True)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self._row(True) | {"gaps": gaps, "cost": found[0][START] + self.fixed, "audit": audit, "repaired": left}

    def cut(self) -> dict:
        """The rows so far as a piece, which is then empty."""
        one = [[0 if s == t else _FAR for s in _STATES] for t in _STATES]
        to = [distances(self.rows, ends)[0] for ends in one]
        rows = [{"role": r, "text": t, "kind": k, "more": m} for r, t, k, m in self.rows]
        out = self._row(False) | {"costs": [to[t][s] for s in _STATES for t in _STATES], "rows": rows}
        self.piece += 1
        self._clear()
        return out

    def _row(self, whole: bool) -> dict:
        held = {"first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns, "head": self.head, "tail": self.tail, "fixed": self.fixed, "size": self.chars}
        return self.key | {"piece": self.piece, "whole": whole} | held | self.counts


def _lists(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _repaired(ordered: DataFrame, piece_rows: int, piece_chars: int) -> DataFrame:
    """Whole conversations, and the pieces of those that may go on in another part."""
    names = _columns(_PIECE)

    def rows(batches):
        now, first = None, True
        for batch in batches:
            for nameless, conv, turn, role, text, gone, seen, copies, part in _lists(batch):
                if now is None or (now.key["nameless"], now.key["conv"]) != (nameless, conv):
                    if now is not None:
                        yield now.cut() if first or now.piece else now.whole()
                        first = False
                    now = _Open(nameless, conv, part)
                if not gone:
                    now.add(turn, role, text, seen, copies)
                    if len(now.rows) >= piece_rows or now.chars >= piece_chars:
                        yield now.cut()
        if now is not None:
            yield now.cut()

    return ordered.mapInArrow(lambda batches: _batches(rows(batches), names), _PIECE)


_NUMBERS = f"{_KEY}, ends array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, pieces int"


def _by_conversation(df: DataFrame, descending: bool) -> DataFrame:
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("part", "piece")]
    return df.repartition("nameless", "conv").sortWithinPartitions("nameless", "conv", *order)


def _backwards(pieces: DataFrame) -> DataFrame:
    """What is left to pay behind every piece, and the conversation's sums with its first piece (null elsewhere)."""
    names = _columns(_NUMBERS)
    taken = ["nameless", "conv", "part", "piece", *_columns(_SUMS), "costs"]

    def rows(batches):
        now = held = None
        for batch in batches:
            for values in _lists(batch):
                row = dict(zip(taken, values, strict=True))
                if now != (row["nameless"], row["conv"]):
                    if held:
                        yield held | sums(total, after)
                    now, held, after = (row["nameless"], row["conv"]), None, _ENDS
                    total = dict.fromkeys([*_COUNTS, "fixed", "turns", "pieces"], 0) | {"head": None, "first_turn": None, "last_turn": None}
                if held:
                    yield held
                held = {k: row[k] for k in ("nameless", "conv", "part", "piece")} | {"ends": after, "last": held is None}
                if total["head"] is not None and row["tail"] is not None:
                    total["illegal"] += row["tail"] + total["head"] not in _LEGAL
                if row["turns"]:
                    total["turns"] -= row["last_turn"] == total["first_turn"]
                    total["last_turn"] = row["last_turn"] if total["last_turn"] is None else total["last_turn"]
                    total["first_turn"] = row["first_turn"]
                total["head"] = total["head"] if row["head"] is None else row["head"]
                for name in [*_COUNTS, "fixed", "turns"]:
                    total[name] += row[name]
                total["pieces"] += 1
                costs = row["costs"]
                after = [min(_FAR, *(costs[4 * s + t] + after[t] for t in _STATES)) for s in _STATES]
        if held:
            yield held | sums(total, after)

    def sums(total, after):
        gaps = total["last_turn"] - total["first_turn"] + 1 - total["turns"] if total["turns"] else 0
        return {k: total[k] for k in (*_COUNTS, "pieces")} | {"gaps": gaps, "cost": after[START] + total["fixed"]}

    return _by_conversation(pieces.select(*taken), True).mapInArrow(lambda batches: _batches(rows(batches), names), _NUMBERS)


def _rows_of(values: list[dict]) -> list[Row]:
    return [(v["role"], v["text"], v["kind"], v["more"]) for v in values]


def _stops(pieces: DataFrame) -> DataFrame:
    """The state behind each piece by the state before it."""
    taken = ["nameless", "conv", "part", "piece", "ends", "last", "rows"]

    def rows(batches):
        for batch in batches:
            for *key, ends, last, values in _lists(batch):
                own = _rows_of(values)
                found = distances(own, ends)
                stops = [walk(own, found, s, last)[2] if found[0][s] < _FAR else s for s in _STATES]
                yield dict(zip(taken[:4], key, strict=True)) | {"stops": stops}

    return pieces.select(*taken).mapInArrow(lambda batches: _batches(rows(batches), [*taken[:4], "stops"]), f"{_KEY}, stops array<int>")


def _forwards(numbers: DataFrame) -> DataFrame:
    """Where every piece starts, its number, and the conversation's sums on all pieces."""
    shared = ["gaps", *_COUNTS, "cost", "pieces"]
    taken = ["nameless", "conv", "part", "piece", "ends", "last", "stops", *shared]
    out = f"{_NUMBERS}, start int, number int"
    names = _columns(out)

    def rows(batches):
        now = None
        for batch in batches:
            for values in _lists(batch):
                row = dict(zip(taken, values, strict=True))
                if now != (row["nameless"], row["conv"]):
                    now, state, number = (row["nameless"], row["conv"]), START, 0
                    sums = {k: row[k] for k in shared}
                yield row | sums | {"start": state, "number": number}
                state, number = row["stops"][state], number + 1

    return _by_conversation(numbers.select(*taken), False).mapInArrow(lambda batches: _batches(rows(batches), names), out)


_FOUND = f"nameless boolean, conv long, number int, pieces int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired {_TURNS}"


def _walked(pieces: DataFrame) -> DataFrame:
    """Every piece's share of audit and rows."""
    names = _columns(_FOUND)
    taken = [*names[:-2], "start", "ends", "last", "rows"]

    def rows(batches):
        for batch in batches:
            for *same, start, ends, last, values in _lists(batch):
                own = _rows_of(values)
                audit, left, _ = walk(own, distances(own, ends), start, last)
                yield dict(zip(names, same, strict=False)) | {"audit": audit, "repaired": left, "size": sum(len(x["text"]) for x in left)}

    return pieces.select(*taken).mapInArrow(lambda batches: _batches(rows(batches), names), _FOUND)


def _ordered(rows: DataFrame, work: Workspace) -> DataFrame:
    """The rows in parts by ranges, sorted; equal rows are one with ``copies``, ``seen`` tells rows of a role and text met at an earlier turn."""
    base = rows.select(
        F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col("gone") if "gone" in rows.columns else F.lit(False)).alias("gone"), (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("long").alias("copies"),
    ).withColumns({"named": F.col("turn").isNotNull(), "hash": F.xxhash64("text"), "chars": F.char_length("text")})
    same = ["nameless", "conv", "role", "hash", "chars"]
    at = ["named", "turn"]
    narrow = base.where("not gone").groupBy(*same, *at).agg(F.count("*").alias("rows"))
    narrow = work.table(narrow, "rows")
    first = narrow.groupBy(*same).agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    later = salted_join(narrow, first, same, at).where(F.struct(*at) > F.col("first"))
    later = later.select(*same, "named", F.coalesce("turn", F.lit(0).cast("long")).alias("of"), F.lit(True).alias("seen"))
    size = narrow.agg(F.count("*").alias("n"), F.max("rows").alias("most")).first()
    if (size["most"] or 0) > 1:
        base = base.groupBy(*same, *at, "text", "gone").agg(F.sum("copies").alias("copies"))
    of = F.coalesce("turn", F.lit(0).cast("long"))
    marked = base.withColumn("of", of).join(later, [*same, "named", "of"], "left")
    order = ["nameless", "conv", "named", "turn", "role", "hash"]
    parts = marked.repartitionByRange(work.files(size["n"]), *order).sortWithinPartitions(*order, "text")
    return parts.select("nameless", "conv", "turn", "role", "text", "gone", F.coalesce("seen", F.lit(False)).alias("seen"), "copies", F.spark_partition_id().alias("part"))


def repair(rows: DataFrame, piece_rows: int = 4096, piece_chars: int = 1 << 22) -> DataFrame:
    """Every conversation of ``rows(conv_id, turn, role, text)`` repaired, in ``pieces`` pieces by ``number`` (nearly always one).

    ``(conv_id, number, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)``: the counts and the cost are the
    whole conversation's on each of its pieces, ``audit`` and ``repaired`` (role, text) are the piece's share.
    A column ``copies`` repeats a row; ``gone`` rows name their conversation only.
    """
    work = Workspace(rows.sparkSession, "conversations")
    key = ["nameless", "conv", "part", "piece"]
    made = work.table(_repaired(_ordered(rows, work), piece_rows, piece_chars), "pieces")
    pieces = made.where("not whole")
    numbers = work.table(_backwards(pieces), "left")
    stops = work.table(_stops(pieces.select(*key, "rows").join(numbers.select(*key, "ends", "last"), key)), "stops")
    starts = work.table(_forwards(numbers.join(stops, key)), "starts")
    walked = work.table(_walked(pieces.select(*key, "rows").join(starts, key)), "walked")
    whole = made.where("whole").withColumns({"number": F.lit(0), "pieces": F.lit(1)}).select(*walked.columns)
    named = F.when(~F.col("nameless"), F.col("conv")).alias("conv_id")
    return whole.unionByName(walked).select(named, *walked.columns[2:])


def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults by the remainder of a checksum of ``conv_id:turn``: rows for :func:`repair`, nulls as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = told("role"), told("text")
    return conversations.select(
        "conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (hit == 0).alias("gone"), F.when(hit == 3, 2).otherwise(1).alias("copies"),
    )


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(found: DataFrame) -> DataFrame:
    """One row a conversation of :func:`repair`: its audit, and the SHA-256 of its rows ``role:text``, joined by newlines.

    A digest of many pieces is made by one task, which holds one piece at a time.
    """
    names = _columns(_DIGEST)
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    one = found.where("pieces = 1").select(*names[:-1], F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    schema = pa.schema([("conv_id", pa.int64()), *((n, _TYPES[n]) for n in names[1:])])

    def rows(batches):
        now = None
        for batch in batches:
            for number, *values, text in _lists(batch):
                row = dict(zip(names[:-1], values, strict=True))
                if not number:
                    if now:
                        yield done(now, audits, digest)
                    now, audits, digest, some = row, [], hashlib.sha256(), False
                audits.append(row["audit"])
                if text is not None:
                    digest.update(b"\n" * some + text.encode("utf-8", "surrogatepass"))
                    some = True
        if now:
            yield done(now, audits, digest)

    def done(now, audits, digest):
        return now | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    def run(batches):
        for row in rows(batches):
            yield pa.RecordBatch.from_pylist([row], schema)

    shares = found.where("pieces > 1").select("number", *names[:-1], F.when(F.size("repaired") > 0, text).alias("share"))
    many = shares.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(run, _DIGEST)
    return one.unionByName(many)

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from docspark.llm import conversation as c
from docspark.llm import queries

SOME = re.compile(r"[^\x20\x09-\x0D]")


def least(kinds):
    """Cheapest cost and least audit of (initial, fault) rows, with the roles it leaves: all edits tried, at most two insertions in a row."""

    @cache
    def best(i, state, inserts):
        due = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
        options = [(0, "", ())] if i == len(kinds) and state in ("", "a") else []
        if inserts < 2:
            n, audit, left = best(i, due, inserts + 1)
            options.append((n + 5, "I" + audit, ((due, None), *left)))
        if i < len(kinds):
            initial, fault = kinds[i]
            n, audit, left = best(i + 1, state, 0)
            options.append((n + 2, "D" + audit, left))
            if fault in (None, "truncated"):
                stay = 5 if fault else 0
                n, audit, left = best(i + 1, due, 0)
                options.append((n + 1 + stay, "R" + audit, ((due, i), *left)))
                if initial == due or (initial == "s" and state == ""):
                    n, audit, left = best(i + 1, initial, 0)
                    options.append((n + stay, "K" + audit, (("keep", i), *left)))
        return min(options, default=(1 << 40, "", ()), key=lambda x: x[:2])

    return best(0, "", 0)


def brute(rows):
    """The contract's rows by plain loops."""
    by_conv, out = defaultdict(list), []
    for conv, turn, role, text in rows:
        kept = by_conv[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        kept.extend([(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    for conv, kept in by_conv.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], 0))
        kinds, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            marks = SOME.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append((role[:1], fault))
            if fault:
                n[fault] += 1
        initials = [k for k, _ in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, left = least(tuple(kinds))
        done = [f"{kept[i][1]}:{kept[i][2]}" if how == "keep" else f"{ {'u': 'user', 'a': 'assistant'}[how]}:{'' if i is None else kept[i][2]}" for how, i in left]
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, convs=60, longest=40):
    r = random.Random(seed)
    words = ["Yes.", "No!", "so", "Well?", "  ", "", "what. ", "fine\n", None, "é.", "Yes. "]
    rows = []
    for conv in [*range(convs), None]:
        size = r.randrange(1, longest)
        for turn in range(size):
            if r.random() < 0.9:
                said = r.choice(words) if r.random() < 0.4 else f"{r.randrange(10**6)}."
                rows.append((conv, None if r.random() < 0.02 else turn + r.randrange(2) * 3 * (turn > 5) * 100, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), said))
    seen, unique = set(), []
    for row in rows:  # rows of one turn would tie
        if (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            unique.append(row)
    r.shuffle(unique)
    return unique


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("piece_rows", "piece_chars"), [(4096, 1 << 22), (3, 1 << 22), (1, 1 << 22), (50, 12)])
def test_equals_brute_force(spark, piece_rows, piece_chars):
    """Whole conversations and such in many pieces are repaired alike."""
    rows = conversations(piece_rows)
    table = spark.createDataFrame([(*r, 1, True) for r in rows], f"{SCHEMA}, number int, seen boolean").repartition(4)
    found = c.digests(c.repair(c.damage(table), piece_rows, piece_chars))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_conversation_repair(spark, sf_dir).collect()), key=str) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    """It is repaired in pieces by many tasks, to what one task makes of it."""
    rows = [r for r in conversations(5, 1, 6000)]
    table = spark.createDataFrame(rows, SCHEMA)
    pieces = c.repair(c.damage(table), piece_rows=500)
    assert pieces.agg({"pieces": "max"}).first()[0] > 8
    one = c.digests(c.repair(c.damage(table.coalesce(1)), 1 << 20, 1 << 30))
    assert sorted(c.digests(pieces).collect(), key=str) == sorted(one.collect(), key=str)


def test_repeated_rows_and_empty_conversations(spark):
    """Rows repeated a thousand times are deleted but for one; a conversation that lost all rows has an empty repair."""
    rows = [(1, 0, "user", "Hello.", 1000, False), (1, 1, "assistant", "Yes.", 1, False), (2, 0, "user", "x", 1, True), (3, 0, None, None, 2, False), (4, 0, "user", "Twice.", 1, False), (4, 0, "user", "Twice.", 1, False)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long, gone boolean")
    pieces = sorted(c.repair(table).collect(), key=lambda r: r["number"])
    found = {r["conv_id"]: r.asDict() | {"audit": "", "repaired": []} for r in pieces}
    for r in pieces:
        found[r["conv_id"]]["audit"] += r["audit"]
        found[r["conv_id"]]["repaired"] += r["repaired"]
    assert (found[1]["audit"], found[1]["duplicate"], found[1]["illegal"], found[1]["cost"]) == ("K" + "D" * 999 + "K", 999, 999, 1998)
    assert [(t["role"], t["text"]) for t in found[1]["repaired"]] == [("user", "Hello."), ("assistant", "Yes.")]
    assert (found[2]["audit"], found[2]["cost"], found[2]["repaired"]) == ("", 0, [])
    assert (found[3]["audit"], found[3]["blank"]) == ("DD", 2)
    assert (found[4]["audit"], found[4]["duplicate"]) == ("DD", 1)
    said = {r["conv_id"]: r["repaired_sha256"] for r in c.digests(c.repair(table)).collect()}
    assert said[2] == hashlib.sha256(b"").hexdigest() and said[1] == hashlib.sha256(b"user:Hello.\nassistant:Yes.").hexdigest()


def test_empty_table(spark):
    assert c.digests(c.repair(c.damage(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_distances_are_shortest():
    """Against relaxing all arcs until nothing changes."""
    r = random.Random(1)
    for _ in range(200):
        rows = [(r.choice(["user", "assistant", "system", "tool", ""]), "", r.randrange(3), 0) for _ in range(r.randrange(12))]
        ends = [c._FAR] * 4
        ends[r.randrange(4)] = 7
        want = [[c._FAR] * 4 for _ in rows] + [list(ends)]
        for place in range(len(rows) - 1, -1, -1):
            role, _, kind, _ = rows[place]
            for _ in range(5):
                for s in range(4):
                    arcs = [want[place + 1][t] + cost for a, t, cost in c._arcs(role[:1], kind) if a == s]
                    want[place][s] = min([want[place][s], want[place][c._DUE[s]] + c.INSERT, *arcs])
        want = [[min(x, c._FAR) for x in place] for place in want]
        assert c.distances(rows, ends) == want

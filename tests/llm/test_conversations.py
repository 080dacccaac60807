"""Repair of conversations against all edits, chunks against whole conversations, and edge cases."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from callweave.llm import conversations as C

RND = random.Random(9)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost int"
ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
TEXTS = ["Yes.", "No", "Well? ", "ok!\n", "", " \t", "cut off", None, "Yes."]


def seen_faults(rows):
    """Rows (turn, role, text) in order with their faults, by plain Python."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out, seen = [], set()
    for t, r, x in rows:
        bare = x.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def plain_repair(rows):
    """(counts, illegal, cost, audit, digest) over every legal row of edits, by search over states."""
    found = seen_faults(rows)
    # states: what has been made so far, as the last initial ("" at the start); cheapest, then least audit
    best = {"": (0, "", ())}
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(now):
        todo = dict(now)
        for _ in range(4):
            for last, (cost, audit, lines) in list(todo.items()):
                for role in ("user", "assistant"):
                    if role[0] in after[last]:
                        new = (cost + 3, audit + "I", lines + (f"{role}:",))
                        todo[role[0]] = min(todo.get(role[0], new), new)
        return todo

    # all ways are kept apart for the order of audits: (last, cost, audit, lines), the least of each state and cost
    ways = {("", 0): ("", ())}
    for _, r, x, fault in found:
        more = {}

        def put(last, cost, audit, lines):
            old = more.get((last, cost))
            if old is None or audit < old[0]:
                more[last, cost] = (audit, lines)

        for (last, cost), (audit, lines) in list(ways.items()):
            chain = [(last, cost, audit, lines)]
            for _ in range(2):
                now, c, a, ls = chain[-1]
                role = "assistant" if now == "u" else "user"
                chain.append((role[0], c + 3, a + "I", ls + (f"{role}:",)))
            for now, c, a, ls in chain:
                put(now, c + 4, a + "D", ls)
                if fault in ("", "truncated"):
                    extra = 3 * (fault == "truncated")
                    if r[:1] and r[0] in after[now]:
                        put(r[0], c + extra, a + "K", ls + (f"{r}:{x}",))
                    for role in ("user", "assistant"):
                        if role[0] in after[now]:
                            put(role[0], c + 3 + extra, a + "R", ls + (f"{role}:{x}",))
        ways = more
    ends = []
    for (last, cost), (audit, lines) in ways.items():
        close = {"": [], "s": ["user:", "assistant:"], "u": ["assistant:"], "a": []}[last]
        ends.append((cost + 3 * len(close), audit + "I" * len(close), lines + tuple(close)))
    cost, audit, lines = min(ends)
    turns = {t for t, *_ in found if t is not None}
    initials = [r[:1] for _, r, _, _ in found]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = lambda k: sum(f == k for *_, f in found)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def talk(n):
    return [(RND.choice([None, *range(n)]), RND.choice(ROLES), RND.choice(TEXTS) if RND.random() < 0.5 else f"text {RND.random()}.") for _ in range(n)]


def test_every_edit_of_short_talks():
    """The search above against all words over D, I, K, R for talks of two rows."""
    pattern = re.compile("(s?(ua)+)?")
    price = {"D": 4, "I": 3, "K": 0, "R": 3}
    for roles in itertools.product(["user", "assistant", "system", "tool"], repeat=2):
        rows = [(i, r, f"{i}.") for i, r in enumerate(roles)]
        best = None
        for size in range(2, 5):
            for audit in map("".join, itertools.product("DIKR", repeat=size)):
                if len(audit) - audit.count("I") != 2:
                    continue
                own = iter(roles)
                options = []
                for e in audit:
                    if e == "I":
                        options.append("ua")
                    else:
                        r = next(own)
                        options.append({"D": [""], "K": [r[0]], "R": "ua"}[e])
                if any(pattern.fullmatch("".join(x)) for x in itertools.product(*options)):
                    cost = sum(price[e] for e in audit)
                    best = min(best or (99, ""), (cost, audit))
        assert plain_repair(rows)[5:7] == best


@pytest.mark.parametrize("most_rows", [10_000, 5])
def test_repairs_equal_plain_search(spark, monkeypatch, most_rows):
    monkeypatch.setattr(C, "CHUNK", 3)
    monkeypatch.setattr(C, "FAN", 2)
    talks = {i: talk(RND.randrange(1, 12)) for i in range(150)} | {None: talk(9), 999: talk(40), 1000: [(1, "user", "Same.")] * 30}
    rows = [(c, *r, 0) for c, rs in talks.items() for r in rs]
    RND.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df, most_rows=most_rows).collect()}
    assert got == {c: plain_repair(rs) for c, rs in talks.items()}
    lines = C.repair(df, lines=True, most_rows=most_rows).collect()
    for c in talks:
        own = sorted((r for r in lines if r.conv_id == c), key=lambda r: r.position)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == got[c][-1]


def test_divide_and_conquer_equals_one_pass():
    for n in (1, 2, 3, 17, 300):
        turns = [C.Turn(i, RND.choice(["user", "assistant", "system", "x"]), f"{i}.", RND.choice([C.SOUND, C.SOUND, C.CUT_OFF, C.BLANK, C.GONE])) for i in range(n)]
        steps = C.steps_of(turns)
        _, t = C.ending(*C.forward(steps, 0, n, C.START))
        whole = C.crossings(steps, C.START, t)
        for size in (1, 4, 64):
            parts = [steps[i : i + size] for i in range(0, n, size)]
            outer = C.crossings([C.together(p) for p in parts], C.START, t)
            inner = [s for p, a, b in zip(parts, outer, outer[1:]) for s in C.crossings(p, a, b)[:-1]] + [t]
            assert C.apply(turns, inner, C.CLOSING[t]).audit == C.apply(turns, whole, C.CLOSING[t]).audit


def test_edges(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, None, None, None, 0), (2, 5, "user", long, 0), (2, 3, "system", "Be kind.", 0), (3, 1, "user", "a.", 0), (3, 1, "user", "a.", 0), (4, 2, "assistant", "x ", 0), (5, 1, "user", "gone.", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df, F.col("conv_id") == 5).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 1, 0, 0, 0, 4, "D", nothing) and got[5] == (0, 0, 0, 0, 0, 0, "", nothing)
    for c in (2, 3, 4):
        assert got[c] == plain_repair([r[1:4] for r in rows if r[0] == c])
    assert got[2][6] == "KKI" and got[4][3] == 1
    assert C.repair(df.where("false")).count() == 0 and C.repair(df.where("false"), lines=True).count() == 0


def test_damage_kinds(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!", 0) for c in [None, *range(40)] for t in (None, 1, 2)]
    damaged, gone = C.damage(spark.createDataFrame(rows, SCHEMA))
    got = damaged.select("conv_id", "turn", "role", "text", gone.alias("gone")).collect()
    for c in [None, *range(40)]:
        for t in (None, 1, 2):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            own = [r for r in got if r.conv_id == c and r.turn == t]
            assert len(own) == (2 if kind == 3 else 1) and all(r.gone == (kind == 0) for r in own)
            assert {r.text for r in own} == {{1: "", 2: "One Two"}.get(kind, "One. Two!")} and {r.role for r in own} == {"user" if kind == 4 else "assistant"}

"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

A repaired conversation is empty, or a system turn at most, then pairs of a user's and an
assistant's turn. Four states say which turns may follow: at the start, after system, after
user, after assistant. Edits keep a row, change its role, delete it, or insert an empty turn.

The edits come from Hirschberg's divide and conquer. Costs of the four states run forward
from the beginning of a stretch and backward from its end and meet in its middle; of the
cheapest crossings the one with the least edits, read as text, is taken, and both halves are
solved by themselves. Forward costs carry the order of their edits: a stretch's rows each end
in a letter of their own, so edits that lead to different states differ before either ends,
and the order of the left halves decides.

Ordinary conversations are solved where a task meets their rows. Those of very many rows
are cut into chunks; a chunk's costs and orders between each two states stand for its rows,
and the same divide and conquer runs over chunks of chunks, then down to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.ordered import running_sum
from callweave.plans.scratch import materialise

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The turn that an inserted or renamed row makes in each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs of ending in a state: what must be inserted to close the last pair.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NEVER = 1 << 60
#: Faults of a row; blank and duplicate rows must be deleted.
SOUND, CUT_OFF, DUPLICATE, BLANK, GONE = range(5)

#: Rows (and bytes) of a conversation that one task may hold, and of one chunk of a longer one.
MOST_ROWS, MOST_BYTES, CHUNK, CHUNK_BYTES, FAN = 4096, 32 << 20, 1024, 16384, 256


@lru_cache(None)
def word(initial: str, fault: int, s: int, t: int) -> tuple[int, str]:
    """The cheapest, then least edits that take one row from state ``s`` to ``t`` and end with the row's own letter.

    ``initial`` is one of s, u, a, or empty for any other role.
    """
    found, at = [], s
    for inserts in range(3):
        before, price = "I" * inserts, INSERT * inserts
        if t == at:
            found.append((price + DELETE, before + "D"))
        if fault < DUPLICATE:
            extra = TRUNCATED if fault == CUT_OFF else 0
            if t == NEXT[at]:
                found.append((price + REROLE + extra, before + "R"))
            if (at == START and initial == "s" and t == SYSTEM) or (t == NEXT[at] and initial == "sua"[t - 1]):
                found.append((price + extra, before + "K"))
        at = NEXT[at]
    return min(found, default=(NEVER, ""))


Costs = tuple[tuple[int, int], ...]


@dataclass(frozen=True, eq=False)
class Step:
    """From each state to each: (cost, place in the order of edits from that state). Equal only to itself, so quick to look up."""

    table: tuple[Costs, ...]


@lru_cache(None)
def step_of(initial: str, fault: int) -> Step:
    """One row's step; a dropped row (GONE) has no edits and changes nothing."""
    out = []
    for s in STATES:
        if fault == GONE:
            out.append(_only(s))
            continue
        words = [word(initial, fault, s, t) for t in STATES]
        order = sorted(STATES, key=lambda t: words[t][1])
        out.append(tuple((words[t][0], order.index(t)) for t in STATES))
    return Step(tuple(out))


@lru_cache(1 << 16)
def _forward(now: Costs, one: Step) -> tuple[int, Costs]:
    """Costs after one more step, less the least of them, which comes first."""
    best, step = [], one.table
    for t in STATES:
        # cheapest, then by the edits so far, then by the step's own
        best.append(min((now[c][0] + step[c][t][0], now[c][1], step[c][t][1]) if now[c][0] < NEVER and step[c][t][0] < NEVER else (NEVER, 0, 0) for c in STATES))
    order = sorted(STATES, key=lambda t: best[t][1:])
    least = min(b[0] for b in best)
    return least, tuple((b[0] - least if b[0] < NEVER else NEVER, order.index(t)) for t, b in enumerate(best))


@lru_cache(1 << 16)
def _backward(one: Step, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    step = one.table
    cost = [min(step[c][t][0] + after[t] if step[c][t][0] < NEVER and after[t] < NEVER else NEVER for t in STATES) for c in STATES]
    least = min(cost)
    return least, tuple(x - least if x < NEVER else NEVER for x in cost)


def _only(s: int) -> Costs:
    return tuple((0, 0) if s == t else (NEVER, 0) for t in STATES)


def forward(steps: Sequence[Step], lo: int, hi: int, s: int) -> tuple[int, Costs]:
    """Least cost from state ``s`` over steps lo to hi, and each state's cost above it with its order."""
    total, now = 0, _only(s)
    for i in range(lo, hi):
        least, now = _forward(now, steps[i])
        total += least
    return total, now


def backward(steps: Sequence[Step], lo: int, hi: int, t: int) -> tuple[int, ...]:
    """Each state's cost of reaching ``t`` over steps lo to hi, up to a number common to all."""
    after = tuple(0 if t == c else NEVER for c in STATES)
    for i in range(hi - 1, lo - 1, -1):
        _, after = _backward(steps[i], after)
    return after


def crossings(steps: Sequence[Step], s: int, t: int) -> list[int]:
    """The state before each step and after the last on the least of the cheapest ways from ``s`` to ``t``."""
    out = [s] * (len(steps) + 1)
    out[-1] = t
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        _, left = forward(steps, lo, mid, out[lo])
        right = backward(steps, mid, hi, out[hi])
        out[mid] = min((c for c in STATES if left[c][0] < NEVER and right[c] < NEVER), key=lambda c: (left[c][0] + right[c], left[c][1]))
        todo += [(lo, mid), (mid, hi)]
    return out


def ending(total: int, costs: Costs) -> tuple[int, int]:
    """(cost, last state) of the best way of all, with what closes the last pair."""
    cost, _, t = min((costs[t][0] + INSERT * len(CLOSING[t]), costs[t][1], t) for t in STATES if costs[t][0] < NEVER)
    return total + cost, t


def together(steps: Sequence[Step]) -> Step:
    """All steps as one."""
    out = []
    for s in STATES:
        total, costs = forward(steps, 0, len(steps), s)
        out.append(tuple((c + total if c < NEVER else NEVER, o) for c, o in costs))
    return Step(tuple(out))


@dataclass
class Turn:
    """A row after damage: GONE rows only stand for their conversation."""

    turn: int | None
    role: str
    text: str
    fault: int


@dataclass
class Repair:
    """Counts, edits and turns of a stretch of rows."""

    counts: list[int] = field(default_factory=lambda: [0] * 5)
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    lines: list[tuple[str, str, str]] = field(default_factory=list)  # edit, role, text


def known(role: str) -> str:
    """The initial that states know a role by, empty for any other."""
    return role[0] if role[:1] in ("s", "u", "a") else ""


def follows(a: str | None, b: str | None) -> bool:
    return (a or "") + (b or "") in ("su", "ua", "au")


def apply(turns: Sequence[Turn], states: Sequence[int], closing: str) -> Repair:
    """The edits of rows whose states are known, and what they make of the rows."""
    out = Repair()

    def insert(at: int, n: int) -> int:
        for _ in range(n):
            at = NEXT[at]
            out.lines.append(("I", ROLE[at], ""))
        return at

    for t, s, e in zip(turns, states, states[1:], strict=False):
        out.counts[t.fault] += 1
        if t.fault == GONE:
            continue
        initial = known(t.role)
        if out.first is None:
            out.first = initial
        else:
            out.illegal += not follows(out.last, initial)
        out.last = initial
        cost, letters = word(initial, t.fault, s, e)
        out.cost += cost
        out.audit.append(letters)
        at = insert(s, len(letters) - 1)
        if letters[-1] == "K":
            out.lines.append(("K", t.role, t.text))
        elif letters[-1] == "R":
            out.lines.append(("R", ROLE[NEXT[at]], t.text))
    insert(states[-1], len(closing))
    out.cost += INSERT * len(closing)
    out.audit.append(closing)
    return out


def steps_of(turns: Sequence[Turn]) -> list[Step]:
    return [step_of(known(t.role), t.fault) for t in turns]


def repair_rows(turns: Sequence[Turn]) -> Repair:
    """The repair of a whole conversation."""
    steps = steps_of(turns)
    _, t = ending(*forward(steps, 0, len(steps), START))
    return apply(turns, crossings(steps, START, t), CLOSING[t])


def faults(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, row, fault`` of rows ``conv_id, turn, role, text``, written once.

    Null roles and texts become one space. A row is blank without any character but white
    space; else a duplicate if role and text were seen at an earlier turn (nulls first) of
    the conversation or in an equal row before it; else cut off if its last such character
    ends no sentence. Rows that ``dropped`` names are GONE.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if dropped is None else dropped
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), gone.alias("__gone"))
    base = materialise(
        own.withColumn("row", F.monotonically_increasing_id()).withColumn(
            "fault",
            F.when(F.col("__gone"), GONE).when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND),
        ).drop("__gone"),
        "turns",
    )
    # equal rows: all but the first of each group, by the names of rows, so that no text is shuffled
    lean = base.where(F.col("fault") < DUPLICATE).select("conv_id", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("d"), F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row").alias("at"))
    firsts = lean.groupBy("conv_id", "d").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    parts = firsts.select(F.col("conv_id").alias("c"), "d", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    dealt = lean.withColumn("p", F.pmod(F.col("at.row"), F.lit(16)).cast("int"))
    later = dealt.join(parts, ["d", "p"]).where(F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") != F.col("first")))
    again = materialise(later.select(F.col("at.row").alias("row"), F.lit(DUPLICATE).alias("__again")), "again")
    return base.join(again, "row", "left").withColumn("fault", F.coalesce("__again", "fault")).drop("__again")


#: Order of the rows of a conversation, nulls first; rows of one turn go by role, the beginning of the text and place in the table.
ORDER = ("__known", "turn", "role", "__begin", "row")
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LINES = "conv_id bigint, position bigint, edit string, role string, text string"


def gaps(turns: Sequence[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def digest(lines: Sequence[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[int | None, list[tuple]]]:
    """The rows of one conversation after another, from batches sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"__known": F.col("turn").isNotNull(), "__begin": F.left("text", F.lit(256))})


def _whole(rows: DataFrame, lines: bool) -> DataFrame:
    """Conversations that a task can hold: one shuffle, then each is solved in passing."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, found in _groups(batches, ("conv_id", "turn", "role", "text", "fault")):
            turns = [Turn(*r[1:]) for r in found]
            r = repair_rows(turns)
            if lines:
                out += [(conv, k, *line) for k, line in enumerate(r.lines)]
            else:
                n = r.counts
                out.append((conv, gaps([t.turn for t in turns if t.fault != GONE]), n[BLANK], n[DUPLICATE], n[CUT_OFF], r.illegal, r.cost, "".join(r.audit), digest(r.lines)))
            if len(out) >= 2000:
                yield _table(out, LINES if lines else SUMMARY)
                out = []
        yield _table(out, LINES if lines else SUMMARY)

    dealt = _ordered(rows).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(make, LINES if lines else SUMMARY)


PARTS = "conv_id bigint, chunk bigint, steps string"
WAYS = "conv_id bigint, chunk bigint, s int, t int"


def _pack(x: Step) -> str:
    return ",".join(f"{c} {o}" for row in x.table for c, o in row)


def _unpack(x: str) -> Step:
    cells = [tuple(map(int, p.split())) for p in x.split(",")]
    return Step(tuple(tuple(cells[4 * s : 4 * s + 4]) for s in STATES))


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with their ``chunk`` (of bounded rows and bytes) and place ``run``; a first chunk has number 0."""
    cost = (F.lit(CHUNK_BYTES) + F.octet_length("text")).cast("bigint")
    placed = running_sum(_ordered(rows), cost, ORDER, by=("conv_id",))
    return materialise(placed.withColumn("chunk", F.floor((F.col("run") - cost) / (CHUNK * CHUNK_BYTES))), "chunks")


def _sorted_turns(t: pa.Table) -> list[Turn]:
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("run", "turn", "role", "text", "fault")), strict=True), key=lambda r: r[0])
    return [Turn(*r[1:]) for r in rows]


def _long(rows: DataFrame, lines: bool) -> DataFrame:
    """Conversations of any length: summaries of chunks, then of chunks of chunks, until one is left; then down again."""
    chunks = _chunks(rows)

    def leaf(t: pa.Table) -> pa.Table:
        packed = _pack(together(steps_of(_sorted_turns(t))))
        return pa.Table.from_batches([_table([(t.column("conv_id")[0].as_py(), t.column("chunk")[0].as_py(), packed)], PARTS)])

    def upper(t: pa.Table) -> pa.Table:
        found = sorted(zip(t.column("chunk").to_pylist(), t.column("steps").to_pylist(), strict=True))
        packed = _pack(together([_unpack(x) for _, x in found]))
        return pa.Table.from_batches([_table([(t.column("conv_id")[0].as_py(), found[0][0] // FAN, packed)], PARTS)])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(c, k, START, ending(0, _unpack(x).table[START])[1]) for c, k, x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "chunk", "steps")), strict=True)]
            yield _table(found, WAYS)

    def lower(t: pa.Table) -> pa.Table:
        found = sorted(zip(t.column("chunk").to_pylist(), t.column("steps").to_pylist(), strict=True))
        states = crossings([_unpack(x) for _, x in found], t.column("s")[0].as_py(), t.column("t")[0].as_py())
        conv = t.column("conv_id")[0].as_py()
        return pa.Table.from_batches([_table([(conv, k, a, b) for (k, _), a, b in zip(found, states, states[1:], strict=False)], WAYS)])

    levels = [materialise(chunks.groupBy("conv_id", "chunk").applyInArrow(leaf, PARTS), "summaries")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        above = levels[-1].groupBy("conv_id", F.floor(F.col("chunk") / FAN).alias("__up")).applyInArrow(upper, PARTS)
        levels.append(materialise(above, "summaries"))
    ways = materialise(levels[-1].mapInArrow(top, WAYS), "ways")
    for level in reversed(levels[:-1]):
        parents = ways.select(F.col("conv_id").alias("__c"), F.col("chunk").alias("__up"), "s", "t")
        below = level.withColumn("__down", F.floor(F.col("chunk") / FAN)).join(parents, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__down") == F.col("__up")))
        ways = materialise(below.groupBy("conv_id", "__down").applyInArrow(lower, WAYS), "ways")
    final = levels[0].groupBy("conv_id").agg(F.max("chunk").alias("__end"))
    ways = ways.join(final.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c"))).select(
        F.col("conv_id").alias("__c"), F.col("chunk").alias("__k"), "s", "t", (F.col("chunk") == F.col("__end")).alias("__last")
    )
    told = chunks.join(ways, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__k")))
    made = "conv_id bigint, chunk bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, cost bigint, audit string, body string, n_lines bigint"

    def parts(t: pa.Table) -> tuple[int | None, int, Repair]:
        turns, s, end = _sorted_turns(t), t.column("s")[0].as_py(), t.column("t")[0].as_py()
        r = apply(turns, crossings(steps_of(turns), s, end), CLOSING[end] if t.column("__last")[0].as_py() else "")
        return t.column("conv_id")[0].as_py(), t.column("chunk")[0].as_py(), r

    def digested(t: pa.Table) -> pa.Table:
        conv, chunk, r = parts(t)
        body = "\n".join(f"{role}:{text}" for _, role, text in r.lines)
        n = r.counts
        return pa.Table.from_batches([_table([(conv, chunk, n[BLANK], n[DUPLICATE], n[CUT_OFF], r.illegal, r.first, r.last, r.cost, "".join(r.audit), body, len(r.lines))], made)])

    def listed(t: pa.Table) -> pa.Table:
        conv, chunk, r = parts(t)
        return pa.Table.from_batches([_table([(conv, chunk << 32 | k, *line) for k, line in enumerate(r.lines)], LINES)])

    if lines:  # positions rise with the turns, but leave gaps between chunks
        return told.groupBy("conv_id", "chunk").applyInArrow(listed, LINES)
    names = [x.split()[0] for x in made.split(", ")]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each conversation from its chunks in order: bytes are digested as they stream by."""
        state: dict = {}

        def close() -> tuple:
            return (state["conv"], 0, *state["n"][:4], state["n"][4], "".join(state["audit"]), state["sha"].hexdigest())

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                conv, _, *n, first, last, cost, audit, body, n_lines = (batch.column(c)[i].as_py() for c in names)
                if state and state["conv"] != conv:
                    out.append(close())
                    state = {}
                if not state:
                    state = {"conv": conv, "n": [0] * 5, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
                state["n"] = [a + b for a, b in zip(state["n"], (*n, cost), strict=True)]
                if first is not None:
                    state["n"][3] += state["last"] is not None and not follows(state["last"], first)
                    state["last"] = last
                state["audit"].append(audit)
                if n_lines:
                    state["sha"].update((b"\n" if state["any"] else b"") + body.encode())
                    state["any"] = True
            yield _table(out, SUMMARY)
        if state:
            yield _table([close()], SUMMARY)

    done = materialise(told.groupBy("conv_id", "chunk").applyInArrow(digested, made), "repaired")
    one = done.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(joined, SUMMARY).drop("gaps")
    spans = chunks.where(F.col("fault") != GONE).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    spans = spans.select(F.col("conv_id").alias("__c"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    return one.join(spans, F.col("conv_id").eqNullSafe(F.col("__c")), "left").withColumn("gaps", F.coalesce("gaps", F.lit(0))).select(*names)


def repair(rows: DataFrame, dropped: Column | None = None, lines: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """Repairs every conversation of ``conv_id, turn, role, text``.

    Gives SUMMARY, a row for each conversation: missing turns between the least and the
    greatest, blank, duplicate and truncated rows, neighbours of which one's role may not
    follow the other's, the cost of the cheapest edits, their letters (D delete, I insert, K
    keep, R change the role; the least text of all cheapest) and the SHA-256 of the repaired
    turns as ``role:text`` lines. With ``lines``, the repaired turns themselves, in LINES.

    Rows go by turn, nulls first, then role and the first 256 characters of the text. Rows that ``dropped`` names (a column
    of the rows) are left out, but their conversations stay: one without any other row has
    zeros, no edits and the digest of nothing. Null roles and texts are one space, so blank or
    of no known role; null conversation ids are one conversation. Repeated rows are
    duplicates of the first. Conversations beyond ``most_rows`` rows or MOST_BYTES are
    solved in chunks, so that no task holds one whole; their digest is made by one task that
    reads the repaired turns as they stream by, as a digest can't be cut. An empty table gives none; other columns are left out.
    """
    found = faults(rows, dropped)
    sizes = found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("b"))
    large = materialise(sizes.where((F.col("n") > most_rows) | (F.col("b") > MOST_BYTES)).select(F.col("conv_id").alias("__c")), "large")
    if large.isEmpty():
        return _whole(found, lines)
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.pmod(F.col("row"), F.lit(16)) == F.col("__p"))
    parts = large.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return _whole(found.join(parts, same, "left_anti"), lines).union(_long(found.join(parts, same, "left_semi"), lines))


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the damage that ``crc32(conv_id:turn) % 20`` deals out, and the column that names dropped rows.

    0 drops the row, 1 empties its text, 2 takes out its full stops, exclamation and question
    marks, 3 repeats it, 4 makes it the user's. A null id or turn is one space in the key.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("__kind", kind)
    damaged = rows.select(
        "conv_id", "turn",
        F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("__kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")
    return damaged, F.col("dropped")

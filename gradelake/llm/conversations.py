"""Conversations put right by the cheapest edits: an exact search over keeping, re-labelling, deleting and inserting turns.

The search is depth-first branch and bound with an explicit stack. A node is a place among the turns and the role that was written last. The bound
of a node is the least cost of what follows it whatever the audit, the incumbent is the best whole script so far by (cost, audit), and a table for each node
drops prefixes that reach it with more cost or, at the same cost, a greater audit. Scripts of one cost that have edited as many turns never begin with one another, so what is
better as a prefix is better as a whole.

A conversation streams through one task in blocks of at most BLOCK_ROWS turns: between blocks only the best script for each last role is known, and what all of
those share is settled, written and forgotten. So memory follows a block and not the conversation (its audit apart, one byte an edit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns, and characters of their texts, that one search takes at once (or one turn).
BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 20
#: Rows of results in an Arrow batch, and characters of their texts.
OUT_ROWS, OUT_CHARS = 1024, 1 << 21

#: The last role written: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow: the role that comes after each, and where a conversation may end.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (NONE, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: No script that another one leads by more can still win: whatever follows it follows the other after an inserted turn (2) and a deleted system turn (3).
LEAD = COST["I"] + COST["D"]
LEGAL = ("su", "ua", "au")


def kept(state: int, initial: str) -> int | None:
    """The state after a turn with this role initial is kept, None where it can't be."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    wanted = USER if initial == "u" else ASSISTANT if initial == "a" else None
    return wanted if wanted == NEXT[state] else None


def moves(state: int, turn: tuple[str, bool, bool] | None) -> list[tuple[str, int, int, bool]]:
    """(edit, cost, state after it, whether it uses up the turn), greatest edit first. turn: role initial, must go, is cut off; None at the end."""
    out = []
    if turn is not None:
        initial, must_go, cut = turn
        if not must_go:
            out.append(("R", COST["R"] + cut, NEXT[state], True))
            if (after := kept(state, initial)) is not None:
                out.append(("K", COST["K"] + cut, after, True))
    out.append(("I", COST["I"], NEXT[state], False))
    if turn is not None:
        out.append(("D", COST["D"], state, True))
    return out


def bounds(turns: list[tuple[str, bool, bool]], goals: tuple[int, ...], at_end: bool) -> list[list[float]]:
    """[place][state]: the least cost of what leads from there to a goal after the last turn. at_end: turns may be inserted after the last one."""
    inf = float("inf")
    out = [[0.0 if q in goals else inf for q in range(4)]]
    if at_end:
        relax(out[0])
    for turn in reversed(turns):
        after = out[-1]
        now = [min(c + after[to] for _, c, to, uses in moves(q, turn) if uses) for q in range(4)]
        relax(now)
        out.append(now)
    out.reverse()
    return out


def relax(costs: list[float]) -> None:
    """Costs at one place, with insertions there: two at most are of use."""
    for _ in range(2):
        costs[:] = [min(c, COST["I"] + costs[NEXT[q]]) for q, c in enumerate(costs)]


def search(turns: list[tuple[str, bool, bool]], entries: dict[int, tuple[int, int]], goals: tuple[int, ...], at_end: bool) -> tuple[int, int, str, int] | None:
    """(cost, entry's rank, audit, goal) of the cheapest script from one of `entries` (state: cost, rank) to one of `goals`, least by rank and audit; None if none leads there.

    Ranks order the scripts that led to the entries. Without at_end nothing is inserted after the last turn, so that the next block may.
    """
    least = bounds(turns, goals, at_end)
    n = len(turns)
    best: tuple[int, int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, int, str]] = {}
    stack = sorted(((c, rank, "", 0, q) for q, (c, rank) in entries.items()), reverse=True)
    while stack:
        cost, rank, audit, place, state = stack.pop()
        if best is not None and (cost + least[place][state], rank) > best[:2]:
            continue
        if least[place][state] == float("inf"):
            continue
        own = (cost, rank, audit)
        if table.get((place, state), own) < own:
            continue
        table[place, state] = own
        if place == n and state in goals and (best is None or own < best[:3]):
            best = (*own, state)
        if place == n and not at_end:
            continue
        bar = float("inf") if best is None else best[0]
        for edit, more, to, uses in moves(state, turns[place] if place < n else None):
            then = place + uses
            if cost + more + least[then][to] <= bar:
                found = (cost + more, rank, audit + edit)
                if table.get((then, to), found) >= found:
                    stack.append((*found, then, to))
    return best


def applied(audit: str, state: int, turns: list[tuple]) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of each edit that leaves a turn or deletes one; turns: (turn, role, text). A deleted turn has its own role and text."""
    rows = iter(turns)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, None, NAMES[state], ""
            continue
        turn, role, text = next(rows)
        if edit == "R":
            state = NEXT[state]
            role = NAMES[state]
        elif edit == "K":
            state = kept(state, role[:1])
        yield edit, turn, role, text


class Repair:
    """One conversation, fed turn by turn. `out` gets its settled edits."""

    def __init__(self, out):
        self.out, self.turns, self.codes, self.chars = out, [], [], 0
        # the best script to each state: cost, and its blocks (audit, state it began in), of which the settled ones are gone
        self.open: dict[int, tuple[int, list[tuple[str, int]]]] = {NONE: (0, [])}
        self.blocks: list[list[tuple]] = []
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last_turn = self.last_role = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.n[fault] += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in LEGAL:
            self.n["illegal"] += 1
        self.last_role = role
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        if self.turns and (len(self.turns) >= BLOCK_ROWS or self.chars + len(text) > BLOCK_CHARS):
            self.block()
        self.turns.append((turn, role, text))
        self.codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.chars += len(text)

    def entries(self) -> tuple[dict[int, tuple[int, int]], list[int]]:
        """The open states with cost and the rank of their scripts, and the states by rank."""
        order = sorted(self.open, key=lambda q: "".join(a for a, _ in self.open[q][1]))
        return {q: (self.open[q][0], r) for r, q in enumerate(order)}, order

    def block(self) -> None:
        """Carries the open scripts over the turns held."""
        entries, order = self.entries()
        found = [x for q in range(4) if (x := search(self.codes, entries, (q,), False))]
        least = min(x[0] for x in found)
        self.open = {x[3]: (x[0], [*self.open[order[x[1]]][1], (x[2], order[x[1]])]) for x in found if x[0] <= least + LEAD}
        self.blocks.append(self.turns)
        self.turns, self.codes, self.chars = [], [], 0
        self.settle()

    def settle(self) -> None:
        """Writes the blocks that every open script edits alike."""
        scripts = [s for _, s in self.open.values()]
        while scripts[0] and all(s[0] == scripts[0][0] for s in scripts):
            audit, state = scripts[0][0]
            self.audit.append(audit)
            for edit, turn, role, text in applied(audit, state, self.blocks.pop(0)):
                if edit != "D":
                    self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode(errors="surrogatepass"))
                    self.empty = False
                self.out(edit, turn, role, text)
            for s in scripts:
                s.pop(0)

    def end(self) -> dict:
        """What holds of the whole conversation."""
        entries, order = self.entries()
        cost, rank, audit, _ = search(self.codes, entries, ENDS, True)
        self.open = {0: (cost, [*self.open[order[rank]][1], (audit, order[rank])])}
        self.blocks.append(self.turns)
        self.settle()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **self.n, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, turn long, role string, text string"


def ordered(rows: DataFrame) -> DataFrame:
    """Turns with their faults, each conversation whole in one partition and in order, before each of its turns the marks of duplicates there.

    A turn is a duplicate of an earlier one by the digests of role and text, which Spark groups with partial minima: no list of a conversation's turns is kept.
    """
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    key = F.md5(F.concat_ws("\x00", spaced("conv_id"), F.col("conv_id").isNull().cast("string"), F.length("role").cast("string"), "role", "text"))
    said = said.withColumn("key", key)
    firsts = said.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    later = said.select("conv_id", "turn", "key").join(firsts, "key").filter(F.struct("turn") > F.col("first")).select("conv_id", "turn", "key").distinct()
    none = F.lit(None).cast("string")
    marks = later.select("conv_id", "turn", F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), "key", F.lit(False).alias("blank"), F.lit(False).alias("cut"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    turns = said.select("conv_id", "turn", F.lit(1).alias("kind"), "role", "text", "key", blank.alias("blank"), cut.alias("cut"))
    return turns.union(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "kind", "role", "text")


def repaired(rows: DataFrame, turns: bool) -> DataFrame:
    """The stream behind `repair_turns` and `repair_summary`: rows of the one or of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        conv, now, place, marks, last = None, None, 0, set(), None
        width = 1 + len((TURNS if turns else SUMMARY).split(","))

        def emit(edit, turn, role, text):
            nonlocal place, chars
            if turns:
                out.append((conv, place, edit, turn, role, text))
                chars += len(text)
                place += 1

        def closed():
            nonlocal chars
            if now is not None:
                x = now.end()
                if not turns:
                    out.append((conv, *x.values()))
                    chars += len(x["audit"])

        def batch():
            nonlocal out, chars
            b = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
            out, chars = [], 0
            return b

        fields = [f.strip().split() for f in (TURNS if turns else SUMMARY).split(",")]
        names = ["conv_id", *(f[0] for f in fields)]
        types = [None] * width
        for b in batches:
            types[0] = b.schema.field("conv_id").type
            types[1:] = [pa.int64() if f[1] == "long" else pa.string() for f in fields]
            for c, turn, kind, role, text, key, blank, cut in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if now is None or c != conv:
                    closed()
                    conv, now, place, marks, last = c, Repair(emit), 0, set(), None
                if last is not None and last[0] != turn:
                    marks = set()
                if kind == 0:
                    marks.add(key)
                    last = (turn, None)
                    continue
                now.add(turn, role, text, blank, key in marks or last == (turn, key), cut)
                last = (turn, key)
                if len(out) >= OUT_ROWS or chars > OUT_CHARS:
                    yield batch()
        closed()
        if out:
            yield batch()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered(rows).mapInArrow(run, f"conv_id {kind}, {TURNS if turns else SUMMARY}")


def repair_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (Keep, Rerole, Insert, Delete by initial), turn, role, text of every edit of each conversation (conv_id, turn, role, text), cheapest scripts
    first, of those the one whose audit is least in ASCII. Without the rows of edit D it is the repaired conversation.

    Turns are taken in order of turn (nulls first), equal ones by role and text. Nulls in role or text are one space; a null conv_id is a
    conversation. No rows give none; other columns are not read.
    """
    return repaired(rows, True)


def repair_summary(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` of the repaired turns, joined by newlines).

    What is said of order, nulls and empty tables at `repair_turns` holds. All turns null: no gaps.
    """
    return repaired(rows, False)


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it the user's."""
    d = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    d = d.withColumn("kind", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repair_table(rows: DataFrame) -> DataFrame:
    """`repair_summary` of the damaged rows for every conv_id of `rows`; one that lost all its rows has zeros, an empty audit and the hash of nothing."""
    done = repair_summary(damaged(rows)).withColumnRenamed("conv_id", "found")
    ids = rows.select("conv_id").distinct()
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    numbers = [f.split()[0] for f in SUMMARY.split(", ") if f.endswith("long")]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a forward dynamic program over (place, last role), each state's best as a struct of cost, audit and lines, which compare in that order."""

    def plus(state: str, cost: str, edit: str, line: str = "", when: str = "true") -> str:
        lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': ({state}.c + {cost})::BIGINT, 'a': {state}.a || '{edit}', 'r': {lines}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def inserted(source: str) -> str:
        user = least("q2", *[plus(q, "2", "I", "'user:'") for q in ("q0", "q1", "q3")])
        return f"SELECT *, {least('q3', plus('u', '2', 'I', repr('assistant:')))} AS a FROM (SELECT *, {user} AS u FROM {source}) x1"

    def reached(initial: str, name: str, *sources: str) -> list[str]:
        return [plus(q, "2 + t", "R", f"'{name}:' || text", "NOT gone") for q in sources] + [plus(q, "t", "K", "role || ':' || text", f"NOT gone AND p = '{initial}'") for q in sources]

    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: unicode(substr(key, i, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"
    step = f"""SELECT conv_id, i + 1 AS i, {plus("q0", "3", "D")} AS q0, {least(plus("q1", "3", "D"), plus("q0", "t", "K", "role || ':' || text", "NOT gone AND p = 's'"))} AS q1,
  {least(plus("u", "3", "D"), *reached("u", "user", "q0", "q1", "a"))} AS q2, {least(plus("a", "3", "D"), *reached("a", "assistant", "u"))} AS q3
  FROM (SELECT y.*, g.role, g.text, g.gone, g.t, g.p FROM ({inserted("s")}) y JOIN g ON g.conv_id IS NOT DISTINCT FROM y.conv_id AND g.i = y.i + 1) z"""
    return rf"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM said),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM o),
g AS (SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND cut)::BIGINT AS t, substr(role, 1, 1) AS p FROM f),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM g UNION ALL {step}),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(t) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND substr(before, 1, 1) || p NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY conv_id),
e AS (SELECT conv_id, i, list_min([q0, a]) AS best FROM ({inserted("s")}) x)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = n.rows"""


REPAIR_SQL = _sql()

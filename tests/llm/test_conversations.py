"""Conversation repair against a forward dynamic program over whole scripts, and against its SQL."""

import hashlib
import itertools
import random

import duckdb
import pytest

from gradelake.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"


def brute(codes):
    """(cost, audit) least of all scripts: the best of each last role, place by place."""
    best = {0: (0, "")}

    def inserted(b):
        b = dict(b)
        for _ in range(4):
            for q, (c, a) in list(b.items()):
                to = conversations.NEXT[q]
                b[to] = min(b.get(to, (9**9, "")), (c + 2, a + "I"))
        return b

    for initial, gone, cut in codes:
        new = {}
        for q, (c, a) in inserted(best).items():
            options = [(q, c + 3, "D")]
            if not gone:
                options.append((conversations.NEXT[q], c + 2 + cut, "R"))
                if (initial, q) == ("s", 0) or initial == {2: "u", 3: "a"}[conversations.NEXT[q]]:
                    options.append((1 if initial == "s" else conversations.NEXT[q], c + cut, "K"))
            for to, cost, edit in options:
                new[to] = min(new.get(to, (9**9, "")), (cost, a + edit))
        best = new
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def run(turns):
    """The summary and edits of one conversation of (role, blank, duplicate, truncated) by `Repair`."""
    out = []
    r = conversations.Repair(lambda *x: out.append(x))
    for i, (role, blank, dup, cut) in enumerate(turns):
        r.add(i, role, f"t{i}", blank, dup, cut)
    return r.end(), out


def codes(turns):
    return [(role[:1], blank or dup, cut and not blank and not dup) for role, blank, dup, cut in turns]


@pytest.mark.parametrize("block", [1, 2, 5, 512])
def test_search_finds_the_least_script(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    r = random.Random(block)
    for case in range(150):
        n = r.choice([0, 1, 2, 3, 7, 40])
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "user"]), r.random() < 0.1, r.random() < 0.1, r.random() < 0.2) for _ in range(n)]
        got, edits = run(turns)
        assert (got["cost"], got["audit"]) == brute(codes(turns)), (case, turns)
        left = [e for e in edits if e[0] != "D"]
        assert "".join(e[2][:1] for e in left) in ("", *("s" * s + "ua" * k for s in (0, 1) for k in range(1, 60)))
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{e[2]}:{e[3]}" for e in left).encode()).hexdigest()


def test_every_script_of_short_conversations():
    """Against all strings of edits up to a length, judged one by one."""

    def judge(script, turns):
        state, at, cost = 0, 0, 0
        for e in script:
            if e == "I":
                state, cost = conversations.NEXT[state], cost + 2
                continue
            if at == len(turns):
                return None
            initial, gone, cut = turns[at]
            at += 1
            if e == "D":
                cost += 3
                continue
            if gone or (e == "K" and conversations.kept(state, initial) is None):
                return None
            state, cost = (conversations.NEXT[state], cost + 2) if e == "R" else (conversations.kept(state, initial), cost)
            cost += cut
        return (cost, "".join(script)) if at == len(turns) and state in (0, 3) else None

    for turns in itertools.product(itertools.product("sua", (False, True), (False, True)), repeat=2):
        every = [judge(s, turns) for n in range(6) for s in itertools.product("DIKR", repeat=n)]
        cost, _, audit, _ = conversations.search(list(turns), {0: (0, 0)}, conversations.ENDS, True)
        assert (cost, audit) == min(x for x in every if x)


def test_long_conversations_settle_as_they_go(monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 16)
    r = conversations.Repair(lambda *x: None)
    for i in range(5000):
        r.add(i, "user" if i % 2 == 0 else "assistant", "x.", False, i % 50 == 3, i % 7 == 0)
        assert len(r.blocks) <= 2 and len(r.turns) <= 16
    assert len(r.end()["audit"]) >= 5000


def rows_with_oddities():
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", "a b."), (None, None, "user", "x"), (2, 1, "", ""), (2, 5, "system", "S."), (2, 5, "system", "S.")]
    rows += [(3, 1, "user", "a.\n"), (3, 2, "assistant", "b!  "), (3, 2, "tool", "z?"), (4, None, "user", "x."), (5, 9, "user", "long " * 200_000 + "."), (5, 10, "assistant", " "), (6, -3, "assistant", "ends in a dot.\x0b"), (6, 4, "user", "\x00?")]
    r = random.Random(4)
    return rows + [(r.randrange(100, 140), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", None, "Über"]), r.choice([None, "", " ", "a.", "b", "c?\n", f"u{r.random()}."])) for _ in range(900)]


def test_damaged_table_matches_its_sql(spark):
    rows = rows_with_oddities()
    docs = spark.createDataFrame(rows, ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(map(str, con.execute(conversations.REPAIR_SQL).fetchall()))
    for d in (docs, docs.repartition(7).selectExpr("*", "1 as key", "'x' as audit", "2 as kind")):
        assert sorted(str(tuple(r)) for r in conversations.repair_table(d).collect()) == want


def test_turns_of_the_operator(spark):
    rows = [(7, 0, "assistant", "Hello."), (7, 1, "user", "What?"), (7, 2, "user", "What?"), (7, 3, "assistant", "This"), (8, None, "user", " ")]
    got = {}
    for r in conversations.repair_turns(spark.createDataFrame(rows, ROWS)).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.edit, r.turn, r.role, r.text))
    assert sorted(got[7], key=lambda e: e[0]) == [(0, "I", None, "user", ""), (1, "K", 0, "assistant", "Hello."), (2, "K", 1, "user", "What?"), (3, "D", 2, "user", "What?"), (4, "K", 3, "assistant", "This")]
    s = {r.conv_id: r for r in conversations.repair_summary(spark.createDataFrame(rows, ROWS)).collect()}
    assert s[7].audit == "".join(e[1] for e in sorted(got[7], key=lambda e: e[0])) and (s[7].duplicate, s[7].truncated, s[7].illegal) == (1, 1, 1)
    assert (s[8].audit, s[8].cost, s[8].gaps) == ("D", 3, 0)


def test_no_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversations.repair_table(none).count() == 0 and conversations.repair_turns(none).count() == 0

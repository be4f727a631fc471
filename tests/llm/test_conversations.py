"""Conversation repair against trying every edit, and against a plain shortest-path search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from riskfabric.llm import conversation_repair as C

LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(rows, inserts=3):
    """Least (cost, audit, turns) over all edits of (role, text, fault) rows, with up to ``inserts`` turns put in."""
    best = None
    places = range(len(rows) + 1)
    put = [()] + [p for n in range(1, inserts + 1) for p in itertools.combinations_with_replacement(places, n)]
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for e, (*_, f) in zip(edits, rows)):
            continue
        for where in put:
            audit, turns, cost = "", [], 0
            for i in places:
                for _ in range(where.count(i)):
                    audit += "I"
                    turns.append([("user", ""), ("assistant", "")])
                    cost += 5
                if i < len(rows):
                    role, text, fault = rows[i]
                    e = edits[i]
                    audit += e
                    cost += {"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and fault == "truncated" else 0)
                    if e == "K":
                        turns.append([(role, text)])
                    elif e == "R":
                        turns.append([("user", text), ("assistant", text)])
            if best and (cost, audit) >= best[:2]:
                continue
            for made in itertools.product(*turns):
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in made)):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in made))
                    break
    return best


def plain_search(rows):
    """Distances by relaxing all arcs until nothing changes, from the end back: (cost, audit)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    later = None
    for i in range(len(rows), -1, -1):
        here = {q: (0, "") if i == len(rows) and q in (0, 3) else (10**9, "") for q in range(4)}
        changed = True
        while changed:
            changed = False
            for q in range(4):
                ways = [here[q]]
                turns = [step[q, x] for x in "ua" if (q, x) in step]
                ways += [(5 + here[t][0], "I" + here[t][1]) for t in turns]
                if i < len(rows):
                    initial, fault = rows[i]
                    ways.append((2 + later[q][0], "D" + later[q][1]))
                    if fault not in ("blank", "duplicate"):
                        more = 5 * (fault == "truncated")
                        ways += [(1 + more + later[t][0], "R" + later[t][1]) for t in turns]
                        if (q, initial) in step:
                            t = step[q, initial]
                            ways.append((more + later[t][0], "K" + later[t][1]))
                if (w := min(ways)) != here[q]:
                    here[q], changed = w, True
        later = here
    return later[0]


def test_the_audit_is_the_least_of_all_repairs():
    r = random.Random(5)
    kinds = [("system", "hm."), ("user", "a?"), ("assistant", "b!"), ("tool", "x."), ("", "y.")]
    for _ in range(150):
        rows = [(*r.choice(kinds), r.choice(C.FAULTS)) for _ in range(r.randrange(0, 4))]
        want = every_repair(rows)
        assert C.audit_of(bytes(C.code(role[:1], f) for role, _, f in rows)) == want[:2], rows


def test_the_auction_finds_shortest_paths():
    r = random.Random(6)
    for _ in range(400):
        rows = [(r.choice(["s", "u", "a", "t", ""]), r.choice(C.FAULTS + ("",) * 3)) for _ in range(r.randrange(0, 40))]
        assert C.audit_of(bytes(C.code(*x) for x in rows)) == plain_search(rows)


def test_a_long_conversation_takes_time_in_proportion():
    r = random.Random(7)
    rows = bytes(r.randrange(16) for _ in range(60_000))
    cost, audit = C.audit_of(rows)
    assert len(audit) - audit.count("I") == len(rows) and cost > 0


def prices_are_distances(row, later):
    price, _ = C.auction_layer(row, later)
    for q in range(4):  # no arc is shorter than the difference of its prices, and one is as long
        slack = [length + (later[to] if onward else price[to]) - price[q] for _, length, onward, to in C.arcs(row, q)]
        assert min(slack) == 0


def test_converged_prices_leave_no_shorter_arc():
    r = random.Random(8)
    for _ in range(300):
        low = r.randrange(50)
        later = [low + r.randrange(12) for _ in range(4)]
        prices_are_distances(r.randrange(16), later)


def brute(table):
    """All of it row by row: damage, faults, repair."""
    out = []
    for conv in {c for c, *_ in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_search(list(zip(initials, faults)))
        said, at, q = [], 0, 0
        for letter in audit:
            if letter in "IR":
                who, q = ("assistant", 3) if q == 2 else ("user", 2)
                said.append(f"{who}:{rows[at][2] if letter == 'R' else ''}")
            elif letter == "K":
                q = {"s": 1, "u": 2, "a": 3}[initials[at]]
                said.append(f"{rows[at][1]}:{rows[at][2]}")
            at += letter != "I"
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(x) for x in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                               "repaired_sha256").collect()), key=repr)


def frame(spark, table, extra=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    if extra:
        for c in ("copy", "kind", "fault", "audit", "text_sha", "nth", "initial", "gaps"):
            df = df.withColumn(c, F.lit(f"clash {c}"))
    return df


@pytest.fixture(scope="module")
def turns():
    r = random.Random(11)
    table = []
    for conv in [*range(120), None]:
        n = r.choice([1, 2, 3, 5, 8, 30])
        for turn in range(n):
            role = r.choice(["system"] if turn == 0 and r.random() < 0.3 else ["user", "assistant"][turn % 2:] + ["user"])
            role = r.choice([role] * 12 + [None, "", "tool", "User"])
            text = r.choice(["Yes.", "no", "Where?", "done! ", "same words.", "", " \t\n", None, "längerer Satz\x0b", "漢字。", f"{conv} {turn}."])
            table.append((conv, r.choice([turn] * 9 + [None, turn + 1, turn + 40]), role, text))
    return table + table[:15] + [(500, k, "user", "w " * 20_000 + ".") for k in range(3)]


def test_equals_brute_force(shipped, turns):
    assert result(C.repair(frame(shipped, turns).repartition(5))) == brute(turns)


def test_conversations_that_lose_all_rows_and_an_empty_table(shipped):
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    table = [(c, 0, "user", "Gone.") for c in lost]
    assert result(C.repair(frame(shipped, table))) == sorted(((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
                                                                 for c in lost), key=repr)
    assert C.repair(frame(shipped, [])).collect() == []


def test_whole_table(shipped):
    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.001/conversations.parquet"
    table = [tuple(x[c] for c in ("conv_id", "turn", "role", "text")) for x in pq.read_table(path).to_pylist()]
    assert result(C.query(shipped, "/root/testdata/sf0.001")) == brute(table)

"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation's rows and the states of ``(s?(ua)+)?`` span a lattice: node
(i, q) has i rows behind it and state q.  Keeping, re-roling or deleting row i
leads to layer i + 1, inserting a turn stays in the layer; arc lengths are the
edits' integer costs.  Node prices never exceed an arc's length plus the price
behind it (complementary slackness).  An auction grows a path from a node: if
the end node's price is below its best arc it rises to it and the path
contracts, else the path is extended along that arc.  It ends at a node whose
price is final; then the prices on the path are exact distances, too.

Layers are auctioned from the last one back, and a layer's prices start at the
lowest price behind it, which is no more than any distance from there.  So a
price rises a few times only, and all prices converge to the distances.  Then
the arcs without slack are those of the cheapest repairs; each node keeps the
first letter among them, and following these letters from the start spells the
least audit.

Rows are dealt out by conversation and streamed in order.  A task holds a byte
a row and five prices' worth of two layers to find a conversation's audit, and
no text; a second stream hashes the repaired texts as they pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that a re-roled or inserted turn must have in each state, and the state behind it.
TURN = {q: ("a", ASSISTANT) if q == USER else ("u", USER) for q in range(4)}
ROLE = {"u": "user", "a": "assistant"}

#: A row's code: its role's initial (other ones count as one) and its first fault.
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
#: The end of the auction's path: behind the last layer.
_SINK = -1


def code(initial: str, fault: str) -> int:
    i = INITIALS.find(initial) if initial and initial in "sua" else 3
    return 4 * i + FAULTS.index(fault)


def arcs(row: int | None, q: int) -> list[tuple[str, int, int, int]]:
    """(letter, length, layers onward, state behind) of the edits in state q before a row (None: behind the last)."""
    who, behind = TURN[q]
    out = [("I", INSERT, 0, behind)]
    if row is not None:
        initial, fault = INITIALS[row >> 2], FAULTS[row & 3]
        out.append(("D", DELETE, 1, q))
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            out.append(("R", REROLE + more, 1, behind))
            if (q, initial) in STEP:
                out.append(("K", KEEP + more, 1, STEP[q, initial]))
    elif q in ENDS:
        out.append(("", 0, 1, _SINK))
    return sorted(out)


_ARCS = {(row, q): arcs(row, q) for row in [None, *range(16)] for q in range(4)}


def auction_layer(row: int | None, later: list[int]) -> tuple[list[int], bytes]:
    """Exact distances of a layer's four nodes, given those of the layer behind it, and the
    first letter of each node's arcs without slack (0: none, the path ends).  The layer behind
    the last row's is the sink: ``later`` is then [0] * 4."""
    price, final = [min(later)] * 4, [False] * 4
    for origin in range(4):
        path = [origin]
        while not final[path[-1]]:
            q = path[-1]
            best, ahead = None, None
            for _, length, onward, to in _ARCS[row, q]:
                p = length + (later[to] if onward else price[to])
                if best is None or p < best:
                    best, ahead = p, (onward, to)
            if price[q] < best:  # contraction: the price rises to the best arc
                price[q] = best
                if len(path) > 1:
                    path.pop()
            elif ahead[0]:  # extension to a converged node: so are all nodes of the path
                break
            else:  # extension within the layer
                path.append(ahead[1])
        for q in path:
            final[q] = True
    letters = []
    for q in range(4):
        tight = [letter for letter, length, onward, to in _ARCS[row, q]
                 if price[q] == length + (later[to] if onward else price[to])]
        letters.append(ord(tight[0]) if tight[0] else 0)
    return price, bytes(letters)


def audit_of(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation whose rows have these codes."""
    prices, last = auction_layer(None, [0, 0, 0, 0])
    layers = bytearray(4 * len(rows))
    for i in range(len(rows) - 1, -1, -1):
        prices, letters = auction_layer(rows[i], prices)
        layers[4 * i:4 * i + 4] = letters
    layers += last
    out, i, q = bytearray(), 0, START
    while letter := layers[4 * i + q]:
        out.append(letter)
        if letter == ord("K"):
            q = STEP[q, INITIALS[rows[i] >> 2]]
        elif letter != ord("D"):
            q = TURN[q][1]
        i += letter != ord("I")
    return prices[START], out.decode()


# ---------------------------------------------------------------------------
# damage and faults, as DataFrame operations
# ---------------------------------------------------------------------------
_WHITE = r"[\x20\x09-\x0D]"


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, role, text`` after the damage by crc32 of ``conv_id:turn``; a null
    role or text is one space from here on, a null id or turn is one in the hashed text only."""
    kind = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.explode(copies).alias("copy"),
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def _in_order() -> list[Column]:
    """A conversation's order: by turn, nulls first; rows of one turn by role and text, copies adjacent."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text_sha"), F.asc("copy")]


def faulty(rows: DataFrame) -> DataFrame:
    """Damaged rows with ``text_sha`` and the first ``fault`` of each (empty: none)."""
    seen = W.partitionBy("conv_id", "role", "text_sha").orderBy(F.asc_nulls_first("turn"), F.asc("copy"))
    rows = rows.withColumn("text_sha", F.sha2("text", 256)).withColumn("nth", F.row_number().over(seen))
    body = F.regexp_replace("text", _WHITE + r"+\z", "")
    return rows.withColumn("fault", F.when(body == "", F.lit("blank")).when(F.col("nth") > 1, F.lit("duplicate"))
                           .when(~F.substring(body, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))).drop("nth")


_AUDIT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations stream past in order: a row for each, when its last row has passed."""
    solved: dict[bytes, tuple[int, str]] = {}  # short conversations of equal codes
    conv, codes, faults, illegal, before, out = None, bytearray(), [0, 0, 0, 0], 0, None, []
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string())])

    def close():
        rows = bytes(codes)
        found = solved.get(rows) or audit_of(rows)
        if len(rows) <= 16 and len(solved) < 200_000:
            solved[rows] = found
        out.append(dict(zip(schema.names, (conv, *faults[1:], illegal, *found))))
    for batch in batches:
        for c, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if codes and c != conv:
                close()
                codes, faults, illegal, before = bytearray(), [0, 0, 0, 0], 0, None
            conv = c
            codes.append(code(initial, fault))
            faults[FAULTS.index(fault)] += 1
            illegal += before is not None and before + initial not in _LEGAL
            before = initial
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if codes:
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit, then its conversation's rows in order: the repaired text's hash."""
    conv, audit, at, state, sha, any_turn, out, open_ = None, "", 0, START, None, False, [], False

    def say(text: str):
        nonlocal any_turn
        if any_turn:
            sha.update(b"\n")
        sha.update(text.encode())
        any_turn = True

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            who, state = TURN[state]
            say(f"{ROLE[who]}:")
            at += 1

    def close():
        inserts()
        out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for c, a, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if a is not None:
                if open_:
                    close()
                conv, audit, at, state, sha, any_turn, open_ = c, a, 0, START, hashlib.sha256(), False, True
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                who, state = TURN[state]
                say(f"{ROLE[who]}:{text}")
            elif edit == "K":
                state = STEP[state, role[:1]]
                say(f"{role}:{text}")
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if open_:
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``.

    Rows of one turn stand in the order of role and text, so repeated rows are adjacent and all but
    the first are duplicates.  Rows without an id are one conversation (without an id).  Roles count
    by their initial; one that isn't s, u or a is legal nowhere.  A conversation that loses all rows
    has zeros, an empty audit and the empty text's hash.  An empty table gives no rows; other columns
    play no part.  A conversation of any length is streamed, a byte a row being held for its audit.
    """
    given = turns.select("conv_id", "turn", "role", "text")
    rows = written(faulty(damaged(given)), "turns")
    initial = F.substring("role", 1, 1).alias("initial")
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *_in_order())
    audits = written(dealt.select("conv_id", initial, "fault").mapInArrow(_audits, _AUDIT), "audits")
    parts = audits.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("text_sha"), F.lit(0).alias("copy")) \
        .unionByName(rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "text_sha", "copy"))
    streamed = parts.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.desc_nulls_last("audit"), *_in_order())
    hashes = streamed.select("conv_id", "audit", "role", "text").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    gaps = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    none = F.lit(None).cast("long")
    all_parts = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct() \
        .select("conv_id", *[none.alias(c) for c in _COUNTS], F.lit("").alias("audit"), F.lit("").alias("repaired_sha256"))
    for part in (gaps, audits, hashes):
        all_parts = all_parts.unionByName(part.select("conv_id", *[
            (F.col(c) if c in part.columns else none).alias(c) for c in _COUNTS], *[
            (F.col(c) if c in part.columns else F.lit("")).alias(c) for c in ("audit", "repaired_sha256")]))
    sha = F.max("repaired_sha256")
    return all_parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.max("audit").alias("audit"),
        F.when(sha == "", F.sha2(F.lit(""), 256)).otherwise(sha).alias("repaired_sha256"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(turns)

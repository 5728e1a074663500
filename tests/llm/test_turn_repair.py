"""The auction and the repair against dynamic programming and plain loops over small conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlab.llm import common, turn_repair
from claimlab.llm.turn_repair import Turn, chunk_path, crossings, edits, row_arcs

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}


def brute(rows):
    """Least (cost, initials) by relaxing all states until nothing changes; rows are (initial, fault)."""
    best = {0: (0, "")}

    def with_insertions(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(best.items()):
                found = (cost + 3, audit + "I")
                if INSERTED[state] not in best or found < best[INSERTED[state]]:
                    best[INSERTED[state]], changed = found, True
        return best

    for initial, fault in rows:
        after = {}

        def offer(state, cost, audit):
            if state not in after or (cost, audit) < after[state]:
                after[state] = cost, audit

        more = 3 if fault == "truncated" else 0
        for state, (cost, audit) in with_insertions(best).items():
            offer(state, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                if (state, initial) in LEGAL:
                    offer(LEGAL[state, initial], cost + more, audit + "K")
                offer(INSERTED[state], cost + 3 + more, audit + "R")
        best = after
    best = with_insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def expected(table):
    """Contract rows of a table of (conv_id, turn, role, text), by plain loops."""
    held = defaultdict(list)
    for conv_id, turn, role, text in table:
        show = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        rows = held[conv_id]
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        rows.extend([(turn, role, text)] * (2 if code == 3 else 1))
    result = []
    for conv_id, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            words = text.strip(SPACE)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else None
            if fault is None and words[-1] not in ".!?":
                fault = "truncated"
            faults.append(fault)
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = brute([(r[1][:1], f) for r, f in zip(rows, faults)])
        state, left, lines = 0, iter(rows), []
        for edit in audit:
            if edit == "D":
                next(left)
                continue
            role, text = ("?", "") if edit == "I" else next(left)[1:]
            if edit in "IR":
                role = "assistant" if state == 2 else "user"
            state = LEGAL[state, role[:1]]
            lines.append(f"{role}:{text}")
        result.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(result, key=repr)


ROWS = st.lists(st.tuples(st.sampled_from("suatx"), st.sampled_from([None, None, "blank", "duplicate", "truncated"])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_cheapest_edits_and_their_order(rows):
    cost, audit, states = edits([Turn(None, role, "", fault) for role, fault in rows])
    assert (cost, audit) == brute(rows)
    assert len(states) == len(audit)


@settings(max_examples=200, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_chunks_give_the_same_path(rows, size):
    turns = [Turn(None, role, "", fault) for role, fault in rows]
    chunks = []
    for at in range(0, len(turns), size):
        part = turns[at : at + size]
        ways = [
            {"origin": o, "end": e, "cost": cost, "audit": "".join(a for a, _, _ in path)}
            for (o, e), (cost, path) in crossings(*row_arcs(part, closed=False), 4 * len(part)).items()
        ]
        for way in ways:
            way["rank"] = sorted(w["audit"] for w in ways if w["origin"] == way["origin"]).index(way["audit"])
        chunks.append(ways)
    cost, states, tail = chunk_path(chunks)
    audit = "".join(
        next(w["audit"] for w in ways if (w["origin"], w["end"]) == pair) for ways, pair in zip(chunks, states)
    )
    assert (cost, audit + tail) == brute(rows)


def test_prices_prove_the_cost():
    rows = [Turn(i, "ua"[i % 3 == 1], f"{i}", "truncated" if i % 5 == 0 else None) for i in range(300)]
    arcs, prices = row_arcs(rows, closed=True)
    end = len(arcs) - 1
    arcs = turn_repair.leading_to(arcs, end)
    cost = turn_repair.auction(arcs, prices, 0, end)
    assert all(prices[i] <= c + prices[j] for i, leaving in enumerate(arcs) for _, c, j in leaving)
    assert prices[0] - prices[end] == cost == brute([(r.role, r.fault) for r in rows])[0]


def odd_rows():
    rows = [(None, None, None, None), (None, 3, "user", "No id."), (1, None, "user", "Null turn."), (1, 1, None, "x"), (2, 1, "", "y.")]
    rows += [(3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "tie."), (3, 2, "system", "late\n\n")]
    rows += [(4, i, "system" if i == 0 else "user" if i % 2 else "assistant", "Long text. " * 20_000) for i in range(5)]
    rows += [(5 + i, 0, "user", "Alone.") for i in range(60)]  # some conversations lose their only row
    rows += [(-7, -(2**40), "user", "Early."), (-7, 2**40, "assistant", "Late.")]
    return rows


def as_rows(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("large, chunk", [(1024, 256), (3, 2)])
def test_odd_rows(spark, large, chunk):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Text_ string").repartition(5)
    found = turn_repair.repaired_conversations(turn_repair.damaged(table), large, chunk)
    assert as_rows(found) == expected(rows)


def test_one_large_conversation(spark):
    draw = random.Random(1)
    texts = ["Yes.", "No!", "cut", "Why?", " ", "Well."]
    rows = [(9, i // 2, draw.choice(["user", "assistant", "system"]), f"{draw.choice(texts)} {i % 40}.") for i in range(1500)]
    rows += [(9, 7, "user", "copy.")] * 900 + [(9, None, "assistant", "copy.")] * 5 + [(8, 1, "user", "Small.")]
    rows += [(None, i, "user", f"{i}!") for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = turn_repair.repaired_conversations(turn_repair.damaged(table), 50, 32)
    assert as_rows(found) == expected(rows)


def test_empty_table(spark):
    assert as_rows(turn_repair.repaired_conversations(turn_repair.damaged(spark.createDataFrame([], SCHEMA)))) == []


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(turn_repair.repair_digest(spark, sf_dir)) == expected(rows)

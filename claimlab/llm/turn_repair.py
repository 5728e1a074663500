"""Repair of conversations whose turns were lost, emptied, cut off, repeated or given a wrong role.

The rows of a conversation and the state that the repaired text is in (nothing yet, after the system turn, after
a user, after an assistant) span a lattice. Keeping, reroling and deleting a row lead to the next row, inserting
an empty turn leads to another state of the same row. A cheapest repair is a shortest path from the first row to
the end, in a state in which the conversation may end. It is found by an auction: a path grows from the origin
along the arc that costs least with the price of its end; where the price of the path's last node is below that,
the price rises to it and the path loses the node. Prices begin at the costs that the rows ahead force, so they
rise only for what the order of roles adds. When the path reaches the end, every arc of every cheapest path
is tight under the prices, and of these paths the one whose edits have the ASCII-least initials is traced.

A conversation of at most `large` rows lies in one task, which streams conversations that are sorted there. Rows
of larger ones are sorted by range over all tasks and cut into chunks of at most `chunk` rows. A chunk's lattice
gives the least cost, and the least initials, between each of the four states before and after it; its prices serve all
four origins of one end. The chunks of a conversation then form a lattice of their own, with the same auction:
labels are ranks of initials among those that leave one state, and as no such initials begin other ones, comparing
ranks compares the whole. Rows with equal role and text are marked by a join on their digest, and equal rows
are counted before, so neither a large conversation nor a large group of copies meets in one task.
Only `digest` reads a large conversation's repaired rows in order, as SHA-256 asks; it holds one row at a time.

Defined results: null conv_id is a conversation of its own; a null turn, role or text reads as one space, a null
turn comes first and has no part in gaps; rows of one turn are ordered by role and text; equal rows count each, as
duplicates from the second on; other columns are not read; an empty table gives no row. A role without
characters has no initial and can't be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common

LARGE, CHUNK = 1024, 256
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES, ENDS = 4, (0, 3)
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that an inserted or reroled turn gets, and the state after it.
_NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
_FAULTS = ("blank", "duplicate", "truncated")

#: Arcs of each node, as (label, cost, end).
Arcs = list[list[tuple]]


# --- The auction -------------------------------------------------------------------------------------------


def auction(arcs: Arcs, prices: list[int], origin: int, end: int) -> int:
    """The least cost from origin to end; `prices` are raised until they prove it.

    The prices must satisfy price <= cost + price of the arc's end everywhere, every node must lead to the end,
    and every cycle must cost something.
    """
    path = [origin]
    while path[-1] != end:
        node = path[-1]
        least, nearest = min((cost + prices[to], to) for _, cost, to in arcs[node])
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(nearest)
    return prices[origin] - prices[end]


def traced(arcs: Arcs, prices: list[int], origin: int, end: int) -> list[tuple]:
    """The tight path whose labels come first, as (label, node before, node after)."""

    def tight(node: int) -> Iterator[tuple]:
        return iter(sorted((a for a in arcs[node] if prices[node] == a[1] + prices[a[2]]), key=lambda a: a[0]))

    path, ways, seen = [], [(origin, tight(origin))], {origin}
    while ways[-1][0] != end:
        node, left = ways[-1]
        arc = next((a for a in left if a[2] not in seen), None)
        if arc is None:
            ways.pop()  # tight, but leads no further
            path.pop()
        else:
            seen.add(arc[2])
            path.append((arc[0], node, arc[2]))
            ways.append((arc[2], tight(arc[2])))
    return path


def leading_to(arcs: Arcs, end: int) -> Arcs:
    """The arcs that lie on a way to the end."""
    before: list[list[int]] = [[] for _ in arcs]
    for node, leaving in enumerate(arcs):
        for _, _, to in leaving:
            before[to].append(node)
    reached, waiting = {end}, [end]
    while waiting:
        for node in before[waiting.pop()]:
            if node not in reached:
                reached.add(node)
                waiting.append(node)
    return [[a for a in leaving if a[2] in reached] if node in reached else [] for node, leaving in enumerate(arcs)]


# --- Lattices ----------------------------------------------------------------------------------------------


@dataclass
class Turn:
    turn: int | None
    role: str
    text: str
    fault: str | None

    @property
    def forced(self) -> int:
        """What this row costs in any repair."""
        return 0 if self.fault is None else CUT_OFF if self.fault == "truncated" else DELETE


def row_arcs(rows: list[Turn], closed: bool) -> tuple[Arcs, list[int]]:
    """Arcs and first prices; node `STATES * i + q` stands before row i in state q.

    A closed lattice goes on to one last node, by way of turns inserted behind the last row; an open one ends
    in the four states after its last row.
    """
    arcs: Arcs = [[] for _ in range(STATES * (len(rows) + 1) + closed)]
    prices = [0] * len(arcs)
    ahead = 0
    for i in range(len(rows), -1, -1):
        at = STATES * i
        row = rows[i] if i < len(rows) else None
        ahead += row.forced if row else 0
        for state in range(STATES):
            leaving, (_, following) = arcs[at + state], _NEXT[state]
            prices[at + state] = ahead
            if row is not None or closed:
                leaving.append(("I", INSERT, at + following))
            if row is None:
                if closed and state in ENDS:
                    leaving.append(("", 0, len(arcs) - 1))
                continue
            leaving.append(("D", DELETE, at + STATES + state))
            if row.fault in ("blank", "duplicate"):
                continue
            more = CUT_OFF if row.fault else 0
            kept = _AFTER.get(row.role[:1], {}).get(state)
            if kept is not None:
                leaving.append(("K", KEEP + more, at + STATES + kept))
            leaving.append(("R", REROLE + more, at + STATES + following))
    return arcs, prices


def edits(rows: list[Turn]) -> tuple[int, str, list[int]]:
    """Least cost, initials of the edits, and the state before each of them."""
    arcs, prices = row_arcs(rows, closed=True)
    end = len(arcs) - 1
    arcs = leading_to(arcs, end)
    cost = auction(arcs, prices, 0, end)
    path = traced(arcs, prices, 0, end)[:-1]
    return cost, "".join(label for label, _, _ in path), [node % STATES for _, node, _ in path]


def crossings(arcs: Arcs, prices: list[int], last: int) -> dict[tuple[int, int], tuple[int, list[tuple]]]:
    """Least cost and least path between each state before the first and after the last stage of an open lattice."""
    found = {}
    for state in range(STATES):
        end = last + state
        held, rising = leading_to(arcs, end), prices.copy()
        for origin in range(STATES):
            if held[origin] or origin == end:
                # Prices that an earlier origin has raised are still valid for this end.
                cost = auction(held, rising, origin, end)
                found[origin, state] = cost, traced(held, rising, origin, end)
    return found


def repaired(rows: list[Turn], initials: str, states: list[int]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits."""
    left = iter(rows)
    for edit, state in zip(initials, states):
        row = Turn(None, "", "", None) if edit == "I" else next(left)
        if edit != "D":
            yield (row.role if edit == "K" else _NEXT[state][0]), row.text


def joined_turns(turns: Iterable[tuple[str, str]]) -> Iterator[bytes]:
    """The bytes of `role:text` lines, in parts."""
    for i, (role, text) in enumerate(turns):
        yield f"{chr(10) if i else ''}{role}:{text}".encode("utf-8", "replace")


# --- Rows --------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the copies of each row that the damage leaves: 0, 1 or 2."""
    space = F.lit(" ")
    part = lambda name: F.coalesce(F.col(name).cast("string"), space)
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    there = F.col("copies") > 0
    # A row that is dropped only says that its conversation exists.
    return rows.select("conv_id", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")


_CHUNK_FIELDS = (
    "conv_id long, part int, seq int, n long, blank long, duplicate long, truncated long, illegal long, first string,"
    " last string, low long, high long, turns long, cost long, audit string, repaired_sha256 string,"
    " rows array<struct<turn:long,role:string,text:string,fault:string>>,"
    " ways array<struct<origin:int,end:int,cost:long,rank:int,audit:string,states:binary>>"
)
_PATHS = "conv_id long, part int, seq int, origin int, end int, cost long, tail string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_TURN = pa.struct([("turn", pa.int64()), *((name, pa.string()) for name in ("role", "text", "fault"))])
_WAY = pa.struct([
    ("origin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string()),
    ("states", pa.binary()),
])


def _arrow_schema(fields: str) -> pa.Schema:
    """The Arrow schema of a list of fields; workers have no session that could read it."""
    named = (part.split(" ", 1) for part in fields.split(", "))
    nested = {"rows": pa.list_(_TURN), "ways": pa.list_(_WAY)}
    return pa.schema([(name, nested[name] if name in nested else _ARROW[kind]) for name, kind in named])


@dataclass
class Tally:
    """What counting needs from one row to the next."""

    n: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(_FAULTS, 0))

    def add(self, row: Turn) -> None:
        initial = row.role[:1]
        self.illegal += self.n > 0 and self.last + initial not in _LEGAL
        self.first, self.last = (initial if self.n == 0 else self.first), initial
        self.n += 1
        if row.fault:
            self.faults[row.fault] += 1
        if row.turn is not None:
            self.turns += row.turn != self.high  # rows come by turn
            self.low, self.high = (row.turn if self.low is None else self.low), row.turn

    def follow(self, other: Tally) -> None:
        """Take in the tally of the rows behind these."""
        if not other.n:
            return
        self.illegal += other.illegal + (self.n > 0 and self.last + other.first not in _LEGAL)
        self.first, self.last = (other.first if self.n == 0 else self.first), other.last
        self.n += other.n
        self.turns += other.turns - (other.low is not None and other.low == self.high)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        for name in _FAULTS:
            self.faults[name] += other.faults[name]

    def columns(self) -> dict:
        names = ("n", "illegal", "turns", "low", "high", "first", "last")
        return {name: getattr(self, name) for name in names} | self.faults

    @classmethod
    def of(cls, row: dict) -> Tally:
        names = ("n", "illegal", "turns", "low", "high", "first", "last")
        return cls(**{name: row[name] for name in names}, faults={name: row[name] for name in _FAULTS})

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def fault_of(role: str, text: str, seen: bool) -> str | None:
    text = text.rstrip(_SPACE)
    if not text:
        return "blank"
    if seen:
        return "duplicate"
    return None if text[-1] in ".!?" else "truncated"


def _whole(conv_id: int | None, rows: list[Turn]) -> dict:
    """The result of a conversation that is held whole."""
    tally, digest = Tally(), hashlib.sha256()
    for row in rows:
        tally.add(row)
    cost, initials, states = edits(rows)
    for part in joined_turns(repaired(rows, initials, states)):
        digest.update(part)
    found = {"cost": cost, "audit": initials, "repaired_sha256": digest.hexdigest()}
    return {"conv_id": conv_id, **tally.columns(), **found}


def _open(conv_id: int | None, part: int, seq: int, rows: list[Turn]) -> dict:
    """A chunk of a large conversation with the ways through it."""
    tally = Tally()
    for row in rows:
        tally.add(row)
    arcs, prices = row_arcs(rows, closed=False)
    ways = []
    for (origin, end), (cost, path) in crossings(arcs, prices, STATES * len(rows)).items():
        states = bytes(node % STATES for _, node, _ in path)
        ways.append({"origin": origin, "end": end, "cost": cost, "audit": "".join(a for a, _, _ in path), "states": states})
    for origin in range(STATES):
        order = sorted((w for w in ways if w["origin"] == origin), key=lambda w: w["audit"])
        for rank, way in enumerate(order):
            way["rank"] = rank
    held = [{"turn": r.turn, "role": r.role, "text": r.text, "fault": r.fault} for r in rows]
    return {"conv_id": conv_id, "part": part, "seq": seq, **tally.columns(), "ways": ways, "rows": held}


def _batches(results: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in results:
        held.append(row)
        weight += 1 + len(row.get("rows") or ())
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _small(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task can hold, one at a time."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(_CHUNK_FIELDS)

        def results() -> Iterator[dict]:
            held: list[Turn] = []
            seen: set[tuple[str, str]] = set()
            current, begun = None, False
            for conv_id, turn, role, text, copies in _columns(batches):
                if not begun or conv_id != current:
                    if begun:
                        yield _whole(current, held)
                    current, begun, held = conv_id, True, []
                    seen.clear()
                for _ in range(copies):
                    held.append(Turn(turn, role, text, fault_of(role, text, (role, text) in seen)))
                    seen.add((role, text))
            if begun:
                yield _whole(current, held)

        yield from _batches(results(), schema)

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "turn", "role", "text", "copies").mapInArrow(solve, _CHUNK_FIELDS)


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Chunks of large conversations, which may lie over any number of tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), _arrow_schema(_CHUNK_FIELDS)

        def results() -> Iterator[dict]:
            held: list[Turn] = []
            seq, current = 0, None
            for conv_id, turn, role, text, copies, seen in _columns(batches):
                for copy in range(copies):
                    if held and (conv_id != current or len(held) >= chunk):
                        yield _open(current, part, seq, held)
                        held, seq = [], seq + 1
                    current = conv_id
                    held.append(Turn(turn, role, text, fault_of(role, text, seen or copy > 0)))
            if held:
                yield _open(current, part, seq, held)

        yield from _batches(results(), schema, 4 * chunk)

    # Rows that are equal, and copies over many tasks with them, combine before the shuffle.
    counted = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    counted = common.saved(counted.withColumn("key", key))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = counted.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(
        F.count("*").alias("places"), F.min(place).alias("earliest")
    )
    repeated = repeated.where("places > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    later = F.coalesce(place != F.col("earliest"), F.lit(False)).alias("seen")
    marked = counted.join(repeated, same, "left").select("conv_id", "turn", "role", "text", "copies", later)
    order = ["conv_id", "turn", "role", "text"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _CHUNK_FIELDS)


def chunk_path(ways: list[list[dict]]) -> tuple[int, list[tuple[int, int]], str]:
    """Least cost through all chunks, the states before and after each, and the turns inserted behind the last."""
    # The cheapest way through a chunk is paid in any case.
    forced = [min(w["cost"] for w in chunk) for chunk in ways]
    arcs: Arcs = [[] for _ in range(STATES * (len(ways) + 1) + 1)]
    prices = [0] * len(arcs)
    end = len(arcs) - 1
    for i, chunk in enumerate(ways):
        for way in chunk:
            arcs[STATES * i + way["origin"]].append((way["rank"], way["cost"], STATES * (i + 1) + way["end"]))
    for state in range(STATES):
        missing = 0 if state in ENDS else 1 if state == 2 else 2
        arcs[STATES * len(ways) + state].append((0, INSERT * missing, end))
    ahead = 0
    for i in range(len(ways) - 1, -1, -1):
        ahead += forced[i]
        prices[STATES * i : STATES * (i + 1)] = [ahead] * STATES
    arcs = leading_to(arcs, end)
    cost = auction(arcs, prices, 0, end)
    path = traced(arcs, prices, 0, end)
    last = path[-1][1] % STATES
    return cost, [(a % STATES, b % STATES) for _, a, b in path[:-1]], "" if last in ENDS else "I" if last == 2 else "II"


def _large(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Results of large conversations without their digest, and their repaired turns in order."""
    chunks = common.saved(_chunks(rows, chunk))

    def solve(group: pa.Table) -> pa.Table:
        held = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        cost, states, tail = chunk_path([r["ways"] for r in held])
        schema, found = _arrow_schema(_PATHS), []
        for i, (row, (origin, end)) in enumerate(zip(held, states)):
            last = i == len(held) - 1
            found.append({
                "conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "origin": origin, "end": end,
                "cost": cost if last else None, "tail": tail if last else "",
            })
        return pa.Table.from_pylist(found, schema)

    def tallied(group: pa.Table) -> pa.Table:
        total, rows = Tally(), sorted(group.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        for row in rows:
            total.follow(Tally.of(row))
        audit = "".join(row["audit"] + row["tail"] for row in rows)
        cost = rows[-1]["cost"]
        found = {"conv_id": rows[0]["conv_id"], **total.columns(), "cost": cost, "audit": audit}
        return pa.Table.from_pylist([found], _arrow_schema(_CHUNK_FIELDS))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, part, seq, rows, audit, states, tail, origin in _columns(batches):
            turns = repaired([Turn(**r) for r in rows], audit, list(states))
            held = list(turns) + [(("user", "assistant")[(i + len(tail)) % 2], "") for i in range(len(tail))]
            names = ["conv_id", "part", "seq", "at", "role", "text"]
            values = list(zip(*((conv_id, part, seq, i, r, t) for i, (r, t) in enumerate(held)))) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(values, types)], names=names)

    # The lattice of chunks carries four numbers a way, one row for each chunk.
    narrow = chunks.select("conv_id", "part", "seq", F.expr("transform(ways, w -> struct(w.origin, w.end, w.cost, w.rank))").alias("ways"))
    paths = common.saved(narrow.groupBy("conv_id").applyInArrow(solve, _PATHS))
    chosen = F.expr("filter(ways, w -> w.origin = p.origin and w.end = p.end)[0]")
    same = (F.col("c.part") == F.col("p.part")) & (F.col("c.seq") == F.col("p.seq"))
    both = chunks.drop("cost", "audit").alias("c").join(paths.alias("p"), same).withColumn("way", chosen)
    counts = both.select("c.conv_id", "c.part", "c.seq", "n", "illegal", "turns", "low", "high", "first", "last", *_FAULTS,
                         "p.cost", "way.audit", "tail")
    results = counts.groupBy("conv_id").applyInArrow(tallied, _CHUNK_FIELDS)
    turns = both.select("c.conv_id", "c.part", "c.seq", "rows", "way.audit", "way.states", "tail", "p.origin")
    return results, turns.mapInArrow(applied, "conv_id long, part int, seq int, at int, role string, text string")


def digest(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines; a task reads them in order, one at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, count = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([current], pa.int64()), pa.array([state.hexdigest()])], names=["id", "sha"])

        for conv_id, role, text in _columns(batches):
            if state is None or conv_id != current:
                if state is not None:
                    yield done()
                state, current, count = hashlib.sha256(), conv_id, 0
            state.update(f"{chr(10) if count else ''}{role}:{text}".encode("utf-8", "replace"))
            count += 1
        if state is not None:
            yield done()

    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "at")
    return placed.select("conv_id", "role", "text").mapInArrow(read, "id long, sha string")


def repaired_conversations(rows: DataFrame, large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, copies; no copies only name it).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    sizes = rows.groupBy(F.col("conv_id").alias("id")).agg(F.sum("copies").alias("n"))
    hot = common.saved(sizes.where(F.col("n") > large))
    is_hot = F.col("conv_id").eqNullSafe(F.col("id"))
    results = _small(rows.join(hot, is_hot, "left_anti")) if not hot.isEmpty() else _small(rows)
    names = ["conv_id", "n", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "cost", "audit"]
    results = results.select(*names, "repaired_sha256")
    if not hot.isEmpty():
        found, turns = _large(rows.join(hot, is_hot, "left_semi"), chunk)
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        found = found.select(*names).join(digest(turns), is_hot, "left").select(*names, F.coalesce("sha", empty).alias("repaired_sha256"))
        results = results.unionByName(found)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    return results.select("conv_id", gaps, *_FAULTS, "illegal", "cost", "audit", "repaired_sha256")


def repair_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all conversations."""
    return repaired_conversations(damaged(common.table(spark, sf_dir, "conversations")))

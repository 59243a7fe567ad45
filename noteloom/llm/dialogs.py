"""Conversation structure repair by a bidirectional tight-arc DAG.

A conversation has to read ``(s?(ua)+)?`` by the initials of its roles: an optional system message, then pairs of
user and assistant. Rows may be kept, given another role, deleted, or empty messages inserted, each at a cost. The
nodes of the DAG are (rows read, state of the pattern), its arcs the edits. Minimum costs from the start
(forward) and to the end (backward) tell which arcs lie on a cheapest path: those whose forward cost, own cost and
backward cost sum to the total are tight. A traversal with a frontier set over tight arcs takes the least edit letter at each
step, so of all cheapest edits the ASCII-least string is found.

Rows are dealt over tasks by (conversation, turn, role, text hash, a salt), so a conversation of any length is cut over
many tasks, and within a task into blocks of BLOCK_ROWS rows or BLOCK_BYTES. A conversation that is one block inside a task is
solved there. Blocks of the others meet in two steps: texts seen in an earlier block by digest, first of each block
only; then each block becomes a min-plus matrix over the four states, and the matrices of a conversation, some 300 bytes for
each block, are multiplied forward and backward. With both vectors every block finds its tight arcs and the letters from each
state it may be entered in; which one it is follows from the blocks before.

Defined results: rows are ordered by turn, nulls first, then role and a hash of the text, so that repeated rows are adjacent; a
null role or text counts as one space; rows for which ``dropped`` holds are as if absent, but their conversation is
reported; a null conv_id is a conversation of its own; empty texts are blank rows; very long texts are blocks of their own; equal rows
are duplicates after the first; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, parts, ship

#: States: nothing yet, after system, after user, after assistant. What an initial leads to, and which role can be put in.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 50
#: A row's kind is its initial's place here times three, plus its fault.
INITIALS, FINE, CUT_OFF, GONE = "sua", 0, 1, 2
#: Rows and bytes of text after which a block is closed.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 17
SPACE = r"\x20\x09-\x0D"

Vector = tuple[int, int, int, int]
ENTER: Vector = (0, NEVER, NEVER, NEVER)
LEAVE: Vector = tuple(0 if q in ACCEPTED else NEVER for q in range(4))


@lru_cache(1 << 10)
def arcs(kind: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the (letter, cost, next state) of what may be done with a row of the kind."""
    initial, fault = (INITIALS + "?")[kind // 3], kind % 3
    out = []
    for q in range(4):
        held = [("D", DELETE, q)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT_OFF else 0
            if initial in STEP[q]:
                held.append(("K", KEEP + more, STEP[q][initial]))
            held.append(("R", REROLE + more, NEXT[q]))
        out.append(tuple(held))
    return tuple(out)


def _inserted(v: list[int]) -> list[int]:
    """Forward costs of a layer, insertions included; two of them lead back to where they began, at a cost."""
    for _ in range(2):
        for q in range(4):
            v[NEXT[q]] = min(v[NEXT[q]], v[q] + INSERT)
    return v


def _inserting(v: list[int]) -> list[int]:
    """Backward costs of a layer, insertions included."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def forward(kinds: bytes, enter: Vector, last: bool) -> list[list[int]]:
    """Least costs from the start to each state of each layer; insertions of the layer after the last row are the next block's."""
    layers = [_inserted(list(enter)) if kinds or last else list(enter)]
    for i, kind in enumerate(kinds):
        after = [NEVER] * 4
        for q, held in enumerate(arcs(kind)):
            for _, cost, to in held:
                after[to] = min(after[to], layers[-1][q] + cost)
        layers.append(_inserted(after) if last or i + 1 < len(kinds) else after)
    return layers


def backward(kinds: bytes, leave: Vector, last: bool) -> list[list[int]]:
    """Least costs from each state of each layer to the end."""
    layers = [_inserting(list(leave)) if last else list(leave)]
    for kind in reversed(kinds):
        here = [min(cost + layers[-1][to] for _, cost, to in held) for held in arcs(kind)]
        layers.append(_inserting(here))
    return layers[::-1]


def matrix(kinds: bytes) -> list[int]:
    """Least costs of a block from each state to each, row by row."""
    return [x for p in range(4) for x in forward(kinds, tuple(0 if q == p else NEVER for q in range(4)), False)[-1]]


def times(v: Vector, m: list[int]) -> Vector:
    return tuple(min(NEVER, *(v[p] + m[4 * p + q] for p in range(4))) for q in range(4))


def behind(m: list[int], v: Vector) -> Vector:
    return tuple(min(NEVER, *(m[4 * p + q] + v[q] for q in range(4))) for p in range(4))


def paths(kinds: bytes, enter: Vector, leave: Vector, last: bool) -> dict[int, tuple[str, int]]:
    """For each state of the first layer that lies on a cheapest path: the least letters over tight arcs, and the state they end in."""
    ahead, back = forward(kinds, enter, last), backward(kinds, leave, last)
    total, n = min(a + b for a, b in zip(ahead[0], back[0], strict=True)), len(kinds)

    def tight(i: int, q: int) -> Iterator[tuple[str, int, int]]:
        if i < n:
            for letter, cost, to in arcs(kinds[i])[q]:
                if ahead[i][q] + cost + back[i + 1][to] == total:
                    yield letter, i + 1, to
        if (i < n or last) and ahead[i][q] + INSERT + back[i][NEXT[q]] == total:
            yield "I", i, NEXT[q]

    out = {}
    for p in range(4):
        if enter[p] >= NEVER or enter[p] + back[0][p] != total:
            continue
        frontier, letters = {(0, p)}, []
        while found := [arc for node in frontier for arc in tight(*node)]:
            least = min(letter for letter, _, _ in found)
            letters.append(least)
            frontier = {(i, q) for letter, i, q in found if letter == least}
        out[p] = "".join(letters), min(q for _, q in frontier)
    return out


@lru_cache(1 << 16)
def solve(kinds: bytes) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return min(backward(kinds, LEAVE, True)[0][START], NEVER), paths(kinds, ENTER, LEAVE, True)[START][0]


def mend(roles: list[str], texts: list[str], edits: str, state: int = START) -> list[tuple[str, str]]:
    """The (role, text) that edits make of the rows, from a state of the pattern on."""
    out, i = [], 0
    for letter in edits:
        if letter == "D":
            i += 1
            continue
        state = STEP[state][roles[i][:1]] if letter == "K" else NEXT[state]
        out.append((roles[i] if letter == "K" else ROLES[state], "" if letter == "I" else texts[i]))
        i += letter != "I"
    return out


def row_fault(text: Column) -> Column:
    """1 for a blank text, 2 for one whose last character other than white space ends no sentence, else 0."""
    return F.when(~text.rlike(f"[^{SPACE}]"), 1).when(text.rlike(rf"[.!?][{SPACE}]*\z"), 0).otherwise(2)


#: A block: its place, counts, the edges that its neighbours need, and its rows; edits are null until they are known.
COUNTS = ("blank", "duplicate", "truncated", "illegal")
BLOCK = (
    "at long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "least_turn long, most_turn long, turns long, first_turn long, last_turn long, cost long, state int, edits string, roles array<string>, texts array<string>, faults binary, digests array<binary>"
)
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[dict], schema: str, key: pa.DataType | None = None) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {name: key if kind == "key" else _ARROW[kind] for name, kind in fields}
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()], list(kinds))


def judge(roles: list[str], texts: list[str], faults: bytes, seen: set[bytes], digests: list[bytes]) -> tuple[bytes, dict]:
    """The rows' kinds, and how many have each fault first; what is in ``seen`` was there before, and the rows' digests join it."""
    kinds, counts = bytearray(), dict.fromkeys(COUNTS, 0)
    for role, fault, digest in zip(roles, faults, digests, strict=True):
        if fault == 1:
            counts["blank"] += 1
        elif digest in seen:
            counts["duplicate"] += 1
        elif fault == 2:
            counts["truncated"] += 1
        gone = fault == 1 or digest in seen
        seen.add(digest)
        kinds.append(3 * "sua?".index(role[:1] if role[:1] in ("s", "u", "a") else "?") + (GONE if gone else CUT_OFF if fault == 2 else FINE))
    counts["illegal"] = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    return bytes(kinds), counts


def _turns(turns: list[int | None]) -> dict:
    held = [t for t in turns if t is not None]
    return {"least_turn": held[0] if held else None, "most_turn": held[-1] if held else None, "turns": len(set(held)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task as blocks; conversations that may go on in another task, or that are longer than a block, stay open."""
    part, seq = TaskContext.get().partitionId(), 0
    key, kind, out, size = None, None, [], 0
    held: dict[str, list] = {"turn": [], "role": [], "text": [], "fault": []}
    weight, blocks, first = 0, 0, True

    def closed(whole: bool) -> dict:
        nonlocal seq, weight, blocks
        roles, texts, faults = held["role"], held["text"], bytes(held["fault"])
        row = {"conv_id": key, "at": part << 32 | seq, "whole": whole, "rows": len(roles), "state": START, "roles": roles, "texts": texts}
        row |= {"first_initial": roles[0][:1] if roles else None, "last_initial": roles[-1][:1] if roles else None, **_turns(held["turn"])}
        if whole:  # texts themselves tell duplicates
            kinds, counts = judge(roles, texts, faults, set(), list(zip(roles, texts, strict=True)))
            cost, edits = solve(kinds)
            row |= {**counts, "cost": cost, "edits": edits, "faults": None, "digests": None}
        else:
            digests = [hashlib.blake2b(f"{key}\0{len(r)}\0{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
            row |= {**dict.fromkeys(COUNTS), "cost": None, "edits": None, "faults": faults, "digests": digests}
        seq, weight, blocks = seq + 1, 0, blocks + 1
        for name in held:
            held[name] = []
        return row

    def finished(whole: bool) -> None:
        nonlocal blocks, size
        if blocks == 0 or held["role"]:
            size += weight
            out.append(closed(whole and blocks == 0))
        blocks = 0

    started = False
    for batch in batches:
        kind = batch.column(0).type
        ids, n = batch.column(0), batch.num_rows
        if not n:
            continue
        codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
        edges = [0, *(int(i) + 1 for i in (codes[1:] != codes[:-1]).nonzero()[0]), n]
        turn, role, text, fault, kept = (batch.column(k).to_pylist() for k in range(1, 6))
        for lo, hi in zip(edges, edges[1:]):
            name = ids[lo].as_py()
            if started and name != key:
                finished(not first)
                first = False
            key, started = name, True
            for i in range(lo, hi):
                if not kept[i]:
                    continue
                held["turn"].append(turn[i])
                held["role"].append(role[i])
                held["text"].append(text[i])
                held["fault"].append(fault[i])
                weight += len(text[i])
                if len(held["role"]) >= BLOCK_ROWS or weight >= BLOCK_BYTES:
                    size += weight
                    out.append(closed(False))
            if len(out) >= 500 or size > 4 * BLOCK_BYTES:
                yield _batch(out, "conv_id key, " + BLOCK, kind)
                out, size = [], 0
    if started:
        finished(False)
    if out:
        yield _batch(out, "conv_id key, " + BLOCK, kind)


def blocks(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id and BLOCK of rows(conv_id, turn, role, text)."""
    ship(rows.sparkSession)
    held = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if dropped is None else ~F.coalesce(dropped, F.lit(False))).alias("kept"),
    )
    held = held.withColumn("text", F.when(F.col("kept"), F.col("text")).otherwise(F.lit("")))
    held = held.select("conv_id", "turn", "role", "text", row_fault(F.col("text")).cast("int").alias("fault"), "kept", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_salt"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "_hash", "_salt"]
    dealt = held.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return cut(dealt.mapInArrow(_blocks, f"conv_id {kind}, {BLOCK}"), "dialog-blocks")


PART = "conv_id key, at long, kinds binary, matrix array<long>, rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, least_turn long, most_turn long, turns long, first_turn long, last_turn long"
CHAIN = "conv_id key, at long, enter array<long>, leave array<long>, last boolean, cost long, rows long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            kinds, counts = judge(row["roles"], row["roles"], row["faults"], set(row["seen"] or ()), row["digests"])
            out.append(row | counts | {"kinds": kinds, "matrix": matrix(kinds)})
        yield _batch(out, PART, batch.schema.field("conv_id").type)


def _chain(table: pa.Table) -> pa.Table:
    """Forward and backward costs at the edges of a conversation's blocks, and its counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    total = {name: sum(r[name] for r in rows) for name in ("rows", *COUNTS, "turns")}
    full = [r for r in rows if r["rows"]]
    for a, b in zip(full, full[1:]):
        total["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
        total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    known = [r for r in rows if r["turns"]]
    total |= {"least_turn": known[0]["least_turn"] if known else None, "most_turn": known[-1]["most_turn"] if known else None}
    enter, v = [], ENTER
    for r in rows:
        enter.append(v)
        v = times(v, r["matrix"])
    v = LEAVE
    leave, ending = [], tuple(_inserting(list(LEAVE)))
    for k, r in enumerate(reversed(rows)):
        leave.append(v)
        v = behind(r["matrix"], ending if k == 0 else v)
    out = [{"conv_id": r["conv_id"], "at": r["at"], "enter": e, "leave": b, "last": r is rows[-1], "cost": v[START], **total} for r, e, b in zip(rows, enter, reversed(leave), strict=True)]
    return pa.Table.from_batches([_batch(out, CHAIN, table.schema.field("conv_id").type)])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            found = paths(row["kinds"], tuple(row["enter"]), tuple(row["leave"]), row["last"])
            out.append({"conv_id": row["conv_id"], "at": row["at"], "letters": [found.get(p, ("", -1))[0] for p in range(4)], "ends": [found.get(p, ("", -1))[1] for p in range(4)]})
        yield _batch(out, "conv_id key, at long, letters array<string>, ends array<int>", batch.schema.field("conv_id").type)


def _states(table: pa.Table) -> pa.Table:
    state, out = START, []
    for row in sorted(table.to_pylist(), key=lambda r: r["at"]):
        out.append({"at": row["at"], "state": state})
        state = row["ends"][state]
    return pa.Table.from_batches([_batch(out, "at long, state int")])


def repair(rows: DataFrame, dropped: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, edited) of rows(conv_id, turn, role, text).

    reports(conv_id, gaps, blank, duplicate, truncated, illegal, cost): one row for each conversation. edited(conv_id, at, state, edits,
    roles, texts): its blocks in order of ``at``, with the letters of the cheapest edits (K keep, R another role, D delete, I insert) and the
    state of the pattern in which they begin; ``messages`` and ``digests`` make the repaired rows of them.
    """
    stored = blocks(rows, dropped)
    kind = rows.schema["conv_id"].dataType.simpleString()
    typed = lambda schema: schema.replace("conv_id key", f"conv_id {kind}")
    whole, opened = stored.filter("whole"), stored.filter("not whole")
    entries = opened.select("at", F.explode(F.array_distinct("digests")).alias("digest"))
    first = entries.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("latest")).filter("first < latest")
    seen = entries.join(first, "digest").filter("at > first").groupBy("at").agg(F.collect_list("digest").alias("seen"))
    summed = opened.select("conv_id", "at", "rows", "first_initial", "last_initial", "least_turn", "most_turn", "turns", "first_turn", "last_turn", "roles", "faults", "digests").join(seen, "at", "left")
    parts_ = cut(summed.mapInArrow(_summaries, typed(PART)), "dialog-parts")
    chain = cut(parts_.drop("kinds").groupBy("conv_id").applyInArrow(_chain, typed(CHAIN)), "dialog-chain")
    ways = cut(parts_.select("at", "kinds").join(chain, "at").mapInArrow(_ways, typed("conv_id key, at long, letters array<string>, ends array<int>")), "dialog-ways")
    states = ways.select("conv_id", "at", "ends").groupBy("conv_id").applyInArrow(_states, "at long, state int")
    edits = ways.join(states, "at").select("at", "state", F.get("letters", F.col("state")).alias("edits"))
    columns = ["conv_id", "at", "state", "edits", "roles", "texts"]
    edited = whole.select(*columns).withColumn("alone", F.lit(True)).unionByName(opened.drop("state", "edits").join(edits, "at").select(*columns).withColumn("alone", F.lit(False)))
    totals = ["conv_id", *COUNTS, "cost", "least_turn", "most_turn", "turns"]
    reports = whole.select(*totals).unionByName(chain.filter("last").select(*totals))
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return reports.select("conv_id", gaps.alias("gaps"), *COUNTS, "cost"), edited


def messages(edited: DataFrame) -> DataFrame:
    """(conv_id, at, place, role, text): the repaired rows; (at, place) is their order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv_id": r["conv_id"], "at": r["at"], "place": k, "role": role, "text": text} for r in batch.to_pylist() for k, (role, text) in enumerate(mend(r["roles"], r["texts"], r["edits"], r["state"]))]
            yield _batch(out, "conv_id key, at long, place int, role string, text string", batch.schema.field("conv_id").type)

    kind = edited.schema["conv_id"].dataType.simpleString()
    return edited.select("conv_id", "at", "state", "edits", "roles", "texts").mapInArrow(work, f"conv_id {kind}, at long, place int, role string, text string")


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): all edit letters, and the digest of the repaired ``role:text`` joined by newlines.

    Blocks of one conversation pass through one task, one after the other, as a digest is a chain; none is held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, state, schema = None, False, None, None
        name = "conv_id key, audit string, repaired_sha256 string"

        def done() -> dict:
            return {"conv_id": key, "audit": "".join(state[0]), "repaired_sha256": state[1].hexdigest()}

        for batch in batches:
            schema, out = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != key:
                    if begun:
                        out.append(done())
                    key, begun, state = row["conv_id"], True, [[], hashlib.sha256(), False]
                state[0].append(row["edits"])
                for role, text in mend(row["roles"], row["texts"], row["edits"], row["state"]):
                    state[1].update(f"{chr(10) if state[2] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    state[2] = True
            if out:
                yield _batch(out, name, schema)
        if begun:
            yield _batch([done()], name, schema)

    kind = edited.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "state", "edits", "roles", "texts"]
    ordered = edited.filter("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "at").select(*columns)
    schema = f"conv_id {kind}, audit string, repaired_sha256 string"
    return edited.filter("alone").select(*columns).mapInArrow(work, schema).unionByName(ordered.mapInArrow(work, schema))

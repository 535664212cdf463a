"""Conversation repair: cheapest edits that make a conversation's roles alternate, by Hirschberg's divide and conquer."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .work import saved

#: White space of the faults: space and the control characters from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: What edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the pattern (s?(ua)+)? by the last role kept: none, system, user, assistant; the next state for each role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
#: Inserts that bring each state to one that may end, after the last row.
ENDS = ("", "II", "I", "")
#: Rows of a conversation that one task divides; longer conversations are divided at the bounds of such blocks first.
BLOCK = 2048

Moves = list[tuple[int, int, int, object]]
Vector = tuple[tuple[int, int] | None, ...]


def _moves(code: int) -> Moves:
    """(from, to, cost, edits) of all edits of one row and inserts before it; of equal ends the cheapest, then least.

    code: the role's place in "sua" (3 for others), plus 4 for a truncated row, 8 for one that must go.
    """
    role, kind, best = "sua?"[code % 4], code // 4, {}
    for start in range(4):
        at, cost, edits = start, 0, ""
        for _ in range(3):
            tries = [(at, DELETE, "D")]
            if kind < 2:
                late = TRUNCATED * kind
                tries += [(NEXT[at][role], late, "K")] if role in NEXT[at] else []
                tries += [(NEXT[at][r], REROLE + late, "R") for r in "ua" if r in NEXT[at]]
            for to, more, edit in tries:
                best[start, to] = min(best.get((start, to), (1 << 60, "")), (cost + more, edits + edit))
            at, cost, edits = next(NEXT[at][r] for r in "ua" if r in NEXT[at]), cost + INSERT, edits + "I"
    return [(p, q, *found) for (p, q), found in best.items()]


ROWS: list[Moves] = [_moves(code) for code in range(12)]


def _forward(vector: Vector, moves: Moves) -> tuple[int, Vector]:
    """One step of the four costs from the front: (what all states gained, costs above that and places in order).

    A place says which of the states' least edits come first. No state's edits begin with another's, as all end with a
    row's own edit, so places and what is added decide every later tie.
    """
    best = {}
    for p, q, cost, added in moves:
        if vector[p]:
            found = (vector[p][0] + cost, vector[p][1], added)
            if q not in best or found < best[q]:
                best[q] = found
    order = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][1:]))}
    low = min(x[0] for x in best.values())
    return low, tuple((best[q][0] - low, order[q]) if q in best else None for q in range(4))


def _backward(costs: tuple, moves: Moves) -> tuple:
    """One step of the four costs from the back."""
    best = [None] * 4
    for p, q, cost, _ in moves:
        if costs[q] is not None and (best[p] is None or costs[q] + cost < best[p]):
            best[p] = costs[q] + cost
    low = min(x for x in best if x is not None)
    return tuple(None if x is None else x - low for x in best)


#: Costs above the least and places take few different values, so each step over a row is made once in a worker.
_ahead = lru_cache(maxsize=1 << 16)(lambda vector, code: _forward(vector, ROWS[code]))
_behind = lru_cache(maxsize=1 << 16)(lambda costs, code: _backward(costs, ROWS[code]))


def _from(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def crossings(n: int, ahead, behind, start: int, end: int) -> list[int]:
    """The states before, between and after ``n`` items of the audit-least cheapest way from ``start`` to ``end``.

    Forward costs of the first half meet backward costs of the second; of the cheapest crossings, the state whose
    edits so far come first is taken, and both halves are divided again. At any time four costs per direction are held.
    """
    states, todo = [start, *[0] * (n - 1), end] if n else [start], [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        front = _from(states[low])
        for i in range(low, middle):
            front = ahead(front, i)[1]
        back = tuple(0 if s == states[high] else None for s in range(4))
        for i in range(high - 1, middle - 1, -1):
            back = behind(back, i)
        states[middle] = min((f[0] + b, f[1], s) for s, (f, b) in enumerate(zip(front, back, strict=True)) if f and b is not None)[2]
        todo += [(low, middle), (middle, high)]
    return states


@lru_cache(maxsize=1 << 14)
def transfer(codes: bytes) -> tuple[list[int], list[int]]:
    """Cost and place of a block for each start and end state, -1 where there is no way."""
    costs, places = [], []
    for start in range(4):
        vector, total = _from(start), 0
        for code in codes:
            low, vector = _ahead(vector, code)
            total += low
        costs += [-1 if x is None else total + x[0] for x in vector]
        places += [-1 if x is None else x[1] for x in vector]
    return costs, places


def join_blocks(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """(cost, states at the blocks' bounds) of a whole conversation, from its blocks' transfers in order."""
    moves = [[(k // 4, k % 4, c, places[k]) for k, c in enumerate(costs) if c >= 0] for costs, places in blocks]
    vector, total = _from(0), 0
    for m in moves:
        low, vector = _forward(vector, m)
        total += low
    cost, _, end = min((x[0] + INSERT * len(ENDS[s]), x[1], s) for s, x in enumerate(vector) if x)
    return total + cost, crossings(len(moves), lambda v, i: _forward(v, moves[i]), lambda c, i: _backward(c, moves[i]), 0, end)


@lru_cache(maxsize=1 << 14)
def edits(codes: bytes, start: int, end: int) -> list[str]:
    """The edits of each row of a block between two states, inserts before the row included."""
    states = crossings(len(codes), lambda v, i: _ahead(v, codes[i]), lambda c, i: _behind(c, codes[i]), start, end)
    tails = [{(p, q): e for p, q, _, e in m} for m in ROWS]
    return [tails[code][p, q] for code, p, q in zip(codes, states, states[1:], strict=False)]


def key(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes its stops out, 3 repeats it, 4 makes its role user. A null is one space, in the key, too."""
    n = F.crc32(key(F.col("conv_id"), F.col("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("_n") == 1, "").when(F.col("_n") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("_n") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", n.alias("_n")).filter("_n <> 0")
    row = F.struct("conv_id", "turn", role.alias("role"), text.alias("text"))
    return own.select(F.explode(F.array_repeat(row, F.when(F.col("_n") == 3, 2).otherwise(1))).alias("r")).select("r.*")


@dataclass
class Repair:
    """turns: conv_id, part, block, k (their order), edit, role, text of the repaired rows; stats: a row for each
    conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost; audits: conv_id, audit."""

    turns: DataFrame
    stats: DataFrame
    audits: DataFrame


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCKS = "part int, block int, conv_id long, codes binary, uids array<long>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role int, last_role int"


def _cut(batches, size: int):
    """Rows in order (conv_id, turn, role, kind, uid) as blocks of one conversation and ``size`` rows at most."""
    import pyspark

    part, number, open_, done = pyspark.TaskContext.get().partitionId(), 0, None, []
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("conv_id", pa.int64()), ("codes", pa.binary()), ("uids", pa.list_(pa.int64())), *[(c, pa.int64()) for c in (*_COUNTS, "turns", "first_turn", "last_turn")], ("first_role", pa.int32()), ("last_role", pa.int32())])

    def close():
        nonlocal number, open_
        done.append({**open_, "part": part, "block": number, "codes": bytes(open_["codes"])})
        number, open_ = number + 1, None

    for b in batches:
        for conv, turn, role, kind, uid in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "r", "kind", "uid")), strict=True):
            if open_ and (open_["conv_id"] != conv or len(open_["codes"]) >= size):
                close()
            if not open_:
                open_ = {"conv_id": conv, "codes": bytearray(), "uids": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first_turn": None, "last_turn": None, "first_role": role, "last_role": None}
            else:
                open_["illegal"] += not legal(open_["last_role"], role)
            open_["codes"].append(role + (0, 4, 8, 8)[kind])
            open_["uids"].append(uid)
            for k, name in enumerate(("truncated", "blank", "duplicate"), 1):
                open_[name] += kind == k
            if turn is not None and turn != open_["last_turn"]:
                open_["turns"] += 1
                open_["last_turn"] = turn
                open_["first_turn"] = turn if open_["first_turn"] is None else open_["first_turn"]
            open_["last_role"] = role
        if len(done) >= 4096:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if open_:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def legal(a: int, b: int) -> bool:
    """Whether role b may follow role a: user after system or assistant, assistant after user."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


_STATES = "part int, block int, conv_id long, entry int, exit int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _solve(batches):
    """States at the bounds of each block, and a conversation's sums on its last block, of blocks in order."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("conv_id", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")]])
    held, out = [], []

    def close():
        cost, states = join_blocks([(h["costs"], h["places"]) for h in held])
        own = {c: sum(h[c] for h in held) for c in _COUNTS}
        own["illegal"] += sum(not legal(a["last_role"], b["first_role"]) for a, b in zip(held, held[1:], strict=False))
        dated = [h for h in held if h["turns"]]
        turns = sum(h["turns"] for h in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
        own["gaps"] = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0
        for k, h in enumerate(held):
            end = k == len(held) - 1
            out.append({"part": h["part"], "block": h["block"], "conv_id": h["conv_id"], "entry": states[k], "exit": states[k + 1], "last": end, **(own | {"cost": cost} if end else {})})
        held.clear()

    for b in batches:
        for row in b.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                close()
            held.append(row)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(turns: DataFrame, block: int = BLOCK) -> Repair:
    """The cheapest edits of each conversation (conv_id, turn, role, text) that make its roles system?, (user, assistant)*.

    Rows come by turn, null first, then role and the digest of their text. Keep costs 0, a new role 1, deletion 2,
    an inserted empty turn 5, an undeleted truncated row 5; blank rows and those of a role and text seen earlier must go. Of
    equally cheap edits, those whose initials come first (D, I, K, R) are taken. Roles other than user, assistant and
    system count by their first letter.

    A null role or text counts as one space, a null conv_id is a conversation of its own, a null turn comes first; an
    empty table has no conversations; other columns are not read. Rows are sorted over all tasks and cut into blocks of
    ``block`` rows, so a long conversation is many blocks, and each is edited by itself once its end states are known; what one
    task gets of a conversation is 16 costs for each of its blocks.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = saved(own.withColumn("uid", F.monotonically_increasing_id()), "repair-turns")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(trimmed == "", 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    firsts = own.select("conv_id", "role", digest, F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"), "uid").alias("at")).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    marked = own.select("conv_id", "turn", "role", digest, "uid", fault.alias("fault")).join(firsts.select(F.col("at.uid").alias("uid"), F.lit(True).alias("first")).hint("merge"), "uid", "left")
    kind = F.when((F.col("fault") != 2) & F.col("first").isNull(), 3).otherwise(F.col("fault"))
    head = F.substring("role", 1, 1)
    r = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    ordered = marked.select("conv_id", "turn", "role", "digest", "uid", kind.alias("kind"), r.alias("r")).orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "uid")
    blocks = saved(ordered.select("conv_id", "turn", "r", "kind", "uid").mapInArrow(lambda b: _cut(b, block), _BLOCKS), "repair-blocks")

    def weigh(batches):
        for b in batches:
            found = [transfer(c) for c in b.column("codes").to_pylist()]
            kept = b.drop_columns(["codes"])
            yield pa.record_batch([*kept.columns, pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=[*kept.schema.names, "costs", "places"])

    light = [f for f in _BLOCKS.split(", ") if not f.startswith("uids")]
    made = ", ".join(f for f in light if not f.startswith("codes")) + ", costs array<long>, places array<int>"
    weighed = blocks.select(*(f.split()[0] for f in light)).mapInArrow(weigh, made)
    states = saved(weighed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_solve, _STATES), "repair-states")

    def rebuild(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("k", pa.int32()), ("edit", pa.string()), ("uid", pa.int64()), ("role", pa.string())])
        for b in batches:
            out = []
            for row in b.to_pylist():
                head = (row["conv_id"], row["part"], row["block"])
                found = edits(row["codes"], row["entry"], row["exit"])
                state, k, end = row["entry"], 0, ENDS[row["exit"]] if row["last"] else ""
                out.append((*head, -1, "".join(found) + end, None, None))
                for code, uid, some in [*zip(row["codes"], row["uids"], found, strict=True), (3, None, end)]:
                    for e in some:
                        if e == "D":
                            continue
                        letter = "sua?"[code % 4] if e == "K" else next(x for x in "ua" if x in NEXT[state])
                        out.append((*head, k, e, None if e == "I" else uid, None if e == "K" else NAMES[letter]))
                        state, k = NEXT[state][letter], k + 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    ways = blocks.select("conv_id", "part", "block", "codes", "uids").join(states.select("part", "block", "entry", "exit", "last").hint("merge"), ["part", "block"])
    ways = ways.select("conv_id", "part", "block", "codes", "uids", "entry", "exit", "last")
    done = saved(ways.mapInArrow(rebuild, "conv_id long, part int, block int, k int, edit string, uid long, role string"), "repair-edits")
    rows = done.filter("k >= 0")
    texts = own.select("uid", F.col("role").alias("own"), "text").hint("merge")
    columns = ["conv_id", "part", "block", "k", "edit"]
    kept = rows.filter("uid is not null").join(texts, "uid").select(*columns, F.coalesce("role", "own").alias("role"), "text")
    result = kept.union(rows.filter("uid is null").select(*columns, "role", F.lit("").alias("text")))
    parts = done.filter("k < 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "block", "edit"))).alias("parts"))
    audits = parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["edit"]), "").alias("audit"))
    return Repair(result, states.filter("last").select("conv_id", "gaps", *_COUNTS, "cost"), audits)


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's ``role:text`` lines, joined by line feeds.

    SHA-256 has to read a conversation in order, so its lines go by one task, as a stream: a batch is held at a time.
    """

    def run(batches):
        conv, own = None, None
        for b in batches:
            out = []
            for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if own is None or c != conv:
                    if own is not None:
                        out.append((conv, own.hexdigest()))
                    conv, own = c, hashlib.sha256(line.encode())
                else:
                    own.update(b"\n")
                    own.update(line.encode())
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["conv_id", "sha256"])
        if own is not None:
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([own.hexdigest()])], names=["conv_id", "sha256"])

    lines = turns.select("conv_id", "part", "block", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "k").select("conv_id", "line").mapInArrow(run, "conv_id long, sha256 string")


def digest(turns: DataFrame, found: Repair) -> DataFrame:
    """A row for each conv_id of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. One without rows to repair has zeros, an empty audit and the hash of an empty string."""
    names = ("gaps", *_COUNTS, "cost")
    sides = [turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), found.stats, found.audits, text_digests(found.turns)]
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side, allowMissingColumns=True)
    summed = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*names, "audit", "sha256")])
    return summed.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

"""Conversation structure repair: the least edits that make a conversation's roles `(s?(ua)+)?`, by a tight-arc DAG.

A node is (rows read, state of the role automaton); arcs keep, rerole or delete the next row or insert an empty turn.
Minimum costs from the start (forward) and to the end (backward) tell which arcs lie on some cheapest path: those whose
forward cost, own cost and backward cost add up to the least total. A walk with the frontier of nodes that the least
letters so far lead to takes the least letter of a tight arc at each step, which gives the ASCII-least cheapest edits.

A conversation may be longer than a task should hold, so that costs go by pieces: rows get global positions, BLOCK
positions are a block, and a conversation's rows in a block are a piece. A piece is a row of codes, a byte a turn, and
a matrix of least costs from state to state; matrices add up (min, +) over pieces from both ends. Given both costs at
its borders, a piece maps a start state to an end state; the maps chained give every piece its start, and then each
piece writes its edits. (The automaton is deterministic and a letter fixes the role that it writes, so that frontiers
at borders hold one state.) Texts move once, to stream in order through a running digest that holds no row.

Defined cases: null role and text are one space, as are a null conv_id and turn in the damage key. Rows with null
conv_id form a conversation; null turns come first and don't count for gaps. Rows of one turn go by role, then by a
digest of text, repeated ones side by side. Roles count by their first character; an empty or other role has none of
s, u and a. A conversation of dropped rows alone has zeros, no edits and the digest of nothing. Other columns aren't
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_batches, stable, stored
from factorloom.operators.ordering import with_position

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the contract: rerole or insert, delete, and what an undeleted truncated turn adds.
CHANGE, DELETE, TRUNCATED = 3, 4, 3
NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant. A turn of initial s, u or a (1, 2, 3) leads on.
ALLOWED = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
ACCEPTED, STATES = (0, 3), range(4)
ROLES = {2: "user", 3: "assistant"}
#: A code is 4 * fault + initial (0 for others); a dropped row has GONE.
SOUND, BLANK, DUPLICATE, CUT, GONE = 0, 1, 2, 3, 16
ORDER = ["conv_id", "turn", "role", "digest", "row", "copy"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, row, copy, gone of conversations' rows after the contract's damage; row is a number,
    and a dropped row is kept as gone, so that its conversation isn't lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = stable(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    plain = plain.withColumn("row", F.monotonically_increasing_id()).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), "row", copies.alias("copy"), (F.col("kind") == 0).alias("gone"))


def intact(rows: DataFrame) -> DataFrame:
    """The same of conversations' rows as they are."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = stable(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")))
    return plain.select("*", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


# -- the graph of one piece


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the arcs that read a row of `code`."""
    fault, initial = divmod(code, 4)
    out = [("D", state, DELETE)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    if (state, initial) in ALLOWED:
        out.append(("K", ALLOWED[state, initial], more))
    return out + [("R", ALLOWED[state, new], CHANGE + more) for new in ROLES if (state, new) in ALLOWED]


ARCS = [[arcs(code, q) for q in STATES] for code in range(GONE)]
INSERTS = [[ALLOWED[q, new] for new in ROLES if (q, new) in ALLOWED] for q in STATES]


def times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """(min, +) product."""
    return [[min(x + y for x, y in zip(row, column)) for column in zip(*b)] for row in a]


def inserting() -> list[list[int]]:
    """Least costs of inserts alone, from state to state."""
    one = [[0 if p == q else CHANGE if q in INSERTS[p] else NEVER for q in STATES] for p in STATES]
    two = times(one, one)
    return times(two, two)


CLOSURE = inserting()


def reading(code: int) -> list[list[int]]:
    """Least costs of reading a row of `code`, then inserting."""
    row = [[min((c for _, to, c in ARCS[code][p] if to == q), default=NEVER) for q in STATES] for p in STATES]
    return times(row, CLOSURE)


READING = [reading(code) for code in range(GONE)]


def across(vector: list[int], matrix: list[list[int]]) -> list[int]:
    return times([vector], matrix)[0]


def back(matrix: list[list[int]], vector: list[int]) -> list[int]:
    return [min(x + y for x, y in zip(row, vector)) for row in matrix]


BEGIN = across([0 if q == 0 else NEVER for q in STATES], CLOSURE)
END = back(CLOSURE, [0 if q in ACCEPTED else NEVER for q in STATES])


@lru_cache(maxsize=20_000)
def matrix_of(codes: bytes) -> list[list[int]]:
    """Least costs of all rows of a piece."""
    out = CLOSURE
    for code in codes:
        if code != GONE:
            out = times(out, READING[code])
    return out


def walk(codes: bytes, forward: list[int], backward: list[int], start: int, last: bool) -> tuple[list[tuple[list[int], str, int]], list[int], int]:
    """Edits of a piece: for each row, the roles inserted before it, its letter and the state it leads to (a dropped row
    has none); the roles inserted after all; the state at the end. forward and backward are least costs before the
    first row and after the last, start the state before; last says that no piece follows.
    """
    rows = [c for c in codes if c != GONE]
    ahead, behind = [forward], [backward]
    for code in rows:
        ahead.append(across(ahead[-1], READING[code]))
    for code in reversed(rows):
        behind.append(back(CLOSURE, back(READING[code], behind[-1])))
    behind.reverse()
    total = min(x + y for x, y in zip(forward, behind[0]))

    def tight(i: int, j: int, p: int, q: int, cost: int) -> bool:
        return ahead[i][p] + cost + behind[j][q] == total

    frontier, steps, after = {start}, [], []
    inserted = lambda i: {q for p in frontier for q in INSERTS[p] if tight(i, i, p, q, CHANGE)}
    for i, code in enumerate(rows):
        before: list[int] = []
        while True:
            to: dict[str, set[int]] = {"I": inserted(i)}
            for p in frontier:
                for letter, q, cost in ARCS[code][p]:
                    if tight(i, i + 1, p, q, cost):
                        to.setdefault(letter, set()).add(q)
            letter = min(k for k, states in to.items() if states)
            frontier = to[letter]
            if letter != "I":
                break
            before.append(max(frontier))
        steps.append((before, letter, max(frontier)))
    while last and not frontier & set(ACCEPTED):
        frontier = inserted(len(rows))
        after.append(max(frontier))
    reading_on, out = iter(steps), []
    for code in codes:
        out.append(([], "", 0) if code == GONE else next(reading_on))
    return out, after, max(frontier)


# -- pieces, borders and edits as tables

PIECES = "conv_id long, first long, codes binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, begins int, ends int, least long, most long, turns long"


def flags(rows: DataFrame) -> DataFrame:
    """Order columns, pos and code of every row, at its place in the order of all conversations."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3)) for x in pair]), F.substring("role", 1, 1)), F.lit(0))
    keys = rows.select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), "row", "copy", "gone", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), initial.alias("initial"))
    placed = stored(with_position(keys, ORDER, "pos"), "turns")
    first = placed.filter("not gone").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    code = F.when(F.col("gone"), GONE).otherwise(4 * fault + F.col("initial")).cast("int")
    return placed.join(first, "pos", "left").select("pos", *ORDER, code.alias("code"))


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that follow each other with equal keys."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def made(schema: str, rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.record_batch([pa.array(c, kinds[s.split()[1]]) for c, s in zip(columns, schema.split(", "))], names)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def task(schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], most: int = 2000) -> tuple[Callable, str]:
    """A mapInArrow function of what yields rows, and its schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in f(batches):
            rows.append(row)
            if len(rows) == most:
                yield made(schema, rows, KINDS)
                rows = []
        yield made(schema, rows, KINDS)

    return run, schema


def legal(p: int, q: int) -> bool:
    return (p, q) in ((1, 2), (2, 3), (3, 2))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row per piece: its codes, costs and counts."""
    for (_, conv_id), rows in by_key(batches, "block", "conv_id"):
        rows = list(rows)  # BLOCK at most
        codes = bytes(r["code"] for r in rows)
        held = [c for c in codes if c != GONE]
        turns = [r["turn"] for r in rows if r["code"] != GONE and r["turn"] is not None]
        faults, initials = [c // 4 for c in held], [c % 4 for c in held]
        illegal = sum(not legal(p, q) for p, q in zip(initials, initials[1:]))
        costs = [x for row in matrix_of(codes) for x in row]
        yield (conv_id, rows[0]["pos"], codes, costs, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, initials[0] if held else None, initials[-1] if held else None, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


BORDERS = "conv_id long, first long, forward array<long>, backward array<long>, place int, pieces int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Least costs before the first and after the last row of every piece; a conversation's counts are at its first."""
    for (conv_id,), rows in by_key(batches, "conv_id"):
        rows = list(rows)  # a row of numbers for BLOCK turns
        matrices = [[r["costs"][k : k + 4] for k in (0, 4, 8, 12)] for r in rows]
        forward, backward = [BEGIN], [END]
        for m in matrices[:-1]:
            forward.append(across(forward[-1], m))
        for m in matrices[:0:-1]:
            backward.append(back(m, backward[-1]))
        backward.reverse()
        cost = min(x + y for x, y in zip(BEGIN, back(matrices[0], backward[0])))
        held = [r for r in rows if r["begins"] is not None]
        timed = [r for r in rows if r["least"] is not None]
        illegal = sum(r["illegal"] for r in rows) + sum(not legal(x["ends"], y["begins"]) for x, y in zip(held, held[1:]))
        turns = sum(r["turns"] for r in timed) - sum(x["most"] == y["least"] for x, y in zip(timed, timed[1:]))
        gaps = timed[-1]["most"] - timed[0]["least"] + 1 - turns if timed else 0
        counts = (gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, cost)
        for k, r in enumerate(rows):
            yield (conv_id, r["first"], forward[k], backward[k], k, len(rows), *(counts if k == 0 else [None] * 6))


def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The state that each piece of several leads to from each state that a cheapest path may be in."""
    for b in batches:
        for r in b.to_pylist():
            least = min(x + y for x, y in zip(r["forward"], back(matrix_of(r["codes"]), r["backward"])))
            onward = back(matrix_of(r["codes"]), r["backward"])
            yield r["conv_id"], r["first"], [walk(r["codes"], r["forward"], r["backward"], q, False)[2] if r["forward"][q] + onward[q] == least else -1 for q in STATES]


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The state in which each piece of several starts."""
    for _, rows in by_key(batches, "conv_id"):
        state = 0
        for r in rows:
            yield r["first"], state
            state = r["to"][state]


EDITS = "pos long, letters string, before string, new_role string, kept int, after string"


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What becomes of every row: its letters, the turns inserted before it, its new role if it has one, whether it
    stays, and the turns inserted after it at the end."""
    lines = lambda states: "\n".join(f"{ROLES[q]}:" for q in states) if states else None
    for b in batches:
        for r in b.to_pylist():
            last = r["place"] == r["pieces"] - 1
            steps, after, _ = walk(r["codes"], r["forward"], r["backward"], r["state"] or 0, last)
            final = max((k for k, (_, letter, _) in enumerate(steps) if letter), default=-1)
            for k, (before, letter, to) in enumerate(steps):
                if letter:
                    tail = after if k == final else []
                    yield r["first"] + k, "I" * len(before) + letter + "I" * len(tail), lines(before), ROLES[to] if letter == "R" else None, int(letter != "D"), lines(tail)
            if final < 0 and after:  # dropped rows alone: no turn follows the edit
                yield r["first"], "I" * len(after), lines(after), None, -1, None


DIGESTS = "conv_id long, audit string, repaired_sha256 string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Letters and the running digest of every conversation's turns, each after its edit."""
    for (conv_id,), rows in by_key(batches, "conv_id"):
        letters, state, any_yet, edit = [], hashlib.sha256(), False, None
        for r in rows:
            if r["kind"] == 0:
                edit = r
                letters.append(r["letters"])
                if edit["kept"] >= 0:
                    continue
            turn = f"{edit['new_role'] if edit['new_role'] is not None else r['role']}:{r['text']}" if edit["kept"] > 0 else None
            for line in (edit["before"], turn, edit["after"]):
                if line is not None:
                    state.update(("\n" if any_yet else "").encode() + line.encode())
                    any_yet = True
        yield conv_id, "".join(letters), state.hexdigest()


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows as of damaged or intact."""
    small_batches(rows.sparkSession)
    coded = stored(flags(rows), "coded")
    dealt = coded.select("pos", "conv_id", "turn", "code", F.floor(F.col("pos") / block).alias("block")).repartition("block").sortWithinPartitions("block", "pos")
    pieces = stored(dealt.mapInArrow(*task(PIECES, cut)), "pieces")
    numbers = pieces.drop("codes").repartition("conv_id").sortWithinPartitions("conv_id", "first")
    bordered = stored(numbers.mapInArrow(*task(BORDERS, borders)), "borders")
    whole = pieces.select("first", "codes").join(bordered.select("conv_id", "first", "forward", "backward", "place", "pieces"), "first")
    mapped = whole.filter("pieces > 1").mapInArrow(*task("conv_id long, first long, to array<int>", maps))
    states = mapped.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(*task("first long, state int", chain))
    done = coded.join(whole.join(states, "first", "left").mapInArrow(*task(EDITS, edits)), "pos")
    marks = done.select(*ORDER, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "letters", "before", "new_role", "kept", "after")
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("letters", "string"), ("before", "string"), ("new_role", "string"), ("kept", "int"), ("after", "string"))]
    turns = rows.filter("not gone").select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), "row", "copy", F.lit(1).alias("kind"), "text", *empty)
    in_order = marks.unionByName(turns).repartition("conv_id").sortWithinPartitions(*ORDER, "kind")
    said = in_order.select("conv_id", "role", "kind", "text", "letters", "before", "new_role", "kept", "after").mapInArrow(*task(DIGESTS, digests))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = bordered.filter("place = 0").select("conv_id", *counts).alias("a").join(said.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    return found.select("a.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of conversations (conv_id, turn, role, text) after the contract's damage."""
    return repair(damaged(conversations))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of conversations (conv_id, turn, role, text) as they are."""
    return repair(intact(conversations))

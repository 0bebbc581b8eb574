import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import repair as rp

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, letters, repaired) by Dijkstra over (cost, letters), so that the first way to the end is the least."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, said, out = heapq.heappop(heap)
        if (i, said[:1] == "s", said.endswith(("u", "a")) and said[-1], bool(said)) in done:
            continue
        done.add((i, said[:1] == "s", said.endswith(("u", "a")) and said[-1], bool(said)))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, letters, "\n".join(out)

        def go(letter, more, to, initial="", line=None, cost=cost, letters=letters, said=said, out=out):
            now = said + initial
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, letters + letter, to, now, out if line is None else (*out, line)))

        for name in ("user", "assistant"):
            go("I", 3, i, name[0], f"{name}:")
        if i < len(rows):
            (role, text), fault = rows[i], found[i]
            go("D", 4, i + 1)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go("K", more, i + 1, role[0], f"{role}:{text}")
                for name in ("user", "assistant"):
                    go("R", 3 + more, i + 1, name[0], f"{name}:{text}")
    raise AssertionError


def brute(rows):
    """The contract's rows, by conversation. Ties of turn are as the operator states them."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    after, out = damage(rows), []
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        said = [r[1:] for r in mine]
        found = faults(said)
        turns = [r[0] for r in mine if r[0] is not None]
        illegal = sum(p[0][:1] + q[0][:1] not in ("su", "ua", "au") for p, q in zip(said, said[1:]))
        cost, letters, text = cheapest(said, found)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha(text)))
    return sorted(out, key=str)


def got(found):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found.columns == names
    return sorted(map(tuple, found.collect()), key=str)


def table(seed=3, n=60):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "uncle", "", None]
    texts = ["Yes.", "No!", "so it", "", " \n", None, "Why?", "élan", "a.b.c", "end. \t", "x"]
    rows = []
    for conv_id in range(n):
        for turn in range(r.randint(1, 14)):
            rows.append((conv_id, turn * r.choice([1, 1, 1, 2]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"text {r.randint(0, 9)}{r.choice('.!?x')}"))
    for k in range(2):  # as conversations should be, with gaps
        rows += [(1000 + k, 3 * turn, ["user", "assistant"][turn % 2], f"turn {turn}.") for turn in range(20)]
    rows += [(2000, None, "user", "Hello."), (2000, None, "assistant", "Hi."), (2000, 1, "user", "Hi."), (2000, 1, "user", "Hi.")]
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [4096, 16, 3, 1])
def test_contract(spark, block):
    """Also of conversations in many pieces."""
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(rp.repair(rp.damaged(df), block)) == brute(rows)


LEGAL = re.compile("(s?(ua)+)?")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["a.", "b.", "c", "", "d?"])), max_size=9))
def test_walk_is_least(rows):
    found = faults(rows)
    codes = bytes(4 * {None: rp.SOUND, "blank": rp.BLANK, "duplicate": rp.DUPLICATE, "truncated": rp.CUT}[f] + {"s": 1, "u": 2, "a": 3}.get(role[0], 0) for f, (role, _) in zip(found, rows))
    steps, after, _ = rp.walk(codes, rp.BEGIN, rp.END, 0, True)
    cost, letters, _ = cheapest(rows, found)
    assert "".join("I" * len(b) + letter for b, letter, _ in steps) + "I" * len(after) == letters
    assert min(x + y for x, y in zip(rp.BEGIN, rp.back(rp.matrix_of(codes), rp.END))) == cost


def test_dropped_conversation(spark):
    conv_id = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv_id, 0, "user", "x")], SCHEMA)
    assert got(rp.repair_damaged(df)) == [(conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_without_damage(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 0, "user", "a"), (2, 1, "assistant", "b.")]
    found = {r[0]: r[6:8] for r in got(rp.repair_conversations(spark.createDataFrame(rows, SCHEMA)))}
    assert found == {1: (3, "KIK"), 2: (3, "KK")}


def test_empty_and_clashing(spark):
    assert got(rp.repair_damaged(spark.createDataFrame([], SCHEMA))) == []
    rows = table(9, 8)
    names = "conv_id long, turn long, role string, text string, row long, copy string, gone boolean, kind int, pos int, code int, digest string"
    df = spark.createDataFrame([(*r, 1, "c", True, 7, 0, 3, "d") for r in rows], names)
    assert got(rp.repair_damaged(df)) == brute(rows)


def test_one_long_conversation(spark):
    """A conversation of most rows spans many pieces, and holds a text of megabytes."""
    r = random.Random(1)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), f"{r.randint(0, 5000)}{r.choice('.?x')}") for t in range(6000)] + [(7, 6000, "user", "long " * 600_000)]
    found = got(rp.repair(rp.damaged(spark.createDataFrame(rows, SCHEMA).repartition(4)), 256))
    after = damage(rows)
    said = [(a, b) for _, _, a, b in sorted(after, key=lambda x: x[1])]
    codes = bytes(4 * {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] + {"s": 1, "u": 2, "a": 3}[role[0]] for f, (role, _) in zip(faults(said), said))
    steps, tail, _ = rp.walk(codes, rp.BEGIN, rp.END, 0, True)
    lines = []
    for (before, letter, to), (role, text) in zip(steps, said):
        lines += [f"{rp.ROLES[q]}:" for q in before] + ([] if letter == "D" else [f"{rp.ROLES[to] if letter == 'R' else role}:{text}"])
    lines += [f"{rp.ROLES[q]}:" for q in tail]
    audit = "".join("I" * len(b) + letter for b, letter, _ in steps) + "I" * len(tail)
    assert LEGAL.fullmatch("".join(x[0] for x in lines)) and found[0][7:] == (audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())

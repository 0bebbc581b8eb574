"""Contexts against a plain assembly of one prompt after the other."""

import itertools

from factorloom.operators import context as C
from factorloom.plans.loop import sections

SCHEMA = "system string, task string, memory string, hints string, strategy string"


def tokens(t):
    cjk = sum("一" <= c <= "鿿" for c in t)
    return int(cjk * 1.5 + (len(t) - cjk) / 4)


def cut(t, most):
    if not t or most <= 0:
        return ""
    return t if tokens(t) <= most else t[: int(len(t) * (most / tokens(t)) * 0.9)] + "\n\n[...truncated...]"


def plain(system, task, memory, hints, strategy, total, pass_on):
    memory, hints = memory or "", hints or ""
    if strategy == C.WINDOW:
        session = f"{memory}\n\n[Similar Historical Traces]\n{hints}" if hints else memory
    elif strategy == C.SUMMARY:
        session = "\n\n".join(x for x in (memory, hints and f"[Relevant Past Experience]\n{hints}") if x)
    else:
        session = f"[Retrieved Relevant Context — Prioritize This]\n{hints}\n\n[Recent Session — For Reference]\n{memory}" if hints else memory
    spare, blocks = 0, []
    for text, share in ((system, 0.15), (task, 0.5), (session, 0.35)):
        most = int(total * share) + (spare if pass_on else 0)
        blocks.append(cut(text, most))
        spare = max(most - tokens(blocks[-1]), 0)
    said = [b for b in blocks[:2] if b] + ([f"[Session Context]\n{blocks[2]}"] if blocks[2] else [])
    return "\n\n---\n\n".join(said), [tokens(b) for b in blocks]


def test_assembly(spark):
    texts = [None, "", "short", "word " * 60, "营收增长" * 30, "x" * 4000]
    rows = [(s, t, m, h, k) for s, t in itertools.product(texts, texts) for m, h in zip(texts, reversed(texts)) for k in (C.WINDOW, C.SUMMARY, C.RETRIEVAL)]
    for total, pass_on in ((200, False), (200, True), (3, False)):
        got = C.assembled(spark.createDataFrame(rows, SCHEMA).coalesce(2), total, pass_on=pass_on).collect()
        for r in got:
            context, used = plain(r.system, r.task, r.memory, r.hints, r.strategy, total, pass_on)
            assert r.context == context and [r.system_tokens, r.task_tokens, r.session_tokens] == used
            assert r.total_tokens == sum(used) and r.max_tokens == total and abs(r.utilization - sum(used) / total) < 1e-12
        assert len(got) == len(rows)


def test_summary_replaces_memory(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("s", "t", "a long memory", "", C.SUMMARY), ("s", "t", "", "", C.SUMMARY), ("s", "t", "m", "", "other")], SCHEMA)
    got = [r.context for r in C.assembled(rows, summary=F.upper(F.substring("memory", 1, 6))).collect()]
    assert got == ["s\n\n---\n\nt\n\n---\n\n[Session Context]\nA LONG", "s\n\n---\n\nt", "s\n\n---\n\nt"]


def test_recent_texts_within_a_sum(spark):
    rows = [(1, t, "x" * 40) for t in range(5)] + [(2, 0, "y" * 4000), (2, 1, "z" * 4)] + [(3, 0, "w" * 4000)]
    got = {r.g: r.recent.split("\n") for r in C.recent_within(spark.createDataFrame(rows, "g long, t long, x string"), "g", "t", "x", 25).collect()}
    assert got == {1: ["x" * 40] * 2, 2: ["z" * 4]}


def test_driver_sections_still_cut():
    assert "[...truncated...]" in sections({"a": "x" * 4000, "b": "", "c": ""}, 100)

import json
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import history as h
from factorloom.sources import readers
from factorloom.streaming import runs, traces

MINUTE = 60


def step(rng, run, k, second):
    ok = rng.random() < 0.8
    return {
        "run_id": run, "step_id": k, "state": rng.choice(["PLANNING", "ACTING", None]), "tool_called": "t", "tool_ok": ok, "decision": rng.choice(["CONTINUE", "FAIL", None, "RETRY", "CONTINUE", "CONTINUE"]),
        "tool_error": None if ok else rng.choice(["timeout: 5 s", "a long message without any colon", ""]), "timestamp": f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}",
    }


def batch_answer(spark, path, ring):
    """What the batch operators say of all steps there are."""
    steps = readers.trace(spark, path).withColumn("run_id", F.coalesce("run_id", F.lit("none")))
    stats = {r.run_id: r.total_steps for r in h.run_stats(steps).collect()}
    first = {r.run_id: (r.step_id, r.state) for r in h.divergence_point(steps).collect()}
    known = {}
    for r in steps.collect():
        entry = known.setdefault(r.run_id, ([], {}))
        if r.step_id is not None:
            entry[0].append(r.step_id)
        if r.tool_error:
            kind = r.tool_error.split(":")[0] if ":" in r.tool_error else r.tool_error[:20]
            entry[1][kind] = entry[1].get(kind, 0) + 1
    return {k: (stats[k], first.get(k, (None, None)), sorted(known[k][0])[-ring:], known[k][1]) for k in stats}


def trigger(spark, src, tmp_path, seen, ring=3, idle_ms=10 * MINUTE * 1000):
    states = runs.run_states(traces.trace_stream(spark, str(src)), ring, idle_ms, "1 minute")

    def keep(rows, _):
        for r in rows.collect():
            seen.append(r)

    q = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert not q.isActive


def as_answer(rows):
    return {r.run_id or "none": (r.steps, (r.diverged_step, r.diverged_state), list(r.last_steps), json.loads(r.failures)) for r in rows if not r.idle}


@pytest.fixture(scope="module", autouse=True)
def kept_settings(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def test_equals_the_batch_operators_after_every_trigger(spark, tmp_path):
    """Steps come out of order, one run holds most of them, and every trigger is a restart from the checkpoint."""
    rng, src, seen, now = random.Random(5), tmp_path / "in", [], {}
    src.mkdir()
    deck = [("hot", k) for k in range(120)] + [(f"r{k % 7}", k // 7) for k in range(40)] + [(None, k) for k in range(5)]
    rng.shuffle(deck)
    for part in range(3):
        lines = [step(rng, run, k, part * MINUTE + n % MINUTE) for n, (run, k) in enumerate(deck[part::3])]
        if part == 1:
            lines.append({"run_id": "bare", "step_id": None, "tool_ok": False, "timestamp": None})
        (src / f"{part}.json").write_text("\n".join(json.dumps(x) for x in lines))
        seen.clear()
        trigger(spark, src, tmp_path, seen)
        now |= as_answer(seen)
        assert now == batch_answer(spark, str(src), 3)
    assert now["bare"][0] == 1 and now["bare"][2] == []


def test_idle_runs_end(spark, tmp_path):
    rng, src, seen = random.Random(1), tmp_path / "in", []
    src.mkdir()
    for name, lines in (("a", [step(rng, "old", 1, 0), step(rng, "kept", 1, 0)]), ("b", [step(rng, "kept", 2, 30 * MINUTE)]), ("c", [step(rng, "old", 2, 31 * MINUTE)]), ("d", [step(rng, "kept", 3, 2 * MINUTE)])):
        (src / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
        trigger(spark, src, tmp_path, seen)
    assert [r.steps for r in seen if r.run_id == "old" and r.idle] == [1]
    assert [(r.steps, list(r.last_steps)) for r in seen if r.run_id == "old" and not r.idle][-1] == (1, [2])
    assert [r.steps for r in seen if r.run_id == "kept"] == [1, 2]  # the last step is late


def test_batch_sums_merge(spark):
    rows = [("r", k, "S", "FAIL" if k == 4 else None, True, None, None) for k in range(9)]
    steps = spark.createDataFrame(rows, "run_id string, step_id int, state string, decision string, tool_ok boolean, tool_error string, at timestamp")
    got = runs.batch_sums(steps.coalesce(1), 2).collect()
    assert sum(r.steps for r in got) == 9 and sum(r.failed for r in got) == 1 and max(s.step_id for r in got for s in r.last) == 8
    assert runs.batch_sums(steps.limit(0), 2).collect() == []

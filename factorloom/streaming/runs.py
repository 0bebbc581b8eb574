"""Keyed state over growing traces: what is known of every run, kept as its steps arrive.

For each run the state holds counts, the first step that failed or was retried, failures by kind, and a ring of the last
steps; after every trigger a run's row says what the batch operators of operators.history say of all steps seen so far.
Each batch of steps is summed up by run inside its task first, so that a run that holds a third of all steps sends a row
a batch to its state, not a row a step. Such sums merge in any order, since all is decided by step_id: steps may come
late and out of order. Steps of one step_id go by state and decision, nulls as empty texts.

A run without new steps for `idle_ms` of event time gives its last row, marked idle, and its state is dropped; steps
that come later start it anew. Steps that arrive later than `late` behind the newest are dropped, as a watermark does it:
by the newest step of their run in their batch. A restart goes on from the checkpoint. Null runs are one run; a step without a time or number counts, but sets no timer,
takes no place in the ring and is no first failure.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP = "step_id int, state string, decision string"
STEP_TYPE = "struct<step_id:int,state:string,decision:string>"
SUMS = f"run_id string, at timestamp, steps long, failed long, passed long, diverged {STEP_TYPE}, last array<{STEP_TYPE}>, kinds map<string,long>"
ROW = "run_id string, steps long, failed long, passed long, diverged_step int, diverged_state string, last_steps array<int>, failures string, idle boolean"


def step_key(step: tuple) -> tuple:
    return (step[0], step[1] or "", step[2] or "")


def newest(steps: list[tuple], n: int) -> list[tuple]:
    """The n last of some steps, oldest first."""
    return sorted(steps, key=step_key)[-n:]


def earliest(steps: list[tuple]) -> tuple | None:
    return min(steps, key=step_key, default=None)


def summed(frame: pd.DataFrame, ring: int) -> Iterator[dict]:
    """One row of SUMS for each run of a batch of steps."""
    for run, rows in frame.groupby("run_id", dropna=False, sort=False):
        ids = rows["step_id"]
        known = rows[ids.notna()].astype({"step_id": int})
        tuples = lambda part: list(part[["step_id", "state", "decision"]].itertuples(index=False, name=None))
        late = known.nlargest(ring, "step_id", keep="all")
        bad = known[known["bad"]]
        first = bad[bad["step_id"] == bad["step_id"].min()]
        at = rows["at"].max()
        yield {
            "run_id": None if pd.isna(run) else run, "at": None if pd.isna(at) else at, "steps": len(rows), "failed": int(rows["bad"].sum()), "passed": int((~rows["bad"]).sum()),
            "diverged": earliest(tuples(first)), "last": newest(tuples(late), ring), "kinds": {k: int(n) for k, n in rows["kind"].dropna().value_counts().items()},
        }


def batch_sums(steps: DataFrame, ring: int) -> DataFrame:
    """steps (run_id, step_id, state, decision, tool_ok, tool_error, at) as sums of each batch by run."""
    bad = ~F.coalesce("tool_ok", F.lit(True)) | F.coalesce("decision", F.lit("")).isin("FAIL", "RETRY")
    error = F.coalesce("tool_error", F.lit(""))
    kind = F.when(error != "", F.when(error.contains(":"), F.substring_index(error, ":", 1)).otherwise(F.substring(error, 1, 20)))
    narrow = steps.select(F.col("run_id").cast("string").alias("run_id"), F.col("step_id").cast("int").alias("step_id"), "state", "decision", bad.alias("bad"), kind.alias("kind"), "at")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(list(summed(batch, ring)))

    return narrow.mapInPandas(sums, SUMS)


class RunState(StatefulProcessor):
    """State of one run: counts and the first failure, a ring of steps, failures by kind, one timer."""

    def __init__(self, ring: int, idle_ms: int):
        self.size, self.idle_ms = ring, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", f"steps long, failed long, passed long, seen_ms long, {STEP}")
        self.ring = handle.getListState("ring", STEP)
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def row(self, key: tuple, idle: bool) -> pd.DataFrame:
        steps, failed, passed, _, diverged, state, _ = self.counts.get()
        last = [r[0] for r in self.ring.get()]
        kinds = json.dumps({k[0]: n[0] for k, n in sorted(self.kinds.iterator())}, ensure_ascii=False)
        return pd.DataFrame([{"run_id": key[0], "steps": steps, "failed": failed, "passed": passed, "diverged_step": diverged, "diverged_state": state, "last_steps": last, "failures": kinds, "idle": idle}]).astype({"diverged_step": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps, failed, passed, seen, *first = self.counts.get() if self.counts.exists() else (0, 0, 0, None, None, None, None)
        first = tuple(first) if first[0] is not None else None
        ring, kinds = [tuple(r) for r in self.ring.get()], Counter()
        for part in rows:
            steps, failed, passed = steps + int(part["steps"].sum()), failed + int(part["failed"].sum()), passed + int(part["passed"].sum())
            first = earliest([s for s in (first, *map(as_step, part["diverged"])) if s])
            ring = newest(ring + [as_step(s) for some in part["last"] for s in some], self.size)
            for some in part["kinds"]:
                kinds.update(dict(some))
            if (at := part["at"].max()) is not pd.NaT:
                seen = max(seen or 0, int(at.timestamp() * 1000))
        self.counts.update((steps, failed, passed, seen, *(first or (None, None, None))))
        if ring:
            self.ring.put(ring)
        for kind, n in kinds.items():
            old = self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0
            self.kinds.updateValue((kind,), (old + int(n),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seen is not None:
            self.handle.registerTimer(max(seen + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self.row(key, True)
            for state in (self.counts, self.ring, self.kinds):
                state.clear()

    def close(self) -> None:
        pass


def as_step(s) -> tuple | None:
    """A step as a tuple, whatever form a struct came in."""
    if s is None:
        return None
    step = tuple(s.values()) if isinstance(s, dict) else tuple(s)
    return None if step[0] is None else (int(step[0]), *step[1:])


def run_states(steps: DataFrame, ring: int = 3, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """A row of ROW for every run with new steps in a trigger, and one for every run that turned idle.

    failures is a JSON object of counts by kind. The stream needs RocksDB as its state store, which this sets in the
    caller's session; write it with output mode update.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    sums = batch_sums(steps, ring).withWatermark("at", late)
    return sums.groupBy("run_id").transformWithStateInPandas(RunState(ring, idle_ms), ROW, "Update", "EventTime")

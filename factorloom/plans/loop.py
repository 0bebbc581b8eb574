"""The evaluation loop on the driver: small states over DataFrame stages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from factorloom.sources.writers import checkpoint as write_checkpoint

# Legal moves between states.
MOVES: dict[str, set[str]] = {
    "INIT": {"PLANNING", "FAILED"},
    "PLANNING": {"ACTING", "DONE", "FAILED"},
    "ACTING": {"OBSERVING", "RETRYING", "FAILED"},
    "OBSERVING": {"EVALUATING", "RETRYING", "FAILED"},
    "EVALUATING": {"DIAGNOSING", "FINALIZING", "RETRYING"},
    "DIAGNOSING": {"FINALIZING", "FAILED"},
    "FINALIZING": {"PLANNING", "DONE"},
    "RETRYING": {"PLANNING", "FAILED"},
    "DONE": set(),
    "FAILED": set(),
}
NEXT = {"INIT": "PLANNING", "PLANNING": "ACTING", "ACTING": "OBSERVING", "OBSERVING": "EVALUATING", "DIAGNOSING": "FINALIZING", "RETRYING": "PLANNING"}


@dataclass
class State:
    state: str = "INIT"
    iteration: int = 0
    step_id: int = 0
    completed: list[str] = field(default_factory=list)
    feature: str | None = None
    tokens: int = 0


@dataclass
class Loop:
    """handlers: state -> function(context) -> decision (CONTINUE, FAIL, RETRY or DONE). Data stay in DataFrames that the
    context refers to; a checkpoint keeps the small state, and data are kept as Parquet by the handlers."""

    handlers: dict[str, Callable[[dict], str]]
    most: int = 10
    path: str | None = None
    budget: int | None = None
    warn_at: float = 0.85
    now: State = field(default_factory=State)
    context: dict = field(default_factory=dict)

    def move(self, to: str) -> None:
        if to not in MOVES[self.now.state]:
            raise ValueError(f"{self.now.state} can't be followed by {to}")
        self.now.state = to

    def spend(self, tokens: int) -> bool:
        """Count tokens; whether the budget is nearly used up."""
        self.now.tokens += tokens
        return self.budget is not None and self.now.tokens >= self.budget * self.warn_at

    def save(self) -> None:
        if self.path:
            write_checkpoint(asdict(self.now), self.path)

    def resume(self) -> bool:
        if not self.path or not Path(self.path).exists():
            return False
        self.now = State(**json.loads(Path(self.path).read_text()))
        return True

    def step(self) -> str:
        """Run this state's handler and move on."""
        at = self.now.state
        decision = self.handlers.get(at, lambda _: "CONTINUE")(self.context)
        self.now.step_id += 1
        if decision == "RETRY" and "RETRYING" in MOVES[at]:
            self.move("RETRYING")
        elif at == "EVALUATING":
            self.move("DIAGNOSING" if decision == "FAIL" else "FINALIZING")
        elif at == "FINALIZING":
            if self.now.feature:
                self.now.completed.append(self.now.feature)
            self.now.iteration += 1
            self.move("DONE" if decision == "DONE" or self.now.iteration >= self.most else "PLANNING")
        elif decision == "DONE" and "DONE" in MOVES[at]:
            self.move("DONE")
        elif decision == "FAIL" and "FAILED" in MOVES[at]:
            self.move("FAILED")
        else:
            self.move(NEXT[at])
        self.save()
        return self.now.state

    def run(self) -> State:
        while self.now.state not in ("DONE", "FAILED"):
            self.step()
        return self.now


def sections(parts: dict[str, str], total: int, shares: tuple[float, float, float] = (0.15, 0.50, 0.35)) -> str:
    """System, memory and task texts in their shares of a token budget."""

    def tokens(t: str) -> int:
        cjk = sum("一" <= c <= "鿿" for c in t)
        return int(cjk * 1.5 + (len(t) - cjk) / 4)

    out = []
    for (name, text), part in zip(parts.items(), shares):
        most = int(total * part)
        if tokens(text) > most:
            text = text[: int(len(text) * most / tokens(text) * 0.9)] + "\n\n[...truncated...]"
        out.append(f"## {name}\n{text}")
    return "\n\n".join(out)


@dataclass
class Memory:
    """Working memory on the driver: the oldest entries become one once there are more than `limit`."""

    limit: int = 8
    entries: list[dict] = field(default_factory=list)
    compressed: int = 0

    def add(self, iteration: int, feature: str, outcome: str, metrics: str = "", summary: str = "") -> None:
        self.entries.append({"iteration": iteration, "feature_name": feature, "outcome": outcome, "key_metrics": metrics, "summary": summary})
        if len(self.entries) > self.limit:
            n = max(len(self.entries) // 2, 2)
            old, self.entries = self.entries[:n], self.entries[n:]
            passed, failed = (sum(e["outcome"] == o for e in old) for o in ("PASS", "FAIL"))
            names = [e["feature_name"] for e in old]
            self.entries.insert(0, {"iteration": 0, "feature_name": ",".join(names[:5]) + ("..." if n > 5 else ""), "outcome": f"COMPRESSED({passed}P/{failed}F)", "key_metrics": "", "summary": f"{n} entries: {passed} PASS, {failed} FAIL"})
            self.compressed += n

    @property
    def pass_rate(self) -> float:
        done = [e["outcome"] for e in self.entries if e["outcome"] in ("PASS", "FAIL")]
        return done.count("PASS") / len(done) if done else 0.0

"""Context assembly under a token budget, for many prompts at once: all of it expressions and one running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import text as T

# Headings, marks and shares of assembled contexts.
SESSION, SIMILAR, PAST = "[Session Context]\n", "[Similar Historical Traces]\n", "[Relevant Past Experience]\n"
RETRIEVED, RECENT = "[Retrieved Relevant Context — Prioritize This]\n", "[Recent Session — For Reference]\n"
BETWEEN, CUT = "\n\n---\n\n", "\n\n[...truncated...]"
TOTAL, SHARES = 8000, {"system": 0.15, "task": 0.50, "session": 0.35}
WINDOW, SUMMARY, RETRIEVAL = "sliding_window", "summarization", "retrieval_augmented"


def within(text: Column, most: Column) -> Column:
    """text, or its first part and a mark if it is over `most` tokens; empty for no text or no budget."""
    tokens = T.token_estimate(text)
    keep = F.floor(F.length(text) * (most.cast("double") / F.nullif(tokens, F.lit(0))) * 0.9).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), keep), F.lit(CUT))
    return F.when(text.isNull() | (text == "") | (most <= 0), "").when(tokens <= most, text).otherwise(cut)


def session_text(strategy: Column, memory: Column, hints: Column, summary: Column | None = None) -> Column:
    """The session's part by strategy: the memory and similar traces; a summary of it, if there is one, and past
    experience; or what was retrieved, and then the memory."""
    memory, hints = F.coalesce(memory, F.lit("")), F.coalesce(hints, F.lit(""))
    windowed = F.when(hints == "", memory).otherwise(F.concat(memory, F.lit("\n\n" + SIMILAR), hints))
    short = F.when(memory == "", memory).otherwise(memory if summary is None else summary)
    past = F.array_join(F.filter(F.array(short, F.when(hints == "", hints).otherwise(F.concat(F.lit(PAST), hints))), lambda x: x != ""), "\n\n")
    found = F.when(hints == "", memory).otherwise(F.concat(F.lit(RETRIEVED), hints, F.lit("\n\n" + RECENT), memory))
    return F.when(strategy == WINDOW, windowed).when(strategy == SUMMARY, past).when(strategy == RETRIEVAL, found)


def assembled(prompts: DataFrame, total: int = TOTAL, shares: dict[str, float] | None = None, pass_on: bool = False, summary: Column | None = None) -> DataFrame:
    """prompts (system, task, memory, hints, strategy, ...) with context and its breakdown: system_tokens, task_tokens,
    session_tokens, total_tokens, max_tokens, utilization.

    Each part is cut to its share of the total. With pass_on, what a part leaves of its share is added to the next
    one's. Null texts are empty; an unknown strategy has no session.
    """
    budget = {k: int(total * share) for k, share in (shares or SHARES).items()}
    rows = prompts.withColumn("__session", session_text(F.col("strategy"), F.col("memory"), F.col("hints"), summary))
    spare, blocks = F.lit(0), []
    for name, text in (("system", F.col("system")), ("task", F.col("task")), ("session", F.col("__session"))):
        most = F.lit(budget[name]) + spare if pass_on else F.lit(budget[name])
        rows = rows.withColumn(f"__{name}_block", within(text, most)).withColumn(f"{name}_tokens", T.token_estimate(F.col(f"__{name}_block")))
        spare = F.greatest(most - F.col(f"{name}_tokens"), F.lit(0))
        block = F.col(f"__{name}_block")
        blocks.append(F.when(block != "", F.concat(F.lit(SESSION), block) if name == "session" else block))
    used = F.col("system_tokens") + F.col("task_tokens") + F.col("session_tokens")
    out = rows.withColumn("context", F.array_join(F.array_compact(F.array(*blocks)), BETWEEN)).withColumn("total_tokens", used)
    return out.withColumn("max_tokens", F.lit(total)).withColumn("utilization", F.col("total_tokens") / F.lit(float(total))).drop("__session", *[f"__{n}_block" for n in SHARES])


def recent_within(turns: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """by, recent: each group's latest texts whose tokens add up to `most` at most, in order, a line each."""
    later = Window.partitionBy(by).orderBy(F.desc(order), F.desc(text)).rowsBetween(Window.unboundedPreceding, 0)
    kept = turns.withColumn("__sum", F.sum(T.token_estimate(F.col(text))).over(later)).filter(F.col("__sum") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return kept.groupBy(by).agg(F.array_join(lines, "\n").alias("recent"))

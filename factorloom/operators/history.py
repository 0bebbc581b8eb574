"""Append-only logs: feature history with patches and repairs, run traces, episodic and working memory.

Log lines carry line_no, their order. "Last wins" and "first wins" are max_by and min_by of it, which combine before
any shuffle, so a name with very many lines is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.sources.scratch import STORED, drop_stored, stored

GATES = ["G1_coverage", "G2_zero_ratio", "G3_t_stat", "G4_direction"]
PATTERNS = ["zero_ratio", "t_stat", "direction", "coverage"]


def kind_of_line() -> Column:
    """'patch', 'repair' or 'feature', by the keys a history line has."""
    return F.when(F.col("_patch_feature").isNotNull(), "patch").when(F.col("_repair_spec").isNotNull(), "repair").otherwise("feature")


def last_by(rows: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def first_by(rows: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def patched(records: DataFrame, patches: DataFrame) -> DataFrame:
    """records (feature, ...) with the diagnosis of each feature's latest patch (feature, diagnosis, line_no)."""
    latest = last_by(patches.select("feature", "diagnosis", "line_no"), "feature").select("feature", F.col("diagnosis").alias("patch"))
    out = records.join(latest, "feature", "left")
    if "diagnosis" in records.columns:
        return out.withColumn("diagnosis", F.coalesce("patch", "diagnosis")).drop("patch")
    return out.withColumnRenamed("patch", "diagnosis")


def unexplored(specs: DataFrame, explored: DataFrame) -> DataFrame:
    """The first spec of each feature that is not explored."""
    return first_by(specs.join(explored.select("feature").distinct(), "feature", "left_anti"), "feature")


def queue(seeds: DataFrame, repairs: DataFrame, explored: DataFrame) -> DataFrame:
    """feature, source, line_no in the order to be tried: seeds, then repairs; explored ones are left out."""
    both = seeds.withColumn("source", F.lit("seed")).withColumn("priority", F.lit(0)).unionByName(repairs.withColumn("source", F.lit("repair")).withColumn("priority", F.lit(1)))
    one = both.join(explored.select("feature").distinct(), "feature", "left_anti").groupBy("feature").agg(F.min(F.struct("priority", "line_no", "source")).alias("m"))
    return one.select("feature", "m.priority", "m.source", "m.line_no").orderBy("priority", "line_no")


def lineage(records: DataFrame) -> DataFrame:
    """repair_of, feature and both versions' metrics, for every repaired feature: the first record of each side."""
    metrics = ["ic_mean", "t_stat", "zero_ratio", "direction_consistency", "passed"]
    one = first_by(records, "feature")
    new = one.filter("repair_of is not null").select("repair_of", "feature", *[F.col(m).alias(f"new_{m}") for m in metrics])
    return new.join(one.select(F.col("feature").alias("repair_of"), *[F.col(m).alias(f"old_{m}") for m in metrics]), "repair_of")


def lineage_roots(records: DataFrame) -> DataFrame:
    """feature, root, depth, cyclic for the first record of every feature: its oldest recorded ancestor by repair_of and
    the number of steps there. Records on a cycle, or below one, have no root and are cyclic.

    Pointer jumping: each round doubles the steps that a pointer spans, so that a chain of n versions takes log2(n)
    joins. Pointers that reached a root are not moved again. Parents that are not recorded end a chain.
    """
    one = first_by(records, "feature").select("feature", "repair_of")
    known = one.select(F.col("feature").alias("repair_of"), F.lit(True).alias("recorded"))
    inner = F.coalesce("recorded", F.lit(False))
    state = one.join(known, "repair_of", "left").select("feature", F.when(inner, F.col("repair_of")).otherwise(F.col("feature")).alias("root"), inner.cast("long").alias("depth"), (~inner).alias("done"))
    state = stored(state, "lineage")
    left, spans = state.filter("not done").count(), 1
    most = left
    while left and spans <= most:  # no chain has more steps than there are children
        to = state.select(F.col("feature").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("reached"))
        moved = state.filter("not done").join(to, "root").select("feature", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("reached").alias("done"))
        old, state = state, stored(state.filter("done").unionByName(moved), "lineage")
        drop_stored(records.sparkSession, [x for x in STORED if any(x.rsplit("/", 1)[-1] in file for file in old.inputFiles())])
        left, spans = state.filter("not done").count(), 2 * spans
    return state.select("feature", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), (~F.col("done")).alias("cyclic"))


def compared(lines: DataFrame, metrics: list[str], lower_is_better: list[str]) -> DataFrame:
    """repair_of, metric, old, new, delta, better."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"old_{m}").cast("double").alias("old"), F.col(f"new_{m}").cast("double").alias("new")) for m in metrics])
    rows = lines.select("repair_of", F.explode(entries).alias("e")).select("repair_of", "e.*").withColumn("delta", F.col("new") - F.col("old"))
    return rows.withColumn("better", F.when(F.col("metric").isin(lower_is_better), F.col("delta") < 0).otherwise(F.col("delta") > 0))


def exploration_summary(records: DataFrame) -> DataFrame:
    """total, passed, failed of a history."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))


def passed_names(records: DataFrame) -> DataFrame:
    """line_no, feature of what passed: rows, as a history may be long."""
    return records.filter("passed").select("line_no", "feature")


def cluster_usage(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, place, n: uses of every declared cluster (cluster, place), zero included."""
    used = records.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(used, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def least_used(usage: DataFrame) -> DataFrame:
    """The least used cluster, ties by declared order."""
    return usage.agg(F.min_by("cluster", F.struct("n", "place")).alias("cluster"))


def recent(rows: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last n rows: each task keeps n, no more."""
    return rows.orderBy(F.desc(order)).limit(n)


def trimmed(rows: DataFrame, most: int, order: str = "line_no") -> DataFrame:
    return recent(rows, most, order)


def ranked_candidates(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("passed"), F.desc("ic_mean"), "feature")


# -- traces


def run_stats(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """One row of counters per run."""
    called = F.coalesce("tool_called", F.lit("")) != ""
    iterations = F.count_distinct(F.when(F.col("iteration") > 0, F.col("iteration")))
    gated = F.col("observation").rlike("Gate|G1_|G2_")
    gates = [F.count(F.when(gated & F.col("observation").contains(g), 1)).alias(g) for g in GATES]
    return steps.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_steps"), F.max("step_id").alias("total_iterations"), F.sum("context_tokens").alias("total_tokens"),
        F.sum(F.coalesce("tool_latency_ms", F.lit(0.0))).alias("total_latency_ms"),
        F.coalesce(F.avg(F.when(called, F.when(F.col("tool_ok"), 1.0).otherwise(0.0))), F.lit(1.0)).alias("tool_success_rate"),
        F.coalesce(F.try_divide(F.count(F.lit(1)).cast("double"), iterations), F.lit(0.0)).alias("avg_steps_per_iteration"), *gates,
    )


def states_visited(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """by, states: distinct states in the order first seen."""
    first = steps.groupBy(by, "state").agg(F.min("step_id").alias("at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "state"))), lambda x: x["state"]).alias("states"))


def counts_by(steps: DataFrame, c: str, by: str = "run_id") -> DataFrame:
    """by, c, n over steps where c is not empty: tools or decisions."""
    return steps.filter(F.coalesce(c, F.lit("")) != "").groupBy(by, c).agg(F.count(F.lit(1)).alias("n"))


def tool_metrics(steps: DataFrame) -> DataFrame:
    """tool_called, calls, success_rate, mean_latency_ms."""
    called = steps.filter(F.coalesce("tool_called", F.lit("")) != "")
    return called.groupBy("tool_called").agg(F.count(F.lit(1)).alias("calls"), F.avg(F.when(F.col("tool_ok"), 1.0).otherwise(0.0)).alias("success_rate"), F.avg("tool_latency_ms").alias("mean_latency_ms"))


def divergence_point(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """The first step of each run that failed or was retried."""
    bad = steps.filter(~F.coalesce("tool_ok", F.lit(True)) | F.coalesce("decision", F.lit("")).isin("FAIL", "RETRY"))
    return bad.groupBy(by).agg(F.min_by(F.struct("step_id", "state", "decision"), "step_id").alias("s")).select(by, "s.*")


def replay(steps: DataFrame, run: str) -> DataFrame:
    return steps.filter(F.col("run_id") == run).orderBy("step_id")


def trace_metrics(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """by, key_metrics: what each run's first observation with an IC states."""
    stated = steps.filter(F.col("observation").contains("IC=")).groupBy(by).agg(F.min_by("observation", "step_id").alias("observation"))
    return stated.select(by, T.key_metrics(F.col("observation")).alias("key_metrics"))


def trace_parts(steps: DataFrame, per_part: int = 1000, by: str = "run_id") -> DataFrame:
    """by, part, steps: each run's steps in order as JSON lists, one for every per_part step ids, so that a run may be of
    any length; its document is its parts in order."""
    rest = [c for c in steps.columns if c not in (by, "step_id")]
    ordered = F.array_sort(F.collect_list(F.struct("step_id", *rest)))
    return steps.groupBy(by, F.floor(F.col("step_id") / per_part).alias("part")).agg(F.to_json(ordered).alias("steps"))


def trace_document(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """by, document: all steps of a run as one JSON text, for runs that fit one value; others are read by trace_parts."""
    rest = [c for c in steps.columns if c != by]
    ordered = F.array_sort(F.collect_list(F.struct("step_id", *[c for c in rest if c != "step_id"])))
    return steps.groupBy(by).agg(F.to_json(F.struct(F.first(by).alias("run_id"), ordered.alias("steps"))).alias("document"))


# -- memory


def failure_key(f: Column) -> Column:
    return F.when(f.contains(":"), F.substring_index(f, ":", 1)).otherwise(F.substring(f, 1, 20))


def failure_patterns(records: DataFrame, n: int = 20) -> DataFrame:
    """failure, count: the three commonest failures among the last n records."""
    keys = recent(records, n).filter("outcome = 'FAIL'").select(F.explode("failures").alias("f")).select(failure_key(F.col("f")).alias("failure"))
    return keys.groupBy("failure").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "failure").limit(3)


def pass_rate(records: DataFrame) -> DataFrame:
    done = records.filter(F.col("outcome").isin("PASS", "FAIL"))
    return done.agg(F.coalesce(F.avg(F.when(F.col("outcome") == "PASS", 1.0).otherwise(0.0)), F.lit(0.0)).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


def with_failure(records: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """The last k failed records one of whose failures contains kind."""
    return recent(records.filter((F.col("outcome") == "FAIL") & F.exists("failures", lambda f: f.contains(kind))), k)


def with_outcome(records: DataFrame, outcome: str, k: int = 3) -> DataFrame:
    return recent(records.filter(F.col("outcome") == outcome), k)


def hint(similar: DataFrame) -> DataFrame:
    """hint: advice from a few similar records (line_no, outcome, failures, feature_name, ic, zero_ratio, diagnosis_fix)."""
    has = lambda g: F.count(F.when(F.exists("failures", lambda f: f.contains(g)), 1))
    line = F.concat(F.format_string("  [%s] %s: %s (IC=%+.3f, zr=%.0f%%)", F.when(F.col("outcome") == "PASS", "PASS").otherwise("FAIL"), "feature_name", "outcome", "ic", F.col("zero_ratio") * 100),
                    F.when(F.coalesce("diagnosis_fix", F.lit("")) != "", F.concat(F.lit("\n     Fix applied: "), F.substring("diagnosis_fix", 1, 120))).otherwise(""))
    sums = similar.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outcome") == "FAIL", 1)).alias("failed"), has("G2").alias("g2"), has("G3").alias("g3"),
                       F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    warn = F.col("failed") >= 2
    parts = [F.lit("[Episodic Memory — Lessons from Similar Past Features]"), F.when(warn, F.format_string("WARNING: %d/%d similar past features FAILED.", "failed", "n")),
             F.when(warn & (F.col("g2") >= 2), "-> Common issue: High zero-ratio. Consider finer-grained scoring intervals."),
             F.when(warn & (F.col("g3") >= 2), "-> Common issue: Weak signal (low |t-stat|). Consider narrowing condition_scope."), F.array_join("lines", "\n")]
    return sums.select(F.when(F.col("n") == 0, "").otherwise(F.concat_ws("\n", *parts)).alias("hint"))


def common_pattern(entries: DataFrame) -> DataFrame:
    """pattern, n, failed: the commonest failure word among failed entries; ties by declared order."""
    text = F.lower(F.concat_ws(" ", "key_metrics", "summary"))
    failed = entries.filter("outcome = 'FAIL'").select(F.array_compact(F.array(*[F.when(text.contains(w), F.lit(k)) for k, w in enumerate(PATTERNS)])).alias("hits"))
    total = failed.agg(F.count(F.lit(1)).alias("failed"))
    counts = failed.select(F.explode("hits").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.max("n").alias("n"))
    return counts.join(F.broadcast(total)).select(F.get(F.array(*[F.lit(w) for w in PATTERNS]), F.col("k")).alias("pattern"), "n", "failed")


def memory_context(entries: DataFrame, compressed: int = 0) -> DataFrame:
    """context: entries, newest first, as lines."""
    line = F.concat(F.format_string("  Iter%d: %s → %s", "iteration", "feature_name", "outcome"), F.when(F.coalesce("key_metrics", F.lit("")) != "", F.concat(F.lit(" ["), "key_metrics", F.lit("]"))).otherwise(""))
    lines = entries.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("line_no")).alias("o"), line.alias("l")))), lambda x: x["l"]).alias("lines"))
    head = F.concat_ws("\n", F.lit("[Working Memory — Recent Iterations]"), F.when(F.lit(compressed) > 0, F.lit(f"(+ {compressed} compressed earlier iterations)")))
    return lines.select(F.when(F.size("lines") == 0, "").otherwise(F.concat_ws("\n", head, F.array_join("lines", "\n"))).alias("context"))


def digest(records: DataFrame, n: int = 12) -> DataFrame:
    """passed and failed: texts of the last n records, by line order; failed ones with their diagnosis if there is one."""
    ordered = lambda condition, line, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("line_no", line.alias("l"))))), lambda x: x["l"]), sep)
    good = F.format_string("%s(IC=%+.3f, t=%+.2f)", "feature", "ic_mean", "t_stat")
    bad = F.format_string("%s IC=%+.4f t=%+.3f zero=%.0f%%", "feature", "ic_mean", "t_stat", F.col("zero_ratio") * 100)
    bad = F.concat_ws(" >> ", bad, F.nullif(F.coalesce("diagnosis_fix", F.lit("")), F.lit("")))
    return recent(records, n).agg(ordered(F.col("passed"), good, ";  ").alias("passed"), ordered(~F.col("passed"), bad, "\n").alias("failed"))


def last_steps_summary(steps: DataFrame, n: int = 5, by: str = "run_id") -> DataFrame:
    """by, summary: the last n steps' lines, oldest first."""
    last = steps.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("step_id")))).filter(F.col("r") <= n)
    return last.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_id", T.step_summary().alias("l")))), lambda x: x["l"]), " | ").alias("summary"))

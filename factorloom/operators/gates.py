"""Quality gates and failure rules as columns over validation results.

A validation row has coverage, coverage_failure, zero_ratio, t_stat, ic_mean, direction_consistency and the maps
zero_by_sector, per_sector_ic, score_dist, zero_by_year. Maps have string keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.sources.scratch import stored

# Limits of the checks and of salvage.
ZERO_UNIFORM, ZERO_STRICT, LEAST_T, LEAST_CONSISTENCY, LEAST_COVERAGE, MOST_DRAWDOWN = 0.70, 0.45, 1.5, 0.60, 0.05, 0.03
SALVAGE_IC, SALVAGE_T, SALVAGE_IC_LOW, SALVAGE_T_LOW, SALVAGE_ZERO = 0.08, 2.0, 0.03, 1.0, 0.30

# Search texts by symptom.
QUERY_COVERAGE = "sample selection bias out-of-sample coverage earnings call signal condition scope"
QUERY_SPARSE = "sparse coverage LLM scoring conservative zero inflation valid signal earnings call"
QUERY_AMBIGUOUS = "zero inflation ambiguous instruction LLM scoring threshold earnings transcript signal"
QUERY_BIMODAL = "bimodal score distribution granularity mismatch earnings call LLM rating"
QUERY_WEAK = "language feature no predictive power stock return earnings call transcript weak signal"
QUERY_SECTOR = "sector heterogeneity earnings call tone signal reversal industry specific cross-sectional"
QUERY_DEFAULT = "earnings call transcript signal failure low IC t-stat diagnosis improvement"
EXTERNAL = ["consensus", "预期", "上季度", "市场预期", "分析师预期", "vs prior"]


def _values(c: str) -> Column:
    return F.map_values(F.coalesce(F.col(c), F.create_map().cast("map<string,double>")))


def _fold(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def sector_variance(c: str = "zero_by_sector") -> Column:
    v = _values(c)
    n = F.size(v)
    mean = _fold(v, lambda x: x) / F.nullif(n, F.lit(0))
    return F.when(n > 1, _fold(v, lambda x: (x - mean) * (x - mean)) / F.nullif(n - 1, F.lit(0)))


def zero_type(c: str = "zero_by_sector") -> Column:
    """How missing signals spread over sectors: uniform, systemic_sparse, concentrated or unknown."""
    v = _values(c)
    mean = _fold(v, lambda x: x) / F.nullif(F.size(v), F.lit(0))
    return (
        F.when(F.size(v) < 3, "unknown").when(sector_variance(c) < 0.02, F.when(mean > 0.70, "systemic_sparse").otherwise("uniform"))
        .when((F.array_max(v) > 0.80) & (F.array_min(v) < 0.40), "concentrated").otherwise("unknown")
    )


def polar_share(c: str = "score_dist") -> Column:
    """Share of scores 2 and -2, whichever way the keys are written."""
    get = lambda k: F.coalesce(F.try_element_at(c, F.lit(f"{k}.0")), F.try_element_at(c, F.lit(str(k))), F.lit(0.0))
    return get(2) + get(-2)


def reversed_sectors(limit: int = 5) -> Column:
    """Sectors whose IC has the other sign than the mean, the first `limit` by name."""
    entries = F.map_entries(F.coalesce(F.col("per_sector_ic"), F.create_map().cast("map<string,double>")))
    other = F.filter(F.array_sort(entries), lambda e: ((e["value"] < 0) & (F.col("ic_mean") >= 0)) | ((e["value"] > 0) & (F.col("ic_mean") < 0)))
    return F.slice(F.transform(other, lambda e: e["key"]), 1, limit)


def governance(results: DataFrame) -> DataFrame:
    """results with zero_type, zero_limit, failures (texts) and passed. A coverage failure stands alone."""
    percent = lambda c, places: F.format_string(f"%.{places}f%%", c * 100)
    table = results.withColumn("zero_type", zero_type())
    table = table.withColumn("zero_limit", F.when(F.col("zero_type") == "uniform", ZERO_UNIFORM).otherwise(ZERO_STRICT))
    zero, t, dc = F.coalesce("zero_ratio", F.lit(1.0)), F.coalesce("t_stat", F.lit(0.0)), F.coalesce("direction_consistency", F.lit(0.0))
    g1 = F.concat(F.lit("G1_coverage: "), percent(F.coalesce("coverage", F.lit(0.0)), 1), F.lit(" < 5%"))
    g2 = F.concat(F.lit("G2_zero_ratio: "), percent(zero, 1), F.lit(" >= "), percent(F.col("zero_limit"), 0), F.lit(" (zero_type="), "zero_type", F.lit(")"))
    g3 = F.concat(F.lit("G3_t_stat: |"), F.format_string("%.3f", t), F.lit(f"| < {LEAST_T}"))
    g4 = F.concat(F.lit("G4_direction: consistency="), percent(dc, 0), F.lit(" < 60%"))
    rest = F.array_compact(F.array(F.when(zero >= F.col("zero_limit"), g2), F.when(F.abs(t) < LEAST_T, g3), F.when(dc < LEAST_CONSISTENCY, g4)))
    failures = F.when(F.coalesce("coverage_failure", F.lit(False)), F.array(g1)).otherwise(rest)
    return table.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


@dataclass(frozen=True)
class Gate:
    """A named condition over a validation row."""

    name: str
    condition: Column


def coverage_gate(least: float = LEAST_COVERAGE) -> Gate:
    return Gate("G1_coverage", ~F.coalesce("coverage_failure", F.lit(False)) & (F.coalesce("coverage", F.lit(1.0)) >= least))


def zero_gate(uniform: float = ZERO_UNIFORM, strict: float = ZERO_STRICT) -> Gate:
    """Lenient for any even spread over sectors, systemic sparseness included; strict otherwise."""
    even = (F.size(_values("zero_by_sector")) >= 3) & (sector_variance() < 0.02)
    return Gate("G2_zero_ratio", F.coalesce("zero_ratio", F.lit(1.0)) < F.when(even, uniform).otherwise(strict))


def t_gate(least: float = LEAST_T) -> Gate:
    return Gate("G3_t_stat", F.abs(F.coalesce("t_stat", F.lit(0.0))) >= least)


def direction_gate(least: float = LEAST_CONSISTENCY) -> Gate:
    return Gate("G4_direction", F.coalesce("direction_consistency", F.lit(0.0)) >= least)


def drawdown_gate(most: float = MOST_DRAWDOWN) -> Gate:
    return Gate("G5_max_drawdown", F.abs(F.coalesce("max_drawdown", F.lit(0.0))) <= most)


@dataclass(frozen=True)
class Handler:
    """What is noted on a failed row, from its columns and failed_gates; null notes nothing, as does an error that the
    column's own try_ functions turn into null."""

    name: str
    note: Column


@dataclass(frozen=True)
class Pipeline:
    """Gates in order. `pre` gates stop at the first failure, `post` gates all run; handlers see every failed row; edits
    give a new pipeline."""

    pre: tuple[Gate, ...] = ()
    post: tuple[Gate, ...] = field(default_factory=lambda: (coverage_gate(), zero_gate(), t_gate(), direction_gate()))
    handlers: tuple[Handler, ...] = ()

    def add(self, gate: Gate, pre: bool = False) -> Pipeline:
        return replace(self, pre=(*self.pre, gate)) if pre else replace(self, post=(*self.post, gate))

    def remove(self, name: str) -> Pipeline:
        keep = lambda gates: tuple(g for g in gates if g.name != name)
        return replace(self, pre=keep(self.pre), post=keep(self.post))

    def insert_after(self, name: str, gate: Gate) -> Pipeline:
        """After the named post gate, or at the end if there is none."""
        at = next((k + 1 for k, g in enumerate(self.post) if g.name == name), len(self.post))
        return replace(self, post=(*self.post[:at], gate, *self.post[at:]))

    def swap(self, name: str, gate: Gate) -> Pipeline:
        there = lambda gates: tuple(gate if g.name == name else g for g in gates)
        return replace(self, pre=there(self.pre), post=there(self.post))

    @property
    def hooks(self) -> list[str]:
        return [g.name for g in (*self.pre, *self.post)]

    def describe(self) -> str:
        return "\n".join([f"pre:  {g.name}" for g in self.pre] + [f"post: {g.name}" for g in self.post])

    def run(self, results: DataFrame) -> DataFrame:
        """results with hook_results (gate -> passed), blocked_by, failed_by, failed_gates and gates_passed, and notes (handler ->
        text) of rows that failed or were blocked."""
        name = lambda g: F.when(~g.condition, F.lit(g.name))
        first = lambda gates: F.coalesce(*[name(g) for g in gates], F.lit(None).cast("string"))
        table = results.withColumn("blocked_by", first(self.pre))
        ran = F.map_from_arrays(F.array(*[F.lit(g.name) for g in self.post]), F.array(*[g.condition for g in self.post])) if self.post else F.create_map().cast("map<string,boolean>")
        failed = F.array_compact(F.array(*[name(g) for g in self.post], F.lit(None).cast("string")))
        open_ = F.col("blocked_by").isNull()
        out = (
            table.withColumn("hook_results", F.when(open_, ran)).withColumn("failed_gates", F.when(open_, failed).otherwise(F.array("blocked_by")))
            .withColumn("failed_by", F.when(open_, first(self.post))).withColumn("gates_passed", open_ & (F.size("failed_gates") == 0))
        )
        said = F.array_compact(F.array(*[F.when(h.note.isNotNull(), F.struct(F.lit(h.name).alias("key"), h.note.cast("string").alias("value"))) for h in self.handlers]))
        notes = F.map_from_entries(said) if self.handlers else F.create_map().cast("map<string,string>")
        return out.withColumn("notes", F.when(~F.col("gates_passed"), notes))


    def run_with_executor(self, rows: DataFrame, executor: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows that no pre gate blocks go through the executor, which may add columns, and then the post gates; blocked
        ones keep nulls there. rows are stored first, so that both ways see the same ones."""
        rows = stored(rows, "gated")
        checked = replace(self, post=(), handlers=()).run(rows).select(*rows.columns, "blocked_by")
        done = replace(self, pre=()).run(executor(checked.filter("blocked_by is null").drop("blocked_by")))
        blocked = replace(self, post=()).run(rows).filter("blocked_by is not null")
        return done.unionByName(blocked, allowMissingColumns=True)


def symptom_queries() -> Column:
    """At most two search texts for a failed result."""
    zero, t, dc, ic = F.coalesce("zero_ratio", F.lit(0.0)), F.abs(F.coalesce("t_stat", F.lit(0.0))), F.coalesce("direction_consistency", F.lit(1.0)), F.abs(F.coalesce("ic_mean", F.lit(0.0)))
    high = F.when(zero >= 0.45, F.when(t >= 1.5, QUERY_SPARSE).otherwise(QUERY_AMBIGUOUS))
    weak = F.when((t < 1.5) & (zero < 0.45) & (ic < 0.04), F.when(polar_share() > 0.65, QUERY_BIMODAL).otherwise(QUERY_WEAK))
    found = F.array_compact(F.array(high, weak, F.when(dc < 0.60, QUERY_SECTOR)))
    return F.when(F.coalesce("coverage_failure", F.lit(False)), F.array(F.lit(QUERY_COVERAGE))).when(F.size(found) == 0, F.array(F.lit(QUERY_DEFAULT))).otherwise(F.slice(found, 1, 2))


def only_zero_failures() -> Column:
    """Every failure is about the zero ratio, and there is one at least."""
    return (F.size("failures") > 0) & F.forall("failures", lambda f: f.contains("G2_zero_ratio"))


def salvageable(results: DataFrame, explored: DataFrame) -> DataFrame:
    """results with `salvageable`: strong signal that fails on zeros only, or few zeros with a weak signal; once at most.

    explored has a column feature of names tried before.
    """
    ic, t, zero = F.abs(F.coalesce("ic_mean", F.lit(0.0))), F.abs(F.coalesce("t_stat", F.lit(0.0))), F.coalesce("zero_ratio", F.lit(1.0))
    standard = (ic > SALVAGE_IC) & (t > SALVAGE_T) & only_zero_failures()
    proven = (zero < SALVAGE_ZERO) & (ic > SALVAGE_IC_LOW) & (t > SALVAGE_T_LOW)
    tried = explored.select(F.regexp_replace("feature", "_v2$", "").alias("feature"), F.lit(True).alias("tried")).where(explored["feature"].endswith("_v2")).distinct()
    able = ~F.coalesce("coverage_failure", F.lit(False)) & ~F.col("feature").endswith("_v2") & F.col("tried").isNull() & (standard | proven) & (proven | (zero_type() != "uniform"))
    return results.join(tried, "feature", "left").withColumn("salvageable", able).drop("tried")


def blocker() -> Column:
    """Why a result that failed on zeros gets no repair, the first reason that holds; null if none does. Needs the column
    salvageable."""
    return (
        F.when(F.col("salvageable"), None).when(F.col("feature").endswith("_v2"), "already repaired").when(~only_zero_failures(), "other failures")
        .when(F.abs("ic_mean") <= SALVAGE_IC, "weak ic").when(F.abs("t_stat") <= SALVAGE_T, "weak t").when(zero_type() == "uniform", "uniform zeros").otherwise("tried before")
    )


def zero_only_candidates(results: DataFrame) -> DataFrame:
    """Failed results whose single failure is the zero ratio, strongest first."""
    one = (F.size("failures") == 1) & F.get("failures", F.lit(0)).contains("G2_zero_ratio")
    return results.filter(~F.col("passed") & ~F.coalesce("coverage_failure", F.lit(False)) & one).orderBy(F.desc(F.abs("ic_mean")), "feature")


def failure_mode(sections: Column, definition: Column) -> Column:
    """The first failure mode that fits: G1, F, A, B, E, D, G, C or edge."""
    dist, years = "score_dist", F.coalesce("zero_by_year", F.create_map().cast("map<string,double>"))
    ic, t, zero, dc = F.abs("ic_mean"), F.abs("t_stat"), F.col("zero_ratio"), F.coalesce("direction_consistency", F.lit(1.0))
    zero_scores = F.coalesce(F.try_element_at(dist, F.lit("0.0")), F.try_element_at(dist, F.lit("0")), F.lit(0.0))
    early = F.size(F.filter(F.map_entries(years), lambda e: (e["value"] > 0.60) & (e["key"].cast("int") <= 2017)))
    both = F.coalesce(F.array_contains(sections, "prepared") & F.array_contains(sections, "qa"), F.lit(False))
    external = reduce(lambda a, b: a | b, [definition.contains(w) for w in EXTERNAL])
    top = F.coalesce(F.array_max(_values(dist)), F.lit(0.0))
    return (
        F.when(F.coalesce("coverage_failure", F.lit(False)), "G1").when(both & (ic < 0.03), "F").when((zero > 0.50) | (zero_scores > 0.55), "A")
        .when((polar_share() > 0.65) & (ic < 0.04), "B").when(early >= 2, "E").when(dc < 0.60, "D")
        .when((ic < 0.02) & (zero < 0.20) & (t < 0.8), F.when(external, "G").otherwise("C")).when((t < 1.5) & (zero < 0.35) & (top < 0.60), "C").otherwise("edge")
    )


def worst(c: str, n: int = 3, ascending: bool = False) -> Column:
    """The n keys of a map with the largest (or least) values, ties by key."""
    entries = F.transform(F.map_entries(c), lambda e: F.struct((e["value"] if ascending else -e["value"]).alias("v"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["k"])


def repair_spec(spec: Column) -> Column:
    """The spec of a repaired version: `_v2` name and a pointer to what it repairs."""
    return spec.withField("_repair_of", spec["feature_name"]).withField("feature_name", F.concat(spec["feature_name"], F.lit("_v2")))


FALLBACK_FIX = {
    "G1": "widen the condition scope or reword the retrieval query", "F": "score prepared remarks and answers as two features", "A": "say in the instruction which words earn each score",
    "B": "narrow the score range or separate strong from weak wording", "E": "widen section and speaker filters for early years", "D": "limit the feature to one sector or score relative to it",
    "G": "define the feature by what a transcript itself holds", "C": "drop this direction and start from another theory", "edge": "adjust scope, query or top_k slightly",
}


def rule_diagnosis(mode: Column) -> Column:
    """A struct (root_cause, fix) that needs no model."""
    fixes = F.create_map(*[F.lit(x) for kv in FALLBACK_FIX.items() for x in kv])
    return F.struct(F.concat(F.lit("failure mode "), mode).alias("root_cause"), fixes[mode].alias("fix"))

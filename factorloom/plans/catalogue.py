"""The query catalogue: each query composes the library's operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.functions.columns import clip, no_signal, split_of
from factorloom.operators import asof, chunking, context, diagnosis, evaluation, fusion, gates, gram_index, history, panel, portfolio, quantile_sketches, retrieval, scoring, vector_index
from factorloom.plans import domain as D
from factorloom.plans import oracle
from factorloom.sources import readers
from factorloom.sources.scratch import fresh_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def _rows(s: SparkSession, d: str) -> DataFrame:
    return panel.joined(D.panel(s, d), D.features(s, d))


def _test(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("year").isin(D.TEST))


def _fused(s: SparkSession, d: str) -> DataFrame:
    return fusion.fusion_table(D.panel(s, d), D.features(s, d), D.WEIGHTS, 1995)


# -- panel


@query
def flagship_nw_ic(s: SparkSession, d: str) -> DataFrame:
    """Sector-neutral quarterly IC of every feature with its Newey-West t."""
    rows = panel.joined(panel.with_neutral(D.panel(s, d)), D.features(s, d))
    return evaluation.newey_west(evaluation.ic_series(_test(rows), y="move_neutral")).select("feature", r6("ic_mean"), r6("t_stat"), "n_quarters")


@query
def ic_series(s: SparkSession, d: str) -> DataFrame:
    return evaluation.ic_series(_rows(s, d)).select("feature", "year", "quarter", r6("ic"), "n")


@query
def mean_ic(s: SparkSession, d: str) -> DataFrame:
    return evaluation.mean_ic(evaluation.ic_series(_test(_rows(s, d)))).select("feature", r6("ic_mean"))


@query
def season_ic(s: SparkSession, d: str) -> DataFrame:
    return evaluation.season_ic(_test(_rows(s, d))).select("feature", "season", r6("ic"))


@query
def sector_ic(s: SparkSession, d: str) -> DataFrame:
    return evaluation.sector_ic(_test(_rows(s, d))).select("feature", "sector", r6("ic"))


@query
def direction_consistency(s: SparkSession, d: str) -> DataFrame:
    test = _test(_rows(s, d))
    return evaluation.direction_consistency(evaluation.sector_ic(test), evaluation.mean_ic(evaluation.ic_series(test))).select("feature", r6("direction_consistency"))


@query
def zero_ratio(s: SparkSession, d: str) -> DataFrame:
    return evaluation.zero_ratio(_rows(s, d)).select("feature", r6("zero_ratio"))


def _winsorized(s: SparkSession, d: str) -> DataFrame:
    """Stored once, as bounds read the joined rows several times."""
    rows = stored(_rows(s, d), "joined")
    return panel.winsorized(rows, panel.winsor_bounds(rows, D.TRAIN))


@query
def zero_by_sector(s: SparkSession, d: str) -> DataFrame:
    """Of winsorised values, like the other maps that gates read."""
    return evaluation.zero_ratio(_winsorized(s, d), ["sector"]).select("feature", "sector", r6("zero_ratio"))


@query
def zero_by_year(s: SparkSession, d: str) -> DataFrame:
    rows = _winsorized(s, d).withColumn("calendar", F.year("earnings_date"))
    return evaluation.zero_ratio(rows, ["calendar"]).select("feature", "calendar", r6("zero_ratio"))


@query
def score_dist(s: SparkSession, d: str) -> DataFrame:
    """Shares of every feature's winsorised scores."""
    return evaluation.score_distribution(_winsorized(s, d)).withColumn("score", F.round("score", 6)).select("feature", "score", r6("share"))


@query
def coverage(s: SparkSession, d: str) -> DataFrame:
    found = evaluation.coverage_failure(evaluation.test_coverage(D.panel(s, d), D.features(s, d), D.TEST))
    return found.select("feature", "n_test", "n_panel", r6("coverage"), "coverage_failure")


@query
def winsorize_bounds(s: SparkSession, d: str) -> DataFrame:
    return panel.winsor_bounds(_rows(s, d), D.TRAIN).select("feature", r6("low"), r6("high"))


@query
def sketched_bounds(s: SparkSession, d: str) -> DataFrame:
    """The same bounds of a panel that grows by a year at a time, by sketches kept for each file."""
    rows, path = stored(_rows(s, d).select("feature", "year", "value"), "joined"), fresh_path(s, "years")
    store = quantile_sketches.SketchStore(s, fresh_path(s, "sketches"), path, D.TRAIN)
    for some in (D.TRAIN[:1], D.TRAIN[1:]):
        rows.filter(F.col("year").isin(some)).write.mode("append").parquet(path)
        store.update()
    return store.bounds().select("feature", r6("low"), r6("high"))


@query
def winsorized_panel(s: SparkSession, d: str) -> DataFrame:
    return _winsorized(s, d).select("feature", "episode", r6("value"))


@query
def zscore_panel(s: SparkSession, d: str) -> DataFrame:
    return panel.with_target(D.panel(s, d)).select("episode", r6("target"))


@query
def sector_demean(s: SparkSession, d: str) -> DataFrame:
    """A seventh of it, so that no exact tie meets the rounding."""
    return panel.with_neutral(D.panel(s, d)).select("episode", r6(F.col("move_neutral") / 7, "move_neutral"))


@query
def split_counts(s: SparkSession, d: str) -> DataFrame:
    rows = D.panel(s, d).withColumn("part", split_of(F.col("year"), D.TRAIN, D.VALID, D.TEST))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query
def sector_encoding(s: SparkSession, d: str) -> DataFrame:
    coded = panel.with_sector_code(D.panel(s, d))
    return coded.groupBy("sector", "sector_code").agg(F.count(F.lit(1)).alias("n"))


@query
def symbol_sector(s: SparkSession, d: str) -> DataFrame:
    return panel.first_sector(D.panel(s, d))


@query
def symbol_year_filter(s: SparkSession, d: str) -> DataFrame:
    return panel.of_symbols(D.panel(s, d), list(range(1, 60)), [1996, 1999]).select("episode", "symbol", F.date_format("earnings_date", "yyyy-MM-dd").alias("day"))


@query
def asof_features(s: SparkSession, d: str) -> DataFrame:
    """Every episode with its symbol's latest shipping day at or before it, and what was shipped then."""
    shipped = D.table(s, d, "lineitem").join(D.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("symbol"), F.col("l_shipdate").alias("shipped_on")).agg(F.sum(F.col("l_quantity").cast("long")).alias("shipped"))
    found = asof.asof_join(D.panel(s, d).select("symbol", "episode", "earnings_date"), shipped, "symbol", "earnings_date", "shipped_on")
    return found.select("symbol", "episode", F.date_format("shipped_on", "yyyy-MM-dd").alias("day"), "shipped")


@query
def null_rate(s: SparkSession, d: str) -> DataFrame:
    """After a left join, so that episodes without lines are null."""
    rows = D.panel(s, d).select("episode").join(D.features(s, d).filter("feature = 'score'"), "episode", "left").withColumn("feature", F.lit("score"))
    return evaluation.null_rate(rows).select("feature", r6("null_rate"))


@query
def test_share(s: SparkSession, d: str) -> DataFrame:
    return evaluation.test_share(D.panel(s, d), 1999).select("n", "n_test", r6("share"), "warn")


@query
def validation_metrics(s: SparkSession, d: str) -> DataFrame:
    """The scalar metrics that the gates read, from one evaluation of all features."""
    return evaluation.validation(D.panel(s, d), D.features(s, d), D.TRAIN, D.TEST).select("feature", r6("coverage"), "coverage_failure", r6("ic_mean"), r6("t_stat"), "n_quarters", r6("zero_ratio"), r6("direction_consistency"))


@query
def validation_maps(s: SparkSession, d: str) -> DataFrame:
    """The maps that the gates and reports read, as rows: IC by sector and season, zeros by sector and year, scores (in
    millionths)."""
    found = evaluation.validation(D.panel(s, d), D.features(s, d), D.TRAIN, D.TEST)
    names = ["per_sector_ic", "season_ic", "zero_by_sector", "zero_by_year", "score_dist"]
    maps = F.array(*[F.struct(F.lit(n).alias("map"), F.col(n).alias("of")) for n in names])
    rows = found.select("feature", F.explode(maps).alias("m")).select("feature", "m.map", F.explode("m.of").alias("key", "value"))
    return rows.withColumn("key", F.when(F.col("map") == "score_dist", F.round(F.col("key").cast("double") * 1_000_000).cast("long").cast("string")).otherwise(F.col("key"))).groupBy("feature", "map", "key").agg(F.round(F.sum("value"), 6).alias("value"))


def _returns(s: SparkSession, d: str) -> DataFrame:
    """Test rows with the standardised move, in hundredths, as their return."""
    rows = _test(panel.joined(panel.with_target(D.panel(s, d)), D.features(s, d)))
    return rows.withColumn("ret", F.col("target") / 100)


@query
def quantile_buckets(s: SparkSession, d: str) -> DataFrame:
    """Five buckets of every feature's cross-sections, and how many rows each has."""
    return portfolio.bucketed(_rows(s, d)).groupBy("feature", "year", "quarter", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query
def portfolio_path(s: SparkSession, d: str) -> DataFrame:
    return portfolio.path(portfolio.long_short(_returns(s, d))).select("feature", "year", "quarter", r6("spread"), r6("wealth"), r6("drawdown"))


@query
def portfolio_risk(s: SparkSession, d: str) -> DataFrame:
    """Long-short spread, information ratio, ICIR and maximum drawdown of every feature."""
    return portfolio.risk(_returns(s, d)).select("feature", "n_quarters", r6("spread_mean"), r6("information_ratio"), r6("icir"), r6("wealth"), r6("max_drawdown"))


@query
def drawdown_gate(s: SparkSession, d: str) -> DataFrame:
    """Gates over the validation of the features, G5 with their portfolios' drawdown."""
    found = portfolio.with_drawdown(evaluation.validation(D.panel(s, d), D.features(s, d), D.TRAIN, D.TEST), portfolio.risk(_returns(s, d)))
    ran = gates.Pipeline(post=(gates.coverage_gate(), gates.t_gate(), gates.direction_gate(), gates.drawdown_gate())).run(found)
    return ran.select("feature", r6("max_drawdown"), F.array_join("failed_gates", ",").alias("failed"))


# -- fusion


@query
def feature_wide(s: SparkSession, d: str) -> DataFrame:
    return panel.wide(D.panel(s, d), D.features(s, d), D.NAMES).select("episode", *[r6(n) for n in D.NAMES])


@query
def fusion_equal(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("episode", r6("fusion_equal"), "text_covered")


@query
def fusion_icw(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("episode", r6("fusion_icw"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return fusion.long_scores(_fused(s, d).filter("target is not null"), [*D.NAMES, "fusion_equal", "fusion_icw"])


@query
def single_factor_ic(s: SparkSession, d: str) -> DataFrame:
    return fusion.ic_table(_test(_scores(s, d))).select("feature", r6("ic_mean"), r6("t_stat"), "n_quarters")


@query
def annual_ic(s: SparkSession, d: str) -> DataFrame:
    return fusion.annual_ic(_scores(s, d)).select("feature", "year", r6("ic"), "n")


@query
def valid_year_ic(s: SparkSession, d: str) -> DataFrame:
    return fusion.annual_ic(_scores(s, d).filter(F.col("year").isin(D.VALID))).select("feature", r6("ic"), "n")


@query
def covered_ic(s: SparkSession, d: str) -> DataFrame:
    return fusion.covered_ic(_test(_scores(s, d))).select("feature", r6("ic_mean"), r6("ic_all"), r6("delta"))


@query
def spearman_matrix(s: SparkSession, d: str) -> DataFrame:
    return fusion.feature_correlation(panel.wide(D.panel(s, d), D.features(s, d), D.NAMES), D.NAMES).select("left", "right", r6("rho"))


@query
def fusion_report(s: SparkSession, d: str) -> DataFrame:
    """The assembled table of every score: IC, t, covered IC, and the pooled IC of the validation year."""
    scores = _scores(s, d)
    valid = fusion.annual_ic(scores.filter(F.col("year").isin(D.VALID))).select("feature", F.col("ic").alias("ic_valid"))
    return fusion.report(_test(scores), valid).select("feature", r6("ic_mean"), r6("t_stat"), "n_quarters", r6("ic_covered"), r6("delta"), r6("ic_valid"))


@query
def feature_importance(s: SparkSession, d: str) -> DataFrame:
    """The gain of a boosted model's splits, a row a column, largest first."""
    model = fusion.fit_boosted(_fused(s, d), D.NAMES, D.TRAIN)
    return s.createDataFrame(fusion.feature_importance(model), "feature string, importance double")


@query
def gbt_fusion(s: SparkSession, d: str) -> DataFrame:
    table = fusion.boosted(_fused(s, d), D.NAMES, D.TRAIN)
    return fusion.neutral_prediction(table).select("episode", "prediction", "prediction_neutral")


# -- gates


@query
def zero_type(s: SparkSession, d: str) -> DataFrame:
    return D.results(s, d).select("feature", gates.zero_type().alias("zero_type"))


@query
def governance(s: SparkSession, d: str) -> DataFrame:
    found = gates.governance(D.results(s, d))
    return found.select("feature", "passed", F.array_join(F.transform("failures", lambda f: F.substring_index(f, ":", 1)), ",").alias("failed"))


@query
def gate_matrix(s: SparkSession, d: str) -> DataFrame:
    ran = gates.Pipeline().run(D.results(s, d))
    return ran.select("feature", *[F.col("hook_results")[n].alias(n[:2].lower()) for n in history.GATES], "failed_by", "gates_passed")


@query
def gate_failures(s: SparkSession, d: str) -> DataFrame:
    """All five gates, drawdown included, as a pipeline with a gate before them; what its handlers note on failed rows."""
    k = F.col("k")
    rows = D.results(s, d).withColumn("max_drawdown", F.when(k % 4 > 0, (k % 9) / F.lit(100.0)))
    known = gates.Gate("known", k % 10 != 3)
    notes = (gates.Handler("sparse", F.when(F.array_contains("failed_gates", "G2_zero_ratio"), F.concat(F.lit("zeros of "), "feature"))), gates.Handler("count", F.size("failed_gates").cast("string")))
    ran = gates.Pipeline(handlers=notes).add(known, pre=True).add(gates.drawdown_gate()).run(rows)
    return ran.select("feature", "blocked_by", "failed_by", F.array_join("failed_gates", ",").alias("failed"), "gates_passed", F.col("notes")["sparse"].alias("sparse"), F.col("notes")["count"].alias("n_failed"))


@query
def gate_executor(s: SparkSession, d: str) -> DataFrame:
    """Governance as the step between the gates: it runs on what no pre gate blocks."""
    known = gates.Gate("known", F.col("k") % 10 != 3)
    ran = gates.Pipeline().add(known, pre=True).run_with_executor(D.results(s, d), gates.governance)
    return ran.select("feature", "blocked_by", "passed", "failed_by", "gates_passed")


@query
def reversed_sectors(s: SparkSession, d: str) -> DataFrame:
    return D.results(s, d).select("feature", F.array_join(gates.reversed_sectors(), ",").alias("sectors"))


@query
def worst_sectors(s: SparkSession, d: str) -> DataFrame:
    return D.results(s, d).select("feature", F.array_join(gates.worst("zero_by_sector"), ",").alias("worst"), r6(gates.polar_share(), "polar"))


@query
def rag_queries(s: SparkSession, d: str) -> DataFrame:
    return D.results(s, d).select("feature", F.array_join(gates.symptom_queries(), " || ").alias("queries"))


def _salvage(s: SparkSession, d: str) -> DataFrame:
    found = gates.governance(D.results(s, d))
    return gates.salvageable(found, found.filter("k % 6 = 1").select(F.concat("feature", F.lit("_v2")).alias("feature")))


@query
def salvageable(s: SparkSession, d: str) -> DataFrame:
    return _salvage(s, d).select("feature", "salvageable")


@query
def salvage_report(s: SparkSession, d: str) -> DataFrame:
    return gates.zero_only_candidates(_salvage(s, d)).select("feature", "salvageable", gates.blocker().alias("blocker"))


def _mode() -> Column:
    sections = F.when(F.col("k") % 4 == 0, F.array(F.lit("prepared"), F.lit("qa"))).otherwise(F.array(F.lit("qa")))
    return gates.failure_mode(sections, F.when(F.col("k") % 3 == 0, "beat vs consensus").otherwise("tone"))


@query
def failure_mode(s: SparkSession, d: str) -> DataFrame:
    return D.results(s, d).select("feature", _mode().alias("mode"))


@query
def rule_diagnoses(s: SparkSession, d: str) -> DataFrame:
    """Diagnoses of all results where no model is at hand."""
    return diagnosis.diagnosed(gates.governance(D.results(s, d)), _mode()).select("feature", "mode", "fix", "avoid", "source")


# -- retrieval


@query
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(D.chunks(s, d), D.vector(s, d, 0), 10).select("chunk_id", r6("score"))


@query
def scoped_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.scoped_top_k(D.chunks(s, d), D.vector(s, d, 1), 20, 10**9, ["qa"], ["mgmt"]).select("chunk_id", "section_type", r6("score"))


@query
def sector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.scoped_top_k(D.chunks(s, d), D.vector(s, d, 2), 20, 10**9, sector="s1").select("chunk_id", r6("score"))


@query
def multi_query_topk(s: SparkSession, d: str) -> DataFrame:
    queries = D.table(s, d, "embeddings").filter("vec_id in (3, 4)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.multi_query_top_k(D.chunks(s, d), queries, 4, 8, ["page_num"]).select("page_num", "chunk_id", r6("score"))


@query
def all_vectors_topk(s: SparkSession, d: str) -> DataFrame:
    """Every vector as a query: its five best vectors, itself among them."""
    queries = D.table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search(vector_index.build(D.chunks(s, d), block=64), queries, 5).select("query_id", F.col("key").alias("chunk_id"), r6("score"), "rank")


@query
def memory_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.memory_top_k(D.chunks(s, d), D.vector(s, d, 5), 5, 0.1, "chunk_id").select("chunk_id", r6("score"))


@query
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    v = retrieval.normalised(F.transform("embedding", lambda x: x * 3))
    return D.chunks(s, d).select("chunk_id", r6(F.get(v, F.lit(0)), "first"), r6(retrieval.inner_product(v, v), "norm"))


@query
def pooled_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors as four token vectors each, the third masked for odd labels, summed up in both ways."""
    rows = D.table(s, d, "embeddings").withColumn("tokens", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, F.lit(16))))
    mask = F.array(F.lit(1), F.lit(1), F.when(F.col("label") % 2 == 0, 1).otherwise(0), F.lit(1))
    first, mean = scoring.cls_pooled(F.col("tokens")), scoring.mean_pooled(F.col("tokens"), mask)
    unit = retrieval.normalised(mean)
    return rows.select("vec_id", r6(F.get(first, F.lit(15)), "first"), r6(F.get(mean, F.lit(3)), "mean"), r6(F.get(unit, F.lit(3)), "unit"))


@query
def episode_head(s: SparkSession, d: str) -> DataFrame:
    scored = retrieval.scored(D.chunks(s, d), D.vector(s, d, 0))
    return retrieval.head_by_episode(scored, 3).select("episode", "chunk_id", "rank", r6("score"))


@query
def batch_assign(s: SparkSession, d: str) -> DataFrame:
    return retrieval.in_batches(D.panel(s, d).select("symbol", "episode"), ["symbol", "episode"], 50).select("episode", "batch")


@query
def stratified_quota(s: SparkSession, d: str) -> DataFrame:
    return retrieval.year_quotas(D.panel(s, d), 400)


@query
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """How many rows each year's sample has: its quota."""
    return retrieval.stratified_sample(D.panel(s, d), 400).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    found = D.records(s, d).withColumnRenamed("feature", "feature_name")
    return retrieval.keyword_search(found, "G2_zero weak feat_12 BRAND#1", 5).select("line_no", F.col("score").cast("long").alias("score"))


def _searches(s: SparkSession, d: str) -> tuple[gram_index.GramIndex, DataFrame]:
    """All records as a memory, and a query for every name and brand of parts."""
    found = D.records(s, d).withColumnRenamed("feature", "feature_name")
    index = gram_index.GramIndex(s, fresh_path(s, "grams")).add(found)
    asked = D.table(s, d, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand", F.lit("G3_t 7"), F.concat(F.lit("FEAT_"), F.length("p_name")), F.lit("absent")).alias("query"))
    return index, asked.distinct()


@query
def memory_search(s: SparkSession, d: str) -> DataFrame:
    """The three best records of every query, by postings of 3-grams."""
    return gram_index.search(*_searches(s, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "line_no", "score")


@query
def memory_postings(s: SparkSession, d: str) -> DataFrame:
    """What the words of those queries read: lists and postings."""
    return gram_index.postings_read(*_searches(s, d))


@query
def prompt_text(s: SparkSession, d: str) -> DataFrame:
    turns = D.turns(s, d).withColumn("rank", F.col("turn"))
    return retrieval.prompt_text(turns, "conv_id", 40)


def _prompts(s: SparkSession, d: str) -> DataFrame:
    """A prompt a conversation: its system turns, its last user turn as task, its latest turns as memory, its assistant
    turns as hints, and one of the strategies."""
    turns = D.table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    parts = turns.groupBy("conv_id").agg(said("system").alias("system"), F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("task"), said("assistant").alias("hints"))
    lines = turns.select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    memory = context.recent_within(lines, "conv_id", "turn", "line", 120).withColumnRenamed("recent", "memory")
    strategy = F.get(F.array(*[F.lit(x) for x in (context.WINDOW, context.SUMMARY, context.RETRIEVAL)]), (F.col("conv_id") % 3).cast("int"))
    return parts.join(memory, "conv_id", "left").withColumn("strategy", strategy)


def _assembled(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.md5("context").alias("digest"), "system_tokens", "task_tokens", "session_tokens", "total_tokens", r6("utilization"))


@query
def context_assembly(s: SparkSession, d: str) -> DataFrame:
    """Contexts of 400 tokens by all three strategies, each part within its own share."""
    return _assembled(context.assembled(_prompts(s, d), 400))


@query
def context_passed_on(s: SparkSession, d: str) -> DataFrame:
    """The same with unused budget passed on to the next part."""
    return _assembled(context.assembled(_prompts(s, d), 400, pass_on=True))


# -- text


@query
def qa_boundary(s: SparkSession, d: str) -> DataFrame:
    """On conversations one in three of which gets a line that opens questions."""
    opened = F.when(F.col("symbol") % 3 == 0, F.concat("transcript", F.lit("\nQuestions and Answers\nAnalyst: thanks"))).when(F.col("symbol") % 3 == 1, F.concat(F.lit("We will now begin the question round\n"), "transcript")).otherwise(F.col("transcript"))
    return D.calls(s, d).select("symbol", T.qa_line(opened).alias("line"), F.length(T.qa_part(opened)).alias("qa_chars"))


@query
def section_type(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Your Question please"))).otherwise(F.col("text"))
    return D.table(s, d, "conversations").select("conv_id", "turn", T.section_type(text).alias("section_type"))


@query
def speaker_role(s: SparkSession, d: str) -> DataFrame:
    """Of names as they stand in calls, followed by a whole document, and of the name alone."""
    name = F.get(F.array(*[F.lit(x) for x in ("", "Q - Jo", "The Operator", "Ann Lee, Morgan Stanley", "Sue Roe, CFO", "Sam")]), (F.col("doc_id") % 6).cast("int"))
    said = F.concat(name, F.when(F.col("n_chars") % 5 > 0, F.col("text")).otherwise(""))
    return D.table(s, d, "documents").select("doc_id", T.speaker_role(said).alias("role"))


@query
def noise_lines(s: SparkSession, d: str) -> DataFrame:
    """Noise among document lines and a few planted ones."""
    lines = D.table(s, d, "documents").select("doc_id", F.explode(T.lines(F.concat("text", F.lit("\nForm 8-K\nsee report.pdf\n$1,2,3,4 12,000\n")))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(T.release_noise(F.col("line")), 1)).alias("noise"))


@query
def paper_lines(s: SparkSession, d: str) -> DataFrame:
    lines = D.table(s, d, "documents").select("doc_id", F.explode(T.lines(F.concat("text", F.lit("\nReferences\ndoi:10.1\n12 \n")))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.when(T.paper_noise(F.col("line")), 1)).alias("noise"))


@query
def paper_clean(s: SparkSession, d: str) -> DataFrame:
    return D.table(s, d, "documents").select("doc_id", F.md5(T.paper_text(F.col("text"))).alias("digest"))


@query
def score_parse(s: SparkSession, d: str) -> DataFrame:
    """Replies made from order keys and prices: scores in and out of range, repeated lines, notes, missing lines."""
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    reply = F.concat_ws("\n", F.concat(F.lit("1: "), cents % 7 - 3), F.concat(F.lit("2: +"), cents % 4, F.lit("."), cents % 90 + 10), F.concat(F.lit(" 3 : -0."), k % 10), F.lit("notes: none"), F.when(cents % 2 == 0, F.lit("1: 0.5")))
    found = T.score_lines(reply, -2, 2)
    return D.table(s, d, "orders").select(k.alias("episode"), *[F.try_element_at(found, F.lit(n)).alias(f"s{n}") for n in (1, 2, 3, 4)], T.first_number(reply, -2, 2).alias("first"))


@query
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("营收增长"))
    return D.table(s, d, "documents").select("doc_id", T.token_estimate(text).alias("tokens"), F.length(T.truncated(text, 100)).alias("cut_chars"))


@query
def name_normalise(s: SparkSession, d: str) -> DataFrame:
    name = T.feature_name(F.col("p_name"))
    return D.table(s, d, "part").select("p_partkey", name.alias("name"), T.distinct_name(name, F.array(F.lit("part_1"), F.lit("part_2"))).alias("unique_name"), T.base_name(F.concat(name, F.lit("_v2_v2"))).alias("base"), T.direction(F.get(F.array(*[F.lit(x) for x in ("+", "-", "Up", "1", "down")]), (F.col("p_partkey") % 5).cast("int"))).alias("direction"))


@query
def reply_parse(s: SparkSession, d: str) -> DataFrame:
    """Fenced JSON, labelled lines and metrics in replies."""
    k = F.col("p_partkey").cast("string")
    fenced = F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))
    lines = F.concat(F.lit("cause: c"), k, F.lit("\nfix:  f"), k)
    seen = F.concat(F.lit("done IC=+0.1"), k, F.lit(" t=-2.5 zero_ratio=30%"))
    return D.table(s, d, "part").select("p_partkey", T.json_in(fenced).alias("json"), T.labelled(lines, "cause").alias("cause"), T.labelled(lines, "fix").alias("fix"), T.labelled(lines, "avoid", F.lit("")).alias("avoid"), T.key_metrics(seen).alias("metrics"))


@query
def argument_masks(s: SparkSession, d: str) -> DataFrame:
    args = F.create_map(F.lit("api_key"), F.lit("x"), F.lit("_own"), F.lit("y"), F.lit("text"), F.repeat("p_name", F.lit(30)))
    safe = T.sanitised(args)
    names = F.get(F.array(F.lit("ReadTimeout"), F.lit("ValueError"), F.lit("KeyError")), (F.col("p_partkey") % 3).cast("int"))
    words = F.get(F.array(F.lit("Please Try Again"), F.lit("bad value"), F.lit("none"), F.lit("Rate limit")), (F.col("p_partkey") % 4).cast("int"))
    return D.table(s, d, "part").select("p_partkey", safe["api_key"].alias("key"), F.length(safe["text"]).alias("text_chars"), F.size(safe).alias("n_args"), T.retryable(names, words).alias("again"), F.length(T.summary(F.repeat("p_name", F.lit(20)))).alias("summary_chars"))


@query
def chunk_counts(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_counts(D.turns(s, d)).select("section_type", "speaker_role", "n", r6("mean_length"))


@query
def paper_counts(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks_by_paper(D.pages(s, d))


@query
def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "conversations").select("conv_id", "turn", "text")
    return chunking.with_chunk_ids(rows, ["conv_id", "turn"], 60).select("conv_id", "turn", "chunk_id")


@query
def transcript_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.transcript_chunks(D.calls(s, d))


@query
def press_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = D.table(s, d, "documents").select(F.col("doc_id").alias("symbol"), F.lit("2020-01-01").alias("earnings_date"), F.col("text").alias("release"))
    return chunking.release_chunks(docs)


@query
def paper_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.paper_chunks(D.pages(s, d))


@query
def lexicon_scores(s: SparkSession, d: str) -> DataFrame:
    """Of whole documents; some get words that count."""
    more = F.get(F.array(F.lit(" strong Growth"), F.lit(" weak risk lower"), F.lit(""), F.lit(" exceeds, records MISSED. Raised")), (F.col("n_chars") % 4).cast("int"))
    return D.table(s, d, "documents").select("doc_id", scoring.lexicon_score(F.concat("text", more)).alias("value"))


# -- logs


@query
def trace_stats(s: SparkSession, d: str) -> DataFrame:
    found = history.run_stats(D.steps(s, d))
    return found.withColumn("total_latency_ms", F.round("total_latency_ms", 4)).withColumn("tool_success_rate", r6("tool_success_rate")).withColumn("avg_steps_per_iteration", r6("avg_steps_per_iteration"))


@query
def states_visited(s: SparkSession, d: str) -> DataFrame:
    return history.states_visited(D.steps(s, d)).select("run_id", F.array_join("states", ">").alias("states"))


@query
def decision_counts(s: SparkSession, d: str) -> DataFrame:
    return history.counts_by(D.steps(s, d), "decision")


@query
def tool_metrics(s: SparkSession, d: str) -> DataFrame:
    return history.tool_metrics(D.steps(s, d)).select("tool_called", "calls", r6("success_rate"), F.round("mean_latency_ms", 4).alias("mean_latency_ms"))


@query
def divergence_point(s: SparkSession, d: str) -> DataFrame:
    return history.divergence_point(D.steps(s, d))


@query
def trace_metrics(s: SparkSession, d: str) -> DataFrame:
    return history.trace_metrics(D.steps(s, d))


@query
def step_lines(s: SparkSession, d: str) -> DataFrame:
    return D.steps(s, d).select("step_id", T.step_summary().alias("line"))


@query
def failure_patterns(s: SparkSession, d: str) -> DataFrame:
    return history.failure_patterns(D.records(s, d), 50)


@query
def pass_rate(s: SparkSession, d: str) -> DataFrame:
    return history.pass_rate(D.records(s, d)).select(r6("pass_rate"), "n")


@query
def recent_failures(s: SparkSession, d: str) -> DataFrame:
    return history.with_failure(D.records(s, d), "G3", 4).select("line_no", "feature")


@query
def episode_lines(s: SparkSession, d: str) -> DataFrame:
    named = D.records(s, d).withColumnRenamed("feature", "feature_name").withColumnRenamed("ic_mean", "ic")
    return named.select("line_no", T.episode_summary().alias("line"))


@query
def patch_merge(s: SparkSession, d: str) -> DataFrame:
    found = D.records(s, d)
    patches = found.select(F.concat(F.lit("feat_"), (F.col("line_no") % 40).cast("string")).alias("feature"), F.col("diagnosis_fix").alias("diagnosis"), "line_no")
    return history.patched(found.select("feature", "line_no"), patches)


@query
def unexplored_anti(s: SparkSession, d: str) -> DataFrame:
    """Strong records are explored."""
    specs = D.records(s, d).select(F.concat(F.lit("feat_"), (F.col("line_no") % 300).cast("string")).alias("feature"), "line_no")
    return history.unexplored(specs, D.records(s, d).filter("ic_mean > 0.25").select("feature"))


@query
def queue_order(s: SparkSession, d: str) -> DataFrame:
    """Base features are seeds, repaired ones repairs; the strongest are explored."""
    found = D.records(s, d)
    names = lambda condition: found.filter(condition).select("feature", "line_no")
    return history.queue(names("repair_of is null"), names("repair_of is not null"), names("ic_mean > 0.4")).select("feature", "source", "line_no")


@query
def lineage_compare(s: SparkSession, d: str) -> DataFrame:
    lines = history.lineage(D.records(s, d))
    return history.compared(lines, ["ic_mean", "zero_ratio", "direction_consistency"], ["zero_ratio"]).select("repair_of", "metric", r6("old"), r6("new"), r6("delta"), "better")


@query
def lineage_depth(s: SparkSession, d: str) -> DataFrame:
    """Roots and depths of chains of up to a hundred versions, a few of which run in a circle."""
    return history.lineage_roots(D.versions(s, d)).select("feature", "root", "depth", "cyclic")


@query
def exploration_summary(s: SparkSession, d: str) -> DataFrame:
    return history.exploration_summary(D.records(s, d))


@query
def passed_names(s: SparkSession, d: str) -> DataFrame:
    return history.passed_names(D.records(s, d))


@query
def first_records(s: SparkSession, d: str) -> DataFrame:
    """The first line of each feature and of its repairs."""
    rows = D.records(s, d).select(T.base_name(F.col("feature")).alias("feature"), "line_no", "definition", "repair_of")
    return history.first_by(rows, "feature")


@query
def least_used_cluster(s: SparkSession, d: str) -> DataFrame:
    found = D.records(s, d)
    clusters = found.groupBy("cluster").agg(F.min("line_no").alias("place"))
    return history.least_used(history.cluster_usage(found, clusters))


@query
def feature_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = D.records(s, d).select(T.base_name(F.col("feature")).alias("feature"), "line_no", "definition")
    return history.last_by(rows, "feature")


@query
def metadata_upsert(s: SparkSession, d: str) -> DataFrame:
    """Small parts are there, large ones come; those between do both."""
    rows = D.table(s, d, "part").select(F.col("p_partkey").alias("chunk_id"), "p_name", "p_size")
    old, new = rows.filter("p_size <= 30").drop("p_size"), rows.filter("p_size > 20").drop("p_size")
    return readers.upserted(old, new.withColumn("p_name", F.lit("new")))


@query
def index_resume(s: SparkSession, d: str) -> DataFrame:
    rows = D.table(s, d, "part").select(F.col("p_partkey").alias("chunk_id"), "p_name", "p_size")
    return readers.not_yet(rows.drop("p_size"), rows.filter("p_size <= 30"))


@query
def ranked_candidates(s: SparkSession, d: str) -> DataFrame:
    """The ten first candidates: passed ones, then the strongest."""
    return history.ranked_candidates(D.records(s, d)).limit(10).select("feature", "passed", r6("ic_mean"))


@query
def memory_hint(s: SparkSession, d: str) -> DataFrame:
    named = D.records(s, d).withColumnRenamed("feature", "feature_name").withColumnRenamed("ic_mean", "ic")
    return history.hint(history.recent(named, 4))


@query
def memory_context(s: SparkSession, d: str) -> DataFrame:
    named = history.recent(D.records(s, d).withColumnRenamed("feature", "feature_name"), 5)
    return history.memory_context(named.withColumn("iteration", F.col("line_no").cast("int")).withColumn("key_metrics", F.when(F.col("line_no") % 2 == 0, "t=1.0")), 2)


@query
def common_pattern(s: SparkSession, d: str) -> DataFrame:
    named = D.records(s, d).select("outcome", F.array_join("failures", " ").alias("key_metrics"), F.lit("t_stat low").alias("summary"))
    return history.common_pattern(named)


@query
def history_digest(s: SparkSession, d: str) -> DataFrame:
    return history.digest(D.records(s, d), 12)


@query
def score_assignment(s: SparkSession, d: str) -> DataFrame:
    """Scores parsed from replies for batches of three episodes, back on their episodes; null where a line is missing."""
    batches = retrieval.in_batches(D.table(s, d, "orders").select(F.col("o_orderkey").alias("episode")), ["episode"], 3)
    items = batches.withColumn("index", (F.row_number().over(Window.partitionBy("batch").orderBy("episode"))).cast("int"))
    reply = F.concat_ws("\n", F.concat(F.lit("1: "), F.col("batch") % 3), F.when(F.col("batch") % 2 == 0, F.concat(F.lit("3: -"), F.col("batch") % 4)))
    return items.select("episode", F.try_element_at(T.score_lines(reply, -2, 2), F.col("index")).alias("value"))


@query
def chunk_lookup(s: SparkSession, d: str) -> DataFrame:
    """Texts of the best vectors, by key."""
    best = retrieval.top_k(D.chunks(s, d), D.vector(s, d, 6), 12)
    docs = D.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), T.cut(F.col("text"), 300).alias("text"))
    return docs.join(F.broadcast(best.select("chunk_id", "score")), "chunk_id").select("chunk_id", F.md5("text").alias("digest"), r6("score"))


@query
def run_documents(s: SparkSession, d: str) -> DataFrame:
    """The parts of each run's JSON document of steps, and the run's last lines."""
    small = D.steps(s, d).select("run_id", "step_id", "state", "tool_called", "tool_ok", "tool_latency_ms", "tool_error", "decision")
    lines = history.last_steps_summary(small, 2)
    return history.trace_parts(small.select("run_id", "step_id", "state"), 100).select("run_id", "part", F.md5("steps").alias("digest")).join(lines, "run_id")


@query
def report_documents(s: SparkSession, d: str) -> DataFrame:
    from factorloom.sources.writers import report

    rows = D.results(s, d).select("feature", "k", "coverage_failure")
    return report(rows.withColumn("season_ic", F.lit(1)))


@query
def baseline_model(s: SparkSession, d: str) -> DataFrame:
    """Boosted trees on numeric columns without text features, and their quarterly IC."""
    table = _fused(s, d).withColumn("size", F.col("symbol") % 100).withColumn("day", F.dayofyear("earnings_date"))
    scored = fusion.neutral_prediction(fusion.boosted(table, ["size", "day"], D.TRAIN)).withColumn("feature", F.lit("baseline")).withColumn("value", F.col("prediction_neutral"))
    return evaluation.newey_west(evaluation.ic_series(_test(scored), y="move_neutral"))


@query
def signal_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows with and without signal, and values clipped to a fixed range."""
    rows = D.features(s, d)
    return rows.groupBy("feature").agg(F.count(F.when(no_signal(F.col("value")), 1)).alias("without"), F.count(F.when(~no_signal(F.col("value")), 1)).alias("with_signal"), F.round(F.sum(clip(F.col("value"), -1.0, 1.0)), 4).alias("clipped"))


@query
def recent_window(s: SparkSession, d: str) -> DataFrame:
    """Each run's last three steps."""
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step_id")))
    return D.steps(s, d).select("run_id", "step_id", last.alias("r")).filter("r <= 3")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}

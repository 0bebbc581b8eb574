import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import history as h
from factorloom.operators import retrieval as rt
from factorloom.operators import scoring
from factorloom.plans.loop import Loop, Memory, sections
from factorloom.sources import readers, writers
from factorloom.streaming import traces

STEP = "run_id string, step_id int, state string, iteration int, tool_called string, tool_latency_ms double, tool_ok boolean, tool_error string, context_tokens int, observation string, decision string"


@pytest.fixture(scope="module")
def steps(spark):
    rows = [
        ("r", 1, "PLANNING", 1, "plan", 3200.0, True, None, 2847, "", "CONTINUE"), ("r", 2, "ACTING", 1, "extract", 245000.0, True, None, 5000, "IC=0.1656 t=4.983 zero_ratio=30.6%", ""),
        ("r", 3, "OBSERVING", 1, None, 50.0, True, None, 1000, "IC=0.2", "CONTINUE"), ("r", 4, "EVALUATING", 2, "gate", 1200.0, True, None, 3000, "Gate G2_zero_ratio and G3_t_stat", "FAIL"),
        ("r", 5, "DIAGNOSING", 2, "diagnose", 8500.0, True, None, 3000, "G3_t_stat only", ""), ("bad", 1, "ACTING", 0, "extract", None, False, "it broke", 0, "", "RETRY"), ("bad", 2, "ACTING", 0, "extract", 1.0, False, "again", 0, "", "FAIL"),
    ]
    return spark.createDataFrame(rows, STEP)


def test_run_stats(steps):
    got = {r.run_id: r for r in h.run_stats(steps).collect()}
    r = got["r"]
    assert (r.total_steps, r.total_iterations, r.total_tokens, r.tool_success_rate, r.avg_steps_per_iteration) == (5, 5, 14847, 1.0, 2.5)
    assert (r.G2_zero_ratio, r.G3_t_stat) == (1, 1) and got["bad"].tool_success_rate == 0.0 and got["bad"].avg_steps_per_iteration == 0.0
    assert {x.run_id: x.state for x in h.divergence_point(steps).collect()} == {"r": "EVALUATING", "bad": "ACTING"}
    assert {x.run_id: x.states for x in h.states_visited(steps).collect()}["r"] == ["PLANNING", "ACTING", "OBSERVING", "EVALUATING", "DIAGNOSING"]
    assert h.trace_metrics(steps).collect()[0].key_metrics == "IC=0.1656 t=4.983 zr=30.6%"
    assert {x.decision: x.n for x in h.counts_by(steps.filter("run_id = 'bad'"), "decision").collect()} == {"RETRY": 1, "FAIL": 1}
    document = json.loads(h.trace_document(steps).filter("run_id = 'r'").first().document)
    assert [s["step_id"] for s in document["steps"]] == [1, 2, 3, 4, 5]
    assert h.last_steps_summary(steps, 1).filter("run_id = 'bad'").first().summary == "[Step2|ACTING] extract✗ 1ms →FAIL err=again"
    assert {x.tool_called: x.success_rate for x in h.tool_metrics(steps).collect()}["extract"] == pytest.approx(1 / 3)
    assert [x.step_id for x in h.replay(steps, "r").collect()] == [1, 2, 3, 4, 5]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(k, f"f{k}", f"scoring of evasiveness {k}", "FAIL" if k % 2 else "PASS", ["G2_zero_ratio: 60%", "no colon in this long text"] if k % 2 else [], 0.1, 2.0, 0.5, "why", "fix it") for k in range(10)]
    return spark.createDataFrame(rows, "line_no long, feature_name string, definition string, outcome string, failures array<string>, ic double, t_stat double, zero_ratio double, diagnosis_root_cause string, diagnosis_fix string")


def test_memory(records):
    assert [(r.failure, r.n) for r in h.failure_patterns(records, 4).collect()] == [("G2_zero_ratio", 2), ("no colon in this lon", 2)]
    assert h.pass_rate(records).first().pass_rate == 0.5 and h.pass_rate(records.limit(0)).first().pass_rate == 0.0
    found = rt.keyword_search(records, "QA Evasiveness f3", 3).collect()
    assert found[0].line_no == 3 and found[0].score == 2 and len(found) == 3
    text = h.hint(records.filter("line_no < 4")).first().hint
    assert "WARNING: 2/4" in text and "High zero-ratio" in text and "[FAIL] f1: FAIL (IC=+0.100, zr=50%)" in text
    assert h.hint(records.limit(0)).first().hint == ""
    assert [r.line_no for r in h.with_failure(records, "G2", 2).orderBy("line_no").collect()] == [7, 9]
    assert [r.line_no for r in h.with_outcome(records, "PASS", 2).orderBy("line_no").collect()] == [6, 8]
    entries = records.select("line_no", "feature_name", "outcome", F.col("line_no").cast("int").alias("iteration"), F.lit("zero_ratio=0.9").alias("key_metrics"), F.lit("t_stat low").alias("summary"))
    p = h.common_pattern(entries).first()
    assert (p.pattern, p.n, p.failed) == ("zero_ratio", 5, 5)
    assert h.memory_context(entries.filter("line_no < 2"), 3).first().context.split("\n")[1:] == ["(+ 3 compressed earlier iterations)", "  Iter1: f1 → FAIL [zero_ratio=0.9]", "  Iter0: f0 → PASS [zero_ratio=0.9]"]


def test_history_merges(spark):
    recs = spark.createDataFrame([("a", 1), ("b", 2), ("a", 5)], "feature string, line_no long")
    patches = spark.createDataFrame([("a", "old", 3), ("a", "new", 4), ("z", "none", 6)], "feature string, diagnosis string, line_no long")
    assert {(r.feature, r.line_no): r.diagnosis for r in h.patched(recs, patches).collect()} == {("a", 1): "new", ("a", 5): "new", ("b", 2): None}
    specs = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3)], "feature string, line_no long")
    assert [tuple(r) for r in h.unexplored(specs, recs).collect()] == [("c", 2)]
    order = h.queue(spark.createDataFrame([("s1", 9), ("s2", 1)], "feature string, line_no long"), specs, recs).collect()
    assert [(r.feature, r.source) for r in order] == [("s2", "seed"), ("s1", "seed"), ("c", "repair")]
    clusters = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "cluster string, place int")
    used = h.cluster_usage(spark.createDataFrame([("x",), ("x",), ("z",)], "cluster string"), clusters)
    assert {r.cluster: r.n for r in used.collect()} == {"x": 2, "y": 0, "z": 1} and h.least_used(used).first().cluster == "y"


def test_log_files(spark, tmp_path):
    lines = ['{"feature_spec": {"feature_name": "a"}, "governance_result": {"passed": true}}', "", '{"_patch_feature": "a", "diagnosis": {"fix": "x"}}', '{"_repair_spec": {"feature_name": "a_v2"}}']
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    assert [r.kind for r in readers.history(spark, str(tmp_path / "h.jsonl")).orderBy("line_no").collect()] == ["feature", "patch", "repair"]
    df = spark.createDataFrame([("é", 1.0), ("b", None)], "feature string, value double")
    writers.append_json(df, str(tmp_path / "log"))
    writers.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    writers.csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    writers.checkpoint({"a": 1}, str(tmp_path / "c" / "s.json"))
    assert json.loads((tmp_path / "c" / "s.json").read_text()) == {"a": 1}
    assert "<td>é</td>" in writers.page("t", {"x": df}) and writers.bars(df, "feature", "value").count("<rect") == 2
    writers.write_reports(df.withColumn("season_ic", F.lit(1)), str(tmp_path / "reports"))
    assert "season_ic" not in writers.report(df.withColumn("season_ic", F.lit(1))).first().document


def test_readers(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p/one.parquet"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p/two.parquet"))
    assert readers.folder(spark, str(tmp_path / "p/*"), ["id"], 3).count() == 6 and readers.folder(spark, str(tmp_path / "p/*"), ["id"]).count() == 20
    with pytest.raises(ValueError, match="nope"):
        readers.folder(spark, str(tmp_path / "p/*"), ["id", "nope"])
    assert readers.files_with(spark, [str(tmp_path / "p/one.parquet")], ["id"]).count() == 10
    (tmp_path / "f.csv").write_text("symbol,earnings_date,tone\nA,2020-01-02,1.5\nB,2020-01-03,\n")
    assert [r.value for r in readers.feature_csv(spark, str(tmp_path / "f.csv"), "tone").orderBy("symbol").collect()] == [1.5, None]
    old, new = spark.createDataFrame([(1, "o")], "chunk_id long, t string"), spark.createDataFrame([(1, "n"), (2, "n")], "chunk_id long, t string")
    assert {tuple(r) for r in readers.upserted(old, new).collect()} == {(1, "o"), (2, "n")} and [r.chunk_id for r in readers.not_yet(new, old).collect()] == [2]


def test_retrieval(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8))
    rows = [(k, [float(x) for x in v[k]], ["qa", "prepared"][k % 2], ["mgmt", "analyst"][k % 3 > 0], f"s{k % 4}") for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, section_type string, speaker_role string, sector string")
    q = v[0].tolist()
    order = sorted(range(60), key=lambda k: (-(v.astype(np.float32)[k].astype(float) @ v[0]), k))
    assert [x.chunk_id for x in rt.top_k(chunks, q, 7).collect()] == order[:7]
    scoped = [k for k in order[:30] if k % 2 == 0][:10]
    assert [x.chunk_id for x in rt.scoped_top_k(chunks, q, 10, 60, ["qa"]).collect()] == scoped
    assert len(rt.scoped_top_k(chunks, q, 20, 25, sector="s1").collect()) == len([k for k in order[:25] if k % 4 == 1])
    heads = rt.head_by_episode(rt.scored(chunks, q).withColumn("episode", F.col("chunk_id") % 5), 2).collect()
    assert len(heads) == 10 and {(h_.episode, h_.chunk_id) for h_ in heads} == {(e, k) for e in range(5) for k in [x for x in order if x % 5 == e][:2]}
    batches = rt.in_batches(chunks.select("chunk_id"), ["chunk_id"], 7).collect()
    assert all(b.batch == b.chunk_id // 7 for b in batches)
    norm = chunks.select(rt.inner_product(rt.normalised(F.col("embedding")), rt.normalised(F.col("embedding"))).alias("n")).first().n
    assert norm == pytest.approx(1)


def test_sample_quotas(spark):
    df = spark.range(3000).select(F.col("id").alias("episode"), (2000 + F.col("id") % 3 * F.col("id") % 2).cast("int").alias("year"))
    quotas = {r.year: r.quota for r in rt.year_quotas(df, 300).collect()}
    got = {r.year: r["count"] for r in rt.stratified_sample(df, 300).groupBy("year").count().collect()}
    assert got == quotas and rt.stratified_sample(df, 300).exceptAll(rt.stratified_sample(df, 300)).count() == 0


def test_scorers(spark):
    prompts = spark.createDataFrame([(k, p) for k, p in enumerate(["strong growth", "", "risk", None])], "episode long, prompt string").coalesce(1)
    assert [r.value for r in scoring.lexicon_scored(prompts).orderBy("episode").collect()] == [2.0, None, -1.0, None]

    def scorer():
        tries = []

        def ask(text):
            tries.append(1)
            if len(tries) == 1:
                raise ConnectionError("once")
            return "1: 1.5\n3: -9"

        return ask

    assert [r.value for r in scoring.scored_by(prompts, scorer, "score").orderBy("episode").collect()] == [1.5, None, -2.0, None]
    out = scoring.encoded(spark.createDataFrame([("a b",), (None,)], "text string"), scoring.hashed_encoder(8)).collect()
    assert np.linalg.norm(out[0].embedding) == pytest.approx(1, abs=1e-6) and len(out[1].embedding) == 8


def test_stream_of_traces(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda at, ok: json.dumps({"run_id": "r", "step_id": 1, "tool_called": "t", "tool_ok": ok, "tool_latency_ms": 2.0, "context_tokens": 5, "timestamp": at})
    (src / "1.json").write_text("\n".join([row("2024-01-01T00:00:01", True), row("2024-01-01T00:01:00", False)]))
    stats = traces.windowed_stats(traces.trace_stream(spark, str(src)))
    run = lambda: traces.write_stats(stats, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    (src / "2.json").write_text(row("2024-01-01T02:00:00", True))
    run()
    (src / "3.json").write_text(row("2024-01-01T00:00:02", True))  # too late: its window is closed
    run()
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.calls, r.failed, r.tokens) for r in done] == [(2, 1, 10)]


def test_loop(tmp_path):
    seen = []
    decide = {"EVALUATING": ["FAIL", "CONTINUE"]}
    handlers = {s: (lambda c, s=s: (seen.append(s), (decide.get(s) or ["CONTINUE"]).pop(0) if decide.get(s) else "CONTINUE")[1]) for s in ("PLANNING", "ACTING", "EVALUATING", "DIAGNOSING", "FINALIZING")}
    loop = Loop(handlers, most=2, path=str(tmp_path / "state.json"), budget=100_000)
    assert not loop.spend(80_000) and loop.spend(10_000)
    assert loop.run().state == "DONE" and seen == ["PLANNING", "ACTING", "EVALUATING", "DIAGNOSING", "FINALIZING", "PLANNING", "ACTING", "EVALUATING", "FINALIZING"]
    again = Loop({}, path=str(tmp_path / "state.json"))
    assert again.resume() and again.now.iteration == 2 and again.now.tokens == 90_000
    with pytest.raises(ValueError):
        Loop({}).move("DONE")


def test_working_memory():
    m = Memory()
    for k in range(12):
        m.add(k, f"f{k}", "PASS" if k % 2 else "FAIL")
    assert len(m.entries) <= 10 and "COMPRESSED" in m.entries[0]["outcome"] and 0 < m.pass_rate < 1
    assert "[...truncated...]" in sections({"system": "s" * 4000, "memory": "m", "task": "t"}, 100)

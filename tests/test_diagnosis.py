import pytest
from pyspark.sql import functions as F

from factorloom.operators import diagnosis as d
from factorloom.operators import gates

SCHEMA = "feature string, zero_ratio double, t_stat double, ic_mean double, direction_consistency double, zero_by_sector map<string,double>, zero_by_year map<string,double>, score_dist map<string,double>, coverage_failure boolean, failures array<string>"
MODE = lambda: gates.failure_mode(F.array(F.lit("qa")), F.lit("tone"))


@pytest.fixture(scope="module")
def results(spark):
    sectors = {"a": 0.9, "b": 0.2, "c": 0.95}
    rows = [(n, 0.65, 1.0, 0.05, 0.7, sectors, {"2015": 0.5}, {"0.0": 0.6}, False, ["G2_zero_ratio: 65%"]) for n in ("told", "told", "bare", "blank", "broken", "flaky")]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture
def model():
    def load():
        calls = {}

        def ask(prompt):
            if "Name: broken" in prompt:
                raise ValueError("no connection")
            if "Name: flaky" in prompt and calls.setdefault(prompt, 0) == 0:
                calls[prompt] = 1
                raise TimeoutError("once")
            if "Name: bare" in prompt:
                return "x" * 150
            return "  " if "Name: blank" in prompt else "根因: zeros in c\n修复: add examples\n避免: a wider scale"

        return ask

    return load


def test_model_with_rules_where_it_fails(results, model):
    rows = d.diagnosed(results, MODE(), model, wait=0.0).collect()
    got = {r.feature: r for r in rows}
    assert len(rows) == 7 and sum(r.feature == "told" for r in rows) == 2
    for name in ("told", "flaky"):
        assert (got[name].root_cause, got[name].fix, got[name].avoid, got[name].source, got[name].error) == ("zeros in c", "add examples", "a wider scale", "model", None)
    assert (got["bare"].root_cause, got["bare"].fix, got["bare"].source) == ("x" * 100, "", "model")
    for name in ("blank", "broken"):
        assert (got[name].mode, got[name].root_cause, got[name].fix, got[name].source) == ("A", "failure mode A; failed checks: G2_zero_ratio: 65%", gates.FALLBACK_FIX["A"], "rule")
    assert got["broken"].error == "ValueError: no connection" and got[None].source == "model"


def test_without_model_all_is_native(results, model):
    found = d.diagnosed(results, MODE())
    assert {r.source for r in found.collect()} == {"rule"} and "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert d.diagnosed(results.limit(0), MODE(), model).collect() == []


def test_prompt_states_the_result(results):
    p = results.filter("feature = 'told'").select(d.prompt(F.repeat(F.lit("i"), 400), F.lit("a paper")).alias("p")).first().p
    for part in ("Name: told", "IC +0.0500, t +1.000, zeros 65.0%, direction 70%", "Most zeros by sector: c, a, b; fewest: b, a, c; by year: 2015", "concentrated", "- G2_zero_ratio: 65%", "Literature:\na paper", "根因"):
        assert part in p
    assert "i" * 300 in p and "i" * 301 not in p
    none = results.filter("feature is null").select(d.prompt(F.lit(None).cast("string")).alias("p")).first().p
    assert none is not None and "IC n/a, t n/a" in none and "Failed checks:\nnone" in none

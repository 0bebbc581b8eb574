import datetime as dt
import math
import random

import numpy as np
import pytest

from factorloom.functions.columns import clip, mean_of, weighted
from factorloom.operators import evaluation as ev
from factorloom.operators import fusion, panel
from pyspark.sql import functions as F

SCHEMA = "episode long, symbol string, sector string, earnings_date timestamp, year int, quarter int, move double"


def made(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        d = dt.datetime(2018 + k % 5, 1 + (k * 7) % 12, 1 + k % 28)
        rows.append((k, f"s{k % 50}", [None, "A", "B", "C"][k % 4], d, d.year, (d.month - 1) // 3 + 1, r.gauss(0, 1)))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(made(), SCHEMA)


@pytest.fixture(scope="module")
def features(spark):
    r = random.Random(2)
    rows = [("a", k, r.choice([-1.0, 0.0, 1.0, None])) for k in range(0, 400, 2)] + [("b", k, r.gauss(0, 2)) for k in range(400)] + [("flat", k, 1.0) for k in range(400)] + [("late", 1, 0.5)]
    return spark.createDataFrame(rows, "feature string, episode long, value double")


def newey_west(x, lags=4):
    x = np.asarray(x)
    if len(x) < 2:
        return 0.0
    e = x - x.mean()
    v = (e @ e) / len(x) + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / len(x) for k in range(1, min(lags, len(x) - 1) + 1))
    return x.mean() / math.sqrt(max(v, 1e-12) / len(x))


def test_ic_and_newey_west(events, features):
    rows = panel.joined(events, features)
    series = ev.ic_series(rows)
    local = {}
    for r in rows.collect():
        if r.value is not None:
            local.setdefault((r.feature, r.year, r.quarter), []).append((r.value, r.move))
    want = {k: np.corrcoef(np.array(v).T)[0, 1] for k, v in local.items() if len(v) >= 5 and len({a for a, _ in v}) > 1}
    got = {(r.feature, r.year, r.quarter): r.ic for r in series.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert not any(k[0] == "flat" for k in got)
    for r in ev.newey_west(series).collect():
        x = [want[k] for k in sorted(want) if k[0] == r.feature]
        assert r.n_quarters == len(x) and r.t_stat == pytest.approx(newey_west(x))


def test_single_quarter_has_no_t(spark):
    one = spark.createDataFrame([("f", 2020, 1, 0.3)], "feature string, year int, quarter int, ic double")
    assert ev.newey_west(one).first().t_stat == 0.0


def test_neutral_and_target(events):
    rows = panel.with_neutral(panel.with_target(events)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.year, r.quarter), []).append(r.move)
    for r in rows:
        x = groups[r.year, r.quarter]
        assert r.target == pytest.approx((r.move - np.mean(x)) / (np.std(x, ddof=1) + 1e-8))
        assert (r.move_neutral is None) == (r.sector is None)


def test_clip_keeps_null_and_bounds(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,), (0.5,)], "x double").select(clip(F.col("x"), -1.0, 1.0).alias("y"))
    assert [r.y for r in df.collect()] == [None, 1.0, -1.0, 0.5]


def test_winsor_bounds_are_numpy_quantiles(events, features):
    rows = panel.joined(events, features)
    x = [r.value for r in rows.filter("feature = 'b' and year in (2018, 2019)").collect()]
    b = panel.winsor_bounds(rows, [2018, 2019]).filter("feature = 'b'").first()
    assert (b.low, b.high) == (pytest.approx(np.percentile(x, 1)), pytest.approx(np.percentile(x, 99)))
    assert panel.winsorized(rows, panel.winsor_bounds(rows, [2018])).count() == rows.count()


def test_coverage_and_zero_ratio(events, features):
    cover = {r.feature: r for r in ev.coverage_failure(ev.test_coverage(events, features, [2020, 2021])).collect()}
    assert cover["late"].coverage_failure and cover["late"].n_test == 0 and not cover["b"].coverage_failure
    zero = {r.feature: r.zero_ratio for r in ev.zero_ratio(panel.joined(events, features)).collect()}
    assert zero["flat"] == 0 and 0.2 < zero["a"] < 0.8


def test_direction_consistency_signs(spark):
    sectors = spark.createDataFrame([("f", "A", 0.1), ("f", "B", 0.0), ("f", "C", -0.2), ("g", "A", 0.1)], "feature string, sector string, ic double")
    means = spark.createDataFrame([("f", 0.0), ("g", -0.1), ("h", 0.2)], "feature string, ic_mean double")
    got = {r.feature: r.direction_consistency for r in ev.direction_consistency(sectors, means).collect()}
    assert got == {"f": pytest.approx(1 / 3), "g": 0.0, "h": 0.0}


def test_validation_row(events, features):
    rows = {r.feature: r for r in ev.rounded(ev.validation(events, features, [2018, 2019], [2020, 2021, 2022])).collect()}
    assert set(rows) == {"a", "b", "flat", "late"}
    assert rows["late"].coverage_failure and rows["late"].ic_mean == 0
    assert set(rows["b"].zero_by_sector) == {"A", "B", "C"} and sum(rows["a"].score_dist.values()) == pytest.approx(1, abs=0.01)


def test_spearman(events, features):
    wide = panel.wide(events, features, ["a", "b"])
    got = {(r.left, r.right): r.rho for r in ev.spearman(wide, ["a", "b"]).collect()}
    pairs = np.array([(r.a, r.b) for r in wide.collect() if r.a is not None and r.b is not None])

    def rank(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    assert got["a", "b"] == pytest.approx(np.corrcoef(rank(pairs[:, 0]), rank(pairs[:, 1]))[0, 1]) and got["a", "a"] == pytest.approx(1)


def test_fusion(events, features):
    table = fusion.fusion_table(events, features, {"a": 0.2, "b": 0.1}, 2019)
    for r in table.limit(50).collect():
        z = [x for x in (r.a_z, r.b_z) if x is not None]
        assert r.fusion_equal == (pytest.approx(np.mean(z)) if z else None)
        assert r.fusion_icw == pytest.approx((r.a_z or 0) * 2 / 3 + (r.b_z or 0) / 3)
    scores = fusion.long_scores(table, ["a", "fusion_icw"])
    assert {r.feature for r in fusion.ic_table(scores).collect()} == {"a", "fusion_icw"}
    assert fusion.covered_ic(scores).count() == 2 and fusion.single_prediction(panel.joined(events, features)).filter("prediction is null").count() == 0


def test_means_and_weights(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double").select(mean_of([F.col("a"), F.col("b")]).alias("m"), weighted([F.col("a"), F.col("b")], [1, 3]).alias("w"))
    assert [tuple(r) for r in df.collect()] == [(1.0, 0.25), (None, 0.0), (2.0, 2.5)]


def test_boosting_learns(events, features):
    table = fusion.fusion_table(events.withColumn("move", F.rand(3)), features, {"b": 1.0}, 2018).withColumn("target", F.col("b"))
    out = fusion.boosted(table, ["b"], [2018, 2019, 2020], rounds=15)
    assert out.stat.corr("prediction", "target") > 0.8


def test_sector_codes(events):
    coded = panel.with_sector_code(events)
    assert {(r.sector, r.sector_code) for r in coded.select("sector", "sector_code").distinct().collect()} == {(None, -1), ("A", 0), ("B", 1), ("C", 2)}
    back = panel.sector_of_code(coded.select("episode", "sector_code"), panel.sector_codes(events))
    assert back.filter("sector is null").count() == coded.filter("sector_code = -1").count()

"""Boosted trees against a plain reading of their rules, without histograms."""

import numpy as np
import pytest

from factorloom.operators import boosting as B
from factorloom.plans import catalogue

TABLES = "/root/testdata/sf0.001"


def data(n=900, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(np.stack([r.normal(size=n), r.integers(0, 6, n), r.random(n), np.full(n, 3.0)]), 3)
    return x, 2 * (x[0] > 0.3) - 0.5 * x[1] + (x[2] > 0.5) * (x[0] > 0) + 0.1 * r.normal(size=n)


def table(spark, x, y):
    return spark.createDataFrame([(*map(float, row), None if np.isnan(t) else float(t)) for *row, t in zip(*x, y)], "a double, b double, c double, d double, y double").repartition(3)


def plain_tree(x, g, edges, columns, s):
    """(values of rows, [(column, gain)]): the leaf of most gain is split first; every cut is tried on the rows themselves."""
    T = lambda v: np.sign(v) * max(abs(v) - s.l1, 0.0)
    score = lambda rows: T(g[rows].sum()) ** 2 / (len(rows) + s.l2)

    def best(rows, depth):
        found = None
        for c in columns if depth < s.depth else []:
            for cut in edges[c]:
                left, right = rows[x[c][rows] <= cut], rows[x[c][rows] > cut]
                if min(len(left), len(right)) >= s.least:
                    gain = score(left) + score(right) - score(rows)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, c, left, right)
        return found

    leaves, splits = [(np.arange(len(g)), 0)], []
    while len(leaves) < s.leaves:
        options = [(k, best(*leaf)) for k, leaf in enumerate(leaves)]
        options = [(k, b) for k, b in options if b]
        if not options:
            break
        k, (gain, c, left, right) = max(options, key=lambda o: o[1][0])
        depth = leaves.pop(k)[1] + 1
        leaves += [(left, depth), (right, depth)]
        splits.append((c, gain))
    out = np.zeros(len(g))
    for rows, _ in leaves:
        out[rows] = -s.rate * T(g[rows].sum()) / (len(rows) + s.l2)
    return out, splits


@pytest.mark.parametrize("part", [B.PART, 0])
@pytest.mark.parametrize("leaves,depth,columns", [(16, 3, 0.7), (5, 6, 1.0), (3, 2, 0.5)])
def test_five_rounds_by_brute_force(spark, monkeypatch, leaves, depth, columns, part):
    """In one task, and by jobs."""
    monkeypatch.setattr(B, "PART", part)
    x, y = data()
    s = B.Settings(rounds=5, rate=0.3, leaves=leaves, depth=depth, least=25, columns=columns)
    df = table(spark, x, y)
    model = B.fit(df, list("abcd"), "y", s)
    pick, want, gains = np.random.default_rng(s.seed), np.full(len(y), y.mean()), np.zeros(4)
    for _ in range(s.rounds):
        some = sorted(pick.choice(4, max(1, round(columns * 4)), replace=False).tolist())
        more, splits = plain_tree(x, want - y, model.edges, some, s)
        want = want + more
        for c, gain in splits:
            gains[c] += gain
    assert np.abs(model.predict(list(x)) - want).max() < 1e-9
    assert dict(model.importance()) == pytest.approx(dict(zip("abcd", gains)), abs=1e-6) and gains[3] == 0
    got = {(r.a, r.b, r.c): r.prediction for r in B.predicted(df, model).collect()}
    assert max(abs(got[tuple(x[:3, k])] - want[k]) for k in range(len(y))) < 1e-9


def test_folds_change_nothing(spark, monkeypatch):
    x, y = data(300)
    s = B.Settings(rounds=7, rate=0.2, least=10)
    whole = B.fit(table(spark, x, y), list("abcd"), "y", s).predict(list(x))
    monkeypatch.setattr(B, "PART", 0)
    monkeypatch.setattr(B, "FOLD", 2)
    monkeypatch.setattr(B, "PARTIAL", 0)
    assert np.abs(B.fit(table(spark, x, y), list("abcd"), "y", s).predict(list(x)) - whole).max() < 1e-9


def test_edges_are_quantiles(spark):
    x, y = data(3000)
    edges = B.quantile_edges(table(spark, x, y), list("abcd"), 20)
    assert edges[1].tolist() == [0, 1, 2, 3, 4] and len(edges[3]) == 0
    shares = np.array([(x[0] <= e).mean() for e in edges[0]])
    assert len(edges[0]) == 19 and np.abs(shares - np.arange(1, 20) / 20).max() < 0.01


def test_missing_values_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (5.0, None)], "a double, y double")
    model = B.fit(rows, ["a"], "y")
    assert {r.prediction for r in B.predicted(rows, model).collect()} == {1.5}
    none = B.fit(rows.filter("y > 9"), ["a"], "y")
    assert none.trees == [] and {r.prediction for r in B.predicted(rows, none).collect()} == {0.0}


@pytest.mark.parametrize("name", ["gbt_fusion", "baseline_model", "feature_importance"])
def test_registered_models_use_the_settings(spark, monkeypatch, name):
    """200 rounds, 16 leaves, depth 3, 40 rows a leaf, L1 0.5, L2 2.0, 0.7 of the columns."""
    seen = []
    whole = B.fit
    monkeypatch.setattr(B, "fit", lambda rows, names, label, settings: seen.append(settings) or whole(rows, names, label, B.Settings(rounds=2)))
    catalogue.queries()[name](spark, TABLES).collect()
    s = seen[0]
    assert (s.rounds, s.rate, s.leaves, s.depth, s.least, s.l1, s.l2, s.columns) == (200, 0.02, 16, 3, 40, 0.5, 2.0, 0.7)


def test_importance_follows_from_the_model(spark):
    x, y = data(600)
    model = B.fit(table(spark, x, y), list("abcd"), "y", B.Settings(rounds=3, rate=0.3, columns=1.0))
    want = {n: sum(g for t in model.trees for c, g in zip(t.column, t.gain) if c == k) for k, n in enumerate("abcd")}
    assert dict(model.importance()) == pytest.approx(want) and model.importance()[0][0] in ("a", "b") and model.importance()[-1] == ("d", 0.0)


def test_rows_of_equal_bins_are_one_cell(spark):
    """What boosting passes over grows with the combinations of bins, not with the rows."""
    from pyspark.sql import functions as F

    x, y = data(300)
    once = table(spark, x, y)
    often = once.crossJoin(spark.range(7).select(F.col("id").alias("copy"))).withColumn("y", F.col("y") + F.col("copy") - 3)
    edges = B.quantile_edges(once, list("abcd"), 8)
    cells = B.cells_of(once, list("abcd"), "y", edges)
    more = {r.cell: (r.n, r.labels) for r in B.cells_of(often, list("abcd"), "y", edges).collect()}
    assert cells.count() == len(more) == len({tuple(v) for v in B.binned(list(x), edges).T}) < 300
    for r in cells.collect():
        assert more[r.cell][0] == 7 * r.n and abs(more[r.cell][1] - 7 * r.labels) < 1e-9

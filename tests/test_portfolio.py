"""Portfolios against a plain reading: sorted cross-sections, a path walked quarter by quarter."""

import math
import random
from collections import defaultdict

import pytest

from factorloom.operators import portfolio as P

SCHEMA = "feature string, year int, quarter int, value double, ret double"


def rows(seed=2, big=0):
    r = random.Random(seed)
    out = [("a", 2000 + k // 4, k % 4 + 1, float(r.randint(0, 9)) if k % 2 else r.random(), r.gauss(0, 0.05)) for k in range(12) for _ in range(r.randint(3, 40))]
    out += [("b", 2000, 1, None, 0.1), ("b", 2000, 1, 1.0, None), ("b", None, 1, 1.0, 0.2)]
    out += [("c", 2000, q, float(k), -3.0 if k == 9 and q == 2 else 0.01 * k) for q in (1, 2, 3) for k in range(10)]
    return out + [("d", 2001, 1, math.floor(r.random() * 900) / 7, r.gauss(0, 0.1)) for _ in range(big)]


def brute_cuts(values, buckets):
    values = sorted(values)
    return [values[max(-(-len(values) * j // buckets), 1) - 1] for j in range(1, buckets)]


def sections(some):
    out = defaultdict(list)
    for f, y, q, v, ret in some:
        if None not in (f, y, q, v):
            out[f, y, q].append((v, ret))
    return out


@pytest.mark.parametrize("buckets", [2, 5, 10])
def test_cuts_are_exact(spark, buckets):
    """Also of a cross-section too large to be ordered whole."""
    some = rows(big=6000)
    got = {(r.feature, r.year, r.quarter): r.cuts for r in P.quantile_cuts(spark.createDataFrame(some, SCHEMA).repartition(3), P.SECTIONS, buckets).collect()}
    assert got == {k: brute_cuts([v for v, _ in x], buckets) for k, x in sections(some).items()}


def brute_risk(some, buckets=5):
    spreads = defaultdict(list)
    for (f, y, q), pairs in sorted(sections([r for r in some if r[4] is not None]).items()):
        cuts = brute_cuts([v for v, _ in pairs], buckets)
        side = lambda k: [ret for v, ret in pairs if 1 + sum(c < v for c in cuts) == k]
        high, low = side(buckets), side(1)
        if len(pairs) >= 5 and high and low:
            spreads[f].append(sum(high) / len(high) - sum(low) / len(low))
    out = {}
    for f, x in spreads.items():
        wealth, peak, worst = 1.0, 1.0, 0.0
        for s in x:
            wealth = wealth * (1 + s) if s > -1 else 0.0
            peak = max(peak, wealth)
            worst = min(worst, wealth / peak - 1)
        mean = sum(x) / len(x)
        sd = math.sqrt(sum((s - mean) ** 2 for s in x) / (len(x) - 1))
        out[f] = (len(x), mean, 2 * mean / sd, wealth, worst)
    return out


def test_risk(spark):
    some = rows()
    got = {r.feature: (r.n_quarters, r.spread_mean, r.information_ratio, r.wealth, r.max_drawdown) for r in P.risk(spark.createDataFrame(some, SCHEMA).repartition(3)).collect()}
    want = brute_risk(some)
    assert set(got) == set(want) == {"a", "c"}
    for f in want:
        assert got[f] == pytest.approx(want[f], abs=1e-12)
    assert got["c"][3:] == (0.0, -1.0)  # all is lost in the second quarter


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.risk(none).collect() == [] and P.quantile_cuts(none, P.SECTIONS, 5).collect() == []

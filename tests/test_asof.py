"""The as-of join against a search for every row."""

import random

import pytest

from factorloom.operators.asof import asof_join


def brute(left, right):
    out = []
    for s, t, n in left:
        fits = sorted(((rt, x) for rs, rt, x in right if None not in (s, t, rs, rt) and rs == s and rt <= t), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        out.append((s, t, n, *(fits[-1] if fits else (None, None))))
    return sorted(out, key=str)


def joined(spark, left, right):
    df = asof_join(spark.createDataFrame(left, "s string, t int, n int").repartition(3), spark.createDataFrame(right, "s string, u int, x int").repartition(4), "s", "t", "u")
    assert df.columns == ["s", "t", "n", "u", "x"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts,batch", [("1", "10000"), ("7", "3"), ("40", "2")])
def test_matches(spark, parts, batch):
    """One range or many, batches of any size; ties, repeats, nulls, keys of one side."""
    r = random.Random(4)
    left = [(r.choice(["a", "b", "c", "only left", None]), r.choice([None, *range(30)]), k) for k in range(150)] + [("a", 5, 999)] * 3
    right = [(r.choice(["a", "b", "hot", "only right", None]), r.choice([None, *range(30)]), r.choice([None, 1, 2, 3])) for k in range(80)] + [("c", 0, 7)]
    left += [("hot", t, 0) for t in range(0, 60, 3)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, (parts, batch, "false")):
        spark.conf.set(k, v)
    try:
        assert joined(spark, left, right) == brute(left, right)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_sides(spark):
    assert joined(spark, [], [("a", 1, 1)]) == []
    assert joined(spark, [("a", 1, 1)], []) == [("a", 1, 1, None, None)]


def test_a_symbol_of_a_million_rows(spark):
    """One key holds nearly all rows of both sides and spans all ranges."""
    left = spark.range(1_000_000).selectExpr("if(id % 50000 = 3, id, 0) AS s", "id AS t")
    right = spark.range(0, 1_000_000, 1000).selectExpr("0L AS s", "id AS u", "id * 2 AS x")
    got = asof_join(left, right, "s", "t", "u").selectExpr("count(*) n", "count(x) m", "sum(if(s = 0, x - 2 * (t - t % 1000), 0)) off", "count(distinct x) d").first()
    assert (got.n, got.m, got.off, got.d) == (1_000_000, 999_980, 0, 1000)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2)], "s int, t int")
    with pytest.raises(ValueError):
        asof_join(df, df, "s", "t", "t")

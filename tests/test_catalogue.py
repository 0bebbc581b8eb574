import duckdb
import pytest

import __spark_entry__ as entry
from factorloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert {r.feature for r in entry.entry(spark).collect()} == {"discount", "quantity", "score"}


def test_registered():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"transcript_chunks", "press_chunks", "paper_chunks", "gbt_fusion"} <= set(names)


def test_plans_push_down_and_stay_native(spark):
    plan = catalogue.symbol_year_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "o_comment" not in plan
    topk = catalogue.vector_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in topk and "Exchange" not in topk

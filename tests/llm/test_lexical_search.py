import math
import re

import pytest

from factorloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, most=20):
    """(item_id, rank, doc_id, score) by the formula, document by document."""
    said = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in said), sum(len(t) for _, t in said)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, words in said:
            score = 0
            for t in terms(text):
                df, tf = sum(t in w for _, w in said), words.count(t)
                if tf:
                    m = 100 - 25 + 25 * len(words) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item_id, k, doc_id, score) for k, (score, doc_id) in enumerate(found[:most], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the River of stone"), (2, "Élan élan ÉLAN straße x1 w7 w9"), (3, None), (4, "..."), (5, "nowhere-seen"), (6, "To to to To"), (1, "theta, kappa"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (8, "w1 w2 w3 w4 w5 w6 and the of")]
ITEM = "item_id long, text string"


def got(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.mark.parametrize("window,items", [(4096, 10_000), (16, 10_000), (8, 3)])
def test_scores(spark, docs, window, items):
    """Also of many windows, and of several blocks of items."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(ls.search(docs, spark.createDataFrame(ITEMS, ITEM), window=window, per_block=items)) == brute(rows, ITEMS)


def test_few_best_and_clashing_columns(spark, clashing):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    items = spark.createDataFrame([(a, b, 7, "x") for a, b in ITEMS], "item_id long, text string, item int, doc_id string")
    assert got(ls.search(clashing, items, 3)) == brute(rows, ITEMS, 3)


def test_ties_repeats_and_nulls(spark):
    rows = [(k, "same words here", None) for k in range(30, 0, -1)] + [(None, "same words here", None), (5, "same words here", None), (6, None, None), (None, "", None)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([("a", "words"), ("a", "words")], "item_id string, text string")
    found = got(ls.search(docs, items))
    # a word of every document but two weighs more than nothing, and equal scores go by doc_id
    assert found == brute([(a, b) for a, b, _ in rows], [("a", "words"), ("a", "words")])
    few = [(None, "only"), (1, "other")]
    assert got(ls.search(spark.createDataFrame(few, "doc_id long, text string"), spark.createDataFrame([(1, "only")], ITEM))) == brute(few, [(1, "only")])


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], ITEM)
    assert ls.search(docs, none).collect() == [] and ls.search(empty, spark.createDataFrame(ITEMS, ITEM)).collect() == [] and ls.search(empty, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text(spark):
    rows = [(1, "word Other " * 300_000), (2, "word"), (3, "other")]
    assert got(ls.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "word other")], ITEM))) == brute(rows, [(1, "word other")])


def test_large_lengths_stay_exact():
    import numpy as np

    n = np.array([0, 10**8], np.int64)
    assert ls.rounded_length(n, 10**11, 10**14).tolist() == [75, 75 + 25 * 10**8 * 10**11 // 10**14]


def test_sql(spark):
    import duckdb

    from factorloom.llm import oracle, registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracle.SQL["op12_lexical_search"])
    at = [want.columns.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert got(registry.op12_lexical_search(spark, sf)) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)

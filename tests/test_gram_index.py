import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import gram_index as g
from factorloom.operators import retrieval as rt

RECORD = "line_no long, definition string, feature_name string, failures array<string>"


def memory(seed, n, start=0):
    rng = random.Random(seed)
    words = ["evasive", "guidance", "tone", "Δelta", "risk😀y", "a", "of", "margin", "IC", "g2_zero"]
    pick = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    return [(k, rng.choice([None, pick(6)]), f"f{k % 13}", rng.choice([None, [], ["G2_zero_ratio: " + pick(1), "x"]])) for k in range(start, start + n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Two parts, appended one after the other."""
    found = g.GramIndex(spark, f"file://{tmp_path_factory.mktemp('grams')}/index")
    for part in (memory(1, 150), memory(2, 50, 150)):
        found.add(spark.createDataFrame(part, RECORD))
    return found


QUERIES = ["QA Evasive f3", "a", "of g2", "😀", "isk😀y Δ", "zzz evasive", "zzz", "  ", None, "TONE tone Tone", "f1 f12 margin ic", "zero_ratio: x", "vas", "\0"]


def test_every_query_equals_the_scan(spark, index):
    records = spark.createDataFrame(memory(1, 150) + memory(2, 50, 150), RECORD)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = {}
    for r in g.search(index, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.line_no, r.score))
    for k, text in enumerate(QUERIES):
        wanted = [(r.line_no, r.score) for r in rt.keyword_search(records, text, 4).collect()] if text and text.strip() else []
        assert got.get(k, []) == wanted, text


def test_reads_the_rarest_gram_only(spark, index):
    asked = spark.createDataFrame([("q", "guidance zzz a")], "query_id string, query string")
    read = {r.word: (r.lists, r.postings) for r in g.postings_read(index, asked).collect()}
    texts = [r.text for r in index.texts().collect()]
    grams = ["guidance"[k : k + 3] for k in range(6)]
    assert read["guidance"] == (1, min(sum(x in t for t in texts) for x in grams)) and "zzz" not in read and read["a"][0] > 1
    plan = g.hits(index, g.query_words(asked))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan or "PartitionFilters: [isnotnull(slot" in plan


def test_more_grams_than_literals(spark, index, monkeypatch):
    asked = spark.createDataFrame([("q", "guidance tone"), ("r", "margin a")], "query_id string, query string")
    before = g.search(index, asked).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(g, "LITERALS", 1)
    assert before and g.search(index, asked).orderBy("query_id", "rank").collect() == before


def test_empty_memory_and_a_long_text(spark, tmp_path):
    found = g.GramIndex(spark, f"file://{tmp_path}/index").add(spark.createDataFrame([], RECORD))
    asked = spark.createDataFrame([("q", "needle")], "query_id string, query string")
    assert g.search(found, asked).collect() == []
    long = spark.range(1).select(F.lit(7).cast("long").alias("line_no"), F.concat(F.repeat(F.lit("hay "), 1_000_000), F.lit("needle")).alias("definition"), F.lit(None).cast("string").alias("feature_name"), F.lit(None).cast("array<string>").alias("failures"))
    assert [(r.line_no, r.score) for r in g.search(found.add(long), asked).collect()] == [(7, 1)]


def test_like_records_are_scored_once(spark, tmp_path):
    """A memory that grows by like records has no more signatures to score; the k first of each are kept."""
    said = [(k, ["tone of margin", "guidance", "evasive tone"][k % 3], "x", None) for k in range(300)]
    found = g.GramIndex(spark, f"file://{tmp_path}/index").add(spark.createDataFrame(said, RECORD))
    asked = spark.createDataFrame([("q", "tone evasive"), ("r", "guidance margin zzz")], "query_id string, query string")
    sets = {tuple(r.words): (r.signature, r.members) for r in g.signatures(g.hits(found, g.query_words(asked)), 4).collect()}
    assert sets == {("margin", "tone"): (0, [0, 3, 6, 9]), ("guidance",): (1, [1, 4, 7, 10]), ("evasive", "tone"): (2, [2, 5, 8, 11])}
    got = [(r.query_id, r.line_no, r.score) for r in g.search(found, asked, 4).orderBy("query_id", "rank").collect()]
    assert got == [("q", 2, 2), ("q", 5, 2), ("q", 8, 2), ("q", 11, 2), ("r", 0, 1), ("r", 1, 1), ("r", 3, 1), ("r", 4, 1)]

"""The block index against all products, one after the other."""

import numpy as np
import pytest

from factorloom.operators import vector_index as V

SCHEMA = "chunk_id long, embedding array<float>"


def rows(seed=1, n=900, size=12):
    r = np.random.default_rng(seed)
    centres = 4 * r.normal(size=(9, size))
    m = (centres[r.integers(0, 9, n)] + 0.3 * r.normal(size=(n, size))).astype(np.float32)
    m[100:400] = m[99]  # a third of all are copies
    out = [(int(k), [float(x) for x in v]) for k, v in zip(r.permutation(10 * n)[:n], m)]
    return out + [(-1, None), (-2, [1.0]), (-3, [float("nan")] * size), (-4, [None] * size)]


def plain(vectors, query, k):
    def score(v):
        total = 0.0
        for x, y in zip(v, query):
            total += x * y
        return total

    good = [(key, v) for key, v in vectors if v is not None and len(v) == len(query) and all(x is not None and x == x for x in v)]
    return sorted(((key, score(v)) for key, v in good), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("block,k", [(32, 5), (1024, 40), (1, 3)])
def test_exact(spark, block, k):
    """Scores to the last bit and ties by key, with copies over many blocks; blocks are skipped."""
    vectors = rows()
    index = V.build(spark.createDataFrame(vectors, SCHEMA).repartition(3), block=block)
    queries = [(f"q{key}", v) for key, v in vectors[:60:7] + vectors[99:100]] + [("zero", [0.0] * 12), ("short", [1.0]), ("none", None)]
    counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    got = {}
    for r in V.search(index, spark.createDataFrame(queries, "query_id string, vector array<float>"), k, counts=counts).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.key, r.score)
    assert set(got) == {q for q, _ in queries} - {"short", "none"}
    for name, v in queries[:-2]:
        assert [got[name][j + 1] for j in range(k)] == plain(vectors, v, k)
    assert index.blocks.count() >= 900 // block and counts[0].value + counts[1].value >= index.blocks.count()


def test_blocks_are_skipped(spark):
    vectors = rows()
    index = V.build(spark.createDataFrame(vectors, SCHEMA), block=32)
    counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    V.search(index, spark.createDataFrame([(1, vectors[99][1])], "query_id long, vector array<float>"), 5, counts=counts).collect()
    assert counts[1].value > counts[0].value > 0


def test_few_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    query = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert V.search(V.build(none), query, 3).collect() == []
    few = V.build(spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.0])], SCHEMA))
    assert [(r.key, r.score, r["rank"]) for r in V.search(few, query, 3).orderBy("rank").collect()] == [(4, 1.0, 1), (5, 1.0, 2)]
    assert V.search(few, query.limit(0), 3).collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    vectors = rows(3, 200)
    index = V.build(spark.createDataFrame(vectors, SCHEMA), block=16)
    monkeypatch.setattr(V, "QUERIES", 4)
    queries = [(key, v) for key, v in vectors[:20]]
    got = {(r.query_id, r["rank"]): r.key for r in V.search(index, spark.createDataFrame(queries, "query_id long, vector array<float>"), 2).collect()}
    assert got == {(q, j + 1): key for q, v in queries for j, (key, _) in enumerate(plain(vectors, v, 2))}


def test_several_queries_with_and_without_an_index(spark):
    """The best rows over several queries are the same by a scan and by the index."""
    from factorloom.operators import retrieval

    vectors = [(k, v, k // 3) for k, v in rows(5, 300)[:-4]]
    chunks = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>, page long")
    queries = spark.createDataFrame([(k, v) for k, v, _ in vectors[:6]], "query_id long, vector array<float>")
    read = lambda index: [(r.query_id, r.chunk_id, r.score) for r in retrieval.multi_query_top_k(chunks, queries, 4, 9, ["page"], index=index).collect()]
    assert read(None) == read(V.build(chunks, block=16)) and len(read(None)) == 9
    none = retrieval.multi_query_top_k(chunks, queries.limit(0), 4, 9, ["page"])
    assert none.collect() == []


def test_best_of_many_queries_at_once(spark):
    """A block is offered to all queries that need it in one call, ties and copies included."""
    r = np.random.default_rng(8)
    q, m = r.integers(-2, 3, (50, 3)).astype(float), r.integers(-2, 3, (400, 3)).astype(float)
    keys = r.permutation(400)
    best = V.Best(q, np.full(50, -np.inf), 6)
    for at in range(0, 400, 37):
        best.offer(np.arange(50), m[at : at + 37], keys[at : at + 37])
    for j in range(50):
        want = plain([(int(k), v) for k, v in zip(keys, m)], q[j], 6)
        assert list(zip(best.keys[j].tolist(), best.scores[j].tolist())) == want

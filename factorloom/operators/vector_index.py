"""Exact vector search over blocks: blocks that can't hold a best vector are skipped by a bound.

Vectors go to the nearest of some centres and lie in blocks of BLOCK rows, each with its mean and radius as columns of
their own. For a query q, no vector of a block scores more than q.mean + |q| radius, and none less than q.mean - |q|
radius. One pass over means and radii gives every query a score that k vectors reach at least; the second pass
multiplies only blocks whose bound reaches that, or the task's own k-th best so far, as one matrix product for all
queries that need the block. Candidates are scored again term by term, so that scores are those of
retrieval.inner_product to the last bit, whatever the block.

Queries are a stated set, taken in blocks of QUERIES, each broadcast. A centre that holds very many vectors is dealt
out by salt. Defined cases: vectors that are null, of another size than most, or hold a null or NaN have no
score and are left out; equal scores go by key; fewer than k vectors give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.scratch import stored

BLOCK, CENTRES, QUERIES = 1024, 1024, 16_384
#: Queries whose bounds, and products whose scores, a task holds at once.
AT_ONCE, PRODUCTS = 1000, 1 << 20
NO_KEY = np.iinfo(np.int64).max
BLOCKS = "mean binary, radius double, n int, keys array<long>, vectors binary"
#: Relative slack for sums in another order.
SLACK = 1e-9


@dataclass
class Index:
    blocks: DataFrame
    size: int


def matrix_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those lists of a column that have `size` numbers."""
    fits = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
    m = flat.reshape(len(fits), size)
    good = np.flatnonzero(~np.isnan(m).any(axis=1))
    return fits[good], m[good]


def build(vectors: DataFrame, key: str = "chunk_id", vector: str = "embedding", block: int = BLOCK, centres: int = CENTRES) -> Index:
    """The stored index of vectors. Centres are vectors themselves, chosen by a hash of their key, as many as blocks but
    `centres` at most: they shape the blocks, and no result depends on them."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    sizes = sorted(((r["count"], r.size) for r in rows.groupBy(F.size("v").alias("size")).count().collect()), reverse=True)
    n, size = sizes[0] if sizes else (0, 0)
    some = [r.v for r in rows.filter(F.size("v") == size).orderBy(F.xxhash64("key"), "key").limit(max(1, min(centres, -(-n // block)))).collect()]
    good = [c for c in some if all(x is not None and x == x for x in c)]
    sent = spark.sparkContext.broadcast(np.array(good, np.float64).reshape(len(good), size))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        half = (c * c).sum(axis=1) / 2
        for b in batches:
            at, m = matrix_of(b.column("v"), size)
            centre = np.argmax(m @ c.T - half, axis=1) if len(c) and len(m) else np.zeros(len(at), np.int64)
            yield pa.record_batch([pa.array(centre.astype(np.int32)), b.column("key").take(pa.array(at)), pa.array([x.tobytes() for x in m], pa.binary())], ["centre", "key", "v"])

    near = stored(rows.mapInArrow(nearest, "centre int, key long, v binary"), "near")
    held = near.groupBy("centre").count()  # a row a centre
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / (32 * block))).alias("salt")
    dealt = near.join(F.broadcast(held), "centre").select("centre", salt, "key", "v").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "key")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(keys: list, vs: list) -> pa.RecordBatch:
            m = np.frombuffer(b"".join(vs), np.float64).reshape(-1, size)
            mean = m.mean(axis=0)
            radius = float(np.sqrt(((m - mean) ** 2).sum(axis=1).max()))
            return pa.record_batch([pa.array([mean.tobytes()]), pa.array([radius]), pa.array([len(keys)], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([m.tobytes()])], [x.split()[0] for x in BLOCKS.split(", ")])

        keys, vs, of = [], [], None
        for b in batches:
            for centre, k, v in zip(b.column("centre").to_pylist(), b.column("key").to_pylist(), b.column("v").to_pylist()):
                if keys and (centre != of or len(keys) == block):
                    yield row(keys, vs)
                    keys, vs = [], []
                keys.append(k)
                vs.append(v)
                of = centre
        if keys:
            yield row(keys, vs)

    return Index(stored(dealt.select("centre", "key", "v").mapInArrow(made, BLOCKS), "vector_index"), size)


def floors(index: Index, queries: np.ndarray, k: int) -> np.ndarray:
    """For every query a score that k vectors reach, by means and radii alone; minus infinity if there are fewer."""
    sent, size = index.blocks.sparkSession.sparkContext.broadcast(queries), index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        norm = np.sqrt((q * q).sum(axis=1))
        means, radii, ns = [], [], []
        for b in batches:
            if b.num_rows:
                means.append(np.frombuffer(b"".join(b.column("mean").to_pylist()), np.float64).reshape(-1, size))
                radii.append(b.column("radius").to_numpy().copy())
                ns.append(b.column("n").to_numpy().astype(np.int64))
        if means:
            mean, radius, n = np.concatenate(means), np.concatenate(radii), np.concatenate(ns)
            most = min(k, len(n))  # k blocks hold k vectors
            for at in range(0, len(q), AT_ONCE):
                low = mean @ q[at : at + AT_ONCE].T - radius[:, None] * norm[at : at + AT_ONCE]
                best = np.argpartition(-low, most - 1, axis=0)[:most]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(low, best, 0), axis=0), 0)
                held = n[best]
                i, j = np.nonzero(np.cumsum(held, axis=0) - held < k)  # as many of the task's blocks as hold k vectors
                yield pa.record_batch([pa.array((j + at).astype(np.int32)), pa.array(low[best[i, j], j]), pa.array(held[i, j].astype(np.int32))], ["query", "low", "n"])

    found = index.blocks.select("mean", "radius", "n").mapInArrow(run, "query int, low double, n int")
    reached = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0))
    out = np.full(len(queries), -np.inf)
    for r in found.withColumn("reached", reached).filter(F.col("reached") >= k).groupBy("query").agg(F.max("low").alias("low")).collect():
        out[r["query"]] = r.low
    return out - SLACK * (1 + np.abs(np.where(np.isfinite(out), out, 0)))


class Best:
    """A task's k best of each query so far, and the score that a vector must reach to be one."""

    def __init__(self, queries: np.ndarray, least: np.ndarray, k: int):
        self.q, self.columns, self.least, self.k = queries, np.ascontiguousarray(queries.T), least.copy(), k
        self.scores, self.keys = np.full((len(queries), k), -np.inf), np.full((len(queries), k), NO_KEY)

    def offer(self, need: np.ndarray, m: np.ndarray, keys: np.ndarray) -> None:
        """Vectors to the queries `need`, all at once."""
        k, rough = self.k, self.q[need] @ m.T
        slack = SLACK * (1 + np.abs(rough))
        mask = rough + slack >= self.least[need][:, None]
        many = np.flatnonzero(mask.sum(axis=1) > 4 * k)
        if len(many):
            kth = np.partition(rough[many], len(m) - k, axis=1)[:, len(m) - k]
            mask[many] &= rough[many] + 2 * slack[many] >= kth[:, None]
        i, j = np.nonzero(mask)
        if not len(i):
            return
        of, by = need[i], np.ascontiguousarray(m.T)
        score = by[0][j] * self.columns[0][of]
        for c in range(1, len(by)):  # in order, as SQL adds
            score += by[c][j] * self.columns[c][of]
        good = score >= self.scores[of, k - 1]
        of, score, key = of[good], score[good], keys[j[good]]
        met = np.unique(of)
        who, score, key = np.concatenate((np.repeat(met, k), of)), np.concatenate((self.scores[met].reshape(-1), score)), np.concatenate((self.keys[met].reshape(-1), key))
        order = np.lexsort((key, -score, who))
        at = order[np.searchsorted(who[order], met)[:, None] + np.arange(k)]
        self.scores[met], self.keys[met] = score[at], key[at]
        last = self.scores[met, k - 1]
        full = np.isfinite(last)
        self.least[met[full]] = np.maximum(self.least[met[full]], last[full] - SLACK * (1 + np.abs(last[full])))


def _search(index: Index, ids: list, queries: np.ndarray, k: int, counts: tuple | None) -> DataFrame:
    spark, size = index.blocks.sparkSession, index.size
    sent = spark.sparkContext.broadcast((ids, queries, floors(index, queries, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, least = sent.value
        norm = np.sqrt((q * q).sum(axis=1))
        best = Best(q, least, k)
        for batch in batches:
            for mean, radius, keys, vectors in zip(*(batch.column(c) for c in ("mean", "radius", "keys", "vectors"))):
                most = q @ np.frombuffer(mean.as_buffer(), np.float64) + norm * radius.as_py()
                need = np.flatnonzero(most + SLACK * (1 + np.abs(most)) >= best.least)
                if counts:
                    counts[0 if len(need) else 1].add(1)
                m, keys = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, size), keys.values.to_numpy()
                width = max(1, PRODUCTS // len(m))
                for at in range(0, len(need), width):
                    best.offer(need[at : at + width], m, keys)
        i, j = np.nonzero(best.keys != NO_KEY)
        yield pa.record_batch([pa.array(np.array(ids, np.int64)[i]), pa.array(best.keys[i, j]), pa.array(best.scores[i, j])], ["place", "key", "score"])

    found = index.blocks.mapInArrow(run, "place long, key long, score double")
    best = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, query: str = "query_id", vector: str = "vector", counts: tuple | None = None) -> DataFrame:
    """query_id, key, score, rank of every query's k best vectors. counts, two accumulators, get the blocks read and
    skipped (a task that runs twice counts twice)."""
    kind = queries.schema[query].dataType.simpleString()
    wanted = stored(queries.select(F.col(query).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("number")), "queries")
    blocks = max(1, -(-wanted.count() // QUERIES))
    parts = []
    for block in range(blocks):
        rows = [r for r in wanted.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).collect() if r.v is not None and len(r.v) == index.size and None not in r.v]
        if rows:
            named = queries.sparkSession.createDataFrame([(k, r.query_id) for k, r in enumerate(rows)], f"place long, query_id {kind}")
            found = _search(index, list(range(len(rows))), np.array([r.v for r in rows], np.float64), k, counts)
            parts.append(found.join(F.broadcast(named), "place").select("query_id", "key", "score", "rank"))  # QUERIES rows or so
    none = queries.sparkSession.createDataFrame([], f"query_id {kind}, key long, score double, rank int")
    return reduce(DataFrame.unionByName, parts) if parts else none

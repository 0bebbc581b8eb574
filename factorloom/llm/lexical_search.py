"""Ranked lexical search: windowed bucket scoring of all documents for each item of a benchmark.

build_index turns documents, as they are scanned, into windows of WINDOW document numbers at most. A window's row holds
its documents' ids and lengths and, term by term, the posting lists of documents and counts. Nothing is shuffled. A
scoring task reads its windows one after the other. For each item it adds up the item's posting lists in an array of one
window, which fits into a core's cache, marks the documents that a list touches in a bitset, and harvests those into the
item's heap. A window whose largest possible score can't enter a full heap is skipped. The heaps of all tasks are then
merged, so that `most` rows a task and item are shuffled.

Items are taken in blocks of ITEMS rows and ITEM_BYTES bytes in expectation, whatever their number: a block's terms and
items are broadcast, and its index holds its terms alone. Blocks are searched one after the other, and all their results
together are the result.

Score of a document: sum over the item's terms, repeats included, of w * ((1000000000 tf) div (1000 tf + 12 m)), with
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 75 + ((25 n N) div L). N documents have terms, L in all; n is the
document's number of terms, df that of documents with the term, tf its occurrences in the document.

Defined cases: null texts have no terms; an item without terms, or without a document that scores above 0, has no rows.
Benchmark rows that share item_id, or repeat, are ranked each for itself. Documents that repeat are found each for
itself; equal scores go by doc_id, null last. Long texts are read by stretches. Extra columns are not read. Empty tables
give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import ALNUM, blobs, by_bytes, small_batches, stored, word_lists

WINDOW, POSTINGS = 4096, 4 << 20
ITEMS, ITEM_BYTES = 10_000, 16 << 20
INDEX = "doc_ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, docs array<smallint>, counts array<int>"
LAST = (1 << 63) - 1


class Building:
    """The window that a task fills."""

    def __init__(self, window: int):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.keys, self.counts, self.held = [], [], 0

    def add(self, doc_id: int | None, length: int, ids: list[np.ndarray]) -> None:
        """A document: its number of terms and the ids of those that are in the lexicon, by stretches."""
        found, counts = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.keys.append(found * self.window + len(self.doc_ids))
        self.counts.append(counts)
        self.doc_ids.append(doc_id)
        self.lengths.append(length)
        self.held += len(found)

    def full(self) -> bool:
        return len(self.doc_ids) == self.window or self.held >= POSTINGS

    def row(self) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        term = keys[order] // self.window
        terms, sizes = np.unique(term, return_counts=True)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int32())
        columns = (self.doc_ids, self.lengths, terms.astype(np.int32), sizes.astype(np.int32), (keys[order] % self.window).astype(np.int16), counts[order].astype(np.int32))
        names = [x.split()[0] for x in INDEX.split(", ")]
        out = pa.record_batch([pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)], names)
        self.clear()
        return out


def build_index(docs: DataFrame, terms: list[bytes], window: int = WINDOW) -> DataFrame:
    """Windows of `window` documents with posting lists of `terms`; a term's id is its place among them."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: k for k, t in enumerate(sent.value)}
        building = Building(window)
        for batch in batches:
            for b in by_bytes(batch, "text"):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), blobs(b.column("text"))):
                    length, ids = 0, []
                    for words in word_lists(text.translate(ALNUM)):
                        length += len(words)
                        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                        ids.append(found[found >= 0])
                    building.add(doc_id, length, ids)
                    if building.full():
                        yield building.row()
        if building.doc_ids:
            yield building.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def rounded_length(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms."""
    if int(n.max(initial=0)) * 25 * documents > LAST:
        return np.array([75 + 25 * int(x) * documents // terms for x in n], np.int64)
    return 75 + 25 * n * documents // max(terms, 1)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Heap:
    """The `most` best of what is harvested: (score, least doc_id first)."""

    def __init__(self, most: int):
        self.most, self.held = most, []

    @property
    def least(self) -> int:
        """A score below this one can't enter."""
        return self.held[0][0] if len(self.held) == self.most else 1

    def harvest(self, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good) > self.most:
            good = good[np.lexsort((doc_ids[good], -scores[good]))[: self.most]]
        for score, doc_id in zip(scores[good].tolist(), doc_ids[good].tolist()):
            if len(self.held) < self.most:
                heapq.heappush(self.held, (score, -doc_id))
            else:
                heapq.heappushpop(self.held, (score, -doc_id))


def score_windows(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, terms: int, most: int, window: int = WINDOW) -> DataFrame:
    """item (its place among items), doc_id, score: each task's best. An item is its term ids and their repeats."""
    sent = index.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        heaps = [Heap(most) for _ in items]
        place = np.full(len(weight), -1, np.int64)
        sums, empty = np.zeros(window, np.int64), np.zeros(-(-window // 8), np.uint8)
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, named, sizes, docs, counts = (batch.column(c)[row].values.to_numpy() for c in ("lengths", "terms", "sizes", "docs", "counts"))
                if not len(named):
                    continue
                doc_ids = batch.column("doc_ids")[row].values.fill_null(LAST).to_numpy()
                docs, tf = docs.astype(np.int64), counts.astype(np.int64)
                values = np.repeat(weight[named], sizes) * (1_000_000_000 * tf // (1000 * tf + 12 * rounded_length(lengths, documents, terms)[docs]))
                ends = np.cumsum(sizes)
                starts = ends - sizes
                highest = np.maximum.reduceat(values, starts)
                place[named] = np.arange(len(named))
                bits: dict[int, np.ndarray] = {}
                for heap, (ids, repeats) in zip(heaps, items):
                    at = place[ids]
                    there = at >= 0
                    if int((highest[at[there]] * repeats[there]).sum()) < heap.least:
                        continue
                    occupied = empty.copy()
                    for k, n in zip(at[there].tolist(), repeats[there].tolist()):
                        of = docs[starts[k] : ends[k]]
                        sums[of] += n * values[starts[k] : ends[k]]
                        if k not in bits:
                            marked = np.zeros(window, bool)
                            marked[of] = True
                            bits[k] = np.packbits(marked)
                        occupied |= bits[k]
                    touched = np.flatnonzero(np.unpackbits(occupied))
                    heap.harvest(sums[touched], doc_ids[touched])
                    sums[touched] = 0
                place[named] = -1
        found = [(k, None if doc_id == -LAST else -doc_id, score) for k, heap in enumerate(heaps) for score, doc_id in heap.held]
        columns = list(zip(*found)) or [[]] * 3
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, most: int = 20, window: int = WINDOW, per_block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the `most` best documents for each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    rows = stored(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // per_block), -(-size.bytes // ITEM_BYTES))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        some = rows.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).collect()
        if some:
            found = search_block(docs, some, kind, most, window)
            out = found if block == 0 else out.unionByName(found)
    return out


def search_block(docs: DataFrame, items: list, kind: str, most: int, window: int = WINDOW) -> DataFrame:
    """The same for the rows (item_id, text) of one block."""
    spark = docs.sparkSession
    said = [Counter(r.text.encode().translate(ALNUM).split()) for r in items]
    lexicon = sorted(set().union(*said))
    known = {t: k for k, t in enumerate(lexicon)}
    coded = [(np.array([known[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in said]
    index = stored(build_index(docs, lexicon, window), "windows")
    total = index.agg(F.coalesce(F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(lexicon), np.int64)
    for r in index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df")).collect():  # a block's terms at most
        df[r.terms] = r.df
    scored = score_windows(index, coded, weights(df, total.documents), total.documents, total.terms, most, window)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    named = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(items)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # ITEMS rows

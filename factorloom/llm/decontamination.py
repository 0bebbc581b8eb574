"""Benchmark decontamination with a distributed positional inverted index.

build_index posts every benchmark term of every document: term, document and ascending word positions, and under the
empty term each document's word count. A phrase search takes each phrase's rarest terms by postings in the index,
shifts their positions back to where the phrase would start, intersects these lists, and then settles each start left
against the postings of all the phrase's terms. With slop above 0 each term may be that many words away from its
place, in any order: a proximity match.

The vocabulary that limits the index is broadcast only up to VOCABULARY terms; a larger benchmark gets an index of all
terms. Windows are broadcast only up to PHRASES of them, the items' words up to ten times as many, and the documents
left to settle up to ROWS ids; beyond that they are joined by shuffle.

Defined cases: a null or empty text has no words and no hits. Items without words have no windows; items of fewer
words than a window are one window. Rows that repeat, by doc_id or in full, are indexed and reported each for itself.
Only doc_id, item_id and text are read, so extra columns may have any name. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import ALNUM, blobs, by_bytes, small_batches, stored

VOCABULARY, PHRASES, ROWS = 1_000_000, 200_000, 2_000_000
POSTINGS = "row_id long, doc_id long, term string, positions array<int>"


def item_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(ALNUM).split()


def sequences(items: DataFrame) -> DataFrame:
    """sequence (an id), words, item_ids: the distinct non-empty word sequences of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[w.decode() for w in item_words(text)] for text in blobs(b.column("text"))]
            yield pa.record_batch([b.column("item_id"), pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item_id string, words array<string>")
    return rows.filter(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.sha2(F.array_join("words", " "), 256).alias("sequence"), "words", "item_ids")


def with_ids(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and text of docs."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def build_index(rows: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Postings (row_id, doc_id, term, positions) of the given terms of rows (row_id, doc_id, text), or of all terms;
    term '' holds [number of words]."""
    small_batches(rows.sparkSession)
    sent = None if terms is None else rows.sparkSession.sparkContext.broadcast(sorted(terms))  # VOCABULARY of them at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if sent is None else sent.value
        known = None if fixed is None else {t.encode(): k for k, t in enumerate(fixed)}
        spelled = None if fixed is None else pa.array(fixed, pa.string())
        for batch in batches:
            for b in by_bytes(batch, "text"):
                words = [item_words(x) for x in blobs(b.column("text"))]
                lengths = np.array([len(x) for x in words], np.int64)
                flat = [w for x in words for w in x]
                names, lexicon = spelled, known
                if known is None:
                    lexicon = {w: k for k, w in enumerate(dict.fromkeys(flat))}
                    names = pa.array([w.decode() for w in lexicon], pa.string())
                ids = np.fromiter(map(lexicon.get, flat, repeat(-1)), np.int64, len(flat))
                at = np.flatnonzero(ids >= 0)
                row = np.repeat(np.arange(len(words)), lengths)[at]
                position = (at - (np.cumsum(lengths) - lengths)[row]).astype(np.int32)
                key = row * (len(lexicon) + 1) + ids[at]
                order = np.argsort(key, kind="stable")
                head = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(order) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)), pa.int32()), pa.array(position[order]))
                sizes = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1), pa.int32()), pa.array(lengths.astype(np.int32)))
                row_id, doc_id = b.column("row_id"), b.column("doc_id")
                of = pa.array(row[order][head])
                yield pa.record_batch([row_id, doc_id, pa.array([""] * len(words), pa.string()), sizes], ["row_id", "doc_id", "term", "positions"])
                yield pa.record_batch([row_id.take(of), doc_id.take(of), names.take(pa.array(ids[at][order][head])), lists], ["row_id", "doc_id", "term", "positions"])

    return rows.mapInArrow(post, POSTINGS)


def find(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """row_id, sequence, offset, start, length: where windows of items (sequence, words) occur.

    A window is `width` consecutive words of an item, or all of a shorter item; offset is its place in the item, start
    its place in the document. A posting of the item's word at offset o is shifted by o to its diagonal, so that words
    of one occurrence meet on one diagonal whichever windows they belong to.
    """
    words = items.select("sequence", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    wanted = words.select("term").distinct()
    near = F.broadcast if wanted.count() <= VOCABULARY else _as_is
    posted = index.filter("term <> ''").join(near(wanted), "term", "left_semi")
    frequency = posted.groupBy("term").agg(F.sum(F.size("positions")).alias("frequency"))
    # a row per window with its words, rarest first; a window with a word that is posted nowhere can't occur
    spans = items.select("sequence", F.size("words").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("window"))
    inside = (F.col("offset") >= F.col("window")) & (F.col("offset") < F.col("window") + width)
    ranked = (
        spans.join(words.drop("size"), "sequence").filter(inside).join(frequency, "term").groupBy("sequence", "window", "size")
        .agg(F.array_sort(F.collect_list(F.struct("frequency", "term", "offset"))).alias("ranked"))
        .filter(F.size("ranked") == F.least("size", F.lit(width)))
    )
    ranked = stored(ranked.select("sequence", "window", F.size("ranked").alias("length"), F.col("ranked")[0].alias("a"), F.expr("get(ranked, 1)").alias("b")), "windows")
    near = F.broadcast if ranked.count() <= PHRASES else _as_is
    near_words = F.broadcast if words.count() <= 10 * PHRASES else _as_is

    def diagonals(which: str) -> DataFrame:
        of = ranked.filter(F.col(which).isNotNull()).select("sequence", F.col(f"{which}.term").alias("term"), F.col(f"{which}.offset").alias(f"{which}_offset")).distinct()
        shifted = F.transform("positions", lambda p: p - F.col(f"{which}_offset"))
        return posted.join(near(of), "term").select("row_id", "sequence", f"{which}_offset", shifted.alias(which))

    def meets(x: Column, y: Column) -> Column:
        return F.array_intersect(x, y) if slop == 0 else F.filter(x, lambda s: F.exists(y, lambda t: F.abs(s - t) <= 2 * slop))

    pairs = ranked.select("sequence", "window", "length", F.col("a.offset").alias("a_offset"), F.col("b.offset").alias("b_offset"))
    both = near(pairs.filter("b_offset is not null").select("sequence", "a_offset", "b_offset").distinct())
    rare = diagonals("a")
    two = rare.join(diagonals("b"), ["row_id", "sequence"]).join(both, ["sequence", "a_offset", "b_offset"]).select("row_id", "sequence", "a_offset", "b_offset", meets(F.col("a"), F.col("b")).alias("at"))
    one = rare.join(near(pairs.filter("b_offset is null").select("sequence", "a_offset").distinct()), ["sequence", "a_offset"]).select("row_id", "sequence", "a_offset", F.lit(None).cast("int").alias("b_offset"), F.col("a").alias("at"))
    left = stored(two.unionByName(one).filter(F.size("at") > 0), "met")
    rows = stored(left.select("row_id").distinct(), "rows")
    few = F.broadcast if rows.count() <= ROWS else _as_is
    of_rows = posted.join(few(rows), "row_id", "left_semi").select("row_id", "term", "positions")
    same = F.col("l.sequence").eqNullSafe(F.col("p.sequence")) & F.col("l.a_offset").eqNullSafe(F.col("p.a_offset")) & F.col("l.b_offset").eqNullSafe(F.col("p.b_offset"))
    # the anchor itself may be off its place, so that starts around its diagonal are settled too
    starts = F.col("at") if slop == 0 else F.array_distinct(F.flatten(F.transform("at", lambda d: F.sequence(d - slop, d + slop))))
    places = left.withColumn("diagonal", F.explode(starts)).drop("at").distinct().alias("l").join(near(pairs).alias("p"), same).select("l.row_id", "l.sequence", "diagonal", "window", "length").distinct()
    checks = places.join(near_words(words.drop("size")), "sequence").filter(inside).withColumn("at", F.col("diagonal") + F.col("offset"))
    there = F.array_contains("positions", F.col("at")) if slop == 0 else F.exists("positions", lambda p: F.abs(p - F.col("at")) <= slop)
    settled = checks.join(of_rows, ["row_id", "term"]).filter(there).groupBy("row_id", "sequence", "window", "diagonal", "length").agg(F.count(F.lit(1)).alias("n"))
    return settled.filter("n = length").select("row_id", "sequence", F.col("window").alias("offset"), (F.col("diagonal") + F.col("window")).alias("start"), "length")


def _as_is(df: DataFrame) -> DataFrame:
    return df


def contaminated_words(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contaminated_rows(with_ids(docs), items, width, slop).drop("row_id")


def contaminated_rows(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """The same for rows (row_id, doc_id, text), with their row_id."""
    wanted = stored(sequences(items), "items")
    terms = wanted.select(F.explode("words").alias("term")).distinct()
    vocabulary = [r.term for r in terms.limit(VOCABULARY + 1).collect()]
    index = stored(build_index(docs, vocabulary if len(vocabulary) <= VOCABULARY else None), "index")
    hits = stored(find(index, wanted.select("sequence", "words"), width, slop), "hits")
    spans = hits.groupBy("row_id").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    found = spans.select("row_id", words.cast("long").alias("n_hit"))
    ids = hits.select("row_id", "sequence").distinct().join(wanted.select("sequence", "item_ids"), "sequence").select("row_id", F.explode("item_ids").alias("item_id")).groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = index.filter("term = ''").select("row_id", "doc_id", F.col("positions")[0].cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    full = rows.join(found, "row_id", "left").join(ids, "row_id", "left").withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return full.select("row_id", "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

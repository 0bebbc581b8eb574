"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.scratch import OWN, STORED, drop_stored, shared_dir, stored  # noqa: F401

U64 = np.uint64
#: Byte maps: words of letters and digits (op1) lower-cased, and plain A-Z lower-casing.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Whole texts may be long, so Arrow batches to Python hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


SPACE = re.compile(rb"[ \t-\r]")


def word_lists(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, runs without ASCII white space, by stretches of about `most` bytes: as objects, words take
    many times a text's size."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + most)
        to = end.start() if end else len(text)
        yield text[at:to].split()
        at = to


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit name per word, the same in every task."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit name of the ordered pair (a, b)."""
    a, b = np.atleast_1d(a), np.atleast_1d(b)
    x = a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(31))) * U64(0xC2B2AE3D27D4EB4F) + U64(0x165667B19E3779F9)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def block_hash(names: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Name of names[s:s+length] for each s in start."""
    out = np.zeros(len(start), U64)
    for k in range(length):
        out = mix(out, names[start + k])
    return out


def shingle_hashes(blob: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles of an A-Z lower-cased text.

    Words are runs without ASCII white space. A text of fewer than `width` words gives its whole word sequence
    as one shingle; a text without words gives none.
    """
    names = np.concatenate([np.empty(0, U64), *map(word_hashes, word_lists(blob.translate(LOWER)))])
    if not len(names):
        return np.empty(0, U64)
    if len(names) <= width:
        out = U64(len(names)) * np.ones(1, U64)
        for k in range(len(names)):
            out = mix(out, names[k : k + 1])
        return out
    out = np.full(len(names) - width + 1, width, U64)
    for k in range(width):
        out = mix(out, names[k : len(names) - width + 1 + k])
    return np.unique(out)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes, one row at least."""
    sizes = np.cumsum(np.array([len(x) for x in blobs(batch.column(column))], np.int64)) if batch.num_rows else np.empty(0)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give memory that Arrow and the C library hold unused back to the system: worker processes live on and share theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def stable(docs: DataFrame) -> DataFrame:
    """docs whose rows come in the same parts and order at every reading, so that numbers given to them hold: as they
    are if they are a plain scan of files, else written once."""

    def plain(plan) -> bool:
        children = [plan.children().apply(k) for k in range(plan.children().size())]
        return plan.nodeName() == "LogicalRelation" or plan.nodeName() in ("Project", "Filter") and all(map(plain, children))

    plan = docs._jdf.queryExecution().optimizedPlan()
    return docs if plan.deterministic() and plain(plan) else stored(docs, "rows")


def numbered(docs: DataFrame) -> DataFrame:
    """Every row of docs once, stored: row_id and doc, its columns."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row_id"), columns), "numbered")


def in_chunks(docs: DataFrame, per_chunk: int = 1000, most: int = 16 << 20) -> tuple[DataFrame, int, int]:
    """row_id, chunk, doc_id and text of docs, dealt out by chunk; the number of documents; a number of key ranges.

    A chunk holds about per_chunk documents, or fewer of `most` bytes together, whichever their ids, so one source or
    key can't fill it; a single text may be longer. Two passes over the result share one shuffle.
    """
    spark = docs.sparkSession
    rows = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    chunks = max(1, -(-size.n // per_chunk), -(-size.bytes // most))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id()).withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // 4000), -(-size.bytes // most))
    return rows.repartition("chunk"), size.n, parts


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(33)) % U64(parts)).astype(np.int32)


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()

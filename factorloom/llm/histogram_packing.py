"""Packing of tokenized documents into fixed-length sequences: shortest pack first over the histogram of lengths.

tokenize encodes every whole text and cuts what is longer than a sequence into whole ones and a rest. The lengths'
histogram, at most one row a length, goes to the driver, where plan places lengths longest first: a length goes to the
pack with the most space that holds it, for all packs alike at once, so that packing patterns and their counts change
and never single documents. Packs that stay loose, as of many documents of one length over half a sequence, are filled
anew by cutting documents where checksums were kept, every GRID tokens, if that saves sequences. A sequence whose
tokens are a power of two needs no padding and is never loose.

Patterns then become parts, ranges of ranks within a length; every document gets its rank within its length, and its
parts with it. A length's documents are dealt out by salt, SALTED rows a salt on average, so that no length, however
common, meets in one task; only the salts' counts are added up.

Defined cases: a null or empty text has no tokens but its end token. Rows that repeat are packed each for itself.
Columns other than doc_id and text are not read. A text of any length is encoded by stretches, but its ids, four bytes
a token, are held at once. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import blobs, by_bytes, small_batches, stored
from factorloom.llm.packing import Encoder

#: Tokens between kept checksums, where a document may be cut; documents a salt; salts that are broadcast.
GRID, SALTED, SALTS = 64, 10_000, 200_000
#: Words whose ids a worker process remembers, some 180 MB.
REMEMBERED = 800_000
PIECES = "doc_id long, row_id long, start long, length int, ids_crc32 long, doc_tokens long, marks binary"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def checksums(ids: bytes, grid: int = GRID) -> tuple[int, bytes]:
    """crc32 of ids, and those of its beginnings at every grid-th token before its end."""
    crc, marks = 0, []
    for at in range(0, len(ids), 4 * grid):
        if at:
            marks.append(crc)
        crc = zlib.crc32(ids[at : at + 4 * grid], crc)
    return crc, np.array(marks, "<u4").tobytes()


def checksum_of_rest(whole: int, head: int, rest_bytes: int) -> int:
    """crc32 of what follows a head, from those of both together and of the head."""
    zeros = bytes(rest_bytes)
    return whole ^ zlib.crc32(zeros, head) ^ zlib.crc32(zeros)


def tokenize(docs: DataFrame, tokenizer: str, most: int = 4096, end: int = 2, grid: int = GRID) -> DataFrame:
    """Whole sequences and rests of every document, with their checksums."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(tokenizer, REMEMBERED)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            for b in by_bytes(batch, "text", 2 << 20):
                rows: list[list] = [[] for _ in kinds]
                for doc_id, row_id, ids in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), encoder.encode(blobs(b.column("text")), end)):
                    for at in range(0, len(ids), 4 * most):
                        part = ids[at : at + 4 * most]
                        for column, value in zip(rows, (doc_id, row_id, at // 4, len(part) // 4, *(checksums(part, grid) if len(part) < 4 * most else (zlib.crc32(part), None)), len(ids) // 4)):
                            column.append(value)
                rows[5], rows[6] = rows[6], rows[5]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(rows, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


@dataclass
class Packs:
    """count packs with the same slots (length, documents), the last one first."""

    count: int
    slots: tuple | None = None

    def listed(self) -> list[tuple[int, int]]:
        out, at = [], self.slots
        while at is not None:
            out.append((at[1], at[2]))
            at = at[0]
        return out[::-1]


def shortest_pack_first(histogram: np.ndarray) -> list[list[Packs]]:
    """Packs by free space. histogram[n] counts the documents of n tokens; its last index is a sequence's size."""
    most = len(histogram) - 1
    packs: list[list[Packs]] = [[] for _ in range(most + 1)]
    widest = 0
    for length in range(most, 0, -1):
        left, free = int(histogram[length]), widest
        while left:
            while free >= length and not packs[free]:
                free -= 1
            if free >= length:
                some = packs[free][-1]
                took, rest, slots = min(some.count, left), some.count - left, some.slots
                if rest > 0:
                    some.count = rest
                else:
                    packs[free].pop()
                # one more of the same length lengthens the last slot
                slots = (slots[0], length, slots[2] + 1) if slots and slots[1] == length else (slots, length, 1)
                packs[free - length].append(Packs(took, slots))
                left -= took
                continue
            each = most // length
            for count, documents in ((left // each, each), (1, left % each)):
                if count and documents:
                    space = most - documents * length
                    packs[space].append(Packs(count, (None, length, documents)))
                    widest = max(widest, space)
            left = 0
    return packs


@dataclass
class Plan:
    """Parts of ranks: documents of `length` with ranks first to first + n - 1 give their tokens from a to b, `each` of
    them to a sequence from `sequence` on, side by side from `offset` on; level counts their cuts before a."""

    rows: list[tuple[int, ...]] = field(default_factory=list)
    sequences: int = 0

    def put(self, length: int, first: int, n: int, a: int, b: int, each: int, offset: int, level: int) -> None:
        self.rows.append((level, length, first, n, a, b, self.sequences, each, offset))


def plan(histogram: np.ndarray, grid: int = GRID) -> Plan:
    """Where the documents of a histogram of lengths go."""
    most = len(histogram) - 1
    packs = shortest_pack_first(histogram)
    out, following = Plan(), np.zeros(most + 1, np.int64)
    loose = [p for free in range(grid, most) if (most - free) & (most - free - 1) for p in packs[free]]
    tokens = sum(p.count * n * k for p in loose for n, k in p.listed())
    if sum(p.count for p in loose) <= -(-tokens // (most - grid)):
        loose = []
    anew = {id(p) for p in loose}
    for p in (p for some in packs for p in some if id(p) not in anew):
        offset = 0
        for length, documents in p.listed():
            out.put(length, int(following[length]), p.count * documents, 0, length, documents, offset, 0)
            following[length] += p.count * documents
            offset += length * documents
        out.sequences += p.count
    refill(out, [(length, 0, int(following[length]), int(histogram[length] - following[length]), 0) for length in range(1, most + 1) if histogram[length] > following[length]], most, grid)
    return out


def refill(out: Plan, rests: list[tuple[int, int, int, int, int]], most: int, grid: int) -> None:
    """Sequences of rests (length, a, first, n, level), the tokens from a on of n documents, cutting on the grid.

    Of each pattern, the longest rests come first, and the one that doesn't fit is cut; the pattern repeats as often as
    its rests last.
    """
    while rests:
        rests.sort(key=lambda r: (r[1] - r[0], r[0], r[2]))
        free, used, cut = most, {}, None
        for k, (length, a, _, n, _) in enumerate(rests):
            size = length - a
            used[k] = min(free // size, n)
            free -= used[k] * size
            if used[k] < n and free >= grid:  # the next one doesn't fit
                cut = (k, free // grid * grid)
                break
            if free < grid:
                break
        need = {k: u + (cut is not None and cut[0] == k) for k, u in used.items()}
        times = min(rests[k][3] // n for k, n in need.items() if n)
        offset, later = 0, []
        for k, (length, a, first, n, level) in enumerate(rests):
            took = used.get(k, 0) * times
            if took:
                out.put(length, first, took, a, length, used[k], offset, level)
                offset += used[k] * (length - a)
            first, n = first + took, n - took
            if cut and cut[0] == k:
                out.put(length, first, times, a, a + cut[1], 1, offset, level)
                later.append((length, a + cut[1], first, times, level + 1))
                first, n = first + times, n - times
            if n:
                later.append((length, a, first, n, level))
        out.sequences += times
        rests = later


def with_ranks(pieces: DataFrame, counts: list[tuple[int, int]]) -> DataFrame:
    """pieces with rank, from 0 on within their length."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(length, -(-n // SALTED)) for length, n in counts], "length int, salts long")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row_id", "start"), F.col("salts"))).drop("salts")  # a row a length
    sizes = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    if sum(-(-n // SALTED) for _, n in counts) <= SALTS:
        base = F.broadcast(base)
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id", "start"))
    return dealt.withColumn("number", number).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("number") - 1).drop("number", "base", "salt")


def placed(ranked: DataFrame, parts: Plan, grid: int = GRID) -> DataFrame:
    """A row per part of every ranked piece."""
    table = np.array(sorted(parts.rows), np.int64).reshape(-1, 9)
    sent = ranked.sparkSession.sparkContext.broadcast(table)  # bounded by the number of lengths, not of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        levels = [table[table[:, 0] == k] for k in range(int(table[:, 0].max(initial=-1)) + 1)]
        keys = [(t[:, 1] << 48) | t[:, 2] for t in levels]
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            start, crc, tokens = (b.column(c).to_numpy() for c in ("start", "ids_crc32", "doc_tokens"))
            rows = np.arange(b.num_rows)
            for t, key in zip(levels, keys):
                at = np.searchsorted(key, (length[rows] << 48) | rank[rows], "right") - 1
                inside = (at >= 0) & (t[at, 1] == length[rows]) & (rank[rows] < t[at, 2] + t[at, 3])
                rows, at = rows[inside], at[inside]
                if not len(rows):
                    break
                a, z, each = t[at, 4], t[at, 5], t[at, 7]
                within = rank[rows] - t[at, 2]
                said = crc[rows].copy()
                for k in np.flatnonzero((a > 0) | (z < length[rows])):
                    marks = np.frombuffer(b.column("marks")[int(rows[k])].as_py(), "<u4")
                    to = int(marks[z[k] // grid - 1]) if z[k] < length[rows[k]] else int(said[k])
                    said[k] = checksum_of_rest(to, int(marks[a[k] // grid - 1]), 4 * int(z[k] - a[k])) if a[k] else to
                columns = (pa.array(start[rows] + a), pa.array(z - a), pa.array(said), pa.array(tokens[rows]), pa.array(t[at, 6] + within // each), pa.array(t[at, 8] + within % each * (z - a)))
                yield pa.record_batch([b.column("doc_id").take(pa.array(rows)), *columns], names)

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks", "rank").mapInArrow(run, RESULT)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = 4096, end: int = 2, grid: int = GRID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. most is a multiple of grid."""
    pieces = stored(tokenize(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), most, end, grid), "pieces")
    counts = sorted((r.length, r["count"]) for r in pieces.groupBy("length").count().collect())  # `most` rows at most
    histogram = np.zeros(most + 1, np.int64)
    for length, n in counts:
        histogram[length] = n
    parts = plan(histogram, grid)
    if not any(a or b < length for _, length, _, _, a, b, *_ in parts.rows):
        pieces = pieces.withColumn("marks", F.lit(None).cast("binary"))  # nothing is cut
    return placed(with_ranks(pieces, counts), parts, grid)

"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k least 64-bit hashes of a text's distinct 5-word shingles (A-Z lower-cased; a text of fewer words is
one shingle, a text without words has the empty sketch). Sketches of parts merge into the sketch of the whole, and
they estimate distinct shingles, resemblance and containment. A sketch of fewer than k hashes is the whole set, so
estimates are exact there.

Defined cases: null text is empty; two empty sketches have resemblance and containment 1, an empty and a full one 0.
Documents that share a doc_id follow each other by a hash of their texts, the highest first; null ids come last. The
last document is followed by the first, a single one by itself. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import U64, binary, shingle_hashes, small_batches

K = 128
WIDTH = 5
#: Bytes of text that a task compares, in expectation; places a task, and sampled documents a place, that deal them out.
RANGE, PLACES, SAMPLED = 64 << 20, 4, 20
#: Keys whose sketches a task holds before it sends them on.
HELD = 20_000


def sketch(text: bytes, k: int = K) -> np.ndarray:
    return shingle_hashes(text, WIDTH)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both sketches' sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    union = merge(a, b, k)
    return 1.0 if not len(union) else len(np.intersect1d(np.intersect1d(a, b), union)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that b's set holds."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(U64)


def fingerprints(docs: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The columns `keys` and the fingerprint of all rows with those keys: parts of a document merge into one.

    Sketches merge by key within tasks first, so a key with very many parts sends a few sketches only.
    """
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def rows(kinds: list[pa.DataType], held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([key[j] for key in held], kind) for j, kind in enumerate(kinds)]
        return pa.record_batch([*columns, pa.array([binary(x) for x in held.values()], pa.binary())], [*names, "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            kinds = [b.schema.field(n).type for n in names]
            for *key, text in zip(*(b.column(n).to_pylist() for n in names), b.column("text").to_pylist()):
                own = sketch((text or "").encode(), k)
                held[tuple(key)] = merge(held[tuple(key)], own, k) if tuple(key) in held else own
            if len(held) > HELD:
                yield rows(kinds, held)
                held = {}
        if held:
            yield rows(kinds, held)

    def merged(table: pa.Table) -> pa.Table:
        own = np.empty(0, U64)
        for x in table.column("hashes"):
            own = merge(own, np.frombuffer(x.as_buffer(), U64), k)
        return table.select(names).slice(0, 1).append_column("fingerprint", pa.array([written(own)], pa.string()))

    parts = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{ddl}, hashes binary")
    return parts.groupBy(*keys).applyInArrow(merged, f"{ddl}, fingerprint string")


def edit(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see the module's contract."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return spark.createDataFrame([], RESULT)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // RANGE))
    rate = min(1.0, SAMPLED * PLACES * parts / size.n)
    some = rows.select("id", "h").filter(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) < rate * (1 << 30)).toArrow()  # some 20 ids a place
    order = np.sort(sort_keys(some.column("id").to_numpy(), some.column("h").to_numpy()))
    cuts = np.unique(order[SAMPLED::SAMPLED])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = sort_keys(b.column("id").to_numpy(), b.column("h").to_numpy())
            place = np.searchsorted(cuts, keys, "left")
            best: dict[int, bytes] = {}
            for p, key in zip(place.tolist(), keys.tolist()):
                best[p] = max(best.get(p, b""), key)
            yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.binary())], ["place", "key"])

    # the first document of each place, by descending key; a row a place
    found = rows.select("id", "h").mapInArrow(placed, "place int, key binary").groupBy("place").agg(F.max("key").alias("key")).toArrow().sort_by("place")
    there, first = found.column("place").to_numpy(), np.array(found.column("key").to_pylist(), "S16")
    sent = spark.sparkContext.broadcast((cuts, there, first))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, there, first = sent.value
        for b in batches:
            keys = sort_keys(b.column("id").to_numpy(), b.column("h").to_numpy())
            place = np.searchsorted(cuts, keys, "left").astype(np.int32)
            at = np.searchsorted(there, place)
            leads = np.flatnonzero(first[at] == keys)
            kept = b.select(["doc_id", "text", "id", "h"])
            yield pa.record_batch([*kept.columns, pa.array(place), pa.array(np.zeros(len(keys), bool))], RANGED)
            if len(leads):  # a place's first document also follows the last one of the place above
                home = there[(at[leads] + 1) % len(there)].astype(np.int32)
                yield pa.record_batch([*kept.take(pa.array(leads)).columns, pa.array(home), pa.array(np.ones(len(leads), bool))], RANGED)

    dealt = rows.select("doc_id", "text", "id", "h").mapInArrow(ranged, "doc_id long, text string, id long, h long, place int, next boolean")
    dealt = dealt.repartition(parts, "place").sortWithinPartitions("place", "next", F.desc("id"), F.desc("h"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for doc_id, text, place, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "place", "next"))):
                own = sketch(text.encode(), k) if not following or held else None
                if held and held[2] == place:
                    out.append(compared(held, text, own, k))
                held = None if following else (doc_id, text, place, own)
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return dealt.select("doc_id", "text", "place", "next").mapInArrow(compare, RESULT)


RANGED = ["doc_id", "text", "id", "h", "place", "next"]


def sort_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(id, hash) as 16 bytes each that sort alike."""
    both = np.stack((ids, hashes), axis=1).astype(np.int64).view(U64) ^ U64(1 << 63)
    return both.astype(">u8").view("S16").reshape(-1)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64())])


def compared(held: tuple, following: str, next_sketch: np.ndarray, k: int) -> dict:
    doc_id, text, _, own = held
    changed = edit(text, following).encode()
    other = sketch(changed, k)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(), "fingerprint": written(own), "edited_fingerprint": written(other),
        "near_edited": resemblance(own, other, k), "near_next": resemblance(own, next_sketch, k), "n_shingles": distinct(own, k),
    }

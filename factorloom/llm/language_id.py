"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Features are hashed n-grams of 2 and 3 characters (code points of the lower-cased text, a space at either end), their
term frequency is the share of the text's n-grams, and the inverse document frequency is counted over all training
documents. Weights come from follow-the-regularised-leader with L1 and L2 penalties; a temperature fitted on held-back
sample rows calibrates the probabilities. Every label is learned. Only the classifier's fit is bounded: SAMPLE rows a
language, in expectation, chosen by a hash of doc_id and text, or fewer of more languages than ROWS / SAMPLE, LEAST at
least. The weights take a column a language, so that of many languages n-grams hash to fewer slots, TABLE weights in all
where that leaves 2^LEAST_BITS. Document frequencies cover every training document.

Defined cases: a text that is null or has no letter is 'und' with score 0. Rows without lang are never learned from.
With no labelled row, every text is 'und'. Repeated rows are predicted each for itself; columns other than doc_id,
text and lang are not read. Texts of any length are read whole, in stretches of STRETCH characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import blobs, by_bytes, small_batches, trim

BITS, LEAST_BITS, TABLE = 16, 10, 12_000_000
SAMPLE, ROWS, LEAST = 600, 24_000, 8
STRETCH = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def stretches_of_codes(text: bytes, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-gram features of a text, slots of pairs of characters and then of triples, by stretches of the text."""
    said = text.decode(errors="replace").lower()
    if not said:
        return
    said = f" {said} "
    shift = np.uint32(32 - bits)
    for at in range(0, len(said) - 1, STRETCH):
        c = np.frombuffer(said[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        triples = (pairs[:-1] * np.uint32(0x85EBCA6B) + c[2:]) * np.uint32(0xC2B2AE35)
        yield np.concatenate(((pairs[:STRETCH] * np.uint32(0x85EBCA6B)) >> shift, (triples >> shift) + np.uint32(1 << bits)))


def codes_of(text: bytes, bits: int = BITS) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint32), *stretches_of_codes(text, bits)])


def bits_for(languages: int) -> int:
    """How wide n-grams are hashed, for a table of TABLE weights at most."""
    bits = BITS
    while bits > LEAST_BITS and (2 << bits) * languages > TABLE:
        bits -= 1
    return bits


@dataclass
class Model:
    languages: list[str]
    #: A row per feature with any weight, and a last one of zeros: IDF times weight, by language; `row` finds it.
    table: np.ndarray
    row: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int = BITS

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        step = max(1, 4 * STRETCH // max(len(self.languages), 1))
        for some in stretches_of_codes(text, self.bits):
            n += len(some)
            for at in range(0, len(some), step):
                total += self.table.take(self.row[some[at : at + step]], axis=0).sum(axis=0)
        return self.bias + total / max(n, 1)

    def probabilities(self, text: bytes) -> np.ndarray:
        x = self.logits(text) / self.temperature
        x = np.exp(x - x.max())
        return x / x.sum()


def document_frequency(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Documents by feature, and their number, over all rows of docs."""
    dim = 2 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for b in batches:
            for text in blobs(b.column("text")):
                seen = np.zeros(dim, bool)
                for some in stretches_of_codes(text, bits):
                    seen[some] = True
                total[:dim] += seen
                total[dim] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "n"])

    found = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(dim + 1, np.int64)
    out[found.column("feature").to_numpy()] = found.column("n").to_numpy()  # dim + 1 rows at most
    return out[:dim], int(out[dim])


def sample_by_language(docs: DataFrame, counts: dict[str, int], per_language: int, seed: int = 17) -> DataFrame:
    """About per_language rows of each language of counts, chosen by a hash of doc_id and text; all of a rarer language."""
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in counts.items()], "lang string, __rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    some = docs.join(F.broadcast(rates), "lang").filter(draw < F.col("__rate")).drop("__rate")  # a row a language
    return some.dropDuplicates(["doc_id", "text", "lang"])  # equal rows draw alike


def counted(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often it has each."""
    total = np.zeros(2 << bits, np.int64)
    some = list(stretches_of_codes(text, bits)) if len(text) <= STRETCH else None
    if some is not None:
        return np.unique(np.concatenate([np.empty(0, np.uint32), *some]), return_counts=True)
    for x in stretches_of_codes(text, bits):
        total += np.bincount(x, minlength=len(total))
    at = np.flatnonzero(total)
    return at, total[at]


def featurise(docs: DataFrame, bits: int = BITS) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, doc_id, features, term frequencies) of a bounded sample, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats, shares = [], []
            for text in blobs(b.column("text")):
                f, n = counted(text, bits)
                feats.append(f.astype(np.int32).tobytes())
                shares.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
            yield pa.record_batch([b.column("lang"), b.column("doc_id"), pa.array(feats, pa.binary()), pa.array(shares, pa.binary())], ["lang", "doc_id", "f", "tf"])

    rows = docs.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id long, f binary, tf binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return [(lang.as_py(), doc_id.as_py(), np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(tf.as_buffer(), np.float32)) for lang, doc_id, f, tf in zip(*(rows.column(c) for c in ("lang", "doc_id", "f", "tf")))]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, gain: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3, seed: int = 5) -> np.ndarray:
    """FTRL-proximal weights of a softmax over sparse rows (features, values, class), elastic-net penalties.

    Values are multiplied by their feature's gain. The last row of the result is the bias.
    """
    dim = len(gain) + 1
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    order = np.random.default_rng(seed)

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, x, y = rows[k]
            f, x = np.append(f, dim - 1), np.append(x * gain[f], 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[f] + g * g
            z[f] += g - (np.sqrt(grown) - np.sqrt(n[f])) / alpha * w
            n[f] = grown
    return weights(np.arange(dim))


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on held-back rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]))

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    return float(min(grid, key=loss))


def train(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang) with lang not null; document frequencies over all of them."""
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}  # a row a language
    languages = sorted(counts)
    bits = bits_for(len(languages))
    dim = 2 << bits
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(dim, np.int32), np.zeros(0), 1.0)
    df, n = document_frequency(labelled, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = featurise(sample_by_language(labelled, counts, min(per_language, max(LEAST, ROWS // len(languages)))), bits)
    index = {x: k for k, x in enumerate(languages)}
    gain = 10.0 * idf  # of the share vector, so that FTRL's steps suit it
    held_back = [(doc_id or 0) % 5 == 0 for _, doc_id, _, _ in rows]
    ready = [(f, tf, index[lang]) for lang, _, f, tf in rows]
    fit = [r for r, held in zip(ready, held_back) if not held] or ready
    w = ftrl(fit, len(languages), gain)
    held = [r for r, back in zip(ready, held_back) if back]
    logits = np.array([(tf * gain[f]) @ w[f] + w[dim] for f, tf, _ in held]).reshape(len(held), len(languages))
    used = np.flatnonzero(w[:dim].any(axis=1))
    place = np.full(dim, len(used), np.int32)
    place[used] = np.arange(len(used))
    table = np.concatenate((w[used] * gain[used, None], np.zeros((1, len(languages))))).astype(np.float32)
    model = Model(languages, table, place, w[dim], temperature_of(logits, np.array([r[2] for r in held], int)), bits)
    del rows, ready, fit, held, w
    trim()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs, whatever their columns, with __language and __language_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TABLE weights at most, less what has none
    names = docs.columns
    rows = docs.withColumn("__language_text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__language", T.StringType()), T.StructField("__language_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for b in by_bytes(batch, "__language_text"):
                said, scores = [], []
                for text in blobs(b.column("__language_text")):
                    if not m.languages or not has_letter(text.decode(errors="replace")):
                        said.append("und")
                        scores.append(0.0)
                        continue
                    p = m.probabilities(text)
                    k = int(p.argmax())
                    said.append(m.languages[k])
                    scores.append(float(p[k]))
                yield pa.record_batch([b.column(n) for n in names] + [pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*names, "__language", "__language_score"])

    return rows.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(4, 2).alias("held_out"))
    model = train(rows.filter(~F.coalesce("held_out", F.lit(False))))
    found = predict(rows.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", F.col("__language").alias("lang_pred"), F.col("__language_score").alias("score"))

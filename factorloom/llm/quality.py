"""Quality classifier: a sparse rule ensemble over document statistics.

Statistics of every whole text are counted in one pass. A bounded sample of labelled rows (SAMPLE, in expectation,
chosen by a hash of doc_id) grows gradient-boosted trees on random row and column subsets; every tree path is a
conjunctive rule. Lasso logistic regression keeps few rules, and those are compiled into one Spark column expression
over the statistics.

Defined cases: null text counts as empty and is scored like any text. Documents without a label are scored, not
learned from; a label whose document is absent is unused; label rows that repeat count once, and of documents that
share a labelled doc_id one teaches. With labels of one kind, or none, every score is that label's smoothed share. Only doc_id, text and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import LOWER, blobs, by_bytes, small_batches
from factorloom.llm.language_id import held_out

SAMPLE, TREES, DEPTH, SEED = 6000, 80, 3, 11
STATISTICS = ["n_bytes", "n_words", "word_len", "upper", "digit", "punct", "symbol", "space", "beyond_ascii", "distinct", "top_word", "same_next", "lines", "line_words", "line_copies", "short_words", "long_words", "caps_words", "ends_marked", "pipes", "word_entropy", "top_bigram"]
DIGIT, UPPER, PUNCT, SYMBOL = (np.array([chr(c) in s for c in range(256)]) for s in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~"))


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one text; all are 0 or more."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    words = text.translate(LOWER).split()
    m = max(len(words), 1)
    ids = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    freq = np.bincount(at, minlength=1)
    share = freq[freq > 0] / m
    pairs = np.unique(at[:-1] * (len(ids) + 1) + at[1:], return_counts=True)[1] if len(at) > 1 else np.zeros(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        float(len(text)), float(len(words)), float(sizes.mean()) if len(sizes) else 0.0,
        counts[UPPER].sum() / n, counts[DIGIT].sum() / n, counts[PUNCT].sum() / n, counts[SYMBOL].sum() / n,
        (counts[32] + counts[9:14].sum()) / n, counts[128:].sum() / n,
        len(ids) / m, float(freq.max()) / m, float((at[1:] == at[:-1]).sum()) / m,
        float(len(lines)), m / k, 1 - len(set(lines)) / k,
        float((sizes <= 2).sum()) / m, float((sizes > 12).sum()) / m, sum(map(bytes.isupper, text.split())) / m,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / k, counts[ord("|")] / n,
        float(-(share * np.log(share)).sum()) / max(np.log(m), 1.0), float(pairs.max()) / m,
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` (simple types) of every row and its STATISTICS."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{s} double" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in by_bytes(batch, "text"):
                x = np.array([statistics(t) for t in blobs(b.column("text"))], np.float64).reshape(-1, len(STATISTICS))
                yield pa.record_batch([b.column(f.name) for f in fields] + [pa.array(x[:, k]) for k in range(x.shape[1])], [f.name for f in fields] + STATISTICS)

    return docs.select(*[f.name for f in fields], "text").mapInArrow(run, ddl)


#: A rule: (statistic, above?, threshold) terms that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def grow(x: np.ndarray, gradient: np.ndarray, columns: np.ndarray, depth: int, least: int, path: Rule = ()) -> list[tuple[Rule, float]]:
    """Leaves (path, mean gradient) of a least-squares tree; splits at quantiles."""
    best = (1e-9, None)
    if depth and len(x) >= 2 * least:
        total, n = gradient.sum(), len(x)
        for k in columns:
            order = np.argsort(x[:, k], kind="stable")
            v, g = x[order, k], np.cumsum(gradient[order])
            cut = np.unique(np.linspace(least, n - least, 24).astype(int)) - 1
            cut = cut[v[cut] < v[np.minimum(cut + 1, n - 1)]]
            if len(cut):
                left = cut + 1
                gain = g[cut] ** 2 / left + (total - g[cut]) ** 2 / (n - left) - total**2 / n
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (int(k), float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    if best[1] is None:
        return [(path, float(gradient.mean()))]
    k, t = best[1]
    right = x[:, k] > t
    return grow(x[~right], gradient[~right], columns, depth - 1, least, (*path, (k, False, t))) + grow(x[right], gradient[right], columns, depth - 1, least, (*path, (k, True, t)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """The distinct paths, partial ones too, of boosted trees fitted to the logistic loss."""
    rng = np.random.default_rng(seed)
    score, found = np.zeros(len(x)), {}
    for _ in range(trees):
        rows = rng.random(len(x)) < 0.6
        columns = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        if rows.sum() < 20:
            rows[:] = True
        for path, value in grow(x[rows], residual[rows], columns, depth, max(5, len(x) // 100)):
            score += 0.4 * value * 4 * applies(path, x)
            for k in range(1, len(path) + 1):
                found.setdefault(tuple(sorted(path[:k])), None)
    return list(found)


def lasso_logistic(features: np.ndarray, y: np.ndarray, l1: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of L1-penalised logistic regression by accelerated proximal gradient."""
    n, d = features.shape
    design = np.hstack([np.ones((n, 1)), features])
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    # largest eigenvalue of the Gram matrix by power iteration bounds the curvature
    u = np.ones(d + 1)
    for _ in range(20):
        u = design.T @ (design @ u) / n
        u /= np.linalg.norm(u)
    rate = 4 / max(float(u @ (design.T @ (design @ u)) / n), 1e-9)
    for _ in range(steps):
        gradient = design.T @ (1 / (1 + np.exp(-(design @ v))) - y) / n
        new = v - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass
class Rules:
    intercept: float
    weighted: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as one Spark expression over the STATISTICS columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            held = F.lit(True)
            for k, above, t in rule:
                held = held & ((F.col(STATISTICS[k]) > t) if above else (F.col(STATISTICS[k]) <= t))
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Rules(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    features = np.column_stack([applies(r, x) for r in rules]).astype(np.float64)
    intercept, weights = lasso_logistic(features, y)
    return Rules(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on about `sample` labelled documents (doc_id, text; doc_id, quality), twice as many at most.

    Label rows that repeat count once. Of documents that share a labelled doc_id one teaches, chosen by a hash of its
    text, so that an id of very many rows sends one text a task.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().distinct()
    rate = min(1.0, sample / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    few = known.filter(draw < rate).orderBy(draw, "doc_id", "quality").limit(2 * sample)
    met = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))  # 2 * sample rows at most
    rows = with_statistics(met.select("doc_id", "quality", "m.text"), ["doc_id", "quality"])
    found = sorted(tuple(r) for r in rows.drop("doc_id").collect())
    data = np.array(found, np.float64).reshape(-1, len(STATISTICS) + 1)
    return fit(data[:, 1:], (data[:, 0] > 0.5).astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels of those not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(3, 1).alias("held_out"))
    model = train(rows.filter(~F.coalesce("held_out", F.lit(False))).drop("held_out"), labels.filter(~F.coalesce(held_out(3, 1), F.lit(False))))
    scored = with_statistics(rows, ["doc_id", "held_out"]).select("doc_id", "held_out", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Pluggable encoders and scorers; the defaults are deterministic and need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import text as T

#: An encoder turns texts into an array of shape (texts, size); a scorer turns a prompt of numbered items into lines.
Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[str], str]

# Words that the lexicon scorer counts.
POSITIVE = ["strong", "growth", "improve", "confident", "record", "exceed", "raise"]
NEGATIVE = ["weak", "decline", "uncertain", "headwind", "lower", "miss", "risk"]


def encoded(chunks: DataFrame, encoder: Callable[[], Encoder], batch: int = 16) -> DataFrame:
    """chunks with embedding, unit length. `encoder` is called once in each task to load a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            texts = b["text"].fillna("").tolist()
            rows = [encode(texts[k : k + batch]) for k in range(0, len(texts), batch)]
            v = np.concatenate(rows) if rows else np.empty((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield b.assign(embedding=list(v.astype(np.float32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, fields + ", embedding array<float>")


def cls_pooled(tokens: Column) -> Column:
    """The first of an array of token vectors: how retrieval's encoder sums up a text."""
    return F.get(tokens, F.lit(0))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1: how memory's encoder does; zeros if there is none."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1))), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)


def hashed_encoder(size: int = 64) -> Callable[[], Encoder]:
    """An encoder of hashed word counts."""
    import zlib

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[k, h % size] += 1 if h & 1 << 31 else -1
            return out

        return encode

    return load


def lexicon_score(text: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """Difference of positive and negative word counts, clipped; null for an empty text."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit(r"\b(" + "|".join(words) + ")"))
    return F.when(~T.is_blank(text), F.least(F.greatest((count(POSITIVE) - count(NEGATIVE)).cast("double"), F.lit(low)), F.lit(high)))


def lexicon_scored(prompts: DataFrame) -> DataFrame:
    """prompts (episode, prompt) with value."""
    return prompts.withColumn("value", lexicon_score(F.col("prompt")))


def scored_by(prompts: DataFrame, scorer: Callable[[], Scorer], instruction: str, low: float = -2.0, high: float = 2.0, size: int = 50, tries: int = 3) -> DataFrame:
    """episode, value by a model: batches of numbered items to a scorer, its 'index: score' lines parsed back.

    A batch that fails `tries` times, with growing waits, gives nulls; so do items without a line or text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask = scorer()
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                items = [(k, p) for k, p in enumerate(part["prompt"], 1) if p]
                reply = ""
                for attempt in range(tries if items else 0):
                    try:
                        reply = ask(instruction + "\n\n" + "\n\n".join(f"{k}:\n{p}" for k, p in items))
                        break
                    except Exception:  # a model's failure costs this batch only
                        time.sleep(2**attempt)
                yield pd.DataFrame({"episode": part["episode"], "index": range(1, len(part) + 1), "reply": reply})

    replies = prompts.select("episode", "prompt").mapInPandas(run, "episode long, index int, reply string")
    return replies.select("episode", F.try_element_at(T.score_lines(F.col("reply"), low, high), F.col("index")).alias("value"))

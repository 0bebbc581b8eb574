"""A training-corpus pipeline: language ID, near-duplicate join, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
stage's docs. All but the last return the columns of documents, for the rows they keep.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontamination, jaccard_join, language_id, packing, secrets
from factorloom.llm.common import OWN, STORED, drop_stored, numbered, small_batches, stored

#: A text whose language is less sure than LEAST_SURE, or, of many languages, than CHANCE divided by their number, is
#: rejected: it is hardly surer than chance.
LEAST_SURE, CHANCE = 0.3, 1.2
#: Most ids that are broadcast, some 16 MB.
BROADCAST = 1_000_000
#: Words whose ids a packing task remembers, some 25 MB; no worker keeps them, as the other stages need its memory.
REMEMBERED = 100_000
MASK = "[secret]"


class Left(threading.local):
    """By folder, the tables that the last stage of this thread's run over it wrote for itself."""

    def __init__(self):
        self.paths: dict[str, list[str]] = {}


LEFT = Left()


def stage(f):
    """A stage that first drops the tables that the stage before it wrote for itself: its result stands by now, as a
    stage's docs are the Parquet that it was written to. Tables that docs still read stay. Runs in other threads, and
    runs over other folders, keep theirs."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        drop_stored(spark, [x for x in LEFT.paths.pop(sf_dir, []) if x in STORED and not any(x.rsplit("/", 1)[-1] in file for file in read)])
        before = len(OWN.paths)
        out = f(spark, docs, sf_dir)
        LEFT.paths[sf_dir] = [x for x in OWN.paths[before:] if x in STORED]
        return out

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; lang becomes the predicted one. Learns from the rows' own lang.

    Rows with null text, without a letter, or of a language less sure than LEAST_SURE go, as do all rows of a table
    without any lang. Rows that repeat, or share doc_id, are judged each for itself."""
    small_batches(spark)
    rows = docs.withColumn("held_out", language_id.held_out(4, 2))
    model = language_id.train(rows.filter(~F.coalesce("held_out", F.lit(False))).select("doc_id", "text", "lang"))
    said = language_id.predict(docs, model)
    sure = (F.col("__language") != "und") & (F.col("__language_score") >= min(LEAST_SURE, CHANCE / max(len(model.languages), 1)))
    return said.filter(sure).withColumn("lang", F.col("__language")).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that similarity links connect, the one with the smallest doc_id stays.

    Rows with null doc_id come after those with one; of equal ids any one row stays. A row of another text stays, whoever
    shares its doc_id. Rows without words are linked with nothing and stay."""
    return jaccard_join.first_of_each(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; null and empty texts hold none. doc_id isn't looked at."""
    rows = numbered(docs)
    texts = rows.select("row_id", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    found = decontamination.contaminated_rows(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(found.filter("contaminated").select("row_id"), "contaminated")
    side = F.broadcast(gone) if gone.count() <= BROADCAST else gone  # shuffled beyond that
    return rows.join(side, "row_id", "left_anti").select("doc.*")


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each reported secret span replaced by MASK and n_chars counted anew; null texts stay null."""
    return secrets.masked(docs, MASK)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences; a null or empty text is its end token."""
    return packing.pack_documents(docs, remembered=REMEMBERED, keep=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("pack", pack),
]

#: SQL can't express the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs.inputFiles(), stored(step(spark, docs, sf_dir), name)
        drop_stored(spark, [x for x in OWN.paths if x in STORED and any(x.rsplit("/", 1)[-1] in file for file in before)])
    return STAGES[-1][1](spark, docs, sf_dir)

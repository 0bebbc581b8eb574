"""Keyword search over a growing memory by postings of 3-grams.

A record's text is its definition, name and failures in lower case. A posting is (gram, line_no) for each distinct
3-gram of a text, which ends in two filler characters, so that every place of a text starts a gram. A query is split
into distinct words; a word that is a substring of a text has all its grams there. So a word reads the postings of its
rarest gram alone, and the texts of those records decide. A word of one or two characters reads the grams that begin
with it. The answer is that of retrieval.keyword_search, for any number of queries at once.

Records that hold the same of all queries' words have one score for every query, and of them only the k first can be
among a query's best k. So scores are counted by such a signature, not by record: queries times signatures, where a
memory that grows by like records has no more of them.

Postings lie in SLOTS folders by a hash of the gram, sorted by gram within a file: a search lists only the slots of its
grams (where they are at most LITERALS), and Parquet's statistics skip row groups in them. Ranges are cut by gram and
record, so that a gram that a third of all records hold is spread over tasks. Records are added by appending; nothing is
rewritten.

Defined cases: line_no is a record's key (readers.history makes it unique); nulls count as empty texts and have no
hits; a query that is null or blank has no rows; equal queries are answered each by its own id; a record in two parts
of an index is found once; equal scores go by line_no.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.sources.scratch import stored

SLOTS = 64
#: Up to so many grams of a search prune the scan as literals; more grams lie in nearly all slots anyway.
LITERALS = 1000
#: Most rows of queries' words that are broadcast, so that signatures with a frequent word stay spread over tasks.
BROADCAST = 200_000
#: Most pairs of a query and a signature that a task may count.
PAIRS = 1_000_000
FILLER = "\0\0"
GRAM = r"(?s)(?=(...))"


def record_text() -> Column:
    return F.lower(F.concat_ws(" ", "definition", "feature_name", F.array_join("failures", " ")))


def grams(text: Column) -> Column:
    """The distinct 3-grams of a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(GRAM), F.lit(1)))


def slot_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


@dataclass
class GramIndex:
    """Folders under path: postings (slot, gram, line_no), counts (gram, n) and texts (line_no, text)."""

    spark: SparkSession
    path: str

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, line_no long, slot int").parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        """gram, n: postings of each gram over all parts."""
        return self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts").groupBy("gram").agg(F.sum("n").alias("n"))

    def texts(self) -> DataFrame:
        return self.spark.read.schema("line_no long, text string").parquet(f"{self.path}/texts")

    def add(self, records: DataFrame) -> GramIndex:
        """Append records (line_no, definition, feature_name, failures), which the index must not hold yet."""
        texts = records.select(F.col("line_no").cast("long").alias("line_no"), record_text().alias("text"))
        texts.write.mode("append").parquet(f"{self.path}/texts")
        found = texts.select(F.explode(grams(F.concat("text", F.lit(FILLER)))).alias("gram"), "line_no").withColumn("slot", slot_of(F.col("gram")))
        order = ["slot", "gram", "line_no"]
        found.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("slot").parquet(f"{self.path}/postings")
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.path}/counts")
        return self


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, word: the distinct lower-case words of queries (query_id, query)."""
    words = F.array_distinct(F.split(F.lower("query"), r"(?U)\s+"))
    return queries.select("query_id", F.explode(words).alias("word")).filter("word != ''").distinct()


def lookups(index: GramIndex, words: DataFrame) -> DataFrame:
    """word, gram, n: the postings lists that words are looked up in, and their lengths.

    A word's rarest gram, ties by gram; for a word shorter than a gram, all grams that begin with it. A word with a gram
    that no record has is left out: nothing holds it.
    """
    counts = index.counts()
    words = words.select("word").distinct()
    asked = words.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    known = asked.join(counts, "gram", "left")
    rarest = known.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n"), F.count(F.when(F.col("n").isNull(), 1)).alias("absent"))
    long = rarest.filter("absent = 0").select("word", "gram", "n")
    short = words.filter(F.length("word") < 3)
    begins = [short.filter(F.length("word") == k).join(counts.withColumn("word", F.substring("gram", 1, k)), "word").select("word", "gram", "n") for k in (1, 2)]
    return long.unionByName(begins[0]).unionByName(begins[1])


def hits(index: GramIndex, words: DataFrame) -> DataFrame:
    """word, line_no: every record that holds a word, once."""
    found = lookups(index, words).select("word", "gram").withColumn("slot", slot_of(F.col("gram")))
    asked, read = found.select("slot", "gram").distinct().limit(LITERALS + 1).collect(), index.postings()
    if len(asked) <= LITERALS:
        read = read.filter(F.col("slot").isin(sorted({r.slot for r in asked})) & F.col("gram").isin([r.gram for r in asked]))
    near = read.join(found, ["slot", "gram"]).select("line_no", "word")
    held = near.join(index.texts(), "line_no").filter(F.contains("text", "word"))
    return held.select("word", "line_no").distinct()


def signatures(held: DataFrame, k: int) -> DataFrame:
    """signature, words, members: records of hits by the set of words that they hold; of each set the k first line_no in
    order, the first of which names it."""
    sets = held.groupBy("line_no").agg(F.array_sort(F.collect_set("word")).alias("words"))
    first = sets.withColumn("place", F.row_number().over(Window.partitionBy("words").orderBy("line_no"))).filter(F.col("place") <= k)
    return first.groupBy("words").agg(F.array_sort(F.collect_list("line_no")).alias("members")).select(F.get("members", F.lit(0)).alias("signature"), "words", "members")


def search(index: GramIndex, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, rank (from 1), line_no, score: each query's k records that hold most of its distinct words."""
    words = stored(query_words(queries), "query_words")
    sets = stored(signatures(hits(index, words), k), "signatures")
    asked = F.broadcast(words) if words.count() <= BROADCAST else words
    # a signature's words stay in one task, so that its counts are whole there
    pairs = sets.count() * words.select("query_id").distinct().count()
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    scores = sets.repartition(parts, "signature").select("signature", F.explode("words").alias("word")).join(asked, "word").groupBy("query_id", "signature").agg(F.count(F.lit(1)).alias("score"))
    # a signature's first record comes before its others, so that the k best records are in the k best signatures
    near = scores.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "signature"))).filter(F.col("place") <= k).drop("place")
    found = near.join(sets.select("signature", F.explode("members").alias("line_no")), "signature")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "line_no")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "line_no", "score")


def postings_read(index: GramIndex, queries: DataFrame) -> DataFrame:
    """word, lists, postings: how many lists and postings each word of the queries reads."""
    return lookups(index, query_words(queries)).groupBy("word").agg(F.count(F.lit(1)).alias("lists"), F.sum("n").alias("postings"))

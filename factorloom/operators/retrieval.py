"""Exact vector retrieval, keyword retrieval, batches and quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import vector_index
from factorloom.operators.ordering import with_position
from factorloom.sources.scratch import stored

#: Hits that are broadcast; queries that need no index.
HITS, FEW = 200_000, 8


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, floor: float = 0.0) -> Column:
    """v scaled to unit length; floor is added to the length, as for memory vectors."""
    norm = F.sqrt(inner_product(v, v)) + floor
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def scored(chunks: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """chunks with score, their inner product with a query given as a literal; no join, so the scan stays whole."""
    return chunks.withColumn("score", inner_product(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def top_k(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """The k best rows, ties by key: each task keeps k rows, so nothing else moves."""
    return scored(chunks, query).orderBy(F.desc("score"), key).limit(k)


def in_scope(chunks: DataFrame, sections: list[str] | None = None, roles: list[str] | None = None, sector: str | None = None) -> DataFrame:
    for c, allowed in (("section_type", sections), ("speaker_role", roles)):
        if allowed:
            chunks = chunks.filter(F.col(c).isin(allowed))
    return chunks.filter(F.col("sector") == sector) if sector else chunks


def scoped_top_k(chunks: DataFrame, query: list[float], k: int, total: int, sections: list[str] | None = None, roles: list[str] | None = None, sector: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Over-fetch 3 k rows (5 k with a sector), at most total, filter by scope, keep k: fewer if few are in scope.

    The filter must stay above the limit. For all rows in scope, filter first and call top_k.
    """
    fetched = top_k(chunks, query, min(k * (5 if sector else 3), total), key)
    return in_scope(fetched, sections, roles, sector).orderBy(F.desc("score"), key).limit(k)


def multi_query_top_k(chunks: DataFrame, queries: DataFrame, per_query: int, total: int, by: list[str], key: str = "chunk_id", index: vector_index.Index | None = None) -> DataFrame:
    """The best `total` rows over several queries' best `per_query`, one row for each value of `by`: its best score.

    queries (query_id, vector) is a stated set, searched in an index of the chunks' vectors. Without one, up to FEW
    queries scan the chunks themselves, and more have an index built. Both ways give the same scores. The hits are joined
    to their chunks, broadcast if they are few.
    """
    if index is None and len(few := queries.limit(FEW + 1).collect()) <= FEW:
        kind = queries.schema["query_id"].dataType
        hits = reduce(DataFrame.unionByName, [top_k(chunks, q.vector, per_query, key).select(F.lit(q.query_id).cast(kind).alias("query_id"), F.col(key).alias("key"), "score") for q in few] or [chunks.limit(0).select(F.lit(None).cast(kind).alias("query_id"), F.col(key).alias("key"), F.lit(0.0).alias("score"))])
    else:
        hits = vector_index.search(index or vector_index.build(chunks, key), queries, per_query)
    hits = stored(hits.select("query_id", F.col("key").alias(key), "score"), "hits")
    side = F.broadcast(hits) if hits.count() <= HITS else hits  # shuffled beyond that
    best = chunks.join(side, key)
    one = best.withColumn("again", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "query_id", key))).filter("again = 1")
    return one.orderBy(F.desc("score"), key).limit(total).drop("again")


def head_by_episode(rows: DataFrame, k: int = 5, by: str = "episode", key: str = "chunk_id") -> DataFrame:
    """The first k chunks of each episode by score."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def prompt_text(rows: DataFrame, by: str = "episode", most: int = 300) -> DataFrame:
    """by, prompt: each episode's chunks in rank order as [section/role] text, texts cut at `most` characters."""
    line = F.concat(F.lit("["), "section_type", F.lit("/"), "speaker_role", F.lit("] "), F.substring("text", 1, most))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def in_batches(episodes: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """episodes with batch, consecutive groups of `size` in order."""
    return with_position(episodes, order, "__at").withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")


def year_quotas(episodes: DataFrame, sample: int) -> DataFrame:
    """year, n, quota: proportional shares of a sample, one at least."""
    counts = episodes.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    total = episodes.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("year", "n", F.greatest(F.lit(1), F.bround(sample * F.col("n") / F.col("total"), 0).cast("int")).alias("quota"))


def stratified_sample(episodes: DataFrame, sample: int, key: str = "episode", seed: int = 42) -> DataFrame:
    """About `sample` rows, each year's quota, chosen by a seeded hash of the key.

    A hash threshold with slack cuts each year down before any window ranks what is left.
    """
    quotas = year_quotas(episodes, sample)
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    slack = (F.col("quota") + 6 * F.sqrt("quota") + 10) / F.col("n")
    few = episodes.join(F.broadcast(quotas), "year").withColumn("__draw", draw).filter(F.col("__draw") < slack)
    ranked = few.withColumn("__rank", F.row_number().over(Window.partitionBy("year").orderBy("__draw", key)))
    return ranked.filter("__rank <= quota").drop("__draw", "__rank", "n", "quota")


def keyword_search(records: DataFrame, query: str, k: int = 3, order: str = "line_no") -> DataFrame:
    """The k records that hold most of the query's distinct words as substrings of definition, name and failures."""
    words = sorted(set(query.lower().split()))
    text = F.lower(F.concat_ws(" ", "definition", "feature_name", F.array_join("failures", " ")))
    score = F.size(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(text, w)))
    return records.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), order).limit(k)


def memory_top_k(records: DataFrame, query: list[float], k: int, floor: float = 0.3, key: str = "episode_id") -> DataFrame:
    """The k records nearest by cosine, those above the floor."""
    return top_k(records, query, k, key).filter(F.col("score") > floor)

"""The driver's tables in the roles that the library's operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.operators.panel import with_periods

TRAIN, VALID, TEST = [1995, 1996, 1997], [1998], [1999, 2000, 2001]
NAMES = ["discount", "quantity", "score"]
WEIGHTS = {"discount": 0.16, "quantity": 0.07, "score": 0.11}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes, customers' segments as sectors."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return with_periods(rows.select(F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"), F.col("o_orderdate").alias("earnings_date"), F.col("o_totalprice").alias("move")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, episode, value of three features of an order's lines; sums are of whole numbers, so exact."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    mean = F.col("d") / F.col("n")
    values = {"discount": mean, "quantity": F.col("q") / F.col("n"), "score": F.least(F.greatest(F.floor(mean) - 5, F.lit(-2)), F.lit(2)).cast("double")}
    entries = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])
    return lines.select("episode", F.explode(entries).alias("e")).select("e.feature", "episode", "e.value")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows, one per supplier, whose metrics vary enough to meet every gate and failure mode."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.concat(F.lit("s"), (F.col("l_linenumber") % 5).cast("string")).alias("sector"), F.year("l_shipdate").cast("string").alias("year"),
        (F.pmod(F.col("l_partkey") * 7, F.lit(10)) < F.col("l_suppkey") % 10).cast("int").alias("zero"), (F.pmod("l_partkey", F.lit(7)) - 3).alias("x"),
        F.concat((F.pmod("l_partkey", F.lit(5)) - 2).cast("string"), F.lit(".0")).alias("score"),
    )
    as_map = lambda by, value, name: li.groupBy("k", by).agg(value.alias("v")).groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).alias("key"), F.col("v").alias("value"))))).alias(name))
    base = li.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.sum("zero") / F.count(F.lit(1))).alias("zero_ratio"), (F.sum("x") / F.count(F.lit(1))).alias("m"))
    shares = li.groupBy("k", "score").agg(F.count(F.lit(1)).alias("c")).join(base.select("k", "n"), "k").groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("score").alias("key"), (F.col("c") / F.col("n")).alias("value"))))).alias("score_dist"))
    mean = lambda c: F.sum(c) / F.count(F.lit(1))
    out = base.join(as_map("sector", mean("zero"), "zero_by_sector"), "k").join(as_map("sector", mean("x"), "per_sector_ic"), "k").join(as_map("year", mean("zero"), "zero_by_year"), "k").join(shares, "k")
    return out.select(
        F.concat(F.lit("f"), F.col("k").cast("string"), F.when(F.col("k") % 9 == 4, "_v2").otherwise("")).alias("feature"), F.col("k"), (F.col("k") % 13 == 0).alias("coverage_failure"),
        F.when(F.col("k") % 13 == 0, F.lit(0.01)).otherwise(F.lit(0.5)).alias("coverage"), "zero_ratio", F.col("m").alias("ic_mean"), (F.col("m") * (F.col("k") % 50)).alias("t_stat"),
        ((F.col("k") % 11) / F.lit(10.0)).alias("direction_consistency"), "zero_by_sector", "per_sector_ic", "zero_by_year", "score_dist",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks, with sections, roles and sectors by label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("label") % 2 == 0, "qa").otherwise("prepared").alias("section_type"), F.when(F.col("label") % 3 == 0, "analyst").otherwise("mgmt").alias("speaker_role"),
        F.concat(F.lit("s"), (F.col("label") % 5).cast("string")).alias("sector"), F.floor(F.col("vec_id") / 7).cast("long").alias("episode"), F.floor(F.col("vec_id") / 3).cast("long").alias("page_num"),
    )


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, as a query."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first().embedding


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace steps, users as runs."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), kind.alias("state"), (F.col("event_id") % 5).cast("int").alias("iteration"), F.when(kind != "view", kind).alias("tool_called"),
        F.col("value").alias("tool_latency_ms"), (kind != "error").alias("tool_ok"), F.when(kind == "error", "it failed").alias("tool_error"), k.alias("context_tokens"),
        F.concat(F.get(F.array(*[F.lit(x) for x in ("Gate G1_coverage", "saw G2_zero_ratio", "saw G3_t_stat", "Gate G4_direction IC=0.0123 t=-1.50 zero_ratio=45.5%")]), k % 4)).alias("observation"),
        F.when(kind == "error", "FAIL").when(kind == "signup", "RETRY").otherwise("CONTINUE").alias("decision"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as history records: base features and their repaired versions."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("feat_"), F.floor(k / 2).cast("string"))
    failures = F.array_compact(F.array(F.when(k % 3 == 0, F.concat(F.lit("G2_zero_ratio: "), "p_brand")), F.when(k % 5 == 0, "G3_t_stat: weak"), F.when(k % 7 == 0, "something long without a colon in it")))
    return table(spark, sf_dir, "part").select(
        k.alias("line_no"), F.when(k % 2 == 1, F.concat(name, F.lit("_v2"))).otherwise(name).alias("feature"), F.when(k % 2 == 1, name).alias("repair_of"), F.col("p_name").alias("definition"),
        (F.col("p_size") / 100.0).alias("ic_mean"), (F.col("p_size") / 10.0).alias("t_stat"), ((k % 10) / F.lit(10.0)).alias("zero_ratio"), ((k % 4) / F.lit(4.0)).alias("direction_consistency"),
        (F.size(failures) == 0).alias("passed"), failures.alias("failures"), F.when(F.size(failures) == 0, "PASS").otherwise("FAIL").alias("outcome"), F.col("p_type").alias("cluster"), F.concat(F.lit("fix "), "p_type").alias("diagnosis_fix"),
        F.concat(F.lit("root of "), "p_brand").alias("diagnosis_root_cause"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as versions of features, each the repair of the one before in its hundred; some repair a later one."""
    k = F.col("p_partkey")
    of = F.when(k % 500 == 150, k + 3).when(k % 100 > 0, k - 1)
    name = lambda x: F.concat(F.lit("v"), x.cast("string"))
    return table(spark, sf_dir, "part").select(k.alias("line_no"), name(k).alias("feature"), name(of).alias("repair_of"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as call transcripts, one line a turn."""
    who = F.when(F.col("role") == "user", "Analyst Capital").when(F.col("role") == "assistant", "Chief Officer").otherwise("Operator")
    line = F.concat(who, F.lit(": "), F.regexp_replace("text", "\n", " "))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("symbol")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))
    return rows.withColumn("earnings_date", F.lit("2020-01-01"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paper pages."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("paper_title"), F.col("doc_id").alias("page_num"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", T.section_type(F.col("text")).alias("section_type"), T.speaker_role(F.col("role")).alias("speaker_role"))

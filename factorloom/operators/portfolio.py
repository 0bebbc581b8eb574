"""Long-short portfolios of features: quantile buckets by cross-section, their returns, and the risk of the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.evaluation import LEAST_PAIRS, ic_series
from factorloom.operators.panel import KEYS

SECTIONS = ["feature", *KEYS]
#: Share of a group's rows around a cut that is put in order, five times what the sketch may be off.
NEAR = 0.002


def quantile_cuts(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """by..., cuts: for j = 1 to buckets - 1 the least value that at least j / buckets of a group's values don't exceed.

    A sketch encloses each cut; values below are counted and only those near it, some thousandths of a group, are put
    in order, so that a group of very many rows is never sorted in one task. Groups with a null key are left out.
    """
    held = rows.filter(F.col("value").isNotNull()).dropna(subset=by).select(*by, F.col("value").cast("double").alias("value"))
    around = [x for j in range(1, buckets) for x in (max(j / buckets - NEAR, 0.0), min(j / buckets + NEAR, 1.0))]
    found = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", around, 10_000).alias("c"))
    few = F.col("n") < 2000
    ranges = F.array(*[F.struct(F.lit(j).alias("j"), F.when(few, F.col("least")).otherwise(F.col("c")[2 * j - 2]).alias("low"), F.when(few, F.col("most")).otherwise(F.col("c")[2 * j - 1]).alias("high")) for j in range(1, buckets)])
    near = held.join(F.broadcast(found.select(*by, "n", ranges.alias("ranges"))), by)  # a row a feature and quarter
    below = near.groupBy(*by).agg(*[F.count(F.when(F.col("value") < F.col("ranges")[j - 1]["low"], 1)).alias(f"b{j}") for j in range(1, buckets)])
    sides = F.filter("ranges", lambda r: F.col("value").between(r["low"], r["high"]))
    counts = near.select(*by, "n", "value", F.explode(sides).alias("r")).groupBy(*by, "n", "value", F.col("r.j").alias("j")).agg(F.count(F.lit(1)).alias("m"))
    placed = counts.join(F.broadcast(below), by)
    base = F.element_at(F.array(*[F.col(f"b{j}") for j in range(1, buckets)]), F.col("j"))
    to = base + F.sum("m").over(Window.partitionBy(*by, "j").orderBy("value"))
    least = placed.withColumn("to", to).filter(F.col("to") * buckets >= F.col("n") * F.col("j")).groupBy(*by, "j").agg(F.min("value").alias("cut"))
    return least.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cut"))), lambda x: x["cut"]).alias("cuts"))


def bucketed(rows: DataFrame, buckets: int = 5, by: list[str] = SECTIONS) -> DataFrame:
    """rows with bucket 1 to buckets by value within their group: 1 and the number of cuts below it; equal values share
    one. Rows without a value or with a null key are left out."""
    cuts = quantile_cuts(rows, by, buckets)
    return rows.filter(F.col("value").isNotNull()).join(F.broadcast(cuts), by).withColumn("bucket", 1 + F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")


def long_short(rows: DataFrame, buckets: int = 5) -> DataFrame:
    """feature, year, quarter, spread: mean ret of the highest bucket less that of the lowest; quarters without both, or
    with fewer than five rows of a return, are left out."""
    mean = lambda k: F.avg(F.when(F.col("bucket") == k, F.col("ret")))
    found = bucketed(rows.filter(F.col("ret").isNotNull()), buckets).groupBy(*SECTIONS).agg((mean(buckets) - mean(1)).alias("spread"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("n") >= LEAST_PAIRS) & F.col("spread").isNotNull()).drop("n")


def path(series: DataFrame) -> DataFrame:
    """series with wealth, 1 compounded by spread quarter after quarter, its highest so far, and drawdown, the loss since
    then. A loss of all stays 0. Windows over a feature's quarters, some tens of rows."""
    so_far = Window.partitionBy("feature").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, 0)
    log = F.when(F.col("spread") > -1, F.log1p("spread")).otherwise(F.lit(float("-inf")))
    wealth = series.withColumn("wealth", F.exp(F.sum(log).over(so_far)))
    return wealth.withColumn("peak", F.greatest(F.max("wealth").over(so_far), F.lit(1.0))).withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def risk(rows: DataFrame, buckets: int = 5, per_year: int = 4) -> DataFrame:
    """feature, n_quarters, spread_mean, information_ratio (a year), icir, wealth, max_drawdown (0 or less) of rows
    (feature, year, quarter, value, ret)."""
    series = path(long_short(rows, buckets))
    ratio = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0))
    paid = series.groupBy("feature").agg(F.count(F.lit(1)).alias("n_quarters"), F.avg("spread").alias("spread_mean"), (ratio("spread") * per_year**0.5).alias("information_ratio"), F.max_by("wealth", F.struct(*KEYS)).alias("wealth"), F.min("drawdown").alias("max_drawdown"))
    return paid.join(ic_series(rows, y="ret").groupBy("feature").agg(ratio("ic").alias("icir")), "feature", "left")


def with_drawdown(validated: DataFrame, risks: DataFrame) -> DataFrame:
    """Validation rows with the max_drawdown that gate G5 reads; null for a feature without a portfolio."""
    return validated.join(risks.select("feature", "max_drawdown"), "feature", "left")

"""The event panel and features joined to it.

The panel has a row per episode: episode, symbol, sector, earnings_date, year, quarter, move. Features are kept in long
form (feature, episode, value), so that every statistic runs once for all features, grouped by feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import clip

KEYS = ["year", "quarter"]


def with_periods(events: DataFrame, date: str = "earnings_date") -> DataFrame:
    return events.withColumn("year", F.year(date)).withColumn("quarter", F.quarter(date))


def from_year(panel: DataFrame, first: int) -> DataFrame:
    return panel.filter(F.col("year") >= first)


def of_symbols(panel: DataFrame, symbols: list | None = None, years: list[int] | None = None) -> DataFrame:
    """Rows of the given symbols and calendar years; None keeps all."""
    if symbols is not None:
        panel = panel.filter(F.col("symbol").isin(symbols))
    return panel if years is None else panel.filter(F.year("earnings_date").isin(years))


def with_z(rows: DataFrame, named: dict[str, str], by: list[str] = KEYS) -> DataFrame:
    """rows with, for each column c -> name of `named`, (c - mean) / (sample deviation + 1e-8) within groups.

    Null where c is, where a group has one row, or where a group key is null. Group statistics are aggregated first and
    joined back, so that a group of very many rows never meets in one task.
    """
    stats = rows.groupBy(*by).agg(*[f(c).alias(f"__{k}_{c}") for c in named for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    both = rows.join(stats, by, "left")
    z = [((F.col(c) - F.col(f"__mean_{c}")) / (F.col(f"__sd_{c}") + 1e-8)).alias(name) for c, name in named.items()]
    return both.select(*rows.columns, *z)


def with_demeaned(rows: DataFrame, c: str, name: str, by: list[str] = KEYS, within: str = "sector") -> DataFrame:
    """rows with c less its mean by group and sector; null for a null sector, which has no mean."""
    means = rows.groupBy(*by, within).agg(F.avg(c).alias("__mean"))
    return rows.join(means, [*by, within], "left").select(*rows.columns, (F.col(c) - F.col("__mean")).alias(name))


def with_target(panel: DataFrame) -> DataFrame:
    """target: the cross-sectional z-score of move, over the whole panel."""
    return with_z(panel, {"move": "target"})


def with_neutral(panel: DataFrame, c: str = "move") -> DataFrame:
    return with_demeaned(panel, c, f"{c}_neutral")


def joined(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Panel rows that a feature covers, a row per feature."""
    return panel.join(features, "episode")


def wide(panel: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Panel with a column per feature, null where it is missing: one pivot and one join for any number of features."""
    columns = features.filter(F.col("feature").isin(names)).groupBy("episode").pivot("feature", names).agg(F.first("value", ignorenulls=True))
    return panel.join(columns, "episode", "left")


def winsor_bounds(rows: DataFrame, train_years: list[int], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feature, low, high: exact interpolated quantiles over training years.

    Approximate quantiles on either side enclose each exact one; only the distinct values between them, some thousandths
    of a feature's rows, are put in order, and rows below are counted. A feature of few rows is ordered whole.
    """
    train = rows.filter(F.col("year").isin(train_years) & F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value"))
    near = 0.002
    around = [max(low - near, 0.0), min(low + near, 1.0), max(high - near, 0.0), min(high + near, 1.0)]
    cuts = train.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", around, 10_000).alias("c"))
    few = F.col("n") < 2000
    cuts = cuts.select("feature", "n", *[F.when(few, F.col("least" if k % 2 == 0 else "most")).otherwise(F.col("c")[k]).alias(c) for k, c in enumerate(("l0", "l1", "h0", "h1"))])
    return exact_bounds(train, cuts, low, high)


def exact_bounds(train: DataFrame, cuts: DataFrame, low: float, high: float) -> DataFrame:
    """feature, low, high: exact interpolated quantiles of train (feature, value, no nulls), of which a feature has n.

    cuts (feature, n, l0, l1, h0, h1) enclose them: l0 to l1 the low one, h0 to h1 the high one. Null where they don't.
    """
    near_cuts = train.join(F.broadcast(cuts), "feature")  # a row a feature
    inside = {"low": F.col("value").between(F.col("l0"), F.col("l1")), "high": F.col("value").between(F.col("h0"), F.col("h1"))}
    side = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in inside.items()]))
    below = near_cuts.groupBy("feature").agg(F.count(F.when(F.col("value") < F.col("l0"), 1)).alias("b_low"), F.count(F.when(F.col("value") < F.col("h0"), 1)).alias("b_high"))
    counts = near_cuts.withColumn("side", F.explode(side)).groupBy("feature", "n", "side", "value").agg(F.count(F.lit(1)).alias("m"))
    placed = counts.join(F.broadcast(below), "feature").withColumn("q", F.when(F.col("side") == "low", F.lit(low)).otherwise(F.lit(high)) * (F.col("n") - 1))
    to = F.sum("m").over(Window.partitionBy("feature", "side").orderBy("value")) + F.when(F.col("side") == "low", F.col("b_low")).otherwise(F.col("b_high"))
    placed = placed.withColumn("to", to).withColumn("from", F.col("to") - F.col("m"))
    at = lambda rank, name: F.max(F.when((F.col("from") <= rank) & (rank < F.col("to")), F.col("value"))).alias(name)
    found = placed.groupBy("feature", "side").agg(F.max("q").alias("q"), at(F.floor("q"), "x"), at(F.ceil("q"), "y"))
    share = F.col("q") - F.floor("q")
    value = F.when(share == 0, F.col("x")).otherwise(F.col("x") * (1 - share) + F.col("y") * share)
    return found.groupBy("feature").agg(*[F.max(F.when(F.col("side") == k, value)).alias(k) for k in ("low", "high")])


def winsorized(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows with value clipped to its feature's bounds (one row a feature, so broadcast)."""
    return rows.join(F.broadcast(bounds), "feature", "left").withColumn("value", F.when(F.col("low").isNull(), F.col("value")).otherwise(clip(F.col("value"), F.col("low"), F.col("high")))).drop("low", "high")


def sector_codes(panel: DataFrame) -> DataFrame:
    """sector, code: codes count up from 0 in sorted order. A window over the distinct sectors only."""
    found = panel.select("sector").filter("sector is not null").distinct()
    return found.withColumn("code", F.dense_rank().over(Window.orderBy("sector")) - 1)


def with_sector_code(panel: DataFrame) -> DataFrame:
    """panel with sector_code, -1 for a null sector."""
    return panel.join(F.broadcast(sector_codes(panel)), "sector", "left").withColumn("sector_code", F.coalesce("code", F.lit(-1))).drop("code")


def sector_of_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """rows with the sector that sector_code stands for; null for -1."""
    return rows.join(F.broadcast(codes.withColumnRenamed("code", "sector_code")), "sector_code", "left")


def first_sector(panel: DataFrame) -> DataFrame:
    """symbol, sector: each symbol's sector at its first date."""
    return panel.groupBy("symbol").agg(F.min_by("sector", F.struct("earnings_date", "episode")).alias("sector"))

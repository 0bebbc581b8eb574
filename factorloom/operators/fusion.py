"""Fusion of several features into one score, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import any_signal, mean_of, weighted
from factorloom.operators import boosting
from factorloom.operators.evaluation import ic_by, ic_series, newey_west, spearman
from factorloom.operators.panel import from_year, wide, with_demeaned, with_neutral, with_target, with_z


def fusion_table(panel: DataFrame, features: DataFrame, weights: dict[str, float], first_year: int) -> DataFrame:
    """The panel from first_year on with, per feature, its value and z-score, fusion_equal, fusion_icw, text_covered and
    the neutral move. The target's z-score is over the whole panel, before years are dropped."""
    names = list(weights)
    table = with_neutral(wide(from_year(with_target(panel), first_year), features, names))
    table = with_z(table, {n: f"{n}_z" for n in names})
    z = [F.col(f"{n}_z") for n in names]
    return table.withColumn("fusion_equal", mean_of(z)).withColumn("fusion_icw", weighted(z, list(weights.values()))).withColumn("text_covered", any_signal([F.col(n) for n in names]))


def long_scores(table: DataFrame, names: list[str]) -> DataFrame:
    """feature, value rows of several score columns, beside year, quarter, sector, moves and text_covered."""
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return table.select("episode", "year", "quarter", "sector", "move", "move_neutral", "target", "text_covered", F.explode(entries).alias("s")).select("*", "s.*").drop("s")


def ic_table(scores: DataFrame, y: str = "move_neutral") -> DataFrame:
    """feature, ic_mean, t_stat, n_quarters of every score column."""
    return newey_west(ic_series(scores, y=y))


def annual_ic(scores: DataFrame, y: str = "move_neutral", least: int = 10) -> DataFrame:
    """feature, year, ic pooled over the whole year."""
    return ic_by(scores, ["feature", "year"], y=y, least=least)


def covered_ic(scores: DataFrame, y: str = "move_neutral") -> DataFrame:
    """ic_table on covered rows, and its difference from all rows."""
    all_rows, covered = ic_table(scores, y), ic_table(scores.filter("text_covered"), y)
    return covered.join(all_rows.select("feature", F.col("ic_mean").alias("ic_all")), "feature").withColumn("delta", F.col("ic_mean") - F.col("ic_all"))


def feature_correlation(table: DataFrame, names: list[str]) -> DataFrame:
    return spearman(table, names)


def single_prediction(rows: DataFrame) -> DataFrame:
    """rows with prediction: the feature itself, 0 where it is missing."""
    return rows.withColumn("prediction", F.coalesce("value", F.lit(0.0)))


def report(scores: DataFrame, valid: DataFrame, y: str = "move_neutral") -> DataFrame:
    """feature, ic_mean, t_stat, n_quarters, ic_covered, delta and what `valid` (feature, ...) adds: one row a score."""
    covered = covered_ic(scores, y).select("feature", F.col("ic_mean").alias("ic_covered"), "delta")
    return ic_table(scores, y).join(covered, "feature", "left").join(valid, "feature", "left")


def fit_boosted(table: DataFrame, columns: list[str], train_years: list[int], rounds: int = 200, label: str = "target", seed: int = 42) -> boosting.Model:
    """Gradient-boosted trees on columns of the training years; the validation year doesn't stop them."""
    return boosting.fit(table.filter(F.col("year").isin(train_years)), columns, label, boosting.Settings(rounds=rounds, seed=seed))


def boosted(table: DataFrame, columns: list[str], train_years: list[int], rounds: int = 200, label: str = "target", seed: int = 42) -> DataFrame:
    """table with prediction by gradient-boosted trees on columns."""
    return boosting.predicted(table, fit_boosted(table, columns, train_years, rounds, label, seed))


def feature_importance(model: boosting.Model, top: int = 10) -> list[tuple[str, float]]:
    """The columns whose splits gain most, with their gain."""
    return model.importance()[:top]


def neutral_prediction(table: DataFrame) -> DataFrame:
    return with_demeaned(table, "prediction", "prediction_neutral")

"""Column helpers whose null and zero rules the statistics share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_signal(c: Column) -> Column:
    """Null, NaN or zero."""
    return c.isNull() | F.isnan(c.cast("double")) | (c == 0)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """c within bounds; null stays null, although least and greatest would skip it."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, bound(low)), bound(high)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation of pairs without nulls; null for a constant side, where corr itself would raise."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which condition is true."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def any_signal(columns: list[Column]) -> Column:
    """Whether any column has a signal."""
    return reduce(lambda a, b: a | b, [~no_signal(c) for c in columns])


def mean_of(columns: list[Column]) -> Column:
    """Row mean without nulls; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return total / F.nullif(count, F.lit(0))


def weighted(columns: list[Column], weights: list[float]) -> Column:
    """Weighted sum with weights scaled to 1 and nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * (w / sum(weights)) for c, w in zip(columns, weights)])


def season(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def split_of(year: Column, train: list[int], valid: list[int], test: list[int]) -> Column:
    """'train', 'valid', 'test' or null by year."""
    return F.when(year.isin(train), "train").when(year.isin(valid), "valid").when(year.isin(test), "test")

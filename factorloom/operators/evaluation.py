"""Cross-sectional statistics of features against moves, for all features at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import no_signal, pearson, season, share
from factorloom.sources.scratch import stored

LAGS, LEAST_PAIRS = 4, 5
#: Distinct values that a task ranks.
VALUES = 200_000


def ic_by(rows: DataFrame, by: list[str], x: str = "value", y: str = "move", least: int = LEAST_PAIRS) -> DataFrame:
    """by..., ic, n: Pearson correlation of x and y by group, over pairs without nulls; groups that have fewer than
    `least` pairs or a constant side are left out, as are groups with a null key."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).dropna(subset=by)
    found = pairs.groupBy(*by).agg(pearson(F.col(x), F.col(y)).alias("ic"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_series(rows: DataFrame, x: str = "value", y: str = "move") -> DataFrame:
    return ic_by(rows, ["feature", "year", "quarter"], x, y)


def newey_west(series: DataFrame, lags: int = LAGS) -> DataFrame:
    """feature, ic_mean, t_stat, n_quarters of quarterly ic.

    Lag products come from one window per feature over its quarters, some tens of rows.
    """
    by = Window.partitionBy("feature")
    order = by.orderBy("year", "quarter")
    resid = series.withColumn("mean", F.avg("ic").over(by)).withColumn("e", F.col("ic") - F.col("mean"))
    products = resid.select("feature", "ic", "e", *[(F.col("e") * F.lag("e", k).over(order)).alias(f"p{k}") for k in range(1, lags + 1)])
    n = F.count(F.lit(1))
    variance = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) / n
    t = F.when(n < 2, 0.0).otherwise(F.avg("ic") / F.sqrt(F.greatest(variance, F.lit(1e-12)) / n))
    return products.groupBy("feature").agg(F.avg("ic").alias("ic_mean"), t.alias("t_stat"), n.alias("n_quarters"))


def mean_ic(series: DataFrame) -> DataFrame:
    return series.groupBy("feature").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic_mean"))


def season_ic(rows: DataFrame) -> DataFrame:
    return ic_series(rows).select("feature", season(F.col("year"), F.col("quarter")).alias("season"), "ic")


def sector_ic(rows: DataFrame) -> DataFrame:
    return ic_by(rows, ["feature", "sector"]).select("feature", "sector", "ic")


def direction_consistency(sectors: DataFrame, means: DataFrame) -> DataFrame:
    """feature, direction_consistency: share of sectors with the mean's sign. A zero sector IC counts as negative, a
    zero mean as positive; features without a sector get 0."""
    same = (F.col("ic") > 0) == (F.col("ic_mean") >= 0)
    found = means.join(sectors, "feature", "left").groupBy("feature").agg(F.avg(F.when(F.col("ic").isNull(), None).when(same, 1.0).otherwise(0.0)).alias("dc"))
    return found.select("feature", F.coalesce("dc", F.lit(0.0)).alias("direction_consistency"))


def zero_ratio(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """feature, by..., zero_ratio: share of rows without signal; groups with a null key are left out."""
    by = by or []
    return rows.dropna(subset=by or None, how="any" if by else "all").groupBy("feature", *by).agg(share(no_signal(F.col("value"))).alias("zero_ratio"))


def score_distribution(rows: DataFrame) -> DataFrame:
    """feature, score, share of non-null values."""
    counts = rows.filter(F.col("value").isNotNull()).groupBy("feature", F.col("value").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("feature", "score", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("share"))


def test_coverage(panel: DataFrame, features: DataFrame, test_years: list[int]) -> DataFrame:
    """feature, n_test, n_panel, coverage: non-null feature rows among all panel rows of the test years."""
    base = panel.filter(F.col("year").isin(test_years))
    total = base.agg(F.count(F.lit(1)).alias("n_panel"))
    covered = base.join(features, "episode").groupBy("feature").agg(F.count("value").alias("n_test"))
    names = features.select("feature").distinct().join(covered, "feature", "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
    return names.join(F.broadcast(total)).withColumn("coverage", F.coalesce(F.try_divide("n_test", "n_panel"), F.lit(0.0)))


def coverage_failure(coverage: DataFrame, least: float = 0.05) -> DataFrame:
    return coverage.withColumn("coverage_failure", (F.col("n_test") == 0) | (F.col("coverage") < least))


def spearman(table: DataFrame, names: list[str], key: str = "episode") -> DataFrame:
    """left, right, rho for every pair of columns, over rows where both are present: average ranks, then Pearson.

    Rows are counted by pair and both values once, so that ties, zeros above all, are one row; ranks come from those
    counts, by ranges of distinct values. The mean of average ranks is (n + 1) / 2, so sums of products are centred.
    """
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(names) for b in names[i:]]
    long = table.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("x is not null and y is not null")
    joint = stored(long.groupBy("left", "right", "x", "y").agg(F.count(F.lit(1)).alias("n")), "joint")
    by = ["left", "right", "side"]
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("x", "y")])
    counts = stored(joint.select("left", "right", "n", F.explode(sides).alias("s")).groupBy("left", "right", "s.side", "s.v").agg(F.sum("n").alias("n")), "values")
    ranges = max(8, counts.count() // VALUES)
    cuts = counts.groupBy(*by).agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts"))
    placed = counts.join(F.broadcast(cuts), by).withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    total = placed.groupBy(*by, "range").agg(F.sum("n").alias("total"))
    of = Window.partitionBy(*by)
    total = total.select(*by, "range", (F.sum("total").over(of.orderBy("range")) - F.col("total")).alias("before"), ((F.sum("total").over(of) + 1) / 2).alias("mean"))
    within = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("v")) - F.col("n")
    ranks = placed.withColumn("within", within).join(F.broadcast(total), [*by, "range"]).select(*by, "v", (F.col("before") + F.col("within") + (F.col("n") + 1) / 2 - F.col("mean")).alias("r"))
    ranks = stored(ranks, "ranks")
    own = lambda c: ranks.filter(F.col("side") == c).select("left", "right", F.col("v").alias(c), F.col("r").alias(f"r{c}"))
    both = joint.join(own("x"), ["left", "right", "x"]).join(own("y"), ["left", "right", "y"])
    products = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    return both.groupBy("left", "right").agg((products("rx", "ry") / F.nullif(F.sqrt(products("rx", "rx") * products("ry", "ry")), F.lit(0.0))).alias("rho"))


def newey_west_of(ics: Column, lags: int = LAGS) -> Column:
    """t of an array of a feature's quarterly ic, in order."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size(ics)
    e = F.transform(ics, lambda x: x - total(ics) / n)
    variance = total(F.transform(e, lambda x: x * x)) / n
    for k in range(1, lags + 1):
        # pairs k quarters apart: what zip_with pads with null counts as 0
        variance = variance + 2 * (1 - k / (lags + 1)) * total(F.transform(F.zip_with(e, F.slice(e, k + 1, F.greatest(n, F.lit(1))), lambda x, y: x * y), lambda p: F.coalesce(p, F.lit(0.0)))) / n
    return F.when(n < 2, 0.0).otherwise(total(ics) / n / F.sqrt(F.greatest(variance, F.lit(1e-12)) / n))


#: Grouping ids of `summary` over (feature, year, quarter, sector, calendar).
QUARTERS, SECTORS, CALENDARS, WHOLE = 0b00011, 0b01101, 0b01110, 0b01111


def summary(rows: DataFrame) -> DataFrame:
    """Every statistic of rows (feature, year, quarter, sector, calendar, move, raw, value, test) by feature and period,
    sector or calendar year, in one aggregation: kind, keys, ic and n of test rows, shares, counts."""
    paired = F.col("test") & F.col("value").isNotNull() & F.col("move").isNotNull()
    x, y = F.when(paired, F.col("value")), F.when(paired, F.col("move"))
    keys = ["feature", "year", "quarter", "sector", "calendar"]
    sets = [["feature", "year", "quarter"], ["feature", "sector"], ["feature", "calendar"], ["feature"]]
    found = rows.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("kind"), pearson(x, y).alias("ic"), F.count(x).alias("n"), share(no_signal(F.col("value"))).alias("zeros"), share(no_signal(F.col("raw"))).alias("raw_zeros"),
        F.count(F.when(F.col("test"), F.col("raw"))).alias("n_test"),
    )
    usable = (F.col("n") >= LEAST_PAIRS) & F.col("ic").isNotNull() & ~F.isnan("ic")
    return found.withColumn("ic", F.when(usable, F.col("ic")))


def validation(panel: DataFrame, features: DataFrame, train_years: list[int], test_years: list[int]) -> DataFrame:
    """One row per feature with every statistic that the gates read, maps included; metrics unrounded.

    The joined rows are stored once; bounds, then one aggregation for all statistics of few groups, and one for the
    counts of scores, of which there may be many, read them.
    """
    from factorloom.operators.panel import joined, winsor_bounds, winsorized

    test = F.col("year").isin(test_years)
    raw = stored(joined(panel, features).select("feature", "year", "quarter", "sector", F.year("earnings_date").alias("calendar"), "move", F.col("value").alias("raw"), "value", test.alias("test")), "joined")
    clipped = winsorized(raw, stored(winsor_bounds(raw, train_years), "bounds"))
    found = summary(clipped)
    of = lambda kind: F.col("kind") == kind
    listed = lambda condition, **fields: F.array_sort(F.collect_list(F.when(condition, F.struct(*[c.alias(k) for k, c in fields.items()]))))
    as_map = lambda kind, key, value: F.map_from_entries(listed(of(kind) & key.isNotNull() & value.isNotNull(), key=key.cast("string"), value=value))
    quarters = listed(of(QUARTERS) & F.col("ic").isNotNull() & F.col("year").isNotNull() & F.col("quarter").isNotNull(), year=F.col("year"), quarter=F.col("quarter"), ic=F.col("ic"))
    whole = lambda c: F.max(F.when(of(WHOLE), F.col(c)))
    scores = score_distribution(clipped).groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("score").cast("string").alias("key"), F.col("share").alias("value"))))).alias("score_dist"))
    rows = found.groupBy("feature").agg(
        quarters.alias("quarters"), whole("raw_zeros").alias("zero_ratio"), whole("n_test").alias("n_test"),
        as_map(SECTORS, F.col("sector"), F.col("ic")).alias("per_sector_ic"), as_map(QUARTERS, season(F.col("year"), F.col("quarter")), F.col("ic")).alias("season_ic"),
        as_map(SECTORS, F.col("sector"), F.col("zeros")).alias("zero_by_sector"), as_map(CALENDARS, F.col("calendar"), F.col("zeros")).alias("zero_by_year"),
    )
    rows = rows.join(scores, "feature", "left").withColumn("score_dist", F.coalesce("score_dist", F.create_map().cast("map<string,double>")))
    ics = F.transform("quarters", lambda q: q["ic"])
    mean = F.aggregate(ics, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(ics), F.lit(0))
    signs = F.transform(F.map_values("per_sector_ic"), lambda x: F.when((x > 0) == (F.col("ic_mean") >= 0), 1.0).otherwise(0.0))
    rows = rows.withColumn("n_quarters", F.size("quarters").cast("long")).withColumn("t_stat", F.when(F.size("quarters") > 0, newey_west_of(ics))).withColumn("ic_mean", mean)
    rows = rows.withColumn("direction_consistency", F.when(F.col("n_quarters") > 0, F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(signs), F.lit(0))))
    total = panel.filter(F.col("year").isin(test_years)).agg(F.count(F.lit(1)).alias("n_panel"))
    names = features.select("feature").distinct()
    out = names.join(rows, "feature", "left").join(F.broadcast(total)).withColumn("n_test", F.coalesce("n_test", F.lit(0))).withColumn("coverage", F.coalesce(F.try_divide("n_test", "n_panel"), F.lit(0.0)))
    out = coverage_failure(out).drop("n_test", "n_panel", "quarters")
    gone = F.col("coverage_failure")
    for c in ("ic_mean", "t_stat", "direction_consistency"):
        out = out.withColumn(c, F.when(gone, 0.0).otherwise(F.coalesce(c, F.lit(0.0))))
    return out.withColumn("n_quarters", F.coalesce("n_quarters", F.lit(0)))


def rounded(results: DataFrame) -> DataFrame:
    """Metrics as the gates read them: ic to 4 places, t, zero ratio, consistency and zero maps to 3."""
    out = results.withColumn("ic_mean", F.round("ic_mean", 4))
    for c in ("t_stat", "zero_ratio", "direction_consistency"):
        out = out.withColumn(c, F.round(c, 3))
    for c in ("zero_by_sector", "zero_by_year", "score_dist"):
        out = out.withColumn(c, F.transform_values(c, lambda k, v: F.round(v, 3)))
    return out


def null_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(share(F.col("value").isNull()).alias("null_rate"))


def test_share(episodes: DataFrame, first_year: int = 2021, warn: float = 0.10) -> DataFrame:
    """n, n_test, share and whether the share is too small, over distinct (symbol, earnings_date) episodes."""
    distinct = episodes.select("symbol", "earnings_date").distinct()
    late: Column = F.year("earnings_date") >= first_year
    out = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(late, 1).otherwise(0)).alias("n_test"))
    return out.withColumn("share", F.coalesce(F.try_divide("n_test", "n"), F.lit(0.0))).withColumn("warn", F.col("share") < warn)

"""Audits: name collisions, profiles against poles, alignment of switches with the panel, income proxies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.operators.linalg import exact_median


def collisions(names: DataFrame, name: str, region: str) -> DataFrame:
    """(name, n_regions, n_rows): names that stand in more than one region."""
    g = names.where(F.col(name).isNotNull() & F.col(region).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count_distinct(region).alias("n_regions"), F.count("*").alias("n_rows"))
    return g.where("n_regions > 1")


def any_match(left: DataFrame, right: DataFrame, on: Column, key: str, flag: str) -> DataFrame:
    """(key, matched): whether any row of ``right`` that joins has the flag; false without any. ``on`` may join different names and fan out."""
    joined = left.join(right, on, "left")
    return joined.groupBy(key).agg(F.coalesce(F.bool_or(F.col(flag)), F.lit(False)).alias("matched"))


def closer_pole(value: Column, low: Column, high: Column) -> Column:
    """0 or 1 for the closer of two poles, 'tie' if neither is."""
    a, b = F.abs(value - low), F.abs(value - high)
    return F.when(a < b, "0").when(b < a, "1").otherwise("tie")


def direction(value: Column, middle: Column, sign: Column) -> Column:
    """Whether a value lies 'toward' or 'away' from the pole to which a feature of the given sign points: above the middle is toward for a positive sign, away for a negative one; 'neutral' for none. A value on the middle isn't above it."""
    return F.when(F.coalesce(sign, F.lit(0)) == 0, "neutral").when((value > middle) == (sign > 0), "toward").otherwise("away")


def directions(profile: DataFrame, signs: dict[str, int]) -> DataFrame:
    """``profile`` (feature, value, median, ...) with ``direction``; features without sign are neutral."""
    known = F.create_map(*(x for k, v in signs.items() for x in (F.lit(k), F.lit(v)))) if signs else F.create_map().cast("map<string,int>")
    return profile.withColumn("direction", direction(F.col("value"), F.col("median"), F.element_at(known, F.col("feature"))))


def seasonality(panel: DataFrame, category: str) -> DataFrame:
    """(entity, n, mean, cv): how much an entity's periods of a category vary: population deviation by mean, NULL where the mean is 0."""
    rows = panel.where((F.col("category") == category) & F.col("value").isNotNull())
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.try_divide(F.stddev_pop("value"), F.avg("value")).alias("cv"))


def require(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


def require_features(columns: Sequence[str], expected: int) -> Sequence[str]:
    """The feature names, if there are as many as expected and none twice; else an error names them."""
    require(len(columns) == expected and len(set(columns)) == expected, f"{expected} features expected, found {len(columns)}: {list(columns)}")
    return columns


def one_match(df: DataFrame) -> DataFrame:
    """``df``, if it has exactly one row; two are enough to tell."""
    n = len(df.limit(2).collect())
    require(n == 1, "one row expected, found none" if n == 0 else "one row expected, found several")
    return df


def aligned(labels: DataFrame, entities: DataFrame, key: str = "entity") -> DataFrame:
    """``labels``, if they label each of ``entities`` exactly once and nothing else; else an error with the numbers."""
    a, b = labels.groupBy(key).agg(F.count("*").alias("_a")), entities.select(key).distinct().withColumn("_b", F.lit(1))
    r = a.join(b, key, "full").agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("extra"), F.count(F.when(F.col("_a").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_a") > 1, 1)).alias("twice")).first()
    require(r.extra == r.missing == r.twice == 0, f"labels: {r.missing} entities without, {r.extra} unknown, {r.twice} with several")
    return labels


def expected_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """``df`` whose rows raise an error where ``column`` isn't ``value``: a guard inside the plan, checked where the rows are read."""
    same = F.col(column).eqNullSafe(F.lit(value))
    told = F.concat(F.lit(f"{column}: {value} expected, found "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    return df.where(F.when(same, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def profile_vs_poles(features: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(entity, feature, value, median, delta, mean0, mean1, closer) of every entity: against the medians and the means of both labels. One long pass."""
    long = features.select("entity", F.col(label).alias("_label"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("f")).select("entity", "_label", "f.*")
    stats = long.groupBy("feature").agg(F.avg(F.when(F.col("_label") == 0, F.col("value"))).alias("mean0"), F.avg(F.when(F.col("_label") == 1, F.col("value"))).alias("mean1"))
    joined = long.join(F.broadcast(stats.join(exact_median(long, "value", ["feature"]), "feature")), "feature")  # one row per feature
    return joined.select("entity", "feature", "value", "median", (F.col("value") - F.col("median")).alias("delta"), "mean0", "mean1", closer_pole(F.col("value"), F.col("mean0"), F.col("mean1")).alias("closer"))


def align_switches(events: DataFrame, windows: DataFrame, panel: DataFrame) -> DataFrame:
    """(entity, to_window, category, before, after, pct): mean values in the windows around each switch, each window half-open [start, end)."""
    bounds = lambda s: windows.select(F.col("window").alias(f"{s}_window"), F.col("window_start").alias(f"{s}_start"), F.col("window_end").alias(f"{s}_end"))
    around = events.join(bounds("from"), "from_window").join(bounds("to"), "to_window")
    rows = around.join(panel, "entity")
    inside = lambda s: (F.col("period") >= F.col(f"{s}_start")) & (F.col("period") < F.col(f"{s}_end"))
    g = rows.groupBy("entity", "to_window", "category").agg(F.avg(F.when(inside("from"), F.col("value"))).alias("before"), F.avg(F.when(inside("to"), F.col("value"))).alias("after"))
    return g.withColumn("pct", (F.try_divide("after", "before") - 1) * 100)


def top_periods(panel: DataFrame, category: str, k: int = 3) -> DataFrame:
    """(entity, place, period, value): each entity's ``k`` largest values of a category; ties by period."""
    order = Window.partitionBy("entity").orderBy(F.desc("value"), "period")
    rows = panel.where((F.col("category") == category) & F.col("value").isNotNull())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("entity", "place", "period", "value")


def regressions(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """(``by``, n, slope, intercept, r2, pearson) of y on x within groups; NULL where x doesn't vary."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(y) & ~F.isnan(x))
    cy, cx = F.col(y), F.col(x)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"), F.regr_r2(cy, cx).alias("r2"), F.corr(cy, cx).alias("pearson"))


def quantile_imputed(df: DataFrame, target: str, q: float = 0.75) -> DataFrame:
    """``df`` with <target>_q: the known value, else the quantile ``q`` of the known ones (linear between ranks)."""
    known = F.col(target).isNotNull() & ~F.isnan(target)
    level = df.where(known).agg(F.percentile(F.col(target), F.lit(q)).alias("_level"))  # merges counts of different values
    return df.join(F.broadcast(level)).withColumn(f"{target}_q", F.when(known, F.col(target)).otherwise(F.col("_level"))).drop("_level")


def residual(df: DataFrame, target: str, predictor: str) -> DataFrame:
    """``df`` with <target>_residual: what a straight line in ``predictor`` leaves of ``target``; NULL where either is. One aggregate of one row."""
    line = df.agg(F.regr_slope(F.col(target), F.col(predictor)).alias("_slope"), F.regr_intercept(F.col(target), F.col(predictor)).alias("_level"))
    return df.join(F.broadcast(line)).withColumn(f"{target}_residual", F.col(target) - F.coalesce(F.col("_slope"), F.lit(0.0)) * F.col(predictor) - F.coalesce(F.col("_level"), F.lit(0.0))).drop("_slope", "_level")


def income_proxy(df: DataFrame, target: str, predictors: Sequence[str], least_r2: float = 0.05) -> tuple[DataFrame, dict]:
    """``df`` with <target>_proxy: the known value, else the least-squares prediction, or the known median where the fit explains less than ``least_r2``."""
    known = df.where(F.col(target).isNotNull() & ~F.isnan(target)).dropna(subset=list(predictors))
    shape = VectorAssembler(inputCols=list(predictors), outputCol="_f", handleInvalid="skip")
    model = LinearRegression(featuresCol="_f", labelCol=target, solver="normal").fit(shape.transform(known))
    middle = exact_median(known, target).first()[0]
    fallback = model.summary.r2 < least_r2
    guess = F.lit(float(model.intercept))
    for c, w in zip(predictors, model.coefficients.toArray()):
        guess = guess + F.col(c) * float(w)
    fill = F.lit(middle) if fallback else F.coalesce(guess, F.lit(middle))
    out = df.withColumn(f"{target}_proxy", F.when(F.col(target).isNotNull() & ~F.isnan(target), F.col(target)).otherwise(fill))
    return out, {"r2": float(model.summary.r2), "used_fallback": bool(fallback)}

"""Missing values filled from similar records by group-aware predictive mean matching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmodes.operators.prefix import running_sums
from panelmodes.session import cut


@dataclass(frozen=True)
class Fill:
    """A column to fill: ``real`` tells a real value; ``target`` is what the model predicts of a real one."""

    column: str
    real: Column
    target: Column


@dataclass(frozen=True)
class Model:
    """Ridge regression on standardised predictors with a shrunken intercept per group."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float


def _kept_near(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` whose predictors beyond ten times the range of their middle 98 % stand at that end: an extreme or infinite value keeps its side, but doesn't outweigh all others. Sketches of bounded size."""
    if not names:
        return df
    got = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), [0.01, 0.99], 10_000).alias(c) for c in names]).first()
    most = 1e100  # squares of these can be summed
    for c in names:
        if got[c]:
            low, high = (min(max(v, -most), most) for v in got[c])
            wide = 10 * (high - low) or 10 * abs(high) + 1.0
            df = df.withColumn(c, F.when(F.col(c).isNotNull() & ~F.isnan(c), F.greatest(F.least(F.col(c), F.lit(min(high + wide, most))), F.lit(max(low - wide, -most)))))
    return df


def fit(df: DataFrame, predictors: Sequence[str], ridge: float = 1e-3) -> Model:
    """Fit ``_y`` on the predictors over all rows of ``df`` from one pass of sums and products.

    A predictor missing in a row stands at its mean. The sums are p^2 numbers whatever the number of rows.
    """
    p = len(predictors)
    first = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(predictors)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(predictors)], F.avg("_y").alias("y"), F.count("_y").alias("n")).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([first[f"s{i}"] or 1.0 for i in range(p)])
    if not first["n"]:
        return Model(mean, scale, np.zeros(p), 0.0)
    z = [F.coalesce((F.col(c) - float(mean[i])) / float(scale[i]), F.lit(0.0)) for i, c in enumerate(predictors)]
    y = F.col("_y") - float(first["y"])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = df.agg(*[F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(z[i] * y).alias(f"y{i}") for i in range(p)]).first()
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"x{i}_{j}"]
    weights = np.linalg.solve(gram + ridge * first["n"] * np.eye(p), np.array([got[f"y{i}"] for i in range(p)])) if p else np.zeros(0)
    return Model(mean, scale, weights, float(first["y"]))


def score(model: Model, predictors: Sequence[str]) -> Column:
    out = F.lit(model.intercept)
    for i, c in enumerate(predictors):
        out = out + float(model.weights[i]) * F.coalesce((F.col(c) - float(model.mean[i])) / float(model.scale[i]), F.lit(0.0))
    return out


def fill_by_matching(df: DataFrame, key: str, group: str, fill: Fill, predictors: Sequence[str], donors: int = 5, shrink: float = 5.0) -> DataFrame:
    """(key, _real, _donor, _value, _distance): one row per row of ``df`` whose ``fill.column`` isn't real.

    A ridge regression on all real rows, plus each group's mean residual shrunk by ``shrink`` rows, predicts every row. Donors are
    the real rows in order of (group, prediction, key); a recipient's range is the ``donors`` nearest on each side in its
    group, found by rank. Of these the one with the closest prediction gives its observed value (ties: the smaller key).
    A group without a donor takes donors from all groups. Without any donor the value and donor are NULL.

    Ranks come from a range-partitioned sort with distributed prefix counts, so a group with most of the rows, or any number of equal
    predictions, is no single task. ``key`` must be unique. NULL groups form one group; NULL or NaN predictors stand at their mean, extreme ones at the end of
    their side.
    """
    spark = df.sparkSession
    clean = df.select(
        F.col(key).cast("long").alias("_id"),
        F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("_group"),
        fill.real.alias("_real"),
        F.when(fill.real, fill.target.cast("double")).alias("_y"),
        F.col(fill.column).alias("_seen"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(predictors)],
    ).withColumn("_real", F.coalesce("_real", F.lit(False)))
    clean = cut(clean)
    names = [f"_x{i}" for i in range(len(predictors))]
    clean = _kept_near(clean, names)
    model = fit(clean.where("_real"), names)
    scored = clean.withColumn("_hat", score(model, names))
    residual = scored.where("_real").groupBy("_group").agg((F.sum(F.col("_y") - F.col("_hat")) / (F.count("*") + shrink)).alias("_lift"), F.count("*").alias("_have"))
    scored = scored.join(residual, "_group", "left").withColumn("_hat", F.col("_hat") + F.coalesce("_lift", F.lit(0.0)))
    pools = scored.select("_id", "_real", "_seen", "_hat", F.when(F.col("_have") > 0, F.col("_group")).otherwise(F.lit("\1")).alias("_pool"))
    # Recipients of groups without donors search one more pool that every donor is in as well.
    if pools.where("_pool = '\1'").limit(1).count():
        pools = pools.unionByName(pools.where("_real").withColumn("_pool", F.lit("\1")))
    ranked = running_sums(pools, ("_hat", "_id"), {"_rank": F.col("_real").cast("long")}, "_pool")
    ranked = ranked.select("_id", "_real", "_seen", "_hat", "_pool", F.col("_rank").cast("long").alias("_rank"))
    giving = ranked.where("_real").select(F.col("_pool"), F.col("_rank").alias("_at"), F.col("_id").alias("_donor"), F.col("_hat").alias("_donor_hat"), F.col("_seen").alias("_value"))
    asking = ranked.where("NOT _real").withColumn("_at", F.explode(F.sequence(F.col("_rank") - (donors - 1), F.col("_rank") + donors)))
    near = asking.join(giving, ["_pool", "_at"], "left").withColumn("_distance", F.abs(F.col("_hat") - F.col("_donor_hat")))
    best = F.min(F.when(F.col("_donor").isNotNull(), F.struct("_distance", "_donor", "_value")))
    return near.groupBy("_id").agg(best.alias("_b")).select(F.col("_id").alias(key), F.col("_b._donor").alias("_donor"), F.col("_b._value").alias("_value"), F.col("_b._distance").alias("_distance"))


def filled(df: DataFrame, key: str, group: str, fills: Sequence[Fill], predictors: Sequence[str]) -> DataFrame:
    """``df`` with every fill column complete and, for each, ``<column>_filled`` and ``<column>_donor``.

    An unreal value (a sentinel, an infinity, a blank) never survives: it is replaced by the donor's or by NULL.
    """
    out = df
    for f in fills:
        got = fill_by_matching(df, key, group, f, [p for p in predictors if p != f.column])
        got = got.select(F.col(key).alias("_key"), "_donor", "_value")
        real = F.coalesce(f.real, F.lit(False))
        out = out.withColumn("_was_real", real).join(got, F.col(key) == F.col("_key"), "left")
        out = out.withColumns({f.column: F.when(F.col("_was_real"), F.col(f.column)).otherwise(F.col("_value")), f"{f.column}_filled": ~F.col("_was_real"), f"{f.column}_donor": F.col("_donor")}).drop("_was_real", "_key", "_donor", "_value")
    return out

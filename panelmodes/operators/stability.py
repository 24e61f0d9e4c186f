"""How stable the typology is: bootstrap of the rows and a sweep of the regularisation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmodes.operators import linalg, plm, validity
from panelmodes.session import cut


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """``df`` with _row from 0 in order of ``order`` (unique), by a distributed rank."""
    from panelmodes.operators.prefix import running_sums

    return running_sums(df, (order,), {"_row": F.lit(1)}).withColumn("_row", (F.col("_row") - 1).cast("long"))


def resamples(spark, rows: int, reps: int) -> DataFrame:
    """(rep, _row, weight): how often each row is drawn in each replicate; replicate r draws with the legacy generator seeded by r, one task per replicate."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in b["id"]:
                n = np.bincount(np.random.RandomState(int(rep)).randint(0, rows, rows), minlength=rows)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"rep": int(rep), "_row": at, "weight": n[at]})

    return spark.range(0, reps, 1, min(reps, 64)).mapInPandas(draw, "rep int, _row long, weight long")


def poisson_weights(placed: DataFrame, reps: int) -> DataFrame:
    """``placed`` once for each replicate that draws the row: with rep and weight, Poisson of mean 1 from a hash of row and replicate.

    The bootstrap of tables of any size: every row draws for itself, nothing is numbered and no task draws for a whole replicate. A replicate has about as many rows as the table, not exactly.
    """
    u = (F.shiftrightunsigned(F.xxhash64("entity", "rep"), 11) + 0.5) / float(2**53)
    tail, term, weight = 1.0, math.exp(-1), F.lit(0)
    for k in range(1, 20):
        tail -= term
        term /= k
        weight = weight + (u < tail).cast("int")  # weight >= k with probability ``tail``
    return placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("weight", weight.cast("long")).where("weight > 0")


def labels_by_group(binary: DataFrame, x: DataFrame, columns: Sequence[str], by: str, c: float, weight: str | None = None) -> DataFrame:
    """(``by``, entity, u1, label, weight) of median splits along each group's leading mode. ``binary`` and ``x`` hold every group's rows (``by``, entity, columns, weight)."""
    modes = cut(plm.spectrum(plm.couplings(binary, columns, c, [by], weight), [by]).where("mode = 1").select(by, "loadings"))
    vec = F.array(*[F.col(k) for k in columns])
    u = F.aggregate(F.zip_with(vec, "loadings", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    w = F.col(weight) if weight else F.lit(1)
    scored = x.join(F.broadcast(modes), by).select(by, "entity", u.alias("u1"), w.cast("long").alias("weight"))
    scored = cut(scored)  # the modes were one row a group
    mid = linalg.exact_median(scored, "u1", [by], "_mid", "weight")
    return scored.join(mid, by).select(by, "entity", "u1", (F.col("u1") > F.col("_mid")).cast("int").alias("label"), "weight")


def bootstrap_ari(x: DataFrame, columns: Sequence[str], c: float = 0.2, reps: int = 100, draws: str = "legacy") -> DataFrame:
    """(rep, n, ari): agreement of each resample's labels with the labels of the whole, on the resample's own rows.

    ``x`` is (entity, standardised columns); it isn't standardised again. Rows are numbered in order of entity. A replicate holds weights instead of copies, so
    all replicates share one table, and each coupling fit sees only the distinct binary patterns. ``draws`` is 'legacy', the numbers of the well-known generator, drawn by one task
    a replicate, or 'poisson', where every row draws for itself, for tables beyond a task.
    """
    spark = x.sparkSession
    placed = x.select("entity", *columns) if draws == "poisson" else cut(row_numbers(x.select("entity", *columns), "entity"))
    one = placed.withColumn("all", F.lit(0))
    base = labels_by_group(linalg.binarize(one, columns), one, columns, "all", c).select("entity", F.col("label").alias("base"))
    drawn = poisson_weights(placed, reps) if draws == "poisson" else placed.join(resamples(spark, placed.count(), reps).hint("merge"), "_row")  # the planner takes the draws for a few rows and would send them through the driver
    got = labels_by_group(linalg.binarize(drawn, columns), drawn, columns, "rep", c, "weight")
    table = validity.contingency(got.join(base, "entity"), "label", "base", ["rep"], "weight")
    return validity.adjusted_rand(table, ["rep"])


def regularisation_sweep(x: DataFrame, columns: Sequence[str], grid: Sequence[float], base: float = 0.2) -> DataFrame:
    """(c, ari, lambda_max, lambda_2, pr_plus, frustration, silhouette): each strength's spectrum, the agreement of its labels with those at ``base``, and the labels' silhouette on the columns.

    All strengths' silhouettes come from one pass over the pairs of blocks of rows.
    """
    cs = sorted({*grid, base})
    each = x.select("entity", *columns).withColumn("c", F.explode(F.array(*map(F.lit, cs))))
    binary = linalg.binarize(each, columns)
    modes = cut(plm.spectrum(plm.couplings(binary, columns, base, ["c"]), ["c"]))
    vec = F.array(*[F.col(k) for k in columns])
    u = F.aggregate(F.zip_with(vec, "loadings", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    scored = each.join(modes.where("mode = 1").select("c", "loadings"), "c").select("c", "entity", u.alias("u1"))
    scored = cut(scored)
    split = scored.join(linalg.exact_median(scored, "u1", ["c"], "_mid"), "c").select("c", "entity", (F.col("u1") > F.col("_mid")).cast("int").alias("label"))
    ref = split.where(F.col("c") == base).select("entity", F.col("label").alias("base"))
    ari = validity.adjusted_rand(validity.contingency(split.join(ref, "entity"), "label", "base", ["c"]), ["c"])
    at = {v: k for k, v in enumerate(cs)}
    place = F.create_map(*(i for v, k in at.items() for i in (F.lit(v), F.lit(k))))
    marks = split.groupBy("entity").agg(F.sum(F.col("label") * F.pow(F.lit(2), F.element_at(place, F.col("c"))).cast("int")).cast("int").alias("label"))  # one bit for each strength
    points = x.select(F.col("entity").alias("id"), vec.alias("x")).join(marks.withColumnRenamed("entity", "id"), "id")
    sw = validity.silhouettes_of_halves(points, len(cs)).withColumn("c", F.element_at(F.array(*map(F.lit, cs)), F.col("k") + 1)).select("c", "silhouette")
    out = ari.join(plm.spectral_metrics(modes, ["c"]), "c").join(sw, "c").where(F.col("c").isin(*grid))
    return out.select("c", "ari", "lambda_max", "lambda_2", "pr_plus", "frustration", "silhouette")

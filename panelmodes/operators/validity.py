"""Agreement and validity of labelings. Rows are (id, label INT, x ARRAY<DOUBLE>); labels need not be contiguous."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmodes.operators.linalg import block_size, blocks, over_pairs
from panelmodes.session import cut


def contingency(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(``by``, a, b, n): how often two labelings meet."""
    n = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))


def adjusted_rand(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, n, ari) of a contingency table; 1 where both labelings are trivial."""
    two = lambda c: c * (c - 1) / 2
    cells = table.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("_both"), F.sum("n").alias("n"))
    side = lambda s: table.groupBy(*by, s).agg(F.sum("n").alias("_m")).groupBy(*by).agg(F.sum(two(F.col("_m"))).alias(f"_{s}"))
    if by:
        joined = cells.join(side("a"), list(by)).join(side("b"), list(by))
    else:
        joined = cells.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))  # one row each
    expected = F.try_divide(F.col("_a") * F.col("_b"), two(F.col("n")))
    top, room = F.col("_both") - expected, (F.col("_a") + F.col("_b")) / 2 - expected
    return joined.select(*by, F.col("n").cast("long").alias("n"), F.coalesce(F.when(room != 0, F.try_divide(top, room)), F.lit(1.0)).alias("ari"))


def distance_sums(points: DataFrame) -> DataFrame:
    """(id, label, other, total, n): the sum of distances from each point to the points of each label, without itself. Block by block, one row per point, block and label."""

    def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
        out = []
        for ids, own, others, m in ((a, la, lb, d), *(() if same else ((b, lb, la, d.T),))):
            labels, at = np.unique(others, return_inverse=True)
            hot = (at[:, None] == np.arange(len(labels))[None, :]).astype(float)
            n = np.tile(hot.sum(0).astype(np.int64), (len(ids), 1))
            if same:
                n -= own[:, None] == labels[None, :]
            k = len(labels)
            out.append(pd.DataFrame({"id": np.repeat(ids, k), "label": np.repeat(own, k), "other": np.tile(labels, len(ids)), "total": (m @ hot).ravel(), "n": n.ravel()}))
        return pd.concat(out)

    parts = over_pairs(blocks(points, "id", "x", "label", block_size(points)), kernel, "id long, label int, other int, total double, n long")
    return parts.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(sums: DataFrame) -> DataFrame:
    """(id, label, s): Euclidean silhouette of every point; 0 for the only member of a cluster."""
    mean = F.try_divide("total", "n")
    own = F.col("label") == F.col("other")
    g = sums.groupBy("id", "label").agg(F.max(F.when(own, mean)).alias("a"), F.max(F.when(own, F.col("n"))).alias("mates"), F.min(F.when(~own, mean)).alias("b"))
    return g.select("id", "label", F.when((F.col("mates") > 0) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0).alias("s"))


def silhouette(sums: DataFrame) -> DataFrame:
    return silhouettes(sums).agg(F.avg("s").alias("silhouette"))


def silhouettes_of_halves(points: DataFrame, many: int) -> DataFrame:
    """(k, silhouette) for ``many`` labelings in two at once: bit k of ``label`` is a point's label in the k-th. Their sums of distances come from one pass over the pairs of blocks."""

    def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
        out = []
        for ids, own, others, m in ((a, la, lb, d), *(() if same else ((b, lb, la, d.T),))):
            for k in range(many):
                mine, theirs = own >> k & 1, others >> k & 1
                for side in (0, 1):
                    n = np.full(len(ids), int((theirs == side).sum()))
                    out.append(pd.DataFrame({"id": ids, "k": k, "label": mine, "other": side, "total": m[:, theirs == side].sum(1), "n": n - (mine == side) if same else n}))
        return pd.concat(out)

    parts = over_pairs(blocks(points, "id", "x", "label"), kernel, "id long, k int, label int, other int, total double, n long")
    sums = parts.groupBy("k", "id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0 OR label = other")
    mean, own = F.try_divide("total", "n"), F.col("label") == F.col("other")
    g = sums.groupBy("k", "id").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    s = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return g.groupBy("k").agg(F.avg(s).alias("silhouette"))


def avi(sums: DataFrame) -> DataFrame:
    """Mean over clusters (of two or more) of the mean distance within, by the mean over pairs of clusters of the mean distance between."""
    g = sums.groupBy("label", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    mean = F.try_divide("t", "n")
    h = g.agg(F.avg(F.when(F.col("label") == F.col("other"), mean)).alias("i"), F.avg(F.when(F.col("label") < F.col("other"), mean)).alias("o"))
    return h.select((F.col("i") / (F.col("o") + 1e-12)).alias("avi"))


def long_points(points: DataFrame) -> DataFrame:
    """(id, label, d, x): one row per coordinate."""
    return points.select("id", "label", F.posexplode("x").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(long: DataFrame) -> DataFrame:
    """(label, d, c, n, v): mean, count and population variance of each cluster's coordinate."""
    return long.groupBy("label", "d").agg(F.avg("x").alias("c"), F.count("*").alias("n"), F.var_pop("x").alias("v"))


def radii(long: DataFrame, cents: DataFrame) -> DataFrame:
    """(label, r, n): mean distance of a cluster's points to their centroid."""
    near = long.join(cents.select("label", "d", "c"), ["label", "d"]).groupBy("id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("r"))
    return near.groupBy("label").agg(F.avg("r").alias("r"), F.count("*").alias("n"))


def mq(long: DataFrame, cents: DataFrame) -> DataFrame:
    return radii(long, cents).agg(F.avg("r").alias("mq"))


def avu(cents: DataFrame) -> DataFrame:
    return cents.groupBy("label").agg(F.avg("v").alias("v")).agg(F.avg("v").alias("avu"))


def calinski(long: DataFrame, cents: DataFrame) -> DataFrame:
    """Between by within dispersion, each by its degrees of freedom."""
    mean = long.groupBy("d").agg(F.avg("x").alias("g"))
    between = cents.join(mean, "d").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) * (F.col("c") - F.col("g"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    sizes = cents.where("d = 0").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return between.join(F.broadcast(sizes)).select(F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0))).alias("calinski"))


def centre_distances(cents: DataFrame) -> DataFrame:
    """(a, b, d) of every ordered pair of different centroids, joined by coordinate."""
    one, two = cents.select(F.col("label").alias("a"), "d", F.col("c").alias("x")), cents.select(F.col("label").alias("b"), "d", F.col("c").alias("y"))
    return one.join(two, "d").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d"))


def davies_bouldin(long: DataFrame, cents: DataFrame) -> DataFrame:
    r = radii(long, cents)
    pairs = centre_distances(cents).join(r.select(F.col("label").alias("a"), F.col("r").alias("ra")), "a").join(r.select(F.col("label").alias("b"), F.col("r").alias("rb")), "b")
    return pairs.groupBy("a").agg(F.max(F.try_divide(F.col("ra") + F.col("rb"), F.col("d"))).alias("m")).agg(F.avg("m").alias("davies_bouldin"))


MIDS_BYTES = 64 << 20


def s_dbw(points: DataFrame, long: DataFrame, cents: DataFrame) -> DataFrame:
    """Scatter by whole scatter, plus mean density at the midpoints of centroids. Infinite for fewer than two clusters.

    sigma of a set is the root of the mean squared distance to its mean. A midpoint's density counts, by the larger cluster's size, the points whose every coordinate
    is closer than the clusters' mean sigma. The midpoints (clusters squared times coordinates) travel in rows of at most about MIDS_BYTES each, and a point leaves a row only where it lies inside.
    """
    sigma = cents.groupBy("label").agg(F.sqrt(F.sum("v")).alias("s"), F.max("n").alias("n"))
    mean_all = sigma.agg(F.avg("s").alias("stdev"), F.avg(F.when(F.col("n") > 1, F.col("s"))).alias("scatter"), F.count("*").alias("k"))
    whole = long.groupBy("d").agg(F.var_pop("x").alias("v")).agg(F.sqrt(F.sum("v")).alias("all"))
    ids = cents.select("label", "d", "c", "n")
    two = ids.select(F.col("label").alias("b"), "d", F.col("c").alias("y"), F.col("n").alias("m"))
    mids = ids.withColumnRenamed("label", "a").join(two, "d").where("a < b").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("d", ((F.col("c") + F.col("y")) / 2).alias("mid")))).alias("at"), F.max(F.greatest("n", "m")).alias("most"))
    mids = cut(mids)
    shape = mids.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("numbers")).first()
    parts = max(1, -(-shape.numbers * 8 // MIDS_BYTES))  # as many broadcasts of bounded size as the midpoints need
    hits = None
    for k in range(parts):
        part = mids.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k).agg(F.collect_list(F.struct("a", "b", "most", F.col("at.mid").alias("mid"))).alias("mids"))
        seen = points.select("id", F.col("x").cast("array<double>").alias("x")).join(F.broadcast(part)).join(F.broadcast(mean_all.select("stdev")))
        near = lambda m: F.forall(F.zip_with(m["mid"], F.col("x"), lambda p, q: F.abs(q - p) < F.col("stdev")), lambda t: t)
        hit = seen.select(F.explode(F.filter("mids", near)).alias("m")).agg(F.sum(1.0 / F.col("m.most")).alias("hit"))
        hits = hit if hits is None else hits.unionByName(hit)
    joined = mean_all.join(F.broadcast(whole)).join(F.broadcast(hits.agg(F.sum("hit").alias("hit")))).withColumn("pairs", F.lit(shape.pairs))
    density = F.coalesce(F.try_divide(F.coalesce("hit", F.lit(0.0)), F.col("pairs")), F.lit(0.0))
    return joined.select(F.when(F.col("k") < 2, F.lit(float("inf"))).otherwise(F.coalesce("scatter", F.lit(0.0)) / (F.col("all") + 1e-12) + density).alias("s_dbw"))


def validity_table(points: DataFrame, method: str) -> DataFrame:
    """(method, silhouette, calinski, davies_bouldin, s_dbw, avi, avu, mq): one row."""
    sums = cut(distance_sums(points))
    long = cut(long_points(points))
    cents = cut(centroids(long))
    out = silhouette(sums)
    for part in (calinski(long, cents), davies_bouldin(long, cents), s_dbw(points, long, cents), avi(sums), avu(cents), mq(long, cents)):
        out = out.join(F.broadcast(part))  # one row each
    return out.select(F.lit(method).alias("method"), "*")

"""Clusters of mutually similar records: parallel pivot correlation clustering.

Records are similar if they differ by at most a tolerance in every field. A seeded hash orders them; in each round the
records that come before all their similar neighbours become pivots and absorb their neighbours, until none is left. Members then go to the
closest pivot, and exact medoids describe each cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmodes.operators.prefix import running_sums
from panelmodes.session import cut

UNIT = 1_000_000_000  # coordinates are whole billionths, so that tolerances compare exactly


def _close(fields: Sequence[int], tol: Sequence[int], a: str, b: str) -> Column:
    out = F.lit(True)
    for i in fields:
        out = out & (F.abs(F.col(f"{a}{i}") - F.col(f"{b}{i}")) <= tol[i])
    return out


def shuffled(seed: int, key: Column) -> Column:
    """LONG that orders keys as good as at random: sixty bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), 1, 15), 16, 10).cast("long")


class BoxClusters:
    """Clustering of ``df`` by numeric fields with a tolerance for each.

    ``key`` must be unique; a record without one is left out. A field that is NULL, NaN or beyond nine billion in size (which billionths can't hold) is unknown: records with such
    fields found no cluster, but ``everyone`` gives them one by the fields they have. Exact copies
    are collapsed to one weighted point first and expanded at the end, so copies cost nothing. A grid as wide as the
    tolerances makes all points of a cell similar to each other: one point per cell can become a pivot in a round, and a point meets
    at most the candidates of its own and the 3^k - 1 neighbouring cells. Work per round is linear in the points, however dense they lie;
    no pairs of points within a group are formed.
    """

    def __init__(self, df: DataFrame, key: str, tolerances: dict[str, float], seed: int = 17) -> None:
        self.names, self.key, self.seed = list(tolerances), key, seed
        self.tol = [round(t * UNIT) for t in tolerances.values()]
        self.at = range(len(self.names))
        grid = [F.when(F.abs(F.col(c).cast("double")) < 9e9, F.round(F.col(c).cast("double") * UNIT).cast("long")).alias(f"x{i}") for i, c in enumerate(self.names)]
        real = F.col("id").isNotNull()
        for i, c in enumerate(self.names):
            real = real & F.col(f"x{i}").isNotNull()
        every = cut(df.select(F.col(key).cast("long").alias("id"), *grid).where("id IS NOT NULL"))
        self.records, self.partial = every.where(real), every.where(~real)
        self.points = cut(self._points())
        self.assigned = self._cluster()

    def _cells(self, prefix: str = "c") -> list[Column]:
        return [F.expr(f"(x{i} - pmod(x{i}, {t}L)) div {t}L").alias(f"{prefix}{i}") for i, t in zip(self.at, self.tol)]

    def _points(self) -> DataFrame:
        xs = [f"x{i}" for i in self.at]
        one = self.records.groupBy(*xs).agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        return one.select("id", "weight", shuffled(self.seed, F.col("id")).alias("h"), *xs, *self._cells())

    def _probes(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Every row once for each cell that can hold a neighbour; its coordinates as p0, p1, ..."""
        steps = F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{i}") for i, d in enumerate(o))) for o in product((-1, 0, 1), repeat=len(self.names))))
        far = df.withColumn("step", F.explode(steps))
        return far.select(*keep, *[F.col(f"x{i}").alias(f"p{i}") for i in self.at], *[(F.col(f"c{i}") + F.col(f"step.d{i}")).alias(f"c{i}") for i in self.at])

    def _cluster(self) -> DataFrame:
        """(id, pivot, pivot coordinates q0...) of every point."""
        cell, xs = [f"c{i}" for i in self.at], [f"x{i}" for i in self.at]
        left, pivots = self.points, None
        while left.limit(1).count():
            least = left.groupBy(*cell).agg(F.min(F.struct("h", "id", *xs)).alias("m"))
            candidates = least.select("m.*", *cell)
            probes = self._probes(candidates, [F.col("h").alias("ph"), F.col("id").alias("pid")])
            earlier = (F.col("h") < F.col("ph")) | ((F.col("h") == F.col("ph")) & (F.col("id") < F.col("pid")))
            beaten = probes.join(left.select("h", "id", *xs, *cell), cell).where(earlier & _close(self.at, self.tol, "x", "p")).select(F.col("pid").alias("id")).distinct()
            found = cut(candidates.join(beaten, "id", "left_anti"))
            reach = self._probes(found, [F.col("h").alias("ph"), F.col("id").alias("pid")])
            absorbed = reach.join(left, cell).where(_close(self.at, self.tol, "x", "p")).select("id").distinct()
            left = cut(left.join(absorbed, "id", "left_anti"))
            pivots = found if pivots is None else pivots.unionByName(found)
        if pivots is None:
            empty = self.points.limit(0)
            return empty.select("*", F.col("id").alias("pivot"), *[F.col(f"x{i}").alias(f"q{i}") for i in self.at])
        # Every point to its closest pivot; the one that absorbed it is near enough, so each has one.
        reach = self._probes(pivots, [F.col("h").alias("ph"), F.col("id").alias("pid")])
        away = F.lit(0.0)
        for i in self.at:
            away = away + F.abs(F.col(f"x{i}") - F.col(f"p{i}")) / float(self.tol[i])
        best = F.min(F.struct(away, "ph", "pid", *[f"p{i}" for i in self.at]))
        met = reach.join(self.points, cell).where(_close(self.at, self.tol, "x", "p")).groupBy("id").agg(best.alias("b"))
        chosen = met.select("id", F.col("b.pid").alias("pivot"), *[F.col(f"b.p{i}").alias(f"q{i}") for i in self.at])
        return cut(self.points.join(chosen, "id"))

    def members(self) -> DataFrame:
        """(id, cluster): every comparable record with its cluster, named by the smallest id in it."""
        xs = [f"x{i}" for i in self.at]
        names = self.assigned.groupBy("pivot").agg(F.min("id").alias("cluster"))
        return self.records.join(self.assigned.join(names, "pivot").select(*xs, "cluster"), xs).select("id", "cluster")

    def everyone(self) -> DataFrame:
        """(id, cluster, compared): ``members``, and every other record: with the cluster whose pivot, the first in hash order of its own or a neighbouring cell of the known fields, is similar in
        all of them (the closest of these), else in a cluster of its own.

        Pivots are looked up once for each set of known fields that occurs, one for each cell, so this is linear too.
        """
        known = F.array_compact(F.array(*(F.when(F.col(f"x{i}").isNotNull(), F.lit(i)) for i in self.at)))
        kinds = [r.known for r in self.partial.select(known.alias("known")).distinct().collect()]  # at most 2 to the number of fields
        names = self.assigned.groupBy("pivot").agg(F.min("id").alias("cluster"))
        pivots = self.assigned.where("id = pivot").select("pivot", "h", *[f"x{i}" for i in self.at], *[f"c{i}" for i in self.at]).join(names, "pivot")
        out = self.members().select("id", "cluster", F.lit(True).alias("compared"))
        for have in kinds:
            rows = self.partial.where(known == F.array(*map(F.lit, have)) if have else F.size(known) == 0)
            found = None
            if have:
                cell = [f"c{i}" for i in have]
                first = pivots.groupBy(*cell).agg(F.min(F.struct("h", "pivot", *[F.col(f"x{i}").alias(f"p{i}") for i in have], "cluster")).alias("f"))
                steps = F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{i}") for i, d in zip(have, o))) for o in product((-1, 0, 1), repeat=len(have))))
                cells = self._cells()
                near = rows.select("id", *[f"x{i}" for i in have], *[cells[i] for i in have]).withColumn("step", F.explode(steps))
                near = near.select("id", *[f"x{i}" for i in have], *[(F.col(f"c{i}") + F.col(f"step.d{i}")).alias(f"c{i}") for i in have])
                met = near.join(first, cell).select("id", *[f"x{i}" for i in have], "f.*").where(_close(have, self.tol, "x", "p"))
                away = F.lit(0.0)
                for i in have:
                    away = away + F.abs(F.col(f"x{i}") - F.col(f"p{i}")) / float(self.tol[i])
                found = met.groupBy("id").agg(F.min(F.struct(away.alias("away"), "h", "cluster")).alias("b")).select("id", F.col("b.cluster").alias("cluster"))
            placed = rows.select("id").join(found, "id", "left") if found is not None else rows.select("id", F.lit(None).cast("long").alias("cluster"))
            out = out.unionByName(placed.select("id", F.coalesce("cluster", "id").alias("cluster"), F.lit(False).alias("compared")))
        return out

    def medoids(self, most: int = 3) -> DataFrame:
        """(cluster, size, typical ARRAY of ids, spread): size in records, the ``most`` points with the least mean distance, and that least mean.

        Distance is the sum over fields of difference by tolerance. The sum of distances from a point to all others
        comes exactly from prefix sums along each field, without pairs; hot clusters spread over many tasks. Ties: the smaller id.
        """
        pts = self.assigned.select("id", "weight", "pivot", *[(F.col(f"x{i}") - F.col(f"q{i}")).alias(f"r{i}") for i in self.at])
        totals = pts.groupBy("pivot").agg(F.min("id").alias("cluster"), F.sum("weight").alias("size"), *[F.sum(F.col("weight") * F.col(f"r{i}")).alias(f"t{i}") for i in self.at])
        dist = None
        for i in self.at:
            ranked = running_sums(pts.select("id", "pivot", "weight", f"r{i}"), (f"r{i}", "id"), {"w": F.col("weight"), "s": F.col("weight") * F.col(f"r{i}")}, "pivot")
            one = ranked.select("id", F.col("w").alias(f"w{i}"), F.col("s").alias(f"s{i}"))
            dist = one if dist is None else dist.join(one, "id")
        full = pts.join(dist, "id").join(totals, "pivot")
        total = F.lit(0.0)
        for i, t in zip(self.at, self.tol):
            total = total + (F.col(f"r{i}") * (2 * F.col(f"w{i}") - F.col("size")) - 2 * F.col(f"s{i}") + F.col(f"t{i}")) / float(t)
        ranked = full.select("cluster", "size", F.struct((total / F.col("size")).alias("mean"), "id").alias("m"))
        # The least few by repeated minima: bounded state for clusters of any size.
        out = None
        rest = cut(ranked)
        for k in range(most):
            best = rest.groupBy("cluster").agg(F.min("m").alias(f"m{k}"), F.max("size").alias("size"))
            out = best if out is None else out.join(best.drop("size"), "cluster", "left")
            rest = rest.join(best.select("cluster", F.col(f"m{k}").alias("taken")), "cluster").where("m > taken").drop("taken")
        ids = F.array_compact(F.array(*(F.col(f"m{k}.id") for k in range(most))))
        return out.select("cluster", "size", ids.alias("typical"), F.col("m0.mean").alias("spread"))

    def isolated(self, least: int = 4) -> DataFrame:
        """(first_id, id): clusters of at least ``least`` records that are cliques without any similar record outside.

        Exact: a cluster is a clique exactly if each field's range is within its tolerance. A cell holds no two such clusters, so records outside meet at
        most one cluster per neighbouring cell, and only those inside its box widened by the tolerances are compared with its members.
        """
        cell, xs = [f"c{i}" for i in self.at], [f"x{i}" for i in self.at]
        box = [f(f"x{i}").alias(f"{n}{i}") for i in self.at for n, f in (("lo", F.min), ("hi", F.max))]
        tight = F.col("size") >= least
        for i, t in zip(self.at, self.tol):
            tight = tight & (F.col(f"hi{i}") - F.col(f"lo{i}") <= t)
        cliques = self.assigned.groupBy("pivot").agg(F.sum("weight").alias("size"), *box).where(tight)
        shared = self.assigned.groupBy(*cell).agg(F.min("pivot").alias("a"), F.max("pivot").alias("b")).where("a <> b").select(*cell)
        crowded = self.assigned.join(shared, cell, "left_semi").select("pivot").distinct()
        cliques = cut(cliques.join(crowded, "pivot", "left_anti"))
        spots = self.assigned.select("pivot", *cell).distinct().join(cliques, "pivot")
        steps = F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{i}") for i, d in enumerate(o))) for o in product((-1, 0, 1), repeat=len(self.names))))
        around = spots.withColumn("step", F.explode(steps)).select("pivot", *[f"{n}{i}" for i in self.at for n in ("lo", "hi")], *[(F.col(f"c{i}") + F.col(f"step.d{i}")).alias(f"c{i}") for i in self.at]).distinct()
        inside = F.col("other") != F.col("pivot")
        for i, t in zip(self.at, self.tol):
            inside = inside & F.col(f"x{i}").between(F.col(f"lo{i}") - t, F.col(f"hi{i}") + t)
        near = around.join(self.assigned.select(F.col("pivot").alias("other"), F.col("id").alias("oid"), *xs, *cell), cell).where(inside).select("pivot", *[F.col(f"x{i}").alias(f"p{i}") for i in self.at]).distinct()
        touched = near.join(self.assigned.select("pivot", *xs), "pivot").where(_close(self.at, self.tol, "x", "p")).select("pivot").distinct()
        good = cliques.select("pivot").join(touched, "pivot", "left_anti")
        firsts = self.assigned.join(good, "pivot", "left_semi").groupBy("pivot").agg(F.min("id").alias("first_id"))
        own = self.assigned.join(firsts, "pivot").select(*xs, "first_id")
        return self.records.join(own, xs).where("id > first_id").select("first_id", "id")

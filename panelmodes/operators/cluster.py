"""Labels: median split, k-means, neighbourhood graphs, components and communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.operators import near
from panelmodes.operators.linalg import distance_quantiles, exact_median, spanning_edges
from panelmodes.session import cut, written


def median_split(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with label 1 where ``value`` lies above the exact (midpoint) median, else 0."""
    mid = exact_median(df, value, by, "_mid")
    joined = df.join(mid, list(by)) if by else df.join(F.broadcast(mid))  # one row
    return joined.withColumn("label", (F.col(value) > F.col("_mid")).cast("int")).drop("_mid")


def kmeans(points: DataFrame, k: int, starts: int = 30, seed: int = 42) -> DataFrame:
    """(id, label): the best of ``starts`` seeded k-means runs by cost (ties: the earlier seed). Labels are 0.. by size, then by smallest id."""
    return kmeans_grid(points, [k], starts, seed).select("id", "label")


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each id, by splitmix64 of id and salt."""
    z = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt + 1) * 0xD1342543DE82EF95 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15), (29, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        step = x[:, d][:, None] - centres[:, d][None, :]
        out += step * step
    return out


def kmeans_grid(points: DataFrame, ks: Sequence[int], starts: int = 30, seed: int = 42, most: int = 300, tol: float = 1e-4) -> DataFrame:
    """(k, id, label) for every k: the best of ``starts`` seeded k-means++ runs by cost (ties: the earlier seed); labels 0.. by size, then by smallest id.

    All runs of all k advance together, one job a step: a task holds its batch and the centres, and only sums per run and cluster leave it. A draw proportional to
    the squared distance is the least of exponential keys, so it needs no global order. A run ends when its centres move by less than ``tol`` of the mean variance.
    """
    rows = cut(points.where("x IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")))
    first = rows.first()
    if first is None:
        return ranked_by_size(rows.select(F.lit(0).alias("k"), "id", F.lit(0).alias("label")), ["k"])
    p = len(first.x)
    stats = rows.agg(*[F.var_pop(F.col("x")[i]) for i in range(p)]).first()
    least = tol * sum(stats) / p
    runs = [(k, s) for k in ks for s in range(starts)]
    centres: dict[int, np.ndarray] = {r: np.zeros((0, p)) for r in range(len(runs))}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for f in frames:
            if len(f):
                yield f["id"].to_numpy(), np.vstack(f["x"].to_list())

    for step in range(max(ks)):
        todo = {r: centres[r] for r, (k, _) in enumerate(runs) if k > step}

        def draw(frames, todo=todo, step=step):  # noqa: ANN001, ANN202
            for ids, x in batches(frames):
                out = []
                for r, c in todo.items():
                    k, s = runs[r]
                    with np.errstate(divide="ignore"):
                        keys = -np.log(_uniform(ids, ((seed + s) * 1000 + k) * 1000 + step)) / (_squares(x, c).min(1) if len(c) else 1.0)
                    at = int(np.lexsort((ids, keys))[0])
                    out.append((r, float(keys[at]), int(ids[at]), x[at].tolist()))
                yield pd.DataFrame(out, columns=["r", "key", "id", "x"])

        got = rows.mapInPandas(draw, "r int, key double, id long, x array<double>").groupBy("r").agg(F.min(F.struct("key", "id", "x")).alias("m")).collect()  # one row a run
        for g in got:
            centres[g.r] = np.vstack([centres[g.r], np.array(g.m.x)])

    def sums(frames: Iterator[pd.DataFrame], now: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        total = {r: np.zeros((len(c), p + 2)) for r, c in now.items()}  # sums, number and cost of each cluster
        for _, x in batches(frames):
            for r, c in now.items():
                square = _squares(x, c)
                at = square.argmin(1)
                hot = (at[:, None] == np.arange(len(c))[None, :]).astype(float)
                total[r] += hot.T @ np.column_stack([x, np.ones(len(x)), square[np.arange(len(x)), at]])
        out = [pd.DataFrame({"r": r, "i": np.arange(t.size), "v": t.ravel()}) for r, t in total.items()]
        yield pd.concat(out) if out else pd.DataFrame({"r": [], "i": [], "v": []})

    def gathered(now: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        got = rows.mapInPandas(lambda f: sums(f, now), "r int, i int, v double").groupBy("r", "i").agg(F.sum("v").alias("v")).toPandas()  # a number per run, cluster and coordinate
        return {r: g.sort_values("i")["v"].to_numpy().reshape(-1, p + 2) for r, g in got.groupby("r")}

    active = dict(centres)
    for _ in range(most):
        for r, t in gathered(active).items():
            new = np.where(t[:, p : p + 1] > 0, t[:, :p] / np.maximum(t[:, p : p + 1], 1), centres[r])  # an empty cluster stays
            done = float(((new - centres[r]) ** 2).sum()) <= least
            centres[r] = new
            if done:
                del active[r]
            else:
                active[r] = new
        if not active:
            break
    cost = {r: float(t[:, p + 1].sum()) for r, t in gathered(centres).items()}
    best = {}
    for k in ks:
        mine = [r for r, (q, _) in enumerate(runs) if q == k]
        low = min(cost[r] for r in mine)
        best[k] = centres[next(r for r in mine if cost[r] <= low * (1 + 1e-9))]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in batches(frames):
            for k, c in best.items():
                yield pd.DataFrame({"k": k, "id": ids, "label": _squares(x, c).argmin(1)})

    return ranked_by_size(cut(rows.mapInPandas(assign, "k int, id long, label int")), ["k"])


def ranked_by_size(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels renamed 0, 1, 2... by falling size, ties by smallest id."""
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("_n"), F.min("id").alias("_least"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("_n"), "_least")  # one row per label
    named = sizes.withColumn("_rank", F.row_number().over(order) - 1).select(*by, "label", "_rank")
    return labels.join(named, [*by, "label"]).drop("label").withColumnRenamed("_rank", "label")


def merge_small(labels: DataFrame, least: int) -> DataFrame:
    """Labels ranked by size; all labels of fewer than ``least`` members become one, numbered after the others."""
    ranked = ranked_by_size(labels)
    sizes = ranked.groupBy("label").agg(F.count("*").alias("_n"))
    big = sizes.agg(F.count(F.when(F.col("_n") >= least, 1)).alias("_big"))
    joined = ranked.join(sizes, "label").join(F.broadcast(big))
    return joined.withColumn("label", F.when(F.col("_n") >= least, F.col("label")).otherwise(F.col("_big")).cast("int")).drop("_n", "_big")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): connected components named by their smallest id; isolated vertices too.

    Alternating large-star and small-star steps: each step rewires edges to smaller neighbours, so the number of rounds grows with the logarithm of a path's length,
    and edges shrink to one per vertex. Every round is cut from its lineage in the shared folder.
    """
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    now = cut(both)
    last = None
    while True:
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("v"), F.col("a").alias("u"))
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(low, "v").where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b"))).distinct()
        now = written(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    named = now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return vertices.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def eps_components(points: DataFrame, grid: Sequence[float]) -> Iterator[tuple[float, float, int]]:
    """(q, ε, number of components of the graph of distances below ε) for each q of ``grid``; ε is the quantile q of the positive distances of (id, x)."""
    tree = cut(spanning_edges(points, "id", "x"))
    for q in grid:
        yield q, *_parts(points, tree, q)


def _parts(points: DataFrame, tree: DataFrame, q: float) -> tuple[float, int]:
    (eps,) = distance_quantiles(points, "id", "x", [q])
    links = tree.where(F.col("d") < eps).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return eps, components(points.where("x IS NOT NULL"), links).select("component").distinct().count()


def connected_eps(points: DataFrame, grid: Sequence[float]) -> tuple[float, float]:
    """(q, ε) of the smallest q of ``grid`` whose graph is one component, else of the largest q. A larger ε only joins components, so the grid is halved at each look."""
    tree, grid, known = cut(spanning_edges(points, "id", "x")), sorted(grid), {}
    low, high = 0, len(grid) - 1
    while low < high:
        mid = (low + high) // 2
        known[mid], parts = _parts(points, tree, grid[mid])
        low, high = (low, mid) if parts == 1 else (mid + 1, high)
    return grid[low], known[low] if low in known else distance_quantiles(points, "id", "x", [grid[low]])[0]


def louvain_labels(src: Sequence[int], dst: Sequence[int], nodes: Sequence[int], resolution: float, most: int = 50, weights: Sequence[float] | None = None) -> dict[int, int]:
    """Deterministic Louvain: nodes in order of id, moves of strictly positive gain to the best neighbour community (ties: the smaller), levels until nothing moves."""
    member = {v: v for v in nodes}
    weight: dict[int, dict[int, float]] = {v: defaultdict(float) for v in nodes}
    loops: dict[int, float] = defaultdict(float)
    for a, b, w in zip(src, dst, weights if weights is not None else repeat(1.0)):
        if a != b:
            weight[a][b] += w
            weight[b][a] += w
        elif weights is not None:  # what a contracted vertex holds inside
            loops[a] += w
    total = sum(sum(n.values()) for n in weight.values()) / 2 + sum(loops.values())
    if total == 0:
        return member
    for _ in range(most):
        own = {v: v for v in weight}
        degree = {v: sum(n.values()) + 2 * loops[v] for v, n in weight.items()}
        mass = dict(degree)
        moved_any = False
        for _ in range(most):
            moved = False
            for v in sorted(weight):
                here = own[v]
                to: dict[int, float] = defaultdict(float)
                for u, w in weight[v].items():
                    to[own[u]] += w
                mass[here] -= degree[v]
                stay = to.get(here, 0.0) - resolution * degree[v] * mass[here] / (2 * total)
                best, gain = here, stay
                for c in sorted(to):
                    got = to[c] - resolution * degree[v] * mass[c] / (2 * total)
                    if got > gain + 1e-12:
                        best, gain = c, got
                mass[best] += degree[v]
                if best != here:
                    own[v], moved, moved_any = best, True, True
            if not moved:
                break
        member = {v: own[c] for v, c in member.items()}
        if not moved_any:
            break
        merged: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(own.values())}
        inner: dict[int, float] = defaultdict(float)
        for v, near in weight.items():
            inner[own[v]] += loops[v]
            for u, w in near.items():
                if own[u] == own[v]:
                    inner[own[v]] += w / 2
                else:
                    merged[own[v]][own[u]] += w
        weight, loops = merged, inner
    return member


def louvain(vertices: DataFrame, edges: DataFrame, resolution: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, id, label): communities of each graph, a graph being one group (``by``) that fits a worker; labels ranked by size."""
    keys = list(by)
    typed = dict(vertices.dtypes)
    rows = vertices.select(*keys, F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select(*keys, F.col("src").cast("long"), F.col("dst").cast("long")))
    schema = ", ".join([*(f"{k} {typed[k]}" for k in keys), "id long, label int"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        edge = group[group["dst"].notna()]
        nodes = sorted(set(group.loc[group["dst"].isna(), "src"].astype("int64")))
        got = louvain_labels(edge["src"].astype("int64").tolist(), edge["dst"].astype("int64").tolist(), nodes, resolution)
        names = {c: i for i, c in enumerate(sorted(set(got.values())))}
        out = pd.DataFrame({"id": nodes, "label": [names[got[v]] for v in nodes]})
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    return ranked_by_size(rows.groupBy(*(keys or [F.lit(1).alias("_all")])).applyInPandas(solve, schema), keys)


def louvain_of_points(points: DataFrame, grid: Sequence[float], resolution: float = 0.5) -> DataFrame:
    """(id, label): communities of the neighbourhood graph of (id, x) under the ε of ``connected_eps``, as ``louvain`` gives for its edges; labels ranked by size.

    The points are one group that fits a worker. Their edges, a share of all pairs, are never listed.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        graph = near.Near(np.vstack(group["x"].to_list()))
        _, eps = near.connected_eps(graph, grid)
        return pd.DataFrame({"id": group["id"], "label": near.communities(graph, eps, resolution)})

    rows = points.where("x IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    return ranked_by_size(cut(rows.groupBy(F.lit(1).alias("_all")).applyInPandas(solve, "id long, label int")))


def modularity(labels: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of a labeling of a simple undirected graph."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    e = edges.join(a, "src").join(b, "dst")
    m = e.agg(F.count("*").alias("m"), F.sum((F.col("la") == F.col("lb")).cast("long")).alias("inside"))
    mass = e.select(F.explode(F.array("la", "lb")).alias("label")).groupBy("label").agg(F.count("*").alias("k")).agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    return m.join(F.broadcast(mass)).select((F.col("inside") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


SMALL_GRAPH = 200_000  # links of a contracted graph that one worker finishes, with the same gains, to save its jobs


def louvain_parallel(vertices: DataFrame, edges: DataFrame, resolution: float = 0.5, seed: int = 42) -> DataFrame:
    """(id, label): communities of one graph of any size; labels ranked by size.

    The same gains as the sequential method, but a seeded third of the vertices moves at a time by joins and aggregates. A level ends when no vertex wants to move, or when three rounds running
    each raise modularity by less than 0.002; then communities become the vertices of the next level; the search ends with a level that raises nothing. Both always come to an end, as
    modularity only rises. A contracted graph of at most SMALL_GRAPH links is finished in one task; larger ones go on by joins, however long. Every round is cut from its lineage. Isolated vertices stay alone.
    """
    sym = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()
    links = cut(sym.withColumn("w", F.lit(1.0)).unionByName(sym.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w"))))
    twice = links.agg(F.sum("w")).first()[0]
    member = vertices.select(F.col("id").cast("long").alias("id")).distinct().withColumn("label", F.col("id"))
    if not twice:
        return ranked_by_size(member)

    def quality(state: DataFrame) -> tuple[float, int]:
        a, b = state.select(F.col("id").alias("src"), F.col("com").alias("ca")), state.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
        inside = links.join(a, "src").join(b, "dst").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i"))
        mass = state.groupBy("com").agg(F.sum("deg").alias("m"), F.sum(F.col("wants").cast("long")).alias("w")).agg(F.sum(F.col("m") * F.col("m")).alias("m"), F.sum("w").alias("w"))
        r = inside.join(F.broadcast(mass)).first()  # one row each
        return r.i / twice - resolution * r.m / (twice * twice), r.w

    level = 0
    while True:
        state = cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")).withColumns({"com": F.col("id"), "wants": F.lit(True)}))
        start = now = quality(state)[0]
        idle = r = 0
        while idle < 3:
            totals = state.groupBy(F.col("com").alias("to")).agg(F.sum("deg").alias("tot"))
            to = links.where("src <> dst").join(state.select(F.col("id").alias("dst"), F.col("com").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("k"))
            own = state.select("id", F.col("com").alias("to"), F.lit(0.0).alias("k"))
            every = to.unionByName(own).groupBy("id", "to").agg(F.sum("k").alias("k")).join(state, "id").join(totals, "to")
            rest = F.col("tot") - F.when(F.col("to") == F.col("com"), F.col("deg")).otherwise(0.0)
            gain = every.withColumn("g", F.round(F.col("k") - resolution * F.col("deg") * rest / twice, 9))
            best = gain.groupBy("id", "com", "deg").agg(F.max(F.struct("g", (-F.col("to")).alias("t"))).alias("b"), F.max(F.when(F.col("to") == F.col("com"), F.col("g"))).alias("stay"))
            turn = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit(r), "id"), F.lit(3)) == 0
            r += 1
            wants = F.col("b.g") > F.col("stay")
            moved = written(best.select("id", "deg", F.when(turn & wants, -F.col("b.t")).otherwise(F.col("com")).alias("com"), wants.alias("wants")))
            got, wanting = quality(moved)
            if not wanting:
                break
            idle = 0 if got > now + 2e-3 else idle + 1
            if got > now + 1e-9:
                state, now = moved, got
        if now <= start + 1e-9:
            break
        names = state.select(F.col("id").alias("label"), F.col("com").alias("new"))
        member = cut(member.join(names, "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        a, b = state.select(F.col("id").alias("src"), F.col("com").alias("ca")), state.select(F.col("id").alias("dst"), F.col("com").alias("cb"))
        links = cut(links.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")))
        level += 1
        if links.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
            break

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(group["src"]))
        half = group[group["src"] <= group["dst"]]
        w = half["w"].where(half["src"] != half["dst"], half["w"] / 2)
        got = louvain_labels(half["src"].tolist(), half["dst"].tolist(), nodes, resolution, weights=w.tolist())
        return pd.DataFrame({"label": nodes, "new": [got[v] for v in nodes]})

    if level and links.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
        names = links.groupBy(F.lit(1).alias("_all")).applyInPandas(finish, "label long, new long")
        member = member.join(names, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
    return ranked_by_size(cut(member))

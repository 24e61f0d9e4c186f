"""Column-wise standardisation, projections and block-wise distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.session import cut

BLOCK = 512  # rows of one block of a block-wise pair computation


def zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns as (x - mean) / population deviation, over all rows or within ``by``; a constant column becomes 0. NULL stays NULL.

    One aggregate and one join with its few rows; no window, so no single task sees all rows.
    """
    stats = [f(c).alias(f"_{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if by:
        joined = df.join(df.groupBy(*by).agg(*stats), list(by))
    else:
        joined = df.join(F.broadcast(df.agg(*stats)))  # one row
    scaled = {c: F.when(F.col(f"_s_{i}") > 0, (F.col(c) - F.col(f"_m_{i}")) / F.when(F.col(f"_s_{i}") > 0, F.col(f"_s_{i}"))).when(F.col(c).isNotNull(), 0.0) for i, c in enumerate(columns)}
    return joined.withColumns(scaled).drop(*[f"_{n}_{i}" for i in range(len(columns)) for n in "ms"])


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median", weight: str | None = None, most: int = 1_000_000, bins: int = 4096) -> DataFrame:
    """(``by``, name): the exact midpoint median of ``value`` within groups, of any size; ``weight`` counts a row as so many.

    While a group has more than ``most`` rows between its bounds, its histogram of ``bins`` equal steps, summed on the map side, narrows the bounds to the steps that hold the middle
    ranks. Then the few distinct values between the bounds give them exactly, so no task ever holds a group's values. NULL and NaN count as no value, a NULL weight or one below 1 as no row; a group
    without values has no row.
    """
    keys = list(by)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (w > 0)).select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w"))
    near = lambda stats: rows.join(stats, keys) if keys else rows.join(F.broadcast(stats))  # noqa: E731  # one row
    stats = cut(rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).cast("long").alias("_below")).where("_n > 0"))
    first, last = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    while not stats.where((F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        place = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1))).otherwise(0)
        steps = near(stats).where("_v BETWEEN _lo AND _hi").groupBy(*keys, "_n", "_below", place.alias("_bin")).agg(F.sum("_w").alias("_k"), F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        path = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows a group
        upto = steps.withColumn("_upto", F.col("_below") + F.sum("_k").over(path))
        held = upto.where((F.col("_upto") > first) & (F.col("_upto") - F.col("_k") <= last))
        stats = cut(held.groupBy(*keys, "_n").agg(F.sum("_c").alias("_rows"), F.min("_a").alias("_lo"), F.max("_b").alias("_hi"), F.min(F.col("_upto") - F.col("_k")).alias("_below")).select(*keys, "_n", "_rows", "_lo", "_hi", "_below"))
    inside = near(stats).where("_v BETWEEN _lo AND _hi").groupBy(*keys, "_v", "_n", "_below").agg(F.sum("_w").alias("_k"))
    path = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # at most ``most`` rows a group
    upto = inside.withColumn("_upto", F.col("_below") + F.sum("_k").over(path))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    return upto.groupBy(*keys).agg(((at(first) + at(last)) / 2).alias(name))


def binarize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as 1 where positive, else 0; NULL and NaN are not positive."""
    return df.withColumns({c: F.coalesce((F.nanvl(F.col(c), F.lit(0.0)) > 0).cast("int"), F.lit(0)) for c in columns})


def dot(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """Sum of columns times literal weights."""
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        out = out + F.col(c) * float(w)
    return out


def row_normalised(columns: Sequence[str]) -> dict[str, Column]:
    """Columns divided by the row's Euclidean norm plus 1e-12."""
    norm = F.lit(0.0)
    for c in columns:
        norm = norm + F.col(c) * F.col(c)
    return {c: F.col(c) / (F.sqrt(norm) + 1e-12) for c in columns}


def block_size(df: DataFrame, most: int = 2048) -> int:
    """Rows of a block for sums over pairs: a row leaves each pair of blocks a point is in, so many points take blocks of up to ``most`` rows, whose distances are 32 MB."""
    return min(most, max(BLOCK, df.count() // 24))


def blocks(df: DataFrame, key: str, vector: str, label: str | None = None, size: int = BLOCK) -> DataFrame:
    """Rows (key LONG, vector ARRAY, label) gathered by hash into blocks of about ``size``: (block, last, ids, xs, labels). Rows without vector are left out."""
    rows = df.where(F.col(vector).isNotNull())
    n = rows.count()
    many = max(1, -(-n // size))
    one = F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), (F.col(label).cast("int") if label else F.lit(0)).alias("label"))
    packed = rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(many)).cast("int").alias("block"), one.alias("r")).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select("block", F.lit(many - 1).alias("last"), F.col("r.id").alias("ids"), F.flatten("r.x").alias("xs"), F.col("r.label").alias("labels"))


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame]


def over_pairs(packed: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """``kernel(ids_a, labels_a, ids_b, labels_b, distances, same)`` over every pair of blocks a <= b; its frames are united.

    Each block travels once to each later one; distances exist only as one matrix of two blocks at a time, and only what the kernel returns leaves the task.
    """
    left = packed.select("ids", "xs", "labels", F.explode(F.sequence("block", "last")).alias("other"), F.col("block"))
    right = packed.select(F.col("block").alias("other"), F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"), F.col("labels").alias("labels_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b = np.asarray(r.ids), np.asarray(r.ids_b)
                x, y = np.asarray(r.xs).reshape(len(a), -1), np.asarray(r.xs_b).reshape(len(b), -1)
                square = np.zeros((len(a), len(b)))
                for d in range(x.shape[1]):
                    step = x[:, d][:, None] - y[:, d][None, :]
                    square += step * step
                yield kernel(a, np.asarray(r.labels), b, np.asarray(r.labels_b), np.sqrt(square), r.block == r.other)

    return left.join(right, "other").select("ids", "xs", "labels", "block", "other", "ids_b", "xs_b", "labels_b").mapInPandas(run, schema)


def _ordered(a: np.ndarray, b: np.ndarray, d: np.ndarray, same: bool, keep: np.ndarray) -> pd.DataFrame:
    if same:
        keep = keep & (a[:, None] < b[None, :])
    i, j = np.nonzero(keep)
    return pd.DataFrame({"i": np.minimum(a[i], b[j]), "j": np.maximum(a[i], b[j]), "d": d[i, j]})


def pairwise_distances(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, d) for i < j: Euclidean distance of every pair, which is this operator's result; block by block."""
    return over_pairs(blocks(df, key, vector), lambda a, la, b, lb, d, same: _ordered(a, b, d, same, np.ones_like(d, dtype=bool)), "i long, j long, d double")


def edges_below(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """(i, j, d) for i < j with d < eps: the edges of the neighbourhood graph. Other pairs never leave their block."""
    return over_pairs(blocks(df, key, vector), lambda a, la, b, lb, d, same: _ordered(a, b, d, same, d < eps), "i long, j long, d double")


def spanning_edges(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, d) for i < j: of every pair of blocks a minimum spanning forest. For every ε the pairs kept with d < ε connect what all pairs with d < ε connect, with far fewer rows."""

    def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
        d = np.nan_to_num(d, nan=np.inf, posinf=np.inf)
        ids, far = (a, 0) if same else (np.concatenate([a, b]), len(a))
        best, via, open_ = np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
        out, v = [], 0
        for _ in range(len(ids)):  # Prim's steps
            open_[v] = False
            to, row = (slice(0, None), d[v]) if same else (slice(far, None), d[v]) if v < far else (slice(0, far), d[:, v - far])
            nearer = row < best[to]
            best[to] = np.where(nearer, row, best[to])
            via[to] = np.where(nearer, v, via[to])
            left = np.where(open_, best, np.inf)
            v = int(left.argmin())
            if not open_[v] or left[v] == np.inf:
                if not open_.any():
                    break
                v = int(open_.argmax())
                continue
            out.append((min(ids[v], ids[via[v]]), max(ids[v], ids[via[v]]), left[v]))
        return pd.DataFrame(out, columns=["i", "j", "d"])

    return over_pairs(blocks(df, key, vector), kernel, "i long, j long, d double")


def distance_quantiles(df: DataFrame, key: str, vector: str, qs: Sequence[float], bins: int = 4096, small: int = 200_000) -> list[float]:
    """Exact linearly interpolated quantiles of the positive distances, each pair counted twice.

    Histograms of bounded size are summed over the blocks and refined around the wanted ranks until what is left there is short enough to
    look at value by value; the pairs themselves are never shuffled.
    """
    packed = cut(blocks(df, key, vector))

    def histogram(lo: float, hi: float) -> pd.DataFrame:
        def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
            v = d[np.triu_indices(len(a), 1)] if same else d.ravel()
            v = v[(v > 0) & (v >= lo) & (v <= hi)]
            at = np.minimum(((v - lo) / (hi - lo) * bins).astype(np.int64), bins - 1) if hi > lo else np.zeros(len(v), np.int64)
            n = np.bincount(at, minlength=1)
            return pd.DataFrame({"bin": np.flatnonzero(n), "n": n[n > 0]})

        return over_pairs(packed, kernel, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()

    def values(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
            v = d[np.triu_indices(len(a), 1)] if same else d.ravel()
            u, n = np.unique(v[(v > 0) & (v >= lo) & (v <= hi)], return_counts=True)
            return pd.DataFrame({"v": u, "n": n})

        got = over_pairs(packed, kernel, "v double, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").toPandas()
        return got["v"].to_numpy(), got["n"].cumsum().to_numpy()  # different distances only, however many pairs have them

    def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
        v = d[np.triu_indices(len(a), 1)] if same else d.ravel()
        v = v[v > 0]
        return pd.DataFrame({"n": [len(v)], "hi": [v.max() if len(v) else 0.0]})

    top = over_pairs(packed, kernel, "n long, hi double").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).first()
    if not top.n:
        return [float("nan")] * len(qs)

    looked: dict[tuple[float, float], tuple[np.ndarray, np.ndarray]] = {}

    def ranked(rank: int) -> float:
        lo, hi, before, inside = 0.0, float(top.hi), 0, int(top.n)
        while inside > small and hi > lo:
            h = histogram(lo, hi)
            at = int(np.searchsorted(before + h["n"].cumsum().to_numpy(), rank, side="right"))
            before += int(h["n"].to_numpy()[:at].sum())
            inside = int(h["n"].iloc[at])
            step, b = (hi - lo) / bins, int(h["bin"].iloc[at])
            new = (lo + b * step, lo + (b + 1) * step if b < bins - 1 else hi)
            if new == (lo, hi):
                break
            lo, hi = new
            before = _below(lo)
        if (lo, hi) not in looked:
            looked[lo, hi] = values(lo, hi)
        distances, upto = looked[lo, hi]
        return float(distances[np.searchsorted(upto, rank - before, side="right")])

    def _below(lo: float) -> int:
        def kernel(a, la, b, lb, d, same):  # noqa: ANN001, ANN202
            v = d[np.triu_indices(len(a), 1)] if same else d.ravel()
            return pd.DataFrame({"n": [int(((v > 0) & (v < lo)).sum())]})

        return int(over_pairs(packed, kernel, "n long").agg(F.sum("n")).first()[0])

    wanted = {q: q * (2 * top.n - 1) for q in qs}
    ends = {q: (int(np.floor(at)) // 2, min(int(np.floor(at)) + 1, 2 * top.n - 1) // 2) for q, at in wanted.items()}
    value = {r: ranked(r) for r in sorted({r for pair in ends.values() for r in pair})}
    return [float(value[ends[q][0]] + (value[ends[q][1]] - value[ends[q][0]]) * (wanted[q] - np.floor(wanted[q]))) for q in qs]

"""Pseudo-likelihood couplings of binary features and their spectrum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, most: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Weights of the L2-penalised logistic model: minimise |w|^2 / 2 + c * sum of weighted log-losses, free intercept left out of the result. Damped Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.ones(design.shape[1])
    penalty[-1] = 0.0
    w = np.zeros(design.shape[1])

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return 0.5 * float(penalty @ (v * v)) + c * float(weight @ (np.logaddexp(0, z) - y * z))

    now = loss(w)
    for _ in range(most):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = penalty * w + c * design.T @ (weight * (p - y))
        if np.abs(slope).max() < tol * max(1.0, c * weight.sum()):
            break
        bend = np.diag(penalty) + c * (design * (weight * p * (1 - p))[:, None]).T @ design
        bend[-1, -1] += 1e-12
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now = loss(w)
    return w[:-1]


def coupling_matrix(patterns: np.ndarray, weight: np.ndarray, c: float) -> np.ndarray:
    """Symmetric zero-diagonal J of weighted binary rows; the row of a constant column stays 0 before averaging with its mirror."""
    p = patterns.shape[1]
    out = np.zeros((p, p))
    for j in range(p):
        y = patterns[:, j]
        mass = float(weight @ y)
        if mass == 0 or mass == float(weight.sum()):
            continue
        out[j, np.arange(p) != j] = logistic(np.delete(patterns, j, axis=1), y, weight, c)
    out = (out + out.T) / 2
    np.fill_diagonal(out, 0)
    return out


def patterns(binary: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct binary rows with their number (``by``, bits STRING, n). The couplings depend on nothing else, and there are at most 2^p of them however many rows."""
    bits = F.concat(*[F.col(c).cast("int").cast("string") for c in columns])
    return binary.groupBy(*by, bits.alias("bits")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("n"))


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    group = group.sort_values("bits")
    return np.array([[int(b) for b in s] for s in group["bits"]], dtype=float), group["n"].to_numpy(dtype=float)


def couplings(binary: DataFrame, columns: Sequence[str], c: float = 0.2, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(``by``, i, j, w): the coupling matrix of every group, i and j from 0. ``by`` may hold ``c`` itself for a sweep."""
    keys = list(by)
    counted = patterns(binary, columns, keys, weight)
    typed = dict(binary.dtypes)
    schema = ", ".join([*(f"{k} {typed[k]}" for k in keys), "i int", "j int", "w double"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, n = _matrix(group)
        got = coupling_matrix(x, n, float(group["c"].iloc[0]) if "c" in keys else c)
        p = len(columns)
        out = pd.DataFrame({"i": np.repeat(np.arange(p), p), "j": np.tile(np.arange(p), p), "w": got.ravel()})
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    return counted.groupBy(*(keys or [F.lit(1).alias("_all")])).applyInPandas(fit, schema)


def couplings_by_ml(binary: DataFrame, columns: Sequence[str], c: float = 0.2, most: int = 3000, tol: float = 1e-6) -> np.ndarray:
    """The same J from p distributed logistic regressions over the weighted patterns, for very many features."""
    counted = patterns(binary, columns)
    n = counted.agg(F.sum("n")).first()[0]
    wide = counted.select("n", *[F.substring("bits", i + 1, 1).cast("double").alias(f"x{i}") for i in range(len(columns))]).cache()
    p = len(columns)
    out = np.zeros((p, p))
    for j in range(p):
        mass = wide.agg(F.sum(F.col(f"x{j}") * F.col("n"))).first()[0]
        if mass in (0, n):
            continue
        others = [f"x{i}" for i in range(p) if i != j]
        rows = VectorAssembler(inputCols=others, outputCol="f").transform(wide)
        model = LogisticRegression(featuresCol="f", labelCol=f"x{j}", weightCol="n", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=most, tol=tol).fit(rows)
        out[j, np.arange(p) != j] = model.coefficients.toArray()
    wide.unpersist()
    out = (out + out.T) / 2
    np.fill_diagonal(out, 0)
    return out


def spectrum(j: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, mode, lambda, loadings ARRAY): eigenvalues from the largest down, modes from 1; of each vector the entry largest in size (the first of equals) is positive.

    A group is one p x p matrix.
    """
    keys = list(by)
    typed = dict(j.dtypes)
    schema = ", ".join([*(f"{k} {typed[k]}" for k in keys), "mode int", "`lambda` double", "loadings array<double>"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        p = int(group["i"].max()) + 1
        m = np.zeros((p, p))
        m[group["i"], group["j"]] = group["w"]
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        for k in range(p):
            top = np.argmax(np.round(np.abs(vectors[:, k]), 12))
            if vectors[top, k] < 0:
                vectors[:, k] *= -1
        out = pd.DataFrame({"mode": np.arange(1, p + 1), "lambda": values, "loadings": list(vectors.T)})
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    return j.groupBy(*(keys or [F.lit(1).alias("_all")])).applyInPandas(solve, schema)


def spectral_metrics(modes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, lambda_max, lambda_2, pr_plus, frustration, n_plus, n_minus, top_share) of eigenvalues (mode, lambda)."""
    v = F.col("lambda")
    pos = F.when(v > 0, v)
    g = modes.groupBy(*by).agg(
        F.max(v).alias("lambda_max"),
        F.max(F.when(F.col("mode") == 2, v)).alias("lambda_2"),
        F.sum(pos).alias("_s"),
        F.sum(pos * pos).alias("_q"),
        F.count(F.when(v < 0, 1)).alias("n_minus"),
        F.count(pos).alias("n_plus"),
        F.count("*").alias("_p"),
    )
    return g.select(*by, "lambda_max", "lambda_2", F.coalesce(F.try_divide(F.col("_s") * F.col("_s"), F.col("_q")), F.lit(0.0)).alias("pr_plus"), (F.col("n_minus") / F.col("_p")).alias("frustration"), "n_plus", "n_minus", F.try_divide("lambda_max", "_s").alias("top_share"))


def loadings_long(modes: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(``by``, mode, feature, loading)."""
    names = F.array(*map(F.lit, columns))
    return modes.select(*by, "mode", F.posexplode("loadings").alias("_k", "loading")).select(*by, "mode", F.element_at(names, F.col("_k") + 1).alias("feature"), "loading")


def top_loadings(long: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features of each mode with the largest loadings in size; ties by name."""
    order = Window.partitionBy("mode").orderBy(F.desc(F.abs("loading")), "feature")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def coupling_strength(j: DataFrame, q: float = 0.92, threshold: float = 0.2) -> DataFrame:
    """(q_abs, share_strong): quantile of |w| over the whole matrix, and the share above the threshold."""
    size = F.abs("w")
    return j.agg(F.percentile(size, F.lit(q)).alias("q_abs"), F.avg((size > threshold).cast("double")).alias("share_strong"))

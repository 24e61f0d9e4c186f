"""Typology over sliding windows: window spectra, communities, trajectories and switches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.config import Params
from panelmodes.operators import linalg, near, plm, validity


def window_modes(features: DataFrame, columns: Sequence[str], p: Params) -> DataFrame:
    """(window, mode, lambda, loadings) of every window at once; features are standardised within their window."""
    z = linalg.zscore(features, columns, ["window"])
    return plm.spectrum(plm.couplings(linalg.binarize(z, columns), columns, p.c_reg, ["window"]), ["window"])


def communities_of_window(group: pd.DataFrame, p: Params) -> pd.DataFrame:
    """(window, entity, label) of one window's rows (window, entity, x, v): ``v`` holds the leading modes' loadings one after the other. Memory grows with the entities only."""
    group = group.sort_values("entity", ignore_index=True)
    x = np.vstack(group["x"].to_list())
    u = x @ np.asarray(group["v"].iloc[0]).reshape(-1, x.shape[1]).T
    graph = near.Near(u)
    got = near.communities(graph, graph.quantile(p.window_eps), p.resolution)
    _, first, lab, sizes = np.unique(got, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -sizes))
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.minimum(np.arange(len(order)), int((sizes >= p.min_community).sum()))
    return pd.DataFrame({"window": group["window"].iloc[0], "entity": group["entity"], "label": name[lab]})


def window_communities(features: DataFrame, modes: DataFrame, columns: Sequence[str], p: Params) -> DataFrame:
    """(window, entity, label): communities of each window's neighbourhood graph on the leading modes.

    A window is one group and one task, whose entities have to fit a worker; its graph, quadratic by definition, is never stored. Communities are ranked by size; those below
    the least size become one label after the others.
    """
    k = p.graph_modes
    z = linalg.zscore(features, columns, ["window"])
    lead = modes.where(F.col("mode") <= k).groupBy("window").agg(F.flatten(F.sort_array(F.collect_list(F.struct("mode", "loadings")))["loadings"]).alias("v"))
    rows = z.select("window", F.col("entity").cast("string").alias("entity"), F.array(*[F.col(c) for c in columns]).alias("x")).join(lead, "window")
    spread = rows.repartitionByRange(max(1, lead.count()), "window")  # else small windows, which are long work, are put into one task
    return spread.groupBy("window").applyInPandas(lambda group: communities_of_window(group, p), "window int, entity string, label int")


def window_summary(features: DataFrame, modes: DataFrame, labels: DataFrame) -> DataFrame:
    """(window, n, pr_plus, frustration, n_communities, top_evals ARRAY of 5)."""
    n = features.groupBy("window").agg(F.count("*").alias("n"))
    top = modes.where("mode <= 5").groupBy("window").agg(F.sort_array(F.collect_list("lambda"), asc=False).alias("top_evals"))
    coms = labels.groupBy("window").agg(F.count_distinct("label").alias("n_communities"))
    return n.join(plm.spectral_metrics(modes, ["window"]), "window").join(coms, "window").join(top, "window").select("window", "n", "pr_plus", "frustration", "n_communities", "top_evals")


def switch_counts(labels: DataFrame) -> DataFrame:
    """(entity, n_switches): how often an entity's label differs from the one in its window before."""
    path = Window.partitionBy("entity").orderBy("window")
    steps = labels.withColumn("_prev", F.lag("label").over(path))
    return steps.groupBy("entity").agg(F.count(F.when(F.col("_prev") != F.col("label"), 1)).alias("n_switches"))


def switch_events(labels: DataFrame) -> DataFrame:
    """(entity, from_window, to_window, from_label, to_label) of every change."""
    path = Window.partitionBy("entity").orderBy("window")
    steps = labels.withColumns({"from_window": F.lag("window").over(path), "from_label": F.lag("label").over(path)})
    return steps.where(F.col("from_label") != F.col("label")).select("entity", "from_window", F.col("window").alias("to_window"), "from_label", F.col("label").alias("to_label"))


def events_with_metrics(events: DataFrame, windows: DataFrame, ari: DataFrame) -> DataFrame:
    """``events`` (entity, from_window, to_window, from_label, to_label) with the metrics of both windows and the agreement between them.

    ``windows`` is one row per window with pr_plus, frustration and n_communities, ``ari`` is (from_window, to_window, ari); an event whose window or pair isn't there keeps NULLs.
    Both are joined by window, a few rows each.
    """
    metrics = ("pr_plus", "frustration", "n_communities")
    side = lambda s: windows.select(F.col("window").alias(f"{s}_window"), *[F.col(m).alias(f"{m}_{s}") for m in metrics])
    out = events.join(side("from"), "from_window", "left").join(side("to"), "to_window", "left").join(ari.select("from_window", "to_window", "ari"), ["from_window", "to_window"], "left")
    return out.select("entity", "from_window", "to_window", "from_label", "to_label", *[f"{m}_{s}" for m in metrics for s in ("from", "to")], "ari")


def consecutive_ari(labels: DataFrame, least: int = 10) -> DataFrame:
    """(from_window, to_window, n, ari) of neighbouring windows with at least ``least`` common entities."""
    nxt = labels.select("entity", (F.col("window") - 1).alias("window"), F.col("label").alias("next"))
    table = validity.contingency(labels.join(nxt, ["entity", "window"]), "label", "next", ["window"])
    ari = validity.adjusted_rand(table, ["window"]).where(F.col("n") >= least)
    return ari.select(F.col("window").alias("from_window"), (F.col("window") + 1).alias("to_window"), "n", "ari")

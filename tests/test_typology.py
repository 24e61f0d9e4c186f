"""The typology's operators against stored results, NumPy and brute force on small data."""

import datetime as dt
import io
import itertools
import time
import tracemalloc
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmodes import session
from panelmodes.config import MONTHLY, Params
from panelmodes.functions import markup, names
from panelmodes.operators import audit, cluster, dynamics, linalg, near, panel, plm, stability, validity
from panelmodes.sources import archives, labels
from panelmodes.streaming import panel_stream

# 24 months of one entity by category, and the features they must give.
SERIES = {
    "Здоровье": "1271 1371 1416 1319 1089 1166 1110 1242 1264 1211 1280 1266 1221 1413 1513 1390 1333 1253 1386 1223 1458 1575 1506 1537",
    "Маркетплейсы": "2154 2376 2810 2496 2712 2672 2928 2953 3133 3603 4657 5298 3374 3976 4422 4061 3989 4532 4519 4851 4591 5342 5983 7187",
    "Общественное питание": "923 904 1036 1077 1196 1206 1335 1340 1235 1214 1254 1246 1180 1270 1401 1335 1453 1616 1599 1455 1492 1471 1333 1384",
    "Продовольствие": "10910 11230 12453 11643 12370 12426 12821 12493 11808 11754 11855 14279 11732 12115 13408 12930 14079 13994 14052 13098 12361 13347 13206 15344",
    "Транспорт": "1744 1606 1703 1735 1892 1936 2155 2216 2033 2023 1928 2048 1781 1780 1913 1996 2103 2259 2298 2125 2176 2178 1944 2091",
    "Все категории": "24929 26273 28492 26482 27955 27456 28459 28417 26951 28709 29149 33495 26776 29527 31830 30737 31699 32950 32509 32357 30274 33903 34700 38968",
}

FEATURE_ROW = {
    "share_health": 0.0435181109701473,
    "share_marketplace": 0.1471325376071252,
    "share_food": 0.0439867436501566,
    "share_grocery": 0.4133961629081117,
    "share_transport": 0.0638065401444735,
    "log_total": 10.379312745217486,
    "growth_health": 0.1201599466844385,
    "growth_marketplace": 0.5036780270956814,
    "growth_food": 0.2164542460260633,
    "growth_grocery": 0.0932882321523945,
    "growth_transport": 0.0705938572483599,
    "cv_health": 0.0841453701858762,
    "cv_marketplace": 0.2075953288184765,
    "cv_food": 0.0857580218092328,
    "cv_grocery": 0.0712225944545467,
    "cv_transport": 0.0802063451748103,
}

# 17 eigenvalues of a stored coupling matrix.
EIGENVALUES = "5.540522477719779 2.160546105524472 1.753556478152268 0.9076524838088864 0.879944249925166 0.4481410054369035 0.07511319116961079 -0.09028706343720971 -0.1991640490464621 -0.6331461063109509 -0.8660491098005056 -1.234491131198289 -1.354082324298701 -1.478671960449115 -1.661831551272095 -1.909029189359186 -2.33872350656459"

SHORT = {"Здоровье": "health", "Маркетплейсы": "marketplace", "Общественное питание": "food", "Продовольствие": "grocery", "Транспорт": "transport", "Все категории": "total"}
CATS = ["health", "marketplace", "food", "grocery", "transport"]


def months(n=24):
    return [dt.date(2023 + i // 12, i % 12 + 1, 1) for i in range(n)]


def golden_panel(spark, drop=()):
    rows = [("e", m, SHORT[c], float(v)) for c, line in SERIES.items() for m, v in zip(months(), line.split()) if (SHORT[c], m) not in drop]
    return spark.createDataFrame(rows, "entity string, period date, category string, value double")


def test_stored_series_gives_stored_features(spark):
    wide = panel.pivot_mean(golden_panel(spark), ["entity", "period"], ["total", *CATS])
    row = panel.static_features(panel.keep_long_series(wide, 18), "total", CATS, MONTHLY).first()
    for k, v in FEATURE_ROW.items():
        assert row[k] == pytest.approx(v, abs=1e-12), k


def test_missing_month_zeroes_cv_but_not_means(spark):
    gone = {("food", dt.date(2024, 3, 1))}
    row = panel.static_features(panel.pivot_mean(golden_panel(spark, gone), ["entity", "period"], ["total", *CATS]), "total", CATS, MONTHLY).first()
    assert row.cv_food == 0.0 and row.share_food > 0 and row.cv_health > 0


def test_short_series_and_zero_totals_drop_out(spark):
    wide = panel.pivot_mean(golden_panel(spark), ["entity", "period"], ["total", *CATS])
    assert panel.keep_long_series(wide, 25).count() == 0
    zero = wide.withColumn("total", F.lit(0.0))
    assert panel.static_features(zero, "total", CATS, MONTHLY).count() == 0
    late = wide.where("period >= '2023-09-01'")
    assert panel.static_features(late, "total", CATS, MONTHLY).first().growth_food == 0.0
    assert panel.static_features(wide.limit(0), "total", CATS, MONTHLY).count() == 0


def test_index_ratio(spark):
    rows = [("a", dt.date(2024, 3, 1), 10.0), ("a", dt.date(2024, 9, 1), 20.0), ("a", dt.date(2024, 9, 1), 22.0), ("b", dt.date(2024, 3, 1), 5.0)]
    df = spark.createDataFrame(rows, "entity string, period date, value double")
    got = {r.entity: r.mob_logratio for r in panel.two_period_logratio(df).collect()}
    assert got["a"] == pytest.approx(np.log(22) - np.log(11)) and got["b"] is None
    three = df.unionByName(spark.createDataFrame([("c", dt.date(2025, 1, 1), 1.0)], df.schema))
    assert {r.mob_logratio for r in panel.two_period_logratio(three).collect()} == {0.0}


def test_windows(spark):
    wide = panel.pivot_mean(golden_panel(spark), ["entity", "period"], ["total", *CATS])
    w = panel.assign_windows(wide, 6).select("window", "window_start", "window_end").distinct().orderBy("window").collect()
    assert len(w) == 19 and w[0].window_end == dt.date(2023, 6, 1) and w[-1].window_start == dt.date(2024, 7, 1)
    assert panel.assign_windows(wide.where("period < '2023-04-01'"), 6).count() == 0
    f = panel.window_features(panel.assign_windows(wide, 6), "total", CATS, Params(window_min_entities=1))
    row = f.where("window = 1").first()
    v = {SHORT[c]: np.array([float(x) for x in line.split()])[:6] for c, line in SERIES.items()}
    s = v["food"] / v["total"]
    assert row.share_food == pytest.approx(s.mean()) and row.cv_share_food == pytest.approx(s.std() / s.mean())
    assert row.growth_share_food == pytest.approx((s[-3:].mean() - s[:3].mean()) / (s[:3].mean() + 1e-9))


def test_spectral_metrics_of_stored_eigenvalues(spark):
    v = [float(x) for x in EIGENVALUES.split()]
    got = plm.spectral_metrics(spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "mode int, `lambda` double")).first()
    assert got.pr_plus == pytest.approx(3.4396002709, abs=1e-8) and got.frustration == pytest.approx(10 / 17)
    assert got.top_share == pytest.approx(0.470913584934, abs=1e-9) and got.n_plus == 7 and got.lambda_2 == v[1]
    none = plm.spectral_metrics(spark.createDataFrame([(1, -1.0), (2, 0.0)], "mode int, `lambda` double")).first()
    assert none.pr_plus == 0.0 and none.frustration == 0.5


@pytest.mark.parametrize(
    "raw, want",
    [("Вологодский муниципальный округ", "вологодский"), (" Городской Округ  г. Коряжма ", "коряжма"), ("городской  округ А", "ской а"), ("внутригородская территория города федерального значения город Зеленогорск", "зеленогорск"), ("Белгородский район", "белский"), ("  А Б ", "а б"), ("", ""), (None, None)],
)
def test_territory_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(names.territory_name(F.col("s"))).first()[0] == want


def test_regions_codes_and_casts(spark):
    rows = [("Республика Коми", "49\u00a0606 000", "1.5"), ("Ямало-Ненецкий АО", "49x", "x"), ("Тверская область", None, None), (None, "", " 7 ")]
    got = spark.createDataFrame(rows, "t string, c string, v string").select(names.first_key(F.col("t")), names.looks_like_region(F.col("t")), names.digits_or_null(F.col("c")), names.number_or_null(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("Коми", True, "49606000", 1.5), ("НАО", False, None, None), (None, True, None, None), (None, False, None, 7.0)]


def test_zscore_and_binarize(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 2.0, 5.0, 1.0), (3, 4.0, 5.0, float("nan"))], "entity int, a double, b double, c double")
    got = linalg.zscore(df, ["a", "b"]).orderBy("entity").collect()
    a = np.array([1.0, 2, 4])
    assert np.allclose([r.a for r in got], (a - a.mean()) / a.std()) and [r.b for r in got] == [0.0, 0.0, 0.0]
    assert [tuple(r)[1:] for r in linalg.binarize(df, ["a", "b", "c"]).orderBy("entity").collect()] == [(1, 1, 0), (1, 1, 1), (1, 1, 0)]


def binary_table(spark, n=160, p=6, seed=2):
    x = (np.random.default_rng(seed).normal(size=(n, p)) @ np.random.default_rng(seed + 1).normal(size=(p, p)) > 0).astype(int)
    cols = [f"f{i}" for i in range(p)]
    return x, cols, spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "entity long, " + ", ".join(f"{c} int" for c in cols))


def test_couplings_reach_the_optimum_and_both_ways_agree(spark):
    x, cols, df = binary_table(spark)
    got = np.zeros((6, 6))
    for r in plm.couplings(df, cols, 0.2).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, got.T) and np.allclose(np.diag(got), 0)
    raw = plm.logistic(np.delete(x, 0, 1).astype(float), x[:, 0].astype(float), np.ones(len(x)), 0.2)

    def loss(w, b):
        z = np.delete(x, 0, 1) @ w + b
        return 0.5 * w @ w + 0.2 * np.sum(np.logaddexp(0, z) - x[:, 0] * z)

    grid = np.linspace(-3, 3, 2001)
    base = min(loss(raw, b) for b in grid)
    for k, e in itertools.product(range(5), (-0.01, 0.01)):
        w = raw.copy()
        w[k] += e
        assert min(loss(w, b) for b in grid) > base - 1e-6
    assert np.allclose(plm.couplings_by_ml(df, cols, 0.2), got, atol=1e-4)


def test_constant_column_has_no_coupling(spark):
    _, cols, df = binary_table(spark)
    j = plm.couplings(df.withColumn("f0", F.lit(1)), cols, 0.2)
    assert j.where("(i = 0 OR j = 0)").agg(F.sum(F.abs("w"))).first()[0] == pytest.approx(0, abs=1e-8)


def test_spectrum(spark):
    _, cols, df = binary_table(spark)
    modes = plm.spectrum(plm.couplings(df, cols, 0.2)).orderBy("mode").collect()
    v = [r["lambda"] for r in modes]
    assert v == sorted(v, reverse=True) and sum(v) == pytest.approx(0, abs=1e-9)
    for r in modes:
        assert np.linalg.norm(r.loadings) == pytest.approx(1) and max(r.loadings, key=abs) > 0


def labelled(spark, n=60, k=3, seed=5):
    rng = np.random.default_rng(seed)
    lab = rng.integers(0, k, n)
    x = rng.normal(size=(n, 4)) + lab[:, None]
    return x, lab, spark.createDataFrame([(i, int(a), [float(t) for t in r]) for i, (a, r) in enumerate(zip(lab, x))], "id long, label int, x array<double>")


@pytest.mark.parametrize("size", [7, 512])
def test_block_distances(spark, monkeypatch, size):
    x, _, df = labelled(spark)
    monkeypatch.setattr(linalg.blocks, "__defaults__", (None, size))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = linalg.pairwise_distances(df, "id", "x").collect()
    assert len(got) == 60 * 59 // 2 and all(r.i < r.j and r.d == pytest.approx(d[r.i, r.j]) for r in got)
    doubled = d[d > 0]
    for q, v in zip((0.15, 0.4, 1.0), linalg.distance_quantiles(df, "id", "x", (0.15, 0.4, 1.0), bins=16, small=40)):
        assert v == pytest.approx(np.quantile(doubled, q), rel=1e-12)
    eps = float(np.quantile(doubled, 0.2))
    assert linalg.edges_below(df, "id", "x", eps).count() == int((np.triu(d < eps, 1)).sum())


def test_validity_indices_match_numpy(spark):
    x, lab, df = labelled(spark)
    row = validity.validity_table(df, "m").first()
    ks = sorted(set(lab))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (lab == lab[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), min(d[i, lab == k].mean() for k in ks if k != lab[i])
        s.append((b - a) / max(a, b))
    c = np.array([x[lab == k].mean(0) for k in ks])
    n = np.array([(lab == k).sum() for k in ks])
    within = sum(((x[lab == k] - c[i]) ** 2).sum() for i, k in enumerate(ks))
    between = (n[:, None] * (c - x.mean(0)) ** 2).sum()
    r = np.array([np.linalg.norm(x[lab == k] - c[i], axis=1).mean() for i, k in enumerate(ks)])
    db = np.mean([max((r[i] + r[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    sig = [np.sqrt(((x[lab == k] - c[i]) ** 2).sum(1).mean()) for i, k in enumerate(ks)]
    dens = []
    for i, j in itertools.combinations(range(len(ks)), 2):
        dens.append((np.abs(x - (c[i] + c[j]) / 2) < np.mean(sig)).all(1).sum() / max(n[i], n[j]))
    intra = np.mean([d[np.ix_(lab == k, lab == k)].sum() / (m * (m - 1)) for k, m in zip(ks, n)])
    inter = np.mean([d[np.ix_(lab == a, lab == b)].mean() for a, b in itertools.combinations(ks, 2)])
    assert row.silhouette == pytest.approx(np.mean(s)) and row.calinski == pytest.approx((between / (len(ks) - 1)) / (within / (len(x) - len(ks))))
    assert row.davies_bouldin == pytest.approx(db) and row.mq == pytest.approx(r.mean())
    assert row.s_dbw == pytest.approx(np.mean(sig) / (np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()) + 1e-12) + np.mean(dens))
    assert row.avi == pytest.approx(intra / (inter + 1e-12)) and row.avu == pytest.approx(np.mean([x[lab == k].var(0).mean() for k in ks]))


def test_single_member_has_silhouette_zero(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 5, [9.0])], "id long, label int, x array<double>")
    got = {r.id: r.s for r in validity.silhouettes(validity.distance_sums(df)).collect()}
    assert got[3] == 0.0 and got[1] == pytest.approx(8 / 9)


def ari(a, b):
    from math import comb

    both = sum(comb(sum(1 for t in zip(a, b) if t == c), 2) for c in set(zip(a, b)))
    x, y, n = sum(comb(a.count(k), 2) for k in set(a)), sum(comb(b.count(k), 2) for k in set(b)), comb(len(a), 2)
    return (both - x * y / n) / ((x + y) / 2 - x * y / n)


def test_adjusted_rand(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 50).tolist(), rng.integers(0, 4, 50).tolist()
    of = lambda p, q: validity.adjusted_rand(validity.contingency(spark.createDataFrame(list(zip(p, q)), "a int, b int"), "a", "b")).first().ari
    assert of(a, b) == pytest.approx(ari(a, b)) and of(a, a) == 1.0 and of(a, [7 - v for v in a]) == pytest.approx(1.0) and of([1] * 5, [2] * 5) == 1.0


def test_components_of_paths_and_isolated(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 101 + i) for i in range(7)] + [(200, 200), (5, 3)]
    v = [*range(31), *range(100, 108), 200, 300]
    got = {r.id: r.component for r in cluster.components(spark.createDataFrame([(i,) for i in v], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 if i < 31 else 100 if i < 108 else i for i in v}
    none = spark.createDataFrame([], "src long, dst long")
    assert cluster.components(spark.createDataFrame([(1,)], "id long"), none).collect()[0].component == 1


def test_louvain_finds_planted_groups(spark):
    rng = np.random.default_rng(3)
    edges = [(a, b) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.5 if a // 20 == b // 20 else 0.02)]
    v = spark.createDataFrame([(i,) for i in range(61)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.label for r in cluster.louvain(v, e, 1.0).collect()}
    assert len({tuple(sorted({got[i] for i in range(k * 20, k * 20 + 20)})) for k in range(3)}) == 3 and got[60] == 3
    q = cluster.modularity(spark.createDataFrame(list(got.items()), "id long, label int"), e).first()[0]
    one = cluster.modularity(v.withColumn("label", F.lit(0)), e).first()[0]
    assert q > 0.5 and one == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("small", [200_000, 0])
def test_parallel_louvain_is_as_good(spark, monkeypatch, small):
    monkeypatch.setattr(cluster, "SMALL_GRAPH", small)
    rng = np.random.default_rng(4)
    edges = [(a, b) for a, b in itertools.combinations(range(50), 2) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    v, e = spark.createDataFrame([(i,) for i in range(51)], "id long"), spark.createDataFrame(edges, "src long, dst long")
    got = cluster.louvain_parallel(v, e, 1.0)
    one, two = (cluster.modularity(labels, e).first()[0] for labels in (cluster.louvain(v, e, 1.0), got))
    assert two >= 0.95 * one and one > 0.5
    assert got.count() == 51 and cluster.louvain_parallel(v, e.limit(0), 1.0).select("label").distinct().count() == 51


def test_merge_small_and_ranks(spark):
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate([5] * 4 + [2] * 6 + [7] + [1] * 2 + [9] * 4)], "id long, label int")
    got = {r.id: r.label for r in cluster.merge_small(df, 3).collect()}
    assert [got[i] for i in range(17)] == [1] * 4 + [0] * 6 + [3] + [3] * 2 + [2] * 4


def test_median_split_ties_go_down(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 3.0])], "entity int, u double")
    assert [r.label for r in cluster.median_split(df, "u").orderBy("entity").collect()] == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("n", [1, 2, 7, 2001, 9000, 9001])
def test_exact_median(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(3 if n % 2 else 9)
    rows = [("a", float(x)) for x in v] + [("b", 2.0)] * 3 + [("b", 5.0)] * 3 + [("c", None), ("d", float("nan")), ("d", 1.0)] + [("e", 1.0)] * 4000 + [("e", 0.0)] * 3999
    got = {r.k: r["median"] for r in linalg.exact_median(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    want = {"a": float(np.median(v)), "b": 3.5, "d": 1.0, "e": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    narrowed = {r.k: r["median"] for r in linalg.exact_median(df, "v", ["k"], most=50, bins=8).collect()}  # many rounds of bounds
    assert got == want and narrowed == want
    assert linalg.exact_median(df.where("k = 'a'"), "v", most=10, bins=4).first()[0] == want["a"]


def test_weighted_median(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v), int(w)) for k, v, w in zip(rng.integers(0, 3, 500), rng.normal(size=500).round(2), rng.integers(-1, 4, 500))] + [(0, 1e300, 1), (0, -1e308, 1), (1, 0.5, None)]
    df = spark.createDataFrame(rows, "k int, v double, w int")
    want = {k: float(np.median(np.repeat([v for q, v, w in rows if q == k and w and w > 0], [w for q, v, w in rows if q == k and w and w > 0]))) for k in range(3)}
    for most in (1_000_000, 20):
        assert {r.k: r["median"] for r in linalg.exact_median(df, "v", ["k"], weight="w", most=most, bins=16).collect()} == want


def test_quantiles_of_many_equal_distances(spark):
    """A million pairs at few different distances: the driver sees the distances only."""
    pts = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(1500)], "id long, x array<double>")
    d = np.array([1.0] * (500 * 500 * 2) + [2.0] * (500 * 500))
    qs = [0.1, 0.5, 0.66, 0.67, 0.9]
    assert linalg.distance_quantiles(pts, "id", "x", qs, small=100) == pytest.approx([float(np.quantile(np.repeat(d, 2), q)) for q in qs])


def test_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    x = (x - x.mean(0)) / x.std(0)
    cols = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "entity long, " + ", ".join(f"{c} double" for c in cols))

    def split(rows):
        j = plm.coupling_matrix((rows > 0).astype(float), np.ones(len(rows)), 0.2)
        w, v = np.linalg.eigh(j)
        u = rows @ (v[:, -1] * np.sign(v[np.argmax(np.abs(v[:, -1])), -1]))
        return (u > np.median(u)).astype(int)

    base = split(x)
    got = {r.rep: r.ari for r in stability.bootstrap_ari(df, cols, 0.2, 5).collect()}
    for rep in range(5):
        at = np.random.RandomState(rep).randint(0, 40, 40)
        assert got[rep] == pytest.approx(ari(split(x[at]).tolist(), base[at].tolist()))
    sweep = {r.c: r for r in stability.regularisation_sweep(df, cols, (0.1, 0.2)).collect()}
    assert sweep[0.2].ari == 1.0 and set(sweep) == {0.1, 0.2}
    lab = spark.createDataFrame([(i, int(base[i]), [*map(float, x[i])]) for i in range(40)], "id long, label int, x array<double>")
    assert sweep[0.2].silhouette == pytest.approx(validity.silhouette(validity.distance_sums(lab)).first()[0])


def test_poisson_draws(spark):
    placed = spark.range(4000).withColumnRenamed("id", "entity")
    rows = stability.poisson_weights(placed, 5).groupBy("rep").agg(F.sum("weight").alias("n"), F.count("*").alias("k"), F.max("weight").alias("most")).collect()
    assert len(rows) == 5 and all(abs(r.n - 4000) < 300 and abs(r.k - 4000 * (1 - np.exp(-1))) < 200 and r.most < 10 for r in rows)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate((x - x.mean(0)) / x.std(0))], "entity long, a double, b double, c double")
    got = stability.bootstrap_ari(df, ["a", "b", "c"], 0.2, 6, "poisson").collect()
    assert len(got) == 6 and all(-1 <= r.ari <= 1 and 100 < r.n < 300 for r in got)


def test_switches(spark):
    rows = [("a", w, lab) for w, lab in enumerate([0, 0, 1, 1, 0], 1)] + [("b", 1, 2), ("b", 3, 2), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "entity string, window int, label int")
    assert {r.entity: r.n_switches for r in dynamics.switch_counts(df).collect()} == {"a": 2, "b": 0, "c": 0}
    assert [(r.from_window, r.to_window, r.from_label, r.to_label) for r in dynamics.switch_events(df).orderBy("to_window").collect()] == [(2, 3, 0, 1), (4, 5, 1, 0)]
    assert [r.entity for r in panel.in_all_windows(df).collect()] == ["a"]


def test_income_proxy_falls_back_to_the_median(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(3 * a + 1) if i % 4 else None) for i, a in enumerate(rng.normal(size=80))]
    out, told = audit.income_proxy(spark.createDataFrame(rows, "id int, a double, y double"), "y", ["a"])
    assert not told["used_fallback"] and all(r.y_proxy == pytest.approx(3 * r.a + 1) for r in out.collect())
    noise = [(i, float(a), float(b) if i % 4 else None) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    out, told = audit.income_proxy(spark.createDataFrame(noise, "id int, a double, y double"), "y", ["a"], least_r2=0.9)
    middle = float(np.median([r[2] for r in noise if r[2] is not None]))
    assert told["used_fallback"] and all(r.y_proxy == pytest.approx(middle) for r in out.where("y IS NULL").collect())


def zipped(name, data):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr(name, data)
        z.writestr("other.csv", "x\n1\n")
    return buf.getvalue()


def test_zipped_csv(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped("a.csv", "﻿mo,value\nА,1\nБ,\n".encode()))
    (tmp_path / "b.zip").write_bytes(zipped("b.csv", "mo;value\nВ;3,5\n".encode("cp1251")))
    (tmp_path / "c.csv").write_bytes("mo\tvalue\tmore\nГ\t4\t5\n".encode())
    got = archives.read_zipped_csv(spark, str(tmp_path), ["mo", "value", "none"]).collect()
    assert sorted(tuple(r) for r in got) == [("А", "1", None), ("Б", None, None), ("В", "3,5", None), ("Г", "4", None)]


def test_workbook_and_carry_down(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
      <row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Кемский район</t></is></c><c r="C2"><v>86</v></c><c r="D2"><v>31.5</v></c></row>
      <row r="3"><c r="B3" t="inlineStr"><is><t>Тверская область</t></is></c></row><row r="4"><c r="A4"><v>2</v></c><c r="B4" t="inlineStr"><is><t>Бежецк</t></is></c><c r="D4"><v>3</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="2020" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Республика Карелия</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = archives.read_sheets(spark, str(tmp_path), ["2020", "2021"])
    got = [tuple(r)[1:] for r in panel.carry_down(rows).collect()]
    assert got == [("2020", 2, "Карелия", "Кемский район", "86", 31.5)]


def test_headers_stay_in_their_file(spark, tmp_path):
    """Two workbooks with a sheet of the same name: their lines interleave, their headers don't."""
    for name, region in (("a", "Новгородская область"), ("b", "Псковская область")):
        lines = "".join(f'<row r="{3 * i + 1 + (name == "b")}"><c r="B1" t="inlineStr"><is><t>{region}</t></is></c></row><row r="{3 * i + 3}"><c r="A1"><v>{i}</v></c><c r="B1" t="inlineStr"><is><t>{name}{i} район</t></is></c><c r="D1"><v>{i}</v></c></row>' for i in range(4))
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="2020" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>')
    got = panel.carry_down(archives.read_sheets(spark, str(tmp_path), ["2020"])).collect()
    assert len(got) == 8 and {(r.name[0], r.region) for r in got} == {("a", "НовОбл"), ("b", "ПскОбл")}


def test_csv_with_mark_round_trip(spark, tmp_path):
    rows = [("а", "x, y", 1), ("", None, 2), (None, 'say "hi"', 3), (" b ", "two\nlines", None), ("\\N-", "", 4)]
    archives.write_csv(spark.createDataFrame(rows, "name string, note string, n long").coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfname,note,n")
    got = archives.read_csv(spark, str(tmp_path / "out"), "name string, note string, n long").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    (tmp_path / "plain.csv").write_text("name,n\nа,1\n", encoding="utf-8")
    (tmp_path / "marked.csv").write_text("name,n\nб,2\n", encoding="utf-8-sig")
    assert sorted(map(tuple, archives.read_csv(spark, str(tmp_path / "*.csv"), "name string, n long").collect())) == [("а", 1), ("б", 2)]


def test_guards(spark):
    df = spark.createDataFrame([("a", 8), ("b", 8), ("c", None)], "entity string, n int")
    assert audit.require_features(["x", "y"], 2) == ["x", "y"]
    for bad in (["x"], ["x", "x"]):
        with pytest.raises(ValueError, match="2 features expected"):
            audit.require_features(bad, 2)
    assert audit.one_match(df.where("entity = 'a'")).first().n == 8
    for where in ("entity = 'z'", "n = 8"):
        with pytest.raises(ValueError, match="one row expected"):
            audit.one_match(df.where(where))
    assert audit.expected_value(df.where("n = 8"), "n", 8).count() == 2
    with pytest.raises(Exception, match="n: 8 expected, found NULL"):
        audit.expected_value(df, "n", 8).collect()
    labels = df.select("entity")
    assert audit.aligned(labels, df).count() == 3
    for other, what in ((labels.where("entity <> 'a'"), "1 entities without"), (labels.unionByName(labels.limit(1)), "1 with several")):
        with pytest.raises(ValueError, match=what):
            audit.aligned(other, df)


def test_both_lists_of_income_names():
    cols = ["share_food", "log_income", "wage_mean", "urov_2020", "Доход", "зарплата", "dohod"]
    assert names.without_income(cols) == ["share_food", "urov_2020", "Доход"] and names.without_income(cols, names.INCOME_PARTS_OTHER) == ["share_food", "wage_mean", "dohod"]


def test_plain_text_and_table_cells(spark):
    text = "## A **b** `c` ![pic](x.png) [link](http://y) --- \\(\\lambda_₁ \\approx 2$\\) &lt;z&gt; ∈"
    df = spark.createDataFrame([(text,), (None,), ("",), ("a ## b",)], "t string").select(markup.plain_text(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["A b c [рис.: pic] link  λ_1 ≈ 2 <z> in", None, "", "a ## b"]
    lines = spark.createDataFrame([("| a | b|c |",), ("|---|---|",), ("one",), (None,)], "t string").select(markup.table_cells(F.col("t")).alias("c"))
    assert [r.c for r in lines.collect()] == [["a", "b", "c"], None, ["one"], None]


def test_directions_and_seasonality(spark):
    rows = [("e", f, v, 1.0) for f in ("up", "down", "none") for v in (0.0, 1.0, 2.0)]
    got = [r.direction for r in audit.directions(spark.createDataFrame(rows, "entity string, feature string, value double, median double"), {"up": 1, "down": -1}).collect()]
    assert got == ["away", "away", "toward", "toward", "toward", "away", "neutral", "neutral", "neutral"]
    panel_rows = [("e", "c", v) for v in (1.0, 2.0, 3.0)] + [("e", "d", 9.0), ("f", "c", None), ("g", "c", 1.0), ("g", "c", -1.0)]
    got = {r.entity: r for r in audit.seasonality(spark.createDataFrame(panel_rows, "entity string, category string, value double"), "c").collect()}
    assert set(got) == {"e", "g"} and got["e"].cv == pytest.approx(np.std([1, 2, 3]) / 2) and got["g"].cv is None


def test_events_with_metrics(spark):
    events = spark.createDataFrame([("a", 1, 2, 0, 1), ("b", 2, 9, 1, 0)], "entity string, from_window int, to_window int, from_label int, to_label int")
    windows = spark.createDataFrame([(1, 3.0, 0.5, 2), (2, 4.0, 0.6, 3)], "window int, pr_plus double, frustration double, n_communities int")
    agree = spark.createDataFrame([(1, 2, 0.9)], "from_window int, to_window int, ari double")
    got = {r.entity: r for r in dynamics.events_with_metrics(events, windows, agree).collect()}
    assert got["a"].pr_plus_from == 3.0 and got["a"].pr_plus_to == 4.0 and got["a"].ari == 0.9
    assert got["b"].pr_plus_from == 4.0 and got["b"].pr_plus_to is None and got["b"].ari is None


def test_imputed_and_residual_targets(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 2 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    got = {r.id: r.y_q for r in audit.quantile_imputed(df, "y").collect()}
    assert got[1] == 3.0 and got[2] == pytest.approx(np.quantile([3.0, 7.0, 11.0, 15.0], 0.75))
    assert all(r.y_residual == pytest.approx(0, abs=1e-9) for r in audit.residual(df, "y", "a").where("y IS NOT NULL").collect())


def test_saved_labels(spark, tmp_path):
    people = spark.createDataFrame([("a",), ("b",)], "entity string")
    again = lambda: people.withColumn("label", F.lit(9))
    path = str(tmp_path / "l")
    assert {r.label for r in labels.labels_or_else(spark, path, ["x"], people, again).collect()} == {9}
    spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "entity string, x int").write.parquet(path)
    assert sorted(tuple(r) for r in labels.labels_or_else(spark, path, ["y", "x"], people, again).collect()) == [("a", 1), ("b", 0)]
    more = people.unionByName(spark.createDataFrame([("d",)], "entity string"))
    assert {r.label for r in labels.labels_or_else(spark, path, ["x"], more, lambda: more.withColumn("label", F.lit(9))).collect()} == {9}


def test_stream_equals_table(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 25, base + dt.timedelta(hours=i), "k", float(i)) for i in range(40)] + [(99, None, "k", 1.0), (98, base, "k", None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = panel_stream.read_stream(spark, str(tmp_path / "in"), "id int, ts timestamp, kind string, value double")
    got = panel_stream.windowed_totals(stream, "ts", ["kind"], "value", "1 day", "12 hours", "30 days")
    q = got.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = panel_stream.windowed_totals(df, "ts", ["kind"], "value", "1 day", "12 hours", "30 days")
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, table.collect()))
    assert panel_stream.first_seen(df, "id", "ts", "1 day").count() == 27
    w = panel_stream.to_table(panel_stream.first_seen(stream, "id", "ts", "30 days").select("id", "value"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    w.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() >= 25


def test_bootstrap_queries_run_all_replicates(spark):
    from panelmodes.plans import core

    got = [r.rep for r in core.bootstrap_ari(spark, "/root/testdata/sf0.001").select("rep").collect()]
    assert sorted(got) == list(range(100))


def test_eps_is_the_smallest_quantile_that_connects(spark, monkeypatch):
    monkeypatch.setattr(linalg.blocks, "__defaults__", (None, 16))
    rng = np.random.default_rng(11)
    grid = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
    for shift in (3.2, 50.0):
        x = rng.normal(size=(60, 2))
        x[:30, 0] += shift
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        want = []
        for q in grid:
            eps = np.quantile(d[d > 0], q)
            seen, todo, parts = set(), [], 0
            for v in range(60):
                if v not in seen:
                    parts, todo = parts + 1, [v]
                    while todo:
                        u = todo.pop()
                        if u not in seen:
                            seen.add(u)
                            todo += [int(w) for w in np.flatnonzero(d[u] < eps) if w not in seen]
            want.append((q, pytest.approx(eps), parts))
        pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
        got = list(cluster.eps_components(pts, grid))
        assert got == want
        chosen = next((r for r in got if r[2] == 1), got[-1])
        assert cluster.connected_eps(pts, grid) == chosen[:2]


def test_graph_queries_take_the_chosen_eps(spark):
    from panelmodes.plans import core

    folder = "/root/testdata/sf0.001"
    rows = core.eps_choice(spark, folder).collect()
    (chosen,) = [r for r in rows if r.chosen]
    want = linalg.edges_below(core.panels.points(spark, folder), "id", "x", chosen.eps)
    e = core.graph_edges(spark, folder)
    assert len(rows) == 6 and e.count() == want.count() > 0
    assert core.graph_components(spark, folder).select("component").distinct().count() == chosen.components
    q = cluster.modularity(cluster.louvain(core.panels.points(spark, folder).select("id"), e, 0.5), e).first()[0]
    assert core.louvain_modularity(spark, folder).first()[0] == pytest.approx(q)


def test_kmeans_grid_finds_planted_groups(spark):
    rng = np.random.default_rng(12)
    at = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    x = np.vstack([rng.normal(size=(15, 2)) + c for c in at])
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = cluster.kmeans_grid(pts, [2, 4], 30).toPandas()
    four = got[got["k"] == 4].sort_values("id")["label"].tolist()
    assert four == [0] * 15 + [1] * 15 + [2] * 15 + [3] * 15
    assert len(got) == 120 and set(got[got["k"] == 2]["label"]) == {0, 1}


def test_kmeans_query_is_the_best_of_the_grid(spark):
    from panelmodes.plans import core

    assert core.QUARTERLY.n_init == 30
    rows = core.kmeans_choice(spark, "/root/testdata/sf0.01").collect()
    (best,) = [r for r in rows if r.chosen]
    assert {r.k for r in rows} <= set(range(2, 9)) and len(rows) > 1 and min(min(r.sizes) for r in rows) >= 2
    assert best.silhouette == max(r.silhouette for r in rows)


def test_headline_reads_the_community_trajectories(spark):
    from panelmodes.plans import core

    folder = "/root/testdata/sf0.01"
    got = core.headline(spark, folder).first()
    seen = {}
    for r in core.trajectories(spark, folder).collect():
        seen[r.entity] = r.n_switches > 0
    assert got.switchers == pytest.approx(sum(seen.values()) / len(seen))
    aris = [r.ari for r in core.trajectory_ari(spark, folder).collect()]
    assert got.mean_window_ari == pytest.approx(sum(aris) / len(aris))


def test_headline_joins_the_lines_once(spark, monkeypatch):
    from panelmodes.plans import core, panels

    folder, read, whole = "/root/testdata/sf0.01", [], panels.panel_l
    monkeypatch.setattr(panels, "panel_l", lambda *a: read.append(a) or whole(*a))
    got = core.headline(spark, folder).first()
    assert len(read) == 1
    m, aris = core.spectral_metrics(spark, folder).first(), [r.ari for r in core.bootstrap_ari(spark, folder).collect()]
    assert [got[c] for c in ("lambda_max", "top_share", "pr_plus", "frustration")] == pytest.approx([m[c] for c in ("lambda_max", "top_share", "pr_plus", "frustration")])
    assert len(aris) == 100 and (got.bootstrap_mean, got.bootstrap_std) == (pytest.approx(np.mean(aris)), pytest.approx(np.std(aris)))


def test_draws_of_the_bootstrap_are_never_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, *(float(v) for v in rng.standard_normal(3))) for i in range(40)], "entity long, a double, b double, c double")
    given, whole = [], stability.labels_by_group
    monkeypatch.setattr(stability, "labels_by_group", lambda binary, x, *a: given.append(x) or whole(binary, x, *a))
    assert stability.bootstrap_ari(rows, ["a", "b", "c"], 0.2, 5).count() == 5
    plan = given[1]._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Broadcast" not in plan


def test_windows_leave_rows_where_their_entity_is(spark):
    wide = spark.createDataFrame([(i % 5, dt.date(2020 + i // 20, 1 + 3 * (i // 5 % 4), 1), float(i)) for i in range(40)], "entity int, period date, total double").repartition("entity")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = panel.assign_windows(wide, 3)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.window, r.n) for r in got.groupBy("window").agg(F.count("*").alias("n")).collect()) == [(w, 15) for w in range(1, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_release_deletes_the_shuffle_files_of_what_is_cut(spark):
    files = lambda: {x for x in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    session.release(spark)
    old = files()
    kept = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() - old
    session.release(spark)
    for _ in range(20):
        if not files() - old:
            break
        time.sleep(0.25)
    assert not files() - old and kept.count() == 7


# --- graphs whose edges are never stored -------------------------------------------------------------------------


def listed_communities(u, q, resolution):
    """ε and communities from the matrix of all distances."""
    d = np.sqrt(((u[:, None, :] - u[None, :, :]) ** 2).sum(2))
    eps = np.quantile(d[d > 0], q) if (d > 0).any() else 0.0
    i, j = np.nonzero(np.triu(d < eps, 1))
    got = cluster.louvain_labels(i.tolist(), j.tolist(), range(len(u)), resolution)
    return eps, [got[v] for v in range(len(u))]


@pytest.mark.parametrize("seed", range(12))
def test_unlisted_graph_has_the_communities_of_the_listed_one(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n, q, resolution = int(rng.integers(2, 240)), (0.3, 0.15, 0.02, 0.4)[seed % 4], (0.5, 1.0, 3.0)[seed % 3]
    u = rng.standard_normal((n, 1 + seed % 5)) * 10.0 ** rng.integers(-3, 3)
    if seed % 3 == 0:
        u = u[rng.integers(0, max(1, n // 5), n)]  # exact copies
    if seed % 4 == 0:
        u = np.round(u, 1)  # many equal distances, some of them ε
    if seed % 5 == 0:
        u[0] = np.nan
    eps, want = listed_communities(u, q, resolution)
    graph = near.Near(u)
    assert graph.quantile(q) == graph.quantile(q, drawn=50) == eps
    assert near.communities(graph, eps, resolution).tolist() == want
    for most in (32 << 20, 2 * n):  # rows by sevens, then without room for counts
        monkeypatch.setattr(near, "ROWS", 7 * n)
        monkeypatch.setattr(near, "COUNTS", most)
        assert near.communities(graph, eps, resolution).tolist() == want


def test_window_of_many_entities_needs_no_matrix_of_its_pairs():
    rng = np.random.default_rng(3)
    n, p = 5000, Params(min_community=3)
    x = rng.standard_normal((n, 5)) + (np.arange(n) % 2)[:, None] * 3
    group = pd.DataFrame({"window": 1, "entity": [f"{i:05d}" for i in range(n)], "x": list(x), "v": [np.eye(5).ravel()] * n})
    tracemalloc.start()
    got = dynamics.communities_of_window(group, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8 and got["label"].nunique() > 1  # one number a pair would be more


def test_communities_of_points_are_those_of_their_edges(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal((60, 5)), rng.standard_normal((50, 5)) + 4])
    pts = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(110) * 3, x)], "id long, x array<double>").localCheckpoint()
    grid = (0.15, 0.2, 0.3, 0.4)
    _, eps = cluster.connected_eps(pts, grid)
    edges = linalg.edges_below(pts, "id", "x", eps).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    want = {r.id: r.label for r in cluster.louvain(pts.select("id"), edges, 0.5).collect()}
    assert {r.id: r.label for r in cluster.louvain_of_points(pts, grid, 0.5).collect()} == want


def test_sums_of_distances_leave_a_row_for_a_large_block(spark):
    rng = np.random.default_rng(9)
    x, lab = rng.standard_normal((130, 3)), rng.integers(0, 3, 130)
    pts = spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(lab, x))], "id long, label int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in validity.distance_sums(pts).collect():
        at = (lab == r.other) & (np.arange(130) != r.id)
        assert r.total == pytest.approx(d[r.id, at].sum()) and r.n == at.sum()
    many = spark.range(30_000).withColumn("x", F.array(F.col("id").cast("double")))
    assert linalg.block_size(many) == 1250 and linalg.block_size(pts) == linalg.BLOCK

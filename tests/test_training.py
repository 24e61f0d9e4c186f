"""The general training-data operators on small tables: nulls, ties, repeats, empty tables, clashing names, skew."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmodes.functions.dates import quarter_number, real_date
from panelmodes.functions.labels import CATEGORIES, category_name, category_slot
from panelmodes.operators import impute, regular, rolling, widen
from panelmodes.operators.prefix import running_sums
from panelmodes.operators.readings import usable_readings

SPEND = "spend_id long, mo_id long, mo string, period string, category_15 string, value double, loaded_at timestamp, slot string, day string, at string"
T0 = dt.datetime(2024, 1, 1)


def spend(spark, rows):
    return spark.createDataFrame([(i, m, "x", p, c, v, t, "clash", "clash", "clash") for i, m, p, c, v, t in rows], SPEND)


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-07-15", "2023-07-15"), ("15.07.2023", "2023-07-15"), ("2023/7/5", "2023-07-05"), ("20230715", "2023-07-15"), ("2023-07", "2023-07-01"), ("07.2023", "2023-07-01"),
        ("2023-07-15 00:00:00", "2023-07-15"), (" 2023-07-15​", "2023-07-15"), ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("00.00.0000", None), ("2023-13-01", None),
        ("", None), ("—", None), ("нет даты", None), (None, None), ("31.04.2023", None), ("202307", None),
    ],
)
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(real_date(F.col("t")).cast("string")).first()[0]
    assert got == day


def test_quarters(spark):
    rows = [("I кв.", 1), ("Ⅳ кв.", 4), ("3 кв.", 3), ("II кв.", 2), ("V кв.", None), (None, None), ("", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(quarter_number(F.col("t"))).collect()
    assert [g[0] for g in got] == [r[1] for r in rows]


def test_categories(spark):
    rows = [("Bce категории", "Все категории"), ("Здоро​вье", "Здоровье"), ("Прод-е (продовольствие)", "Продовольствие"), ("Общепит", "Общественное питание"), ("Трансп.", "Транспорт"), (" МАРКЕТПЛЕЙСЫ ", "Маркетплейсы"), ("прочее", None), (None, None), ("", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(category_name(category_slot(F.col("t")))).collect()
    assert [g[0] for g in got] == [r[1] for r in rows]


def rows_of_panel():
    return [
        (1, 7, "2023-01-01", "Здоровье", 10.0, T0),
        (2, 7, "01.01.2023", "здоровье", 11.0, T0 + dt.timedelta(1)),  # corrects
        (2, 7, "01.01.2023", "здоровье", 11.0, T0 + dt.timedelta(1)),  # repeats
        (3, 7, "2023-01", "Транспорт", 0.0, None),  # zero is a value
        (4, 7, "2023-02-30", "Транспорт", 5.0, T0),  # no date
        (5, 7, "2023-05-20", "Здоровье", 50.0, T0),
        (6, 7, "2023-05-21", "Здоровье", None, T0),
        (7, 7, "2023-05-21", "Здоровье", float("nan"), T0),
        (8, None, "2023-05-21", "Здоровье", 4.0, T0),
        (9, 8, "2023-03-03", "прочее", 4.0, T0),
        (10, 9, None, "Здоровье", 4.0, T0),
    ]


def test_wide_months(spark):
    wide = widen.wide_months(usable_readings(spend(spark, rows_of_panel())))
    got = {(r.mo_id, r.ym): r for r in wide.collect()}
    assert set(got) == {(7, "2023-01"), (7, "2023-05")}
    assert got[7, "2023-01"]["Здоровье"] == 11.0 and got[7, "2023-01"]["Транспорт"] == 0.0 and got[7, "2023-01"]["Маркетплейсы"] is None
    holes = widen.empty_cells(wide, ["mo_id", "ym"], CATEGORIES, "category").collect()
    assert len(holes) == 4 + 5
    empty = widen.wide_months(usable_readings(spend(spark, [])))
    assert empty.count() == 0 and empty.columns == ["mo_id", "ym", *CATEGORIES]


@pytest.mark.parametrize("merger, want", [("sum", 21.0), ("mean", 7.0), ("min", 1.0), ("max", 12.0), ("count", 3.0), ("latest", 8.0), ("earliest", 12.0)])
def test_mergers(spark, merger, want):
    cells = spark.createDataFrame([(1, 0, 12.0, 1), (1, 0, 1.0, 2), (1, 0, 8.0, 3)], "k int, slot int, v double, r int").repartition(3)
    assert widen.widen(cells, ["k"], "slot", "v", [widen.Slot("a", "double", merger)], ["r"]).first().a == want


def test_null_ranks_come_first(spark):
    rows = [("a", 0, 1.0, None, "x"), ("a", 0, 2.0, T0, None), ("a", 0, 3.0, None, None), ("b", 0, 4.0, None, None), ("b", 0, 5.0, None, None)]
    cells = spark.createDataFrame(rows, "k string, slot int, v double, t timestamp, s string").repartition(3)
    for merger, want in (("latest", {"a": 2.0, "b": 5.0}), ("earliest", {"a": 3.0, "b": 4.0})):
        assert {r.k: r.c for r in widen.widen(cells, ["k"], "slot", "v", [widen.Slot("c", "double", merger)], ["t", "s"]).collect()} == want


def test_typed_slots_and_null_keys(spark):
    rows = [("a", 0, "5"), ("a", 1, "yes"), ("a", 2, "2024-02-30"), (None, 3, "t"), ("b", 0, "x"), ("b", 9, "z"), ("c", 1, None), ("c", None, "q")]
    cells = spark.createDataFrame(rows, "k string, slot int, v string")
    slots = [widen.Slot("n", "long"), widen.Slot("f", "boolean"), widen.Slot("d", "date"), widen.Slot("s", "string")]
    got = {r.k: tuple(r)[1:] for r in widen.widen(cells, ["k"], "slot", "v", slots).collect()}
    assert got == {"a": (5, True, None, None), None: (None, None, None, "t"), "b": (None, None, None, None)}


def test_grid_interpolates_by_time(spark):
    got = {(r.category, r.ym): r for r in regular.monthly_grid(usable_readings(spend(spark, rows_of_panel())), 124).collect()}
    # neighbours 1 January and 20 May lie 139 days apart: a gap
    assert [got["Здоровье", f"2023-0{m}"].mark for m in range(1, 6)] == ["observed", "gap", "gap", "gap", "observed"]
    wide = {(r.category, r.ym): r for r in regular.monthly_grid(usable_readings(spend(spark, rows_of_panel())), 200).collect()}
    r = wide["Здоровье", "2023-03"]
    assert r.mark == "interpolated" and r.value == pytest.approx(11 + (50 - 11) * 59 / 139) and r.before_day == dt.date(2023, 1, 1)
    assert ("Транспорт", "2023-01") in got and len([k for k in got if k[0] == "Транспорт"]) == 1
    assert regular.monthly_grid(usable_readings(spend(spark, []))).count() == 0


def brute_trailing(days, w):
    first, last = min(days), max(days)
    return {d: (sum(days.get(x, 0) for x in range(d - w + 1, d + 1)), sum(x in days for x in range(d - w + 1, d + 1))) for d in range(first, last + 1)}


def test_trailing_totals_match_brute_force(spark):
    rng = random.Random(4)
    base = dt.date(2023, 1, 1)
    rows, days = [], {}
    for mo in (1, 2):
        for _ in range(120):
            k, v = rng.randrange(150), round(rng.random() * 100, 2)
            rows.append((len(rows), mo, (base + dt.timedelta(k)).isoformat(), "Все категории", v, T0))
            if rng.random() < 0.3:
                rows.append(rows[-1])  # equal values of a day count once
            days.setdefault((mo, k), set()).add(v)
    totals = rolling.daily_totals(usable_readings(spend(spark, rows)))
    got = {(r.mo_id, r.on_day): r for r in rolling.daily_report(totals).collect()}
    for mo in (1, 2):
        own = {k: sum(v) for (m, k), v in days.items() if m == mo}
        for w in (7, 30):
            for d, (total, n) in brute_trailing(own, w).items():
                r = got[mo, (base + dt.timedelta(d)).isoformat()]
                assert r[f"total_{w}"] == pytest.approx(total) and r[f"days_{w}"] == n
                assert r[f"avg_{w}"] == pytest.approx(total / min(w, d - min(own) + 1))
    assert len(got) == sum(max(k for m, k in days if m == mo) - min(k for m, k in days if m == mo) + 1 for mo in (1, 2))
    found = {(r.mo_id, r.on_day) for r in rolling.concentrated_days(totals).collect()}
    want = set()
    for mo in (1, 2):
        own = {k: sum(v) for (m, k), v in days.items() if m == mo}
        a, b = brute_trailing(own, 7), brute_trailing(own, 30)
        want |= {(mo, (base + dt.timedelta(d)).isoformat()) for d in a if d >= min(own) + 29 and b[d][1] >= 10 and a[d][0] > 0.6 * b[d][0] + 1e-9}
    assert found == want


def test_trailing_edge_cases(spark):
    assert rolling.daily_report(rolling.daily_totals(usable_readings(spend(spark, [])))).count() == 0
    rows = [(1, 1, "2023-01-01", "Все категории", float("inf"), T0), (2, 1, "2023-01-02", "Все категории", 3.0, T0), (3, 2, "2023-01-02", "Все категории", -4.0, T0)]
    got = rolling.daily_report(rolling.daily_totals(usable_readings(spend(spark, rows)))).collect()
    assert sorted((r.mo_id, r.on_day, r.total_7) for r in got) == [(1, "2023-01-01", float("inf")), (1, "2023-01-02", float("inf")), (2, "2023-01-02", -4.0)]


def test_huge_and_close_readings(spark):
    """Infinite readings leave a period again, huge finite ones are exact or infinite, and values equal to six places are still two."""
    at = lambda k: (dt.date(2023, 1, 1) + dt.timedelta(k)).isoformat()
    values = {0: [1e15, 2.0], 3: [float("inf")], 4: [float("-inf")], 9: [1e-7, 2e-7, 2e-7], 20: [5e24, 1.0], 21: [1e25], 25: [-1e300]}
    rows = [(10 * k + i, 1, at(k), "Все категории", v, T0) for k, vs in values.items() for i, v in enumerate(vs)]
    totals = rolling.daily_totals(usable_readings(spend(spark, rows)))
    got = {r.on_day: r for r in rolling.daily_report(totals, (3, 7)).collect()}
    assert len(got) == 26 and got[at(0)].total_3 == 1e15 + 2 and got[at(1)].days_3 == 1
    assert got[at(3)].total_3 == float("inf") and math.isnan(got[at(4)].total_3) and got[at(6)].total_3 == float("-inf") and got[at(8)].total_3 == 0.0 and math.isnan(got[at(9)].total_7)
    assert got[at(20)].total_3 == 5e24 and got[at(21)].total_3 == float("inf") and got[at(25)].total_7 != got[at(25)].total_7 and got[at(25)].total_3 == float("-inf")
    days = {r["at"]: r for r in totals.collect()}
    assert len(days) == 7
    w = spark.createDataFrame([(1, dt.date(2023, 1, 1), dt.date(2023, 1, 1), T0)], "window int, window_start date, window_end date, computed_at timestamp")
    assert math.isnan(rolling.window_totals(totals, w).first().total)
    # Infinite totals make no case, but a negative infinite far total does where the near one is finite.
    dense = [(k, 1, at(k), "Все категории", float("-inf") if k == 0 else 1.0, T0) for k in range(40)]
    found = {r.on_day for r in rolling.concentrated_days(rolling.daily_totals(usable_readings(spend(spark, dense)))).collect()}
    assert found == {at(29)}


def test_window_totals(spark):
    rows = [(1, 1, "2023-01-31", "Все категории", 5.0, T0), (2, 1, "2023-04-01", "Все категории", -7.0, T0), (3, 1, "2023-08-01", "Все категории", 1.0, T0)]
    w = spark.createDataFrame([(1, dt.date(2023, 1, 1), dt.date(2023, 6, 1), T0), (1, dt.date(2023, 2, 1), dt.date(2023, 6, 1), T0 - dt.timedelta(9)), (2, dt.date(2023, 5, 1), dt.date(2023, 7, 1), None), (3, dt.date(2024, 5, 1), dt.date(2024, 7, 1), T0), (None, None, None, None)], "window int, window_start date, window_end date, computed_at timestamp")
    got = {r.window: r for r in rolling.window_totals(rolling.daily_totals(usable_readings(spend(spark, rows))), w).collect()}
    assert set(got) == {1, 2}
    assert got[1].total == -2.0 and got[1].days == 2 and got[1].avg == pytest.approx(-2 / 181)
    assert got[2].total == 0.0 and got[2].days == 0


def test_running_sums_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.randrange(4), i, rng.choice([None, 1, 2])) for i in range(900)]
    rows += [(None, 1, 1000, 5), (None, 0, 1001, 7)]
    got = running_sums(spark.createDataFrame(rows, "g string, k int, id int, v int"), ("k", "id"), {"s": F.col("v")}, "g").collect()
    want, acc = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        acc[g] = acc.get(g, 0) + (v or 0)
        want[i] = acc[g]
    assert {r.id: r.s for r in got} == want
    assert running_sums(spark.createDataFrame([], "g string, k int, id int, v int"), ("k", "id"), {"s": F.col("v")}, "g").count() == 0


def imputation_table(n=600, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        g = ["a", "b", None][i % 3] if i % 10 else "a"
        x = float(rng.normal())
        y = 2 * x + {"a": 0.0, "b": 3.0, None: -3.0}[g] + float(rng.normal(0, 0.1))
        kind = "matched" if x > 0 else "proxy"
        out.append((i, g, x, y, kind))
    return out


def test_predictive_mean_matching_recovers_held_out_values(spark):
    rows = imputation_table()
    hidden = {r[0]: r[3] for r in rows if r[0] % 7 == 0}
    shown = [(i, g, x, None if i in hidden else y, k) for i, g, x, y, k in rows]
    df = spark.createDataFrame(shown, "id long, g string, x double, y double, kind string")
    fill = impute.Fill("y", F.expr("y BETWEEN -50 AND 50"), F.col("y"))
    out = {r.id: r for r in impute.filled(df, "id", "g", [fill], ["x"]).collect()}
    observed = {r[0]: (r[1], r[3]) for r in shown if r[3] is not None}
    errors = []
    for i, y in hidden.items():
        r = out[i]
        assert r.y_filled and observed[r.y_donor] == (r.g, r.y)  # a copy of an observed value of the same group
        errors.append(abs(r.y - y))
    assert np.mean(errors) < 0.3
    assert all(not r.y_filled and r.y_donor is None for i, r in out.items() if i not in hidden)


def test_nearest_donor_is_exact(spark):
    rows = [(i, "g", float(v), None if i % 4 == 0 else float(v)) for i, v in enumerate([5, 1, 1, 1, 1, 9, 3, 7, 7, 2, 2, 8, 6])]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = impute.fill_by_matching(df, "id", "g", impute.Fill("y", F.col("y").isNotNull(), F.col("y")), ["x"]).collect()
    seen = {r[0]: r[2] for r in rows if r[3] is not None}
    for r in got:
        x = dict((a, c) for a, _, c, _ in rows)[r.id]
        best = min(abs(v - x) for v in seen.values())
        assert abs(seen[r._donor] - x) == best
        assert r._donor == min(k for k, v in seen.items() if v == seen[r._donor])


def test_filling_edge_cases(spark):
    schema = "id long, g string, x double, y double, y_filled string, kind string"
    fill = impute.Fill("y", F.expr("y BETWEEN -2 AND 2"), F.col("y"))
    # a group without donors borrows from all; sentinels never survive
    rows = [(1, "a", 1.0, 1.5, "c", "k"), (2, "b", 1.0, -999.0, "c", "k"), (3, "b", None, float("nan"), "c", "k"), (4, None, float("inf"), None, "c", "k")]
    got = {r.id: r for r in impute.filled(spark.createDataFrame(rows, schema), "id", "g", [fill], ["x"]).collect()}
    assert [got[i].y for i in (1, 2, 3, 4)] == [1.5] * 4 and [got[i].y_donor for i in (1, 2, 3, 4)] == [None, 1, 1, 1]
    none = {r.id: r for r in impute.filled(spark.createDataFrame(rows[1:], schema), "id", "g", [fill], ["x"]).collect()}
    assert all(r.y is None and r.y_filled and r.y_donor is None for r in none.values())
    assert impute.filled(spark.createDataFrame([], schema), "id", "g", [fill], ["x"]).count() == 0


def test_category_donor(spark):
    rows = [(i, g, x, y, "n/a" if i % 9 == 0 else k) for i, g, x, y, k in imputation_table(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, kind string")
    fill = impute.Fill("kind", F.expr("kind IN ('matched', 'proxy')"), (F.col("kind") == "matched").cast("double"))
    out = impute.filled(df, "id", "g", [fill], ["x"]).collect()
    assert {r.kind for r in out} == {"matched", "proxy"}
    right = [(r.kind == "matched") == (r.x > 0) for r in out if r.kind_filled]
    assert np.mean(right) > 0.8 and math.isfinite(len(right))

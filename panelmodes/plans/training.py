"""Queries of the general training-data operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmodes.functions.labels import CATEGORIES, TOTAL
from panelmodes.operators import impute, regular, rolling, widen
from panelmodes.operators.readings import usable_readings
from panelmodes.session import table

COLUMNS = dict(zip(CATEGORIES, ("total", "health", "marketplace", "food", "grocery", "transport")))

# What counts as real.
RATIO_REAL = "mob_logratio BETWEEN -2 AND 2"
SOURCE_REAL = "income_source IN ('matched', 'proxy')"
PROXY_REAL = "n_proxy BETWEEN 0 AND 5000"
FEATURE_PREDICTORS = ("share_health", "share_marketplace", "share_food", "share_grocery", "share_transport", "log_total", "cv_grocery", "growth_grocery")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return usable_readings(table(spark, d, "spend"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.empty_cells(widen.wide_months(_readings(spark, d)), ["mo_id", "ym"], CATEGORIES, "category")


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = widen.wide_months(_readings(spark, d))
    return wide.select("mo_id", "ym", *[F.col(f"`{c}`").alias(a) for c, a in COLUMNS.items()])


def p1_wide_mean(spark: SparkSession, d: str) -> DataFrame:
    wide = widen.wide_months(_readings(spark, d), "mean")
    return wide.select("mo_id", "ym", *[F.round(F.col(f"`{c}`"), 6).alias(a) for c, a in COLUMNS.items()])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regular.missing_months(regular.monthly_grid(_readings(spark, d)))


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    grid = regular.monthly_grid(_readings(spark, d))
    return grid.select("mo_id", "category", "ym", F.round("value", 6).alias("value"), "mark", F.col("before_day").cast("string").alias("before_day"), F.col("after_day").cast("string").alias("after_day"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling.daily_totals(_readings(spark, d).where(F.col("slot") == CATEGORIES.index(TOTAL)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.concentrated_days(_totals(spark, d))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.daily_report(_totals(spark, d))
    return out.select("mo_id", "on_day", *[F.round(c, 8).alias(c) for c in ("total_7", "avg_7", "total_30", "avg_30")], "days_7", "days_30")


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.window_totals(_totals(spark, d), table(spark, d, "dynamic_summary"))
    return out.select("mo_id", "window", F.round("total", 8).alias("total"), F.round("avg", 8).alias("avg"), "days")


def feature_fills() -> list[impute.Fill]:
    ratio, source = F.expr(RATIO_REAL), F.expr(SOURCE_REAL)
    return [
        impute.Fill("mob_logratio", ratio, F.col("mob_logratio")),
        impute.Fill("income_source", source, (F.col("income_source") == "matched").cast("double")),
    ]


def complete_features(spark: SparkSession, d: str) -> DataFrame:
    return impute.filled(table(spark, d, "features_szfo_v2_final"), "feat_id", "region", feature_fills(), FEATURE_PREDICTORS)


def complete_calibration(spark: SparkSession, d: str) -> DataFrame:
    """n_proxy from calibrations of the same region; quarters and the matched count predict."""
    calib = table(spark, d, "proxy_income_calibration").withColumn("time", F.col("calib_year") * 4 + F.col("qtr"))
    fill = impute.Fill("n_proxy", F.expr(PROXY_REAL), F.col("n_proxy"))
    return impute.filled(calib, "calib_id", "region", [fill], ("n_matched", "time", "qtr", "pearson_corr", "r2")).drop("time")


def _marks(df: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    cells = F.array_compact(F.array(*(F.when(F.col(f"{c}_filled"), F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value"), F.col(f"{c}_donor").alias("donor_id"))) for c in columns)))
    return df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.explode(cells).alias("c")).select("table_name", "row_id", "c.*")


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, field_name, value, donor_id) of every filled cell."""
    features = _marks(complete_features(spark, d), "features_szfo_v2_final", "feat_id", ["mob_logratio", "income_source"])
    return features.unionByName(_marks(complete_calibration(spark, d), "proxy_income_calibration", "calib_id", ["n_proxy"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_filled(spark, d).select("table_name", "row_id", "field_name")


def p4_complete(spark: SparkSession, d: str) -> DataFrame:
    return complete_features(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_wide, p1_wide_mean, p2_found, p2_series, p4_found, p4_filled, p4_complete, p5_found, p5_daily, p5_windows)}

_CLEAN = r"regexp_replace(period, '[\s\p{Z}\p{Cf}]+', '', 'g')"
_READ = rf"""
read AS (
  SELECT mo_id, spend_id, loaded_at, value, lower(translate(regexp_replace(category_15, '[\s\p{{Z}}\p{{C}}\p{{P}}]+', '', 'g'), 'ABCEHKMOPTXYaceopxyk', 'АВСЕНКМОРТХУасеорхук')) AS c, {_CLEAN} AS p
  FROM spend WHERE mo_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
),
usable AS (
  SELECT mo_id, spend_id, loaded_at, value, day, strftime(day, '%Y-%m') AS ym, CASE
      WHEN c LIKE '%категори%' THEN 'Все категории' WHEN c LIKE '%здоров%' THEN 'Здоровье' WHEN c LIKE '%маркет%' THEN 'Маркетплейсы'
      WHEN c LIKE '%общепит%' OR c LIKE '%питани%' THEN 'Общественное питание' WHEN c LIKE '%прод%' THEN 'Продовольствие' WHEN c LIKE '%трансп%' THEN 'Транспорт' END AS category
  FROM (SELECT *, try_cast(CASE
      WHEN regexp_matches(p, '^[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}([T ]?[0-9]{{1,2}}:.*)?$') THEN p[1:4] || '-' || p[6:7] || '-' || p[9:10]
      WHEN regexp_matches(p, '^[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}}$') THEN p[7:10] || '-' || p[4:5] || '-' || p[1:2]
      WHEN regexp_matches(p, '^[0-9]{{8}}$') THEN p[1:4] || '-' || p[5:6] || '-' || p[7:8]
      WHEN regexp_matches(p, '^[0-9]{{4}}[-/.][0-9]{{2}}$') THEN p[1:4] || '-' || p[6:7] || '-01' END AS DATE) AS day FROM read)
  WHERE day IS NOT NULL AND day >= DATE '0001-01-01'
),
usable6 AS (SELECT * FROM usable WHERE category IS NOT NULL)
"""
_NAMES = ", ".join(f"('{c}')" for c in CATEGORIES)
_TOTALS = rf"""{_READ},
days AS (SELECT mo_id, day, sum(amount)::DECIMAL(27,6) AS total FROM (SELECT DISTINCT mo_id, day, CAST(value AS DECIMAL(20,6)) AS amount FROM usable6 WHERE category = 'Все категории') GROUP BY ALL),
span AS (SELECT mo_id, min(day) AS first, max(day) AS last FROM days GROUP BY ALL),
cal AS (SELECT mo_id, first, last, unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE AS day FROM span),
daily AS (
  SELECT c.mo_id, c.day, c.first, coalesce(d.total, 0) AS total, (d.total IS NOT NULL)::INT AS has
  FROM cal c LEFT JOIN days d USING (mo_id, day)
),
rolled AS (
  SELECT mo_id, day, first, sum(total) OVER w7 AS t7, sum(total) OVER w30 AS t30, sum(has) OVER w7 AS n7, sum(has) OVER w30 AS n30
  FROM daily WINDOW w7 AS (PARTITION BY mo_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY mo_id ORDER BY day ROWS 29 PRECEDING)
)
"""


def _wide_sql(cell: str) -> str:
    cells = ", ".join(f"{cell.format(c=c)} AS {a}" for c, a in COLUMNS.items())
    return f"WITH {_READ} SELECT mo_id, ym, {cells} FROM usable6 GROUP BY mo_id, ym"


SQL: dict[str, str] = {
    "p1_found": f"""WITH {_READ}, months AS (SELECT DISTINCT mo_id, ym FROM usable6), grid AS (SELECT mo_id, ym, c.category FROM months, (VALUES {_NAMES}) c(category))
        SELECT g.mo_id, g.ym, g.category FROM grid g ANTI JOIN usable6 u ON g.mo_id = u.mo_id AND g.ym = u.ym AND g.category = u.category""",
    "p1_wide": _wide_sql("arg_max(value, row(day, loaded_at, spend_id)) FILTER (WHERE category = '{c}')"),
    "p1_wide_mean": _wide_sql("round(avg(value) FILTER (WHERE category = '{c}'), 6)"),
    "p2_found": f"""WITH {_READ}, m AS (SELECT DISTINCT mo_id, category, date_trunc('month', day)::DATE AS m FROM usable6),
        s AS (SELECT mo_id, category, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM m GROUP BY mo_id, category)
        SELECT s.mo_id, s.category, strftime(s.m, '%Y-%m') AS ym FROM s ANTI JOIN m USING (mo_id, category, m)""",
    "p2_series": f"""WITH {_READ}, d AS (SELECT mo_id, category, day, date_trunc('month', day)::DATE AS m, arg_max(value, row(loaded_at, spend_id, value)) AS value FROM usable6 GROUP BY ALL),
        mm AS (SELECT mo_id, category, m, avg(value) AS mean FROM d GROUP BY ALL),
        s AS (SELECT mo_id, category, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM d GROUP BY mo_id, category),
        g AS (SELECT s.*, mm.mean FROM s LEFT JOIN mm USING (mo_id, category, m)),
        b AS (SELECT g.*, d.day AS bd, d.value AS bv FROM g ASOF LEFT JOIN d ON g.mo_id = d.mo_id AND g.category = d.category AND d.day < g.m),
        a AS (SELECT b.*, d.day AS ad, d.value AS av FROM b ASOF LEFT JOIN d ON b.mo_id = d.mo_id AND b.category = d.category AND d.day >= b.m)
        SELECT mo_id, category, strftime(m, '%Y-%m') AS ym,
          round(CASE WHEN mean IS NOT NULL THEN mean WHEN ad - bd <= 124 THEN bv + (av - bv) * ((m - bd)::DOUBLE / (ad - bd)) END, 6) AS value,
          CASE WHEN mean IS NOT NULL THEN 'observed' WHEN ad - bd <= 124 THEN 'interpolated' ELSE 'gap' END AS mark,
          CASE WHEN mean IS NULL THEN bd::VARCHAR END AS before_day, CASE WHEN mean IS NULL THEN ad::VARCHAR END AS after_day FROM a""",
    "p4_found": f"""SELECT 'features_szfo_v2_final' AS table_name, feat_id AS row_id, 'mob_logratio' AS field_name FROM features_szfo_v2_final WHERE NOT coalesce(NOT isnan(mob_logratio) AND {RATIO_REAL}, false)
        UNION ALL SELECT 'features_szfo_v2_final', feat_id, 'income_source' FROM features_szfo_v2_final WHERE NOT coalesce({SOURCE_REAL}, false)
        UNION ALL SELECT 'proxy_income_calibration', calib_id, 'n_proxy' FROM proxy_income_calibration WHERE NOT coalesce({PROXY_REAL}, false)""",
    "p5_found": f"""WITH {_TOTALS} SELECT mo_id, day::VARCHAR AS on_day FROM rolled WHERE day >= first + 29 AND n30 >= 10 AND t7 > 0.6 * t30""",
    "p5_daily": f"""WITH {_TOTALS} SELECT mo_id, day::VARCHAR AS on_day, round(t7::DOUBLE, 4) AS total_7, round(t7::DOUBLE / least(7, day - first + 1), 8) AS avg_7,
        round(t30::DOUBLE, 4) AS total_30, round(t30::DOUBLE / least(30, day - first + 1), 8) AS avg_30, n7::BIGINT AS days_7, n30::BIGINT AS days_30 FROM rolled""",
    "p5_windows": f"""WITH {_TOTALS}, w AS (SELECT "window", arg_max(window_start, computed_at) AS a, last_day(arg_max(window_end, computed_at)) AS b FROM dynamic_summary GROUP BY ALL)
        SELECT s.mo_id, w."window", round(coalesce(sum(d.total), 0)::DOUBLE, 4) AS total, round(coalesce(sum(d.total), 0)::DOUBLE / (w.b - w.a + 1), 8) AS avg, count(d.total)::BIGINT AS days
        FROM span s JOIN w ON date_trunc('month', s.first) <= w.b AND last_day(s.last) >= w.a LEFT JOIN days d ON d.mo_id = s.mo_id AND d.day BETWEEN w.a AND w.b GROUP BY s.mo_id, w."window", w.a, w.b""",
}

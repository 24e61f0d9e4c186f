"""The star schema and the spending tables as panels, feature tables and labelled points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmodes.config import QUARTERLY
from panelmodes.operators import linalg, panel
from panelmodes.session import table

TOTAL = "total"
CATS = ("economy", "large", "medium", "promo", "small")
FEATURES = (*(f"share_{c}" for c in CATS), "log_total", *(f"growth_{c}" for c in CATS), *(f"cv_{c}" for c in CATS), "mob_logratio")
WINDOW_FEATURES = (*(f"share_{c}" for c in CATS), "log_total", *(f"growth_share_{c}" for c in CATS), *(f"cv_share_{c}" for c in CATS))


def panel_l(spark: SparkSession, d: str) -> DataFrame:
    """Supplier x quarter x part type: shipped value, with a total row over all types."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.trunc("l_shipdate", "quarter").alias("period"), "l_extendedprice")
    parts = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("category"))
    cells = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity"), "period", "category").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    cells = cells.repartition("entity")  # all that follows groups by entity and more; an entity has a cell per period and category at most
    # The total is one more grouping of the same cells, so the join and the first aggregate run once.
    both = cells.select("entity", "period", F.explode(F.array("category", F.lit(TOTAL))).alias("category"), "value")
    return both.groupBy("entity", "period", "category").agg(F.round(F.sum("value"), 2).alias("value"))


def wide_l(spark: SparkSession, d: str) -> DataFrame:
    return panel.pivot_mean(panel_l(spark, d), ["entity", "period"], [TOTAL, *CATS])


def long_wide_l(spark: SparkSession, d: str) -> DataFrame:
    return panel.keep_long_series(wide_l(spark, d), QUARTERLY.min_periods)


def index_l(spark: SparkSession, d: str) -> DataFrame:
    """Supplier's shipped quantity in the two years: the analog of an index read at two dates."""
    rows = table(spark, d, "lineitem").where(F.year("l_shipdate").isin(*QUARTERLY.years))
    return rows.groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "year").alias("period")).agg(F.sum("l_quantity").alias("value"))


def features_l(spark: SparkSession, d: str, wide: DataFrame | None = None) -> DataFrame:
    """``wide`` is the panel of ``long_wide_l`` where the caller holds it."""
    static = panel.static_features(long_wide_l(spark, d) if wide is None else wide, TOTAL, CATS, QUARTERLY)
    return panel.join_index(static, panel.two_period_logratio(index_l(spark, d))).select("entity", *FEATURES)


def scaled_l(spark: SparkSession, d: str) -> DataFrame:
    return linalg.zscore(features_l(spark, d), FEATURES)


def window_features_l(spark: SparkSession, d: str, wide: DataFrame | None = None) -> DataFrame:
    return panel.window_features(panel.assign_windows(long_wide_l(spark, d) if wide is None else wide, QUARTERLY.window_length), TOTAL, CATS, QUARTERLY)


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


PANEL_SQL = """
cells AS (SELECT l_suppkey AS entity, date_trunc('quarter', l_shipdate)::DATE AS period, lower(p_type) AS category, round(sum(l_extendedprice), 2) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
panel AS (SELECT * FROM cells UNION ALL SELECT entity, period, 'total', round(sum(value), 2) FROM cells GROUP BY 1, 2),
wide AS (SELECT entity, period, """ + ", ".join(f"avg(value) FILTER (WHERE category = '{c}') AS {c}" for c in (TOTAL, *CATS)) + " FROM panel GROUP BY 1, 2)"

LONG_SQL = PANEL_SQL + f", long AS (SELECT * FROM wide WHERE entity IN (SELECT entity FROM wide GROUP BY 1 HAVING count(*) >= {QUARTERLY.min_periods}))"

_Y1, _Y2 = QUARTERLY.years


def _static_sql() -> str:
    aggs = [f"count(*) FILTER (WHERE year(period) = {_Y1}) AS n1", f"count(*) FILTER (WHERE year(period) = {_Y2}) AS n2", f"avg({TOTAL}) FILTER (WHERE year(period) = {_Y2}) AS size"]
    for c in CATS:
        aggs += [f"avg({c}) FILTER (WHERE year(period) = {_Y1}) AS a_{c}", f"avg({c}) FILTER (WHERE year(period) = {_Y2}) AS b_{c}", f"stddev_pop({c}) FILTER (WHERE year(period) = {_Y2}) AS s_{c}", f"count({c}) FILTER (WHERE year(period) = {_Y2}) AS k_{c}"]
    cols = [f"b_{c} / size AS share_{c}" for c in CATS] + ["ln(1 + size) AS log_total"]
    cols += [f"CASE WHEN n1 < {QUARTERLY.min_year_rows} OR a_{c} IS NULL OR a_{c} <= 0 THEN 0 ELSE (b_{c} - a_{c}) / a_{c} END AS growth_{c}" for c in CATS]
    cols += [f"CASE WHEN k_{c} = n2 AND b_{c} > 0 THEN s_{c} / b_{c} ELSE 0 END AS cv_{c}" for c in CATS]
    return f"sums AS (SELECT entity, {', '.join(aggs)} FROM long GROUP BY 1), static AS (SELECT entity, {', '.join(cols)} FROM sums WHERE n2 >= {QUARTERLY.min_year_rows} AND size > 0)"


STATIC_SQL = LONG_SQL + ", " + _static_sql()
RATIO_SQL = f"""idx AS (SELECT l_suppkey AS entity, year(l_shipdate) AS y, sum(l_quantity) AS value FROM lineitem WHERE year(l_shipdate) IN ({_Y1}, {_Y2}) GROUP BY 1, 2),
ratio AS (SELECT entity, CASE WHEN (SELECT count(DISTINCT y) FROM idx) = 2 THEN ln(1 + avg(value) FILTER (WHERE y = {_Y2})) - ln(1 + avg(value) FILTER (WHERE y = {_Y1})) ELSE 0 END AS mob_logratio FROM idx GROUP BY 1)"""
FEATURES_SQL = f"{STATIC_SQL}, {RATIO_SQL}, features AS (SELECT s.*, coalesce(r.mob_logratio, 0) AS mob_logratio FROM static s LEFT JOIN ratio r USING (entity))"
SCALED_SQL = FEATURES_SQL + ", scaled AS (SELECT entity, " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () WHEN {c} IS NOT NULL THEN 0 END AS {c}" for c in FEATURES) + " FROM features)"

WINDOW_SQL = LONG_SQL + f""", per AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS m, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM long)),
wins AS (SELECT a.m + 1 AS "window", a.period AS window_start, b.period AS window_end FROM per a JOIN per b ON b.m = a.m + {QUARTERLY.window_length - 1}),
windowed AS (SELECT w.*, l.* FROM long l JOIN wins w ON l.period BETWEEN w.window_start AND w.window_end)"""


def _window_sql() -> str:
    k = QUARTERLY.edge_rows
    base = ", ".join(f"{c} / total AS s_{c}" for c in CATS)
    aggs = ", ".join(f"avg(s_{c}) AS share_{c}, avg(s_{c}) FILTER (WHERE i <= {k}) AS h_{c}, avg(s_{c}) FILTER (WHERE j <= {k}) AS t_{c}, stddev_pop(s_{c}) AS d_{c}" for c in CATS)
    full = " AND ".join(f"{c} IS NOT NULL" for c in (TOTAL, *CATS))
    cols = [f"share_{c}" for c in CATS] + ["log_total"] + [f"(t_{c} - h_{c}) / (h_{c} + 1e-9) AS growth_share_{c}" for c in CATS] + [f"CASE WHEN share_{c} > 0 THEN d_{c} / share_{c} ELSE 0 END AS cv_share_{c}" for c in CATS]
    return f"""wrows AS (SELECT "window", entity, total, {base}, row_number() OVER (PARTITION BY "window", entity ORDER BY period) AS i, row_number() OVER (PARTITION BY "window", entity ORDER BY period DESC) AS j FROM windowed WHERE {full} AND total > 0),
wagg AS (SELECT "window", entity, count(*) AS n, ln(1 + avg(total)) AS log_total, {aggs} FROM wrows GROUP BY 1, 2 HAVING count(*) >= {QUARTERLY.window_min_rows}),
wfeat AS (SELECT "window", entity, {', '.join(cols)} FROM wagg WHERE "window" IN (SELECT "window" FROM wagg GROUP BY 1 HAVING count(*) >= {QUARTERLY.window_min_entities}))"""


WINDOW_FEATURES_SQL = WINDOW_SQL + ", " + _window_sql()
WLABEL_SQL = WINDOW_FEATURES_SQL + """, wlab AS (SELECT "window", entity, (share_economy > median(share_economy) OVER (PARTITION BY "window"))::INT AS label FROM wfeat)"""
POINTS_SQL = "pts AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL)"
PAIRS_SQL = POINTS_SQL + ", pairs AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_distance(a.x, b.x) AS d FROM pts a JOIN pts b ON a.id < b.id)"
LONG_POINTS_SQL = POINTS_SQL + ", lp AS (SELECT id, label, unnest(range(len(x))) AS d, unnest(x) AS x FROM pts), cents AS (SELECT label, d, avg(x) AS c, count(*) AS n, var_pop(x) AS v FROM lp GROUP BY 1, 2)"

"""One query for each operator of the typology, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmodes.config import QUARTERLY
from panelmodes.functions import dates, markup, names
from panelmodes.operators import audit, cluster, dynamics, linalg, panel, plm, stability, validity
from panelmodes.plans import panels
from panelmodes.plans.panels import CATS, FEATURES, TOTAL, WINDOW_FEATURES
from panelmodes.session import cut, ensure_checkpoint_dir, release, table
from panelmodes.sources import archives
from panelmodes.streaming import panel_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A fixed leading vector, so that what follows a fit can be checked without one.
LOADING = tuple((1.0 if i % 2 == 0 else -0.5) / 4 for i in range(len(FEATURES)))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, negative zeros made plain, dates as text, counts as BIGINT."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif t == "date":
            c = c.cast("string")
        elif t in ("int", "bigint", "smallint"):
            c = c.cast("long")
        out.append(c.alias(n))
    return df.select(*out)


def _r(columns: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# --- panels ------------------------------------------------------------------------------------------------------


@query(f"WITH {panels.PANEL_SQL} SELECT entity, period::VARCHAR AS period, {_r((TOTAL, *CATS))} FROM wide")
def panel_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.wide_l(spark, d))


@query(f"WITH {panels.LONG_SQL} SELECT entity, period::VARCHAR AS period, {_r((TOTAL, *CATS))} FROM long")
def panel_min_months(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.long_wide_l(spark, d))


@query(f"WITH {panels.STATIC_SQL} SELECT entity, {_r(FEATURES[:-1])} FROM static")
def features_static(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.static_features(panels.long_wide_l(spark, d), TOTAL, CATS, QUARTERLY))


@query(f"WITH {panels.RATIO_SQL} SELECT entity, round(mob_logratio, 6) + 0.0 AS mob_logratio FROM ratio")
def mobility_logratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.two_period_logratio(panels.index_l(spark, d)))


@query(f"WITH {panels.FEATURES_SQL} SELECT entity, {_r(FEATURES)} FROM features")
def features_joined(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.features_l(spark, d))


@query(
    """WITH w AS (SELECT o.o_orderdate, c.c_nationkey AS entity, c.c_mktsegment AS category, o.o_totalprice AS value FROM orders o JOIN customer c ON o_custkey = c_custkey),
    p AS (SELECT entity, date_trunc('month', o_orderdate)::DATE AS period, category, avg(value) AS v FROM w GROUP BY 1, 2, 3)
    SELECT entity::BIGINT AS entity, period::VARCHAR AS period, """
    + ", ".join(f"round(max(v) FILTER (WHERE category = '{s}'), 4) AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM p GROUP BY 1, 2"
)
def panel_orders(spark: SparkSession, d: str) -> DataFrame:
    """Sparse panel: nation x month x segment."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    long = rows.select(F.col("c_nationkey").alias("entity"), F.trunc("o_orderdate", "month").alias("period"), F.lower("c_mktsegment").alias("category"), F.col("o_totalprice").alias("value"))
    return rounded(panel.pivot_mean(long, ["entity", "period"], ["automobile", "building", "furniture", "household", "machinery"]), 4)


@query(
    """SELECT user_id AS entity, ts::DATE::VARCHAR AS period, """
    + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS n_{t}" for t in ("click", "error", "purchase", "scroll", "view"))
    + " FROM events WHERE value IS NOT NULL GROUP BY 1, 2"
)
def panel_events(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "scroll", "view"]
    long = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("period"), F.col("event_type").alias("category"), "value")
    wide = panel.pivot_mean(long, ["entity", "period"], kinds)
    return rounded(wide.select("entity", "period", *[F.col(k).alias(f"n_{k}") for k in kinds]))


@query("""SELECT l_suppkey AS entity, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def semi_entities(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(keys, "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("""SELECT c_custkey AS entity, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND year(o_orderdate) = 1998)""")
def anti_entities(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").where(F.year("o_orderdate") == 1998).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))


@query("""SELECT c_custkey AS c_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def any_match(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return audit.any_match(table(spark, d, "customer").select("c_custkey"), orders, F.col("o_custkey") == F.col("c_custkey"), "c_custkey", "urgent")


_WS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_NORM = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(@c), '^{_WS}+|{_WS}+$', '', 'g'), '{names.CITY_PHRASE}', '', 'g'), '{names.KIND_WORDS}', '', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"""


@query(f"SELECT mo_id, {_NORM.replace('@c', 'mo')} AS name FROM mo_cards")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mo_cards").select("mo_id", names.territory_name(F.col("mo")).alias("name"))


@query(f"SELECT DISTINCT area_id, replace(lower(regexp_replace(ref_area, '^{_WS}+|{_WS}+$', '', 'g')), 'ё', 'е') AS name FROM mobility")
def name_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mobility").select("area_id", names.plain_name(F.col("ref_area")).alias("name")).distinct()


#: Ordered region keys of this project's tables.
PROJECT_REGIONS = (("вельтор", "ВелОбл"), ("камжур", "КамОбл"), ("ордыхт", "ОрдОбл"), ("сивечар", "СивОбл"), ("тарво", "ТарОбл"), ("онгрус", "ОнгРесп"), ("гурвел", "ГурКрай"))


@query(
    "SELECT mo_id, CASE "
    + " ".join(f"WHEN contains(replace(lower(region_raw), 'ё', 'е'), '{k}') THEN '{v}'" for k, v in PROJECT_REGIONS)
    + " END AS region, coalesce("
    + " OR ".join(f"contains(lower(region_raw), '{w}')" for w in names.REGION_WORDS)
    + ", false) AS is_region, coalesce("
    + " OR ".join(f"contains(lower(mo), '{w}')" for w in names.HEADER_WORDS)
    + ", false) AS is_header FROM mo_cards"
)
def region_detect(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "mo_cards")
    return c.select("mo_id", names.first_key(F.col("region_raw"), PROJECT_REGIONS).alias("region"), names.looks_like_region(F.col("region_raw")).alias("is_region"), names.is_header(F.col("mo")).alias("is_header"))


@query("""SELECT spend_id, try_cast(trim(period) AS DOUBLE) AS number, CASE WHEN regexp_matches(replace(replace(period, ' ', ''), chr(160), ''), '^[0-9]+$') THEN replace(replace(period, ' ', ''), chr(160), '') END AS code FROM spend""")
def safe_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spend").select("spend_id", names.number_or_null(F.col("period")).alias("number"), names.digits_or_null(F.col("period")).alias("code"))


@query(f"""SELECT {_NORM.replace('@c', 'mo')} AS name, count(DISTINCT region_raw) AS n_regions, count(*) AS n_rows FROM mo_cards WHERE mo IS NOT NULL AND region_raw IS NOT NULL GROUP BY 1 HAVING count(DISTINCT region_raw) > 1""")
def collisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "mo_cards").select(names.territory_name(F.col("mo")).alias("n"), "region_raw")
    return audit.collisions(c, "n", "region_raw")


@query(f"""WITH {panels.WINDOW_SQL} SELECT "window", window_start::VARCHAR AS window_start, window_end::VARCHAR AS window_end, count(*) AS n, count(DISTINCT entity) AS entities FROM windowed GROUP BY 1, 2, 3""")
def window_assign(spark: SparkSession, d: str) -> DataFrame:
    w = panel.assign_windows(panels.long_wide_l(spark, d), QUARTERLY.window_length)
    return rounded(w.groupBy("window", "window_start", "window_end").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities")))


@query(f"""WITH {panels.WINDOW_FEATURES_SQL} SELECT "window", entity, {_r(WINDOW_FEATURES)} FROM wfeat""")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.window_features_l(spark, d))


def window_labels(spark: SparkSession, d: str) -> DataFrame:
    """A labeling of every window that needs no fit."""
    f = cut(panels.window_features_l(spark, d).select("window", "entity", "share_economy"))
    return cluster.median_split(f, "share_economy", ["window"]).select("window", "entity", "label")


@query(f"""WITH {panels.WLABEL_SQL} SELECT entity FROM wlab GROUP BY 1 HAVING count(DISTINCT "window") = (SELECT count(DISTINCT "window") FROM wlab)""")
def entities_all_windows(spark: SparkSession, d: str) -> DataFrame:
    return panel.in_all_windows(window_labels(spark, d))


_STEPS = """steps AS (SELECT *, lag(label) OVER p AS prev, lag("window") OVER p AS prev_window FROM wlab WINDOW p AS (PARTITION BY entity ORDER BY "window"))"""


@query(f"""WITH {panels.WLABEL_SQL}, {_STEPS} SELECT entity, count(*) FILTER (WHERE prev <> label) AS n_switches FROM steps GROUP BY 1""")
def switch_counts(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.switch_counts(window_labels(spark, d))


@query(f"""WITH {panels.WLABEL_SQL}, {_STEPS} SELECT entity, prev_window AS from_window, "window" AS to_window, prev::BIGINT AS from_label, label::BIGINT AS to_label FROM steps WHERE prev <> label""")
def switch_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dynamics.switch_events(window_labels(spark, d)))


_ARI = """cont AS (SELECT {k} a, b, count(*)::DOUBLE AS n FROM pairing GROUP BY ALL), tot AS (SELECT {k} sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM cont GROUP BY ALL),
sa AS (SELECT {k} sum(m * (m - 1) / 2) AS s FROM (SELECT {k} a, sum(n) AS m FROM cont GROUP BY ALL) GROUP BY ALL), sb AS (SELECT {k} sum(m * (m - 1) / 2) AS s FROM (SELECT {k} b, sum(n) AS m FROM cont GROUP BY ALL) GROUP BY ALL)"""
_ARI_VALUE = "CASE WHEN (sa.s + sb.s) / 2 - sa.s * sb.s / (tot.n * (tot.n - 1) / 2) = 0 THEN 1 ELSE (tot.s - sa.s * sb.s / (tot.n * (tot.n - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (tot.n * (tot.n - 1) / 2)) END"


@query(
    f"""WITH {panels.WLABEL_SQL}, pairing AS (SELECT x."window" AS w, x.label AS a, y.label AS b FROM wlab x JOIN wlab y ON x.entity = y.entity AND y."window" = x."window" + 1), {_ARI.format(k="w,")}
    SELECT w AS from_window, w + 1 AS to_window, tot.n::BIGINT AS n, round({_ARI_VALUE}, 6) + 0.0 AS ari FROM tot JOIN sa USING (w) JOIN sb USING (w) WHERE tot.n >= 10"""
)
def window_ari(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dynamics.consecutive_ari(cut(window_labels(spark, d))))


@query(
    f"""WITH {panels.WLABEL_SQL}, {_STEPS}, ev AS (SELECT entity, prev_window AS fw, "window" AS tw, prev AS fl, label AS tl FROM steps WHERE prev <> label),
    pairing AS (SELECT x."window" AS w, x.label AS a, y.label AS b FROM wlab x JOIN wlab y ON x.entity = y.entity AND y."window" = x."window" + 1), {_ARI.format(k="w,")},
    agree AS (SELECT w, round({_ARI_VALUE}, 6) + 0.0 AS ari FROM tot JOIN sa USING (w) JOIN sb USING (w) WHERE tot.n >= 10),
    met AS (SELECT "window" AS w, arg_max(pr_plus, computed_at) AS pr, arg_max(frustration, computed_at) AS fr, arg_max(n_communities, computed_at) AS nc FROM dynamic_summary GROUP BY 1)
    SELECT entity, fw AS from_window, tw AS to_window, fl::BIGINT AS from_label, tl::BIGINT AS to_label, round(f.pr, 6) + 0.0 AS pr_plus_from, round(t.pr, 6) + 0.0 AS pr_plus_to, round(f.fr, 6) + 0.0 AS frustration_from, round(t.fr, 6) + 0.0 AS frustration_to,
    f.nc::BIGINT AS n_communities_from, t.nc::BIGINT AS n_communities_to, CASE WHEN tw = fw + 1 THEN ari END AS ari FROM ev LEFT JOIN met f ON f.w = fw LEFT JOIN met t ON t.w = tw LEFT JOIN agree ON agree.w = fw"""
)
def switch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Switches with the stored metrics of both windows (of several computations the latest) and the agreement between the windows."""
    labels = cut(window_labels(spark, d))
    stored = table(spark, d, "dynamic_summary").groupBy("window").agg(*[F.max_by(c, "computed_at").alias(c) for c in ("pr_plus", "frustration", "n_communities")])
    return rounded(dynamics.events_with_metrics(dynamics.switch_events(labels), stored, dynamics.consecutive_ari(labels)))


# A small sheet, line by line: columns 0 to 3.
SHEET = (
    (1, None, "Содержание", None, None),
    (2, None, "Новгородская область", None, None),
    (3, "1", "Боровичский район", "49 606 000", "31.5"),
    (4, "2", "Муниципальные районы", "49", "3"),
    (5, None, "Муниципальные районы", None, None),
    (6, "3", " Валдайский район ", "49\u00a0608 000", "abc"),
    (7, "4", "Окуловский район", "49x", "28.25"),
    (8, None, "Тверская область", None, None),
    (9, "5", "Бежицкий район", "28", "20"),
    (10, None, "Республика Карелия", None, None),
    (11, "6", "Кемский район", None, "44"),
    (12, None, "примечание", None, None),
    (13, "7", "Лоухский район", "86", " 51.75 "),
)


def _lit(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


_SHEET_SQL = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in SHEET)
_HEAD = " OR ".join(f"contains(lower(t), '{w}')" for w in names.HEADER_WORDS)
_REG = " OR ".join(f"contains(lower(t), '{w}')" for w in names.REGION_WORDS)
_DET = "CASE " + " ".join(f"WHEN contains(replace(lower(t), 'ё', 'е'), '{k}') THEN '{v}'" for k, v in names.REGION_KEYS) + " END"


@query(
    f"""WITH s AS (SELECT *, regexp_replace(c1, '^\\s+|\\s+$', '', 'g') AS t FROM (VALUES {_SHEET_SQL}) v(line, c0, c1, c2, c3)),
    m AS (SELECT *, CASE WHEN c0 IS NULL AND c1 IS NOT NULL AND c3 IS NULL AND NOT ({_HEAD}) AND ({_REG}) THEN coalesce({_DET}, '#') END AS mark FROM s),
    r AS (SELECT *, last_value(mark IGNORE NULLS) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS region FROM m)
    SELECT line::BIGINT AS line, region, t AS name, CASE WHEN regexp_matches(replace(replace(c2, ' ', ''), chr(160), ''), '^[0-9]+$') THEN replace(replace(c2, ' ', ''), chr(160), '') END AS code, try_cast(trim(c3) AS DOUBLE) AS value
    FROM r WHERE c3 IS NOT NULL AND t IS NOT NULL AND region <> '#' AND t <> '' AND NOT ({_HEAD}) AND try_cast(trim(c3) AS DOUBLE) IS NOT NULL"""
)
def carry_down(spark: SparkSession, d: str) -> DataFrame:
    sheet = spark.createDataFrame(list(SHEET), "line int, col0 string, col1 string, col2 string, col3 string")
    return rounded(panel.carry_down(sheet))


_CARD_KEYS = "CASE " + " ".join(f"WHEN contains(replace(lower(t), 'ё', 'е'), '{k}') THEN '{v}'" for k, v in PROJECT_REGIONS) + " END"


@query(
    f"""WITH c AS (SELECT mo_id, region_raw AS file, regexp_replace(region_raw, '^{_WS}+|{_WS}+$', '', 'g') AS t, regexp_replace(mo, '^{_WS}+|{_WS}+$', '', 'g') AS name, residents FROM mo_cards WHERE region_raw IS NOT NULL),
    m AS (SELECT *, CASE WHEN NOT ({_HEAD}) AND ({_REG}) THEN coalesce({_CARD_KEYS}, '#') END AS region FROM c)
    SELECT file, mo_id AS line, region, name, residents::DOUBLE AS value FROM (SELECT m.*, name AS t FROM (SELECT * EXCLUDE (t) FROM m) m) WHERE region IS NOT NULL AND region <> '#' AND name <> '' AND residents IS NOT NULL AND NOT ({_HEAD})"""
)
def carry_down_cards(spark: SparkSession, d: str) -> DataFrame:
    """The register as sheets, one for each spelling of a region with its header before the entities: every header reaches its own sheet only."""
    cards = table(spark, d, "mo_cards").where("region_raw IS NOT NULL")
    heads = cards.select(F.col("region_raw").alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("line"), F.lit(None).cast("string").alias("col0"), F.col("file").alias("col1"), F.lit(None).cast("string").alias("col2"), F.lit(None).cast("string").alias("col3"))
    rows = cards.select(F.col("region_raw").alias("file"), F.col("mo_id").alias("line"), F.col("mo_id").cast("string").alias("col0"), F.col("mo").alias("col1"), F.lit(None).cast("string").alias("col2"), F.col("residents").cast("string").alias("col3"))
    return rounded(panel.carry_down(heads.unionByName(rows), PROJECT_REGIONS).select("file", "line", "region", "name", "value"))


@query(f"""WITH {panels.PANEL_SQL} SELECT entity, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value) / avg(value), 6) AS cv FROM panel WHERE category = 'promo' AND value IS NOT NULL GROUP BY 1""")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    """How much each entity's periods of one category vary; its three largest are in ``topk_months``."""
    return rounded(audit.seasonality(panels.panel_l(spark, d), "promo").withColumn("mean", F.round("mean", 4)))


@query(f"""WITH {panels.PANEL_SQL} SELECT entity, place, period::VARCHAR AS period, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, period) AS place FROM panel WHERE category = 'total' AND value IS NOT NULL) WHERE place <= 3""")
def topk_months(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.top_periods(panels.panel_l(spark, d), TOTAL))


@query("SELECT year(o_orderdate) AS year, o_orderkey AS id, o_totalprice AS value FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def union_years(spark: SparkSession, d: str) -> DataFrame:
    """Tables of single years, stacked by name."""
    orders = table(spark, d, "orders")
    parts = [orders.where(F.year("o_orderdate") == y).select(F.lit(y).cast("long").alias("year"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")) for y in range(1996, 2000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT o_custkey AS entity FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def entities_both_years(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("entity"))
    return year(1996).intersect(year(1997))


@query("""SELECT o_custkey AS entity FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def entities_first_year_only(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("entity"))
    return year(1996).subtract(year(1997))


@query("SELECT o_orderkey AS id, o_totalprice AS value, o_orderdate::DATE::VARCHAR AS day, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31' AND o_orderpriority LIKE '%URGENT%'")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    """Both ends inclusive, pushed to the scan, with a substring predicate."""
    o = table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1997-03-01").cast("timestamp"), F.lit("1997-05-31").cast("timestamp")) & F.col("o_orderpriority").contains("URGENT"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").cast("string").alias("day"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"))


@query("SELECT l_suppkey AS entity, round(sum(l_quantity), 4) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-06-01' GROUP BY 1")
def half_open_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-06-01").cast("timestamp")))
    return rows.groupBy(F.col("l_suppkey").alias("entity")).agg(F.round(F.sum("l_quantity"), 4).alias("value"))


@query("""SELECT spend_id, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE value END AS value FROM spend WHERE mo IS NOT NULL AND period IS NOT NULL""")
def drop_and_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spend").dropna(subset=["mo", "period"])
    return rows.select("spend_id", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


@query("SELECT unnest(['share_health', 'share_marketplace', 'share_food', 'share_grocery', 'share_transport', 'log_total', 'growth_health', 'growth_marketplace', 'growth_food', 'growth_grocery', 'growth_transport', 'cv_health', 'cv_marketplace', 'cv_food', 'cv_grocery', 'cv_transport', 'mob_logratio']) AS feature")
def feature_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns without ids, meta and income-like names."""
    t = table(spark, d, "features_szfo_v2_final")
    cols = names.without_income(panel.feature_columns(t.drop("feat_id", "mo_id"), sorted(QUARTERLY.meta)))
    return spark.createDataFrame([(c,) for c in cols], "feature string")


@query("""SELECT category, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS spread, round(median(v), 6) AS middle FROM (SELECT o_orderpriority AS category, o_totalprice AS v FROM orders) GROUP BY 1""")
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice")
    rows = table(spark, d, "orders").withColumn("category", F.col("o_orderpriority"))
    g = rows.groupBy("category").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("spread"))
    return g.join(linalg.exact_median(rows, "o_totalprice", ["category"], "middle").withColumn("middle", F.round("middle", 6)), "category")


@query("""SELECT mo_norm, round(avg(log_total), 6) AS log_total, round(avg(share_grocery), 6) AS share_grocery, count(*) AS n FROM features_szfo_v2_final GROUP BY 1""")
def duplicate_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features_szfo_v2_final").groupBy("mo_norm").agg(F.round(F.avg("log_total"), 6).alias("log_total"), F.round(F.avg("share_grocery"), 6).alias("share_grocery"), F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT region AS region_code, year::BIGINT AS year, CASE WHEN regexp_matches(period, '^(1|I|Ⅰ) ') THEN 1 WHEN regexp_matches(period, '^(2|II|Ⅱ) ') THEN 2 WHEN regexp_matches(period, '^(3|III|Ⅲ) ') THEN 3 WHEN regexp_matches(period, '^(4|IV|Ⅳ) ') THEN 4 END::BIGINT AS quarter, round(avg(income_rub_month), 4) AS income, count(*) AS n FROM sdd_quarterly_szfo GROUP BY 1, 2, 3)""")
def quarterly_income(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly incomes by region with the quarter read from text."""
    t = table(spark, d, "sdd_quarterly_szfo").select(F.col("region").alias("region_code"), F.col("year").cast("long"), dates.quarter_number(F.col("period")).cast("long").alias("quarter"), "income_rub_month")
    return t.groupBy("region_code", "year", "quarter").agg(F.round(F.avg("income_rub_month"), 4).alias("income"), F.count("*").alias("n"))


@query(f"WITH {panels.FEATURES_SQL} SELECT row_number() OVER (ORDER BY entity) - 1 AS row_no, entity FROM features")
def row_order(spark: SparkSession, d: str) -> DataFrame:
    return stability.row_numbers(panels.features_l(spark, d).select("entity"), "entity").select(F.col("_row").alias("row_no"), "entity")


@query("SELECT unnest(['share_marketplace', 'growth_transport', 'log_total', 'mob_logratio', 'cv_food']) AS feature, unnest(['mkt', 'g_trans', 'log tot', 'mob', 'cv_food']) AS short")
def feature_names_short(spark: SparkSession, d: str) -> DataFrame:
    names_of = spark.createDataFrame([(c,) for c in ("share_marketplace", "growth_transport", "log_total", "mob_logratio", "cv_food")], "feature string")
    return names_of.select("feature", names.short_feature(F.col("feature")).alias("short"))


_SHORT = "feature"
for _a, _b in names.SHORT_PARTS:
    _SHORT = f"replace({_SHORT}, '{_a}', '{_b}')"
_ALL_NAMES = ", ".join(f"'{c}'" for c in ("share_health", "share_marketplace", "share_food", "share_grocery", "share_transport", "log_total", "growth_health", "growth_marketplace", "growth_food", "growth_grocery", "growth_transport", "cv_health", "cv_marketplace", "cv_food", "cv_grocery", "cv_transport", "mob_logratio"))


@query(
    f"""WITH l AS (SELECT unnest([{_ALL_NAMES}]) AS feature, unnest([{_ALL_NAMES.replace("'", "")}]) AS v FROM features_szfo_v2_final)
    SELECT feature, {_SHORT} AS short, count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v)) AS n, round(avg(v) FILTER (WHERE NOT isnan(v)), 6) + 0.0 AS mean FROM l GROUP BY 1"""
)
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every feature that name-based pruning keeps of the table's columns, with its short name, values and mean."""
    t = table(spark, d, "features_szfo_v2_final")
    kept = audit.require_features(names.without_income(names.without_income(panel.feature_columns(t.drop("feat_id", "mo_id"), sorted(QUARTERLY.meta))), names.INCOME_PARTS_OTHER), 17)
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c), F.lit(None).cast("double")).alias("v")) for c in kept])).alias("f")).select("f.*")
    return rounded(long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).select("feature", names.short_feature(F.col("feature")).alias("short"), "n", "mean"))


def _markup_sql() -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    out = "text"
    for old, new in markup.GLYPHS:
        out = f"replace({out}, {q(old)}, {q(new)})"
    for pattern, new in markup.PATTERNS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(new.replace('@', chr(92)))}, 'g')"
    for old, new in markup.MARKS:
        out = f"replace({out}, {q(old)}, {q(new)})"
    out = f"regexp_replace({out}, {q(markup.HEADING)}, '')"
    for old, new in markup.FORMULAS:
        out = f"replace({out}, {q(old)}, {q(new)})"
    return out


@query(f"""SELECT doc_id, length(p)::BIGINT AS n_plain, sha256(p) AS plain_hash FROM (SELECT doc_id, {_markup_sql()} AS p FROM documents)""")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts without their light markup; their hash stands for them."""
    p = markup.plain_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(p).cast("long").alias("n_plain"), F.sha2(p, 256).alias("plain_hash"))


# --- standardised features and labels ----------------------------------------------------------------------------


@query(f"WITH {panels.SCALED_SQL} SELECT entity, {_r(FEATURES)} FROM scaled")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panels.scaled_l(spark, d))


@query(f"WITH {panels.SCALED_SQL} SELECT entity, {', '.join(f'coalesce((round({c}, 9) > 0)::BIGINT, 0) AS {c}' for c in FEATURES)} FROM scaled")
def binarize(spark: SparkSession, d: str) -> DataFrame:
    x = panels.scaled_l(spark, d)
    return rounded(linalg.binarize(x.withColumns({c: F.round(c, 9) for c in FEATURES}), FEATURES))


_U = " + ".join(f"{c} * {w}" for c, w in zip(FEATURES, LOADING))
_SPLIT_SQL = f"{panels.SCALED_SQL}, u AS (SELECT *, {_U} AS u1 FROM scaled), split AS (SELECT *, (u1 > (SELECT median(u1) FROM u))::INT AS label FROM u)"


def split_l(spark: SparkSession, d: str) -> DataFrame:
    return cluster.median_split(cut(panels.scaled_l(spark, d).withColumn("u1", linalg.dot(FEATURES, LOADING))), "u1")


@query(f"WITH {_SPLIT_SQL} SELECT entity, round(u1, 6) + 0.0 AS u1, label::BIGINT AS label FROM split")
def median_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(split_l(spark, d).select("entity", "u1", "label"))


@query(f"WITH {_SPLIT_SQL}, f AS (SELECT f.*, s.label FROM features f JOIN split s USING (entity)) SELECT label::BIGINT AS label, count(*) AS n, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in FEATURES)} FROM f GROUP BY 1")
def cluster_means(spark: SparkSession, d: str) -> DataFrame:
    f = panels.features_l(spark, d).join(split_l(spark, d).select("entity", "label"), "entity")
    return rounded(f.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in FEATURES]))


@query(
    f"""WITH {_SPLIT_SQL}, f AS (SELECT entity, s.label, {', '.join(f'f.{c}' for c in FEATURES)} FROM features f JOIN split s USING (entity)), l AS (UNPIVOT f ON {', '.join(FEATURES)} INTO NAME feature VALUE v),
    st AS (SELECT feature, median(v) AS m, avg(v) FILTER (WHERE label = 0) AS m0, avg(v) FILTER (WHERE label = 1) AS m1 FROM l GROUP BY 1)
    SELECT entity, feature, round(v, 6) + 0.0 AS value, round(m, 6) + 0.0 AS median, round(v - m, 6) + 0.0 AS delta, round(m0, 6) + 0.0 AS mean0, round(m1, 6) + 0.0 AS mean1,
    CASE WHEN abs(v - m0) < abs(v - m1) THEN '0' WHEN abs(v - m1) < abs(v - m0) THEN '1' ELSE 'tie' END AS closer FROM l JOIN st USING (feature)"""
)
def profile_vs_poles(spark: SparkSession, d: str) -> DataFrame:
    f = cut(panels.features_l(spark, d).join(split_l(spark, d).select("entity", "label"), "entity"))
    return rounded(audit.profile_vs_poles(f, FEATURES))


SIGNS = {c: (1 if w > 0 else -1) for c, w in zip(FEATURES, LOADING) if not c.startswith("growth")}
_SIGN = "CASE feature " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in SIGNS.items()) + " ELSE 0 END"


@query(
    f"""WITH {panels.FEATURES_SQL}, l AS (UNPIVOT (SELECT entity, {', '.join(FEATURES)} FROM features) ON {', '.join(FEATURES)} INTO NAME feature VALUE v), st AS (SELECT feature, median(v) AS m FROM l GROUP BY 1)
    SELECT entity, feature, CASE WHEN {_SIGN} = 0 THEN 'neutral' WHEN (v > m) = ({_SIGN} > 0) THEN 'toward' ELSE 'away' END AS direction FROM l JOIN st USING (feature)"""
)
def pole_direction(spark: SparkSession, d: str) -> DataFrame:
    """Whether each feature of each entity lies toward the pole its loading points to; growth features have no sign."""
    f = cut(panels.features_l(spark, d).join(split_l(spark, d).select("entity", "label"), "entity"))
    return audit.directions(audit.profile_vs_poles(f, FEATURES), SIGNS).select("entity", "feature", "direction")


@query(
    f"""WITH {panels.WLABEL_SQL}, {_STEPS}, ev AS (SELECT entity, prev_window AS fw, "window" AS tw FROM steps WHERE prev <> label),
    a AS (SELECT ev.entity, ev.tw, p.category, avg(p.value) FILTER (WHERE p.period >= f.window_start AND p.period < f.window_end) AS before, avg(p.value) FILTER (WHERE p.period >= t.window_start AND p.period < t.window_end) AS after
      FROM ev JOIN wins f ON f."window" = ev.fw JOIN wins t ON t."window" = ev.tw JOIN panel p ON p.entity = ev.entity GROUP BY 1, 2, 3)
    SELECT entity, tw AS to_window, category, round(before, 4) AS before, round(after, 4) AS after, round((after / before - 1) * 100, 6) + 0.0 AS pct FROM a"""
)
def spend_align(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(panels.panel_l(spark, d))
    wide = panel.keep_long_series(panel.pivot_mean(cells, ["entity", "period"], [TOTAL, *CATS]), QUARTERLY.min_periods)
    events = dynamics.switch_events(window_labels(spark, d))
    windows = panel.assign_windows(wide, QUARTERLY.window_length).select("window", "window_start", "window_end").distinct()
    out = audit.align_switches(events, windows, cells)
    return rounded(out.withColumns({"before": F.round("before", 4), "after": F.round("after", 4)}))


@query("""SELECT region, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(corr(y, x), 6) AS pearson
    FROM (SELECT region, log_total AS y, share_grocery AS x FROM features_szfo_v2_final) WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1""")
def ols_proxy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.regressions(table(spark, d, "features_szfo_v2_final"), "log_total", "share_grocery", ["region"]))


@query()
def income_proxy_multi(spark: SparkSession, d: str) -> DataFrame:
    """Several predictors; where the fit explains too little, the median stands in."""
    t = table(spark, d, "features_szfo_v2_final").withColumn("target", F.when(F.expr("mob_logratio BETWEEN -2 AND 2"), F.col("mob_logratio")))
    out, told = audit.income_proxy(t, "target", ["share_grocery", "log_total", "share_food"])
    return out.select("feat_id", "target_proxy", F.lit(told["used_fallback"]).alias("used_fallback"))


# --- distances, graphs, validity ----------------------------------------------------------------------------------


@query(f"WITH {panels.PAIRS_SQL} SELECT i, j, round(d, 6) AS d FROM pairs")
def pairwise_dist(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.pairwise_distances(panels.points(spark, d), "id", "x"))


_QS = QUARTERLY.eps_grid


@query(f"WITH {panels.PAIRS_SQL}, dbl AS (SELECT d FROM pairs WHERE d > 0 UNION ALL SELECT d FROM pairs WHERE d > 0) " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(d, {q}), 6) AS eps FROM dbl" for q in _QS))
def eps_quantiles(spark: SparkSession, d: str) -> DataFrame:
    got = linalg.distance_quantiles(panels.points(spark, d), "id", "x", _QS)
    return rounded(spark.createDataFrame(list(zip(map(float, _QS), got)), "q double, eps double"))


def _edges(spark: SparkSession, d: str, q: float = 0.05) -> DataFrame:
    pts = panels.points(spark, d)
    (eps,) = linalg.distance_quantiles(pts, "id", "x", [q])
    return linalg.edges_below(pts, "id", "x", eps).select(F.col("i").alias("src"), F.col("j").alias("dst"))


_EDGES_SQL = f"{panels.PAIRS_SQL}, dbl AS (SELECT d FROM pairs WHERE d > 0 UNION ALL SELECT d FROM pairs WHERE d > 0), edges AS (SELECT i AS src, j AS dst FROM pairs WHERE d < (SELECT quantile_cont(d, 0.05) FROM dbl))"


@query(f"WITH {_EDGES_SQL} SELECT src, dst FROM edges")
def eps_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


# Smallest id that each vertex reaches, by waves from all vertices; UNION keeps each reached pair once.
@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
    reach(id, r) AS (SELECT id, id FROM pts UNION SELECT reach.id, sym.dst FROM reach JOIN sym ON reach.r = sym.src)
    SELECT id, min(r) AS component FROM reach GROUP BY 1"""
)
def components(spark: SparkSession, d: str) -> DataFrame:
    return cluster.components(panels.points(spark, d), _edges(spark, d))


@query("""WITH n AS (SELECT label, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, least) - 1 AS r FROM n), b AS (SELECT count(*) FILTER (WHERE n >= 50) AS big FROM k)
    SELECT vec_id AS id, CASE WHEN n >= 50 THEN r ELSE big END::BIGINT AS label FROM embeddings JOIN k USING (label), b""")
def merge_small(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.merge_small(panels.points(spark, d).select("id", "label"), 50)).select("id", "label")


_SIL = f"""{panels.PAIRS_SQL}, sym AS (SELECT i AS id, li AS label, lj AS other, d FROM pairs UNION ALL SELECT j, lj, li, d FROM pairs), m AS (SELECT id, label, other, avg(d) AS d FROM sym GROUP BY 1, 2, 3),
ab AS (SELECT id, label, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM m GROUP BY 1, 2), sil AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""
_CAL = """tot AS (SELECT d, avg(x) AS g FROM lp GROUP BY 1), bw AS (SELECT sum(n * (c - g) ** 2) AS b, sum(n * v) AS w FROM cents JOIN tot USING (d)), nk AS (SELECT sum(n) AS n, count(*) AS k FROM cents WHERE d = 0)"""
_RAD = """nr AS (SELECT id, label, sqrt(sum((x - c) ** 2)) AS r FROM lp JOIN cents USING (label, d) GROUP BY 1, 2), rad AS (SELECT label, avg(r) AS r FROM nr GROUP BY 1)"""
_DB = """cd AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) ** 2)) AS d FROM cents a JOIN cents b USING (d) WHERE a.label <> b.label GROUP BY 1, 2), db AS (SELECT avg(m) AS davies_bouldin FROM (SELECT a, max((x.r + y.r) / d) AS m FROM cd JOIN rad x ON x.label = a JOIN rad y ON y.label = b GROUP BY 1))"""
_AVI = """lm AS (SELECT li AS label, lj AS other, sum(d) AS t, count(*) AS n FROM (SELECT li, lj, d FROM pairs UNION ALL SELECT lj, li, d FROM pairs) GROUP BY 1, 2), avi AS (SELECT avg(t / n) FILTER (WHERE label = other) / (avg(t / n) FILTER (WHERE label < other) + 1e-12) AS avi FROM lm)"""
_SDBW = """sg AS (SELECT label, sqrt(sum(v)) AS s, max(n) AS n FROM cents GROUP BY 1), allv AS (SELECT sqrt(sum(v)) AS s FROM (SELECT d, var_pop(x) AS v FROM lp GROUP BY 1)), mid AS (SELECT a.label AS a, b.label AS b, d, (a.c + b.c) / 2 AS m, greatest(a.n, b.n) AS most FROM cents a JOIN cents b USING (d) WHERE a.label < b.label),
ins AS (SELECT a, b, most, id, bool_and(abs(x - m) < (SELECT avg(s) FROM sg)) AS hit FROM lp JOIN mid USING (d) GROUP BY 1, 2, 3, 4), den AS (SELECT avg(v) AS v FROM (SELECT a, b, count(*) FILTER (WHERE hit) / max(most) AS v FROM ins GROUP BY 1, 2)),
sdbw AS (SELECT (SELECT avg(s) FILTER (WHERE n > 1) FROM sg) / ((SELECT s FROM allv) + 1e-12) + (SELECT v FROM den) AS s_dbw)"""


@query(f"WITH {_SIL} SELECT round(avg(s), 6) AS silhouette FROM sil")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.silhouette(validity.distance_sums(panels.points(spark, d))))


def _long(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    long = validity.long_points(panels.points(spark, d))
    return long, validity.centroids(long)


@query(f"WITH {panels.LONG_POINTS_SQL}, {_CAL} SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski FROM bw, nk")
def calinski(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.calinski(*_long(spark, d)))


@query(f"WITH {panels.LONG_POINTS_SQL}, {_RAD}, {_DB} SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.davies_bouldin(*_long(spark, d)))


@query(f"WITH {panels.LONG_POINTS_SQL}, {_SDBW} SELECT round(s_dbw, 6) AS s_dbw FROM sdbw")
def s_dbw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.s_dbw(panels.points(spark, d), *_long(spark, d)))


@query(f"WITH {panels.PAIRS_SQL}, {_AVI} SELECT round(avi, 6) AS avi FROM avi")
def avi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.avi(validity.distance_sums(panels.points(spark, d))))


@query(f"WITH {panels.LONG_POINTS_SQL} SELECT round(avg(v), 6) AS avu FROM (SELECT label, avg(v) AS v FROM cents GROUP BY 1)")
def avu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.avu(_long(spark, d)[1]))


@query(f"WITH {panels.LONG_POINTS_SQL}, {_RAD} SELECT round(avg(r), 6) AS mq FROM rad")
def mq(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.mq(*_long(spark, d)))


def _half(points: DataFrame) -> DataFrame:
    return points.withColumn("label", (F.col("x")[0] > 0).cast("int"))


def _icvi_sql(label: str, method: str) -> str:
    pts = panels.POINTS_SQL.replace("label,", f"{label} AS label,", 1)
    pairs = panels.PAIRS_SQL.replace(panels.POINTS_SQL, pts)
    long = panels.LONG_POINTS_SQL.replace(panels.POINTS_SQL + ", ", "")
    sil = _SIL.replace(panels.PAIRS_SQL, pairs)
    return f"""SELECT * FROM (WITH {sil}, {long}, {_CAL}, {_RAD}, {_DB}, {_AVI}, {_SDBW} SELECT '{method}' AS method, round((SELECT avg(s) FROM sil), 6) AS silhouette, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski, round((SELECT davies_bouldin FROM db), 6) AS davies_bouldin,
    round((SELECT s_dbw FROM sdbw), 6) AS s_dbw, round((SELECT avi FROM avi), 6) AS avi, round((SELECT avg(v) FROM (SELECT label, avg(v) AS v FROM cents GROUP BY 1)), 6) AS avu, round((SELECT avg(r) FROM rad), 6) AS mq FROM bw, nk)"""


@query(_icvi_sql("label", "given") + " UNION ALL " + _icvi_sql("(embedding[1] > 0)::INT", "half"))
def icvi_table(spark: SparkSession, d: str) -> DataFrame:
    pts = cut(panels.points(spark, d))
    return rounded(validity.validity_table(pts, "given").unionByName(validity.validity_table(_half(pts), "half")))


@query(f"WITH pairing AS (SELECT label AS a, (embedding[1] > 0)::INT AS b FROM embeddings), {_ARI.format(k='')} SELECT tot.n::BIGINT AS n, round({_ARI_VALUE}, 6) + 0.0 AS ari FROM tot, sa, sb")
def ari(spark: SparkSession, d: str) -> DataFrame:
    pts = panels.points(spark, d).select(F.col("label").alias("a"), (F.col("x")[0] > 0).cast("int").alias("b"))
    return rounded(validity.adjusted_rand(validity.contingency(pts, "a", "b")))


@query("SELECT lower(lang) AS a, source AS b, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return validity.contingency(table(spark, d, "documents").select(F.lower("lang").alias("l"), "source"), "l", "source")


@query("""SELECT arg_max(label, m) AS best_label, round(max(m), 6) AS best_mean FROM (SELECT label, avg(embedding[1]::DOUBLE) AS m FROM embeddings GROUP BY 1)""")
def argmax_grid(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    return g.agg(F.max_by("label", "m").alias("best_label"), F.round(F.max("m"), 6).alias("best_mean"))


# --- fits: rows only ----------------------------------------------------------------------------------------------


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    return plm.spectrum(plm.couplings(linalg.binarize(panels.scaled_l(spark, d), FEATURES), FEATURES, QUARTERLY.c_reg))


def threshold_labels(spark: SparkSession, d: str) -> DataFrame:
    """(entity, u1, label): the flagship typology, the median split along the leading mode of the couplings."""
    x = cut(panels.scaled_l(spark, d)).withColumn("_all", F.lit(0))
    return stability.labels_by_group(linalg.binarize(x, FEATURES), x, FEATURES, "_all", QUARTERLY.c_reg).select("entity", "u1", "label")


@query()
def typology(spark: SparkSession, d: str) -> DataFrame:
    return threshold_labels(spark, d)


@query()
def plm_couplings(spark: SparkSession, d: str) -> DataFrame:
    return plm.couplings(linalg.binarize(panels.scaled_l(spark, d), FEATURES), FEATURES, QUARTERLY.c_reg)


@query()
def coupling_strength(spark: SparkSession, d: str) -> DataFrame:
    return plm.coupling_strength(plm_couplings(spark, d))


@query()
def spectrum(spark: SparkSession, d: str) -> DataFrame:
    return _spectrum(spark, d)


@query()
def spectral_metrics(spark: SparkSession, d: str) -> DataFrame:
    return plm.spectral_metrics(_spectrum(spark, d))


@query(
    """WITH w AS (SELECT DISTINCT "window" AS w, top_evals FROM dynamic_summary), l AS (SELECT w, unnest(range(1, len(top_evals) + 1)) AS mode, unnest(top_evals) - 2 AS v FROM w)
    SELECT w AS "window", round(sum(v) FILTER (WHERE v > 0) ** 2 / sum(v * v) FILTER (WHERE v > 0), 6) AS pr_plus, round(count(*) FILTER (WHERE v < 0) / count(*), 6) AS frustration FROM l GROUP BY 1"""
)
def stored_spectral_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Spectral metrics of stored eigenvalues (shifted, so that both signs occur)."""
    w = table(spark, d, "dynamic_summary").select("window", "top_evals").distinct()
    modes = w.select("window", F.posexplode("top_evals").alias("k", "v")).select("window", (F.col("k") + 1).alias("mode"), (F.col("v") - 2).alias("lambda"))
    return rounded(plm.spectral_metrics(modes, ["window"]).select("window", "pr_plus", "frustration"))


@query()
def mode_loadings(spark: SparkSession, d: str) -> DataFrame:
    return plm.loadings_long(_spectrum(spark, d), FEATURES)


@query()
def top_loadings(spark: SparkSession, d: str) -> DataFrame:
    return plm.top_loadings(plm.loadings_long(_spectrum(spark, d), FEATURES))


@query()
def bootstrap_ari(spark: SparkSession, d: str) -> DataFrame:
    return stability.bootstrap_ari(cut(panels.scaled_l(spark, d)), FEATURES, QUARTERLY.c_reg, QUARTERLY.bootstrap)


@query()
def bootstrap_ari_poisson(spark: SparkSession, d: str) -> DataFrame:
    """The same with draws that every row makes for itself, for tables of any size."""
    return stability.bootstrap_ari(cut(panels.scaled_l(spark, d)), FEATURES, QUARTERLY.c_reg, QUARTERLY.bootstrap, "poisson")


@query()
def creg_sweep(spark: SparkSession, d: str) -> DataFrame:
    return stability.regularisation_sweep(cut(panels.scaled_l(spark, d)), FEATURES, QUARTERLY.c_grid, QUARTERLY.c_reg)


def _dynamics(spark: SparkSession, d: str, wide: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = cut(panels.window_features_l(spark, d, wide))
    modes = cut(dynamics.window_modes(f, WINDOW_FEATURES, QUARTERLY))
    return f, modes, cut(dynamics.window_communities(f, modes, WINDOW_FEATURES, QUARTERLY))


@query()
def window_dynamics(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.window_summary(*_dynamics(spark, d))


@query()
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """(entity, window, label, n_switches) of the entities that stand in every window."""
    _, _, labels = _dynamics(spark, d)
    kept = labels.join(panel.in_all_windows(labels), "entity", "left_semi")
    return kept.join(dynamics.switch_counts(kept), "entity")


@query()
def trajectory_ari(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.consecutive_ari(_dynamics(spark, d)[2])


@query()
def eps_choice(spark: SparkSession, d: str) -> DataFrame:
    """(q, eps, components, chosen): the smallest quantile of the grid whose graph is one component is chosen, else the largest."""
    rows = list(cluster.eps_components(cut(panels.points(spark, d)), sorted(_QS)))
    at = next((i for i, r in enumerate(rows) if r[2] == 1), len(rows) - 1)
    return spark.createDataFrame([(*r, i == at) for i, r in enumerate(rows)], "q double, eps double, components long, chosen boolean")


def _graph(points: DataFrame) -> DataFrame:
    """(src, dst) of the neighbourhood graph under the chosen ε."""
    points = cut(points)
    _, eps = cluster.connected_eps(points, QUARTERLY.eps_grid)
    return linalg.edges_below(points, "id", "x", eps).select(F.col("i").alias("src"), F.col("j").alias("dst"))


@query()
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges under the chosen ε; ``eps_edges`` is the operator at the quantile that its SQL fixes."""
    return _graph(panels.points(spark, d))


@query()
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """The components under the chosen ε; ``components`` is the operator at the quantile that its SQL fixes."""
    return cluster.components(panels.points(spark, d), _graph(panels.points(spark, d)))


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return cluster.louvain(panels.points(spark, d).select("id"), _graph(panels.points(spark, d)), QUARTERLY.resolution)


@query()
def louvain_parallel(spark: SparkSession, d: str) -> DataFrame:
    """The same by joins, for graphs that fit no worker."""
    return cluster.louvain_parallel(panels.points(spark, d).select("id"), cut(_graph(panels.points(spark, d))), QUARTERLY.resolution)


@query()
def louvain_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = cut(_graph(panels.points(spark, d)))
    return cluster.modularity(cluster.louvain(panels.points(spark, d).select("id"), e, QUARTERLY.resolution), e)


def lead_modes(x: DataFrame, k: int) -> DataFrame:
    """(id, x): standardised entities projected on the leading ``k`` modes of their couplings."""
    modes = plm.spectrum(plm.couplings(linalg.binarize(x, FEATURES), FEATURES, QUARTERLY.c_reg)).where(F.col("mode") <= k)
    axes = [r.loadings for r in modes.orderBy("mode").select("loadings").collect()]  # k vectors of one entry per feature
    return cut(x.select(F.col("entity").alias("id"), F.array(*[linalg.dot(FEATURES, v) for v in axes]).alias("x")))


def _kmeans_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int | None]:
    """Labels (k, id, label) for K = 2..8 on the row-normalised leading modes, their scores on the features, and the K of the best silhouette; K with a cluster below two members has no score."""
    x = cut(panels.scaled_l(spark, d))
    u = lead_modes(x, QUARTERLY.kmeans_modes)
    cols = [f"u{i}" for i in range(QUARTERLY.kmeans_modes)]
    wide = u.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]).withColumns(linalg.row_normalised(cols))
    labels = cut(cluster.kmeans_grid(wide.select("id", F.array(*cols).alias("x")), range(2, 9), QUARTERLY.n_init, QUARTERLY.seed))
    pts = x.select(F.col("entity").alias("id"), F.array(*[F.col(c) for c in FEATURES]).alias("x"))
    members = labels.groupBy("k", "label").agg(F.count("*").alias("n")).groupBy("k").agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))  # one entry per label
    rows = []
    for r in members.orderBy("k").collect():
        if len(r.sizes) == r.k and min(r.sizes) >= 2:
            got = pts.join(labels.where(F.col("k") == r.k).drop("k"), "id").select("id", "label", "x")
            long = validity.long_points(got)
            cents = validity.centroids(long)
            s = validity.silhouette(validity.distance_sums(got)).join(F.broadcast(validity.calinski(long, cents))).join(F.broadcast(validity.davies_bouldin(long, cents))).first()  # one row each
            rows.append((r.k, r.sizes, *s))
    best = max(rows, key=lambda r: r[2])[0] if rows else None
    table = spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, sizes array<long>, silhouette double, calinski double, davies_bouldin double, chosen boolean")
    return labels, table, best


@query()
def kmeans_multi(spark: SparkSession, d: str) -> DataFrame:
    """(id, label) of the K of the best silhouette among K = 2..8."""
    labels, _, best = _kmeans_grid(spark, d)
    return labels.where(F.col("k") == F.lit(best)).select("id", "label")


@query()
def kmeans_choice(spark: SparkSession, d: str) -> DataFrame:
    """(k, sizes, silhouette, calinski, davies_bouldin, chosen) of each K without a cluster below two members."""
    return _kmeans_grid(spark, d)[1]


@query()
def icvi_methods(spark: SparkSession, d: str) -> DataFrame:
    """The validity table of k-means with K = 2..5, the threshold and the graph communities, all on the standardised features."""
    x = cut(panels.scaled_l(spark, d))
    pts = x.select(F.col("entity").alias("id"), F.array(*[F.col(c) for c in FEATURES]).alias("x"))
    grid = cut(cluster.kmeans_grid(pts, range(2, 6), QUARTERLY.n_init, QUARTERLY.seed))
    methods = {f"kmeans_{k}": grid.where(F.col("k") == k) for k in range(2, 6)}
    methods["threshold"] = threshold_labels(spark, d).withColumnRenamed("entity", "id")
    methods["louvain"] = graph_labels(x)
    out = None
    for name, labels in methods.items():
        row = cut(validity.validity_table(cut(pts.join(labels.select("id", "label"), "id").select("id", "label", "x")), name))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def pca2(spark: SparkSession, d: str) -> DataFrame:
    """(id, pc1, pc2): projection of the centred points on their two leading axes; of each axis the entry largest in size is positive."""
    pts = panels.points(spark, d).select("id", array_to_vector("x").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(pts)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    got = model.transform(pts).select("id", vector_to_array("p").alias("p"))
    means = got.agg(F.avg(F.col("p")[0]).alias("m0"), F.avg(F.col("p")[1]).alias("m1"))
    return got.join(F.broadcast(means)).select("id", ((F.col("p")[0] - F.col("m0")) * sign[0]).alias("pc1"), ((F.col("p")[1] - F.col("m1")) * sign[1]).alias("pc2"))


def graph_labels(x: DataFrame) -> DataFrame:
    """(id, label): communities of the entities' neighbourhood graph on the leading modes under the chosen ε, small ones merged."""
    u = lead_modes(x, QUARTERLY.graph_modes)
    return cluster.merge_small(cluster.louvain_of_points(u, QUARTERLY.eps_grid, QUARTERLY.resolution), QUARTERLY.min_community)


@query()
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, k-means and graph communities of the same entities: sizes, validity and agreement with the threshold."""
    x = cut(panels.scaled_l(spark, d))
    pts = x.select(F.col("entity").alias("id"), F.array(*[F.col(c) for c in FEATURES]).alias("x"))
    threshold = cut(threshold_labels(spark, d).select(F.col("entity").alias("id"), "label"))
    graph = graph_labels(x)
    out = None
    for name, labels in (("threshold", threshold), ("kmeans", cluster.kmeans(pts, 2, QUARTERLY.n_init)), ("louvain", graph)):
        labels = cut(labels.select("id", "label"))
        sizes = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))  # one entry per label
        agree = validity.adjusted_rand(validity.contingency(labels.join(threshold.withColumnRenamed("label", "t"), "id"), "label", "t")).select("ari")
        row = validity.validity_table(cut(pts.join(labels, "id").select("id", "label", "x")), name).join(F.broadcast(sizes)).join(F.broadcast(agree))
        out = cut(row) if out is None else out.unionByName(cut(row))
    return out


def _bundle(name: str, rows: DataFrame, cols: Sequence[str], reps: int = 0) -> DataFrame:
    """One row: spectral metrics of the standardised ``rows``, sizes and silhouette of their threshold typology and, with ``reps``, mean and deviation of the bootstrap's agreement."""
    z = cut(linalg.zscore(rows.select("entity", *cols), cols))
    binary = linalg.binarize(z, cols)
    modes = plm.spectrum(plm.couplings(binary, cols, QUARTERLY.c_reg))
    labels = cut(stability.labels_by_group(binary.withColumn("_all", F.lit(0)), z.withColumn("_all", F.lit(0)), cols, "_all", QUARTERLY.c_reg).select(F.col("entity").alias("id"), "label"))
    sizes = labels.agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 0, 1)).alias("size_0"), F.count(F.when(F.col("label") == 1, 1)).alias("size_1"))
    pts = z.select(F.col("entity").alias("id"), F.array(*[F.col(c) for c in cols]).alias("x")).join(labels, "id").select("id", "label", "x")
    out = plm.spectral_metrics(modes).join(F.broadcast(sizes)).join(F.broadcast(validity.silhouette(validity.distance_sums(pts))))  # one row each
    if reps:
        out = out.join(F.broadcast(stability.bootstrap_ari(z, cols, QUARTERLY.c_reg, reps).agg(F.avg("ari").alias("bootstrap_mean"), F.stddev_pop("ari").alias("bootstrap_std"))))
    return cut(out.select(F.lit(name).alias("rows"), *[c for c in out.columns]))


@query()
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The typology of all entities, of those whose supplier has a positive balance, and the difference of the two (matched less all)."""
    x = cut(panels.features_l(spark, d))
    kept = x.join(table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity")), "entity", "left_semi")
    full, part = (_bundle(name, rows, FEATURES, 20) for name, rows in (("all", x), ("matched", kept)))
    numbers = [c for c in full.columns if c != "rows"]
    one = full.select(*[F.col(c).alias(f"{c}_a") for c in numbers]).join(F.broadcast(part.select(*[F.col(c).alias(f"{c}_b") for c in numbers])))  # one row each
    delta = one.select(F.lit("delta").alias("rows"), *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(c) for c in numbers])
    return full.unionByName(part).unionByName(delta)


@query()
def headline(spark: SparkSession, d: str) -> DataFrame:
    """One row: leading eigenvalue and its share, bootstrap mean and deviation, share of switching entities among those in every window, mean agreement of neighbouring windows."""
    wide = cut(panels.long_wide_l(spark, d))  # the lines are joined and summed once for all parts
    release(spark)
    x = cut(linalg.zscore(cut(panels.features_l(spark, d, wide)), FEATURES))
    m = cut(plm.spectral_metrics(plm.spectrum(plm.couplings(linalg.binarize(x, FEATURES), FEATURES, QUARTERLY.c_reg))).select("lambda_max", "top_share", "pr_plus", "frustration"))
    b = cut(stability.bootstrap_ari(x, FEATURES, QUARTERLY.c_reg, QUARTERLY.bootstrap).agg(F.avg("ari").alias("bootstrap_mean"), F.stddev_pop("ari").alias("bootstrap_std")))
    release(spark)
    labels = _dynamics(spark, d, wide.repartition("entity"))[2]  # rows meet by entity before windows multiply them
    kept = labels.join(panel.in_all_windows(labels), "entity", "left_semi")
    s = cut(dynamics.switch_counts(kept).agg(F.avg((F.col("n_switches") > 0).cast("double")).alias("switchers")))
    w = cut(dynamics.consecutive_ari(labels).agg(F.avg("ari").alias("mean_window_ari")))
    return m.join(F.broadcast(b)).join(F.broadcast(s)).join(F.broadcast(w))


@query()
def ablations(spark: SparkSession, d: str) -> DataFrame:
    """(variant, lambda_max, pr_plus, frustration, sizes, silhouette, ...) of the typology by how the index enters: not at all, with its unknown values (those not above zero) imputed by the upper
    quartile or by a regression on size, or only as what a regression on size leaves of it; and without the growth features."""
    x = cut(panels.features_l(spark, d))
    known = x.withColumn("index", F.when(F.col("mob_logratio") > 0, F.col("mob_logratio")))
    proxied, _ = audit.income_proxy(known, "index", ["log_total", "share_small"])
    proxied = cut(proxied)
    with_index = lambda df, c: df.withColumn("mob_logratio", F.col(c))
    variants: dict[str, tuple[DataFrame, tuple[str, ...]]] = {
        "all": (x, FEATURES),
        "no_growth": (x, tuple(c for c in FEATURES if not c.startswith("growth"))),
        "no_index": (x, FEATURES[:-1]),
        "q75_index": (with_index(audit.quantile_imputed(known, "index"), "index_q"), FEATURES),
        "proxied_index": (with_index(proxied, "index_proxy"), FEATURES),
        "residual_index": (with_index(audit.residual(proxied, "index_proxy", "log_total"), "index_proxy_residual"), FEATURES),
    }
    out = None
    for name, (rows, cols) in variants.items():
        row = _bundle(name, rows, cols).withColumnRenamed("rows", "variant")
        out = row if out is None else out.unionByName(row)
    return out


# --- windows of events and file formats ---------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 6 DAY, time_bucket(INTERVAL 1 DAY, ts), INTERVAL 1 DAY)) AS s FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
    SELECT strftime(s, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2"""
)
def sliding_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator on a table: weekly windows that move by a day."""
    got = panel_stream.windowed_totals(table(spark, d, "events"), "ts", ["event_type"], "value", "7 days", "1 day", "2 days")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of this run's own in the shared folder, so that two runs never meet."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT mo_id, mo, region_raw, residents::BIGINT AS residents FROM mo_cards")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as delimited text with mark by the library's sink and read again by its source."""
    path = _scratch(spark, "csv_round_trip")
    archives.write_csv(table(spark, d, "mo_cards").select("mo_id", "mo", "region_raw", F.col("residents").cast("long").alias("residents")), path)
    return archives.read_csv(spark, path, "mo_id long, mo string, region_raw string, residents long")


@query("""SELECT "window"::BIGINT AS "window", n_mo::BIGINT AS n_mo, round(pr_plus, 6) AS pr_plus, round(top_evals[1], 6) AS first_eval, len(top_evals)::BIGINT AS n_evals FROM dynamic_summary""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested summaries written as JSON, a document a line, read by schema and exploded."""
    path = _scratch(spark, "json_round_trip")
    w = table(spark, d, "dynamic_summary").select("window", "n_mo", "pr_plus", "top_evals")
    archives.write_json(w.select(F.array(F.struct(*w.columns)).alias("windows")), path)
    got = archives.read_windows(spark, path, "windows array<struct<window:int,n_mo:int,pr_plus:double,top_evals:array<double>>>", whole=False)
    return rounded(got.select("window", "n_mo", "pr_plus", F.col("top_evals")[0].alias("first_eval"), F.size("top_evals").alias("n_evals")))

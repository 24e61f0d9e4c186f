"""Entity x period x category panels: pivots, feature tables, sliding windows.

All operators take long panels with columns entity, period DATE, category STRING, value DOUBLE, where one category is the total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.config import Params

KINDS = ("share", "growth", "cv")


def clean_values(panel: DataFrame) -> DataFrame:
    """Rows with a value; NaN counts as none."""
    return panel.where(F.col("value").isNotNull() & ~F.isnan("value"))


def pivot_mean(panel: DataFrame, rows: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Mean value by ``rows`` and category, one column per category; repeated cells are averaged. Keys without any value have no row."""
    return clean_values(panel).groupBy(*rows).pivot("category", list(categories)).agg(F.avg("value"))


def keep_long_series(wide: DataFrame, least: int) -> DataFrame:
    """Rows of entities with at least ``least`` rows."""
    enough = wide.groupBy("entity").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("entity")
    return wide.join(enough, "entity", "left_semi")


def static_features(wide: DataFrame, total: str, categories: Sequence[str], p: Params) -> DataFrame:
    """(entity, share_c..., log_total, growth_c..., cv_c...): one pass over the wide panel, one hash aggregate by entity.

    Shares and log size are of the second year; growth compares the years' means and is 0 without enough rows in the first or with a
    first mean that isn't positive; cv is over the second year's rows. Entities with too few rows in the second year or without a positive total drop out.
    """
    y1, y2 = (F.year("period") == y for y in p.years)
    in1, in2 = F.when(y1, True), F.when(y2, True)
    mean = lambda year, c: F.avg(F.when(year, F.col(c)))
    aggs = [F.count(in1).alias("n1"), F.count(in2).alias("n2"), mean(y2, total).alias("size")]
    for c in categories:
        aggs += [mean(y1, c).alias(f"a_{c}"), mean(y2, c).alias(f"b_{c}"), F.stddev_pop(F.when(y2, F.col(c))).alias(f"s_{c}"), F.count(F.when(y2, F.col(c))).alias(f"k_{c}")]
    g = wide.where(y1 | y2).groupBy("entity").agg(*aggs).where((F.col("n2") >= p.min_year_rows) & (F.col("size") > 0))
    share = [(F.col(f"b_{c}") / F.col("size")).alias(f"share_{c}") for c in categories]
    grown = [
        F.when((F.col("n1") < p.min_year_rows) | F.col(f"a_{c}").isNull() | (F.col(f"a_{c}") <= 0), 0.0).otherwise((F.col(f"b_{c}") - F.col(f"a_{c}")) / F.when(F.col(f"a_{c}") > 0, F.col(f"a_{c}"))).alias(f"growth_{c}") for c in categories
    ]
    cv = [F.when((F.col(f"k_{c}") == F.col("n2")) & (F.col(f"b_{c}") > 0), F.col(f"s_{c}") / F.when(F.col(f"b_{c}") > 0, F.col(f"b_{c}"))).otherwise(0.0).alias(f"cv_{c}") for c in categories]
    return g.select("entity", *share, F.log1p("size").alias("log_total"), *grown, *cv)


def two_period_logratio(index: DataFrame) -> DataFrame:
    """(entity, mob_logratio): ln(1 + second) - ln(1 + first) of an index read at two periods; 0 for all unless exactly two periods exist.

    Repeated readings are averaged; an entity without one of the two has NULL.
    """
    rows = clean_values(index)
    span = rows.agg(F.min("period").alias("p1"), F.max("period").alias("p2"), F.count_distinct("period").alias("n"))
    both = rows.join(F.broadcast(span))  # one row
    means = both.groupBy("entity", "n").agg(F.avg(F.when(F.col("period") == F.col("p1"), F.col("value"))).alias("d1"), F.avg(F.when(F.col("period") == F.col("p2"), F.col("value"))).alias("d2"))
    return means.select("entity", F.when(F.col("n") == 2, F.log1p("d2") - F.log1p("d1")).otherwise(0.0).alias("mob_logratio"))


def join_index(features: DataFrame, ratio: DataFrame) -> DataFrame:
    """Features with the index ratio, 0 where the entity has none."""
    return features.join(ratio, "entity", "left").withColumn("mob_logratio", F.coalesce("mob_logratio", F.lit(0.0)))


def feature_columns(df: DataFrame, meta: Sequence[str]) -> list[str]:
    """Numeric columns that are no meta column, in the table's order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if n not in meta and (t in numeric or t.startswith("decimal"))]


def assign_windows(wide: DataFrame, length: int) -> DataFrame:
    """``wide`` once for each sliding window of ``length`` observed periods that holds the row; adds window, window_start, window_end.

    Windows are numbered from 1 in order of time and move by one observed period. Fewer periods than ``length`` give no window.
    """
    periods = wide.select("period").distinct()
    placed = periods.select("period", (F.dense_rank().over(Window.orderBy("period")) - 1).alias("m"))  # as many rows as periods
    bounds = placed.agg(F.max("m").alias("last"), F.sort_array(F.collect_list("period")).alias("all"))
    rows = placed.join(F.broadcast(bounds)).where(F.col("last") >= length - 1)
    each = rows.withColumn("w", F.explode(F.sequence(F.greatest(F.col("m") - (length - 1), F.lit(0)), F.least("m", F.col("last") - (length - 1)))))
    each = each.select("period", (F.col("w") + 1).alias("window"), F.element_at("all", F.col("w") + 1).alias("window_start"), F.element_at("all", F.col("w") + length).alias("window_end"))
    return wide.join(F.broadcast(each), "period")  # a row per period and window, so rows stay where their entity is


def window_features(windowed: DataFrame, total: str, categories: Sequence[str], p: Params) -> DataFrame:
    """(window, entity, share_c..., log_total, growth_share_c..., cv_share_c...) of rows with all values and a positive total.

    Shares are taken row by row and averaged; growth compares the means of the last and first ``edge_rows`` rows; entities with fewer than ``window_min_rows`` rows
    in a window, and windows with fewer than ``window_min_entities`` entities, drop out.
    """
    full = windowed.dropna(subset=[total, *categories]).where(F.col(total) > 0)
    rows = full.select("window", "entity", "period", F.col(total).alias("_total"), *[(F.col(c) / F.col(total)).alias(f"s_{c}") for c in categories])
    path = Window.partitionBy("window", "entity")
    rows = rows.withColumns({"_first": F.row_number().over(path.orderBy("period")), "_last": F.row_number().over(path.orderBy(F.desc("period")))})
    head, tail = F.col("_first") <= p.edge_rows, F.col("_last") <= p.edge_rows
    aggs = [F.count("*").alias("_n"), F.log1p(F.avg("_total")).alias("log_total")]
    for c in categories:
        s = F.col(f"s_{c}")
        aggs += [F.avg(s).alias(f"share_{c}"), F.avg(F.when(head, s)).alias(f"h_{c}"), F.avg(F.when(tail, s)).alias(f"t_{c}"), F.stddev_pop(s).alias(f"d_{c}")]
    g = rows.groupBy("window", "entity").agg(*aggs).where(F.col("_n") >= p.window_min_rows)
    big = g.groupBy("window").agg(F.count("*").alias("_m")).where(F.col("_m") >= p.window_min_entities).select("window")
    return g.join(big, "window", "left_semi").select(
        "window",
        "entity",
        *[F.col(f"share_{c}") for c in categories],
        "log_total",
        *[((F.col(f"t_{c}") - F.col(f"h_{c}")) / (F.col(f"h_{c}") + 1e-9)).alias(f"growth_share_{c}") for c in categories],
        *[F.when(F.col(f"share_{c}") > 0, F.col(f"d_{c}") / F.when(F.col(f"share_{c}") > 0, F.col(f"share_{c}"))).otherwise(0.0).alias(f"cv_share_{c}") for c in categories],
    )


def in_all_windows(labels: DataFrame) -> DataFrame:
    """Entities that stand in every window."""
    windows = labels.agg(F.count_distinct("window").alias("_all"))
    per = labels.groupBy("entity").agg(F.count_distinct("window").alias("_own"))
    return per.join(F.broadcast(windows)).where("_own = _all").select("entity")


def carry_down(rows: DataFrame, keys: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Section headers carried down to the entity rows below: (line, col0, col1, col2, col3) -> (line, region, name, code, value).

    A row with text only in its second column is a header: heading words are skipped, region words set the region, or reset it to none if the
    region is out of scope; anything else leaves it. An entity row needs a region, a name that is no heading and a number. A sheet of a file (``file``, ``year``, where
    ``rows`` has them) is a unit of its own, read in the order of ``line``; no header reaches into another. ``keys`` are the ordered region keys.
    """
    from panelmodes.functions.names import digits_or_null, first_key, is_header, looks_like_region, number_or_null, stripped

    text = stripped(F.col("col1"))
    header = F.col("col0").isNull() & F.col("col1").isNotNull() & F.col("col3").isNull()
    marker = F.when(header & ~is_header(text) & looks_like_region(text), F.coalesce(first_key(text, keys) if keys else first_key(text), F.lit("#")))
    sheet = [c for c in ("file", "year") if c in rows.columns]
    order = Window.partitionBy(*sheet, F.lit(0)).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    region = F.last(marker, ignorenulls=True).over(order)
    named = rows.withColumns({"region": region, "name": text, "code": digits_or_null(F.col("col2")), "value": number_or_null(F.col("col3"))})
    keep = F.col("col3").isNotNull() & F.col("col1").isNotNull() & F.col("region").isNotNull() & (F.col("region") != "#") & (F.col("name") != "") & ~is_header(F.col("name")) & F.col("value").isNotNull()
    return named.where(keep).select(*sheet, "line", "region", "name", "code", "value")

"""Irregular readings onto a regular monthly grid by an as-of merge in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.functions.dates import month_index, month_of_index
from panelmodes.functions.labels import category_name

OBSERVED, INTERPOLATED, GAP = "observed", "interpolated", "gap"


def day_values(readings: DataFrame) -> DataFrame:
    """(mo_id, slot, day, value): the last loaded reading of each day (ties: larger spend_id, then larger value).

    The aggregate combines on the map side, so a source with very many readings a day leaves a
    map task as one row per day and category.
    """
    last = F.max(F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("spend_id", F.lit(-(2**62))), "value"))
    return readings.groupBy("mo_id", "slot", "day").agg(last.getField("value").alias("value"))


def monthly_grid(readings: DataFrame, max_gap_days: int = 124) -> DataFrame:
    """(mo_id, category, ym, value, mark, before_day, after_day): a gapless monthly series per source.

    The grid runs from the month of a series' first reading to that of its last. An observed month holds
    the mean of its day values. A missing month's grid point is the first of the month: an as-of merge gives it the nearest
    reading before and the nearest after, and it is interpolated linearly by time between the two if they lie
    at most ``max_gap_days`` apart, else its value is NULL and its mark 'gap'. A series of one month has one row.
    Infinite neighbours interpolate by IEEE rules. Empty input gives no rows.

    Readings are first reduced to days, so no series can grow beyond its days, whatever share of the rows it has.
    """
    days = day_values(readings).repartition("mo_id", "slot")  # serves the months and both neighbours
    at = F.unix_date("day")
    by_series = Window.partitionBy("mo_id", "slot")
    marked = days.select("mo_id", "slot", month_index(F.col("day")).alias("month"), at.alias("at"), "value")
    # One row per month read, with its own mean and its outermost readings.
    months = marked.groupBy("mo_id", "slot", "month").agg(
        F.avg("value").alias("mean"),
        F.min(F.struct("at", "value")).alias("first"),
        F.max(F.struct("at", "value")).alias("last"),
    )
    # As-of merge of the sorted grid: of each run of missing months, the neighbours are the last reading before and the first after.
    ordered = by_series.orderBy("month")
    merged = months.withColumn("next_month", F.lead("month").over(ordered)).withColumn("after", F.lead("first").over(ordered))
    grid = merged.select(
        "mo_id",
        "slot",
        "mean",
        F.col("month").alias("read_month"),
        F.col("last").alias("before"),
        "after",
        F.explode(F.sequence("month", F.coalesce(F.col("next_month") - 1, F.col("month")))).alias("month"),
    )
    point = F.unix_date(F.to_date(F.concat(month_of_index(F.col("month")), F.lit("-01"))))
    span = F.col("after.at") - F.col("before.at")
    share = (point - F.col("before.at")) / span
    seen = F.col("month") == F.col("read_month")
    near = span <= max_gap_days
    day_of = lambda c: F.date_from_unix_date(F.col(c))
    return grid.select(
        "mo_id",
        category_name(F.col("slot")).alias("category"),
        month_of_index(F.col("month")).alias("ym"),
        F.when(seen, F.col("mean")).when(near, F.col("before.value") + (F.col("after.value") - F.col("before.value")) * share).alias("value"),
        F.when(seen, OBSERVED).when(near, INTERPOLATED).otherwise(GAP).alias("mark"),
        F.when(~seen, day_of("before.at")).alias("before_day"),
        F.when(~seen, day_of("after.at")).alias("after_day"),
    )


def missing_months(grid: DataFrame) -> DataFrame:
    """(mo_id, category, ym) of every month of the grid without a reading."""
    return grid.where(F.col("mark") != OBSERVED).select("mo_id", "category", "ym")

"""Usable readings of a long panel: one typed row for each reading that can be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmodes.functions.dates import real_date
from panelmodes.functions.labels import category_slot


def usable_readings(spend: DataFrame) -> DataFrame:
    """(mo_id, day DATE, slot INT, value, loaded_at, spend_id) of every usable reading.

    Usable: the period names a real date, the value is neither NULL nor NaN, the category is known and
    mo_id is not NULL. Zero is a value. Other columns of the input are ignored whatever their names.
    Repeated rows stay; the operators on top say how they settle them.
    """
    return (
        spend.where(F.col("mo_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
        .select(
            F.col("mo_id").cast("long"),
            real_date(F.col("period")).alias("day"),
            category_slot(F.col("category_15")).alias("slot"),
            F.col("value").cast("double").alias("value"),
            "loaded_at",
            F.col("spend_id").cast("long"),
        )
        .where(F.col("day").isNotNull() & F.col("slot").isNotNull())
    )

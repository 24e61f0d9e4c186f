"""Labels from a saved table, keyed by entity; what is missing is computed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labels_or_else(spark: SparkSession, path: str, columns: Sequence[str], entities: DataFrame, again: Callable[[], DataFrame]) -> DataFrame:
    """(entity, label) from the first of ``columns`` that the parquet table at ``path`` has, if it labels every entity; else ``again()``."""
    try:
        saved = spark.read.parquet(path)
    except AnalysisException:
        return again()
    found = next((c for c in columns if c in saved.columns), None)
    if found is None or "entity" not in saved.columns:
        return again()
    labels = saved.select("entity", F.col(found).cast("int").alias("label")).where("label IS NOT NULL")
    if entities.join(labels, "entity", "left_anti").limit(1).count():
        return again()
    return labels.join(entities.select("entity"), "entity", "left_semi")

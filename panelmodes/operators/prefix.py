"""Global order, ranks and running sums over any number of rows without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmodes.session import cut, shuffle_width


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], group: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with inclusive running sums in the given total order.

    Rows are range-partitioned and sorted by ``group`` and ``order`` (which must be unique together, so that even
    equal keys spread over partitions), numbered in place and cut from their lineage. Running sums within a partition plus the sums
    of the partitions before it give the global ones; the table of partition sums has one row per partition. With ``group``
    the sums restart there: the sum before the group's first row is taken off. A hot group spans many partitions. NULL summands count as zero.
    """
    spark = df.sparkSession
    keys = [*([group] if group else []), *order]
    width = partitions or shuffle_width(spark)
    placed = df.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("_part", F.shiftright("_place", 33))
    values = {name: F.coalesce(c, F.lit(0)) for name, c in sums.items()}
    inner = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({name: F.sum(c).over(inner) for name, c in values.items()})
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in values.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums])
    total = local.join(F.broadcast(offsets), "_part").withColumns({name: F.col(name) + F.col(f"_o_{name}") for name in sums})
    total = total.drop(*[f"_o_{name}" for name in sums])
    if group:
        starts = total.withColumns({f"_b_{name}": F.col(name) - c for name, c in values.items()}).groupBy(group).agg(*[F.min_by(f"_b_{name}", "_place").alias(f"_b_{name}") for name in sums])
        starts = starts.withColumnRenamed(group, "_g")
        total = total.join(starts, F.col(group).eqNullSafe(F.col("_g")))
        total = total.withColumns({name: F.col(name) - F.col(f"_b_{name}") for name in sums}).drop("_g", *[f"_b_{name}" for name in sums])
    return total.drop("_place", "_part")

"""Numbers and running sums of large groups, whose rows are dealt out in ranges of their order, so that no task has a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import checkpointed


def running_sum(rows: DataFrame, by: list[str], order: list[str], length: Column, name: str) -> DataFrame:
    """Adds the sum of length over the rows before a row in its group: within ranges of the order, plus the sums of the ranges before.

    The ranges are written once, as their bounds are drawn anew whenever they are made. What is joined is one sum for each range and group.
    """
    ranged = checkpointed(rows.withColumn("__length", length).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range", *by).agg(F.sum("__length").alias("__sum"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    here = F.col("r.__range") == F.col("o.__range")
    for k in by:
        here = here & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = ranged.withColumn("__inside", F.coalesce(F.sum("__length").over(inside), F.lit(0))).alias("r").join(offsets.alias("o"), here)
    return joined.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("__before") + F.col("__inside")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds 1, 2, ... in order, over all rows or in each group."""
    made = running_sum(rows, by or [], order, F.lit(1), name)
    return made.withColumn(name, F.col(name) + 1)

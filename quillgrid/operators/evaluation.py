"""Evaluation gates and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import version_parts
from quillgrid.operators.metrics import ratio


def evaluate(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Accuracy of a tier and version over all rows, failed inferences included, and whether it passes. rows: tier, version, correct (null if inference failed)."""
    base = rows.groupBy("tier", "version").agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("correct").isNull()).alias("errors"))
    return base.withColumn("accuracy", ratio(F.col("correct"), F.col("total"), 4)).withColumn("status", F.when(F.col("accuracy") < least, "fail").otherwise("ok"))


def by_category(rows: DataFrame) -> DataFrame:
    """Per category; failed inferences don't count here."""
    return rows.filter(F.col("correct").isNotNull()).groupBy("tier", "version", "category").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", ratio(F.col("correct"), F.col("total"), 4))


def against_previous(scores: DataFrame, by: list[str], order: list, value: str, most_drop: float) -> DataFrame:
    """Adds the value of the row before in each group, the change, and whether it fell by more than allowed."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    change = F.round(F.col(value) - F.col("previous"), 4)
    return scores.withColumn("previous", before).withColumn("change", change).withColumn("regressed", F.coalesce(F.col("change") < -most_drop, F.lit(False)))


def version_deltas(scores: DataFrame, most_drop: float = 0.05) -> DataFrame:
    """Accuracy against the version before, by parsed versions and not by their text."""
    return against_previous(scores.withColumn("v", version_parts(F.col("version"))), ["tier"], ["v"], "accuracy", most_drop).drop("v")

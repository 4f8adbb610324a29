"""Leaderboards kept up to date while results are written again, without reading all results.

A state has a row for each model and confidence bin: sums that can be added and taken away again. Confidences are summed as decimals, so that taking away leaves nothing
behind. A batch of results changes the state by its own sums, less those of the rows that it replaces; only these are read. Everything the leaderboard says follows from the state.

Null confidences have a bin of their own. A key that comes twice in a batch counts once, its last by `order`. Rows with a null in their key replace nothing and aren't replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.metrics import board_of_bins
from quillgrid.sources.sinks import last_wins

SUMS = ["n", "right", "over", "under", "sure", "told"]


def partial(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The sums of predictions (model, confidence, correct) by model and bin, times sign."""
    confidence = F.col("confidence")
    bin_ = F.when(confidence.isNotNull(), F.least(F.floor(confidence * 10), F.lit(9))).cast("int")
    count = lambda c: F.coalesce(F.sum(F.when(c, sign)), F.lit(0)).cast("long")
    return rows.groupBy("model", bin_.alias("bin")).agg(
        F.sum(F.lit(sign)).cast("long").alias("n"), count(F.col("correct")).alias("right"), count((confidence >= 0.8) & ~F.col("correct")).alias("over"), count((confidence < 0.5) & F.col("correct")).alias("under"),
        (F.coalesce(F.sum(confidence.cast("decimal(20,12)")), F.lit(0).cast("decimal(30,12)")) * sign).cast("decimal(38,12)").alias("sure"), count(confidence.isNotNull()).alias("told"),
    )


def merged(*states: DataFrame) -> DataFrame:
    """States and changes added up; bins of which nothing is left go. A change may leave a bin's number of rows as it is and yet change who was right."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    sums = [F.sum(c).cast("decimal(38,12)" if c == "sure" else "long").alias(c) for c in SUMS]
    return rows.groupBy("model", "bin").agg(*sums).filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def overwrite(results: DataFrame, batch: DataFrame, keys: list[str], order: Column | str) -> tuple[DataFrame, DataFrame]:
    """The results with a batch in place of rows of equal keys, and what that changes in the state."""
    new = last_wins(batch, keys, order)
    told = new.select(*keys).distinct()
    kept = results.join(told, keys, "left_anti")
    change = merged(partial(new), partial(results.join(told, keys, "left_semi"), -1))
    return kept.unionByName(new), change


def leaderboard(state: DataFrame) -> DataFrame:
    """The rows of metrics.leaderboard, from the state."""
    return board_of_bins(state.withColumn("sure", F.when(F.col("told") > 0, F.col("sure").cast("double"))))

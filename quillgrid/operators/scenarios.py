"""Scenario expansion and run plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(tasks: DataFrame) -> DataFrame:
    """A golden row for each task and a drift row for each of its candidates; the patch's path, not its text."""
    common = [F.col("id").alias("task_id"), "name", "repository", "category", "intent"]
    golden = tasks.select(*common, F.concat("id", F.lit("__golden")).alias("scenario_id"), F.col("golden_patch").alias("patch_path"), F.lit(False).alias("has_drift"), F.lit(None).cast("string").alias("drift_type"), F.lit(None).cast("string").alias("expected_gate"))
    each = tasks.withColumn("c", F.explode("drift_candidates"))
    drift = each.select(*common, F.concat("id", F.lit("__"), F.col("c.id")).alias("scenario_id"), F.col("c.patch").alias("patch_path"), F.lit(True).alias("has_drift"), F.col("c.drift_type").alias("drift_type"), F.col("c.fail_gate").alias("expected_gate"))
    return golden.unionByName(drift)


def with_patches(scenarios: DataFrame, patches: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Scenarios whose patch exists, with its text; drop_empty: and isn't empty."""
    texts = patches.select(F.col("path").alias("patch_path"), F.col("content").alias("patch"))
    found = scenarios.join(texts, "patch_path").drop("patch_path")
    return found.filter(F.length("patch") > 0) if drop_empty else found


def evaluation_rows(scenarios: DataFrame, patches: DataFrame) -> DataFrame:
    """Scenarios with a patch that isn't empty, as they are exported: a drift type that isn't given is an empty text."""
    return with_patches(scenarios, patches, drop_empty=True).na.fill("", ["drift_type"])


def golden_and_drift(scenarios: DataFrame) -> DataFrame:
    return scenarios.agg(F.count_if(~F.col("has_drift")).alias("golden"), F.count_if("has_drift").alias("drift"), F.count("*").alias("total"))


def run_plan(models: DataFrame, tasks: DataFrame, model: str | None = None, task: str | None = None) -> DataFrame:
    """Every model with every task: the plan is this product by its meaning, and the models are few. model, task: that one alone (columns model and id)."""
    models = models if model is None else models.filter(F.col("model") == model)
    tasks = tasks if task is None else tasks.filter(F.col("id") == task)
    return tasks.crossJoin(models)


def preview(models: DataFrame, tasks: DataFrame, most: int = 5) -> DataFrame:
    """A row for each model: the first `most` tasks by id, how many more there are, and how many runs all models make."""
    first = tasks.select("id").orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("first_tasks"))
    n = tasks.agg(F.count("*").alias("n_tasks"))
    return models.crossJoin(first).crossJoin(n).crossJoin(models.agg(F.count("*").alias("n_models"))).select("model", "first_tasks", F.greatest(F.col("n_tasks") - most, F.lit(0)).alias("more"), (F.col("n_tasks") * F.col("n_models")).alias("total_runs"))

"""Accuracy, calibration, breakdowns, ranks and merges of leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import title_case


def ratio(a: Column, b: Column, digits: int, times: int = 1) -> Column:
    """Rounded times * a / b; 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(times * a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def accuracy(rows: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """correct, total and accuracy of predictions by columns."""
    return rows.groupBy(*by).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", ratio(F.col("correct"), F.col("total"), digits))


def calibration_error(rows: DataFrame, by: list[str], midpoint: bool = False) -> DataFrame:
    """Expected calibration error over ten bins, against the mean confidence of a bin or its middle; null confidences don't count."""
    binned = rows.filter(F.col("confidence").isNotNull()).withColumn("bin", F.least(F.floor(F.col("confidence") * 10), F.lit(9)))
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    against = (F.col("bin") + 0.5) / 10 if midpoint else F.col("conf")
    error = F.sum(F.col("n") * F.abs(F.col("acc") - against)) / F.sum("n")
    return bins.groupBy(*by).agg(F.round(error, 4).alias("ece"))


def leaderboard(rows: DataFrame) -> DataFrame:
    """A row for each model: accuracy, extreme confidences, calibration both ways, and rank. One pass over the rows, by model and bin; the rest is of eleven rows a model."""
    confidence = F.col("confidence")
    bins = rows.groupBy("model", F.when(confidence.isNotNull(), F.least(F.floor(confidence * 10), F.lit(9))).alias("bin")).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("right"),
        F.count_if((confidence >= 0.8) & ~F.col("correct")).alias("over"),
        F.count_if((confidence < 0.5) & F.col("correct")).alias("under"),
        F.sum("confidence").alias("sure"),
        F.count("confidence").alias("told"),
    )
    return board_of_bins(bins)


def board_of_bins(bins: DataFrame) -> DataFrame:
    """The leaderboard from sums by model and bin (null: no confidence): n, right, over, under, sure (of confidences) and told (how many)."""
    has = F.col("bin").isNotNull()
    share = F.col("right") / F.col("n")

    def error(against: Column) -> Column:
        return F.round(F.sum(F.when(has, F.col("n") * F.abs(share - against))) / F.sum(F.when(has, F.col("n"))), 4)

    board = bins.groupBy("model").agg(
        F.sum("n").alias("total"),
        F.sum("right").alias("correct"),
        F.sum("over").alias("overconfident_errors"),
        F.sum("under").alias("underconfident_correct"),
        F.round(F.sum("sure") / F.sum("told"), 3).alias("avg_confidence"),
        error(F.col("sure") / F.col("n")).alias("ece_mean"),
        error((F.col("bin") + 0.5) / 10).alias("ece_midpoint"),
    )
    scored = board.withColumn("overall_accuracy", ratio(F.col("correct"), F.col("total"), 4))
    return ranked(scored, [F.desc("overall_accuracy"), F.asc("model")])


def by_accuracy(rows: DataFrame) -> DataFrame:
    """Rank by accuracy, then by completed tasks, both descending; equals by model."""
    return ranked(rows, [F.desc("accuracy"), F.desc("tasks_completed"), F.asc("model")])


def run_status(completed: Column) -> Column:
    return F.when(completed >= 20, "verified").otherwise("partial")


def tasks_by_repository(tasks: DataFrame) -> DataFrame:
    """Tasks of each repository, with the number of repositories and of all tasks beside."""
    each = tasks.groupBy("repository").agg(F.count("*").alias("tasks"))
    return each.crossJoin(each.agg(F.count("*").alias("repositories"), F.sum("tasks").alias("total_tasks")))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds 1..n over all rows: for leaderboards, whose rows are models."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rates(results: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Pass, detection and accuracy rates over completed runs, error rate over all; more: further aggregates of the same pass. results: error, passed, detected, correct."""
    done = F.col("error").isNull()
    base = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(~done).alias("errors"),
        F.count_if(done & F.col("passed")).alias("passed"),
        F.count_if(done & ~F.col("passed")).alias("failed"),
        F.count_if(done & F.col("correct")).alias("correct"),
        *more,
    )
    completed = F.col("total") - F.col("errors")
    return base.select(
        "*",
        completed.alias("completed"),
        ratio(F.col("passed"), completed, 1, 100).alias("pass_rate"),
        ratio(F.col("failed"), completed, 1, 100).alias("drift_detection_rate"),
        ratio(F.col("correct"), completed, 1, 100).alias("accuracy"),
        ratio(F.col("errors"), F.col("total"), 1, 100).alias("error_rate"),
    )


def exclude_false_positives(results: DataFrame, false_positive: Column) -> DataFrame:
    """Completed failures by the structure check alone count as passed; marked in fp_excluded."""
    hit = F.col("error").isNull() & ~F.col("passed") & F.coalesce(false_positive, F.lit(False))
    return results.withColumn("fp_excluded", hit).withColumn("passed", F.col("passed") | hit)


def counters(results: DataFrame, by: list[str]) -> DataFrame:
    """The rates of results whose false positives are excluded, and how many those are, in one pass."""
    return rates(results, by, F.count_if("fp_excluded").alias("false_positives_excluded"))


def breakdown(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """passed, failed and total by each dimension alone, in one pass of grouping sets; rows with an error count in total only."""
    done = F.col("error").isNull()
    sets = results.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id().alias("g"), F.count_if(done & F.col("passed")).alias("passed"), F.count_if(done & ~F.col("passed")).alias("failed"), F.count("*").alias("total")
    )
    n = len(dimensions)
    which = F.coalesce(*(F.when(F.col("g") == (1 << n) - 1 - (1 << n - 1 - k), F.lit(d)) for k, d in enumerate(dimensions)))
    value = F.coalesce(*(F.when(F.col("g") == (1 << n) - 1 - (1 << n - 1 - k), F.col(d).cast("string")) for k, d in enumerate(dimensions)))
    return sets.select(which.alias("dimension"), value.alias("value"), "passed", "failed", "total")


def gate_counts(reports: DataFrame) -> DataFrame:
    """passed, failed and total of each gate in summary maps."""
    each = reports.select(F.explode("summary").alias("gate", "status"))
    return each.groupBy("gate").agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count("*").alias("total"))


def finding_histogram(reports: DataFrame) -> DataFrame:
    """Findings by id, most frequent first; a missing id is unknown."""
    each = reports.select(F.explode("failures").alias("f")).select(F.coalesce("f.id", F.lit("unknown")).alias("finding"))
    return each.groupBy("finding").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "finding")


def detection_by_slug(results: DataFrame) -> DataFrame:
    """Detection rate of each model folder; the false-positive rate is a constant, as no golden run feeds it."""
    base = results.groupBy("model_slug").agg(F.count("*").alias("total"), F.count_if(F.coalesce("detected", F.lit(False))).alias("detected"))
    return base.select("model_slug", "total", "detected", ratio(F.col("detected"), F.col("total"), 1, 100).alias("ddr"), F.lit(0.0).alias("fpr"), F.when(F.col("total") >= 50, "Completed").otherwise("In Progress").alias("status")).orderBy(F.desc("ddr"), "model_slug")


def detection_report(candidates: DataFrame) -> DataFrame:
    """Detection rates over all, by drift type and by task, of valid tasks. candidates: task_id, drift_type, status, detected."""
    valid = candidates.filter("status != 'INVALID_TASK'")
    sets = valid.groupingSets([[], ["drift_type"], ["task_id"]], "drift_type", "task_id").agg(F.grouping_id("drift_type", "task_id").alias("g"), F.count_if("detected").alias("detected"), F.count("*").alias("total"))
    level = F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "drift_type").otherwise("task")
    return sets.select(level.alias("level"), F.coalesce(F.when(F.col("g") == 1, F.col("drift_type")), F.when(F.col("g") == 2, F.col("task_id")), F.lit("all")).alias("value"), "detected", "total", ratio(F.col("detected"), F.col("total"), 1, 100).alias("rate"))


def with_task_metadata(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """The category of a result, else of its task, else unknown."""
    meta = tasks.select(F.col("id").alias("task_id"), F.col("category").alias("task_category")).dropDuplicates(["task_id"])
    return results.join(meta, "task_id", "left").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.nullif("task_category", F.lit("")), F.lit("unknown"))).drop("task_category")


def with_language(results: DataFrame, repositories: DataFrame) -> DataFrame:
    """The language of a result's repository (short name) by the table of repositories (repo, language), else unknown."""
    known = repositories.select(F.col("repo").alias("repository"), F.col("language").alias("repo_language")).dropDuplicates(["repository"])
    return results.join(known, "repository", "left").withColumn("language", F.coalesce("repo_language", F.lit("unknown"))).drop("repo_language")


def capital(c: Column) -> Column:
    """The first character large, all others small."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


COUNTS = "map<string, struct<passed: bigint, failed: bigint, total: bigint>>"
HITS = "map<string, struct<correct: bigint, total: bigint>>"


def batch_entry(batch: DataFrame, tasks_total: int = 0) -> DataFrame:
    """Rows of a batch leaderboard as leaderboard rows: accuracy in percent, rates and errors that a batch has not as 0, counts of categories with the failed ones, by_repo as the batch has it (by_repository), and the number of all tasks."""
    counts = F.transform_values("by_category", lambda _, v: F.struct(v["correct"].alias("passed"), (v["total"] - v["correct"]).alias("failed"), v["total"].alias("total")))
    run = F.coalesce("scenarios_evaluated", F.lit(0))
    zero = F.lit(0.0)
    by_repo = F.col("by_repository").cast(HITS) if "by_repository" in batch.columns else F.lit(None).cast(HITS)
    return batch.select(
        "model", F.replace("model", F.lit("/"), F.lit("_")).alias("slug"), F.coalesce("display_name", "model").alias("display_name"), capital(F.coalesce("provider", F.lit("unknown"))).alias("provider"),
        zero.alias("pass_rate"), zero.alias("drift_detection_rate"), zero.alias("error_rate"), F.round(F.coalesce("overall_accuracy", zero) * 100, 1).alias("accuracy"), run.alias("tasks_run"), run.alias("tasks_completed"),
        F.coalesce("calibration_ece", zero).alias("calibration_ece"), F.coalesce("overconfident_errors", F.lit(0)).alias("overconfident_errors"), F.coalesce("underconfident_correct", F.lit(0)).alias("underconfident_correct"), "avg_confidence",
        F.coalesce(counts.cast(COUNTS), F.create_map().cast(COUNTS)).alias("by_category"), run_status(run).alias("status"), F.lit("batch").alias("source"),
        F.lit(tasks_total).cast("long").alias("tasks_total"), F.lit(0).cast("long").alias("errors"), F.lit(0).cast("long").alias("false_positives_excluded"), F.coalesce(by_repo, F.create_map().cast(HITS)).alias("by_repo"),
    )


def merge_leaderboards(local: DataFrame, batch: DataFrame, tasks_total: int = 0) -> DataFrame:
    """Full outer by model, ranked. A model of both keeps its local row with the batch's calibration error and overconfident errors, where given, and its categories as by_category_batch; a model of the batch alone gets a row of its own.

    local: columns of batch_entry, of which errors, tasks_total, false_positives_excluded and by_repo may be absent (null then). batch: model, display_name, provider, overall_accuracy, scenarios_evaluated, calibration_ece,
    overconfident_errors, underconfident_correct, avg_confidence, by_category (map to correct and total), and by_repository likewise or absent.
    """
    entries = batch_entry(batch, tasks_total)
    for c in [f for f in entries.schema if f.name not in local.columns]:
        local = local.withColumn(c.name, F.lit(None).cast(c.dataType))
    a, b = local.alias("a"), entries.alias("b")
    given = batch.select(F.col("model").alias("given_model"), F.col("calibration_ece").alias("given_ece"), F.col("overconfident_errors").alias("given_over"), F.col("by_category").alias("by_category_batch"))
    joined = a.join(b, F.col("a.model") == F.col("b.model"), "full").join(given, F.col("given_model") == F.col("a.model"), "left")
    richer = {"calibration_ece": "given_ece", "overconfident_errors": "given_over"}
    whole = {"tasks_total", "errors", "false_positives_excluded", "by_repo"}  # a local row's own, given or not
    both = lambda c: F.when(F.col("a.model").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) if c in whole else F.coalesce(*([richer[c]] if c in richer else []), f"a.{c}", f"b.{c}")
    columns = [both(c).alias(c) for c in entries.columns]
    return by_accuracy(joined.select(*columns, "by_category_batch"))


def model_names(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Provider and display name of model ids, from the registry or made of the id."""
    reg = registry.select(F.col("model"), F.nullif("display_name", F.lit("")).alias("given"))
    tail = F.element_at(F.split("model", "/"), -1)
    first = F.get(F.split("model", "/"), F.lit(0))
    provider = F.when(F.col("model").contains("/"), F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substr(first, F.lit(2))))).otherwise("Unknown")
    return models.join(reg, "model", "left").select("model", provider.alias("provider"), F.coalesce("given", title_case(F.replace(tail, F.lit("-"), F.lit(" ")))).alias("display_name"))


def overview(rows: DataFrame) -> DataFrame:
    """By repository: scenarios, drift scenarios, distinct categories and their sorted list."""
    return rows.groupBy("repository").agg(F.count("*").alias("scenarios"), F.count_if("has_drift").alias("drift"), F.countDistinct("category").alias("n_categories"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


def route(model: Column) -> Column:
    """The provider that a model's name stands for."""
    m = F.lower(model)
    return F.when(m.contains("claude") | m.startswith("anthropic/"), "anthropic").when(m.rlike("^(openai/)?(gpt|o[0-9])"), "openai").when(m.contains("gemini"), "google").when(m.contains("deepseek"), "deepseek").otherwise("litellm")


#: Seconds between calls of providers whose rate isn't configured.
DEFAULT_DELAYS = {"gemini": 6.5, "groq": 2.0, "deepseek": 1.0}


def delay_seconds(rpm: Column, provider: Column | None = None) -> Column:
    """Seconds between calls: by the configured rate, half a second on top, else what the provider is known for, else half a second."""
    default = F.lit(0.5)
    if provider is not None:
        default = F.coalesce(*(F.when(provider == p, F.lit(s)) for p, s in DEFAULT_DELAYS.items()), default)
    return F.when(F.coalesce(rpm, F.lit(0)) != 0, F.lit(60.0) / rpm + 0.5).otherwise(default)


def warmup_steps(size: Column, batch_size: int, accumulation: int, epochs: int, share: float = 0.1) -> Column:
    """Steps of a tenth of all, one at least, of a training over so many rows."""
    a_epoch = F.greatest(F.lit(1), F.floor(size / (batch_size * accumulation)))
    return F.greatest(F.lit(1), F.floor(a_epoch * epochs * share)).cast("int")


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")

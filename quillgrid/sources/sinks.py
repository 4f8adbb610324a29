"""Sinks: documents, line files, keyed overwrites, upserts and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.formats import fixed, percent


def write_document(row: DataFrame, path: str) -> None:
    """One JSON document; null fields stay."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results by model and task; only the tasks at hand are written again."""
    results.withColumn("task", F.col("task_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_slug", "task").parquet(path)


def _some_null(keys: list[str]) -> Column:
    return reduce(or_, (F.col(k).isNull() for k in keys))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key; rows with a null in the key all stay and meet in no task."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = rows.filter(~_some_null(keys)).withColumn("__n", n).filter("__n = 1").drop("__n")
    return first.unionByName(rows.filter(_some_null(keys)))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key, nulls equal to nulls. Tasks keep one row of a key each before they meet, so that a key (or a null) that many rows have is as many rows as tasks."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(state: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The state with the new rows in place of those of equal keys, nulls equal to nulls; of several new rows of a key the last by `order` (or any one). Columns missing on either side become null."""
    once = last_wins(new, keys, order) if order else new.dropDuplicates(keys)
    ids = once.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return state.join(ids, same, "left_anti").unionByName(once, allowMissingColumns=True)


def delete(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def append_history(history: DataFrame, run: DataFrame, order: str, most: int = 52) -> DataFrame:
    """The last `most` runs with the new one."""
    return history.unionByName(run, allowMissingColumns=True).orderBy(F.desc(order)).limit(most)


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One row, report: a heading and a table with a line for each (few) row, in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = f"## {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    key = F.struct(*order, *(c for c in columns if c not in order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("report"))


def detection_document(candidates: DataFrame, title: str = "Detection report") -> DataFrame:
    """One row, report: global metrics, a table by category and one by task. candidates: task_id, category, detected; of valid tasks, whose golden patches passed, so that the false-positive rate is 0."""
    rate = lambda: F.coalesce(F.try_divide(100.0 * F.count_if("detected"), F.count("*").cast("double")), F.lit(0.0))
    shown = lambda c: F.concat(fixed(c, 1), F.lit("%"))
    by = lambda key: candidates.groupBy(key).agg(F.count_if("detected").alias("detected"), F.count("*").alias("total"), shown(rate()).alias("DDR"))
    line = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    table = lambda rows, said, name: rows.agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias(name))
    categories = table(by("category"), line("category", F.col("detected").cast("string"), F.col("total").cast("string"), "DDR"), "categories")
    tasks = table(by("task_id"), line("task_id", F.concat_ws("/", "detected", "total"), "DDR"), "tasks")
    # The report's headings and lines.
    sums = candidates.agg(F.countDistinct("task_id").alias("n_tasks"), F.count("*").alias("n"), shown(rate()).alias("rate"))
    text = F.concat(
        F.lit(f"# {title}\n\n## Global Metrics\n\n- **Total Tasks Evaluated**: "), F.col("n_tasks").cast("string"), F.lit("\n- **Total Candidates/Variations**: "), F.col("n").cast("string"),
        F.lit("\n- **Global DDR (Drift Detection Rate)**: **"), "rate", F.lit("**\n- **FPR (False Positive Rate)**: **0.0%** (Enforced by Golden Patch validation)\n\n## Category Performance\n\n| Category | Detected | Total | DDR |\n| :--- | :--- | :--- | :--- |\n"),
        "categories", F.lit("\n\n## Task Breakdown\n\n| Task ID | Detected/Total | DDR |\n| :--- | :--- | :--- |\n"), "tasks", F.lit("\n"),
    )
    return sums.crossJoin(categories).crossJoin(tasks).select(text.alias("report"))


def console_rows(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One text column: numbers to the right, other values to the left, cut to their widths."""
    number = {f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")}
    return rows.select(F.concat_ws(" ", *((F.lpad if c in number else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items())).alias("line"))


def leaderboard_lines(board: DataFrame) -> DataFrame:
    """rank and line: what is printed of each model. board: rank, display_name, overall_accuracy, overconfident_errors and calibration_ece."""
    # Fixed value: the line's form.
    parts = [F.lit("  #"), F.col("rank").cast("string"), F.lit(" "), F.col("display_name"), F.lit(": "), percent(F.col("overall_accuracy"), 1), F.lit(" (overconfident: "), F.col("overconfident_errors").cast("string"), F.lit(", ECE: "), fixed(F.col("calibration_ece"), 3), F.lit(")")]
    return board.select("rank", F.concat(*parts).alias("line"))


def dataset_card(stats: DataFrame, most: int = 10) -> DataFrame:
    """One row, report: sums of category statistics and the table of the largest categories."""
    best = stats.orderBy(F.desc("total"), "category").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "category")))
    table = markdown_table(best, ["category", "verified", "dropped", "total", "verification_rate"], ["place"], "Largest categories")
    sums = stats.agg(F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.count("*").alias("n"))
    head = F.concat(F.lit("# Dataset\n\nverified: "), F.col("verified").cast("string"), F.lit("\ndropped: "), F.col("dropped").cast("string"), F.lit("\ncategories: "), F.col("n").cast("string"), F.lit("\n\n"))
    return sums.crossJoin(F.broadcast(table)).select(F.concat(head, "report").alias("report"))

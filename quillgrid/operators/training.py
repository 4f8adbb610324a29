"""Preference data: verified findings to instruction and preference pairs, and their statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import json_text
from quillgrid.operators.metrics import ratio
from quillgrid.operators.permutation import shuffled
from quillgrid.operators.ranges import numbered
from quillgrid.session import checkpointed

# The prompt of preference pairs and its notes.
DPO_HEAD = "Analyze this codebase for quality issues.\n\nAST-EXTRACTED FACTS:\n"
DPO_TAIL = "\n\nReturn findings as JSON."
CHOSEN_NOTES = "Passed structural verification"


def split_rows(rows: DataFrame) -> DataFrame:
    """Adds part: verified, retry or dropped, or null. Notes match without case, and their underscore is any character; null notes of verified rows match neither."""
    notes = F.col("verification_notes")
    retry = notes.ilike("pass2:verified_retry%")
    return rows.withColumn("part", F.when((F.col("verified") == 1) & retry, "retry").when((F.col("verified") == 1) & ~retry, "verified").when(F.col("verified") == 0, "dropped"))


def retryable(rows: DataFrame, most: int = 50, batch: bool = False) -> DataFrame:
    """The first `most` dropped rows of each repository whose notes invite another try; batch: of all, and with fewer exclusions."""
    notes = F.lower("verification_notes")
    fine = (F.col("verified") == 0) & (F.length("verification_notes") > 0) & ~notes.contains("confidence floor")
    if not batch:
        fine = fine & ~notes.contains("batch_mode")
    if batch:
        return rows.filter(fine).orderBy("seq").limit(most)
    n = F.row_number().over(Window.partitionBy("repo").orderBy("seq"))
    return rows.filter(fine).withColumn("n", n).filter(F.col("n") <= most).drop("n")


def facts_prompt() -> Column:
    return F.coalesce(F.nullif("facts_prompt", F.lit("")), F.concat(F.lit("FILE: "), F.col("file_path"), F.lit(" (repo: "), F.col("repo"), F.lit(")")))


def finding_json() -> Column:
    """A finding as JSON text."""
    return json_text(category=F.col("category"), severity=F.col("severity"), file=F.col("file_path"), description=F.col("description"), suggestion=F.col("suggestion"), confidence=F.col("confidence"))


def sft_groups(verified: DataFrame) -> DataFrame:
    """Findings of one prompt (or hash, or file) in order of category, repository and id: the messages of one pair."""
    key = F.coalesce(F.nullif("facts_prompt", F.lit("")), F.nullif("facts_hash", F.lit("")), F.col("file_path"))
    row = F.struct("category", "repo", "id", facts_prompt().alias("prompt"), finding_json().alias("finding"))
    grouped = verified.groupBy(key.alias("batch")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    reply = F.concat(F.lit('{"findings": ['), F.array_join(F.transform("rows", lambda r: r["finding"]), ", "), F.lit("]}"))
    return grouped.select("batch", F.size("rows").cast("long").alias("n_findings"), F.get("rows", F.lit(0))["prompt"].alias("prompt"), reply.alias("reply"))


def sft_messages(groups: DataFrame, system: str) -> DataFrame:
    """System, user and assistant messages."""
    # The prompt's head and tail.
    user = F.concat(F.lit("AST-EXTRACTED FACTS:\n"), F.col("prompt"), F.lit("\n\nReturn findings as JSON."))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return groups.select("batch", F.array(said("system", F.lit(system)), said("user", user), said("assistant", F.col("reply"))).alias("messages"))


def pick_pairs(dropped: DataFrame, chosen: DataFrame, by: str, seed: str = "") -> DataFrame:
    """Each dropped row with one chosen row of its group, picked by a digest of the dropped id: no sampling, no pairs of all.

    dropped: id and by; chosen: id and by. Chosen rows are numbered within their group; a dropped row takes number digest mod group size.
    """
    places = numbered(chosen.select(by, F.col("id").alias("chosen_id")), ["chosen_id"], "k", [by]).withColumn("k", F.col("k") - 1)
    sizes = chosen.groupBy(by).agg(F.count("*").alias("n"))
    digest = F.conv(F.left(F.md5(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")
    wanted = dropped.select(by, F.col("id").alias("dropped_id"), digest.alias("digest")).join(sizes, by).withColumn("k", F.col("digest") % F.col("n")).drop("digest", "n")
    return wanted.join(places, [by, "k"]).select(by, "dropped_id", "chosen_id")


def dpo_pairs(rows: DataFrame, most: int = 10_000, retry_weight: float = 0.6, seed: int = 42) -> DataFrame:
    """Preference pairs: dropped against verified rows of its category (weight 1), then against retried ones, `most` at most.

    A seeded permutation mixes them, always the same way for the same rows.
    """
    split = split_rows(rows)
    dropped = split.filter("part = 'dropped'")
    tries = [(1, "verified", 1.0), (2, "retry", retry_weight)]
    pairs = None
    for number, part, weight in tries:
        one = pick_pairs(dropped, split.filter(F.col("part") == part), "category").select("*", F.lit(number).alias("try"), F.lit(weight).alias("weight"))
        pairs = one if pairs is None else pairs.unionByName(one)
    capped = pairs.orderBy("try", "category", "dropped_id").limit(most)  # a top-k: each task keeps its own before any meet
    lose = split.select(F.col("id").alias("dropped_id"), F.concat(F.lit(DPO_HEAD), facts_prompt(), F.lit(DPO_TAIL)).alias("prompt"), finding_json().alias("rejected"), F.coalesce("verification_notes", F.lit("")).alias("rejected_notes"))
    win = split.select(F.col("id").alias("chosen_id"), finding_json().alias("chosen"))
    out = capped.join(lose, "dropped_id").join(win, "chosen_id")
    told = out.select("category", "dropped_id", "chosen_id", "prompt", "chosen", "rejected", F.lit(CHOSEN_NOTES).alias("chosen_notes"), "rejected_notes", F.when(F.col("weight") != 1.0, F.col("weight")).alias("weight"))
    return shuffled(checkpointed(told), ["dropped_id", "weight"], seed)


def category_stats(split: DataFrame, by: str = "category") -> DataFrame:
    """Verified (retried ones too), dropped, total, retried, and rate in percent, most first. split: by and part."""
    base = split.groupBy(by).agg(F.count_if(F.col("part").isin("verified", "retry")).alias("verified"), F.count_if(F.col("part") == "dropped").alias("dropped"), F.count_if(F.col("part") == "retry").alias("retry_verified"))
    total = F.col("verified") + F.col("dropped")
    return base.select(by, "verified", "dropped", total.alias("total"), "retry_verified", ratio(F.col("verified"), total, 1, 100).alias("verification_rate")).orderBy(F.desc("total"), by)


def teacher_scores(rows: DataFrame, teacher: str = "teacher_model", category: str = "category") -> DataFrame:
    """Verified rate of each teacher in each category, to three places."""
    return rows.groupBy(teacher, category).agg(F.count("*").alias("total"), F.sum(F.when(F.col("verified") == 1, 1).otherwise(0)).cast("long").alias("verified")).withColumn("rate", ratio(F.col("verified"), F.col("total"), 3))


def teacher_means(scores: DataFrame, teacher: str = "teacher_model") -> DataFrame:
    """Unweighted mean of a teacher's rounded rates."""
    return scores.groupBy(teacher).agg(F.round(F.avg("rate"), 3).alias("mean_rate"), F.count("*").alias("n_categories"))


def scan_totals(first: DataFrame) -> DataFrame:
    """Totals of a scan from its two tries: rows that are rejected again count twice, as the log has it. first: v1, d1, v2, d2."""
    return first.withColumn("verified_count", F.col("v1") + F.col("v2")).withColumn("dropped_count", F.col("d1") - F.col("v2") + F.col("d2"))


def run_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.sum("verified_count").cast("long").alias("verified"), F.sum("dropped_count").cast("long").alias("dropped"), F.countDistinct("repo").alias("repos"))


def run_entry(stats: DataFrame, run_number: Column, date: Column) -> DataFrame:
    """One history row: sums, and a map of the categories' counts and rates."""
    entry = F.struct(F.col("category"), F.struct("verified", "dropped", F.col("verification_rate").alias("rate")))
    return stats.agg(run_number.alias("run_number"), date.alias("date"), F.sum("verified").cast("long").alias("total_verified"), F.sum("dropped").cast("long").alias("total_dropped"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("categories"))


def budget_prefix(rows: DataFrame, by: list[str], order: list[str], length: Column, most: int, keep_last: bool = True, shares: int = 64) -> DataFrame:
    """Rows of each group until those before one are longer than `most` (keep_last) or reach it.

    A row that is out by the rows of its share of the group alone (dealt by a hash of its order) is out by all, so that few rows of a large group meet.
    """
    before = lambda *more: F.coalesce(F.sum(length).over(Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.col("chars_before") <= most if keep_last else F.col("chars_before") < most
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*order), F.lit(shares))).withColumn("chars_before", before("__share")).filter(fits)
    return dealt.drop("__share", "chars_before").withColumn("chars_before", before()).filter(fits)


def micro_batches(rows: DataFrame, by: list[str], order: list[str], size: int = 15, keep_rest: bool = True) -> DataFrame:
    """Numbers batches of `size` in each group; keep_rest=False drops what is left over after at least one full batch."""
    made = numbered(rows, order, "batch", by).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))
    if keep_rest:
        return made
    full = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in by)).agg(F.greatest(F.lit(1), F.floor(F.count("*") / size)).alias("__full"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by))
    return made.join(full, same).filter(F.col("batch") < F.col("__full")).select(made.columns)


def content_hash(facts: Column) -> Column:
    return F.left(F.sha2(F.to_json(facts).cast("binary"), 256), F.lit(16))


def gate_status(stats: DataFrame, least_rows: int = 50, least_rate: float = 10.0) -> DataFrame:
    """Whether enough rows are verified, and whether the rate is worth a warning."""
    total = stats.agg(F.sum("verified").cast("long").alias("verified"), F.sum("total").cast("long").alias("total"))
    rate = ratio(F.col("verified"), F.col("total"), 1, 100)
    return total.select("*", rate.alias("rate"), F.when(F.coalesce("verified", F.lit(0)) < least_rows, "fail").when(rate < least_rate, "warn").otherwise("ok").alias("status"))

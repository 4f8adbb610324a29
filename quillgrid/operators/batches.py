"""Batch requests and what comes back: ids, findings of replies, their repositories and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import batch_custom_id, repo_of_custom_id, strip_fences

FINDING = "struct<category: string, severity: string, file: string, line: int, description: string, suggestion: string, confidence: double>"


def requests(prompts: DataFrame) -> DataFrame:
    """custom_id and user text of prompts (repo, batch, prompt)."""
    # The prompt's head and tail.
    user = F.concat(F.lit("AST-EXTRACTED FACTS:\n"), F.col("prompt"), F.lit("\n\nReturn findings as JSON."))
    return prompts.select(batch_custom_id(F.col("repo"), F.col("batch")).alias("custom_id"), "repo", user.alias("user"))


def detection_prompt(intent: Column, patch: Column) -> Column:
    """The leaderboard's question on a patch."""
    # The prompt's text.
    return F.concat(F.lit("## Code Review Task\n\n**Intent:**\n"), intent, F.lit("\n\n**Patch:**\n```diff\n"), patch, F.lit("\n```\n\nDoes this patch introduce code drift? Respond with JSON only."))


def evaluation_prompt(scenarios: DataFrame) -> Column:
    """The question on a scenario's first candidate; empty where it has none. Missing fields count as empty."""
    given = lambda c: F.coalesce(c, F.lit(""))
    first = F.get("drift_candidates", F.lit(0))
    # The prompt's text.
    text = F.concat(
        F.lit("You are a code drift detector. Analyze the following code change for potential drift issues.\n\nRepository: "), given(scenarios["repository"]),
        F.lit("\nIntent: "), given(scenarios["intent"]), F.lit("\nCategory being tested: "), given(scenarios["category"]), F.lit("\nChange name: "), given(scenarios["name"]),
        F.lit("\n\nA drift candidate has been identified with type: "), given(first["drift_type"]),
        F.lit('\n\nBased on the intent and the drift type, should this code change be flagged as drift?\nRespond with a JSON object: {"is_drift": true/false, "confidence": 0.0-1.0, "category": "..."}'),
    )
    return F.when(F.size(F.coalesce("drift_candidates", F.array())) == 0, "").otherwise(text)


def retry_prompt(finding: Column, reason: Column, facts: Column) -> Column:
    """The second try's text. finding: the rejected finding as JSON text."""
    # The prompt's text.
    return F.concat(
        F.lit("Your previous finding was REJECTED by structural verification.\n\nREJECTION REASON: "), reason, F.lit("\n\nYOUR REJECTED FINDING:\n"), finding, F.lit("\n\nORIGINAL AST FACTS:\n"), facts,
        F.lit("\n\nPlease produce a CORRECTED finding that addresses the rejection reason, or return empty findings if no valid issue exists."),
    )


def findings(responses: DataFrame) -> DataFrame:
    """A row for each finding in replies (custom_id, text): an object with findings, or a list of them; marked with the id."""
    body = strip_fences(F.col("text"))
    inside, listed = F.from_json(body, f"struct<findings: array<{FINDING}>>")["findings"], F.from_json(body, f"array<{FINDING}>")
    return responses.select("custom_id", F.posexplode(F.when(body.startswith("["), listed).otherwise(inside)).alias("pos", "f")).select(F.col("custom_id").alias("_batch_id"), "pos", "f.*")


def with_repo(found: DataFrame, known: DataFrame) -> DataFrame:
    """Findings with the repository of their request, else that which the id stands for; orphan where no repository is known by that name."""
    ids = known.select(F.col("custom_id").alias("_batch_id"), F.col("repo").alias("asked"))
    names = known.select(F.col("repo").alias("guess"), F.lit(True).alias("there")).distinct()
    rows = found.join(ids, "_batch_id", "left").withColumn("guess", repo_of_custom_id(F.col("_batch_id"))).join(names, "guess", "left")
    return rows.select(F.coalesce("asked", "guess").alias("repo"), (F.col("asked").isNull() & F.col("there").isNull()).alias("orphan"), *found.columns)


def outcome_counts(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("errored"), F.count("*").alias("total"))

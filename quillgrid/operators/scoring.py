"""Gate reports and model replies to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import dashed_id, json_object, let, response_body


def failed_gates(summary: Column) -> Column:
    return F.map_keys(F.map_filter(summary, lambda _, v: v == "FAIL"))


def false_positive(report: Column) -> Column:
    """A failure of the structure check alone, by gate and by finding."""
    only = F.array(F.lit("structure-check"))
    return F.coalesce((report["status"] != "PASS") & (failed_gates(report["summary"]) == only) & (F.transform(report["failures"], lambda f: f["id"]) == only), F.lit(False))


def detected(report: Column, patch_applied: Column) -> Column:
    """An error with a staleness finding, a failure, or a patch that didn't apply."""
    stale = F.exists(F.coalesce(report["failures"], F.array()), lambda f: F.coalesce(f["id"].startswith("STALENESS_"), F.lit(False)))
    return F.when(~F.coalesce(patch_applied, F.lit(True)), True).when(report["status"] == "ERROR", stale).otherwise(F.coalesce(report["status"] == "FAIL", F.lit(False)))


def candidate_correct(expected: Column, found: Column, gate: Column, summary: Column) -> Column:
    right_gate = gate.isNull() | (gate == "") | F.coalesce(F.try_element_at(summary, gate) == "FAIL", F.lit(False))
    return F.when(expected == "FAIL", found & right_gate).otherwise(~found)


def task_status(golden_detected: Column) -> Column:
    return F.when(golden_detected, "INVALID_TASK").otherwise("VALID")


def evaluate_candidates(tasks: DataFrame) -> DataFrame:
    """Candidates of valid tasks with correctness. tasks: task_id, golden_detected, candidates with id, expected_result, detected, fail_gate and summary."""
    each = tasks.withColumn("status", task_status(F.col("golden_detected"))).select("task_id", "status", F.explode_outer(F.when(F.col("status") == "VALID", F.col("candidates"))).alias("c"))
    return each.select("task_id", "status", F.col("c.id").alias("candidate_id"), F.col("c.detected").alias("detected"), candidate_correct(F.col("c.expected_result"), F.col("c.detected"), F.col("c.fail_gate"), F.col("c.summary")).alias("correct"))


def outcome(results: DataFrame) -> DataFrame:
    """passed: nothing detected; correct: the same as for the golden patch."""
    llm, golden = F.col("llm_result.detected"), F.col("golden_result.detected")
    return results.withColumn("passed", ~llm).withColumn("correct", llm == golden)


def parse_reply(text: Column) -> Column:
    """parsed, says_drift, confidence, drift_type and explanation of a reply.

    has_drift: false if missing, null if given as null or of another type (equal to neither truth); confidence: 0.5
    if missing, clamped to 0 to 1. Not one whole JSON object, or no number as confidence: not parsed.
    Every step is bound to a name once, and all fields come from one parsed value.
    """
    value = json_object(response_body(text))
    get = lambda v, p, t: F.try_variant_get(v, p, t)

    def fields(v: Column) -> Column:
        given, has = get(v, "$.confidence", "variant"), get(v, "$.has_drift", "variant")
        number = F.coalesce(get(v, "$.confidence", "double"), get(v, "$.confidence", "string").try_cast("double"))
        says = F.when(has.isNull(), F.lit(False)).when(F.schema_of_variant(has) == "BOOLEAN", get(v, "$.has_drift", "boolean"))
        return F.struct(
            v.isNotNull().alias("object"), given.isNull().alias("unsure"), number.alias("number"), says.alias("says"),
            get(v, "$.drift_type", "string").alias("drift_type"), get(v, "$.explanation", "string").alias("explanation"),
        )

    def reply(f: Column) -> Column:
        confidence = F.when(f["unsure"], F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f["number"])))
        return let(
            f["object"] & (f["unsure"] | f["number"].isNotNull()),
            lambda parsed: F.struct(
                parsed.alias("parsed"), F.when(parsed, f["says"]).alias("says_drift"), F.when(parsed, confidence).otherwise(0.0).alias("confidence"),
                F.when(parsed, f["drift_type"]).alias("drift_type"), F.when(parsed, F.coalesce(f["explanation"], F.lit(""))).otherwise("(parse error)").alias("explanation"),
            ),
        )

    return let(let(value, fields), reply)


def predictions(responses: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Replies joined with their scenarios; a reply that can't be parsed counts as wrong with no confidence. Of scenarios with one cleaned id, the last by scenario_id is meant."""
    known = scenarios.select(dashed_id(F.col("scenario_id")).alias("custom_id"), F.struct("scenario_id", "has_drift", "category", "repository").alias("s")).groupBy("custom_id").agg(F.max("s").alias("s"))
    rows = responses.join(known, "custom_id").withColumn("r", parse_reply(F.col("text")))
    truth = F.col("s.has_drift")
    says = F.when(F.col("r.parsed"), F.col("r.says_drift")).otherwise(~truth)
    return rows.select("model", F.col("s.scenario_id").alias("scenario_id"), F.col("s.category").alias("category"), F.col("s.repository").alias("repository"), says.alias("has_drift"), F.col("r.confidence").alias("confidence"), F.col("r.drift_type").alias("drift_type"), F.col("r.explanation").alias("explanation"), F.coalesce(says == truth, F.lit(False)).alias("correct"), F.left("text", F.lit(500)).alias("raw_response"))

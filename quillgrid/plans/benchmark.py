"""Benchmark side: predictions, results and leaderboards, with events in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import metrics, scenarios, scoring
from quillgrid.plans.registry import query, table

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
PREDICTIONS_SQL = f"SELECT concat('m', user_id % 10) AS model, event_type AS category, ts, {_K} / 100.0::DOUBLE AS confidence, (event_id * 37) % 100 < {_K} AS correct, event_type = 'error' AS failed_run, event_id FROM events"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored predictions: model by user, category by type, confidence from props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model"), F.col("event_type").alias("category"), "ts", (k / 100.0).alias("confidence"),
        ((F.col("event_id") * 37) % 100 < k).alias("correct"), (F.col("event_type") == "error").alias("failed_run"), "event_id",
    )


def _ece(mid: bool, by: str = "model") -> str:
    against = "(bin + 0.5) / 10" if mid else "conf"
    return f"""SELECT {by}, round(sum(n * abs(acc - {against})) / sum(n), 4) AS ece FROM (
      SELECT {by}, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc, avg(confidence) AS conf FROM p WHERE confidence IS NOT NULL GROUP BY ALL) GROUP BY {by}"""


@query("q01_leaderboard", f"""
WITH p AS ({PREDICTIONS_SQL}), a AS (
  SELECT model, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (confidence >= 0.8 AND NOT correct) AS overconfident_errors,
    count(*) FILTER (confidence < 0.5 AND correct) AS underconfident_correct, round(avg(confidence), 3) AS avg_confidence,
    round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS overall_accuracy FROM p GROUP BY model)
SELECT a.*, m.ece AS ece_mean, d.ece AS ece_midpoint, CAST(row_number() OVER (ORDER BY overall_accuracy DESC, model) AS INTEGER) AS rank
FROM a LEFT JOIN ({_ece(False)}) m USING (model) LEFT JOIN ({_ece(True)}) d USING (model)""")  # fmt: skip
def leaderboard(spark, sf_dir):
    return metrics.leaderboard(predictions(spark, sf_dir))


@query("q02_accuracy_by_category", f"WITH p AS ({PREDICTIONS_SQL}) SELECT model, category, count(*) FILTER (correct) AS correct, count(*) AS total, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM p GROUP BY ALL")
def by_category(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir), ["model", "category"])


def runs(spark, sf_dir):
    return predictions(spark, sf_dir).select("model", "category", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("failed_run"), "failed").alias("error"), F.col("correct").alias("passed"), (F.col("event_id") % 3 != 0).alias("correct"), "event_id")


RUNS_SQL = f"SELECT model, category, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN failed_run THEN 'failed' END AS error, correct AS passed, event_id % 3 <> 0 AS correct, event_id FROM ({PREDICTIONS_SQL})"
_PASSED = "count(*) FILTER (error IS NULL AND passed) AS passed, count(*) FILTER (error IS NULL AND NOT passed) AS failed, count(*) AS total"


@query("q03_breakdown", f"""WITH r AS ({RUNS_SQL})
SELECT 'model' AS dimension, model AS value, {_PASSED} FROM r GROUP BY ALL UNION ALL SELECT 'category', category, {_PASSED} FROM r GROUP BY ALL UNION ALL SELECT 'day', day, {_PASSED} FROM r GROUP BY ALL""")
def breakdown(spark, sf_dir):
    return metrics.breakdown(runs(spark, sf_dir), ["model", "category", "day"])


@query("q04_rates", f"""WITH r AS ({RUNS_SQL}), a AS (SELECT model, count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND passed) AS passed,
  count(*) FILTER (error IS NULL AND NOT passed) AS failed, count(*) FILTER (error IS NULL AND correct) AS correct FROM r GROUP BY model)
SELECT *, total - errors AS completed, round(coalesce(100.0::DOUBLE * passed / nullif(total - errors, 0), 0), 1) AS pass_rate, round(coalesce(100.0::DOUBLE * failed / nullif(total - errors, 0), 0), 1) AS drift_detection_rate,
  round(coalesce(100.0::DOUBLE * correct / nullif(total - errors, 0), 0), 1) AS accuracy, round(coalesce(100.0::DOUBLE * errors / nullif(total, 0), 0), 1) AS error_rate FROM a""")
def rates(spark, sf_dir):
    return metrics.rates(runs(spark, sf_dir), ["model"])


@query("q05_gates", f"""WITH g AS (SELECT unnest([{{'gate': 'ast-analysis', 'status': CASE WHEN correct THEN 'PASS' ELSE 'FAIL' END}}, {{'gate': category, 'status': CASE WHEN failed_run THEN 'SKIP' WHEN confidence > 0.5 THEN 'PASS' ELSE 'FAIL' END}}]) AS x FROM ({PREDICTIONS_SQL}))
SELECT x.gate AS gate, count(*) FILTER (x.status = 'PASS') AS passed, count(*) FILTER (x.status = 'FAIL') AS failed, count(*) AS total FROM g GROUP BY ALL""")
def gates(spark, sf_dir):
    p = predictions(spark, sf_dir)
    summary = F.create_map(F.lit("ast-analysis"), F.when(F.col("correct"), "PASS").otherwise("FAIL"), F.col("category"), F.when(F.col("failed_run"), "SKIP").when(F.col("confidence") > 0.5, "PASS").otherwise("FAIL"))
    return metrics.gate_counts(p.select(summary.alias("summary")))


@query("q06_finding_histogram", f"""WITH f AS (SELECT unnest([category, CASE WHEN correct THEN 'ok' END]) AS id FROM ({PREDICTIONS_SQL})) SELECT coalesce(id, 'unknown') AS finding, count(*) AS n FROM f GROUP BY ALL""")
def findings(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return metrics.finding_histogram(p.select(F.array(F.struct(F.col("category").alias("id")), F.struct(F.when(F.col("correct"), "ok").alias("id"))).alias("failures")))


@query("q07_detection_report", f"""WITH c AS (SELECT model AS task_id, category AS drift_type, failed_run AS invalid, correct AS detected FROM ({PREDICTIONS_SQL})), v AS (SELECT * FROM c WHERE NOT invalid)
SELECT level, value, detected, total, round(100.0::DOUBLE * detected / total, 1) AS rate FROM (
  SELECT 'global' AS level, 'all' AS value, count(*) FILTER (detected) AS detected, count(*) AS total FROM v UNION ALL
  SELECT 'drift_type', drift_type, count(*) FILTER (detected), count(*) FROM v GROUP BY drift_type UNION ALL SELECT 'task', task_id, count(*) FILTER (detected), count(*) FROM v GROUP BY task_id)""")
def detection(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return metrics.detection_report(p.select(F.col("model").alias("task_id"), F.col("category").alias("drift_type"), F.when(F.col("failed_run"), "INVALID_TASK").otherwise("VALID").alias("status"), F.col("correct").alias("detected")))


@query("q08_slug_rates", f"""SELECT concat('org_', model) AS model_slug, count(*) AS total, count(*) FILTER (correct) AS detected, round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS ddr, 0.0::DOUBLE AS fpr,
CASE WHEN count(*) >= 50 THEN 'Completed' ELSE 'In Progress' END AS status FROM ({PREDICTIONS_SQL}) GROUP BY model""")
def slugs(spark, sf_dir):
    return metrics.detection_by_slug(predictions(spark, sf_dir).select(F.concat(F.lit("org_"), "model").alias("model_slug"), F.col("correct").alias("detected")))


def _half(spark, sf_dir, odd: int, models: tuple[int, int]):
    p = predictions(spark, sf_dir).filter((F.col("event_id") % 2 == odd) & F.substring("model", 2, 2).cast("int").between(*models))
    return metrics.leaderboard(p), metrics.accuracy(p, ["model", "category"])


def _half_sql(odd: int, low: int, high: int) -> str:
    return f"""(WITH p AS (SELECT * FROM ({PREDICTIONS_SQL}) WHERE event_id % 2 = {odd} AND CAST(substr(model, 2) AS INTEGER) BETWEEN {low} AND {high})
    SELECT model, count(*) AS n, count(*) FILTER (correct) AS hits, any_value(e.ece) AS ece, count(*) FILTER (confidence >= 0.8 AND NOT correct) AS over, count(*) FILTER (confidence < 0.5 AND correct) AS under,
    round(avg(confidence), 3) AS avg_confidence, count(DISTINCT category) AS n_categories FROM p JOIN ({_ece(odd == 0)}) e USING (model) GROUP BY model)"""


_LOCAL = "concat('org/', model) AS model, concat('org_', model) AS slug, concat('Org ', upper(model)) AS display_name, 'Org' AS provider, 0.5::DOUBLE AS pass_rate, round(100.0::DOUBLE * hits / n, 1) AS accuracy, n AS tasks_completed, ece AS calibration_ece, over AS overconfident_errors, under AS underconfident_correct, avg_confidence, CASE WHEN n >= 20 THEN 'verified' ELSE 'partial' END AS status"
_BATCHED = _LOCAL.replace("concat('Org ', upper(model))", "concat('org/', model)").replace("'Org' AS", "CASE WHEN model = 'm9' THEN 'Unknown' ELSE 'Acme' END AS").replace("0.5::DOUBLE", "0.0::DOUBLE").replace("round(100.0::DOUBLE * hits / n, 1)", "round(round(hits::DOUBLE / n, 4) * 100, 1)")


@query("q09_merge_leaderboards", f"""WITH a AS (SELECT {_LOCAL} FROM {_half_sql(0, 0, 6)}), h AS (SELECT * FROM {_half_sql(1, 4, 9)}), b AS (SELECT {_BATCHED}, n_categories FROM h),
m AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.slug, b.slug) AS slug, coalesce(a.display_name, b.display_name) AS display_name, coalesce(a.provider, b.provider) AS provider, coalesce(a.pass_rate, b.pass_rate) AS pass_rate, coalesce(a.accuracy, b.accuracy) AS accuracy,
  coalesce(a.tasks_completed, b.tasks_completed) AS tasks_completed, coalesce(b.calibration_ece, a.calibration_ece) AS calibration_ece, coalesce(b.overconfident_errors, a.overconfident_errors) AS overconfident_errors, coalesce(a.underconfident_correct, b.underconfident_correct) AS underconfident_correct,
  coalesce(a.avg_confidence, b.avg_confidence) AS avg_confidence, coalesce(a.status, b.status) AS status, CASE WHEN a.model IS NULL THEN 'batch' ELSE 'local' END AS source, CASE WHEN a.model IS NULL THEN NULL ELSE CAST(b.n_categories AS INTEGER) END AS batch_categories, CASE WHEN a.model IS NULL THEN CAST(b.n_categories AS INTEGER) ELSE 0 END AS own_categories,
  CASE WHEN a.model IS NULL THEN 97 ELSE 90 END::BIGINT AS tasks_total, CASE WHEN a.model IS NULL THEN 0 ELSE 1 END::BIGINT AS errors, CASE WHEN a.model IS NULL THEN 0 ELSE 2 END::BIGINT AS false_positives_excluded, CASE WHEN a.model IS NULL THEN CAST(b.n_categories AS INTEGER) ELSE -1 END AS repositories FROM a FULL JOIN b ON a.model = b.model)
SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, tasks_completed DESC, model) AS INTEGER) AS rank FROM m""")
def merge(spark, sf_dir):
    (mine, _), (other, by) = _half(spark, sf_dir, 0, (0, 6)), _half(spark, sf_dir, 1, (4, 9))
    name, zero = F.concat(F.lit("org/"), "model"), F.lit(0.0)
    none = F.create_map().cast(metrics.COUNTS)
    local = mine.select(
        name.alias("model"), F.concat(F.lit("org_"), "model").alias("slug"), F.concat(F.lit("Org "), F.upper("model")).alias("display_name"), F.lit("Org").alias("provider"), F.lit(0.5).alias("pass_rate"), zero.alias("drift_detection_rate"), zero.alias("error_rate"),
        metrics.ratio(F.col("correct"), F.col("total"), 1, 100).alias("accuracy"), F.col("total").alias("tasks_run"), F.col("total").alias("tasks_completed"), F.col("ece_midpoint").alias("calibration_ece"), "overconfident_errors", "underconfident_correct", "avg_confidence",
        none.alias("by_category"), metrics.run_status(F.col("total")).alias("status"), F.lit("local").alias("source"),
    )
    counts = by.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("correct", "total")))).alias("by_category"))
    batch = other.join(counts, "model").select(
        name.alias("model"), F.lit(None).cast("string").alias("display_name"), F.when(F.col("model") != "m9", "aCME").alias("provider"), "overall_accuracy", F.col("total").alias("scenarios_evaluated"), F.col("ece_mean").alias("calibration_ece"), "overconfident_errors", "underconfident_correct", "avg_confidence", "by_category",
    )
    hits = by.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("correct", "total")))).alias("by_repository")).withColumn("model", name)
    local = local.withColumns({"tasks_total": F.lit(90).cast("long"), "errors": F.lit(1).cast("long"), "false_positives_excluded": F.lit(2).cast("long")})
    made = metrics.merge_leaderboards(local, batch.join(hits, "model"), tasks_total=97)
    columns = ["model", "slug", "display_name", "provider", "pass_rate", "accuracy", "tasks_completed", "calibration_ece", "overconfident_errors", "underconfident_correct", "avg_confidence", "status", "source", "rank", "tasks_total", "errors", "false_positives_excluded"]
    return made.select(*columns, F.coalesce(F.size("by_repo"), F.lit(-1)).alias("repositories"), F.when(F.col("by_category_batch").isNotNull(), F.size("by_category_batch")).alias("batch_categories"), F.size("by_category").alias("own_categories"))


def tasks(spark, sf_dir):
    """Documents as tasks; candidates are two for every third."""
    d = table(spark, sf_dir, "documents")
    cand = lambda n, t: F.struct(F.lit(n).alias("id"), F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(f"/{n}.patch")).alias("patch"), F.lit(t).alias("drift_type"), F.lit("FAIL").alias("expected_result"), F.when(F.col("doc_id") % 2 == 0, "ast-analysis").alias("fail_gate"))
    two = F.when(F.col("doc_id") % 3 == 0, F.array(cand("c1", "logic_drift"), cand("c2", "staleness"))).otherwise(F.array(cand("c1", "logic_drift")))
    return d.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("category"), F.col("source").alias("name"), F.concat(F.lit("org/"), "source").alias("repository"), F.lit("keep").alias("intent"), F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit("/gold.patch")).alias("golden_patch"), two.alias("drift_candidates"))


_TASK_COLUMNS = "concat('t', doc_id) AS task_id, source AS name, concat('org/', source) AS repository, lang AS category, 'keep' AS intent"


@query("q10_scenarios", f"""SELECT {_TASK_COLUMNS}, concat('t', doc_id, '__golden') AS scenario_id, concat('p/', doc_id, '/gold.patch') AS patch_path, false AS has_drift, NULL::VARCHAR AS drift_type, NULL::VARCHAR AS expected_gate FROM documents
UNION ALL SELECT {_TASK_COLUMNS}, concat('t', doc_id, '__', c.id), concat('p/', doc_id, '/', c.id, '.patch'), true, c.t, CASE WHEN doc_id % 2 = 0 THEN 'ast-analysis' END
FROM documents, (VALUES ('c1', 'logic_drift', 0), ('c2', 'staleness', 1)) AS c(id, t, k) WHERE c.k = 0 OR doc_id % 3 = 0""")
def expand(spark, sf_dir):
    return scenarios.expand(tasks(spark, sf_dir))


@query("q11_overview", f"""WITH s AS (SELECT concat('org/', source) AS repository, lang AS category, false AS has_drift FROM documents UNION ALL SELECT concat('org/', source), lang, true FROM documents, (VALUES (0), (1)) AS c(k) WHERE c.k = 0 OR doc_id % 3 = 0)
SELECT repository, count(*) AS scenarios, count(*) FILTER (has_drift) AS drift, count(DISTINCT category) AS n_categories, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM s GROUP BY repository""")
def overview(spark, sf_dir):
    return metrics.overview(scenarios.expand(tasks(spark, sf_dir)))


@query("q12_run_plan", "SELECT r_name AS model, n_name AS task FROM region, nation")
def plan(spark, sf_dir):
    return scenarios.run_plan(table(spark, sf_dir, "region").select(F.col("r_name").alias("model")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("task")))


# Replies of each kind; what Python's json module makes of them was worked out by hand.
REPLIES = [
    ("plain", '{"has_drift": true, "confidence": 0.9, "drift_type": "logic"}', True, True, 0.9, "logic"),
    ("fenced", '```json\n{"has_drift": false, "confidence": 0.4}\n```', True, False, 0.4, None),
    ("word", 'json {"has_drift": true}', True, True, 0.5, None),
    ("trailing", '{"has_drift": true} and so on', False, None, 0.0, None),
    ("list", "[]", False, None, 0.0, None),
    ("prose", "no json here", False, None, 0.0, None),
    ("missing", '{"confidence": 0.7}', True, False, 0.7, None),
    ("null", '{"has_drift": null}', True, None, 0.5, None),
    ("string", '{"has_drift": "true"}', True, None, 0.5, None),
    ("number as text", '{"has_drift": true, "confidence": "0.7"}', True, True, 0.7, None),
    ("above", '{"has_drift": true, "confidence": 1.7}', True, True, 1.0, None),
    ("below", '{"has_drift": true, "confidence": -0.2}', True, True, 0.0, None),
    ("null number", '{"has_drift": true, "confidence": null}', False, None, 0.0, None),
]


def quoted(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_REPLY_ROWS = ", ".join(f"({k}, {quoted(a)}, {quoted(b)}, {quoted(c)}, {quoted(d)}, {quoted(e)})" for k, (a, _, b, c, d, e) in enumerate(REPLIES))


@query("q13_parse_replies", f"SELECT event_id, name, parsed, says_drift, confidence, drift_type FROM events JOIN (VALUES {_REPLY_ROWS}) AS t(k, name, parsed, says_drift, confidence, drift_type) ON event_id % {len(REPLIES)} = k")
def replies(spark, sf_dir):
    """Every event with a reply of one of the kinds."""
    kinds = spark.createDataFrame([(k, n, t) for k, (n, t, *_) in enumerate(REPLIES)], "k long, name string, text string")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(REPLIES)).alias("k")).join(kinds, "k")
    return rows.withColumn("r", scoring.parse_reply(F.col("text"))).select("event_id", "name", "r.parsed", "r.says_drift", "r.confidence", "r.drift_type")


@query("q14_json_defaults", f"SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE {_K} / 80.0::DOUBLE END)) AS confidence, event_id % 2 = 0 AND event_id % 5 <> 0 AS has_drift FROM events")
def json_defaults(spark, sf_dir):
    """Replies made of the events' props: a confidence on two of three, which may be above 1, a decision on four of five."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double") / 80
    fields = F.array_compact(F.array(F.when(i % 3 != 0, F.concat(F.lit('"confidence": '), k.cast("string"))), F.when(i % 5 != 0, F.concat(F.lit('"has_drift": '), F.when(i % 2 == 0, "true").otherwise("false")))))
    reply = scoring.parse_reply(F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}")))
    return table(spark, sf_dir, "events").withColumn("r", reply).select("event_id", "r.confidence", F.col("r.says_drift").alias("has_drift"))


@query("q15_candidate_rules", f"""WITH c AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'FAIL' ELSE 'PASS' END AS expected, correct AS detected, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'click' ELSE category END AS gate, category FROM ({PREDICTIONS_SQL}))
SELECT event_id, CASE WHEN expected = 'FAIL' THEN detected AND (gate IS NULL OR gate = category) ELSE NOT detected END AS correct FROM c""")
def candidate_rules(spark, sf_dir):
    p = predictions(spark, sf_dir)
    i = F.col("event_id")
    gate = F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 3 == 0, "click").otherwise(F.col("category"))
    ok = scoring.candidate_correct(F.when(i % 2 == 0, "FAIL").otherwise("PASS"), F.col("correct"), gate, F.create_map(F.col("category"), F.lit("FAIL")))
    return p.select("event_id", ok.alias("correct"))


@query("q16_task_results", """WITH t AS (SELECT doc_id, lang AS category FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, CASE WHEN quality = 1 THEN source END AS own FROM labels JOIN documents USING (doc_id))
SELECT coalesce(own, t.category, 'unknown') AS category, count(*) AS n FROM r LEFT JOIN t USING (doc_id) GROUP BY ALL""")
def task_results(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    tasks_ = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    results = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("task_id"), F.when(F.col("quality") == 1, F.col("source")).alias("category"))
    return metrics.with_task_metadata(results, tasks_).groupBy("category").agg(F.count("*").alias("n"))


@query("q17_languages", """SELECT coalesce(l.language, 'unknown') AS language, count(*) AS n FROM documents LEFT JOIN (SELECT source, min(lang) AS language FROM documents WHERE lang <> 'en' GROUP BY source HAVING min(lang) < 'es') l USING (source) GROUP BY ALL""")
def languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.filter("lang <> 'en'").groupBy(F.col("source").alias("repo")).agg(F.min("lang").alias("language")).filter("language < 'es'")
    return metrics.with_language(d.select(F.col("source").alias("repository")), known).groupBy("language").agg(F.count("*").alias("n"))


@query("q18_tasks_by_repository", "SELECT concat('org/', source) AS repository, count(*) AS tasks, (SELECT count(DISTINCT source) FROM documents) AS repositories, (SELECT count(*) FROM documents) AS total_tasks FROM documents GROUP BY ALL")
def tasks_by_repository(spark, sf_dir):
    return metrics.tasks_by_repository(tasks(spark, sf_dir))


@query("q19_run_preview", "SELECT r_name AS model, (SELECT list(n) FROM (SELECT n_name AS n FROM nation ORDER BY n_name LIMIT 5))::VARCHAR AS first_tasks, (SELECT count(*) - 5 FROM nation) AS more, (SELECT count(*) FROM nation) * (SELECT count(*) FROM region) AS total_runs FROM region")
def run_preview(spark, sf_dir):
    made = scenarios.preview(table(spark, sf_dir, "region").select(F.col("r_name").alias("model")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("id")))
    return made.withColumn("first_tasks", F.concat(F.lit("["), F.array_join("first_tasks", ", "), F.lit("]")))

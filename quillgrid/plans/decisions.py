"""Decisions from gate reports, replies and scans, with events, documents and suppliers in their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import formats
from quillgrid.functions.text import dashed_id, has_diff
from quillgrid.operators import discovery, metrics, scenarios, scoring, training
from quillgrid.plans.benchmark import tasks
from quillgrid.plans.registry import query, table

_REPORTS = """SELECT event_id, concat('m', user_id % 10) AS model, event_type, user_id, k, CASE WHEN k < 40 THEN 'PASS' WHEN k < 80 THEN 'FAIL' WHEN k IS NOT NULL THEN 'ERROR' END AS st, CASE WHEN event_id % 13 <> 0 THEN event_id % 11 <> 0 END AS applied, user_id % 7 = 0 AS golden
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_GATES = f"""SELECT event_id, model, CASE WHEN golden THEN 'INVALID_TASK' ELSE 'VALID' END AS task_status, detected, fp, NOT detected OR (fp AND error IS NULL) AS passed, detected = golden AS correct, error IS NULL AND detected AND fp AS fp_excluded, error FROM (
  SELECT *, CASE WHEN NOT coalesce(applied, true) THEN true WHEN st = 'ERROR' THEN user_id % 3 = 0 ELSE coalesce(st = 'FAIL', false) END AS detected,
    coalesce(st <> 'PASS', false) AND event_id % 2 = 0 AND event_type <> 'error' AND user_id % 3 <> 0 AS fp, CASE WHEN k > 95 THEN 'failed' END AS error FROM ({_REPORTS}))"""


def gate_runs(spark, sf_dir):
    """Events as gate reports: what they detect, whether the structure check alone failed, and runs judged by them."""
    e = table(spark, sf_dir, "events")
    i, user, k = F.col("event_id"), F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    mark = lambda fails: F.when(fails, "FAIL").otherwise("PASS")
    finding = lambda when, name: F.when(when, F.struct(name.alias("id")))
    failures = F.filter(F.array(finding(i % 2 == 0, F.lit("structure-check")), finding(user % 3 == 0, F.concat(F.lit("STALENESS_"), "event_type"))), lambda f: f.isNotNull())
    report = F.struct(
        F.when(k < 40, "PASS").when(k < 80, "FAIL").when(k.isNotNull(), "ERROR").alias("status"),
        F.create_map(F.lit("structure-check"), mark(i % 2 == 0), F.lit("ast-analysis"), mark(F.col("event_type") == "error")).alias("summary"), failures.alias("failures"),
    )
    rows = e.select("event_id", F.concat(F.lit("m"), (user % 10).cast("string")).alias("model"), report.alias("report"), F.when(i % 13 != 0, i % 11 != 0).alias("applied"), (user % 7 == 0).alias("golden"), F.when(k > 95, "failed").alias("error"))
    found = rows.withColumn("detected", scoring.detected(F.col("report"), F.col("applied"))).withColumn("fp", scoring.false_positive(F.col("report")))
    judged = scoring.outcome(found.withColumn("llm_result", F.struct("detected")).withColumn("golden_result", F.struct(F.col("golden").alias("detected"))))
    return metrics.exclude_false_positives(judged.withColumn("task_status", scoring.task_status(F.col("golden"))), F.col("fp"))


@query("q60_gate_runs", _GATES)
def gates(spark, sf_dir):
    return gate_runs(spark, sf_dir).select("event_id", "model", "task_status", "detected", "fp", "passed", "correct", "fp_excluded", "error")


_RATE = "round(coalesce(100.0::DOUBLE * {} / nullif({}, 0), 0), 1)"


@query("q61_gate_counters", f"""
WITH c AS (SELECT model, count(*) AS total, count(error) AS errors, count(*) FILTER (error IS NULL AND passed) AS passed, count(*) FILTER (error IS NULL AND NOT passed) AS failed, count(*) FILTER (error IS NULL AND correct) AS correct, count(*) FILTER (fp_excluded) AS false_positives_excluded FROM ({_GATES}) GROUP BY model)
SELECT *, total - errors AS completed, {_RATE.format('passed', 'total - errors')} AS pass_rate, {_RATE.format('failed', 'total - errors')} AS drift_detection_rate, {_RATE.format('correct', 'total - errors')} AS accuracy, {_RATE.format('errors', 'total')} AS error_rate FROM c""")
def gate_counters(spark, sf_dir):
    return metrics.counters(gate_runs(spark, sf_dir), ["model"])


@query("q62_reply_metrics", """
SELECT concat('m', doc_id % 3) AS model, scenario_id, lang AS category, repository, says AS has_drift, CASE WHEN parsed THEN (n_chars % 100) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN parsed THEN 'logic_drift' END AS drift_type,
  CASE WHEN parsed THEN source ELSE '(parse error)' END AS explanation, says = truth AS correct FROM (
  SELECT *, concat('t', doc_id, CASE WHEN doc_id % 4 = 0 THEN '::' ELSE '..' END, which) AS scenario_id, CASE WHEN doc_id % 4 = 0 THEN 'org/late' ELSE concat('org/', source) END AS repository, CASE WHEN parsed THEN doc_id % 2 = 1 ELSE NOT truth END AS says
  FROM (SELECT *, CASE WHEN doc_id % 3 = 1 THEN 'golden' ELSE 'c1' END AS which, doc_id % 3 <> 1 AS truth, doc_id % 9 <> 0 AS parsed FROM documents WHERE doc_id % 10 <> 0))""")
def reply_metrics(spark, sf_dir):
    """A reply for each document's scenario, some without JSON, some for no scenario; scenarios whose cleaned ids collide."""
    made = scenarios.expand(tasks(spark, sf_dir))
    renamed = lambda df, sep: df.withColumn("scenario_id", F.replace("scenario_id", F.lit("__"), F.lit(sep)))
    late = made.filter(F.substring("task_id", 2, 18).cast("long") % 4 == 0).withColumn("repository", F.lit("org/late"))
    known = renamed(made, "..").unionByName(renamed(late, "::"))
    i = F.col("doc_id")
    target = F.concat(F.lit("t"), i.cast("string"), F.lit("__"), F.when(i % 3 == 1, "golden").otherwise("c1"))
    body = F.to_json(F.struct((i % 2 == 1).alias("has_drift"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"), F.lit("logic_drift").alias("drift_type"), F.col("source").alias("explanation")))
    replies = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.when(i % 10 == 0, F.concat(F.lit("lost"), i.cast("string"))).otherwise(dashed_id(F.replace(target, F.lit("__"), F.lit("..")))).alias("custom_id"), F.when(i % 9 == 0, "no JSON here").otherwise(body).alias("text")
    )
    return scoring.predictions(replies, known).drop("raw_response")


_PATCHES = """SELECT doc_id, 'golden' AS which, '' AS drift_type, text AS patch FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'c1', 'logic_drift', CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN concat('--- a/', source) ELSE source END FROM documents UNION ALL SELECT doc_id, 'c2', 'staleness', concat('+++ b/', lang) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0"""


def _patches(spark, sf_dir):
    """Patches of documents: the text for the golden one, where there is one; an empty one for some candidates."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = lambda name: F.concat(F.lit("p/"), i.cast("string"), F.lit(f"/{name}.patch")).alias("path")
    first = F.when(i % 5 == 0, "").when(i % 2 == 0, F.concat(F.lit("--- a/"), "source")).otherwise(F.col("source"))
    golden, one, two = d.filter(i % 7 != 0).select(path("gold"), F.col("text").alias("content")), d.select(path("c1"), first.alias("content")), d.filter((i % 3 == 0) & (i % 2 == 0)).select(path("c2"), F.concat(F.lit("+++ b/"), "lang").alias("content"))
    return golden.unionByName(one).unionByName(two)


@query("q63_evaluation_rows", f"SELECT concat('t', doc_id, '__', which) AS scenario_id, drift_type, length(patch)::INTEGER AS patch_chars, contains(patch, '--- ') OR contains(patch, '+++ ') AS is_patch FROM ({_PATCHES}) WHERE length(patch) > 0")
def evaluation_rows(spark, sf_dir):
    made = scenarios.evaluation_rows(scenarios.expand(tasks(spark, sf_dir)), _patches(spark, sf_dir))
    return made.select("scenario_id", "drift_type", F.length("patch").alias("patch_chars"), has_diff(F.col("patch")).alias("is_patch"))


@query("q64_golden_and_drift", f"SELECT count(*) FILTER (which = 'golden') AS golden, count(*) FILTER (which <> 'golden') AS drift, count(*) AS total FROM ({_PATCHES})")
def golden_and_drift(spark, sf_dir):
    return scenarios.golden_and_drift(scenarios.with_patches(scenarios.expand(tasks(spark, sf_dir)), _patches(spark, sf_dir)))


_SCAN = """SELECT doc_id AS seq, source AS repo, lang AS category, quality AS verified, toxic, ['Weak evidence', 'Below Confidence Floor', 'Batch_Mode: skipped', '', NULL, 'Path not found'][1 + doc_id % 6] AS notes FROM labels JOIN documents USING (doc_id)"""
_TRIED = f"""SELECT *, verified = 0 AND notes <> '' AND NOT contains(lower(notes), 'confidence floor') AND NOT contains(lower(notes), 'batch_mode') AS fine FROM ({_SCAN})"""
_LOG = f"""WITH t AS (SELECT *, fine AND row_number() OVER (PARTITION BY repo, coalesce(fine, false) ORDER BY seq) <= 50 AS again FROM ({_TRIED})),
c AS (SELECT repo, count(*) FILTER (verified = 1) AS v1, count(*) FILTER (verified = 0) AS d1, count(*) FILTER (again AND toxic = 0) AS v2, count(*) FILTER (again AND toxic = 1) AS d2 FROM t GROUP BY repo)
SELECT *, v1 + v2 AS verified_count, d1 - v2 + d2 AS dropped_count FROM c"""


def _scan(spark, sf_dir):
    """Labelled documents as findings of a scan: repository by source, notes by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    notes = F.get(F.array(*map(F.lit, ["Weak evidence", "Below Confidence Floor", "Batch_Mode: skipped", "", None, "Path not found"])), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("seq"), F.col("source").alias("repo"), F.col("lang").alias("category"), F.col("quality").alias("verified"), "toxic", notes.alias("verification_notes"))


def scan_log(spark, sf_dir):
    rows = _scan(spark, sf_dir)
    counts = rows.groupBy("repo").agg(F.count_if(F.col("verified") == 1).alias("v1"), F.count_if(F.col("verified") == 0).alias("d1"))
    second = training.retryable(rows).groupBy("repo").agg(F.count_if(F.col("toxic") == 0).alias("v2"), F.count_if(F.col("toxic") == 1).alias("d2"))
    return training.scan_totals(counts.join(second, "repo", "left").na.fill(0, ["v2", "d2"]))


@query("q65_scan_log", _LOG)
def scans(spark, sf_dir):
    """Totals of each repository's scan with its second tries, the first fifty of each."""
    return scan_log(spark, sf_dir)


@query("q66_run_summary", f"SELECT sum(verified_count)::BIGINT AS verified, sum(dropped_count)::BIGINT AS dropped, count(DISTINCT repo) AS repos FROM ({_LOG})")
def run_summary(spark, sf_dir):
    return training.run_summary(scan_log(spark, sf_dir))


@query("q67_batch_retries", f"SELECT seq, repo, notes AS verification_notes FROM ({_SCAN}) WHERE verified = 0 AND notes <> '' AND NOT contains(lower(notes), 'confidence floor') ORDER BY seq LIMIT 50")
def batch_retries(spark, sf_dir):
    """Findings that a batch tries again: the first fifty of all, those of batch mode among them."""
    return training.retryable(_scan(spark, sf_dir), batch=True).select("seq", "repo", "verification_notes")


_DAY = "(SELECT strftime(max(ts), '%Y-%m-%d') FROM events)"


@query("q68_history_entry", f"""
WITH s AS (SELECT category, count(*) FILTER (verified = 1) AS v, count(*) FILTER (verified = 0) AS d FROM ({_SCAN}) GROUP BY category)
SELECT (SELECT count(DISTINCT repo) FROM ({_SCAN})) AS run_number, {_DAY} AS date, (SELECT sum(v) FROM s)::BIGINT AS total_verified, (SELECT sum(d) FROM s)::BIGINT AS total_dropped, category, v AS verified, d AS dropped, {_RATE.format('v', 'v + d')} AS rate FROM s""")
def history_entry(spark, sf_dir):
    """The history row of a run, a row for each of its categories."""
    rows = _scan(spark, sf_dir)
    parts = training.split_rows(rows.withColumn("verification_notes", F.coalesce("verification_notes", F.lit(""))))
    latest = table(spark, sf_dir, "events").agg(formats.utc_day(F.max("ts")).alias("date"))
    number = rows.agg(F.countDistinct("repo").alias("run_number"))
    entry = training.run_entry(training.category_stats(parts).crossJoin(latest).crossJoin(number), F.max("run_number"), F.max("date"))
    return entry.select("run_number", "date", "total_verified", "total_dropped", F.explode("categories").alias("category", "e")).select("run_number", "date", "total_verified", "total_dropped", "category", "e.verified", "e.dropped", "e.rate")


@query("q69_signals", """
WITH c AS (SELECT l_suppkey, array_to_string(list_sort(list(concat('tool', l_partkey % 4))), ',') AS marks, max(l_discount) > 0.09 AS cursor FROM lineitem GROUP BY l_suppkey),
m AS (SELECT l_suppkey, array_to_string(list_sort(list(concat('tool', l_partkey % 4))), ',') AS marks FROM lineitem WHERE l_quantity = 50 GROUP BY l_suppkey)
SELECT concat('own/', s_suppkey) AS repo, m.marks, s_nationkey % 3 = 0 AS has_topic_match, coalesce(c.cursor, false) AS has_cursorrules FROM supplier LEFT JOIN c ON c.l_suppkey = s_suppkey LEFT JOIN m ON m.l_suppkey = s_suppkey""")
def signals(spark, sf_dir):
    """Suppliers as repositories with the signals of three sources."""
    s, l = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    repo = lambda c: F.concat(F.lit("own/"), F.col(c).cast("string")).alias("repo")
    marks = l.filter(F.col("l_quantity") == 50).select(repo("l_suppkey"), F.concat(F.lit("tool"), (F.col("l_partkey") % 4).cast("string")).alias("signal"))
    made = discovery.with_signals(s.select(repo("s_suppkey")), marks, s.filter(F.col("s_nationkey") % 3 == 0).select(repo("s_suppkey")), l.filter(F.col("l_discount") > 0.09).select(repo("l_suppkey")))
    return made.select("repo", F.array_join("coauthor_signals", ",").alias("marks"), "has_topic_match", "has_cursorrules")


@query("q70_training_list", """
WITH l AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0)
SELECT concat('own/', k) AS repo, k::INTEGER AS ord FROM l UNION ALL SELECT concat('own/', s_suppkey), ((SELECT max(k) FROM l) + row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey))::INTEGER FROM supplier WHERE s_suppkey % 2 = 1""")
def training_list(spark, sf_dir):
    """A list of repositories, and those that a search finds beside them, richest first."""
    s = table(spark, sf_dir, "supplier").withColumn("repo", F.concat(F.lit("own/"), F.col("s_suppkey").cast("string")))
    listed = s.filter(F.col("s_suppkey") % 2 == 0).select("repo", F.col("s_suppkey").cast("int").alias("ord"))
    found = s.select("repo", F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey").alias("ord"))
    return discovery.add_new(listed, found)


_MODELS = """SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ['openai', 'anthropic', 'GOOGLE', 'deepseek', 'mistral'][1 + c_custkey % 5] END AS p, ['gpt', 'claude', 'gemini', 'chat', 'large'][1 + c_custkey % 5] AS family, c_custkey % 50 AS k, lower(c_mktsegment) AS seg FROM customer"""


@query("q71_model_names", f"""
SELECT model, coalesce(upper(p[1]) || lower(p[2:]), 'Unknown') AS provider, CASE WHEN k % 4 = 1 THEN concat('Model ', k) ELSE concat(upper(family[1]), family[2:], ' ', k, ' ', upper(seg[1]), seg[2:]) END AS display_name,
  CASE WHEN family = 'chat' THEN CASE WHEN p IS NULL THEN 'litellm' ELSE 'deepseek' END ELSE CASE family WHEN 'gpt' THEN 'openai' WHEN 'claude' THEN 'anthropic' WHEN 'gemini' THEN 'google' ELSE 'litellm' END END AS route
FROM (SELECT *, concat(p || '/', family, '-', k, '-', seg) AS model FROM ({_MODELS}))""")
def model_names(spark, sf_dir):
    """Models of customers: providers, display names (from a registry that knows some, some by an empty name) and who is called."""
    c = F.col("c_custkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (c % 5).cast("int"))
    tail = F.concat(pick(["gpt", "claude", "gemini", "chat", "large"]), F.lit("-"), (c % 50).cast("string"), F.lit("-"), F.lower("c_mktsegment"))
    provider = F.concat(pick(["openai", "anthropic", "GOOGLE", "deepseek", "mistral"]), F.lit("/"))
    models = table(spark, sf_dir, "customer").select(F.when(c % 7 == 0, tail).otherwise(F.concat(provider, tail)).alias("model"), (c % 50).alias("k")).distinct()
    registry = models.filter(F.col("k") % 4 < 2).select("model", F.when(F.col("k") % 4 == 1, F.concat(F.lit("Model "), F.col("k").cast("string"))).otherwise("").alias("display_name"))
    return metrics.model_names(models.select("model"), registry).withColumn("route", metrics.route(F.col("model")))


@query("q72_user_times", """
WITH u AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, (epoch_us(b) - epoch_us(a)) // 1000 AS duration_ms, concat(strftime(a, '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(a) % 1000000 <> 0 THEN strftime(a, '.%f') ELSE '' END, '+00:00') AS started, concat(strftime(date_trunc('second', b), '%Y-%m-%dT%H:%M:%S'), '+00:00') AS ended,
  strftime(b, '%Y-%m-%d') AS day, strftime(b::DATE - 90, '%Y-%m-%d') AS since, CASE WHEN n % 7 <> 0 THEN 60.0::DOUBLE / (n % 7) + 0.5::DOUBLE ELSE CAST([6.5, 2.0, 1.0, 0.5][1 + user_id % 4] AS DOUBLE) END AS delay,
  greatest(1, floor((greatest(1, n // 8) * 3) * 0.1::DOUBLE))::INTEGER AS warmup, left(sha256(concat('{"user_id":', user_id, ',"n":', n, '}')), 16) AS hash FROM u""")
def user_times(spark, sf_dir):
    """Each user's time from first to last event, and what rates, training steps and hashes follow from their number."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"), F.count("*").alias("n"))
    provider = F.get(F.array(*map(F.lit, [*metrics.DEFAULT_DELAYS, "other"])), (F.col("user_id") % 4).cast("int"))
    return u.select(
        "user_id", metrics.duration_ms(F.col("a"), F.col("b")).alias("duration_ms"), formats.iso_utc(F.col("a")).alias("started"), formats.iso_utc(F.date_trunc("second", "b")).alias("ended"), formats.utc_day(F.col("b")).alias("day"), discovery.since(F.col("b")).alias("since"),
        metrics.delay_seconds(F.col("n") % 7, provider).alias("delay"), metrics.warmup_steps(F.col("n"), 2, 4, 3).alias("warmup"), training.content_hash(F.struct("user_id", "n")).alias("hash"),
    )

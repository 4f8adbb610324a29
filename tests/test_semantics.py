"""Definitions that are easily got wrong, on rows worked out by hand."""

import json

from pyspark.sql import functions as F

from quillgrid.operators import batches, discovery, metrics, ranges, scenarios, training
from quillgrid.sources import readers, sinks


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_cap_counts_accepted_files(spark):
    rows = [("r", f"a{k:03}.py", "x = 1\n") for k in range(5)] + [("r", f"b{k:03}.py", "1\n" * 6) for k in range(4)] + [("r", "c.py", "1\n" * 30_000), ("r", "vendor/d.py", "1\n" * 6), ("r", "e.txt", "1\n" * 6)]
    got = readers.source_files(spark.createDataFrame(rows, "repo string, path string, content string"), most=3).orderBy("ord").collect()
    assert [(r.ord, r.path) for r in got] == [(0, "b000.py"), (1, "b001.py"), (2, "b002.py")]


def test_context_files(spark):
    skipped = [".git/a", ".hidden/a.py", "x/node_modules/a.js", "dist/a.js", "a.png", "poetry.lock", "package-lock.json", "x-lock.json", "a.woff"]
    taken = [".env", "src/.eslintrc", "vendor/a.py", "coverage/a.py", "env/a.py", "a.woff2", "a.gz", "b.pyc"]
    rows = spark.createDataFrame([("r", p, "x") for p in skipped + taken], "repo string, path string, content string")
    assert sorted(values(readers.context_files(rows), "path")) == sorted(taken)
    # An entry has 16 characters beside a content of 4000: 5 + 6 + 5 with its line's end ("--- a00.py ---\n...\n").
    long = spark.createDataFrame([("r", f"a{k:02}.py", "x" * 5000) for k in range(30)], "repo string, path string, content string")
    assert readers.context_files(long).count() == 20 and readers.context_files(long, stop=3 * 4016).count() == 3 and readers.context_files(long, stop=3 * 4016 + 1).count() == 4
    assert set(values(readers.context_files(long), F.length("content"))) == {4000}


def test_valid_tasks(spark):
    good = ("t", "logic_drift", "n", "o/r", "i", "s", "g.patch", "c", [("c1", "p", "logic", "FAIL", None)])
    bad = [good[:1] + ("odd",) + good[2:], good[:4] + (None,) + good[5:], good[:8] + ([("c1", "p", "logic", "MAYBE", None)],), good[:8] + ([("c1", None, "logic", "PASS", None)],), good[:8] + (None,)]
    kinds = "id string, category string, name string, repository string, intent string, base_sha string, golden_patch string, rigour_config string, drift_candidates array<struct<id: string, patch: string, drift_type: string, expected_result: string, fail_gate: string>>"
    assert readers.valid_tasks(spark.createDataFrame([good, *bad], kinds)).collect() == spark.createDataFrame([good], kinds).collect()


def test_results_of_one_task_are_written_alone(spark, tmp_path):
    rows = spark.createDataFrame([("m", "t1", 1), ("m", "t2", 1), ("n", "t1", 1)], "model_slug string, task_id string, v int")
    sinks.write_results(rows, str(tmp_path / "r"))
    sinks.write_results(spark.createDataFrame([("m", "t1", 2)], "model_slug string, task_id string, v int"), str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert sorted((r.model_slug, r.task_id, r.v) for r in got.collect()) == [("m", "t1", 2), ("m", "t2", 1), ("n", "t1", 1)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3)], "k int, v string, seq int")
    got = sinks.upsert(old, new, ["k"], "seq").collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "z"), (1, "y"), (3, "c")]


def test_language_and_status(spark):
    rows = spark.createDataFrame([("lodash",), ("flask",), ("own",)], "repository string")
    known = spark.createDataFrame([("lodash", "javascript"), ("flask", "python")], "repo string, language string")
    assert sorted(values(metrics.with_language(rows, known), "language")) == ["javascript", "python", "unknown"]
    assert values(spark.range(19, 21).select(metrics.run_status(F.col("id")).alias("s")), "s") == ["partial", "verified"]


def local_row(model, accuracy, completed):
    return (model, model.replace("/", "_"), model, "A", 1.0, 2.0, 0.0, accuracy, completed, completed, 0.1, 7, 1, 0.5, {}, "verified", "local")


def test_merge_and_rank(spark):
    kinds = f"model string, slug string, display_name string, provider string, pass_rate double, drift_detection_rate double, error_rate double, accuracy double, tasks_run long, tasks_completed long, calibration_ece double, overconfident_errors long, underconfident_correct long, avg_confidence double, by_category {metrics.COUNTS}, status string, source string"
    local = spark.createDataFrame([local_row("a/x", 50.0, 30), local_row("a/y", 50.0, 40)], kinds)
    batch = spark.createDataFrame(
        [("a/x", None, "a", 0.9, 25, None, 3, 2, None, {"c": (1, 4)}), ("b/z", None, "dEEP", 0.61239, 19, 0.25, None, None, 0.7, {"c": (3, 4)}), ("b/w", "W", None, None, None, None, None, None, None, None)],
        "model string, display_name string, provider string, overall_accuracy double, scenarios_evaluated long, calibration_ece double, overconfident_errors long, underconfident_correct long, avg_confidence double, by_category map<string, struct<correct: bigint, total: bigint>>",
    )
    got = {r.model: r for r in metrics.merge_leaderboards(local, batch).collect()}
    assert [m for m, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == ["b/z", "a/y", "a/x", "b/w"]
    x, z, w = got["a/x"], got["b/z"], got["b/w"]
    assert (x.accuracy, x.calibration_ece, x.overconfident_errors, x.underconfident_correct, x.source, x.by_category) == (50.0, 0.1, 3, 1, "local", {}) and x.by_category_batch["c"].total == 4
    assert (z.slug, z.display_name, z.provider, z.accuracy, z.pass_rate, z.tasks_completed, z.status, z.source, z.overconfident_errors) == ("b_z", "b/z", "Deep", 61.2, 0.0, 19, "partial", "batch", 0)
    assert tuple(z.by_category["c"]) == (3, 1, 4)
    assert (w.provider, w.display_name, w.accuracy, w.tasks_run, w.by_category) == ("Unknown", "W", 0.0, 0, {})


def test_quota_of_one_track_or_few(spark):
    rows = spark.createDataFrame([(f"a{k}", "ai", 90 - k) for k in range(8)] + [("e0", "ent", 10)], "repo string, track string, score int")
    assert "e0" in values(discovery.quota(rows, 5), "repo") and "e0" not in values(discovery.quota(rows, 5, track="ai"), "repo")
    few = rows.filter("score > 87 OR track = 'ent'")
    assert values(discovery.quota(few, 3), "repo") == ["a0", "a1", "a2"]


def test_prompts(spark):
    row = spark.createDataFrame([("keep it", "--- a\n+++ b")], "intent string, patch string")
    assert values(row.select(batches.detection_prompt(F.col("intent"), F.col("patch")).alias("p")), "p") == ["## Code Review Task\n\n**Intent:**\nkeep it\n\n**Patch:**\n```diff\n--- a\n+++ b\n```\n\nDoes this patch introduce code drift? Respond with JSON only."]
    kinds = "repository string, intent string, category string, name string, drift_candidates array<struct<drift_type: string>>"
    tasks = spark.createDataFrame([("o/r", "i", "c", None, [("logic",), ("other",)]), ("o/r", "i", "c", "n", [])], kinds)
    first, none = values(tasks.select(batches.evaluation_prompt(tasks).alias("p")), "p")
    assert none == "" and "Repository: o/r\nIntent: i\nCategory being tested: c\nChange name: \n\nA drift candidate has been identified with type: logic\n\n" in first and first.endswith('{"is_drift": true/false, "confidence": 0.0-1.0, "category": "..."}')
    again = values(spark.range(1).select(batches.retry_prompt(F.lit('{"a": 1}'), F.lit("too small"), F.lit("FILE: x")).alias("p")), "p")[0]
    assert again.startswith("Your previous finding was REJECTED by structural verification.\n\nREJECTION REASON: too small\n\nYOUR REJECTED FINDING:\n{\"a\": 1}\n\nORIGINAL AST FACTS:\nFILE: x\n\nPlease produce")


def test_plan_filter_and_preview(spark):
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    tasks = spark.createDataFrame([(f"t{k}",) for k in range(7)], "id string")
    assert scenarios.run_plan(models, tasks).count() == 14 and scenarios.run_plan(models, tasks, model="m2").count() == 7 and scenarios.run_plan(models, tasks, "m2", "t3").count() == 1
    got = scenarios.preview(models, tasks).collect()
    assert {(r.model, tuple(r.first_tasks), r.more, r.total_runs) for r in got} == {(m, ("t0", "t1", "t2", "t3", "t4"), 2, 14) for m in ("m1", "m2")}


def test_small_formulas(spark):
    one = lambda c: values(spark.range(1).select(c.alias("x")), "x")[0]
    none = F.lit(None).cast("int")
    assert one(metrics.delay_seconds(F.lit(30))) == 2.5 and one(metrics.delay_seconds(none, F.lit("gemini"))) == 6.5 and one(metrics.delay_seconds(none, F.lit("else"))) == 0.5 and one(metrics.delay_seconds(F.lit(0), F.lit("groq"))) == 2.0
    assert [one(metrics.warmup_steps(F.lit(n), 4, 4, 3)) for n in (0, 10, 640)] == [1, 1, 12]
    assert one(discovery.since(F.to_timestamp(F.lit("2024-03-01 10:00:00")), 90)) == "2023-12-02"
    t = lambda s: F.to_timestamp(F.lit(s))
    assert one(metrics.duration_ms(t("2024-01-01 00:00:00.0004"), t("2024-01-01 00:00:01.9999"))) == 1999


def test_report(spark):
    rows = spark.createDataFrame([("t1", "logic", True), ("t1", "stale", False), ("t2", "logic", True)], "task_id string, category string, detected boolean")
    report = sinks.detection_document(rows, "R").first().report
    assert report == (
        "# R\n\n## Global Metrics\n\n- **Total Tasks Evaluated**: 2\n- **Total Candidates/Variations**: 3\n- **Global DDR (Drift Detection Rate)**: **66.7%**\n- **FPR (False Positive Rate)**: **0.0%** (Enforced by Golden Patch validation)\n\n"
        "## Category Performance\n\n| Category | Detected | Total | DDR |\n| :--- | :--- | :--- | :--- |\n| logic | 2 | 2 | 100.0% |\n| stale | 0 | 1 | 0.0% |\n\n## Task Breakdown\n\n| Task ID | Detected/Total | DDR |\n| :--- | :--- | :--- |\n| t1 | 1/2 | 50.0% |\n| t2 | 1/1 | 100.0% |\n"
    )
    assert sinks.detection_document(rows.limit(0)).first().report.count("0.0%") == 2


def test_numbers_by_ranges(spark):
    rows = spark.createDataFrame([(k % 3 if k % 5 else None, k * 7 % 101) for k in range(100)], "g int, k int").repartition(7)
    got = ranges.numbered(rows, ["k"], "n", ["g"]).collect()
    for g in (0, 1, 2, None):
        mine = sorted((r.k, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert len(got) == 100 and ranges.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_budget_of_a_large_group(spark):
    rows = spark.range(5000).withColumn("g", F.lit("a"))
    for keep_last, want in ((True, 11), (False, 10)):
        got = training.budget_prefix(rows, ["g"], ["id"], F.lit(10), 100, keep_last)
        assert sorted(values(got, "id")) == list(range(want)) and sorted(values(got, "chars_before")) == [10 * k for k in range(want)]


def test_python_agrees_on_json(spark):
    from quillgrid.functions.text import json_text

    text = 'a"\\ é 😀\n'
    got = values(spark.createDataFrame([(text,)], "t string").select(json_text(t=F.col("t"), n=F.lit(1)).alias("x")), "x")[0]
    assert got == json.dumps({"t": text, "n": 1})

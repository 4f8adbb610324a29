"""Operators on small tables with rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import discovery, facts, metrics, scoring, training
from quillgrid.plans import review
from quillgrid.sources import readers, schemas, sinks


SF = "/root/testdata/sf0.001"


def test_skipped_files(spark):
    got = {r.path for r in review.source_files(spark, SF).collect()}
    assert "web/short.js" not in got and "node_modules/skip.js" not in got and "notes.txt" not in got and "app/core.py" in got


def test_calibration(spark):
    rows = spark.createDataFrame([("m", c, k) for c, k in ((0.0, False), (0.05, True), (0.5, True), (0.7, False), (0.8, True), (0.999, True), (1.0, False), (None, True))], "model string, confidence double, correct boolean")
    board = metrics.leaderboard(rows).first()
    bins = {}
    for c, k in ((0.0, 0), (0.05, 1), (0.5, 1), (0.7, 0), (0.8, 1), (0.999, 1), (1.0, 0)):
        bins.setdefault(min(int(c * 10), 9), []).append((c, k))
    mean = sum(len(b) / 7 * abs(sum(k for _, k in b) / len(b) - sum(c for c, _ in b) / len(b)) for b in bins.values())
    mid = sum(len(b) / 7 * abs(sum(k for _, k in b) / len(b) - (n + 0.5) / 10) for n, b in bins.items())
    assert board.ece_mean == pytest.approx(round(mean, 4)) and board.ece_midpoint == pytest.approx(round(mid, 4))
    assert board.overconfident_errors == 1 and board.underconfident_correct == 1 and board["rank"] == 1


def test_breakdown_totals(spark):
    rows = spark.createDataFrame([("a", "x", None, True), ("a", "y", None, False), ("b", "x", "e", None)], "repo string, category string, error string, passed boolean")
    got = {(r.dimension, r.value): (r.passed, r.failed, r.total) for r in metrics.breakdown(rows, ["repo", "category"]).collect()}
    assert got == {("repo", "a"): (1, 1, 2), ("repo", "b"): (0, 0, 1), ("category", "x"): (1, 0, 2), ("category", "y"): (0, 1, 1)}


def test_reports(spark):
    rows = spark.createDataFrame(
        [("fp", ("FAIL", None, {"structure-check": "FAIL", "x": "PASS"}, [("structure-check",)])), ("two", ("FAIL", None, {"structure-check": "FAIL", "x": "FAIL"}, [("structure-check",)])), ("more", ("FAIL", None, {"structure-check": "FAIL"}, [("structure-check",), ("y",)])), ("pass", ("PASS", None, {}, [])), ("stale", ("ERROR", "e", None, [("STALENESS_1",)])), ("error", ("ERROR", "e", None, []))],
        f"name string, report {schemas.REPORT}",
    )
    got = {r.name: (r.fp, r.detected) for r in rows.select("name", scoring.false_positive(F.col("report")).alias("fp"), scoring.detected(F.col("report"), F.lit(True)).alias("detected")).collect()}
    assert got == {"fp": (True, True), "two": (False, True), "more": (False, True), "pass": (False, False), "stale": (False, True), "error": (False, False)}


def test_evaluate_candidates(spark):
    rows = spark.createDataFrame([("a", False, [("c1", "FAIL", True, "g", {"g": "FAIL"}), ("c2", "FAIL", True, "g", {"g": "PASS"}), ("c3", "PASS", False, None, {})]), ("b", True, [("c1", "FAIL", True, None, {})])], "task_id string, golden_detected boolean, candidates array<struct<id: string, expected_result: string, detected: boolean, fail_gate: string, summary: map<string, string>>>")
    got = {(r.task_id, r.candidate_id): (r.status, r.correct) for r in scoring.evaluate_candidates(rows).collect()}
    assert got[("a", "c1")] == ("VALID", True) and got[("a", "c2")] == ("VALID", False) and got[("a", "c3")] == ("VALID", True) and got[("b", None)][0] == "INVALID_TASK"


def test_predictions(spark):
    responses = spark.createDataFrame([("m", "a-1", "ok", '{"has_drift": true}'), ("m", "a-2", "ok", "?"), ("m", "zzz", "ok", "{}")], schemas.RESPONSE)
    scenarios = spark.createDataFrame([("a/1", True, "c", "r"), ("a/2", False, "c", "r")], "scenario_id string, has_drift boolean, category string, repository string")
    got = {r.scenario_id: (r.has_drift, r.confidence, r.correct) for r in scoring.predictions(responses, scenarios).collect()}
    assert got == {"a/1": (True, 0.5, True), "a/2": (True, 0.0, False)}


def test_first_wins_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, "x")], "seq int, a string, b string")
    assert sorted(r.seq for r in sinks.first_wins(rows, ["a", "b"], "seq").collect()) == [1, 3, 4]
    assert sorted(r.seq for r in sinks.last_wins(rows, ["a", "b"], "seq").collect()) == [2, 4]


TRAIN = [
    (1, "c1", 1, "ok", "p"), (2, "c1", 0, "bad", "p"), (3, "c1", 0, "bad", None), (4, "c2", 1, "pass2:verified_retry|x", "p"), (5, "c2", 0, "no", ""), (6, "c3", 1, None, "p"), (7, "c4", 0, "x", "p"),
]


def training_rows(spark):
    rows = spark.createDataFrame(TRAIN, "id long, category string, verified int, verification_notes string, facts_prompt string")
    return rows.withColumns({"repo": F.lit("r"), "file_path": F.concat(F.lit("f"), "id"), "facts_hash": F.lit(""), "severity": F.lit("low"), "description": F.lit('say "x"'), "suggestion": F.lit(None).cast("string"), "confidence": F.lit(0.5)})


def test_pairs(spark):
    got = {(r.dropped_id, r.chosen_id): r for r in training.dpo_pairs(training_rows(spark)).collect()}
    assert set(got) == {(2, 1), (3, 1), (5, 4)}
    assert got[(2, 1)].weight is None and got[(5, 4)].weight == 0.6
    assert "FILE: f3 (repo: r)" in got[(3, 1)].prompt and json.loads(got[(2, 1)].chosen)["description"] == 'say "x"'
    assert training.dpo_pairs(training_rows(spark), most=2).count() == 2


def test_sft_groups(spark):
    split = training.split_rows(training_rows(spark)).filter("part IN ('verified', 'retry')")
    groups = training.sft_groups(split).collect()
    assert [g.n_findings for g in groups] == [2] and len(json.loads(groups[0].reply)["findings"]) == 2
    said = training.sft_messages(training.sft_groups(split), "sys").first().messages
    assert [m.role for m in said] == ["system", "user", "assistant"]


def test_micro_batches(spark):
    for n, kept in ((0, 0), (1, 1), (14, 14), (15, 15), (29, 15), (30, 30), (201, 195)):
        rows = spark.range(n).withColumn("repo", F.lit("r"))
        assert training.micro_batches(rows, ["repo"], ["id"], keep_rest=False).count() == kept
        assert training.micro_batches(rows, ["repo"], ["id"]).count() == n


def test_quota(spark):
    rows = spark.createDataFrame([(f"a{k}", "ai", 90 - k) for k in range(8)] + [(f"e{k}", "ent", 50 - k) for k in range(8)], "repo string, track string, score int")
    got = [r.repo for r in discovery.quota(rows, 5).collect()]
    assert len(got) == 5 and sum(r.startswith("e") for r in got) == 2 and got == sorted(got, key=lambda r: (r[0], r))


def test_add_new(spark):
    listed = spark.createDataFrame([("a", 0), ("b", 1)], "repo string, ord int")
    got = discovery.add_new(listed, spark.createDataFrame([("b", 0), ("d", 1), ("c", 2)], "repo string, ord int")).collect()
    assert sorted((r.ord, r.repo) for r in got) == [(0, "a"), (1, "b"), (2, "d"), (3, "c")]


def test_reading_tasks(spark, tmp_path):
    good = {"id": "t1", "category": "c", "name": "n", "repository": "o/r", "intent": "i", "base_sha": "s", "golden_patch": "p/g.patch", "drift_candidates": []}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "one" / "b.json").write_text("{not json")
    (tmp_path / "one" / "c.json").write_text(json.dumps({"task_id": "x", "scenario": {}}))
    (tmp_path / "two" / "deep").mkdir(parents=True)
    (tmp_path / "two" / "deep" / "d.json").write_text(json.dumps(good | {"id": "t2"}))
    assert [r.id for r in readers.read_tasks(spark, str(tmp_path)).collect()] == ["t1"]
    assert sorted(r.id for r in readers.read_tasks(spark, str(tmp_path), recursive=True).collect()) == ["t1", "t2"]
    tasks = readers.read_tasks(spark, str(tmp_path))
    path = tasks.select(readers.resolve_path(F.col("golden_patch"), F.col("source_dir")).alias("p")).first().p
    assert path.endswith(f"{tmp_path.parent.name}/p/g.patch") and readers.find_task(tasks, "t1").count() == 1


def test_registry_and_repo_list(spark):
    text = spark.createDataFrame([('{"a/b": {"mode": "x", "max_tokens": 5, "display_name": "A"}}',), ("nonsense",)], "value string")
    assert [(r.model, r.max_tokens) for r in readers.registry(text).collect()] == [("a/b", 5)]
    for value in ('["o/a", "o/b"]', '[{"name": "o/a"}, {"full_name": "o/b"}]', '{"repos": [{"name": "o/a"}, {"name": "o/b"}]}'):
        got = readers.repo_list(spark.createDataFrame([(value,)], "value string")).orderBy("ord").collect()
        assert [r.repo for r in got] == ["o/a", "o/b"]


def test_batch_responses(spark):
    lines = [{"custom_id": "1", "result": {"type": "succeeded", "message": {"content": [{"text": "a"}]}}}, {"custom_id": "2", "result": {"type": "errored"}}, {"custom_id": "3", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "c"}}]}}}]
    got = {r.custom_id: (r.ok, r.text) for r in readers.batch_responses(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()}
    assert got == {"1": (True, "a"), "2": (False, None), "3": (True, "c")}


def test_context_budget(spark):
    files = spark.createDataFrame([("r", f"f{k:02}.py", "x" * 5000) for k in range(30)] + [("r", ".hidden/a.py", "x"), ("r", "yarn.lock", "x")], "repo string, path string, content string")
    assert readers.context_files(files).count() == 20


def test_reports_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "name string, n int")
    assert sinks.markdown_table(rows, ["name", "n"], ["name"], "T").first().report == "## T\n\n| name | n |\n|---|---|\n| a | 2 |\n| b | 1 |"
    sinks.write_lines(rows.withColumn("w", F.lit(None).cast("string")), str(tmp_path / "l"))
    assert sorted(json.loads(r.value)["w"] is None for r in spark.read.text(str(tmp_path / "l")).collect()) == [True, True]
    assert [r.line for r in sinks.console_rows(rows, {"name": 3, "n": 4}).collect()] == ["b      1", "a      2"]
    assert sinks.append_history(rows.limit(0), spark.range(60).select(F.col("id").cast("string").alias("name"), F.col("id").cast("int").alias("n")), "n").count() == 52


def test_prompt_budget(spark):
    made = facts.prompts(facts.extract(review.source_files(spark, SF)), most=100).first().prompt
    assert made.count("FILE:") == 1 or len(made.split("\n\n")[0]) <= 100


def test_streaming(spark, tmp_path):
    from quillgrid.streaming import ingest

    rows = spark.createDataFrame([(k % 3, k) for k in range(9)], "key int, seq int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"), "key int, seq int")
    q = stream.writeStream.foreachBatch(ingest.upsert_into(str(tmp_path / "state"), ["key"], "seq")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    state = str(tmp_path / "state")
    assert sorted((r.key, r.seq) for r in ingest.read_state(spark, state).collect()) == [(0, 6), (1, 7), (2, 8)]
    merge = ingest.upsert_into(state, ["key"], "seq")
    for number, more in ((1, [(1, 3)]), (2, [(2, 99), (7, 1)]), (2, [(2, 99), (7, 1)]), (3, [(2, 100)]), (4, [(2, 101)])):
        merge(spark.createDataFrame(more, "key int, seq int"), number)
    assert sorted((r.key, r.seq) for r in ingest.read_state(spark, state).collect()) == [(0, 6), (1, 7), (2, 101), (7, 1)]
    assert sorted(ingest.state_folders(spark, state)[4]) == sorted({r.b for r in spark.range(1).selectExpr("CAST(pmod(xxhash64(CAST(2 AS INT)), 64) AS INT) AS b").collect()})


def test_prompts_of_findings(spark):
    from quillgrid.operators import verify

    f = facts.extract(review.source_files(spark, SF))
    rows = verify.with_prompts(review.findings(spark, SF).filter("repo = 'r1'"), f, facts.prompt_lines(f)).orderBy("seq").collect()
    assert rows[0].facts_prompt is None and rows[0].facts_hash is None
    assert rows[1].facts_prompt.startswith("FILE: app/core.py") and rows[2].facts_prompt == rows[1].facts_prompt and len(rows[1].facts_hash) == 16


def test_dataset_card(spark):
    stats = training.category_stats(training.split_rows(training_rows(spark)))
    report = sinks.dataset_card(stats, most=2).first().report
    assert "verified: 2\ndropped: 4\ncategories: 4" in report and report.count("\n| c") == 3

"""Seeded shuffles, leaderboards kept up to date, pairs in blocks, scans of the training table, and plans that keep hot groups apart."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import formats
from quillgrid.operators import incremental, metrics, pairs, permutation, training
from quillgrid.session import ensure_checkpoints
from quillgrid.sources import readers, schemas, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50, 1009])
def test_places_are_a_permutation(spark, n):
    rows = spark.range(n).select(F.col("id"), *(permutation.place(F.col("id"), n, seed).alias(f"s{seed}") for seed in (1, 2))).collect()
    assert sorted(r.s1 for r in rows) == sorted(r.s2 for r in rows) == list(range(n))
    if n > 40:
        assert [r.s1 for r in rows] != [r.s2 for r in rows] and sum(r.s1 == r.id for r in rows) < 8
        near = sum(abs(a.s1 - b.s1) < n / 20 for a, b in zip(rows, rows[1:], strict=False))
        assert near < 0.25 * n  # neighbours don't stay neighbours
    assert spark.range(1).select(permutation.place(F.lit(n), n, 1)).first()[0] is None


def test_shuffle_repeats_itself(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7).alias("v"))
    orders = []
    for n, seed, parts in ((5, 42, 4), (2, 42, 4), (3, 42, 4), (3, 43, 4)):
        made = permutation.shuffled(rows.repartition(n), ["key"], seed, parts)
        assert "rangepartitioning" not in plan(made)
        orders.append([r.key for r in made.collect()])
        assert sorted(orders[-1]) == sorted(r.key for r in rows.collect())
    assert orders[0] == orders[1] == orders[2] != orders[3]
    sizes = [len(p) for p in permutation.shuffled(rows, ["key"], 42, 4).rdd.glom().collect()]
    assert sizes == [750] * 4
    assert permutation.shuffled(rows.limit(0), ["key"]).count() == 0


def test_pairs_come_out_mixed_and_repeat(spark):
    kinds = "id long, category string, repo string, file_path string, facts_prompt string, severity string, description string, suggestion string, confidence double, verified int, verification_notes string"
    rows = spark.createDataFrame([(k, "c", "r", "f", "", "low", "d", "s", 0.5, k % 2, "ok") for k in range(200)], kinds)
    one, two = ([r.dropped_id for r in training.dpo_pairs(rows.repartition(n)).collect()] for n in (2, 5))
    assert one == two != sorted(one) and sorted(one) == list(range(0, 200, 2)) and [r.dropped_id for r in training.dpo_pairs(rows, seed=1).collect()] != one


def test_state_after_overwrites_equals_all_results_again(spark):
    rng = random.Random(8)
    kinds = "model string, task string, run int, confidence double, correct boolean"
    row = lambda run: (f"m{rng.randint(0, 3)}", rng.choice([f"t{rng.randint(0, 25)}", f"t{rng.randint(0, 25)}", None]), run, rng.choice([None, rng.random(), rng.randint(0, 10) / 10]), rng.random() < 0.5)
    ensure_checkpoints(spark)
    results = spark.createDataFrame([], kinds)
    state, kept, loose = incremental.partial(results), {}, []
    for run in range(5):
        batch = [row(run * 100 + k) for k in range(60)]
        results, change = incremental.overwrite(results, spark.createDataFrame(batch, kinds), ["model", "task"], "run")
        results, state = results.checkpoint(), incremental.merged(state, change).checkpoint()
        best = {}
        for r in batch:
            best[r[:2]] = r if r[2] >= best.get(r[:2], r)[2] else best[r[:2]]
        loose += [r for (_, task), r in best.items() if task is None]
        kept |= {k: r for k, r in best.items() if k[1] is not None}
        now = spark.createDataFrame([*kept.values(), *loose], kinds)
        assert sorted(map(tuple, incremental.leaderboard(state).collect())) == sorted(map(tuple, metrics.leaderboard(now).collect()))
    gone = incremental.merged(state, incremental.partial(results, -1))
    assert gone.count() == 0  # taking all away leaves nothing


def test_pairs_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", k) for k in range(90)] + [(f"k{rng.randint(0, 30)}", rng.randint(0, 99)) for _ in range(300)] + [(None, 1), (None, 2), ("hot", None)] * 3
    keys = collections.defaultdict(set)
    for k, i in rows:
        if k is not None and i is not None:
            keys[k].add(i)
    want = collections.Counter((a, b) for items in keys.values() for a in items for b in items if a < b)
    df = spark.createDataFrame(rows, "key string, item long")
    for block in (7, 256):
        made = pairs.shared_pairs(df, "key", "item", block)
        assert {(r.a, r.b): r.shared for r in made.collect()} == want
    assert pairs.shared_pairs(df.limit(0), "key", "item").count() == 0


def test_training_selects(spark, tmp_path):
    rows = [(k, f"c{k % 3}", f"r{k % 2}", v, n) for k, (v, n) in enumerate([(1, "ok"), (1, "PASS2:Verified_retry|x"), (0, "ok"), (0, None), (1, None), (None, "ok"), (1, "pass2:verified-retry"), (0, "pass2:verified_retry")])]
    spark.createDataFrame(rows, "id long, category string, repo string, verified int, verification_notes string").write.parquet(f"{tmp_path}/t")
    scans = readers.training_selects(spark, f"{tmp_path}/t")
    got = {name: [r.id for r in df.collect()] for name, df in scans.items()}
    assert {k: sorted(v) for k, v in got.items()} == {"verified": [0], "retry": [1, 6], "dropped": [2, 3, 7]} and got["dropped"] == [3, 7, 2] and set(scans["dropped"].columns) == {f.split(" ")[0] for f in schemas.TRAINING.split(", ")}
    assert "EqualTo(verified,0)" in scans["dropped"]._jdf.queryExecution().toString()


def test_hot_groups_meet_as_few_rows(spark):
    """Tasks keep the first rows of each group before rows meet."""
    rows = spark.createDataFrame([(None, k, "r") for k in range(100)], "k string, n long, repo string")
    assert plan(sinks.last_wins(rows, ["k"], "n")).count("WindowGroupLimit") == 2 and sinks.last_wins(rows, ["k"], "n").collect()[0].n == 99
    files = rows.select("repo", F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(".py")).alias("path"), F.lit("1\n2\n3\n4\n5").alias("content"))
    assert plan(readers.source_files(files, 10)).count("WindowGroupLimit") == 2
    assert [r.ord for r in readers.source_files(files, 10).orderBy("path").collect()] == list(range(10))


def test_rows_of_the_batch_alone(spark):
    hits = "map<string, struct<correct: long, total: long>>"
    kinds = f"model string, display_name string, provider string, overall_accuracy double, scenarios_evaluated long, calibration_ece double, overconfident_errors long, underconfident_correct long, avg_confidence double, by_category {hits}, by_repository {hits}"
    batch = spark.createDataFrame([("a", None, "x", 0.5, 30, 0.1, 1, 2, 0.5, {"c": (1, 3)}, {"r": (2, 5)}), ("b", None, None, None, None, None, None, None, None, None, None)], kinds)
    local = metrics.batch_entry(batch).filter("model = 'a'").withColumn("source", F.lit("local")).drop("errors", "tasks_total", "false_positives_excluded", "by_repo")
    got = {r.model: r for r in metrics.merge_leaderboards(local, batch, 97).collect()}
    assert (got["a"].tasks_total, got["a"].by_repo, got["a"].source) == (None, None, "local") and got["a"].by_category_batch == {"c": (1, 3)}
    assert (got["b"].tasks_total, got["b"].errors, got["b"].false_positives_excluded, got["b"].by_repo, got["b"].source) == (97, 0, 0, {}, "batch")
    alone = metrics.merge_leaderboards(local.filter("model = 'z'"), batch, 97)
    assert {r.model: r.by_repo for r in alone.collect()} == {"a": {"r": (2, 5)}, "b": {}}


def test_numbers_as_python_prints_them(spark):
    rng = random.Random(1)
    some = [0.25, 0.15, 0.35, 2.5, 1.005, 0.05, 0.5, 1.5, -0.25, -0.04, 0.0, 1e-9, 99.95, 1e11, 0.125, 0.375, float("inf"), float("-inf"), float("nan")] + [rng.uniform(-100, 100) for _ in range(300)] + [rng.randint(0, 4000) / 8 for _ in range(200)] + [rng.randint(0, 4000) / 1000 for _ in range(300)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*some, None])], "k int, x double")
    made = rows.select("k", "x", *(formats.fixed(F.col("x"), d).alias(f"f{d}") for d in range(4)), formats.percent(F.col("x"), 1).alias("p")).orderBy("k").collect()
    for r, x in zip(made, some, strict=False):
        assert ([r[f"f{d}"] for d in range(4)], r.p) == ([f"{x:.{d}f}" for d in range(4)], f"{x:.1%}"), x
    assert made[-1].f1 is None and made[-1].p is None

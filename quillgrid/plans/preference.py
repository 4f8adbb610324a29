"""Preference-data side: labelled documents as findings, and what is built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as t
from quillgrid.operators import discovery, evaluation, training, verify
from quillgrid.operators import pairs as pairs_by
from quillgrid.plans.benchmark import quoted
from quillgrid.plans.registry import query, table
from quillgrid.sources import sinks

FINDINGS_SQL = "SELECT d.doc_id AS id, d.source AS category, d.lang AS teacher, l.quality AS verified, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: category by source, teacher by language, verified by quality, retried by toxicity."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("teacher"), F.col("quality").alias("verified"), "toxic", "n_chars")


_SCORES = f"SELECT teacher, category, count(*) AS total, CAST(sum(CASE WHEN verified = 1 THEN 1 ELSE 0 END) AS BIGINT) AS verified, round(sum(CASE WHEN verified = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 3) AS rate FROM ({FINDINGS_SQL}) GROUP BY ALL"


@query("q20_teacher_scores", _SCORES)
def scores(spark, sf_dir):
    return training.teacher_scores(findings(spark, sf_dir), "teacher")


@query("q21_teacher_means", f"SELECT teacher, round(avg(rate), 3) AS mean_rate, count(*) AS n_categories FROM ({_SCORES}) GROUP BY teacher")
def means(spark, sf_dir):
    return training.teacher_means(training.teacher_scores(findings(spark, sf_dir), "teacher"), "teacher")


def _parts(spark, sf_dir):
    notes = F.when(F.col("toxic") == 1, F.when(F.col("id") % 2 == 0, "PASS2:Verified_retry|x").otherwise("pass2:verified-retry")).when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise("ok")
    return training.split_rows(findings(spark, sf_dir).withColumn("verification_notes", notes))


_PARTS = f"""SELECT *, CASE WHEN verified = 1 AND notes ILIKE 'pass2:verified_retry%' THEN 'retry' WHEN verified = 1 AND NOT (notes ILIKE 'pass2:verified_retry%') THEN 'verified' WHEN verified = 0 THEN 'dropped' END AS part FROM (
  SELECT *, CASE WHEN toxic = 1 THEN CASE WHEN id % 2 = 0 THEN 'PASS2:Verified_retry|x' ELSE 'pass2:verified-retry' END WHEN id % 11 = 0 THEN NULL ELSE 'ok' END AS notes FROM ({FINDINGS_SQL}))"""
_STATS = f"""SELECT category, verified, dropped, verified + dropped AS total, retry_verified, round(coalesce(100.0::DOUBLE * verified / nullif(verified + dropped, 0), 0), 1) AS verification_rate FROM (
  SELECT category, count(*) FILTER (part IN ('verified', 'retry')) AS verified, count(*) FILTER (part = 'dropped') AS dropped, count(*) FILTER (part = 'retry') AS retry_verified FROM ({_PARTS}) GROUP BY category)"""


@query("q22_category_stats", _STATS)
def stats(spark, sf_dir):
    return training.category_stats(_parts(spark, sf_dir))


@query("q23_top_categories", f"SELECT category, total FROM ({_STATS}) ORDER BY total DESC, category LIMIT 10")
def top(spark, sf_dir):
    return training.category_stats(_parts(spark, sf_dir)).select("category", "total").orderBy(F.desc("total"), "category").limit(10)


_PICK = f"""WITH p AS ({_PARTS}), d AS (SELECT category, id AS dropped_id, CAST('0x' || left(md5(id::VARCHAR), 8) AS BIGINT) AS digest FROM p WHERE part = 'dropped'),
w AS (SELECT category, id AS chosen_id, part, row_number() OVER (PARTITION BY part, category ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY part, category) AS n FROM p WHERE part IN ('verified', 'retry')),
pairs AS (SELECT d.category, dropped_id, chosen_id, CASE w.part WHEN 'verified' THEN 1 ELSE 2 END AS try FROM d JOIN w ON d.category = w.category AND d.digest % w.n = w.k)"""


@query("q24_preference_pairs", f"""{_PICK} SELECT category, dropped_id, chosen_id, try, CASE WHEN try = 2 THEN 0.6::DOUBLE END AS weight FROM (SELECT *, row_number() OVER (ORDER BY try, category, dropped_id) AS n FROM pairs) WHERE n <= 10000""")
def pairs(spark, sf_dir):
    rows = _parts(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("f"), F.col("id").cast("string")), "repo": F.col("category"), "facts_prompt": F.lit(""), "severity": F.lit("low"), "description": F.lit("d"), "suggestion": F.lit("s"), "confidence": F.lit(0.5)})
    made = training.dpo_pairs(rows)
    return made.select("category", "dropped_id", "chosen_id", F.when(F.col("weight").isNull(), 1).otherwise(2).alias("try"), "weight")


@query("q25_sft_groups", """WITH f AS (SELECT conv_id, role, turn, text, coalesce(nullif(CASE WHEN conv_id % 3 = 0 THEN concat('facts of ', conv_id) END, ''), CASE WHEN conv_id % 3 = 1 THEN concat('hash', conv_id) END, concat('file', conv_id)) AS batch,
  coalesce(CASE WHEN conv_id % 3 = 0 THEN concat('facts of ', conv_id) END, concat('FILE: file', conv_id, ' (repo: ', role, ')')) AS prompt FROM conversations)
SELECT batch, count(*) AS n_findings, (list(prompt ORDER BY role, turn))[1] AS prompt, concat('{"findings": [', string_agg(concat('{"category": "', role, '", "severity": "low", "file": "file', conv_id, '", "description": "t', turn, '", "suggestion": null, "confidence": 0.5}'), ', ' ORDER BY role, turn), ']}') AS reply FROM f GROUP BY batch""")
def sft(spark, sf_dir):
    """Turns as verified findings of their conversation: category by role, grouped by prompt, hash or file."""
    c = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("turn").cast("long").alias("id"), F.col("role").alias("category"), F.col("role").alias("repo"), F.concat(F.lit("file"), c.cast("string")).alias("file_path"), F.when(c % 3 == 0, F.concat(F.lit("facts of "), c.cast("string"))).otherwise("").alias("facts_prompt"),
        F.when(c % 3 == 1, F.concat(F.lit("hash"), c.cast("string"))).alias("facts_hash"), F.lit("low").alias("severity"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("description"), F.lit(None).cast("string").alias("suggestion"), F.lit(0.5).alias("confidence"),
    )
    return training.sft_groups(rows)


@query("q26_budget_prefix", """SELECT source, doc_id, chars_before FROM (SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents) WHERE chars_before <= 12000""")
def budget(spark, sf_dir):
    return training.budget_prefix(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 12_000).select("source", "doc_id", "chars_before")


_BATCH = "SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 15) AS BIGINT) AS batch, count(*) OVER (PARTITION BY source) AS n FROM documents"


@query("q27_micro_batches", f"SELECT source, doc_id, batch FROM ({_BATCH})")
def batches(spark, sf_dir):
    return training.micro_batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("q28_full_batches", f"SELECT source, doc_id, batch FROM ({_BATCH}) WHERE batch < greatest(1, floor(n / 15))")
def full_batches(spark, sf_dir):
    return training.micro_batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], keep_rest=False)


@query("q29_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first(spark, sf_dir):
    return sinks.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("q30_last_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last(spark, sf_dir):
    return sinks.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("q31_upsert_delete", """WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), new AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT k, v FROM (SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new) WHERE k % 7 <> 0""")
def upsert_delete(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    now = sinks.upsert(old, old.filter("k % 3 = 0").withColumn("v", F.col("v") + 1), ["k"])
    return sinks.delete(now, old.filter("k % 7 = 0"), ["k"])


@query("q32_history", """WITH d AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1), r AS (SELECT strftime(hour, '%Y-%m-%d %H') AS run, n, round(bad::DOUBLE / n, 4) AS rate FROM d)
SELECT run, n, rate, lag(rate) OVER (ORDER BY run) AS previous, round(rate - lag(rate) OVER (ORDER BY run), 4) AS change, coalesce(round(rate - lag(rate) OVER (ORDER BY run), 4) < -0.005, false) AS regressed FROM (SELECT * FROM r ORDER BY run DESC LIMIT 52)""")
def history(spark, sf_dir):
    """Hours as runs: the newest is appended to the history of the others, of which the last 52 stay."""
    e = table(spark, sf_dir, "events")
    hours = e.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("rate"))
    last = hours.agg(F.max("run").alias("last"))
    known = hours.join(F.broadcast(last), F.col("run") < F.col("last")).drop("last")
    new = hours.join(F.broadcast(last), F.col("run") == F.col("last")).drop("last")
    return evaluation.against_previous(sinks.append_history(known, new, "run"), [], [F.col("run")], "rate", 0.005)


_EDGES = "SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem"


@query("q33_shared_pairs", f"WITH e AS ({_EDGES}) SELECT a.supp AS a, b.supp AS b, count(*) AS shared FROM e a JOIN e b ON a.part = b.part AND a.supp < b.supp GROUP BY ALL")
def shared(spark, sf_dir):
    """Pairs of suppliers with how many parts they share."""
    return pairs_by.shared_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("q46_shared_params", """WITH r AS (SELECT *, row_number() OVER () AS k FROM lineitem), l AS (SELECT DISTINCT l_orderkey AS o, k, unnest([concat('t', CAST(round(l_tax * 100) AS INTEGER)), lower(l_returnflag), lower(l_linestatus)]) AS p FROM r), m AS (SELECT a.o, a.k, b.k AS j, count(*) AS n FROM l a JOIN l b ON a.o = b.o AND a.k < b.k AND a.p = b.p GROUP BY ALL)
SELECT o AS l_orderkey, coalesce(max(n), 0) AS shared FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) LEFT JOIN m USING (o) GROUP BY o""")
def shared_params(spark, sf_dir):
    """Orders as files, their lines as functions, whose parameters are the line's codes."""
    f = F.struct(F.col("l_linenumber").alias("k"), F.array(F.concat(F.lit("T"), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(": str")), F.col("l_returnflag"), F.upper("l_linestatus")).alias("params"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(f)).alias("functions"))
    return rows.select("l_orderkey", verify.most_shared_params(F.col("functions")).cast("long").alias("shared"))


@query("q34_set_operations", """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), s AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)
SELECT 'candidates' AS op, k FROM (SELECT k FROM o UNION SELECT k FROM s EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM o INTERSECT SELECT k FROM s)""")
def sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer")
    s, b = (c.filter(x).select(F.col("c_custkey").alias("k")) for x in ("c_mktsegment = 'BUILDING'", "c_acctbal < 0"))
    return discovery.candidates([o, s], [b], "k").select(F.lit("candidates").alias("op"), "k").unionByName(o.intersect(s).select(F.lit("both").alias("op"), "k"))


def repos(spark, sf_dir):
    """Customers as repositories: stars by balance, size by orders."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    k, now = F.col("c_custkey"), F.lit("2024-06-01T00:00:00Z")
    ago = lambda days: F.date_format(F.to_timestamp(now) - F.make_dt_interval(days), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    licenses = F.get(F.array(*map(F.lit, ("MIT", "Apache-2.0", "", "GPL-3.0", "NOASSERTION"))), (k % 5).cast("int"))
    languages = F.get(F.array(*map(F.lit, ("Python", "Go", "C++"))), (k % 3).cast("int"))
    signals = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 7).cast("int"))), lambda i: F.concat(F.lit("tool"), (i % 3).cast("string")))
    return c.join(n, "c_custkey", "left").select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 8, "0")).alias("repo"), F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("int").alias("stars"), licenses.alias("license"), languages.alias("language"),
        (k % 41 == 0).alias("archived"), (k % 43 == 0).alias("fork"), (F.coalesce("n_orders", F.lit(0)) * 300).cast("int").alias("size_kb"), ago((k % 60).cast("int")).alias("pushed_at"), ago((k % 900).cast("int")).alias("created_at"),
        F.array().cast("array<string>").alias("topics"), F.when(k % 7 > 0, signals).alias("coauthor_signals"), (k % 2 == 0).alias("has_cursorrules"), (k % 3 == 0).alias("has_topic_match"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("is_enterprise"),
        (k % 4 < 2).alias("has_ci"), (k % 5 < 2).alias("has_tests"), (k % 30).cast("int").alias("contributors"), (k % 2).cast("int").alias("ai_commit_count"),
    )


_SCORED = """SELECT repo, track, skip_reason, CASE WHEN skip_reason IS NOT NULL THEN 0 ELSE (CASE WHEN k % 7 >= 5 THEN 30 WHEN k % 7 >= 1 THEN 15 ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END) + (CASE WHEN k % 4 < 2 THEN 10 ELSE 0 END)
  + (CASE WHEN k % 5 < 2 THEN 10 ELSE 0 END) + (CASE WHEN k % 30 >= 20 THEN 10 WHEN k % 30 >= 10 THEN 7 WHEN k % 30 >= 5 THEN 4 ELSE 0 END) + (CASE WHEN stars >= 5000 THEN 10 WHEN stars >= 1000 THEN 7 WHEN stars >= 500 THEN 5 ELSE 2 END)
  + (CASE WHEN k % 60 <= 30 THEN 5 ELSE 0 END) + (CASE WHEN k % 900 > 365 THEN 5 ELSE 0 END) + (CASE WHEN k % 3 < 2 THEN 5 ELSE 0 END) + (CASE WHEN track <> 'enterprise' AND k % 2 > 0 THEN 5 ELSE 0 END) END AS score FROM (
  SELECT *, CASE WHEN k % 41 = 0 THEN 'archived' WHEN k % 43 = 0 THEN 'fork' WHEN stars < 200 THEN concat('too_few_stars (', stars, ')') WHEN k % 5 = 3 THEN 'license (gpl-3.0)' WHEN size_kb < 500 THEN concat('too_small (', size_kb, 'KB)') END AS skip_reason FROM (
    SELECT c_custkey AS k, concat('r', lpad(c_custkey::VARCHAR, 8, '0')) AS repo, CAST(floor(greatest(c_acctbal, 0)) AS INTEGER) AS stars, CAST(coalesce(n, 0) * 300 AS INTEGER) AS size_kb, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'enterprise' ELSE 'ai-signal' END AS track
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey))"""


def scored(spark, sf_dir):
    return discovery.score(repos(spark, sf_dir), F.to_timestamp(F.lit("2024-06-01T00:00:00Z")))


@query("q35_repo_scores", _SCORED)
def repo_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("repo", "track", "skip_reason", "score")


@query("q36_outcomes", f"SELECT track, count(*) FILTER (skip_reason IS NULL AND score >= 50) AS qualified, count(*) FILTER (skip_reason IS NOT NULL) AS skipped, count(*) FILTER (skip_reason IS NULL AND score < 50) AS below_threshold FROM ({_SCORED}) GROUP BY track")
def outcomes(spark, sf_dir):
    return discovery.outcome_counts(scored(spark, sf_dir), 50)


@query("q37_quota", f"""WITH q AS (SELECT * FROM ({_SCORED}) WHERE skip_reason IS NULL AND score >= 50), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, repo) <= 8 AS reserved FROM q),
p AS (SELECT *, row_number() OVER (ORDER BY reserved DESC, score DESC, repo) AS place FROM k) SELECT repo, track, score FROM p WHERE place <= 20""")
def quota(spark, sf_dir):
    rows = scored(spark, sf_dir).select("repo", "track", "skip_reason", "score")
    # A repository counts once. The filter stands after the aggregate, lest the optimizer carry the score's many cases along as constraints; skipped ones have score 0.
    return discovery.quota(rows.groupBy("repo", "track").agg(F.max("score").alias("score")).filter("score >= 50"), 20)


_PLAIN = ", ".join(f"'{x}'" for x in t.PLAIN_NUMBERS)
#: Runs of word characters and dots; a number is one that has digits alone, as nothing of these stands beside it.
_NUMBERS = rf"len(list_filter(regexp_extract_all({{0}}, '[\w.]+'), lambda x: regexp_full_match(x, '[0-9]{{{{2,}}}}') AND x NOT IN ({_PLAIN})))"


@query("q38_text_facts", f"""SELECT page_id, len(string_split(html, chr(10))) AS n_lines, CAST(len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS INTEGER) AS links, CAST({_NUMBERS.format("regexp_replace(html, '[^ -~\n\t]', '_', 'g')")} AS INTEGER) AS numbers FROM pages""")
def text_facts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    plain = F.regexp_replace("html", r"[^ -~\n\t]", "_")  # SQL's pattern knows no word characters beyond ASCII
    return p.select("page_id", F.size(F.split("html", "\n", -1)).cast("long").alias("n_lines"), t.count_matches(F.col("html"), 'href="([^"]+)"').alias("links"), t.magic_numbers(plain).alias("numbers"))


@query("q39_longest_entity", """WITH n AS (SELECT list(n_name ORDER BY length(n_name) DESC, n_nationkey) AS names FROM nation), s AS (SELECT s_suppkey, concat('supplier of ', n_name, ' near ', r_name) AS said FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, list_filter(names, lambda x: contains(said, x))[1] AS entity FROM s, n""")
def longest(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    s = table(spark, sf_dir, "supplier").join(n.join(r, n.n_regionkey == r.r_regionkey), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.crossJoin(names).select("s_suppkey", verify.longest_contained(F.col("names"), F.concat(F.lit("supplier of "), "n_name", F.lit(" near "), "r_name")).alias("entity"))


# Text functions on inputs of each kind, with results worked out by hand.
PATCH = "--- src/a§.py\n+++ src/a§.py\n@@ -1 +1 @@\n-x\n+y"


KEY = "§"


def text_cases(key):
    """Name and column. KEY in a text stands for key."""
    lit = lambda x: F.replace(F.lit(x), F.lit(KEY), key)
    patch = lit(PATCH)
    return [
        ("batch_custom_id", t.batch_custom_id(lit("owner/repo§.js"), F.lit(3))),
        ("repo_of_custom_id", t.repo_of_custom_id(lit("owner--my-repo§_b12"))),
        ("repo_of_old_id", t.repo_of_custom_id(lit("owner_my_repo§_b1"))),
        ("dashed_id", t.dashed_id(lit("a/b c.§d"))),
        ("bare_id", t.bare_id(lit("a/b c.§d"))),
        ("bare_id_empty", t.bare_id(lit("///"))),
        ("strip_fences", t.strip_fences(lit('```json\n{"a": "§"}\n```'))),
        ("response_body", t.response_body(lit('  ```\njson {"a": "§"}\n```  '))),
        ("first_object", t.first_object(lit('so {"a": "§"} and {"b": 2}'))),
        ("diff_paths", F.array_join(t.diff_paths(lit("--- a/x§.py\n+++ b/x§.py\n--- /dev/null\n+++ b/y.py")), ",")),
        ("prefixed_paths", t.prefixed_paths(patch)),
        ("extract_fenced", t.extract_patch(lit(f"Here:\n```diff\n{PATCH}\n```\nbye"))),
        ("extract_raw", t.extract_patch(lit("no patch §"))),
        ("added_lines", t.added_lines(lit("--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+one§\n+two"))),
        ("new_file_diff", t.new_file_diff(lit("n"), lit("one§\ntwo"))),
        ("model_of_slug", t.model_of_slug(lit("openai_gpt_§"))),
        ("title_case", t.title_case(lit("claude-opus x§y"))),
        ("repo_short_name", t.repo_short_name(lit("flat"), lit("Lodash-stale-1"), ["flask", "lodash"])),
        ("bump_minor", t.bump(lit("v1.9.3"), lit("minor"))),
        ("task_file_name", t.task_file_name(lit("flask-logic-§"))),
        ("detect_language", t.detect_language(lit("src/App§.TSX"))),
        ("detect_unknown", t.detect_language(lit("dir/.py"))),
        ("category_matches", t.category_matches(lit("staleness_drift"), lit("stale")).cast("string")),
        ("category_empty", t.category_matches(lit("logic_drift"), F.lit(None).cast("string")).cast("string")),
        ("code_issues", F.array_join(t.code_issues(lit("var x = §; module.exports = x"), lit("ES6 and ESM")), ";")),
        ("object_from_brace", t.object_from_brace(lit('note\n{"a": {"b": "§"}}'))),
        ("object_from_none", t.object_from_brace(lit("no § object"))),
        ("json_text", t.json_text(a=lit("x§é😀"), b=F.lit(None).cast("string"), c=F.lit(0.5))),
    ]


TEXT_RESULTS = [
    ("batch_custom_id", "owner--repo§js_b3"), ("repo_of_custom_id", "owner/my-repo§"), ("repo_of_old_id", "owner/my_repo§"), ("dashed_id", "a-b-c-§d"), ("bare_id", "abc§d"), ("bare_id_empty", "req"), ("strip_fences", '{"a": "§"}'), ("response_body", '{"a": "§"}'),
    ("first_object", '{"a": "§"}'), ("diff_paths", "x§.py,y.py"), ("prefixed_paths", "--- a/src/a§.py\n+++ b/src/a§.py\n@@ -1 +1 @@\n-x\n+y"), ("extract_fenced", "--- a/src/a§.py\n+++ b/src/a§.py\n@@ -1 +1 @@\n-x\n+y"), ("extract_raw", "no patch §"), ("added_lines", "one§\ntwo"),
    ("new_file_diff", "--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n+one§\n+two"), ("model_of_slug", "openai/gpt_§"), ("title_case", "Claude-Opus X§Y"), ("repo_short_name", "lodash"), ("bump_minor", "1.10.0"), ("task_file_name", "logic_§.json"), ("detect_language", "typescript"),
    ("detect_unknown", "unknown"), ("category_matches", "true"), ("category_empty", "true"), ("code_issues", "Uses 'var' instead of const/let (staleness);Uses CommonJS instead of ES modules (staleness)"), ("object_from_brace", '{"a": {"b": "§"}}'), ("object_from_none", None), ("json_text", '{"a": "x§\\u00e9\\ud83d\\ude00", "b": null, "c": 0.5}'),
]


@query("q40_text_functions", "SELECT s_suppkey, name, replace(value, '§', s_suppkey::VARCHAR) AS value FROM supplier, (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEXT_RESULTS) + ") AS t(name, value)")
def text_functions(spark, sf_dir):
    """All functions on texts with each supplier's number in them."""
    key = F.col("s_suppkey").cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in text_cases(key)))).alias("x")
    return table(spark, sf_dir, "supplier").select("s_suppkey", each).select("s_suppkey", "x.name", "x.value")

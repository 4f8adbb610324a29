"""Facts and verification over whole tables: every supplier has a small repository, with its number in some names, whose answers were worked out by hand; every document is a source file."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import batches, evaluation, facts, verify
from quillgrid.plans.benchmark import quoted
from quillgrid.plans.registry import query, table
from quillgrid.session import checkpointed
from quillgrid.sources import readers

KEY = "§"
BODY = "\n".join(f"    step_{k} = {k}" for k in range(10))
SOURCES = {
    "app/core.py": f"import util\nfrom app.util import helper\n\nclass Engine§:\n    def start(self, a):\n        return a\n\n    def stop(self):\n        return 0\n\ndef runAll§(alpha, beta, gamma, delta):\n{BODY}\n    return 12345\n\ndef run_more(alpha: int, beta, gamma):\n    return 77 + 88\n",
    "app/util.py": "from app.core import runAll\nimport app/core.py\n\ndef helper(x):\n    return x\n\ndef other(y):\n    return y\n",
    "lib/more.py": "def helper(x):\n    return x\n\n\n\n",
    "svc/main.go": 'package main\n\ntype Server struct {\n\tname string\n}\n\ntype Runner interface {\n\tRun(x int) error\n\tStop()\n}\n\nfunc (s *Server) Serve_all(n int) {\n\tgo work()\n\tch := make(chan int)\n\tdefer close(ch)\n}\n\nfunc Start(a, b int) {\n\tvar mu sync.Mutex\n}\n',
    "web/page.test.ts": "import { runAll } from '../app/core'\nexport class Page {\n  render(a) {\n    return 1\n  }\n}\nexport const load = async (x) => {\n  expect(x).toBe(1)\n}\n",
    "web/a.js": "const x = require('run_more')\n1\n2\n3\n4\n",
    "web/b.js": "const x = require('run_more')\n1\n2\n3\n4\n",
    "web/c.js": "const x = require('run_more')\n1\n2\n3\n4\n",
    "web/d.js": "const x = require('./run_more.js')\n1\n2\n3\n4\n",
    "web/short.js": "let a = 1\n",
    "node_modules/skip.js": "1\n2\n3\n4\n5\n",
    "notes.txt": "1\n2\n3\n4\n5\n",
}

# Worked out by hand: category, file, description, confidence; then whether it is verified and the notes. KEY stands for the supplier's number.
FINDINGS = [
    ("god_class", "nope.rs", "x", 0.9, False, "File not found: nope.rs"),
    ("god_class", "app/core.py", "Engine§ does too much", 0.9, False, "'Engine§' too small for god class"),
    ("ocp_violation", "core.py", "Engine§ is closed", 0.1, True, "'Engine§' verified"),
    ("isp_violation", "app/core.py", "runAll§ is no class", 0.9, False, "Entity 'runAll§' not found"),
    ("lsp_violation", "app/util.py", "helper", 0.9, False, "No classes or structs found"),
    ("dip_violation", "svc/main.go", "nothing named", 0.4, True, "No entity name found"),
    ("god_function", "app/core.py", "runAll§ is long", 0.9, False, "'runAll§' only 13 lines"),
    ("long_params", "app/core.py", "runAll§ takes many", 0.9, True, "Function 'runAll§' verified"),
    ("long_params", "app/core.py", "run_more takes many", 0.9, False, "'run_more' only 3 params"),
    ("complex_conditional", "app/core.py", "Engine§ branches", 0.9, False, "Function 'Engine§' not found"),
    ("complex_conditional", "app/core.py", "unknown", 0.3, False, "No function name found"),
    ("feature_envy", "app/core.py", "Engine§ envies", 0.3, True, "Entity 'Engine§' exists"),
    ("feature_envy", "app/core.py", "unknown", 0.5, False, "No entity name — requires high confidence"),
    ("dead_code", "app/core.py", "run_more is dead", 0.9, False, "'run_more' imported by web/a.js"),
    ("dead_code", "app/core.py", "Engine§ is dead", 0.9, True, "'Engine§' unreferenced — dead code confirmed"),
    ("dead_code", "app/core.py", "unknown", 0.6, True, "No entity name for dead code"),
    ("naming_convention", "app/core.py", "runAll§ is camel", 0.9, True, "Python function 'runAll§' not snake_case"),
    ("naming_convention", "app/core.py", "run_more is fine", 0.9, False, "'run_more' follows conventions"),
    ("naming_convention", "svc/main.go", "Server.Serve_all has a name", 0.9, True, "Go: 'Server.Serve_all' uses snake_case"),
    ("hardcoded_config", "web/page.test.ts", "x", 0.9, False, "Test file — hardcoded values expected"),
    ("hardcoded_config", "app/core.py", "x", 0.9, True, "3 magic numbers found"),
    ("hardcoded_config", "svc/main.go", "x", 0.5, False, "No magic numbers detected"),
    ("data_clump", "app/core.py", "x", 0.9, True, "Functions share 3 params"),
    ("data_clump", "app/util.py", "x", 0.9, False, "Max shared params: 0 (need 3+)"),
    ("data_clump", "web/a.js", "x", 0.9, False, "Need 2+ functions for data clump"),
    ("performance", "app/core.py", "run_more is slow", 0.9, False, "'run_more' only 3 lines"),
    ("performance", "app/core.py", "runAll§ is slow", 0.1, True, "'runAll§' verified"),
    ("performance", "app/core.py", "all slow", 0.9, False, "File-level check"),
    ("circular_dependency", "app/util.py", "x", 0.9, True, "Cycle: app/util.py <-> app/core.py"),
    ("circular_dependency", "svc/main.go", "x", 0.9, False, "No circular dependency found"),
    ("dry_violation", "app/util.py", "helper again", 0.9, True, "Similar to helper in lib/more.py"),
    ("copy_paste_code", "app/core.py", "runAll§ again", 0.9, False, "No similar function for 'runAll§'"),
    ("shotgun_surgery", "app/core.py", "run_more everywhere", 0.9, True, "'run_more' imported by 4 files"),
    ("shotgun_surgery", "app/core.py", "runAll§ somewhere", 0.9, False, "Only imported by 0 files (need 4+)"),
    ("inappropriate_intimacy", "app/util.py", "x", 0.9, True, "Bidirectional import: app/util.py <-> app/core.py"),
    ("inappropriate_intimacy", "svc/main.go", "x", 0.9, False, "No bidirectional imports"),
    ("race_condition", "svc/main.go", "x", 0.4, True, "Concurrency present"),
    ("goroutine_leak", "app/core.py", "x", 0.9, False, "No concurrency constructs"),
    ("channel_misuse", "web/page.test.ts", "x", 0.3, False, "Concurrency present"),
    ("empty_catch", "app/core.py", "x", 0.4, True, "Error handling check"),
    ("test_quality", "web/page.test.ts", "x", 0.3, True, "Test file check"),
    ("test_quality", "app/core.py", "x", 0.9, False, "Test file check"),
    ("missing_test", "app/core.py", "x", 0.9, False, "Needs tests"),
    ("long_file", "app/util.py", "x", 0.9, False, "File is 9 lines"),
    ("magic_number", "app/core.py", "x", 0.9, False, "3 magic numbers"),
    ("code_smell", "app/core.py", "x", 0.5, True, "Confidence floor: 0.5"),
    ("resource_leak", "app/core.py", "x", 0.4, False, "Unknown category 'resource_leak'"),
]


def keyed(c):
    """The text with the supplier's number for KEY."""
    return F.replace(c, F.lit(KEY), F.col("s_suppkey").cast("string"))


def trees(spark, sf_dir):
    """The small repository of every supplier: repo, path and content."""
    rows = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.crossJoin(rows).select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repo"), "path", keyed(F.col("content")).alias("content"))


def source_files(spark, sf_dir, documents: bool = False):
    """The suppliers' trees and, if asked for, every document as a repository of one file."""
    rows = trees(spark, sf_dir)
    if documents:
        d = table(spark, sf_dir, "documents")
        rows = rows.unionByName(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"), F.lit("lib/page.rb").alias("path"), F.col("text").alias("content")))
    return readers.source_files(rows)


def findings(spark, sf_dir):
    """Every finding in every supplier's repository."""
    rows = spark.createDataFrame([(k, c, f, d, x) for k, (c, f, d, x, *_) in enumerate(FINDINGS)], "seq int, category string, file string, description string, confidence double")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.crossJoin(rows).select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repo"), "seq", "category", "file", keyed(F.col("description")).alias("description"), "confidence")


def by_supplier(columns: str, rows: list[tuple]) -> str:
    """SQL for these rows for every supplier, KEY in texts replaced."""
    names = columns.split(", ")
    listed = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    out = ", ".join(f"replace({n}, '{KEY}', s_suppkey::VARCHAR) AS {n}" if isinstance(rows[0][k], str) else n for k, n in enumerate(names))
    return f"SELECT concat('r', s_suppkey) AS repo, {out} FROM supplier, (VALUES {listed}) AS t({columns})"


FACT_COLUMNS = "path, language, line_count, classes, structs, interfaces, functions, imports, exports, test_assertions, has_tests, goroutines, channels, defers, mutexes, magic_numbers"
# Worked out by hand: the columns above; classes with lines and methods, structs and interfaces with methods, functions with lines and parameters.
FACTS = [
    ("app/core.py", "python", 26, "Engine§:7:2", "", "", "runAll§:13:4,run_more:3:3", "util,app.util", "", 0, False, 0, 0, 0, 0, 3),
    ("app/util.py", "python", 9, "", "", "", "helper:3:1,other:3:1", "app.core,app/core.py", "", 0, False, 0, 0, 0, 0, 0),
    ("lib/more.py", "python", 6, "", "", "", "helper:6:1", "", "", 0, False, 0, 0, 0, 0, 0),
    ("svc/main.go", "go", 21, "", "Server:1", "Runner:2", "Server.Serve_all:5:1,Start:3:2", "", "", 0, False, 1, 1, 1, 1, 0),
    ("web/a.js", "javascript", 6, "", "", "", "", "run_more", "", 0, False, 0, 0, 0, 0, 0),
    ("web/b.js", "javascript", 6, "", "", "", "", "run_more", "", 0, False, 0, 0, 0, 0, 0),
    ("web/c.js", "javascript", 6, "", "", "", "", "run_more", "", 0, False, 0, 0, 0, 0, 0),
    ("web/d.js", "javascript", 6, "", "", "", "", "./run_more.js", "", 0, False, 0, 0, 0, 0, 0),
    ("web/page.test.ts", "typescript", 10, "Page:5:1", "", "", "load:3:0", "../app/core", "Page,load", 1, True, 0, 0, 0, 0, 0),
]
_TESTED = " OR ".join(f"contains(text, '{x}')" for x in ("describe(", "it(", "test(", "def test_", "@pytest"))
#: Documents are prose: no code in them; their numbers, which SQL can't find without look-arounds, are left out.
_PAGES = f"SELECT concat('d', doc_id), 'lib/page.rb', 'ruby', CAST(len(string_split(text, chr(10))) AS INTEGER), '', '', '', '', '', '', 0, {_TESTED}, 0, 0, 0, 0, NULL FROM documents WHERE length(text) <= 50000 AND len(string_split(text, chr(10))) >= 5"


@query("q41_facts", f"{by_supplier(FACT_COLUMNS, FACTS)} UNION ALL {_PAGES}")
def extracted(spark, sf_dir):
    f = facts.extract(source_files(spark, sf_dir, documents=True))
    names = lambda c, *more: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], *(x[m].cast("string") for m in more))), ",")
    return f.select(
        "repo", "path", "language", "line_count", names("classes", "lineCount", "methodCount").alias("classes"), names("structs", "methodCount").alias("structs"), names("interfaces", "methodCount").alias("interfaces"), names("functions", "lineCount", "paramCount").alias("functions"),
        F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), "test_assertions", "has_tests", "goroutines", "channels", "defers", "mutexes", F.when(F.col("language") != "ruby", F.col("magic_numbers")).alias("magic_numbers"),
    )


@query("q42_verify", by_supplier("seq, category, verified, notes", [(k, c, v, n) for k, (c, _, _, _, v, n) in enumerate(FINDINGS)]))
def verified(spark, sf_dir):
    known = checkpointed(facts.extract(source_files(spark, sf_dir)))  # read for paths, imports and functions
    return verify.verify(findings(spark, sf_dir), known).select("repo", "seq", "category", "verified", "notes")


# Worked out by hand: the prompt of a supplier's repository.
PROMPT = "\n\n".join([
    "FILE: app/core.py (python, 26 lines)\n  CLASS Engine§ (7 lines, 2 methods: start, stop)\n  FN runAll§(alpha, beta, gamma, delta) [13 lines]\n  IMPORTS: 2 (util, app.util)",
    "FILE: app/util.py (python, 9 lines)\n  IMPORTS: 2 (app.core, app/core.py)",
    "FILE: lib/more.py (python, 6 lines)",
    "FILE: svc/main.go (go, 21 lines)\n  STRUCT Server (3 lines, 1 methods: Serve_all)\n  INTERFACE Runner (2 methods: Run, Stop)",
    "FILE: web/a.js (javascript, 6 lines)\n  IMPORTS: 1 (run_more)",
    "FILE: web/b.js (javascript, 6 lines)\n  IMPORTS: 1 (run_more)",
    "FILE: web/c.js (javascript, 6 lines)\n  IMPORTS: 1 (run_more)",
    "FILE: web/d.js (javascript, 6 lines)\n  IMPORTS: 1 (./run_more.js)",
    "FILE: web/page.test.ts (typescript, 10 lines)\n  CLASS Page (5 lines, 1 methods: render)\n  IMPORTS: 1 (../app/core)",
])


@query("q43_prompts", by_supplier("prompt", [(PROMPT,)]))
def prompts(spark, sf_dir):
    return facts.prompts(facts.extract(source_files(spark, sf_dir)))


#: Versions in order, by event_id.
VERSIONS = ["1.9.0", "1.10.0", "2.0.0", "v2.0.1"]
_VERSIONED = f"SELECT event_type AS tier, k, version, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % (k + 2) = 0 OR event_id % 5 < 3 END AS correct FROM events JOIN (VALUES {', '.join(f'({k}, {quoted(v)})' for k, v in enumerate(VERSIONS))}) AS v(k, version) ON event_id % {len(VERSIONS)} = k"


@query("q44_versions", f"""WITH s AS (SELECT tier, k, version, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM ({_VERSIONED}) GROUP BY ALL), p AS (SELECT *, lag(accuracy) OVER (PARTITION BY tier ORDER BY k) AS previous FROM s)
SELECT tier, version, accuracy, CASE WHEN accuracy < 0.6 THEN 'fail' ELSE 'ok' END AS status, previous, round(accuracy - previous, 4) AS change, coalesce(round(accuracy - previous, 4) < -0.05, false) AS regressed FROM p""")
def versions(spark, sf_dir):
    """Events as inferences: tier by type, version by number."""
    i, k = F.col("event_id"), F.col("event_id") % len(VERSIONS)
    correct = F.when(i % 7 != 0, (i % (k + 2) == 0) | (i % 5 < 3))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), F.get(F.array(*map(F.lit, VERSIONS)), k.cast("int")).alias("version"), correct.alias("correct"))
    return evaluation.version_deltas(evaluation.evaluate(rows)).select("tier", "version", "accuracy", "status", "previous", "change", "regressed")


@query("q45_batch_findings", """WITH r AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 3 THEN concat('who--other', conv_id, '_b', turn) ELSE concat('own--lib', conv_id, '_b', turn) END AS batch_id, CASE WHEN conv_id % 4 = 3 THEN concat('who/other', conv_id) ELSE concat('own/lib', conv_id) END AS repo FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))
SELECT repo, conv_id % 4 = 3 AS orphan, batch_id, 0 AS pos, role AS category, concat('f', turn, '.py') AS file, 0.5::DOUBLE AS confidence FROM r WHERE turn % 3 < 2
UNION ALL SELECT repo, conv_id % 4 = 3, batch_id, 1, 'long_file', 'b.py', NULL FROM r WHERE turn % 3 = 0""")
def batch_findings(spark, sf_dir):
    """Turns as replies: an object with two findings, a list of one, or no JSON; a quarter of the conversations have no request."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    one = F.concat(F.lit('{"category": "'), "role", F.lit('", "file": "f'), t, F.lit('.py", "confidence": 0.5}'))
    two = F.concat(F.lit('```json\n{"findings": ['), one, F.lit(', {"category": "long_file", "file": "b.py"}]}\n```'))
    text = F.when(F.col("turn") % 3 == 0, two).when(F.col("turn") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise("no json")
    unknown = F.col("conv_id") % 4 == 3
    replies = rows.select(F.concat(F.when(unknown, "who--other").otherwise("own--lib"), c, F.lit("_b"), t).alias("custom_id"), text.alias("text"))
    asked = rows.filter(~unknown).select(F.concat(F.lit("own/lib"), c).alias("repo"), F.col("turn").alias("batch"), F.lit("p").alias("prompt"))
    return batches.with_repo(batches.findings(replies), batches.requests(asked)).select("repo", "orphan", F.col("_batch_id").alias("batch_id"), "pos", "category", "file", "confidence")

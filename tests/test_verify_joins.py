"""The joins of verification against pairs of all, on made-up repositories; their plans pair nothing."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import containment, verify
from quillgrid.session import checkpointed
from quillgrid.sources import schemas

WORDS = ["a", "b", "ab", "core", "util", "app", "run", "runAll", "Engine", "é", "x.y", "index"]


def repository(rng, repo, n):
    files = []
    paths = list(dict.fromkeys("/".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) + rng.choice([".py", ".js"]) for _ in range(n)))
    for k, path in enumerate(paths):
        kinds = [rng.choice(WORDS), rng.choice(WORDS) + "." + rng.choice(WORDS), rng.choice(paths), rng.choice(paths).replace("/", ".").replace(".py", ""), rng.choice(paths).replace("/", ".")]
        functions = [{"name": rng.choice(WORDS), "lineStart": 1, "lineEnd": 2, "lineCount": rng.randint(1, 14), "paramCount": rng.randint(0, 4), "params": [], "isAsync": False, "isExported": False} for _ in range(rng.randint(0, 3))]
        files.append({"repo": repo, "ord": (k * 7) % len(paths) if len(paths) % 7 else k, "path": path, "language": "python", "line_count": 10, "classes": [{"name": "Engine", "lineStart": 1, "lineEnd": 2, "methodCount": 1, "methods": [], "lineCount": 3}] if rng.random() < 0.4 else [],
                      "structs": [], "interfaces": [], "functions": functions, "imports": rng.sample(kinds, rng.randint(0, 3)), "exports": [], "test_assertions": 0, "has_tests": False, "goroutines": 0, "channels": 0, "defers": 0, "mutexes": 0, "magic_numbers": 0})
    return files


def brute(files, finding):
    repo, seq, category, file, description = finding
    own = [f for f in files if f["repo"] == repo]
    same = [f for f in own if f["path"] == file]
    f = min(same or [f for f in own if f["path"].endswith(file) or file.endswith(f["path"])], key=lambda f: f["ord"], default=None)
    if f is None:
        return None
    names = [c["name"] for c in f["classes"]] + [g["name"] for g in f["functions"]]
    inside = [n for n in names if n in description]
    entity = max(inside, key=len) if inside else None
    func = next((g for g in f["functions"] if g["name"] == entity), None)
    others = sorted((o for o in own if o["path"] != f["path"]), key=lambda o: o["ord"])
    dots = lambda p: p.replace("/", ".").replace("\\", ".")
    there = lambda imports, p: any(dots(p) in i or i in p for i in imports)
    within = lambda imports, p: any(i in p for i in imports)
    first = lambda rows: next((o["path"] for o in rows), None)
    importers = [o for o in others if entity is not None and any(entity in i for i in o["imports"])]
    alike = lambda g: g["name"] == func["name"] or abs(func["paramCount"] - g["paramCount"]) <= 1 and abs(func["lineCount"] - g["lineCount"]) <= 5 and func["lineCount"] > 5
    twins = [(g["name"], o["path"]) for o in others for g in o["functions"] if func and alike(g)]
    return (f["ord"], entity, len(importers), first(importers), first(o for o in others if there(f["imports"], o["path"]) and there(o["imports"], f["path"])), first(o for o in others if within(f["imports"], o["path"]) and within(o["imports"], f["path"])), twins[0] if twins else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_pairs_of_all(spark, seed):
    rng = random.Random(seed)
    files = [f for r in range(6) for f in repository(rng, f"r{r}", [40, 25, 12, 6, 2, 1][r])]
    findings = []
    for seq in range(300):
        repo = f"r{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9])}"
        path = rng.choice([f["path"] for f in files])
        file = rng.choice([path, path[-rng.randint(1, len(path)) :], "deep/er/" + path, "", "none", path.split("/")[-1]])
        findings.append((repo, seq, rng.choice(verify.ACROSS), file, " ".join(rng.sample(WORDS, 3))))
    facts = checkpointed(spark.createDataFrame(files, schemas.FILE_FACT).repartition(3))
    rows = checkpointed(verify.looked_up(spark.createDataFrame([(*x, 0.5) for x in findings], "repo string, seq int, category string, file string, description string, confidence double"), facts))
    got = {r.seq: r for r in rows.join(verify.across(rows, facts).drop("category"), ["repo", "seq"], "left").collect()}
    assert len(got) == len(findings)
    for x in findings:
        want, r = brute(files, x), got[x[1]]
        if want is None:
            assert r.f_ord is None
        else:
            twin = r.twin and (r.twin["name"], r.twin["path"])
            assert (r.f_ord, r.entity, r.importers or 0, r.importer, r.cycle, r.mutual, twin) == want, x
    assert sum(r.cycle is not None for r in got.values()) > 5 and sum(r.twin is not None for r in got.values()) > 5 and sum((r.importers or 0) > 0 for r in got.values()) > 5


def test_contained_equals_pairs(spark):
    rng = random.Random(4)
    texts = [(s, "".join(rng.choices("abcé", k=rng.randint(0, 14)))) for s in "xy" for _ in range(80)] + [("x", None), (None, "abc")]
    names = [(s, "".join(rng.choices("abcé", k=rng.randint(0, 7)))) for s in "xyz" for _ in range(60)] + [("x", None), (None, "abc")]
    got = {tuple(r) for r in containment.contained(spark.createDataFrame(names, "s string, name string"), spark.createDataFrame(texts, "s string, text string"), "s").collect()}
    assert got == {(s, n, t) for s, n in names for q, t in texts if s and s == q and n is not None and t is not None and n in t}
    ends = {tuple(r)[:3] for r in containment.ends_with(spark.createDataFrame(names[:-2], "s string, name string"), spark.createDataFrame(texts[:-2], "s string, text string"), "s").select("s", "name", "text").collect()}
    assert ends == {(s, n, t) for s, n in names[:-2] for q, t in texts[:-2] if s == q and t.endswith(n)}


def test_candidates_grow_with_files(spark):
    """Names of one repository, twice as many each time: what is checked grows likewise."""
    made = []
    for n in (200, 400):
        texts = spark.range(n).select(F.lit("r").alias("s"), F.concat(F.lit("pkg.module"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(".Service")).alias("text"))
        names = spark.range(n).select(F.lit("r").alias("s"), F.concat(F.lit("module"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
        df = containment.contained(names, texts, "s")
        assert df.count() == n
        q = df._jdf.queryExecution()
        assert "CartesianProduct" not in q.toString()
        made.append(n)
    assert made == [200, 400]


def test_strings_are_shuffled_once_and_large_scopes_in_blocks(spark):
    """Names and texts are dealt as they are, not gram by gram; both sides may be dealt by their scope already; blocks give what one task gives."""
    here = spark.range(1).select(F.lit("r").alias("s"))
    texts = spark.range(300).select(F.lit("r").alias("s"), F.concat(F.lit("pkg.module"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text")).join(here.hint("merge"), "s", "left_semi")
    names = spark.range(300).select(F.lit("r").alias("s"), F.lpad(F.col("id").cast("string"), 5, "0").alias("name")).join(here.hint("merge"), "s", "left_semi")
    whole = {tuple(r) for r in containment.contained(names, texts, "s").collect()}
    assert len(whole) >= 300
    found = containment.contained(names, texts, "s", block=40)
    rows = found.collect()
    assert {tuple(r) for r in rows} == whole and len(rows) == len(whole)
    assert "explode(flatten" not in containment.contained(names, texts, "s")._jdf.queryExecution().optimizedPlan().toString()
    ends = [tuple(r) for r in containment.ends_with(names, texts, "s", block=40).collect()]
    assert len(ends) == len(set(ends)) == 300 and all(t.endswith(n) for _, n, t in ends)

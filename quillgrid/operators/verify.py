"""Verification of findings against facts: one CASE over precomputed columns.

Rules that look at one file are expressions. Those that look at the other files of a repository never pair files: names are looked up in imports and paths by an index
of their characters, import edges meet their reverse, and functions like a given one are looked up by their sizes (`across`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import let
from quillgrid.operators.containment import contained, ends_with
from quillgrid.session import dealt, written

# Categories by rule, and the notes that the rules give.
CLASS = ["god_class", "srp_violation", "ocp_violation", "lsp_violation", "isp_violation", "dip_violation"]
FUNCTION = ["god_function", "long_params", "complex_conditional"]
NAMED = ["lazy_class", "feature_envy", "primitive_obsession", "speculative_generality", "refused_bequest", "missing_abstraction", "api_design"]
CONCURRENCY = ["race_condition", "goroutine_leak", "missing_context", "channel_misuse", "mutex_scope"]
ERRORS = ["empty_catch", "error_inconsistency", "error_swallowing", "missing_error_check", "panic_in_library"]
TESTS = ["test_quality", "test_coupling", "test_duplication"]
FLOOR = ["architecture", "package_cohesion", "code_smell", "language_idiom"]
ACROSS = ["dead_code", "circular_dependency", "dry_violation", "copy_paste_code", "shotgun_surgery", "inappropriate_intimacy"]


def resolve(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings with the facts (struct f, or null) of their file: the same path, else the first file where either path ends with the other.

    Each file name is looked up once, among the ends of paths and by its own ends; only numbers of files meet the findings, and the facts join by number.
    """
    paths = facts.select("repo", F.col("ord").alias("f_ord"), F.col("path").alias("f_path"))
    named = findings.select("repo", F.col("file").alias("name"))
    longer = ends_with(named, paths.select("repo", F.col("f_path").alias("text")), "repo").select("repo", F.col("name").alias("file"), F.col("text").alias("f_path"))
    shorter = ends_with(paths.select("repo", F.col("f_path").alias("name")), named.withColumnRenamed("name", "text"), "repo").select("repo", F.col("text").alias("file"), F.col("name").alias("f_path"))
    hits = longer.unionByName(shorter).join(dealt(paths.groupBy("repo", "f_path").agg(F.min("f_ord").alias("f_ord"))), ["repo", "f_path"])
    best = hits.groupBy("repo", "file").agg(F.min(F.struct((F.col("f_path") != F.col("file")).alias("other"), "f_ord")).alias("best")).select("repo", "file", F.col("best.f_ord").alias("f_ord"))
    own = facts.select("repo", F.col("ord").alias("f_ord"), F.struct(*[c for c in facts.columns if c != "repo"]).alias("f"))
    return findings.join(dealt(best), ["repo", "file"], "left").join(dealt(own), ["repo", "f_ord"], "left").drop("f_ord")


def longest_contained(names: Column, text: Column) -> Column:
    """The longest name that the text holds, of equally long ones the first; null if none."""
    rated = F.transform(names, lambda n, k: F.struct((-F.length(n)).alias("short"), k.alias("k"), n.alias("name")))
    return F.get(F.array_sort(F.filter(rated, lambda r: text.contains(r["name"]) & (F.length(r["name"]) > 0))), F.lit(0))["name"]


def named(items: Column, name: Column) -> Column:
    return F.get(F.filter(items, lambda x: x["name"] == name), F.lit(0))


def most_shared_params(functions: Column) -> Column:
    """The most parameter names that two functions share."""
    bare = F.transform(functions, lambda f: F.array_distinct(F.transform(f["params"], lambda p: F.lower(F.trim(F.get(F.split(p, ":"), F.lit(0)))))))
    pairs = F.flatten(F.transform(bare, lambda a, i: F.transform(F.filter(bare, lambda _, j: j > i), lambda b: F.size(F.array_intersect(a, b)))))
    return F.coalesce(F.array_max(pairs), F.lit(0))


def dotted(path: Column) -> Column:
    return F.translate(path, "/\\", "..")


def two_least(rows: DataFrame, by: list[str], *carried: str) -> DataFrame:
    """by, and firsts: the row of the least ord of each of the two paths that come first, so that one remains whichever path is left out. rows: by, ord, path and carried."""
    row = F.struct("ord", "path", *carried)
    each = rows.groupBy(*by, "path").agg(F.min(row).alias("first"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("first"))  # tasks keep two each before they meet
    return each.withColumn("n", n).filter("n <= 2").groupBy(*by).agg(F.array_sort(F.collect_list("first")).alias("firsts"))


def first_elsewhere(firsts: Column, path: Column) -> Column:
    return F.get(F.filter(firsts, lambda x: x["path"] != path), F.lit(0))


def import_edges(files: DataFrame, brought: DataFrame, in_imports: DataFrame) -> DataFrame:
    """repo, a, b and inside: file a has an import that stands in the path of b (inside), or one in which the dotted path of b stands.

    files: repo, ord and path; brought: repo, ord and text (an import); in_imports: repo, name and text of names that stand in imports.
    """
    paths = files.select("repo", F.col("ord").alias("b"), F.col("path"))
    inside = contained(brought.select("repo", F.col("text").alias("name")), files.select("repo", F.col("path").alias("text")), "repo").select("repo", F.col("name").alias("text"), F.col("text").alias("path"))
    importers = brought.select("repo", F.col("ord").alias("a"), "text")
    to_paths = inside.join(dealt(importers), ["repo", "text"]).join(dealt(paths), ["repo", "path"]).select("repo", "a", "b", F.lit(True).alias("inside"))
    dots = paths.select("repo", "b", dotted(F.col("path")).alias("name"))
    from_dots = in_imports.join(dealt(dots), ["repo", "name"]).join(dealt(importers), ["repo", "text"]).select("repo", "a", "b", F.lit(False).alias("inside"))
    return to_paths.unionByName(from_dots).filter("a <> b").groupBy("repo", "a", "b").agg(F.max("inside").alias("inside"))


def mutual_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """repo, ord, cycle and mutual: the path of the first file that has an edge from this one and to it; mutual: by imports inside paths alone."""
    back = edges.select("repo", F.col("b").alias("a"), F.col("a").alias("b"), F.col("inside").alias("inside_back"))
    both = edges.join(dealt(back), ["repo", "a", "b"]).groupBy("repo", F.col("a").alias("ord")).agg(F.min("b").alias("cycle_ord"), F.min(F.when(F.col("inside") & F.col("inside_back"), F.col("b"))).alias("mutual_ord"))
    path = lambda c, name: files.select("repo", F.col("ord").alias(c), F.col("path").alias(name))
    return both.join(dealt(path("cycle_ord", "cycle")), ["repo", "cycle_ord"], "left").join(dealt(path("mutual_ord", "mutual")), ["repo", "mutual_ord"], "left").select("repo", "ord", "cycle", "mutual")


def by_name(name: Column) -> Column:
    """The cell of functions of a name."""
    return F.struct(F.lit(True).alias("named"), F.coalesce(name, F.lit("")).alias("word"), F.lit(0).alias("params"), F.lit(0).alias("lines"))


def by_size(params: Column, lines: Column) -> Column:
    """The cell of functions of so many parameters and lines."""
    return F.struct(F.lit(False).alias("named"), F.lit("").alias("word"), F.coalesce(params, F.lit(-1)).alias("params"), F.coalesce(lines, F.lit(-1)).alias("lines"))


def similar_functions(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """repo, seq and twin (name and path): the first function of another file that has the name of func, or parameters within one and lines within five of it, if it has over five lines.

    Functions lie in cells: by name, and by their numbers of parameters and lines. A finding looks into its name's cell and the 33 cells around its sizes, each of which holds two files.
    """
    g = F.col("g")
    each = facts.select("repo", "ord", "path", F.posexplode("functions").alias("pos", "g")).select("repo", "ord", "path", "pos", g["name"].alias("name"), F.explode(F.array(by_name(g["name"]), by_size(g["paramCount"], g["lineCount"]))).alias("cell"))
    firsts = two_least(each, ["repo", "cell"], "pos", "name")
    func = F.col("func")
    around = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda p: F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda x: by_size(func["paramCount"] + p, func["lineCount"] + x))))
    alone = F.array(by_name(func["name"]))
    asks = wanted.filter(func.isNotNull()).select("repo", "seq", F.col("f_path").alias("own"), F.explode(F.when(func["lineCount"] > 5, F.concat(alone, around)).otherwise(alone)).alias("cell"))
    found = asks.join(dealt(firsts), ["repo", "cell"]).select("repo", "seq", first_elsewhere(F.col("firsts"), F.col("own")).alias("t"))
    return found.filter("t IS NOT NULL").groupBy("repo", "seq").agg(F.min(F.struct("t.ord", "t.pos", "t.name", "t.path")).alias("t")).select("repo", "seq", F.struct("t.name", "t.path").alias("twin"))


def across(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """What other files of the repository say: importers of the entity, cycles, mutual imports, similar functions. rows: see `looked_up`."""
    wanted = rows.filter(F.col("category").isin(ACROSS) & F.col("f_ord").isNotNull()).select("repo", "seq", "category", "entity", "f_ord", "f_path", "func")
    here = wanted.select("repo").distinct()
    files = facts.select("repo", "ord", "path").join(dealt(here), "repo", "left_semi")
    brought = facts.join(dealt(here), "repo", "left_semi").select("repo", "ord", "path", F.explode(F.array_distinct("imports")).alias("text"))
    entities = wanted.filter("entity IS NOT NULL").select("repo", F.col("entity").alias("name"))
    in_imports = written(contained(entities.unionByName(files.select("repo", dotted(F.col("path")).alias("name"))), brought, "repo"))
    # Importers: how many files by entity and path, and the first two paths.
    importing = in_imports.join(dealt(entities.distinct()), ["repo", "name"], "left_semi").join(dealt(brought), ["repo", "text"]).select("repo", F.col("name").alias("entity"), "ord", "path").distinct()
    by_path = importing.groupBy("repo", "entity", "path").agg(F.count("*").alias("own_files"))
    totals = by_path.groupBy("repo", "entity").agg(F.sum("own_files").alias("all_files")).join(dealt(two_least(importing, ["repo", "entity"])), ["repo", "entity"])
    asked = wanted.filter("entity IS NOT NULL").select("repo", "seq", "entity", F.col("f_path").alias("path"))
    importers = (
        asked.join(dealt(totals), ["repo", "entity"]).join(dealt(by_path), ["repo", "entity", "path"], "left")
        .select("repo", "seq", (F.col("all_files") - F.coalesce("own_files", F.lit(0))).alias("importers"), first_elsewhere(F.col("firsts"), F.col("path"))["path"].alias("importer"))
    )
    rounds = mutual_imports(written(import_edges(files, brought, in_imports)), files)  # edges meet their reverse: written, as they are read twice
    placed = wanted.select("repo", "seq", F.col("f_ord").alias("ord")).join(dealt(rounds), ["repo", "ord"], "left").drop("ord")
    return placed.join(dealt(importers), ["repo", "seq"], "left").join(dealt(similar_functions(wanted, facts)), ["repo", "seq"], "left")


def looked_up(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings with what their own file says, in a few values each: f_ord and f_path, the entity that the description names, its class or struct (kind) and function (func), and counts."""
    f = F.col("f")
    # Only what the rules read of a file meets its findings.
    less = lambda c, *names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    kinds = F.concat("classes", F.coalesce("structs", F.array().cast(facts.schema["structs"].dataType)))
    slim = facts.select(
        "repo", "ord", "path", "language", "line_count", "has_tests", "magic_numbers", "goroutines", "channels", "mutexes", less(kinds, "name", "methodCount", "lineCount").alias("kinds"),
        less(F.col("functions"), "name", "paramCount", "lineCount", "params", "isAsync").alias("functions"),
    )
    rows = resolve(findings.withColumn("file", F.coalesce("file", F.lit(""))), slim)
    kinds = f["kinds"]
    parallel = (f["goroutines"] > 0) | (f["channels"] > 0) | (f["mutexes"] > 0) | F.exists(f["functions"], lambda x: x["isAsync"])

    def about(kinds: Column) -> Column:
        names = F.concat(F.transform(kinds, lambda x: x["name"]), F.transform(f["functions"], lambda x: x["name"]))
        return let(
            F.struct(longest_contained(names, F.coalesce("description", F.lit(""))).alias("entity")),
            lambda n: F.struct(n["entity"].alias("entity"), named(kinds, n["entity"]).alias("kind"), named(f["functions"], n["entity"]).alias("func"), F.size(kinds).alias("n_kinds")),
        )

    short = lambda c, *names: F.when(c.isNotNull(), F.struct(*(c[n].alias(n) for n in names)))
    rows = rows.withColumn("about", let(kinds, about))
    shared = F.when(F.col("category") == "data_clump", most_shared_params(f["functions"]))
    return rows.select(
        *findings.columns, f["ord"].alias("f_ord"), f["path"].alias("f_path"), f["language"].alias("language"), f["line_count"].alias("line_count"), f["has_tests"].alias("has_tests"), f["magic_numbers"].alias("magic_numbers"),
        F.size(f["functions"]).alias("n_functions"), parallel.alias("parallel"), shared.alias("shared"), F.col("about.entity").alias("entity"), F.col("about.n_kinds").alias("n_kinds"),
        short(F.col("about.kind"), "name", "methodCount", "lineCount").alias("kind"), short(F.col("about.func"), "name", "paramCount", "lineCount").alias("func"),
    )


def verify(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings (repo, seq, category, file, description, confidence) with verified and notes. facts are read several times: give them written, or checkpointed."""
    rows = written(looked_up(findings, facts))  # the rules and the joins of `across` start from these few values
    rows = rows.join(dealt(across(rows, facts).drop("category")), ["repo", "seq"], "left")
    e, func, kind, category = F.col("entity"), F.col("func"), F.col("kind"), F.col("category")
    sure = F.coalesce("confidence", F.lit(0.0))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    says = lambda ok, note: F.struct((F.lit(ok) if isinstance(ok, bool) else ok).alias("verified"), (F.lit(note) if isinstance(note, str) else note).alias("notes"))
    imported = F.coalesce("importers", F.lit(0))
    no = lambda least, note: says(sure >= least, note)
    god = category.isin("god_class", "srp_violation") & (kind["methodCount"] < 5) & (kind["lineCount"] < 200)
    class_rule = (
        F.when(F.col("n_kinds") == 0, says(False, "No classes or structs found")).when(e.isNull(), no(0.4, "No entity name found")).when(kind.isNull(), says(False, text("Entity '", e, "' not found")))
        .when(god, says(False, text("'", e, "' too small for god class"))).otherwise(says(True, text("'", e, "' verified")))
    )
    function_rule = (
        F.when(e.isNull(), no(0.4, "No function name found")).when(func.isNull(), says(False, text("Function '", e, "' not found")))
        .when((category == "god_function") & (func["lineCount"] < 30), says(False, text("'", e, "' only ", func["lineCount"], " lines")))
        .when((category == "long_params") & (func["paramCount"] < 4), says(False, text("'", e, "' only ", func["paramCount"], " params"))).otherwise(says(True, text("Function '", e, "' verified")))
    )
    named_rule = F.when(e.isNull(), no(0.6, "No entity name — requires high confidence")).otherwise(says(sure >= 0.3, text("Entity '", e, "' exists")))
    dead = F.when(e.isNull(), no(0.6, "No entity name for dead code")).when(imported > 0, says(False, text("'", e, "' imported by ", F.col("importer")))).otherwise(says(True, text("'", e, "' unreferenced — dead code confirmed")))
    snake = (F.col("language") == "go") & e.contains("_") & (e != F.upper(e))
    camel = (F.col("language") == "python") & func.isNotNull() & e.rlike(r"\p{Lu}") & ~e.startswith("_")
    naming = (
        F.when(e.isNull(), no(0.6, "No entity name for naming check")).when(snake, says(True, text("Go: '", e, "' uses snake_case")))
        .when(camel, says(True, text("Python function '", e, "' not snake_case"))).otherwise(says(False, text("'", e, "' follows conventions")))
    )
    config = F.when(F.col("has_tests"), says(False, "Test file — hardcoded values expected")).when(F.col("magic_numbers") > 2, says(True, text(F.col("magic_numbers"), " magic numbers found"))).otherwise(no(0.6, "No magic numbers detected"))
    shared = F.col("shared")
    clump = F.when(F.col("n_functions") < 2, says(False, "Need 2+ functions for data clump")).when(shared >= 3, says(True, text("Functions share ", shared, " params"))).otherwise(says(False, text("Max shared params: ", shared, " (need 3+)")))
    speed = F.when(func["lineCount"] < 10, says(False, text("'", e, "' only ", func["lineCount"], " lines"))).when(func.isNotNull(), says(True, text("'", e, "' verified"))).otherwise(says((sure >= 0.5) & (F.col("line_count") > 50), "File-level check"))
    circle = F.when(F.col("cycle").isNotNull(), says(True, text("Cycle: ", F.col("f_path"), " <-> ", F.col("cycle")))).otherwise(says(False, "No circular dependency found"))
    twin = F.col("twin")
    repeat = F.when(e.isNull(), no(0.6, "No entity name for DRY check")).when(func.isNull() | twin.isNull(), says(False, text("No similar function for '", e, "'"))).otherwise(says(True, text("Similar to ", twin["name"], " in ", twin["path"])))
    surgery = F.when(e.isNull(), no(0.6, "No entity name")).when(imported >= 4, says(True, text("'", e, "' imported by ", imported, " files"))).otherwise(says(False, text("Only imported by ", imported, " files (need 4+)")))
    intimacy = F.when(F.col("mutual").isNotNull(), says(True, text("Bidirectional import: ", F.col("f_path"), " <-> ", F.col("mutual")))).otherwise(says(False, "No bidirectional imports"))
    parallel = F.col("parallel")
    concurrency = F.when(~parallel, says(False, "No concurrency constructs")).otherwise(no(0.4, "Concurrency present"))
    rule = (
        F.when(F.col("f_ord").isNull(), says(False, text("File not found: ", F.col("file"))))
        .when(category.isin(CLASS), class_rule).when(category.isin(FUNCTION), function_rule).when(category.isin(NAMED), named_rule)
        .when(category == "dead_code", dead).when(category == "naming_convention", naming).when(category == "hardcoded_config", config).when(category == "data_clump", clump)
        .when(category == "performance", speed).when(category == "circular_dependency", circle).when(category.isin("dry_violation", "copy_paste_code"), repeat)
        .when(category == "shotgun_surgery", surgery).when(category == "inappropriate_intimacy", intimacy).when(category.isin(CONCURRENCY), concurrency)
        .when(category.isin(ERRORS), no(0.4, "Error handling check")).when(category.isin(TESTS), says((sure >= 0.3) & F.col("has_tests"), "Test file check"))
        .when(category == "missing_test", says(~F.col("has_tests") & (F.col("line_count") > 50) & (F.col("n_functions") > 1), "Needs tests"))
        .when(category == "long_file", says(F.col("line_count") > 300, text("File is ", F.col("line_count"), " lines")))
        .when(category == "magic_number", says(F.col("magic_numbers") > 3, text(F.col("magic_numbers"), " magic numbers")))
        .when(category.isin(FLOOR), no(0.5, text("Confidence floor: ", sure))).otherwise(no(0.5, text("Unknown category '", category, "'")))
    )
    judged = rows.withColumn("judged", rule)
    return judged.select(*findings.columns, F.col("judged.verified").alias("verified"), F.col("judged.notes").alias("notes"))


def with_prompts(findings: DataFrame, facts: DataFrame, parts: DataFrame) -> DataFrame:
    """Findings with the prompt part (repo, ord, part) of the file that they resolve to, and a hash of its facts."""
    found = resolve(findings.withColumn("file", F.coalesce("file", F.lit(""))), facts).withColumn("ord", F.col("f.ord"))
    hashed = found.withColumn("facts_hash", F.when(F.col("f").isNotNull(), F.left(F.sha2(F.to_json("f").cast("binary"), 256), F.lit(16))))
    return hashed.join(dealt(parts.select("repo", "ord", F.col("part").alias("facts_prompt"))), ["repo", "ord"], "left").select(*findings.columns, "facts_prompt", "facts_hash")

"""What the driver holds doesn't grow with the number of joins, keys or files."""

import random

from pyspark.sql import functions as F
from test_verify_joins import repository

from quillgrid.llm import lines
from quillgrid.llm.common import prepare
from quillgrid.operators import verify
from quillgrid.plans import content
from quillgrid.session import checkpointed
from quillgrid.sources import schemas


def ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_verification_sends_no_side_of_a_join_to_all_tasks(spark):
    """Small sides too: Spark decides by bytes, join by join, and the driver would hold all of them."""
    files = repository(random.Random(3), "r", 12)
    facts = checkpointed(spark.createDataFrame(files, schemas.FILE_FACT))
    rows = [("r", k, verify.ACROSS[k % len(verify.ACROSS)], f["path"], "run Engine app", 0.5) for k, f in enumerate(files)]
    found = checkpointed(verify.looked_up(spark.createDataFrame(rows, "repo string, seq int, category string, file string, description string, confidence double"), facts))
    for df in (verify.looked_up(found.select("repo", "seq", "category", "file", "description", "confidence"), facts), verify.across(found, facts)):
        assert "Broadcast" not in ran(df)
    named = found.select("repo", F.col("f_path").alias("path"), F.lit("run").alias("part"), F.col("f_ord").alias("ord"))
    assert "Broadcast" not in ran(verify.with_prompts(found.select("repo", "file"), facts, named.select("repo", "ord", "part")))


def test_files_of_contents_send_no_part_to_all_tasks(spark):
    assert "Broadcast" not in ran(content.files(spark, "/root/testdata/sf0.001"))


def test_line_dedup_sends_no_lines_to_all_tasks(spark):
    prepare(spark)
    told = " ".join("".join(random.Random(k).choices("abcdefghijklmnop", k=7)) for k in range(12))
    docs = spark.createDataFrame([(1, told), (2, told + "x\nother words here"), (3, None)], "doc_id long, text string")
    gone = lines.removals(docs)
    assert "Broadcast" not in ran(gone) and [(r.doc_id, r.places) for r in gone.collect()] == [(2, [0])]

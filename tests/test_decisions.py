"""Times as they are printed, exports and counters, on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from quillgrid.functions import formats
from quillgrid.operators import metrics, scenarios


def test_iso_utc_is_pythons_in_any_session_zone(spark):
    times = [dt.datetime(2024, 3, 10, 7, 30, tzinfo=dt.UTC), dt.datetime(2024, 11, 3, 6, 15, 1, 250, tzinfo=dt.UTC), dt.datetime(1999, 12, 31, 23, 59, 59, 999999, tzinfo=dt.UTC), dt.datetime(2024, 1, 1, 0, 0, 0, 120000, tzinfo=dt.UTC)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.range(len(times)).select("id", F.get(F.array(*(F.timestamp_micros(F.lit(int((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1)))) for t in times)), F.col("id").cast("int")).alias("t"))
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = rows.select("id", formats.iso_utc(F.col("t")).alias("iso"), formats.utc_day(F.col("t")).alias("day")).orderBy("id").collect()
            assert [r.iso for r in got] == [t.isoformat() for t in times]
            assert [r.day for r in got] == [t.strftime("%Y-%m-%d") for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS t").select(formats.iso_utc(F.col("t")).alias("x")).first().x is None


def test_exported_scenarios_have_text_for_no_drift_type(spark):
    made = spark.createDataFrame([("s1", "a.patch", None), ("s2", "b.patch", "x"), ("s3", "c.patch", None), ("s4", "none", "x")], "scenario_id string, patch_path string, drift_type string")
    patches = spark.createDataFrame([("a.patch", "+"), ("b.patch", "-"), ("c.patch", "")], "path string, content string")
    got = {(r.scenario_id, r.drift_type) for r in scenarios.evaluation_rows(made, patches).collect()}
    assert got == {("s1", ""), ("s2", "x")}
    assert {r.scenario_id for r in scenarios.with_patches(made, patches).collect()} == {"s1", "s2", "s3"}


def test_counters_exclude_false_positives_once(spark):
    rows = spark.createDataFrame([("m", None, False, True, True), ("m", None, True, True, True), ("m", "x", False, False, True), ("m", None, False, False, None)], "model string, error string, passed boolean, correct boolean, fp boolean")
    r = metrics.counters(metrics.exclude_false_positives(rows, F.col("fp")), ["model"]).first()
    assert (r.total, r.errors, r.passed, r.failed, r.correct, r.false_positives_excluded) == (4, 1, 2, 1, 2, 1)
    assert metrics.counters(metrics.exclude_false_positives(rows.limit(0), F.col("fp")), ["model"]).count() == 0

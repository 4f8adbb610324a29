"""Batches as keyed state: the stream, the window form and a plain state machine agree, whatever the order and however often events come."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.streaming import pending

START = dt.datetime(2026, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def machine(events, now, hours=24):
    """Outcomes by going through each batch's events in order."""
    out, life = [], dt.timedelta(hours=hours)
    null_first = lambda said: tuple((x is not None, x or 0) for x in said)
    for batch in {e[0] for e in events if e[0] is not None}:
        own = sorted({e for e in events if e[0] == batch and e[1] in ("submitted", "done") and e[2] is not None}, key=lambda e: (e[2], e[1] == "done", null_first(e[3:])))
        held, told = None, set()
        for _, kind, time, *said in own:
            if (kind, time) in told:
                continue
            told.add((kind, time))
            if held and time > held[1] + life:
                out.append((batch, "expired", *held[0], held[1], held[1] + life))
                held = None
            if kind == "submitted":
                held = (said, time)
            elif held:
                out.append((batch, "done", *held[0], held[1], time))
                held = None
        if held:
            out.append((batch, *(("expired", *held[0], held[1], held[1] + life) if now > held[1] + life else ("pending", *held[0], held[1], None))))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_events(seed, batches=12, n=160, span=120.0):
    rng = random.Random(seed)
    events = []
    for _ in range(n):
        kind = rng.choice(["submitted", "submitted", "done", "done", "polled", "other"])
        time = rng.choice([rng.uniform(0, span), float(rng.randint(0, 20) * 6)])  # ends and repeats on the hour, too
        said = (rng.choice(["r1", "r2", None]), rng.choice(["m", None]), rng.choice([1, 2, None])) if kind == "submitted" else (None, None, None)
        events.append((f"b{rng.randint(1, batches)}", kind, at(time), *said))
    return events + rng.sample(events, n // 5)


EDGES = [
    ("end", "submitted", at(0), "r", "m", 1), ("end", "done", at(24), None, None, None), ("after", "submitted", at(0), "r", "m", 1), ("after", "done", at(24) + dt.timedelta(microseconds=1), None, None, None),
    ("same", "done", at(3), None, None, None), ("same", "submitted", at(3), "r", "m", 1), ("again", "submitted", at(0), "r", "m", 1), ("again", "submitted", at(20), "r", "m", 2), ("again", "done", at(40), None, None, None), ("again", "done", at(41), None, None, None),
    ("twice", "submitted", at(1), "r", "m", 1), ("twice", "done", at(2), None, None, None), ("twice", "submitted", at(5), "q", "m", 1), ("alone", "done", at(5), None, None, None), ("polled", "polled", at(5), None, None, None), ("micro", "submitted", at(1) + dt.timedelta(microseconds=333), "r", None, None),
    (None, "submitted", at(1), "r", "m", 1), ("timeless", "submitted", None, "r", "m", 1), ("nulls", "submitted", at(2), None, "m", 1), ("nulls", "submitted", at(2), "r", "m", 1),
]


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_the_machine(spark, seed):
    events = some_events(seed) + EDGES
    df = spark.createDataFrame(events, pending.EVENT).repartition(3)
    now = max(e[2] for e in events if e[2])
    assert rows_of(pending.outcomes(df)) == machine(events, now)
    assert rows_of(pending.outcomes(df, at(70))) == machine(events, at(70))  # what is known, seen at an earlier time
    assert pending.outcomes(df.limit(0)).count() == 0


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    pending.prepare(spark)
    yield
    spark.conf.set(key, before)


def test_stream_equals_windows(spark, store, tmp_path):
    """Files out of order within the watermark, repeats in other files, a stop between."""
    rng = random.Random(11)
    events = some_events(11, batches=8, n=120, span=100.0) + EDGES
    rng.shuffle(events)
    known = [e for e in events if e[2]]
    known.sort(key=lambda e: e[2].timestamp() + rng.uniform(0, 3600 * 15))  # at most 15 hours out of order
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(*parts):
        for part in parts:
            spark.createDataFrame(part, pending.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(pending.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        pending.follow(stream, "16 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    half = len(known) // 2
    run(known[: half // 2], known[half // 2 : half])
    # What the state holds then: batches that wait at the watermark.
    mark = max(e[2] for e in known[:half]) - dt.timedelta(hours=16)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    seen = [e for e in known if e[2] <= mark]
    waiting = sorted(((b, *r[:4]) for b, o, *r in machine(seen, mark) if o == "pending" and r[3] + dt.timedelta(hours=24) > mark), key=repr)
    assert rows_of(pending.pending(spark, checkpoint)) == waiting
    run(known[half:], [("last", "done", at(1000), None, None, None)])
    want = [r for r in machine(known, at(984)) if r[1] != "pending"]
    assert rows_of(spark.read.parquet(out).select("batch_id", "outcome", "repo", "model", "prompt_count", "submitted_at", "ended_at")) == want
    batch = pending.outcomes(spark.createDataFrame(known, pending.EVENT), at(984))
    assert rows_of(batch) == want
    # An event that the watermark has passed changes nothing.
    run([("late", "submitted", at(1), "r", "m", 1)], [("last", "done", at(1100), None, None, None)])
    assert spark.read.parquet(out).filter("batch_id = 'late'").count() == 0

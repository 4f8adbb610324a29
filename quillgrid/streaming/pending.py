"""Pending batches as keyed state: a batch is submitted, polled, and done, or it expires a day after it was submitted.

Events have batch_id, kind (submitted, polled, done), at (a timestamp) and what a submission says: repo, model, prompt_count. What becomes of a batch follows from the
times of its events alone, in their order (of equal times, a submission first): a submission while it is pending replaces the one before; a batch that isn't done within
`hours` of its last submission expires then, and a later "done" means nothing until it is submitted again; a batch done right at the end of its time is done. Polls and "done" for an unknown
batch mean nothing. Of several submissions of a batch at one time, the least (repo, model, prompt_count) counts, nulls first. Events without an id, a time or a known kind are left out.

`outcomes` is the batch form: a window over each batch's submissions and ends, no state. `follow` is the stream: events wait in the state of their batch until the watermark has passed them
and are then taken in order, so the order in which they come doesn't matter, nor do repeats; timers end what nobody ends. Both give the same rows for events no later than the watermark allows; later ones are
dropped. `pending` reads the batches that a stopped stream would go on with, from its checkpoint. Polls are kept in neither: nothing depends on them, so a batch that is asked for again and again has no more state than any other.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOURS = 24
EVENT = "batch_id string, kind string, at timestamp, repo string, model string, prompt_count int"
OUTCOME = "batch_id string, outcome string, repo string, model string, prompt_count int, submitted_at timestamp, ended_at timestamp"
#: What the stream's state holds of a pending batch; times are microseconds.
HELD = "repo string, model string, prompt_count int, submitted_at long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def telling(events: DataFrame) -> DataFrame:
    """Events that matter to what becomes of a batch, in the columns of EVENT."""
    return events.filter(F.col("batch_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("submitted", "done")).select("batch_id", "kind", "at", "repo", "model", F.col("prompt_count").cast("int").alias("prompt_count"))


def outcomes(events: DataFrame, now=None, hours: int = HOURS) -> DataFrame:
    """A row for each batch that is done or expired, and (outcome pending) for those that time `now` (default: the last event's, of any kind) finds waiting."""
    told = F.struct("repo", "model", "prompt_count")
    # One row for each batch, kind and time: repeats meet as partial sums, before any task sees a batch whole.
    once = telling(events).groupBy("batch_id", "kind", "at").agg(F.min(F.when(F.col("kind") == "submitted", told)).alias("said"))
    order = Window.partitionBy("batch_id").orderBy("at", F.desc("kind"))
    spans = once.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_at", F.lead("at").over(order)).filter("kind = 'submitted'")
    last = events.agg(F.max("at").alias("now")) if now is None else events.sparkSession.createDataFrame([(now,)], "now timestamp")
    ends = F.col("at") + F.make_interval(hours=F.lit(hours))
    spans = spans.withColumn("ends", ends).crossJoin(F.broadcast(last))  # one row
    outcome = F.when(F.col("next_at") > F.col("ends"), "expired").when(F.col("next_kind") == "done", "done").when(F.col("next_kind").isNull(), F.when(F.col("now") > F.col("ends"), "expired").otherwise("pending"))
    ended = F.when(F.col("outcome") == "done", F.col("next_at")).when(F.col("outcome") == "expired", F.col("ends"))
    return spans.withColumn("outcome", outcome).filter("outcome IS NOT NULL").select("batch_id", "outcome", "said.repo", "said.model", "said.prompt_count", F.col("at").alias("submitted_at"), ended.alias("ended_at"))


class Follower(StatefulProcessor):
    """One batch: `waiting` has its events by time, `pending` its submission."""

    def __init__(self, hours: int):
        self.life = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", HELD)
        self.waiting = handle.getMapState("waiting", "at long, kind string", "repo string, model string, prompt_count int")

    def close(self) -> None:
        pass

    def wake(self, micros: int) -> None:
        """A timer for the first whole millisecond at or after a time."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            at = int(r["micros"])
            said = (r["repo"], r["model"], r["prompt_count"])
            if self.waiting.containsKey((at, r["kind"])):
                said = min(said, tuple(self.waiting.getValue((at, r["kind"]))), key=lambda s: tuple((x is not None, x if x is not None else 0) for x in s))
            self.waiting.updateValue((at, r["kind"]), said)
            self.wake(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Takes all events up to the watermark: none of these can come any more, whichever timer this is."""
        now = 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = ((tuple(k), tuple(v)) for k, v in self.waiting.iterator())
        due = sorted(((at, kind != "submitted", kind, said) for (at, kind), said in known if at <= now), key=lambda e: e[:2])
        out, held = [], tuple(self.pending.get()) if self.pending.exists() else None
        for at, _, kind, said in due:
            if held and at > held[3] + self.life:
                out.append(self.ended(key, "expired", held, held[3] + self.life))
                held = None
            if kind == "submitted":
                held = (*said, at)
            elif held:
                out.append(self.ended(key, "done", held, at))
                held = None
            self.waiting.removeKey((at, kind))
        if held and held[3] + self.life <= now:
            out.append(self.ended(key, "expired", held, held[3] + self.life))
            held = None
        if held:
            self.pending.update(held)
            self.wake(held[3] + self.life)
        elif self.pending.exists():
            self.pending.clear()
        return iter(out)

    @staticmethod
    def ended(key, outcome: str, held: tuple, at: int) -> Row:
        when = lambda micros: datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=micros)
        return Row(batch_id=key[0], outcome=outcome, repo=held[0], model=held[1], prompt_count=held[2], submitted_at=when(held[3]), ended_at=when(at))


def follow(events: DataFrame, late: str = "2 hours", hours: int = HOURS) -> DataFrame:
    """A stream of batches that are done or expired, from a stream of events. Needs the RocksDB state store, see `prepare`."""
    rows = telling(events.withWatermark("at", late)).withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("batch_id").transformWithState(Follower(hours), OUTCOME, "Append", "EventTime")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The batches that are pending in a stream's state: batch_id, repo, model, prompt_count and submitted_at."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    v = F.col("value")
    return state.select(F.col("key.batch_id").alias("batch_id"), v["repo"].alias("repo"), v["model"].alias("model"), v["prompt_count"].alias("prompt_count"), F.timestamp_micros(v["submitted_at"]).alias("submitted_at"))

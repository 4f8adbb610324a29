"""Extension: result files as a stream, kept as a last-wins state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.sinks import last_wins


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; rows later than `late` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """First-wins within the watermark: state stays bounded, so a key may come again after it, unlike the batch form."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_into(path: str, keys: list[str], order: str, buckets: int = 64):
    """A foreachBatch function: merges each batch into the Parquet table at path, last by order wins. See read_state.

    The state lies in buckets by a hash of the keys. A batch writes only the buckets that it touches, as state-<batch>/bucket=<n>; a bucket's newest
    folder holds all of it, so that readers and retries see whole buckets, and what a newer one replaces goes two batches later.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        newest = {b: n for b, n in newest_buckets(spark, path).items() if n < number}
        for n in {newest[b] for b in touched if b in newest}:
            old = spark.read.parquet(f"{path}/state-{n}").filter(F.col("bucket").isin([b for b in touched if newest.get(b) == n]))
            rows = rows.unionByName(old, allowMissingColumns=True)
        last_wins(rows, keys, order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state-{number}")
        for folder, found in state_folders(spark, path).items():
            for b in found:
                if folder < newest.get(b, -1) and folder < number - 1:
                    _files(spark, path).delete(_path(spark, f"{path}/state-{folder}/bucket={b}"), True)

    return merge


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def state_folders(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Batch number -> its buckets, of batches that are written to their end."""
    files, found = _files(spark, path), {}
    if not files.exists(_path(spark, path)):
        return found
    for folder in files.listStatus(_path(spark, path)):
        name = folder.getPath().getName()
        if name.startswith("state-") and files.exists(_path(spark, f"{path}/{name}/_SUCCESS")):
            inside = [x.getPath().getName() for x in files.listStatus(folder.getPath())]
            found[int(name[6:])] = [int(x[7:]) for x in inside if x.startswith("bucket=")]
    return found


def newest_buckets(spark: SparkSession, path: str) -> dict[int, int]:
    """Bucket -> the last batch that wrote it."""
    newest: dict[int, int] = {}
    for n, found in sorted(state_folders(spark, path).items()):
        newest |= dict.fromkeys(found, n)
    return newest


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state's rows: each bucket from its newest folder."""
    newest = newest_buckets(spark, path)
    rows = None
    for n in sorted(set(newest.values())):
        one = spark.read.parquet(f"{path}/state-{n}").filter(F.col("bucket").isin([b for b, m in newest.items() if m == n])).drop("bucket")
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is None:
        raise ValueError(f"no state at {path}")
    return rows

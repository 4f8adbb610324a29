"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import ensure_checkpoints, ship

#: Bytes of an Arrow batch between Spark and Python: bounds a worker's memory with long texts.
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and sees to a checkpoint folder."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoints(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text() -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


_memories: list[dict] = []


def keep_only(memory: dict | None) -> None:
    """Of the memories of words and runs that a worker has, only this one stays: workers live on from one operator to the next."""
    if memory is not None and not any(memory is m for m in _memories):
        _memories.append(memory)
    for m in _memories:
        if m is not memory and m:
            m.clear()


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end, memory that the worker has freed goes back to the system, as workers live on between tasks."""
    keep_only(None)
    yield from rows
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 40) -> Iterator[pa.Table]:
    """The batches in tables of about so many rows, or so many bytes, whichever comes first."""
    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        b += batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held)
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow that leaves a tidy worker."""
    return df.mapInArrow(lambda batches: tidy(work(batches)), schema)


def key_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch, name: str):
    """A column of a batch or table as one Arrow array."""
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles nothing refers to any more, so that executors delete their files now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed: no lineage, and the files of the shuffles behind it may go."""
    done = df.checkpoint()
    free_shuffles(df.sparkSession)
    return done


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet beside the session's checkpoints and read again: cuts its lineage, takes less room than rows."""
    import uuid

    spark = df.sparkSession
    path = f"{prepare(spark).sparkContext.getCheckpointDir()}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    free_shuffles(spark)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(made: DataFrame) -> None:
    """Deletes the files of what `stored` gave, once nothing will read them any more."""
    spark = made.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(made.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

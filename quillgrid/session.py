"""Ships this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Takes the session's own checkpoint folder (spark.checkpoint.dir); a local session without one gets one of its own, as driver and executors are one process there."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet beside the session's checkpoints and read again: takes a fraction of a checkpoint's room."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals and sorts both sides by their key. Without it, Spark sends whatever looks small to all tasks, and a query of many joins has the driver hold all of these at once."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context, once; workers then import it without a path of their own."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="quillgrid-")) / "quillgrid.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)

"""Resharding by a minimum-cost flow of blocks.

Documents lie in old shards; new shards have capacities in bytes. A document's bytes are those of its text and one more. Old shards are cut into
blocks by a hash of the text, so that equal texts share a block; a block of more than twice the usual bytes (a group of copies that many
documents belong to) is cut again by a hash of doc_id, and rows that share both by where they were read. Only the bytes and rows of blocks come to the
driver: BLOCKS in all by the first hash (eight of each old shard at least), and by either cut no more than twice what the new shards hold in blocks of the usual size.

From the sizes of old shards and the capacities a transportation problem gives the bytes that go from each old shard to each new one
at the least cost (by default a byte costs nothing where it is and one elsewhere, so the fewest bytes move). Blocks, largest first, follow this
flow; what rounding to whole blocks leaves uneven is mended by single blocks between the fullest and the emptiest shards. A row's slot is its block's
place in the shard and its number in the block, so no task numbers a whole shard.

`write` lays shards out as files and `rewrite` reshards them: a shard that only receives keeps its files and gets one folder more, one that
gives is written again, others aren't touched. A layout file, put in place last, names the folders of every shard, so that readers see the old or the new
layout and nothing between; folders that no layout names are left-overs of a job that didn't end.

Null text counts as empty (one byte). Null and repeated ids are rows like others; equal rows are told apart by where they were read. A document larger than a
shard's capacity makes its shard that much larger. An empty table gives no rows, and moves nothing.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import free_name, prepare, settled

#: Blocks by the first hash, over all old shards; blocks of the usual size in a new shard.
BLOCKS, IN_SHARD = 8192, 256


def transfers(supply: list[int], room: list[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each old shard to each new one, of the least total cost, by successive shortest paths. supply adds up to no more than room."""
    n, m = len(supply), len(room)
    flow, left, free = np.zeros((n, m), dtype=np.int64), np.array(supply, dtype=np.int64), np.array(room, dtype=np.int64)
    cost = np.asarray(cost, dtype=np.float64)
    while left.any():
        near, far = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        via_old, via_new = np.full(m, -1), np.full(n, -1)
        while True:  # shortest distances over edges forward, and back along those that carry something
            to = near[:, None] + cost
            best = to.argmin(axis=0)
            shorter = to[best, np.arange(m)] < far - 1e-9
            far, via_old = np.where(shorter, to[best, np.arange(m)], far), np.where(shorter, best, via_old)
            back = np.where(flow > 0, far[None, :] - cost, np.inf)
            best = back.argmin(axis=1)
            nearer = back[np.arange(n), best] < near - 1e-9
            near, via_new = np.where(nearer, back[np.arange(n), best], near), np.where(nearer, best, via_new)
            if not nearer.any():
                break
        ends = np.where(free > 0, far, np.inf)
        if not np.isfinite(ends).any():
            raise ValueError("capacities are too small")
        j = end = int(ends.argmin())
        path = []
        while True:
            i = int(via_old[j])
            path.append((i, j))
            if via_new[i] < 0:
                break
            j = int(via_new[i])
        sends = min(int(left[i]), int(free[end]), *(int(flow[a, path[k + 1][1]]) for k, (a, _) in enumerate(path[:-1])))
        for k, (a, b) in enumerate(path):
            flow[a, b] += sends
            if k + 1 < len(path):
                flow[a, path[k + 1][1]] -= sends
        left[i] -= sends
        free[end] -= sends
    return flow


def spread(old: np.ndarray, size: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The new shard of each block (its old shard, its bytes): blocks follow the cheapest transfers, then single ones mend what rounding left."""
    n = cost.shape[0]
    supply = np.bincount(old, weights=size, minlength=n).astype(np.int64)
    need = transfers(supply.tolist(), capacity.tolist(), cost).astype(np.float64)
    allowed = need > 0
    where = np.zeros(len(old), dtype=np.int64)
    for b in np.lexsort((np.arange(len(old)), -size)).tolist():
        i = old[b]
        where[b] = j = int(np.where(allowed[i], need[i], -np.inf).argmax())
        need[i, j] -= size[b]
    over = np.bincount(where, weights=size, minlength=len(capacity)) - capacity
    stuck = np.zeros(len(capacity), dtype=bool)
    while not stuck.all():
        full, empty = int(np.where(stuck, -np.inf, over).argmax()), int(over.argmin())
        gap = over[full] - over[empty]
        own = np.flatnonzero(where == full)
        fits = own[size[own] < gap]
        if not len(fits):
            stuck[full] = True
            continue
        # The block that halves the gap best; of equal ones the one that costs least to put there instead.
        off = np.abs(size[fits] - gap / 2)
        b = fits[np.lexsort((fits, cost[old[fits], empty] - cost[old[fits], full], off))[0]]
        where[b] = empty
        over[full] -= size[b]
        over[empty] += size[b]
    return where


def equal_capacities(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)


def usual_cost(n: int, m: int) -> np.ndarray:
    """A byte costs nothing in the shard of the same number, one in another."""
    return (np.arange(n)[:, None] != np.arange(m)[None, :]).astype(np.float64)


def by_text(shards: int) -> Column:
    """Old shards that a hash of the text deals out: equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1)), F.lit(shards)).cast("int")


def keys(old: Column, shards: int, row: Column) -> list[Column]:
    """What a row's block is told by: its old shard, bucket of its text, and hashes of its id and of where it was read."""
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(max(8, BLOCKS // shards)))
    return [old.cast("int").alias("old_shard"), bucket.cast("int").alias("bucket"), F.xxhash64(F.col("doc_id").cast("long")).alias("deal"), F.xxhash64(row).alias("row")]


def measured(docs: DataFrame, old: Column, shards: int, row: Column) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, bucket, deal and row of every row. row: tells rows of one id and text apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keys(old, shards, row))


#: Blocks are cut by a hash of the text; large ones again by the id, and what shares both by where it was read.
CUTS = (("part", "deal"), ("turn", "row"))


class Plan:
    """Where every block goes. blocks: old_shard, bucket, part, turn, size, rows, shard, first slot and number; cuts: into how many parts large blocks are cut."""

    def __init__(self, rows: DataFrame, old_shards: int, shards: int, capacities: np.ndarray | None = None, cost: np.ndarray | None = None):
        by = ["old_shard", "bucket"]
        sums = lambda df: df.groupBy(*by).agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("rows"), (F.min("deal") == F.max("deal")).alias("lone")).toPandas()
        blocks, self.cuts = sums(rows), []
        total = int(blocks["size"].sum()) if len(blocks) else 0
        usual = max(1, total // (shards * IN_SHARD))
        for name, key in CUTS:
            # Where ids differ they tell rows apart, and the same way every time; a part that stays large all the same has many rows of one id.
            alike = blocks["lone"].astype(bool) | (blocks["size"] > 16 * usual) if key == "row" else True
            large = blocks[(blocks["size"] > 2 * usual) & (blocks["rows"] > 1) & alike]
            into = np.minimum(-(-large["size"] // usual), large["rows"])
            self.cuts.append((name, key, list(by), large[by].assign(into=into).astype("int32")))
            by.append(name)
            if len(large):
                rows = self._cut(rows, *self.cuts[-1])
                blocks = sums(rows)
            else:
                blocks[name] = 0
                rows = rows.withColumn(name, F.lit(0))
        capacities = equal_capacities(total, shards) if capacities is None else np.asarray(capacities, dtype=np.int64)
        cost = usual_cost(old_shards, shards) if cost is None else np.asarray(cost, dtype=np.float64)
        blocks = blocks.sort_values(by, ignore_index=True)
        old, size = blocks["old_shard"].to_numpy(np.int64), blocks["size"].to_numpy(np.int64)
        blocks["shard"] = spread(old, size, capacities, cost) if len(blocks) else np.zeros(0, np.int64)
        blocks = blocks.sort_values(["shard", *by], ignore_index=True)
        blocks["first"] = blocks.groupby("shard")["rows"].cumsum() - blocks["rows"]
        blocks["block"] = np.arange(len(blocks))
        self.blocks, self.by = blocks, by

    @staticmethod
    def _cut(rows: DataFrame, name: str, key: str, by: list[str], into: pd.DataFrame) -> DataFrame:
        """Adds name: which part of its block a row is dealt to, 0 in blocks that aren't cut."""
        if into.empty:
            return rows.withColumn(name, F.lit(0))
        table = F.broadcast(rows.sparkSession.createDataFrame(into, ", ".join(f"{c} int" for c in [*by, "into"])))  # a bounded number of blocks
        return rows.join(table, by, "left").withColumn(name, F.coalesce(F.pmod(F.xxhash64(key), F.col("into")), F.lit(0)).cast("int")).drop("into")

    @property
    def moved(self) -> int:
        """Bytes that change their shard."""
        return int(self.blocks.loc[self.blocks["old_shard"] != self.blocks["shard"], "size"].sum())

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds shard, block and first (its block's first slot) to rows that have the keys of blocks."""
        for cut in self.cuts:
            rows = self._cut(rows, *cut)
        kinds = {**dict.fromkeys(self.by, "int"), "shard": "int", "first": "long", "block": "int"}
        table = self.blocks[list(kinds)].astype({k: "int64" if v == "long" else "int32" for k, v in kinds.items()})
        where = rows.sparkSession.createDataFrame(table if len(table) else [], ", ".join(f"{k} {v}" for k, v in kinds.items()))
        return rows.join(F.broadcast(where), self.by)  # a bounded number of blocks


def reshard(docs: DataFrame, old: Column, old_shards: int, shards: int, capacities: np.ndarray | None = None, cost: np.ndarray | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, old_shard and moved of every document. old: its old shard, from 0 to old_shards - 1."""
    prepare(docs.sparkSession)
    rows = settled(measured(docs, old, old_shards, F.monotonically_increasing_id()))
    placed = Plan(rows, old_shards, shards, capacities, cost).apply(rows)
    number = F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size", "row"))
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + number - 1).alias("slot"), "old_shard", (F.col("old_shard") != F.col("shard")).alias("moved")
    )


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def layout(spark: SparkSession, path: str) -> dict:
    """The newest layout: its number, and the folders of each shard."""
    files, folder = _files(spark, f"{path}/_layouts")
    newest = max((f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().endswith(".json")), default=None)
    if newest is None:
        raise FileNotFoundError(f"no layout at {path}")
    text = "".join(r.value for r in spark.read.text(f"{path}/_layouts/{newest}").collect())
    return json.loads(text)


def _put_layout(spark: SparkSession, path: str, number: int, shards: dict[str, list[str]]) -> None:
    """Writes a layout beside its place and moves it there: it is seen whole or not at all."""
    files, _ = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_layouts/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"number": number, "shards": shards}).encode()))
    out.close()
    if not files.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_layouts/{number:09d}.json")):
        raise OSError(f"layout {number} of {path} is there already")


def _write_shards(rows: DataFrame, path: str, shard: str) -> dict[str, list[str]]:
    """Writes rows into a new folder of each shard; the folders, by shard."""
    run = uuid.uuid4().hex
    rows.withColumnRenamed(shard, "shard").withColumn("run", F.lit(run)).write.mode("append").partitionBy("shard", "run").parquet(path)
    files, _ = _files(rows.sparkSession, path)
    found = files.globStatus(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/shard=*/run={run}"))
    return {f.getPath().getParent().getName().removeprefix("shard="): [f"shard={f.getPath().getParent().getName().removeprefix('shard=')}/run={run}"] for f in found}


def write(docs: DataFrame, path: str, shard: Column, shards: int) -> None:
    """Lays documents out as files of shards 0 to shards - 1."""
    if {"shard", "run"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns named shard or run name folders here; rename them")
    made = _write_shards(docs.withColumn("shard", shard), path, "shard")
    _put_layout(docs.sparkSession, path, 1, {str(k): made.get(str(k), []) for k in range(shards)})


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The documents of all shards (or some) with their shard; None where no file is there."""
    shards = layout(spark, path)["shards"]
    folders = [f"{path}/{f}" for k, found in shards.items() for f in found if only is None or int(k) in only]
    return spark.read.option("basePath", path).parquet(*folders).drop("run") if folders else None


def rewrite(spark: SparkSession, path: str, shards: int, capacities: np.ndarray | None = None, cost: np.ndarray | None = None) -> dict:
    """Reshards the files at path to shards 0 to shards - 1. Gives bytes moved, and the shards written again, grown by a folder and left alone."""
    prepare(spark)
    now = layout(spark, path)
    old_shards = 1 + max((int(k) for k in now["shards"]), default=0)
    docs = read(spark, path)
    if docs is None:
        _put_layout(spark, path, now["number"] + 1, {str(k): [] for k in range(shards)})
        return {"moved": 0, "again": [], "grown": [], "alone": list(range(shards))}
    where_read = F.struct("_metadata.file_path", "_metadata.row_index")
    plan = Plan(settled(measured(docs, F.col("shard"), old_shards, where_read)), old_shards, shards, capacities, cost)
    moves = plan.blocks[plan.blocks["old_shard"] != plan.blocks["shard"]]
    gives, takes = {int(x) for x in moves["old_shard"]}, {int(x) for x in moves["shard"]}
    folders = {str(k): [] if k in gives else now["shards"].get(str(k), []) for k in range(shards)}
    if gives:
        source = read(spark, path, sorted(gives))
        to = free_name(source, "to")
        doc = F.struct(*(c for c in source.columns if c != "shard")).alias("doc")
        rows = plan.apply(source.select(doc, *keys(F.col("shard"), old_shards, where_read))).select("doc.*", F.col("shard").alias(to))
        for k, made in _write_shards(rows, path, to).items():
            folders[k] = folders[k] + made
    _put_layout(spark, path, now["number"] + 1, folders)
    kept = set(range(shards))
    return {"moved": plan.moved, "again": sorted(gives & kept), "grown": sorted(takes - gives), "alone": sorted(kept - gives - takes)}

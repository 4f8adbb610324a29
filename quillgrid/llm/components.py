"""Connected components of a link table.

Each task first reduces its links to a spanning forest, which has fewer links than nodes and no long paths. While more than
ONE_TASK links are left, alternating large and small stars (Kiveris et al. 2014) go on distributed rows, a checkpoint a
step; what is left then, at most ONE_TASK links of 16 bytes, is united in one task. Either way gives
the same components, and only a row count and a checksum come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, in_batches, partitions, settled
from quillgrid.session import dealt

#: Links that one task unites: a bound of its memory (some 200 bytes each), whatever the table's size.
ONE_TASK = 1_000_000
#: Links that are worth a task of their own.
A_TASK = 50_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of links and, for each, the least end that it is connected with."""
    node, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    above = list(range(len(node)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while above[a] != a:
            above[a] = above[above[a]]
            a = above[a]
        while above[b] != b:
            above[b] = above[above[b]]
            b = above[b]
        if a < b:
            above[b] = a
        else:
            above[a] = b
    root = np.asarray(above, np.int64)
    while len(root) and (root != root[root]).any():
        root = root[root]
    return node, node[root] if len(node) else node


def _forest(links: DataFrame, all_nodes: bool = False) -> DataFrame:
    """node and root within the links of a task; roots themselves only if all_nodes. Takes in ONE_TASK links at a time."""

    def run(batches):
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            u.append(np.asarray(column(batch, "u")))
            v.append(np.asarray(column(batch, "v")))
            if sum(map(len, u)) > ONE_TASK:
                node, root = roots_of(np.concatenate(u), np.concatenate(v))
                if len(node) > ONE_TASK // 2:  # a forest of many nodes: gives way to the next
                    yield pa.RecordBatch.from_arrays([pa.array(x[node != root]) for x in (node, root)], ["u", "v"])
                    node = root = node[:0]
                u, v = [node], [root]
        node, root = roots_of(np.concatenate(u), np.concatenate(v))
        keep = np.ones(len(node), dtype=bool) if all_nodes else node != root
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, root)], ["u", "v"])

    return in_batches(links.select("u", "v"), run, "u long, v long")


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v, and m: the least of u and all its v. The minima are written, so that both sides of the join are plain shuffles, whose hot u Spark can split."""
    least = settled(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(dealt(least), "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return settled(_with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _with_least(down)
    moved = stars.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = stars.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % (1 << 40)).cast("long")).alias("h")).first()


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """links: long columns u and v. Gives node and root, the least node it is connected with, for all nodes of links between two nodes."""
    one_task = ONE_TASK if one_task is None else one_task
    # Several tables' parts in a task: a forest of few links costs a task all the same.
    tasks = min(partitions(links.sparkSession), max(4, -(-links.count() // A_TASK)))
    now = settled(_forest(links.filter(F.col("u") != F.col("v")).coalesce(tasks)))
    left, before = now.count(), None
    while left > one_task:
        mark = _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, left = mark, mark.n
        if left > one_task:
            now = settled(_small_star(_large_star(now)))
    return settled(_forest(now.repartition(1), all_nodes=True).select(F.col("u").alias("node"), F.col("v").alias("root")))

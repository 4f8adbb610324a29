"""Links of a similarity join from buckets of candidates, without all pairs of a bucket.

First the members of a bucket gather around leaders: of those that are left and look near to many, the least by a hash
leads; all that look near to it are compared with it and leave. Then buckets whose members still belong to
several components are looked at again: members that look near to one of another component are compared with it; where
these pairs are more than SPARSE a member, the members and their contents meet in tasks that hold a pair of blocks, so that the pairs never
leave the task. Two members of a bucket that look near and that `pairs` would link are therefore
linked or connected already. What looks near is decided on sketches, by a bound that links don't miss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, discard, gathered, in_batches, partitions, settled, stored
from quillgrid.llm.components import components
from quillgrid.llm.fingerprints import mix
from quillgrid.session import dealt as by_key

#: Members of a bucket that meet at once; larger buckets are cut into parts by a hash of the node.
PART = 4096
#: Pairs a member of a bucket that are told one by one, unless the caller says otherwise; buckets with more meet in blocks.
SPARSE = 4
#: Pairs that are verified at once, and bytes of their contents; bytes of contents that all tasks get, so that few contents in many pairs don't end in one task.
PAIRS, PAIR_BYTES, BROADCAST_BYTES = 4096, 1 << 22, 8 << 20
#: Members whose contents a task holds and compares at once.
BLOCK = 1024


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups with equal keys (of the first column, if several tables come at once) from sorted batches, at_least so many rows at a time."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(column(batch, k)) for k in keys])
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (values[:, 1:] != values[:, :-1]).any(axis=0)
        new[0] = last is None or tuple(values[:, 0].tolist()) != last
        begin = 0
        for cut in np.flatnonzero(new).tolist():
            if rows + cut - begin >= max(1, at_least):
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                yield pa.Table.from_batches(held)
                held, rows, begin = [], 0, cut
        held.append(batch.slice(begin))
        rows += batch.num_rows - begin
        last = tuple(values[:, -1].tolist())
    if held:
        yield pa.Table.from_batches(held)


def runs(*values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(values[0])
    new = np.ones(n, dtype=bool)
    for v in values:
        new[1:] &= v[1:] == v[:-1]
    new[1:] = ~new[1:]
    return np.append(np.flatnonzero(new), n)


def crowded(buckets: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once: one shuffle by key, then a look at neighbours as the sorted rows stream by."""

    def run(batches):
        last, told = None, True  # the row before, and whether it was given
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.asarray(column(batch, "key"))
            same = key[1:] == key[:-1]
            goes_on = last is not None and column(last, "key")[0].as_py() == int(key[0])
            if goes_on and not told:
                yield last
            keep = np.zeros(n, dtype=bool)
            keep[0] = goes_on
            keep[1:] |= same
            keep[:-1] |= same
            last, told = batch.slice(n - 1, 1), bool(keep[-1])
            if keep.any():
                yield batch.filter(pa.array(keep))

    spread = buckets.repartition(partitions(buckets.sparkSession), "key").sortWithinPartitions("key")
    return in_batches(spread, run, buckets.schema)


def parted(members: DataFrame, part: int) -> DataFrame:
    """Adds part: 0, or a hash of the node in keys with over `part` members, so that no task has to hold a hot key. Members may tell their bucket's size as n; else only large keys' counts are broadcast, one for `part` rows at least."""
    own = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"), F.lit(0))
    if "n" in members.columns:
        return members.withColumn("parts", F.ceil(F.col("n") / part).cast("int")).withColumn("part", own).drop("n")
    hot = members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > part)
    hot = settled(hot.select("key", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    n = hot.count()
    if not n:
        return members.withColumn("part", F.lit(0)).withColumn("parts", F.lit(1))
    some = F.broadcast(hot) if n <= 100_000 else hot
    return members.join(some, "key", "left").withColumn("part", own).withColumn("parts", F.coalesce("parts", F.lit(1)))


def alike_in_runs(cuts: np.ndarray, values: np.ndarray, near: Callable, at_least: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows of at_least so many: places of their members (runs x size) and which pairs look near (runs x size x size). Runs of one size go together."""
    sizes = np.diff(cuts)
    for size in np.unique(sizes[sizes >= at_least]).tolist():
        begins = cuts[:-1][sizes == size]
        step = max(1, (1 << 20) // size**2)
        for lo in range(0, len(begins), step):
            at = begins[lo : lo + step, None] + np.arange(size)
            if size == 2:  # most buckets
                close = np.zeros((len(at), 2, 2), dtype=bool)
                close[:, 0, 1] = close[:, 1, 0] = near(values[at[:, 0]], values[at[:, 1]])
            elif size <= 512:
                close = near(values[at][:, :, None], values[at][:, None, :])
            else:  # a row at a time
                close = np.stack([near(values[at[0]], values[k]) for k in at[0].tolist()])[None]
            close[:, np.arange(size), np.arange(size)] = False
            yield at, close


def leaders(close: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and two places of pairs, for buckets of one size (buckets x size x size; order: buckets x size): of those that are left and look near to half as many as any does, the least by order leads, and all near to it leave. So one member leads in most of the buckets that a group shares, and its pairs are the same."""
    here, left = np.arange(len(close)), np.ones(order.shape, dtype=bool)
    order = order.view(np.uint64)
    found: list[list[np.ndarray]] = [[], [], []]
    while len(here):
        degree = (close & left[:, None, :]).sum(axis=2) * left
        most = degree.max(axis=1)
        if not most.all():
            some = most > 0
            here, left, close, order, degree, most = here[some], left[some], close[some], order[some], degree[some], most[some]
        k = np.arange(len(here))
        c = np.where(2 * degree >= most[:, None], order, ~np.uint64(0)).argmin(axis=1)
        hit = close[k, c] & left
        which, v = np.nonzero(hit)
        for x, y in zip(found, (here[which], c[which], v), strict=True):
            x.append(y)
        left &= ~hit
        left[k, c] = False
    w, u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
    return w, u, v


def _stars(members: DataFrame, also: list[str], near: Callable) -> DataFrame:
    """u and v of members of a bucket (a part of it) that look near to its leaders, with a null key; and the members of buckets where this doesn't settle all: those of three or more that look near to another one, and all of a bucket in parts."""
    names = ["key", "part", "parts", "u", "v", *also]

    def run(batches):
        for held in groups(batches, ["key", "part"], 4 * PART):
            key, part, parts, node = (np.asarray(column(held, c)) for c in ("key", "part", "parts", "node"))
            values = np.stack([np.asarray(column(held, c)) for c in also], axis=1).astype(np.int64)
            u, v, keep, order = [], [], parts > 1, (mix(node.view(np.uint64), 17) >> np.uint64(1)).view(np.int64)
            for at, close in alike_in_runs(runs(key, part), values, near):
                some = np.flatnonzero(close.any(axis=(1, 2)))
                if at.shape[1] == 2:
                    u += at[some, 0].tolist()
                    v += at[some, 1].tolist()
                    continue
                k, x, y = leaders(close[some], order[at[some]])
                u += at[some[k], x].tolist()
                v += at[some[k], y].tolist()
                open_ = close.any(axis=2)
                keep[at[open_ & (open_.sum(axis=1) > 2)[:, None]]] = True
            a, b = node[u], node[v]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).astype(np.int64), axis=0)
            gone = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([gone, gone, gone, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[gone] * len(also)], names)
            if keep.any():
                told = [pa.array(x[keep].astype(np.int64)) for x in (key, part, parts, node)]
                yield pa.RecordBatch.from_arrays([*told, pa.nulls(int(keep.sum()), pa.int64()), *(pa.array(values[keep, k]) for k in range(len(also)))], names)

    spread = members.repartition(partitions(members.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return in_batches(spread.select("key", "part", "parts", "node", *also), run, ", ".join(f"{c} long" for c in names))


def _still_apart(members: DataFrame, roots: DataFrame, also: list[str], near: Callable, sparse: int) -> DataFrame:
    """What looks near in a bucket of three or more but isn't connected: u and v of pairs, or, where these are many, key, u (the member) and its root, with the columns `also`. Parts of a larger bucket meet in pairs, with the columns `also` only."""
    names = ["key", "u", "v", "root", *also]

    def run(batches):
        for held in groups(batches, ["key", "i", "j"], 4 * PART):
            cuts = runs(*(np.asarray(column(held, c)) for c in ("key", "i", "j")))
            node, root, side, whole = (np.asarray(column(held, c)) for c in ("node", "root", "part", "parts"))
            values = np.stack([np.asarray(column(held, c)) for c in also], axis=1).astype(np.int64)
            keep = np.zeros(len(root), dtype=bool)
            several = np.minimum.reduceat(root, cuts[:-1]) != np.maximum.reduceat(root, cuts[:-1])
            mixed = np.flatnonzero(several & ((np.diff(cuts) > 2) | (whole[cuts[:-1]] > 1)))  # two alone have been compared
            rows = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in mixed]) if len(mixed) else np.zeros(0, np.int64)
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, close in alike_in_runs(np.append(0, np.cumsum(np.diff(cuts)[mixed])), values[rows], near):
                at = rows[at]
                two = (side[at] != side[at][:, :1]).any(axis=1)[:, None, None]
                close &= (root[at][:, :, None] != root[at][:, None, :]) & ((side[at][:, :, None] != side[at][:, None, :]) | ~two)
                few = close.sum(axis=(1, 2)) <= 2 * sparse * at.shape[1]
                keep[at[~few][close[~few].any(axis=2)]] = True
                which, x, y = np.nonzero(close & few[:, None, None])
                u.append(node[at[which, x]])
                v.append(node[at[which, y]])
            a, b = np.concatenate(u), np.concatenate(v)
            pairs = np.unique(np.stack([a, b], axis=1)[a < b], axis=0)
            n, m = len(pairs), int(keep.sum())
            gone = lambda k: pa.nulls(k, pa.int64())
            if n:
                yield pa.RecordBatch.from_arrays([gone(n), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(gone(n) for _ in names[3:])], names)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(column(held, "key"))[keep]), pa.array(node[keep]), gone(m), pa.array(root[keep]), *(pa.array(values[keep, k]) for k in range(len(also)))], names)

    labelled = members.join(by_key(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = labelled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    spread = met.repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return in_batches(spread.select("key", "i", "j", "part", "parts", "node", "root", *also), run, ", ".join(f"{c} long" for c in names)).distinct()


def _between(few: DataFrame, contents: DataFrame, also: list[str], pairs: Callable, block: int = BLOCK) -> DataFrame:
    """Links between components of mixed buckets: members and their contents meet in blocks of about `block`, a large bucket in pairs of blocks."""
    parts = few.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").drop("low", "high")
    mine = few.join(by_key(parts), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", *also).join(by_key(contents), "node")

    def run(batches):
        for group in groups(batches, ["key", "i", "j"]):
            node, root, own = (np.asarray(column(group, c)) for c in ("node", "root", "own"))
            values = np.stack([np.asarray(column(group, c)) for c in also], axis=1).astype(np.int64)
            ends = pairs(column(group, "content"), root, own, values) if len(node) > 1 else []
            found = [sorted((int(node[a]), int(node[b]))) for a, b in ends]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    spread = rows.repartition(partitions(few.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return in_batches(spread.select("key", "i", "j", "own", "node", "root", *also, "content"), run, "u long, v long")


def links(members: DataFrame, also: list[str], near: Callable, contents: Callable[[DataFrame], DataFrame], verify: Callable, pairs: Callable, part: int = PART, block: int = BLOCK, sparse: int = SPARSE, once: bool = False, at_once: tuple[int, int] = (PAIRS, PAIR_BYTES)) -> DataFrame:
    """Verified pairs u and v that connect all that is linked.

    members: key, node, the long columns `also` and, if known, n, the size of the bucket (without n, written, as it is read twice). near(rows, rows) tells from these which pairs look near. contents
    gives node and content of the nodes in a column node; verify(contents, contents) tells which pairs are links;
    pairs(contents, roots, sides, rows) gives links between different roots (and sides, where there are two) that connect what all of them connect.
    once: contents are asked for once, of all nodes that may be compared, and written, not anew for each look. at_once: pairs, and bytes of their contents, that are verified at once.
    """
    divided = parted(members, part)
    told = stored(_stars(divided, also, near))
    stars = settled(told.filter("key IS NULL").select("u", "v").distinct())
    divided = told.filter("key IS NOT NULL").select("key", "part", "parts", F.col("u").alias("node"), *also)
    every = None
    if once:
        every = stored(contents(told.select(F.explode(F.array("u", "v")).alias("node")).filter("node IS NOT NULL").distinct()))
        contents = lambda wanted: every.join(by_key(wanted), "node")

    def run(batches):
        for held in gathered(batches, *at_once):
            told = pa.array(verify(column(held, "a"), column(held, "b")), pa.bool_())
            yield from held.select([0, 1]).filter(told).to_batches()

    def ends(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def verified(found: DataFrame) -> DataFrame:
        held = settled(contents(ends(found)))
        left = held.select(F.col("node").alias("u"), F.col("content").alias("a"))
        right = held.select(F.col("node").alias("v"), F.col("content").alias("b"))
        if (held.agg(F.sum(F.octet_length("content"))).first()[0] or 0) <= BROADCAST_BYTES:
            tasks = min(partitions(found.sparkSession), max(4, 4 * found.count() // at_once[0]))  # many pairs at once cost less each
            dealt = found.repartition(tasks, "u", "v")
            met = dealt.join(F.broadcast(left), "u").join(F.broadcast(right), "v")
        else:
            met = found.join(by_key(left), "u").join(by_key(right), "v")
        return settled(in_batches(met.select("u", "v", "a", "b"), run, "u long, v long"))

    found = verified(stars)
    apart = settled(_still_apart(divided, components(found), also, near, sparse))
    discard(told)
    rest = apart.filter("key IS NULL").select("u", "v").join(by_key(stars), ["u", "v"], "left_anti")
    if not rest.isEmpty():
        found = found.unionByName(verified(settled(rest)))
    few = apart.filter("key IS NOT NULL").select("key", F.col("u").alias("node"), "root", *also)
    if few.isEmpty():
        if once:
            discard(every)
        return found
    roots = components(found)
    few = settled(few.drop("root").join(by_key(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    between = settled(_between(few, settled(contents(few.select("node").distinct())), also, pairs, block))
    if once:
        discard(every)
    return found.unionByName(between)

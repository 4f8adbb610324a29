"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised with its own centroids; a cell is a pair of centroids. A query
visits cells by the sum of its two halves' nearness to them, best first, with a heap over the two ordered
lists, until the cells hold `share` of all vectors (or `least` of them); what goes on from there is the sum of the last of these
cells, as all cells of that sum or more are visited. Their entries are ranked again by their exact inner products in double precision.

The centroids are fitted on at most SAMPLE vectors, the least by a hash of vec_id. Every vector
is indexed. Entries of a cell go to blocks of about BLOCK entries (a large cell to several), the queries that visit a block to batches of as
many; a task has one block and one batch, and entries are copied for batches that visit their block alone. Of equal vectors only the least k + 1 ids can be among the
nearest k, so only these are entries. Only centroids and cell sizes come to the driver: both
are bounded by CENTROIDS.

Vectors that are null, zero, of another length than most or with null or non-finite components take no part. A vec_id
that occurs again counts once, with the least of its vectors. Null ids take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import column, settled
from quillgrid.llm.fingerprints import mix

CENTROIDS, SAMPLE, ROUNDS, BLOCK, SHARE, LEAST = 256, 20_000, 12, 4096, 0.3, 512


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def visit(a: np.ndarray, b: np.ndarray, sizes: list[int], enough: int) -> list[int]:
    """Cells by falling a[i] + b[j] until their sizes add up to enough; sizes: by i * len(b) + j."""
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    sa, sb = a[oa].tolist(), b[ob].tolist()
    oa, ob, sizes = oa.tolist(), ob.tolist(), sizes if isinstance(sizes, list) else sizes.tolist()
    # A row is opened with its first column once the row before is visited there; so every pair comes to the heap once.
    heap, cells, have, rows, columns, step = [(-(sa[0] + sb[0]), 0, 0)], [], 0, len(oa), len(ob), heapq.heapreplace
    while heap and have < enough:
        _, i, j = heap[0]
        cell = oa[i] * columns + ob[j]
        if sizes[cell]:
            cells.append(cell)
            have += sizes[cell]
        if j + 1 < columns:
            step(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < rows:
            heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
    return cells


def blocks_of(sizes: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell, and how many blocks it has: small neighbours share one, large cells have several."""
    first, count, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > size:
            block += held > 0
            first[cell], count[cell] = block, -(-n // size)
            block, held = block + int(count[cell]), 0
        else:
            if held + n > size:
                block, held = block + 1, 0
            first[cell], held = block, held + n
    return first, count


def usable(vector: Column, width: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == width) & fine & F.exists(vector, lambda x: x != 0)


def matrix(batch, name: str = "embedding") -> np.ndarray:
    """A column of equally long lists as doubles."""
    lists = column(batch, name)
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, centroids: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector that is_query (of vec_id) holds for, its k nearest others."""
    spark = vectors.sparkSession
    kinds = "query_id long, rank int, vec_id long, score double"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    widths = plain.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).filter("width > 0").orderBy(F.desc("n"), "width").first()
    if widths is None:
        return spark.createDataFrame([], kinds)
    width = widths.width
    half = max(1, width // 2)
    good = settled(plain.filter(usable(F.col("embedding"), width)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], kinds)
    x = matrix(sample)
    books = [k_means(x[:, :half], centroids), k_means(x[:, half:], centroids) if width > 1 else np.zeros((1, 0))]
    across = len(books[1])

    def cells(batches):
        for batch in batches:
            v = matrix(batch)
            if len(v):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(v[:, :half], books[0]) * across + nearest(v[:, half:], books[1]), pa.int64())], ["vec_id", "embedding", "cell"])

    few = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    placed = settled(good.withColumn("copy", few).filter(F.col("copy") <= k + 1).drop("copy").mapInArrow(cells, "vec_id long, embedding array<double>, cell long"))
    sizes = np.zeros(len(books[0]) * across, np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    enough = max(LEAST, k + 1, int(np.ceil(share * sizes.sum())))
    first, count = blocks_of(sizes, block)
    held = sizes.tolist()

    def route(batches):
        """Beside each query the blocks that hold cells it visits, and the sum of its last cell."""
        for batch in batches:
            q = matrix(batch)
            if not len(q):
                continue
            a, b = q[:, :half] @ books[0].T, q[:, half:] @ books[1].T
            blocks, least = [], []
            for i in range(len(q)):
                cell = np.asarray(visit(a[i], b[i], held, enough), dtype=np.int64)
                # A cell of several blocks lies in blocks of its own, one behind the other.
                blocks.append(np.unique(np.concatenate([first[cell], *(np.arange(first[c], first[c] + count[c]) for c in cell[count[cell] > 1].tolist())])))
                least.append(float(a[i, cell[-1] // across] + b[i, cell[-1] % across]))
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).columns, pa.array(least, pa.float64()), pa.array(blocks, pa.list_(pa.int64()))], ["query_id", "query", "least", "blocks"])

    routed = settled(good.filter(is_query).mapInArrow(route, "query_id long, query array<double>, least double, blocks array<long>"))
    # How many batches of queries each block meets: a block that few visit is copied for few, one that none visits isn't read again.
    batches_of = np.zeros(int((first + count).max()), np.int64)
    for r in routed.select(F.explode("blocks").alias("block")).groupBy("block").count().collect():  # a number for each block
        batches_of[r["block"]] = -(-r["count"] // block)

    def entries(batches):
        for batch in batches:
            ids, cell = np.asarray(column(batch, "vec_id")), np.asarray(column(batch, "cell"))
            to = first[cell] + np.abs(ids) % count[cell]
            copies = batches_of[to]
            take = np.repeat(np.arange(len(ids)), copies)
            turn = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to[take], pa.int64()), pa.array(turn, pa.int64())], ["vec_id", "embedding", "cell", "block", "batch"])

    def visits(batches):
        for batch in batches:
            blocks = column(batch, "blocks")
            rows, to = np.repeat(np.arange(len(blocks)), np.diff(np.asarray(blocks.offsets))), np.asarray(blocks.flatten())
            ids = np.asarray(column(batch, "query_id")).astype(np.uint64)
            dealt = (mix(ids, 3)[rows] % batches_of[to].astype(np.uint64)).astype(np.int64)
            part = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.int64()), pa.array(dealt, pa.int64())], ["query_id", "query", "least", "block", "batch"])

    def ranked(have: pa.Table, want: pa.Table) -> pa.Table:
        out = [[], [], []]
        if have.num_rows and want.num_rows:
            ids, v, cell = np.asarray(column(have, "vec_id")), matrix(have), np.asarray(column(have, "cell"))
            q, query, least = np.asarray(column(want, "query_id")), matrix(want, "query"), np.asarray(column(want, "least"))
            for lo in range(0, len(q), 256):
                part = query[lo : lo + 256]
                near = part @ v.T
                rough = (part[:, :half] @ books[0].T)[:, cell // across] + (part[:, half:] @ books[1].T)[:, cell % across]
                visited = rough >= least[lo : lo + 256, None] - 1e-9
                for i in range(len(near)):
                    s = np.where(visited[i] & (ids != q[lo + i]), near[i], -np.inf)
                    edge = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    pick = np.flatnonzero((s >= edge - 1e-9 * max(1.0, abs(edge))) & (s > -np.inf)) if edge > -np.inf else np.flatnonzero(s > -np.inf)
                    exact = (v[pick] * query[lo + i]).sum(axis=1)
                    best = np.lexsort((ids[pick], -exact))[:k]
                    out[0] += [int(q[lo + i])] * len(best)
                    out[1] += ids[pick][best].tolist()
                    out[2] += exact[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    have = placed.mapInArrow(entries, "vec_id long, embedding array<double>, cell long, block long, batch long")
    want = routed.mapInArrow(visits, "query_id long, query array<double>, least double, block long, batch long")
    found = have.groupBy("block", "batch").cogroup(want.groupBy("block", "batch")).applyInArrow(ranked, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Hard negatives by a pivot table.

Integer vectors get one more component, so that all have the largest length M: x' = (x, sqrt(M² - |x|²)), q' = (q, 0). Then |q' - x'|² = M² + |q|² - 2 q·x,
and the largest inner product is the least Euclidean distance. For every row the distances to PIVOTS pivots are stored. By the triangle inequality the largest
|d(q', p) - d(x', p)| and the least d(q', p) + d(x', p) bracket d(q', x'), and so the score; only rows whose bracket meets what an anchor still
wants are checked, by their exact integer scores.

Rows lie in groups: by their nearest pivot, and by rings of their distance to it. A group's least and largest distances bracket all its rows, and an anchor
goes only to groups whose bracket it needs. Groups are cut into blocks of about BLOCK rows, anchors that visit a group into batches of about BATCH; a task has one
block and one batch, so its memory is bounded, and rows are copied for batches that visit their group alone.

First the positives: a bounded sample gives every anchor a score that its last positive reaches at least; then the negatives, whose scores lie between
low and high hundredths of a positive's. Of rows with one label and vector only the least ids can be among the first few, so only these are candidates
(all may be anchors). The pivots come from the sample, too; all rows are in the table, and the result is exact. Random vectors in many dimensions are all about equally far from a pivot: there
brackets exclude little, and most rows are checked.

Rows with a null id, label or vector, or a null component, take no part. A vec_id that occurs again counts once, with the least of its labels and vectors. Of vectors of
different lengths the components that both have count. Scores beyond 64 bits stay at the bound. Anchors without a positive, and positives without a negative, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import column, in_batches, prepare, settled

PIVOTS, RINGS, SAMPLE, BLOCK, BATCH, CHUNK = 16, 8, 2048, 8192, 4096, 64
TOP = 1 << 63


def rectangle(batch, name: str = "vector") -> np.ndarray:
    """A column of integer lists as rows, zeros behind shorter ones."""
    lists = column(batch, name)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    made = np.zeros((len(sizes), width), dtype=np.int64)
    made[np.arange(width)[None, :] < sizes[:, None]] = flat
    return made


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles where every sum stays within their 53 bits, else in whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * d
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < TOP:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -TOP, TOP - 1).astype(np.int64)


class Space:
    """The augmented space: its reach M², and its pivots."""

    def __init__(self, reach: float, sample: np.ndarray, pivots: int):
        self.reach = reach
        x, rest = sample.astype(np.float64), self.rest(sample)
        # The longest first, then always the one farthest from those before.
        picked = [int((x**2).sum(axis=1).argmax())] if len(x) else []
        far = np.full(len(x), np.inf)
        while picked and len(picked) < min(pivots, len(x)):
            p = picked[-1]
            far = np.minimum(far, ((x - x[p]) ** 2).sum(axis=1) + (rest - rest[p]) ** 2)
            if far.max() <= 0:
                break
            picked.append(int(far.argmax()))
        self.pivots, self.rests = x[picked], rest[picked]

    def rest(self, x: np.ndarray) -> np.ndarray:
        """The component that makes a row as long as the longest."""
        return np.sqrt(np.maximum(self.reach - (x.astype(np.float64) ** 2).sum(axis=1), 0))

    def distances(self, x: np.ndarray, asks: bool = False) -> np.ndarray:
        """Distances of rows (asks: of anchors, whose last component is 0) to the pivots."""
        rest = np.zeros(len(x)) if asks else self.rest(x)
        d = min(x.shape[1], self.pivots.shape[1])
        y = x.astype(np.float64)
        lengths = (y**2).sum(axis=1) + rest**2
        own = (self.pivots**2).sum(axis=1) + self.rests**2
        squares = lengths[:, None] + own[None, :] - 2 * (y[:, :d] @ self.pivots[:, :d].T + rest[:, None] * self.rests[None, :])
        return np.sqrt(np.maximum(squares, 0))

    def bracket(self, asks: np.ndarray, lengths: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest scores of anchors with rows whose distances to the pivots lie between least and most, with room for rounding."""
        low, high = np.zeros((len(asks), len(least))), np.full((len(asks), len(least)), np.inf)
        for p in range(asks.shape[1]):
            d = asks[:, p, None]
            np.maximum(low, np.maximum(d - most[None, :, p], least[None, :, p] - d), out=low)
            np.minimum(high, d + most[None, :, p], out=high)
        whole = self.reach + lengths[:, None]
        room = 1 + 1e-7 * whole
        return (whole - high**2) / 2 - room, (whole - low**2) / 2 + room


def lengths(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def first_few(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; tasks keep as many each before they meet."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", n).filter(F.col("rank") <= most)


class Table:
    """Candidates with their distances to the pivots, in groups."""

    def __init__(self, candidates: DataFrame, pivots: int = PIVOTS, block: int = BLOCK, batch: int = BATCH):
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        reach = candidates.agg(F.max(square)).first()[0] or 0.0
        sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "vector").toArrow()
        self.block, self.batch = block, batch
        self.ids, self.labels, self.sample = np.asarray(column(sample, "vec_id")), column(sample, "label").to_numpy(), rectangle(sample)
        self.space = space = Space(reach, self.sample, pivots)
        near = space.distances(self.sample)
        own = near.argmin(axis=1) if len(near) else np.zeros(0, int)
        marks = [np.quantile(near[own == p, p], np.arange(1, RINGS) / RINGS) if (own == p).any() else np.zeros(RINGS - 1) for p in range(near.shape[1])]
        rings = np.array(marks).reshape(-1, RINGS - 1)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    d = space.distances(rectangle(batch))
                    at = d.argmin(axis=1)
                    ring = (d[np.arange(len(d)), at][:, None] > rings[at]).sum(axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(at * RINGS + ring, pa.int32())], [*batch.schema.names, "distances", "at"])

        plain = candidates.select("vec_id", "label", "vector")
        self.rows = settled(in_batches(plain, place, f"vec_id long, label {plain.schema['label'].dataType.simpleString()}, vector array<long>, distances array<double>, at int")) if len(near) else None
        groups = pivots * RINGS
        self.size, self.least, self.most = np.zeros(groups, np.int64), np.full((groups, near.shape[1]), np.inf), np.full((groups, near.shape[1]), -np.inf)
        if self.rows is not None:
            ends = [f(F.col("distances")[p]).alias(f"{name}{p}") for p in range(near.shape[1]) for name, f in (("a", F.min), ("b", F.max))]
            for r in self.rows.groupBy("at").agg(F.count("*").alias("n"), *ends).collect():  # at most PIVOTS * RINGS rows
                self.size[r["at"]] = r["n"]
                self.least[r["at"]] = [r[f"a{p}"] for p in range(near.shape[1])]
                self.most[r["at"]] = [r[f"b{p}"] for p in range(near.shape[1])]
        self.blocks = np.maximum(1, -(-self.size // block))

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which groups each anchor needs, that wants scores from low to high."""
        there = np.flatnonzero(self.size)
        needed = np.zeros((len(x), len(self.size)), dtype=bool)
        if len(there) and len(x):
            a, b = self.space.bracket(self.space.distances(x, asks=True), lengths(x), self.least[there], self.most[there])
            needed[:, there] = (b >= low[:, None]) & (a <= high[:, None])
        return needed

    def search(self, anchors: DataFrame, bounds, work, kinds: str) -> DataFrame:
        """work(rows, anchors, low, high, space) over every block and batch of anchors that visit it. bounds(batch): the scores from low to high that each anchor wants."""
        size, blocks, batch_rows = self.size, self.blocks, self.batch
        me = _Reader(self)

        def count(batches):
            for batch in batches:
                if batch.num_rows:
                    n = me.visits(rectangle(batch), *bounds(me, batch)).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["at", "n"])

        visited = np.zeros(len(size), np.int64)
        for r in in_batches(anchors, count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            visited[r["at"]] = r["n"]
        dealt = np.maximum(1, -(-visited // batch_rows))
        first = np.concatenate([[0], np.cumsum(blocks)])

        def rows(batches):
            for batch in batches:
                at, ids = np.asarray(column(batch, "at")), np.asarray(column(batch, "vec_id")).astype(np.uint64)
                block = first[at] + (spread_ids(ids, 1) % blocks[at].astype(np.uint64)).astype(np.int64)
                copies = np.where(visited[at] > 0, dealt[at], 0)
                take = np.repeat(np.arange(len(at)), copies)
                turn = np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
                part = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block[take], pa.int64()), pa.array(turn, pa.int64())], [*batch.schema.names, "block", "turn"])

        names = anchors.columns

        def asked(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high = bounds(me, batch)
                who, at = np.nonzero(me.visits(rectangle(batch), low, high))
                turn = (spread_ids(np.asarray(column(batch, "vec_id")).astype(np.uint64)[who], 2) % dealt[at].astype(np.uint64)).astype(np.int64)
                copies = blocks[at]
                take = np.repeat(np.arange(len(who)), copies)
                block = first[at][take] + np.arange(len(take)) - np.repeat(np.cumsum(copies) - copies, copies)
                part = batch.take(pa.array(who[take]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low[who[take]]), pa.array(high[who[take]]), pa.array(block, pa.int64()), pa.array(turn[take], pa.int64())], [*names, "low", "high", "block", "turn"])

        have = in_batches(self.rows, rows, _ddl(self.rows) + ", block long, turn long")
        want = in_batches(anchors, asked, _ddl(anchors) + ", low double, high double, block long, turn long")
        space = self.space

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(left, right, space)

        return have.groupBy("block", "turn").cogroup(want.groupBy("block", "turn")).applyInArrow(meet, kinds)


class _Reader:
    """What tasks need of a table: its groups, space and sample."""

    def __init__(self, table: Table):
        self.space, self.size, self.least, self.most = table.space, table.size, table.least, table.most
        self.ids, self.labels, self.sample = table.ids, table.labels, table.sample

    visits = Table.visits


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def spread_ids(ids: np.ndarray, seed: int) -> np.ndarray:
    h = (ids + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pairs_of(have: pa.Table, want: pa.Table, space: Space, same: bool):
    """For each anchor: its place in want, and the rows (places in have, and exact scores) of its label, or of others, whose bracket meets its bounds."""
    if not have.num_rows or not want.num_rows:
        return
    x, q = rectangle(have), rectangle(want)
    ids, labels = np.asarray(column(have, "vec_id")), column(have, "label").to_numpy(zero_copy_only=False)
    who, asks = np.asarray(column(want, "vec_id")), column(want, "label").to_numpy(zero_copy_only=False)
    low, high = np.asarray(column(want, "low")), np.asarray(column(want, "high"))
    stored = rectangle_of_doubles(have)
    near = space.distances(q, asks=True)
    own = lengths(q)
    kinds, at = np.unique(np.concatenate([labels, asks]), return_inverse=True)
    of_rows, of_asks = at[: len(labels)], at[len(labels) :]
    for kind in np.unique(of_asks).tolist():
        rows = np.flatnonzero((of_rows == kind) == same)
        anchors = np.flatnonzero(of_asks == kind)
        for lo in range(0, len(anchors), CHUNK):
            part = anchors[lo : lo + CHUNK]
            a, b = space.bracket(near[part], own[part], stored[rows], stored[rows])
            fits = (b >= low[part, None]) & (a <= high[part, None]) & (ids[rows][None, :] != who[part, None])
            some = np.flatnonzero(fits.any(axis=0))
            exact = scores(q[part], x[rows[some]])
            for k, i in enumerate(part.tolist()):
                survive = np.flatnonzero(fits[k, some])
                yield i, rows[some[survive]], exact[k, survive]


def rectangle_of_doubles(batch, name: str = "distances") -> np.ndarray:
    lists = column(batch, name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def positives_of(most: int):
    """The first rows of an anchor's own label, in a block."""

    def work(have: pa.Table, want: pa.Table, space: Space) -> pa.Table:
        out, ids, who = [[], [], []], np.asarray(column(have, "vec_id")), np.asarray(column(want, "vec_id"))
        for i, at, score in pairs_of(have, want, space, same=True):
            best = np.lexsort((ids[at], ~score))[:most]  # ~score falls as the score rises, and can't overflow
            out[0] += [int(who[i])] * len(best)
            out[1] += ids[at[best]].tolist()
            out[2] += score[best].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score"])

    return work


def negatives_of(most: int, low: int, high: int):
    """For each positive of an anchor the first rows of other labels within its bounds, in a block."""

    def work(have: pa.Table, want: pa.Table, space: Space) -> pa.Table:
        out, ids, who = [[] for _ in range(5)], np.asarray(column(have, "vec_id")), np.asarray(column(want, "vec_id"))
        told = column(want, "positives").to_pylist() if want.num_rows else []
        for i, at, score in pairs_of(have, want, space, same=False):
            order = np.lexsort((ids[at], ~score))
            falling = ~score[order]
            for p in told[i]:
                least, top = window(p["positive_score"], low, high)
                from_, to = np.searchsorted(falling, ~np.int64(top)), np.searchsorted(falling, ~np.int64(least), side="right")
                best = order[from_ : min(to, from_ + most)]
                for c, v in zip(out, ([int(who[i])] * len(best), [p["positive_id"]] * len(best), [p["positive_score"]] * len(best), ids[at[best]].tolist(), score[best].tolist()), strict=True):
                    c += v
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return work


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = PIVOTS, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. rows: vec_id, label and vector (whole numbers); is_anchor: of vec_id."""
    spark = prepare(rows.sparkSession)
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<long>").alias("vector"))
    whole = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    good = settled(whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"))
    few = first_few(good, ["label", "vector"], ["vec_id"], max(positives + 1, negatives)).drop("rank")
    table = Table(settled(few), pivots, block, batch)
    if table.rows is None:
        return spark.createDataFrame([], kinds)
    anchors = good.filter(is_anchor)

    def reached(me, batch):
        """The score that an anchor's last positive has at least, by the sample."""
        ids, labels = np.asarray(column(batch, "vec_id")), column(batch, "label").to_numpy(zero_copy_only=False)
        got = scores(rectangle(batch), me.sample).astype(np.float64)
        got[(labels[:, None] != me.labels[None, :]) | (ids[:, None] == me.ids[None, :])] = -np.inf
        least = np.partition(got, -positives, axis=1)[:, -positives] if got.shape[1] >= positives else np.full(len(ids), -np.inf)
        return least, np.full(len(ids), np.inf)

    found = table.search(anchors, reached, positives_of(positives), "anchor_id long, positive_id long, positive_score long")
    best = first_few(found, ["anchor_id"], [F.desc("positive_score"), "positive_id"], positives).drop("rank")
    listed = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # a few of each
    asking = settled(anchors.join(listed, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))

    def wanted(me, batch):
        """The lowest and highest score that any of an anchor's positives admits."""
        ends = [[window(p["positive_score"], low, high) for p in told] for told in column(batch, "positives").to_pylist()]
        ends = [[(a, b) for a, b in e if a <= b] for e in ends]
        return np.array([min((a for a, _ in e), default=np.inf) for e in ends], dtype=np.float64), np.array([max((b for _, b in e), default=-np.inf) for e in ends], dtype=np.float64)

    hard = table.search(asking, wanted, negatives_of(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = first_few(hard, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine_sql() -> str:
    """The rows of op13_hard_negatives over `embeddings`."""
    whole = "label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0"
    dot = "list_sum([z[1] * z[2] for z in list_zip(a.v, b.v)])::BIGINT"
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE {whole}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, {dot} AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""

"""Packing into training windows by Karmarkar-Karp multiway differencing.

Each document's ids (with the closing id) are cut: what fills a window alone becomes one; the rest is
cut into items of at most `item` tokens. Within a task, items gather until they fill `group` windows but for a
small slack; multiway differencing then merges partial partitions, the largest window of one with the smallest of the other,
until one partition of near-equal windows is left. If its largest window exceeds the capacity, the window
count rises by one and the differencing is done again. What a task has left at its end and fills
no window becomes windows of powers of two, which need no padding.

Tasks work alone: no shuffle, memory bounded by one group. Null text counts as empty and has
the closing id alone; rows with one doc_id are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillgrid.llm.common import key_and_text, texts
from quillgrid.llm.wordbpe import default_path, encode_bytes

WINDOW, ITEM, GROUP, SLACK, CLOSE = 4096, 512, 512, 8, 2
KINDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item, and the sums of the k windows."""
    n = len(sizes)
    trees: list[tuple] = [(i,) for i in range(n)]
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, two = heapq.heappop(heap)
        both = one + two[::-1]  # one falls, two rises
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        trees.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), len(trees) - 1, both))
    labels: dict[int, np.ndarray] = {len(trees) - 1: np.arange(k)}
    where = np.zeros(n, dtype=np.int64)
    for t in range(len(trees) - 1, -1, -1):
        own = labels.pop(t)
        if len(trees[t]) == 1:
            where[t] = own[0]
            continue
        a, b, order = trees[t]
        back = np.empty(k, dtype=np.int64)
        back[order] = own
        labels[a], labels[b] = back, back[::-1]
    return where, np.bincount(where, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Near-equal windows within capacity; their count rises until no window exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        where, sums = difference(sizes, k)
        if sums.max(initial=0) <= capacity:
            return where, sums
        k += 1


class Packer:
    """Takes documents one by one and gives rows of placed pieces."""

    def __init__(self, base: int, window: int = WINDOW, item: int = ITEM, group: int = GROUP, slack: int = SLACK):
        self.next, self.window, self.item, self.group, self.slack = base, window, item, group, slack
        self.items: list[tuple[int, int, bytes, int]] = []  # doc_id, start, ids, doc_tokens
        self.held = 0
        self.rows: list[tuple] = []

    def place(self, piece: tuple[int, int, bytes, int], sequence: int, offset: int) -> int:
        doc, start, ids, total = piece
        n = len(ids) // 4
        self.rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
        return offset + n

    def add(self, doc: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.place((doc, at, ids[4 * at : 4 * (at + self.window)], total), self.next, 0)
            self.next += 1
            at += self.window
        full = self.group * (self.window - self.slack)
        while at < total:
            n = min(self.item, total - at, full - self.held)
            self.items.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at += n
            if self.held == full:
                self.close()

    def close(self) -> None:
        where, sums = windows([len(x[2]) // 4 for x in self.items], self.window)
        offsets = [0] * len(sums)
        for piece, w in zip(self.items, where.tolist(), strict=True):
            offsets[w] = self.place(piece, self.next + w, offsets[w])
        self.next += len(sums)
        self.items, self.held = [], 0

    def split(self, n: int) -> list[tuple]:
        """Takes n tokens off the end of the items."""
        taken = []
        while n:
            doc, start, ids, total = self.items.pop()
            if len(ids) // 4 > n:
                keep = len(ids) // 4 - n
                self.items.append((doc, start, ids[: 4 * keep], total))
                start, ids = start + keep, ids[4 * keep :]
            taken.append((doc, start, ids, total))
            n -= len(ids) // 4
            self.held -= len(ids) // 4
        return taken[::-1]

    def end(self) -> None:
        fill = self.window - self.slack
        rest = self.split(self.held % fill) if self.held else []
        if self.items:
            self.close()
        self.items, self.held = rest, sum(len(x[2]) // 4 for x in rest)
        while self.held:
            offset = 0
            for piece in self.split(1 << (self.held.bit_length() - 1)):
                offset = self.place(piece, self.next, offset)
            self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split(" ")[0] for x in KINDS.split(", ")])


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, item: int = ITEM, group: int = GROUP, slack: int = SLACK, close: int = CLOSE) -> DataFrame:
    """A row for each piece: its document's ids before it, its length, their crc32, and its place."""
    path = path or default_path()
    end = np.asarray([close], dtype="<u4").tobytes()

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 33, window, item, group, slack)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                packer.add(doc, encode_bytes(text, path) + end)
            yield packer.take()
        packer.end()
        yield packer.take()

    return key_and_text(docs).mapInArrow(run, KINDS)

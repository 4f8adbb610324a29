"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces.

A text is cut into paragraphs and these into clauses of at most 256 characters; each has a digest whose
lowest nine bits are its length (a piece that occurs again counts as another). A
sketch adds each digest to three cells: count, sum of digests by xor, sum of checks by xor. The
fingerprint is the smallest sketch with the text's length. Two sketches are subtracted cell by cell and
peeled: a cell with one digest gives it, and it leaves its other cells. If cells remain, the pair
is done again with sketches four times as large. The likeness of two texts is the characters of
common pieces by those of all; two empty texts are alike (1).

Null text counts as empty. The next document is the one with the next smaller doc_id (null is the smallest; among equal ones by
a digest of the text, then by text), after the last the first. Documents are dealt out by ranges of this order, with a copy of
each range's first for the range before it, so that one shuffle of the texts is enough; a range streams by, some hundred
texts at a time, so neither its length nor rows that share a doc_id or have none are held in memory at once.

near_edited and near_next come from larger sketches of the same digests where the smallest can't be peeled; the
fingerprint that is returned is always the smallest.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, in_batches, key_and_text, partitions

CELLS, HASHES, GROW = 24, 3, 4
PIECE = re.compile(r"[^\n.,;:!?]{0,255}(?:[\n.,;:!?]|$|(?<=[^\n.,;:!?]))")
DOCS_PER_RANGE = 1024
#: Texts, and their characters, that a task has in hand at once.
CHUNK, CHUNK_CHARS = 512, 4_000_000


def pieces(text: str) -> list[str]:
    """Clauses with their closing mark, of at most 256 characters; together they are the text."""
    found = PIECE.findall(text)
    return [p for p in found if p]


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LENGTH = np.uint64(0x1FF)


class Digests:
    """Piece digests of many texts: flat, with the text that each belongs to."""

    def __init__(self, texts: list[str]):
        cut = [pieces(t) for t in texts]
        self.counts = np.fromiter(map(len, cut), np.int64, len(cut))
        self.owner = np.repeat(np.arange(len(cut)), self.counts)
        flat = [p for c in cut for p in c]
        digest = xxhash.xxh3_64_intdigest
        raw = np.fromiter((digest(p) for p in flat), np.uint64, len(flat))
        length = np.fromiter(map(len, flat), np.uint64, len(flat))
        order = np.lexsort((raw, self.owner))
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (raw[order][1:] != raw[order][:-1]) | (self.owner[order][1:] != self.owner[order][:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
        again = np.empty(len(flat), dtype=np.uint64)
        again[order] = (np.arange(len(flat)) - begin).astype(np.uint64)
        self.keys = (mix(raw + again * np.uint64(0x632BE59BD9B4E019), 1) & ~LENGTH) | length
        self.chars = np.fromiter(map(len, texts), np.int64, len(texts))


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each digest, one in each third."""
    third = cells // HASHES
    return [(mix(keys, 10 * cells + j) % np.uint64(third)).astype(np.int64) + j * third for j in range(HASHES)]


def checks(keys: np.ndarray, cells: int) -> np.ndarray:
    return (mix(keys, 10 * cells + 9) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Cells of n sketches, flat: counts, digests and checks."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        check, touched = checks(keys, self.cells), []
        for place in places(keys, self.cells):
            at = owner * self.cells + place
            np.add.at(self.count, at, np.int32(sign) if np.isscalar(sign) else sign.astype(np.int32))
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)
            touched.append(at)
        return np.concatenate(touched)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and digest of all that differ, and whether each sketch came out empty."""
        owners, keys = [], []
        look = np.flatnonzero(self.count)
        while len(look):
            look = look[(np.abs(self.count[look]) == 1)]
            look = look[self.check[look] == checks(self.key[look], self.cells)]
            if not len(look):
                break
            found = np.stack([(look // self.cells).astype(np.uint64), self.key[look]])
            _, first = np.unique(found, axis=1, return_index=True)
            owner, key, sign = look[first] // self.cells, self.key[look][first], self.count[look][first]
            look = np.unique(self.add(owner, key, -sign))
            owners.append(owner)
            keys.append(key)
        left = (self.count != 0) | (self.key != 0)
        done = ~left.reshape(self.n, self.cells).any(axis=1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *owners]), np.concatenate([none.astype(np.uint64), *keys]), done


def sketch(d: Digests, which: np.ndarray, cells: int) -> Sketches:
    """Sketches of the texts that `which` lists, in its order."""
    out = Sketches(len(which), cells)
    ends = np.cumsum(d.counts)
    n = d.counts[which]
    flat = np.repeat(ends[which] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(which) else np.zeros(0, np.int64)
    out.add(np.repeat(np.arange(len(which)), n), d.keys[flat])
    return out


def likeness(a: Digests, ia: np.ndarray, b: Digests, ib: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Of each pair of texts, by the characters of the digests that peeling recovers."""
    out = np.ones(len(ia))
    todo = np.arange(len(ia))
    while len(todo):
        gap = np.abs(a.counts[ia[todo]] - b.counts[ib[todo]])
        try_now = gap <= cells  # a larger gap can't be peeled
        now = todo[try_now]
        owner, key, done = sketch(a, ia[now], cells).minus(sketch(b, ib[now], cells)).peel()
        differ = np.bincount(owner, weights=(key & LENGTH).astype(float), minlength=len(now))
        both = (a.chars[ia[now]] + b.chars[ib[now]]).astype(float)
        out[now[done]] = np.where(both > 0, (both - differ) / np.maximum(both + differ, 1), 1.0)[done]
        todo = np.sort(np.concatenate([todo[~try_now], now[~done]]))
        cells *= GROW
    return out


def written(s: Sketches, chars: np.ndarray) -> list[str]:
    """Each sketch as text: its length in characters and its cells."""
    rows = zip(chars.tolist(), s.count.reshape(s.n, -1), s.key.reshape(s.n, -1), s.check.reshape(s.n, -1), strict=True)
    return [f"{n}:" + base64.b64encode(c.astype("<i4").tobytes() + k.astype("<u8").tobytes() + x.astype("<u4").tobytes()).decode() for n, c, k, x in rows]


def fingerprints(texts: list[str], cells: int = CELLS) -> tuple[Digests, list[str]]:
    d = Digests(texts)
    return d, written(sketch(d, np.arange(len(texts)), cells), d.chars)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


KINDS = "doc_id long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def compare_with_next(docs: DataFrame, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """For every document: fingerprints of its text and of its edited text, and the likenesses of both, and of its text and the next document's."""
    rows = key_and_text(docs)
    spark = docs.sparkSession
    # Ascending as doc_id falls; bits are turned, as the least number has no negative.
    place = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("place")
    ids = rows.select(place, F.xxhash64("text").alias("digest"))
    n = ids.count()
    per = max(docs_per_range, n // 100_000)
    # Two rows a range, at most 100,000 or so of them at any size: its ends.
    ends = F.struct("place", "digest")
    spread = ids.repartitionByRange(max(1, -(-n // per)), "place", "digest").groupBy(F.spark_partition_id().alias("part")).agg(F.min(ends).alias("low"), F.max(ends).alias("high"))
    found = sorted((tuple(r.high), tuple(r.low)) for r in spread.collect())
    if not found:
        return spark.createDataFrame([], KINDS)
    highs, before = [h for h, _ in found], {low: (k - 1) % len(found) for k, (_, low) in enumerate(found)}

    def deal(batches):
        for batch in batches:
            keys = list(zip(column(batch, "place").to_pylist(), column(batch, "digest").to_pylist(), strict=True))
            to = [bisect_left(highs, k) for k in keys]
            again = {k: i for i, k in enumerate(keys) if k in before}  # one of equal rows is enough
            part = batch.take(pa.array([*range(len(keys)), *again.values()], pa.int64()))
            to += [before[k] for k in again]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.int64()), pa.array([k >= len(keys) for k in range(len(to))])], ["doc_id", "text", "place", "digest", "part", "copy"])

    def work(ids: list, base: list[str], follow: str) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(base, [*base[1:], follow], strict=True)]
        d, prints = fingerprints([*base, follow])
        e, edited_prints = fingerprints(changed)
        n = np.arange(len(base))
        near, near_next = likeness(d, n, e, n), likeness(d, n, d, n + 1)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(changed), pa.array(prints[:-1]), pa.array(edited_prints), pa.array(near), pa.array(near_next), pa.array(base)], names=[x.split(" ")[0] for x in KINDS.split(", ")])

    def run(batches):
        ids, held, size, at = [], [], 0, None
        for batch in batches:
            for doc_id, text, part, copy in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "part", "copy")), strict=True):
                if part != at:
                    at, ids, held, size = part, [], [], 0
                if copy:
                    if held:
                        yield work(ids, held, text)
                    ids, held, size = [], [], 0  # further copies of the next range's first say the same
                    continue
                if len(held) >= CHUNK or size >= CHUNK_CHARS:
                    yield work(ids, held, text)
                    ids, held, size = [], [], 0
                ids.append(doc_id)
                held.append(text)
                size += len(text)

    dealt = rows.select("doc_id", "text", place, F.xxhash64("text").alias("digest")).mapInArrow(deal, "doc_id long, text string, place long, digest long, part long, copy boolean")
    spread = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "copy", "place", "digest", "text")
    return in_batches(spread.select("doc_id", "text", "part", "copy"), run, KINDS)

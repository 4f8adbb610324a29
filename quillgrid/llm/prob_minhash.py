"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document's elements are its runs of five words, weighted by how often they occur. Each element is a Poisson
process of that rate whose arrivals, drawn from its hash, fall on slots of the signature; a slot keeps its
earliest arrival, and an element stops once its next arrival is later than all slots. Two
documents agree in a slot with their probability Jaccard similarity (Ertl 2020). Bands of the signature
name candidates; the similarity of candidates is computed exactly from their shingles.

Candidates of a bucket are first its members with the leaders that they look near to by a bit of each slot; buckets that then still
hold several components are compared in full between components, as far as members look near, in blocks
whose pairs never leave the task. So no pair of different texts that shares a bucket and looks near is left out unless both are connected already;
a link looks near unless over 36 of its 125 bits differ, where 12.5 are expected at a similarity of 0.8 (a chance below one in 10^9).

Equal texts (in words and case folded) are one class. Null text counts as empty; texts without a word are one class.
Texts of fewer than five words have one element: all their words. Rows with one doc_id share a class, whatever their texts;
null doc_id takes no part in links and has a null class.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, free_name, in_batches, key_and_text, settled, stored, texts
from quillgrid.llm.components import components
from quillgrid.llm.fingerprints import mix
from quillgrid.llm.linking import crowded, links

#: APART: bits of a signature (one a slot) in which similar texts may differ.
WORDS, BANDS, ROWS, LEAST, APART = 5, 25, 5, 0.8, 36
#: Elements of sets that one set is compared with at once; ids that all tasks get, so that no other texts are shuffled.
AT_ONCE, IDS = 1 << 20, 1 << 20


def word_digests(lists: Iterable[Iterable[str]], n: int) -> np.ndarray:
    """The 64-bit digests of the n words in lists."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, n)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and count of the distinct shingles of each text, ordered by owner and digest."""
    split = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = word_digests(split, int(n.sum()))
    owner = np.repeat(np.arange(len(split)), n)
    begin = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(flat)) - begin
    size = np.repeat(n, n)
    run = np.zeros(len(flat), np.uint64)
    for k in range(words):
        have = np.flatnonzero(place + k < size)
        run[have] = mix(run[have] ^ flat[have + k], k + 1)
    use = (place == 0) | (place + words <= size)
    owner, run = owner[use], run[use]
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], run[first], np.diff(np.append(first, len(run)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """n x slots elements, by their earliest arrivals; 0 where a text has no element."""
    earliest = np.full(n * slots, np.inf)
    holder = np.zeros(n * slots, np.uint64)
    latest = np.full(n, np.inf)
    clock = np.zeros(len(owner))
    w, step = weight.astype(float), 0
    while len(owner):
        draw = (mix(element, 2 * step + 101) >> np.uint64(11)).astype(float) * 2.0**-53
        clock = clock - np.log1p(-draw) / w
        soon = clock < latest[owner]
        owner, element, w, clock = owner[soon], element[soon], w[soon], clock[soon]
        at = owner * slots + (mix(element, 2 * step + 102) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(earliest, at, clock)
        won = clock == earliest[at]
        holder[at[won]] = element[won]
        touched = np.unique(owner)
        latest[touched] = earliest.reshape(n, slots)[touched].max(axis=1)
        step += 1
    return holder.reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, slots = signature.shape
    parts = signature.reshape(n, bands, slots // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(slots // bands):
        key = mix(key ^ parts[:, :, k], 7)
    return key.astype(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets, given as ordered elements and weights."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_a, only_b = np.delete(wa, ia).sum(), np.delete(wb, ib).sum()
    pairs, times = np.unique(np.stack([wa[ia], wb[ib]]), axis=1, return_counts=True)
    x, y = pairs.astype(float)
    total = np.maximum(x[None, :] / x[:, None], y[None, :] / y[:, None]) @ times + only_a / x + only_b / y
    return float((times / total).sum())


def similar_to(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which of the others have at least that similarity with one.

    Of two elements' arrivals the ratio of their weights tells which set's decides: an element's total is the weights here of those of its ratio and above by its own, and the weights there of those below by its other
    one. So with common elements ordered by ratio, running sums give all totals. No more than the share of either's weights that is common can be similar.
    """
    element, weight = one
    owner = np.repeat(np.arange(len(others)), [len(e) for e, _ in others])
    found = np.concatenate([e for e, _ in others])
    at = np.minimum(np.searchsorted(element, found), len(element) - 1)
    both = element[at] == found
    x, y, who = weight[at[both]].astype(float), np.concatenate([w for _, w in others])[both].astype(float), owner[both]
    n, all_x, all_y = len(others), float(weight.sum()), np.asarray([w.sum() for _, w in others], float)
    in_x, in_y = np.bincount(who, x, n), np.bincount(who, y, n)
    maybe = (in_x >= least * all_x - 1e-6) & (in_y >= least * all_y - 1e-6)
    use = maybe[who]
    x, y, who = x[use], y[use], who[use]
    if not len(who):
        return maybe
    ratio = x / y
    order = np.lexsort((ratio, who))
    x, y, who, ratio = x[order], y[order], who[order], ratio[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (ratio[1:] != ratio[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of those with the same owner and ratio
    begin = np.searchsorted(who, who)
    before_x, before_y = (np.append(0, np.cumsum(v))[first] - np.append(0, np.cumsum(v))[begin] for v in (x, y))
    total = (all_x - before_x) / x + (before_y + (all_y - in_y)[who]) / y
    likeness = np.bincount(who, 1 / total, n)
    for k in np.flatnonzero(maybe & (np.abs(likeness - least) < 1e-9)).tolist():
        likeness[k] = similarity(element, weight, *others[k])
    return likeness >= least


def as_bytes(element: np.ndarray, weight: np.ndarray) -> bytes:
    """Elements and weights; the latter only if one isn't 1."""
    tail = b"" if (weight == 1).all() else weight.astype("<u4").tobytes()
    return len(element).to_bytes(4, "little") + element.astype("<u8").tobytes() + tail


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    tail = np.frombuffer(data, "<u4", -1, 4 + 8 * n)
    return np.frombuffer(data, "<u8", n, 4), tail.astype(np.int64) if len(tail) else np.ones(n, np.int64)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether texts with rows a and b of signature bits look near."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1) <= APART


def _sketches(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, a digest of the folded words, the band keys of every row, and a bit of each of the first 128 slots."""

    def run(batches):
        for batch in batches:
            held = texts(batch)
            owner, element, weight = shingles(held, words)
            signature = signatures(owner, element, weight, len(held), bands * per_band)
            keys = band_keys(signature, bands)
            bits = np.zeros((len(held), 128), np.uint8)
            few = min(128, bands * per_band)
            bits[:, :few] = signature[:, :few] & np.uint64(1)
            bits = np.packbits(bits, axis=1).view(np.int64)
            same = [xxhash.xxh3_128_digest(" ".join(t.lower().split())) for t in held]
            some = np.isin(np.arange(len(held)), owner)
            listed = [k.tobytes() if s else b"" for k, s in zip(keys, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(listed, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["doc_id", "same", "keys", "high", "low"])

    return in_batches(rows, run, "doc_id long, same binary, keys binary, high long, low long")


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, node, high and low: a row for each band."""

    def run(batches):
        for batch in batches:
            held = column(batch, "keys").to_pylist()
            times = np.fromiter((len(k) // 8 for k in held), np.int64, len(held))
            rest = [np.repeat(np.asarray(column(batch, c)), times) for c in ("node", "high", "low")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.frombuffer(b"".join(held), np.int64), *rest)], ["key", "node", "high", "low"])

    return in_batches(nodes.select("node", "keys", "high", "low"), run, "key long, node long, high long, low long")


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """node, content (its shingles) and a digest of the folded words."""

    def run(batches):
        for batch in batches:
            held = texts(batch)
            owner, element, weight = shingles(held, words)
            ends = np.searchsorted(owner, np.arange(len(held) + 1))
            sets = [as_bytes(element[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            same = [xxhash.xxh3_128_digest(" ".join(t.lower().split())) for t in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(same, pa.binary())], ["node", "content", "same"])

    return in_batches(rows, run, "node long, content binary, same binary")


def similar_pairs(sets: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs at least that similar, enough to connect what they connect, of sets with different roots (and on different sides, if there are two).

    Common elements of all pairs come from products of incidence matrices, a few thousand elements at a time; a set with
    weights other than 1 is compared with all others that it isn't connected with at once.
    """
    n = len(sets)
    element = np.concatenate([e for e, _ in sets])
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    _, number, times = np.unique(element, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    often = times[number] > 1
    number, owner = rank[number[often]], owner[often]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    width = 2048
    cuts = np.searchsorted(number, np.arange(0, number[-1] + 1 + width, width)) if len(number) else [0]
    for k in range(len(cuts) - 1):
        part = np.zeros((n, width), np.float32)
        part[owner[cuts[k] : cuts[k + 1]], number[cuts[k] : cuts[k + 1]] - k * width] = 1
        common += part @ part.T
    size = np.asarray([len(e) for e, _ in sets], np.float64)
    union = size[:, None] + size[None, :] - common
    apart = np.triu((root[:, None] != root[None, :]) & ((side[:, None] != side[None, :]) | (side.min() == side.max())), 1)
    odd = np.asarray([(w != 1).any() for _, w in sets])
    plain = ~odd[:, None] & ~odd[None, :]
    label, out = root.copy(), []

    def unite(i: int, j: int) -> None:
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            out.append((int(i), int(j)))

    for i, j in zip(*np.nonzero(apart & plain & (common >= least * union - 1e-6)), strict=True):
        unite(i, j)
    # Then the weighted ones: a set with all those at a time that it may be linked with and isn't connected with yet.
    shared = apart & ~plain & (common > 0)
    for i in np.flatnonzero(shared.any(axis=1)).tolist():
        some = np.flatnonzero(shared[i] & (label != label[i]))
        lot = np.cumsum(size[some]) // AT_ONCE
        for g in np.unique(lot):
            few = some[lot == g]
            for j in few[similar_to(sets[i], [sets[j] for j in few.tolist()], least)].tolist():
                unite(i, j)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, bands: int = BANDS, per_band: int = ROWS, least: float = LEAST) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class."""
    rows = key_and_text(docs)
    made = _sketches(rows, words, bands, per_band)
    sketched = stored(made.filter(F.col("doc_id").isNotNull()))
    again = repeated(sketched)
    # Equal texts first: one node for each, so that links are between different texts only.
    nodes = stored(sketched.groupBy("same").agg(F.min("doc_id").alias("node"), F.max("keys").alias("keys"), F.max("high").alias("high"), F.max("low").alias("low")))
    member = sketched.select("doc_id", "same").join(nodes.select("same", "node"), "same").select("doc_id", "node")
    members = settled(crowded(_buckets(nodes)))

    def contents(wanted: DataFrame) -> DataFrame:
        wanted = settled(wanted)
        ids = F.broadcast(wanted) if wanted.count() <= IDS else wanted
        sets = _shingle_sets(rows.join(ids, rows.doc_id == wanted.node, "left_semi"), words)
        if again is not None:  # a doc_id may have several texts, and rows of one text
            sets = sets.dropDuplicates(["node", "same"])
        return sets.select("node", "content")

    def verify(a: pa.Array, b: pa.Array) -> list[bool]:
        return [similarity(*from_bytes(x), *from_bytes(y)) >= least for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]

    def pairs(held: pa.Array, root: np.ndarray, side: np.ndarray, _: np.ndarray) -> list[tuple[int, int]]:
        return similar_pairs([from_bytes(x) for x in held.to_pylist()], root, side, least)

    found = links(members, ["high", "low"], near, contents, verify, pairs)
    if again is not None:
        # Rows of one doc_id are one document: its texts' nodes are tied to the doc_id.
        member = settled(member)
        found = found.unionByName(member.join(again, "doc_id").filter("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    out = member.join(components(found), "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    none = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(none)


def repeated(rows: DataFrame) -> DataFrame | None:
    """doc_ids that occur more than once, if there are any."""
    found = rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    found = settled(found)
    return None if found.isEmpty() else found


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, one a class (of several rows with that doc_id, one of least text digest); rows with a null doc_id stay."""
    again = repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    classes = near_duplicates(docs, **options).filter("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_semi")
    if again is not None:
        row = free_name(docs, "row")
        first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.xxhash64("text"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias(row)
        kept = kept.groupBy(F.col("doc_id").cast("long")).agg(first).select(f"{row}.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))

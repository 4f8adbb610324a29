"""Suffix-array dedup: bytes of 100-byte strings that start earlier, too.

Sampling of suffixes: each string of `length` bytes has an anchor, its 32-byte piece of least hash (the first of
equals); equal strings have equal anchors at equal places. The strings with one anchor lie next to each other and
form its segment. Anchors are dealt out by their digests; segments that are equal as a whole become one,
with its first occurrence. Where different segments share an anchor, all their suffixes of `length` bytes or more are
sorted, deep-shallow: multikey quicksort on eight-byte words to a shallow depth, then blind tries for groups that are
still equal. Neighbours in this order with `length` common bytes are one string; all but its first start are marked.

Segments are taken for equal if the 64-bit digests of both anchor and segment are.

Order of starts: doc_id (null last), then place; rows with one doc_id follow by a 64-bit digest of their texts, and rows
equal in doc_id and text are treated alike, as one. Null text counts as empty; texts shorter than `length` stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, discard, free_name, in_batches, partitions, settled, stored, texts, whole_text
from quillgrid.llm.linking import groups

LENGTH, GRAM = 100, 32
#: Bytes that multikey quicksort looks at before the blind tries.
SHALLOW = 32
#: Segments of different text that one task sorts for one anchor; anchors with more are done string by string.
MOST_SEGMENTS = 50_000
#: Texts with segments to sort are picked by a broadcast of up to this many doc_ids, more by a shuffle.
BROADCAST_DOCS = 1_000_000
#: Fixed values of the rolling hash: an odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (ends: where each ends): text, place of the anchor, first and last start of its strings, digests of anchor and segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    code = TABLE[data]
    h, size, base = code, 1, BASE
    while size < gram:
        h = h[: len(h) - size] * np.uint64(base) + h[size:]
        size, base = 2 * size, base * base % (1 << 64)
    h = mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by start of the string
    begins = np.concatenate([[0], ends[:-1]])
    good = np.zeros(n + 1, np.int32)  # starts whose string lies in one text
    some = ends - begins >= length
    np.add.at(good, begins[some], 1)
    np.add.at(good, ends[some] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(good)[: len(at)] > 0)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = at[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low, high, place = starts[first], starts[np.append(first[1:], len(starts)) - 1], a[first]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(code * powers(BASE, n)[:n], out=sums[1:])
    whole = mix((sums[high + length] - sums[low]) * powers(UNBASE, n)[low] + (high - low).astype(np.uint64))
    text = np.searchsorted(ends, low, side="right")
    return text, place - begins[text], low - begins[text], high - begins[text], h[place], whole


class BlindTrie:
    """Orders strings that share a prefix: inner nodes hold only where their strings part, strings are compared once."""

    def __init__(self, first: bytes, name: int):
        self.root: list = [first, [name]]  # a leaf: its string and the names of equals

    def insert(self, s: bytes, name: int) -> None:
        node = self.root
        while isinstance(node[1], dict):  # blind: only the bytes where strings part
            way = node[1]
            node = way.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(way.values()))
        t, n = node[0], 0
        if s == t:
            node[1].append(name)
            return
        most = min(len(s), len(t))
        while n < most and s[n] == t[n]:
            n += 1
        new = [s, [name]]
        mine = s[n] if n < len(s) else -1
        above, key, node = None, None, self.root
        while isinstance(node[1], dict) and node[0] < n:
            above, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node[1], dict) and node[0] == n:
            node[1][mine] = new
            return
        fork = [n, {mine: new, (t[n] if n < len(t) else -1): node}]
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                out += node[1]
        return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows (bytes, sizes[i] of them count) by group and content, shorter first.

    Multikey quicksort on words of eight bytes up to `shallow` bytes: each unfinished interval is split in three by the word of a
    pivot at its depth, all intervals in one go; the middle part goes on one word deeper. Intervals that are
    equal down to `shallow` are ordered by blind tries.
    """
    n, width = rows.shape
    deepest = min(shallow, width) // 8
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, group))  # what follows is stable, so shorter ones stay first
    ends = np.append(np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])), n) if n else np.zeros(1, np.int64)
    low, high = ends[:-1], ends[1:]
    depth, done = np.zeros(len(low), np.int64), []
    while True:
        several = high - low > 1
        deep = several & (depth >= deepest)
        done += list(zip(low[deep].tolist(), high[deep].tolist(), strict=True))
        low, high, depth = (x[several & ~deep] for x in (low, high, depth))
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)  # places in the order
        pivot = words[order[(low + high) // 2], depth]
        word = words[order[at], depth[owner]]
        side = np.where(word < pivot[owner], 0, np.where(word == pivot[owner], 1, 2))
        part = owner * 3 + side
        order[at] = order[at][np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(low)).reshape(-1, 3)
        cuts = low[:, None] + np.concatenate([np.zeros((len(low), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        low, high = cuts[:, :3].ravel(), cuts[:, 1:].ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
    for a, b in done:
        names = order[a:b].tolist()
        strings = [rows[k, deepest * 8 : max(int(sizes[k]), deepest * 8)].tobytes() for k in names]
        trie = BlindTrie(strings[0], names[0])
        for s, k in zip(strings[1:], names[1:], strict=True):
            trie.insert(s, k)
        order[a:b] = trie.order()
    return order


def _common(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes of each row with the one before it in the order; -1 where its group begins."""
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    n = np.minimum(n, np.minimum(sizes[a], sizes[b]))
    return np.concatenate([[-1], np.where(group[a] == group[b], n, -1)])


def _context(data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of bytes from begin on, forwards or backwards, with zeros behind their size."""
    at = begin[:, None] + step * np.arange(width)[None, :]
    fine = np.arange(width)[None, :] < size[:, None]
    return np.where(fine, data[np.where(fine, at, 0)], 0).astype(np.uint8) if len(data) else np.zeros((len(begin), width), np.uint8)


def repeats(group: np.ndarray, data: np.ndarray, begin: np.ndarray, back: np.ndarray, ahead: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For segments in order of occurrence within groups: most and least bytes before the anchor of strings that occur in an earlier segment, or -1.

    begin: place of the segment in data; back: bytes before its anchor; ahead: bytes behind the anchor.
    """
    n, width = len(group), length - gram
    most, least = np.full(n, -1), np.full(n, -1)
    right = _context(data, begin + back + gram, ahead, 1, width)
    left = _context(data, begin + back - 1, back, -1, width)
    ranks = []
    for rows, sizes in ((left, back), (right, ahead)):
        order = deep_shallow(group, rows, sizes)
        ranks.append((order, _common(group, rows, sizes, order)))
    for o in range(width + 1):  # bytes of the string before the anchor
        use = np.flatnonzero((back >= o) & (ahead >= width - o))
        if len(use) < 2:
            continue
        classes = []
        for (order, common), depth in zip(ranks, (o, width - o), strict=True):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(common < depth)
            classes.append(c[use])
        _, first, which = np.unique(classes[0] * (n + 1) + classes[1], return_index=True, return_inverse=True)
        hit = use[first[which] != np.arange(len(use))]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, least


NEVER = (1 << 63) - 1
#: Marks the packed place of a segment that is known as a copy.
COPY = 1 << 62


def _packed(place, back, span):
    return place << 14 | back << 7 | span


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the anchor, bytes before it in its segment, and starts of strings less one."""
    return packed >> 14, packed >> 7 & 127, packed & 127


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """doc (doc_id, null as the largest number) and tie (0 if doc_ids are unique, else a digest of the text)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER))
    again = docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return doc, (F.xxhash64(F.coalesce("text", F.lit(""))) if again else F.lit(0)).cast("long")


KINDS = ["key", "doc", "tie", "packed"]


def _anchor_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = [t.encode() for t in texts(batch)]
            ends = np.cumsum([len(r) for r in raw])
            text, place, low, high, key, whole = anchors(np.frombuffer(b"".join(raw), np.uint8), ends, length, gram)
            packed = _packed(place, place - low, high - low)
            key, whole = key.view(np.int64), whole.view(np.int64)
            doc, tie = (np.asarray(column(batch, c))[text] for c in ("doc", "tie"))
            # Copies within the batch are no first occurrences wherever else the segment is: they go their own way, spread evenly.
            order = np.lexsort((packed, tie, doc, whole, key))
            a, b = order[:-1], order[1:]
            same = (key[a] == key[b]) & (whole[a] == whole[b])
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0)) if len(order) else order
            apart = [x[order] != x[order][first] for x in (doc, tie, packed)]
            copy = np.concatenate([[False], same]) & (apart[0] | apart[1] | apart[2]) if len(order) else np.zeros(0, dtype=bool)
            hit = order[copy]
            key, whole, packed = key.copy(), whole.copy(), packed.copy()
            key[hit] = mix((doc[hit] ^ tie[hit] ^ packed[hit] << 20).astype(np.uint64)).view(np.int64)
            whole[hit] = 0
            packed[hit] |= COPY
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, whole, doc, tie, packed)], ["key", "whole", "doc", "tie", "packed"])

    return in_batches(keyed, run, "key long, whole long, doc long, tie long, packed long")


def _first_and_copies(rows: DataFrame) -> DataFrame:
    """One shuffle by anchor: copies of a segment (key null), and the first of each if its anchor has several."""

    def run(batches):
        first = None  # key, whole, doc, tie and packed of the first row of the segment at hand
        held, told = None, True  # the last first row, and whether it was given
        for batch in batches:
            if not batch.num_rows:
                continue
            key, whole, doc, tie, packed = (np.asarray(column(batch, n)) for n in ("key", "whole", "doc", "tie", "packed"))
            told_copy = packed >= COPY
            if told_copy.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(told_copy.sum()), pa.int64()), *(pa.array(x[told_copy]) for x in (doc, tie, packed ^ COPY))], KINDS)
                key, whole, doc, tie, packed = (x[~told_copy] for x in (key, whole, doc, tie, packed))
                if not len(key):
                    continue
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
            goes_on = first is not None and first[:2] == (int(key[0]), int(whole[0]))
            new[0] = not goes_on
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            apart = [x != np.where(at >= 0, x[at], f) for x, f in zip((doc, tie, packed), first[2:] if goes_on else (0, 0, 0), strict=True)]
            copy = ~new & (apart[0] | apart[1] | apart[2])
            if copy.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(copy.sum()), pa.int64()), *(pa.array(x[copy]) for x in (doc, tie, packed))], KINDS)
            heads = np.flatnonzero(new)
            if len(heads):
                k = key[heads]
                before = held is not None and held[0] == int(k[0])
                if before and not told:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], KINDS)
                keep = np.zeros(len(k), dtype=bool)
                keep[0] = before
                keep[1:] |= k[1:] == k[:-1]
                keep[:-1] |= k[1:] == k[:-1]
                if keep.any():
                    h = heads[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x[h]) for x in (key, doc, tie, packed)], KINDS)
                last = heads[-1]
                held, told = (int(key[last]), int(doc[last]), int(tie[last]), int(packed[last])), bool(keep[-1])
                first = (int(key[last]), int(whole[last]), int(doc[last]), int(tie[last]), int(packed[last]))

    spread = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "whole", "doc", "tie", "packed")
    return in_batches(spread, run, "key long, doc long, tie long, packed long")


def _segments(keyed: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of the segments. Repeated rows give theirs more than once."""
    by_doc = firsts.groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "packed")).alias("segments"))
    wanted = settled(by_doc.select("doc").distinct())
    # Eight bytes each, at most BROADCAST_DOCS of them.
    near = keyed.join(F.broadcast(wanted), "doc", "left_semi") if wanted.count() <= BROADCAST_DOCS else keyed

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, tie, text, found in zip(*(column(batch, c).to_pylist() for c in ("doc", "tie", "text", "segments")), strict=True):
                raw = text.encode()
                for s in found:
                    place, back, span = _unpacked(s["packed"])
                    for x, v in zip(out, (s["key"], doc, tie, s["packed"], raw[place - back : place - back + span + length]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], [*KINDS, "bytes"])

    return in_batches(near.join(by_doc, ["doc", "tie"]).select("doc", "tie", "text", "segments"), run, "key long, doc long, tie long, packed long, bytes binary")


MARKS = "doc long, tie long, begin long, finish long"


def _sorted_marks(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """Sorts the segments of each anchor and marks what occurs in an earlier one."""

    def done(t: pa.Table) -> pa.RecordBatch:
        key, doc, tie, packed = (np.asarray(column(t, c)) for c in KINDS)
        once = np.ones(len(key), dtype=bool)  # repeated rows have given the same segment again
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (packed[1:] != packed[:-1])
        key, doc, tie, packed = (x[once] for x in (key, doc, tie, packed))
        held = column(t, "bytes").filter(pa.array(once))
        place, back, span = _unpacked(packed)
        sizes = np.asarray(pc.binary_length(held)).astype(np.int64)
        data = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        most, least = repeats(group, data, np.cumsum(sizes) - sizes, back, sizes - back - gram, length, gram)
        hit = most >= 0
        arrays = (doc[hit], tie[hit], (place - most)[hit], (place - least)[hit] + length)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], ["doc", "tie", "begin", "finish"])

    def run(batches):
        yield from map(done, groups(batches, ["key"], 20_000))

    spread = segments.repartition(partitions(segments.sparkSession), "key").sortWithinPartitions(*KINDS)
    return in_batches(spread, run, MARKS)


def _hot_marks(segments: DataFrame, length: int) -> DataFrame:
    """Anchors with too many segments for a task: string by string, summed up before the shuffle."""

    def strings(batches):
        for batch in batches:
            for doc, tie, packed, raw in zip(*(column(batch, c).to_pylist() for c in ("doc", "tie", "packed", "bytes")), strict=True):
                place, back, span = _unpacked(packed)
                digest = [hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in range(span + 1)]
                n = span + 1
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([doc] * n), pa.array([tie] * n), pa.array([place - back + k for k in range(n)])], ["digest", "doc", "tie", "begin"])

    rows = in_batches(segments, strings, "digest binary, doc long, tie long, begin long")
    order = F.struct("doc", "tie", "begin")
    first = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return rows.join(first, "digest").filter(order != F.col("first")).select("doc", "tie", "begin", (F.col("begin") + length).alias("finish"))


def marks(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_SEGMENTS) -> DataFrame:
    """doc, tie, begin and finish: bytes of repeated strings, in overlapping pieces (stored). keyed: doc, tie and text."""
    told = stored(_first_and_copies(_anchor_rows(keyed, length, gram)))
    place, back, span = _unpacked_columns(F.col("packed"))
    copies = told.filter("key IS NULL").select("doc", "tie", (place - back).alias("begin"), (place - back + span + length).alias("finish"))
    firsts = told.filter("key IS NOT NULL")
    hot = settled(firsts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"))
    few = hot.isEmpty()
    found = copies.unionByName(_sorted_marks(_segments(keyed, firsts if few else firsts.join(hot, "key", "left_anti"), length), length, gram))
    if not few:
        found = found.unionByName(_hot_marks(_segments(keyed, firsts.join(hot, "key", "left_semi"), length), length))
    made = stored(found)
    discard(told)
    return made


def _unpacked_columns(packed: Column) -> tuple[Column, ...]:
    return F.shiftright(packed, 14), F.shiftright(packed, 7).bitwiseAND(127), packed.bitwiseAND(127)


def cut(raw: bytes, pieces: list[dict]) -> tuple[bytes, int]:
    """The bytes outside the pieces, and how many runs are removed."""
    kept, at, n = [], 0, 0
    end = -1
    for p in sorted(pieces, key=lambda p: p["begin"]):
        if p["begin"] > end:
            n += 1
            kept.append(raw[at : p["begin"]])
        end = max(end, p["finish"])
        at = end
    kept.append(raw[at:])
    return b"".join(kept), n


def dedup(docs: DataFrame, length: int = LENGTH, counts: bool = True) -> DataFrame:
    """The columns of docs with text as what is left of it, and, with counts, n_bytes, n_removed, n_spans and kept (the bytes), which replace columns of these names.

    Where a removal ends inside a character, its bytes in text give way to U+FFFD; kept has them. Text without a removal is the same, null included.
    """
    doc, tie = _keys(docs)
    own_doc, own_tie, own_pieces = (free_name(docs, c) for c in ("doc", "tie", "pieces"))
    pieces = marks(docs.select(doc.alias("doc"), tie.alias("tie"), whole_text()), length)
    pieces = pieces.groupBy(F.col("doc").alias(own_doc), F.col("tie").alias(own_tie)).agg(F.collect_list(F.struct("begin", "finish")).alias(own_pieces))
    here = (doc == F.col(own_doc)) & (tie == F.col(own_tie))
    joined = docs.join(pieces, here, "left").drop(own_doc, own_tie)
    fields = [f for f in docs.schema if not counts or f.name not in ("n_bytes", "n_removed", "n_spans", "kept")]
    names = [f.name for f in fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for batch in batches:
            text, found = column(batch, "text").to_pylist(), column(batch, own_pieces).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for t, p in zip(text, found, strict=True):
                raw = (t or "").encode()
                kept, n = cut(raw, p) if p else (raw, 0)
                for x, v in zip(out, (kept.decode(errors="replace") if p else t, len(raw), len(raw) - len(kept), n, kept), strict=True):
                    x.append(v)
            own = [pa.array(out[0], pa.string()) if c == "text" else column(batch, c) for c in names]
            if "n_chars" in names:
                at = names.index("n_chars")
                own[at] = pa.array([None if t is None else len(t) for t in out[0]]).cast(own[at].type)
            more = [*(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *more], [*names, "n_bytes", "n_removed", "n_spans", "kept"]) if counts else pa.RecordBatch.from_arrays(own, names)

    return in_batches(joined, run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary" if counts else kinds)

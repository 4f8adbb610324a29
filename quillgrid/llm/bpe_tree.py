"""BPE encoding and decoding by tree concatenation.

A long text is halved until its pieces are short enough; the pieces are encoded in parallel, on any
executor, and their encodings are joined in pairs up the tree. Around each join a window is
encoded again and grows until its tokens agree with those of both sides; if they never do, the
window ends as the whole of both sides. Shorter texts are encoded whole.

Why agreement is enough: BPE tokens in a row are the encoding of their text if every two neighbours
are the encoding of theirs, and each two neighbours of the result stand next to each other in an
encoding of a text around them. Three equal tokens at equal places, which begin pre-tokens alike,
are asked for.

Null text counts as empty. Rows with one doc_id stay apart. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, key_and_text, partitions, texts
from quillgrid.llm.wordbpe import default_path, encode_bytes, library

PIECE_CHARS = 16_384
WINDOW_CHARS = 48
#: Characters at either end of a piece whose tokens keep their places; joins beyond need the whole piece.
EDGE_CHARS = 400


@dataclass
class Encoding:
    """Tokens with their places in the text; opens: whether one begins a pre-token."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    opens: np.ndarray

    def cut(self, a: int, b: int) -> Encoding:
        return Encoding(self.ids[a:b], self.starts[a:b], self.ends[a:b], self.opens[a:b])


def concat(parts: list[Encoding]) -> Encoding:
    return Encoding(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "starts", "ends", "opens")))


def encode_piece(text: str, at: int, path: str) -> Encoding:
    got = library(path).encode(text, add_special_tokens=False)
    places = np.asarray(got.offsets, dtype=np.int64).reshape(-1, 2) + at
    words = np.asarray([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
    opens = np.ones(len(words), dtype=bool)
    opens[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return Encoding(np.asarray(got.ids, dtype=np.uint32), places[:, 0], places[:, 1], opens)


def edges(text: str, edge: int = EDGE_CHARS) -> tuple[int, int] | None:
    """Blanks near both ends of a piece, if it has them."""
    a, b = text.find(" ", edge), text.rfind(" ", 0, max(0, len(text) - edge))
    return (a, b) if 0 <= a < b else None


def with_edges(text: str, at: int, path: str, ids: np.ndarray | None = None) -> tuple[Encoding, bool]:
    """The encoding of a piece, and whether all its tokens have places.

    Between blanks near its ends, tokens have the place of the first blank and no length, which never
    agrees with a window's. ids: those of the whole piece, if they are known.
    """
    cut = edges(text)
    if cut is None:
        return encode_piece(text, at, path), True
    a, b = cut
    head, tail = encode_piece(text[:a], at, path), encode_piece(text[b:], at + b, path)
    inner = np.frombuffer(encode_bytes(text[a:b], path), "<u4") if ids is None else ids[len(head.ids) : len(ids) - len(tail.ids)]
    place = np.full(len(inner), at + a, dtype=np.int64)
    return concat([head, Encoding(inner.astype(np.uint32), place, place, np.zeros(len(inner), dtype=bool)), tail]), False


def packed(e: Encoding, at: int) -> bytes:
    """Places as gaps and lengths in the narrowest integers that hold them."""
    gaps = e.starts - np.concatenate([[at], e.ends[:-1]]) if len(e.ids) else e.starts
    both = np.concatenate([gaps, e.ends - e.starts])
    kind = "i1" if len(both) and np.abs(both).max() < 128 else "<i4"
    return kind[-1:].encode() + both.astype(kind).tobytes() + np.packbits(e.opens).tobytes()


def unpacked(ids: np.ndarray, data: bytes, at: int) -> Encoding:
    kind, n = ("i1", 1) if data[:1] == b"1" else ("<i4", 4), len(ids)
    both = np.frombuffer(data, kind[0], 2 * n, 1).astype(np.int64)
    ends = at + np.cumsum(both[:n] + both[n:])
    opens = np.unpackbits(np.frombuffer(data, np.uint8, -1, 1 + 2 * n * kind[1]), count=n).astype(bool)
    return Encoding(ids, ends - both[n:], ends, opens)


def agreement(side: Encoding, window: Encoding, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Indexes of the middle of three tokens that both encodings have, of those within [low, high).

    Places of the same token, so that side up to the first index and window from the second fit.
    """
    rows = {(s, e, i, o): k for k, (s, e, i, o) in enumerate(zip(window.starts.tolist(), window.ends.tolist(), window.ids.tolist(), window.opens.tolist(), strict=True))}
    a, b = np.searchsorted(side.starts, [low, high])
    near = side.cut(a, b)
    hits = [rows.get(x) for x in zip(near.starts.tolist(), near.ends.tolist(), near.ids.tolist(), near.opens.tolist(), strict=True)]
    found = None
    for k in range(1, len(hits) - 1):
        if hits[k] is not None and hits[k - 1] == hits[k] - 1 and hits[k + 1] == hits[k] + 1 and near.ends[k + 1] <= high:
            found = (a + k, hits[k])
            if not last:
                break
    return found


def join(left: Encoding, right: Encoding, text: str, begin: int, at: int, end: int, path: str) -> Encoding:
    """The encoding of text[begin:end] from those of text[begin:at] and text[at:end]."""
    width = WINDOW_CHARS
    while True:
        a, b = max(begin, at - width), min(end, at + width)
        window = encode_piece(text[a:b], a, path)
        edge = width // 4
        l = (0, 0) if a == begin else agreement(left, window, a + edge, at - edge, last=False)
        r = (len(right.ids) - 1, len(window.ids) - 1) if b == end else agreement(right, window, at + edge, b - edge, last=True)
        if l and r and l[1] <= r[1] + 1:
            head = left.cut(0, l[0])
            tail = right.cut(r[0] + 1, len(right.ids))
            return concat([head, window.cut(l[1], r[1] + 1), tail])
        width *= 2


def piece_bounds(n: int, depth: int) -> list[int]:
    return [k * n >> depth for k in range((1 << depth) + 1)]


def join_tree(parts: list[Encoding], bounds: list[int], text: str, path: str) -> Encoding:
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], text, bounds[k], bounds[k + 1], bounds[k + 2], path) for k in range(0, len(parts), 2)]
        bounds = bounds[::2]
    return parts[0]


def encode_long(text: str, path: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """The whole tree in one process; Spark runs the same steps over many."""
    depth = 0
    while len(text) > piece_chars << depth:
        depth += 1
    bounds = piece_bounds(len(text), depth)
    return join_tree([with_edges(text[a:b], a, path)[0] for a, b in zip(bounds, bounds[1:], strict=False)], bounds, text, path).ids


def encode(docs: DataFrame, path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit integers of each row's whole text."""
    path = path or default_path()
    rows = key_and_text(docs)

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_bytes(t, path) for t in texts(batch)], pa.binary())], ["doc_id", "ids"])

    def pieces(batches):
        for batch in batches:
            ids, places = [], []
            for text, at in zip(texts(batch), column(batch, "begin").to_pylist(), strict=True):
                made, whole = with_edges(text, at, path)
                ids.append(made.ids.astype("<u4").tobytes())
                places.append(packed(made, at) if whole else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(places, pa.binary())], [*batch.schema.names, "ids", "places"])

    def joined(group: pa.Table) -> pa.Table:
        row = group.sort_by("begin").to_pylist()
        parts = []
        for x in row:
            ids = np.frombuffer(x["ids"], "<u4")
            parts.append(unpacked(ids, x["places"], x["begin"]) if x["places"] else with_edges(x["text"], x["begin"], path, ids)[0])
        text = "".join(x["text"] for x in row)
        ids = join_tree(parts, [*(x["begin"] for x in row), len(text)], text, path).ids
        return pa.table({"doc_id": pa.array([row[0]["doc_id"]], pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    short = rows.filter(F.char_length("text") <= piece_chars).mapInArrow(whole, "doc_id long, ids binary")
    n, depth, k = F.col("n"), F.col("depth"), F.col("k")
    cut = (
        rows.withColumn("n", F.char_length("text").cast("long"))
        .filter(n > piece_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("depth", F.ceil(F.log2(n / piece_chars)).cast("int"))
        .withColumn("depth", F.when(n > F.lit(piece_chars) * F.pow(F.lit(2), depth), depth + 1).otherwise(depth).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, depth) - 1"))))
        .withColumn("begin", F.expr("shiftright(k * n, depth)"))
        .withColumn("end", F.expr("shiftright((k + 1) * n, depth)"))
        .select("row", "doc_id", "begin", F.expr("substring(text, cast(begin + 1 as int), cast(end - begin as int))").alias("text"))
    )
    kinds = "row long, doc_id long, begin long, text string, ids binary, places binary"
    spread = cut.repartition(partitions(docs.sparkSession), "row", "begin").mapInArrow(pieces, kinds)
    return short.unionByName(spread.groupBy("row").applyInArrow(joined, "doc_id long, ids binary"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds text: the library's decode(ids, skip_special_tokens=False). Null ids decode to the empty text."""
    path = path or default_path()

    def texts_of(batches):
        for batch in batches:
            back = library(path).decode
            ids = column(batch, "ids").to_pylist()
            for lo in range(0, max(len(ids), 1), 64):
                part = batch.slice(lo, 64)
                made = [back(np.frombuffer(x or b"", "<u4").tolist(), skip_special_tokens=False) for x in ids[lo : lo + 64]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*part.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(texts_of, f"{kinds}, text string")

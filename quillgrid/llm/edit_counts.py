"""Edit-aware token counts.

Each document keeps a tree over segments of pre-tokens; a leaf holds a segment's text, and each node the sums
of characters and ids below it. An edit finds its leaves from above, encodes only them
again (with the next segment where the edit took the blank between both) and renews the sums on the
way up. A segment ends after white space, so no id crosses two of them. What an edit leaves is cut into segments again; where these
are more than before, the sums above are renewed from the leaves' without encoding any.

Text without a blank is one segment. One of over LONG_CHARS keeps its ids and their places: an edit encodes a window around what it
puts, which grows until three ids on either side are those that were there (see bpe_tree: neighbours that stand side by side in an encoding stay valid).

Null text counts as empty: one empty leaf. A null list of edits is none; places beyond the end
mean the end. Rows with one doc_id are edited each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.bpe_tree import PIECE_CHARS, WINDOW_CHARS, Encoding, agreement, concat, encode_piece, join_tree, piece_bounds
from quillgrid.llm.common import column, texts, whole_text
from quillgrid.llm.wordbpe import count, default_path

SEGMENT_CHARS = 128
#: Segments beyond this length keep their ids.
LONG_CHARS = 1024
EDIT = "array<struct<at: long, remove: long, insert: string>>"


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cuts after a blank or line feed, `size` characters or a little more apart; without one, the text stays whole."""
    found, at = [], 0
    while len(text) - at > size:
        cuts = [c for c in (text.find(" ", at + size), text.find("\n", at + size)) if c >= 0]
        if not cuts:
            break
        found.append(text[at : min(cuts) + 1])
        at = min(cuts) + 1
    return [*found, text[at:]]


def whole_encoding(text: str, path: str) -> Encoding:
    """A long segment's ids with places, from pieces that are joined."""
    depth = 0
    while len(text) > PIECE_CHARS << depth:
        depth += 1
    bounds = piece_bounds(len(text), depth)
    return join_tree([encode_piece(text[a:b], a, path) for a, b in zip(bounds, bounds[1:], strict=False)], bounds, text, path)


def moved(e: Encoding, by: int) -> Encoding:
    return Encoding(e.ids, e.starts + by, e.ends + by, e.opens)


def spliced(text: str, left: Encoding | None, begin: int, right: Encoding | None, stop: int, path: str) -> tuple[Encoding, int]:
    """The encoding of a text, and the characters encoded for it. left: ids of an encoding that holds text[:begin] alike, those that end by begin; right: likewise of text[stop:]; None: not known."""
    width, spent = WINDOW_CHARS, 0
    while True:
        a = max(0, begin - width) if left else 0
        b = min(len(text), stop + width) if right else len(text)
        window, edge = encode_piece(text[a:b], a, path), width // 4
        spent += b - a
        l = (0, 0) if a == 0 else agreement(left, window, a + edge, begin - edge, last=False)
        r = (len(right.ids) - 1 if right else -1, len(window.ids) - 1) if b == len(text) else agreement(right, window, stop + edge, b - edge, last=True)
        if l and r and l[1] <= r[1] + 1:
            head = [left.cut(0, l[0])] if left else []
            tail = [right.cut(r[0] + 1, len(right.ids))] if right else []
            return concat([*head, window.cut(l[1], r[1] + 1), *tail]), spent
        width *= 2


class CountTree:
    """Sums of characters and ids over segments; encoded counts the characters given to the encoder, but for the joins of a long segment's first pieces."""

    def __init__(self, text: str, path: str, size: int = SEGMENT_CHARS, long: int = LONG_CHARS):
        self.path, self.size, self.long, self.encoded = path, size, long, 0
        leaves = segments(text, size)
        self._build(leaves, *self._counted(leaves))

    def _build(self, leaves: list[str], ids: list[int], held: list[Encoding | None]) -> None:
        self.leaves, self.held = leaves, held
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        spare = [0] * (self.width - len(leaves))
        self.chars, self.ids = [0] * self.width + [*map(len, leaves), *spare], [0] * self.width + [*ids, *spare]
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _counted(self, pieces: list[str]) -> tuple[list[int], list[Encoding | None]]:
        """Ids of each piece, and the encodings of long ones."""
        held = [whole_encoding(p, self.path) if len(p) > self.long else None for p in pieces]
        self.encoded += sum(map(len, pieces))
        return [len(e.ids) if e else count(p, self.path) if p else 0 for p, e in zip(pieces, held, strict=True)], held

    def _parted(self, pieces: list[str], whole: Encoding) -> tuple[list[int], list[Encoding | None]]:
        """The same from the encoding of the pieces' text: no id crosses two of them."""
        places = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        cuts = np.searchsorted(whole.starts, places)
        cuts[-1] = len(whole.ids)
        held = [moved(whole.cut(a, b), -int(at)) if len(p) > self.long else None for p, a, b, at in zip(pieces, cuts[:-1].tolist(), cuts[1:].tolist(), places[:-1], strict=True)]
        return np.diff(cuts).tolist(), held

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.ids[node] = self.ids[2 * node] + self.ids[2 * node + 1]

    def tokens(self) -> int:
        return self.ids[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the place in it; the end belongs to the last leaf with text."""
        node, at = 1, min(at, self.chars[1])
        if at and at == self.chars[1]:
            leaf, inside = self.find(at - 1)
            return leaf, inside + 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = max(0, min(at, self.chars[1]))
        remove = max(0, min(remove, self.chars[1] - at))
        first, begin = self.find(at)
        last, end = self.find(at + remove) if remove else (first, begin)
        put = self.leaves[first][:begin] + insert + self.leaves[last][end:]
        known, stop, gone = self.held[last], begin + len(insert), end  # what holds the put text's end, where it stands there, and what of it is gone
        while last + 1 < len(self.leaves) and not put.endswith((" ", "\n")):  # boundary context
            last += 1
            if self.leaves[last]:
                known, stop, gone = self.held[last], len(put), 0
            put += self.leaves[last]
        left, pieces = self.held[first], segments(put, self.size)
        if left or known:
            head = left.cut(0, int(np.searchsorted(left.ends, begin, side="right"))) if left else None
            tail = moved(known.cut(int(np.searchsorted(known.starts, gone)), len(known.ids)), stop - gone) if known else None
            whole, spent = spliced(put, head, begin, tail, stop, self.path)
            self.encoded += spent
            counts, held = self._parted(pieces, whole)
        else:
            counts, held = self._counted(pieces)
        if len(pieces) > last + 1 - first:
            ids = self.ids[self.width : self.width + len(self.leaves)]
            made = [*zip(self.leaves[:first], ids[:first], self.held[:first], strict=True), *zip(pieces, counts, held, strict=True), *zip(self.leaves[last + 1 :], ids[last + 1 :], self.held[last + 1 :], strict=True)]
            made = [x for x in made if x[0]]
            self._build([x for x, _, _ in made], [n for _, n, _ in made], [e for _, _, e in made])
            return
        for k in range(first, last + 1):
            self.leaves[k] = pieces[k - first] if k - first < len(pieces) else ""
            self.held[k] = held[k - first] if k - first < len(pieces) else None
            self.chars[self.width + k], self.ids[self.width + k] = len(self.leaves[k]), counts[k - first] if k - first < len(pieces) else 0
        nodes = range((self.width + first) // 2, (self.width + last) // 2 + 1)
        while nodes and nodes[0] >= 1:
            for node in nodes:
                self._sum(node)
            nodes = range(nodes[0] // 2, nodes[-1] // 2 + 1)


def apply(text: str, edits: list[dict]) -> str:
    """The edited text without a tree."""
    for e in edits or []:
        at = max(0, min(e["at"] or 0, len(text)))
        text = text[:at] + (e["insert"] or "") + text[at + max(0, e["remove"] or 0) :]
    return text


def edit_counts(docs: DataFrame, edits: Column, path: str | None = None, size: int = SEGMENT_CHARS) -> DataFrame:
    """doc_id, counts before and after the edits (made one after the other), characters encoded for each, and the edited text."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), edits.cast(EDIT).alias("edits"), whole_text())

    def run(batches):
        for batch in batches:
            made = []
            for text, todo in zip(texts(batch), column(batch, "edits").to_pylist(), strict=True):
                tree = CountTree(text, path, size)
                before, built = tree.tokens(), tree.encoded
                for e in todo or []:
                    tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                made.append((before, tree.tokens(), len(todo or []), built, tree.encoded - built, tree.text()))
            columns = list(zip(*made, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "edited_tokens", "n_edits", "chars_built", "chars_reencoded", "edited_text"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, edited_tokens long, n_edits long, chars_built long, chars_reencoded long, edited_text string")


def sample_edits() -> Column:
    """Three edits for any document: a removal, an insertion and a replacement, at its quarters."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    rows = [(n / 4, 40, ""), (n / 2, 0, " revised in review, "), (3 * n / 4, 12, "replaced")]
    return F.array(*(F.struct(F.floor(at).cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert")) for at, remove, insert in rows))

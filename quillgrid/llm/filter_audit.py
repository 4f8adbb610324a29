"""How five filters of documents interact, in every order they can be applied.

Texts are scanned in Arrow buffers: a table gives each byte its classes (blank, capital, symbol, later byte of a character), prefix sums over a batch count words,
capitals, symbols and code points of each document, and words become 64-bit hashes of their bytes, eight at a time. Sorted within each document,
equal neighbours are compared byte by byte, so that a collision is seen (that document's words are then counted as a set). What a document fails is a
mask of bits; what any order of the filters does follows from the counts of each part's 32 masks.

A: under 50 words. B: fewer distinct words than 65 in 100. C: more capitals A to Z than 5 in 100 code points. D: holds one of # $ % & * |. E: another row with the same
text has a smaller doc_id, anywhere in the table and whatever the filters do to it. Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and return.

Null text is empty, a null part the empty string. Rows with a null doc_id are neither smaller nor larger than others, so they don't fail E; rows of one doc_id
and text don't fail E by each other. Repeated labels count if any of them says 1. An empty table gives no rows.

Texts are compared by their SHA-256. Copies meet as sums: rows are first added up by doc_id, text and part, then by text, part and labels, so that a text that a third of all
rows share comes to the join as one row for each part and label.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import column, in_batches, prepare, settled

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
BLANK, CAPITAL, SYMBOL, LATER = 1, 2, 4, 8
#: Classes of each byte.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] |= BLANK
KINDS[ord("A") : ord("Z") + 1] |= CAPITAL
KINDS[list(SYMBOLS)] |= SYMBOL
KINDS[0x80:0xC0] |= LATER
#: Words up to so many bytes are hashed in lanes of eight.
LANES = 8
LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, eight zeros behind them, and where each text begins (and the last ends)."""
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.zeros(int(at[-1] - at[0]) + 8, dtype=np.uint8)
    if data is not None:
        held[:-8] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return held, at - at[0]


def sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each document's bytes the mask holds for."""
    before = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=before[1:])
    return before[at[1:]] - before[at[:-1]]


def word_spans(blank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (plus one) of each word; none goes across documents."""
    full = at[:-1] < at[1:]
    edge = np.ones(len(blank) + 1, dtype=bool)
    edge[1:] = np.append(blank[:-1], True) if len(blank) else True
    opens, closes = edge[: len(blank)].copy(), np.append(blank[1:], True)[: len(blank)]
    opens[at[:-1][full]] = True
    closes[at[1:][full] - 1] = True
    return np.flatnonzero(~blank & opens), np.flatnonzero(~blank & closes) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def distinct_words(held: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int, bits: int = 40) -> np.ndarray:
    """Distinct words of each document, from hashes of `bits` bits that are sorted within it; equal neighbours are verified."""
    length = end - start
    lanes = np.ndarray((len(held) - 7,), dtype="<u8", buffer=held, strides=(1,))
    lane = lambda k, w: lanes[start[w] + 8 * k] & LANE_MASK[np.minimum(length[w] - 8 * k, 8)]
    first = lane(0, slice(None))
    h = mixed(first ^ (length.astype(np.uint64) << np.uint64(48)))
    for k in range(1, LANES):
        w = np.flatnonzero(length > 8 * k)
        if not len(w):
            break
        h[w] = mixed(h[w] ^ lane(k, w))
    whole = lambda w: held[start[w] : end[w]].tobytes()
    for w in np.flatnonzero(length > 8 * LANES).tolist():
        h[w] = int.from_bytes(hashlib.blake2b(whole(w), digest_size=8).digest(), "little")
    key = (doc.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    order = np.argsort(key)
    key = key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[twin], order[twin + 1]
    same = (length[a] == length[b]) & (first[a] == first[b])
    for k in range(1, LANES):
        more = np.flatnonzero(same & (length[a] > 8 * k))
        if not len(more):
            break
        same[more] = lane(k, a[more]) == lane(k, b[more])
    for x in np.flatnonzero(same & (length[a] > 8 * LANES)).tolist():
        same[x] = whole(a[x]) == whole(b[x])
    found = np.bincount(doc, minlength=docs) - np.bincount(doc[a[same]], minlength=docs)
    for d in np.unique(doc[a[~same]]).tolist():  # hashes that collide
        found[d] = len({whole(w) for w in np.flatnonzero(doc == d).tolist()})
    return found


def measures(texts: pa.Array, bits: int = 40) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_symbols and n_chars of each text."""
    held, at = buffers(texts)
    kinds = KINDS[held[:-8]]
    start, end = word_spans(kinds & BLANK > 0, at)
    words = np.diff(np.searchsorted(start, at))
    doc = np.repeat(np.arange(len(words)), words)
    found = distinct_words(held, start, end, doc, len(words), bits) if len(start) else np.zeros(len(words), dtype=np.int64)
    later = sums(kinds & LATER > 0, at)
    return {"n_words": words, "n_distinct": found, "n_capitals": sums(kinds & CAPITAL > 0, at), "n_symbols": sums(kinds & SYMBOL > 0, at), "n_chars": np.diff(at) - later}


def fails(m: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of what each text fails by itself: A to D, from the lowest bit."""
    failed = (m["n_words"] < LEAST_WORDS, 100 * m["n_distinct"] < LEAST_DISTINCT * m["n_words"], 100 * m["n_capitals"] > MOST_CAPITALS * m["n_chars"], m["n_symbols"] > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def scan(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, digest of the text, its counts and the mask of A to D, for every row."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = measures(column(batch, "text"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, pa.int64()) for v in m.values()), pa.array(fails(m), pa.int32())], [*batch.schema.names[:3], *m, "fails"])

    counts = "n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long"
    return in_batches(rows, run, f"doc_id long, part string, digest binary, {counts}, fails int")


def mask_counts(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (with E), n, good and toxic: documents of each part that fail just these filters."""
    # One row for each doc_id, part and text: then the least doc_id of a group has its count beside it.
    once = settled(scanned.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n")))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    # Rows without an id match no label; the spare key deals them out.
    spare = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("long"))
    told = once.withColumn("spare", spare).join(known.withColumn("spare", F.lit(0).cast("long")), ["doc_id", "spare"], "left")
    groups = told.groupBy("digest", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    )
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = groups.join(least, "digest").withColumn("later", F.col("named") - F.coalesce(firsts, F.lit(0)))
    bit = 1 << FILTERS.index("E")
    each = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails").alias("mask"), (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("fails") + bit).alias("mask"), F.col("later").alias("n")))).alias("m"))
    return each.select("part", F.col("m.mask").alias("mask"), F.col("m.n").alias("n"), (F.col("m.n") * F.col("good")).alias("good"), (F.col("m.n") * F.col("toxic")).alias("toxic")).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders() -> list[str]:
    return ["".join(p) for p in itertools.permutations(FILTERS)]


def selections() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """Order, step and filter of each row of a part, and for each column which of the 32 masks it adds up."""
    masks, rows, picks = np.arange(1 << len(FILTERS)), [], {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for order in orders():
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            failing, gone = masks & bit > 0, masks & before > 0
            rows.append((order, step, FILTERS.index(letter)))
            for name, pick in (("kept", ~gone & ~failing), ("removed", failing & ~gone), ("redundant", failing & gone), ("unique_fails", masks == bit)):
                picks[name].append(pick)
            before |= bit
    return rows, {k: np.array(v, dtype=np.int64) for k, v in picks.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, filter_order, step and the counts of what that step does, for every order of the filters."""
    counts = mask_counts(scan(docs, part), labels)
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 of a part

    def run(batches):
        rows, picks = selections()
        letter = np.array([r[2] for r in rows])
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = (np.zeros(1 << len(FILTERS), dtype=np.int64) for _ in range(3))
                for m in masks:
                    n[m["mask"]], good[m["mask"]], toxic[m["mask"]] = m["n"], m["good"], m["toxic"]
                made = {k: p @ n for k, p in picks.items()} | {"good_lost": picks["removed"] @ good, "toxic_lost": picks["removed"] @ toxic}
                each = np.zeros(len(FILTERS), dtype=np.int64)
                np.add.at(each, letter, made["removed"])
                made["shapley"] = each[letter]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(made[c], pa.int64()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return held.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_sql() -> str:
    """The same rows over `documents` and `labels`, part by source."""
    letters = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(FILTERS))
    names, other = "abcde", lambda k: " AND ".join(f"{n}.l <> {'abcde'[k]}.l" for n in "abcde"[:k])
    joins = " ".join(f"JOIN f {x} ON {other(k)}" for k, x in enumerate(names) if k)
    steps = " UNION ALL ".join(f"SELECT filter_order, {k + 1} AS step, b[{k + 1}] AS bit, {' + '.join(f'b[{i + 1}]' for i in range(k)) or '0'} AS before FROM o" for k in range(5))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS later FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN later THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(l, bit) AS (VALUES {letters}),
o AS (SELECT concat({', '.join(f'{x}.l' for x in names)}) AS filter_order, [{', '.join(f'{x}.bit' for x in names)}] AS b FROM f a {joins}),
s AS ({steps}),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

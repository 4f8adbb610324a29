"""Resharding, the audit of filters and hard negatives against brute force, on whole small tables and odd ones."""

import collections
import itertools
import random
import re
import uuid
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import filter_audit, hard_negatives, queries, resharding
from quillgrid.llm.common import prepare

SF = "/root/testdata/sf0.001"
NAMES = ["part", "shard_", "block", "old_shard", "bucket", "deal", "row", "digest", "n", "size", "first", "mask", "good"]


def docs_of(path=SF):
    made = pd.read_parquet(f"{path}/documents.parquet")
    return [(int(d), t if isinstance(t, str) else None, s if isinstance(s, str) else None) for d, t, s in zip(made.doc_id, made.text, made.source, strict=True)]


def n_bytes(t):
    return len((t or "").encode()) + 1


def crc(t):
    return zlib.crc32((t or "").encode())


# Resharding


def cheapest(supply, room, cost):
    """The least cost by trying every way, a unit at a time."""
    best = {tuple(room): 0}
    for i, n in enumerate(supply):
        for _ in range(n):
            after = {}
            for left, c in best.items():
                for j, x in enumerate(left):
                    if x:
                        to = (*left[:j], x - 1, *left[j + 1 :])
                        after[to] = min(after.get(to, np.inf), c + cost[i][j])
            best = after
    return min(best.values())


@pytest.mark.parametrize("seed", range(25))
def test_transfers_cost_least(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 4), rng.randint(1, 4)
    supply = [rng.randint(0, 5) for _ in range(n)]
    room = [rng.randint(0, 4) for _ in range(m)]
    room[0] += max(0, sum(supply) - sum(room))
    cost = [[rng.randint(0, 6) for _ in range(m)] for _ in range(n)]
    flow = resharding.transfers(supply, room, np.array(cost))
    assert flow.min(initial=0) >= 0 and flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= room).all()
    assert (flow * np.array(cost)).sum() == cheapest(supply, room, cost)


def test_transfers_too_much():
    with pytest.raises(ValueError):
        resharding.transfers([5], [4], np.zeros((1, 1)))


def fewest(rows, shards, capacities):
    """Bytes that must move at least, if bytes could be cut: what old shards hold beyond the capacities of their numbers."""
    held = collections.Counter()
    for r in rows:
        held[r.old_shard] += r.size
    return sum(max(0, n - (capacities[i] if i < shards else 0)) for i, n in held.items())


def laws(rows, docs, shards, longest_block):
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted(((d, n_bytes(t), crc(t)) for d, t, *_ in docs), key=key)
    held, slots = collections.Counter(dict.fromkeys(range(shards), 0)), collections.defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(held) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= longest_block
    return held


def test_registered_resharding(spark):
    rows, docs = queries.op11_resharding(spark, SF).collect(), docs_of()
    sizes = sorted((n_bytes(t) for _, t, _ in docs), reverse=True)
    total = sum(sizes)
    fits = sizes[0] <= total / 16
    held = laws(rows, docs, 16, total)
    if not fits:  # one document is more than a shard's share
        assert max(held.values()) <= sizes[0] + total / 16
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None and r.moved == (r.shard != r.old_shard) for r in rows)


def test_resharding_even_and_few_bytes(spark):
    rng = random.Random(3)
    docs = [(k, "x" * rng.randint(1, 60) + str(k)) for k in range(6000)] + [(k, "copy of one text " * 4) for k in range(6000, 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = resharding.reshard(df, resharding.by_text(6), 6, 8).collect()
    held = laws(rows, docs, 8, 200)
    total = sum(held.values())
    capacities = resharding.equal_capacities(total, 8)
    assert sum(r.size for r in rows if r.moved) <= 1.02 * fewest(rows, 8, capacities) + 1000
    again = resharding.reshard(df.repartition(3), resharding.by_text(6), 6, 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    # Equal texts stay together unless their group is a large one.
    pairs = [(k, f"text {k // 2} " * 3) for k in range(4000)]
    shard = {r.doc_id: r.shard for r in resharding.reshard(spark.createDataFrame(pairs, "doc_id long, text string"), resharding.by_text(3), 3, 4).collect()}
    assert all(shard[k] == shard[k + 1] for k in range(0, 4000, 2))


def test_resharding_capacities_and_costs(spark):
    docs = [(k, "y" * 30 + f"{k:06d}") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = (F.col("doc_id") % 2).cast("int")
    # From two shards of 74,000 bytes: shard 2 is near shard 0, shard 3 near shard 1.
    cost = np.array([[0, 9, 1, 5], [9, 0, 5, 1]], dtype=float)
    rows = resharding.reshard(df, old, 2, 4, np.array([50_000, 40_000, 26_000, 32_000]), cost).collect()
    moved = collections.Counter()
    for r in rows:
        moved[r.old_shard, r.shard] += r.size
    want = resharding.transfers([74_000, 74_000], [50_000, 40_000, 26_000, 32_000], cost)
    assert all(abs(moved[i, j] - want[i, j]) <= 400 for i in range(2) for j in range(4))


def test_resharding_odd_rows(spark):
    long = "long text " * 40_000
    rows = [(1, long), (1, long), (2, ""), (2, ""), (3, None), (None, "a b"), (None, "a b"), (None, None), (4, "a b")] + [(None, "same"), (7, "same")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("own").alias(n) for n in NAMES)).repartition(3)
    made = resharding.reshard(df, resharding.by_text(3), 3, 4).collect()
    held = laws(made, rows, 4, 500_000)
    assert sorted(held.values())[-3] <= 40_000
    assert resharding.reshard(df.limit(0), resharding.by_text(3), 3, 4).count() == 0
    small = spark.createDataFrame(rows[9:], "doc_id long, text string").repartition(4)  # two rows, again and again
    laws(resharding.reshard(small, resharding.by_text(3), 3, 4).collect(), rows[9:], 4, 60)


def test_rewrite_touches_affected_shards(spark, tmp_path):
    docs = [(k, f"text {k} " + "z" * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(5).alias("old_shard"), F.lit("q").alias("row"))
    path = str(tmp_path / "shards")
    resharding.write(df, path, (F.col("doc_id") % 4).cast("int"), 4)
    before = resharding.layout(spark, path)
    report = resharding.rewrite(spark, path, 5)
    after = resharding.layout(spark, path)
    got = resharding.read(spark, path)
    assert set(got.columns) == {*df.columns, "shard"}
    assert sorted((r.doc_id, r.text, r.old_shard, r.row) for r in got.collect()) == [(d, t, 5, "q") for d, t in docs]
    held = collections.Counter()
    for r in got.collect():
        held[r.shard] += n_bytes(r.text)
    assert len(held) == 5 and max(held.values()) - min(held.values()) < 100
    assert report["again"] == [0, 1, 2, 3] and report["grown"] == [4] and abs(report["moved"] - held[4]) < 300
    # Even shards of that number again: nothing moves, no file changes.
    still = resharding.rewrite(spark, path, 5)
    assert still["again"] == [] and resharding.layout(spark, path)["shards"] == after["shards"] != before["shards"]
    # One shard less: only it is written again, the others get a folder more.
    less = resharding.rewrite(spark, path, 4)
    now = resharding.layout(spark, path)["shards"]
    assert less["again"] == [] and less["grown"] == [0, 1, 2, 3] and all(set(after["shards"][k]) < set(now[k]) for k in now)
    assert sorted(r.doc_id for r in resharding.read(spark, path).collect()) == list(range(3000))
    # Files of a job that stopped before its layout aren't seen.
    resharding._write_shards(df.withColumn("to", F.lit(1)), path, "to")
    assert resharding.read(spark, path).count() == 3000
    with pytest.raises(ValueError):
        resharding.write(df.withColumn("RUN", F.lit(1)), path, F.lit(0), 1)
    none = str(tmp_path / "none")
    resharding.write(df.limit(0), none, F.lit(0), 3)
    assert resharding.rewrite(spark, none, 4)["moved"] == 0 and resharding.read(spark, none) is None


# Filter audit


def brute_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)


def brute_audit(docs, labels):
    """docs: (doc_id, text, part)."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    failing = []
    for d, t, p in docs:
        w, u, c, s, n = brute_measures(t or "")
        f = {x for x, bad in zip("ABCDE", (w < 50, 100 * u < 65 * w, 100 * c > 5 * n, s > 0, d is not None and d > least[t or ""]), strict=True) if bad}
        failing.append((p or "", f, labels.get(d, (0, 0))))
    out = {}
    for part in {p for p, _, _ in failing}:
        own = [(f, q) for p, f, q in failing if p == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                removed = [(f, q) for f, q in left if x in f]
                redundant = sum(1 for f, _ in own if x in f and f & set(order[: step - 1]))
                left = [(f, q) for f, q in left if x not in f]
                shapley[x] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(f == {x} for f, _ in own), sum(q[0] for _, q in removed), sum(q[1] for _, q in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(df):
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in df.collect()}
    assert df.count() == len(got)
    return got


def test_registered_audit(spark):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    labels = {int(d): (int(r.quality == 1), int(r.toxic == 1)) for d, r in labels.iterrows()}
    got = audited(queries.op12_filter_audit(spark, SF))
    assert got == brute_audit(docs_of(), labels) and any(v[4] or v[5] for v in got.values())


def sql_rows(sql, *tables, sf=SF):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    return [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]


def test_audit_sql(spark):
    rows = sql_rows(filter_audit.audit_sql(), "documents", "labels")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in rows} == audited(queries.op12_filter_audit(spark, SF))


TEXTS = ["", " ", "a", " a\tb\nc\x0bd\x0ce\rf ", "é é È ü x   y\u0085z", "A#b $ % & * | ~", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "ab ab abc " * 300, "\x1c\x1d a\x1fb", "Ünï çödé ABC 日本語 日本語 日本", "word " * 49, "word " * 50, "0123456789abcdef 0123456789abcdeX 0123456789abcdef"]


@pytest.mark.parametrize("bits", [1, 3, 12, 40])
def test_measures_with_collisions(bits):
    rng = random.Random(bits)
    texts = [*TEXTS, *(" ".join("".join(rng.choices("abAB#é", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 200))) for _ in range(40)), ""]
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["pad", *texts, "end"]).slice(1, len(texts))):
        m = filter_audit.measures(array, bits)
        assert list(zip(*(m[k].tolist() for k in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")), strict=True)) == [brute_measures(t) for t in texts]
    assert len(filter_audit.measures(pa.array([], pa.string()), bits)["n_words"]) == 0


def test_audit_odd_rows(spark):
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    docs = [(9, long, "p"), (3, long, "q"), (3, long, "q"), (3, long, "p"), (None, long, "q"), (None, long, "q"), (None, None, None), (1, "", ""), (2, None, "p"), (5, "A B", None), (4, "A B", "p"), (6, None, "p"), *((k, "same text", "hot") for k in range(100, 400))]
    labels = [(3, 1, None), (3, 0, 1), (9, None, 1), (None, 1, 1), (350, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").select("*", *(F.lit("own").alias(n) for n in NAMES)).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(1))
    want = brute_audit(docs, {3: (1, 1), 9: (0, 1), 350: (1, 1), 2: (1, 0)})
    assert audited(filter_audit.audit(df, known, F.col("source"))) == want
    assert filter_audit.audit(df.limit(0), known, F.col("source")).count() == 0
    none = audited(filter_audit.audit(df, known.limit(0), F.col("source")))
    assert all(v[4] == v[5] == 0 and v[:4] == want[k][:4] for k, v in none.items())


# Hard negatives


def brute_negatives(rows, anchors, low=80, high=100, k=5):
    """rows: vec_id -> (label, vector)."""
    out = []
    for a in anchors:
        dot = lambda b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=False))
        scored = sorted(((-dot(b), b) for b in rows if b != a))
        same = [(b, -s) for s, b in scored if rows[b][0] == rows[a][0]][:k]
        for p, best in same:
            fits = [(b, -s) for s, b in scored if rows[b][0] != rows[a][0] and low * best <= -100 * s <= high * best][:k]
            out += [(a, p, r, b, best, s) for r, (b, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def quantised(path):
    made = pd.read_parquet(f"{path}/embeddings.parquet")
    label = np.where(made.vec_id % 7 == 0, (made.label + 1) % 10, made.label)
    return {int(i): (int(b), [int(v) for v in np.floor(256 * np.asarray(x, dtype=np.float64))]) for i, b, x in zip(made.vec_id, label, made.embedding, strict=True)}


def test_registered_negatives(spark):
    rows = quantised("/root/testdata/sf0.01")
    got = mined(queries.op13_hard_negatives(spark, "/root/testdata/sf0.01"))
    assert got == brute_negatives(rows, [a for a in rows if a % 100 == 0]) and got
    told = sql_rows(hard_negatives.mine_sql(), "embeddings", sf="/root/testdata/sf0.01")
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in told) == got


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 120
    return {k: (int(rng.integers(0, 3)) if k % 3 else 7, (centres[k % 12] + rng.normal(size=16) * 12).round().astype(int).tolist()) for k in range(1500)}


def frame(spark, rows):
    return spark.createDataFrame([(k, b, v) for k, (b, v) in rows.items()], "vec_id long, label int, vector array<long>").select("*", *(F.lit("own").alias(n) for n in ("at", "block", "turn", "rank", "low", "distances"))).repartition(3)


def test_negatives_in_small_blocks(spark, clustered):
    rows = dict(clustered) | {5000 + k: (k % 3, clustered[0][1]) for k in range(60)}  # one vector again and again
    got = mined(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, block=40, batch=3))
    assert got == brute_negatives(rows, [a for a in rows if a % 50 == 0]) and got


def test_negatives_leave_groups_out(spark, clustered):
    table = hard_negatives.Table(frame(spark, clustered))
    x = np.array([clustered[0][1]])
    some = table.visits(x, np.array([0.9 * (x**2).sum()]), np.array([np.inf])).sum()
    assert 0 < some < 0.5 * (table.size > 0).sum()
    near, far = table.space.bracket(table.space.distances(x, asks=True), hard_negatives.lengths(x), *[table.space.distances(np.array([v for _, v in clustered.values()]))] * 2)
    exact = [sum(a * b for a, b in zip(x[0].tolist(), v, strict=True)) for _, v in clustered.values()]
    assert (near[0] <= exact).all() and (far[0] >= exact).all()


def test_negatives_odd_rows(spark):
    big = 1 << 40
    rows = {100: (1, [3, 4]), 200: (1, [3, 4, 9]), 3: (1, []), 4: (2, [3, 4]), 5: (2, [0, 0]), 6: (2, [big, -big, 7]), 300: (3, [1, 1]), 8: (2, [3]), 400: (2, [big, big]), 9: (1, [-3, -4]), 500: (9, [0, 0])}
    none = [(11, None, [1, 2]), (12, 1, None), (13, 1, [1, None]), (None, 1, [1, 2]), (100, 5, [1, 1])]
    df = frame(spark, rows)
    odd = df.unionByName(spark.createDataFrame(none, "vec_id long, label int, vector array<long>").select("*", *(F.lit("own").alias(n) for n in df.columns[3:])))
    assert mined(hard_negatives.mine(odd, F.col("vec_id") % 100 == 0)) == brute_negatives(rows, [100, 200, 300, 400, 500])
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == -1).count() == 0

"""Line, near and suffix dedup, links and components against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import lines, linking, multi_index, prob_minhash, suffixes
from quillgrid.llm.common import prepare
from quillgrid.llm.components import components


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


def union(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


def test_components(spark):
    random.seed(4)
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    want = union(131, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[a] == want[a] and got[b] == want[b] for a, b in pairs if a != b)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("one_task", [0, 10])
def test_components_by_stars(spark, one_task):
    random.seed(5)
    pairs = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 300 + k) for k in range(40)]
    want = union(400, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(4), one_task=one_task).collect()}
    assert all(got[a] == want[a] and got[b] == want[b] for a, b in pairs if a != b)


def link_all(spark, rows, close, part=4096, block=1024, sparse=4):
    """Links of rows (key, node), whose contents are the nodes as text and all of which look near."""
    members = linking.crowded(spark.createDataFrame(rows, "key long, node long").distinct().withColumn("bits", F.lit(0).cast("long"))).checkpoint()
    content = lambda wanted: wanted.withColumn("content", F.col("node").cast("string"))
    near = lambda a, b: np.ones(np.broadcast_shapes(a.shape, b.shape)[:-1], dtype=bool)
    verify = lambda a, b: [close(int(x), int(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]

    def pairs(held, root, side, _):
        n, two = [int(x) for x in held.to_pylist()], (side != side[0]).any()
        return [(i, j) for i in range(len(n)) for j in range(i) if root[i] != root[j] and (side[i] != side[j] or not two) and close(n[i], n[j])]

    return [(r.u, r.v) for r in linking.links(members, ["bits"], near, content, verify, pairs, part, block, sparse).collect()]


@pytest.mark.parametrize("part,block,sparse", [(4096, 1024, 4), (5, 3, 4), (4096, 3, 0), (5, 3, 0)])
def test_links_connect_what_is_linked(spark, part, block, sparse):
    random.seed(6)
    rows = [(random.randrange(12), node) for node in range(80) for _ in range(2)]
    close = lambda a, b: (min(a, b) * 7 + max(a, b) * 13 + a * b) % 5 == 0
    found = link_all(spark, rows, close, part, block, sparse)
    buckets = collections.defaultdict(set)
    for k, n in rows:
        buckets[k].add(n)
    every = [(a, b) for b_ in buckets.values() for a in b_ for b in b_ if a < b and close(a, b)]
    assert union(80, every) == union(80, found) and all(close(u, v) for u, v in found)
    assert link_all(spark, [(1, 1), (2, 2)], close) == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[-1] + 1))
        row = now
    return row[-1]


def test_edit_distance():
    random.seed(1)
    for _ in range(300):
        a = "".join(random.choice("abc ") for _ in range(random.randint(0, 40)))
        b = a[: random.randint(0, 40)] + "".join(random.choice("abc ") for _ in range(random.randint(0, 20)))
        assert lines.edit_distance(a, b) == levenshtein(a, b)


def test_within_says_what_the_distance_says():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 8))) for _ in range(30)]
    for _ in range(500):
        x = rng.choices(vocabulary, k=rng.randrange(12))
        y = list(x)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(3)] = rng.choices(vocabulary, k=rng.randrange(3))
        a, b = " ".join(x), " ".join(y)
        d = levenshtein(a, b)
        assert all(lines.within(a, b, most) == (d <= most) for most in range(d - 2, d + 3) if most >= 0)
        for least in (0.5, 0.8, 0.9):
            assert lines.alike(a, b, least) == (lines.edit_similarity(a, b) >= least)


def test_sim_hashes_and_keys():
    assert lines.BLOCKS * 4 == 64
    rng = random.Random(3)
    for _ in range(200):  # hashes that differ in 15 bits agree in one of 16 blocks
        flips = sum(1 << k for k in rng.sample(range(64), 15))
        assert any(flips >> 4 * b & 15 == 0 for b in range(lines.BLOCKS))
    long = {f"w{k}" for k in range(700)}
    digests = [prob_minhash.word_digests([[w]], 1)[0] for w in long]
    bits = lambda v: np.unpackbits(np.asarray([v], np.uint64).view(np.uint8)).tolist()
    weights = np.unpackbits(np.asarray(digests, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    assert bits(lines.sim_hashes([{"a"}, long, {"b", "c"}])[1]) == (2 * weights > len(long)).astype(int).tolist()
    some = ["one two three", "x", "one two three", "words " * 3 + "end", "é" * 200, "a" * 199 + "b"]
    sims, keys = lines.hashed_lines(some)
    assert sims[0] == sims[2] and (keys[0] == keys[2]).all() and len({tuple(k) for k in keys}) == 5
    alone = lines.hashed_lines([some[3]])
    assert alone[0][0] == sims[3] and (alone[1][0] == keys[3]).all()  # whatever stands beside it
    assert (lines.sketches(["x", "same one"])[1] == lines.sketches(["same one"])[0]).all()


def brute_lines(docs):
    """Lines that go, by edit similarity of all pairs of distinct lines."""
    first, order = {}, []
    for d, t in docs:
        for p, line in enumerate(t.split("\n")):
            n = lines.normalise(line)
            if n:
                order.append((d, p, n))
                first.setdefault(n, (d, p))
    texts = list(first)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if lines.edit_similarity(texts[i], texts[j]) >= 0.8]
    root, best = union(len(texts), pairs), {}
    for k, x in enumerate(texts):
        best[root[k]] = min(best.get(root[k], first[x]), first[x])
    at = {x: best[root[k]] for k, x in enumerate(texts)}
    out = collections.defaultdict(list)
    for d, p, n in order:
        if at[n] != (d, p):
            out[d].append(p)
    return out, len(pairs)


def brute_gone(docs):
    """(doc_id, place) of lines that go, by edit similarity of all pairs that the counts of characters leave possible. docs: in order."""
    first, places = {}, collections.defaultdict(list)
    for d, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if n := lines.normalise(line):
                first.setdefault(n, (d, p))
                places[n].append((d, p))
    distinct = list(first)
    alphabet = {c: k for k, c in enumerate(sorted({c for x in distinct for c in x}))}
    counts = np.zeros((len(distinct), len(alphabet)), np.int32)
    for k, x in enumerate(distinct):
        for c, n in collections.Counter(x).items():
            counts[k, alphabet[c]] = n
    size, order, pairs = counts.sum(axis=1), {x: k for k, x in enumerate(distinct)}, []
    for i in range(len(distinct)):
        gap = counts[:i] - counts[i]  # an edit distance is no less than the characters that either has over
        over = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
        may = np.flatnonzero(over <= 0.2 * np.maximum(size[:i], size[i]) + 1e-9)
        pairs += [(i, j) for j in may.tolist() if lines.edit_similarity(distinct[i], distinct[j]) >= 0.8]
    root = union(len(distinct), pairs)  # the least of a group is its first
    return {place for x, k in order.items() for place in places[x] if place != first[distinct[root[k]]]}


def spoken(rng, n):
    """Words of random letters, as words of one pattern are alike by edit distance however they differ."""
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)]


def test_line_dedup(spark):
    rng = random.Random(8)
    vocabulary = spoken(rng, 500)
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]

    def near(s):
        w = s.split()
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    docs = []
    for k in range(60):
        docs.append((k, "\n".join(rng.choice([rng.choice(base), near(rng.choice(base)), " ".join(rng.choices(vocabulary, k=9)), "", "  THE same   line "]) for _ in range(5))))
    want, n = brute_lines(docs)
    assert n > 5
    table = spark.createDataFrame([*((d, t, len(t), 5, "x") for d, t in docs), (900, None, 0, 1, "x"), (901, "", 0, 1, "x")], "doc_id long, text string, n_chars long, removed int, places string")
    made = lines.dedup(table)
    assert made.columns == ["doc_id", "text", "n_chars", "places", "n_lines", "removed"]
    got = {r.doc_id: r for r in made.collect()}
    for d, t in docs:
        assert got[d].removed == sorted(want[d])
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[d])
        assert got[d].text == kept and got[d].n_chars == len(kept)
    assert got[900].text is None and got[901].text == ""
    assert lines.dedup(table.limit(0)).count() == 0


def test_line_dedup_of_odd_tables(spark):
    """Rows of one doc_id and text are treated alike, null ids come last, long lines and lines without blanks are lines."""
    rng = random.Random(4)
    long = " ".join(spoken(rng, 9000))
    glued = "".join(rng.choices("abcdefgh", k=400))
    rows = [(5, "only here\n" + glued), (1, "twice the same row"), (1, "twice the same row"), (None, long + " end\nown line of a null id"), (2, long), (None, "twice the same row!"), (3, glued[:200] + "z" + glued[201:] + "\n\n \n"), (None, None)]
    got = collections.Counter((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(5, "only here"), (1, "twice the same row"), (1, "twice the same row"), (None, "own line of a null id"), (2, long), (None, ""), (3, glued[:200] + "z" + glued[201:] + "\n\n \n"), (None, None)]
    assert got == collections.Counter(want)


def exact_similarity(a, b):
    keys = set(a) | set(b)
    total = 0.0
    for i in set(a) & set(b):
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys)
    return total


def words5(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_probability_jaccard():
    texts = ["a b c d e f g h", "a b c d e f g i", "x y z " * 9, "x y z " * 7 + "q", "one", "One", ""]
    owner, element, weight = prob_minhash.shingles(texts)
    sets = [(element[owner == k], weight[owner == k]) for k in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert abs(prob_minhash.similarity(*sets[i], *sets[j]) - exact_similarity(words5(texts[i]), words5(texts[j]))) < 1e-9
    many = [" ".join(f"w{k}" for k in range(s, s + 300)) for s in (0, 30, 75)]
    owner, element, weight = prob_minhash.shingles(many)
    sig = prob_minhash.signatures(owner, element, weight, 3, 2000)
    for j in (1, 2):
        assert abs((sig[0] == sig[j]).mean() - exact_similarity(words5(many[0]), words5(many[j]))) < 0.05


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=140)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", "", "few words", "few  WORDS", "few other", "again " * 40]
    sets = [words5(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i].lower().split() == texts[j].lower().split() or sets[i] and exact_similarity(sets[i], sets[j]) >= 0.8]
    want = union(len(texts), pairs)
    docs = spark.createDataFrame([*((k, t, "x") for k, t in enumerate(texts)), (None, "few words", "x")], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want and got[None] is None
    kept = [r.doc_id for r in prob_minhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want)) and kept.count(None) == 1
    same = spark.createDataFrame([(1, "one two three"), (1, "four five six"), (2, "four five six")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(same).collect()} == {(1, 1), (2, 1)}
    assert prob_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_what_single_pairs_find():
    rng = random.Random(2)
    texts = []
    for k in range(120):
        w = [f"v{k % 3}{i}" for i in range(100)]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w * 2 if k % 17 == 0 else w))
    owner, element, weight = prob_minhash.shingles(texts)
    sets = [(element[owner == k], weight[owner == k]) for k in range(len(texts))]
    n = np.arange(len(texts))
    got = prob_minhash.similar_pairs(sets, n, np.zeros(len(n), int), 0.8)
    every = [(i, j) for i in n.tolist() for j in range(i) if prob_minhash.similarity(*sets[i], *sets[j]) >= 0.8]
    assert union(len(texts), got) == union(len(texts), every)
    few = prob_minhash.similar_pairs(sets, n, n % 2, 0.8)
    assert all(i % 2 != j % 2 for i, j in few)


def test_weighted_sets_of_a_block_are_compared_many_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    base, common = rng.choice(2**62, 160, replace=False).astype(np.uint64), rng.choice([1, 1, 1, 2, 5], 160)
    sets = []
    for _ in range(120):
        keep, own = rng.random(160) < rng.choice([0.8, 0.95]), rng.choice(2**62, rng.integers(1, 24), replace=False).astype(np.uint64)
        element, weight = np.append(base[keep], own), np.append(np.where(rng.random(160) < 0.05, 3, common)[keep], np.ones(len(own), int))
        order = np.argsort(element)
        sets.append((element[order], weight[order]))
    exact = prob_minhash.similarity
    close = [(i, j) for i in range(120) for j in range(i) if exact(*sets[i], *sets[j]) >= 0.6]
    calls = []
    monkeypatch.setattr(prob_minhash, "similarity", lambda *x: calls.append(1) or exact(*x))
    for side in (np.zeros(120, int), np.arange(120) % 2):
        found = prob_minhash.similar_pairs(sets, np.arange(120), side, 0.6)
        assert set(found) <= {(j, i) for i, j in close}
        assert union(120, found) == union(120, [(i, j) for i, j in close if side[i] != side[j] or not side.any()])
    assert 500 < len(close) < 7000 and len(calls) < 120


@pytest.mark.parametrize("ids", [0, 1 << 20])
def test_only_texts_of_candidates_are_shuffled(spark, monkeypatch, ids):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choices("abcdefghij", k=40))) for k in range(60)]
    docs += [(100 + k, docs[k][1] + " z") for k in range(8)]
    seen, make = [], prob_minhash._shingle_sets
    monkeypatch.setattr(prob_minhash, "IDS", ids)
    monkeypatch.setattr(prob_minhash, "_shingle_sets", lambda rows, words: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or make(rows, words))
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[100 + k] == k for k in range(8)) and len(set(got.values())) == 60
    assert seen and all(("broadcast" in x) == bool(ids) for x in seen)


def brute_suffixes(docs, length):
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("most", [50_000, 3])
def test_suffix_dedup(spark, most, monkeypatch):
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdeé \0") for _ in range(rng.randrange(90, 260))) for _ in range(5)]
    texts = [None, "", "a" * 99, "a" * 350, "ab" * 200]
    for _ in range(60):
        texts.append("".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(rng.randrange(80))), rng.choice(passages)[rng.randrange(60) :]]) for _ in range(rng.randrange(5))))
    texts += [texts[9], texts[10] + "tail"]
    docs = list(enumerate(texts))
    monkeypatch.setattr(suffixes, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffixes.marks, "__defaults__", (suffixes.LENGTH, suffixes.GRAM, most))
    table = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n_chars int, kept string").repartition(3)
    got = {r.doc_id: r for r in suffixes.dedup(table).collect()}
    want = brute_suffixes(docs, 100)
    for d, t in docs:
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[d]
        assert r.text == (t if not r.n_removed else want[d][3].decode(errors="replace"))


def ordered_rows(spark, rows):
    """Rows in the order of starts: doc_id, null last, then the digest of the text; of equal rows one."""
    table = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    return [(r.doc_id, r.text) for r in sorted(table.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))]


def test_suffix_dedup_of_odd_tables(spark):
    """Null and repeated ids with many texts, repeated rows, ties, very long texts and clashing names, exactly."""
    rng = random.Random(3)
    long = "".join(rng.choices("abcdef ", k=300))
    passages = ["".join(rng.choices("abcdefgh", k=150)) for _ in range(40)]
    rows = [(1, long), (1, long), (1, "x" + long), (None, long), (7, "".join(rng.choices("pqrs", k=30_000))), (None, ""), (8, None)]
    rows += [(None, rng.choice(passages) + str(k) + rng.choice(passages)) for k in range(1000)]
    rows += [(7, rows[4][1][5000:9000] + long[:120]), (2, passages[0])]
    table = spark.createDataFrame([(*r, 5, "own") for r in rows], "doc_id long, text string, pieces int, doc string").repartition(4)
    order = ordered_rows(spark, rows)
    want = {order[k]: v for k, v in brute_suffixes([(k, t) for k, (_, t) in enumerate(order)], 100).items()}
    made = suffixes.dedup(table)
    assert made.columns == ["doc_id", "text", "pieces", "doc", "n_bytes", "n_removed", "n_spans", "kept"]
    got = made.collect()
    assert len(got) == len(rows) and all(r.pieces == 5 and r.doc == "own" for r in got)
    left = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert left == collections.Counter((d, *want[d, t]) for d, t in rows)
    assert suffixes.dedup(table.limit(0)).count() == 0


def test_deep_shallow_order():
    rng = random.Random(5)
    for width in (5, 13, 40, 68):
        rows = [("".join(rng.choice("ab\0") for _ in range(width)) if rng.random() < 0.5 else "a" * width)[: rng.randrange(width + 1)].encode() for _ in range(60)]
        group = np.sort(np.asarray([rng.randrange(3) for _ in rows]))
        matrix = np.zeros((len(rows), width), np.uint8)
        for k, r in enumerate(rows):
            matrix[k, : len(r)] = np.frombuffer(r, np.uint8)
        sizes = np.asarray([len(r) for r in rows])
        key = lambda k: (group[k], matrix[k].tobytes(), sizes[k])
        order = suffixes.deep_shallow(group, matrix, sizes, 8)
        assert [key(k) for k in order] == sorted(key(k) for k in range(len(rows)))


def test_multi_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[300:330] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 3), (1080, [None] + [1.0] * 15), (None, [1.0] * 16), (20, x[20].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in multi_index.search(table, F.col("vec_id") % 20 == 0, k=5, centroids=8, block=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:5].tolist()
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - w) < 1e-12 for _, v, w in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[0])][:4] == [300, 301, 302, 303]
    assert multi_index.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    tiny = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in multi_index.search(tiny, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]


def test_visits_are_best_first():
    rng = np.random.default_rng(7)
    a, b, sizes = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 4, 30)
    cells = multi_index.visit(a, b, sizes, 10**9)
    total = (a[:, None] + b[None, :]).ravel()
    assert cells == [c for c in np.argsort(-total, kind="stable").tolist() if sizes[c]]

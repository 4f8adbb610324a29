"""Every registered query of this subpackage over whole tables, each column against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from test_duplicates import brute_gone, brute_suffixes, exact_similarity, union, words5

from quillgrid.llm import edit_counts, fingerprints, queries
from quillgrid.llm.wordbpe import default_path, library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    made = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(d): t if isinstance(t, str) else "" for d, t in zip(made.doc_id, made.text, strict=True)}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_doc(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def ids_of(text):
    return library(default_path()).encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_line_dedup(spark, docs):
    want = brute_gone(sorted(docs.items()))
    got = by_doc(queries.op1_line_dedup(spark, SF))
    gone = {(d, p) for d, r in got.items() for p in r.removed}
    assert set(got) == set(docs) and gone <= want and len(gone) >= 0.99 * len(want) > 10
    for d, r in got.items():
        split = docs[d].split("\n")
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (len(split), len(r.removed), sha("\n".join(x for p, x in enumerate(split) if p not in r.removed)))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_multi_index(spark, sf):
    """The larger table has more vectors than are visited anyway."""
    made = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(made.embedding.to_numpy()).astype(float), made.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in queries.op2_multi_index(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = n = 0
    for q in [k for k in range(len(ids)) if ids[k] % 20 == 0]:
        score = (x * x[q]).sum(axis=1)
        best = [k for k in np.lexsort((ids, -score)).tolist() if k != q][:20]
        found = sorted(got.pop(int(ids[q])))
        assert [r for r, _, _ in found] == list(range(1, 21))
        at = {int(v): s for v, s in zip(ids, score, strict=True)}
        assert all(abs(at[v] - s) < 1e-12 for _, v, s in found) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({int(ids[k]) for k in best} & {v for _, v, _ in found})
        n += 20
    assert not got and hits >= 0.9 * n


def test_bpe(spark, docs):
    got = by_doc(queries.op3_bpe(spark, SF))
    assert set(got) == set(docs)
    for d, r in got.items():
        ids = ids_of(docs[d])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(packed(ids)), sha(library(default_path()).decode(ids, skip_special_tokens=False)))


def test_toxicity(spark, docs):
    got = by_doc(queries.op4_toxicity(spark, SF))
    assert set(got) == set(docs)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    right = total = 0
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and d in labels.index:
            right, total = right + (r.predicted == labels[d]), total + 1
    assert total > 5 and right >= 0.85 * total


def test_token_counts(spark, docs):
    got = by_doc(queries.op5_token_counts(spark, SF))
    assert set(got) == set(docs)
    for d, r in got.items():
        t, n = docs[d], len(docs[d])
        edits = [{"at": n // 4, "remove": 40, "insert": ""}, {"at": n // 2, "remove": 0, "insert": " revised in review, "}, {"at": 3 * n // 4, "remove": 12, "insert": "replaced"}]
        after = edit_counts.apply(t, edits)
        assert (r.n_tokens, r.edited_tokens, r.n_edits, r.edited_sha256) == (len(ids_of(t)), len(ids_of(after)), 3, sha(after))
        assert r.chars_built == n and (n < 2000 or r.chars_reencoded < n)


def test_minhash(spark, docs):
    order = sorted(docs)
    sets = [words5(docs[d]) for d in order]
    folded = [docs[d].lower().split() for d in order]
    links = [(i, j) for i in range(len(order)) for j in range(i) if folded[i] == folded[j] or len(sets[i].keys() & sets[j].keys()) * 2 > max(len(sets[i]), len(sets[j])) and exact_similarity(sets[i], sets[j]) >= 0.8]
    root = union(len(order), links)
    got = by_doc(queries.op6_minhash(spark, SF))
    assert {d: r.class_id for d, r in got.items()} == {d: order[root[k]] for k, d in enumerate(order)}


def test_suffixes(spark, docs):
    want = brute_suffixes([(d, docs[d]) for d in sorted(docs)], 100)
    got = by_doc(queries.op7_suffixes(spark, SF))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == {d: (n, gone, spans, sha(kept)) for d, (n, gone, spans, kept) in want.items()}


def test_packing(spark, docs):
    rows = queries.op9_packing(spark, SF).toPandas()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 4096
    sums = rows.groupby("sequence_id").length.sum()
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sums.tolist())
    assert padded <= 0.03 * sums.sum()
    for d, s in rows.sort_values("start").groupby("doc_id"):
        ids = [*ids_of(docs[int(d)]), 2]
        assert s.start.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() == len(ids) and set(s.doc_tokens) == {len(ids)}
        assert s.ids_crc32.tolist() == [zlib.crc32(packed(ids[a : a + n])) for a, n in zip(s.start, s.length, strict=True)]
    assert set(rows.doc_id) == set(docs)


def likeness(a, b):
    x, y = (collections.Counter(fingerprints.pieces(t)) for t in (a, b))
    every = sum(len(p) * n for p, n in (x | y).items())
    return sum(len(p) * n for p, n in (x & y).items()) / every if every else 1.0


def test_fingerprints(spark, docs):
    got = by_doc(queries.op10_fingerprints(spark, SF))
    order = sorted(docs, reverse=True)
    prints = collections.defaultdict(set)
    for k, d in enumerate(order):
        t, after = docs[d], docs[order[(k + 1) % len(order)]]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(e))
        assert abs(r.near_edited - likeness(t, e)) < 1e-9 and abs(r.near_next - likeness(t, after)) < 1e-9
        prints[r.fingerprint].add(t)
        prints[r.edited_fingerprint].add(e)
    assert set(got) == set(docs) and all(len(x) == 1 for x in prints.values()) and len(prints) == len(set(docs.values()) | {x for s in prints.values() for x in s})

"""Licences, fingerprints and toxicity."""

import collections

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillgrid.llm import fingerprints as fp
from quillgrid.llm import licenses, toxicity


def test_licenses(spark, tmp_path):
    texts = [None, "", "Licensed under the Apache License, Version 2.0.\nx", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "license"]
    texts.append("See the GNU General Public License for more details. Hello. You should have received a copy of the GNU General Public License along with this program.")
    texts.append("You should have received a copy of the GNU General Public License along with this program. See the GNU General Public License for more details.")
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string")
    rows = [tuple(r) for r in licenses.scan(docs).select("doc_id", "sentence_ids", "n_sentences", "licenses").collect()]
    assert sorted(rows) == sorted([(0, "", 0, ""), (1, "", 0, ""), (2, "1", 1, "Apache-2.0"), (2, "1", 1, "Apache-2.0"), (3, "10,30", 2, "CC-BY-NC-4.0,MIT"), (4, "20", 1, "GPL-3.0"), (5, "", 0, ""), (6, "24,25", 2, "GPL"), (7, "25,24", 2, "")])
    docs.filter("doc_id != 2").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(con.execute(licenses.scan_sql()).fetchall()) == sorted(r for r in rows if r[0] != 2)


def brute(x, y):
    a, b = collections.Counter(fp.pieces(x)), collections.Counter(fp.pieces(y))
    both, every = (sum(len(k) * v for k, v in c.items()) for c in (a & b, a | b))
    return both / every if every else 1.0


def test_fingerprints(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: ", ".join(" ".join(rng.choice(words, 4)) for _ in range(n)) + "."
    texts = [None, "", "", "a", "line\n" * 50, text(300), text(3), text(40), "x" * 2000, text(5)]
    texts.append(texts[5] + " and one more, at the end")
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, part int")
    got = {r.doc_id: r for r in fp.compare_with_next(docs, docs_per_range=3).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, after = t or "", texts[k - 1 if k else len(texts) - 1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[k].edited_text == e and "".join(fp.pieces(t)) == t
        assert abs(got[k].near_edited - brute(t, e)) < 1e-12 and abs(got[k].near_next - brute(t, after)) < 1e-12
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    again = spark.createDataFrame([(4, "b"), (4, "a"), (None, "c"), (9, "d")], "doc_id long, text string")
    assert sorted(r.edited_text for r in fp.compare_with_next(again, 1).collect()) == ["a", "b", "c", "d"]
    assert fp.compare_with_next(docs.limit(0)).count() == 0


def brute_marginals(score, trans, start):
    n = len(score)
    total = np.zeros(n)
    z = 0.0
    for path in range(1 << n):
        y = [path >> k & 1 for k in range(n)]
        w = np.exp(sum(s for s, k in zip(score, y, strict=True) if k) + start * y[0] + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        z += w
        total += w * np.asarray(y)
    return total / z


def test_forward_backward():
    rng = np.random.default_rng(1)
    score, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    got = toxicity.sigmoid(toxicity.marginals(score, np.asarray([0, 4, 5]), trans, 0.3)[0])
    want = np.concatenate([brute_marginals(score[a:b], trans, 0.3) for a, b in ((0, 4), (4, 5), (5, 9))])
    assert np.allclose(got, want)
    assert toxicity.chains(np.asarray([False, True, False, False, False, True]), most=3).tolist() == [0, 2, 5]


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(600):
        said = list(rng.choice(words, 60))
        toxic = k % 5 == 0
        if toxic:
            for w in ("grumpf", "blarghen", "snorky"):
                said.insert(int(rng.integers(0, len(said))), w)
        rows.append((k, " ".join(said) + ".", "toxic"))
        labels.append((k, int(toxic)))
    rows += [(1000, None, ""), (1001, "", ""), (1001, "You grumpf, really.", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    one = next(r for r in got if r.doc_id == 1001 and r.spans)
    assert "You grumpf, really."[one.spans[0].begin : one.spans[0].end] == "grumpf"
    assert all(r.score < 0.5 for r in got if r.doc_id == 1000)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted} - {1001} | {1001}
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}

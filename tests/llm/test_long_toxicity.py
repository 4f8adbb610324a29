"""Toxic passages far behind the beginning of long documents are learnt."""

import numpy as np

from quillgrid.llm import toxicity
from quillgrid.llm.common import prepare


def test_passages_behind_12000_characters(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(160):
        said = list(rng.choice(words, 1900))
        if k % 4 == 0:
            said[1850:1850] = ["grumpf", said[0], "blarghen", said[1], "snorky"]
        rows.append((k, " ".join(said) + "."))
    assert min(min(t.find(w) for w in ("grumpf", "blarghen", "snorky")) for k, t in rows if k % 4 == 0) > 12_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k, _ in rows)
    assert all("grumpf" in [t[s.begin : s.end].split()[0] for s in got[k].spans] for k, t in rows if k % 4 == 0)


def test_the_sample_is_bounded_by_characters(spark):
    rows = [(k, f"{k} " * 50) for k in range(40)] + [(3, "again " * n) for n in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    every = toxicity.sample(docs, labels).collect()
    assert {r.toxic for r in every} == {0, 1} and len(every) > 59
    some = toxicity.sample(docs, labels, most_chars=400).collect()
    for kind in (0, 1):
        sizes = sorted(((r.h, r.toxic, len(r.text)) for r in some if r.toxic == kind), key=lambda x: x[0])
        assert sizes and sum(n for _, _, n in sizes) - max(n for _, _, n in sizes) <= 400
        assert {h for h, _, _ in sizes} <= set(sorted({r.h for r in every if r.toxic == kind})[: len(sizes)])

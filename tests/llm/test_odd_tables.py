"""Null ids, repeated rows, very long and empty texts, clashing columns and empty tables in every operator that another test doesn't try so."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import bpe_tree, edit_counts, fingerprints, licenses, packing, prob_minhash, toxicity
from quillgrid.llm.common import prepare
from quillgrid.llm.wordbpe import default_path, library

NAMES = ["part", "place", "node", "root", "key", "ids", "edits", "keys", "copy", "start", "score", "row"]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=20_000)) + "."
    short = " ".join(rng.choices(words, k=30)) + ". Released under the MIT License."
    rows = [(1, long), (1, long), (2, ""), (2, ""), (3, None), (None, short), (None, short), (None, None), (4, short), (1, short), (5, long + " Licensed under the Apache License, Version 2.0.")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("own").alias(n) for n in NAMES)).repartition(3)


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def both(rows, of):
    return sorted(((d, of(t or "")) for d, t in rows), key=key)


def n_ids(t):
    return len(library(default_path()).encode(t, add_special_tokens=False).ids)


def test_bpe(odd):
    rows, docs = odd
    made = bpe_tree.decode(bpe_tree.encode(docs)).selectExpr("doc_id", "CAST(octet_length(ids) / 4 AS LONG) AS n")
    assert sorted((tuple(r) for r in made.collect()), key=key) == both(rows, n_ids)
    assert bpe_tree.decode(bpe_tree.encode(docs.limit(0))).count() == 0


def test_token_counts(odd, spark):
    rows, docs = odd
    made = edit_counts.edit_counts(docs, edit_counts.sample_edits())
    assert sorted(((r.doc_id, r.n_tokens) for r in made.collect()), key=key) == both(rows, n_ids)
    none = edit_counts.edit_counts(docs, F.lit(None)).collect()
    assert all(r.n_edits == 0 and r.n_tokens == r.edited_tokens and r.chars_reencoded == 0 for r in none) and len(none) == len(rows)
    assert edit_counts.edit_counts(docs.limit(0), edit_counts.sample_edits()).count() == 0
    tree = edit_counts.CountTree("one " * 2000, default_path())
    for k in range(300):  # leaves stay small however long a session is
        tree.edit(k * 17 % 7000, 3, " more words here and there " if k % 3 else "")
    assert max(map(len, tree.leaves)) <= 2 * edit_counts.SEGMENT_CHARS and tree.tokens() == n_ids(tree.text())


def test_licenses(odd):
    rows, docs = odd
    of = lambda t: ",".join(x for x, y in (("Apache-2.0", "Apache"), ("MIT", "MIT License")) if y in t)
    assert sorted(((r.doc_id, r.licenses) for r in licenses.scan(docs).collect()), key=key) == both(rows, of)
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "GPL-2.0"),
        ("// SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"),
        (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n", "LGPL-2.1"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
        ("  This software is provided 'as-is', without any express or implied\n  warranty.  In no event will the authors be held liable for any damages\n  arising from the use of this software.\n\n  Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:\n", "Zlib"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n", "MIT"),
    ],
)
def test_notices(spark, text, name):
    assert name in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses.split(",")


def test_rules_have_a_distance(spark):
    see, got, other = "See the GNU General Public License for more details. ", "You should have received a copy of the GNU General Public License along with this program. ", "MIT License. "
    rows = [(n, see + other * n + got) for n in (0, licenses.BETWEEN, licenses.BETWEEN + 1)]
    found = {r.doc_id: r.licenses.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ["GPL" in found[n] for n, _ in rows] == [True, True, False]


def test_packing(odd):
    rows, docs = odd
    made = packing.pack(docs).toPandas()
    assert made.length.sum() == sum(n_ids(t or "") + 1 for _, t in rows) and made.groupby("sequence_id").length.sum().max() <= 4096
    assert made.doc_id.isna().sum() >= 3 and packing.pack(docs.limit(0)).count() == 0


def test_near_duplicates(odd):
    rows, docs = odd
    got = sorted(((r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(docs).collect()), key=key)
    # 1 has the long and the short text, 5 and 4 are near or equal to these; 2 and 3 are empty.
    assert got == sorted(((d, None if d is None else 2 if d in (2, 3) else 1) for d, _ in rows), key=key)
    kept = prob_minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 2]


def test_links_of_ids_with_several_texts(spark):
    rng = random.Random(3)
    a, b = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail")]
    for order in (rows, rows[::-1]):
        got = prob_minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_fingerprints(odd):
    rows, docs = odd
    got = fingerprints.compare_with_next(docs, docs_per_range=2).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == both(rows, str)
    prints = {r.text: r.fingerprint for r in got}
    assert all(prints[r.text] == r.fingerprint for r in got)


def test_toxicity(odd, spark):
    rows, docs = odd
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held in (True, False) for r in got)

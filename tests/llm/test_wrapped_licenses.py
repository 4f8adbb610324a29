"""Licence sentences that are wrapped and commented, for every rule."""

import textwrap

import pytest

from quillgrid.llm import licenses
from quillgrid.llm.common import prepare

RAW = {i: s for s, i in licenses.SENTENCES.items()}
RAW[50] = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
MARKS = [("", ""), ("# ", ""), ("// ", ""), (" * ", ""), ("-- ", ""), ("dnl ", ""), ("/* ", " */")]


def test_wrapped_and_commented(spark):
    prepare(spark)
    rows, want = [], {}
    for name, ids in licenses.RULES:
        for width in (28, 72):
            for begin, end in MARKS:
                paragraphs = [textwrap.wrap("Some words before. " + RAW[i] + ". And some behind.", width) for i in ids]
                lines = [begin + x + end for p in paragraphs for x in [*p, ""]]
                want[len(rows)] = (",".join(map(str, ids)), name)
                rows.append((len(rows), "\n".join(lines)))
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v[0] != want[k][0] or want[k][1] not in v[1].split(",")} == {}


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("// Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this\n// file except in compliance with the License. You may obtain a copy of the\n// License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n", [2, 3, 4]),
        ("of the Mozilla Public\n", []),
        ("/* This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the Free\n * Software Foundation; either version 2 of the License, or (at your option)\n * any later version. */", [23]),
        ("1. Redistributions of source code must retain the above copyright\r\n   notice, this list of conditions and the following disclaimer.\r\n", [41]),
        ("The MIT\n\nLicense", []),
    ],
)
def test_texts(text, ids):
    assert licenses.identifiers(text) == ids

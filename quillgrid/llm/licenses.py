"""Licence scans by sentence rules.

Comment marks and bullets at the beginning of lines are stripped. Stops and blank lines end a sentence; ends of lines and
semicolons may be within one. Runs between these places, in lower case with only letters and digits kept, are looked up among
known licence sentences, the longest first, and become their identifiers. The identifiers, in order, are matched against
rules: a rule holds if its identifiers occur in its order, with at most BETWEEN others between two of them. Lookups are in Python, rules in SQL expressions. The DuckDB
SQL cuts at every line's end and in 'v. 2.0': it has the same rows only where no licence sentence is wrapped or commented.

Null and empty texts have no identifiers and no licence. Rows with one doc_id are scanned each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import in_batches, key_and_text, texts

# Normalised sentences of public licence texts and notices, with identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": 1,
    "licensed under the apache license version 2 0 the license": 2,
    "you may not use this file except in compliance with the license": 3,
    "you may obtain a copy of the license at": 4,
    "see the license for the specific language governing permissions and limitations under the license": 5,
    "released under the mit license": 10,
    "mit license": 11,
    "the mit license": 12,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 13,
    "this work is licensed under the gnu general public license version 3": 20,
    "this work is licensed under the gnu general public license version 2": 21,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 22,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": 23,
    "see the gnu general public license for more details": 24,
    "you should have received a copy of the gnu general public license along with this program": 25,
    "licensed under cc by nc 4 0": 30,
    "licensed under cc by 4 0": 31,
    "licensed under cc by sa 4 0": 32,
    "this work is licensed under a creative commons attribution 4 0 international license": 33,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": 34,
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": 35,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 40,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 41,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 42,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 43,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 50,
    "this is free and unencumbered software released into the public domain": 60,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": 70,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 71,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": 72,
    "see the gnu lesser general public license for more details": 73,
    "you should have received a copy of the gnu lesser general public license along with this library": 74,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 75,
    "see the gnu affero general public license for more details": 76,
    "you should have received a copy of the gnu affero general public license along with this program": 77,
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": 80,
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": 81,
    "distributed under the boost software license version 1 0": 82,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 83,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 84,
    "this software is provided as is without any express or implied warranty": 85,
    "in no event will the authors be held liable for any damages arising from the use of this software": 86,
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": 87,
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": 88,
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": 89,
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": 90,
    "this work is dedicated to the public domain under the cc0 1 0 universal license": 91,
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": 92,
    "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence": 93,
    "the contents of this file are subject to the terms of the common development and distribution license the license": 94,
    "this font software is licensed under the sil open font license version 1 1": 95,
    "do what the fuck you want to public license": 96,
    "you just do what the fuck you want to": 97,
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": 98,
    "psf is making python available to licensee on an as is basis": 99,
    "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0": 100,
    "this license governs use of the accompanying software": 101,
    "if you use the software you accept this license": 102,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 103,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 104,
    "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium": 105,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 106,
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": 107,
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": 108,
}

#: Licence and the identifiers that show it, in order. The same licence may have several rules.
RULES = [
    ("Apache-2.0", [1]), ("Apache-2.0", [2]), ("Apache-2.0", [3, 4, 5]),
    ("MIT", [10]), ("MIT", [11]), ("MIT", [12]), ("MIT", [13]),
    ("GPL-3.0", [20]), ("GPL-3.0", [22]), ("GPL-2.0", [21]), ("GPL-2.0", [23]), ("GPL", [24, 25]),
    ("CC-BY-NC-4.0", [30]), ("CC-BY-NC-4.0", [34]), ("CC-BY-4.0", [31]), ("CC-BY-4.0", [33]), ("CC-BY-SA-4.0", [32]), ("CC-BY-SA-4.0", [35]),
    ("BSD-3-Clause", [40, 41, 42, 43]), ("BSD-2-Clause", [40, 41, 42]), ("BSD-4-Clause", [40, 41, 42, 92, 43]), ("MPL-2.0", [50]), ("Unlicense", [60]),
    ("LGPL-2.1", [70]), ("LGPL-3.0", [71]), ("LGPL-2.0", [72]), ("LGPL", [73, 74]), ("AGPL-3.0", [75]), ("AGPL", [76, 77]), ("EPL-2.0", [80]), ("EPL-1.0", [81]), ("BSL-1.0", [82]), ("ISC", [83]), ("0BSD", [84]),
    ("Zlib", [85, 86, 87]), ("Zlib", [87, 88, 89]), ("CC0-1.0", [90]), ("CC0-1.0", [91]), ("EUPL-1.2", [93]), ("CDDL-1.0", [94]), ("OFL-1.1", [95]), ("WTFPL", [96, 97]), ("PostgreSQL", [98]), ("Python-2.0", [99]), ("Artistic-2.0", [100]),
    ("MS-PL", [101, 102]), ("MIT", [103, 13]), ("NCSA", [104, 41, 42]), ("X11", [103, 13, 105]), ("Apache-2.0", [3, 4, 106, 5]), ("CC-BY-ND-4.0", [107]), ("CC-BY-NC-SA-4.0", [108]),
]

#: Licences whose short identifier line names them; each gets a sentence and a rule of its own.
NAMED = sorted({name for name, _ in RULES if "-" in name or name in ("MIT", "ISC", "Zlib", "NCSA", "PostgreSQL", "Unlicense", "WTFPL", "X11", "0BSD")} | {"GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"})
for _number, _name in enumerate(NAMED):
    SENTENCES["spdx license identifier " + " ".join(_name.lower().replace("-", " ").replace(".", " ").split())] = 200 + _number
    RULES.append((_name.removesuffix("-only").removesuffix("-or-later"), [200 + _number]))

#: Other identifiers that may stand between two of a rule.
BETWEEN = 4

#: What every known sentence holds one of.
HINT = re.compile("licen[sc]e|redistribution|copyright|unencumbered|permission|this software|original software|basis|advertising|you want|eupl")
#: Comment marks and bullets at the beginning of a line.
MARKS = re.compile(r"(?:[^\w\s]+|(?:rem|dnl)\s|\(?[0-9a-z]{1,3}\)|\s+)*")
LINE_END = re.compile("\r\n|\r|\n")
#: The stop of 'v. 2.0' ends no sentence.
VERSION = re.compile(r"\bv\.\s+(?=[0-9])")
STOP = re.compile(r"[.!?]+[ \t\n]+|\n[ \t]*\n")
MAYBE = re.compile("[;\n]")
OTHER = "[^a-z0-9]+"
WORDS = re.compile("[a-z0-9]+")


def pattern(ids: list[int]) -> str:
    """A regular expression over identifiers, each with a blank on either side: those of the rule in order, at most BETWEEN others between two."""
    return f"(?: [0-9]+ ){{0,{BETWEEN}}}".join(f" {i} " for i in ids)


MOST_WORDS = max(len(s.split()) for s in SENTENCES)
FIRST_WORDS = {s.split()[0] for s in SENTENCES}


def identifiers(text: str) -> list[int]:
    """Identifiers of known sentences, in order."""
    text = text.lower()
    if not HINT.search(text):
        return []
    found = []
    bare = "\n".join(line[MARKS.match(line).end() :] for line in LINE_END.split(text))
    for sentence in STOP.split(VERSION.sub("v ", bare)):
        words, places = [], [0]
        for part in MAYBE.split(sentence):
            words += WORDS.findall(part)
            if len(words) > places[-1]:
                places.append(len(words))
        done = 0
        for k, begin in enumerate(places[:-1]):
            if begin < done or words[begin] not in FIRST_WORDS:
                continue
            for end in reversed(places[k + 1 :]):
                if end - begin <= MOST_WORDS and (known := SENTENCES.get(" ".join(words[begin:end]))):
                    found.append(known)
                    done = end
                    break
    return found


def _identified(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([identifiers(x) for x in texts(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (found identifiers), n_sentences and licenses (sorted, comma between)."""
    marked = in_batches(key_and_text(docs), _identified, "doc_id long, ids array<int>")
    spaced = F.concat(F.lit(" "), F.array_join(F.col("ids").cast("array<string>"), "  "), F.lit(" "))
    found = [F.when(F.col("spaced").rlike(pattern(ids)), F.lit(name)) for name, ids in RULES]
    return marked.withColumn("spaced", spaced).select(
        "doc_id",
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.when(F.size("ids") == 0, "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))), ",")).alias("licenses"),
    )


def scan_sql() -> str:
    """The same rows as DuckDB SQL."""
    known = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
    cut = "[.!?]+[ \\t\\r]+|[\\r\\n]+"
    names = ", ".join(f"CASE WHEN regexp_matches(spaced, '{pattern(ids)}') THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{cut}')) AS s, generate_subscripts(regexp_split_to_array(lower(coalesce(text, '')), '{cut}'), 1) AS k FROM documents),
hit AS (SELECT doc_id, k, id FROM cut JOIN known ON trim(regexp_replace(s, '{OTHER}', ' ', 'g')) = sentence WHERE length(s) <= {2 * max(map(len, SENTENCES))}),
listed AS (SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY k) AS sentence_ids, ' ' || string_agg(id::VARCHAR, '  ' ORDER BY k) || ' ' AS spaced, count(*)::BIGINT AS n_sentences FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n_sentences, 0)::BIGINT AS n_sentences,
  CASE WHEN spaced IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') END AS licenses
FROM documents d LEFT JOIN listed USING (doc_id)"""

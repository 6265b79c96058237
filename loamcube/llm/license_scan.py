"""Licence scan by sentence rules, in DataFrame functions alone.

A text is normalised (a-z, 0-9, single spaces; marks where sentences and lines end) and its known sentences,
those that licences and their notices consist of, are mapped to identifiers. A known sentence may be wrapped
over lines, stand behind comment signs or a list number, and end a longer sentence; it must end where a
sentence or a line does. What remains of a document is the sequence of the identifiers it holds, in order.
Rules are sequences of identifiers; the longer ones claim their part of the sequence first, so that the
clauses of a long licence don't also count as a shorter one that shares them.

Documents without any of the few words that every known sentence holds one of are passed over before they
are normalised; that test is part of the tables (see ``CLUES``) and loses nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, normalised (a-z, 0-9, single spaces).
SENTENCES: dict[str, str] = {
    "AP1": "licensed under the apache license version 2 0",
    "AP2": "licensed under the apache license version 2 0 the license",
    "AP3": "you may not use this file except in compliance with the license",
    "AP4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "AP5": "see the license for the specific language governing permissions and limitations under the license",
    "BS1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BS2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BS3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BS4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC1": "licensed under cc by nc 4 0",
    "CC2": "licensed under cc by 4 0",
    "CC3": "licensed under cc by sa 4 0",
    "CC4": "this work is licensed under a creative commons attribution 4 0 international license",
    "CC5": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CC6": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "GP1": "this work is licensed under the gnu general public license version 3",
    "GP0": "this program is free software",
    "GP2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GP3": "this program is distributed in the hope that it will be useful but without any warranty",
    "GPW": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "GP4": "see the gnu general public license for more details",
    "GP5": "licensed under the gnu general public license version 2",
    "IS1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "MI1": "released under the mit license",
    "MI2": "licensed under the mit license",
    "MI3": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MI4": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MP1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "RS1": "all rights reserved",
    "GF1": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "GF2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "GF3": "either version 2 of the license or at your option any later version",
    "GF4": "either version 2 1 of the license or at your option any later version",
    "GP6": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LG0": "this library is free software",
    "LG1": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LG2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LG3": "this library is distributed in the hope that it will be useful but without any warranty",
    "LG4": "see the gnu lesser general public license for more details",
    "AG1": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AG4": "see the gnu affero general public license for more details",
    "ZE1": "licensed under cc0 1 0",
    "SX1": "spdx license identifier mit",
    "SX2": "spdx license identifier apache 2 0",
    "SX3": "spdx license identifier bsd 3 clause",
    "SX4": "spdx license identifier bsd 2 clause",
    "SX5": "spdx license identifier isc",
    "SX6": "spdx license identifier mpl 2 0",
    "SX7": "spdx license identifier gpl 2 0 only",
    "SX8": "spdx license identifier gpl 2 0 or later",
    "SX9": "spdx license identifier gpl 3 0 only",
    "SXA": "spdx license identifier gpl 3 0 or later",
    "SXB": "spdx license identifier lgpl 2 1 or later",
    "SXC": "spdx license identifier agpl 3 0 or later",
    "SXD": "spdx license identifier cc0 1 0",
    "UN1": "this is free and unencumbered software released into the public domain",
}
# Licence and the sequence of its sentences; of rules that fit at one place the longest wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("AP2", "AP3", "AP4", "AP5")),
    ("BSD-3-Clause", ("BS1", "BS2", "BS3", "BS4")),
    ("BSD-2-Clause", ("BS1", "BS2", "BS3")),
    ("GPL-3.0-or-later", ("GP0", "GP2", "GP3", "GPW", "GP4")),
    ("GPL-2.0-or-later", ("GP0", "GF1", "GF3", "GP3", "GPW", "GP4")),
    ("GPL-2.0-or-later", ("GP0", "GP6", "GP3", "GPW", "GP4")),
    ("LGPL-2.1-or-later", ("LG0", "GF2", "GF4", "LG3", "GPW", "LG4")),
    ("LGPL-2.1-or-later", ("LG0", "LG1", "LG3", "GPW", "LG4")),
    ("LGPL-3.0-or-later", ("GP0", "LG2", "GP3", "GPW", "LG4")),
    ("AGPL-3.0-or-later", ("GP0", "AG1", "GP3", "GPW", "AG4")),
    ("MIT", ("MI3", "MI4")),
    ("Apache-2.0", ("AP1",)),
    ("CC-BY-NC-4.0", ("CC1",)),
    ("CC-BY-NC-4.0", ("CC6",)),
    ("CC-BY-4.0", ("CC2",)),
    ("CC-BY-4.0", ("CC4",)),
    ("CC-BY-SA-4.0", ("CC3",)),
    ("CC-BY-SA-4.0", ("CC5",)),
    ("GPL-3.0-only", ("GP1",)),
    ("GPL-2.0-only", ("GP5",)),
    ("ISC", ("IS1",)),
    ("MIT", ("MI1",)),
    ("MIT", ("MI2",)),
    ("MPL-2.0", ("MP1",)),
    ("Unlicense", ("UN1",)),
    ("CC0-1.0", ("ZE1",)),
    ("MIT", ("SX1",)),
    ("Apache-2.0", ("SX2",)),
    ("BSD-3-Clause", ("SX3",)),
    ("BSD-2-Clause", ("SX4",)),
    ("ISC", ("SX5",)),
    ("MPL-2.0", ("SX6",)),
    ("GPL-2.0-only", ("SX7",)),
    ("GPL-2.0-or-later", ("SX8",)),
    ("GPL-3.0-only", ("SX9",)),
    ("GPL-3.0-or-later", ("SXA",)),
    ("LGPL-2.1-or-later", ("SXB",)),
    ("AGPL-3.0-or-later", ("SXC",)),
    ("CC0-1.0", ("SXD",)),
    ("all-rights-reserved", ("RS1",)),
)
#: Every known sentence holds one of these.
CLUES = ("license", "reserved", "redistribut", "permission", "warrant", "domain", "free software")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Steps of normalisation, (pattern, replacement), after A-Z are lower-cased; then B ends a sentence, L a line.
_STEPS = (
    # a machine-readable line is one sentence
    ("spdx-license-identifier: *", "spdx license identifier "),
    # the point of an abbreviated version ends nothing
    ("([^a-z0-9]v)\\. *([0-9])", "\\1 \\2"),
    # a list number begins anew
    ("\\n[^a-z0-9\\n]*([0-9]{1,3}|[a-z])[.)][ \\t]+", "\n\n"),
    # a point and white space, or lines without words (one class of characters: a repeated group would take stack for each line)
    ("[.!?:;][\"')\\]]*[ \\t\\r\\n]+|[.!?:;]+$|\\n[^a-z0-9]*\\n", " B "),
    ("\\n", " L "),
    ("[^a-z0-9BL]+", " "),
)


def _known_sentence() -> str:
    """Pattern of any known sentence, longest first, words apart or on two lines."""
    longest_first = sorted(SENTENCES.values(), key=lambda s: (-len(s), s))
    return "(?:^| )(" + "|".join(s.replace(" ", "(?: L)? ") for s in longest_first) + ")(?: [BL]|$)"


def ordered_rules() -> list[tuple[str, str]]:
    """(licence, text that its sequence has in ``|AP1|RS1|``), longest sequence first."""
    by_length = sorted(RULES, key=lambda rule: -len(rule[1]))
    return [(name, "".join(f"|{s}|" for s in ids)) for name, ids in by_length]


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences in order, each between bars; empty if there are none."""
    out = F.translate(text, _UPPER, _LOWER)
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    known = F.create_map(*[F.lit(x) for pair in ((s, k) for k, s in SENTENCES.items()) for x in pair])
    found = F.regexp_extract_all(F.trim(out), F.lit(_known_sentence()), F.lit(1))
    return F.concat_ws("", F.transform(found, lambda s: F.concat(F.lit("|"), known[F.replace(s, F.lit(" L"), F.lit(""))], F.lit("|"))))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ls_ids`` (known sentences), ``ls_n_known``, ``ls_licenses`` (names, sorted, comma-joined).

    A null or empty text holds nothing: an empty string, 0, an empty string. Whole texts are read, however long their
    sentences; equal rows get equal results, an empty table gives an empty one. A licence found twice is
    named once. Columns named ``ls_*`` are replaced, all others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.translate(text, _UPPER, _LOWER)
    clue = reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in CLUES])
    out = docs.withColumn("ls_ids", F.when(clue, sentence_ids(text)).otherwise(F.lit("")))
    rest, found = F.col("ls_ids"), []
    for n, (name, pattern) in enumerate(ordered_rules()):
        found.append(F.when(F.contains(rest, F.lit(pattern)), F.lit(name)))
        out = out.withColumn(f"ls_{n}", found[-1])
        out = out.withColumn("ls_rest", F.replace(rest, F.lit(pattern), F.lit("#")))
        rest = F.col("ls_rest")
    hits = [f"ls_{n}" for n in range(len(found))]
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    out = out.withColumns({"ls_licenses": F.array_join(names, ","), "ls_n_known": (F.length("ls_ids") / 5).cast("long")})
    return out.drop("ls_rest", *hits)


def oracle_sql() -> str:
    """The same digest over ``documents`` for DuckDB."""
    known = "MAP {" + ", ".join(f"'{s}': '{k}'" for k, s in SENTENCES.items()) + "}"
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, by in _STEPS:
        pattern, by = pattern.replace("'", "''"), by.replace("\n", "' || chr(10) || '")
        low = f"regexp_replace({low}, '{pattern}', '{by}', 'g')"
    sql = f"""WITH t AS (SELECT doc_id, trim({low}) AS low FROM documents),
    k AS (SELECT doc_id, list_transform(regexp_extract_all(low, '{_known_sentence()}', 1), lambda s: '|' || {known}[replace(s, ' L', '')] || '|') AS ids FROM t),
    r0 AS (SELECT doc_id, coalesce(array_to_string(ids, ''), '') AS rest, coalesce(array_to_string(ids, ''), '') AS ids, CAST([] AS VARCHAR[]) AS found FROM k)"""
    last = 0
    for n, (name, pattern) in enumerate(ordered_rules()):
        sql += f""",
    r{n + 1} AS (SELECT doc_id, ids, replace(rest, '{pattern}', '#') AS rest, CASE WHEN contains(rest, '{pattern}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{n})"""
        last = n + 1
    return sql + f"""
    SELECT doc_id, CAST(length(ids) / 5 AS BIGINT) AS n_sentences, ids AS sentence_ids,
           coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses, len(found) > 0 AS has_license FROM r{last}"""

"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut after ".", "!", "?" or ";" with white space, and around SPDX tags. The pieces are normalised (lower
case, all but a-z and 0-9 as one space), so comment markers go; a line end stays as a mark. A known licence sentence
is found where it begins and ends at a cut or a line end, with any line ends inside it: wrapped and commented texts
are read like unbroken ones, and a notice on a line of its own needs no stop around it. Of two that begin together
the longer one counts. A tag gives every licence identifier of its expression, known or not; exceptions after WITH
are no licences.

The identifiers found, in order, are matched against ordered licence rules: a rule holds if its identifiers occur
in its order, others may stand between; of a family the first rule that holds counts. A tag of a licence without
rules counts as written. One pass, no shuffle. Texts without any word that every known sentence has one of are not cut.

Null and empty texts have no sentences. Repeated rows are judged one by one. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, and their usual short names.
SENTENCES = {
    "mit.notice": "Released under the MIT License",
    "mit.licensed": "Licensed under the MIT License",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache.notice": "Licensed under the Apache License, Version 2.0",
    "apache.header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache.compliance": "you may not use this file except in compliance with the License",
    "apache.basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.free": "This program is free software",
    "gpl2.terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2.version": "either version 2 of the License, or (at your option) any later version",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl.free": "This library is free software",
    "lgpl.terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl.version": "either version 2.1 of the License, or (at your option) any later version",
    "mpl.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "bsd.head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.domain": "This is free and unencumbered software released into the public domain",
    "ccbync.notice": "Licensed under CC BY-NC 4.0",
    "ccby.notice": "Licensed under CC BY 4.0",
    "ccbysa.notice": "Licensed under CC BY-SA 4.0",
    "ccby.work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbync.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ccbysa.work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
#: The parts of a sentence that licence texts break in two; tried before the unbroken form.
PARTS = {
    "mit.grant": SENTENCES["mit.grant"].partition(": The above")[0],
    "mit.condition": "The above" + SENTENCES["mit.grant"].partition(": The above")[2],
}
#: (family, licence, identifiers in order), the first of a family that holds counts.
RULES = (
    ("mit", "MIT", ("mit.grant", "mit.warranty")),
    ("mit", "MIT", ("mit.notice",)),
    ("mit", "MIT", ("mit.licensed",)),
    ("mit", "MIT", ("mit.grant",)),
    ("apache", "Apache-2.0", ("apache.header", "apache.compliance", "apache.basis")),
    ("apache", "Apache-2.0", ("apache.header",)),
    ("apache", "Apache-2.0", ("apache.notice",)),
    ("gpl", "GPL-3.0-only", ("gpl3.notice",)),
    ("gpl", "GPL-3.0-or-later", ("gpl.free",)),
    ("gpl", "GPL-2.0-or-later", ("gpl2.free", "gpl2.terms", "gpl2.version")),
    ("lgpl", "LGPL-2.1-or-later", ("lgpl.free", "lgpl.terms", "lgpl.version")),
    ("mpl", "MPL-2.0", ("mpl.notice",)),
    ("mpl", "MPL-2.0", ("mpl.terms",)),
    ("bsd", "BSD-3-Clause", ("bsd.source", "bsd.binary", "bsd.names")),
    ("bsd", "BSD-2-Clause", ("bsd.source", "bsd.binary")),
    ("isc", "ISC", ("isc.grant",)),
    ("unlicense", "Unlicense", ("unlicense.domain",)),
    ("cc", "CC-BY-NC-4.0", ("ccbync.notice",)),
    ("cc", "CC-BY-NC-4.0", ("ccbync.work",)),
    ("cc", "CC-BY-SA-4.0", ("ccbysa.notice",)),
    ("cc", "CC-BY-SA-4.0", ("ccbysa.work",)),
    ("cc", "CC-BY-4.0", ("ccby.notice",)),
    ("cc", "CC-BY-4.0", ("ccby.work",)),
)
#: Every known sentence holds one of these in lower case.
ANCHORS = ("licen", "permission", "redistribut", "warrant", "software")
STOP, BREAK, TAGGED = r"([.!?;])\s+", "\x01", "\x02"
SPDX = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = rf"(?i)SPDX-License-Identifier[ \t]*:[ \t]*([( \t]*{SPDX}(?:[) \t]+(?:and|or|with)[( \t]+{SPDX})*)"
NO_LICENCE = r"(?i)(?<![^\s(])with[ \t]+[A-Za-z0-9.+-]+|(?<![^\s(])(?:and|or|none|noassertion)(?![^\s)])"
COMMENT_WORD = r"(?im)^[ \t]*@?(?:dnl|rem|comment)[ \t]+"  # markers that are words


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier, with a tag sentence for every licence of the rules."""
    tags = {f"spdx-license-identifier {licence}": f"spdx.{licence.lower()}" for _, licence, _ in RULES}
    return {normalised(s): name for name, s in SENTENCES.items()} | {normalised(s): name for s, name in tags.items()}


def told_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier in the order in which they are tried: parts, then longer ones first."""
    return {normalised(s): name for name, s in PARTS.items()} | dict(sorted(known().items(), key=lambda x: -len(x[0])))


def sentence_pattern() -> str:
    """A known sentence between line marks, with a space or a line mark between its words."""
    return "(?<=\n)(?:" + "|".join(s.replace(" ", "[ \n]") for s in told_sentences()) + ")(?=\n)"


def rules():
    """The ordered rules; a tag is the last rule of its family for that licence."""
    tags = dict.fromkeys((family, licence, (f"spdx.{licence.lower()}",)) for family, licence, _ in RULES)
    return (*RULES, *tags)


def rule_pattern(identifiers) -> str:
    """Pattern over ",id,id," that holds if the identifiers occur in order."""
    return ",(?:.*,)?".join(re.escape(i).replace("\\-", "-") for i in identifiers).join((",", ","))


def find_licences(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, n_sentences (licence sentences), sentence_ids (in order), licences (sorted)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = F.lower("text")
    anchored = low.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        anchored = anchored | low.contains(anchor)
    cut = F.regexp_replace(F.regexp_replace(F.translate("text", TAGGED, " "), COMMENT_WORD, " "), EXPRESSION, BREAK + TAGGED + "$1" + BREAK)
    cut = F.split(F.regexp_replace(cut, STOP, "$1" + BREAK), BREAK)
    rows = rows.select("id", F.when(anchored, cut).otherwise(F.array().cast("array<string>")).alias("pieces"))
    names = F.create_map(*(F.lit(x) for pair in told_sentences().items() for x in pair))
    ruled = {f"spdx.{licence.lower()}" for _, licence, _ in RULES}
    # line marks around each piece, and one for each run of other characters that holds a line end
    lined = lambda s: F.regexp_replace(
        F.concat(F.lit("\n"), F.regexp_replace(F.lower(s), r"[^a-z0-9\n\r]+", " "), F.lit("\n")), r" ?[\n\r][ \n\r]*", "\n")
    sentences = lambda s: F.transform(F.regexp_extract_all(lined(s), F.lit(sentence_pattern()), F.lit(0)), lambda x: F.struct(
        F.try_element_at(names, F.translate(x, "\n", " ")).alias("name"), F.lit(None).cast("string").alias("own")))
    tags = lambda s: F.transform(F.regexp_extract_all(F.regexp_replace(s, NO_LICENCE, " "), F.lit(SPDX), F.lit(0)), lambda x: F.struct(
        F.concat(F.lit("spdx."), F.lower(x)).alias("name"), F.when(~F.concat(F.lit("spdx."), F.lower(x)).isin(*sorted(ruled)), x).alias("own")))
    found = F.flatten(F.transform("pieces", lambda s: F.when(s.startswith(TAGGED), tags(F.substring(s, 2, 1 << 30))).otherwise(sentences(s))))
    rows = rows.select("id", found.alias("found"))
    rows = rows.select("id", F.col("found.name").alias("ids"), F.array_compact(F.col("found.own")).alias("own"))
    first = F.filter("own", lambda x, i: F.array_position(F.transform("own", F.lower), F.lower(x)) == i + 1)
    rows = rows.select("id", "ids", first.alias("own"), F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")).alias("sequence"))
    families: dict[str, list] = {}
    for family, licence, identifiers in rules():
        families.setdefault(family, []).append((licence, rule_pattern(identifiers)))
    held = []
    for options in families.values():
        choice = F.when(F.col("sequence").rlike(options[0][1]), options[0][0])
        for licence, pattern in options[1:]:
            choice = choice.when(F.col("sequence").rlike(pattern), licence)
        held.append(choice)
    licences = F.array_join(F.array_sort(F.concat(F.array_compact(F.array(*held)), "own")), ",")
    return rows.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("ids") > 0, licences).otherwise("").alias("licences"))


def licence_sql() -> str:
    """The same over ``documents`` in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n  ".join(f"({quote(s)}, {quote(i)})" for s, i in known().items())
    families: dict[str, list] = {}
    for family, licence, identifiers in rules():
        families.setdefault(family, []).append(f"WHEN regexp_matches(q, {quote(rule_pattern(identifiers))}) THEN {quote(licence)}")
    cases = ", ".join("CASE " + " ".join(c) + " END" for c in families.values())
    return f"""
WITH names(s, id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(
        regexp_replace(coalesce(text, ''), '(SPDX-License-Identifier:[^\\n]*)\\n', '\\1' || chr(1), 'g'), '\\s*\\n\\s*([^a-z\\s(])', chr(1) || '\\1', 'g'),
        '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS c FROM documents),
e AS (SELECT r, unnest(c) AS s, generate_subscripts(c, 1) AS i FROM d),
f AS (SELECT r, i, names.id FROM e JOIN names ON names.s = trim(regexp_replace(lower(e.s), '[^a-z0-9]+', ' ', 'g'))),
g AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM f GROUP BY r),
h AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, ',' || coalesce(ids, '') || ',' AS q FROM d LEFT JOIN g USING (r))
SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ','), '') AS licences FROM h
"""

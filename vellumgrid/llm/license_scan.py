"""Licence scans by sentence rules, in built-in expressions only.

A text is normalised to its words (runs of ASCII letters and digits, lower-cased) in a row, so that line breaks, indents,
comment marks and punctuation don't matter. Known licence sentences are recognised in it wherever their words stand in
a row, the longer of two that begin at one word first, and replaced by their identifiers. The sequence of identifiers
is then matched against ordered rules: a rule is a sequence of identifiers that has to occur without another known
sentence between, and longer rules take their sentences before shorter ones see them. Everything happens within a row,
so a scan has no shuffle, and only texts that hold an anchor, which every known sentence does, are looked at.

Defined results: null or blank texts have no sentences; repeated rows are scanned alike; a known sentence that no rule
took is listed as unmatched; an empty table gives no rows; only the key and the text are read, so other columns don't
clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import LOWER, UPPER, table

# Names of licences, as SPDX identifier -> the ways a notice names it.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT/X11 License", "terms of the MIT License", "MIT"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GNU GPL version 3 or later", "GPLv3 or later", "GPL-3.0-or-later", "GPL-3.0+"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL-2.0"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GNU GPL version 2 or later", "GPLv2 or later", "GPL-2.0-or-later", "GPL-2.0+"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1 or later", "LGPL-2.1-or-later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPLv3 or later", "LGPL-3.0-or-later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPLv3 or later", "AGPL-3.0-or-later"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
NOTICES = ["licensed under {the}{name}", "released under {the}{name}", "distributed under {the}{name}", "available under {the}{name}", "SPDX-License-Identifier: {name}"]
# Sentences of licence texts and file headers; {gpl} stands for the names that the GNU licences share them under.
SENTENCES: dict[str, str] = {
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gnu-warranty": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.",
    "gpl-2-license": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "proprietary": "All rights reserved.",
}
#: (rule, SPDX identifier, ordered sentence identifiers).
RULES: list[tuple[str, str, list[str]]] = [
    ("apache-header", "Apache-2.0", ["notice:Apache-2.0", "apache-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("apache-text", "Apache-2.0", ["apache-title"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice"]),
    ("mpl-header", "MPL-2.0", ["mpl-header", "mpl-copy"]),
    *[(f"{k}{n}-header", spdx, [*s, "gnu-warranty", f"{k.split('-')[0]}-see"]) for k, n, spdx, s in (
        ("gpl-3", "-or-later", "GPL-3.0-or-later", ["gpl-3-later"]), ("gpl-2", "-or-later", "GPL-2.0-or-later", ["gpl-2-later"]), ("gpl-3", "", "GPL-3.0-only", ["gpl-3"]),
        ("gpl-2", "", "GPL-2.0-only", ["gpl-2"]), ("gpl-2", "-license", "GPL-2.0-only", ["gpl-2-license"]), ("lgpl-3", "-or-later", "LGPL-3.0-or-later", ["lgpl-3-later"]),
        ("lgpl-2.1", "-or-later", "LGPL-2.1-or-later", ["lgpl-21-later"]), ("agpl-3", "-or-later", "AGPL-3.0-or-later", ["agpl-3-later"]),
    )],
    ("gpl-3-text", "GPL-3.0-only", ["gpl-3-title"]),
    ("gpl-2-text", "GPL-2.0-only", ["gpl-2-title"]),
    ("mpl-notice", "MPL-2.0", ["mpl-header"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense"]),
    ("boost-text", "BSL-1.0", ["boost-grant"]),
    ("zlib-text", "Zlib", ["zlib-grant"]),
    *[(f"notice:{k}", k, [f"notice:{k}"]) for k in NAMES],
]
#: Every known sentence holds one of these, as it stands in a text, whatever breaks and marks lie between its words.
ANCHOR = "licen|permi|warrant|redistrib|copyright|released|distributed|available|rights|mpl"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known() -> dict[str, str]:
    """Normalised sentence -> identifier, built from NAMES x NOTICES and SENTENCES, the longest first."""
    out = {normalised(n.format(the=the, name=name)): f"notice:{k}" for k, names in NAMES.items() for name in names for n in NOTICES for the in ("", "the ")}
    out |= {normalised(s): k for k, s in SENTENCES.items()}
    assert all(re.search(ANCHOR, s) for s in out), "every known sentence needs an anchor"
    return dict(sorted(out.items(), key=lambda x: (-len(x[0]), x[0])))


def pattern() -> str:
    """All known sentences in the row of words, where each word has a space before it: of those that begin at a word, the longest."""
    by_first: dict[str, list[str]] = {}
    for sentence in known():
        first, rest = sentence.split(" ", 1)
        by_first.setdefault(first, []).append(rest)
    return f" ((?:{'|'.join(f'{first} (?:{chr(124).join(rest)})' for first, rest in by_first.items())}))(?= )"


def ordered_rules() -> list[tuple[str, str, list[str]]]:
    """RULES, the longer before the shorter."""
    return sorted(RULES, key=lambda r: -len(r[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_ids, rules, licenses, unmatched): arrays, the ids and rules in the text's order, licenses sorted."""
    ids = F.create_map(*[F.lit(x) for kv in known().items() for x in kv])
    spdx = F.create_map(*[F.lit(x) for r, k, _ in RULES for x in (r, k)])
    df = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    row = F.concat(F.lit(" "), F.regexp_replace(F.translate("_t", UPPER, LOWER), "[^a-z0-9]+", " "), F.lit(" "))
    # Each word gets a space of its own on either side: neighbouring sentences share none.
    df = df.withColumn("_s", F.when(F.col("_t").rlike(f"(?i){ANCHOR}"), F.regexp_extract_all(row, F.lit(pattern()), F.lit(1))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("sentence_ids", F.transform("_s", lambda s: F.element_at(ids, s)))
    left: Column = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for name, _, sequence in ordered_rules():
        left = F.replace(left, F.lit("".join(f"<{x}>" for x in sequence)), F.lit(f"{{{name}}}"))
    df = df.withColumn("_q", left)
    df = df.withColumn("rules", F.array_distinct(F.regexp_extract_all("_q", F.lit(r"\{([^}]+)\}"), F.lit(1))))
    df = df.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.element_at(spdx, r)))))
    df = df.withColumn("unmatched", F.array_distinct(F.regexp_extract_all("_q", F.lit("<([^>]+)>"), F.lit(1))))
    return df.select(key, "sentence_ids", "rules", "licenses", "unmatched")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licenses", "unmatched")])


def _oracle() -> str:
    """DuckDB has no look-ahead: each word gets two spaces of its own, and a sentence takes its last one's."""
    values = ", ".join(f"('{s.replace(' ', '  ')}', '{k}')" for s, k in known().items())
    spdx = ", ".join(f"('{r}', '{k}')" for r, k, _ in RULES)
    left = "string_agg('<' || id || '>', '' ORDER BY pos)"
    for name, _, sequence in ordered_rules():
        left = f"replace({left}, '{''.join(f'<{x}>' for x in sequence)}', '{{{name}}}')"
    any_ = "|".join(s.replace(" ", "  ") for s in known())
    return rf"""
WITH known(s, id) AS (VALUES {values}), spdx(rule, id) AS (VALUES {spdx}),
d AS (SELECT row_number() OVER () AS r, doc_id, '  ' || regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', '  ', 'g') || '  ' AS t FROM documents),
f AS (SELECT r, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT r, regexp_extract_all(t, ' ({any_}) ', 1) AS p FROM d)),
k AS (SELECT r, pos, id FROM f JOIN known USING (s)),
q AS (SELECT r, string_agg(id, ',' ORDER BY pos) AS ids, {left} AS q FROM k GROUP BY r),
x AS (SELECT r, ids, regexp_extract_all(q, '\{{([^}}]+)\}}', 1) AS rules, regexp_extract_all(q, '<([^>]+)>', 1) AS rest FROM q),
a AS (SELECT r, string_agg(DISTINCT spdx.id, ',' ORDER BY spdx.id) AS licenses FROM (SELECT r, unnest(rules) AS rule FROM x) JOIN spdx USING (rule) GROUP BY r),
u AS (SELECT r, ids, array_to_string(list_filter(rules, lambda v, i: list_position(rules, v) = i), ',') AS rules, array_to_string(list_filter(rest, lambda v, i: list_position(rest, v) = i), ',') AS rest FROM x)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses, coalesce(rest, '') AS unmatched
FROM d LEFT JOIN u USING (r) LEFT JOIN a USING (r)"""


ORACLE = _oracle()

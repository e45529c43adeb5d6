"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised and cut into sentences. Each sentence that a licence is known to consist of maps to an
identifier; a sentence that isn't known is tried again line by line. The identifiers of a text, in order, are
matched against ordered licence rules, each a sequence of identifiers: the first rule takes its occurrences out, then
the next one is tried on what is left, so that longer rules come before those they contain.

Null and empty texts have no sentences and no licences. Rows are judged alone: repeated rows and null ids get their
own rows; extra columns are dropped; an empty table gives an empty table. A text's licences are its rules' names in the
order of the rules. Sentences other than the known ones are ignored, between those of a rule too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "apache2-you": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "gpl3-notice": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "gpl-details": ["See the GNU General Public License for more details."],
    "bsd-head": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "ccbync4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "ccby4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "ccbysa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "unlicense-free": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "isc-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ],
    "isc-liability": [
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "bsd-as-is": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ],
    "bsd-liability": [
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ],
    "apache2-unless": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "gpl2-only": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    ],
    "lgpl21-free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "lgpl3-free": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-hope": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "lgpl-details": ["See the GNU Lesser General Public License for more details."],
    "agpl3-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc0-deed": [
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "boost-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0."],
}

#: (licence, its identifiers in order); earlier rules win.
RULES = (
    ("MIT", ("mit-grant", "mit-keep", "as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-you", "apache2-copy", "apache2-unless", "apache2-see")),
    ("Apache-2.0", ("apache2-you", "apache2-copy")),
    ("Apache-2.0", ("apache2-you",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC0-1.0", ("cc0-deed",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("Unlicense", ("unlicense",)),
)
#: A sentence ends at these marks before white space (a colon: at the end of a line) and at an empty line; 2.0 stays whole.
OTHER, END = r"[^A-Za-z0-9\n.:!?]+", r"[.!?]+(?=[ \n])|:(?= *\n)|\n *\n"


def normal(sentence: str) -> str:
    """A known sentence as it comes out of a text."""
    plain = re.sub(OTHER, " ", sentence).lower() + "\n"
    parts = [re.sub(r"[ \n]+", " ", p).strip(" ") for p in re.split(END, plain)]
    parts = [p for p in parts if p]
    if len(parts) != 1:
        raise ValueError(f"not one sentence: {sentence}")
    return parts[0]


def known_sentences(sentences=None) -> dict[str, str]:
    return {normal(x): name for name, group in (sentences or SENTENCES).items() for x in group}


def sentence_ids(text: Column, sentences=None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known_sentences(sentences)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    plain = F.concat(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), OTHER, " ")), F.lit("\n"))
    clean = lambda s: F.trim(F.regexp_replace(s, r"[ \n]+", " "))
    is_known = lambda s: s.isin(*known)

    def found(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\n"), clean), is_known)
        return F.when(is_known(clean(s)), F.array(clean(s))).when(F.contains(s, F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))

    return F.transform(F.flatten(F.transform(F.split(plain, END), found)), lambda s: F.element_at(table, s))


def licences(ids: Column, rules=RULES) -> Column:
    """The licences whose rules match a sequence of identifiers (an array), each once, in the order of the rules."""

    # identifiers are doubly spaced, so that neighbouring occurrences don't share a space
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(parts) + " ").alias("ids")) for name, parts in rules])

    def step(done: Column, rule: Column) -> Column:
        hit = F.contains(done["seq"], rule["ids"])
        return F.struct(F.replace(done["seq"], rule["ids"], F.lit(" ; ")).alias("seq"), F.when(hit, F.array_append(done["hits"], rule["name"])).otherwise(done["hits"]).alias("hits"))

    def match(seq: Column) -> Column:
        return F.aggregate(table, F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("hits")), step, lambda done: F.array_distinct(done["hits"]))

    seq = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(match(seq))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """(id_col, sentence_ids array, licences array) of every document."""
    ids = docs.select(F.col(f"`{id_col}`").alias(id_col), sentence_ids(F.col(f"`{text_col}`").cast("string"), sentences).alias("sentence_ids"))
    return ids.withColumn("licences", licences(F.col("sentence_ids"), rules))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = known_sentences()
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items()) + "}"
    steps, hits = [], []
    for k, (name, parts) in enumerate(RULES):
        pattern = quote(" " + "  ".join(parts) + " ")
        hits.append(f"CASE WHEN contains(seq{k}, {pattern}) THEN {quote(name)} END")
        steps.append(f"r{k + 1} AS (SELECT *, replace(seq{k}, {pattern}, ' ; ') AS seq{k + 1} FROM r{k})")
    clean = r"trim(regexp_replace({0}, '[ \n]+', ' ', 'g'), ' ')"
    keys = "[" + ", ".join(quote(k) for k in known) + "]"
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(
    lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n.:!?]+', ' ', 'g')) || chr(10),
    '[.!?]+([ \n])|:( *\n)', '§\1\2', 'g'), '\n *\n', '§', 'g'), '§') AS parts
  FROM documents),
one AS (
  SELECT doc_id, list_filter(flatten(list_transform(parts, lambda s:
    CASE WHEN list_contains({keys}, {clean.format("s")}) THEN [{clean.format("s")}]
         ELSE list_filter(list_transform(string_split(s, chr(10)), lambda x: {clean.format("x")}), lambda x: list_contains({keys}, x)) END)),
    lambda s: s IS NOT NULL) AS found
  FROM cut),
r0 AS (
  SELECT doc_id, array_to_string(list_transform(found, lambda s: {table}[s]), ' ') AS sentence_ids,
         ' ' || array_to_string(list_transform(found, lambda s: {table}[s]), '  ') || ' ' AS seq0
  FROM one),
{", ".join(steps)}
SELECT doc_id, sentence_ids,
       array_to_string(list_transform(list_filter(list_distinct_in_order, lambda h: h IS NOT NULL), lambda h: h), ' ') AS licences
FROM (SELECT doc_id, sentence_ids,
        list_filter(hits, lambda h, i: h IS NOT NULL AND NOT list_contains(hits[1:i - 1], h)) AS list_distinct_in_order
      FROM (SELECT doc_id, sentence_ids, [{", ".join(hits)}] AS hits FROM r{len(RULES)}))
"""


QUERIES = {"op8_license_scan": op8_license_scan}
SQL = {"op8_license_scan": _sql()}

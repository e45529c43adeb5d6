from tessera.llm import license_scan as L


def test_sequences_match_ordered_rules(spark):
    mit = "\n".join(L.SENTENCES["mit-grant"] + L.SENTENCES["mit-keep"] + L.SENTENCES["as-is"])
    bsd = "\n  * ".join(x for k in ("bsd-head", "bsd-source", "bsd-binary") for x in L.SENTENCES[k])
    wrapped = L.SENTENCES["gpl-free"][0].replace(" the ", "\nthe ")
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore", ["MIT"]),
        (2, mit, ["MIT"]),
        (3, bsd + "\n" + L.SENTENCES["bsd-names"][0], ["BSD-3-Clause"]),
        (4, bsd, ["BSD-2-Clause"]),
        (5, "intro.\n\n" + wrapped + "\n" + L.SENTENCES["gpl-hope"][0], ["GPL-3.0-or-later"]),
        (6, None, []),
        (7, "", []),
        (None, "a heading\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        (8, "Licensed under the Apache License, Version 2.0. RELEASED under the  MIT License! É", ["MIT", "Apache-2.0"]),
        (8, "Never released under the MIT License.", []),
        (9, ("word " * 20000) + ". Released under the MIT License.", ["MIT"]),
        (10, "Released under the MIT License. Released under the MIT License.", ["MIT"]),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, licences string")
    got = L.scan(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.licences) for r in got), key=key) == sorted(((i, w) for i, _, w in rows), key=key)
    assert next(r.sentence_ids for r in got if r.doc_id == 10) == ["mit-notice"] * 2
    assert L.scan(docs.limit(0)).count() == 0


def test_known_sentences_are_single():
    assert len(L.known_sentences()) == sum(map(len, L.SENTENCES.values()))


TEXTS = {
    "ISC": """Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "MIT": """# Copyright <YEAR> <COPYRIGHT HOLDER>
#
# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
# associated documentation files (the "Software"), to deal in the Software without restriction, including
# without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
# the following conditions:
#
# The above copyright notice and this permission notice shall be included in all copies or substantial
# portions of the Software.
#
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
# LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
# NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
# WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
# SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.",
}


def test_texts_as_they_are_published(spark):
    docs = spark.createDataFrame([(k, f"Some words before.\n\n{t}\n\nand after.") for k, t in TEXTS.items()], "doc_id string, text string")
    assert {r.doc_id: r.licences for r in L.scan(docs).collect()} == {k: [k] for k in TEXTS}

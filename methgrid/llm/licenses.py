"""License scans by conditional compression.

Words that licenses use are cues. The words about a cue are candidate blocks of several sizes, for
one-line notices up to whole texts. Each block is compressed alone and with every template as
zstandard's raw dictionary; templates are ranked by how much smaller the block gets. All that
make it smaller by ``REDUCTION`` or more are confirmed by their exact wording: the words missing
from and added to the closest form of the template, among which names and versions may not be.
The form about the cue with the most words in place wins, and the search goes on behind it.

Licenses too long to be quoted whole in files (GPL, Apache, ...) are known by their titles and by
the notices that they ask for. The opening of the BSD texts alone doesn't tell them apart, and
is reported as ``BSD``.

Spans are code points, end exclusive. Nulls: a null text is an empty text without findings; a null
``doc_id`` is carried. Very long texts are scanned whole. Repeated rows give the same findings
each, empty tables none. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, read_table

#: Names of licenses as notices write them.
NAMES = {
    "MIT": ["the MIT License", "MIT", "an MIT-style license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0", "the Apache License 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "the Modified BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPLv2", "the GPL version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPLv3", "the GPL version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0"],
    "ISC": ["the ISC License", "ISC"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "EPL 2.0"],
    "BSL-1.0": ["the Boost Software License, version 1.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons Zero 1.0 license"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
#: What stands before the name.
LEADS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under the terms of", "SPDX-License-Identifier:"]
#: Texts of licenses, their notices and titles.
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION',
    ],
    "BSD": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:',
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ],
    "GPL-2.0": [
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
        'GNU GENERAL PUBLIC LICENSE Version 2, June 1991',
    ],
    "GPL-3.0": [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007',
    ],
    "LGPL-2.1": [
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
        'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999',
    ],
    "LGPL-3.0": [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007',
    ],
    "AGPL-3.0": [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007',
    ],
    "MPL-2.0": [
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "EPL-2.0": [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    ],
    "BSL-1.0": [
        'Boost Software License - Version 1.0 - August 17th, 2003',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain.',
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ],
}
#: Cues, one of which is in every form.
CUES = r"(?i)licen[sc]e|\b(?:released|distributed|available) under\b|spdx|redistribut|\bpermission (?:is|to)\b|public domain|\bcreative commons\b|\bcc0?[ -]by\b"
#: Compressed sizes fall by this share at least; words that may differ, as a share of the form's.
REDUCTION, DIFFERENT = 0.1, 0.1
#: Words before and behind a cue in its blocks; a last block is as long as the longest form.
BLOCKS = [(3, 5), (3, 9), (3, 17), (14, 17), (14, 60)]
#: Words that tell one license from another: names, versions, numbers.
TELLING = re.compile(r"\d|^(?:mit|apache|bsd|gnu|gpl\w*|lesser|affero|lgpl\w*|agpl\w*|mozilla|mpl|isc|eclipse|epl|boost|unlicense|cc0?|by|sa|nc|nd|zero|attribution|sharealike|noncommercial|noderivatives|clause|simplified|modified|new)$")

WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
CUE = re.compile(CUES)


def norm(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def forms() -> dict[str, list[list[str]]]:
    """The words of every form of every license: leads with names, texts, notices and titles."""
    out = {k: [norm(f"{lead} {name}") for name in names for lead in LEADS] for k, names in NAMES.items()}
    for k, texts in TEXTS.items():
        out.setdefault(k, []).extend(norm(text) for text in texts)
    return out


def differences(block: list[str], form: list[str]) -> tuple[list[str], list[str], int, int]:
    """(missing, added, first, end): how the closest stretch of ``block`` differs from ``form``, and where it lies.

    The stretch is about where the form would lie if their longest common run is in place.
    """
    matcher = difflib.SequenceMatcher(None, block, form, autojunk=False)
    longest = matcher.find_longest_match()
    slack = 2 + len(form) // 8
    low, high = max(0, longest.a - longest.b - slack), longest.a - longest.b + len(form) + slack
    near = block[low:high]
    parts = [m for m in difflib.SequenceMatcher(None, near, form, autojunk=False).get_matching_blocks() if m.size]
    if not parts:
        return form, [], 0, 0
    first, end = parts[0].a, parts[-1].a + parts[-1].size
    missing, added, at, f_at = [], [], first, 0
    for m in parts:
        missing += form[f_at : m.b]
        added += near[at : m.a]
        at, f_at = m.a + m.size, m.b + m.size
    return missing + form[f_at:], added, low + first, low + end


class Scanner:
    def __init__(self):
        self.forms = forms()
        self.names = list(self.forms)
        self.plain = zstandard.ZstdCompressor(level=3)
        self.with_template = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict("\n".join(" ".join(f) for f in self.forms[k]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k in self.names]
        self.longest = max(len(f) for fs in self.forms.values() for f in fs)
        self.seen: dict[tuple[str, int], tuple | None] = {}

    def rank(self, words: list[str]) -> list[tuple[float, str]]:
        """(reduction, license) of the templates that make the block much smaller, best first."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        found = [(1 - len(c.compress(data)) / alone, k) for c, k in zip(self.with_template, self.names, strict=True)]
        return sorted((x for x in found if x[0] >= REDUCTION), key=lambda x: (-x[0], x[1]))

    def confirm(self, words: list[str], cue: int) -> tuple | None:
        """(license, reduction, missing, added, first word, end word) of the best confirmed template about the word ``cue``."""
        best, kinds, text = None, set(words), f" {' '.join(words)} "
        for place, (reduction, name) in enumerate(self.rank(words)):
            for form in self.forms[name]:
                exact = f" {' '.join(form)} "
                at, first = text.find(exact), -1
                while at >= 0 and not first <= cue < first + len(form):
                    first = text.count(" ", 0, at)
                    at = text.find(exact, at + 1)
                if first >= 0:
                    missing, added, end = [], [], first + len(form)
                elif sum(w not in kinds for w in form) > DIFFERENT * len(form):
                    continue
                else:
                    missing, added, first, end = differences(words, form)
                off = len(missing) + len(added)
                if not first <= cue < end or off > DIFFERENT * len(form) or any(TELLING.search(w) for w in missing + added):
                    continue
                key = (off - len(form), off, place)
                if best is None or key < best[0]:
                    best = (key, (name, reduction, " ".join(missing), " ".join(added), first, end))
        return best and best[1]

    def scan(self, text: str) -> Iterator[tuple]:
        """(start, end, license, reduction, missing, added) of every finding, in order."""
        spots = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        starts = [a for a, _ in spots]
        covered = 0
        for cue in CUE.finditer(text):
            at = max(0, bisect_left(starts, cue.start() + 1) - 1)
            if at < covered:
                continue
            results = []
            for before, behind in (*BLOCKS, (14, self.longest * 5 // 4)):
                low = max(covered, at - before)
                words = [text[a:b].lower() for a, b in spots[low : at + behind]]
                key = " ".join(words)
                if (key, at - low) not in self.seen:
                    if len(self.seen) > 50_000:
                        self.seen.clear()
                    self.seen[key, at - low] = self.confirm(words, at - low)
                got = self.seen[key, at - low]
                if got:
                    results.append((*got[:4], low + got[4], low + got[5]))
            if results:
                name, reduction, missing, added, first, covered = max(results, key=lambda r: r[5] - r[4])
                yield spots[first][0], spots[covered - 1][1], name, reduction, missing, added


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, license, reduction, missing, added): the confirmed findings of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in scanner.scan(text.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.string()), ("added", pa.string())])
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUES))
    return in_batches(some).mapInArrow(run, "doc_id long, start int, end int, license string, reduction double, missing string, added string")


def op6_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))

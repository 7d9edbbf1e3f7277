"""Licence notices in texts: Dice coefficient over word bigrams against templates."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, text_or_empty

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# Licences, and how their short notices name them.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "MIT": ["the MIT License", "MIT License", "the MIT licence"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the BSD License", "the New BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Zlib": ["the zlib License"],
    "ISC": ["the ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"],
}
# Openings of short notices.
OPENINGS = [
    "Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under",
    "This project is licensed under", "This software is licensed under", "This file is licensed under",
    "This code is released under",
]
# Identifiers that a tag in a file's first lines may name.
TAGGED = [
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "ISC", "0BSD", "Unlicense", "WTFPL", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
]
_GRANT = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_HEAD = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_MIDDLE = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
# Licence texts, whole where they are short; of the long ones the standard notices of files and the title
# and first lines, by which a whole text is found as well.
TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT_HEAD), ("MIT", f"{_MIT_HEAD} {_MIT_END}"),
    ("ISC", f"{_ISC_HEAD}, {_ISC_MIDDLE}"), ("ISC", f"{_ISC_HEAD}, {_ISC_MIDDLE} {_ISC_END}"),
    ("0BSD", f"{_ISC_HEAD}. {_ISC_END}"),
    ("BSD", _BSD_HEAD),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_1} {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", _GRANT.format(";", _GPL, ";", 2)), ("GPL-3.0", _GRANT.format(":", _GPL, ",", 3)),
    ("LGPL-2.1", _GRANT.format(";", _LESSER, ";", "2.1")), ("LGPL-3.0", _GRANT.format(":", _LESSER, ",", 3)),
    ("AGPL-3.0", _GRANT.format(":", _AFFERO, ",", 3)),
    ("GPL-2.0", f"{_GRANT.format(';', _GPL, ';', 2)} {_NO_WARRANTY.format(_GPL)}"),
    ("GPL-3.0", f"{_GRANT.format(':', _GPL, ',', 3)} {_NO_WARRANTY.format(_GPL)}"),
    ("LGPL-2.1", f"{_GRANT.format(';', _LESSER, ';', '2.1')} {_NO_WARRANTY.format(_LESSER)}"),
    ("LGPL-3.0", f"{_GRANT.format(':', _LESSER, ',', 3)} {_NO_WARRANTY.format(_LESSER)}"),
    ("AGPL-3.0", f"{_GRANT.format(':', _AFFERO, ',', 3)} {_NO_WARRANTY.format(_AFFERO)}"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    *[
        (f"CC-{code}-4.0", f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {said} 4.0 International Public License (\"Public License\").")
        for code, said in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"))
    ],
]

Templates = tuple[tuple[str, str], ...]


def notices() -> Templates:
    """All templates: (licence, text)."""
    short = [(name, f"{opening} {called}.") for name, said in NAMES.items() for called in said for opening in OPENINGS]
    tags = [(name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in TAGGED]
    return tuple(short + tags + TEXTS)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def windows_with(places: np.ndarray, before: np.ndarray, width: int, n: int) -> np.ndarray:
    """How many different items each window of ``width`` of n places in a row has. ``places``: where items are,
    ``before``: where the same item was last, or -1. An item counts in the windows that begin after that."""
    starts = n - width + 1
    lo, hi = np.maximum(np.maximum(places - width, before) + 1, 0), np.minimum(places, starts - 1)
    used = lo <= hi
    change = np.bincount(lo[used], minlength=starts + 1) - np.bincount(hi[used] + 1, minlength=starts + 1)
    return np.cumsum(change[:starts])


@lru_cache(maxsize=4)
class Scanner:
    """Finds the windows of a text whose bigram set has a Dice coefficient of ``threshold`` or more with a template's."""

    def __init__(self, templates: Templates, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        pairs = [list(zip(w, w[1:])) for w in (words(text) for _, text in templates)]
        self.sizes = [len(p) for p in pairs]
        self.sets = [set(p) for p in pairs]
        index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, bigrams in enumerate(self.sets):
            for b in bigrams:
                index[b].append(k)
        self.index, self.known = dict(index), frozenset(index)

    def least(self, k: int) -> float:
        """Bigrams of template k that a stretch must have to reach the threshold at all, whatever else it has."""
        return self.threshold / (2 - self.threshold) * len(self.sets[k])

    def widths(self, k: int, n: int) -> list[int]:
        """Bigrams of a window for template k: four fifths of its own number, as many, five fourths; at most n."""
        size = self.sizes[k]
        return sorted({max(1, min(n, w)) for w in (round(0.8 * size), size, round(1.25 * size))})

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, end word), not overlapping, best first chosen, in order of place."""
        w = words(text)
        pairs = list(zip(w, w[1:]))
        shared: dict[int, int] = defaultdict(int)
        for b in self.known.intersection(pairs):
            for k in self.index[b]:
                shared[k] += 1
        likely = [k for k, n in shared.items() if n >= self.least(k) - 1e-9]
        if not likely:
            return []
        number: dict[tuple[str, str], int] = {}
        of = np.array([number.setdefault(p, len(number)) for p in pairs])
        order = np.argsort(of, kind="stable")
        before = np.full(len(of), -1)
        again = of[order[1:]] == of[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        n, all_places, sizes, found = len(of), np.arange(len(of)), {}, []
        for k in sorted(likely):
            mine = np.zeros(len(number), bool)
            mine[[number[b] for b in self.sets[k] if b in number]] = True
            places = np.flatnonzero(mine[of])
            for width in self.widths(k, n):
                if width not in sizes:
                    sizes[width] = windows_with(all_places, before, width, n)
                hits = windows_with(places, before[places], width, n)
                dice = 2 * hits / (sizes[width] + len(self.sets[k]))
                starts = np.flatnonzero(dice >= self.threshold - 1e-12)
                found += [(-round(d * h, 6), -d, i, -(i + width + 1), self.names[k]) for d, h, i in zip(np.round(dice[starts], 6).tolist(), hits[starts].tolist(), starts.tolist())]
        taken: list[tuple[str, float, int, int]] = []
        busy = bytearray(len(w))
        for _, d, begin, end, name in sorted(found):  # what explains most of a stretch, and explains it well, comes first
            if busy.find(1, begin, -end) < 0:
                busy[begin:-end] = b"\1" * (-end - begin)
                taken.append((name, -d, begin, -end))
        return sorted(taken, key=lambda x: x[2])


def license_notices(docs: DataFrame, templates: Templates | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices anywhere in whole texts, in one pass without a shuffle.

    Compared are all windows of a text's normalised words (lower case, without punctuation) of as many as a template has,
    of four fifths and of five fourths as many (a shorter text: all of it), in time linear in the text.
    Returns one row per notice: doc_id, license, dice, begin_word, end_word. Windows overlap no other; what shares
    more bigrams, times its coefficient, wins, so a heading that several licences share doesn't name a text that is nearly one of them whole; ties by
    coefficient, place, length and name. Templates of one word have no bigrams and match nothing. Null and empty texts have no rows;
    a null doc_id is kept; rows that repeat give rows that repeat; extra columns are not read; an empty table gives an empty one. Texts are scanned
    whole, one after the other.
    """
    templates = templates if templates is not None else notices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [(i, *found) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for found in scanner.scan(text.as_py())]
            fields = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, kinds)], ["doc_id", "license", "dice", "begin_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, license string, dice double, begin_word long, end_word long")

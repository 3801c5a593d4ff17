"""License scans by conditional compression.

Templates are whole public license texts and the notices that name a license. A run of three words that a template
holds opens a candidate block in a text, as long as the template with its allowance; overlapping blocks are one. Each
block is compressed alone and with every template as a raw zstandard dictionary, and the templates are ranked by the
bytes they save. In that order they are compared with the block word by word, and the first whose wording is confirmed
wins; templates that save the same bytes go by fewest missing and strange words, then by name. Confirmed means: nearly
all words of a template stand in the block in order, all those that tell licenses apart among them, with few others
between. All places of the winner in the block are taken at once, and what lies between them is ranked anew without it,
so that a block is compressed once a template at most however many notices follow each other in it. A copy whose missing
and strange words number fewer than a third of the template's always has a run that opens a block.

Defined results: a null text counts as empty; a text without a license gives no row, and neither does an empty table;
rows alike give the same rows; equal winners go by name; texts may be of any length; offsets are in words of the whole
text; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import text_of

#: Public license texts and notices, and the words of each that tell it from the others.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
CC = """You are free to: Share — copy and redistribute the material in any medium or format for any purpose, even commercially. Adapt — remix, transform, and build upon the material for any purpose, even commercially. The licensor cannot revoke these freedoms as long as you follow the license terms. Under the following terms: Attribution — You must give appropriate credit, provide a link to the license, and indicate if changes were made."""
TEMPLATES: dict[str, tuple[str, str]] = {
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT-licensed": ("Licensed under the MIT License.", "mit"),
    "MIT-text": (MIT, "granted merge sublicense"),
    "MIT-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted free charge"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0-name": ("Apache License, Version 2.0", "apache 2.0"),
    "Apache-2.0-header": (APACHE, "apache 2.0"),
    "Apache-2.0-notice": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance license"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    "GPL-2.0-header": (GNU.format(what="program", name="General Public License", version=2), "gnu general public 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    "GPL-3.0-header": (GNU.format(what="program", name="General Public License", version=3), "gnu general public 3"),
    "LGPL-2.1-header": (GNU.format(what="library", name="Lesser General Public License", version=2.1), "gnu lesser public 2.1"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser public 3"),
    "LGPL-3.0-header": (GNU.format(what="library", name="Lesser General Public License", version=3), "gnu lesser public 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero public 3"),
    "AGPL-3.0-header": (GNU.format(what="program", name="Affero General Public License", version=3), "gnu affero public 3"),
    "BSD-2-Clause": (f"{BSD_HEAD} {BSD_TAIL}", "redistribution source binary"),
    "BSD-3-Clause": (f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}", "redistribution neither endorse promote"),
    "BSD-conditions": (BSD_HEAD, "redistribution source binary"),
    "BSD-endorsement": (BSD_THIRD, "neither endorse promote"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    "MPL-2.0-header": (MPL, "mozilla 2.0"),
    "ISC": (ISC, "distribute fee granted"),
    "Zlib": (ZLIB, "misrepresented altered"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered domain"),
    "Unlicense-text": (UNLICENSE, "unencumbered domain"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-4.0-name": ("CC BY 4.0", "cc by 4.0"),
    "CC-BY-4.0-deed": (CC, "attribution credit"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    "CC0-1.0": ("Released under CC0 1.0.", "cc0 1.0"),
    "Creative-Commons-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    "All-rights-reserved": ("All rights reserved.", "all rights reserved"),
}
#: Words of a run that opens a block; shares of a template's words that may be missing, or strange words between; level of compression.
RUN, MISSING, STRANGE, LEVEL = 3, 0.1, 0.25, 9
FINDING = "doc_id long, license string, start long, words long, n_missing long, n_strange long, saved double"
_WORD, _EDGE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"^\W+|\W+$")


class Scanner:
    """Templates with the runs that open their blocks; everything is derived from the templates given."""

    def __init__(self, templates: dict[str, tuple[str, str]]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates: dict[str, tuple] = {}
        self.runs: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for name, (text, keys) in sorted(templates.items()):
            words = [w for x in text.lower().split() if (w := _EDGE.sub("", x))]
            raw = " ".join(words).encode()
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            by = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)
            most = max(len(self.plain.compress(raw)) - len(by.compress(raw)), 1)
            self.templates[name] = (words, set(keys.split()), by, most)
            n = min(RUN, len(words))
            for at in range(len(words) - n + 1):
                self.runs[" ".join(words[at : at + n])].append((name, at))
        self.first = {x.split(" ", 1)[0] for x in self.runs}
        self.lengths = sorted({x.count(" ") + 1 for x in self.runs})

    def _hits(self, words: list[str]) -> list[tuple[int, str, int]]:
        """(beginning that the template would have, template, place) of every run that a template holds."""
        found = []
        for k in (k for k, w in enumerate(words) if w in self.first):
            for n in self.lengths:
                found += [(k - at, name, k) for name, at in self.runs.get(" ".join(words[k : k + n]), ())]
        return found

    def _places(self, name: str, begins: list[int], block: list[str]) -> list[tuple[int, int, int, int]]:
        """(start, end, missing, strange) of every place where the template's wording is in the block.

        A place is looked at if enough runs would have the template begin near it: a missing word breaks up to RUN runs,
        a strange one RUN - 1, and what the allowances leave must be there.
        """
        template = self.templates[name][0]
        slack = int((MISSING + STRANGE) * len(template)) + 1
        need = max(1, math.floor(len(template) - RUN + 1 - (MISSING * RUN + STRANGE * (RUN - 1)) * len(template)))
        begins, found, near = sorted(begins), [], set()
        for begin, _ in sorted(Counter(begins).items(), key=lambda x: (-x[1], x[0])):
            if begin in near:
                continue
            if bisect_right(begins, begin + slack) - bisect_left(begins, begin - slack) < need:
                continue
            near.update(range(begin - slack // 2, begin + slack // 2 + 1))
            if (of := self._confirm(name, begin, block)) is not None:
                found.append(of)
                block[of[0] : of[1]] = [""] * (of[1] - of[0])
        return sorted(found)

    def _confirm(self, name: str, begin: int, block: list[str]):
        """(start, end, missing, strange) if the template's wording is in the block, about where it would begin."""
        template, keys, _, _ = self.templates[name]
        slack = int((MISSING + STRANGE) * len(template)) + 1
        low = max(begin - slack, 0)
        span = block[low : max(begin, 0) + len(template) + slack]
        runs = [m for m in difflib.SequenceMatcher(None, template, span, autojunk=False).get_matching_blocks() if m.size]
        # Stray words at either end that lie further off than they are worth are none of the notice.
        while len(runs) > 1 and runs[0].size < runs[1].b - runs[0].b - runs[0].size:
            runs.pop(0)
        while len(runs) > 1 and runs[-1].size < runs[-1].b - runs[-2].b - runs[-2].size:
            runs.pop()
        if not runs:
            return None
        found = {template[m.a + k] for m in runs for k in range(m.size)}
        start, end, n = runs[0].b, runs[-1].b + runs[-1].size, sum(m.size for m in runs)
        missing, strange = len(template) - n, end - start - n
        if keys <= found and missing <= MISSING * len(template) and strange <= STRANGE * len(template):
            return low + start, low + end, missing, strange
        return None

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, float]]:
        """(license, start, words, missing, strange, saved) for each notice in a text."""
        words = [_EDGE.sub("", m.group().lower()) for m in _WORD.finditer(text)]
        blocks: list[list] = []
        for begin, name, at in sorted(self._hits(words)):
            slack = int((MISSING + STRANGE) * len(self.templates[name][0])) + 1
            low, high = max(begin - slack, 0), min(begin + len(self.templates[name][0]) + slack, len(words))
            if blocks and low <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], high)
                blocks[-1][2].append((begin, name, at))
            else:
                blocks.append([low, high, [(begin, name, at)]])
        out = []
        while blocks:
            low, high, hits = blocks.pop()
            block = words[low:high]
            if (best := self._best(block, [(begin - low, name, at - low) for begin, name, at in hits])) is None:
                continue
            name, saved, places = best
            out += [(name, low + start, end - start, missing, strange, saved) for start, end, missing, strange in places]
            # What lies between the places is searched for the other templates.
            edges = [low, *[low + x for start, end, _, _ in places for x in (start, end)], high]
            others = sorted((h for h in hits if h[1] != name), key=lambda h: h[2])
            at = [h[2] for h in others]
            for left, right in zip(edges[::2], edges[1::2], strict=True):
                if rest := others[bisect_left(at, left) : bisect_right(at, right - RUN if right < high else right)]:
                    blocks.append([left, right, rest])
        return sorted(set(out), key=lambda x: x[1])

    def ranking(self, block: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of all templates over the words of a block, the greatest reduction first."""
        raw = " ".join(w for w in block if w).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(of[2].compress(raw)), name) for name, of in self.templates.items()), key=lambda x: (-x[0], x[1]))

    def _best(self, block: list[str], hits: list[tuple[int, str, int]]):
        """(template, share saved, its places) of the first template in the ranking that is confirmed; none: null."""
        begins = defaultdict(list)
        for begin, name, _ in hits:
            begins[name].append(begin)
        for saved, group in itertools.groupby(self.ranking(block), key=lambda x: x[0]):
            equal = [(name, of) for _, name in group if name in begins and (of := self._places(name, begins[name], list(block)))]
            if equal:
                name, places = min(equal, key=lambda x: (min(2 * p[2] + p[3] - len(self.templates[x[0]][0]) for p in x[1]), x[0]))
                return name, saved / self.templates[name][3], places
        return None


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, start, words, n_missing, n_strange, saved): a row for each notice found in docs (doc_id, text)."""
    templates = templates or TEMPLATES

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scanner(templates)
        names = [c.split()[0] for c in FINDING.split(", ")]
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for found in own.scan(t)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(part, FINDING)

"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates of like length share windows: a quarter longer than the longest of them, and so far apart, so an occurrence of its length lies
whole in one window. The bands of each class are set from the least Jaccard similarity such a window can have with its template,
so that a match is missed with a probability of at most MISS. A window that holds no shingle of any template cannot collide in
a band, so such windows get no MinHash at all.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id
from .substring import Powers, WordHashes, mixed, window_hashes

SHINGLE, SIMILARITY, MISS = 5, 0.8, 1e-6
#: Templates are sent to every worker: more characters than this are refused.
MAX_TEMPLATE_CHARS = 16 << 20
#: A class has templates of up to this many times its shortest one's shingles.
SPREAD = 1.25
#: Windows of a class begin every so many parts of its longest template.
STEPS = 4
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
FOUND = "license string, containment double, start int, stop int, matched_words int"

# Published license notices and permission texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "This project is licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def bands_for(similarity: float, miss: float = MISS, most: int = 128, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the most rows, up to so many, for which at most so many bands miss a pair of this similarity with probability miss."""
    most_rows, rows = rows, 1
    while True:
        bands = math.ceil(math.log(miss) / math.log1p(-(similarity ** (rows + 1)))) if similarity < 1 else 1
        if bands > most or rows == most_rows:
            break
        rows += 1
    return (math.ceil(math.log(miss) / math.log1p(-(similarity**rows))) if similarity < 1 else 1), rows


@dataclass
class Class:
    """Templates of like length: their window, step and bands, and which templates are in each band's bucket."""

    window: int
    step: int
    need: int  # shingles that the smallest template's match has at least
    bands: int
    rows: int
    buckets: dict[tuple[int, bytes], list[int]] = field(default_factory=dict)


class Templates:
    """All templates as shingle hashes and words, in classes of like length."""

    def __init__(self, texts: dict[str, str], shingle: int = SHINGLE, similarity: float = SIMILARITY):
        if sum(map(len, texts.values())) > MAX_TEMPLATE_CHARS:
            raise ValueError("too many template characters to send to every worker; scan with parts of them in turn")
        self.shingle, self.similarity = shingle, similarity
        cache, powers = WordHashes(), Powers()
        self.names = sorted(t for t in texts if words_of(texts[t])[0])
        self.words = [words_of(texts[t])[0] for t in self.names]
        self.sizes = [min(shingle, len(w)) for w in self.words]
        self.order = [{k: i for i, k in enumerate(dict.fromkeys(tuple(w[i : i + n]) for i in range(len(w) - n + 1)))} for w, n in zip(self.words, self.sizes, strict=True)]
        hashes = [np.unique(shingle_hashes(w, n, cache, powers)) for w, n in zip(self.words, self.sizes, strict=True)]
        self.classes: dict[int, list[Class]] = {}  # by shingle size: templates of fewer words have shingles of their own length
        self.known: dict[int, np.ndarray] = {}
        for n in sorted(set(self.sizes)):
            own = sorted((i for i in range(len(self.names)) if self.sizes[i] == n), key=lambda i: len(self.words[i]))
            self.known[n] = np.unique(np.concatenate([hashes[i] for i in own]))
            while own:
                least = len(hashes[own[0]])
                part = [i for i in own if len(hashes[i]) <= SPREAD * least]
                own = own[len(part) :]
                longest = max(len(self.words[i]) for i in part)
                step, need = -(-longest // STEPS), math.ceil(similarity * least)
                window = longest + step
                jaccard = need / (window - n + 1 + least - need)
                c = Class(window, step, need, *bands_for(jaccard))
                for i in part:
                    for band, key in enumerate(signature(hashes[i], c)):
                        c.buckets.setdefault((band, key), []).append(i)
                self.classes.setdefault(n, []).append(c)


def words_of(text: str) -> tuple[list[bytes], list[int]]:
    """Lower-case words and the byte offsets where they start."""
    found = [(m[0], m.start()) for m in WORD.finditer(text.encode().translate(LOWER))]
    return [w for w, _ in found], [at for _, at in found]


def shingle_hashes(words: list[bytes], n: int, cache: WordHashes, powers: Powers) -> np.ndarray:
    return window_hashes(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), n, powers)


def signature(hashes: np.ndarray, c: Class) -> list[bytes]:
    """The MinHash of a set of shingles, a key for each band."""
    k = c.bands * c.rows
    seeds = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = mixed(hashes ^ seeds[:, None]).min(1)
    return [low[i : i + c.rows].tobytes() for i in range(0, k, c.rows)]


def occurrences(places: list[int], words: list[bytes], n: int, order: dict[tuple[bytes, ...], int], similarity: float) -> list[tuple[float, int, int, int]]:
    """(containment, first word, last word, words matched) of each time a template is told among places, where its shingles begin.

    The template's shingles have an order; where it falls back by half of the template, another telling begins.
    """
    out, run, last = [], [], -1
    for j in [*places, None]:
        at = order[tuple(words[j : j + n])] if j is not None else -1
        if run and (j is None or at <= last - len(order) // 2):
            part = len({tuple(words[i : i + n]) for i in run}) / len(order)
            if part >= similarity:
                out.append((part, run[0], run[-1] + n - 1, len({x for i in run for x in range(i, i + n)})))
            run, last = [], -1
        if j is not None:
            run.append(j)
            last = max(last, at) if run[:-1] else at
    return out


def scan_words(words: list[bytes], t: Templates, cache: WordHashes, powers: Powers) -> list[tuple[int, float, int, int, int]]:
    """(template, containment, first word, last word, words matched) of each place where a template is found."""
    out: set[tuple[int, float, int, int, int]] = set()
    for n, classes in t.classes.items():
        h = shingle_hashes(words, n, cache, powers)
        if not len(h):
            continue
        known = t.known[n]
        hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        for c in classes if len(hits) else ():
            last = max(0, -(-(len(words) - c.window) // c.step))
            lows = np.unique(np.concatenate([hits // c.step - d for d in range(-(-c.window // c.step) + 1)] + [np.minimum(hits // c.step, last)]))
            for w in lows[(lows >= 0) & (lows <= last)]:
                a, b = int(w) * c.step, min(len(words), int(w) * c.step + c.window)
                own = h[a : b - n + 1]
                if np.searchsorted(hits, b - n, "right") - np.searchsorted(hits, a) < c.need:  # too few shingles of any template to match
                    continue
                near = {i for band, key in enumerate(signature(own, c)) for i in c.buckets.get((band, key), ())}
                for i in near:
                    places = [j for j in range(a, b - n + 1) if tuple(words[j : j + n]) in t.order[i]]
                    out |= {(i, *x) for x in occurrences(places, words, n, t.order[i], t.similarity)}
    return whole_places(out)


def whole_places(found: set[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
    """Of places of one template that share most of their words, seen from neighbouring windows, the one that holds most of it."""
    out: list[tuple[int, float, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[0], x[2], -x[1], -x[3])):
        if out and out[-1][0] == x[0] and 2 * (out[-1][3] - x[2] + 1) > min(out[-1][3] - out[-1][2], x[3] - x[2]) + 1:
            out[-1] = max(out[-1], x, key=lambda y: (y[1], y[4]))
        else:
            out.append(x)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, start, stop, matched_words): every place of every whole text where a template is found.

    containment is the share of the template's distinct shingles of five words in the window, 0.8 at least; start and stop are
    characters of the text. A template of fewer than five words is one shingle. Null and empty
    texts, and empty tables, give no rows; repeated rows and ids give their own.
    """
    texts = TEMPLATES if templates is None else templates

    def each(batches):
        t, cache, powers = Templates(texts), WordHashes(), Powers()
        for b in batches:
            rows = []
            for doc, text in zip(b["id"], b["text"], strict=True):
                words = text.encode().translate(LOWER).translate(TO_BLANKS).split() if text else []
                found = scan_words(words, t, cache, powers)
                if found:
                    raw, (own, at) = text.encode(), words_of(text)
                    for i, part, first, last, n in found:
                        start = len(raw[: at[first]].decode())
                        stop = start + len(raw[at[first] : at[last] + len(own[last])].decode())
                        rows.append((doc, t.names[i], part, start, stop, n))
            yield pd.DataFrame(rows, columns=["id", *(c.split()[0] for c in FOUND.split(", "))])

    return by_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), each, FOUND)


TO_BLANKS = bytes(b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def op8(spark, sf_dir):
    """Every place of a license template in every document. Repeated ids give their own rows; an empty table gives none."""
    from .common import table

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

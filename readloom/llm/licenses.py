"""License scans: stretches of normalised text against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.common import TokenHashes, batches, mix

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Stretches that are compared at a time.
CELLS = 1 << 20

# Licence texts and notices, as published.
TEMPLATES: dict[str, str] = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution.""",
}
# The full texts lie beside this module, one a file; only the driver reads them.
TEMPLATES |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> list[bytes]:
    """Lower-cased words; punctuation and layout are dropped."""
    return (text or "").lower().encode().translate(_SPACED).split()


def bigrams(words: list[bytes], tokens: TokenHashes) -> np.ndarray:
    hashes = tokens.of(words)
    return mix(hashes[:-1], hashes[1:])


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """2 |a and b| / (|a| + |b|) of two bags."""
    if not len(a) or not len(b):
        return 0.0
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return 2 * (x & y).total() / (len(a) + len(b))


def most_value(hit: np.ndarray, threshold: float) -> float:
    """The largest 2 hits - threshold * size of any run."""
    sums = np.concatenate([[0.0], np.cumsum(2.0 * hit - threshold)])
    return float((sums[1:] - np.minimum.accumulate(sums)[:-1]).max())


def best_stretch(bag: np.ndarray, grams: np.ndarray, hits: np.ndarray, threshold: float) -> tuple[int, int, float] | None:
    """Begin, end and Dice coefficient of the stretch of `grams` that is most like the bag, if it reaches the threshold;
    ties: the first begin, then the first end. `hits` are the places of bigrams of the bag, in order.

    Every stretch from a hit to a hit is compared whose size lets it reach the threshold; no other is better. A hit counts
    in the stretches that begin after the place where its bigram stood as many bigrams earlier as the bag has of it.
    """
    size = len(bag)
    known, times = np.unique(bag, return_counts=True)
    number = np.searchsorted(known, grams[hits])
    order = np.argsort(number, kind="stable")
    of = number[order]
    first = np.searchsorted(of, np.arange(len(known)))
    rank = np.arange(len(order)) - first[of]
    old = np.full(len(hits), -1, np.int64)
    late = rank >= times[of]
    old[order[late]] = hits[order[np.flatnonzero(late) - times[of[late]]]]
    longest = int(size * (2 - threshold) / threshold + 1e-9)
    ends = np.searchsorted(hits, hits + longest)  # hits in the longest stretch from each
    best, found = threshold - 1e-12, None
    # a begin needs as many hits after it as the threshold asks of the shortest stretch
    begins = np.flatnonzero(2 * (ends - np.arange(len(hits))) >= threshold * (size + 1))
    step = max(1, CELLS // max(1, longest))
    for at in range(0, len(begins), step):
        some = begins[at : at + step]
        width = int((ends[some] - some).max())
        cell = np.minimum(some[:, None] + np.arange(width), len(hits) - 1)
        inside = some[:, None] + np.arange(width) < ends[some][:, None]
        start = hits[some][:, None]
        shared = np.cumsum(inside & (old[cell] < start), axis=1)
        value = np.where(inside, 2.0 * shared / (hits[cell] - start + 1 + size), 0.0)
        top = int(value.argmax())
        if value.flat[top] > best:
            row, column = divmod(top, width)
            best = float(value.flat[top])
            found = int(hits[some[row]]), int(hits[cell[row, column]]) + 1, best
    return found


class LicenseScanner:
    """Compares texts with licence templates.

    A stretch of b bigrams with h of a template of t reaches a Dice coefficient of d only if 2 h >= d (b + t). So a
    template is a candidate for a text only if the text has at least d t / (2 - d) bigrams, and as many of the
    template; the largest 2 h - d b, hits counted without regard to how often the template has them, must reach d t. Then
    all stretches from hit to hit are compared in full, so a template that stands twice near itself is found too.
    """

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        tokens = TokenHashes()
        self.threshold = threshold
        self.names = sorted(templates)
        self.bags = [bigrams(normalised(templates[n]), tokens) for n in self.names]
        self.least = np.array([threshold * len(b) / (2 - threshold) for b in self.bags])
        self.known = np.unique(np.concatenate(self.bags))
        self.holds = np.stack([np.isin(self.known, b) for b in self.bags])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, grams: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(name, dice, first word, words) of each template that the text's bigrams match."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(48)).astype(np.int64)])
        number = np.searchsorted(self.known, grams[at])
        number[number == len(self.known)] = 0
        real = self.known[number] == grams[at]
        at, number = at[real], number[real]
        enough = (self.holds[:, number].sum(axis=1) >= self.least) & (len(grams) >= self.least)
        out = []
        for k in np.flatnonzero(enough & (self.least > 0)):
            hit = np.zeros(len(grams), bool)
            hit[at[self.holds[k, number]]] = True
            if most_value(hit, self.threshold) >= self.threshold * len(self.bags[k]) - 1e-9:
                found = best_stretch(self.bags[k], grams, np.flatnonzero(hit), self.threshold)
                if found:
                    begin, end, d = found
                    out.append((self.names[k], d, begin, end - begin + 1))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches) for each row of `docs`: matches is array<struct<license, dice, first_word, n_words>>, by licence
    name. Null and empty texts, and texts of one word, match nothing; repeated rows are scanned one by one."""
    scanner = LicenseScanner(TEMPLATES if templates is None else templates, threshold)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            tokens = TokenHashes()
            found = [scanner.scan(bigrams(normalised(x), tokens)) for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "matches": pa.array([[dict(zip(("license", "dice", "first_word", "n_words"), m, strict=True)) for m in x] for x in found], kind),
                }
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, matches array<struct<license:string,dice:double,first_word:bigint,n_words:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

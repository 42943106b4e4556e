"""Operator 3: license scans by conditional compression.

Candidate blocks are the sentences of a line that hold a license word, at most ``AROUND``
characters to either side of it.  Each block is compressed by
zstandard (in lower case) alone and with each template as a raw-content dictionary; templates are
ranked by the bytes that they save.  The best ``TOP`` are then aligned with the block word by word,
other words before and after the aligned stretch being free, and the winner is the one with
the fewest differing words, confirmed if these are at most a share ``DIFFERENCE`` of the
template's words.  What a confirmed notice leaves of its block is scored anew.
Notices that run over the ends of lines are looked for around each line end, within a
paragraph, and are rows if confirmed.  Identical blocks are scored once a worker.

Whole texts of short licenses and standard headers (``TEXTS``) are looked for in stretches
around the hints that are long enough for any of them, over line ends and paragraphs: ranked by
the bytes that they save, aligned if they save a share ``SAVING`` of their own compressed
size, and rows if confirmed; notices that overlap them are not rows of their own.  Texts of
several thousand words (Apache, GPL) and the headers of the GNU licenses are no templates.

Defined cases: null and empty texts have no blocks; of a very long text, only what is
around its hints is looked at closely, in time linear in their number; ties go to the template first in
alphabetical order; repeated rows are scanned each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices, as they stand in works under these licenses.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: Whole texts of short licenses and standard headers, without the lines that name their holders.
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{_CLAUSES} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
AROUND, TOP, DIFFERENCE = 150, 4, 0.1
#: Characters that a license text may take (line ends, indents and comment signs are more than the template has), and the share of a template's compressed size that a block must save to be aligned.
REACH, SAVING = int(1.5 * max(map(len, TEXTS.values()))), 0.25
#: Some word of every template matches.
HINT = r"(?i)licen[cs]|copyright|public\W+domain|creative\W+commons|altered\W+source|express\W+or\W+implied"
_HINT = re.compile(HINT)
_STOP = re.compile(r"\.(?=\s|$)")
_NOTICE, _LEAST = max(map(len, TEMPLATES.values())), min(map(len, TEXTS.values())) // 2
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def blocks(text: str | None) -> Iterator[tuple[int, str]]:
    """(place in the text, block) of the candidate blocks."""
    at = 0
    for line in (text or "").split("\n"):
        end = whole = -1  # hints before whole have their notice in the last block
        for m in _HINT.finditer(line):
            if m.start() < end and m.end() <= whole:
                continue
            a, b = max(0, m.start() - AROUND), min(len(line), m.end() + AROUND)
            dot = line.rfind(". ", a, m.start())
            a = dot + 2 if dot >= 0 else line.find(" ", a, m.start()) + 1 or a if a else 0
            stop = _STOP.search(line, m.end(), b)
            end = b = stop.end() if stop else b
            whole = b if stop or b == len(line) else b - _NOTICE
            yield at + a, line[a:b]
        at += len(line) + 1


def _dictionaries(templates: dict[str, str]) -> tuple:
    import zstandard

    alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
    given = {k: zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(v.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in templates.items()}
    return alone, given, {k: words(v) for k, v in templates.items()}


@functools.cache
def _tools() -> tuple:
    return _dictionaries(TEMPLATES)


@functools.cache
def _text_tools() -> tuple:
    alone, given, wordings = _dictionaries(TEXTS)
    return alone, given, wordings, {k: len(alone.compress(v.lower().encode())) for k, v in TEXTS.items()}


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def align(template: list[str], own: list[str]) -> tuple[int, int, int]:
    """(differing words, first word, end) of the stretch of own words nearest to the template (Sellers' alignment)."""
    row = [(0, j) for j in range(len(own) + 1)]
    for i, w in enumerate(template, 1):
        new = [(i, 0)]
        for j, x in enumerate(own, 1):
            (c, at), (up, up_at), (left, left_at) = row[j - 1], row[j], new[-1]
            new.append(min((c + (w != x), at), (up + 1, up_at), (left + 1, left_at)))
        row = new
    return min((c, at, j) for j, (c, at) in enumerate(row))


def align_long(template: list[str], own: list[str]) -> tuple[int, int, int]:
    """As align(), a row of words at a time: cost and first word are one number, so minima are taken of both."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(template))}
    mine = np.array([numbers.get(w, -1) for w in own], np.int64)
    at = np.arange(len(own) + 1, dtype=np.int64)
    row, one = at.copy(), np.int64(1) << 32
    for i, w in enumerate(template, 1):
        new = row + one  # a word of the template is missing
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(mine == numbers[w], 0, one))
        new[0] = i * one
        row = np.minimum.accumulate(new - at * one) + at * one  # other words between
    end = int(np.lexsort((at, row & (one - 1), row >> 32))[0])
    return int(row[end] >> 32), int(row[end] & (one - 1)), end


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every license text with a hint in it: one for the hints of each half of REACH."""
    last = -1
    for m in _HINT.finditer(text):
        if m.start() >= last:
            last = m.start() + REACH // 2
            yield max(0, m.start() - REACH), min(len(text), last + REACH)


def texts(text: str | None) -> Iterator[tuple]:
    """(place, stretch, *score) of confirmed license texts and headers, over as many lines and paragraphs as they take."""
    text = text or ""
    if len(text) < _LEAST:
        return
    alone, given, wordings, sizes = _text_tools()
    seen: list[tuple[int, int]] = []
    for region in _regions(text):
        todo = [region]
        while todo:
            a, b = todo.pop()
            block = text[a:b]
            raw = block.lower().encode()
            size = len(alone.compress(raw))
            saved = sorted((len(c.compress(raw)) - size, k) for k, c in given.items())
            places = [m.span() for m in _WORD.finditer(block)]
            own = [block[x:y].lower() for x, y in places]
            found = min(((*align_long(wordings[k], own), less, k) for less, k in saved[:TOP] if -less >= SAVING * sizes[k]), key=lambda f: (f[0] / len(wordings[f[4]]), f[4]), default=None)
            if not found or found[0] > DIFFERENCE * len(wordings[found[4]]):
                continue
            differ, first, end, less, k = found
            x, y = a + places[first][0], a + places[end - 1][1]
            if not any(x < q and p < y for p, q in seen):
                seen.append((x, y))
                yield x, text[x:y], k, size, -less, differ, len(wordings[k]), True
            todo += [(p, q) for p, q in ((a, x), (y, b)) if q - p >= _LEAST and _HINT.search(text, p, q)]


@functools.lru_cache(maxsize=20_000)
def _best(block: str) -> tuple[str, int, int, int, int, bool, int, int]:
    """As score(), then the aligned stretch of the block."""
    alone, given, wordings = _tools()
    raw = block.lower().encode()
    size = len(alone.compress(raw))
    saved = sorted(((len(c.compress(raw)) - size, k) for k, c in given.items()))
    places = [m.span() for m in _WORD.finditer(block)]
    own = words(block)
    differ, less, k, first, end = min((differ, less, k, first, end) for less, k in saved[:TOP] for differ, first, end in [align(wordings[k], own)])
    n = len(wordings[k])
    return k, size, -less, differ, n, differ <= DIFFERENCE * n, *((places[first][0], places[end - 1][1]) if end > first else (0, 0))


def score(block: str) -> tuple[str, int, int, int, int, bool]:
    """(template, bytes alone, bytes saved, differing words, words of the template, confirmed) of the winner."""
    return _best(block)[:6]


def notices(text: str | None) -> Iterator[tuple]:
    """(place, block, *score) of each block; of a block with a confirmed notice, also of confirmed ones before and after it."""
    seen = set()
    for at, block in blocks(text):
        todo = [(at, block, True)]
        while todo:
            at, block, whole = todo.pop()
            *row, a, b = _best(block)
            if not row[-1]:
                if whole:
                    yield at, block, *row
                continue
            if (at + a, row[0]) not in seen:  # blocks of a long sentence overlap
                seen.add((at + a, row[0]))
                yield at, block, *row
            todo += [(at + x, rest, False) for x, rest in ((b, block[b:]), (0, block[:a])) if _HINT.search(rest)]


def wrapped(text: str | None) -> Iterator[tuple]:
    """(place, block, *score) of confirmed notices that run over the ends of lines, within a paragraph."""
    last = 0
    for m in re.finditer(r"(?<=[^\n])\n(?=[^\n])", text or ""):
        p = m.start()
        a, b = max(last, text.rfind("\n\n", 0, p) + 1, p - 2 * _NOTICE), min(text.find("\n\n", p) % (len(text) + 1), p + 2 * _NOTICE)
        while a <= p < b and _HINT.search(text, a, b):
            *row, x, y = _best(text[a:b])
            if not row[-1]:
                break
            if a + x < p < a + y:
                yield a + x, text[a + x : a + y], *row
                last = a + y  # not found again at its next line end
                break
            a, b = (a + y, b) if a + y <= p else (a, a + x)


def both(text: str | None) -> list[tuple]:
    """texts(), and outside them notices() and wrapped(); where these overlap in confirmed ones, those with fewer differing words."""
    whole = list(texts(text))
    inside = lambda r: any(r[0] < w[0] + len(w[1]) and w[0] < r[0] + len(r[1]) for w in whole)
    rows = [r for r in notices(text) if not inside(r)]
    for x in wrapped(text):
        if inside(x):
            continue
        same = [r for r in rows if r[-1] and r[0] < x[0] + len(x[1]) and x[0] < r[0] + len(r[1])]
        if all(x[5] < r[5] for r in same):
            rows = [r for r in rows if r not in same] + [x]
    return rows + whole


def scan(docs: DataFrame) -> DataFrame:
    """A row for each candidate block, with its winner."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "position", "block", "license", "bytes_alone", "bytes_saved", "words_differing", "words_template", "confirmed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_())
            rows = [(i.as_py(), *found) for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True) for found in both(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    hinted = docs.select("doc_id", "text").where(F.col("text").rlike(HINT))
    return hinted.mapInArrow(run, f"doc_id {kind}, position long, block string, license string, bytes_alone long, bytes_saved long, words_differing long, words_template long, confirmed boolean")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("confirmed").drop("confirmed")

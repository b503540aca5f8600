"""Operator 2: license scan by MinHash bands over overlapping windows and exact shingle containment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import ALNUM_WORDS, gram_hashes, lean, mix, row_groups, text_rows, word_hashes
from .shared import materialize

#: Words of a shingle (a shorter template is one shingle), and the share of a template's shingles that a match holds.
WORDS, CONTAINMENT = 5, 0.8
#: A match may be spread over so many times the shingles of its template: by words, notices or page heads put in.
SPREAD = 1.5
#: A window that holds a match shares no band with its template with at most this probability.
MISS = 1e-6
#: Templates of up to so many rows and bytes are broadcast at a time; more are scanned for block by block.
TEMPLATES, TEMPLATE_BYTES = 10_000, 1 << 24

# Statements and texts by which a license is declared.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_AS_IS_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
STATEMENTS = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", _BSD_HEAD),
    ("bsd-2-clause", " ".join([_BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_END])),
    ("bsd-3-clause", " ".join([_BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_THREE, _BSD_END])),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_AUTHOR),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS_AUTHOR),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-2.0-or-later", (_GNU + _NO_WARRANTY).format("General Public License", "2", "General Public License")),
    ("gpl-3.0-or-later", (_GNU + _NO_WARRANTY).format("General Public License", "3", "General Public License")),
    ("agpl-3.0-or-later", (_GNU + _NO_WARRANTY).format("Affero General Public License", "3", "Affero General Public License")),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("all-rights-reserved", "All rights reserved."),
]


def statements(spark: SparkSession) -> DataFrame:
    """(license, text) of the built-in statements."""
    return spark.createDataFrame(STATEMENTS, "license string, text string")


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one row each that two sets of this similarity all miss with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


_SEEDS = mix(np.arange(1, 257, dtype=np.uint64))


def _minima(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The least value of each hash function over some shingles."""
    seeds = _SEEDS[:bands, None]
    out = np.full(bands, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 4096):
        np.minimum(out, ((shingles[lo : lo + 4096] ^ seeds) * (seeds | np.uint64(1))).min(axis=1), out=out)
    return out


class Templates:
    """Template shingles in classes of equal shingle length and about equal size, with a lookup by band."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.names, self.sets = [], []
        groups: dict[tuple[int, int], list[int]] = {}
        for name, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            words, _ = word_hashes(raw, np.array([0, len(raw)]), ALNUM_WORDS)
            if not len(words):
                continue
            k = min(WORDS, len(words))
            shingles = np.unique(gram_hashes(words, k))
            # spans of up to SPREAD times the template, in steps of a half
            half = math.ceil(SPREAD ** math.ceil(math.log(SPREAD * len(shingles), SPREAD)))
            groups.setdefault((k, half), []).append(len(self.sets))
            self.names.append(name)
            self.sets.append(shingles)
        self.classes = []
        for (k, half), members in sorted(groups.items()):
            # a window has 2 * half shingles, so every span of half of them lies in one
            least = min(CONTAINMENT * len(self.sets[t]) / (2 * half + (1 - CONTAINMENT) * len(self.sets[t])) for t in members)
            bands = min(len(_SEEDS), bands_for(least))
            minima = np.stack([_minima(self.sets[t], bands) for t in members])
            keys: dict[tuple[int, int], list[int]] = {}
            for t, row in zip(members, minima.tolist(), strict=True):
                for b, value in enumerate(row):
                    keys.setdefault((b, value), []).append(t)
            self.classes.append((k, half, bands, keys, np.unique(np.concatenate([self.sets[t] for t in members]))))


def _holds(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the grams that are among the sorted known ones."""
    found = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.flatnonzero(known[found] == grams)


def _scan(docs: DataFrame, templates: Templates) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sieves = {k: _sieve([own for j, _, _, _, own in known.classes if j == k]) for k, *_ in known.classes}
        for batch in batches:
            data, at = text_rows(batch, "text")
            for lo, hi in row_groups(at):
                words, first = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM_WORDS)
                places: dict[tuple[int, str], dict[int, float]] = {}
                spots = {}
                for k, sieve in sieves.items():
                    grams = gram_hashes(words, k)
                    spots[k] = grams, np.flatnonzero(sieve[(grams & np.uint64(len(sieve) - 1)).astype(np.int64)])
                for k, half, bands, keys, own in known.classes:
                    grams, maybe = spots[k]
                    maybe = maybe[_holds(own, grams[maybe])]
                    row = np.searchsorted(first, maybe, "right") - 1
                    inside = maybe + k <= first[row + 1]  # grams between two rows cross them
                    maybe, row = maybe[inside], row[inside]
                    block = (maybe - first[row]) // half
                    # a window is two blocks; only one that holds some shingle of a template can match
                    windows = np.unique(np.concatenate([np.stack([row, block], 1), np.stack([row, block - 1], 1)[block > 0]]), axis=0)
                    for r, w in windows.tolist():
                        start = int(first[r]) + w * half
                        end = min(start + 2 * half, int(first[r + 1]) - k + 1)
                        part = grams[start:end]
                        found = {t for b, value in enumerate(_minima(part, bands).tolist()) for t in keys.get((b, value), ())}
                        for t in found:
                            _verify(known, t, part, start - int(first[r]), r, places)
                rows = sorted((r, name, max(shares.values()), min(shares)) for (r, name), shares in places.items())
                ids = batch.column("doc_id")[lo:hi].take(pa.array([x[0] for x in rows], pa.int64()))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["doc_id", "license", "containment", "first_word"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word long")


def _sieve(shingles: list[np.ndarray]) -> np.ndarray:
    """A table of flags by the low bits of the shingles, 2^16 to 2^24 of them."""
    every = np.concatenate(shingles)
    out = np.zeros(1 << min(24, max(16, int(16 * len(every)).bit_length())), bool)
    out[(every & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _verify(known: Templates, template: int, grams: np.ndarray, start: int, row: int, places: dict) -> None:
    """Notes the template's place in places[row, license] if the window of grams holds enough of its shingles."""
    wanted = known.sets[template]
    at = _holds(wanted, grams)
    share = len(np.unique(grams[at])) / len(wanted)
    if share >= CONTAINMENT:
        shares = places.setdefault((row, known.names[template]), {})
        spot = start + int(at[0])
        shares[spot] = max(share, shares.get(spot, 0.0))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): one row for each license that a text declares.

    Texts are cut into overlapping windows of a size after the templates of a class, so that any span of SPREAD times a
    template lies in one; bands of a window's MinHash retrieve templates, and the share of a template's shingles that
    the window holds decides, exactly. Windows without any shingle of a class are passed over, as they can't match. Of
    several matches of one license the row has the best share and the first place (a word's number).

    templates(license, text); None: the built-in ones. They are broadcast by blocks of TEMPLATES rows and
    TEMPLATE_BYTES bytes, all templates of a license in one block; each block is one scan. A license that is over the
    bound by itself is an error.

    Null and empty texts, texts and templates without words: no rows. Repeated rows: one row each for each license;
    rows without id are scanned too. Long texts are hashed in pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    given = (statements(spark) if templates is None else templates).select("license", "text").where("license is not null and text is not null").distinct()
    if templates is not None:
        given = materialize(given)
    size = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")
    own = given.groupBy("license").agg(*size)
    total = own.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), F.max("bytes").alias("longest")).first()
    if (total.most or 0) > TEMPLATES or (total.longest or 0) > TEMPLATE_BYTES:
        raise ValueError(f"a license of more than {TEMPLATES} templates or {TEMPLATE_BYTES} bytes")
    blocks = max(1, math.ceil(max((total.n or 0) / TEMPLATES, (total.bytes or 0) / TEMPLATE_BYTES)))
    out = []
    for block in range(blocks):
        part = given.where(F.pmod(F.xxhash64("license"), F.lit(blocks)) == block).orderBy("license", "text").collect()  # about the bound, twice it at most for large blocks
        out.append(_scan(docs, Templates([(r.license, r.text) for r in part])))
    return reduce(DataFrame.unionByName, out)

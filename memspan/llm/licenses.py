"""License scans by MinHash bands over overlapping text windows [native].

Words are lower-cased runs of letters and digits; shingles have five. For each length of
a template, windows a little longer overlap so much that any occurrence lies whole in
one. A window and a template meet when they agree in one of the bands, each the smallest
shingle under a hash of its own; candidates are verified by the exact share of the
template's shingles that the window holds.

A stride of a quarter of the template keeps the likeness of a window that holds 0.8 of
the template's shingles at 0.5 or more, so that 16 bands of one row miss it with a
probability under 0.00002. As a band agrees only where the window holds the template's
smallest shingle, only windows around places of those shingles are made; that changes
no result.

Templates are notices, made of names and the phrases that introduce them, public license
texts, whole and by paragraph, so that a body is found without its opening, and the whole
terms of seven long licenses, read from files beside this module. They are a fixed
list, so the tables made of them are small whatever the input; those of a caller are
broadcast only up to a stated size. Licenses that share most of their words are told
together: the terms of one of which only a sister is known are found under the sister's
name, with a share below 1.

Defined cases: a null or empty text, or one of fewer than five words, has no license.
Rows that repeat an id are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import let

WORDS = 5
BANDS = 16
CONTAINMENT = 0.8

#: Bytes of template texts up to which their table is broadcast.
BROADCAST_BYTES = 1 << 20

#: Names of licenses in notices.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0"],
    "mit": ["the MIT License"],
    "bsd-2-clause": ["the BSD 2-Clause License"],
    "bsd-3-clause": ["the BSD 3-Clause License"],
    "isc": ["the ISC License"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0"],
    "epl-2.0": ["the Eclipse Public License 2.0"],
    "gpl-2.0": ["the GNU General Public License, version 2"],
    "gpl-3.0": ["the GNU General Public License, version 3"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3"],
    "cc-by-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
PHRASES = ["Licensed under", "Released under", "Distributed under"]

_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CONDITIONS = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
)
#: Paragraphs of public license texts and of the headers that the longer licenses prescribe.
TEXTS = {
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "bsd-2-clause": [*_BSD_CONDITIONS, _BSD_WARRANTY],
    "bsd-3-clause": [*_BSD_CONDITIONS, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", _BSD_WARRANTY],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "gpl-3.0": [x.format(name="GNU General Public License", version=3) for x in _GNU],
    "lgpl-3.0": [x.format(name="GNU Lesser General Public License", version=3) for x in _GNU],
    "agpl-3.0": [x.format(name="GNU Affero General Public License", version=3) for x in _GNU],
}


#: Licenses whose terms lie in ``license_texts``, verbatim; what follows the terms tells how to apply them.
BODIES = ["apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0", "cc0-1.0"]
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def body(license_: str) -> str:
    """The terms of one of ``BODIES``."""
    text = resources.files("memspan.llm").joinpath("license_texts", f"{license_}.txt").read_text(encoding="utf-8")
    return text.partition(END_OF_TERMS)[0]


def default_templates() -> dict[str, list[str]]:
    """Notices, paragraphs of over eight words, whole texts, and whole terms, by license."""
    out: dict[str, list[str]] = {}
    for license_, names in NAMES.items():
        out[license_] = [f"{phrase} {name}" for phrase in PHRASES for name in names]
    for license_, parts in TEXTS.items():
        known = out.setdefault(license_, [])
        known += [p for p in parts if len(template_words(p)) > 8]
        known += ["\n\n".join(parts)] * (len(parts) > 1)
    for license_ in BODIES:
        out.setdefault(license_, []).append(body(license_))
    return out


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingled(df: DataFrame, words: str, out: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``out``, the hashes of the runs of five of the words."""
    run = lambda at: F.transform(F.slice(at, 1, F.greatest(F.size(at) - (WORDS - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(at, i + k) for k in range(1, WORDS))))
    return df.select(*keep, let(F.transform(words, lambda w: F.xxhash64(w)), run).alias(out))


def _banded(df: DataFrame, hashes: str, keep: list[str], bands: int) -> DataFrame:
    """``keep``, ``band`` and ``least``: the smallest of the hashes as the band hashes them anew."""
    rows = df.select(*keep, hashes, F.explode(F.lit(list(range(bands))).cast("array<int>")).alias("band"))
    smallest = F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64("band", h).alias("v"), h.alias("h"))))
    return rows.select(*keep, "band", smallest.alias("least"))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, bands: int = BANDS, least: float = CONTAINMENT) -> DataFrame:
    """``id``, ``row`` (a hash of the text) and ``licenses``, an array of (license, share, word) by license.

    ``share`` is the best share of the shingles of one of the license's templates in a window
    and ``word`` the first word of the first such window, from 0.
    """
    spark = df.sparkSession
    given = default_templates() if templates is None else templates
    texts = [(name, len(words), words) for name, listed in given.items() for text in listed if len(words := template_words(text)) >= WORDS or _refuse(name)]
    texts = [(k, *x) for k, x in enumerate(texts)]
    listed = spark.createDataFrame(texts, "k int, license string, n int, words array<string>")
    known = _shingled(listed, "words", "t", ["k", "license", "n"]).select("k", "license", "n", F.array_distinct("t").alias("t")).collect()  # the templates, which the caller holds
    least_of = _banded(spark.createDataFrame([(r["k"], r["n"], r["t"]) for r in known], "k int, n int, t array<bigint>"), "t", ["k", "n"], bands).collect()  # a row for each template and band
    minima = sorted({r["least"]["h"] for r in least_of})
    small = sum(len(text.encode()) for listed in given.values() for text in listed) <= BROADCAST_BYTES
    by_size = lambda table: F.broadcast(table) if small else table
    bands_of = spark.createDataFrame([(r["least"]["h"], r["least"]["v"], r["band"], r["k"], r["n"]) for r in least_of], "h bigint, v bigint, band int, k int, n int")
    of = spark.createDataFrame([(r["k"], r["license"], r["t"]) for r in known], "k int, license string, t array<bigint>")

    row = F.xxhash64(F.col(f"`{text_col}`"))
    ids = df.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"))
    words = F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}\p{N}]+")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.array_remove(words, "").alias("words"))
    docs = _shingled(docs, "words", "s", ["id", "row"])
    # The places of shingles that are a template's smallest. Written as SQL, a long list is one constant.
    places = F.expr(f"filter(transform(s, (h, p) -> struct(h, p)), x -> x.h IN ({', '.join(f'{h}L' for h in minima)}))")
    # The outer form keeps the optimizer from computing the shingles once more to rule empty lists out.
    found = docs.select("id", "row", "s", F.explode_outer(places).alias("x")).where("x is not null").select("id", "row", "s", "x.h", "x.p")
    near = found.join(by_size(bands_of), "h").withColumns({"stride": _stride("n"), "size": _size("n")})
    last = F.greatest(F.size("s") - F.col("size"), F.lit(0))
    low = F.greatest(F.ceil((F.col("p") - F.col("size") + 1) / F.col("stride")).cast("int"), F.lit(0))
    high = F.floor(F.least(F.col("p"), last) / F.col("stride")).cast("int")
    grid = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * F.col("stride"))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(F.array_union(grid, F.array(last)), lambda at: (at <= F.col("p")) & (F.col("p") < at + F.col("size")))
    windows = near.select("id", "row", "s", "size", "band", "v", "k", F.explode(starts).alias("word"))
    windows = windows.select("id", "row", "k", "word", "band", "v", F.slice("s", F.col("word") + 1, F.col("size")).alias("w"))
    # A window agrees with a template in a band if it holds the template's smallest shingle and none that is smaller.
    met = windows.where(~F.exists("w", lambda h: F.xxhash64("band", h) < F.col("v"))).join(by_size(of), "k")
    share = F.size(F.array_intersect("w", "t")) / F.size("t")
    hits = met.select("id", "row", "license", "word", share.alias("share")).where(F.col("share") >= least)
    best = hits.groupBy("id", "row", "license").agg(F.max(F.struct(F.col("share"), (-F.col("word")).alias("word"))).alias("b"))
    listed = best.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("license", "b.share", (-F.col("b.word")).alias("word")))).alias("licenses"))
    listed = listed.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "licenses")
    none = F.array().cast(listed.schema["licenses"].dataType)
    return ids.join(listed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("id", "row", F.coalesce("licenses", none).alias("licenses"))


def _stride(n: str) -> Column:
    """A quarter of a template of ``n`` words."""
    return F.greatest(F.floor(F.col(n) / 4), F.lit(1)).cast("int")


def _size(n: str) -> Column:
    """Shingles of a window: those of ``n`` words and, but for one, a stride."""
    return (F.col(n) - (WORDS - 1) + _stride(n) - 1).cast("int")


def _refuse(name: str) -> bool:
    raise ValueError(f"template {name} has fewer than {WORDS} words")

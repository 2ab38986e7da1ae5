"""License notices in documents, by Dice coefficient over word bigrams.

Native: DataFrame functions only. A document's lines, paragraphs and whole text are normalised and turned
into sets of word bigrams; a piece can only reach the threshold with templates whose size lies within
bounds of its own, and only if it shares a bigram with some template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The conditions and disclaimers of short licenses, in full.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_0BSD_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.")
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "3. This notice may not be removed or altered from any source distribution.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")


def _in_full(*parts: str) -> list[str]:
    """The whole text, and each of its paragraphs by itself."""
    return [" ".join(parts), *parts]


# Notices by which texts name their license, and short licenses in full.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", f"{_MIT_GRANT} {_MIT_NOTICE}", *_in_full(_MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", *_in_full(*_APACHE)],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD_NAMES, " ".join((_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_WARRANTY)), " ".join((_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES))],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", " ".join((_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_WARRANTY)), " ".join((_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY))],
    "BSD": [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_WARRANTY],
    "ISC-like": [_ISC_WARRANTY],
    "ISC": ["Released under the ISC License.", _ISC_GRANT, f"{_ISC_GRANT} {_ISC_WARRANTY}"],
    "0BSD": [_0BSD_GRANT, f"{_0BSD_GRANT} {_ISC_WARRANTY}"],
    "Zlib": ["Released under the zlib License.", *_in_full(*_ZLIB)],
    "Unlicense": _in_full(*_UNLICENSE),
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
}

#: Names of paragraphs that several licenses share, reported only where none of those licenses is.
FAMILIES = {"BSD": ("BSD-2-Clause", "BSD-3-Clause"), "ISC-like": ("ISC", "0BSD")}

# The notice that the GNU licenses ask for, and the license names that files are tagged with.
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
for _name, _kind, _version in (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
    NOTICES[_name] += [_GNU.format(work, _kind, _version) for work in ("program", "library")]
for _name in NOTICES.keys() - FAMILIES.keys():
    NOTICES[_name] += [f"SPDX-License-Identifier: {_name}{end}" for end in (("", "-only", "-or-later") if "GPL" in _name else ("",))]


def normal(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """All pairs of neighbouring words; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return pairs


def _once(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with an array ``column`` worked out once: filters on what a generator gives stay behind it, where the
    optimiser would put the column's whole expression into a filter for every mention."""
    return rows.select(*(F.col(c) for c in rows.columns if c != column), F.explode(F.array(column)).alias(column))


def _templates(notices: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, texts in notices.items():
        for text in texts:
            words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            out.append((name, sorted({" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words))))
    return out


def scan(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, notices: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, dice, pieces``: best coefficient and number of matching pieces of each license found.

    Pieces are the lines, the paragraphs (between empty lines) and the whole text, each distinct one once;
    pieces of more distinct words, and so of more distinct bigrams, than any template can match are left out.
    Paragraphs that licenses share name their family (FAMILIES), unless the document names a member of it.
    A document without notice, a null or an empty text has no row. Every row of the table counts for itself,
    whatever its id. An empty table gives an empty result. Other columns are ignored, whatever their names.
    Notices within a longer line or paragraph, and the long licenses' full texts, are beyond the templates.
    """
    templates = _templates(notices or NOTICES)
    known = sorted({b for _, bs in templates for b in bs})
    # Dice is at most 2 min / (a + b): a piece of n bigrams meets templates of n t/(2-t) to n (2-t)/t.
    slack = 1e-9
    fits = [(n, name, bs) for name, bs in templates for n in range(1, int(len(bs) * (2 - threshold) / threshold + slack) + 1) if 2 * min(n, len(bs)) >= threshold * (n + len(bs)) - slack]
    table = spark.createDataFrame(fits, "n int, license string, template array<string>")  # as large as the list of notices
    text = F.col(text_col)
    pieces = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    # Numbered before the pieces are unfolded, so that all pieces of a row carry its number.
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), pieces.alias("pieces"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "row", F.posexplode("pieces").alias("nth", "piece"))
    most = max((n for n, _, _ in fits), default=0)
    rows = _once(rows.select("doc_id", "row", "nth", F.split(normal(F.col("piece")), " ").alias("words")), "words").where(F.col("words")[0] != "")
    # All but one of the distinct words outside the templates begin a distinct bigram outside them, and of n bigrams
    # at most this share may be.
    vocabulary = sorted({w for b in known for w in b.split(" ")})
    rows = _once(rows.select("doc_id", "row", "nth", "words", F.array_distinct("words").alias("distinct")), "distinct").where(F.size("distinct") <= most + 1)
    strange = F.size(F.filter("distinct", lambda w: ~w.isin(vocabulary)))
    n_most = F.least(F.greatest(F.size("words") - 1, F.lit(1)), F.lit(most))
    rows = rows.where(strange - 1 <= (2 - 2 * threshold) / (2 - threshold) * n_most + slack)
    rows = _once(rows.select("doc_id", "row", "nth", F.array_distinct(bigrams(F.col("words"))).alias("all")), "all")
    rows = _once(rows.select("doc_id", "row", "nth", F.filter("all", lambda b: b.isin(known)).alias("shared"), F.size("all").alias("n")), "shared").where(F.size("shared") > 0)
    hits = rows.join(F.broadcast(table), "n")
    dice = 2.0 * F.size(F.array_intersect("shared", "template")) / (F.col("n") + F.size("template"))
    hits = hits.select("doc_id", "row", "nth", "license", dice.alias("dice")).where(F.col("dice") >= threshold - slack)
    # Each piece goes to the license it is closest to (ties to the later name).
    each = hits.groupBy("doc_id", "row", "nth").agg(F.max(F.struct("dice", "license")).alias("best"))
    found = each.groupBy("doc_id", "row", F.col("best.license").alias("license")).agg(F.round(F.max("best.dice"), 9).alias("dice"), F.count(F.lit(1)).alias("pieces"))
    # At most one entry for each license.
    held = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("license", "dice", "pieces")).alias("held"))
    named = F.transform("held", lambda x: x["license"])
    general = F.lit(False)
    for family, members in FAMILIES.items():
        general = general | ((F.col("x.license") == family) & F.arrays_overlap("named", F.array(*map(F.lit, members))))
    return held.select("doc_id", named.alias("named"), F.explode("held").alias("x")).where(~general).select("doc_id", "x.*")

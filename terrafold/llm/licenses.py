"""License scans: MinHash bands over overlapping windows, then exact shingle containment. DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Clauses that several licenses have in common.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_SOURCE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)

# License texts under their SPDX names, whole where they are short, else the header that the license asks for.
LICENSES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        f"{MIT_GRANT}, subject to the following conditions: "
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}"
    ),
    "MIT-0": f"{MIT_GRANT}. {AS_IS}",
    "BSD-2-Clause": BSD_SOURCE + BSD_AS_IS,
    "BSD-3-Clause": BSD_SOURCE + BSD_NAMES + BSD_AS_IS,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
        "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        f"future rights to this software under copyright law. {AS_IS}"
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
# Notices of a line or two that are in common use, by SPDX name.
NOTICES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "MIT/notice": "Released under the MIT License.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause/condition": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES = LICENSES | NOTICES
WORDS = 5
CONTAINED = 0.8
#: Hashes of a signature; a band is one of them, so a window whose shingles have similarity s with a template's meets it
#: with probability 1 - (1 - s) ** BANDS. Windows are at most about twice as long as their templates, which
#: leaves s of a third or more and a chance over 0.999 for each; see ``least_collision``.
BANDS = 20


def norm_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


def anchors(templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> list[str]:
    """Words of which each text with ``contained`` of a template's shingles has at least one.

    For each template, words are taken until the shingles without any of them are fewer than the share that a
    text must hold. Long words come first, as other texts seldom have them, then such as serve many templates.
    """
    use = Counter(w for t in templates.values() for w in set(norm_words(t)))
    out: list[str] = []
    for text in templates.values():
        left = shingles(norm_words(text))
        need = contained * len(left)
        left = {s for s in left if not set(s.split()) & set(out)}
        while len(left) >= need:
            here = Counter(w for s in left for w in set(s.split()))
            out.append(max(here, key=lambda w: (min(len(w), 7), here[w] * use[w], w)))
            left = {s for s in left if out[-1] not in s.split()}
    return out


def scale(n: int) -> int:
    """Words of the windows that look for a template of ``n`` words: the next length of a geometric row."""
    size = WORDS
    while size < n:
        size = max(size + 1, int(size * 1.6))
    return size


def least_collision(n: int, bands: int = BANDS) -> float:
    """Lower bound of the chance that a window holding 0.8 of a template of ``n`` words meets it in a band."""
    window, m = scale(n) + step(scale(n)), max(1, n - WORDS + 1)
    s = CONTAINED * m / (max(1, window - WORDS + 1) + (1 - CONTAINED) * m)
    return 1 - (1 - min(1.0, s)) ** bands


def step(size: int) -> int:
    """Words between two windows of a scale; windows are ``size + step`` long, so each run of ``size`` words lies within one."""
    return max(1, size // 4)


def shingle_array(words: Column) -> Column:
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - WORDS + 1))
    return F.when(n > 0, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(WORDS)), " ")))).otherwise(F.array().cast("array<string>"))


def signature(hashes: Column, bands: int = BANDS) -> Column:
    """The least of the shingles' hashes under each of ``bands`` hash functions, marked with its band."""
    seeds = F.array(*map(F.lit, range(bands)))
    return F.transform(seeds, lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))))


def word_array(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def catalogue(spark: SparkSession, templates: dict[str, str] = TEMPLATES, bands: int = BANDS) -> Column:
    """The templates by the length of their windows, as one constant: as many as the caller's dictionary holds."""
    given = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(t).alias("text")) for k, t in templates.items()))
    rows = spark.range(1).select(F.inline(given))
    rows = rows.select("name", word_array(F.col("text")).alias("w")).select("name", F.size("w").alias("n"), shingle_array(F.col("w")).alias("s"))
    known = rows.select("name", "n", "s", signature(F.transform("s", lambda s: F.xxhash64(s)), bands).alias("g")).collect()
    template = lambda r: F.struct(F.lit(r.name).alias("name"), F.array(*map(F.lit, r.s)).alias("s"), F.array(*map(F.lit, r.g)).alias("g"))
    by_scale = {size: [r for r in known if scale(r.n) == size] for size in sorted({scale(r.n) for r in known})}
    return F.array(*(F.struct(F.lit(step(k)).alias("stride"), F.lit(k + step(k)).alias("length"), F.array(*map(template, own)).alias("templates")) for k, own in by_scale.items()))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """``(id_col, licenses)`` per row: each found license as ``(name, containment, word)``, its best window, by name.

    Windows overlap, one length for templates of like length; their MinHash bands retrieve
    templates, and a retrieved one counts where the window holds at least ``contained`` of its five-word
    shingles, exactly. Texts without any of the templates' anchor words, and windows without one, can't
    reach that and are left aside before hashing, which loses nothing. All of it happens within a row: no
    shuffle, no join, memory of one text. Cases: null and empty texts have none; a text shorter than a
    window is one window; of equal containments the first window counts; repeated rows and null ids stay as they are; an
    empty table gives an empty result; other columns are ignored.
    """
    known, marks = catalogue(docs.sparkSession, templates, bands), anchors(templates, contained)
    words, places = F.col("words"), F.col("places")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    quick = F.col("text").rlike("(?i)" + "|".join(sorted(marks, key=len, reverse=True)))
    plain = plain.select("id", F.when(quick, word_array(F.col("text"))).alias("words"))
    plain = plain.withColumn("places", F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(marks))))

    def hits(sc: Column) -> Column:
        stride, length = sc["stride"], sc["length"]
        # the windows that hold an anchor; window w begins at word w * stride
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - length + 1) / stride).cast("int"))
        near = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(first(p), F.floor(p / stride).cast("int")))))
        windows = F.transform(near, lambda w: F.struct((w * stride).alias("word"), shingle_array(F.slice(words, w * stride + 1, length)).alias("s")))
        windows = F.transform(windows, lambda x: F.struct(x["word"].alias("word"), x["s"].alias("s"), F.transform(x["s"], lambda s: F.xxhash64(s)).alias("h")))
        windows = F.transform(windows, lambda x: F.struct(x["word"].alias("word"), x["s"].alias("s"), signature(x["h"], bands).alias("g")))

        def verified(x: Column) -> Column:
            met = F.filter(sc["templates"], lambda t: F.arrays_overlap(t["g"], x["g"]))
            share = lambda t: F.size(F.array_intersect(x["s"], t["s"])) / F.size(t["s"])
            return F.transform(met, lambda t: F.struct(t["name"].alias("name"), share(t).alias("c"), (-x["word"]).alias("w")))

        return F.filter(F.flatten(F.transform(windows, verified)), lambda h: h["c"] >= contained)

    plain = plain.select("id", F.when(F.size(places) > 0, F.flatten(F.transform(known, hits))).alias("hits"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"])))
    best = F.transform(names, lambda n: F.array_max(F.filter("hits", lambda h: h["name"] == n)))
    listed = F.transform(best, lambda h: F.struct(h["name"].alias("name"), h["c"].alias("containment"), (-h["w"]).cast("int").alias("word")))
    none = F.array().cast("array<struct<name:string,containment:double,word:int>>")
    return plain.select(F.col("id").alias(id_col), F.coalesce(listed, none).alias("licenses"))


def license_report(docs: DataFrame, **kw) -> DataFrame:
    found = scan_licenses(docs, **kw)
    names = F.transform("licenses", lambda x: x["name"])
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.round(F.array_max(F.transform("licenses", lambda x: x["containment"])), 6).alias("containment"))

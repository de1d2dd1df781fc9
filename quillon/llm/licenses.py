"""Licence scan: TF-IDF cosine of headers and whole files to licence notices and texts, then inheritance from directories.

SQL functions only. Of a file's matching parts the one with the largest matched weight decides, which is its cosine
times its norm, so that a whole text outweighs a line of it; a line that only reserves all rights decides where
nothing else matches. A part that names versions matches no template of other versions. A file with an
SPDX-License-Identifier has the licence that it declares, an expression of several as it stands, and never inherits.

Null texts have no licence. A null path has no directory and inherits nothing. Every row is scanned by itself,
whatever its key: null and repeated keys keep their own licences. Ties go to the higher cosine, then the first
licence in alphabetical order, also between licence files of one directory. Very
long texts are scanned whole; only those of their lines, paragraphs and sentences that can match are compared. An
empty table gives an empty result; other columns than the three named ones are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import broadcast_if_small, materialise

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_GNU = (
    " is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
_GNU_MORE = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along "
    "with this program. If not, see <https://www.gnu.org/licenses/>."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_CC_MORE = " To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."


def _gnu(name: str, version: str, date: str) -> tuple[str, ...]:
    title = f"GNU {name.upper()} Version {version}, {date}"
    return (title, "This program" + _GNU.format(name, version), "This program" + _GNU.format(name, version) + _GNU_MORE.format(name))


def _cc(code: str, title: str) -> tuple[str, ...]:
    return (f"Licensed under CC {code.upper()} 4.0.", _CC.format(title), _CC.format(title) + _CC_MORE.format(code), f"Creative Commons {title} 4.0 International Public License")


#: The notices by which works declare these licences, the titles of the long ones and the texts of the short ones.
TEMPLATES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", *_gnu("Affero General Public License", "3", "19 November 2007")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD 2-Clause License.", _BSD + _BSD_WARRANTY),
    "BSD-3-Clause": (
        "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
        _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    ),
    "CC-BY-4.0": _cc("by", "Attribution"),
    "CC-BY-NC-4.0": _cc("by-nc", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("by-sa", "Attribution-ShareAlike"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", *_gnu("General Public License", "2", "June 1991")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", *_gnu("General Public License", "3", "29 June 2007")),
    "ISC": (
        "SPDX-License-Identifier: ISC", "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", *_gnu("Lesser General Public License", "2.1", "February 1999")),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", *_gnu("Lesser General Public License", "3", "29 June 2007")),
    "MIT": (
        "Released under the MIT License.", "Released under MIT.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    "MPL-2.0": (
        "Subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright, all rights reserved."),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
}
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: Words that are no terms, as they say nothing about a licence.
STOP = frozenset("all also above agreed along been each had he her his how however i into list made many may me more most must my name names one part people said she some then they time use way we when word words would a an and any are as at be by but can do even for from has have if in is it its no not of on or other out see so such than that the their there these this to under was were what which who will with without you your".split())
MIN_COSINE = 0.6
#: Stems that headers have and prose seldom has; anchor() adds what is wanting.
STEMS = ("licen", "copyright", "reserved", "redistribut", "unencumbered", "warrant", "cc0", "creative", "sublicense")
#: The licences whose templates end with the whole text: a file that is such a text is a licence file, whatever its name.
WHOLE_TEXTS = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")
#: What decides only where nothing else matches.
LAST = "Proprietary"
#: How a text names a licence's version, and the expression that it declares.
VERSION = r"(?<![a-z])(?:version|v\.?|attribution(?:-[a-z]+)*|licenses/[a-z-]+/)[\s,]*(\d+(?:\.\d+)*)"
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
DECLARED = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
#: A file is a licence file if so named and any part of it matches.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Directories with a licence that are broadcast; more are joined by shuffle.
BROADCAST_DIRS = 20_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def versions(text: Column) -> Column:
    """The version numbers that a text names, 2.0 being 2."""
    found = F.regexp_extract_all(F.lower(text), F.lit(VERSION), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, r"(\.0)+$", "")))


def declared(text: Column) -> Column:
    """The expression of the text's first SPDX line, without brackets around the whole; null without one."""
    said = F.regexp_replace(F.regexp_extract(text, DECLARED, 1), r"^\(([^()]*)\)$|\.$", "$1")
    return F.when(F.contains(text, F.lit("SPDX-License-Identifier:")), F.nullif(said, F.lit("")))


def template_versions() -> list[list[str]]:
    return [sorted({re.sub(r"(\.0)+$", "", v) for v in re.findall(VERSION, text.lower())}) for texts in TEMPLATES.values() for text in texts]


def template_weights() -> tuple[list[tuple[str, dict[str, float]]], dict[str, float], float]:
    """(licence, weights of unit length by term) of each template, idf over the templates, ln((1 + T) / (1 + df)) + 1, and that of other terms.

    A term that occurs n times weighs (1 + ln n) idf.
    """
    terms_of = lambda text: Counter(t for t in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()) if t not in STOP)
    found = [(name, terms_of(text)) for name, texts in TEMPLATES.items() for text in texts]
    df = Counter(term for _, terms in found for term in terms)
    idf = {term: math.log((1 + len(found)) / (1 + n)) + 1 for term, n in df.items()}
    out = []
    for name, terms in found:
        x = {t: (1 + math.log(tf)) * idf[t] for t, tf in terms.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out.append((name, {t: v / norm for t, v in x.items()}))
    return out, idf, math.log(1 + len(found)) + 1


def anchor(min_cosine: float = MIN_COSINE) -> str:
    """A pattern that every text within min_cosine of a template matches in lower case.

    A text's cosine to a template is at most the norm of the template's weights on the terms that both have. So it
    must have one of the terms without which the rest of the template's norm is less than min_cosine: terms with one of
    STEMS, and where these don't suffice the template's heaviest other terms, those of one or two characters last.
    """
    words: list[str] = []
    for _, weights in template_weights()[0]:
        rest = sorted((len(t) < 3, -w, t) for t, w in weights.items() if t not in words and not any(s in t for s in STEMS))
        while sum(w * w for _, w, _ in rest) >= min_cosine**2:
            words.append(rest.pop(0)[2])
    return "|".join(STEMS) + r"|(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"


def reachable(text: Column, min_cosine: float = MIN_COSINE) -> Column:
    """False only if no template can be within min_cosine of the text.

    With k distinct terms that no template has, and n occurrences of terms that some have, the text's norm is at least
    sqrt(v + k other_idf^2), v being the squared norm of the latter; a cosine is at most sqrt(v) over that. And
    v <= 1.5 n max_idf^2, as (1 + ln t)^2 <= 1.5 t.
    """
    _, idf, other_idf = template_weights()
    factor = (1 / min_cosine**2 - 1) * 1.5 * max(idf.values()) ** 2 / other_idf**2
    known, plain = F.lit(sorted(idf)), F.lit(sorted({*idf, *STOP}))

    def test(terms: Column) -> Column:
        distinct = F.array_distinct(terms)
        shared = F.filter(F.array(F.array_intersect(distinct, known)), lambda s: F.size(s) > 0)
        n = F.transform(shared, lambda s: F.size(F.filter(terms, lambda t: F.array_contains(s, t))))
        return F.size(F.array_except(distinct, plain)) <= factor * F.coalesce(F.get(n, F.lit(0)), F.lit(0))

    return F.element_at(F.transform(F.array(_terms(text)), test), 1)


def segments(text: Column, pattern: str) -> Column:
    """The whole text, empty if it can't match, its paragraphs, lines, sentences and runs of two or three sentences, those that can match; null for a text without the pattern."""
    has = lambda x: F.lower(x).rlike(pattern)
    split = F.concat(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), F.split(text, "\n"))
    pieces = F.when(F.contains(text, F.lit("\n")), F.filter(split, lambda x: has(x) & (x != text))).otherwise(F.array().cast("array<string>"))
    sentences = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?;]) ")

    def runs(z: Column) -> Column:
        """Each sentence and it with the one and the two after it, where one of them matches: no match spans two, as none has a blank."""
        s = z["s"]
        hit = lambda i: F.coalesce(F.get(z["h"], i), F.lit(False))
        near = lambda x, i: F.array(
            F.when(hit(i), x), F.when(hit(i) | hit(i + 1), F.concat_ws(" ", x, F.get(s, i + 1))), F.when(hit(i) | hit(i + 1) | hit(i + 2), F.concat_ws(" ", x, F.get(s, i + 1), F.get(s, i + 2)))
        )
        return F.array_compact(F.flatten(F.transform(s, near)))

    judged = F.transform(F.array(sentences), lambda s: F.struct(s.alias("s"), F.transform(s, has).alias("h")))
    pieces = F.concat(pieces, F.element_at(F.transform(judged, runs), 1))
    matching = F.filter(F.array_distinct(F.filter(pieces, lambda x: x != text)), lambda x: reachable(x))
    return F.when(F.lower(text).rlike(pattern), F.concat(F.array(F.when(reachable(text), text).otherwise("")), matching))


def headers(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(row, licence, cosine, whole): of files (row, segments) the weightiest matching segment, and whether the file is a whole licence text.

    Each segment's term counts are made once; its norm and its products with all templates are sums of one
    aggregate. The templates' weights are a row for each of their terms, which bounds the broadcast.
    """
    spark = files.sparkSession
    templates, idf, other_idf = template_weights()
    entries: dict[str, list[tuple[int, float]]] = {}
    for i, (_, weights) in enumerate(templates):
        for term, w in weights.items():
            entries.setdefault(term, []).append((i, w))
    vocabulary = spark.createDataFrame([(t, idf[t], e) for t, e in entries.items()], "term string, idf double, entries array<struct<t:int,w:double>>")
    ends = [i == len(texts) - 1 and name in WHOLE_TEXTS for name, texts in TEMPLATES.items() for i in range(len(texts))]
    names = spark.createDataFrame([(i, name, v, end) for i, ((name, _), v, end) in enumerate(zip(templates, template_versions(), ends))], "t int, licence string, of_versions array<string>, text boolean")
    parts = files.filter("segments is not null").select("row", F.posexplode("segments").alias("part", "text")).withColumn("versions", versions(F.col("text")))
    tf = parts.select("row", "part", "versions", F.explode(_terms(F.col("text"))).alias("term")).filter(~F.col("term").isin(*sorted(STOP))).groupBy("row", "part", "versions", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(vocabulary), "term", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other_idf)))
    own = F.array(F.struct(F.lit(-1).alias("t"), (F.col("x") * F.col("x")).alias("v")))
    shared = F.transform(F.coalesce("entries", F.array().cast("array<struct<t:int,w:double>>")), lambda e: F.struct(e["t"].alias("t"), (F.col("x") * e["w"]).alias("v")))
    sums = weighed.select("row", "part", "versions", F.explode(F.concat(own, shared)).alias("e")).groupBy("row", "part", "versions", "e.t").agg(F.sum("e.v").alias("v"))
    sums = sums.join(F.broadcast(names), "t", "left")
    agrees = (F.size("versions") == 0) | (F.size("of_versions") == 0) | F.arrays_overlap("versions", "of_versions")
    best = F.min(F.when((F.col("t") >= 0) & agrees, F.struct((-F.round("v", 9)).alias("v"), "licence", "text")))
    each = sums.groupBy("row", "part").agg(F.max(F.when(F.col("t") < 0, F.col("v"))).alias("norm"), best.alias("b"))
    scored = each.select("row", "part", "b.licence", "b.text", F.round(-F.col("b.v"), 6).alias("weight"), F.round(-F.col("b.v") / F.sqrt("norm"), 6).alias("cosine")).filter(F.col("cosine") >= min_cosine)
    order = F.struct(F.col("licence") == LAST, (-F.col("weight")).alias("w"), (-F.col("cosine")).alias("c"), "licence")
    found = scored.groupBy("row").agg(F.min(order).alias("b"), F.max((F.col("part") == 0) & F.col("text")).alias("whole"))
    return found.select("row", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "whole")


def parent(path: Column) -> Column:
    """The directory of a path; null for a path without one."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def scan(files: DataFrame, key_col: str, path_col: str, text_col: str) -> DataFrame:
    """(key, path, licence, cosine, origin, inherited_from): origin is header, inherited or none; a declared licence that no part matches has no cosine.

    The texts are read once; what is stored of them are the segments that may match. Licence files give their
    directory its licence. Every distinct directory of files looks up its ancestors, itself first, by an equal join
    on their paths; files then join their directory.
    """
    text, path = F.coalesce(F.col(text_col), F.lit("")), F.col(path_col)
    rows = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(key_col).alias("key"), path.alias("path"), parent(path).alias("dir"),
        F.coalesce(path.rlike(FILE_NAME), F.lit(False)).alias("named"), declared(text).alias("declared"), segments(text, anchor()).alias("segments"),
    )
    rows = materialise(rows, "segments")
    own = materialise(headers(rows.select("row", "segments")), "headers")
    own = rows.drop("segments").join(own, "row", "left").withColumn("licence", F.coalesce("declared", "licence"))
    scanned = materialise(own.drop("declared"), "scanned")
    given = scanned.filter("(named or whole) and licence is not null and dir is not null")
    dirs = given.groupBy("dir").agg(F.min(F.struct(F.coalesce(-F.col("cosine"), F.lit(0.0)).alias("c"), F.col("licence"))).alias("b"))
    dirs = materialise(dirs.select(F.col("dir").alias("ancestor"), F.col("b.licence").alias("dir_licence"), (-F.col("b.c")).alias("dir_cosine")), "licensed-dirs")
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    lookups = scanned.filter("licence is null and dir is not null").select("dir").distinct().select("dir", F.explode(ancestors).alias("ancestor"))
    nearest = lookups.join(broadcast_if_small(dirs, BROADCAST_DIRS), "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "dir_licence", "dir_cosine")).alias("b"))
    nearest = materialise(nearest.select(F.col("dir").alias("of_dir"), "b.ancestor", "b.dir_licence", "b.dir_cosine"), "nearest")
    joined = scanned.join(broadcast_if_small(nearest, BROADCAST_DIRS), F.col("licence").isNull() & (F.col("dir") == F.col("of_dir")), "left")
    origin = F.when(F.col("licence").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select("key", "path", F.coalesce("licence", "dir_licence").alias("licence"), F.when(F.col("licence").isNotNull(), F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"), origin.alias("origin"), F.col("ancestor").alias("inherited_from"))

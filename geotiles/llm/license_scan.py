"""Find licences in headers and licence files, and inherit them down directories.

Every passage (line or sentence) of a whole text that names a licence is
compared with templates of licence notices by the cosine of sparse TF-IDF
vectors.  The idf comes from the templates, a fixed and small set; a word that
no template has weighs as much as the rarest and counts once per occurrence.
The passage's best template of ``THRESHOLD`` or more is its licence, and the
text's is that of its best passage.

Beside passages, the whole text, its comment blocks, paragraphs, and the lines
and sentences in them are compared, lines joined and comment marks dropped,
whatever words they have, with standard headers, licence texts, titles and
sentences about every licence's name (``Blocks``).  A template may ask for words,
a name or a version, without which a unit is not its licence.  An SPDX tag
counts in full for each licence it names, known to a template or not.

A file without a licence takes that of the nearest ancestor directory (its own
first) which holds a licence file (LICENSE, COPYING, ...) with one.  Distinct
directories are joined with the licensed ones by path; files then join their
directory, so a directory that holds most files is one row until that last
join, which adaptive execution may split.

Only DataFrame functions are used.  Defined cases: null or empty texts have no
licence of their own and may inherit; a null path inherits from nowhere; the
best score wins in a directory with several licence files, then the licence
first in the alphabet; repeated rows each get their row; an empty table gives
an empty result; extra columns are kept, but those named like a result column
give way to it.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm.common import let, materialize, table, text_or_empty

#: Notices that stand for licences; several may stand for one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.6
#: A passage is looked at if it names a licence.
NAMES = "(?i)licen[cs]e|copyleft|public domain"
#: Comment marks at the start of a line; ends of comments, and of runs of line comments, end a block.
MARKS = r"(?m)^[ \t]*(?://+!?|/\*+!?|\*+|#+!?|--+|;+|%+|<!--|\"{3}|'{3}|dnl\b)[ \t]*"
BLOCK_ENDS = r"(?m)\*+/|-->|(?<=\n)(?=[ \t]*[^\s/#;%*-])(?<=^[ \t]{0,80}(?://|#|--|;|%)[^\n]{0,400}\n)"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\n\r]*)"
PASSAGES = r"\n|(?<=[.!?;])\x20"
TOKENS = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicen[cs]e|notice)(?:\.[^/]*)?$"


class Weights:
    """idf of the templates' words and the templates' normalised vectors."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        counts = [Counter(re.findall(TOKENS, text.lower())) for _, text in templates]
        df = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in sorted(df.items())}
        self.rarest = math.log(1 + len(counts)) + 1
        self.vectors = []
        for (name, _), c in zip(templates, counts, strict=True):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.vectors.append((name, {w: n * self.idf[w] / norm for w, n in sorted(c.items())}))


def _literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def best_license(text: Column, weights: Weights | None = None) -> Column:
    """struct<score, license> of the text's best passage, null where no passage reaches the threshold."""
    weights = weights or Weights()
    idf = _literal(weights.idf)

    def judge(passage: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(passage), F.lit(TOKENS), F.lit(0))

        def scored(tokens: Column) -> Column:
            known = F.filter(tokens, lambda w: F.map_contains_key(idf, w))
            # distinct known words are as many as the templates have, at most
            parts = F.transform(F.array_distinct(known), lambda w: F.struct(w.alias("w"), (F.size(F.filter(known, lambda x: x == w)) * F.element_at(idf, w)).alias("x")))

            def compared(parts: Column) -> Column:
                sums = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, p: a + f(p))
                norm = F.sqrt(sums(lambda p: p["x"] * p["x"]) + (F.size(tokens) - F.size(known)) * F.lit(weights.rarest**2))

                def cosine(vector: dict[str, float]) -> Column:
                    of = _literal(vector)
                    return sums(lambda p: p["x"] * F.coalesce(F.element_at(of, p["w"]), F.lit(0.0))) / norm

                return _best(F.array(*[F.struct(cosine(v).alias("score"), F.lit(name).alias("license")) for name, v in weights.vectors]))

            return let(parts, compared)

        return let(tokens, scored)

    passages = F.filter(F.split(text, PASSAGES, -1), lambda p: p.rlike(NAMES))
    return F.when(text.rlike(NAMES), let(_best(F.transform(passages, judge)), lambda b: F.when(F.round(b["score"], 4) >= THRESHOLD, F.struct(F.round(b["score"], 4).alias("score"), b["license"].alias("license")))))


def _tokens(text: str) -> list[str]:
    return re.findall(TOKENS, text.lower())


_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} version {1} as published by the Free Software Foundation."
_HOPE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: Names of the licences in sentences.
LICENSE_NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0 License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal Public Domain Dedication",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0 License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "MIT": ("MIT License", "MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "Unlicense": ("The Unlicense",),
}
SENTENCES = (
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}. See LICENSE for more information.",
    "This project is licensed under the {} - see the LICENSE.md file for details.", "This software is licensed under the terms of the {}. See the LICENSE file.",
)
#: Words of a name that do not tell one licence from another.
WEAK = frozenset(("the", "version", "v"))


def _blocks() -> list[tuple[str, str, tuple[str, ...]]]:
    """(licence, template, the words it asks for)."""
    out = [(n, s.format(name), tuple(w for w in dict.fromkeys(_tokens(name)) if w not in WEAK)) for n, names in LICENSE_NAMES.items() for name in names for s in SENTENCES]
    for n, name, version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
        need = ("gnu", name.split()[0].lower(), version)
        out += [(n, t, need) for form in (_GNU, _GNU_ONLY) for t in (form.format(name, version), form.format(name, version) + _HOPE.format(name))]
        date = {"GPL-2.0": "June 1991", "LGPL-2.1": "February 1999", "AGPL-3.0": "19 November 2007"}.get(n, "29 June 2007")
        out.append((n, f"GNU {name} Version {version}, {date}", need))
    out += [("MIT", "The MIT License (MIT)", ("mit", "license")), ("MIT", _MIT, ("sublicense",)), ("MIT", _MIT + _MIT_REST, ("sublicense",))]
    out += [("BSD-2-Clause", _BSD + _BSD_REST, ("redistribution", "binary")), ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_REST, ("redistribution", "endorse"))]
    out += [("Apache-2.0", _APACHE, ("apache", "2.0")), ("Apache-2.0", _APACHE + _APACHE_REST, ("apache", "2.0")), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache", "2.0"))]
    out += [("ISC", _ISC, ("fee", "granted")), ("ISC", _ISC + _ISC_REST, ("fee", "granted")), ("MPL-2.0", _MPL, ("mozilla", "2.0")), ("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla", "2.0"))]
    return [*out, ("Unlicense", _UNLICENSE, ("unencumbered",)), ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", ("cc0", "1.0"))]


class Blocks:
    """Templates of whole blocks, weighed among themselves as ``Weights`` does."""

    def __init__(self) -> None:
        made = _blocks()
        self.weights = Weights(tuple((n, t) for n, t, _ in made))
        self.needs = [need for _, _, need in made]

    def may_match(self, lowered: Column) -> Column:
        """Whether some template's words all occur in a text: where not, no unit of it can be compared with any."""
        sets = dict.fromkeys(tuple(sorted(need, key=lambda w: (-len(w), w))) for need in self.needs)
        return functools.reduce(operator.or_, [functools.reduce(operator.and_, [lowered.contains(w) for w in need]) for need in sets])

    def literal(self) -> Column:
        """All templates as one constant array of structs."""
        quoted = lambda w: f"'{w}'"
        rows = [
            f"named_struct('license', {quoted(n)}, 'needs', array({', '.join(map(quoted, need))}), 'v', map({', '.join(f'{quoted(w)}, {x!r}D' for w, x in v.items())}))"
            for (n, v), need in zip(self.weights.vectors, self.needs, strict=True)
        ]
        return F.expr(f"array({', '.join(rows)})")


def _best(found: Column) -> Column:
    """The highest score, then the licence first in the alphabet."""
    none = F.lit(None).cast("struct<score:double,license:string>")
    better = lambda a, x: a.isNull() | (F.round(x["score"], 9) > F.round(a["score"], 9)) | ((F.round(x["score"], 9) == F.round(a["score"], 9)) & (x["license"] < a["license"]))
    return F.aggregate(found, none, lambda a, x: F.when(x.isNotNull() & better(a, x), x).otherwise(a))


def spdx(text: Column) -> Column:
    """struct<score, license> of the text's SPDX tags: of all licences they name, the first in the alphabet."""
    asked = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda t: F.regexp_replace(t, r"(?i)\bWITH\s+\S+|\*/|-->", ""))
    ids = F.flatten(F.transform(asked, lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9.+-]*"), F.lit(0))))
    ids = F.transform(F.filter(ids, lambda i: ~F.upper(i).isin("AND", "OR", "WITH", "NONE", "NOASSERTION")), lambda i: F.regexp_replace(i, r"(?:-only|-or-later|\+)$", ""))
    return F.when(F.size(ids) > 0, F.struct(F.lit(1.0).alias("score"), F.array_min(ids).alias("license")))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r", ""), BLOCK_ENDS, "\f\n"), MARKS, "")


def units(text: Column) -> Column:
    """The whole text, its comment blocks, paragraphs, sentences and lines, without comment marks."""
    plain = without_marks(text)

    def cut(plain: Column) -> Column:
        paragraphs = F.split(plain, r"\f|\n[ \t]*(?=\n)", -1)
        sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?;])\s+(?=[A-Z(\"])", -1)))
        return F.array_distinct(F.concat(F.array(plain), F.split(plain, "\f", -1), paragraphs, sentences, F.split(plain, r"[\n\f]", -1)))

    return let(plain, cut)


def best_block(text: Column, blocks: Blocks | None = None) -> Column:
    """struct<score, license> of the best of the text's units, null where none reaches the threshold."""
    blocks = blocks or Blocks()
    weights, templates = blocks.weights, blocks.literal()
    idf = F.expr(f"map({', '.join(f'\'{w}\', {x!r}D' for w, x in weights.idf.items())})")

    def judge(unit: Column) -> Column:
        def scored(tokens: Column) -> Column:
            known = F.filter(tokens, lambda w: w.isin(*weights.idf))
            unknown = (F.size(tokens) - F.size(known)) * F.lit(weights.rarest**2)

            def counted(known: Column) -> Column:
                return F.transform(F.array_distinct(known), lambda w: F.struct(w.alias("w"), (F.size(F.filter(known, lambda x: x == w)) * F.element_at(idf, w)).alias("x")))

            def compared(parts: Column) -> Column:
                square = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["x"] * p["x"])
                words = F.transform(parts, lambda p: p["w"])

                def against(words: Column, norm2: Column) -> Column:
                    dot = lambda t: F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["x"] * F.coalesce(F.element_at(t["v"], p["w"]), F.lit(0.0)))
                    able = F.filter(templates, lambda t: F.size(F.array_except(t["needs"], words)) == 0)
                    return _best(F.transform(able, lambda t: F.struct((dot(t) / F.sqrt(norm2)).alias("score"), t["license"].alias("license"))))

                # no cosine is above the known words' share of the norm: most units end here
                return let(square, lambda q: F.when((q > 0) & (q >= (THRESHOLD - 1e-3) ** 2 * (q + unknown)), let(words, lambda w: against(w, q + unknown))))

            return let(let(known, counted), compared)

        return let(folded(unit), lambda u: F.when(blocks.may_match(u), let(F.regexp_extract_all(u, F.lit(TOKENS), F.lit(0)), scored)))

    folded = lambda x: F.regexp_replace(F.lower(x), "licence", "license")
    found = let(folded(without_marks(text)), lambda u: F.when(blocks.may_match(u), _best(F.transform(units(text), judge))))
    return let(found, lambda b: F.when(F.round(b["score"], 4) >= THRESHOLD, F.struct(F.round(b["score"], 4).alias("score"), b["license"].alias("license"))))


def own_license(text: Column, weights: Weights | None = None) -> Column:
    """struct<score, license> of the best of the text's passages, blocks and SPDX tags."""
    return _best(F.array(best_license(text, weights), best_block(text), spdx(text)))


def scan(files: DataFrame, path: str = "path", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """``files`` without the text, with ``license``, ``score``, ``found`` ("file" or "inherited") and ``found_in``."""
    rest = [c for c in files.columns if c not in (text, path, "license", "score", "found", "found_in")]
    own = files.select(F.struct(F.lit(True), *[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(path).alias("_path"), own_license(text_or_empty(text), weights).alias("_own"))
    own = own.withColumn("_dir", F.regexp_replace("_path", "/?[^/]*$", ""))
    own = own.withColumn("_declares", F.coalesce(F.regexp_extract("_path", "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False)))
    own = materialize(own)
    rank = F.struct(F.col("_own.score").alias("score"), F.col("_own.license").alias("license"))
    declared = own.where("_declares AND _own IS NOT NULL").groupBy("_dir").agg(F.max("_own.score").alias("top"), F.collect_set(rank).alias("all"))
    # a directory's licences are as many as there are templates and scores, not files
    declared = declared.select(F.col("_dir").alias("ancestor"), F.array_min(F.transform(F.filter("all", lambda r: r["score"] == F.col("top")), lambda r: r["license"])).alias("license"), F.col("top").alias("score"))
    dirs = own.where("_own IS NULL AND _dir IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/", -1)
    above = dirs.withColumn("depth", F.explode(F.sequence(F.size(parts), F.lit(0), F.lit(-1))))
    above = above.withColumn("ancestor", F.array_join(F.slice(F.split("_dir", "/", -1), F.lit(1), F.col("depth")), "/"))
    above = above.groupBy("_dir", "ancestor").agg(F.max("depth").alias("depth"))
    nearest = above.join(declared, "ancestor").groupBy("_dir").agg(F.max_by(F.struct("license", "score", "ancestor"), "depth").alias("_from"))
    joined = own.join(nearest, "_dir", "left")
    inherited = F.col("_own").isNull()
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rest],
        F.col("_path").alias(path),
        F.when(inherited, F.col("_from.license")).otherwise(F.col("_own.license")).alias("license"),
        F.when(inherited, F.col("_from.score")).otherwise(F.col("_own.score")).alias("score"),
        F.when(~inherited, "file").when(F.col("_from").isNotNull(), "inherited").alias("found"),
        F.when(~inherited, F.col("_path")).otherwise(F.col("_from.ancestor")).alias("found_in"),
    )


def document_path() -> Column:
    """The table of documents has no paths; this lays them out by source, language and number.

    Every thousandth document is its source's LICENSE file, every hundredth
    its language's, every tenth its folder's.
    """
    source, lang, n = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id")
    folder = F.floor(n / 200).cast("string")
    return (
        F.when(n % 1000 == 0, F.concat_ws("/", source, F.lit("LICENSE")))
        .when(n % 100 == 0, F.concat_ws("/", source, lang, F.lit("LICENSE.txt")))
        .when(n % 10 == 0, F.concat_ws("/", source, lang, folder, F.lit("COPYING")))
        .when(n.isNotNull(), F.concat_ws("/", source, lang, folder, F.concat(n.cast("string"), F.lit(".txt"))))
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path"))
    return scan(documents).select("doc_id", "path", "license", "score", "found", "found_in")


def _sql() -> str:
    weights = Weights()
    idf = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in weights.idf.items())
    vectors = ", ".join(f"({i}, '{name}', '{w}', {x!r}::DOUBLE)" for i, (name, v) in enumerate(weights.vectors) for w, x in v.items())
    return rf"""
WITH idf(w, idf) AS (VALUES {idf}), template(t, license, w, x) AS (VALUES {vectors}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l,
        (doc_id // 200)::VARCHAR AS f FROM documents),
p AS (SELECT rid, doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN s || '/LICENSE' WHEN doc_id % 100 = 0 THEN s || '/' || l || '/LICENSE.txt'
        WHEN doc_id % 10 = 0 THEN s || '/' || l || '/' || f || '/COPYING' ELSE s || '/' || l || '/' || f || '/' || doc_id || '.txt' END AS path FROM d),
pas AS (SELECT rid, unnest(string_split(regexp_replace(text, '([.!?;])\x20', '\1' || chr(10), 'g'), chr(10))) AS passage FROM p),
num AS (SELECT rid, row_number() OVER () AS pid, passage FROM pas WHERE regexp_matches(passage, '(?i)licen[cs]e|copyleft|public domain')),
tok AS (SELECT rid, pid, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+(?:\.[0-9]+)*')) AS w FROM num),
tf AS (SELECT rid, pid, w, count(*) AS n FROM tok GROUP BY ALL),
wt AS (SELECT rid, pid, w, n, n * idf AS x FROM tf LEFT JOIN idf USING (w)),
norm AS (SELECT pid, sqrt(sum(CASE WHEN x IS NULL THEN n * {weights.rarest**2!r} ELSE x * x END)) AS norm FROM wt GROUP BY pid),
cosine AS (SELECT rid, license, sum(wt.x * template.x) / any_value(norm) AS score FROM wt JOIN template USING (w) JOIN norm USING (pid) GROUP BY rid, pid, t, license),
own AS (SELECT rid, round(score, 4) AS score, license FROM cosine WHERE round(score, 4) >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY round(score, 9) DESC, license) = 1),
file AS (SELECT p.rid, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, score, license,
        regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(?:licen[cs]e|copying|unlicen[cs]e|notice)(?:\.[^/]*)?$') AS declares FROM p LEFT JOIN own USING (rid)),
decl AS (SELECT dir AS ancestor, license, score FROM file WHERE declares AND license IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (SELECT file.rid, decl.* FROM file JOIN decl ON file.license IS NULL AND (file.dir = ancestor OR starts_with(file.dir, ancestor || '/'))
        QUALIFY row_number() OVER (PARTITION BY file.rid ORDER BY len(ancestor) DESC) = 1)
SELECT doc_id, path, coalesce(file.license, near.license) AS license, coalesce(file.score, near.score) AS score,
       CASE WHEN file.license IS NOT NULL THEN 'file' WHEN near.license IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN file.license IS NOT NULL THEN path ELSE ancestor END AS found_in
FROM file LEFT JOIN near USING (rid)
"""


OP1_SQL = _sql()

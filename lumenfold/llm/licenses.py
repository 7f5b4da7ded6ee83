"""License scans: Dice coefficient over word bigrams between units of a text and licence templates.

Units of a text are its lines, the licence-like sentences of lines that have several, its paragraphs (parted by blank lines),
its passages and the whole text. A sentence is licence-like if half of its words and half of its bigrams or more are in some
template; a passage is a run of such sentences, over any lines and paragraphs. So a notice within a longer line is a sentence or a passage, and one over several paragraphs a
passage. A unit with n distinct bigrams can reach a Dice coefficient of t only against templates with t/(2-t)*n to (2-t)/t*n
distinct bigrams; others are pruned before any bigram is compared. All work is within a row: no shuffle, no state that grows
with the corpus.

Defined results: null and empty texts, and texts of one word, match nothing; ties between templates go to the smallest
name; repeated documents are judged row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import let, text_of

# Notices and texts of public licences, as published.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": _BSD + "the following conditions are met: 1. " + _BSD_SOURCE + " 2. " + _BSD_BINARY,
    "bsd-2-clause-full": _BSD + "the following conditions are met: 1. " + _BSD_SOURCE + " 2. " + _BSD_BINARY + " " + _BSD_AS_IS,
    "bsd-3-clause": _BSD + "the following conditions are met: 1. " + _BSD_SOURCE + " 2. " + _BSD_BINARY + " 3. " + _BSD_NAME,
    "bsd-3-clause-full": _BSD + "the following conditions are met: 1. " + _BSD_SOURCE + " 2. " + _BSD_BINARY + " 3. " + _BSD_NAME + " " + _BSD_AS_IS,
    "artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": _ISC,
    "isc-full": _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-full": _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit": _MIT,
    "mit-short": "Licensed under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
THRESHOLD = 0.8


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of normalised text, sorted; the plain form of what Spark computes."""
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


#: Short notices are worded in many ways: each of WORDINGS with each of these names is a template, unless an earlier one of its licence reaches it and no other licence does.
NAMES = {
    "agpl-3.0": "the GNU Affero General Public License, version 3", "apache-2.0": "the Apache License, Version 2.0", "artistic-2.0": "the Artistic License 2.0", "boost-1.0": "the Boost Software License, Version 1.0", "bsd-2-clause": "the BSD 2-Clause License", "bsd-3-clause": "the BSD 3-Clause License",
    "cc-by-4.0": "CC BY 4.0", "cc-by-nc-4.0": "CC BY-NC 4.0", "cc-by-sa-4.0": "CC BY-SA 4.0", "cc0-1.0": "CC0 1.0", "epl-2.0": "the Eclipse Public License 2.0", "gpl-2.0": "the GNU General Public License, version 2",
    "gpl-3.0": "the GNU General Public License, version 3", "isc": "the ISC License", "lgpl-2.1": "the GNU Lesser General Public License, version 2.1", "lgpl-3.0": "the GNU Lesser General Public License, version 3", "mit": "the MIT License", "mpl-2.0": "the Mozilla Public License, version 2.0", "unlicense": "the Unlicense",
}
WORDINGS = [f"{start}{verb} under {{}}." for start in ("", "This project is ") for verb in ("Licensed", "Released", "Distributed", "Available")]


def _worded() -> dict[str, str]:
    reaches = lambda g, h: 2 * len(g & h) >= THRESHOLD * (len(g) + len(h))
    found = {}
    for name, called in NAMES.items():
        own = [g for t, text in TEMPLATES.items() if t == name or t.startswith(f"{name}-") for g in [set(bigrams_of(text))]]
        for wording in WORDINGS if called.startswith("the ") else WORDINGS[:4]:
            grams = set(bigrams_of(wording.format(called)))
            others = [set(bigrams_of(wording.format(other))) for other in NAMES.values() if other != called]
            if not any(reaches(grams, g) for g in own) or any(reaches(grams, g) for g in others):
                own.append(grams)
                found[f"{name}-{'-'.join(wording.lower().split()[:-2])}"] = wording.format(called)
    return found


TEMPLATES |= _worded()


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


#: Ends of sentences within a line.
SENTENCE_END = r"[.;:!?]+(?:[ \t\r]|$)"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches, an array of (dice, license, unit, number) for each unit and template at the threshold or over.

    unit is line, sentence, paragraph, passage or text; number counts the units of a kind from 0. A text of one line is no line.
    """
    rows = sorted((name, grams) for name, text in (TEMPLATES if templates is None else templates).items() if (grams := bigrams_of(text)))
    table = F.from_json(F.lit(_json(rows)), "array<struct<name:string,grams:array<string>>>")
    known = sorted({g for _, grams in rows for g in grams})
    vocabulary = sorted({w for g in known for w in g.split()})
    least, most = min((len(g) for _, g in rows), default=0), max((len(g) for _, g in rows), default=-1)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def of_unit(unit: Column) -> Column:
        def scored(grams: Column) -> Column:
            n = F.size(grams)
            fits = F.filter(F.col("table"), lambda t: (F.size(t["grams"]) >= n * low) & (F.size(t["grams"]) <= n * high))
            dice = F.transform(fits, lambda t: F.struct((F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (n + F.size(t["grams"]))).alias("dice"), t["name"].alias("license"), unit["unit"].alias("unit"), unit["number"].alias("number")))
            return F.filter(dice, lambda m: m["dice"] >= threshold)

        # a unit has no more distinct bigrams than words less one, and no fewer than distinct words less one
        fits = lambda words: (F.size(words) - 1 >= least * low) & (F.size(F.array_distinct(words)) - 1 <= most * high)
        return let(unit["words"], lambda words: F.when(fits(words), let(_bigrams(words), lambda grams: F.when(F.size(grams) <= most * high, scored(grams)))))

    words_of = lambda x: F.array_remove(F.split(x, "[^a-z0-9]+"), "")
    named = lambda kind, parts: F.transform(parts, lambda w, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), w.alias("words")))
    none = F.array().cast("array<struct<unit:string,number:int,words:array<string>>>")

    def licence_like(words: Column) -> Column:
        """True or false; null for a sentence without a bigram, which parts no passage."""
        if not known:
            return F.lit(False)
        # most sentences have few of the words, so that their bigrams needn't be made
        mostly = lambda values, these: 2 * F.size(F.filter(values, lambda v: v.isin(these))) >= F.size(values)
        return F.when(F.size(words) > 1, mostly(words, vocabulary) & let(_bigrams(words), lambda grams: mostly(grams, known)))

    def passages(sentences: Column) -> Column:
        def between(like: Column) -> Column:
            ends = F.filter(F.transform(like, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
            ends = F.concat(F.array(F.lit(-1)), ends, F.array(F.size(like)))
            run = lambda values, stop, k: F.slice(values, F.get(stop, k) + 2, F.get(stop, k + 1) - F.get(stop, k) - 1)
            several = lambda stop, k: F.size(F.filter(run(like, stop, k), lambda x: x)) > 1
            parts = lambda stop: F.transform(F.sequence(F.lit(0), F.size(stop) - 2), lambda k: F.when(several(stop, k), F.flatten(run(sentences, stop, k))))
            return let(ends, lambda stop: F.filter(parts(stop), lambda w: w.isNotNull()))

        some = lambda like: F.size(F.filter(like, lambda x: x)) > 1
        return let(F.transform(sentences, licence_like), lambda like: F.when(some(like), named("passage", between(like))).otherwise(none))

    def units(text: Column) -> Column:
        """Each sentence is split into words once; lines and the text are their sentences' words together."""
        blocks = F.when(F.regexp_like(text, F.lit("\n[^a-z0-9\n]*\n")), named("paragraph", F.transform(F.split(text, "\n[^a-z0-9\n]*\n[^a-z0-9]*"), words_of))).otherwise(none)

        def of_lines(lines: Column) -> Column:
            own = F.when(F.size(lines) > 1, named("line", F.transform(lines, lambda x: F.flatten(x)))).otherwise(none)
            some = lambda x: F.filter(x, lambda w: F.size(w) > 0)
            several = named("sentence", F.filter(F.flatten(F.filter(F.transform(lines, some), lambda x: F.size(x) > 1)), licence_like))
            rest = lambda sentences: F.concat(passages(sentences), named("text", F.array(F.flatten(sentences))))
            return F.concat(own, several, blocks, let(F.flatten(lines), rest))

        return let(F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(line, SENTENCE_END), words_of)), of_lines)

    found = docs.select("doc_id", F.lower(text_of()).alias("low"), table.alias("table"))
    matches = F.flatten(F.filter(F.transform(let(F.col("low"), units), of_unit), lambda m: m.isNotNull()))
    flat = F.transform(matches, lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"), m["unit"].alias("unit"), m["number"].cast("bigint").alias("number")))
    return found.select("doc_id", flat.alias("matches"))


def _json(rows: list) -> str:
    import json

    return json.dumps([{"name": n, "grams": g} for n, g in rows])


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names in order), best_license and best_dice (null without a match)."""
    best = lambda m: F.array_min(F.transform(m, lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license"))))
    return license_matches(docs).select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        best(F.col("matches"))["license"].alias("best_license"), (-best(F.col("matches"))["d"]).alias("best_dice"))


def op5_sql() -> str:
    """op5_license_scan for DuckDB."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in bigrams_of(t))) for n, t in sorted(TEMPLATES.items()))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    words = "list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH templates(name, grams) AS (VALUES {rows}),
known AS (SELECT list(DISTINCT g) AS u, list_distinct(flatten(list(string_split(g, ' ')))) AS v FROM (SELECT unnest(grams) AS g FROM templates)),
normal AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
lines AS (SELECT doc_id, l[i] AS line, i, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM normal))),
parts AS (SELECT doc_id, i, n, k, {words.format('p[k]')} AS w
  FROM (SELECT doc_id, i, n, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, i, n, regexp_split_to_array(line, '{SENTENCE_END}') AS p FROM lines))),
judged AS (SELECT doc_id, i, k, w, CASE WHEN len(w) > 1 THEN 2 * len(list_filter(w, lambda x: list_contains(v, x))) >= len(w) AND 2 * len(list_intersect({grams.format('w')}, u)) >= len({grams.format('w')}) END AS alike FROM parts, known),
run AS (SELECT *, sum(CASE WHEN NOT alike THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, k) AS r FROM judged),
units AS (
  SELECT doc_id, flatten(list(w ORDER BY k)) AS w FROM parts WHERE n > 1 GROUP BY doc_id, i
  UNION ALL SELECT doc_id, w FROM (SELECT *, count(*) FILTER (len(w) > 0) OVER (PARTITION BY doc_id, i) AS m FROM judged) WHERE m > 1 AND alike
  UNION ALL SELECT doc_id, {words.format('u')} FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n[^a-z0-9\\n]*\\n[^a-z0-9]*')) AS u FROM normal WHERE regexp_matches(t, '\\n[^a-z0-9\\n]*\\n'))
  UNION ALL SELECT doc_id, flatten(list(w ORDER BY i, k)) FROM run WHERE coalesce(alike, true) GROUP BY doc_id, r HAVING count(*) FILTER (WHERE alike) > 1
  UNION ALL SELECT doc_id, flatten(list(w ORDER BY i, k)) FROM parts GROUP BY doc_id),
grams AS (SELECT doc_id, {grams.format('w')} AS g FROM units WHERE len(w) > 1),
scored AS (
  SELECT doc_id, name, len(list_intersect(g, grams)) * 2.0::DOUBLE / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON len(grams) >= len(g) * {low}::DOUBLE AND len(grams) <= len(g) * {high}::DOUBLE),
hits AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}::DOUBLE),
best AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, (-dice, name)) AS best, max(dice) AS dice
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses, best AS best_license, dice AS best_dice
FROM documents d LEFT JOIN best USING (doc_id)"""

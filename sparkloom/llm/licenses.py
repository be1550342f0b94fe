"""Licence scan: Dice coefficient over word bigrams, in built-in functions only.

A document's lines, runs of up to RUN lines that follow one another, and its
whole text are candidates, so that a notice may be wrapped inside a longer
file. A template is tried only where the number of bigrams still lets the
coefficient reach the threshold, and bigrams are formed only where a word occurs
without which no template can. A run that reaches a template has such a word in
one of its lines: runs are formed around those lines alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

THRESHOLD = 0.8
#: Lines of a run, at most.
RUN = 6

# Licence notices as their publishers word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
PARTS = "[^a-z0-9]+"
#: Words too common to tell anything; tried last.
COMMON = frozenset("a an and any be by can for in is may not of that the this to under with you your".split())


def bigrams(text: str) -> list[str]:
    w = [x for x in re.split(PARTS, text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def telling_words(grams: list[str], threshold: float) -> list[str]:
    """Words of which a text must hold one at least to reach the threshold: without them too few bigrams are left to share."""
    least = math.ceil(threshold / 2 * (len(grams) + math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)) - 1e-9)
    rest, out = set(grams), []
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(rest) < least:
            break
        if gone := {g for g in rest if w in g.split()}:
            rest -= gone
            out.append(w)
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), PARTS), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with _license (null: none), _score (best coefficient at or over the threshold, else 0) and _n_matches (matching single lines).

    Ties go to the template first in name order. Null and empty texts match
    nothing; repeated rows get the same; an empty table gives no rows. Templates
    of fewer than two words are refused. Columns that have the results' names
    already are replaced.
    """
    docs = without(docs, "_license", "_score", "_n_matches", "_found", "_best")
    sets = {k: bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    if any(not v for v in sets.values()):
        raise ValueError("a template needs two words")
    least = min(map(len, sets.values())) * threshold / (2 - threshold)
    most = max(map(len, sets.values())) * (2 - threshold) / threshold

    def score(b: Column) -> Column:
        n = F.size(b)
        tried = []
        for i, (k, v) in enumerate(sets.items()):
            low, high = len(v) * threshold / (2 - threshold), len(v) * (2 - threshold) / threshold
            same = F.size(F.array_intersect(b, F.array(*map(F.lit, v))))
            dice = F.when((n >= low) & (n <= high), 2.0 * same / (n + len(v)))
            tried.append(F.when(dice >= threshold, F.struct(dice.alias("s"), F.lit(-i).alias("i"))))
        return F.array_max(F.array(*tried))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    telling = sorted({w for v in sets.values() for w in telling_words(v, threshold)})
    tells = lambda t: t.rlike(f"(?<![a-z0-9])(?:{'|'.join(telling)})(?![a-z0-9])")
    lower, least_words, most_words = F.lower(text), F.lit(least + 1), F.lit(most + 1)

    def found(parts: Column) -> Column:
        """Best template of each part that has one; n distinct words give n - 1 distinct bigrams at least."""
        words = F.filter(F.transform(parts, _words), lambda w: (F.size(w) >= least_words) & (F.size(F.array_distinct(w)) <= most_words))
        grams = F.filter(F.transform(words, _bigrams), lambda b: (F.size(b) >= F.lit(least)) & (F.size(b) <= F.lit(most)))
        return F.filter(F.transform(grams, score), lambda s: s.isNotNull())

    def around(lines: Column) -> Column:
        """Runs of 2 to RUN lines that hold a line with a telling word, each once."""
        n = F.size(lines)
        told = F.filter(F.sequence(F.lit(1), n), lambda i: tells(F.get(lines, i - 1)))
        first = F.flatten(F.transform(told, lambda i: F.sequence(F.greatest(i - (RUN - 1), F.lit(1)), i)))
        spans = F.transform(F.array_distinct(first), lambda a: F.transform(F.sequence(F.lit(2), F.lit(RUN)), lambda k: F.when(a + k - 1 <= n, F.array_join(F.slice(lines, a, k), " "))))
        return F.filter(F.flatten(spans), lambda t: t.isNotNull() & tells(t))

    # parts are lambda variables, so that each is split once; the whole text counts beside its lines only if it has several
    cut = F.transform(F.array(lower), lambda t: F.split(t, "\n"))
    lines = F.flatten(F.transform(cut, lambda ls: found(F.filter(ls, tells))))
    runs = F.flatten(F.transform(cut, lambda ls: found(F.when(F.size(ls) > 1, around(ls)).otherwise(F.array().cast("array<string>")))))
    whole = found(F.filter(F.array(lower), lambda t: F.instr(t, "\n") > 0))
    out = docs.withColumn("_found", F.when(tells(lower), F.struct(lines.alias("lines"), runs.alias("runs"), whole.alias("whole"))))
    names = F.array(*map(F.lit, sets))
    out = out.withColumn("_best", F.array_max(F.concat("_found.lines", "_found.runs", "_found.whole")))
    return out.select(
        *docs.columns,
        F.when(F.col("_best").isNotNull(), F.element_at(names, 1 - F.col("_best.i"))).alias("_license"),
        F.coalesce(F.col("_best.s"), F.lit(0.0)).alias("_score"),
        F.when(F.col("_found").isNull(), 0).otherwise(F.size("_found.lines")).cast("long").alias("_n_matches"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The same result in SQL, without size bounds."""
    rows = ", ".join("({}, '{}', [{}])".format(i, k, ", ".join(f"'{b}'" for b in bigrams(v))) for i, (k, v) in enumerate(sorted(TEMPLATES.items())))
    return f"""
WITH t(i, name, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
ls AS (SELECT r, string_split(text, chr(10)) AS ls FROM d),
parts AS (
  SELECT r, true AS line, unnest(ls) AS part FROM ls
  UNION ALL SELECT r, false, array_to_string(ls[a:a + k - 1], ' ') FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS a FROM ls WHERE len(ls) > 1) x, (SELECT unnest(range(2, {RUN + 1})) AS k) y WHERE a + k - 1 <= len(ls)
  UNION ALL SELECT r, false, text FROM d WHERE contains(text, chr(10))),
w AS (SELECT r, line, list_filter(string_split_regex(lower(part), '{PARTS}'), lambda x: x <> '') AS w FROM parts),
g AS (SELECT r, line, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT r, line, i, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS s FROM g, t),
m AS (SELECT r, max(s) AS score, min_by(name, (-s, i)) AS license FROM s WHERE s >= {threshold} GROUP BY r),
c AS (SELECT r, count(*) AS n FROM (SELECT r, line FROM (SELECT r, line, g FROM g) q WHERE line AND EXISTS (SELECT 1 FROM t WHERE 2.0::DOUBLE * len(list_intersect(q.g, t.grams)) / (len(q.g) + len(t.grams)) >= {threshold})) z GROUP BY r)
SELECT d.doc_id, m.license, coalesce(m.score, 0.0)::DOUBLE AS score, coalesce(c.n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r)"""

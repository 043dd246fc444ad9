"""Licence scans: TF-IDF cosine of headers and licence files to templates, then the nearest ancestor directory's licence.

A text is a row of lower-cased words, whatever lines they stand in, so it makes no difference where a notice is wrapped or what
comment signs are around it. Templates are notices of one sentence as well as headers and whole licence texts. A template is
compared, as sparse TF-IDF vectors, with windows of as many words as it has. Document frequencies are counted over all texts.
Words that are in no template weigh as much as the rarest can, so a passage about something else stays far from all templates.

A window comes to the threshold only with some of a template's leading words: the words by falling weight, until what is left
weighs less than the threshold's share of the vector. Every occurrence of a leading word proposes the window in which it stands
where it first stands in the template, and all proposed windows are scored. Texts without any leading word have none.

A text has the licence of its best window. A file of its own kind (few words besides its licences' windows, or the name of a
licence file) speaks for its directory; a text without a licence takes that of the nearest directory above it that has one, found
by joining the paths of its directories. DataFrame operations only.

Nulls: a null text has no words; a null path has no directories and inherits nothing. Ties go to the licence that comes
first by name. Repeated rows are judged alike. Texts are read whole, however long. Empty tables give empty results. Extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, hint_if_small, let, materialize

#: Licences, and the notices, headers and texts by which they are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
)
THRESHOLD = 0.8
#: Fixed value: names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: A text with at most this many words besides its licences speaks for its directory too.
MOST_OTHER_WORDS = 40

#: White space and the punctuation around it. A run of punctuation is looked at from its start only, so long ones cost no more than others.
BETWEEN = r"(?:(?<![\p{P}\p{S}])[\p{P}\p{S}]++)?[\x20\x09-\x0D]+[\p{P}\p{S}]*+"


def _tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends."""
    return F.array_remove(F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BETWEEN, -1), "")


def plain_tokens(text: str) -> list[str]:
    cut = lambda w: w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")  # noqa: E731  templates are ASCII
    return [x for x in map(cut, text.lower().split()) if x]


def vectors(df: dict[str, int], n: int, templates=TEMPLATES) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The weight of each template word, and unit vectors of the templates."""
    idf = {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for _, t in templates for w in plain_tokens(t)}
    out = []
    for _, t in templates:
        words = plain_tokens(t)
        v = {w: words.count(w) * idf[w] for w in dict.fromkeys(words)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()})
    return idf, out


def leading(vector: dict[str, float], threshold: float) -> set[str]:
    """Words of which a window needs one to come to the threshold."""
    out, rest = set(), 1.0
    for w, x in sorted(vector.items(), key=lambda kv: (-round(kv[1], 9), kv[0])):
        if math.sqrt(max(rest, 0.0)) < threshold - 1e-6:
            break
        out.add(w)
        rest -= x * x
    return out


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def declared(files: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """``files`` with four columns, whose names are returned: licence, score, words (0 without any leading word), words in licences' windows."""
    names = fresh(files, "_licence", "_score", "_n_words", "_n_licence")
    (windows,) = fresh(files, "_windows")
    tokens = _tokens(F.col(text))
    known = F.array(*[F.lit(w) for w in sorted({w for _, t in templates for w in plain_tokens(t)})])
    count = files.select(F.explode(F.array_intersect(tokens, known)).alias("w")).groupBy("w").count()
    df, n = {r[0]: r[1] for r in count.collect()}, files.count()  # a row for each template word
    idf, units = vectors(df, n, templates)
    other = 1 + math.log(1 + n)
    weight = _literal_map(idf)
    sizes = F.array(*[F.lit(len(plain_tokens(t))) for _, t in templates])
    proposes: dict[str, list[tuple[int, int]]] = {}  # leading word: its templates, and where it first stands in each
    for i, (u, (_, t)) in enumerate(zip(units, templates)):
        for w in sorted(leading(u, threshold)):
            proposes.setdefault(w, []).append((i, plain_tokens(t).index(w)))
    starts = F.create_map(*[x for w, at in sorted(proposes.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(o).alias("o")) for i, o in at]))])
    rough = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(rf'\Q{w}\E' for w in sorted(proposes))})(?![\p{{L}}\p{{N}}])"
    unit = F.array(*[_literal_map(u) for u in units])

    def score(window: Column, template: Column) -> Column:
        def first(ordered: Column) -> Column:
            at = F.transform(ordered, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
            return F.filter(at, lambda x: (x["i"] == 0) | (x["w"] != F.get(ordered, x["i"] - 1)))

        def weighed(runs: Column) -> Column:
            return F.transform(runs, lambda x, k: F.struct(
                x["w"].alias("w"), ((F.coalesce(F.get(runs, k + 1)["i"], F.size(window)) - x["i"]).cast("double") * F.coalesce(F.element_at(weight, x["w"]), F.lit(other))).alias("x")))

        def cosine(counts: Column) -> Column:
            dot = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["x"] * F.coalesce(F.element_at(F.get(unit, template), c["w"]), F.lit(0.0)))
            return F.round(dot / F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["x"] * c["x"])), 9)

        return let(let(let(F.sort_array(window), first), weighed), cosine)

    def proposed(t: Column) -> Column:
        places = F.filter(F.transform(t, lambda w, i: F.struct(F.element_at(starts, w).alias("of"), i.alias("i"))), lambda x: x["of"].isNotNull())
        every = F.flatten(F.transform(places, lambda x: F.transform(x["of"], lambda y: F.struct(y["t"].alias("t"), F.greatest(x["i"] - y["o"], F.lit(0)).alias("s")))))
        return F.transform(F.array_distinct(every), lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), F.slice(t, c["s"] + 1, F.get(sizes, c["t"])).alias("w")))

    def scored(t: Column) -> Column:
        return F.transform(proposed(t), lambda c: F.struct(score(c["w"], c["t"]).alias("score"), F.get(F.array(*[F.lit(name) for name, _ in templates]), c["t"]).alias("licence"), c["s"].alias("s"), F.size(c["w"]).alias("n")))

    nothing = F.lit(None).cast("array<struct<score: double, licence: string, s: int, n: int>>")
    found = F.when(F.lower(F.col(text)).rlike(rough), let(tokens, lambda t: F.struct(F.size(t).alias("n"), F.filter(scored(t), lambda x: x["score"] >= threshold).alias("good"))))
    out = files.withColumn(windows, F.coalesce(found, F.struct(F.lit(0).alias("n"), F.coalesce(nothing, F.array()).alias("good"))))
    good = F.col(f"{windows}.good")
    best = F.reduce(good, F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("licence")), lambda a, b: F.when((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["licence"] < a["licence"])), F.struct(b["score"], b["licence"])).otherwise(a))
    covered = F.size(F.array_distinct(F.flatten(F.transform(good, lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    return out.select(*[F.col(f"`{c}`") for c in files.columns], best["licence"].alias(names[0]), F.when(F.size(good) > 0, best["score"]).alias(names[1]),
                      F.col(f"{windows}.n").cast("long").alias(names[2]), F.when(F.size(good) > 0, covered).otherwise(F.lit(0)).cast("long").alias(names[3])), names


def scan(files: DataFrame, key: str, path: str, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, path, licence, score, basis (own, inherited or none), from_dir (the directory inherited from, else null)."""
    narrow = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    found, (licence, score, n_words, n_licence) = declared(narrow, "text", templates, threshold)
    found = found.drop("text").withColumnsRenamed({licence: "own", score: "score", n_words: "n_words", n_licence: "n_licence"})
    name = F.element_at(F.split("path", "/"), -1)
    found = materialize(found.withColumn("speaks", F.col("own").isNotNull() & F.col("path").isNotNull() & (name.rlike(LICENCE_FILE) | (F.col("n_words") - F.col("n_licence") <= MOST_OTHER_WORDS))), "licences")
    # A directory's licence: that of its most licence files, then the first by name.
    votes = found.filter("speaks").select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "own").groupBy("dir", "own").count()
    dirs = materialize(votes.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("own"))).alias("x")).select("dir", F.col("x.own").alias("dir_licence")), "directories")
    # Each directory that has files looks up those above it once, however many files it has.
    parts = F.split(F.col("at"), "/")
    above = found.filter(F.col("own").isNull() & F.col("path").isNotNull()).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("at")).distinct()
    above = above.select("at", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("up")).distinct()
    nearest = above.join(hint_if_small(dirs, 200_000), F.col("up") == F.col("dir")).groupBy("at").agg(F.max(F.struct(F.length("up").alias("n"), F.col("up"), F.col("dir_licence"))).alias("x"))
    nearest = materialize(nearest.select("at", F.col("x.up").alias("from_dir"), F.col("x.dir_licence").alias("inherited")), "nearest")
    lacking = F.when(F.col("own").isNull(), F.regexp_replace("path", r"/?[^/]*$", ""))
    out = found.join(hint_if_small(nearest, 200_000), lacking == F.col("at"), "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("key", "path", F.coalesce("own", "inherited").alias("licence"), "score", basis.alias("basis"), "from_dir")

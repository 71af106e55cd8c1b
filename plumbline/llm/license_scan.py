"""Licence scans by a positional index of rare licence words, in DataFrame functions alone.

The index holds, for each licence template, the places of its rarest words;
rarity is a word's inverse document frequency over the templates.  All words
of the index are looked up in each file; each hit gives a template
and a relative position (place in the file less place in the template), and
hits that agree in both are words of one occurrence.  A template is reported
if half of its rare places or more agree on one position and all its mandatory
phrases stand in the file.  The score is the largest share of a template's
rare places that agree on one position, whether that is enough or not.
Everything is a projection of one scan: there is no shuffle, and the index is
a literal bounded by the templates.

Beside that, ``base`` phrases are found wherever their words are consecutive.

A word is a run of characters that are non-ASCII, digits or letters, with A-Z
made a-z.

Defined cases: a null text is the empty one (no words, no labels, score 0);
repeated rows are scanned one by one; equal scores need no order, since labels
are sorted; a table without rows gives none; only doc_id and the text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A notice, or a passage of a licence, as it stands in files, and phrases without which it isn't reported (words alone, small letters)."""

    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


# The public wording of licences and of the notices by which files refer to them.
TEMPLATES = (
    Template("mit-notice", "Released under the MIT License.", ("the mit license",)),
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.""", ("permission is hereby granted free of charge",)),
    Template("mit-text", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("the software is provided as is", "permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2 0",)),
    Template("apache-2.0", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly
perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""", ("each contributor hereby grants to you a perpetual worldwide", "prepare derivative works of")),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2.", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("gnu general public license", "version 3 of the license")),
    Template("lgpl", "Licensed under the GNU Lesser General Public License.", ("lesser general public license",)),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", ("lesser general public license",)),
    Template("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3.", ("affero general public license",)),
    Template("agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", ("affero general public license",)),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ("mozilla public license",)),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""", ("redistribution and use in source and binary forms",)),
    Template("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("redistribution and use in source and binary forms", "special exemplary or consequential damages")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ("permission to use copy modify and or distribute this software",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""", ("unencumbered software",)),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must
not be misrepresented; you must not claim that you wrote the original software.""", ("alter it and redistribute it freely",)),
    Template("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software.""", ("free of charge to any person or organization obtaining a copy",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("licensed", "cc by 4 0")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("licensed", "cc by sa 4 0")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("licensed", "cc by nc 4 0")),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international license",)),
    Template("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    Template("all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)
#: Rare words that the index holds of each template.
RARE_OF_TEMPLATE = 12
#: Share of a template's rare words that must agree on one position.
AGREE = 0.5


class Index:
    """Vocabulary by falling IDF, and each word's postings (template, place)."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE_OF_TEMPLATE):
        self.templates = templates
        cut = [t.words for t in templates]
        df: dict[str, int] = {}
        for words in cut:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: math.log((1 + len(cut)) / n) for w, n in df.items()}
        # of words that are as rare, the longer ones are rarer in files
        rank = lambda w: (-self.idf[w], -len(w), w)
        chosen = [sorted(set(words), key=rank)[:rare] for words in cut]
        #: Places of a template that the index holds, and how many of them must agree.
        self.most = [sum(w in c for w in words) for c, words in zip(chosen, cut, strict=True)]
        self.need = [max(1, math.ceil(AGREE * n)) for n in self.most]
        self.vocabulary = sorted({w for c in chosen for w in c}, key=rank)
        self.postings = [[(t, p) for t, (c, words) in enumerate(zip(chosen, cut, strict=True)) if v in c for p, w in enumerate(words) if w == v] for v in self.vocabulary]


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, index: Index | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``, one row for each row of ``docs``.

    ``places``: struct (label, at) of each base place, ``at`` the word from 0.
    """
    index = index or Index()
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    first = docs.select("doc_id", words.alias("words"))

    def places(phrase: str, label: str) -> Column:
        own = phrase.split()

        def at(w: Column, i: Column) -> Column:
            ok = w == own[-1]
            for k, x in enumerate(reversed(own[:-1]), 1):
                ok = ok & (F.get(F.col("words"), i - k) == x)
            return F.when(ok, F.struct(F.lit(label).alias("label"), (i - (len(own) - 1)).cast("long").alias("at")))

        return F.filter(F.transform("words", at), lambda x: x.isNotNull())

    vocabulary = _literals(index.vocabulary, "string")
    postings = F.array(*[F.array(*[F.lit(t * 2**32 - p) for t, p in posts]).cast("array<bigint>") for posts in index.postings])
    # a set of literals is asked by hash, so that the list is searched for the words of the index alone
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(index.vocabulary), i)), lambda i: i.isNotNull())
    # template * 2**32 + relative position
    codes = F.array_sort(F.flatten(F.transform("hits", lambda i: F.transform(F.element_at(postings, F.array_position(vocabulary, F.get("words", i)).cast("int")), lambda c: c + i))))
    starts = F.filter(F.transform("codes", lambda c, i: F.when((i == 0) | (c != F.get("codes", i - 1)), i)), lambda i: i.isNotNull())
    need, most, names = _literals(index.need, "int"), _literals(index.most, "int"), _literals([t.label for t in index.templates], "string")

    def run(start: Column, k: Column) -> Column:
        """How many rare words of which template agree from a place of the sorted codes on."""
        # the relative position may be negative, by less than any template is long
        template = F.floor((F.get("codes", start) + 2**20) / 2**32).cast("int")
        n = F.coalesce(F.get("starts", k + 1), F.size("codes")) - start
        return F.struct(template.alias("k"), (n / F.get(most, template)).alias("share"), (n >= F.get(need, template)).alias("enough"))

    mandatory = F.array(*[F.array(*[F.lit(f" {p} ") for p in t.mandatory]) for t in index.templates])
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    enough = F.array_distinct(F.transform(F.filter("runs", lambda r: r["enough"]), lambda r: r["k"]))
    # as a lambda's variable the joined words are made once, and only where something agrees
    found = F.flatten(F.transform(F.array(joined), lambda whole: F.filter("enough", lambda k: F.forall(F.get(mandatory, k), lambda p: F.contains(whole, p)))))
    staged = (
        first.withColumns({"places": F.concat(*[places(p, label) for p, label in base]), "hits": hits})
        .withColumn("codes", F.when(F.size("hits") > 0, codes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("starts", starts).withColumn("runs", F.transform("starts", run)).withColumn("enough", enough)
        .withColumn("found", F.when(F.size("enough") > 0, F.transform(found, lambda k: F.get(names, k))).otherwise(none))
    )
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    spots = F.transform("places", lambda p: p["at"])
    return staged.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(spots).alias("first_word"), F.array_max(spots).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, "found"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["share"])), F.lit(0.0)).alias("score"),
        "places",
    )

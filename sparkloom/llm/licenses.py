"""License scan by a positional rare-token index, native columns only.

A template is the wording of a licence or of a notice with key phrases, all of which a copy must have at their places.
The index holds, of each template, the RARE words of one key phrase that are rarest over all documents (highest IDF), each with its place in the
template; the phrase is the one with the rarest word of all.  As every copy has those words, looking up a file's indexed words finds all
of them, whatever else the file holds.  A word at place p that the template has at place r votes for the start p - r; the votes
of a template's words are intersected, which leaves the starts where all of them stand at their relative places.  There the whole key
phrase must stand exactly, and every other one within a tolerance that grows with its distance (SLACK words and a word in DRIFT).  Votes are
numbers that are intersected by hashing, so the work grows with the text and not with its square.  The score is the idf-weighted share of the
template's words found in place.

Base phrases are found the same way (an anchor word, then the words around it compared) and always label.

Defined cases: a null or empty text has no words, no labels and score 0; a very long text is scanned whole; of words that are
equally rare the first in the alphabet, then in place, is indexed; repeated rows give a row each; an empty table gives no
rows; extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: label, phrase, place of the anchor word in it
BASE = [("mit", "under the mit license", 2), ("apache-2", "apache license version 2", 0), ("cc-by-nc", "cc by nc", 2)]

#: Label, wording of the notice or licence, key phrases that a copy must have.
TEMPLATES = [
    ("mit", "released under the MIT license", ["mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["hereby granted free of charge", "associated documentation files"],
    ),
    ("apache-2", "licensed under the Apache License Version 2.0", ["apache license", "version 2"]),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["except in compliance with the license", "without warranties or conditions of any kind"],
    ),
    ("gpl-3", "licensed under the GNU General Public License version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "free software foundation", "version 3"]),
    ("gpl-2", "licensed under the GNU General Public License version 2", ["gnu general public license", "version 2"]),
    ("gpl-2", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "free software foundation", "version 2"]),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3", ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License version 2.1", ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-2.1", "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["gnu lesser general public license", "free software foundation", "version 2 1"]),
    ("agpl-3", "licensed under the GNU Affero General Public License version 3", ["gnu affero general public license", "version 3"]),
    ("agpl-3", "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license", "free software foundation", "version 3"]),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["neither the name of", "endorse or promote products derived from this software"],
    ),
    (
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["source and binary forms with or without modification", "redistributions in binary form must reproduce"],
    ),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["source and binary forms", "with or without modification are permitted"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license", "2 0"]),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license", "2 0"]),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
        ["for any purpose with or without fee is hereby granted", "appear in all copies"],
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ["in no event will the authors be held liable", "alter it and redistribute it freely"],
    ),
    ("bsl-1", "distributed under the Boost Software License, Version 1.0", ["boost software license", "version 1"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered software", "public domain"]),
    ("cc0-1", "the author has waived all copyright and related rights under CC0 1.0", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under CC BY NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under CC BY SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "licensed under CC BY ND 4.0", ["cc by nd"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4 0"]),
]
#: Label and identifier of the short form "SPDX-License-Identifier: ...".
IDENTIFIERS = {
    "mit": "MIT", "apache-2": "Apache-2.0", "gpl-3": "GPL-3.0", "gpl-2": "GPL-2.0", "lgpl-3": "LGPL-3.0", "lgpl-2.1": "LGPL-2.1", "agpl-3": "AGPL-3.0", "bsd-3": "BSD-3-Clause", "bsd-2": "BSD-2-Clause",
    "mpl-2": "MPL-2.0", "epl-2": "EPL-2.0", "isc": "ISC", "zlib": "Zlib", "bsl-1": "BSL-1.0", "unlicense": "Unlicense", "cc0-1": "CC0-1.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by": "CC-BY-4.0",
}
TEMPLATES += [(label, f"SPDX License Identifier {i}", [f"spdx license identifier {i}"]) for label, i in IDENTIFIERS.items()]
#: How far key phrases may stand from their places: SLACK words, and one more for each DRIFT words from the indexed phrase.
SLACK, DRIFT = 2, 8
#: Words of a template that are looked up, of those that its key phrase has.
RARE = 3


def plain(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents that hold each word of a fixed small vocabulary."""
    known = F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    found = {r["word"]: r["df"] for r in counts.collect()}  # at most one row per vocabulary word
    return found.get("", 0), found


def place_of(phrase: list[str], text: list[str]) -> int:
    """Where a key phrase stands in its template."""
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


def indexed(templates: list, idf: dict[str, float]) -> list[tuple]:
    """Per template: label, words, indexed words with their places, its key phrases as (words, place from the start, tolerance)."""
    out = []
    for label, text, keys in templates:
        ws, phrases = plain(text), [plain(k) for k in keys]
        at = [place_of(k, ws) for k in phrases]
        *_, own = min((-idf[w], w, a + j, k) for k, (a, ph) in enumerate(zip(at, phrases, strict=True)) for j, w in enumerate(ph))
        places: dict[str, int] = {}
        for j, w in enumerate(phrases[own]):
            places.setdefault(w, at[own] + j)
        rare = sorted(places.items(), key=lambda p: (-idf[p[0]], p))[:RARE]
        out.append((label, ws, rare, [(ph, a, 0 if k == own else SLACK + abs(a - at[own]) // DRIFT) for k, (a, ph) in enumerate(zip(at, phrases, strict=True))]))
    return out


def _strings(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def scan(docs: DataFrame, templates: list | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (template label, start, score)."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, text, _ in templates for w in plain(text)})
    n, df = document_frequency(docs, vocabulary)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    lists = indexed(templates, idf)
    # of each rank of rarity the words that are looked up, with (template, place); a template with fewer words has its last one in the other ranks too
    ranks: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(RARE)]
    for t, (_, _, rare, _) in enumerate(lists):
        for k, index in enumerate(ranks):
            w, place = rare[min(k, len(rare) - 1)]
            index.setdefault(w, []).append((t, place))
    marked = sorted({plain(p)[a] for _, p, a in BASE}.union(*ranks))

    book = F.array(*[
        F.struct(
            F.lit(label).alias("label"), _strings(ws).alias("ws"), F.array(*[F.lit(idf[w]) for w in ws]).alias("idf"), F.lit(sum(idf[w] for w in ws)).alias("all"),
            F.array(*[F.struct(_strings(ph).alias("ws"), F.array(*[F.lit(a + o) for o in sorted(range(-off, off + 1), key=abs)]).alias("places")) for ph, a, off in keys]).alias("keys"),
        )
        for label, ws, _, keys in lists
    ])

    def votes(index: dict[str, list[tuple[int, int]]]) -> Column:
        """Template and start, as one number, that the places of words vote for; a text may begin within a template."""
        postings = F.create_map(*[x for w, ps in sorted(index.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(i).alias("i")) for t, i in ps]))])
        start = lambda m, p: p["t"] * (1 << 33) + (m["i"] - p["i"]) + (1 << 32)
        return F.flatten(F.transform(F.filter("m", lambda m: m["x"].isin(sorted(index))), lambda m: F.transform(F.element_at(postings, m["x"]), lambda p: start(m, p))))

    w = F.col("w")
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    mark = F.filter(F.transform(w, lambda x, i: F.when(x.isin(marked), F.struct(x.alias("x"), i.alias("i")))), lambda m: m.isNotNull())
    rows = rows.select("doc_id", "w", F.when(F.exists(w, lambda x: x.isin(marked)), mark).otherwise(F.array().cast("array<struct<x:string,i:int>>")).alias("m"))

    def stands(at: Column, phrase: Column | list[str], n: Column | int) -> Column:
        """Whether a phrase stands at a place."""
        return (at >= 0) & (F.slice(w, F.greatest(at, F.lit(0)) + 1, n) == (_strings(phrase) if isinstance(phrase, list) else phrase))

    def base(label: str, phrase: str, a: int) -> Column:
        ws = plain(phrase)
        hit = F.filter("m", lambda m: (m["x"] == ws[a]) & stands(m["i"] - a, ws, len(ws)))
        return F.transform(hit, lambda m: F.struct(F.lit(label).alias("label"), (m["i"] - a).alias("at")))

    def verify(v: Column) -> Column:
        def judged(t: Column) -> Column:
            share = F.aggregate(F.zip_with(F.transform(t["ws"], lambda x, i: F.when(v["at"] + i >= 0, F.get(w, v["at"] + i)).eqNullSafe(x)), t["idf"], lambda same, x: F.when(same, x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) / t["all"]
            here = F.forall(t["keys"], lambda k: F.exists(k["places"], lambda o: stands(v["at"] + o, k["ws"], F.size(k["ws"]))))
            return F.when(here, F.struct(t["label"].alias("label"), v["at"].alias("at"), F.round(share, 6).alias("score")))

        return let(F.get(book, v["t"]), judged)

    agreed = votes(ranks[0])
    for index in ranks[1:]:
        agreed = F.array_intersect(agreed, votes(index))
    starts = F.transform(agreed, lambda v: F.struct(F.shiftright(v, 33).cast("int").alias("t"), (v.bitwiseAND((1 << 33) - 1) - (1 << 32)).cast("int").alias("at")))
    found = F.filter(F.transform(starts, verify), lambda m: m.isNotNull())
    found = F.when(F.size("m") > 0, found).otherwise(F.array().cast("array<struct<label:string,at:int,score:double>>"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*[base(*b) for b in BASE]).alias("base"), found.alias("matches"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "matches.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.score"), F.lit(0.0))).alias("score"), "matches",
    )

"""Licence scans by a positional index of rare words.

The templates' words form an index: word, template, position. A word's weight is its inverse document frequency in
the corpus. Of every template two groups of its rarest words are looked up (anchors): an anchor found at word p of a
file, standing at position q of a template, proposes the template at p - q. The places that both groups propose are
intersected. There the other words of the template are compared by their relative positions, and the template's
mandatory phrases have to stand word for word.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import lower_ascii

# Fixed values. Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Fixed values. Notices of licences: label, text, phrases that must stand in it word for word.
TEMPLATES = [
    ("agpl", "gnu affero general public license", ["affero general public"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ["apache license", "2 0"],
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["except in compliance with the license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ["source and binary forms"],
    ),
    ("bsl", "boost software license version 1 0", ["boost software license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ["hereby granted free of charge"],
    ),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    (
        "gpl-2.0",
        "gnu general public license as published by the free software foundation either version 2 of the license",
        ["gnu general public license", "version 2 of the license"],
    ),
    (
        "gpl-3.0",
        "gnu general public license as published by the free software foundation either version 3 of the license",
        ["gnu general public license", "version 3 of the license"],
    ),
    (
        "lgpl",
        "gnu lesser general public license as published by the free software foundation",
        ["lesser general public license"],
    ),
    (
        "agpl",
        "gnu affero general public license as published by the free software foundation",
        ["affero general public license"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    (
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        ["eclipse public license"],
    ),
    ("wtfpl", "do what the fuck you want to public license", ["you want to public license"]),
]
# Fixed values. Paragraphs of licences that no other of these licences has, whole, and phrases of theirs; paragraphs are cut
# into passages, and the phrases within a passage must stand in it word for word.
PARAGRAPHS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        ["hereby granted free of charge", "deal in the software without restriction", "sublicense and or sell copies", "to whom the software is furnished"],
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        ["shall be included in all copies"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["permission to use copy modify", "permission notice appear in all copies"],
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["retain the above copyright notice", "reproduce the above copyright notice", "materials provided with the distribution"],
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        ["neither the name", "endorse or promote products"],
    ),
    (
        "zlib",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required.",
        ["must not be misrepresented", "acknowledgment in the product documentation"],
    ),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["anyone is free to copy", "commercial or non commercial"],
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software",
        ["any person or organization", "display distribute execute", "prepare derivative works"],
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
        ["unless required by applicable law", "without warranties or conditions", "specific language governing permissions"],
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["distributed in the hope that it will be useful", "without even the implied warranty"],
    ),
]
# Fixed values. Words of identifiers that stand behind SPDX-License-Identifier, by label.
IDENTIFIERS = {
    "agpl": ["agpl 3 0"],
    "apache-2.0": ["apache 2 0"],
    "bsd": ["bsd 2 clause", "bsd 3 clause", "0bsd"],
    "bsd-3-clause": ["bsd 3 clause"],
    "bsl": ["bsl 1 0"],
    "cc-by": ["cc by 4 0"],
    "cc-by-nc": ["cc by nc 4 0"],
    "cc-by-sa": ["cc by sa 4 0"],
    "cc0": ["cc0 1 0"],
    "epl-2.0": ["epl 2 0"],
    "gpl-2.0": ["gpl 2 0"],
    "gpl-3.0": ["gpl 3 0"],
    "isc": ["isc"],
    "lgpl": ["lgpl 2 1", "lgpl 3 0"],
    "mit": ["mit"],
    "mpl-2.0": ["mpl 2 0"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl"],
    "zlib": ["zlib"],
}
# Passages of paragraphs have this many words at least, so that a word put in breaks one passage only.
PASSAGE = 16

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased: digits, a-z and all characters beyond ASCII."""
    pieces = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(pieces, lambda w: w != "")


def _passages(paragraph: str) -> list[list[str]]:
    """Words of a paragraph in passages of even length."""
    words = [w for w in re.split(SEPARATORS, paragraph.lower()) if w]
    n = max(1, len(words) // PASSAGE)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def _templates():
    """Every template as (number, label, words, mandatory phrases, base): base phrases first.

    An identifier has to stand whole.
    """
    base = [(label, phrase.split(), [], True) for phrase, label in PHRASES.items()]
    own = [(label, text.split(), [p.split() for p in phrases], False) for label, text, phrases in TEMPLATES]
    for label, paragraph, phrases in PARAGRAPHS:
        for words in _passages(paragraph):
            inside = [p.split() for p in phrases if f" {p} " in f" {' '.join(words)} "]
            own.append((label, words, inside, False))
    marked = [(label, f"spdx license identifier {name}".split()) for label, names in IDENTIFIERS.items() for name in names]
    own += [(label, words, [words], False) for label, words in marked]
    return [(n, *t) for n, t in enumerate(base + own)]


def _anchors(words: list[str], weight, least: float, base: bool) -> tuple[list[int], list[int]]:
    """Positions of two groups of a template's rarest words.

    Each holds more than 1 - ``least`` of its weight, so that a place without any word of a group cannot be accepted;
    of a base phrase, which needs all words, each is one word. If a short template has no second group it is the first.
    """
    # Rarest first; of equal weights the earlier position.
    rarest = sorted(range(len(words)), key=lambda i: (-weight(words[i]), i))
    total = sum(map(weight, words))
    groups: list[list[int]] = [[]]
    for i in rarest:
        if groups[-1] and (base or sum(weight(words[k]) for k in groups[-1]) / total > 1 - least + 1e-9):
            groups.append([])
        groups[-1].append(i)
    whole = [g for g in groups if base or sum(weight(words[k]) for k in g) / total > 1 - least + 1e-9]
    return whole[0], whole[min(1, len(whole) - 1)]


def word_weights(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows that hold each word of the templates.

    Tasks send at most one partial count for each word of the templates, of which there are a few hundred.
    """
    vocabulary = sorted({w for _, _, words, _, _ in _templates() for w in words})
    # A word of a text is one of the templates' if it stands between separators; one expression finds all of them.
    held = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return found.pop("", 0), found


def scan(
    docs: DataFrame, weights: tuple[int, dict[str, int]] | None = None, id_col="doc_id", text_col="text", least=0.8
) -> DataFrame:
    """Words, places of base phrases, and licence labels of every row.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest word at which
    one starts (null without any). A template gives its label where it stands with at least ``least`` of its weight
    and with all mandatory phrases; ``score`` is the largest share of weight among the accepted places (1.0 for a
    base phrase, 0.0 without any). No place that would be accepted is missed: both groups of anchors propose it (see
    ``_anchors``). A template may begin before the text does, whose first words are then missing.

    Null counts as empty: no words, no labels, score 0. Every row is scanned on its own, rows that repeat give rows
    that repeat, an empty table gives no rows, and further columns are not carried along. No text is shuffled.
    """
    rows, found = word_weights(docs, text_col) if weights is None else weights
    weight = lambda w: _idf(rows, found.get(w, 0))
    every = _templates()

    indexes: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for n, _, words, _, base in every:
        for index, group in zip(indexes, _anchors(words, weight, least, base), strict=True):
            for position in group:
                index.setdefault(words[position], []).append((n, position))

    # A place in one number, so that sets of places are hashed: the template's number, and above it the start.
    places = len(every)
    postings = [
        F.create_map(*[x for word, at in index.items() for x in (F.lit(word), F.array(*[F.lit(n - q * places).cast("bigint") for n, q in at]))])
        for index in indexes
    ]
    shares = [[weight(w) / sum(map(weight, words)) for w in words] for _, _, words, _, _ in every]
    about = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.array(*map(F.lit, words)).alias("words"),
                F.array(*map(F.lit, share)).alias("shares"),
                F.array(*[F.lit(f" {' '.join(p)} ") for p in phrases]).cast("array<string>").alias("phrases"),
                F.lit(base).alias("base"),
            )
            for (_, label, words, phrases, base), share in zip(every, shares, strict=True)
        ]
    )

    def proposed(words: Column, number: int) -> Column:
        """Places that the anchors of a group propose."""
        known = F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("bigint").alias("i"))), lambda x: x["w"].isin(list(indexes[number]))
        )
        return F.flatten(F.transform(known, lambda x: F.transform(postings[number][x["w"]], lambda p: x["i"] * places + p)))

    def opened(place: Column) -> Column:
        n = F.pmod(place, F.lit(places))
        return F.struct(n.cast("int").alias("n"), F.floor((place - n) / places).cast("int").alias("start"))

    def compared(words: Column, place: Column) -> Column:
        """Share of weight of the words that stand where the template has them, 0 without the mandatory phrases."""
        template = F.get(about, place["n"])
        before = F.greatest(-place["start"], F.lit(0))
        there = F.slice(words, F.greatest(place["start"], F.lit(0)) + 1, F.size(template["words"]) - before)
        here = F.concat(F.array_repeat(F.lit(None).cast("string"), before), there)
        same = F.zip_with(here, template["words"], lambda a, b: a.eqNullSafe(b))
        share = F.aggregate(F.zip_with(same, template["shares"], lambda s, w: F.when(s, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        text = F.concat(F.lit(" "), F.array_join(here, " "), F.lit(" "))
        whole = F.forall(template["phrases"], lambda p: F.contains(text, p)) & (~template["base"] | F.forall(same, lambda s: s))
        return F.struct(
            place["start"].cast("bigint").alias("start"),
            template["base"].alias("base"),
            template["label"].alias("label"),
            F.when(whole, F.least(share, F.lit(1.0))).otherwise(0.0).alias("score"),
        )

    text = F.col(text_col)
    words = F.col("words")
    held = lambda index: F.arrays_overlap(words, F.array(*map(F.lit, sorted(index))))
    read = docs.select(F.col(id_col).alias("doc_id"), words_of(text).alias("words")).select(
        "*", (held(indexes[0]) & held(indexes[1])).alias("candidate")
    )
    agreed = F.transform(F.array_intersect(proposed(words, 0), proposed(words, 1)), opened)
    none = F.array().cast("array<struct<start:bigint,base:boolean,label:string,score:double>>")
    hits = read.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.when(
            F.col("candidate"),
            F.filter(F.transform(agreed, lambda p: compared(words, p)), lambda h: h["score"] >= least),
        )
        .otherwise(none)
        .alias("hits"),
    )
    base = F.filter("hits", lambda h: h["base"])
    label = lambda hs: F.array_join(F.array_sort(F.array_distinct(hs["label"])), ",")
    return hits.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.col("hits")["score"]), F.lit(0.0)).alias("score"),
    )


def _idf(rows: int, holding: int) -> float:
    """Inverse document frequency, smoothed so that every word has some weight."""
    return math.log((rows + 1) / (holding + 1)) + 1

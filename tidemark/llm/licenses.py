"""Licence recognition: known sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-share": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "Licensed under CC0 1.0.",
}

# Licence rules, each an ordered list of sentences; earlier rules are more specific.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-or-later", ("gpl-share", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-share",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
)

# Further sentences and rules. The SQL of the query knows those above only.
MORE_SENTENCES = {
    "gpl2-share": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-share": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-share": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-share": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
MORE_RULES = (
    ("GPL-2.0-or-later", ("gpl2-share",)),
    ("LGPL-2.1-or-later", ("lgpl21-share",)),
    ("LGPL-3.0-or-later", ("lgpl3-share",)),
    ("AGPL-3.0-or-later", ("agpl3-share",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
)
# Identifiers taken from SPDX lines besides those of the rules.
SPDX = ("0BSD", "BSL-1.0", "CC-BY-ND-4.0", "EPL-2.0", "GPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only")

#: A sentence ends at a line's end, or after ``.``, ``!``, ``?``, ``:`` or ``;`` and white space.
BREAK = r"\n+|(?<=[.!?:;])[ \t]+"
_NOISE = r"[^a-z0-9]+"


def normal_text(sentence: str) -> str:
    return re.sub(_NOISE, " ", sentence.lower()).strip()


def _parts(sentence: str) -> list[str]:
    return [x for x in (normal_text(p) for p in re.split(BREAK, sentence)) if x]


def known_sentences(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """Normalised sentences with their numbers, and rules over these numbers.

    A listed sentence that the text rule cuts in several counts as these in their order.
    """
    numbers: dict[str, int] = {}
    ids = {key: [numbers.setdefault(p, len(numbers)) for p in _parts(s)] for key, s in sentences.items()}
    return numbers, [(name, [n for key in keys for n in ids[key]]) for name, keys in rules]


def _marked(text: Column) -> Column:
    """Normalised text where ``B`` is the end of a sentence or a blank line, and ``L`` another line feed.

    Comment marks are no letters and vanish; a line of them alone is blank.
    """
    text = F.lower(text)
    for pattern, mark in (
        (r"(?:^|\n)[ \t]*[.!?:;]+", "\n"),
        (r"(?<=[.!?:;])(?:[ \t\r]*\n|[ \t]+)", "B"),
        (r"\n[^a-z0-9B\n]*(?=\n)", "B"),
        (r"\n", "L"),
        (r"[^a-z0-9BL]+", " "),
        (r"[ L]*B[BL ]*", "B"),
        (r" *L[L ]*", "L"),
    ):
        text = F.regexp_replace(text, pattern, mark)
    return F.concat(F.lit("B"), F.trim(text), F.lit("B"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, n_known, licenses, sequence)`` of each row, without a shuffle.

    Sentences are normalised to a-z, 0-9 and single spaces and looked up in the known ones. A known
    sentence is found on a line of its own, and also where it is wrapped over lines, with or without
    comment marks. ``n_sentences`` counts pieces that end at sentence ends and at all line feeds.
    Identifiers on ``SPDX-License-Identifier:`` lines are found too. ``sequence`` is what was found, in order. A rule matches where its numbers follow each other in
    that sequence, so sentences that are not known may lie between. A rule within a longer matching
    rule is that one's part and not reported again. ``licenses`` is sorted, without repeats.

    Null and empty texts have no sentence. Null ids and repeated rows are scanned row by row, texts
    of any length whole. An empty table gives no rows. Further columns are ignored.
    """
    numbers, rules = known_sentences(SENTENCES | MORE_SENTENCES, RULES + MORE_RULES)
    table = F.create_map(*(x for key, n in numbers.items() for x in (F.lit(key), F.lit(str(n)))))

    def normal(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), _NOISE, " "))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.filter(F.transform(F.split(text, BREAK), normal), lambda x: x != "")
    # longer sentences first: one may begin like another
    ways = "|".join(k.replace(" ", "[ L]") for k in sorted(numbers, key=len, reverse=True))
    hits = F.regexp_extract_all(_marked(text), F.lit(f"(?<=[BL])(?:{ways})(?=[BL])"), F.lit(0))
    named = F.regexp_extract_all(text, F.lit(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"), F.lit(1))
    ids = F.split(F.array_join(named, " "), r"[() \t]+")
    listed = F.array(*(F.lit(x) for x in sorted({*SPDX, *(name for name, _ in rules)})))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), parts.alias("parts"), hits.alias("hits"), F.array_intersect(ids, listed).alias("ids")
    )
    known = F.transform("hits", lambda x: F.try_element_at(table, F.translate(x, "L", " ")))
    rows = rows.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), known.alias("known"), "ids")
    joined = F.concat(F.lit("|"), F.array_join("known", "|"), F.lit("|"))
    rows = rows.select("doc_id", "n_sentences", F.size("known").cast("long").alias("n_known"), joined.alias("sequence"), "ids")
    text = {i: "|" + "|".join(map(str, r)) + "|" for i, (_, r) in enumerate(rules)}
    found = []
    for i, (name, _) in enumerate(rules):
        rest = F.col("sequence")
        for j in text:  # what longer rules cover is taken out first
            if j != i and text[i] in text[j] and len(text[j]) > len(text[i]):
                rest = F.replace(rest, F.lit(text[j]), F.lit("|"))
        found.append(F.when(F.contains(rest, F.lit(text[i])), F.lit(name)))
    every = F.concat(F.array_compact(F.array(*found)), F.col("ids"))
    return rows.select("doc_id", "n_sentences", "n_known", F.array_sort(F.array_distinct(every)).alias("licenses"), "sequence")

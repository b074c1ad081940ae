"""Licence scans by sentence rules.

A text is cut into pieces at line feeds and sentence ends, and each is normalised (case,
punctuation, quotes, comment marks and runs of spaces go). Successive pieces of a paragraph,
as many as fit, are looked up among known licence sentences, which gives an identifier: so a
sentence is found on one line as well as wrapped over several. Blank lines, also those with a
comment mark only, end a paragraph. The
identifiers of a document, in order, are then matched against an ordered list of rules, each a
sequence of identifiers that stands for a licence; matched sentences are used up. Known
sentences that no rule takes are reported as they are.

Sentences and rules are tables with a few dozen rows that come with the operator or from the
caller. Everything happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

BREAK = r"\r\n|\n|\r|(?<=[.!?;:])[ \t\x0B\f]++(?![\r\n])"
NOISE = r"[^\p{L}\p{N}.+]+"
STOP = r"\.(?= |$)"

# fixed values: public licence sentences, and the identifier of each
SENTENCES = {
    "Licensed under the Apache License, Version 2.0": "Apache-2",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache-2",
    "you may not use this file except in compliance with the License": "ApacheUse",
    "You may obtain a copy of the License at": "ApacheCopy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "ApacheAsIs",
    "See the License for the specific language governing permissions and limitations under the License": "ApacheSee",
    "Released under the MIT License": "MITName",
    "Licensed under the MIT License": "MITName",
    "The MIT License (MIT)": "MITName",
    "MIT License": "MITName",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MITGrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MITNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "MITAsIs",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDPre",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "BSDAsIs",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file": "BSDSee",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "GPL-2+",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPL-3+Tail",
    "This program is free software": "GNUFree",
    "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3",
    "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "MPL-2",
    "Licensed under CC BY 4.0": "CC-BY-4",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4",
    "Licensed under CC BY-ND 4.0": "CC-BY-ND-4",
    "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4",
    "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4",
    "This work is dedicated to the public domain under CC0 1.0": "CC0-1",
    "This is free and unencumbered software released into the public domain": "Unlicense",
    "All rights reserved": "AllRights",
}

# fixed values: rules in the order in which they are tried
RULES = [
    (("Apache-2", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("Apache-2",), "Apache-2.0"),
    (("MITName", "MITGrant", "MITNotice", "MITAsIs"), "MIT"),
    (("MITGrant", "MITNotice", "MITAsIs"), "MIT"),
    (("MITGrant", "MITNotice"), "MIT"),
    (("MITName",), "MIT"),
    (("AllRights", "BSDPre", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("AllRights", "BSDPre", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDPre", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("AllRights", "BSDSee"), "BSD-3-Clause"),
    (("BSDSee",), "BSD-3-Clause"),
    (("GNUFree", "GPL-3+Tail"), "GPL-3.0-or-later"),
    (("GPL-2+",), "GPL-2.0-or-later"),
    (("GPL-3",), "GPL-3.0-only"),
    (("GPL-2",), "GPL-2.0-only"),
    (("AGPL-3",), "AGPL-3.0-only"),
    (("LGPL-2.1",), "LGPL-2.1-only"),
    (("LGPL-3",), "LGPL-3.0-only"),
    (("MPL-2",), "MPL-2.0"),
    (("CC-BY-NC-ND-4",), "CC-BY-NC-ND-4.0"),
    (("CC-BY-NC-SA-4",), "CC-BY-NC-SA-4.0"),
    (("CC-BY-NC-4",), "CC-BY-NC-4.0"),
    (("CC-BY-ND-4",), "CC-BY-ND-4.0"),
    (("CC-BY-SA-4",), "CC-BY-SA-4.0"),
    (("CC-BY-4",), "CC-BY-4.0"),
    (("CC0-1",), "CC0-1.0"),
    (("Unlicense",), "Unlicense"),
    (("AllRights",), "LicenseRef-all-rights-reserved"),
]


def normal(sentence: Column) -> Column:
    """Lower case, no punctuation but stops inside numbers, single spaces."""
    spaced = F.trim(F.regexp_replace(F.lower(sentence), NOISE, " "))
    return F.trim(F.regexp_replace(spaced, STOP, ""))


def normal_text(sentence: str) -> str:
    """The same for one sentence, with which the table of known ones is made."""
    spaced = re.sub(r"[^\w.+]+|_+", " ", sentence.lower()).strip()
    return re.sub(r"\.(?= |$)", "", spaced).strip()


def parts_of(sentence: str) -> list[str]:
    """A known sentence may itself hold marks that end one."""
    return [p for p in (normal_text(p) for p in re.split(r"(?<=[.!?;:])\s+|[\r\n]+", sentence)) if p]


def beginnings(known: dict[str, str]) -> set[str]:
    """All known sentences cut off behind any of their words."""
    return {" ".join(words[:n]) for words in map(str.split, known) for n in range(1, len(words) + 1)}


def named(pieces: list[str], known: dict[str, str], begun: set[str]) -> list[str]:
    """Identifiers of the known sentences that successive pieces make up; of two that start at
    the same piece the longer one. An empty piece is a blank line, which no sentence crosses."""
    out, at = [], 0
    while at < len(pieces):
        text, stop, name, after = pieces[at], at + 1, None, at + 1
        while text in begun:
            if text in known:
                name, after = known[text], stop
            if stop == len(pieces) or not pieces[stop]:
                break
            text += " " + pieces[stop]
            stop += 1
        if name is not None:
            out.append(name)
        at = after
    return out


def apply_rules(ids: list[str], rules: list[tuple[tuple[str, ...], str]]) -> tuple[list[str], list[str]]:
    """Licences of an identifier sequence, by place, and the identifiers left over."""
    found, used = [], [False] * len(ids)
    for sequence, licence in rules:
        n, at = len(sequence), 0
        while at + n <= len(ids):
            if tuple(ids[at : at + n]) == sequence and not any(used[at : at + n]):
                used[at : at + n] = [True] * n
                found.append((at, licence))
                at += n
            else:
                at += 1
    return [licence for _, licence in sorted(found)], [i for i, u in zip(ids, used) if not u]


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``sentence_ids``, ``licenses`` and ``left_over`` (arrays of strings).

    Null and empty texts have none, a licence that is stated twice is listed twice, in the
    order of the text; equal texts give equal results; columns named like the new ones are
    replaced.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    known = {" ".join(parts_of(sentence)): name for sentence, name in sentences.items()}
    begun = beginnings(known)
    kept = docs.drop("sentence_ids", "licenses", "left_over")
    name = fresh(kept)
    pieces = F.transform(F.split(F.col("text"), BREAK), normal)

    @F.pandas_udf("sentence_ids array<string>, licenses array<string>, left_over array<string>")
    def ruled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [[] if x is None else named(list(x), known, begun) for x in batch]
            yield pd.DataFrame([(x, *apply_rules(x, rules)) for x in ids], columns=["sentence_ids", "licenses", "left_over"])

    some_word = F.col("text").rlike("(?i)licen[cs]|rights|permi|redistrib|warrant|copyright|domain|software|names? of|use of") if sentences is SENTENCES else F.lit(True)
    return (
        kept.withColumn(name, ruled(F.when(some_word, pieces)))
        .select(*kept.columns, f"{name}.*")
    )

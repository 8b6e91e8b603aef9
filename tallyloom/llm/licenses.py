"""Licence scan with a positional rare-token index (operator 1), in DataFrame expressions only.

Notices are word sequences with a mandatory key phrase: phrases, opening lines, whole file headers and texts, and tags.
One pass counts in how many documents each key-phrase word occurs.  Each key phrase is indexed under its rarest word, the
one of highest inverse document frequency: word -> (notice, offset).  A second pass finds the places of a file's indexed
words, the rarest licence words it has, in one walk over its words, and looks each up in the index.  A posting and a place
give a start; it stands if the notice's second rarest word lies at its own offset from there, the mandatory phrase
is verified word by word, and what share of the whole notice lies in place is measured.  A key phrase cannot occur
without its rare words at one start, so no place is missed.  Nothing is shuffled but the counts of the index's
vocabulary, whose size the notices bound.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a notice's words that must stand in place for its label.
MIN_COVERAGE = 0.8
#: The score of a base phrase on its own.
PHRASE_SCORE = 0.5


@dataclass(frozen=True)
class Notice:
    """``words`` with the mandatory phrase at ``words[key:key + size]``; ``base`` phrases are counted at every place."""

    label: str
    words: tuple[str, ...]
    key: int
    size: int
    base: bool = False

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.key : self.key + self.size]


def notice(label: str, text: str, phrase: str, base: bool = False) -> Notice:
    words, key = (tuple(w for w in re.split(SEPARATORS, x.lower()) if w) for x in (text, phrase))
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return Notice(label, words, at, len(key), base)


#: The phrases and labels of the base.
BASE = (
    notice("gpl", "gnu general public license", "gnu general public license", True),
    notice("apache", "apache license", "apache license", True),
    notice("cc-by", "cc by", "cc by", True),
    notice("mit", "mit license", "mit license", True),
)
#: Identifiers that a tag in a file may name.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0",
    "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "LPPL-1.3c", "MIT", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
)
#: Opening lines, file headers and texts of well-known licences and the phrase that each must hold.
NOTICES = (
    notice("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    notice("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    notice("cc0-1.0", "cc0 1 0 universal", "cc0 1 0"),
    notice("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    notice("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    notice("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    notice("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    # whole texts and file headers
    notice("agpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "GNU Affero General Public License as published by the Free Software Foundation"),
    notice("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "you may not use this file except in compliance with the License"),
    notice("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Redistributions of source code must retain the above copyright notice"),
    notice("bsd-3-clause-text", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "may be used to endorse or promote products derived from this software"),
    notice("bsl-1.0-text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following", "any person or organization obtaining a copy of the software and accompanying documentation"),
    notice("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "GNU General Public License as published by the Free Software Foundation"),
    notice("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "provided that the above copyright notice and this permission notice appear in all copies"),
    notice("lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU Lesser General Public License as published by the Free Software Foundation"),
    notice("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    notice("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file"),
    notice("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Anyone is free to copy modify publish use compile sell or distribute this software"),
    notice("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    *(notice(f"spdx:{name.lower()}", f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}") for name in SPDX),
)


def words_of(text: Column) -> Column:
    """Words of a text in which only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    # lower() is a fast path: beyond A-Z it only turns word characters into other word characters, and of those only
    # the Kelvin sign becomes an ASCII letter.
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = F.when(F.contains(text, F.lit("\u212a")), ascii_lower).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def document_counts(words: DataFrame, notices: Sequence[Notice]) -> dict[str, int]:
    """In how many documents each word of a key phrase occurs; as many rows reach the driver as there are such words."""
    vocabulary = sorted({w for n in notices for w in n.phrase})
    index = F.array(*map(F.lit, vocabulary))
    found = words.select(F.explode(F.array_intersect(index, F.col("_words"))).alias("word")).groupBy("word").count()
    counts = dict.fromkeys(vocabulary, 0)
    return counts | {r["word"]: r["count"] for r in found.collect()}


def anchors(n: Notice, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The two rarest words of a key phrase with their offsets: the highest inverse document frequencies."""
    ranked = sorted((counts[w], i, w) for i, w in enumerate(n.phrase))
    return [(w, n.key + i) for _, i, w in ranked[:2]]


def _strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _template(n: Notice, counts: dict[str, int]) -> Column:
    """What a candidate is tested against, as a constant."""
    word, offset = anchors(n, counts)[-1]
    values = {"label": n.label, "base": n.base, "second": word, "at": offset, "key": n.key, "size": n.size}
    return F.struct(*[F.lit(v).alias(c) for c, v in values.items()], _strings(n.phrase).alias("phrase"), _strings(n.words).alias("words"))


def _found(words: Column, notices: Sequence[Notice], counts: dict[str, int]) -> Column:
    """(label, base, start, coverage) of every place of a notice among the words."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(notices):
        word, offset = anchors(n, counts)[0]
        postings.setdefault(word, []).append((i, offset))
    templates = F.array(*[_template(n, counts) for n in notices])
    index = F.create_map(*[x for w, at in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(o).alias("o")) for i, o in at]))])
    of = lambda x, name: F.get(templates, x["t"])[name]

    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*postings), i)), lambda i: i.isNotNull())
    starts = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(index, F.get(words, p)), lambda x: F.struct(x["t"].alias("t"), (p - x["o"]).alias("s")))))
    # relative positions first, then the mandatory phrase; a notice's head may lie before the text, its phrase may not
    met = F.filter(starts, lambda x: F.get(words, x["s"] + of(x, "at")) == of(x, "second"))
    held = F.filter(met, lambda x: (x["s"] + of(x, "key") >= 0) & (F.slice(words, F.greatest(x["s"] + of(x, "key"), F.lit(0)) + 1, of(x, "size")) == of(x, "phrase")))

    def covered(x: Column) -> Column:
        whole = of(x, "words")
        hits = F.filter(F.sequence(F.lit(0), F.size(whole) - 1), lambda i: F.get(words, x["s"] + i) == F.get(whole, i))
        return F.size(hits) / F.size(whole).cast("double")

    scored = F.transform(held, lambda x: F.struct(of(x, "label").alias("label"), of(x, "base").alias("base"), (x["s"] + of(x, "key")).cast("long").alias("start"), covered(x).alias("coverage")))
    return F.filter(scored, lambda x: x["base"] | (x["coverage"] >= MIN_COVERAGE))


def license_scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), base: Sequence[Notice] = BASE, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """``keep``, ``n_words`` and ``found``: an array of (label, base, start, coverage), one for each place of a notice.

    Null or empty text: no words, nothing found.  A long text is one row like any other: its words are split once and
    walked once.  Overlapping notices, and equal ones, are all reported.  Rows that repeat are scanned row by row.  An
    empty table gives no rows.  Other columns are left out unless named in ``keep``; one called ``n_words`` or ``found``
    may not be.
    """
    if clash := {"n_words", "found"} & set(keep):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    every = [*base, *notices]
    counts = document_counts(docs.select(words_of(F.col(text)).alias("_words")), every)
    # the words are bound to a lambda's name, so that they are split once a row whatever refers to them
    scan = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _found(w, every, counts).alias("found")))
    scanned = docs.select(*keep, F.inline(scan))
    return scanned.select(*keep, "n_words", "found")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: F.when(x["base"], F.lit(PHRASE_SCORE)).otherwise(x["coverage"]))), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The same result without an index: each notice is tried at each word of each text."""

    def tried(n: Notice, k: int) -> str:
        key = " AND ".join(f"words[i+{j}] = '{w}'" for j, w in enumerate(n.phrase))
        whole = "[" + ", ".join(f"'{w}'" for w in n.words) + "]"
        hits = f"len(list_filter(range({len(n.words)}), lambda j: i+j-{n.key} > 0 AND words[i+j-{n.key}] = {whole}[j+1]))"
        return f"""SELECT doc_id, '{n.label}' AS label, {n.base} AS base, i - 1 AS start, {hits} / {len(n.words)}.0::DOUBLE AS coverage
          FROM (SELECT doc_id, words, unnest(list_filter(range(1, len(words) + 1), lambda i: {key})) AS i FROM w) t{k}"""

    union = " UNION ALL ".join(tried(n, k) for k, n in enumerate([*BASE, *NOTICES]))
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT * FROM ({union}) WHERE base OR coverage >= {MIN_COVERAGE}),
s AS (SELECT doc_id, count(*) FILTER (base) AS n, min(start) FILTER (base) AS a, max(start) FILTER (base) AS b,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(CASE WHEN base THEN {PHRASE_SCORE} ELSE coverage END) AS score FROM p GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN s USING (doc_id)
"""


ORACLE = _oracle()

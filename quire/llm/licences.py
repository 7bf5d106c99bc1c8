"""Licence scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences, a sentence is normalised (lower case, only letters and digits) and looked
up among known licence sentences; the identifiers found, in order, are matched against rules that
are ordered identifiers of one licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their usual notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "Licensed under the BSD License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl-terms-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-see": "See the GNU General Public License for more details",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "apache-patent": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted",
    "gpl-title-3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-title-2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-title-3": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-title-21": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies",
    "lgpl-terms-21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "agpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-lgpl-21": "SPDX-License-Identifier: LGPL-2.1-only",
    "spdx-lgpl-21-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl-3": "SPDX-License-Identifier: LGPL-3.0-only",
    "spdx-lgpl-3-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl": "SPDX-License-Identifier: AGPL-3.0-only",
    "spdx-agpl-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-epl": "SPDX-License-Identifier: EPL-2.0",
    "spdx-boost": "SPDX-License-Identifier: BSL-1.0",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-bsd": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mpl": "SPDX-License-Identifier: MPL-2.0",
}
# Licence and the identifiers its rule wants in this order; others may stand between.
RULES = [
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-title", "apache-grant", "apache-patent")),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-grant", "mit-include")),
    ("MIT", ("spdx-mit",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("spdx-bsd",)),
    ("BSD", ("bsd-notice",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("spdx-isc",)),
    ("GPL-3.0", ("gpl-notice",)),
    ("GPL-3.0", ("gpl-notice-2",)),
    ("GPL-3.0", ("gpl-terms-3",)),
    ("GPL-2.0", ("gpl-terms-2",)),
    ("GPL-3.0", ("gpl-title-3", "gnu-verbatim")),
    ("GPL-3.0", ("spdx-gpl",)),
    ("GPL-3.0", ("spdx-gpl-later",)),
    ("GPL-2.0", ("gpl-title-2", "gnu-verbatim")),
    ("GPL-2.0", ("spdx-gpl-2",)),
    ("GPL-2.0", ("spdx-gpl-2-later",)),
    ("LGPL-3.0", ("lgpl-title-3", "gnu-verbatim")),
    ("LGPL-2.1", ("lgpl-title-21", "gnu-verbatim")),
    ("LGPL-2.1", ("lgpl-terms-21", "lgpl-hope")),
    ("LGPL-2.1", ("spdx-lgpl-21",)),
    ("LGPL-2.1", ("spdx-lgpl-21-later",)),
    ("LGPL-3.0", ("spdx-lgpl-3",)),
    ("LGPL-3.0", ("spdx-lgpl-3-later",)),
    ("AGPL-3.0", ("agpl-title", "gnu-verbatim")),
    ("AGPL-3.0", ("agpl-terms", "gpl-hope")),
    ("AGPL-3.0", ("spdx-agpl",)),
    ("AGPL-3.0", ("spdx-agpl-later",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("MPL-2.0", ("mpl-title", "mpl-grant")),
    ("MPL-2.0", ("spdx-mpl",)),
    ("EPL-2.0", ("epl-notice",)),
    ("EPL-2.0", ("spdx-epl",)),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("spdx-boost",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Zlib", ("spdx-zlib",)),
    ("CC0-1.0", ("spdx-cc0",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
]
# Fixed value: every known sentence, normalised, holds one of these.
TELLING = "licen|permi|warrant|redistribut|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved|free[^a-z0-9]+software|copyright"
#: Rules that another one contains: the licence, its rule's last sentence, and the sentence that the longer one ends with.
#: Each of the latter takes one of the former away; a notice by name counts for itself.
CONTAINED = ("BSD-2-Clause", "bsd-binary", "bsd-endorse")


def normalised(text: str) -> str:
    """A sentence as the scan compares it (for tables of rules; texts go through columns)."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return " ".join(words)


def _clean(parts: Column) -> Column:
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(clean, lambda s: s != "")


def sentences(text: Column) -> Column:
    """Normalised sentences of wrapped text: cut behind ``.!?``, at colons that end a line, at blank lines."""
    cut = F.regexp_replace(text, r"([.!?])[ \t\r\n]+|(:)[ \t\r]*\n|\n[ \t\r]*\n", "$1$2\u0001")
    return _clean(F.split(cut, "\u0001"))


def clauses(text: Column) -> Column:
    """As ``sentences``, and cut at semicolons that end a line too."""
    return sentences(F.regexp_replace(text, r";[ \t\r]*\n", ";\n\n"))


def line_sentences(text: Column) -> Column:
    """Normalised sentences where every line stands for itself."""
    return _clean(F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+|\n", "$1\u0001"), "\u0001"))


def _known() -> dict[str, str]:
    return {normalised(sentence): name for name, sentence in SENTENCES.items()}


def _placed(parts: Column, known: Column) -> Column:
    """(at, id) of the known sentences: ``at`` is the letters and digits before it, the same however the text is cut."""
    none = F.array().cast("array<struct<at:int,id:string>>")

    def step(x: Column, s: Column) -> Column:
        hit = F.struct(x["at"].alias("at"), F.try_element_at(known, s).alias("id"))
        found = F.when(hit["id"].isNotNull(), F.concat(x["found"], F.array(hit))).otherwise(x["found"])
        return F.struct((x["at"] + F.length(F.replace(s, F.lit(" "), F.lit("")))).alias("at"), found.alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda x: x["found"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``licence``: struct of licences (sorted, distinct), sentence_ids (in order), n_sentences.

    A text is read as wrapped sentences, as wrapped clauses and line by line; what the readings find is
    merged by where it starts, once if they agree. Whole texts are scanned; null and empty texts have none. Other columns pass through and a column
    called ``licence`` is replaced. One narrow pass without shuffle: repeated rows are scanned alike,
    an empty table gives an empty result.
    """
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    telling = F.lower(F.col("text")).rlike(TELLING)
    found = F.array_sort(F.array_distinct(F.concat(*[_placed(f(F.col("text")), known) for f in (sentences, clauses, line_sentences)])))
    none, name = F.array().cast("array<string>"), "ids"
    while name in docs.columns:
        name += "_"
    ids = F.col(name)
    rows = docs.drop("licence").withColumn(name, F.when(telling, F.transform(found, lambda x: x["id"])).otherwise(none))
    many = lambda s: F.size(F.filter(ids, lambda x: x == s))
    shorter, last, longer = CONTAINED
    met = [
        F.when(_in_order(ids, rule) & ((many(last) > many(longer)) if licence == shorter and last in rule else F.lit(True)), F.lit(licence)) for licence, rule in RULES
    ]
    licences = F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*met))))).otherwise(none)
    return rows.withColumn("licence", F.struct(licences.alias("licences"), ids.alias("sentence_ids"), F.size(ids).alias("n_sentences"))).drop(name)


def _in_order(ids: Column, rule: tuple[str, ...]) -> Column:
    """If the identifiers of a rule stand in ``ids`` in this order, with others between."""
    met = F.lit(True)
    for k, wanted in enumerate(rule):
        at = F.array_position(ids, wanted)
        met = met & (at > 0)
        if k + 1 < len(rule):
            ids = F.slice(ids, (at + 1).cast("int"), F.size(ids))
    return met

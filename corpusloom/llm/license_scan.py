"""License scans by sentence rules, with DataFrame functions only.

A text is normalised (lower case, one space for each run of other characters than letters and
digits, so that comment prefixes go) with marks at sentence ends (. ! ? ; before white space)
and at line ends. What lies between two marks and is a known licence sentence gives its
identifier; a line end within it counts as a space, so that a wrapped sentence is found, but a
sentence end or an empty line does not. The identifiers of a text, in order, are matched
against ordered rules: a rule that finds its sequence takes it, so that a later, more general
rule does not see it again. More than GAP other sentences or lines between two identifiers
break a sequence, so that parts of unrelated notices do not make one. Proprietary is reported
only where no licence is.

A null or empty text, or one without a known sentence, has no identifiers and no licences;
repeated rows give repeated results; a null id stays null; texts of any length are read whole;
an empty table gives an empty table; extra columns are not read. A text in which none of ANCHORS occurs can hold no known
sentence (each holds one, all of its words) and is not cut.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_text

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-short": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "isc-grant": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-short": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License v3.0"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "version-3": ["either version 3 of the License, or (at your option) any later version", "version 3 of the License"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "lgpl2.1-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "agpl-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "version-2": ["either version 2 of the License, or (at your option) any later version", "version 2 of the License"],
    "version-2.1": ["either version 2.1 of the License, or (at your option) any later version", "version 2.1 of the License"],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License v2.0"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3-short": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "bsd2-short": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "epl-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "cc0-dedication": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc0-short": ["This work is licensed under CC0 1.0", "This work is marked with CC0 1.0 Universal license"],
    "cc-by-nd-short": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "mpl-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under CC BY-NC 4.0"],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-short": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
# Sentences of which a bounded number of words in the middle, or before, is free.
OPEN_SENTENCES = {
    "bsd-endorse": [(f"Neither the name of {the}".strip(), f"nor the names of {whose} contributors may be used to endorse or promote products derived from this software without specific prior written permission") for the in ("", "the") for whose in ("its", "his", "her", "their")],
    "mit-short": [("", "available under the MIT License"), ("", "licensed under the MIT License"), ("", "released under the MIT License")],
    "apache-short": [("", "available under the Apache License, Version 2.0"), ("", "licensed under the Apache License, Version 2.0")],
    "bsd3-short": [("", "available under the BSD 3-Clause License")],
    "bsd2-short": [("", "available under the BSD 2-Clause License")],
}
#: The most free words of an open sentence. A sentence end may stand among those in its middle, as after an abbreviated name.
FREE_WORDS = 12
#: Words that turn what follows them around; none may be free before a sentence.
TURNING = ("not", "never", "isn", "nor", "no", "unless", "if", "whether", "than")
# SPDX identifiers by licence, where they are not its name alone.
SPDX = {"GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"), "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later")}
PROPRIETARY = "Proprietary"  # a text with nothing but a reservation of rights
#: (licence, sequence of identifiers), in the order of application: longer forms first.
_RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-short",)),
    ("Apache-2.0", ("apache-short", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-short", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-title",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("AGPL-3.0", ("agpl-terms", "version-3")),
    ("AGPL-3.0", ("agpl-title",)),
    ("LGPL-3.0", ("lgpl-terms", "version-3")),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl2.1-title",)),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("LGPL-2.1", ("lgpl-terms", "version-2.1")),
    ("GPL-2.0", ("gpl-terms", "version-2", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0", ("gpl-terms", "version-2", "gpl-warranty")),
    ("GPL-2.0", ("gpl-terms", "version-2")),
    ("GPL-2.0", ("gpl2-short",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl-terms", "version-3", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0", ("gpl-terms", "version-3", "gpl-warranty")),
    ("GPL-3.0", ("gpl-terms", "version-3")),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("EPL-2.0", ("epl-short",)),
    ("MPL-2.0", ("mpl-header",)),
    ("MPL-2.0", ("mpl-title",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("Unlicense", ("unlicense",)),
    (PROPRIETARY, ("reserved",)),
)
#: All rules: a licence's SPDX line is one of its own.
RULES = tuple((name, (f"spdx-{name}",)) for name in dict.fromkeys(x for x, _ in _RULES) if name != PROPRIETARY) + _RULES
#: So many other sentences or lines may lie between the identifiers of a sequence.
GAP, BREAK = 12, "-"
#: Each known sentence holds one of these, in lower case and within a word.
ANCHORS = ("licen", "permission", "copyright", "warrant", "free software", "redistribut", "cc by", "public domain", "rights reserved", "prior written")
#: An abbreviated version is no sentence end.
VERSION = r"\bv\.[\x20\t]+([0-9])", "v $1"
SENTENCE_END, LINE_END = r"[.!?;](?:[\x20\t]+|(?=[\r\n]))", r"\r\n|[\r\n]"


def normalise(sentence: str) -> str:
    """The rule for one sentence, as Python states it (the data goes through _found)."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


@functools.lru_cache
def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    spdx = {f"spdx-{name}": [f"SPDX-License-Identifier: {x}" for x in (name, *SPDX.get(name, ()))] for name, seq in RULES if seq[0] == f"spdx-{name}"}
    return {normalise(t): name for name, texts in reversed((SENTENCES | spdx).items()) for t in texts}


@functools.lru_cache
def open_known() -> tuple[tuple[str, str, str], ...]:
    """(what a sentence begins with, what it ends with, identifier), normalised."""
    return tuple((normalise(a), normalise(b), name) for name, texts in OPEN_SENTENCES.items() for a, b in texts)


def _found(text: Column) -> Column:
    """The known sentences in order, normalised, and BREAK for more than GAP others in a row.
    Marks: 1 a sentence end or an empty line, 2 a line end."""
    clean = F.regexp_replace(F.translate(F.lower(text), "\u0001\u0002", "  "), *map(F.lit, VERSION))
    marked = F.regexp_replace(F.regexp_replace(clean, SENTENCE_END, "\u0001"), LINE_END, "\u0002")
    plain = F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{N}\u0001\u0002]+", " "), r" ?([\u0001\u0002]) ?", "$1")
    whole = F.regexp_replace(F.concat(F.lit("\u0001"), F.trim(plain), F.lit("\u0001")), "[\u0001\u0002]{2,}", "\u0001")
    word, gap = "[^ \u0001\u0002]+", "[ \u0002]"
    free = [f"{a.replace(' ', gap)}(?:[ \u0001\u0002]{word}){{1,{FREE_WORDS}}}?[ \u0001\u0002]{b.replace(' ', gap)}" if a else f"(?:(?!(?:{'|'.join(TURNING)}){gap}){word}{gap}){{1,{FREE_WORDS}}}?{b.replace(' ', gap)}" for a, b, _ in open_known()]
    some = "|".join([*(k.replace(" ", gap) for k in sorted(known(), key=len, reverse=True)), *free])
    mark, inside = "[\u0001\u0002]", "[^\u0001\u0002]"
    others = f"(?:{mark}(?!(?:{some}){mark}){inside}++){{{GAP + 1}}}"
    hits = F.regexp_extract_all(whole, F.lit(f"(?<={mark})(?:{some})(?={mark})|{others}"), F.lit(0))
    return F.transform(hits, lambda s: F.when(s.rlike(f"^{mark}"), F.lit(BREAK)).otherwise(F.translate(s, "\u0001\u0002", "  ")))


def _open_id(sentence: Column) -> Column:
    """The identifier of an open sentence that _found() gave."""
    return F.coalesce(*[F.when(F.startswith(sentence, F.lit(a)) & F.endswith(sentence, F.lit(b)), name) for a, b, name in open_known()])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, sentence_ids array<string> (known sentences in order) and licenses
    array<string> (distinct, in rule order)."""
    text, lower = F.col("text"), F.lower("text")
    table = F.create_map(*[F.lit(x) for pair in sorted({**known(), BREAK: BREAK}.items()) for x in pair])
    may = F.lit(False)
    for a in ANCHORS:
        first, *more = (F.contains(lower, F.lit(w)) for w in a.split())
        for m in more:
            first = first & m
        may = may | first
    ids = F.when(may, F.array_compact(F.transform(_found(text), lambda s: F.coalesce(F.try_element_at(table, s), _open_id(s))))).otherwise(F.array().cast("array<string>"))
    out = id_text(docs, id_col, text_col, keep_row).select("doc_id", *["row"] * keep_row, ids.alias("_ids"))
    out = out.withColumn("sentence_ids", F.array_remove("_ids", BREAK))
    # one pass over a short string for each rule: what is left, and the licences found so far
    out = out.withColumn("_left", F.concat(F.lit("|"), F.array_join("_ids", "|"), F.lit("|"))).withColumn("_found", F.array().cast("array<string>"))
    start = F.struct(F.col("_left").alias("left"), F.col("_found").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"|{'|'.join(seq)}|").alias("seq")) for name, seq in RULES])

    def step(acc, rule):
        hit = F.contains(acc["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["seq"], F.lit("|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit & ~F.array_contains(acc["found"], rule["name"]) & ((rule["name"] != PROPRIETARY) | (F.size(acc["found"]) == 0)), F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        )

    licenses = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step, lambda acc: acc["found"])).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", *["row"] * keep_row, "sentence_ids", licenses.alias("licenses"))


def report(scanned: DataFrame) -> DataFrame:
    """One row for each text: how many known sentences, which, and the licences they make."""
    return scanned.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )

"""Licence scans by sentence rules, with built-in functions only.

A text is normalised: lower case, runs of anything but letters and digits as one space. Sentences end
at blank lines and at . ; : ! ? before white space, but not at the colon after "license". Each sentence is a list of
lines, and runs of whole lines of one sentence are looked up in the table of known sentences, so that a sentence is known
wrapped or not, after a list number or not, and with up to six words of a name before "is" or "are". A line costs one look-up
in a hash set, however many sentences are known: only where a line begins one are longer runs tried. The longest run
from a line counts, and runs that begin inside another one don't. A known run becomes its identifier; what lies between becomes one
gap, but for lone list numbers, which are dropped. The text's sequence of identifiers is matched against the rules in
order: a rule fits where its identifiers stand next to each other, and what it fits is taken out, so
that a full licence text isn't reported again by a shorter rule. An SPDX expression is read as its licences.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licence texts and notices, as they stand there.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "all-rights": ["All rights reserved"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-use": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0"],
    "bsl-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "apache-the": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl2-made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "cc0-waived": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-free": ["This program is free software", "* is free software"],
    "gpl3-modify": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-modify": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "lgpl21-modify": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-modify": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-modify": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "either-2": ["either version 2 of the License, or (at your option) any later version"],
    "either-2.1": ["either version 2.1 of the License, or (at your option) any later version"],
    "either-3": ["either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "* is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
}
#: Licences by SPDX identifier, and the names that notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-3-Clause": ["BSD License", "BSD 3-Clause License", "BSD 3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause", "2-Clause BSD License", "Simplified BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2 License", "Apache 2"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2 License", "GPLv2", "GPL-2.0"],
    "GPL-2.0-or-later": ["GNU General Public License v2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPLv2+", "GPL-2.0+"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3 License", "GPLv3", "GPL-3.0"],
    "GPL-3.0-or-later": ["GNU General Public License v3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPLv3+", "GPL-3.0+"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-2.1-or-later": ["LGPLv2.1 or later", "LGPLv2.1+", "LGPL-2.1+"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"],
    "LGPL-3.0-or-later": ["LGPLv3 or later", "LGPLv3+", "LGPL-3.0+"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPLv3", "AGPL-3.0"],
    "AGPL-3.0-or-later": ["AGPLv3 or later", "AGPLv3+", "AGPL-3.0+"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
}
#: What stands before a licence's name; * is a name of up to six words. Names with the word License are known alone.
SAID = ["licensed under", "released under", "distributed under", "available under", "published under", "* is licensed under", "* is released under", "* is distributed under", "* is available under", "* is published under"]
def named(license: str) -> str:
    """Identifier of a sentence that names a licence."""
    return f"{license.lower().removesuffix('-4.0')}-ref"


#: Rules in order of their trial: name, licence, identifiers that stand next to each other.
RULES = [
    ("mit-full", "MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("mit-part", "MIT", ["mit-grant", "mit-notice"]),
    ("isc-full", "ISC", ["isc-grant", "isc-warranty"]),
    ("bsd-3-full", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("bsd-2-full", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("unlicense", "Unlicense", ["unlicense-free", "unlicense-use"]),
    ("zlib", "Zlib", ["zlib-warranty", "zlib-liable", "zlib-grant"]),
    ("apache-header", "Apache-2.0", ["apache-the", "apache-use", "apache-copy"]),
    ("apache-header-plain", "Apache-2.0", ["apache-2.0-ref", "apache-use", "apache-copy"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl-free", "gpl3-modify", "gpl-hope"]),
    ("gpl-3-header-parts", "GPL-3.0-or-later", ["gpl-free", "gpl-terms", "either-3", "gpl-hope"]),
    ("gpl-3-short", "GPL-3.0-or-later", ["gpl-free", "gpl3-modify"]),
    ("gpl-3-short-parts", "GPL-3.0-or-later", ["gpl-free", "gpl-terms", "either-3"]),
    ("gpl-3-terms", "GPL-3.0-or-later", ["gpl3-modify"]),
    ("gpl-3-terms-parts", "GPL-3.0-or-later", ["gpl-terms", "either-3"]),
    ("gpl-2-header", "GPL-2.0-or-later", ["gpl-free", "gpl2-modify", "gpl-hope"]),
    ("gpl-2-header-parts", "GPL-2.0-or-later", ["gpl-free", "gpl-terms", "either-2", "gpl-hope"]),
    ("gpl-2-short", "GPL-2.0-or-later", ["gpl-free", "gpl2-modify"]),
    ("gpl-2-short-parts", "GPL-2.0-or-later", ["gpl-free", "gpl-terms", "either-2"]),
    ("gpl-2-terms", "GPL-2.0-or-later", ["gpl2-modify"]),
    ("gpl-2-terms-parts", "GPL-2.0-or-later", ["gpl-terms", "either-2"]),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ["gpl-free", "lgpl21-modify", "gpl-hope"]),
    ("lgpl-2.1-header-parts", "LGPL-2.1-or-later", ["gpl-free", "lgpl-terms", "either-2.1", "gpl-hope"]),
    ("lgpl-2.1-short", "LGPL-2.1-or-later", ["gpl-free", "lgpl21-modify"]),
    ("lgpl-2.1-short-parts", "LGPL-2.1-or-later", ["gpl-free", "lgpl-terms", "either-2.1"]),
    ("lgpl-2.1-terms", "LGPL-2.1-or-later", ["lgpl21-modify"]),
    ("lgpl-2.1-terms-parts", "LGPL-2.1-or-later", ["lgpl-terms", "either-2.1"]),
    ("lgpl-3-header", "LGPL-3.0-or-later", ["gpl-free", "lgpl3-modify", "gpl-hope"]),
    ("lgpl-3-header-parts", "LGPL-3.0-or-later", ["gpl-free", "lgpl-terms", "either-3", "gpl-hope"]),
    ("lgpl-3-short", "LGPL-3.0-or-later", ["gpl-free", "lgpl3-modify"]),
    ("lgpl-3-short-parts", "LGPL-3.0-or-later", ["gpl-free", "lgpl-terms", "either-3"]),
    ("lgpl-3-terms", "LGPL-3.0-or-later", ["lgpl3-modify"]),
    ("lgpl-3-terms-parts", "LGPL-3.0-or-later", ["lgpl-terms", "either-3"]),
    ("agpl-3-header", "AGPL-3.0-or-later", ["gpl-free", "agpl3-modify", "gpl-hope"]),
    ("agpl-3-header-parts", "AGPL-3.0-or-later", ["gpl-free", "agpl-terms", "either-3", "gpl-hope"]),
    ("agpl-3-short", "AGPL-3.0-or-later", ["gpl-free", "agpl3-modify"]),
    ("agpl-3-short-parts", "AGPL-3.0-or-later", ["gpl-free", "agpl-terms", "either-3"]),
    ("agpl-3-terms", "AGPL-3.0-or-later", ["agpl3-modify"]),
    ("agpl-3-terms-parts", "AGPL-3.0-or-later", ["agpl-terms", "either-3"]),
    ("mpl-2-header", "MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("unlicense-short", "Unlicense", ["unlicense-free"]),
    ("apache-license", "Apache-2.0", ["apache-the"]),
    ("mpl-2-form", "MPL-2.0", ["mpl2-form"]),
    ("epl-2-made", "EPL-2.0", ["epl2-made"]),
    ("cc0-waived", "CC0-1.0", ["cc0-waived"]),
    ("bsl", "BSL-1.0", ["bsl-grant"]),
    ("bsl-title", "BSL-1.0", ["bsl-title"]),
    ("apache-title", "Apache-2.0", ["apache-title"]),
    ("gpl-3-title", "GPL-3.0-only", ["gpl3-title"]),
    ("gpl-2-title", "GPL-2.0-only", ["gpl2-title"]),
    ("lgpl-3-title", "LGPL-3.0-only", ["lgpl3-title"]),
    ("lgpl-2.1-title", "LGPL-2.1-only", ["lgpl21-title"]),
    ("agpl-3-title", "AGPL-3.0-only", ["agpl3-title"]),
    *((x.lower(), x, [named(x)]) for x in NAMES),
    ("reserved", "LicenseRef-all-rights-reserved", ["all-rights"]),
]
#: A sentence's end, in normalised text and as an entry of the list of lines.
END = "\x02"
SPDX = "spdx license identifier "
#: Patterns that Java and RE2 read alike. Colons after "license"; "v." before a number; "+" for "or later"; ends; what isn't part of a word; pointers to a licence file.
COLON, VERSION, LATER, ENDS, OTHER, POINTER = r"(licenses?|identifier)[\"']?[ \t]*:", r"(^|[^a-z])v\.[ \t\r\n]+([0-9])", r"(gplv?-?[0-9.]+)\+", r"[.;:!?](\s|$)", "[^a-z0-9\\x{80}-\\x{10FFFF}\n]+", "( and)?( please)? see[ \n](the[ \n])?(file[ \n]|included[ \n]|accompanying[ \n])?(license|copying)( [a-z]+)*"
#: A list number before a line, alone, and the name before "is" or "are".
NUMBER, ALONE, NAMED = "^[0-9]{1,2} ", f"^([0-9]{{1,2}}|{END})$", "^([^ ]+ ){1,6}?(is|are) "


def whole() -> dict[str, str]:
    """Normalised known sentence: its identifier in <>. Names of a few letters stand without "the"."""

    def one(s: str) -> str:
        s = re.sub(LATER, r"\1 or later", s.lower().replace("licence", "license"))
        return re.sub("[^a-z0-9*]+", " ", re.sub(VERSION, r"\1v \2", s)).strip()

    table = {}
    for lic, names in NAMES.items():
        for name in names:
            said = [*(f"{v} {the}{name}" for v in SAID for the in (("",) if len(name) < 5 else ("", "the ", "the terms of the "))), f"License {name}", f"{SPDX}{name}", f"{SPDX}{lic}", f"License {lic}"]
            if "License" in name and len(name.split()) > 1:
                said += [name, f"The {name}"]
            table |= {one(s): f"<{named(lic)}>" for s in said}
    table |= {one(s): f"<{name}>" for name, sentences in SENTENCES.items() for s in sentences}
    return table


def signs(table: dict[str, str]) -> list[str]:
    """A few long words of which every known sentence holds at least one: the word that most of the sentences left have, as long as there are any."""
    left, out = set(table), []
    while left:
        counts = Counter(w for k in left for w in set(k.split()) if len(w) >= min(7, max(map(len, k.split()))))
        out.append(max(counts, key=lambda w: (counts[w], w)))
        left = {k for k in left if out[-1] not in k}
    return out


def normalised(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds a column with the normalised text between ENDs: lines are apart by a line end, sentences by one or more ENDs, which may have line ends around them."""
    df = df.withColumn(to, F.replace(F.translate(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), END, " "), F.lit("licence"), F.lit("license")))
    for words, pattern, by in ((("license", "identifier"), COLON, "$1 "), (("v.",), VERSION, "$1v $2"), (("gpl",), LATER, "$1 or later")):
        df = df.withColumn(to, F.when(functools.reduce(lambda a, b: a | b, [F.contains(to, F.lit(w)) for w in words]), F.regexp_replace(to, pattern, by)).otherwise(F.col(to)))
    out = F.regexp_replace(F.regexp_replace(to, ENDS, f"{END}\n"), OTHER.replace("\n", f"\n{END}"), " ")
    out = F.concat(F.lit(END), out, F.lit(END))
    for a, b in ((" \n", "\n"), ("\n ", "\n"), (f" {END}", END), (f"{END} ", END), ("\n\n", f"\n{END}\n")):  # OTHER leaves single spaces only
        out = F.replace(out, F.lit(a), F.lit(b))
    df = df.withColumn(to, out)
    return df.withColumn(to, F.when(F.contains(to, F.lit(" see")), F.regexp_replace(to, POINTER, "")).otherwise(F.col(to)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_sentences, n_known, sequence (identifiers in <>, ? for a gap), rules and licenses (comma-joined, in rule order).

    n_sentences counts the pieces between ends of sentences or lines. Null and empty texts have no
    sentences, an empty sequence and no licence; repeated rows get equal results; an empty table gives
    an empty result. Other columns are not read.
    """
    table = whole()
    any_of = lambda c, values: f"{c} IN ({', '.join(f"'{x}'" for x in values)})"
    begins = dict.fromkeys(" ".join(words[: n + 1]) for words in (k.split() for k in table) for n in range(len(words)))
    most, length = max(len(k.split()) for k in table), max(map(len, table))
    codes = F.map_from_arrays(F.split(F.lit("|".join(table)), r"\|"), F.split(F.lit("|".join(table.values())), r"\|"))

    lines = normalised(df.select(id_col, F.col(text_col).alias("_text")), "_text", "lines")
    signed = functools.reduce(lambda a, b: a | b, [F.contains(F.col("lines"), F.lit(w)) for w in signs(table)])  # texts without any sign have no known sentence
    cut = lines.select(id_col, signed.alias("signed"), F.expr(f"filter(split(replace(lines, '{END}', '\n{END}\n'), '\n'), l -> l <> '')").alias("ls"))
    cut = cut.withColumn("n_sentences", F.expr(f"CAST(size(filter(ls, l -> l <> '{END}')) AS BIGINT)"))
    parts = f"transform(split(replace(substr(l, {len(SPDX) + 1}), ' or later', ' or-later'), ' (or|and) '), x -> '{SPDX}' || replace(regexp_replace(x, ' with .*$', ''), ' or-later', ' or later'))"
    cut = cut.withColumn("ls", F.expr(f"CASE WHEN exists(ls, l -> startswith(l, '{SPDX}')) THEN flatten(transform(ls, l -> CASE WHEN startswith(l, '{SPDX}') THEN {parts} ELSE array(l) END)) ELSE ls END"))
    # i: a line's place from 0; k: how it begins a known sentence
    forms = f"array(l, CASE WHEN l RLIKE '{NUMBER}' THEN regexp_replace(l, '{NUMBER}', '') END, CASE WHEN contains(l, ' is ') OR contains(l, ' are ') THEN regexp_replace(l, '{NAMED}', '* is ') END)"
    starts = f"filter(transform(ls, (l, i) -> struct(i AS i, get(filter({forms}, f -> {any_of('f', begins)}), 0) AS k)), x -> x.k IS NOT NULL)"
    cut = cut.withColumn("starts", F.expr(f"CASE WHEN signed THEN {starts} ELSE CAST(array() AS array<struct<i: int, k: string>>) END"))
    # s: the run so far, null when it has grown too long; e: its last line; hit: the longest known run
    hit = lambda s, e, other: f"CASE WHEN {any_of(s, table)} THEN struct({e} AS at, {s} AS key) ELSE {other} END"
    longer = f"CASE WHEN length(a.s) + length(l) < {length} THEN a.s || ' ' || l END"
    run = f"aggregate(slice(ls, x.i + 2, {most}), struct(x.k AS s, x.i AS e, {hit('x.k', 'x.i', 'CAST(NULL AS struct<at: int, key: string>)')} AS hit), (a, l) -> struct({longer} AS s, a.e + 1 AS e, {hit(f'({longer})', 'a.e + 1', 'a.hit')} AS hit), a -> a.hit)"
    cut = cut.withColumn("hits", F.expr(f"filter(transform(starts, x -> struct(x.i AS i, {run} AS hit)), h -> h.hit IS NOT NULL)"))
    cut = cut.withColumn("hits", F.expr(f"filter(hits, (h, n) -> NOT exists(slice(hits, greatest(1, n + 1 - {most}), least(n, {most})), g -> g.hit.at >= h.i))"))
    gap = lambda first, n: f"CASE WHEN exists(slice(ls, {first}, {n}), l -> NOT l RLIKE '{ALONE}') THEN '?' ELSE '' END"
    before = "CASE WHEN n = 0 THEN -1 ELSE hits[n - 1].hit.at END"
    cut = cut.withColumn("_gaps", F.expr(f"transform(hits, (h, n) -> {gap(f'{before} + 2', f'h.i - ({before}) - 1')})"))
    cut = cut.withColumn("_codes", F.transform("hits", lambda h: F.element_at(codes, h["hit"]["key"])))
    tail = gap("coalesce(get(hits, size(hits) - 1).hit.at, -1) + 2", "size(ls)")
    coded = cut.select(id_col, "n_sentences", F.concat(F.array_join(F.zip_with("_gaps", "_codes", lambda g, c: F.concat(g, c)), ""), F.expr(tail)).alias("sequence"))
    rules = F.from_json(F.lit(json.dumps([{"rule": n, "license": lic, "ids": "".join(f"<{x}>" for x in ids)} for n, lic, ids in RULES])), "array<struct<rule: string, license: string, ids: string>>")

    def step(acc, r):
        fits = F.contains(acc["left"], r["ids"])
        return F.struct(F.when(fits, F.replace(acc["left"], r["ids"], F.lit("#"))).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["found"], F.array(F.struct(r["rule"].alias("rule"), r["license"].alias("license"))))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast("array<struct<rule:string,license:string>>")
    found = coded.withColumn("found", F.when(F.contains("sequence", F.lit("<")), F.aggregate(rules, F.struct(F.col("sequence").alias("left"), none.alias("found")), step)["found"]).otherwise(none))
    return found.select(
        id_col, "n_sentences", F.length(F.regexp_replace("sequence", "[^<]", "")).cast("long").alias("n_known"), "sequence",
        F.array_join(F.transform("found", lambda x: x["rule"]), ",").alias("rules"), F.array_join(F.array_distinct(F.transform("found", lambda x: x["license"])), ",").alias("licenses"),
    )


def scan_sql() -> str:
    """The same in DuckDB SQL over ``documents``: lines as rows, runs joined with the table of known sentences, gaps and identifiers put together by line."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table, end = whole(), f"chr({ord(END)})"
    most = max(len(k.split()) for k in table)
    text = f"replace(translate(lower(coalesce(text, '')), {end}, ' '), 'licence', 'license')"
    for pattern, to in ((COLON, "\\1 "), (VERSION, "\\1v \\2"), (LATER, "\\1 or later")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
    steps = []
    for k, (_, _, ids) in enumerate(RULES):
        steps.append(f"t{k + 1} AS (SELECT *, replace(s{k}, {quoted(''.join(f'<{x}>' for x in ids))}, '#') AS s{k + 1} FROM t{k})")
    changed = lambda what: f"list_filter([{', '.join(f'CASE WHEN s{k} <> s{k + 1} THEN {quoted(r[what])} END' for k, r in enumerate(RULES))}], lambda x: x IS NOT NULL)"
    order = f"[{', '.join(dict.fromkeys(quoted(r[1]) for r in RULES))}]"
    return f"""
WITH kn AS (SELECT unnest([{', '.join(map(quoted, table))}]) AS key, unnest([{', '.join(map(quoted, table.values()))}]) AS code),
b AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS k FROM (SELECT w, unnest(range(1, len(w) + 1)) AS n FROM (SELECT string_split(key, ' ') AS w FROM kn))),
n0 AS (SELECT doc_id, row_number() OVER () AS rid, regexp_replace({text}, '[.;:!?](\\s|$)', {end} || chr(10), 'g') AS t FROM documents),
n1 AS (SELECT doc_id, rid, regexp_replace({end} || regexp_replace(t, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}\\n\\x02]+', ' ', 'g') || {end}, ' *\\n *', chr(10), 'g') AS t FROM n0),
n2 AS (SELECT doc_id, rid, regexp_replace(regexp_replace(regexp_replace(t, '\\n\\n+', {end}, 'g'), '[ \\n]*\\x02[ \\n\\x02]*', {end}, 'g'), {quoted(POINTER)}, '', 'g') AS t FROM n1),
n3 AS MATERIALIZED (SELECT doc_id, rid, list_filter(string_split(replace(t, {end}, chr(10) || {end} || chr(10)), chr(10)), lambda l: l <> '') AS ls FROM n2),
d AS MATERIALIZED (SELECT doc_id, rid, len(list_filter(ls, lambda l: l <> {end}))::BIGINT AS n_sentences, flatten(list_transform(ls, lambda l: CASE WHEN starts_with(l, {quoted(SPDX)})
  THEN list_transform(regexp_split_to_array(replace(substr(l, {len(SPDX) + 1}), ' or later', ' or-later'), ' (or|and) '), lambda x: {quoted(SPDX)} || replace(regexp_replace(x, ' with .*$', ''), ' or-later', ' or later')) ELSE [l] END)) AS ls FROM n3),
x AS MATERIALIZED (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d),
f AS (SELECT rid, i, 0 AS o, l AS k FROM x
  UNION ALL SELECT rid, i, 1, regexp_replace(l, '{NUMBER}', '') FROM x WHERE regexp_matches(l, '{NUMBER}')
  UNION ALL SELECT rid, i, 2, regexp_replace(l, '{NAMED}', '* is ') FROM x WHERE contains(l, ' is ') OR contains(l, ' are ')),
s AS (SELECT rid, i, arg_min(k, o) AS k FROM f JOIN b USING (k) GROUP BY rid, i),
r AS (SELECT rid, i, j, k || CASE WHEN j > i THEN ' ' || array_to_string(ls[i + 1 : j], ' ') ELSE '' END AS key FROM (SELECT s.*, ls, unnest(range(i, least(i + {most}, len(ls)) + 1)) AS j FROM s JOIN d USING (rid))),
h0 AS (SELECT rid, i, max(j) AS j, arg_max(code, j) AS code FROM r JOIN kn USING (key) GROUP BY rid, i),
h AS (SELECT * FROM (SELECT *, max(j) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h0) WHERE reach IS NULL OR reach < i),
g AS (SELECT x.rid, x.i, CASE WHEN code IS NOT NULL THEN code WHEN regexp_matches(l, {quoted(ALONE)}) OR max(j) OVER (PARTITION BY x.rid ORDER BY x.i) >= x.i THEN '' ELSE '?' END AS sign FROM x LEFT JOIN h ON h.rid = x.rid AND h.i = x.i),
q AS (SELECT rid, regexp_replace(string_agg(sign, '' ORDER BY i), '[?]+', '?', 'g') AS s FROM g GROUP BY rid),
t0 AS (SELECT doc_id, n_sentences, coalesce(s, '') AS s0 FROM d LEFT JOIN q USING (rid)),
{', '.join(steps)}
SELECT doc_id, n_sentences, length(regexp_replace(s0, '[^<]', '', 'g'))::BIGINT AS n_known, s0 AS sequence,
  coalesce(array_to_string({changed(0)}, ','), '') AS rules,
  coalesce(array_to_string(list_filter({order}, lambda l: list_contains({changed(1)}, l)), ','), '') AS licenses
FROM t{len(RULES)}"""

"""License scans: sentences are mapped to the identifiers of known licence sentences, their sequence to licence rules.

Only DataFrame functions are used: a row stays where it is, and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.llm.common import table

#: Known sentences, in normalised form (lower case, runs of other characters than letters and digits as one space).
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-later": "either version 3 of the license or at your option any later version",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "lgpl21-later": "either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl3-notice": "this work is licensed under the gnu lesser general public license version 3",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-notice": "licensed under cc by nc sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "this work is dedicated to the public domain under cc0 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
}

#: Ordered rules: a run of identifiers, in this order and without others between, names a licence. What a rule has matched
#: no later rule sees, so long runs come before the sentences that they contain.
RULES = (
    ("MIT", ("mit-notice", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice-2", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later", "lgpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl3-later", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl3-later")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl3-later", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl3-later")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-2",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense-free",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
)

#: Sentences that real notices run together, and the rules for them, which come after those above.
_LATER = (("gpl", "3", "gpl", "GPL-3.0"), ("gpl", "2", "gpl", "GPL-2.0"), ("lgpl", "21", "lgpl", "LGPL-2.1"), ("lgpl", "3", "lgpl", "LGPL-3.0"), ("agpl", "3", "gpl", "AGPL-3.0"))
JOINED = {f"{kind}{v}-free-later": f"{SENTENCES[f'{kind}-free']} {SENTENCES['lgpl21-later' if v == '21' else f'gpl{v}-later']}" for kind, v, _, _ in _LATER}
JOINED_RULES = tuple((f"{name}-or-later", (f"{kind}{v}-free-later", *hope)) for kind, v, by, name in _LATER for hope in ((f"{by}-hope",), ()))

# Licences as notices call them: name, version ("" for none) and SPDX identifier.
NAMED = (
    ("mit license", "", "MIT"), ("isc license", "", "ISC"), ("zlib license", "", "Zlib"), ("postgresql license", "", "PostgreSQL"), ("microsoft public license", "", "MS-PL"),
    ("bsd 2 clause license", "", "BSD-2-Clause"), ("simplified bsd license", "", "BSD-2-Clause"), ("bsd 3 clause license", "", "BSD-3-Clause"), ("new bsd license", "", "BSD-3-Clause"),
    ("apache license", "2 0", "Apache-2.0"), ("mozilla public license", "2 0", "MPL-2.0"), ("eclipse public license", "1 0", "EPL-1.0"), ("eclipse public license", "2 0", "EPL-2.0"),
    ("gnu general public license", "2", "GPL-2.0-only"), ("gnu general public license", "3", "GPL-3.0-only"), ("gnu lesser general public license", "2 1", "LGPL-2.1-only"),
    ("gnu lesser general public license", "3", "LGPL-3.0-only"), ("gnu affero general public license", "3", "AGPL-3.0-only"), ("boost software license", "1 0", "BSL-1.0"),
    ("artistic license", "2 0", "Artistic-2.0"), ("academic free license", "3 0", "AFL-3.0"), ("sil open font license", "1 1", "OFL-1.1"), ("european union public licence", "1 2", "EUPL-1.2"),
    ("common development and distribution license", "1 0", "CDDL-1.0"), ("blue oak model license", "1 0 0", "BlueOak-1.0.0"), ("university of illinois ncsa open source license", "", "NCSA"),
)
# Further SPDX identifiers that may stand in an identifier line.
SPDX = (
    "0BSD", "BSD-1-Clause", "BSD-2-Clause-Patent", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-1.1", "MIT-0", "ODbL-1.0", "PSF-2.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11",
)


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Names in their spellings, and identifier lines; either is the sentence `name-<identifier>`. A name stands by itself or after LEAD.
TITLES = {spelled: name for base, v, name in NAMED for spelled in ([base] if not v else [f"{base} {form}{v}" for form in ("", "v", "v ", "version ")])}
LINES = {f"spdx license identifier {_normal(name)}": name for name in (*SPDX, *dict.fromkeys(n for _, _, n in NAMED))}
LINES = {line: name for line, name in LINES.items() if line not in SENTENCES.values()}
LEAD = "(?:this (?:project|software|work|code|program|file|library|package|repository) is )?(?:licensed|released|distributed|published|available) under (?:the terms of )?(?:the |a |an )?"
NAME_RULES = tuple((name, (f"name-{name.lower()}",)) for name in dict.fromkeys((*TITLES.values(), *LINES.values())))

#: A line feed ends a sentence, and a stop does where white space or the end follows it.
BREAK = r"\n|[.!?;:]+(?:[ \t\r\n]|$)"


def _looked_up(sentence: Column, known: list[tuple[str, str]]) -> Column:
    """The identifier of a sentence, null for others."""
    places, names = (F.array(*map(F.lit, column)) for column in zip(*known))
    return F.get(names, (F.array_position(places, sentence) - 1).cast("int"))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of docs with license_sentences (identifiers in text order), licenses (one for each matched rule, in the order of
    the rules, without repeats) and licensed, which replace columns of these names.

    Null and empty texts, and texts without a known sentence, get empty lists and false. An empty table gives an empty one.
    """
    new = ("license_sentences", "licenses", "licensed")
    table_of = [(sentence, id_) for id_, sentence in (*SENTENCES.items(), *JOINED.items())]
    named = [(spelled, f"name-{name.lower()}") for spelled, name in (*TITLES.items(), *LINES.items())]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = F.transform(F.split(text, BREAK), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    # "|" stands at each break: a known sentence starts and ends at one, and may be wrapped or stopped at others within.
    marked = F.concat(F.lit("|"), F.array_join(F.filter(plain, lambda s: s != ""), "|"), F.lit("|"))
    longest = lambda found: "|".join(sorted(found, key=len, reverse=True))
    wrapped = f"{longest(k for k, _ in table_of)}|(?:{LEAD})?(?:{longest(TITLES)})|{longest(LINES)}".replace(" ", "[ |]")
    hits = F.transform(F.regexp_extract_all(marked, F.lit(f"(?<=\\|)(?:{wrapped})(?=\\|)"), F.lit(0)), lambda s: F.translate(s, "|", " "))
    found = F.transform(hits, lambda s: F.coalesce(_looked_up(s, table_of), _looked_up(F.regexp_replace(s, f"^{LEAD}", ""), named)))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f";{';;'.join(run)};").alias("run")) for name, run in (*RULES, *JOINED_RULES, *NAME_RULES)])
    # Each identifier is held as ";id;", so that neighbours share no mark and runs cannot overlap.
    held = F.concat(F.lit(";"), F.array_join(F.col("license_sentences"), ";;"), F.lit(";"))
    start = F.struct(held.alias("s"), F.array().cast("array<string>").alias("out"))
    matched = F.aggregate(
        rules,
        start,
        lambda acc, r: F.when(F.contains(acc["s"], r["run"]), F.struct(F.replace(acc["s"], r["run"], F.lit("|")).alias("s"), F.array_union(acc["out"], F.array(r["name"])).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    own = docs.select(*[c for c in docs.columns if c not in new], found.alias("license_sentences"))
    empty = F.array().cast("array<string>")
    return own.withColumn("licenses", F.when(F.size("license_sentences") > 0, matched).otherwise(empty)).withColumn("licensed", F.size("licenses") > 0)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("license_sentences", ",").alias("license_sentences"), F.array_join("licenses", ",").alias("licenses"), "licensed")


def _oracle() -> str:
    pairs = lambda found: ", ".join(f"('{id_}', '{sentence}')" for sentence, id_ in found)
    values = pairs((sentence, id_) for id_, sentence in SENTENCES.items())
    named = pairs((spelled, f"name-{name.lower()}") for spelled, name in (*TITLES.items(), *LINES.items()))
    steps, last = [], "s0"
    for k, (name, run) in enumerate((*RULES, *NAME_RULES), 1):
        seq = f";{';;'.join(run)};"
        steps.append(f"s{k} AS (SELECT doc_id, ids, replace(s, '{seq}', '|') AS s, CASE WHEN contains(s, '{seq}') AND NOT list_contains(out, '{name}') THEN list_append(out, '{name}') ELSE out END AS out FROM {last})")
        last = f"s{k}"
    return f"""
WITH known(id, sentence) AS (VALUES {values}),
named(id, sentence) AS (VALUES {named}),
m AS (SELECT map(list(sentence), list(id)) AS of FROM known),
n AS (SELECT map(list(sentence), list(id)) AS titles FROM named),
p AS (
  SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\\n|[.!?;:]+(?:[ \\t\\r\\n]|$)'),
                                lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS parts
  FROM documents
),
i AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: coalesce(of[x], titles[regexp_replace(x, '^{LEAD}', '')])), lambda x: x IS NOT NULL) AS ids FROM p, m, n),
s0 AS (SELECT doc_id, ids, ';' || array_to_string(ids, ';;') || ';' AS s, CAST([] AS VARCHAR[]) AS out FROM i),
{', '.join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS license_sentences, array_to_string(out, ',') AS licenses, len(out) > 0 AS licensed FROM {last}
"""


OP9_SQL = _oracle()

"""Licence recognition by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences; the sequence of
identifiers of a document is then matched against ordered rules, each naming a licence.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, text_or_empty

# Ways to write a licence's name, normalised.
NAMES = {
    "MIT": ("mit license", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "ISC": ("isc license", "isc"),
    "Zlib": ("zlib license", "zlib"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl 2 0", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl 3 0", "gpl v3", "gplv3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl v2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgpl v3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agpl v3"),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal license"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
}
# Sentences around a name.
FRAMES = (
    "licensed under {}",
    "licensed under the {}",
    "released under the {}",
    "distributed under the {}",
    "available under the {}",
    "this work is licensed under the {}",
    "this work is licensed under a {}",
    "this file is licensed under the {}",
    "this code is licensed under the {}",
    "this project is licensed under the {}",
    "this software is licensed under the {}",
    "this software is released under the {}",
    "this program is licensed under the {}",
    "licensed under the terms of the {}",
    "released under the terms of the {}",
    "distributed under the terms of the {}",
    "available under the terms of the {}",
    "this project is released under the {}",
    "this project is released under the terms of the {}",
    "this project is licensed under the terms of the {}",
    "this software is licensed under the terms of the {}",
    "this software is released under the terms of the {}",
    "this software is distributed under the {}",
    "this software is distributed under the terms of the {}",
    "this program is distributed under the terms of the {}",
    "this work is released under the {}",
    "this package is licensed under the {}",
    "this library is licensed under the {}",
    "this code is released under the {}",
    "spdx license identifier {}",
)
# Sentences around a choice of two names.
CHOICES = (
    "licensed under either of {} or {}",
    "licensed under either of {} or {} at your option",
    "licensed under either the {} or the {}",
    "licensed under either the {} or the {} at your option",
    "dual licensed under the {} and the {}",
    "dual licensed under the {} or the {}",
    "dual licensed under {} and {}",
    "dual licensed under {} or {}",
)
# Sentences of licence texts and notices, normalised.
SENTENCES = {
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache.grant": "licensed under the apache license version 2 0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.obtain": "you may obtain a copy of the license at",
    "gpl.grant2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.grant3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.grant": "this is free and unencumbered software released into the public domain",
    "mpl.grant": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "agpl.grant3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.grant21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl.grant3": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.only2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl.grant": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "apache.head": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl.head2": "gnu general public license version 2 june 1991",
    "gpl.head3": "gnu general public license version 3 29 june 2007",
    "lgpl.head21": "gnu lesser general public license version 2 1 february 1999",
    "lgpl.head3": "gnu lesser general public license version 3 29 june 2007",
    "agpl.head3": "gnu affero general public license version 3 19 november 2007",
}
# Other wordings of these sentences, normalised.
WORDINGS = {
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgment": "bsd.advert",
    "apache license version 2 0 january 2004 https www apache org licenses": "apache.head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl.grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl.grant3",
}
# A sentence with a name in it: what it begins with, its pattern, and the known sentence it stands for.
HOLDER = ("neither the name", "^neither the names? of .+ nor the names? of (its|the|their|any) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used")
# Identifier sequences and the licence each names. Earlier rules go first; what
# one has matched is used up.
RULES = (
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.endorse")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", ("apache.grant", "apache.comply", "apache.obtain")),
    ("Apache-2.0", ("apache.grant", "apache.comply")),
    ("GPL-2.0-or-later", ("gpl.grant2", "gpl.hope")),
    ("GPL-3.0-or-later", ("gpl.grant3", "gpl.hope")),
    ("GPL-2.0-or-later", ("gpl.grant2",)),
    ("GPL-3.0-or-later", ("gpl.grant3",)),
    ("Apache-2.0", ("apache.grant",)),
    ("ISC", ("isc.grant",)),
    ("Unlicense", ("unlicense.grant",)),
    ("MPL-2.0", ("mpl.grant",)),
    ("AGPL-3.0-or-later", ("agpl.grant3", "gpl.hope")),
    ("AGPL-3.0-or-later", ("agpl.grant3",)),
    ("LGPL-2.1-or-later", ("lgpl.grant21", "lgpl.hope")),
    ("LGPL-2.1-or-later", ("lgpl.grant21",)),
    ("LGPL-3.0-or-later", ("lgpl.grant3", "lgpl.hope")),
    ("LGPL-3.0-or-later", ("lgpl.grant3", "gpl.hope")),
    ("LGPL-3.0-or-later", ("lgpl.grant3",)),
    ("GPL-2.0-only", ("gpl.only2", "gpl.hope")),
    ("GPL-2.0-only", ("gpl.only2",)),
    ("Zlib", ("zlib.warranty", "zlib.grant")),
    ("Zlib", ("zlib.grant",)),
    ("BSL-1.0", ("bsl.grant",)),
    ("EPL-2.0", ("epl.grant",)),
    ("Apache-2.0", ("apache.head",)),
    ("GPL-2.0", ("gpl.head2",)),
    ("GPL-3.0", ("gpl.head3",)),
    ("LGPL-2.1", ("lgpl.head21",)),
    ("LGPL-3.0", ("lgpl.head3",)),
    ("AGPL-3.0", ("agpl.head3",)),
    *((name, (f"names.{name}",)) for name in NAMES),
)


def forms_of(name: str) -> list[str]:
    """Ways to write a name, with "license" behind those that lack the word."""
    return [*NAMES[name], *(f"{form} license" for form in NAMES[name] if "license" not in f"{form} license".split()[:-1])]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier, or identifiers joined by >< for a choice of licences."""
    known = {frame.format(form): f"names.{name}" for name in NAMES for form in forms_of(name) for frame in FRAMES}
    for one, two in itertools.permutations(("MIT", "Apache-2.0"), 2):
        for frame, a, b in itertools.product(CHOICES, forms_of(one), forms_of(two)):
            known[frame.format(a, b)] = f"names.{one}><names.{two}"
    return {**known, **{text: name for name, text in SENTENCES.items()}, **WORDINGS}


# Comment marks at the start of a line say nothing; sentences end at . ! ? ; : with white space.
MARKS = r"(?m)^[ \t]*(?:[#*;]+|//+|--+|/\*+|\*/|<!--)[ \t]*"
# A copyright line names people and stands between sentences; the colon of a tag ends none.
NOTICES = r"(?im)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
TAG = r"(?i)(SPDX-License-Identifier):"
ENDS = r"[.!?;:][\x09-\x0D\x20]+|[.!?;:]$"


PARAGRAPH = r"\n[ \t\r]*\n\s*"


def _normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(sentence), "licence", "license"), "[^a-z0-9]+", " ")
    plain = F.trim(plain)
    return F.when(F.startswith(plain, F.lit(HOLDER[0])), F.regexp_replace(plain, *HOLDER[1:])).otherwise(plain)


# A sentence of the splitter ends within these sentences: their parts between the marks that
# some standard text has there (; : or the point of "v."). Another text may have a comma instead.
GRANT = ("this program is free software", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation")
PARTS = {
    "gpl.grant2": (*GRANT, "either version 2 of the license or at your option any later version"),
    "gpl.grant3": (*GRANT, "either version 3 of the license or at your option any later version"),
    "gpl.hope": (
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "mpl.grant": ("this source code form is subject to the terms of the mozilla public license v", "2 0"),
    "agpl.grant3": (GRANT[0], GRANT[1].replace("gnu", "gnu affero"), "either version 3 of the license or at your option any later version"),
    "lgpl.grant21": ("this library is free software", GRANT[1].replace("gnu", "gnu lesser"), "either version 2 1 of the license or at your option any later version"),
    "lgpl.grant3": (GRANT[0], GRANT[1].replace("gnu", "gnu lesser"), "either version 3 of the license or at your option any later version"),
    "lgpl.hope": (
        "this library is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gpl.only2": (GRANT[0], GRANT[1].replace("license", "license version 2")),
}
# Other wordings in parts.
PART_WORDINGS = (
    ("lgpl.grant3", ("this library is free software", GRANT[1].replace("gnu", "gnu lesser"), "either version 3 of the license or at your option any later version")),
)
# Names with a suffix of SPDX; the bare name tells nothing of later versions.
SUFFIXED = {
    f"{name}-{suffix}": f"{name} {suffix}".lower().replace("-", " ").replace(".", " ")
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
    for suffix in ("only", "or-later")
}
ALL_RULES = (*RULES, *((name, (f"names.{name}",)) for name in SUFFIXED))
SPDX = "spdx license identifier "
# As NOTICES, but a line of a licence's text may begin with "copyright notice" or "copyright holder".
NAMED_NOTICES = r"(?im)^[ \t]*(?:copyright(?![ \t]+(?:notice|holder|owner)s?\b(?!:))|\(c\)|©)[^\n]*$"
PLUS = r"(?i)\b([AL]?GPL-[0-9.]*[0-9])\+"


def cut_sentences() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Pieces of known sentences with their marks, and the runs of marks that are a whole sentence."""
    pieces: dict[str, str] = {}
    runs = []
    for name, parts in (*PARTS.items(), *PART_WORDINGS):
        for cuts in itertools.product((True, False), repeat=len(parts) - 1):
            if not any(cuts):
                continue
            joined = [parts[0]]
            for cut, part in zip(cuts, parts[1:]):
                joined = [*joined, part] if cut else [*joined[:-1], f"{joined[-1]} {part}"]
            runs.append(("".join(pieces.setdefault(x, f"<?{len(pieces)}>") for x in joined), f"<{name}>"))
    return pieces, runs


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id and ``ids``, the identifiers of known sentences in order, as a line of <..>.

    A sentence is known where it is read on over its line breaks, or else where one of its lines
    is known alone. Neighbouring pieces of a known sentence count as that sentence, other pieces
    not at all. A tag of SPDX gives each name of its expression.
    """
    pieces, runs = cut_sentences()
    known = {s: f"<{name}>" for s, name in known_sentences().items()}
    known |= {frame.format(form): f"<names.{name}>" for name, form in SUFFIXED.items() for frame in FRAMES}
    known |= pieces
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def tags(line: Column) -> Column:
        names = F.split(F.replace(F.substr(line, F.lit(len(SPDX) + 1)), F.lit(" or later"), F.lit(" or-later")), " (?:or|and|with) ")
        apart = F.transform(names, lambda x: F.concat(F.lit(SPDX), F.replace(x, F.lit("or-later"), F.lit("or later"))))
        return F.when(F.startswith(line, F.lit(SPDX)), apart).otherwise(F.array(line))

    plain = F.regexp_replace(F.regexp_replace(text_or_empty(), MARKS, ""), NAMED_NOTICES, ".")
    later = F.when(F.contains(F.lower(plain), F.lit("spdx")), F.regexp_replace(plain, PLUS, "$1-or-later")).otherwise(plain)
    text = F.regexp_replace(F.regexp_replace(later, TAG, "$1"), PARAGRAPH, " . ")
    read = F.transform(
        F.split(text, ENDS),
        lambda x: F.struct(
            _normalised(x).alias("s"),
            F.when(F.rlike(x, F.lit("[\r\n]")), F.transform(F.split(x, "[\r\n]+"), _normalised)).alias("lines"),
        ),
    )
    # The set test is a hash look-up; only its few hits are looked up in the map.
    sentences = F.flatten(
        F.transform(
            read,
            lambda x: F.when(x["s"].isin(list(known)), F.array(x["s"]))
            .when(x["lines"].isNull(), tags(x["s"]))
            .otherwise(F.flatten(F.transform(x["lines"], tags))),
        )
    )
    marks = F.transform(sentences, lambda s: F.when(s.isin(list(known)), F.element_at(table, s)).otherwise("~"))
    whole = F.col("ids")
    for run, name in runs:
        whole = F.replace(whole, F.lit(run), F.lit(name))
    whole = F.when(F.contains("ids", F.lit("<?")), F.regexp_replace(whole, "<[?][0-9]+>", "")).otherwise(F.col("ids"))
    return docs.select("doc_id", F.array_join(marks, "").alias("ids")).select("doc_id", F.replace(whole, F.lit("~"), F.lit("")).alias("ids"))


def scan(docs: DataFrame, rules=ALL_RULES) -> DataFrame:
    """doc_id, n_known, licenses (names joined by commas, in the order of the rules), n_matches, unmatched.

    Sentences are read over line breaks and line by line, and what either finds counts once. Rules are applied
    in their order to the sequence of identifiers; what a rule matches is taken out of it, each
    match counts, and ``unmatched`` holds what no rule took. A text without a known sentence
    (null and empty ones too) has no licence. One row per row of ``docs``, in one narrow
    projection; columns other than ``doc_id`` and ``text`` are not looked at.
    """

    def number(c: str) -> Column:
        return F.length(c) - F.length(F.translate(c, "<", ""))

    read = identifiers(docs)
    patterns = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("p"), F.lit(name).alias("name")) for name, ids in rules])
    start = F.struct(F.col("ids").alias("rest"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("n"))

    def apply(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["rest"], rule["p"], F.lit("#"))
        hits = (F.length(rest) - F.length(F.translate(rest, "#", ""))) - (F.length(acc["rest"]) - F.length(F.translate(acc["rest"], "#", "")))
        return F.when(F.contains(acc["rest"], rule["p"]), F.struct(rest.alias("rest"), F.array_append(acc["names"], rule["name"]).alias("names"), (acc["n"] + hits).alias("n"))).otherwise(acc)

    # Most texts hold no known sentence and skip the fold.
    found = F.when(F.col("ids") == "", start).otherwise(F.aggregate(patterns, start, apply))
    return read.select("doc_id", "ids", found.alias("f")).select(
        "doc_id",
        number("ids").cast("long").alias("n_known"),
        F.array_join(F.array_distinct("f.names"), ",").alias("licenses"),
        F.col("f.n").cast("long").alias("n_matches"),
        F.translate("f.rest", "#", "").alias("unmatched"),
    )


def _sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in known_sentences().items())
    plain = f"regexp_replace(regexp_replace(coalesce(text, ''), '{MARKS}', '', 'g'), '{NOTICES}', '.', 'g')"
    steps, before = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        p = "".join(f"<{i}>" for i in ids)
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, replace(rest, '{p}', '#') AS rest, "
            f"CASE WHEN contains(rest, '{p}') THEN list_append(names, '{name}') ELSE names END AS names FROM {before})"
        )
        before = f"r{k}"

    def reading(name: str, sub: str) -> str:
        return f"""
{name}_s AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM
     (SELECT doc_id, regexp_split_to_array({sub}, '{ENDS}') AS p FROM bare)),
{name}_n AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(regexp_replace(lower(x), 'licence', 'license', 'g'), '[^a-z0-9]+', ' ', 'g')), '{HOLDER[1]}', '{HOLDER[2]}') AS s FROM {name}_s),
{name} AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY i) AS ids FROM {name}_n JOIN known USING (s) GROUP BY doc_id)"""

    return f"""
WITH known(s, id) AS (VALUES {known}),
bare AS (SELECT doc_id, regexp_replace({plain}, '{TAG}', '\\1', 'g') AS t FROM documents),
{reading('by_line', "regexp_replace(t, '[\\r\\n]+', ' . ', 'g')")},
{reading('wrapped', f"regexp_replace(regexp_replace(t, '{PARAGRAPH}', ' . ', 'g'), '[\\r\\n]+', ' ', 'g')")},
r0 AS (SELECT doc_id, ids, ids AS rest, CAST([] AS VARCHAR[]) AS names FROM (SELECT d.doc_id,
     coalesce(CASE WHEN coalesce(w.n, 0) > coalesce(l.n, 0) THEN w.ids ELSE l.ids END, '') AS ids
     FROM documents d LEFT JOIN by_line l ON l.doc_id = d.doc_id LEFT JOIN wrapped w ON w.doc_id = d.doc_id)),
{', '.join(steps)}
SELECT doc_id, CAST(length(ids) - length(replace(ids, '<', '')) AS BIGINT) AS n_known,
       (SELECT coalesce(string_agg(x, ',' ORDER BY i), '') FROM (SELECT x, min(i) AS i FROM (SELECT unnest(names) AS x, unnest(range(len(names))) AS i) GROUP BY x)) AS licenses,
       CAST(length(rest) - length(replace(rest, '#', '')) AS BIGINT) AS n_matches, replace(rest, '#', '') AS unmatched FROM {before}"""


@register("op1_license_sentences", _sql())
def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

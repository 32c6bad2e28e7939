from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.llm.licenses import FRAMES, NAMES, PARTS, SENTENCES, forms_of, identifiers, scan

MIT = """\
# Copyright (c) 2020 Somebody
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""
APACHE = """\
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
"""


def test_rules(make):
    texts = [
        None,
        "",
        "Some text. No licence here.",
        "Words. Released under the MIT License.\nMore words.",
        "THIS WORK IS LICENSED UNDER THE GNU General Public Licence, version 3.",
        MIT,
        APACHE + "code\n" + MIT,
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        "you may not use this file except in compliance with the License.",
        "// SPDX-License-Identifier: Apache-2.0",
        "word " * 50_000 + "\nLicensed under the MPL 2.0.",
    ]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = make(rows).withColumn("ids", F.lit("clash")).withColumn("licenses", F.lit(1))
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["unmatched"]) for r in scan(docs).collect()}
    assert scan(docs).count() == len(rows)
    assert got == {
        0: ("", 0, ""),
        1: ("", 0, ""),
        2: ("", 0, ""),
        3: ("MIT", 1, ""),
        4: ("GPL-3.0", 1, ""),
        5: ("MIT", 1, ""),
        6: ("MIT,Apache-2.0", 2, ""),
        7: ("CC-BY-NC-4.0", 2, ""),
        8: ("", 0, "<apache.comply>"),
        9: ("Apache-2.0", 1, ""),
        10: ("MPL-2.0", 1, ""),
    }
    assert scan(make([])).collect() == []


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.")
    lines += ("This work is licensed under the GNU General Public License, version 3.",)
    want = {r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in lines)}
    assert {r["doc_id"] for r in scan(docs).where("n_matches > 0").collect()} == want and want


GPL = """\
 * This program is free software{a} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{b} either version {v} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""
ORIGINAL = {
    "mit.grant": MIT.split("\n#\n")[1],
    "mit.notice": MIT.split("\n#\n")[2],
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT',
    "bsd.grant": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "bsd.source": "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "bsd.binary": "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "bsd.endorse": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "apache.grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.obtain": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "gpl.grant2": GPL.format(a=";", b=";", v=2).split(" *\n")[0],
    "gpl.grant3": GPL.format(a=":", b=",", v=3).split(" *\n")[0],
    "gpl.hope": GPL.split(" *\n")[1],
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "unlicense.grant": "This is free and unencumbered software released into the public domain.",
    "mpl.grant": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file",
}


GNU = """\
This {what} is free software{a} you can redistribute it and/or
modify it under the terms of the GNU {which} General Public License as
published by the Free Software Foundation{b} either version {v} of the
License, or (at your option) any later version."""
ORIGINAL |= {
    "bsd.advert": "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n     This product includes software developed by the Example Group.",
    "agpl.grant3": GNU.format(what="program", a=":", which="Affero", b=",", v=3),
    "lgpl.grant21": GNU.format(what="library", a=";", which="Lesser", b=";", v="2.1"),
    "lgpl.grant3": GNU.format(what="program", a=":", which="Lesser", b=",", v=3),
    "lgpl.hope": GPL.split(" *\n")[1].replace("program", "library"),
    "gpl.only2": "// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License version 2 as\n// published by the Free Software Foundation.",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "bsl.grant": 'Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:',
    "epl.grant": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nSome words",
    "apache.head": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS",
    "gpl.head2": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989",
    "gpl.head3": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright",
    "lgpl.head21": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n\nCopyright",
    "lgpl.head3": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright",
    "agpl.head3": "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n\nCopyright",
}


def test_every_sentence_in_its_punctuation(make):
    assert ORIGINAL.keys() == SENTENCES.keys()
    assert {name: " ".join(parts) for name, parts in PARTS.items()} == {name: SENTENCES[name] for name in PARTS}
    rows = list(enumerate(ORIGINAL.values()))
    got = {r["doc_id"]: r["ids"] for r in identifiers(make(rows)).collect()}
    assert got == {i: f"<{name}>" for i, name in enumerate(ORIGINAL)}


def test_notices_tags_and_both_readings(make):
    tag = "# SPDX-License-Identifier: "
    texts = {
        GPL.format(a=";", b=";", v=2): "GPL-2.0-or-later",
        GPL.format(a=":", b=",", v=3): "GPL-3.0-or-later",
        GPL.format(a=",", b=",", v=3): "GPL-3.0-or-later",
        "A title\n" + GPL.format(a=";", b=";", v=2): "GPL-2.0-or-later",
        ORIGINAL["mpl.grant"]: "MPL-2.0",
        "This program is free software; it is. You can redistribute it. 2.0. Without": "",
        "This program is free software; really. " + GPL.split("software{a} ")[1].format(b=";", v=2).split(" *\n")[0]: "",
        tag + "GPL-3.0-or-later": "GPL-3.0-or-later",
        tag + "GPL-2.0-only\ncode": "GPL-2.0-only",
        tag + "LGPL-2.1+": "LGPL-2.1-or-later",
        tag + "MIT OR Apache-2.0\nimport os": "MIT,Apache-2.0",
        "/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Linux-syscall-note) AND MIT */": "MIT,GPL-2.0-or-later",
        tag + "MIT is not meant": "",
        tag + "MIT\n" + APACHE: "Apache-2.0,MIT",
        "Licensed under the MIT License\nand more\n\n" + ORIGINAL["unlicense.grant"]: "Unlicense,MIT",
        "Released under\nthe MIT License. Some line\nLicensed under the MPL 2.0\nand another": "MIT,MPL-2.0",
    }
    got = {r["doc_id"]: r["licenses"] for r in scan(make(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(texts.values()))


def test_holders_advertising_and_choices(make):
    bsd = "\n".join(ORIGINAL[f"bsd.{part}"] for part in ("grant", "source", "binary"))
    endorse = ORIGINAL["bsd.endorse"]
    tail = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"
    texts = {
        bsd + tail: "BSD-2-Clause",
        f"{bsd}\n{endorse}{tail}": "BSD-3-Clause",
        f"{bsd}\n{endorse.replace('copyright holder', '<organization>')}{tail}": "BSD-3-Clause",
        f"{bsd}\n{endorse.replace('the copyright holder', 'Example, Inc')}{tail}": "BSD-3-Clause",
        f"{bsd}\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.{tail}": "BSD-3-Clause",
        f"{bsd}\n{ORIGINAL['bsd.advert']}\n{endorse.replace('3.', '4.').replace('copyright holder', 'University')}{tail}": "BSD-4-Clause",
        f"{bsd}\n{ORIGINAL['bsd.advert']}{tail}": "BSD-4-Clause",
        "Neither the name of the ship nor the names of its sailors are known.": "",
        ORIGINAL["agpl.grant3"] + "\n\n" + ORIGINAL["gpl.hope"]: "AGPL-3.0-or-later",
        ORIGINAL["lgpl.grant21"] + "\n\n" + ORIGINAL["lgpl.hope"]: "LGPL-2.1-or-later",
        ORIGINAL["lgpl.grant3"]: "LGPL-3.0-or-later",
        ORIGINAL["lgpl.grant3"].replace("This program", "This library"): "LGPL-3.0-or-later",
        ORIGINAL["gpl.only2"]: "GPL-2.0-only",
        ORIGINAL["zlib.warranty"] + " arising from the use of this software.\n\n" + ORIGINAL["zlib.grant"]: "Zlib",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + ORIGINAL["bsl.grant"]: "BSL-1.0",
        ORIGINAL["apache.head"] + "\nand so on\n\n" + APACHE: "Apache-2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "MIT,Apache-2.0",
        "This project is licensed under the GPL-3.0 license.": "GPL-3.0",
        "Released under the terms of the MIT license.": "MIT",
    }
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["licenses"] for r in scan(make(rows)).collect()}
    assert got == dict(enumerate(texts.values()))


def test_every_name_in_every_frame(make):
    want, rows = {}, []
    for name in NAMES:
        for form in forms_of(name):
            text = ".\n".join(frame.format(form) for frame in FRAMES)
            want[len(rows)] = (name, len(FRAMES))
            rows.append((len(rows), f"{text}."))
    assert {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in scan(make(rows)).collect()} == want

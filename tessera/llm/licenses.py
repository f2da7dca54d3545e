"""Licence scan by sentence rules, with built-in functions only.

1. *Sentences.*  A text is lower-cased and cut at sentence ends (``. ! ? ; :``
   before white space or the end), at blank lines and before a line that starts
   with a capitalised word; everything that is not a letter or a digit becomes
   one blank.  Other line ends count as blanks, so wrapped licence texts keep
   their sentences.  An ``SPDX-License-Identifier`` line is cut into one sentence per
   identifier of its expression.
2. *Identifiers.*  Known licence texts are cut like documents, and before every
   capitalised word, as a wrapped line may start with it.  Each piece has an
   identifier, and every run of neighbouring pieces, which is what a spelling
   without some of the cuts leaves, is a known sentence that maps to the
   identifiers of its pieces (a constant of fixed size; a hash set finds the
   candidates).  A piece of one word has an identifier only if it tells licences
   apart, or in the name of a notice, where it is not known alone.  A known sentence with a hole (the
   name of a holder) is known by what stands before and behind the hole.
3. *Rules.*  A licence rule is an ordered list of identifiers.  It matches where
   its identifiers follow each other among the document's known sentences, whatever
   unknown sentences stand between them; a match inside a longer matching rule does
   not count.

The scan is one pass without a shuffle: its memory is that of a text.

Defined cases: a null or empty text has no sentences and no licences; very long
texts are scanned whole; a sentence repeated in a document is listed as often
as it stands there, a licence once; repeated rows are each reported; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty

LINE = r"\n[ \t]*(\p{Lu}\p{Ll})"
END = r"[.!?;:]+([ \t\n\x0b\f\r]|\z)|\r?\n[ \t\r]*\n"
OTHER = r"[^\p{L}\p{N}\x01]+"
#: What introduces an SPDX line, and what stands between the identifiers of its expression.
SPDX_MARK = "SPDX-License-Identifier:"
SPDX_JOIN = r"[ \t)]+(OR|AND|WITH|or|and|with)[ \t(]+"
#: Where a known text may be cut: at sentence ends, and before capitalised words, as a line may start with one.
CUT = re.compile(r"[.!?;:]+\s+|\n\s*\n|(?<=\s)(?=[A-Z][a-z])")
#: Where a name may be cut: before the words that are written capitalised (not before acronyms).
NAME_CUT = re.compile(r"(?:^|(?<= ))(?=(?:apache|license|licence|version|general|public|lesser|affero|mozilla|simplified|new|unlicense|"
                      r"universal|creative|commons|attribution|sharealike|noncommercial|noderivatives|international)\b)")

# The names under which licences are cited, already normalised.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit licence", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl 2 0"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl 3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgplv3", "lgpl 3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agplv3", "agpl 3 0"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "ISC": ["isc license"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"],
    "EUPL-1.2": ["eupl version 1 2", "eupl 1 2"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons cc0 1 0 universal"],
}
# The Creative Commons licences and their versions.
CC_KINDS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives",
            "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"4.0": "4 0 international", "3.0": "3 0 unported", "2.5": "2 5 generic", "2.0": "2 0 generic"}
NAMES |= {f"CC-{kind}-{v}": [f"cc {kind.lower().replace('-', ' ')} {v.replace('.', ' ')}", f"creative commons {words} {version} license",
                             f"creative commons {words} {v.replace('.', ' ')} license"]
          for kind, words in CC_KINDS.items() for v, version in CC_VERSIONS.items()}
# Identifiers of licences that are cited in SPDX lines, besides the names above.
SPDX = ["GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.0", "0BSD",
        "BSD-4-Clause", "BSD-1-Clause", "MIT-0", "X11", "curl", "Python-2.0", "PSF-2.0", "Ruby", "PHP-3.01", "PostgreSQL", "NCSA", "OpenSSL",
        "OLDAP-2.8", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "MPL-1.1", "MPL-1.0", "MS-PL", "MS-RL", "EUPL-1.1", "Apache-1.1", "AFL-3.0", "OSL-3.0",
        "Unicode-3.0", "WTFPL", "BlueOak-1.0.0", "UPL-1.0", "Vim", "W3C", "ODbL-1.0", "CC-PDDC", "MulanPSL-2.0", "Artistic-1.0", "IPL-1.0", "TCL"]

# How a notice cites a licence; the beginning of such a sentence becomes the word "cited".
NOTICE = ("^(this (work|software|project|file|font software|code) is )?(licensed|released|distributed|published|available) under"
          "( the| a| an)?( |$)")

# Sentences of licence texts, by identifier.
SENTENCES: dict[str, str] = {
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
             "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
             "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software",
    "mit-3": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-1": "you may not use this file except in compliance with the License",
    "apache-2": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache-3": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd-0": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met",
    "bsd-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
             "disclaimer",
    "bsd-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
             "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission",
    "gpl-w1": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-w2": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
             "provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit0-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
              "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
              "permit persons to whom the Software is furnished to do so",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "apache-2s": "You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3a": "The name of the author may not be used to endorse or promote products derived from this software without specific "
              "prior written permission",
    "bsd-ad": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "zlib-1": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
              "it and redistribute it freely, subject to the following restrictions",
    "zlib-2": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
             "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
             "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
             "Software is furnished to do so, all subject to the following",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
             "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
             "available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-11": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
              "file except in compliance with the License",
    "cddl-1": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "cc0-1": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
             "software to the public domain worldwide",
    "artistic-1": "This is free software, licensed under:\n\nThe Artistic License 2.0 (GPL Compatible)",
}
# The notices of the GNU licences, by licence and version.
GNU = {"GPL": ("GNU General Public License", ["2", "3"]), "LGPL": ("GNU Lesser General Public License", ["2.1", "3"]),
       "LGPL-2.0": ("GNU Library General Public License", ["2"]), "AGPL": ("GNU Affero General Public License", ["3"])}
GNU_START = "you can redistribute it and/or modify it under the terms of the {name}"
GNU_ANY = [" as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version"]
GNU_ONLY = [" as published by the Free Software Foundation; version {v} of the License", " as published by the Free Software Foundation; version {v}",
            " version {v} as published by the Free Software Foundation", ", version {v}, as published by the Free Software Foundation"]

# Known sentences with a hole, as (identifier, before it, behind it).
HOLES = [
    ("bsd-3", "neither the name", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0-1", "to the extent possible under law", "has waived all copyright and related or neighboring rights to this work"),
]
# Single words that tell licences apart; any other piece of one word has no identifier.
TELLING = {"lesser", "library", "affero"}
#: Longest hole in characters.
HOLE = 200

# Ordered rules over the identifiers above; every licence also has the rule of its one-sentence notice.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-1", "mit-2"]), ("MIT", ["mit-1", "mit-2", "mit-3"]), ("MIT-0", ["mit0-1"]), ("MIT-0", ["mit0-1", "mit-3"]),
    ("Apache-2.0", ["notice-Apache-2.0", "apache-1", "apache-2", "apache-3"]), ("Apache-2.0", ["apache-1", "apache-2"]),
    ("Apache-2.0", ["notice-Apache-2.0", "apache-1", "apache-2s", "apache-3"]), ("Apache-2.0", ["apache-1", "apache-2s"]),
    ("BSD-2-Clause", ["bsd-0", "bsd-1", "bsd-2"]), ("BSD-3-Clause", ["bsd-0", "bsd-1", "bsd-2", "bsd-3"]),
    ("BSD-3-Clause", ["bsd-0", "bsd-1", "bsd-2", "bsd-3a"]), ("BSD-4-Clause", ["bsd-0", "bsd-1", "bsd-2", "bsd-ad", "bsd-3"]),
    ("BSD-4-Clause", ["bsd-0", "bsd-1", "bsd-2", "bsd-ad", "bsd-3a"]), ("BSD-4-Clause", ["bsd-0", "bsd-1", "bsd-2", "bsd-ad"]),
    ("MPL-2.0", ["mpl-1"]), ("MPL-1.1", ["mpl-11"]), ("ISC", ["isc-1"]), ("ISC", ["isc-2"]), ("0BSD", ["0bsd-1"]), ("Unlicense", ["unlicense-1"]),
    ("Zlib", ["zlib-1", "zlib-2"]), ("BSL-1.0", ["bsl-1"]), ("EPL-1.0", ["epl-1"]), ("EPL-2.0", ["epl-2"]), ("CDDL-1.0", ["cddl-1"]),
    ("CC0-1.0", ["cc0-1"]), ("Artistic-2.0", ["artistic-1"]),
]


def _gnu() -> dict[str, tuple[str, str]]:
    """Identifier -> (licence, text) of the GNU notices."""
    out = {}
    for short, (name, versions) in GNU.items():
        for v in versions:
            licence = short if short[-1].isdigit() else f"{short}-{v if '.' in v else v + '.0'}"
            for end, forms in (("or-later", GNU_ANY), ("only", GNU_ONLY)):
                for k, form in enumerate(forms):
                    out[f"{licence}-{end}-{k}".lower()] = (f"{licence}-{end}", (GNU_START + form).format(name=name, v=v))
    return out


for _key, (_licence, _text) in _gnu().items():
    SENTENCES[_key] = _text
    RULES += [(_licence, [_key]), (_licence, [_key, "gpl-w1", "gpl-w2"])]


def _normal(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def _pieces() -> dict[str, list[tuple[str, str]]]:
    """Identifier of a text -> its (piece, identifier or nothing); texts share the identifiers of equal pieces."""
    ids: dict[str, str] = {}
    out = {}
    for name, text in SENTENCES.items():
        parts = [p for x in CUT.split(text) if (p := _normal(x))]
        telling = [p for p in parts if " " in p or p in TELLING]
        for n, part in enumerate(telling):
            ids.setdefault(part, name + (f".{n}" if len(telling) > 1 else ""))
        out[name] = [(part, ids.get(part, "")) for part in parts]
    return out


def _name_ids(name: str) -> list[tuple[str, str]]:
    """(piece, identifier) of a name that is cut before its words."""
    return [(p.strip(), "name-" + p.strip().replace(" ", "-")) for p in NAME_CUT.split(name) if p]


def _names() -> list[tuple[str, str]]:
    """(licence, name), also without a last word "license", which may stand on the next line."""
    return [(licence, n) for licence, names in NAMES.items()
            for n in dict.fromkeys(x for name in names for x in (name, re.sub(" licen[sc]e$", "", name)))]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifiers; a notice begins with "cited"."""
    out = {}
    for parts in _pieces().values():
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if any(i for _, i in parts[a:b]):
                    out[" ".join(p for p, _ in parts[a:b])] = "|".join(i for _, i in parts[a:b] if i)
    whole = {"cited": "cited"}
    for licence, name in _names():
        parts = _name_ids(name)
        for a in range(0 if NAME_CUT.match(name) else 1, len(parts)):
            head, ids = " ".join(p for p, _ in parts[:a]), "|".join(["cited", *(i for _, i in parts[:a])])
            out[f"cited {head}".strip()] = ids
            for b in range(a + 1, len(parts) + 1):
                run = " ".join(p for p, _ in parts[a:b])
                if " " in run:
                    out.setdefault(run, "|".join(i for _, i in parts[a:b]))
        whole[f"cited {name}"] = f"notice-{licence}"
    spdx = {f"{_normal(SPDX_MARK)} {_normal(licence)}": f"notice-{licence}" for licence in [*NAMES, *SPDX]}
    return out | whole | spdx


def rules() -> list[tuple[str, str]]:
    """(licence, rule as ``|a|b|``)."""
    pieces = _pieces()
    texts = [(licence, [i for name in names for i in ([i for _, i in pieces[name] if i] if name in pieces else [name])])
             for licence, names in RULES]
    one = [(licence, [f"notice-{licence}"]) for licence in [*NAMES, *SPDX]]
    cut = [(licence, ["cited", *(i for _, i in _name_ids(name))]) for licence, name in _names()]
    return [(licence, "|" + "|".join(ids) + "|") for licence, ids in texts + one + cut]


def spdx_cut(text: Column) -> Column:
    """The text with every SPDX line as sentences of its own, one per identifier of the expression; "+" means any later version."""
    line = lambda p: F.regexp_extract(p, r"\A[^\r\n]*", 0)
    own = lambda p: F.regexp_replace(F.regexp_replace(line(p), SPDX_JOIN, f"\x01{SPDX_MARK[:-1]} "), r"\+", "-or-later")
    return F.array_join(F.transform(F.split(text, SPDX_MARK), lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.lit(f"\x01{SPDX_MARK[:-1]} "), own(p), F.lit("\x01"), F.substr(p, F.char_length(line(p)) + 1)))), "")


def in_hole(sentence: Column) -> Column:
    """The identifier of a sentence that is known but for its hole, else null."""
    out = F.lit(None).cast("string")
    for ident, before, behind in HOLES:
        fits = (F.startswith(sentence, F.lit(before + " ")) & F.endswith(sentence, F.lit(" " + behind))
                & (F.char_length(sentence) <= len(before) + len(behind) + HOLE))
        out = F.when(fits, F.lit(ident)).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order; empty ones left out."""
    text = F.when(F.contains(text, F.lit(SPDX_MARK)), spdx_cut(text)).otherwise(text)
    marked = F.regexp_replace(F.lower(F.regexp_replace(text, LINE, "\x01$1")), END, "\x01")
    flat = F.regexp_replace(marked, OTHER, " ")
    return F.filter(F.split(flat, " ?\x01 ?"), lambda s: s != "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  known: dict[str, str] | None = None, ordered_rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n_sentences, n_known, sentence_ids, licenses), one row per input row."""
    known = known_sentences() if known is None else known
    ordered_rules = rules() if ordered_rules is None else ordered_rules
    lookup = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    whole = sorted(known)
    rule = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in ordered_rules])
    d = docs.select(id_as_long(id_col).alias("_id"), sentences(text_or_empty(text_col)).alias("_s"))
    d = d.select("_id", F.size("_s").cast("bigint").alias("n_sentences"),
                 F.filter(F.transform("_s", lambda s: F.trim(F.regexp_replace(F.trim(s), NOTICE, "cited "))),
                          lambda s: s.isin(whole) | in_hole(s).isNotNull()).alias("_hit"))
    ids = F.when(F.size("_hit") > 0, F.transform("_hit", lambda s: F.coalesce(in_hole(s), F.element_at(lookup, s))))
    d = d.select("_id", "n_sentences", F.size("_hit").cast("bigint").alias("n_known"),
                 F.coalesce(F.array_join(ids, "|"), F.lit("")).alias("sentence_ids"))
    seq = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    found = F.filter(rule, lambda r: F.contains(F.col("_seq"), r["p"]))
    longest = F.filter("_found", lambda r: ~F.exists("_found", lambda q: (q["p"] != r["p"]) & F.contains(q["p"], r["p"])))
    d = d.withColumn("_seq", seq).withColumn("_found", F.when(F.col("n_known") > 0, found))
    return d.select(F.col("_id").alias(id_col), "n_sentences", "n_known", "sentence_ids",
                    F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(longest, lambda r: r["n"]))), ","),
                               F.lit("")).alias("licenses"))

"""Licence scan by sentence rules.

Texts are cut into pieces at line ends and sentence ends; each is normalised (lower case, letters and digits only, single
spaces, comment marks gone). Pieces that only a line end parts are joined as long as they begin a known sentence, so
wrapped and commented sentences are found as well as one-line notices; a blank line or a full stop ends a sentence. The
longest run of pieces that is a known licence sentence is mapped to its identifier. Licence rules are ordered sequences of identifiers: a rule
matches where its identifiers occur in order, each at most ``GAP`` sentences after the one before. Longer rules win
over shorter ones that they cover.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

GAP = 3
#: Pieces end at line ends, or at . ! ? ; before white space.
SENTENCE = re.compile(r"[^\n.!?;]+(?:[.!?;](?!\s|\Z)[^\n.!?;]*)*")
NOT_WORD = re.compile(r"[^a-z0-9]+")
#: The first words of a piece, after whatever marks lead it.
WORDS = re.compile(r"[^A-Za-z0-9]*+(?:[A-Za-z0-9]++[^A-Za-z0-9]*+){1,4}")
#: Between pieces of one sentence: one line end, then marks of a comment that ends sentences elsewhere (; and !).
SOFT = re.compile(r"\n[ \t]*[.!?;]*\Z")
#: Before a line's text: comment words; before a sentence's: those, or a number or letter of a list.
MARK = re.compile(r"(?:dnl|rem) ")
LEAD = re.compile(r"(?:(?:dnl|rem) )?(?:[0-9a-z] )?")

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "mit-notice": "Released under the MIT License",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-4-title": "Creative Commons Attribution 4.0 International License",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-its": "Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-notice-short": "Licensed under MIT",
    "mit-notice-project": "This project is licensed under the MIT License",
    "apache-notice-2": "Licensed under the Apache License 2.0",
    "gpl-2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-everyone": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "lgpl-21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
#: SPDX identifier and the ordered sentences of each rule.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-notice-the", "apache-comply"]),
    ("Apache-2.0", ["apache-notice-the", "apache-comply", "apache-copy", "apache-url"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-title", "mit-grant", "mit-keep"]),
    ("MIT", ["mit-title-the", "mit-grant", "mit-keep"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse-its"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse-university"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("Apache-2.0", ["apache-notice-2"]),
    ("MIT", ["mit-notice-licensed"]),
    ("MIT", ["mit-notice-short"]),
    ("MIT", ["mit-notice-project"]),
    ("GPL-2.0-or-later", ["gpl-2-redistribute"]),
    ("GPL-2.0-only", ["gpl-2-only"]),
    ("GPL-2.0-only", ["gpl-2-title", "gpl-everyone"]),
    ("GPL-3.0-only", ["gpl-3-title", "gpl-everyone"]),
    ("LGPL-2.1-only", ["lgpl-21-title", "gpl-everyone"]),
    ("LGPL-3.0-only", ["lgpl-3-title", "gpl-everyone"]),
    ("AGPL-3.0-only", ["agpl-3-title", "gpl-everyone"]),
    ("GPL-2.0-only", ["gpl-2-title"]),
    ("GPL-3.0-only", ["gpl-3-title"]),
    ("LGPL-2.1-only", ["lgpl-21-title"]),
    ("LGPL-3.0-only", ["lgpl-3-title"]),
    ("AGPL-3.0-only", ["agpl-3-title"]),
    ("LGPL-2.1-or-later", ["lgpl-21-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl-3-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl-3-redistribute"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("Unlicense", ["unlicense"]),
]
#: Further texts whose first sentences or titles name them.
MORE = [
    ("MPL-1.1", ["MOZILLA PUBLIC LICENSE Version 1.1"]),
    ("MPL-1.1", ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")']),
    ("EPL-1.0", ["Eclipse Public License - v 1.0"]),
    ("EPL-2.0", ["Eclipse Public License - v 2.0"]),
    ("EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"]),
    ("CDDL-1.0", ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"]),
    ("Artistic-1.0", ['The "Artistic License"', "Preamble"]),
    ("Artistic-2.0", ["The Artistic License 2.0"]),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"]),
    ("BSL-1.0", ["Distributed under the Boost Software License, Version 1.0"]),
    ("Zlib", ["This software is provided 'as-is', without any express or implied warranty", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ("WTFPL", ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"]),
    ("0BSD", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"]),
    ("ISC", ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"]),
    ("MIT-0", ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so']),
    ("OFL-1.1", ["This Font Software is licensed under the SIL Open Font License, Version 1.1"]),
    ("OFL-1.1", ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"]),
    ("Python-2.0", ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"]),
    ("GFDL-1.2-only", ["GNU Free Documentation License Version 1.2, November 2002"]),
    ("GFDL-1.2-only", ["GNU Free Documentation License Version 1.2, November 2002", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"]),
    ("GFDL-1.3-only", ["GNU Free Documentation License Version 1.3, 3 November 2008"]),
    ("GFDL-1.3-only", ["GNU Free Documentation License Version 1.3, 3 November 2008", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"]),
    ("GPL-1.0-only", ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"]),
    ("GPL-1.0-only", ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"]),
    ("LGPL-2.0-only", ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    ("LGPL-2.0-only", ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"]),
    ("BSD-4-Clause", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"]),
]
#: The names under which notices speak of a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0", "Apache Software License 2.0"],
    "MIT": ["MIT License", "MIT license terms", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
#: How a notice begins, the GNU licences with their versions, and the parts of a Creative Commons licence.
NOTICES = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This project is licensed under", "This program is licensed under", "This software is licensed under", "This file is licensed under", "This code is licensed under", "This document is licensed under", "Except where otherwise noted, this work is licensed under"]
GNU = {"GPL": ("General Public License", ["1", "2", "3"]), "LGPL": ("Lesser General Public License", ["2.1", "3"]), "AGPL": ("Affero General Public License", ["3"])}
GNU_NOUNS = ["program", "library", "software", "file"]
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": ["Generic"], "2.0": ["Generic"], "2.5": ["Generic"], "3.0": ["Unported"], "4.0": ["International"]}
OWNERS = ["the copyright holder", "the copyright holders", "copyright holder", "the copyright owner", "the author", "the authors", "the organization", "the project", "the University", "the Regents"]


def generated() -> list[tuple[str, list[str]]]:
    """Rules as (licence, sentences) that follow from names and forms: notices, the GNU licences' headers, Creative Commons, the BSD endorsement clause."""
    out, names = list(MORE), {k: list(v) for k, v in NAMES.items()}
    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            names[spdx + "-only"] = [f"GNU {name}, version {v}", f"GNU {name} {v}", f"GNU {name} v{v}", f"GNU {name} v{v}.0", f"{short} {v}", f"{short}v{v}", f"GNU {short}v{v}", f"GNU {short} v{v}", f"{spdx}", f"{spdx}-only", f"GNU {name} version {v} only"]
            names[spdx + "-or-later"] = [f"GNU {name}, version {v} or later", f"GNU {name} v{v} or later", f"GNU {name} v{v}+", f"{short}v{v} or later", f"{short} {v} or later", f"{spdx}-or-later", f"GNU {name}, version {v} or any later version"]
            for noun in GNU_NOUNS:
                for a in ";:":
                    start = f"This {noun} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}"
                    out += [(spdx + "-or-later", [f"{start} as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version"]) for b in ";,"]
                    out += [(spdx + "-only", [f"{start}{c}version {v}{d}as published by the Free Software Foundation"]) for c, d in ((" ", " "), (", ", ", "))]
    for code, words in CC_PARTS.items():
        for v, ports in CC_VERSIONS.items():
            full = [f"Creative Commons {words} {v}{port} {end}".strip() for port in ["", *(" " + p for p in ports)] for end in ("License", "")]
            names[f"CC-{code}-{v}"] = [f"CC {code} {v}", f"CC-{code}-{v}", f"CC-{code} {v}", *full, *("a " + n for n in full)]
            out += [(f"CC-{code}-{v}", [f"{words} {v} {port}"]) for port in ports] + [(f"CC-{code}-{v}", [n]) for n in full if n.endswith("License")]
    for spdx, every in names.items():
        out += [(spdx, [f"{notice}{the}{name}"]) for name in every for notice in NOTICES for the in (" ", " the ")]
    bsd = [SENTENCES[k] for k in ("bsd-conditions", "bsd-source", "bsd-binary")]
    out += [("BSD-3-Clause", [*bsd, f"Neither the name of {owner} nor the names of {its}contributors may be used to endorse or promote products derived from this software without specific prior written permission"]) for owner in OWNERS for its in ("its ", "")]
    return out


#: An SPDX tag names its licence itself, as an expression up to the line's end.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)")
SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def normalise(sentence: str) -> str:
    return NOT_WORD.sub(" ", sentence.lower()).strip()


class Rules:
    """Known sentences by identifier, and ordered rules over identifiers; the built-in ones where none are given."""

    def __init__(self, sentences=None, rules=None, gap: int = GAP):
        named, wanted = dict(sentences or SENTENCES), [(spdx, list(keys)) for spdx, keys in (rules or RULES)]
        if sentences is None and rules is None:
            for spdx, texts in generated():
                keys = []
                for text in texts:
                    name = "+".join(normalise(p).replace(" ", "-") for p in SENTENCE.findall(text))
                    keys.append(name)
                    named.setdefault(name, text)
                wanted.append((spdx, keys))
        # a text's sentence may end where a licence's does not (before a line end), so known texts are cut alike
        self.parts: dict[str, str] = {}
        of = {}
        for key, text in named.items():
            cut = [p for p in map(normalise, SENTENCE.findall(text)) if p]
            of[key] = [self.parts.setdefault(p, f"{key}#{i}" if i else key) for i, p in enumerate(cut)]
        found = {tuple(n for k in keys for n in of[k]): spdx for spdx, keys in reversed(wanted)}
        #: Rules by their first sentence, the longest first; of rules with the same sentences the first.
        self.by_first: dict[str, list[tuple[int, str, tuple[str, ...]]]] = {}
        for no, (path, spdx) in enumerate(sorted(found.items(), key=lambda r: -len(r[0]))):
            self.by_first.setdefault(path[0], []).append((no, spdx, path))
        self.first = {p.split(" ", 1)[0] for p in self.parts}
        self.sorted = sorted(self.parts)
        self.gap = gap

    def _begins(self, words: str) -> bool:
        """Whether a known sentence is longer than ``words`` and begins with them."""
        at = bisect_left(self.sorted, words + " ")
        return at < len(self.sorted) and self.sorted[at].startswith(words + " ")

    def sentences(self, text: str) -> list[tuple[int, str, int, int]]:
        """(sentence number, identifier, start, end) of the known sentences."""
        out = []
        pieces = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
        no, at, end = 0, 0, None
        while at < len(pieces):
            a, b = pieces[at]
            # a piece without a word is a blank line, whatever its comment marks
            few = WORDS.match(text, a, b)
            head = normalise(few.group()) if few else ""
            soft = end is not None and bool(head) and SOFT.match(text, end, a) is not None
            no += end is not None and not soft
            end, step = b if head else None, 1
            if end is None:
                no += 1
            else:
                lead = LEAD.match(head).end()
                for cut in {0, lead, MARK.match(head).end() if MARK.match(head) else 0}:
                    if head[cut:].split(" ", 1)[0] in self.first and (hit := self._run(text, pieces, at, cut)):
                        last, key = hit
                        start = a + re.search(r"[^\s]", text[a:b]).start()
                        stop = pieces[last][0] + len(text[slice(*pieces[last])].rstrip())
                        out.append((no, key, start, stop))
                        step, end = last - at + 1, pieces[last][1]
                        break
            at += step
        return out

    def _run(self, text: str, pieces: list[tuple[int, int]], at: int, cut: int) -> tuple[int, str] | None:
        """The last piece and the identifier of the longest known sentence that starts at a piece, ``cut`` letters in."""
        words, hit = normalise(text[slice(*pieces[at])])[cut:], None
        while True:
            # where lines were refilled, the next list item's number or letter stands at the sentence's end
            if key := self.parts.get(words) or (words[-2:-1] == " " and self.parts.get(words[:-2])):
                hit = at, key
            if not self._begins(words) or at + 1 == len(pieces) or not SOFT.match(text, pieces[at][1], pieces[at + 1][0]):
                return hit
            at += 1
            more = normalise(text[slice(*pieces[at])])
            if not more:
                return hit
            words += " " + (more[m.end() :] if (m := MARK.match(more)) else more)

    def match(self, found: list[tuple[int, str, int, int]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) of the rules met; no sentence serves two rules, and longer rules come first."""
        out, used = [], set()
        tries = sorted((no, i, spdx, keys) for i, f in enumerate(found) for no, spdx, keys in self.by_first.get(f[1], ()))
        for _no, i, spdx, keys in tries:
            if i in used:
                continue
            path, at, last = [i], i, found[i][0]
            for want in keys[1:]:
                near = takewhile(lambda j: found[j][0] - last <= self.gap, range(at + 1, len(found)))  # noqa: B023
                at = next((j for j in near if found[j][1] == want and j not in used), None)
                if at is None:
                    break
                path.append(at)
                last = found[at][0]
            if at is not None:
                used.update(path)
                out.append((spdx, found[i][2], found[path[-1]][3]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def tagged(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the licences and exceptions that SPDX tags name."""
    if "SPDX-License-Identifier:" not in text:
        return []
    return [(x.group(), *x.span()) for m in SPDX.finditer(text) for x in SPDX_ID.finditer(text, *m.span(1)) if x.group() not in ("AND", "OR", "WITH")]


SCHEMA = "doc_id long, n_sentences long, sentence_ids string, n_matches long, licenses string, spans string"


def scan(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per document: known sentences (count, identifiers in order) and matched licences (count, distinct SPDX ids, ``id:start:end`` spans in code points).

    A null text is empty and matches nothing. Repeated rows keep their number; an empty table gives an empty result.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1):
                found = rules.sentences(t.as_py())
                met = rules.match(found) if found else []
                met = sorted(met + tagged(t.as_py()), key=lambda x: (x[1], x[2], x[0]))
                for c, v in zip(cols, (len(found), ",".join(f[1] for f in found), len(met), ",".join(sorted({m[0] for m in met})), ",".join(f"{x}:{s}:{e}" for x, s, e in met))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_sentences", "sentence_ids", "n_matches", "licenses", "spans"])

    return text_or_empty(docs, "doc_id").mapInArrow(run, SCHEMA)

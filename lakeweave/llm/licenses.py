"""License scans by recognition of sentences and of their sequences.

A text is cut into pieces at line feeds and after . ! ? ; : before white space. A piece is read as its words: A-Z in lower
case, all that is no letter, digit, point, plus or hyphen between two words, no points or hyphens around a word; so comment
signs and quotes are off. A table maps licence sentences, read alike, to identifiers. A known sentence is one piece or several
in a row, the longest from where it begins: lines may be wrapped anywhere, but no sentence runs over a blank line. Sentences
that are not known end where a piece does, but not at a single line feed. ``{}`` in a sentence stands for one to MOST_WORDS words, say the name of an
owner or a program; a sentence that ends with ``...`` may go on in any way. Behind a tag, an expression of licence ids joined by
OR, AND and WITH is read to the end of its line, each id with its exception; ids of old style get their present name. The sequence of a text's identifiers (other sentences
are gaps) is matched against ordered rules: at each place the first rule whose identifiers follow there, with at most GAP
other sentences between two of them, takes those sentences; what is left is tried against the later rules. The search for a rule's next sentence ends GAP sentences
behind the last one, so that the time grows with the number of known sentences in proportion.

Defined cases: a null text is the empty text and has no licence; a licence that is stated twice is found twice; ids and
rows are not compared with each other, so repeated rows and ties need no rule; texts of any length are read whole; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spread

GAP = 2
MOST_WORDS = 8  # that a placeholder stands for
#: Sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "mit-liability": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ["The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "zero-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "apache-grant": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-free": ["{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl3-free": ["{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-free": ["{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl-free": ["{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-useful": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: ..."],
    "bsd-names": ["Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission.", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": ["This software is provided by {} \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "bsd-liability": ["In no event shall {} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."],
    "epl-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
    "tag": ["SPDX-License-Identifier:"],
    "gpl3-head": ["GNU General Public License Version 3, 29 June 2007"],
    "gpl2-head": ["GNU General Public License Version 2, June 1991"],
    "lgpl3-head": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "lgpl-head": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "agpl-head": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "apache-head": ["Apache License Version 2.0, January 2004"],
    "mpl-head": ["Mozilla Public License Version 2.0"],
    "epl-head": ["Eclipse Public License - v 2.0"],
}
#: How a sentence may begin that names its licence, and names of licences.
LEADS = ["Licensed under", "Released under", "Distributed under", "Available under", "{} is licensed under", "{} is released under", "{} is distributed under", "{} is available under", "{} are licensed under"]
NAMES = {
    "MIT": ["MIT License", "MIT/X11 License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3", "GNU GPL v3", "GNU GPLv3", "GPLv3", "GPL v3", "GPL version 3"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2", "GNU GPL v2", "GNU GPLv2", "GPLv2", "GPL v2", "GPL version 2"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPLv3", "LGPL v3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPLv2.1", "LGPL v2.1"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPLv3", "AGPL v3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND 4.0"],
    "CC0-1.0": ["CC0 1.0"],
    "Unlicense": ["Unlicense"],
}
#: Ids that a tag may give, ids of old style with what they mean, and exceptions.
IDS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
OLD_IDS = {f"{k}{sign}": f"{k}-{now}" for k in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for sign, now in (("", "only"), ("+", "or-later"))}
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception"]
#: Licence and the identifiers that state it, in order of precedence.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["zero-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["zero-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-warranty", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-grant", "apache-comply"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-useful", "gpl-implied", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-useful", "gpl-implied"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-useful", "gpl-implied", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-useful", "gpl-implied"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl-free"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("MPL-2.0", ["mpl-terms", "mpl-copy"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("EPL-2.0", ["epl-terms"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0-only", ["gpl3-head"]),
    ("GPL-2.0-only", ["gpl2-head"]),
    ("LGPL-3.0-only", ["lgpl3-head"]),
    ("LGPL-2.1-only", ["lgpl-head"]),
    ("AGPL-3.0-only", ["agpl-head"]),
    ("Apache-2.0", ["apache-head"]),
    ("MPL-2.0", ["mpl-head"]),
    ("EPL-2.0", ["epl-head"]),
    *[(k, [f"named {k}"]) for k in NAMES],
    ("all-rights-reserved", ["reserved"]),
]
ALL_SENTENCES = SENTENCES | {f"named {k}": [f"{lead} {the}{n} ..." for lead in LEADS for the in ("", "the ", "the terms of the ") for n in own] for k, own in NAMES.items()}
_CUT = re.compile(rb"\n|(?<=[.!?;:])[\x20\x09-\x0D]+")
_WORD = re.compile(rb"[a-z0-9.+\x80-\xff-]+")
_CONTINUED = bytes(range(0x80, 0xC0))
_ID = re.compile(rb"[A-Za-z0-9][A-Za-z0-9.+-]*")
ANY, OPEN, END = 0, 1, None  # keys of the tree beside words: a placeholder's node, and identifiers of sentences that may go on, or end, there


def words(low: bytes, at: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The words of a piece of a text in lower case, and where each ends."""
    for m in _WORD.finditer(low, at, end):
        if w := m[0].strip(b".-"):
            yield w, m.end()


def step(states: list[tuple[dict, int]], w: bytes) -> list[tuple[dict, int]]:
    """Where the word leads from nodes of the tree, each with how many more words its placeholder may stand for."""
    out = []
    for node, left in states:
        if w in node:
            out.append((node[w], 0))
        if ANY in node:
            out.append((node[ANY], MOST_WORDS - 1))
        if left:
            out.append((node, left - 1))
    return out


class Recogniser:
    def __init__(self, sentences: dict[str, list[str]] = ALL_SENTENCES, rules: list[tuple[str, list[str]]] = RULES, gap: int = GAP):
        self.tree: dict = {}  # word by word
        self.free: dict = {}  # of sentences that begin with a placeholder
        self.anchors: set[bytes] = set()  # second words behind it: without one of them in a text there is no such sentence
        for k, own in sentences.items():
            for x in own:
                parts = x.removesuffix("...").split("{}")
                low = [w for i, part in enumerate(parts) for w in ([ANY] if i else []) + [w for w, _ in words(part.lower().encode(), 0, len(part.encode()))]]
                node = self.free if low[0] == ANY else self.tree
                if low[0] == ANY:
                    self.anchors.add(low[2])
                for w in low:
                    node = node.setdefault(w, {})
                node[OPEN if x.endswith("...") else END] = k
        self.rules, self.gap = rules, gap
        self.ids = {x.lower().encode(): x for x in IDS} | {old.lower().encode(): new for old, new in OLD_IDS.items()}
        self.exceptions = {x.lower().encode(): x for x in EXCEPTIONS}

    def sentences(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """(identifier, numbers of the sentences where it starts and ends, start, end) of each known sentence; places in bytes."""
        low = text.lower()
        roots = [(self.tree, 0)] + ([(self.free, 0)] if any(a in low for a in self.anchors) else [])
        starts, ends, number = [0], [], [0]
        for m in _CUT.finditer(low):
            ends.append(m.start())
            over = m[0] != b"\n" or low[m.start() - 1 : m.start()] in (b".", b"!", b"?", b";", b":") or next(words(low, starts[-1], ends[-1]), None) is None
            starts.append(m.end())
            number.append(number[-1] + over)
        ends.append(len(text))
        out, i = [], 0
        while i < len(starts):
            states, j, found = roots, i, None
            while states and j < len(starts):
                some = False
                for w, end in words(low, starts[j], ends[j]):
                    some = True
                    if not (states := step(states, w)):
                        break
                    if k := next((node[OPEN] for node, _ in states if OPEN in node), None):
                        found = k, j, end
                if not some:
                    break
                if k := next((node[END] for node, _ in states if END in node), None):
                    found = k, j, ends[j]
                j += 1
            if found:
                out.append((found[0], number[i], number[found[1]], starts[i], found[2]))
                i = found[1]
            i += 1
        return out

    def tagged(self, text: bytes, at: int) -> list[tuple[str, int]]:
        """The licences of the expression that begins there, and where each ends; it stops at its line's end or at a word that is no part of one."""
        out: list[tuple[str, int]] = []
        end = text.find(b"\n", at)
        joined, plus = True, False  # an id is due; WITH came last
        for m in _ID.finditer(text, at, len(text) if end < 0 else end):
            w = m[0].lower().rstrip(b".-")
            if plus:
                if w not in self.exceptions:
                    break
                out[-1], plus = (f"{out[-1][0]} WITH {self.exceptions[w]}", m.end()), False
            elif joined and w in self.ids:
                out.append((self.ids[w], m.start() + len(w)))
                joined = False
            elif not joined and w in (b"or", b"and"):
                joined = True
            elif not joined and w == b"with":
                plus = True
            else:
                break
        return out

    def licences(self, text: bytes) -> list[tuple[str, int, int]]:
        """(licence, start, end) in code points, by place."""
        known, taken, out = self.sentences(text), set(), []
        for i, x in enumerate(known):
            if x[0] == "tag":
                out += [(name, x[3], end) for name, end in self.tagged(text, x[4])]
        places: dict[str, list[int]] = {}
        for i, x in enumerate(known):
            places.setdefault(x[0], []).append(i)
        for name, wanted in self.rules:
            for i in places.get(wanted[0], []):
                if i in taken:
                    continue
                used, last = [i], known[i][2]
                for w in wanted[1:]:
                    near = takewhile(lambda j: known[j][1] - last - 1 <= self.gap, range(used[-1] + 1, len(known)))  # noqa: B023
                    nxt = next((j for j in near if j not in taken and known[j][0] == w), None)
                    if nxt is None:
                        break
                    used.append(nxt)
                    last = known[nxt][2]
                if len(used) == len(wanted):
                    taken.update(used)
                    out.append((name, known[used[0]][3], known[used[-1]][4]))
        points = lambda n: len(text[:n].translate(None, _CONTINUED))
        return [(name, points(a), points(b)) for name, a, b in sorted(out, key=lambda x: (x[1], x[2], x[0]))]


@cache
def recogniser() -> Recogniser:
    """The recogniser of a worker, kept between its tasks."""
    return Recogniser()


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences (known ones), licenses (names and spans, by place)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = recogniser()
        shape = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, found = [], []
            for x in b.column(1):
                text = x.as_py() or b""
                n.append(len(own.sentences(text)))
                found.append([{"license": k, "start": s, "end": e} for k, s, e in own.licences(text)] if n[-1] else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, shape)], names=list("abc"))

    own = spread(docs.select(F.col(id_col), F.col(text_col).cast("binary")))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_sentences long, licenses array<struct<license:string,start:long,end:long>>")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(documents(spark, sf_dir))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return found.select("doc_id", "n_sentences", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), spans.alias("spans"))

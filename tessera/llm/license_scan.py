"""License scans by sentence rules.

A text is cut into sentences and each is normalised to lower-case words. Normalised sentences that are known licence
sentences become identifiers; a known sentence may have slots, for a holder's or a program's name, that take a few words of any kind. What lies between
the known sentences is skipped. The sequence of a text's identifiers, in order, is matched against ordered rules: at
each place the first rule whose identifiers come next, in order and close together, and none of whose refusals follows, names the licence and takes them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Sentences of public licence texts and notices, by identifier. {name} is a slot.
SENTENCES = {
    "0bsd-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-compliance": "you may not use this file except in compliance with the License.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-the-license": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "artistic2-title": "The Artistic License 2.0",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY {holder} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of {holder} nor the names of {owner} contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-names": "The names of {holder} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-permitted": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd2-licensed": "Licensed under the BSD 2-Clause License.",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License.",
    "bsl1-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl1-notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-dedicated": "This work is dedicated to the public domain under the CC0 1.0 license.",
    "cc0-waived": "To the extent possible under law, {holder} has waived all copyright and related or neighboring rights to {work}.",
    "cddl1-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-no-warranty": "{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl2-kernel": "{program} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-permission-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-notice": "The above copyright notice and this permission notice {paragraphs} shall be included in all copies or substantial portions of the Software.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit0-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl11-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mspl-title": "Microsoft Public License (Ms-PL)",
    "ncsa-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    "ofl11-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "postgresql-permission": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "python2-grant": "Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version,",
    "rights-reserved": "All rights reserved.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "x11-advertising": "Except as contained in this notice, the name of {holder} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {owner}.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

#: Names of the GNU licences and their versions, of the Creative Commons licences, their versions and how these are called.
GNU = {"GPL": ("General Public License", ("2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("3.0",)), "LGPL-LIBRARY": ("Library General Public License", ("2.0",))}
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.0": "Generic"}

#: Fixed values: (licence, rule, sentence identifiers in order, identifiers that refuse it where they follow); the first that matches wins.
RULES: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]] = [
    ("JSON", "json-full", ("mit-permission", "mit-notice", "json-good"), ()),
    ("X11", "x11-full", ("mit-permission", "mit-notice", "mit-as-is", "x11-advertising"), ()),
    ("NCSA", "ncsa-full", ("mit-permission", "ncsa-source"), ()),
    ("MIT", "mit-full", ("mit-permission", "mit-notice", "mit-as-is"), ("x11-advertising",)),
    ("MIT-0", "mit0-full", ("mit0-permission",), ()),
    ("BSD-4-Clause", "bsd4-full", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-advertising"), ()),
    ("BSD-3-Clause", "bsd3-full", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse"), ()),
    ("BSD-3-Clause", "bsd3-author", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse-author"), ()),
    ("BSD-3-Clause", "bsd3-names", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse-names"), ()),
    ("LicenseRef-BSD-endorsement", "bsd-other-endorsement", ("bsd-permitted", "bsd-source", "bsd-binary", "endorsement"), ()),
    ("BSD-2-Clause", "bsd2-full", ("bsd-permitted", "bsd-source", "bsd-binary"), ("bsd-advertising", "bsd-endorse", "bsd-endorse-author", "bsd-endorse-names", "endorsement")),
    ("LicenseRef-BSD-variant", "bsd-variant", ("bsd-permitted",), ()),
    ("Apache-2.0", "apache2-header", ("apache2-the-license", "apache2-compliance", "apache2-as-is"), ()),
    ("ISC", "isc-permission", ("isc-permission",), ()),
    ("ISC", "isc-permission-and", ("isc-permission-and",), ()),
    ("0BSD", "0bsd-permission", ("0bsd-permission",), ()),
    ("Zlib", "zlib-full", ("zlib-as-is", "zlib-permission"), ()),
    ("Zlib", "zlib-permission", ("zlib-permission",), ()),
    ("BSL-1.0", "bsl1-grant", ("bsl1-grant",), ()),
    ("BSL-1.0", "bsl1-notice", ("bsl1-notice",), ()),
    ("PostgreSQL", "postgresql-permission", ("postgresql-permission",), ()),
    ("Python-2.0", "python2-grant", ("python2-grant",), ()),
    ("GPL-2.0-only", "gpl2-kernel", ("gpl2-kernel",), ()),
    ("Apache-2.0", "apache2-short", ("apache2-the-license",), ()),
    ("Apache-2.0", "apache2-licensed", ("apache2-licensed",), ()),
    ("Apache-2.0", "apache2-title", ("apache2-title",), ()),
    ("MIT", "mit-permission-only", ("mit-permission",), ("x11-advertising", "json-good", "ncsa-source")),
    ("LicenseRef-MIT-variant", "mit-variant", ("mit-permission",), ()),
    ("MIT", "mit-released", ("mit-released",), ()),
    ("MIT", "mit-licensed", ("mit-licensed",), ()),
    ("MPL-2.0", "mpl2-notice", ("mpl2-notice",), ()),
    ("MPL-1.1", "mpl11-notice", ("mpl11-notice",), ()),
    ("EPL-1.0", "epl1-notice", ("epl1-notice",), ()),
    ("EPL-2.0", "epl2-notice", ("epl2-notice",), ()),
    ("CDDL-1.0", "cddl1-notice", ("cddl1-notice",), ()),
    ("BSD-3-Clause", "bsd3-licensed", ("bsd3-licensed",), ()),
    ("BSD-2-Clause", "bsd2-licensed", ("bsd2-licensed",), ()),
    ("Artistic-2.0", "artistic2-title", ("artistic2-title",), ()),
    ("Beerware", "beerware", ("beerware",), ()),
    ("CC0-1.0", "cc0-dedicated", ("cc0-dedicated",), ()),
    ("CC0-1.0", "cc0-waived", ("cc0-waived",), ()),
    ("MS-PL", "mspl-title", ("mspl-title",), ()),
    ("OFL-1.1", "ofl11-notice", ("ofl11-notice",), ()),
    ("Unlicense", "unlicense-domain", ("unlicense-domain",), ()),
    ("WTFPL", "wtfpl-title", ("wtfpl-title",), ()),
]


def _add(licence: str, key: str, sentence: str, *more: str) -> None:
    SENTENCES[key] = sentence
    RULES.append((licence, "-".join([key, *more]), (key, *more), ()))


for _name, (_title, _versions) in GNU.items():
    for _v in _versions:
        _spdx, _key, _plain = f"{_name.removesuffix('-LIBRARY')}-{_v}", f"{_name.lower()}{_v}", _v.removesuffix(".0")
        _free = f"{{program}} is free software: you can redistribute it and/or modify it under the terms of the GNU {_title} as published by the Free Software Foundation, either version {_plain} of the License"
        _add(f"{_spdx}-or-later", f"{_key}-free-software", f"{_free}, or (at your option) any later version.", "gpl-no-warranty")
        _add(f"{_spdx}-or-later", f"{_key}-free-software", f"{_free}, or (at your option) any later version.")
        _add(f"{_spdx}-only", f"{_key}-free-software-only", _free.replace(" either version", " version"))
        _add(f"{_spdx}-only", f"{_key}-notice", f"This work is licensed under the GNU {_title}, version {_plain}.")
        _add(f"{_spdx}-only", f"{_key}-licensed", f"Licensed under the GNU {_title}, version {_plain}.")
        _add(f"{_spdx}-or-later", f"{_key}-notice-or-later", f"This work is licensed under the GNU {_title}, version {_plain} or later.")
        _add(f"{_spdx}-or-later", f"{_key}-licensed-or-later", f"Licensed under the GNU {_title}, version {_plain} or later.")
for _kind, _title in CREATIVE.items():
    for _v, _scope in CREATIVE_VERSIONS.items():
        _spdx, _key = f"CC-{_kind}-{_v}", f"cc-{_kind.lower()}-{_v.removesuffix('.0')}"
        _add(_spdx, _key, f"Licensed under CC {_kind} {_v}.")
        _add(_spdx, f"{_key}-work", f"This work is licensed under CC {_kind} {_v}.")
        _add(_spdx, f"{_key}-long", f"This work is licensed under a Creative Commons {_title} {_v} {_scope} License.")
        _add(_spdx, f"{_key}-long-the", f"This work is licensed under the Creative Commons {_title} {_v} {_scope} License.")

# Reserved rights mean something of their own only where no licence follows.
RULES.append(("Proprietary", "rights-reserved", ("rights-reserved",), tuple(dict.fromkeys(wanted[0] for _, _, wanted, _ in RULES))))

#: Pieces of other text that may lie between two sentences of a rule, and after its last to one that refuses it.
GAP, REACH = 3, 12
#: Words that a slot takes at most.
SLOT = 16
#: A text without any of these, in lower case, holds no known sentence.
TRIGGERS = ("licens", "permission", "redistribut", "warrant", "reserved", "domain", "copyright", "notice", "advertising", "evil", "endorse")
#: Fixed value: words that tell an endorsement clause of any wording.
ENDORSEMENT = "endorse or promote"

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"\n|(?<=[.!?;:])[ \t]+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
#: A part of an SPDX expression: a bracket, or an operator or identifier (of a document of its own, perhaps).
_PART = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")
_OPERATORS = ("AND", "OR", "WITH")
_SLOT = re.compile(r"\{\w+\}")
#: What may stand before a sentence of a list: "1.", "a)", "(iii)".
_ENUMERATOR = re.compile(r"(?:\d{1,2}|[a-h]|i{1,3}|iv|v)[ \n]")


def normal(sentence: str) -> str:
    """Lower-case words joined by spaces; comment signs and punctuation go."""
    return " ".join(_WORD.findall(sentence.lower()))


def parts(sentence: str) -> list[list[str]]:
    """The words of a known sentence before, between and after its slots."""
    return [normal(p).split() for p in _SLOT.split(sentence)]


def _pattern(sentence: str) -> re.Pattern:
    """A known sentence over normalised pieces: words are apart by a space within a piece and by a line feed between two."""
    out = ""
    for k, words in enumerate(parts(sentence)):
        # A slot at the start names something, one inside may be empty.
        out += ("" if not k else rf"(?:[^ \n]+[ \n]){{1,{SLOT}}}?" if not out else rf"(?:[ \n][^ \n]+){{0,{SLOT}}}?") + (r"[ \n]" if out and words else "") + r"[ \n]".join(words)
    return re.compile(out + r"(?=\n|\Z)")


_PATTERNS = {k: _pattern(s) for k, s in SENTENCES.items()}
#: Known sentences by their first word, and those that begin with a slot by the words after it.
_BY_WORD: dict[str, list[str]] = defaultdict(list)
_BY_REST: dict[str, list[str]] = defaultdict(list)
for _k, _s in SENTENCES.items():
    _first, *_more = parts(_s)
    if _first:
        _BY_WORD[_first[0]].append(_k)
    else:
        _BY_REST[" ".join(_more[0][:3])].append(_k)


def sentences(text: str) -> list[str]:
    return [s for s in _BREAK.split(text) if s and s.strip()]


def identifiers(text: str | None) -> list[tuple[int, int, str]]:
    """(first piece, last piece, identifier) of a text's known sentences, in order.

    Lines and sentence ends cut a text into pieces. A known sentence may be wrapped over any number of lines or hold such marks itself: it begins where a
    piece does and ends where one does. Of several that begin at a piece the longest wins, and no piece is in two. An endorsement clause of another wording is
    the identifier "endorsement"."""
    if not text:
        return []
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    pieces = [normal(s) for s in sentences(text)]
    starts, at = [], 0
    for p in pieces:
        starts.append(at)
        at += len(p) + 1
    stream = "\n".join(pieces)
    flat = stream.replace("\n", " ")
    floating = [k for rest, keys in _BY_REST.items() if rest in flat for k in keys]
    clauses = sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(rf"\b{ENDORSEMENT}\b", flat)})
    out: list[tuple[int, int, str]] = []
    n = 0
    while n < len(pieces):
        best: tuple[int, str] | None = None
        begin = starts[n]
        for lead in (begin, m.end() if (m := _ENUMERATOR.match(stream, begin)) else begin):
            word = _WORD.match(stream, lead)
            for k in (*(_BY_WORD.get(word[0], ()) if word else ()), *floating):
                if (hit := _PATTERNS[k].match(stream, lead)) and (best is None or hit.end() > best[0]):
                    best = (hit.end(), k)
        if best:
            last = bisect_right(starts, best[0] - 1) - 1
            out.append((n, last, best[1]))
            n = last + 1
        else:
            n += 1
    taken = {p for a, b, _ in out for p in range(a, b + 1)}
    return sorted(out + [(p, p, "endorsement") for p in clauses if p not in taken])


def recognise(found: list[tuple[int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(licence, rule, first sentence, last sentence) by the ordered rules."""
    out, at = [], 0
    while at < len(found):
        for licence, rule, wanted, refused in RULES:
            part = found[at : at + len(wanted)]
            if tuple(k for *_, k in part) != wanted or any(b[0] - a[1] - 1 > GAP for a, b in zip(part, part[1:], strict=False)):
                continue
            if refused and _follows(found[at + len(wanted) :], part[-1][1], refused, wanted[0]):
                continue
            out.append((licence, rule, part[0][0], part[-1][1]))
            at += len(wanted)
            break
        else:
            at += 1
    return out


def _follows(rest: list[tuple[int, int, str]], last: int, refused: tuple[str, ...], opening: str) -> bool:
    """Whether one of the refused identifiers comes within reach, before the next text of the same kind opens."""
    for first, _, k in rest:
        if first - last - 1 > REACH or k == opening:
            return False
        if k in refused:
            return True
    return False


def spdx(line: str) -> list[str]:
    """Identifiers of the SPDX expression that a line begins with, exceptions after WITH included.

    The expression ends where two identifiers meet without an operator, or at anything else: a comment's end, say."""
    out, wanted, at = [], True, 0
    while m := _PART.match(line, at):
        part, at = m[1], m.end()
        operator = part.upper() in _OPERATORS
        if part in "()":
            if (part == "(") != wanted:
                break
        elif operator == wanted or not (operator or any(c.isalnum() for c in part)):
            break
        else:
            if not operator:
                out.append(part)
            wanted = operator
    return out


def scan_text(text: str | None) -> list[tuple[str, str, int, int]]:
    """Licences of one text; SPDX tags name theirs outright, with sentence numbers -1."""
    found = recognise(identifiers(text))
    return found + [(k, "spdx-tag", -1, -1) for line in (_SPDX.findall(text) if text and "icense-" in text.lower() else ()) for k in spdx(line)]


SCHEMA = "doc_id long, license string, rule string, first_sentence long, last_sentence long"


def scan(docs: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """A row (SCHEMA) for each licence statement found in a text of docs, in reading order.

    Null or empty text and text without a known sentence: no rows. Repeated rows give theirs each; a null doc_id stays
    null. Very long texts are read whole; ties are settled by the rules' order; other columns are ignored. Empty table: no rows."""
    ship(docs.sparkSession)
    names = ["doc_id", "license", "rule", "first_sentence", "last_sentence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *hit) for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scan_text(t.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    key = F.col("doc_id").cast("long") if doc_id is None else doc_id
    return docs.select(key.alias("doc_id"), "text").mapInArrow(run, SCHEMA)

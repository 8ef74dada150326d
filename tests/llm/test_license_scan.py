import random
import re
import textwrap

import pytest

from tessera.llm import license_scan as S

FILL = {"{holder}": "Google Inc. and the Regents of the University", "{owner}": "its", "{program}": "This program", "{paragraphs}": "(including the next paragraph)", "{work}": "this work"}


def filled(name):
    return re.sub(r"\{\w+\}", lambda m: FILL[m[0]], S.SENTENCES[name])


@pytest.mark.parametrize("name", sorted(S.SENTENCES))
def test_sentences(name):
    s = filled(name)
    assert any(t in s.lower() for t in S.TRIGGERS)
    for text in (s, f"Intro.\n{s}\nMore.", "// " + "\n// ".join(textwrap.wrap(s, 60)), "\n".join(textwrap.wrap(s, 20)), f"Before it. {s}\n\nAfter", s.upper(), f"1. {s}", f"  (a) {s}"):
        assert [k for *_, k in S.identifiers(text)] == [name], text


def full(*names):
    return "\n\n".join(filled(n) for n in names)


def test_ordered_rules():
    mit = full("mit-permission", "mit-notice", "mit-as-is")
    assert [r[:2] for r in S.scan_text(mit)] == [("MIT", "mit-full")]
    assert [r[:2] for r in S.scan_text(full("mit-permission", "mit-as-is"))] == [("MIT", "mit-permission-only")]
    assert [r[0] for r in S.scan_text(full("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse") + "\n\n" + full("bsd-permitted", "bsd-source", "bsd-binary"))] == ["BSD-3-Clause", "BSD-2-Clause"]
    assert S.scan_text("x\n" * 50 + full("mit-permission") + "\ny" * 50 + "\n" + full("mit-notice", "mit-as-is"))[0][1] == "mit-permission-only"
    assert [r[:2] for r in S.scan_text("# SPDX-License-Identifier: Apache-2.0\ncode")] == [("Apache-2.0", "spdx-tag")]
    assert S.scan_text("The licensed driver is a person. Copyright is a word.") == []


BSD = ("bsd-permitted", "bsd-source", "bsd-binary")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (full(*BSD, "bsd-as-is"), ["BSD-2-Clause"]),
        (full(*BSD) + "\nNeither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        (full(*BSD, "bsd-endorse-author"), ["BSD-3-Clause"]),
        (full(*BSD) + "\nNobody may use our name to endorse or promote anything at all.", ["LicenseRef-BSD-endorsement"]),
        (full(*BSD) + "\none\ntwo\nthree\nfour\nfive\nNobody may use our name to endorse or promote anything.", ["LicenseRef-BSD-variant"]),
        (full(*BSD, "bsd-advertising", "bsd-endorse"), ["BSD-4-Clause"]),
        (full(*BSD, *BSD, "bsd-endorse"), ["BSD-2-Clause", "BSD-3-Clause"]),
        (full("bsd-permitted") + "\nYou may only whistle.", ["LicenseRef-BSD-variant"]),
        (full("mit-permission", "mit-notice", "mit-as-is", "x11-advertising"), ["X11"]),
        (full("mit-permission", "mit-notice", "json-good"), ["JSON"]),
        (full("mit0-permission"), ["MIT-0"]),
        (full("mit-permission", "ncsa-source"), ["NCSA"]),
        (full("gpl3.0-free-software", "gpl-no-warranty").replace("This program", "The Frobnicator suite"), ["GPL-3.0-or-later"]),
        (full("gpl2.0-free-software"), ["GPL-2.0-or-later"]),
        (full("lgpl2.1-free-software", "gpl-no-warranty"), ["LGPL-2.1-or-later"]),
        (full("cc-by-nc-sa-4-long"), ["CC-BY-NC-SA-4.0"]),
        ("Copyright (c) 2011 Google Inc. All rights reserved.\n" + full(*BSD, "bsd-endorse", "bsd-as-is"), ["BSD-3-Clause"]),
        ("Copyright 2011 Someone. All rights reserved.\nNo licence is given.", ["Proprietary"]),
        (full("mit-released") + "\nCopyright 2011 Someone. All rights reserved.", ["MIT", "Proprietary"]),
    ],
)
def test_licences(text, want):
    for form in (text, "\n".join(" * " + x for line in text.split("\n") for x in (textwrap.wrap(line, 72) or [""])), text.upper()):
        assert [r[0] for r in S.scan_text(form)] == want, form


def plain_identifiers(text):
    """Every piece against every known sentence, word by word."""
    pieces = [S.normal(s).split() for s in S.sentences(text)]
    words, ends, starts = [], {}, []
    for n, p in enumerate(pieces):
        starts.append(len(words))
        words += p
        ends[len(words)] = n

    def after(parts, at, first):
        if not parts:
            return {at}
        slot = range(1 if first else 0, S.SLOT + 1) if len(parts) < total else [0]
        return {e for skip in slot if words[at + skip : at + skip + len(parts[0])] == parts[0] and at + skip + len(parts[0]) <= len(words) for e in after(parts[1:], at + skip + len(parts[0]), False)}

    out, n = [], 0
    while n < len(pieces):
        best = None
        for k, s in S.SENTENCES.items():
            parts = S.parts(s)
            total = len(parts)
            lead = not parts[0]
            for e in after(parts[1:] if lead else parts, starts[n], lead):
                if e in ends and e > starts[n] and (best is None or e > best[0]):
                    best = (e, k)
        if best:
            out.append((n, ends[best[0]], best[1]))
            n = ends[best[0]] + 1
        else:
            n += 1
    return out


def test_against_a_plain_matcher():
    rng = random.Random(3)
    names = [k for k in S.SENTENCES if rng.random() < 0.35 or "{" in S.SENTENCES[k]]
    for _ in range(12):
        parts = []
        for k in rng.choices(names, k=3):
            words = filled(k).split()
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), "other")
            cut = sorted(rng.choices(range(len(words)), k=rng.randrange(4)))
            parts.append("".join(w + ("\n" if i in cut else " ") for i, w in enumerate(words)).strip())
            parts.append(rng.choice(["", "Some words.", "Permission is hereby granted", "is free software"]))
        text = "\n".join(parts)
        assert [x for x in S.identifiers(text) if x[2] != "endorsement"] == plain_identifiers(text), text


def test_every_rule_names_known_sentences():
    assert {k for _, _, wanted, refused in S.RULES for k in (*wanted, *refused)} == {*S.SENTENCES, "endorsement"} - {"bsd-as-is"}


def test_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {S.normal(s) for s in S.SENTENCES.values()}
    want = 0
    for r in docs.collect():
        want += sum(S.normal(line) in plain for line in r["text"].split("\n"))
    assert want and S.scan(docs).count() == want


def test_edge_rows(spark):
    line = S.SENTENCES["mit-released"]
    rows = [(1, line, "a"), (1, line, "a"), (2, None, "a"), (3, "", "a"), (None, line, "a"), (4, "filler. " * 100_000 + line, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert sorted((r["doc_id"] or 0) for r in S.scan(df).collect()) == [0, 1, 1, 4]
    assert S.scan(df.limit(0)).count() == 0

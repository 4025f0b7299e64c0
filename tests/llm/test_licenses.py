from __future__ import annotations

import re

from pyspark.sql import functions as F

from plansift.llm.license_scan import BARE_NEEDS_WORD, FIRST_GATE, GATE, LICENSES, PHRASES, SIGNATURES, SIGNED, detections, rules, scan, summary, word_count
from tests.llm.cases import clashing, documents, empty


def slow(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [p[0] for p in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))


TEXTS = [
    "Released under the MIT License.", "under the mit-license under THE  mit\nlicense", "Apache License, Version 2.0 and CC BY-NC 4.0", "cc by nc", "xcc by nc", "cc by ncx", "under the mit licenseé", "apache license version 2",
    "UNDER THE MIT LICENSE", "", None, "no words: \x00\x7f!", "under the", "İ under the mit license K", "cc\x7fby\x00nc", "under the MIT License " * 300,
]


def test_base_columns(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in summary(scan(d)).collect():
        assert tuple(r)[1:6] == slow(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_rules_are_ordered_and_many():
    own = rules()
    assert len(own) > 200 and [r[2] for r in own] == sorted(r[2] for r in own)
    assert all(re.compile(r[3]) for r in own) and len({r[1] for r in own}) == len(LICENSES)


def words_in(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


def slow_detections(text):
    low = words_in(text)
    found = [(m.start(), m.end(), p, b) for k, b, p, x in rules() if set(k.removeprefix(SIGNED).split()) <= low for m in re.finditer(x, text)]
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    return [d for i, d in enumerate(found) if not any(o[2] <= d[2] and o[0] <= d[0] and o[1] >= d[1] for o in found[:i])]


def test_detections_against_all_rules(spark):
    texts = [
        "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "see https://www.apache.org/licenses/LICENSE-2.0 and MIT license",
        "Licensed under CC BY-NC 4.0. Also CC BY-SA 4.0 and CC-BY 4.0", "distributed under the terms of the Mozilla Public License 2.0 (MPL)", "public domain. All rights reserved.", "mitigate the commit", "GNU LGPL version 2.1 or GNU GPL v2",
        "BSD 3-Clause license; Boost Software License; Eclipse Public License 2.0; ISC license", "",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", detections(F.col("t")).alias("f")).collect():
        assert [tuple(x) for x in r["f"]] == slow_detections(texts[r["i"]]), texts[r["i"]]


def test_odd_tables(spark):
    for d in (documents(spark), clashing(spark)):
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        rows = summary(scan(d)).collect()
        assert len(rows) == d.count()
        assert all(tuple(r)[1:6] == slow(texts[r["doc_id"]]) for r in rows)
    assert summary(scan(empty(spark))).count() == 0
    plan = summary(scan(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    # the rules themselves speak of Python, so operators are looked for by their names
    assert not re.search(r"\b(?:\w*Exchange|\w*EvalPython|MapIn\w+|\w*InPandas)\b", plan)


def plain(pattern):
    """A text that a pattern matches: first choices, optional parts left in, in their plain form."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\(\?[:!]((?:[^()|]|\|(?=\b\B))*)(?:\|[^()]*)?\)\??", lambda m: "" if m[0].startswith("(?!") else m[1], pattern)
    pattern = re.sub(r"\[(.)[^\]]*\]\??", r"\1", pattern)
    return re.sub(r"\\S\*", "x", re.sub(r"(?<!\\)\?", "", pattern)).replace("\\", "")


def test_no_rule_is_shut_out_by_the_gate_or_its_keyword():
    for label, (keyword, name, spdx, address) in LICENSES.items():
        texts = [plain(address), "SPDX-License-Identifier: " + plain(spdx), "released under the " + plain(name), plain(name) + " license"]
        if label not in BARE_NEEDS_WORD:
            texts.append(plain(name))
        for text in texts:
            hits = [r for r in rules() if r[1] == label and not r[0].startswith(SIGNED) and re.search(r[3], text)]
            assert hits, (label, text)
            assert re.search(GATE, text) and words_in(text) & set(FIRST_GATE) and any(set(r[0].split()) <= words_in(text) for r in hits), (label, text)


def every(pattern):
    """The texts of all alternatives, options and characters of classes of a pattern."""
    from itertools import product
    from re import _parser

    def of(items):
        texts = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                new = [chr(arg)]
            elif op == "IN":
                new = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1) if str(o) == "RANGE" else [ord("x")])]
            elif op == "BRANCH":
                new = [t for b in arg[1] for t in of(b)]
            elif op == "SUBPATTERN":
                new = of(arg[3])
            elif op == "MAX_REPEAT":
                new = ["", *of(arg[2])] if arg[0] == 0 else of(arg[2])
            else:
                assert op == "ASSERT_NOT", op
                continue
            texts = [a + b for a, b in product(texts, dict.fromkeys(new))]
        return texts

    return of(_parser.parse(pattern))


def test_no_alternative_is_shut_out():
    own, out = rules(), []
    for label, (_, name, spdx, address) in LICENSES.items():
        mine = [(r[0], re.compile(r[3]), r[3]) for r in own if r[1] == label and not r[0].startswith(SIGNED)]
        texts = every(address) + ["SPDX-License-Identifier: " + t for t in every(spdx)]
        for t in every(name):
            texts += ["released under the " + t, "made available under " + t, t + " license", t + " licence"] + [t] * (label not in BARE_NEEDS_WORD)
        for text in texts:
            low, hits = words_in(text), [r for r in mine if r[1].search(text)]
            tried = {x for k, _, x in hits if set(k.split()) <= low}
            if any(x not in tried for _, _, x in hits) or hits and not (re.search(GATE, text) and low & set(FIRST_GATE)):
                out.append((label, text))
    assert not out


def test_texts_that_the_prefilter_shut_out(spark):
    texts = ["see http://www.gnu.org/copyleft/fdl.html", "released under the PSF License", "the Python License, the PSF License"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", detections(F.col("t")).alias("f")).collect():
        found = [tuple(x) for x in r["f"]]
        assert found == slow_detections(texts[r["i"]]) and {x[3] for x in found} == {("gfdl", "python-2", "python-2")[r["i"]]}


#: Notices and openings of license texts as they stand in files.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("mit", " * The above copyright notice and this permission notice shall be included in all\n * copies or substantial portions of the Software."),
    ("ncsa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("bsd-0", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice"),
    ("bsd-3", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n# 1. keep\n# 3. Neither the name of the copyright holder nor"),
    ("bsd-4", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 3. All advertising materials mentioning features or use of this software 4. Neither the name of the University"),
    ("apache-2", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."),
    ("apache-2", "                                 Apache License\n                           Version 2.0, January 2004\n"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or"),
    ("gpl-3", "    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or"),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"), ("lgpl-3", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"), ("gpl-2", "distributed as GPLv2"), ("gpl-3", "GPL-v3"),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as\n published by the Free Software Foundation, either version 3 of the"),
    ("mpl-2", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"), ("zlib", "1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software."),
    ("epl-2", "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0"), ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost-1", "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("cddl-1", "The contents of this file are subject to the terms of the\nCommon Development and Distribution License"),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited"), ("public-domain", "This file has been placed in the public domain."),
]


def test_notices_and_texts(spark):
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)], "i int, t string")
    for r in d.select("i", detections(F.col("t")).alias("f")).collect():
        label, text = NOTICES[r["i"]]
        found = [tuple(x) for x in r["f"]]
        assert found == slow_detections(text), text
        assert {x[3] for x in found if x[2] == 3} == {label}, (label, found)


def sentence(pattern):
    """A text that a signature matches: first alternatives, options left out."""
    from re import _parser

    def of(items):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "BRANCH":
                out += of(arg[1][0])
            elif op == "SUBPATTERN":
                out += of(arg[3])
            elif op.endswith("REPEAT"):
                out += of(arg[2]) * arg[0]
            elif op == "ANY":
                out += "x"
            elif op == "IN":
                out += next((chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg if str(o) in ("LITERAL", "RANGE")), "x")
        return out

    return of(_parser.parse(pattern))


def test_every_signature_is_tried(spark):
    texts = [sentence(s) for _, _, s in SIGNATURES]
    assert len(SIGNATURES) > 60 and {s[0] for s in SIGNATURES} <= set(LICENSES)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", detections(F.col("t")).alias("f")).collect():
        label, keyword, _ = SIGNATURES[r["i"]]
        assert keyword in words_in(texts[r["i"]]), (keyword, texts[r["i"]])
        assert [tuple(x) for x in r["f"]] == slow_detections(texts[r["i"]]) and any(x["priority"] == 3 for x in r["f"]), (label, texts[r["i"]])


def test_word_counts(spark):
    texts = [t or "" for t in TEXTS] + [" ", "a", " a ", "a b", "\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", word_count(F.col("t")).alias("n")).collect():
        assert r["n"] == slow(texts[r["i"]])[0]

"""License detection with ordered signature rules, in DataFrame functions only.

Two kinds of rules, in one order of priority. Signatures are sentences of
licenses' own texts, of the notices they ask for and of file headers, each
written by hand (:data:`SIGNATURES`). Names are rules of four forms for each
license: an SPDX tag, the address of its text, a grant that names it, and the
bare name (:data:`LICENSES`). The rules of a keyword are tried on a text only
if the keyword's words are among those of the text and a pattern of all of them
together, which is a literal and so compiled once, has a match; names only in
texts that pass one cheap test besides. Detections that lie within a detection of the same or a
higher priority are suppressed.

Apart from the rules, fixed phrases are found by their words alone; those
places always count (:data:`PHRASES`).

Everything happens within a row: no shuffle, and no state across rows.

Defined cases: null counts as the empty text; texts without words have no
places and score 0; rows that repeat an id give a row each; an empty table
gives no rows; extra columns are never read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions.text import let

# Word classes in Java's regular expressions, either case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases by words, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: (keyword in lower case, name as a pattern, SPDX identifier as a pattern, address as a pattern)
LICENSES: dict[str, tuple[str, str, str, str]] = {
    "mit": ("mit", r"MIT(?:/X11)?", r"MIT(?:-0)?", r"opensource\.org/licenses?/mit"),
    "apache-1": ("apache", r"Apache(?: Software)?(?: License)?,? (?:version |v\.? ?)?1\.[01]", r"Apache-1\.[01]", r"apache\.org/licenses/LICENSE-1\.[01]"),
    "apache-2": ("apache", r"Apache(?: Software)?(?: License)?,? (?:version |v\.? ?)?2(?:\.0)?", r"Apache-2\.0", r"apache\.org/licenses/LICENSE-2\.0"),
    "bsd-0": ("bsd", r"(?:zero|0)[- ]clause BSD", r"0BSD", r"opensource\.org/licenses?/0bsd"),
    "bsd-2": ("bsd", r"(?:(?:simplified|freebsd|2-clause|two[- ]clause) BSD|BSD[- ](?:2|two)[- ]clause)", r"BSD-2-Clause", r"opensource\.org/licenses?/bsd-2-clause"),
    "bsd-3": ("bsd", r"(?:(?:new|modified|revised|3-clause|three[- ]clause) BSD|BSD[- ](?:3|three)[- ]clause)", r"BSD-3-Clause", r"opensource\.org/licenses?/bsd-3-clause"),
    "bsd-4": ("bsd", r"(?:(?:original|old|4-clause|four[- ]clause) BSD|BSD[- ](?:4|four)[- ]clause)", r"BSD-4-Clause", r"directory\.fsf\.org/wiki/License:BSD-4-Clause"),
    "isc": ("isc", r"ISC", r"ISC", r"opensource\.org/licenses?/isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)?", r"Zlib", r"opensource\.org/licenses?/zlib"),
    "boost-1": ("boost", r"Boost Software License(?:,? (?:version )?1\.0)?", r"BSL-1\.0", r"boost\.org/LICENSE_1_0"),
    "unlicense": ("unlicense", r"Unlicense", r"Unlicense", r"unlicense\.org"),
    "wtfpl": ("wtfpl", r"WTFPL", r"WTFPL", r"wtfpl\.net"),
    "gpl-1": ("gnu", r"GNU (?:General Public License|GPL),? (?:version |v\.? ?)1(?:\.0)?", r"GPL-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    "gpl-2": ("gnu", r"GNU (?:General Public License|GPL),? (?:version |v\.? ?)2(?:\.0)?", r"GPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3": ("gnu", r"GNU (?:General Public License|GPL),? (?:version |v\.? ?)3(?:\.0)?", r"GPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    "lgpl-2": ("gnu", r"GNU (?:Library General Public License|LGPL),? (?:version |v\.? ?)2(?:\.0)?(?!\.1)", r"LGPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    "lgpl-2.1": ("gnu", r"GNU (?:Lesser General Public License|LGPL),? (?:version |v\.? ?)2\.1", r"LGPL-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    "lgpl-3": ("gnu", r"GNU (?:Lesser General Public License|LGPL),? (?:version |v\.? ?)3(?:\.0)?", r"LGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    "agpl-3": ("gnu", r"GNU (?:Affero General Public License|AGPL),? (?:version |v\.? ?)3(?:\.0)?", r"AGPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    "gfdl": ("gnu", r"GNU (?:Free Documentation License|FDL)(?:,? (?:version |v\.? ?)1\.[123])?", r"GFDL-1\.[123](?:-only|-or-later)?", r"gnu\.org/(?:licenses/|copyleft/)fdl"),
    "mpl-1.1": ("mozilla", r"Mozilla Public License,? (?:version |v\.? ?)?1\.[01]", r"MPL-1\.[01]", r"mozilla\.org/MPL/1\.[01]"),
    "mpl-2": ("mozilla", r"Mozilla Public License,? (?:version |v\.? ?)?2(?:\.0)?", r"MPL-2\.0", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    "epl-1": ("eclipse", r"Eclipse Public License(?:,| -)? ?(?:version |v\.? ?)?1(?:\.0)?", r"EPL-1\.0", r"eclipse\.org/legal/epl-v10"),
    "epl-2": ("eclipse", r"Eclipse Public License(?:,| -)? ?(?:version |v\.? ?)?2(?:\.0)?", r"EPL-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    "cddl-1": ("common development", r"Common Development and Distribution License(?:,? (?:version )?1\.[01])?", r"CDDL-1\.[01]", r"opensource\.org/licenses?/cddl"),
    "cpl-1": ("common public", r"Common Public License(?:,? (?:version )?1\.0)?", r"CPL-1\.0", r"opensource\.org/licenses?/cpl"),
    "cpal-1": ("common public attribution", r"Common Public Attribution License(?:,? (?:version )?1\.0)?", r"CPAL-1\.0", r"opensource\.org/licenses?/cpal"),
    "eupl-1": ("european union", r"European Union Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.[0-2])?", r"EUPL-1\.[0-2]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    "osl-3": ("open software", r"Open Software License,? (?:version |v\.? ?)?3(?:\.0)?", r"OSL-3\.0", r"opensource\.org/licenses?/osl-3"),
    "afl-3": ("academic free", r"Academic Free License,? (?:version |v\.? ?)?3(?:\.0)?", r"AFL-3\.0", r"opensource\.org/licenses?/afl-3"),
    "artistic-1": ("artistic", r"Artistic License(?:,? (?:version )?1\.0)?(?! 2)", r"Artistic-1\.0(?:-Perl|-cl8)?", r"opensource\.org/licenses?/artistic-license-1\.0"),
    "artistic-2": ("artistic", r"Artistic License,? (?:version |v\.? ?)?2(?:\.0)?", r"Artistic-2\.0", r"opensource\.org/licenses?/artistic-license-2\.0"),
    "php-3": ("php", r"PHP License,? (?:version |v\.? ?)?3\.0?1?", r"PHP-3\.0[1]?", r"php\.net/license"),
    "python-2": ("python", r"(?:Python|PSF) (?:Software Foundation )?License(?: (?:version )?2)?", r"(?:Python|PSF)-2\.0", r"python\.org/psf/license"),
    "ruby": ("ruby", r"Ruby(?:'s)? License", r"Ruby", r"ruby-lang\.org/en/about/license"),
    "openssl": ("openssl", r"OpenSSL License", r"OpenSSL", r"openssl\.org/source/license"),
    "curl": ("curl", r"curl license", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    "postgresql": ("postgresql", r"PostgreSQL License", r"PostgreSQL", r"postgresql\.org/about/licence"),
    "ncsa": ("ncsa", r"(?:University of Illinois/)?NCSA Open Source License", r"NCSA", r"opensource\.org/licenses?/uoi-ncsa"),
    "upl-1": ("universal permissive", r"Universal Permissive License(?:,? (?:version |v\.? ?)?1\.0)?", r"UPL-1\.0", r"opensource\.org/licenses?/upl"),
    "ms-pl": ("microsoft", r"Microsoft Public License", r"MS-PL", r"opensource\.org/licenses?/ms-pl"),
    "ms-rl": ("microsoft", r"Microsoft Reciprocal License", r"MS-RL", r"opensource\.org/licenses?/ms-rl"),
    "blueoak-1": ("blue oak", r"Blue Oak Model License(?: 1\.0(?:\.0)?)?", r"BlueOak-1\.0\.0", r"blueoakcouncil\.org/license"),
    "beerware": ("beer", r"Beer-?ware License", r"Beerware", r"people\.freebsd\.org/~phk"),
    "sspl-1": ("server side", r"Server Side Public License(?:,? (?:version |v\.? ?)?1)?", r"SSPL-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    "busl-1.1": ("business source", r"Business Source License(?:,? (?:version )?1\.1)?", r"BUSL-1\.1", r"mariadb\.com/bsl11"),
    "elastic-2": ("elastic", r"Elastic License,? (?:version |v\.? ?)?2(?:\.0)?", r"Elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    "odbl-1": ("open database", r"Open (?:Data Commons Open )?Database License", r"ODbL-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by-1": ("open data commons", r"Open Data Commons Attribution License", r"ODC-By-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl-1": ("open data commons", r"Open Data Commons Public Domain Dedication", r"PDDL-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "ofl-1.1": ("open font", r"(?:SIL )?Open Font License(?:,? (?:version )?1\.[01])?", r"OFL-1\.[01]", r"scripts\.sil\.org/OFL"),
    "cc0": ("cc0", r"CC0(?: 1\.0)?(?: Universal)?", r"CC0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by": ("cc", r"(?:CC[- ]BY|Creative Commons Attribution)(?![- ](?:SA|NC|ND|Share|Non|No))(?:[- ]?[1-4]\.0)?", r"CC-BY-[1-4]\.0", r"creativecommons\.org/licenses/by/"),
    "cc-by-sa": ("cc", r"(?:CC[- ]BY[- ]SA|Creative Commons Attribution[- ]Share-?Alike)(?:[- ]?[1-4]\.0)?", r"CC-BY-SA-[1-4]\.0", r"creativecommons\.org/licenses/by-sa/"),
    "cc-by-nd": ("cc", r"(?:CC[- ]BY[- ]ND|Creative Commons Attribution[- ]No-?Deriv(?:ative)?s?)(?:[- ]?[1-4]\.0)?", r"CC-BY-ND-[1-4]\.0", r"creativecommons\.org/licenses/by-nd/"),
    "cc-by-nc": ("cc", r"(?:CC[- ]BY[- ]NC(?![- ](?:SA|ND))|Creative Commons Attribution[- ]Non-?Commercial(?![- ](?:Share|No)))(?:[- ]?[1-4]\.0)?", r"CC-BY-NC-[1-4]\.0", r"creativecommons\.org/licenses/by-nc/"),
    "cc-by-nc-sa": ("cc", r"(?:CC[- ]BY[- ]NC[- ]SA|Creative Commons Attribution[- ]Non-?Commercial[- ]Share-?Alike)(?:[- ]?[1-4]\.0)?", r"CC-BY-NC-SA-[1-4]\.0", r"creativecommons\.org/licenses/by-nc-sa/"),
    "cc-by-nc-nd": ("cc", r"(?:CC[- ]BY[- ]NC[- ]ND|Creative Commons Attribution[- ]Non-?Commercial[- ]No-?Deriv(?:ative)?s?)(?:[- ]?[1-4]\.0)?", r"CC-BY-NC-ND-[1-4]\.0", r"creativecommons\.org/licenses/by-nc-nd/"),
    "public-domain": ("public domain", r"public domain", r"LicenseRef-Public-Domain", r"creativecommons\.org/publicdomain/mark"),
    "proprietary": ("rights reserved", r"all rights reserved", r"LicenseRef-Proprietary", r"example\.invalid/proprietary-license"),
}

#: What parts words in a license text: blanks, and what comments and quotes put at the start of a line.
BETWEEN = r"[\s*#/;>|\"'`]+"
REDISTRIBUTION = "redistribution and use in source and binary forms, with or without modification, are permitted"
GRANT = "permission is hereby granted, free of charge, to any person"
OFFICIAL = "as published by the free software foundation"
#: label, keyword (one word in lower case), sentence: a blank stands for :data:`BETWEEN`, the rest is a pattern in either case.
SIGNATURES: list[tuple[str, str, str]] = [
    ("mit", "hereby", GRANT + r" obtaining a copy of this software and associated documentation files \(?the \W?software\W{0,2}\)?,? to deal in the software without restriction"),
    ("mit", "substantial", r"the above copyright notice and this permission notice( \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("ncsa", "hereby", GRANT + r" obtaining a copy of this software and associated documentation files \(?the \W?software\W{0,2}\)?,? to deal with the software without restriction"),
    ("boost-1", "hereby", GRANT + r" or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "hereby", r"permission to use, copy, modify,?( and|/or|and/or)* distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("bsd-0", "hereby", r"permission to use, copy, modify,?( and|/or|and/or)* distribute this software for any purpose with or without fee is hereby granted\."),
    ("postgresql", "hereby", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ofl-1.1", "hereby", GRANT + r" obtaining a copy of the font software, to use, study, copy, merge, embed, modify, redistribute"),
    ("upl-1", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software, associated documentation and/or data \(collectively"),
    ("bsd-2", "redistribution", REDISTRIBUTION + r"( \(subject to the limitations in the disclaimer below\))? provided that the following conditions are met"),
    ("bsd-3", "redistribution", REDISTRIBUTION + r"[\s\S]{0,1600}?neither the names? of"),
    ("bsd-4", "redistribution", REDISTRIBUTION + r"[\s\S]{0,1200}?all advertising materials mentioning features[\s\S]{0,600}?neither the names? of .{2}"),
    ("apache-1", "redistribution", REDISTRIBUTION + r"[\s\S]{0,1200}?this product includes software developed by the apache (software foundation|group)"),
    ("openssl", "openssl", r"this product includes (cryptographic )?software (developed|written) by the openssl project"),
    ("php-3", "php", r"this product includes php software, freely available from"),
    ("apache-2", "apache", r"licensed under the apache license, version 2(\.0)? \(?the \W?license\W{0,2}\)?; you may not use this file except in compliance with the license"),
    ("apache-2", "2004", r"apache license version 2\.0, january 2004"),
    ("apache-2", "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("gpl-1", "foundation", r"under the terms of the gnu general public license " + OFFICIAL + r"[;,] either version 1"),
    ("gpl-2", "foundation", r"under the terms of the gnu general public license " + OFFICIAL + r"[;,] (either )?version 2"),
    ("gpl-3", "foundation", r"under the terms of the gnu general public license " + OFFICIAL + r"[;,] (either )?version 3"),
    ("gpl-2", "gnu", r"under the terms of (the )?version 2 of the gnu general public license"),
    ("gpl-3", "gnu", r"under the terms of (the )?version 3 of the gnu general public license"),
    ("lgpl-2", "foundation", r"under the terms of the gnu library general public license " + OFFICIAL + r"[;,] (either )?version 2"),
    ("lgpl-2.1", "foundation", r"under the terms of the gnu lesser general public license " + OFFICIAL + r"[;,] (either )?version 2\.1"),
    ("lgpl-3", "foundation", r"under the terms of the gnu lesser general public license " + OFFICIAL + r"[;,] (either )?version 3"),
    ("agpl-3", "foundation", r"under the terms of the gnu affero general public license " + OFFICIAL + r"[;,] (either )?version 3"),
    ("gpl-1", "1989", r"gnu general public license version 1, february 1989"),
    ("gpl-2", "1991", r"gnu general public license version 2, june 1991"),
    ("gpl-3", "2007", r"gnu general public license version 3, 29 june 2007"),
    ("lgpl-2", "1991", r"gnu library general public license version 2, june 1991"),
    ("lgpl-2.1", "1999", r"gnu lesser general public license version 2\.1, february 1999"),
    ("lgpl-3", "2007", r"gnu lesser general public license version 3, 29 june 2007"),
    ("agpl-3", "2007", r"gnu affero general public license version 3, 19 november 2007"),
    ("gpl-2", "gplv2", r"\bgplv2(\.0)?\b"),
    ("gpl-3", "gplv3", r"\bgplv3(\.0)?\b"),
    ("lgpl-2.1", "lgplv2", r"\blgplv2\.1\b"),
    ("lgpl-3", "lgplv3", r"\blgplv3(\.0)?\b"),
    ("agpl-3", "agplv3", r"\bagplv3(\.0)?\b"),
    ("gpl-2", "gpl", r"\bgpl(-| )v?( )?2(\.0)?\b"),
    ("gpl-3", "gpl", r"\bgpl(-| )v?( )?3(\.0)?\b"),
    ("lgpl-2.1", "lgpl", r"\blgpl(-| )v?( )?2\.1\b"),
    ("lgpl-3", "lgpl", r"\blgpl(-| )v?( )?3(\.0)?\b"),
    ("agpl-3", "agpl", r"\bagpl(-| )v?( )?3(\.0)?\b"),
    ("gfdl", "documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.[01]"),
    ("epl-1", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v\. )?2\.0"),
    ("cpl-1", "accompanying", r"this program and the accompanying materials are made available under the terms of the common public license v1\.0"),
    ("cddl-1", "development", r"the contents of this file are subject to the terms of( either)? the common development and distribution license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", "liable", r"this software is provided as-is, without any express or implied warranty\. in no event will the authors? be held liable"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", r"do what the f.ck you want to public license"),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("curl", "daniel", r"copyright and permission notice copyright \(c\)[^\n]{0,80}daniel stenberg"),
    ("artistic-1", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "package", r"this license establishes the terms under which a given free software package may be copied, modified"),
    ("python-2", "python", r"python software foundation license version 2"),
    ("ms-pl", "accompanying", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("eupl-1", "eupl", r"licensed under the eupl"),
    ("osl-3", "licensed", r"licensed under the open software license version 3\.0"),
    ("afl-3", "academic", r"licensed under the academic free license version 3\.0"),
    ("busl-1.1", "governed", r"use of the licensed work (is|will be) governed by the business source license"),
    ("sspl-1", "server", r"under the terms of the server side public license, version 1"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "waived", r"to the extent possible under law,[^\n]{0,120}has waived all copyright and related or neighboring rights"),
    ("cc-by", "creative", r"licensed under a creative commons attribution [1-4]\.0"),
    ("cc-by-sa", "creative", r"licensed under a creative commons attribution-share( )?alike [1-4]\.0"),
    ("cc-by-nc", "creative", r"licensed under a creative commons attribution-non( )?commercial [1-4]\.0"),
    ("cc-by-nd", "creative", r"licensed under a creative commons attribution-no( )?deriv(ative)?s? [1-4]\.0"),
    ("cc-by-nc-sa", "creative", r"licensed under a creative commons attribution-non( )?commercial-share( )?alike [1-4]\.0"),
    ("cc-by-nc-nd", "creative", r"licensed under a creative commons attribution-non( )?commercial-no( )?deriv(ative)?s? [1-4]\.0"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("public-domain", "domain", r"(is|has been|are|was) (placed|dedicated|released)( in)?(to)? the public domain"),
    ("proprietary", "confidential", r"this (software|file|document) (is|contains) (the )?confidential( and proprietary)?( information)?"),
    ("proprietary", "proprietary", r"this (software|file|document) (is|contains) (the )?proprietary( and confidential)?( information)?"),
    ("proprietary", "strictly", r"unauthori[sz]ed (copying|use|distribution|reproduction)[^\n]{0,80}(is|are) strictly prohibited"),
]

#: A further keyword of licenses whose name need not hold the first.
SECOND_KEYWORDS = {"python-2": "psf", "beerware": "beerware", **dict.fromkeys((k for k in LICENSES if k.startswith("cc-by")), "creative")}
#: Names that mean something only beside the word license.
BARE_NEEDS_WORD = {"mit", "isc", "zlib", "ruby", "curl", "cc0", "cc-by", "wtfpl", "unlicense"}
#: Words of which every text that some rule matches has one.
GATE = r"(?i)licen[cs]|spdx|creative ?commons|\bcc[- ]by|\bcc0\b|public domain|rights reserved|gnu |gnu\.org|apache|mozilla|opensource\.org|unlicense|wtfpl|opendatacommons|dedication|boost|eclipse|bsd|sil\.org/ofl|/docs/copyright|bsl11|joinup\.|\b(?:released|distributed|available|published|provided)\s+under\b|redistribute\b"
#: Words in lower case of which every text that passes :data:`GATE` by a rule's match has one.
FIRST_GATE = (
    "license", "licence", "licensed", "licenced", "licenses", "licences", "licensing", "spdx", "creative", "creativecommons", "cc", "cc0", "domain", "reserved", "gnu", "apache", "mozilla", "opensource", "unlicense",
    "wtfpl", "opendatacommons", "dedication", "boost", "eclipse", "bsd", "freebsd", "ofl", "copyright", "bsl11", "joinup", "under", "redistribute",
)
#: What a detection of each priority is worth, in order: tag, address, signature, grant, name.
WORTH = (1.0, 0.95, 0.95, 0.9, 0.6)
#: What stands before the keyword of a signature, to tell it from one of a name.
SIGNED = "text: "


def rules(licenses: dict[str, tuple[str, str, str, str]] | None = None) -> list[tuple[str, str, int, str]]:
    """``(keyword, label, priority, pattern)`` in order of priority, then of the table."""
    forms = []
    for label, (keyword, name, spdx, address) in (licenses or LICENSES).items():
        bare = rf"\b{name} licen[cs]e\b" if label in BARE_NEEDS_WORD else rf"\b{name}"
        grant = rf"\b(?:licen[cs]ed|released|distributed|available|published|provided|made available|redistribute\b[^\n]{{0,60}})\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{name}\b"
        forms += [
            ("spdx", label, 1, rf"(?i)SPDX-License-Identifier:\s*\(?{spdx}(?![\w.-])"),
            (keyword if set(keyword.split()) <= set(re.findall(r"\w+", address.lower())) else "", label, 2, rf"(?i)\b(?:https?://)?(?:www\.)?{address}"),
            (keyword, label, 4, rf"(?i){grant}"),
            (keyword, label, 5, rf"(?i){bare}"),
        ]
        if label in SECOND_KEYWORDS:
            # a text with both keywords has each place twice; of equal detections one is suppressed
            forms += [(SECOND_KEYWORDS[label], *f[1:]) for f in forms[-2:]]
    if licenses is None:
        forms += [(SIGNED + keyword, label, 3, "(?i)" + sentence.replace(" ", BETWEEN)) for label, keyword, sentence in SIGNATURES]
    return sorted(forms, key=lambda r: r[2])


def _array(values: list[tuple]) -> Column:
    """A literal array of structs ``keyword, label, priority, pattern``."""
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(b).alias("label"), F.lit(p).alias("priority"), F.lit(r).alias("pattern")) for k, b, p, r in values])


def places(text: Column, pattern: Column, label: Column, priority: Column) -> Column:
    """Start, end, priority and label of every match: the lengths between matches and of matches, summed."""

    def sum_up(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)").alias("out"))

        def step(s: Column, m: Column) -> Column:
            a = s["at"] + F.char_length(F.element_at(between, s["k"] + 1))
            e = a + F.char_length(m)
            one = F.struct(a.alias("start"), e.alias("end"), priority.alias("priority"), label.alias("label"))
            return F.struct(e.alias("at"), (s["k"] + 1).alias("k"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(found, start, step, lambda s: s["out"])

    return let(F.regexp_extract_all(text, pattern, 0), sum_up)


def suppressed(found: Column) -> Column:
    """Detections that no other of the same or a higher priority contains, in order of their start.

    Sorted by start, then by the longer, a detection can only lie within one
    before it; of those the furthest end of each priority is enough to know.
    """

    def before(x: Column, y: Column) -> Column:
        key = lambda d: F.struct(d["start"], -d["end"], d["priority"], d["label"])
        return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)

    ends = [f"e{p}" for p in range(1, len(WORTH) + 1)]
    start = F.struct(*[F.lit(-1).alias(e) for e in ends], F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)").alias("out"))

    def step(s: Column, d: Column) -> Column:
        within = F.lit(False)
        for p, e in enumerate(ends, 1):
            within = within | ((d["priority"] >= p) & (s[e] >= d["end"]))
        return F.struct(
            *[F.when(d["priority"] == p, F.greatest(s[e], d["end"])).otherwise(s[e]).alias(e) for p, e in enumerate(ends, 1)],
            F.when(within, s["out"]).otherwise(F.concat(s["out"], F.array(d))).alias("out"),
        )

    return F.aggregate(F.array_sort(found, before), start, step, lambda s: s["out"])


def words_of(text: Column) -> Column:
    """The words of a text in lower case, with an empty one at an end that is a gap."""
    return F.split(F.lower(text), GAP)


def _keywords(table: list[tuple[str, str, int, str]]) -> list[str]:
    """Every word that a rule, a gate or a phrase looks for."""
    phrases = {w for p in PHRASES for w in p.split()}
    return sorted({w for k, _, _, _ in table for w in k.removeprefix(SIGNED).split()} | set(FIRST_GATE) | phrases)


def known_words(words: Column, licenses: dict[str, tuple[str, str, str, str]] | None = None) -> Column:
    """Those of a text's words that some rule, gate or phrase looks for: one pass over the words."""
    return F.array_intersect(words, F.array(*[F.lit(w) for w in _keywords(rules(licenses))]))


def detections(text: Column, licenses: dict[str, tuple[str, str, str, str]] | None = None, known: Column | None = None) -> Column:
    """The detections of a text that stay: an array of ``start, end, priority, label``, in characters.

    ``known`` are its :func:`known_words`, where a column has them already.
    """
    known = known_words(words_of(text), licenses) if known is None else known
    table = rules(licenses)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)")
    no_words = F.expr("cast(array() as array<string>)")
    together: dict[str, str] = {}
    for keyword, _, _, pattern in table:
        together[keyword] = f"{together[keyword]}|{pattern[4:]}" if keyword in together else pattern
    names = [k for k in together if not k.startswith(SIGNED)]
    signed = [k for k in together if k.startswith(SIGNED)]

    def of(own: Column) -> Column:
        def present(keyword: str) -> Column:
            stands = reduce(lambda a, b: a & b, [F.array_contains(own, w) for w in keyword.removeprefix(SIGNED).split()], F.lit(True))
            return F.when(stands & text.rlike(together[keyword]), F.lit(keyword))

        def with_words(tries: Column) -> Column:
            tried = F.filter(_array(table), lambda r: F.array_contains(tries, r["keyword"]))
            found = suppressed(F.flatten(F.transform(tried, lambda r: places(text, r["pattern"], r["label"], r["priority"]))))
            return F.when(F.size(tries) > 0, found).otherwise(empty)

        gate = F.arrays_overlap(own, F.array(*[F.lit(w) for w in FIRST_GATE])) & text.rlike(GATE)
        by_name = F.when(gate, F.array_compact(F.array(*map(present, names)))).otherwise(no_words)
        by_text = F.array_compact(F.array(*map(present, signed))) if signed else no_words
        return let(F.concat(by_name, by_text), with_words)

    return F.when(F.size(known) > 0, let(known, of)).otherwise(empty)


def _stands(words: Column, own: list[str]):
    return lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(own)])


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def phrase_places(words: Column, known: Column, phrases: dict[str, str] | None = None) -> Column:
    """``at, label`` of each place where a phrase's words stand one after the other, words counted from 0.

    ``words`` are those of :func:`words_of`.
    """
    phrases = phrases or PHRASES
    empty = F.expr("cast(array() as array<struct<at:int,label:string>>)")

    def of(own: Column) -> Column:
        n, found = F.size(own), []
        for phrase, label in phrases.items():
            parts = phrase.split()
            at = F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), _stands(own, parts))).otherwise(F.expr("cast(array() as array<int>)"))
            found.append(F.transform(at, _labelled(label)))
        return F.flatten(F.array(*found))

    # a text that lacks a word of each phrase has none
    some = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(known, w) for w in p.split()]) for p in phrases])
    return F.when(some, let(F.filter(words, lambda w: w != ""), of)).otherwise(empty)


def _count(parts: Column) -> Column:
    n = F.size(parts)
    return (n - (F.get(parts, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(parts, n - 1) == "")).cast("int")).cast("long")


def word_count(text: Column, gap: str = GAP) -> Column:
    """The number of words between gaps: the parts of the text without empty ones at its ends."""
    return let(F.split(text, gap), _count)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, tuple[str, str, str, str]] | None = None) -> DataFrame:
    """``doc_id, n_words, base, found``: the fixed phrases' places and the rules' detections."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    own = own.withColumn("known", known_words(F.col("words"), licenses))
    return own.select(
        "doc_id",
        _count(F.col("words")).alias("n_words"),
        phrase_places(F.col("words"), F.col("known")).alias("base"),
        detections(F.col("text"), licenses, F.col("known")).alias("found"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """One digest row per scanned text; the score is that of the detection worth most, 0 without any."""
    at = F.transform("base", lambda x: x["at"])
    base = F.transform("base", lambda x: x["label"])
    both = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda x: x["label"]))))
    worth = F.transform("found", lambda x: F.element_at(F.array(*[F.lit(w) for w in WORTH]), x["priority"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(worth), F.lit(0.0)), F.when(F.size("base") > 0, WORTH[3]).otherwise(0.0)).alias("score"),
    )

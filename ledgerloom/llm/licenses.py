"""License recognition by sentence rules, with built-in functions only.

Two tables drive it.  ``SENTENCES`` maps a normalised sentence to an identifier; ``RULES`` names,
for each license, the identifiers that must occur in a text in this order (others may stand
between).  A text is normalised into words with marks for the ends of sentences, paragraphs and
lines; known sentences are found in it, and the resulting identifier sequence is matched against
all rules.  Everything happens row by row inside one projection: no join, no shuffle, no Python.

Licenses are wrapped, stand in comments and have notices inside longer sentences.  So a single
line end, with any comment mark after it, is white space, as are colons and semicolons; a known
sentence matches inside a longer one, the longest first, but never across a blank line or the end
of a sentence.  Titles alone must fill a line or a sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licenses and usual notices, as normalised: identifier, sentence.
SENTENCES: list[tuple[str, str]] = [
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-is-licensed", "this project is licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache2-under", "licensed under the apache license version 2 0"),
    ("apache2-header", "licensed under the apache license version 2 0 the license"),
    ("apache2-comply", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-limits", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-licensed", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("lgpl-work", "this work is licensed under the gnu lesser general public license version 3"),
    ("cc-by-nc4", "licensed under cc by nc 4 0"),
    ("cc-by4", "licensed under cc by 4 0"),
    ("cc-by-sa4", "licensed under cc by sa 4 0"),
    ("cc-by-nc4-long", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by4-long", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa4-long", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd-permit", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-permit", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-endorse", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache2-text", "apache license version 2 0 january 2004"),
    ("gpl3-text", "gnu general public license version 3 29 june 2007"),
    ("gpl2-text", "gnu general public license version 2 june 1991"),
    ("lgpl3-text", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl3-text", "gnu affero general public license version 3 19 november 2007"),
    ("mpl2-text", "mozilla public license version 2 0"),
    ("epl2-text", "eclipse public license v 2 0"),
    ("gpl3-only", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl2-only", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-only", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 2 1 of the license"),
    ("lgpl3-only", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation version 3 of the license"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("wtfpl-terms", "you just do what the fuck you want to"),
    ("cc0-text", "creative commons legal code cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]

#: License and the identifiers that make it, in order.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-is-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache2-under"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("LGPL-3.0-only", ["lgpl-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-long"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC-BY-4.0", ["cc-by4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-long"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-permit"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-2.0", ["mpl2-text"]),
    ("Apache-2.0", ["apache2-text"]),
    ("Apache-2.0", ["apache2-copy", "apache2-as-is", "apache2-limits"]),
    ("GPL-3.0-only", ["gpl3-text"]),
    ("GPL-2.0-only", ["gpl2-text"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope"]),
    ("LGPL-3.0-only", ["lgpl3-text"]),
    ("AGPL-3.0-only", ["agpl3-text"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("LGPL-2.1-only", ["lgpl21-only", "lgpl-hope"]),
    ("LGPL-3.0-only", ["lgpl3-only", "lgpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("EPL-2.0", ["epl2-text"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("WTFPL", ["wtfpl-terms"]),
    ("CC0-1.0", ["cc0-text"]),
    ("Unlicense", ["unlicense"]),
]

#: Licenses and the names that notices and SPDX lines give them, without the words license and version;
#: the SPDX identifier itself is always one of them.  GNU licenses are named "-only" unless "or later" follows.
NAMES: dict[str, list[str]] = {
    "0BSD": ["zero clause bsd", "bsd zero clause", "bsd 0 clause"],
    "AFL-3.0": ["academic free 3 0"],
    "AGPL-1.0-only": ["affero general public 1"],
    "AGPL-3.0-only": ["gnu affero general public 3", "gnu affero general public 3 0", "affero general public 3", "gnu agpl 3", "gnu agpl 3 0", "agpl 3", "agpl 3 0", "agpl3"],
    "Apache-1.1": ["apache software 1 1", "apache 1 1"],
    "Apache-2.0": ["apache 2", "apache 2 0", "apache software 2 0", "apache software 2", "apache2", "asl 2 0"],
    "APSL-2.0": ["apple public source 2 0"],
    "Artistic-1.0": ["artistic 1 0"],
    "Artistic-2.0": ["artistic 2 0", "artistic 2"],
    "Beerware": ["beer ware", "beerware"],
    "BlueOak-1.0.0": ["blue oak model 1 0 0"],
    "BSD-1-Clause": ["1 clause bsd", "bsd 1 clause"],
    "BSD-2-Clause": ["2 clause bsd", "bsd 2 clause", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["3 clause bsd", "bsd 3 clause", "new bsd", "modified bsd", "revised bsd"],
    "BSD-3-Clause-Clear": ["bsd 3 clause clear", "clear bsd"],
    "BSD-4-Clause": ["4 clause bsd", "bsd 4 clause", "original bsd"],
    "BSL-1.0": ["boost software 1 0", "boost 1 0"],
    "BUSL-1.1": ["business source 1 1"],
    "CAL-1.0": ["cryptographic autonomy 1 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0", "creative commons attribution share alike 3 0 unported"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero 1 0 universal", "creative commons zero 1 0"],
    "CDDL-1.0": ["common development and distribution 1 0", "cddl 1 0"],
    "CDDL-1.1": ["common development and distribution 1 1", "cddl 1 1"],
    "CECILL-2.1": ["cecill 2 1"],
    "CPL-1.0": ["common public 1 0"],
    "ECL-2.0": ["educational community 2 0"],
    "EPL-1.0": ["eclipse public 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public 2 0", "eclipse public 2", "epl 2 0"],
    "EUPL-1.1": ["european union public 1 1", "eupl 1 1"],
    "EUPL-1.2": ["european union public 1 2", "eupl 1 2"],
    "GFDL-1.3-only": ["gnu free documentation 1 3"],
    "GPL-1.0-only": ["gnu general public 1", "gpl 1 0"],
    "GPL-2.0-only": ["gnu general public 2", "gnu general public 2 0", "gnu gpl 2", "gnu gpl 2 0", "gpl 2", "gpl 2 0", "gpl2"],
    "GPL-3.0-only": ["gnu general public 3", "gnu general public 3 0", "gnu gpl 3", "gnu gpl 3 0", "gpl 3", "gpl 3 0", "gpl3"],
    "HPND": ["historical permission notice and disclaimer"],
    "IPL-1.0": ["ibm public 1 0"],
    "ISC": ["isc"],
    "LGPL-2.0-only": ["gnu library general public 2", "lgpl 2 0"],
    "LGPL-2.1-only": ["gnu lesser general public 2 1", "gnu lgpl 2 1", "lgpl 2 1"],
    "LGPL-3.0-only": ["gnu lesser general public 3", "gnu lesser general public 3 0", "gnu lgpl 3", "gnu lgpl 3 0", "lgpl 3", "lgpl 3 0", "lgpl3"],
    "LPPL-1.3c": ["latex project public 1 3c"],
    "MIT": ["mit", "mit x11", "expat"],
    "MIT-0": ["mit no attribution", "mit 0"],
    "MPL-1.1": ["mozilla public 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public 2 0", "mozilla public 2", "mpl 2 0", "mpl 2"],
    "MS-PL": ["microsoft public"],
    "MS-RL": ["microsoft reciprocal"],
    "MulanPSL-2.0": ["mulan permissive software 2"],
    "NCSA": ["university of illinois ncsa open source"],
    "NPL-1.1": ["netscape public 1 1"],
    "ODbL-1.0": ["open database 1 0", "open data commons open database 1 0"],
    "OFL-1.1": ["sil open font 1 1", "open font 1 1", "ofl 1 1"],
    "OpenSSL": ["openssl"],
    "OSL-3.0": ["open software 3 0"],
    "PHP-3.01": ["php 3 01"],
    "PostgreSQL": ["postgresql"],
    "Python-2.0": ["python 2 0", "python software foundation 2"],
    "QPL-1.0": ["q public 1 0"],
    "Ruby": ["ruby"],
    "SSPL-1.0": ["server side public 1", "server side public 1 0"],
    "Unlicense": ["unlicense"],
    "UPL-1.0": ["universal permissive 1 0"],
    "Vim": ["vim"],
    "W3C": ["w3c software"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "X11": ["x11"],
    "Zlib": ["zlib", "zlib libpng"],
    "ZPL-2.1": ["zope public 2 1"],
}

#: A license is not named beside another one whose text holds its own, or whose notice says more.
WIDER: dict[str, list[str]] = {
    "BSD-2-Clause": ["BSD-3-Clause"],
    "GPL-2.0-only": ["GPL-2.0-or-later"],
    "GPL-3.0-only": ["GPL-3.0-or-later"],
    "LGPL-2.1-only": ["LGPL-2.1-or-later"],
    "LGPL-3.0-only": ["LGPL-3.0-or-later"],
    "AGPL-3.0-only": ["AGPL-3.0-or-later"],
}

#: Identifiers of titles: too short to mean anything inside a sentence, they fill a line or a sentence.
TITLES = {"mit-title", "mpl2-text", "epl2-text"}

_LINE_END = r"(?>\r\n?|\n)"
#: Comment marks that are words; those of other signs are no words anyway.
_MARK = r"(?:(?:dnl|@?rem)\b)?"
#: A blank line (a comment mark may stand in it), or . ! ? that white space follows or that ends the text (but not in 'v. 2.0').
SENTENCE_END = _LINE_END + r"[^\p{L}\p{N}\r\n]*" + _MARK + r"[^\p{L}\p{N}\r\n]*(?=[\r\n])|(?<!\bv)[.!?]+(?=\s|$)"
#: A line end with the comment mark after it, or : ; that white space follows or that ends the text.
PART_END = _LINE_END + r"[^\p{L}\p{N}\r\n]*" + _MARK + r"|[:;]+(?=\s|$)"


_GAP = "[ ~]"
_FILL = "(?:license|licence|version|ver|v)"
_LATER = f"or{_GAP}(?:at{_GAP}your{_GAP}option{_GAP})?(?:any{_GAP})?(?:later|newer)(?:{_GAP}versions?)?"
#: What stands before a name: licensed under, released under (and then the word license), "License:", SPDX lines, links.
_LEAD = f"(?:{_GAP}(?:the|terms|and|conditions|of|a|an))*{_GAP}"
FRAMES = [
    f"licen[sc]ed{_GAP}under{_LEAD}",
    f"(?:released|distributed|available|provided|published|offered|covered|governed){_GAP}(?:under|by){_LEAD}",
    "licen[sc]e~",
    f"spdx{_GAP}license{_GAP}identifier{_GAP}",
    f"opensource{_GAP}org{_GAP}licenses?{_GAP}",
]
_LINK = f"creativecommons{_GAP}org{_GAP}licenses{_GAP}"


def _plain(name: str) -> str:
    """An SPDX identifier in the words of a normalised text."""
    return " ".join(re.sub("[^a-z0-9]+", " ", name.lower()).split())


def _slug(name: str) -> str:
    return "named-" + _plain(name).replace(" ", "-")


def named_licenses(names: dict[str, list[str]] = NAMES) -> dict[str, str]:
    """Every name, as ``_bare`` leaves it, with its license; GNU ones with their later form."""
    out: dict[str, str] = {}
    for license_, spoken in names.items():
        gnu = license_.endswith("-only")
        base = license_.removesuffix("-only")
        for name in (_plain(license_), _plain(base), *spoken):
            name = " ".join(w for w in name.split() if not re.fullmatch(_FILL, w))
            out.setdefault(name, license_)
            if gnu:
                root = name.removesuffix(" only")
                out.setdefault(f"{root} only", license_)
                out.setdefault(f"{root} or later", f"{base}-or-later")
    return out


def _name_pattern(names: dict[str, str]) -> str:
    """Any of the names, with license and version between their words, v before a number, and what follows GNU names."""
    between = f"(?:{_GAP}{_FILL})*{_GAP}"
    roots = {n.removesuffix(" only").removesuffix(" or later") for n in names}
    one = lambda n: between.join(f"v?{w}" if w[0].isdigit() else w for w in n.split())
    return f"(?:{'|'.join(one(n) for n in sorted(roots, key=lambda n: (-len(n), n)))})(?![a-z0-9])(?:{_GAP}only(?![a-z0-9])|(?:{_GAP}{_FILL})?{_GAP}{_LATER}(?![a-z0-9]))?"


def notice_pattern(names: dict[str, str]) -> str:
    """Notices that name a license, not after a negation: the frame, then a name; SPDX lines hold expressions."""
    name = _name_pattern(names)
    word = f"{_GAP}licen[sc]e(?![a-z0-9])"
    expression = f"{name}(?:{_GAP}with(?:{_GAP}[a-z0-9]+){{1,6}}?{_GAP}exception(?:{_GAP}[0-9]+)*)?"
    under, offered, field, spdx, link = FRAMES
    any_of = [f"{under}{name}", f"{offered}{name}{word}", f"{offered}(?=(?:[a-z]+{_GAP}){{1,5}}licen[sc]e{_GAP}(?:version{_GAP})?v?[0-9]){name}", f"{field}{name}(?=[|~]|$)", f"{spdx}{expression}(?:{_GAP}(?:or|and){_GAP}{expression})*", f"{link}{name}", f"{_LINK}by(?:{_GAP}(?:nc|nd|sa))*{_GAP}[0-9]{_GAP}0(?![0-9a-z])"]
    return rf"(?<![a-z0-9])(?<!\bnot{_GAP})(?<!n{_GAP}t{_GAP})(?:{'|'.join(any_of)})"


def _notice_ids(notice: Column, table: Column) -> Column:
    """The identifiers of the licenses that a notice names, in order."""
    body = F.regexp_replace(F.translate(notice, "~", " "), "^creativecommons org licenses ", "cc ")
    body = F.regexp_replace(body, "^(?:" + "|".join(f.replace(_GAP, " ").replace("~", " ") for f in FRAMES) + ")", "")
    body = F.regexp_replace(body, f"\\b{_LATER.replace(_GAP, ' ')}", "or later")
    parts = F.split(body, r" (?:or|and) (?!later|distribution\b|disclaimer\b)")
    bare = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, " with .*", ""), r"\bv(?=[0-9])", ""), rf"\b{_FILL}\b ?", ""))
    return F.filter(F.transform(parts, lambda p: F.element_at(table, bare(p))), lambda k: k.isNotNull())


def trigger_pattern(sentences: list[tuple[str, str]] = SENTENCES) -> str:
    """Words of which every known sentence has one: a text without any holds no known sentence."""
    left, words = [s.split() for _, s in sentences], []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in set(s):
                if len(w) >= min(6, max(map(len, s))):  # of short words the longest
                    counts[w] = counts.get(w, 0) + 1
        best = max(sorted(counts), key=counts.get)
        words.append(best)
        left = [s for s in left if best not in s]
    return "(?i)" + "|".join(words)


#: Words of which every notice has one.
NOTICE_WORDS = "licen[sc]e|spdx|creativecommons|opensource"


def _lookup(sentences: list[tuple[str, str]]) -> Column:
    known = dict((s, k) for k, s in sentences)
    return F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))


def sentence_pattern(sentences: list[tuple[str, str]]) -> str:
    """Known sentences in the words that ``marked_words`` gives, the longest first.

    Not after a negation, and not before 'or any later version', which makes another license.
    """
    gap = "[ ~]"
    any_of = lambda some: "|".join(gap.join(s.split()) for s in sorted(some, key=lambda s: (-len(s), s)))
    titles = {s for k, s in sentences if k in TITLES}
    whole = rf"(?<![a-z0-9 ])(?:{any_of(titles)})(?![a-z0-9 ])" if titles else ""
    later = rf"(?!{gap}(?:or|and){gap}(?:at{gap}your{gap}option{gap})?(?:any{gap})?(?:later|newer|greater|higher|above)(?![a-z0-9]))"
    inside = rf"(?<![a-z0-9])(?<!\bnot{gap})(?<!n{gap}t{gap})(?:{any_of({s for _, s in sentences} - titles)})(?![a-z0-9]){later}"
    return f"{inside}|{whole}" if whole else inside


def marked_words(text: Column) -> Column:
    """Lower-case ASCII words and numbers; between two of them a blank, ``~`` (end of a line or part) or ``|`` (of a sentence)."""
    out = F.regexp_replace(F.lower(text), "[|~]", " ")
    out = F.regexp_replace(out, r"(?<=[0-9])\+(?=[^0-9a-z+]|$)", " or later")  # GPL-2.0+
    for pattern, mark in ((SENTENCE_END, "|"), (PART_END, "~"), ("[^a-z0-9|~]+", " "), (r"[ ~]*\|[ ~|]*", "|"), (" ?~[ ~]*", "~")):
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, names: dict[str, list[str]] = NAMES) -> DataFrame:
    """Known license sentences and the licenses they make, for every document.

    Besides ``sentences`` there are notices that name a license: "released under the ... license",
    "License: ...", SPDX lines with their expressions (exceptions are left out), and links; a name of
    ``names`` in one is the identifier ``named-...`` and makes its license by itself.  Texts of any
    length are scanned whole.  Where a sentence and a notice start at the same word the sentence counts;
    of sentences that start together the longest one.

    Columns: doc_id, sentence_ids (comma-joined identifiers in text order), licenses (matched
    names, distinct and sorted, comma-joined), n_sentences (known ones) and n_licenses.  Null and
    empty texts, and those without a known sentence, have empty strings and zeros.  One row for
    each input row, repeated or null doc_ids included; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    table = _lookup(sentences)
    named = named_licenses(names)
    slugs = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*(F.lit(_slug(k)) for k in named.values())))
    rules = [*rules, *((k, [_slug(k)]) for k in sorted(set(named.values())))]
    met = F.regexp_extract_all(marked_words(body), F.lit(f"{sentence_pattern(sentences)}|{notice_pattern(named)}"), F.lit(0))
    known = lambda s: F.element_at(table, F.translate(s, "~", " "))
    ids = F.flatten(F.transform(met, lambda s: F.when(known(s).isNotNull(), F.array(known(s))).otherwise(_notice_ids(s, slugs))))
    empty = F.array().cast("array<string>")
    found = docs.select(F.col(doc_id).alias("doc_id"), F.when(body.rlike(f"{trigger_pattern(sentences)}|{NOTICE_WORDS}"), ids).otherwise(empty).alias("_ids"))
    line = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    wanted = [F.when(line.rlike("," + ",(?:[^,]+,)*".join(steps) + ","), F.lit(name)) for name, steps in rules]
    names = F.array_sort(F.array_distinct(F.filter(F.array(*wanted), lambda k: k.isNotNull())))
    found = found.withColumn("_all", F.when(F.size("_ids") > 0, names).otherwise(empty))
    narrow = [F.when(F.arrays_overlap("_all", F.array(*map(F.lit, others))), F.lit(name)) for name, others in WIDER.items()]
    found = found.withColumn("_names", F.array_except("_all", F.array(*narrow)))
    return found.select(
        "doc_id",
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join("_names", ",").alias("licenses"),
        F.size("_ids").cast("long").alias("n_sentences"),
        F.size("_names").cast("long").alias("n_licenses"),
    )


def duckdb_sql() -> str:
    """The scan as DuckDB SQL over the view ``documents``, for texts whose known sentences and notices are whole lines or sentences of a line."""
    known = dict((s, k) for k, s in SENTENCES)
    pairs = ", ".join(f"('{s}', '{k}')" for s, k in known.items())
    named = named_licenses()
    spoken = ", ".join(f"('{n}', '{_slug(k)}')" for n, k in named.items())
    lead = "(?:the |terms |and |conditions |of |a |an )*"
    frame = f"^(?:licen[sc]ed under {lead}(.*)|(?:released|distributed|available|provided|published|offered|covered|governed) (?:under|by) {lead}(.*licen[sc]e.*)|spdx license identifier (.*))$"
    every_rule = [*RULES, *((k, [_slug(k)]) for k in sorted(set(named.values())))]
    checks = ", ".join(f"CASE WHEN regexp_matches(line, '{',' + ',(?:[^,]+,)*'.join(steps) + ','}') THEN '{name}' END" for name, steps in every_rule)
    narrow = ", ".join(f"CASE WHEN list_has_any(all_names, [{', '.join(repr(o) for o in others)}]) THEN '{name}' END" for name, others in WIDER.items())
    return rf"""
WITH known(sentence, id) AS (VALUES {pairs}), spoken(name, id) AS (VALUES {spoken}),
parts AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '[.!?:;]+(\s|$)', E'\n', 'g'), '[\r\n]+')) AS s,
         generate_subscripts(string_split_regex(regexp_replace(coalesce(text, ''), '[.!?:;]+(\s|$)', E'\n', 'g'), '[\r\n]+'), 1) AS i
  FROM documents),
plain AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
bare AS (SELECT *, trim(regexp_replace(regexp_replace(concat(regexp_extract(s, '{frame}', 1), regexp_extract(s, '{frame}', 2), regexp_extract(s, '{frame}', 3)), 'v([0-9])', '', 'g'), '(?:license|licence|version|ver|v) ?', '', 'g')) AS name FROM plain),
met AS (SELECT p.doc_id, string_agg(coalesce(k.id, n.id), ',' ORDER BY p.i) AS ids, count(*) AS n
        FROM bare p LEFT JOIN known k ON p.s = k.sentence LEFT JOIN spoken n ON p.name = n.name WHERE k.id IS NOT NULL OR n.id IS NOT NULL GROUP BY p.doc_id),
lines AS (SELECT d.doc_id, coalesce(m.ids, '') AS ids, coalesce(m.n, 0) AS n, ',' || coalesce(m.ids, '') || ',' AS line
          FROM documents d LEFT JOIN met m ON d.doc_id = m.doc_id),
every AS (SELECT *, list_sort(list_distinct(list_filter([{checks}], lambda x: x IS NOT NULL))) AS all_names FROM lines),
named AS (SELECT *, list_filter(all_names, lambda x: NOT list_contains([{narrow}], x)) AS names FROM every)
SELECT doc_id, ids AS sentence_ids, array_to_string(names, ',') AS licenses, n AS n_sentences, len(names) AS n_licenses FROM named
"""

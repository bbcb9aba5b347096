"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to words with one space between them.  Each rule has a label, a priority, a
keyword and a regular expression over such words.  A rule is tried on a text only if its keyword occurs there, so most
texts meet no expression at all.  A detection that lies inside another's interval gives way to it if that one has the
better priority, or the same priority and comes first by (longer, earlier rule); so `gpl 3 0 or later` hides the `gpl`
inside it.  Everything happens within a row: nothing is shuffled, and a hot source or copy costs no more than any row;
a text's detections are placed and sifted in one sweep, so that many of them cost in proportion.

Defined results: a null text is empty; a text without a word has no detections and score 0; rules match whole words;
repeated rows are scanned alike; an empty table gives none; only the text column is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Score of a detection by priority: identifier, body text, name with version, name, notice.
SCORES = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.4}
#: Every rule needs one of these: its keyword holds it, or each text that its expression matches does.
STEMS = (
    "licen", "gpl", "cc by", "cc0", "creative", "clause", "wtfpl", "rights reserved", "alle rechte", "tous droits", "todos los derechos", "no part of", "confidential", "unauthori",
    "copyright", "public domain", "hereby granted", "without warranty", "binary forms", "endorse", "advertising", "in compliance", "free software", "altered", "the fuck", "beer", "permission", "deal in the software",
)

Rule = tuple[str, int, str, str]

#: Wording of license texts: label, keyword, expression.
SIGNATURES = [
    ("mit", "permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies"),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", "dealings in the software", "(?:out of or in connection with|arising from) the software or the use or other dealings in the software without warranty"),
    ("mit-advertising", "advertising", "except as contained in this notice the name (?:\\S+ ){1,12}shall not be used in advertising"),
    ("mit-0", "no attribution", "mit no attribution(?: licen[sc]e)?"),
    ("x11", "x consortium", "the x consortium licen[sc]e|copyright (?:\\S+ ){0,4}x consortium"),
    ("isc", "disclaims all warranties", "the author disclaims all warranties with regard to this software(?: including all implied warranties)? copyright"),
    ("isc", "internet systems consortium", "copyright (?:\\S+ ){0,6}internet systems consortium"),
    ("0bsd", "fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", "list of conditions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "this product includes software developed by the university of california berkeley and its contributors advertising"),
    ("bsd-2-clause-patent", "patent", "clause bsd(?: licen[sc]e)? plus patent(?: grant)?"),
    ("bsd-3-clause-clear", "clear bsd", "(?:the )?clear bsd licen[sc]e"),
    ("apache-2.0", "grant of copyright", "grant of copyright licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants"),
    ("apache-2.0", "grant of patent", "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", "apache", "apache licen[sc]e version 2 0 january 2004"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation(?: http www apache org)?(?= )(?=.{0,400}licen)"),
    ("gpl", "free software", "this program is free software"),
    ("gpl", "fifth floor", "free software foundation inc 51 franklin (?:street|st) fifth floor boston"),
    ("gpl", "temple place", "free software foundation inc 59 temple place(?: suite 330)? boston"),
    ("gpl", "should have received", "you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("gpl-2", "gnu general public", "gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3", "gnu general public", "gnu general public licen[sc]e version 3 29 june 2007"),
    ("gpl-3", "copyleft", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("gpl-classpath", "classpath", "gpl (?:\\S+ ){0,4}classpath exception|general public licen[sc]e (?:\\S+ ){0,4}classpath exception"),
    ("gpl-linking", "linking exception", "gpl (?:\\S+ ){0,4}linking exception|general public licen[sc]e (?:\\S+ ){0,4}linking exception"),
    ("gpl-gcc", "runtime library exception", "gcc runtime library exception(?= )(?=.{0,400}licen)"),
    ("lgpl", "should have received", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this library"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3", "lesser general", "gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("agpl-3", "affero", "gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public licen[sc]e"),
    ("agpl", "interacting with it remotely", "users interacting with it remotely through a computer network (?:\\S+ ){0,40}licen[sc]e"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https?|licen[sc]e)"),
    ("mpl-2.0", "secondary licen", "incompatible with secondary licen[sc]es"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e v ?1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e v ?2 0"),
    ("edl-1.0", "eclipse distribution", "eclipse distribution licen[sc]e(?: v| version)? 1 0"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl", "common public", "accompanying materials are made available under the terms of the common public licen[sc]e"),
    ("ipl-1.0", "ibm public", "ibm public licen[sc]e(?: version)? 1 0"),
    ("spl", "sun public", "sun public licen[sc]e(?: version)?(?: 1 0)?"),
    ("npl", "netscape public", "netscape public licen[sc]e(?: version)?(?: 1 [01])?"),
    ("qpl", "q public", "(?:the )?q public licen[sc]e(?: version)?(?: 1 0)?"),
    ("rpl", "reciprocal public", "reciprocal public licen[sc]e(?: version)?(?: 1 [0-9])?"),
    ("sleepycat", "sleepycat", "(?:the )?sleepycat(?: public)? licen[sc]e"),
    ("sissl", "sun industry", "sun industry standards source licen[sc]e"),
    ("cecill", "cecill", "(?:ce ?cill|cecill)(?: [abc])?(?: free software)? licen[sc]e(?: agreement)?"),
    ("cecill", "licence cecill", "(?:la )?licence cecill(?: [abc])?"),
    ("eupl", "eupl", "licen[sc]ed under the eupl"),
    ("zlib", "arising from the use", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software (?:\\S+ ){0,30}altered"),
    ("libpng", "libpng", "(?:the )?(?:libpng|png reference library) licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit(?= )(?=.{0,600}licen)"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young(?= )(?=.{0,600}licen)"),
    ("curl", "curl", "(?:the )?curl licen[sc]e"),
    ("icu", "unicode", "(?:icu|unicode(?: inc)?) licen[sc]e(?: agreement)?(?: data files and software)?"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("ntp", "ntp", "(?:the )?ntp licen[sc]e(?: attribution)?"),
    ("w3c", "w3c", "w3c(?: software)?(?: and document)?(?: notice and)? licen[sc]e"),
    ("vim", "vim", "(?:the )?vim licen[sc]e"),
    ("ruby", "ruby", "(?:the )?ruby(?: s)? licen[sc]e|same terms as ruby(?: itself)? licen[sc]e"),
    ("perl", "perl", "(?:under )?the same terms as (?:perl(?: itself)?|the perl (?:5 )?programming language)(?= )(?=.{0,300}licen)"),
    ("artistic", "artistic", "the artistic licen[sc]e preamble"),
    ("tcl", "tcl", "tcl(?: tk)? licen[sc]e"),
    ("sqlite", "good and not evil", "may you do good and not evil (?:\\S+ ){0,40}public domain|public domain (?:\\S+ ){0,60}may you do good and not evil"),
    ("json", "good not evil", "the software shall be used for good not evil(?= )(?=.{0,600}warranty|.{0,600}licen)"),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[sc]e"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e(?: upl)?(?: version)?(?: 1 0)?"),
    ("blueoak", "blue oak", "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("mulan", "mulan", "mulan(?: psl| permissive software licen[sc]e)(?: v2)?(?= )(?=.{0,300}licen)"),
    ("sspl-1.0", "server side public", "server side public licen[sc]e(?: v ?1| version 1)?"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: 2 0| v2)?"),
    ("confluent", "confluent community", "confluent community licen[sc]e(?: agreement)?(?: version 1 0)?"),
    ("commons-clause", "commons clause", "commons clause(?: licen[sc]e)? condition(?: v1 0)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e(?: 1 0 0)?"),
    ("prosperity", "prosperity", "(?:the )?prosperity public licen[sc]e(?: 3 0 0)?"),
    ("openrail", "rail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m| [a-z]+)? licen[sc]e"),
    ("rail", "responsible ai", "responsible ai licen[sc]e"),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[sc]e"),
    ("pddl", "public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cdla", "community data", "community data licen[sc]e agreement(?: permissive| sharing)?"),
    ("ogl-uk", "open government", "open government licen[sc]e(?: v[123](?: 0)?)?"),
    ("dl-de", "datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?(?: version)? 2 0(?= )(?=.{0,300}licen)"),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?"),
    ("cc0", "waived all copyright", "to the extent possible under law (?:\\S+ ){0,12}has waived all copyright"),
    ("cc0", "no copyright", "cc0 1 0 universal|no copyright (?:\\S+ ){0,8}public domain dedication"),
    ("cc-by-sa", "build upon", "if you (?:remix transform or build upon|alter transform or build upon) (?:\\S+ ){0,20}share ?alike licen[sc]e"),
    ("cc", "creative commons", "creative commons corporation is not a law firm"),
    ("cc", "creativecommons", "creativecommons org publicdomain (?:zero|mark) 1 0"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts (?:\\S+ ){0,30}licen[sc]e"),
    ("ofl-1.1", "reserved font name", "with reserved font name (?:\\S+ ){0,40}open font licen[sc]e"),
    ("lppl", "latex project", "latex project public licen[sc]e(?: version| v)?(?: 1 [0-3][abc]?)?"),
    ("fal", "free art", "free art licen[sc]e(?: 1 [0-3])?|licence art libre"),
    ("gutenberg", "gutenberg", "(?:full )?project gutenberg(?: tm)? licen[sc]e"),
    ("nasa", "nasa open source", "nasa open source agreement(?: version)?(?: 1 3)?(?= )(?=.{0,400}licen)"),
    ("ecl", "educational community", "educational community licen[sc]e(?: version)?(?: 2 0)?"),
    ("wxwindows", "wxwindows", "wxwindows(?: library)? licen[sc]e"),
    ("ftl", "freetype", "(?:the )?freetype(?: project)? licen[sc]e"),
    ("ijg", "independent jpeg", "independent jpeg group(?: s)?(?: free)?(?: software)? licen[sc]e"),
    ("intel", "intel", "intel (?:simplified software|open source|sample source code) licen[sc]e"),
    ("nvidia", "nvidia", "nvidia(?: software)? (?:end user )?licen[sc]e(?: agreement)?"),
    ("oracle-bcl", "binary code", "oracle binary code licen[sc]e(?: agreement)?"),
    ("eula", "end user licen", "end user licen[sc]e agreement"),
    ("shareware", "shareware", "shareware (?:licen[sc]e|version|program) (?:\\S+ ){0,20}licen[sc]e"),
]
#: Wording of notices.
NOTICES = [
    ("reserved", "rights reserved", "no rights reserved"),
    ("reserved", "diritti", "tutti i diritti riservati|todos os direitos reservados (?:\\S+ ){0,6}copyright"),
    ("reserved", "copyright", "copyright (?:\\S+ ){1,10}all rights reserved"),
    ("proprietary", "confidential", "this (?:document|software|material) (?:is|contains) (?:\\S+ ){0,6}confidential"),
    ("proprietary", "trade secret", "(?:contains|protected as) trade secrets? (?:\\S+ ){0,20}(?:confidential|copyright)"),
    ("proprietary", "prior written", "without the(?: express)? prior written (?:permission|consent) of"),
    ("proprietary", "non transferable", "non exclusive non transferable (?:\\S+ ){0,6}licen[sc]e"),
    ("non-commercial", "commercial use", "(?:not for|no|non) commercial use (?:\\S+ ){0,12}(?:permission|licen[sc]e)"),
    ("copyright", "copyright", "copyright (?:owner|holder)s? (?:or|and) contributors"),
    ("copyright", "urheberrecht", "urheberrechtlich geschützt (?:\\S+ ){0,12}copyright"),
    ("copyright", "droit d", "protégé par le droit d auteur (?:\\S+ ){0,12}copyright"),
    ("attribution", "with permission", "(?:reprinted|reproduced|used) with permission"),
    ("warranty", "without warranty", "without warranty of any kind"),
    ("warranty", "merchantability", "implied warrant(?:y|ies) of merchantability (?:\\S+ ){0,20}(?:licen[sc]e|permission|copyright)"),
    ("public-domain", "public domain", "no known copyright restrictions (?:\\S+ ){0,20}public domain|(?:is|are) in the public domain"),
]


def _named(label: str, keyword: str, name: str, versions: dict[str, str], *, ids: tuple[str, ...] = ()) -> list[Rule]:
    """Rules for a license family: identifiers, `released under` phrases, names with and without each version."""
    under = f"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}"
    rules: list[Rule] = [(label, 4, keyword, name), (label, 3, keyword, under)]
    for version, pattern in versions.items():
        full = f"{label}-{version}"
        rules += [
            (full, 3, keyword, f"{name}(?: version| v| ver)? ?{pattern}"),
            (full, 3, keyword, f"{under}(?: licen[sc]e)?(?: version| v)? ?{pattern}"),
            (full + "-or-later", 3, keyword, f"{name}(?: version| v| ver)? ?{pattern} or (?:\\(?at your option\\)? )?(?:any )?(?:later|newer)(?: version)?"),
        ]
    for i in ids:
        rules.append((label, 1, "spdx", f"spdx licen[sc]e identifier {i}(?: only| or later)?"))
        for version, pattern in versions.items():
            rules.append((f"{label}-{version}", 1, "spdx", f"spdx licen[sc]e identifier {i} {pattern}(?: only| or later)?"))
    return rules


def _versions(*numbers: str) -> dict[str, str]:
    return {n: n.replace(".", " ") + ("" if "." in n else "(?: 0)?") for n in numbers}


def rules() -> list[Rule]:
    """All rules in their order."""
    out: list[Rule] = []
    lic = "(?: public)? licen[sc]e"
    out += _named("gpl", "general public", f"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[sc]e", _versions("1", "2", "3"), ids=("gpl",))
    out += _named("gpl", "gpl", "(?:gnu )?gpl", _versions("1", "2", "3"))
    out += _named("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", _versions("2.1", "3"), ids=("lgpl",))
    out += _named("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", _versions("2"))
    out += _named("lgpl", "lgpl", "(?:gnu )?lgpl", _versions("2", "2.1", "3"))
    out += _named("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", _versions("1", "3"), ids=("agpl",))
    out += _named("agpl", "agpl", "(?:gnu )?agpl", _versions("1", "3"))
    out += _named("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", _versions("1.1", "1.2", "1.3"), ids=("gfdl",))
    out += _named("apache", "apache", "apache(?: software)? licen[sc]e", _versions("1.0", "1.1", "2.0"), ids=("apache",))
    out += _named("mpl", "mozilla", f"mozilla{lic}", _versions("1.0", "1.1", "2.0"), ids=("mpl",))
    out += _named("epl", "eclipse", f"eclipse{lic}", _versions("1.0", "2.0"), ids=("epl",))
    out += _named("cddl", "common development", "common development and distribution licen[sc]e", _versions("1.0", "1.1"), ids=("cddl",))
    out += _named("eupl", "european union", f"european union{lic}", _versions("1.0", "1.1", "1.2"), ids=("eupl",))
    out += _named("ofl", "open font", "(?:sil )?open font licen[sc]e", _versions("1.0", "1.1"), ids=("ofl",))
    out += _named("artistic", "artistic", "artistic licen[sc]e", _versions("1.0", "2.0"), ids=("artistic",))
    out += _named("afl", "academic free", "academic free licen[sc]e", _versions("1.1", "2.0", "2.1", "3.0"), ids=("afl",))
    out += _named("osl", "open software", "open software licen[sc]e", _versions("1.0", "2.0", "2.1", "3.0"), ids=("osl",))
    out += _named("bsl", "boost", "boost software licen[sc]e", _versions("1.0"), ids=("bsl",))
    out += _named("busl", "business source", "business source licen[sc]e", _versions("1.0", "1.1"), ids=("busl",))
    out += _named("cpl", "common public", f"common{lic}", _versions("0.5", "1.0"), ids=("cpl",))
    out += _named("odbl", "open database", "open (?:data commons )?(?:open )?database licen[sc]e", _versions("1.0"), ids=("odbl",))
    out += _named("ms-pl", "microsoft public", "microsoft public licen[sc]e", {}, ids=("ms pl",))
    out += _named("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", {}, ids=("ms rl",))
    out += _named("mit", "mit", "(?:the )?mit(?: x11| expat)? licen[sc]e", {}, ids=("mit", "mit 0"))
    out += _named("isc", "isc", "(?:the )?isc licen[sc]e", {}, ids=("isc",))
    out += _named("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", {}, ids=("zlib",))
    out += _named("psf", "python", "python(?: software foundation)? licen[sc]e", _versions("2"), ids=("psf", "python"))
    out += _named("php", "php", "php licen[sc]e", _versions("3.0", "3.01"), ids=("php",))
    out += _named("openssl", "openssl", "openssl licen[sc]e", {}, ids=("openssl",))
    out += _named("ncsa", "illinois", "(?:university of )?illinois(?: ncsa)?(?: open source)? licen[sc]e", {}, ids=("ncsa",))
    out += _named("unlicense", "unlicense", "(?:the )?unlicense", {}, ids=("unlicense",))
    out += _named("wtfpl", "wtfpl", "wtfpl", _versions("2"), ids=("wtfpl",))
    for clauses in ("0", "2", "3", "4"):
        words = {"0": "zero", "2": "two", "3": "three", "4": "four"}[clauses]
        out += _named(f"bsd-{clauses}-clause", "clause bsd", f"(?:{clauses}|{words}) clause bsd(?: licen[sc]e)?", {}, ids=(f"bsd {clauses} clause",))
        out.append((f"bsd-{clauses}-clause", 3, "bsd", f"bsd (?:{clauses}|{words}) clause(?: licen[sc]e)?"))
    out += _named("bsd", "bsd", "(?:new |modified |simplified |revised |original )?bsd(?: style)? licen[sc]e", {})
    parts = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
             "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for short, long in parts.items():
        out += _named(f"cc-{short}", "cc by", f"cc {short.replace('-', ' ')}", _versions("1.0", "2.0", "2.5", "3.0", "4.0"))
        out += _named(f"cc-{short}", "creative commons", f"creative commons {long}(?: licen[sc]e)?", _versions("1.0", "2.0", "2.5", "3.0", "4.0"))
        out.append((f"cc-{short}", 2, "creativecommons", f"creativecommons org licen[sc]es {short.replace('-', ' ')}(?: [1-4] [05])?"))
        out += [(f"cc-{short}-{n}", 1, "spdx", f"spdx licen[sc]e identifier cc {short.replace('-', ' ')} {p}") for n, p in _versions("1.0", "2.0", "2.5", "3.0", "4.0").items()]
    out += _named("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", {}, ids=("cc0 1 0",))
    body = [
        ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work) and associated documentation"),
        ("mit", "without warranty", "the software is provided as is without warranty of any kind express or implied"),
        ("isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
        ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", "endorse", "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products derived"),
        ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
        ("apache-2.0", "in compliance", "you may not use this file except in compliance with the licen[sc]e"),
        ("apache-2.0", "apache", "www apache org licen[sc]es licen[sc]e 2 0"),
        ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
        ("gpl", "fitness", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
        ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
        ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
        ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
        ("bsl", "boost", "boost software licen[sc]e version 1 0 august 17th 2003"),
        ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
        ("wtfpl", "the fuck", "do what the fuck you want to public licen[sc]e"),
        ("beerware", "beer", "buy me a beer in return"),
        ("ofl-1.1", "font", "this font software is licensed under the sil open font licen[sc]e version 1 1"),
        ("cc", "creative commons", "this work is licensed under a creative commons"),
        ("gfdl", "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ]
    out += [(label, 2, keyword, pattern) for label, keyword, pattern in body + SIGNATURES]
    notice = [
        ("reserved", "all rights reserved", "all rights reserved"),
        ("reserved", "some rights reserved", "some rights reserved"),
        ("reserved", "rights reserved", "rights reserved worldwide"),
        ("reserved", "alle rechte", "alle rechte vorbehalten"),
        ("reserved", "tous droits", "tous droits réservés"),
        ("reserved", "todos los derechos", "todos los derechos reservados"),
        ("proprietary", "no part of", "no part of this (?:publication|document|work|book) may be reproduced"),
        ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
        ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution|use)"),
        ("copyright", "copyright", "copyright (?:\\(?c\\)? )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
        ("copyright", "copyright", "copyright by"),
        ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
        ("public-domain", "public domain", "public domain"),
        ("cc", "creative commons", "creative commons(?: licen[sc]e)?"),
    ]
    return out + [(label, 5, keyword, pattern) for label, keyword, pattern in notice + NOTICES]


def word_text(text: Column) -> Column:
    """The lower-cased words of a text with one space between and around them; one space if there are none."""
    # beyond A-Z, lower() changes letters of words only into letters of words, and no rule asks for any of those
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; a column that a lambda names is computed at each of its calls."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(a: Column, size: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda c: F.slice(a, c * size + 1, F.lit(size)))


def running(a: Column) -> Column:
    """The sum of the entries up to each of an array that is not empty, in chunks, so that no step goes over all of it."""
    add = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))
    sums = lambda chunks: F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)), F.array(F.lit(0)), add)
    within = lambda c, head: F.slice(F.aggregate(c, F.array(head), add), F.lit(2), F.size(c))
    return let(chunked(a), lambda chunks: let(sums(chunks), lambda heads: F.flatten(F.transform(chunks, lambda c, i: within(c, heads[i])))))


def detections(words: Column) -> Column:
    """array<struct<start, end, priority, rule, label>>: all detections of a word text, with character intervals in it."""
    groups: dict[str, list[Column]] = {}
    for i, (label, p, k, x) in enumerate(rules()):
        groups.setdefault(k, []).append(F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(i).alias("rule"), F.lit(f"(?<= )(?:{x})(?= )").alias("pattern")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*r).alias("rules")) for k, r in groups.items()])
    gated = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    tried = F.transform(gated, lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("hits")))
    some = F.filter(tried, lambda x: F.size(x["hits"]) > 0)
    # a hit begins after all gaps up to it and all hits before it
    placed = F.transform(some, lambda x: let(F.split(words, x["rule"]["pattern"], -1), lambda gaps: F.struct(
        x["rule"].alias("rule"), x["hits"].alias("hits"),
        running(F.transform(x["hits"], lambda h, k: F.length(gaps[k]) + F.when(k > 0, F.length(F.get(x["hits"], k - 1))).otherwise(0))).alias("starts"),
    )))
    every = F.flatten(F.transform(placed, lambda x: F.transform(x["hits"], lambda h, k: F.struct(
        x["starts"][k].alias("start"), (x["starts"][k] + F.length(h)).alias("end"), x["rule"]["priority"].alias("priority"), x["rule"]["rule"].alias("rule"), x["rule"]["label"].alias("label")
    ))))
    stem = F.lit(False)
    for x in STEMS:
        stem = stem | F.contains(words, F.lit(x))
    return F.when(stem, every)


def survivors(found: Column) -> Column:
    """Detections that no better one's interval holds: better priority, else longer, else earlier rule.

    In the order of (start, longest, priority, rule) whatever can hide a detection comes before it, and hides it if it ends
    no earlier.  So one sweep carries the furthest end of each priority and all better ones, in chunks.
    """
    reach = lambda m, d: F.transform(m, lambda x, q: F.when(q + 1 >= d["priority"], F.greatest(x, d["end"])).otherwise(x))
    none = F.array(*[F.lit(-1)] * len(SCORES))
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), *[d[c].alias(c) for c in ("priority", "rule", "end", "label")])))
    furthest = lambda chunks: F.aggregate(
        F.transform(chunks, lambda c: F.aggregate(c, none, reach)), F.array(none),
        lambda s, m: F.concat(s, F.array(F.zip_with(F.element_at(s, -1), m, lambda x, y: F.greatest(x, y)))),
    )
    fits = lambda c, head: F.aggregate(
        c, F.struct(head.alias("m"), F.array().cast("array<boolean>").alias("keep")),
        lambda s, d: F.struct(reach(s["m"], d).alias("m"), F.concat(s["keep"], F.array(F.get(s["m"], d["priority"] - 1) < d["end"])).alias("keep")), lambda s: s["keep"],
    )
    swept = let(ordered, lambda a: let(chunked(a), lambda chunks: let(furthest(chunks), lambda heads: F.flatten(
        F.transform(chunks, lambda c, i: let(fits(c, heads[i]), lambda keep: F.filter(c, lambda d, j: keep[j])))
    ))))
    return F.when(F.size(found) > 0, F.array_sort(F.transform(swept, lambda d: F.struct(*[d[c].alias(c) for c in ("start", "end", "priority", "rule", "label")]))))


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with words (the word text), found (surviving detections), base labels and places of the base phrases.

    Columns added: lic_words, lic_found, lic_base (array of phrases' labels that occur), lic_n_words, lic_n_base,
    lic_first, lic_last, lic_labels, lic_score.
    """
    words = F.col("lic_words")
    once = docs.withColumn("lic_words", word_text(F.col("text"))).withColumn("lic_every", detections(words))
    held = {p: f" {p} " for p in BASE}
    count = sum((F.when(F.contains(words, F.lit(x)), F.regexp_count(words, F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for p, x in held.items()), F.lit(0))
    some = F.greatest(*[F.contains(words, F.lit(x)) for x in held.values()])
    # word index of a place: spaces before it; the last place is found from the reversed text
    firsts = [F.when(F.contains(words, F.lit(x)), spaces(F.substring_index(words, x, 1))) for x in held.values()]
    total = spaces(words) - 1
    lasts = [F.when(F.contains(words, F.lit(x)), total - F.size(F.split(F.lit(p), " ")) - spaces(F.substring_index(words, x, -1))) for p, x in held.items()]
    out = once.withColumns({
        "lic_found": F.coalesce(survivors(F.col("lic_every")), F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")),
        "lic_n_words": F.when(F.length(words) > 1, total).otherwise(0).cast("long"),
        "lic_n_base": count.cast("long"),
        "lic_base": F.array_compact(F.array(*[F.when(F.contains(words, F.lit(x)), F.lit(BASE[p])) for p, x in held.items()])),
        "lic_first": F.when(some, F.least(*firsts)).cast("long"),
        "lic_last": F.when(some, F.greatest(*lasts)).cast("long"),
    })
    scores = F.create_map(*[F.lit(v) for kv in SCORES.items() for v in kv])
    return out.withColumns({
        "lic_labels": F.array_sort(F.array_union(F.col("lic_base"), F.transform("lic_found", lambda d: d["label"]))),
        "lic_score": F.greatest(F.coalesce(F.array_max(F.transform("lic_found", lambda d: scores[d["priority"]])), F.lit(0.0)), F.when(some, F.lit(0.4)).otherwise(0.0)),
    }).drop("lic_every")

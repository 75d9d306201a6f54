"""License detection rules: hand-written patterns per family and form.

A pattern is matched against a text's words, in lower case, one space apart. Families are known by their
names, whose forms are tried for each (those with a version once per version), and by what their texts
and notices say.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int  # 1 is the strongest
    keyword: str  # stands in every match as whole words
    pattern: str


# Label, names (a pattern over words), keyword of every name, versions. Those
# whose name holds "general public" have all versions of the gpl, whose rules fit in them.
FAMILIES = [
    ("apache", "apache", "apache", ("1 0", "1 1", "2 0")),
    ("mit", "mit|expat mit", "mit", ()),
    ("isc", "isc", "isc", ()),
    ("bsd", "bsd", "bsd", ()),
    ("bsd-2-clause", "bsd 2 clause|simplified bsd|freebsd bsd", "bsd", ()),
    ("bsd-3-clause", "bsd 3 clause|new bsd|revised bsd|modified bsd", "bsd", ()),
    ("bsd-4-clause", "bsd 4 clause|original bsd", "bsd", ()),
    ("gpl", "gnu gpl|gpl", "gpl", ("1 0", "2 0", "2", "3 0", "3")),
    ("gpl", "(?:gnu )?general public", "general public", ("1 0", "2 0", "2", "3 0", "3")),
    ("lgpl", "gnu lgpl|lgpl", "lgpl", ("2 0", "2 1", "3 0", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general public", ("1 0", "2 0", "2 1", "2", "3 0", "3")),
    ("agpl", "gnu agpl|agpl", "agpl", ("1 0", "3 0", "3")),
    ("agpl", "(?:gnu )?affero general public", "affero", ("1 0", "2 0", "2", "3 0", "3")),
    ("gfdl", "gnu free documentation", "free documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla public|mpl", "mozilla", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public", "eclipse", ("1 0", "2 0")),
    ("edl", "eclipse distribution", "eclipse", ("1 0",)),
    ("cddl", "common development and distribution", "common development", ("1 0", "1 1")),
    ("cpl", "common public", "common public", ("1 0",)),
    ("eupl", "european union public", "european union", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost software|boost", "boost", ("1 0",)),
    ("zlib", "zlib|zlib libpng", "zlib", ()),
    ("python", "python software foundation|psf", "python", ("2", "2 0")),
    ("psf", "psf", "psf", ("2", "2 0")),
    ("ofl", "sil open font|open font", "open font", ("1 0", "1 1")),
    ("ms-pl", "microsoft public", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ()),
    ("osl", "open software", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free", ("1 1", "2 0", "2 1", "3 0")),
    ("odbl", "open database", "open database", ("1 0",)),
    ("odbl", "odbl", "odbl", ("1 0",)),
    ("odc-by", "open data commons attribution", "data commons", ("1 0",)),
    ("pddl", "public domain dedication and", "public domain", ("1 0",)),
    ("ncsa", "university of illinois ncsa open source|ncsa", "ncsa", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("openssl", "openssl", "openssl", ()),
    ("php", "php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby", ()),
    ("w3c", "w3c software(?: notice and)?", "w3c", ()),
    ("x11", "x11", "x11", ()),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ibm-public", "ibm public", "ibm public", ("1 0",)),
    ("qpl", "q public", "q public", ("1 0",)),
    ("sleepycat", "sleepycat", "sleepycat", ()),
    ("sspl", "server side public", "server side", ("1 0", "1")),
    ("busl", "business source", "business source", ("1 0", "1 1")),
    ("elastic", "elastic", "elastic", ("1 0", "2 0")),
    ("openrail", "openrail(?: m)?", "openrail", ()),
    ("openrail", "open rail(?: m)?", "open rail", ()),
    ("llama", "llama (?:[23] )?community", "llama", ()),
    ("wtfpl", "do what the fuck you want to public", "what the fuck", ("2",)),
    ("unlicense", "the unlicense|unlicense", "unlicense", ()),
    ("nasa", "nasa open source", "nasa", ("1 3",)),
    ("ogl", "open government", "open government", ("1 0", "2 0", "3 0")),
    ("upl", "universal permissive", "universal permissive", ("1 0",)),
    ("vim", "vim", "vim", ()),
    ("latex", "latex project public", "latex project", ("1 0", "1 2", "1 3")),
    ("json", "json", "json", ()),
    ("perl", "perl artistic|perl 5", "perl", ()),
    ("ecl", "educational community", "educational community", ("1 0", "2 0")),
]

# Creative Commons, by the letters and by the words of the name.
CREATIVE_COMMONS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Notices that name no family.
NOTICES = [
    ("cc0", 2, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 2, "creative commons", "creative commons zero"),
    ("public-domain", 2, "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", 4, "public domain", "public domain"),
    ("reserved", 3, "rights reserved", "copyright (?:\\S+ ){1,6}all rights reserved"),
    ("reserved", 4, "rights reserved", "(?:all|some|no) rights reserved"),
    ("proprietary", 3, "proprietary", "proprietary and confidential"),
    ("proprietary", 3, "unauthorized copying", "unauthorized copying of this (?:file|document)"),
    ("copyleft", 4, "copyleft", "copyleft"),
    ("no-warranty", 4, "warranty", "without warranty of any kind"),
    ("no-warranty", 4, "warranties", "without warranties or conditions of any kind"),
]

_COPY = "permission is hereby granted free of charge to any person obtaining a copy of"
_FORMS = "redistribution and use in source and binary forms"
_BINARY = "redistributions in binary form must reproduce the above copyright notice"
_NAMES = "neither the names? of (?:[^ ]+ ){1,24}may be used to endorse or promote"
_USE = "permission to use copy modify and(?: or)? distribute this software"
_TO_ALL = "provided that the above copyright notice and this permission notice appear in all copies"
_URL = "(?:https? )?(?:www )?"

# What the licenses' own texts and the notices that they ask for say, without a name
# or around it. A longer text contains the shorter ones that other licenses share with it.
TEXTS = [
    ("mit", 2, "hereby granted", f"{_COPY} this software"),
    ("mit", 1, "hereby granted", f"{_COPY} (?:[^ ]+ ){{1,12}}to deal in the (?:software|materials) without restriction"),
    ("ncsa", 1, "hereby granted", f"{_COPY} (?:[^ ]+ ){{1,12}}to deal with the software without restriction"),
    ("boost-1.0", 1, "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("x11", 2, "dealings", "except as contained in this notice the names? of (?:[^ ]+ ){1,16}shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("json", 1, "not evil", "the software shall be used for good not evil"),
    ("0bsd", 2, "hereby granted", f"{_USE} for any purpose with or without fee is hereby granted"),
    ("isc", 1, "hereby granted", f"{_USE} for any purpose with or without fee is hereby granted {_TO_ALL}"),
    ("isc", 1, "hereby granted", f"{_USE} for any purpose with or without fee is hereby granted (?:[^ ]+ ){{1,6}}{_TO_ALL}"),
    ("hpnd", 2, "its documentation", f"{_USE} and its documentation for any purpose"),
    ("postgresql", 1, "its documentation", f"{_USE} and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", 3, "binary forms", f"{_FORMS} with or without modification"),
    ("bsd-2-clause", 2, "binary forms", f"{_FORMS} (?:[^ ]+ ){{1,120}}{_BINARY}"),
    ("bsd-3-clause", 3, "endorse or promote", _NAMES),
    ("bsd-3-clause", 1, "binary forms", f"{_FORMS} (?:[^ ]+ ){{1,180}}{_NAMES}"),
    ("bsd-4-clause", 1, "advertising materials", f"{_FORMS} (?:[^ ]+ ){{1,180}}all advertising materials mentioning features (?:[^ ]+ ){{1,80}}{_NAMES} products derived"),
    ("apache-2.0", 1, "apache", f"(?:you may )?obtain a copy of the license at {_URL}apache org licenses license 2 0"),
    ("apache-2.0", 1, "apache", "apache license version 2 0 january 2004"),
    ("apache-2.0", 2, "applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-2.0", 1, "general public", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 1, "general public", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", 1, "general public", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", 1, "general public", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", 1, "general public", "gnu affero general public license version 3 19 november 2007"),
    ("gnu", 4, "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("wtfpl", 1, "verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("mpl-2.0", 1, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 2, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", 1, "eclipse", "made available under the terms of the eclipse public license (?:v|v |version )?1 0"),
    ("epl-2.0", 1, "eclipse", "made available under the terms of the eclipse public license (?:v|v |version )?2 0"),
    ("zlib", 1, "held liable", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("no-warranty", 3, "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("unlicense", 1, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 1, "this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-1.0", 1, "this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("openssl", 1, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("python-2.0", 1, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("beerware", 1, "this stuff", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("proprietary", 2, "confidential", "confidential and proprietary information of"),
    ("reserved", 3, "may be reproduced", "no part of this (?:publication|book|document) may be reproduced"),
]

# The notice that files under a GNU license carry, by name and versions.
GNU_NOTICES = [
    ("gpl", "general public", (("2", "2.0"), ("3", "3.0"))),
    ("lgpl", "(?:lesser|library) general public", (("2", "2.0"), ("2 1", "2.1"), ("3", "3.0"))),
    ("agpl", "affero general public", (("3", "3.0"),)),
]

_LICENSE = "licen[sc]e"
_UNDER = "(?:licen[sc]ed|released|distributed|available|published|provided)"


def _named(label: str, name: str, keyword: str, versions: tuple[str, ...]) -> list[Rule]:
    name = f"(?:{name})"
    of = f"{name}(?: software)? {_LICENSE}"
    rules = [
        Rule(label, 2, keyword, f"{_UNDER} under (?:the )?(?:terms of the )?{of}"),
        Rule(label, 3, keyword, of),
        Rule(label, 3, keyword, f"{_LICENSE} {name}"),
        Rule(label, 1, keyword, f"spdx {_LICENSE} identifier {name}"),
    ]
    for version in versions:
        full = f"{label}-{version.replace(' ', '.')}"
        tail = f"(?: version| v)? {version}(?: only| or (?:any )?later)?"
        rules += [
            Rule(full, 1, keyword, f"{_UNDER} under (?:the )?(?:terms of the )?{of}{tail}"),
            Rule(full, 2, keyword, f"{of}{tail}"),
            Rule(full, 1, keyword, f"spdx {_LICENSE} identifier {name}{tail}"),
            Rule(full, 2, keyword, f"{name} licen[sc]es? {version}"),
        ]
    return rules


def _creative_commons() -> list[Rule]:
    rules = []
    for label, letters, words in CREATIVE_COMMONS:
        rules += [
            Rule(label, 4, "cc by", f"cc {letters}"),
            Rule(label, 3, "cc by", f"{_UNDER} under (?:a |the )?cc {letters}"),
            Rule(label, 3, "creative commons", f"creative commons {words}"),
        ]
        for version in CC_VERSIONS:
            full = f"{label}-{version.replace(' ', '.')}"
            rules += [
                Rule(full, 3, "cc by", f"cc {letters} {version}"),
                Rule(full, 2, "cc by", f"{_UNDER} under (?:a |the )?cc {letters} {version}"),
                Rule(
                    full,
                    2,
                    "creative commons",
                    f"creative commons {words}(?: (?:international|unported|generic))? {version}",
                ),
                Rule(full, 2, "creativecommons", f"creativecommons org licenses {letters} {version}"),
            ]
    return rules


def _gnu_notices() -> list[Rule]:
    rules = []
    for label, name, versions in GNU_NOTICES:
        terms = f"(?:redistribute it and or modify|modify) it under the terms of the gnu {name} license"
        published = f"{terms} as published by the free software foundation"
        rules.append(Rule(label, 2, "free software", published))
        for version, number in versions:
            either = f"{published} either version {version} of the license or"
            later = f"{either} (?:at your option )?any later version"
            rules.append(Rule(f"{label}-{number}-or-later", 1, "free software", later))
            only = f"{published} version {version} of the license"
            rules.append(Rule(f"{label}-{number}", 1, "free software", only))
    return rules


def all_rules() -> list[Rule]:
    rules = [rule for family in FAMILIES for rule in _named(*family)]
    rules += _creative_commons() + _gnu_notices()
    rules += [Rule(*fixed) for fixed in [*NOTICES, *TEXTS]]
    # Longer labels of one priority first: they are the more exact ones.
    rules.sort(key=lambda r: (r.priority, -len(r.label), r.label, r.pattern))
    for rule in rules:
        re.compile(rule.pattern)
    return rules


# One of these stands in the lower-case text of every match of every rule.
STEMS = (
    ("licen",),
    ("cc", "by"),
    ("cc0",),
    ("creative", "commons"),
    ("creativecommons",),
    ("public", "domain"),
    ("rights", "reserved"),
    ("proprietary",),
    ("unauthorized",),
    ("copyleft",),
    ("without", "warrant"),
    ("hereby", "granted"),
    ("redistribution",),
    ("endorse", "promote"),
    ("advertising", "dealings"),
    ("its", "documentation", "permission"),
    ("good", "evil", "software"),
    ("mpl", "obtain"),
    ("package", "intent", "conditions"),
    ("openssl",),
    ("beer", "stuff"),
    ("reproduced", "may"),
)

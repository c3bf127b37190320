"""The license rules: names by hand, combined with the ways a license is stated.

Rules are regular expressions over the words of a text, lower-case and joined by one space, so
"GPL-3.0-or-later" reads "gpl 3 0 or later".
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``priority``: lower goes first; ``weight``: how sure a detection is, 0 to 1."""

    label: str
    pattern: re.Pattern
    keywords: frozenset[str]
    priority: int
    weight: float


# Label, the license's name, its short identifier, and words one of which most mentions hold; the
# words of the mentions that hold none are added from the patterns (``keywords_of``).
# A bare number is a version; "v" may stand before it.
NAMES: list[tuple[str, str, str, str]] = [
    ("mit", r"(?:mit|expat|mit x11|mit expat)", r"mit", "mit expat"),
    ("mit-0", r"mit no attribution", r"mit 0", "mit"),
    ("apache-1.1", r"apache (?:software )?(?:license )?(?:version |v ?)?1 1", r"apache 1 1", "apache"),
    ("apache-2", r"(?:apache|apache software|asl) (?:license )?(?:version |v ?)?2(?: 0)?", r"(?:apache 2(?: 0)?|asl ?2(?: 0)?)", "apache asl asl2"),
    ("apache", r"apache(?: software)?", r"apache", "apache"),
    ("bsd-2-clause", r"(?:(?:bsd 2|2|two) clause|simplified|freebsd)(?: bsd)?", r"bsd 2 clause", "bsd freebsd clause simplified"),
    ("bsd-3-clause", r"(?:(?:bsd 3|3|three) clause|new|modified|revised)(?: bsd)", r"bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:(?:bsd 4|4|four) clause|original)(?: bsd)", r"bsd 4 clause", "bsd"),
    ("bsd", r"(?:berkeley software distribution|bsd|bsd style)", r"bsd", "bsd berkeley"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", r"0bsd", "bsd 0bsd"),
    ("gpl-1", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?1(?: 0)?", r"gpl ?v?1(?: 0)?(?: only| or later)?", "general gpl gplv1 gpl1"),
    ("gpl-2", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?2(?: 0)?", r"gpl ?v?2(?: 0)?(?: only| or later)?", "general gpl gplv2 gpl2"),
    ("gpl-3", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?3(?: 0)?", r"gpl ?v?3(?: 0)?(?: only| or later)?", "general gpl gplv3 gpl3"),
    ("gpl", r"(?:gnu general public|gnu gpl|gpl)", r"gpl", "gpl gnu"),
    ("lgpl-2", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v ?)?2(?: 0)?", r"lgpl ?v?2(?: 0)?(?: only| or later)?", "library lgpl lgplv2"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?2 1", r"lgpl ?v?2 1(?: only| or later)?", "lesser lgpl lgplv2"),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?3(?: 0)?", r"lgpl ?v?3(?: 0)?(?: only| or later)?", "lesser lgpl lgplv3"),
    ("lgpl", r"(?:gnu (?:lesser|library) general public|gnu lgpl|lgpl)", r"lgpl", "lesser library lgpl"),
    ("agpl-3", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v ?)?3(?: 0)?", r"agpl ?v?3(?: 0)?(?: only| or later)?", "affero agpl agplv3"),
    ("agpl", r"(?:gnu affero general public|affero general public|agpl)", r"agpl", "affero agpl"),
    ("gfdl", r"(?:gnu free documentation|gfdl)", r"gfdl(?: 1 \d)?", "documentation gfdl"),
    ("mpl-1.1", r"(?:mozilla public license|mpl) ?(?:version |v ?)?1 1", r"mpl 1 1", "mozilla mpl"),
    ("mpl-2", r"(?:mozilla public license|mpl) ?(?:version |v ?)?2(?: 0)?", r"mpl ?2(?: 0)?", "mozilla mpl mpl2"),
    ("mpl", r"(?:mozilla public|mpl)", r"mpl", "mozilla mpl"),
    ("epl-1", r"(?:eclipse public license|epl) ?(?:version |v ?)?1(?: 0)?", r"epl 1(?: 0)?", "eclipse epl"),
    ("epl-2", r"(?:eclipse public license|epl) ?(?:version |v ?)?2(?: 0)?", r"epl 2(?: 0)?", "eclipse epl"),
    ("epl", r"(?:eclipse public|epl)", r"epl", "eclipse epl"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl) ?(?:version |v ?)?1 2", r"eupl 1 2", "european eupl"),
    ("eupl", r"(?:european union public|eupl)", r"eupl", "european eupl"),
    ("cddl-1", r"(?:common development and distribution license|cddl) ?(?:version |v ?)?1(?: 0| 1)?", r"cddl 1 [01]", "development cddl"),
    ("cddl", r"(?:common development and distribution|cddl)", r"cddl", "development cddl"),
    ("cpl-1", r"(?:common public license|cpl) ?(?:version |v ?)?1(?: 0)?", r"cpl 1 0", "common cpl"),
    ("isc", r"(?:isc|internet systems consortium)", r"isc", "isc consortium"),
    ("zlib", r"(?:zlib|zlib libpng)", r"zlib", "zlib"),
    ("libpng", r"(?:libpng|png reference library)", r"libpng(?: 2 0)?", "libpng png"),
    ("bsl-1", r"boost(?: software)?(?: license)?(?: version)? 1(?: 0)?", r"bsl 1 0", "boost bsl"),
    ("boost", r"boost(?: software)?", r"boost", "boost"),
    ("artistic-1", r"artistic(?: license)? (?:version )?1(?: 0)?", r"artistic 1 0", "artistic"),
    ("artistic-2", r"artistic(?: license)? (?:version )?2(?: 0)?", r"artistic 2 0", "artistic"),
    ("artistic", r"(?:perl )?artistic", r"artistic", "artistic"),
    ("python-2", r"(?:python software foundation|psf)(?: license)? ?(?:version |v ?)?2(?: 0)?", r"(?:psf|python) 2 0", "python psf"),
    ("python", r"(?:python software foundation|psf|python)", r"psf", "python psf"),
    ("php-3", r"php(?: license)? ?(?:version |v ?)?3(?: 0| 01)?", r"php 3 0(?:1)?", "php"),
    ("ruby", r"ruby", r"ruby", "ruby"),
    ("unlicense", r"(?:unlicense|the unlicense)", r"unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the \w+ you want to public)", r"wtfpl", "wtfpl want"),
    ("cc0", r"(?:cc0|cc 0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?", "cc0 cc creative"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: \d 0)?", r"cc by(?: \d 0)?", "cc creative"),
    ("cc-by-4", r"(?:cc by|creative commons attribution) 4 0", r"cc by 4 0", "cc creative"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: \d \d)?", r"cc by sa(?: \d \d)?", "cc creative"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w+)(?: \d \d)?", r"cc by nd(?: \d \d)?", "cc creative"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: \d \d)?", r"cc by nc(?: \d \d)?", "cc creative"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: \d \d)?", r"cc by nc sa(?: \d \d)?", "cc creative"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w+)(?: \d \d)?", r"cc by nc nd(?: \d \d)?", "cc creative"),
    ("odbl", r"(?:open database|odbl)(?: 1 0)?", r"odbl(?: 1 0)?", "database odbl"),
    ("odc-by", r"(?:open data commons attribution|odc by)(?: 1 0)?", r"odc by(?: 1 0)?", "odc commons"),
    ("pddl", r"(?:public domain dedication and license|pddl)(?: 1 0)?", r"pddl(?: 1 0)?", "dedication pddl"),
    ("ofl-1.1", r"(?:sil )?(?:open font license|ofl)(?: version| v)? ?1 1", r"ofl 1 1", "font ofl"),
    ("ofl", r"(?:sil open font|open font|sil ofl)", r"ofl", "font ofl"),
    ("ms-pl", r"(?:microsoft public|ms pl)", r"ms pl", "microsoft ms"),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", r"ms rl", "microsoft ms"),
    ("ncsa", r"(?:university of illinois|illinois ncsa|ncsa)(?: open source)?", r"ncsa", "illinois ncsa"),
    ("postgresql", r"postgresql", r"postgresql", "postgresql"),
    ("openssl", r"(?:openssl|dual openssl)", r"openssl", "openssl"),
    ("bsl-business", r"business source(?: license)?(?: 1 1)?", r"busl 1 1", "business busl"),
    ("sspl", r"(?:server side public|sspl)(?: v?1)?", r"sspl(?: 1 0)?", "sspl server"),
    ("elastic-2", r"elastic(?: license)?(?: v?2(?: 0)?)?", r"elastic 2 0", "elastic"),
    ("osl-3", r"(?:open software|osl)(?: license)? ?(?:version |v ?)?3(?: 0)?", r"osl 3 0", "osl software"),
    ("afl-3", r"(?:academic free|afl)(?: license)? ?(?:version |v ?)?3(?: 0)?", r"afl 3 0", "academic afl"),
    ("upl", r"(?:universal permissive|upl)(?: 1 0)?", r"upl(?: 1 0)?", "permissive upl"),
    ("bsla-openrail", r"(?:open ?rail|bigscience rail|creativeml open ?rail)(?: m)?", r"open ?rail(?: m)?", "openrail rail"),
    ("vim", r"vim", r"vim", "vim"),
    ("w3c", r"w3c(?: software(?: notice)?(?: and)?)?", r"w3c", "w3c"),
    ("x11", r"x11", r"x11", "x11"),
    ("curl", r"curl", r"curl", "curl"),
    ("beerware", r"(?:beerware|beer ware)", r"beerware", "beerware beer"),
    ("json", r"json", r"json", "json"),
    ("ecl-2", r"(?:educational community|ecl)(?: license)?(?: version)? 2(?: 0)?", r"ecl 2 0", "educational ecl"),
]

#: An open part of a pattern in ``spelled``.
WILD = "\0"

# How a license is stated: priority, weight, and the pattern around the name or the identifier.
STATED: list[tuple[int, float, str]] = [
    (1, 1.0, r"spdx licen[cs]e identifier {short}"),
    (2, 0.95, r"(?:licen[cs]ed|released|distributed|published|provided|available|covered|shared) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?"),
    (3, 0.85, r"licen[cs]e (?:is |type |name |id |as )?{short}"),
    (4, 0.75, r"{name} licen[cs]e"),
]

# Sentences of the license texts themselves, and statements that name no license.
SENTENCES: list[tuple[str, int, float, str, str]] = [
    ("mit", 2, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("mit", 2, 0.8, r"the above copyright notice and this permission notice shall be included in all copies", "notice"),
    ("isc", 2, 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee", "fee"),
    ("bsd", 2, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", 2, 0.9, r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "endorse"),
    ("bsd-4-clause", 2, 0.9, r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("apache-2", 1, 0.95, r"you may not use this file except in compliance with the license", "compliance"),
    ("gpl", 2, 0.9, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu"),
    ("gpl-2", 2, 0.9, r"gnu general public license as published by the free software foundation (?:either )?version 2", "gnu"),
    ("gpl-3", 2, 0.9, r"gnu general public license as published by the free software foundation (?:either )?version 3", "gnu"),
    ("lgpl", 2, 0.9, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "gnu"),
    ("agpl-3", 2, 0.9, r"gnu affero general public license as published by the free software foundation (?:either )?version 3", "affero"),
    ("mpl-2", 1, 0.95, r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("zlib", 2, 0.9, r"the origin of this software must not be misrepresented", "misrepresented"),
    ("unlicense", 2, 0.9, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0", 2, 0.85, r"to the extent possible under law .{1,120}? has waived all copyright and related", "waived"),
    ("wtfpl", 2, 0.9, r"you just do what the \w+ you want to", "want"),
    ("beerware", 2, 0.9, r"buy me a beer in return", "beer"),
    ("boost", 2, 0.9, r"distributed under the boost software license", "boost"),
    ("public-domain", 3, 0.7, r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain", "domain"),
    ("all-rights-reserved", 5, 0.4, r"all rights reserved", "reserved"),
    ("proprietary", 4, 0.6, r"(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", 4, 0.6, r"unauthorized (?:copying|use|reproduction|distribution) .{1,60}? (?:prohibited|forbidden)", "unauthorized"),
    ("non-commercial", 4, 0.6, r"(?:for )?(?:non ?commercial|personal|research|academic) use only", "use"),
    ("freeware", 4, 0.5, r"this (?:software|program) is freeware", "freeware"),
]

#: Base phrases of the query's contract and their labels (fixed values).
BASE_PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


def spelled(pattern: str) -> set[str]:
    """All texts that a pattern of this file matches; ``WILD`` stands for what it leaves open.

    Knows what the patterns above are made of: letters, ``(?:a|b)``, ``[ab]``, ``?``, and the open
    parts ``\\d``, ``\\w+`` and ``.{m,n}?``.
    """
    def either(i: int) -> tuple[set[str], int]:
        done, now = set(), {""}
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                done, now, i = done | now, {""}, i + 1
                continue
            if pattern.startswith("(?:", i):
                part, i = either(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                part, i = set(pattern[i + 1: end]), end + 1
            elif pattern[i] in "\\.":
                part, i = {WILD}, i + (2 if pattern[i] == "\\" else 1)
            else:
                part, i = {pattern[i]}, i + 1
            if pattern.startswith("{", i):
                i = pattern.index("}?", i) + 2
            elif pattern.startswith("+", i):
                i += 1
            elif pattern.startswith("?", i):
                part, i = part | {""}, i + 1
            now = {a + b for a in now for b in part}
        return done | now, i

    return either(0)[0]


def keywords_of(listed: str, *patterns: str) -> frozenset[str]:
    """The listed words, and the longest word of every text of the patterns that holds none of them."""
    words = set(listed.split())
    for text in sorted(set().union(*map(spelled, patterns))):
        whole = [w for w in text.split(" ") if w and WILD not in w]
        if not words.intersection(whole):
            words.add(max(whole, key=len))
    return frozenset(words)


def rules() -> list[Rule]:
    """Every statement of every name, then the sentences, in order of priority."""
    named = [(label, name, short, keywords_of(keys, name, short)) for label, name, short, keys in NAMES]
    found = [
        Rule(label, _words(form.format(name=name, short=short)), keys, priority, weight)
        for priority, weight, form in STATED for label, name, short, keys in named
    ]
    # A full name that ends in its version says enough by itself.
    found += [Rule(label, _words(name), keys, 3, 0.8) for label, name, _, keys in named if "public license" in name]
    found += [Rule(label, _words(text), keywords_of(keys, text), priority, weight) for label, priority, weight, text, keys in SENTENCES]
    return sorted(found, key=lambda r: r.priority)


def _words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")

"""The ordered signature rules of the license scan.

A rule is a regular expression over the words of a text (lower-cased, one space
between words and one at either end), a keyword without which it cannot match,
a label, and a priority. Rules come from the licenses below, each written by
hand, in the forms in which texts name a license.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# label | words of the identifier | names, as a pattern over words | keywords, any of them, at the start of a word
LICENSES = """
mit | mit | (?:the )?(?:mit|expat)(?: expat| x11)? license | mit/expat
mit | mit x11 | mit x11 | mit
mit-0 | mit 0 | mit (?:no attribution|0) license | mit
apache-1.0 | apache 1 0 | apache (?:software )?license v(?:ersion )?1 0 | apache
apache-1.1 | apache 1 1 | apache (?:software )?license v(?:ersion )?1 1 | apache
apache-2 | apache 2 0 | apache (?:software )?license (?:v|version )?2(?: 0)? | apache
apache-2 | apache 2 | apache 2 0(?! \\d)(?: license)? | apache
bsd | bsd | (?:the )?bsd(?: style)? license | bsd
bsd-2-clause | bsd 2 clause | (?:2 clause|two clause|simplified|freebsd) (?:bsd )?license | 2 clause/two clause/simplified/freebsd
bsd-2-clause | bsd 2 clause | bsd (?:2|two) clause(?: license)? | bsd
bsd-3-clause | bsd 3 clause | (?:3 clause|three clause|new|revised|modified) bsd license | bsd
bsd-3-clause | bsd 3 clause | bsd (?:3|three) clause(?: license)? | bsd
bsd-4-clause | bsd 4 clause | (?:4 clause|four clause|original|old) bsd license | bsd
bsd-4-clause | bsd 4 clause | bsd (?:4|four) clause(?: license)? | bsd
0bsd | 0bsd | zero clause bsd(?: license)? | clause
gpl | gpl | gnu (?:general public license|gpl) | gnu
gpl-1 | gpl 1 0(?: only| or later)? | (?:gnu )?(?:general public license|gpl) (?:v|version )?1(?: 0)? | gpl/general public
gpl-2 | gpl 2 0(?: only| or later)? | (?:gnu )?(?:general public license|gpl) (?:v|version )?2(?: 0)? | gpl/general public
gpl-3 | gpl 3 0(?: only| or later)? | (?:gnu )?(?:general public license|gpl) (?:v|version )?3(?: 0)? | gpl/general public
lgpl | lgpl | gnu (?:lesser|library) general public license | general public
lgpl-2 | lgpl 2 0(?: only| or later)? | (?:gnu )?(?:library general public license|lgpl) (?:v|version )?2(?: 0)? | lgpl/public license
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu )?(?:lesser general public license|lgpl) (?:v|version )?2 1 | lgpl/public license
lgpl-3 | lgpl 3 0(?: only| or later)? | (?:gnu )?(?:lesser general public license|lgpl) (?:v|version )?3(?: 0)? | lgpl/public license
agpl-1 | agpl 1 0(?: only| or later)? | affero general public license (?:v|version )?1(?: 0)? | affero
agpl-3 | agpl 3 0(?: only| or later)? | (?:gnu )?(?:affero general public license|agpl) (?:v|version )?3(?: 0)? | agpl/affero
gfdl-1.1 | gfdl 1 1(?: only| or later)? | (?:gnu )?free documentation license (?:v|version )?1 1 | documentation
gfdl-1.2 | gfdl 1 2(?: only| or later)? | (?:gnu )?free documentation license (?:v|version )?1 2 | documentation
gfdl-1.3 | gfdl 1 3(?: only| or later)? | (?:gnu )?free documentation license (?:v|version )?1 3 | documentation
mpl-1.0 | mpl 1 0 | mozilla public license (?:v|version )?1 0 | mozilla
mpl-1.1 | mpl 1 1 | mozilla public license (?:v|version )?1 1 | mozilla
mpl-2 | mpl 2 0 | mozilla public license (?:v|version )?2(?: 0)? | mozilla
epl-1 | epl 1 0 | eclipse public license (?:v|version )?1(?: 0)? | eclipse
epl-2 | epl 2 0 | eclipse public license (?:v|version )?2(?: 0)? | eclipse
edl-1 | edl 1 0 | eclipse distribution license | eclipse
cddl-1.0 | cddl 1 0 | common development and distribution license (?:v|version )?1 0 | distribution
cddl-1.1 | cddl 1 1 | common development and distribution license (?:v|version )?1 1 | distribution
cpl-1 | cpl 1 0 | common public license(?: (?:v|version )?1 0)? | common
cpal-1 | cpal 1 0 | common public attribution license | attribution
eupl-1.1 | eupl 1 1 | european union public licen[cs]e (?:v|version )?1 1 | european
eupl-1.2 | eupl 1 2 | european union public licen[cs]e (?:v|version )?1 2 | european
isc | isc | (?:the )?isc license | isc
zlib | zlib | (?:the )?zlib(?: libpng)? license | zlib
libpng | libpng(?: 2 0)? | libpng license | libpng
bsl-1 | bsl 1 0 | boost software license(?: (?:v|version )?1 0)? | boost
busl-1.1 | busl 1 1 | business source license(?: (?:v|version )?1 1)? | business
sspl-1 | sspl 1 0 | server side public license | server
elastic-2 | elastic 2 0 | elastic license(?: (?:v|version )?2(?: 0)?)? | elastic
artistic-1 | artistic 1 0 | artistic license (?:v|version )?1(?: 0)? | artistic
artistic-2 | artistic 2 0 | artistic license (?:v|version )?2(?: 0)? | artistic
psf-2 | (?:psf|python) 2 0 | python software foundation license | python
ruby | ruby | (?:the )?ruby license | ruby
php-3.01 | php 3 01 | php license(?: (?:v|version )?3 01)? | php
w3c | w3c | w3c software(?: notice and)? license | w3c
unlicense | unlicense | (?:the )?unlicense(?: org)? | unlicense
wtfpl | wtfpl | do what the f\\w+ you want to public license | public
ofl-1.1 | ofl 1 1 | (?:sil )?open font license(?: (?:v|version )?1 1)? | font
odbl-1 | odbl 1 0 | open database license(?: (?:v|version )?1 0)? | database
odc-by-1 | odc by 1 0 | open data commons attribution license | commons
pddl-1 | pddl 1 0 | public domain dedication and license | dedication
upl-1 | upl 1 0 | universal permissive license | permissive
ncsa | ncsa | (?:university of illinois )?ncsa open source license | ncsa
ms-pl | ms pl | microsoft public license | microsoft
ms-rl | ms rl | microsoft reciprocal license | microsoft
osl-3 | osl 3 0 | open software license(?: (?:v|version )?3 0)? | software
afl-3 | afl 3 0 | academic free license(?: (?:v|version )?3 0)? | academic
postgresql | postgresql | (?:the )?postgresql licen[cs]e | postgresql
openssl | openssl | openssl license | openssl
vim | vim | (?:the )?vim license | vim
curl | curl | curl license | curl
unicode-3 | unicode 3 0 | unicode license(?: (?:v|version )?3)? | unicode
cecill-2.1 | cecill 2 1 | cecill(?: free software)? license(?: agreement)?(?: (?:v|version )?2 1)? | cecill
mulan-2 | mulanpsl 2 0 | mulan permissive software license(?: (?:v|version )?2)? | mulan
openrail | openrail | (?:creativeml )?open ?rail(?: m)?(?: license)? | rail/openrail/creativeml
llama-community | llama\\d* | llama \\d+ community license(?: agreement)? | llama
"""

# Creative Commons: parts of the label, and the long name of each.
COMMONS = """
by | attribution
by-sa | attribution share ?alike
by-nc | attribution non ?commercial
by-nd | attribution no ?deriv(?:ative|ative work)?s
by-nc-sa | attribution non ?commercial share ?alike
by-nc-nd | attribution non ?commercial no ?deriv(?:ative|ative work)?s
"""
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Passages of license texts and notices: label | pattern | keyword
NOTICES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | hereby granted
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | substantial portions
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | with or without fee
bsd | redistribution and use in source and binary forms with or without modification are permitted | binary forms
bsd-3-clause | neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors may be used to endorse or promote products | endorse or promote
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement | advertising materials
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | redistribute it
gpl-2 | either version 2 of the license or (?:at your option )?any later version | either version
gpl-3 | either version 3 of the license or (?:at your option )?any later version | either version
gpl | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license | implied warranty
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license | redistribute it
agpl-3 | under the terms of the gnu affero general public license | affero
apache-2 | you may not use this file except in compliance with the license | in compliance with
apache-2 | distributed on an as is basis without warranties or conditions of any kind either express or implied | as is basis
mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0 | source code form
zlib | altered source versions must be plainly marked as such and must not be misrepresented | altered source
bsl-1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software | person or organization
unlicense | this is free and unencumbered software released into the public domain | unencumbered
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain | public domain
public-domain | (?:is|are|placed|released) (?:hereby )?(?:in|into) the public domain | public domain
proprietary | all rights reserved | all rights
proprietary | (?:proprietary and confidential|confidential and proprietary) | confidential
proprietary | unauthorized copying of this file via any medium is strictly prohibited | unauthorized copying
ofl-1.1 | this font software is licensed under the sil open font license | font software
epl-2 | made available under the terms of the eclipse public license | eclipse
"""

# Phrases that are always counted, whatever other rules find.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

PHRASE, IDENTIFIER, ADDRESS, NOTICE, GRANT, NAME = 100, 95, 90, 80, 70, 60


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    label: str
    keywords: tuple[str, ...]
    priority: int


def rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def build_rules() -> list[Rule]:
    """All rules in their order; the base phrases come first."""
    rules = [Rule(re.compile(f" {phrase}(?= )"), label, (phrase,), PHRASE) for phrase, label in BASE]

    def add(pattern: str, label: str, keyword: str, priority: int) -> None:
        rules.append(Rule(re.compile(f" {pattern}(?= )"), label, tuple(keyword.split("/")), priority))

    def forms(label: str, identifier: str, name: str, keyword: str, address: str) -> None:
        add(f"spdx license identifier {identifier}", label, "spdx", IDENTIFIER)
        add(address, label, "creativecommons" if address.startswith("creative") else "opensource/spdx/gnu/apache", ADDRESS)
        add(f"(?:licensed|released|distributed|available|published|provided) (?:only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", label, keyword, GRANT)
        add(name, label, keyword, NAME)
        first = identifier.split()[0]
        short = f"(?:licen[cs]e|(?:dual )?licen[cs]ed(?: under)?)(?: the| is)? {identifier}(?! license)"
        add(short, label, first if first.isalnum() else "licen", NAME)

    for label, identifier, name, keyword in rows(LICENSES):
        forms(label, identifier, name, keyword, f"(?:opensource|spdx|gnu|apache) org (?:licenses?|legal) {identifier}")
    for kind, name in rows(COMMONS):
        short = kind.replace("-", " ")
        add(f"creativecommons org licenses {short}", f"cc-{kind}", "creativecommons", ADDRESS)
        add(f"cc {short}(?: license)?", f"cc-{kind}", "cc ", NAME)
        add(f"creative commons {name}(?: (?:international|unported|generic))?(?: public)?(?: license)?", f"cc-{kind}", "creative", NAME)
        for version in COMMONS_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            address = f"creativecommons org licenses {short} {version}"
            forms(label, f"cc {short} {version}", f"(?:cc {short}|creative commons {name}) {version}", "cc /creative", address)
    forms("cc0-1.0", "cc0 1 0", "(?:cc0|creative commons zero)(?: (?:v|version )?1 0)?(?: universal)?", "cc0/creative", "creativecommons org publicdomain zero 1 0")
    for label, pattern, keyword in rows(NOTICES):
        add(pattern, label, keyword, NOTICE)
    return rules

"""The signature rules of the license scan, in the order of their priority.

A rule is written in lower case; a space stands for any run of characters that are no word, a dot for itself. Every rule stands on
whole words. Licenses give rules for their tag, their address, their name and a mention; SIGNATURES are sentences of license texts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

WORD = r"[0-9a-z\x80-\xff]"
GAP = r"[^0-9a-z\x80-\xff]+"

#: How decisive a kind of rule is; a detection gives way to one of a higher rank, or of its rank and longer, that contains it.
RANKS = {"tag": 6, "address": 5, "text": 4, "mention": 3, "name": 2, "hint": 1}
WEIGHTS = {"tag": 1.0, "address": 0.95, "text": 0.95, "mention": 0.9, "name": 0.8, "hint": 0.4, "base": 0.6}

#: Phrases of the query's base and their labels. They give way to nothing.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Fixed values, in the order of the labels: label | identifiers of tags | name | address (or nothing).
LICENSES = """
0bsd | 0bsd | (?:zero clause bsd|bsd zero clause)(?: license)? | opensource.org/licenses?/0bsd
afl-3.0 | afl 3.0 | academic free license(?: version| v)?(?: 3.0)? | opensource.org/licenses?/afl 3.0
agpl-3.0-only | agpl 3.0(?: only)? | (?:gnu )?affero general public license(?: version| v)?(?: 3(?:.0)?)? | gnu.org/licenses/agpl(?: 3.0)?
agpl-3.0-or-later | agpl 3.0(?: or later|[+]) | (?:gnu )?affero general public license(?: version| v)?(?: 3(?:.0)?)? or(?: at your option)? any later version |
apache-1.1 | apache 1.1 | apache(?: software)? license(?: version| v)? 1.1 | apache.org/licenses/license 1.1
apache-2.0 | apache 2.0 | apache(?: software)? license(?: version| v)? 2(?:.0)? | apache.org/licenses/license 2.0
apsl-2.0 | apsl 2.0 | apple public source license(?: version| v)?(?: 2.0)? | opensource.apple.com/apsl
artistic-1.0 | artistic 1.0 | artistic license(?: version| v)? 1.0 | opensource.org/licenses?/artistic 1.0
artistic-2.0 | artistic 2.0 | artistic license(?: version| v)? 2.0 | opensource.org/licenses?/artistic 2.0
beerware | beerware | beer ware license |
blueoak-1.0.0 | blueoak 1.0.0 | blue oak model license(?: 1.0.0)? | blueoakcouncil.org/license/1.0.0
bsd-1-clause | bsd 1 clause | (?:bsd 1 clause|1 clause bsd)(?: license)? | opensource.org/licenses?/bsd 1 clause
bsd-2-clause | bsd 2 clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)? | opensource.org/licenses?/bsd 2 clause
bsd-3-clause | bsd 3 clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: license)? | opensource.org/licenses?/bsd 3 clause
bsd-4-clause | bsd 4 clause | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)? |
bsl-1.0 | bsl 1.0 | boost software license(?: version| v)?(?: 1.0)? | boost.org/license_1_0.txt
busl-1.1 | busl 1.1 | business source license(?: version| v)?(?: 1.1)? | mariadb.com/bsl11
cc-by-1.0 | cc by 1.0 | (?:creative commons attribution(?: license)?|cc by) 1.0(?: generic)? | creativecommons.org/licenses/by/1.0
cc-by-2.0 | cc by 2.0 | (?:creative commons attribution(?: license)?|cc by) 2.0(?: generic)? | creativecommons.org/licenses/by/2.0
cc-by-2.5 | cc by 2.5 | (?:creative commons attribution(?: license)?|cc by) 2.5(?: generic)? | creativecommons.org/licenses/by/2.5
cc-by-3.0 | cc by 3.0 | (?:creative commons attribution(?: license)?|cc by) 3.0(?: unported)? | creativecommons.org/licenses/by/3.0
cc-by-4.0 | cc by 4.0 | (?:creative commons attribution(?: license)?|cc by) 4.0(?: international)? | creativecommons.org/licenses/by/4.0
cc-by-nc-3.0 | cc by nc 3.0 | (?:creative commons attribution non ?commercial|cc by nc) 3.0(?: unported)? | creativecommons.org/licenses/by nc/3.0
cc-by-nc-4.0 | cc by nc 4.0 | (?:creative commons attribution non ?commercial|cc by nc) 4.0(?: international)? | creativecommons.org/licenses/by nc/4.0
cc-by-nc-nd-4.0 | cc by nc nd 4.0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: 4.0)?(?: international)? | creativecommons.org/licenses/by nc nd/4.0
cc-by-nc-sa-3.0 | cc by nc sa 3.0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 3.0(?: unported)? | creativecommons.org/licenses/by nc sa/3.0
cc-by-nc-sa-4.0 | cc by nc sa 4.0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: 4.0)?(?: international)? | creativecommons.org/licenses/by nc sa/4.0
cc-by-nd-4.0 | cc by nd 4.0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: 4.0)?(?: international)? | creativecommons.org/licenses/by nd/4.0
cc-by-sa-2.5 | cc by sa 2.5 | (?:creative commons attribution share ?alike(?: license)?|cc by sa) 2.5(?: generic)? | creativecommons.org/licenses/by sa/2.5
cc-by-sa-3.0 | cc by sa 3.0 | (?:creative commons attribution share ?alike(?: license)?|cc by sa) 3.0(?: unported)? | creativecommons.org/licenses/by sa/3.0
cc-by-sa-4.0 | cc by sa 4.0 | (?:creative commons attribution share ?alike(?: license)?|cc by sa)(?: 4.0)?(?: international)? | creativecommons.org/licenses/by sa/4.0
cc0-1.0 | cc0 1.0 | (?:creative commons (?:zero|cc0)|cc0)(?: 1.0)?(?: universal)?(?: public domain dedication)? | creativecommons.org/publicdomain/zero/1.0
cddl-1.0 | cddl 1.0 | common development and distribution license(?: version| v)?(?: 1.0)? | opensource.org/licenses?/cddl 1.0
cddl-1.1 | cddl 1.1 | common development and distribution license(?: version| v)? 1.1 |
cecill-2.1 | cecill 2.1 | cecill(?: free software)? license(?: agreement)?(?: version| v)?(?: 2.1)? | cecill.info/licen[cs]es
cecill-b | cecill b | cecill b(?: free software)? license |
cecill-c | cecill c | cecill c(?: free software)? license |
cpal-1.0 | cpal 1.0 | common public attribution license(?: version| v)?(?: 1.0)? | opensource.org/licenses?/cpal 1.0
cpl-1.0 | cpl 1.0 | common public license(?: version| v)?(?: 1.0)? | opensource.org/licenses?/cpl1.0
ecl-2.0 | ecl 2.0 | educational community license(?: version| v)?(?: 2.0)? | opensource.org/licenses?/ecl 2.0
efl-2.0 | efl 2.0 | eiffel forum license(?: version| v)?(?: 2)? | opensource.org/licenses?/efl 2.0
elastic-2.0 | elastic 2.0 | elastic license(?: version| v)?(?: 2.0)? | elastic.co/licensing/elastic license
epl-1.0 | epl 1.0 | eclipse public license(?: version| v)? 1.0 | eclipse.org/legal/epl v10
epl-2.0 | epl 2.0 | eclipse public license(?: version| v)? 2.0 | eclipse.org/legal/epl(?: v20| 2.0)
eupl-1.1 | eupl 1.1 | european union public licen[cs]e(?: version| v)? 1.1 |
eupl-1.2 | eupl 1.2 | european union public licen[cs]e(?: version| v)?(?: 1.2)? | joinup.ec.europa.eu/collection/eupl
gfdl-1.2 | gfdl 1.2(?: only| or later)? | gnu free documentation license(?: version| v)? 1.2 | gnu.org/licenses/old licenses/fdl 1.2
gfdl-1.3 | gfdl 1.3(?: only| or later)? | gnu free documentation license(?: version| v)? 1.3 | gnu.org/licenses/fdl(?: 1.3)?
gpl-1.0 | gpl 1.0(?: only| or later)? | (?:gnu )?general public license(?: version| v)? 1(?:.0)? | gnu.org/licenses/old licenses/gpl 1.0
gpl-2.0-only | gpl 2.0(?: only)? | (?:gnu )?general public license(?: version| v)? 2(?:.0)?(?: only)? | gnu.org/licenses/(?:old licenses/)?gpl 2.0
gpl-2.0-or-later | gpl 2.0(?: or later|[+]) | (?:gnu )?general public license(?: version| v)? 2(?:.0)? or(?: at your option)? any later version |
gpl-3.0-only | gpl 3.0(?: only)? | (?:gnu )?general public license(?: version| v)? 3(?:.0)?(?: only)? | gnu.org/licenses/gpl(?: 3.0)?
gpl-3.0-or-later | gpl 3.0(?: or later|[+]) | (?:gnu )?general public license(?: version| v)? 3(?:.0)? or(?: at your option)? any later version |
hpnd | hpnd | historical permission notice and disclaimer | opensource.org/licenses?/hpnd
ijg | ijg | independent jpeg group(?: s)? license |
ipl-1.0 | ipl 1.0 | ibm public license(?: version| v)?(?: 1.0)? | opensource.org/licenses?/ipl 1.0
isc | isc | isc license | opensource.org/licenses?/isc
json | json | the json license | json.org/license
lgpl-2.0 | lgpl 2.0(?: only| or later|[+])? | (?:gnu )?library general public license(?: version| v)?(?: 2(?:.0)?)? | gnu.org/licenses/old licenses/lgpl 2.0
lgpl-2.1-only | lgpl 2.1(?: only)? | (?:gnu )?lesser general public license(?: version| v)? 2.1(?: only)? | gnu.org/licenses/(?:old licenses/)?lgpl 2.1
lgpl-2.1-or-later | lgpl 2.1(?: or later|[+]) | (?:gnu )?lesser general public license(?: version| v)? 2.1 or(?: at your option)? any later version |
lgpl-3.0-only | lgpl 3.0(?: only)? | (?:gnu )?lesser general public license(?: version| v)? 3(?:.0)?(?: only)? | gnu.org/licenses/lgpl(?: 3.0)?
lgpl-3.0-or-later | lgpl 3.0(?: or later|[+]) | (?:gnu )?lesser general public license(?: version| v)? 3(?:.0)? or(?: at your option)? any later version |
libpng-2.0 | libpng(?: 2.0)? | (?:libpng|png reference library) license(?: version| v)?(?: 2)? | libpng.org/pub/png/src/libpng license
lppl-1.3c | lppl 1.3c | latex project public license(?: version| v)?(?: 1.3c?)? | latex project.org/lppl
mit | mit | (?:expat|x11|mit x11|mit expat) license | opensource.org/licenses?/mit(?: license)?
mit-0 | mit 0 | (?:mit no attribution(?: license)?|mit 0 license) | opensource.org/licenses?/mit 0
mpl-1.1 | mpl 1.1 | mozilla public license(?: version| v)? 1.1 | mozilla.org/mpl/1.1
mpl-2.0 | mpl 2.0(?: no copyleft exception)? | mozilla public license(?: version| v)? 2.0 | mozilla.org/(?:en us/)?mpl/2.0
ms-pl | ms pl | microsoft public license | opensource.org/licenses?/ms pl
ms-rl | ms rl | microsoft reciprocal license | opensource.org/licenses?/ms rl
mulanpsl-2.0 | mulanpsl 2.0 | mulan permissive software license(?: version| v)?(?: 2)? | license.coscl.org.cn/mulanpsl2
ncsa | ncsa | (?:university of illinois ncsa open source|ncsa open source) license | opensource.org/licenses?/ncsa
odbl-1.0 | odbl 1.0 | open (?:data commons open )?database license(?: version| v)?(?: 1.0)? | opendatacommons.org/licenses/odbl
odc-by-1.0 | odc by 1.0 | open data commons attribution license(?: version| v)?(?: 1.0)? | opendatacommons.org/licenses/by
ofl-1.1 | ofl 1.1 | sil open font license(?: version| v)?(?: 1.1)? | scripts.sil.org/ofl
openssl | openssl | openssl license | openssl.org/source/license
osl-3.0 | osl 3.0 | open software license(?: version| v)?(?: 3.0)? | opensource.org/licenses?/osl 3.0
pddl-1.0 | pddl 1.0 | (?:open data commons )?public domain dedication (?:and|&) licen[cs]e | opendatacommons.org/licenses/pddl
php-3.01 | php 3.01 | php license(?: version| v)?(?: 3.01)? | php.net/license/3_01.txt
postgresql | postgresql | postgresql licen[cs]e | opensource.org/licenses?/postgresql
psf-2.0 | (?:psf|python) 2.0 | python software foundation license(?: version| v)?(?: 2)? | docs.python.org/3/license
qpl-1.0 | qpl 1.0 | q public license(?: version| v)?(?: 1.0)? | opensource.org/licenses?/qpl 1.0
ruby | ruby | ruby license | ruby lang.org/en/about/license.txt
sspl-1.0 | sspl 1.0 | server side public license(?: version| v)?(?: 1)? | mongodb.com/licensing/server side public license
sleepycat | sleepycat | sleepycat license | opensource.org/licenses?/sleepycat
unicode-3.0 | unicode (?:3.0|dfs 2016) | unicode license(?: agreement)?(?: version| v)?(?: 3)? | unicode.org/(?:license|copyright)
unlicense | unlicense | the unlicense | unlicense.org
upl-1.0 | upl 1.0 | universal permissive license(?: version| v)?(?: 1.0)? | oss.oracle.com/licenses/upl
vim | vim | vim license |
w3c | w3c(?: 20150513)? | w3c software(?: and document)?(?: notice and)? license | w3.org/consortium/legal/2015/copyright software and document
wtfpl | wtfpl | do what the fuck you want to public license | wtfpl.net
zlib | zlib | (?:zlib|zlib libpng) license | opensource.org/licenses?/zlib
zpl-2.1 | zpl 2.1 | zope public license(?: version| v)?(?: 2.1)? | opensource.org/licenses?/zpl
"""

# Fixed values, in the order of the labels: label | a sentence of the license's text or notice.
SIGNATURES = """
afl-3.0 | licensed under the academic free license version 3.0
agpl-3.0 | offer all users interacting with it remotely through a computer network
agpl-3.0 | the terms of the gnu affero general public license as published by
apache-2.0 | licensed under the apache license version 2.0 the license you may not use this file except in compliance
apache-2.0 | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | this license establishes the terms under which a given free software package may be copied
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither the names? of (?:the )?(?:\\S+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0 | distributed under the boost software license version 1.0
cc-by | this work is licensed under (?:a|the) creative commons attribution
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license
cc0-1.0 | to the extent possible under law the (?:author|person)s? (?:\\S+ ){0,8}waived all copyright and related
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
cecill-2.1 | this software is governed by the cecill (?:\\S+ )?license under french law
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the gnu general public license along with
gpl | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0-or-later | either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 of the license or at your option any later version
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose
ijg | this software is based in part on the work of the independent jpeg group
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
json | the software shall be used for good not evil
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl-2.1-or-later | either version 2.1 of the license or at your option any later version
libpng-2.0 | the png reference library is supplied as is
mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the above copyright notice and this permission notice shall be included in all copies
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1.1
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2.0
ms-pl | if you use the software you accept this license if you do not accept the license do not use the software
ncsa | to deal with the software without restriction including without limitation the rights to use copy modify merge
odbl-1.0 | made available under the open database license
ofl-1.1 | this font software is licensed under the sil open font license
ofl-1.1 | the font software may be sold as part of a larger software package
openssl | this product includes software developed by the openssl project
php-3.01 | this product includes php software freely available from
proprietary | all rights reserved (?:\\S+ ){0,12}(?:unauthori[sz]ed|no part of this) (?:\\S+ ){0,6}(?:copying|reproduc\\w+|distribution)
proprietary | confidential and proprietary information of
psf-2.0 | python software foundation license version 2
public-domain | (?:has been|is|was) (?:placed|released|dedicated) (?:in|into|to) the public domain
unlicense | this is free and unencumbered software released into the public domain
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
vim | you may distribute unmodified copies of vim
wtfpl | you just do what the fuck you want to
zlib | in no event will the authors be held liable for any damages arising from the use of this software
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
"""

# Looser hints, label | rule.
HINTS = """
agpl | (?:agpl|agplv3)(?: licensed)?
apache | apache licensed
bsd | (?:the )?bsd(?: style)? license
cc | creative commons license
copyleft | copyleft
eula | end user license agreement
gpl | (?:gpl|gplv2|gplv3) licensed
gpl | (?:under|of) the (?:gpl|gplv2|gplv3)
lgpl | (?:under|of) the (?:lgpl|lgplv2.1|lgplv3)
mit | mit licensed
open-source | open source license
proprietary | proprietary license
public-domain | public domain
royalty-free | royalty free license
shareware | shareware license
"""


class Rule(NamedTuple):
    """clauses: a text that the rule fits holds a word of each."""

    kind: str
    label: str
    clauses: tuple[frozenset[str], ...]
    regex: str


def _fields(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in re.sub(r" \|$", " | ", table.strip(), flags=re.M).split("\n")]


def compiled(rule: str) -> str:
    """The regular expression of a rule."""
    regex = rule.replace("(?: version| v)? ", "(?: version | v ?| )").replace("(?: version| v)?(?: ", "(?:(?: version | v ?| )")
    regex = regex.replace(".", r"\.").replace("/", r"/+").replace(r"\S+", f"{WORD}+").replace(r"\w+", f"{WORD}+")
    regex = regex.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)
    return f"(?<!{WORD})(?:{regex})(?!{WORD})"


def _parts(rule: str, at: str) -> list[str]:
    """The rule cut at a character (or before and behind its groups, for "(") outside of groups."""
    out, depth = [""], 0
    for c in rule:
        if c == "(" and depth == 0 and at == "(":
            out.append("")
        depth += (c == "(") - (c == ")")
        if c == at and depth == 0:
            out.append("")
        else:
            out[-1] += c
        if c == ")" and depth == 0 and at == "(":
            out.append("")
    return out


def clauses(rule: str) -> tuple[frozenset[str], ...]:
    """Sets of words of which a text that the rule fits must hold one each: single words, and the longest words of a group's alternatives. The most telling first."""
    found: list[frozenset[str]] = []
    parts = _parts(rule, "(")
    for part, behind in zip(parts, [*parts[1:], ""], strict=True):
        if part.startswith("("):
            if not re.match(r"[?*]|\{0", behind):
                of_each = [clauses(x) for x in _parts(re.sub(r"^\((\?:)?|\)$", "", part), "|")]
                if all(of_each):
                    found.append(frozenset().union(*(x[0] for x in of_each)))
        else:
            plain = re.sub(r"\[[^]]*\]\??|\\+[Sw]\+|^(?:[?*+]|\{[^}]*\})|\w\?", " ", part)
            found += [frozenset([w]) for w in re.findall(r"[0-9a-z]+", plain)]
    return tuple(sorted(dict.fromkeys(found), key=lambda x: -min(map(len, x))))


def rules() -> list[Rule]:
    """All rules, the most decisive first; in a rank the order of the tables."""
    found: list[tuple[str, str, str]] = []
    for label, ids, name, address in _fields(LICENSES):
        found += [("tag", label, f"spdx license identifier {ids}"), ("name", label, name), ("mention", label, f"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name}")]
        found += [("mention", label, f"license {ids}")] + ([("address", label, address)] if address else [])
    found += [("text", label, rule) for label, rule in _fields(SIGNATURES)] + [("hint", label, rule) for label, rule in _fields(HINTS)]
    found.sort(key=lambda x: -RANKS[x[0]])
    return [Rule(kind, label, clauses(rule), compiled(rule)) for kind, label, rule in found]

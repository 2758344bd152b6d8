"""License notices by ordered signature rules, with DataFrame functions only.

A text is lower-cased and its words are joined by single spaces; a rule is a regular
expression over that. About two hundred rules are written by hand (characteristic
sentences, grants, addresses, package fields, reserved rights); the sentences that
differ by a license's name and version only are composed from tables. Every rule has
a keyword, a word of whatever it matches, and only rules run whose keyword is in the
text. Detections keep their word spans. One that lies within a longer one is
suppressed (of equal spans the better priority stays); the rest are accepted in the
order of their priority, unless they overlap one that was accepted before.

Everything happens within a row, without a shuffle. Defined cases: a null text is
empty; empty texts have no words, no labels and score 0; repeated rows are scanned
one by one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Names, versions and labels of licenses, as words between spaces;
#: {v} stands for a version's words.
FAMILIES = (
    # label, names, versions
    ("mit", ("mit", "expat"), ()),
    ("apache", ("apache", "apache software"), ("2 0", "1 1", "1 0", "2")),
    ("gpl", ("gnu general public", "gpl", "gnu gpl"), ("3 0", "2 0", "3", "2", "1")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "lgpl", "gnu lgpl"), ("3 0", "2 1", "2 0", "3", "2")),
    ("agpl", ("gnu affero general public", "agpl", "affero general public"), ("3 0", "3", "1")),
    ("bsd", ("bsd", "berkeley software distribution", "new bsd", "simplified bsd", "modified bsd"), ("2 clause", "3 clause", "4 clause")),
    ("mpl", ("mozilla public", "mpl"), ("2 0", "1 1", "1 0")),
    ("epl", ("eclipse public", "epl"), ("2 0", "1 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 1", "1 0")),
    ("cpl", ("common public",), ("1 0",)),
    ("isc", ("isc",), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("boost", ("boost software", "bsl"), ("1 0",)),
    ("artistic", ("artistic", "perl artistic"), ("2 0", "1 0")),
    ("psf", ("python software foundation", "psf"), ("2",)),
    ("ofl", ("sil open font", "open font"), ("1 1", "1 0")),
    ("eupl", ("european union public", "eupl"), ("1 2", "1 1")),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ()),
    ("afl", ("academic free", "afl"), ("3 0", "2 1")),
    ("osl", ("open software", "osl"), ("3 0", "2 1")),
    ("postgresql", ("postgresql",), ()),
    ("php", ("php",), ("3 01", "3 0")),
    ("ruby", ("ruby",), ()),
    ("vim", ("vim",), ()),
    ("openssl", ("openssl",), ()),
    ("x11", ("x11",), ()),
    ("sspl", ("server side public", "sspl"), ("1",)),
    ("busl", ("business source", "busl"), ("1 1",)),
    ("elastic", ("elastic",), ("2 0",)),
    ("odbl", ("open database", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution",), ("1 0",)),
    ("gfdl", ("gnu free documentation", "gfdl"), ("1 3", "1 2", "1 1")),
    ("unlicense", ("the unlicense",), ()),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), ("2",)),
)
#: Creative Commons elements and versions.
CC_ELEMENTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_NAMES = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives", "nc_": "non commercial"}
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")
#: Hand-written signatures, best first: label, a word of every match, and a
#: regular expression over lower-case words joined by single spaces.
SIGNATURES = r"""
# the opening or a characteristic sentence of a license's text
mit | associated | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?(?: including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies)?(?: of the software)?
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions(?: of the software)?
mit-0 | attribution | mit no attribution(?: licen[sc]e)?
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse | neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
0bsd | whatsoever | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted in no event (?:[^ ]+ ){0,25}?whatsoever
isc | appear | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | fee | permission to use copy modify (?:and )?(?:or )?distribute this software (?:and its documentation )?for any purpose (?:with or )?without fee is hereby granted
apache-2.0 | apache | licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2.0 | apache | you may obtain a copy of the licen[sc]e at https? www apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?
apache-2.0 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e
apache-2.0 | licensor | unless required by applicable law or agreed to in writing licensor provides the work
apache-2.0 | agreed | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl-3.0 | gpl | this file is part of (?:[^ ]+ ){1,6}?(?:which is )?(?:released|licensed|distributed) under (?:the )?(?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-3.0-or-later | foundation | it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0-or-later | foundation | it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-2.0 | foundation | it under the terms of the gnu general public licen[sc]e version 2(?: only)? as published by the free software foundation
gpl-3.0 | copyleft | the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl | freedom | the licen[sc]es for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl | received | you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|software|file)(?: if not (?:see|write to))?
lgpl-2.1-or-later | lesser | it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-3.0-or-later | lesser | it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
lgpl-2.0-or-later | library | it under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
lgpl | lesser | you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:program|library|software|file)
agpl-3.0-or-later | affero | it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
agpl-3.0 | affero | the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works specifically designed to ensure cooperation with the community
agpl | affero | you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|library|software|file)
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl | mozilla | subject to the terms of the mozilla public licen[sc]e
npl | netscape | the contents of this file are subject to the netscape public licen[sc]e(?: version 1 [01])?
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v ?|version )?2 0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v ?|version )?1 0
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?:(?: v| version)? 1 0)?
cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution licen[sc]e (?:[^ ]+ ){0,5}?cddl
cddl | distribution | subject to the terms of the common development and distribution licen[sc]e
cpl-1.0 | common | the accompanying program is provided under the terms of this common public licen[sc]e
ipl-1.0 | ibm | ibm public licen[sc]e(?: version| v)?(?: 1 0)?
boost-1.0 | boost | distributed under the boost software licen[sc]e version 1 0(?: see accompanying file licen[sc]e 1 0 txt)?
boost-1.0 | boost | boost software licen[sc]e version 1 0(?: august 17th 2003)?
zlib | misrepresented | the origin of this software must not be misrepresented(?: you must not claim that you wrote the original software)?
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented
zlib | liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | png | (?:the )?png reference library(?: licen[sc]e)?
libpng | libpng | libpng licen[sc]e(?: version 2)?
unlicense | unencumbered | this is free and unencumbered software(?: released into the public domain)?
unlicense | unlicense | (?:released|licensed|distributed|available) under the unlicense
unlicense | unlicense | https? (?:www )?unlicense org|the unlicense licen[sc]e
wtfpl-2.0 | fuck | do what the fuck you want to public licen[sc]e(?: version 2)?
beerware | beer | the beer ware licen[sc]e(?: revision 42)?|buy me a beer in return
artistic-2.0 | artistic | the artistic licen[sc]e 2 0
artistic-1.0 | artistic | the clarified artistic licen[sc]e|the artistic licen[sc]e(?: version)? 1 0
perl | perl | (?:under|on) the same terms as perl(?: itself)?(?: 5)?
psf-2.0 | python | python software foundation licen[sc]e(?: version)? 2
python-2.0 | cnri | cnri (?:open source )?licen[sc]e agreement(?: for python)?
ruby | ruby | (?:under|on) the (?:same )?terms (?:of|as) ruby(?: itself| s licen[sc]e)?
php-3.01 | php | this source file is subject to version 3 01 of the php licen[sc]e
php-3.0 | php | this source file is subject to version 3 0 of the php licen[sc]e
postgresql | postgresql | postgresql (?:global development group|database management system) (?:[^ ]+ ){0,10}?permission to use copy modify and distribute
openssl | openssl | this product includes software developed by the openssl project(?: for use in the openssl toolkit)?
ssleay | young | this product includes cryptographic software written by eric young(?: eay cryptsoft com)?
curl | curl | curl and libcurl are licensed under|curl licen[sc]e
ntp | ntp | ntp licen[sc]e
ntp | protocol | network time protocol licen[sc]e
hpnd | hpnd | historical permission notice and disclaimer(?: hpnd)? hpnd|hpnd licen[sc]e
hpnd | pertaining | permission to use copy modify (?:and )?distribute (?:[^ ]+ ){0,10}?advertising or publicity pertaining to
ncsa | illinois | (?:university of )?illinois ncsa open source licen[sc]e
afl-3.0 | academic | licensed under the academic free licen[sc]e version 3 0
osl-3.0 | osl | licensed under the open software licen[sc]e (?:[^ ]+ ){0,3}?osl(?: 3 0| version 3 0)?
ecl-2.0 | educational | educational community licen[sc]e(?: version)?(?: 2 0)?
eupl-1.2 | eupl | licensed under the eupl(?: version)? (?:v ?)?1 2(?: or as soon they will be approved)?
eupl-1.1 | eupl | licensed under the eupl(?: version)? (?:v ?)?1 1
eupl | european | european union public licen[sc]e
cecill-2.1 | cecill | cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version)? 2 1
cecill | cecill | (?:governed by|licensed under|under) the cecill(?: b| c)?(?: licen[sc]e)?
cecill | cill | ce cill(?: b| c)? licen[sc]e
cecill | cecill | cecill(?: b| c)? licen[sc]e
ms-pl | microsoft | microsoft public licen[sc]e(?: ms pl)?
ms-rl | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)?
ms-lpl | microsoft | microsoft limited public licen[sc]e
ms-eula | microsoft | microsoft software licen[sc]e terms
apsl-2.0 | apple | apple public source licen[sc]e(?: version)?(?: 2 0)?
nasa-1.3 | nasa | nasa open source agreement(?: version)?(?: 1 3)?
intel | intel | intel (?:open source|simplified software) licen[sc]e
oracle-upl-1.0 | upl | universal permissive licen[sc]e(?: version| v)? ?1 0 (?:[^ ]+ ){0,3}?upl|upl 1 0
oracle-upl-1.0 | universal | universal permissive licen[sc]e(?: v| version)?(?: ?1 0)?
oracle-bcl | oracle | oracle binary code licen[sc]e agreement
oracle-otn | oracle | oracle technology network licen[sc]e agreement
sleepycat | sleepycat | sleepycat (?:public )?licen[sc]e
qpl-1.0 | trolltech | q public licen[sc]e (?:[^ ]+ ){0,3}?trolltech|trolltech q public licen[sc]e
w3c | w3c | w3c software (?:and document )?(?:notice and )?licen[sc]e
vim | vim | vim licen[sc]e|distributed under the vim licen[sc]e
tcl | tcl | tcl tk licen[sc]e|tcl licen[sc]e terms
unicode | unicode | unicode (?:data files and software )?licen[sc]e(?: agreement)?
icu | icu | icu licen[sc]e(?: icu 1 8 1 and later)?
imagemagick | imagemagick | imagemagick licen[sc]e
freetype | freetype | (?:the )?freetype (?:project )?licen[sc]e(?: ftl)?
ijg | independent | this software is based in part on the work of the independent jpeg group
json | evil | the software shall be used for good not evil
jpl | jpl | california institute of technology (?:[^ ]+ ){0,10}?jpl
blueoak-1.0.0 | blue | blue oak model licen[sc]e(?: 1 0 0)?
hippocratic | hippocratic | hippocratic licen[sc]e(?: version)?(?: [123](?: [01])?)?
prosperity | prosperity | prosperity public licen[sc]e(?: 3 0 0)?
parity | parity | parity public licen[sc]e(?: [67] 0 0)?
polyform-nc | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform | polyform | polyform (?:shield|strict|small business|perimeter|free trial|internal use) licen[sc]e(?: 1 0 0)?
commons-clause | commons | commons clause (?:licen[sc]e )?condition(?: v1 0)?
commons-clause | clause | without limiting other conditions in the licen[sc]e the grant of rights (?:[^ ]+ ){0,15}?commons clause
elastic-2.0 | elastic | elastic licen[sc]e (?:version |v)?2 0(?: elv2)?
busl-1.1 | busl | spdx licen[sc]e identifier busl 1 1
busl-1.1 | change | business source licen[sc]e (?:[^ ]+ ){0,37}?change (?:date|licen[sc]e)
sspl-1.0 | sspl | server side public licen[sc]e (?:[^ ]+ ){0,3}?sspl|sspl(?: version| v)? 1(?: 0)?
confluent | confluent | confluent community licen[sc]e(?: agreement)?(?: version 1 0)?
redis-sal | redis | redis source available licen[sc]e(?: agreement)?
timescale | timescale | timescale licen[sc]e(?: agreement)?
llama | llama | (?:meta )?llama(?: [234])?(?: [1-9])? community licen[sc]e(?: agreement)?
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m| s)?(?: licen[sc]e)?
# documents, fonts, data
gfdl-1.3 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 3
gfdl-1.2 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 2
gfdl | documentation | under the terms of the gnu free documentation licen[sc]e
ofl-1.1 | sil | (?:this font software is )?licensed under the sil open font licen[sc]e(?: version)? 1 1
ofl-1.1 | scripts | scripts sil org ofl
ofl | reserved | with reserved font name
bitstream-vera | bitstream | bitstream vera (?:fonts? )?(?:copyright|licen[sc]e)
ubuntu-font | ubuntu | ubuntu font licen[sc]e(?: version)?(?: 1 0)?
odbl-1.0 | odbl | (?:available|licensed|published) under (?:the )?(?:open database licen[sc]e )?odbl(?: v?1 0)?
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
pddl-1.0 | pddl | public domain dedication and licen[sc]e pddl|pddl 1 0
cdla-permissive-2.0 | cdla | community data licen[sc]e agreement (?:[^ ]+ ){0,3}?cdla|cdla permissive(?: version)?(?: 2 0)?
cdla-sharing-1.0 | cdla | cdla sharing(?: version)?(?: 1 0)?
ogl-3.0 | government | open government licen[sc]e (?:v ?|version )?3 0
ogl | government | open government licen[sc]e
etalab-2.0 | etalab | licen[sc]e ouverte(?: open licen[sc]e)? etalab(?: v?2 0)?|etalab (?:2 0|open licen[sc]e)
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
dl-de-zero-2.0 | datenlizenz | datenlizenz deutschland zero(?: version)? 2 0
open-data | opendata | opendata licen[sc]e
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
cc0-1.0 | zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm-1.0 | publicdomain | creativecommons org publicdomain mark 1 0
cc-pdm-1.0 | mark | public domain mark(?: 1 0)?
public-domain | domain | (?:released|dedicated|placed|put|donated) (?:to|into|in) the public domain
public-domain | domain | (?:is|are) (?:hereby )?in the public domain
public-domain | dedication | public domain dedication
public-domain | domain | no copyright (?:[^ ]+ ){0,3}?public domain
cc | commons | this work is licensed under a creative commons licen[sc]e
cc | commons | some rights reserved (?:[^ ]+ ){0,3}?creative commons
# addresses and badges
mit | opensource | opensource org licenses mit(?: licen[sc]e)?(?: php| html)?
apache-2.0 | opensource | opensource org licenses apache 2 0
apache-2.0 | apache | apache org licen[sc]es licen[sc]e 2 0
bsd-3-clause | opensource | opensource org licenses bsd 3 clause
bsd-2-clause | opensource | opensource org licenses bsd 2 clause
bsd | opensource | opensource org licenses bsd licen[sc]e
gpl-3.0 | opensource | opensource org licenses gpl 3 0
gpl-2.0 | opensource | opensource org licenses gpl 2 0
lgpl | opensource | opensource org licenses lgpl(?: [23] [01])?
mpl-2.0 | opensource | opensource org licenses mpl 2 0
isc | opensource | opensource org licenses isc(?: licen[sc]e)?
zlib | opensource | opensource org licenses zlib(?: licen[sc]e)?
afl-3.0 | opensource | opensource org licenses afl 3 0
osl-3.0 | opensource | opensource org licenses osl 3 0
artistic-2.0 | opensource | opensource org licenses artistic licen[sc]e 2 0
epl | opensource | opensource org licenses epl(?: [12] 0)?
agpl-3.0 | gnu | gnu org licenses agpl(?: 3 0)?
lgpl | gnu | gnu org licenses lgpl(?: [23] [01])?
gfdl | gnu | gnu org licenses fdl(?: 1 [123])?
gpl | gnu | gnu org (?:licenses|copyleft) gpl(?: [23] 0)?
mpl | mozilla | mozilla org mpl(?: [12] [01])?
epl-2.0 | eclipse | eclipse org legal epl (?:2 0|v20)
epl-1.0 | eclipse | eclipse org legal epl v10
boost-1.0 | boost | boost org licen[sc]e 1 0(?: txt)?
mit | shields | shields io badge licen[sc]e mit
apache | shields | shields io badge licen[sc]e apache(?: 2 0)?
gpl | shields | shields io badge licen[sc]e gpl(?: ?v?[23](?: 0)?)?
bsd | shields | shields io badge licen[sc]e bsd(?: [234] clause)?
mpl | shields | shields io badge licen[sc]e mpl(?: 2 0)?
# package fields
mit | mit | licen[sc]e (?:osi approved )?mit(?: licen[sc]e)?
apache-2.0 | apache | licen[sc]e (?:osi approved )?apache (?:software licen[sc]e|2 0)
gpl | gpl | licen[sc]e (?:osi approved )?(?:gnu general public licen[sc]e(?: v[23])?(?: or later)? )?gpl(?: v?[23])?(?: 0)?(?: or later| only)?
bsd | bsd | licen[sc]e (?:osi approved )?bsd(?: [234] clause| licen[sc]e)?
isc | isc | licen[sc]e (?:osi approved )?isc(?: licen[sc]e)?
# reserved rights
proprietary | proprietary | (?:this (?:software|document|file) (?:is|contains) )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? (?:of this (?:file|software|program|document) )?(?:via any medium )?is strictly prohibited
proprietary | unpublished | unpublished (?:work )?(?:rights reserved|proprietary)(?: under the copyright laws)?
proprietary | reserved | all rights reserved
proprietary | eula | end user licen[sc]e agreement(?: eula)? eula|subject to (?:the |this )?eula
proprietary | disclosed | may not be (?:reproduced|copied|used)(?: or disclosed| disclosed)? (?:[^ ]+ ){0,7}?disclosed
proprietary | permission | no part of this (?:publication|document|book|work) may be reproduced (?:[^ ]+ ){0,20}?permission
free-for-noncommercial | noncommercial | free for (?:personal and )?noncommercial use(?: only)?|for noncommercial use only
free-for-noncommercial | commercial | (?:free for |for )(?:personal and )?non commercial use(?: only)?|not for commercial use
freeware | freeware | (?:this (?:software|program) is |released as )?freeware
shareware | shareware | (?:this (?:software|program) is |distributed as )?shareware
# warranty clauses, which many licenses share
warranty-clause | merchantability | (?:implied )?warranties of merchantability(?: and)? fitness for a particular purpose
warranty-clause | warranty | (?:without any warranty|with absolutely no warranty)(?: without even the implied warranty of merchantability or fitness for a particular purpose)?
"""


@dataclass(frozen=True)
class Rule:
    """``priority``: the lower, the better; ``keyword``: a word without which the pattern can't match."""

    priority: int
    label: str
    keyword: str
    pattern: str
    score: float


def ordered_rules() -> list[Rule]:
    """The rules in order: those written by hand first, then names with versions, bare names last."""
    found: list[tuple[str, str, str, float]] = []
    for line in SIGNATURES.splitlines():
        if line and not line.startswith("#"):
            label, key, pattern = line.split(" | ", 2)
            found.append((label, key, pattern, 0.9))
    for label, names, versions in FAMILIES:
        for name in names:
            key = name.split(" ")[-1] if name.split(" ")[-1] not in ("public", "software", "general", "open", "free") else name.split(" ")[0]
            full = name if name.endswith("unlicense") else f"{name} licen[sc]e"
            spoken = rf"(?:{full}|{name})" if name != full else full
            for v in versions:
                exact = f"{label}-{v.replace(' ', '.')}" if "clause" not in v else f"{label}-{v.replace(' ', '-')}"
                found.append((exact, key, rf"spdx licen[sc]e identifier {name} {v}(?: only| or later)?", 1.0))
                found.append((exact, key, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{spoken}(?: version)? (?:v )?v?{v}(?: or later| or any later version| only)?", 0.95))
                found.append((exact, key, rf"{full}(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v )?v?{v}(?: or later| or any later version| only)?", 0.9))
                found.append((exact, key, rf"{name} (?:v )?v?{v}(?: only| or later)? licen[sc]e", 0.9))
                if "clause" in v:
                    found.append((exact, key, rf"{v} {full}", 0.9))
            found.append((label, key, rf"spdx licen[sc]e identifier {name}", 1.0))
            found.append((label, key, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{spoken}", 0.85))
            found.append((label, key, full, 0.7))
    for elements in CC_ELEMENTS:
        label = "cc-" + elements.replace(" ", "-")
        words = " ".join(rf"(?:{CC_NAMES[e]}|non commercial|share alike|no derivatives|no derivs)" if e != "by" else CC_NAMES[e] for e in elements.split(" "))
        for v in CC_VERSIONS:
            exact = f"{label}-{v.replace(' ', '.')}"
            found.append((exact, "cc", rf"(?:spdx licen[sc]e identifier |(?:licensed|released|distributed|available|published) under (?:the |a )?)?cc {elements} {v}(?: licen[sc]e)?", 0.95))
            found.append((exact, "creativecommons", rf"creativecommons org licenses {elements} {v}", 0.95))
            found.append((exact, "commons", rf"creative commons {words} {v}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", 0.9))
        found.append((label, "cc", rf"cc {elements}(?: licen[sc]e)?", 0.8))
        found.append((label, "commons", rf"creative commons {words}(?: licen[sc]e)?", 0.8))
    return [Rule(k, label, key, pattern, score) for k, (label, key, pattern, score) in enumerate(found)]


def keyword_pattern(keywords: list[str]) -> str:
    """Any of the keywords as a word, tried by first letters."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted(keywords):
        by_letter.setdefault(k[0], []).append(k[1:])
    return " (" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")(?= )"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _detections(norm: Column, rule: Column) -> Column:
    """Spans of a rule's matches: the words before a match are those of the parts and matches that precede it."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))
    parts = F.transform(F.split(norm, pattern), _spaces)
    hits = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), _spaces)

    def span(words: Column, k: Column) -> Column:
        start = _total(F.slice(parts, F.lit(1), k + 1)) + _total(F.slice(hits, F.lit(1), k))
        return F.struct(start.alias("start"), (-(start + words)).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))

    return F.transform(hits, span)


def _resolved(found: Column) -> Column:
    """Detections without those within a longer one, then accepted by priority where they overlap none accepted before."""
    none = F.filter(found, lambda x: F.lit(False))
    outer = F.aggregate(  # sorted by start, longest first, a detection is contained if an earlier one ends as late
        F.array_sort(found),
        F.struct(F.lit(0).alias("end"), none.alias("kept")),
        lambda a, x: F.when(-x["minus_end"] <= a["end"], a).otherwise(F.struct((-x["minus_end"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))),
    )["kept"]
    first = lambda x: F.struct(x["priority"].alias("priority"), x.alias("x"))
    apart = lambda x, y: (y["start"] >= -x["minus_end"]) | (x["start"] >= -y["minus_end"])
    accepted = F.aggregate(F.transform(F.array_sort(F.transform(outer, first)), lambda p: p["x"]), none, lambda a, x: F.when(F.forall(a, lambda y: apart(x, y)), F.concat(a, F.array(x))).otherwise(a))
    return F.array_sort(accepted)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words``, the base columns, ``detections`` (spans with label and score), ``labels`` and ``score``."""
    rules = ordered_rules()
    by_key: dict[str, list[dict]] = {}
    for r in rules:
        by_key.setdefault(r.keyword, []).append(asdict(r))
    kind = "map<string,array<struct<priority:int,label:string,keyword:string,pattern:string,score:double>>>"
    table = F.from_json(F.lit(json.dumps(by_key)), kind)  # a constant
    lower = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))  # A-Z; other letters are word characters in either case
    flat = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flat.alias("flat"))
    cut = cut.select("doc_id", F.when(F.col("flat") == "", F.lit(0)).otherwise(_spaces(F.col("flat")) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "flat", F.lit(" ")).alias("norm"))
    cut = cut.withColumn("keys", F.array_distinct(F.regexp_extract_all("norm", F.lit(keyword_pattern(list(by_key))), F.lit(1))))
    matching = lambda k: F.filter(F.element_at(table, k), lambda r: F.rlike(F.col("norm"), F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
    phrase = "|".join(p for p, _ in BASE)
    base = F.rlike("norm", F.lit(f" (?:{phrase}) "))
    cut = cut.select(
        "doc_id",
        "n_words",
        "norm",
        F.regexp_count("norm", F.lit(f" (?:{phrase})(?= )")).cast("long").alias("n_base"),
        F.when(base, _spaces(F.regexp_extract("norm", f"(?s)^(.*?) (?:{phrase}) ", 1))).cast("long").alias("first_word"),
        F.when(base, _spaces(F.regexp_extract("norm", f"(?s)^(.*) (?:{phrase}) ", 1))).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.contains("norm", F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(BASE, key=lambda x: x[1])))).alias("base"),
        F.flatten(F.transform("keys", lambda k: F.flatten(F.transform(matching(k), lambda r: _detections(F.col("norm"), r))))).alias("found"),
    )
    detections = F.when(F.size("found") > 0, _resolved(F.col("found")))
    cut = cut.withColumn("detections", F.transform(detections, lambda x: F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["label"].alias("label"), x["score"].alias("score"))))
    named = F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>"))
    return cut.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.coalesce(F.array_join(F.array_sort("base"), ","), F.lit("")).alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("base", F.array().cast("array<string>")), named))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
        "detections",
    )

"""License scans: ordered signature rules behind a keyword test, with containment suppression. Native."""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, lower_ascii, sweep, table

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Licenses: label, names in words, versions. A name of "=" is the label's own words. Names stand in lower case, as words do in the normalised text.
FAMILIES = """
gpl|gnu general public license;gnu gpl;gpl|1 0;2 0;3 0;2;3
lgpl|gnu lesser general public license;gnu library general public license;gnu lgpl;lgpl|2 0;2 1;3 0;2;3
agpl|gnu affero general public license;affero general public license;gnu agpl;agpl|1 0;3 0;3
gfdl|gnu free documentation license;gfdl|1 1;1 2;1 3
apache|apache software license;apache license;apache|1 0;1 1;2 0;2
mit|mit license;mit x11 license;expat license;the mit license mit|
mit-0|mit no attribution;mit 0|
bsd-2-clause|bsd 2 clause license;simplified bsd license;freebsd license;bsd 2 clause|
bsd-3-clause|bsd 3 clause license;new bsd license;revised bsd license;modified bsd license;bsd 3 clause|
bsd-4-clause|bsd 4 clause license;original bsd license;bsd 4 clause|
bsd|bsd license;bsd style license;berkeley software distribution license|
0bsd|zero clause bsd license;bsd zero clause;0bsd|
isc|isc license;internet systems consortium license|
mpl|mozilla public license;mpl|1 0;1 1;2 0
epl|eclipse public license;epl|1 0;2 0
cpl|common public license|0 5;1 0
cddl|common development and distribution license;cddl|1 0;1 1
eupl|european union public licence;european union public license;eupl|1 0;1 1;1 2
artistic|artistic license;perl artistic license|1 0;2 0
zlib|zlib license;zlib libpng license|
libpng|libpng license|2 0
boost|boost software license;bsl 1 0|1 0
wtfpl|do what the fuck you want to public license;wtfpl|2
unlicense|the unlicense;unlicense license|
python|python software foundation license;psf license;python license|2 0
php|php license|3 0;3 01
ruby|ruby license|
openssl|openssl license;ssleay license|
ofl|sil open font license;open font license;ofl|1 0;1 1
ms-pl|microsoft public license;ms pl|
ms-rl|microsoft reciprocal license;ms rl|
apsl|apple public source license|1 0;1 1;1 2;2 0
osl|open software license|1 0;2 0;3 0
afl|academic free license|1 2;2 0;2 1;3 0
ncsa|university of illinois ncsa open source license;ncsa open source license|
qpl|q public license|1 0
sleepycat|sleepycat license|
vim|vim license|
w3c|w3c software notice and license;w3c license|
x11|x11 license|
zpl|zope public license|1 1;2 0;2 1
ecl|educational community license|1 0;2 0
upl|universal permissive license|1 0
cecill|cecill free software license agreement;cecill|1 0;1 1;2 0;2 1
odbl|open data commons open database license;open database license;odbl|1 0
odc-by|open data commons attribution license;odc by|1 0
pddl|open data commons public domain dedication;pddl|1 0
bsl|business source license|1 0;1 1
sspl|server side public license;sspl|1
elastic|elastic license|1 0;2 0
commons-clause|commons clause|1 0
blueoak|blue oak model license|1 0 0
mulan|mulan permissive software license;mulan psl|1;2
cc0|creative commons zero;cc0|1 0
cc-by|creative commons attribution;cc by|1 0;2 0;2 5;3 0;4 0
cc-by-sa|creative commons attribution sharealike;creative commons attribution share alike;cc by sa|1 0;2 0;2 5;3 0;4 0
cc-by-nc|creative commons attribution noncommercial;creative commons attribution non commercial;cc by nc|1 0;2 0;2 5;3 0;4 0
cc-by-nd|creative commons attribution noderivatives;creative commons attribution no derivatives;cc by nd|1 0;2 0;2 5;3 0;4 0
cc-by-nc-sa|creative commons attribution noncommercial sharealike;cc by nc sa|1 0;2 0;2 5;3 0;4 0
cc-by-nc-nd|creative commons attribution noncommercial noderivatives;cc by nc nd|1 0;2 0;2 5;3 0;4 0
llama|llama community license|2;3
openrail|creativeml open rail m;openrail m;openrail|
""".strip()

#: Rules written out: label, keyword, expression over the normalised text, score. They are distinctive clauses of licences and notices.
TEXTS = """
mit|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy|0.95
mit|without restriction including|to deal in the software without restriction including without limitation the rights to use|0.95
mit|above copyright notice and this permission notice|the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies|0.9
mit|substantial portions of the software|in all copies or substantial portions of the software|0.85
mit-0|without restriction including|to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided|0.9
mit-modern|without written agreement|permission is hereby granted without written agreement and without license or royalty fees|0.9
x11|x consortium|except as contained in this notice the name of the x consortium shall not be used in advertising|0.95
x11|advertising or otherwise|shall not be used in advertising or otherwise to promote the sale use or other dealings|0.85
isc|permission to use|permission to use copy modify and( or)? distribute this software for any purpose|0.95
isc|with or without fee|this software for any purpose with or without fee is hereby granted|0.9
0bsd|with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided|0.9
hpnd|without fee is hereby granted|permission to use copy modify( and)? distribute( and sell)? this software and its documentation for any purpose( is hereby granted)? without fee is hereby granted|0.9
ntp|no representations about the suitability|makes no representations about the suitability (of )?this software for any purpose|0.85
bsd|redistribution and use|redistribution and use in source and binary forms with or without modification|0.95
bsd|redistributions of source code|redistributions of source code must retain the (above )?(original )?copyright notice|0.9
bsd|redistributions in binary form|redistributions in binary form must reproduce the above copyright notice|0.9
bsd-3-clause|neither the name|neither the name of .{1,400} nor the names of (its|their|any) contributors|0.9
bsd-3-clause|neither the names|neither the names of .{1,400} nor the names of (its|their|any) contributors|0.9
bsd-3-clause|endorse or promote products|may be used to endorse or promote products derived from this software without (specific )?prior written permission|0.9
bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment|0.95
bsd-2-clause-views|views and conclusions|the views and conclusions contained in the software and documentation are those of the authors|0.9
bsd-3-clause-lbnl|upgrades to the features|any bug fixes patches or upgrades to the features functionality or performance of the source code|0.9
bsd-3-clause-clear|no express or implied licenses|no express or implied licenses to any party s patent rights are granted by this license|0.9
warranty-disclaimer|implied warranties|any express or implied warranties including but not limited to the implied warranties of merchantability|0.5
warranty-disclaimer|without warranty of any kind|the software is provided as is without warranty of any kind express or implied|0.5
apache-2.0|may obtain a copy of the license|you may obtain a copy of the license at http www apache org licenses license 2 0|0.95
apache-2.0|except in compliance with the license|you may not use this file except in compliance with the license|0.85
apache-2.0|apache org licenses|apache org licenses license 2 0|0.9
apache-2.0|contributor license agreements|licensed to the apache software foundation asf under one or more contributor license agreements|0.95
apache-2.0|grant of patent license|grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you|0.95
apache-2.0|submission of contributions|submission of contributions unless you explicitly state otherwise any contribution intentionally submitted|0.95
apache-1.1|apache software foundation|this product includes software developed by the apache software foundation|0.9
apache-1.0|apache group|this product includes software developed by the apache group|0.9
gpl|free software|this program is free software you can redistribute it and or modify it|0.95
gpl|free software|(it|this file|this library|this software) is free software you can redistribute it and or modify it under the terms of the gnu general public license|0.95
gpl|either version|either version [123] of the license or at your option any later version|0.9
gpl|received a copy of the gnu general public license|you should have received a copy of the gnu general public license|0.9
gpl|gnu org licenses gpl|gnu org licenses gpl( [123] 0)?( html| txt)?|0.9
gpl|published by the free software foundation|as published by the free software foundation|0.85
gpl-2.0|51 franklin|write to the free software foundation inc 51 franklin (st|street)|0.8
gpl-2.0|59 temple place|(write to the )?free software foundation inc 59 temple place|0.8
gpl-2.0|derived from the program|you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program|0.95
gpl-2.0|freedom to share and change|the licenses for most software are designed to take away your freedom to share and change it|0.95
gpl-3.0|free copyleft license|the gnu general public license is a free copyleft license for software and other kinds of works|0.95
gpl-3.0|to convey a work|to convey a work means any kind of propagation that enables other parties to make or receive copies|0.95
gpl-3.0|installation information|installation information for a user product means any methods procedures authorization keys|0.95
gpl-3.0|effective technological measure|no covered work shall be deemed part of an effective technological measure|0.95
gpl-exception|special exception|as a special exception (the copyright holders?|you|if you|the free software foundation)|0.7
gpl-classpath-exception|linking this library|linking this library statically or dynamically with other modules is making a combined work based on this library|0.95
gpl-autoconf-exception|this configure script|this configure script (is free software|may be copied)|0.6
lgpl|received a copy of the gnu lesser|you should have received a copy of the gnu lesser general public license|0.95
lgpl|derivative of any portion of the library|a program that contains no derivative of any portion of the library but is designed to work with the library|0.95
lgpl-2.1|released version of the lesser gpl|this is the first released version of the lesser gpl|0.95
lgpl-3.0|incorporates the terms and conditions of version 3|this version of the gnu lesser general public license incorporates the terms and conditions of version 3|0.95
lgpl-3.0|combined work|a combined work is a work produced by combining or linking an application with the library|0.95
agpl-3.0|remote network interaction|remote network interaction use with the gnu general public license|0.95
agpl-3.0|interacting with it remotely|all users interacting with it remotely through a computer network|0.95
agpl|received a copy of the gnu affero|you should have received a copy of the gnu affero general public license|0.95
gfdl|invariant sections|with no invariant sections no front cover texts and no back cover texts|0.95
gfdl|granted to copy distribute and or modify this document|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license|0.95
mpl-2.0|source code form|this source code form is subject to the terms of the mozilla public license|0.95
mpl-2.0|incompatible with secondary licenses|this source code form is incompatible with secondary licenses|0.9
mpl-1.1|software distributed under the license|software distributed under the license is distributed on an as is basis without warranty of any kind either express( ed)? or implied see the license for the specific language governing rights and limitations|0.85
mpl-1.1|initial developer|the initial developer of the original code is|0.85
mpl|mozilla org mpl|mozilla org mpl( [12] [01])?|0.9
epl|eclipse org legal|eclipse org legal epl( v10| v20| 2 0)?|0.9
epl|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license|0.95
epl|commercial product offering|a contributor who includes the program in a commercial product offering|0.9
cddl|common development and distribution|the contents of this file are subject to the terms of the common development and distribution license|0.95
cddl|cddl header|cddl header (start|end)|0.9
artistic|may be copied|the intent of this document is to state the conditions under which a package may be copied|0.95
artistic-2.0|copyright holder intends|the copyright holder intends to allow the copying modification and or redistribution|0.8
zlib|origin of this software|the origin of this software must not be misrepresented|0.95
zlib|altered source versions|altered source versions must be plainly marked as such|0.95
zlib|provided as is|this software is provided as is without any express or implied warranty|0.8
libpng|png reference library|the png reference library is supplied as is|0.95
boost|boost org license|boost org license 1 0 txt|0.95
boost|accompanying file license|see accompanying file license 1 0 txt|0.95
boost|machine executable object code|in the form of machine executable object code generated by a source language processor|0.95
unlicense|unencumbered|free and unencumbered software released into the public domain|0.95
unlicense|benefit of the public at large|we make this dedication for the benefit of the public at large|0.95
wtfpl|do what the fuck|you just do what the fuck you want to|0.95
beerware|beer ware|the beer ware license|0.95
beerware|a beer in return|if we meet some day and you think this stuff is worth it you can buy me a beer in return|0.95
json|good not evil|the software shall be used for good not evil|0.95
postgresql|university of california be liable|in no event shall the university of california be liable to any party|0.85
python|python software foundation psf|this license agreement is between the python software foundation psf and the individual or organization|0.95
php|may not be called php|products derived from this software may not be called php|0.95
ruby|verbatim copies of the source form|you may make and give away verbatim copies of the source form of the software without restriction|0.9
openssl|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit|0.95
ssleay|eric young|this product includes cryptographic software written by eric young|0.95
ofl|reserved font name|(with )?reserved font name|0.9
ofl|neither the font software nor any|neither the font software nor any of its individual components in original or modified versions may be sold by itself|0.95
ms-pl|patent claim against any contributor|if you bring a patent claim against any contributor over patents that you claim are infringed by the software|0.9
ms-rl|recipients the source code|for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code|0.95
qpl|separate from the software such as patches|you may distribute your modifications in a form that is separate from the software such as patches|0.95
vim|charityware|vim is charityware you can use and copy it as much as you like|0.95
curl|name of a copyright holder|except as contained in this notice the name of a copyright holder shall not be used in advertising|0.95
unicode|unicode inc|unicode inc license agreement data files and software|0.95
w3c|you the licensee agree|by obtaining using and or copying this work you the licensee agree|0.9
zpl|zope corporation|this software consists of voluntary contributions made by many individuals on behalf of zope corporation|0.95
ecl-2.0|educational community license|licensed under the educational community license version 2 0|0.95
eupl|licensed under the eupl|licensed under the eupl|0.95
cecill|cecill|this software is governed by the cecill( b| c)? license under french law|0.95
cecill|logiciel est régi|ce logiciel est régi par la licence cecill( b| c)?|0.95
odbl|database contents license|any rights in individual contents of the database are licensed under the database contents license|0.95
odbl|made available under the open database license|made available under the open database license|0.95
cc0|waived all copyright|has waived all copyright and related or neighboring rights|0.95
cc0|creativecommons org publicdomain zero|creativecommons org publicdomain zero 1 0|0.95
cc0|affirmer|affirmer hereby overtly fully permanently irrevocably and unconditionally waives|0.95
public-domain-mark|creativecommons org publicdomain mark|creativecommons org publicdomain mark 1 0|0.95
cc-by|creativecommons org licenses by|creativecommons org licenses by [1234] [05]|0.95
cc-by-sa|creativecommons org licenses by sa|creativecommons org licenses by sa [1234] [05]|0.95
cc-by-nc|creativecommons org licenses by nc|creativecommons org licenses by nc [1234] [05]|0.95
cc-by-nd|creativecommons org licenses by nd|creativecommons org licenses by nd [1234] [05]|0.95
cc-by-nc-sa|creativecommons org licenses by nc sa|creativecommons org licenses by nc sa [1234] [05]|0.95
cc-by-nc-nd|creativecommons org licenses by nc nd|creativecommons org licenses by nc nd [1234] [05]|0.95
cc-by|appropriate credit|you must give appropriate credit provide a link to the license and indicate if changes were made|0.9
cc-by-sa|distribute your contributions under the same license|if you remix transform or build upon the material you must distribute your contributions under the same license as the original|0.9
cc-by-nc|commercial purposes|you may not use the material for commercial purposes|0.9
cc-by-nd|modified material|if you remix transform or build upon the material you may not distribute the modified material|0.9
cc|some rights reserved|some rights reserved|0.6
sspl|service source code|you must make the service source code available via network download|0.95
sspl|functionality of the program|making the functionality of the program or modified version available to third parties as a service|0.9
bsl|additional use grant|additional use grant|0.9
bsl|change date|on the change date or the fourth anniversary of the first publicly available distribution|0.95
bsl|non production use|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work|0.95
elastic-2.0|hosted or managed service|you may not provide the software to third parties as a hosted or managed service|0.95
commons-clause|right to sell the software|the grant of rights under the license will not include and the license does not grant to you the right to sell the software|0.95
polyform|polyform|polyform (noncommercial|perimeter|shield|small business|internal use|free trial|strict)( license)?|0.95
fsl|functional source license|functional source license|0.95
blueoak|gives everyone as much permission|this license gives everyone as much permission to work with this software as possible|0.95
mulan|mulan psl|you can use this software according to the terms and conditions of the mulan psl v[12]|0.95
llama|llama materials|(you will not use the )?llama materials|0.8
llama|built with llama|built with llama( [234])?|0.8
gemma|gemma terms of use|gemma terms of use|0.9
openrail|use based restrictions|use based restrictions|0.8
openrail|derivatives of the model|you agree not to use the model or derivatives of the model|0.9
public-domain|public domain|(dedicated to|released into|placed in|put in|in) the public domain|0.8
public-domain|domaine public|(dans le|du|au) domaine public|0.7
public-domain|dominio público|(de|del|al|en el) dominio público|0.7
public-domain|gemeinfrei|gemeinfrei|0.7
us-government|united states government work|(this is a )?united states government work|0.8
us-government|title 17|pursuant to title 17 (section 105 )?(of the )?united states code|0.8
us-government|use duplication or disclosure|use duplication or disclosure by the (u s )?government is subject to restrictions|0.8
crown-copyright|crown copyright|crown copyright|0.7
ogl|open government|open government licen[cs]e( v ?[123]( 0)?| version [123]( 0)?)?|0.9
all-rights-reserved|rights reserved|all rights reserved|0.6
all-rights-reserved|tous droits|tous droits (de reproduction )?réservés|0.6
all-rights-reserved|alle rechte|alle rechte vorbehalten|0.6
all-rights-reserved|derechos reservados|todos los derechos reservados|0.6
all-rights-reserved|direitos reservados|todos os direitos reservados|0.6
all-rights-reserved|diritti riservati|tutti i diritti riservati|0.6
all-rights-reserved|rechten voorbehouden|alle rechten voorbehouden|0.6
copyright|copyright|copyright( c| ©)?( \\d{4}){1,2}|0.4
copyright|droits d auteur|(protégé par les )?droits d auteur|0.4
copyright|urheberrecht|urheberrecht|0.4
copyright|derechos de autor|derechos de autor|0.4
proprietary|proprietary|proprietary (and|or) confidential|0.7
proprietary|confidential and proprietary|confidential and proprietary( information)?|0.7
proprietary|unauthorized copying|unauthorized copying of this (file|software|document) via any medium is strictly prohibited|0.9
proprietary|trade secrets|(contains|constitutes?) (confidential information and |valuable )?trade secrets|0.7
proprietary|without the prior written|may not be (reproduced|copied|distributed|disclosed)( or (reproduced|copied|distributed|disclosed))*( in whole or in part)? without the prior written (consent|permission)|0.7
proprietary|license agreement|end user license agreement|0.6
proprietary|licensed not sold|the software is licensed not sold|0.8
proprietary|reverse engineer|(you may not|not to) reverse engineer decompile or disassemble|0.8
proprietary|internal use only|for internal use only|0.6
non-commercial|non commercial use|(for )?non commercial use only|0.7
non-commercial|noncommercial use|(for )?noncommercial use only|0.7
non-commercial|research purposes only|for (academic( and| or)? |non commercial )?research purposes only|0.7
non-commercial|personal use only|for personal use only|0.6
non-commercial|educational use only|for educational use only|0.6
shareware|evaluation copy|(this is an )?evaluation copy|0.6
freeware|freeware|freeware|0.5
shareware|shareware|shareware|0.5
dual-license|dual licensed|dual licensed (under|with)|0.6
dual-license|your option|licensed under either of .{1,400} at your option|0.7
copyleft|copyleft|copyleft|0.4
royalty-free|royalty free|(perpetual )?(worldwide )?(non exclusive )?(no charge )?royalty free( irrevocable)?( copyright| patent)? licen[cs]e|0.5
patent-grant|patent license|hereby grants (to )?you a perpetual worldwide non exclusive no charge royalty free irrevocable .{0,400}patent license|0.8
""".strip()

# Labels that people say with "licensed" behind them or "license" before them.
SHORT = ("mit", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "isc", "bsd", "zlib", "unlicense")
# Names of one word up to this length are joined with their version (gplv3); longer ones mean other things then.
LONGEST_ACRONYM = 5

WHOLE = "array<struct<keyword:string,regex:string,label:string,priority:int,score:double>>"


@lru_cache(maxsize=1)
def rules() -> list[dict]:
    """The rules in order: SPDX tags, grants by name and version, grants by name, names with a version, plain names, texts.

    An expression matches whole words of the normalised text, in which one space stands before, between and
    after words; it begins at the space before its first word and ends before the one after its last.
    needs are phrases of whole words; every match of the rule has one of them.
    """
    out = []

    def add(priority: int, keyword: str, body: str, label: str, score: float, needs: list[str]) -> None:
        out.append({"keyword": keyword, "regex": f" {body}(?= )", "label": label, "priority": priority, "score": score, "needs": needs})

    grant = "(?:licensed|released|distributed|available|provided|published|covered|made available) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
    for line in FAMILIES.splitlines():
        label, names, versions = line.split("|")
        names, versions = names.split(";"), [v for v in versions.split(";") if v]
        spelled = "(?:" + "|".join(names) + ")"
        key = names[-1] if len(names) == 1 else min(names, key=len)
        keys = {n: n for n in names}
        add(10, "spdx license identifier", f"spdx license identifier {label.replace('-', ' ')}(?: \\d+)*(?: only| or later)?", label, 1.0, ["spdx license identifier"])
        for v in versions:
            spoken_v = f"(?: version| v)? v?{v}"
            add(20, f"{v} ", f"{grant}{spelled}(?: license)?{spoken_v}", f"{label}-{v.replace(' ', '.')}", 0.98, names)
            add(40, f"{v} ", f"{spelled}(?: license)?{spoken_v}", f"{label}-{v.replace(' ', '.')}", 0.9, names)
            for n in (n for n in names if " " not in n and len(n) <= LONGEST_ACRONYM):
                joined = [f"{n}v{v}", f"{n}{v}"]
                add(20, n, f"{grant}{n}v?{v}", f"{label}-{v.replace(' ', '.')}", 0.98, joined)
                add(40, n, f"{n}v?{v}", f"{label}-{v.replace(' ', '.')}", 0.9, joined)
            whole, zero = [n for n in names if "license" in n.split()], v.removesuffix(" 0")
            if whole and zero not in versions:
                add(40, f"{zero} ", f"(?:{'|'.join(whole)})(?: version v?| v ?){zero}", f"{label}-{v.replace(' ', '.')}", 0.85, whole)
        if label in SHORT:
            short = label.replace("-", " ")
            add(30, f"{short} licen", f"{short} licen[cs]ed", label, 0.9, [f"{short} licensed", f"{short} licenced"])
            add(50, f"e {short}", f"licen[cs]e {short}", label, 0.8, [f"license {short}", f"licence {short}"])
        for n in keys:
            add(30, n, f"{grant}{n}(?: license)?", label, 0.95, [n])
        spoken = [n for n in names if "licen" in n or len(n.split()) > 1]
        for n in spoken or [f"{key} license"]:
            add(50, n, n, label, 0.8, [n])
    for line in TEXTS.splitlines():
        label, key, body, score = line.split("|", 2)[0], line.split("|", 2)[1], line.split("|", 2)[2].rpartition("|")[0], line.rpartition("|")[2]
        add(60, key, body.replace("\\\\", "\\"), label, float(score), [key])
    return out


@lru_cache(maxsize=1)
def gate() -> str:
    """A cheap test of the raw text that every text with a base phrase, or with a match of some rule, passes.

    It looks for the phrases that the rules need, as whole words; the word license stands for all phrases with it.
    """
    phrases = sorted({"license" if "license" in n.split() else n for n in [*BASE, *(n for r in rules() for n in r["needs"])]})
    spelled = lambda n: (SEPARATOR + "+").join(n.split())
    heads = (head + "(?:" + "|".join(spelled(n)[1:] for n in group) + ")" for head, group in groupby(phrases, key=lambda n: n[0]))
    return f"(?i)(?:^|{SEPARATOR})(?:" + "|".join(heads) + rf")(?={SEPARATOR}|\z)"


def normalised(text: Column) -> Column:
    """The words of a text in lower case with single spaces before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


DETECTIONS = "array<struct<start:int,end:int,priority:int,score:double,label:string>>"


def found_by(s: Column, rule: Column) -> Column:
    """Places of a rule in the normalised text, as structs of start and end in characters with the rule's fields."""
    between, hits = F.split(s, rule["regex"], -1), F.regexp_extract_all(s, rule["regex"], F.lit(0))
    sizes = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.struct(F.length(b).alias("gap"), F.length(h).alias("len")))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        one = F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["len"]).alias("end"), rule["priority"].alias("priority"), rule["score"].alias("score"), rule["label"].alias("label"))
        return at + p["gap"] + p["len"], F.array(one)

    return bound(sizes, lambda x: sweep(x, F.lit(0), DETECTIONS, step))


def strongest(detections: Column) -> Column:
    """The places of detections that no stronger one contains, in one sweep over them by start, longer ones first.

    A place goes if another that contains it has a smaller priority number, or the same and is longer (then:
    starts first, has the smaller label). Whatever contains a place comes before it in the sweep, so the largest end
    of each priority so far tells.
    """
    levels = sorted({r["priority"] for r in rules()})
    order = F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["end"].alias("end"), d["score"].alias("score")))
    ends = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels])

    def step(ends: Column, d: Column) -> tuple[Column, Column]:
        own = lambda p: F.when(d["priority"] >= p, ends[f"e{p}"]).otherwise(F.lit(-1))
        one = F.struct(d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority"), d["score"].alias("score"), d["label"].alias("label"))
        new = F.struct(*[F.when((d["priority"] == p) & (d["end"] > ends[f"e{p}"]), d["end"]).otherwise(ends[f"e{p}"]).alias(f"e{p}") for p in levels])
        return new, F.when(F.greatest(*map(own, levels)) >= d["end"], F.array().cast(DETECTIONS)).otherwise(F.array(one))

    return bound(F.array_sort(order), lambda x: sweep(x, ends, DETECTIONS, step))


def scan(docs: DataFrame) -> DataFrame:
    """docs (with text) and: _s, the normalised text (null where the gate finds nothing), and detections.

    detections are the places of rules that no stronger one suppresses (see strongest). A null or empty text has
    none; repeated rows are scanned each by itself, an empty table gives no rows. A text of any length is read
    whole, in time about linear in its length and its detections. Columns of docs stay; the names _s and
    detections are taken over.
    """
    table_ = F.from_json(F.lit(json.dumps(rules())), WHOLE)
    s = F.when(F.coalesce("text", F.lit("")).rlike(gate()), normalised(F.col("text")))
    out = docs.drop("_s", "detections").withColumn("_s", s)
    live = F.filter(table_, lambda r: F.contains(F.col("_s"), r["keyword"]))
    out = out.withColumn("detections", F.when(F.col("_s").isNotNull(), F.flatten(F.transform(live, lambda r: found_by(F.col("_s"), r)))))
    return out.withColumn("detections", F.when(F.size("detections") > 0, strongest(F.col("detections"))).otherwise(F.col("detections")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s, text = F.col("_s"), F.coalesce("text", F.lit(""))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        padded = f" {phrase} "
        at, back = F.instr(s, padded), F.instr(F.reverse(s), padded[::-1])
        n = F.when(at > 0, F.size(F.split(s, f" {phrase}(?= )", -1)) - 1).otherwise(0)
        counts.append(n)
        firsts.append(F.when(at > 0, spaces(F.substring(s, F.lit(1), at)) - 1))
        lasts.append(F.when(at > 0, spaces(F.substring(s, F.lit(1), F.length(s) - back - len(padded) + 2)) - 1))
        labels.append(F.when(at > 0, F.lit(label)))
    total = counts[0] + counts[1] + counts[2] + counts[3]
    out = found.withColumn("_b", F.array_sort(F.array_compact(F.array(*labels))))
    more = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.size("_b") > 0, F.lit(0.8)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id",
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_words"),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join("_b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_b", more))), ",").alias("labels"),
        score.alias("score"),
        F.transform(F.coalesce("detections", F.array().cast(DETECTIONS)), lambda d: F.concat_ws(":", d["label"], spaces(F.substring(s, F.lit(1), d["start"] + 1)) - 1)).alias("places"),
    )

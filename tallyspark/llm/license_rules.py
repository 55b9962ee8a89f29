"""The ordered rules of the license scan.

Patterns match a text's words (A-Z in lower case, everything between them one
space), so ``gpl-2.0`` is ``gpl 2 0``.  Order is priority: the base phrases,
then what names a license exactly (identifier tags, addresses, whole titles),
then sentences of the license texts, then short mentions.  Every rule names
words of which a text must hold one for the pattern to be tried at all.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    label: str
    strength: float
    keywords: frozenset[str]
    pattern: re.Pattern
    base: bool


#: (phrase, label): always reported, at every place where its words stand
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: identifiers of which a tag rule, a "license: X" rule and a "X license" rule
#: are made; the label is the identifier
IDENTIFIERS = """
0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 artistic-1.0 artistic-2.0 bittorrent-1.1
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0 cc-by-2.0
cc-by-3.0 cc-by-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cddl-1.0 cddl-1.1
cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1
eupl-1.2 fdl-1.2 fdl-1.3 ftl gpl-1.0 gpl-2.0 gpl-3.0 hpnd ijg intel ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0
libpng-2.0 lppl-1.3c miros mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa ngpl nposl-3.0 odbl-1.0
odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 qpl-1.0
rpl-1.5 sissl sleepycat sspl-1.0 tcl unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 xfree86-1.1 zlib zpl-2.1
""".split()

#: (label, words to look for, patterns): addresses of license texts
ADDRESSES = [
    ("apache-2", "apache", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache org licenses license 1 1"),
    ("mit", "opensource mit", r"opensource org licenses mit(?: license)?(?: php| html)?"),
    ("bsd-2-clause", "opensource", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses bsd 3 clause"),
    ("bsd", "opensource", r"opensource org licenses bsd license(?: php)?"),
    ("isc", "opensource isc", r"opensource org licenses isc(?: license)?"),
    ("artistic-2.0", "opensource", r"opensource org licenses artistic license 2 0"),
    ("osl-3.0", "opensource", r"opensource org licenses osl 3 0(?: php)?"),
    ("afl-3.0", "opensource", r"opensource org licenses afl 3 0(?: php)?"),
    ("ms-pl", "opensource", r"opensource org licenses ms pl"),
    ("zlib", "opensource", r"opensource org licenses zlib(?: license)?"),
    ("ncsa", "opensource", r"opensource org licenses ncsa"),
    ("upl-1.0", "opensource", r"opensource org licenses upl"),
    ("agpl-3.0", "gnu fsf", r"(?:gnu|fsf) org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?"),
    ("lgpl-2.1", "gnu fsf", r"(?:gnu|fsf) org licenses old licenses lgpl 2 1(?: en)?(?: html| txt)?"),
    ("lgpl-3.0", "gnu fsf", r"(?:gnu|fsf) org licenses lgpl(?: 3 0)?(?: en)?(?: html| txt)?"),
    ("gpl-2.0", "gnu fsf", r"(?:gnu|fsf) org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?"),
    ("gpl-3.0", "gnu fsf", r"(?:gnu|fsf) org licenses gpl 3 0(?: en)?(?: html| txt)?"),
    ("gpl", "gnu fsf", r"(?:gnu|fsf) org (?:licenses|copyleft) gpl(?: en)?(?: html| txt)?"),
    ("fdl-1.3", "gnu fsf", r"(?:gnu|fsf) org licenses fdl(?: 1 3)?(?: en)?(?: html| txt)?"),
    ("mpl-2.0", "mozilla", r"mozilla org (?:en us )?mpl 2 0(?: index txt)?"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("mpl", "mozilla", r"mozilla org mpl"),
    ("epl-2.0", "eclipse", r"eclipse org (?:legal|org documents) epl (?:2 0|v20)(?: html)?"),
    ("epl-1.0", "eclipse", r"eclipse org (?:legal|org documents) epl v10(?: html)?"),
    ("bsl-1.0", "boost", r"boost org license 1 0(?: txt)?"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0(?: legalcode| deed)?"),
    ("public-domain-mark", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] \d)?(?: legalcode| deed)?"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net(?: txt copying)?|sam zoy org wtfpl"),
    ("ofl-1.1", "sil ofl", r"scripts sil org ofl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("eupl-1.2", "joinup eupl", r"joinup ec europa eu \S+ \S+ eupl \S+"),
    ("cecill-2.1", "cecill", r"cecill info licences(?: licence cecill v2(?: 1)?)?"),
    ("php-3.01", "php", r"php net license 3 01(?: txt)?"),
    ("postgresql", "postgresql", r"postgresql org about licen[cs]e"),
    ("psf-2.0", "python", r"docs python org 3 license(?: html)?"),
    ("w3c", "w3", r"w3 org consortium legal (?:2002 )?copyright software(?: 20021231| 2015)?"),
    ("elastic-2.0", "elastic", r"elastic co licensing elastic license"),
    ("sspl-1.0", "mongodb", r"mongodb com licensing server side public license"),
    ("blueoak-1.0.0", "blueoakcouncil", r"blueoakcouncil org license 1 0 0"),
]

#: (label, words to look for, pattern): whole titles
TITLES = [
    ("agpl-3.0", "affero agpl agpl3 agplv3", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: (?:as published by the free software foundation|agpl))*(?: either)? (?:version |v)?3(?: 0)?(?: or(?: at your option)? (?:any )?later(?: version)?| only)?|(?:gnu )?agplv?3(?: or later)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (?:version |v)1"),
    ("agpl", "affero agpl", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version |v)?2(?: 0)?"),
    ("lgpl-2.1", "lesser lgpl lgplv2", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: (?:as published by the free software foundation|lgpl))*(?: either)? (?:version |v)?2 1(?: or later| only)?|lgplv2 1"),
    ("lgpl-3.0", "lesser lgpl lgplv3", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: (?:as published by the free software foundation|lgpl))*(?: either)? (?:version |v)?3(?: 0)?(?: or later| only)?|lgplv3"),
    ("lgpl", "lesser library lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl"),
    ("fdl-1.1", "documentation", r"gnu free documentation licen[cs]e (?:version |v)?1 1"),
    ("fdl-1.2", "documentation", r"gnu free documentation licen[cs]e (?:version |v)?1 2"),
    ("fdl-1.3", "documentation", r"gnu free documentation licen[cs]e (?:version |v)?1 3"),
    ("fdl", "documentation gfdl", r"gnu free documentation licen[cs]e|gfdl"),
    ("gpl-1.0", "general gplv1", r"gnu general public licen[cs]e(?: gpl)? (?:version |v)1(?: 0)?|gplv1"),
    ("gpl-2.0", "general gpl gplv2", r"(?:(?:gnu )?general public licen[cs]e|gnu gpl|gpl)(?: (?:as published by the free software foundation|gnu gpl|gpl))*(?: either)? (?:version |v)?2(?: 0)?(?: or(?: at your option)? (?:any )?later(?: version)?| only)?|gplv2(?: or later)?"),
    ("gpl-3.0", "general gpl gplv3", r"(?:(?:gnu )?general public licen[cs]e|gnu gpl|gpl)(?: (?:as published by the free software foundation|gnu gpl|gpl))*(?: either)? (?:version |v)?3(?: 0)?(?: or(?: at your option)? (?:any )?later(?: version)?| only)?|gplv3(?: or later)?"),
    ("gpl", "general gnu gpl", r"gnu general public licen[cs]e|gnu gpl|gnu public licen[cs]e"),
    ("apache-2", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?1 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("mit", "mit expat", r"(?:the )?mit(?: expat| x11)? licen[cs]e|expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-1-clause", "bsd", r"bsd (?:1|one) clause(?: licen[cs]e)?|(?:1|one) clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd freebsd", r"(?:simplified )?bsd (?:2|two) clause(?: simplified)?(?: licen[cs]e)?|(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: new| revised)*(?: licen[cs]e)?|(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", r"bsd (?:4|four) clause(?: licen[cs]e)?|(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e"),
    ("0bsd", "zero 0bsd", r"(?:bsd )?zero clause(?: bsd)? licen[cs]e|0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.0", "mozilla mpl", r"(?:mozilla public licen[cs]e|mpl)(?: mpl)? (?:version |v)?1 0"),
    ("mpl-1.1", "mozilla mpl", r"(?:mozilla public licen[cs]e|mpl)(?: mpl)? (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla mpl", r"(?:mozilla public licen[cs]e|mpl)(?: mpl)? (?:version |v ?)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: (?:version |v)?1 1)?"),
    ("epl-1.0", "eclipse epl", r"(?:eclipse public licen[cs]e|epl) (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse epl", r"(?:eclipse public licen[cs]e|epl) (?:version |v ?)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("cddl-1.1", "cddl development", r"(?:common development and distribution licen[cs]e|cddl)(?: cddl)? (?:version |v ?)?1 1"),
    ("cddl-1.0", "cddl development", r"(?:common development and distribution licen[cs]e|cddl)(?: cddl)?(?: (?:version |v ?)?1 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: (?:version |v ?)?1 1)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng-2.0", "libpng png", r"libpng licen[cs]e|png reference library licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e (?:version |v ?)?3 01"),
    ("php-3.0", "php", r"php licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("psf-2.0", "python psf", r"python software foundation licen[cs]e(?: (?:version |v ?)?2)?|psf licen[cs]e"),
    ("python", "python", r"python licen[cs]e"),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa illinois", r"university of illinois(?: ncsa)?(?: open source)? licen[cs]e|ncsa open source licen[cs]e"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "fuck wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 1)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?: (?:version |v ?)?1 3c?)?"),
    ("eupl-1.1", "eupl european", r"(?:european union public licen[cs]e|eupl)(?: eupl)? (?:version |v ?)?1 1"),
    ("eupl-1.2", "eupl european", r"(?:european union public licen[cs]e|eupl)(?: eupl)?(?: (?:version |v ?)?1 2)?"),
    ("cecill-b", "cecill", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill", r"cecill c(?: licen[cs]e)?"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?|licence cecill"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: (?:version |v ?)?3 0)?"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: (?:version |v ?)?3 0)?"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: (?:version |v ?)?2 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("ms-eula", "microsoft", r"microsoft software licen[cs]e terms"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: upl)?(?: (?:version |v ?)?1 0)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e"),
    ("sspl-1.0", "sspl server", r"server side public licen[cs]e(?: (?:version |v ?)?1)?|sspl"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("commons-clause", "commons", r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("mulanpsl-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?"),
    ("blueoak-1.0.0", "blue", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("qpl-1.0", "public", r"q public licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:version |v ?)?2 1)?"),
    ("tcl", "tcl", r"tcl tk licen[cs]e"),
    ("ijg", "jpeg", r"independent jpeg group s? ?licen[cs]e"),
    ("ftl", "freetype", r"freetype (?:project )?licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("json", "json", r"json licen[cs]e"),
    ("beerware", "beer beerware", r"beer ?ware licen[cs]e"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("odbl-1.0", "odbl open", r"open (?:data commons open )?database licen[cs]e|odbl"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e"),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("etalab-2.0", "etalab licence", r"licence ouverte(?: open licence)?(?: (?:version |v ?)?2 0)?|etalab"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland(?: namensnennung)?(?: (?:version |v ?)?2 0)?"),
    ("openrail", "rail openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?"),
    ("llama-community", "llama", r"llama \d(?: \d)? community licen[cs]e(?: agreement)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] \d)?(?: \S+)?(?: licen[cs]e)?"),
    ("cc0-1.0", "creative cc0", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?|cc0(?: 1 0)?(?: universal)?"),
    ("cc", "creative", r"creative commons(?: public)? licen[cs]e"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] \d)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] \d)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] \d)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] \d)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] \d)?"),
]

#: (label, words to look for, pattern): telling sentences of the texts
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"neither the name(?:s)? of (?:\S+ ){1,12}(?:nor the names of \S+ contributors )?may be used to endorse or promote products"),
    ("apache-2", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)?(?: www)? apache"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("gpl", "gnu", r"see the gnu general public licen[cs]e for more details"),
    ("lgpl", "lesser", r"see the gnu lesser general public licen[cs]e for more details"),
    ("agpl", "affero", r"see the gnu affero general public licen[cs]e for more details"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("artistic-1.0", "artistic", r"under the same terms as perl itself or the artistic licen[cs]e"),
    ("cc-by", "creative", r"this work is licensed under a creative commons attribution"),
    ("cc0-1.0", "waived", r"to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", r"(?:this (?:work|file|code|software|program) (?:is|has been)|(?:dedicated|released|placed)) (?:\S+ ){0,3}(?:to|in|into) the public domain"),
    ("public-domain", "gemeinfrei", r"(?:ist|sind) gemeinfrei"),
    ("public-domain", "domaine", r"(?:est|sont) dans le domaine public"),
    ("public-domain", "dominio", r"(?:es|son|está|están) de dominio público"),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("non-commercial", "commercial noncommercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "commercial", r"not for commercial use|may not be used for commercial purposes"),
    ("evaluation", "evaluation", r"for evaluation purposes only|evaluation licen[cs]e agreement"),
    ("academic", "academic", r"for academic(?: and research)? (?:use|purposes) only|academic use licen[cs]e"),
    ("shareware", "shareware", r"this (?:program|software) is shareware"),
    ("freeware", "freeware", r"this (?:program|software) is freeware|freeware licen[cs]e"),
    ("commercial", "commercial", r"(?:under a|requires a|with a) commercial licen[cs]e"),
    ("dual-license", "dual", r"dual licensed under|available under a dual licen[cs]e"),
]

#: what makes a short mention the start of a title, of which it says less
LATER = r" (?:public |software |x11 |expat )?(?:licen[cs]e|version|v?\d)"

#: (label, words to look for, pattern): short mentions
MENTIONS = [
    ("gpl", "gpl gpled", r"(?:under|the) (?:the )?gpl(?!{LATER})|gpl ?ed|gpl licensed"),
    ("lgpl", "lgpl", r"under (?:the )?lgpl(?!{LATER})|lgpl licensed"),
    ("agpl", "agpl", r"under (?:the )?agpl(?!{LATER})|agpl licensed"),
    ("mit", "mit", r"mit licensed|licensed under mit|licen[cs]e mit|under the mit(?!{LATER})"),
    ("bsd", "bsd", r"bsd licensed|licensed under bsd|under (?:the )?bsd(?!{LATER})"),
    ("apache", "apache", r"apache licensed|licensed under apache|under (?:the )?apache(?!{LATER})"),
    ("apache-2", "apache asl2", r"apache 2(?: 0)?(?: licen[cs]ed?)?|asl2"),
    ("mpl", "mpl", r"mpl licensed|under (?:the )?mpl(?!{LATER})"),
    ("epl", "epl", r"under (?:the )?epl(?!{LATER})"),
    ("wtfpl", "wtfpl", r"under (?:the )?wtfpl(?!{LATER})"),
    ("mit", "lizenz", r"mit lizenz"),
    ("gpl", "licence licencia gpl", r"licence gpl|licence publique générale gnu|licencia pública general(?: de)? gnu"),
    ("cc", "creative licencia", r"licen(?:ce|cia) creative commons|creative commons lizenz"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("all-rights-reserved", "vorbehalten", r"alle rechte vorbehalten"),
    ("all-rights-reserved", "réservés", r"tous droits réservés"),
    ("all-rights-reserved", "reservados", r"todos los derechos reservados"),
]


def rules() -> list[Rule]:
    """All rules in their order."""
    out: list[Rule] = []

    def add(label, strength, keywords, pattern, base=False):
        # encoded, so that letters beyond ASCII are bytes of a word
        out.append(Rule(len(out), label, strength, frozenset(keywords.split()),
                        re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"), base))

    for phrase, label in BASE:
        add(label, 1.0, phrase.split()[-2] if label == "mit" else phrase.split()[0], phrase, True)
    for name in IDENTIFIERS:
        own = re.sub(r"[-.]", " ", name)
        add(name, 1.0, "spdx", f"spdx license identifier {own}(?: or later| only)?")
    for label, keywords, pattern in ADDRESSES:
        add(label, 0.95, keywords, pattern)
    for name in IDENTIFIERS:
        own = re.sub(r"[-.]", " ", name)
        add(name, 0.9, own.split()[0], f"licen[cs]e(?: name| id| type)? {own}|{own} licen[cs]e")
    for label, keywords, pattern in TITLES:
        add(label, 0.9, keywords, pattern)
    for label, keywords, pattern in SENTENCES:
        add(label, 0.8, keywords, pattern)
    for label, keywords, pattern in MENTIONS:
        add(label, 0.5, keywords, pattern.replace("{LATER}", LATER))
    return out

"""License scans: ordered signature rules over the words of a text, all in built-in functions.

A text is first passed through a keyword test, which most texts fail at once. What passes is lower-cased (A to
Z), cut into words, and joined again by single spaces, so that rules see words only. Each rule has a keyword,
which stands in every match of its regular expression, and only rules whose keyword stands in the text run theirs. A rule has a priority;
a detection that lies inside the interval of another whose priority is as good or better is suppressed, so that a name
inside a full title, or a hint inside a name, gives no label of its own. Rules of what speaks against a license have no label:
they hide what they contain.

The base phrases are looked for word by word at every place, apart from the rules; nothing suppresses them.

Everything happens within the row: no shuffle, no join, and nothing that grows with other documents.

Defined cases: null and empty texts have no words, no labels and score 0; equal rows give equal rows; very long texts are scanned whole; an empty table
gives an empty table; columns other than the text pass through, but for those of a result's name in any spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import free_names

#: What separates words, and the base phrases with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, a word or words that every form of the name has, the name's forms, and its short identifier's words.
NAMES = [
    ("mit", "mit", r"mit(?: x11)? licen[cs]e|mit licen[cs]ed", "mit"),
    ("apache-2", "apache", r"apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 1", "apache 1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 0", "apache 1 0"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:v|version))? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:v|version))? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-1", "general public", r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:v|version))? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "gpl"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: (?:v|version))? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: (?:v|version))? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", "library", r"(?:gnu )?library general public licen[cs]e(?: (?:v|version))? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:v|version))? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", "gfdl"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause licen[cs]e|(?:2|two) clause bsd licen[cs]e|simplified bsd licen[cs]e|freebsd licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause licen[cs]e|(?:3|three) clause bsd licen[cs]e|(?:new|modified|revised) bsd licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause licen[cs]e|(?:4|four) clause bsd licen[cs]e|original bsd licen[cs]e", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd licen[cs]e|bsd zero clause licen[cs]e", "0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:v|version))? ?2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: (?:v|version))? ?1 1", "mpl 1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "mpl"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: (?:v|version))? ?2(?: 0)?", "epl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: (?:v|version))? ?1(?: 0)?", "epl 1 0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: version)? 1 2", "eupl 1 2"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: version)?(?: 1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense license", "unlicense"),
    ("wtfpl", "public licen", r"do what the f\w* you want to public licen[cs]e", "wtfpl"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic licen[cs]e", "artistic 1 0"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: version)?(?: 1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: version)?(?: 1 0)?", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", "pddl 1 0"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("python-2.0", "python", r"python(?: software foundation)? licen[cs]e(?: version 2)?", "python 2 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: version)?(?: 3 01)?", "php 3 01"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: version)?(?: 3 0)?", "afl 3 0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: version)?(?: 3 0)?", "osl 3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: version)?(?: 1 0)?", "upl 1 0"),
    ("mulan-psl-2", "mulan", r"mulan permissive software licen[cs]e(?: version)?(?: 2)?", "mulanpsl 2 0"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsl-1.1", "business source", r"business source licen[cs]e(?: version)?(?: 1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: version)?(?: 1(?: 0)?)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)?(?: 2 0)?", "elastic 2 0"),
    ("qpl-1.0", "public licen", r"q public licen[cs]e(?: version)?(?: 1 0)?", "qpl 1 0"),
    ("vim", "vim", r"vim licen[cs]e", "vim"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("x11", "x11", r"x11 licen[cs]e", "x11"),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e", "ruby"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[cs]e", "w3c"),
    ("unicode-dfs", "unicode", r"unicode(?: data files)? licen[cs]e", "unicode dfs 2016"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?", "cc by nc nd [1-4] 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] 0)?", "cc by nc [1-4] 0"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?", "cc by nd [1-4] 0"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?", "cc by sa [1-4] 0"),
    ("cc-by", "cc", r"cc by(?: [1-4] 0)?", "cc by [1-4] 0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?derivatives(?: [1-4] 0)?", "cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?", "cc by nc sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?", "cc by nc"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?derivatives(?: [1-4] 0)?", "cc by nd"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?", "cc by sa"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] 0)?", "cc by"),
]

#: Rules of notices, license texts, headers, exceptions and terms, each written for what it finds: keyword, expression over words
#: joined by single spaces, label ("" speaks against a license: it gives none and hides what it contains), priority, weight.
NOTICES = [
    # permissive license texts
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 2, 0.95),
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 3, 0.9),
    ("without restriction", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "mit", 2, 0.95),
    ("above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 3, 0.85),
    ("except as contained", r"except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,8} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "x11", 2, 0.9),
    ("without written agreement", r"permission is hereby granted without written agreement and without license or royalty fees", "mit-modern-variant", 2, 0.8),
    ("permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided", "isc", 2, 0.95),
    ("permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", "0bsd", 2, 0.9),
    ("permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee|with or without fee) is hereby granted", "hpnd", 2, 0.9),
    ("permission to use copy", r"permission to use copy modify distribute and sell this software and its documentation for any purpose", "hpnd-sell-variant", 2, 0.9),
    ("permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "postgresql", 1, 0.95),
    ("permission to use copy", r"permission to use copy(?: [^ ]+){1,6} this software", "permissive", 4, 0.5),
    ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 2, 0.9),
    ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?! provided)", "bsd", 3, 0.8),
    ("redistributions of source code", r"redistributions of source code must retain the(?: above)? copyright notice", "bsd", 3, 0.8),
    ("redistributions in binary form", r"redistributions in binary form must reproduce the(?: above)? copyright notice", "bsd", 3, 0.8),
    ("neither the name", r"neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|the|their) contributors may be used to endorse", "bsd-3-clause", 2, 0.95),
    ("neither the name", r"neither the names? of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors", "bsd-3-clause", 3, 0.9),
    ("all advertising materials", r"all advertising materials mentioning features or use of this software must display", "bsd-4-clause", 2, 0.95),
    ("software is provided by the copyright", r"this software is provided by the copyright holders and contributors as is", "bsd", 4, 0.6),
    ("regents and contributors", r"this software is provided by the regents and contributors as is", "bsd", 3, 0.8),
    ("nuclear facility", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "bsd-3-clause-no-nuclear-license", 1, 0.95),
    ("this software is provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 2, 0.95),
    ("origin of this software", r"the origin of this software must not be misrepresented", "zlib", 2, 0.9),
    ("altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib", 3, 0.8),
    ("person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "boost-1.0", 2, 0.95),
    ("boost", r"distributed under the boost software license version 1 0", "boost-1.0", 2, 0.95),
    ("beer ware", r"the beer ware license", "beerware", 2, 0.95),
    ("good not evil", r"the software shall be used for good not evil", "json", 1, 0.95),
    ("free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 2, 0.95),
    ("anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 3, 0.9),
    ("copyright interest", r"dedicate any and all copyright interest in the software to the public domain", "unlicense", 3, 0.85),
    ("university of illinois", r"university of illinois ncsa open source license", "ncsa", 2, 0.95),
    ("university of illinois", r"neither the names of [^ ]+(?: [^ ]+){0,6} university of illinois", "ncsa", 2, 0.8),
    ("curl", r"curl and libcurl are licensed under (?:a|an) mit(?: x)? derivate license", "curl", 2, 0.9),
    ("without royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "fsf-all-permissive", 2, 0.9),
    ("gives unlimited permission", r"the free software foundation gives unlimited permission to copy and or distribute it", "fsf-unlimited", 2, 0.9),
    ("open geospatial", r"open geospatial consortium inc all rights reserved", "ogc", 3, 0.6),
    ("docbook", r"permission to use copy modify and distribute the docbook(?: xml)? dtd", "docbook", 2, 0.9),
    ("sun microsystems", r"developed at sunpro a sun microsystems inc business permission to use copy modify and distribute", "sun-permissive", 2, 0.9),
    ("lucent", r"copyright c lucent technologies(?: [^ ]+){0,9} permission to use copy", "lucent-permissive", 2, 0.8),
    ("independent jpeg", r"this software is based in part on the work of the independent jpeg group", "ijg", 2, 0.95),
    ("freetype", r"portions of this software are copyright(?: [^ ]+){0,5} the freetype project", "ftl", 2, 0.95),
    ("info zip", r"this is version [^ ]+(?: [^ ]+){0,6} of the info zip (?:copyright and )?license", "info-zip", 2, 0.95),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode-dfs", 1, 0.95),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 2, 0.95),
    ("eric young", r"this product includes cryptographic software written by eric young", "openssl", 2, 0.95),
    ("apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation", "apache-1.1", 3, 0.7),
    ("university of california", r"this product includes software developed by the university of california berkeley", "bsd-4-clause", 2, 0.9),
    # Apache
    ("apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", 1, 1.0),
    ("may not use this file", r"you may not use this file except in compliance with the license", "apache-2", 4, 0.6),
    ("apache", r"you may obtain a copy of the license at (?:https?|www) (?:www )?apache org licenses license 2 0", "apache-2", 2, 1.0),
    ("apache org", r"apache org licenses license 2 0", "apache-2", 3, 0.95),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2", 2, 0.95),
    ("patent license", r"grant of patent license subject to the terms and conditions of this license", "apache-2", 3, 0.8),
    ("apache", r"apache license 2 0 with llvm exceptions", "apache-2-with-llvm-exception", 1, 0.95),
    ("apache", r"(?:dual )?licensed under (?:either )?(?:of )?(?:the )?apache (?:license )?(?:version )?2 0 (?:license )?(?:or|and) (?:the )?mit(?: license)?", "apache-2", 2, 0.95),
    ("mit", r"(?:dual )?licensed under (?:the )?(?:terms of )?(?:both )?(?:the )?mit (?:license )?(?:or|and) (?:the )?apache (?:license )?(?:version )?2 0", "mit", 2, 0.95),
    # GNU licenses
    ("free software", r"this (?:program|library|file|package|software|module) is free software you can redistribute it and or modify it under the (?:same )?terms (?:of|as)", "unknown-license", 5, 0.4),
    ("general public", r"under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "gpl-3-or-later", 1, 1.0),
    ("general public", r"under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version", "gpl-2-or-later", 1, 1.0),
    ("general public", r"under the terms of the gnu general public license version 2 as published by the free software foundation", "gpl-2-only", 1, 1.0),
    ("general public", r"under the terms of version 2 of the gnu general public license", "gpl-2-only", 1, 0.95),
    ("general public", r"under the terms of the gnu general public license version 3 as published by the free software foundation", "gpl-3-only", 1, 1.0),
    ("general public", r"under the terms of version 3 of the gnu general public license", "gpl-3-only", 1, 0.95),
    ("lesser general public", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version", "lgpl-2.1-or-later", 1, 1.0),
    ("lesser general public", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "lgpl-3-or-later", 1, 1.0),
    ("lesser general public", r"under the terms of the gnu lesser general public license version (?:2 1|3) as published", "lgpl", 1, 0.95),
    ("library general public", r"under the terms of the gnu library general public license as published by the free software foundation either version 2", "lgpl-2", 1, 1.0),
    ("affero general public", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version", "agpl-3-or-later", 1, 1.0),
    ("affero general public", r"under the terms of the gnu affero general public license version 3 as published", "agpl-3-only", 1, 1.0),
    ("remote network interaction", r"remote network interaction use with the gnu general public license", "agpl-3", 2, 0.9),
    ("any later version", r"either version 3(?: of the license)? or at your option any later version", "gpl-3", 3, 0.7),
    ("any later version", r"either version 2(?: of the license)? or at your option any later version", "gpl-2", 3, 0.7),
    ("general public", r"you should have received a copy of the gnu general public license along with", "gpl", 4, 0.8),
    ("lesser general public", r"you should have received a copy of the gnu lesser general public license along with", "lgpl", 3, 0.8),
    ("affero general public", r"you should have received a copy of the gnu affero general public license along with", "agpl", 3, 0.8),
    ("library general public", r"you should have received a copy of the gnu library general public license along with", "lgpl-2", 3, 0.8),
    ("general public", r"gnu general public license version 3 29 june 2007", "gpl-3", 1, 1.0),
    ("general public", r"gnu general public license version 2 june 1991", "gpl-2", 1, 1.0),
    ("general public", r"gnu general public license version 1 february 1989", "gpl-1", 1, 1.0),
    ("lesser general public", r"gnu lesser general public license version 2 1 february 1999", "lgpl-2.1", 1, 1.0),
    ("lesser general public", r"gnu lesser general public license version 3 29 june 2007", "lgpl-3", 1, 1.0),
    ("affero general public", r"gnu affero general public license version 3 19 november 2007", "agpl-3", 1, 1.0),
    ("fifth floor", r"free software foundation inc 51 franklin (?:street|st) fifth floor boston", "gpl", 5, 0.5),
    ("temple place", r"free software foundation inc 59 temple place", "gpl", 5, 0.5),
    ("absolutely no warranty", r"[^ ]+ comes with absolutely no warranty(?: for details type show w)?", "gpl", 5, 0.4),
    ("no warranty", r"(?:comes with|there is) (?:absolutely )?no warranty", "unknown-license", 5, 0.3),
    ("without even the implied warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl", 5, 0.4),
    ("gpl", r"licensed under the (?:gnu )?gpl(?: v| version)? ?2(?: only)?(?! or)", "gpl-2", 2, 0.9),
    ("gpl", r"licensed under the (?:gnu )?gpl ?v?3(?: 0)?(?: or later| only)?", "gpl-3", 2, 0.95),
    ("gpl", r"licensed under the (?:gnu )?gpl ?v?2(?: 0)?(?: or later| only)?", "gpl-2", 2, 0.95),
    ("gpl", r"licensed under the (?:gnu )?lgpl ?v?3(?: 0)?(?: or later| only)?", "lgpl-3", 2, 0.95),
    ("gpl", r"licensed under the (?:gnu )?lgpl ?v?2(?: 1)?(?: or later| only)?", "lgpl-2.1", 2, 0.9),
    ("gpl", r"licensed under the (?:gnu )?agpl ?v?3(?: 0)?(?: or later| only)?", "agpl-3", 2, 0.95),
    ("gpl", r"(?:gplv3|gpl v3|gpl version 3) licen[cs]e", "gpl-3", 3, 0.85),
    ("gpl", r"(?:gplv2|gpl v2|gpl version 2) licen[cs]e", "gpl-2", 3, 0.85),
    # exceptions
    ("special exception", r"as a special exception(?: [^ ]+){0,20} (?:permission|you may) (?:to |create |use )?(?:link|a larger work|this file)", "with-linking-exception", 2, 0.8),
    ("classpath", r"classpath exception(?: 2 0)?", "classpath-exception-2.0", 3, 0.8),
    ("provided by oracle", r"provided by oracle in the license file that accompanied this code", "classpath-exception-2.0", 2, 0.95),
    ("gcc runtime library", r"gcc runtime library exception(?: version)? 3 1", "gcc-exception-3.1", 2, 0.95),
    ("autoconf", r"configuration script generated by autoconf you may include it under the same distribution terms", "autoconf-exception", 2, 0.95),
    ("libtool", r"program or library that is built using gnu libtool you may include this file under the same distribution terms", "libtool-exception", 2, 0.95),
    ("bison", r"you may create a larger work that contains part or all of the bison parser skeleton and distribute that work under terms of your choice", "bison-exception-2.2", 1, 0.95),
    ("font exception", r"(?:gpl )?font exception(?: 2 0)?", "font-exception-2.0", 3, 0.7),
    ("openssl", r"permission to link (?:the code of )?(?:this program|portions of this program)(?: [^ ]+){0,4} with the openssl (?:project )?library", "openssl-exception", 2, 0.9),
    ("llvm", r"llvm exceptions? to the apache 2 0 license", "apache-2-with-llvm-exception", 1, 0.95),
    ("linux syscall", r"spdx license identifier (?:[^ ]+ ){1,6}with linux syscall note", "linux-syscall-note", 1, 1.0),
    ("wxwindows", r"wxwindows library licen[cs]e(?: version 3)?", "wxwindows", 2, 0.95),
    ("qt company", r"the qt company (?:gpl|lgpl) exception version 1 1", "qt-lgpl-exception-1.1", 2, 0.95),
    ("u boot", r"u boot exception(?: 2 0)?", "u-boot-exception-2.0", 3, 0.8),
    ("universal foss", r"universal foss exception(?: version)?(?: 1 0)?", "universal-foss-exception-1.0", 2, 0.9),
    # copyleft of other families
    ("mozilla", r"this source code form is subject to the terms of the mozilla public license v ?2 0", "mpl-2.0", 1, 1.0),
    ("mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 1, 1.0),
    ("mozilla", r"incompatible with secondary licenses as defined by the mozilla public license", "mpl-2.0-no-copyleft-exception", 1, 0.95),
    ("netscape", r"the contents of this file are subject to the netscape public license version 1 [01]", "npl-1.1", 1, 1.0),
    ("eclipse", r"made available under the terms of the eclipse public license(?: v)? ?2 0", "epl-2.0", 1, 1.0),
    ("eclipse", r"made available under the terms of the eclipse public license v1 0", "epl-1.0", 1, 1.0),
    ("eclipse", r"eclipse distribution license(?: v| version)? ?1 0", "edl-1.0", 2, 0.95),
    ("common development", r"the contents of this file are subject to the terms of the common development and distribution license", "cddl-1.0", 1, 1.0),
    ("common public", r"this program and the accompanying materials are made available under the terms of the common public license", "cpl-1.0", 1, 1.0),
    ("eupl", r"licensed under the eupl(?: version)? 1 [0-2]", "eupl-1.2", 1, 1.0),
    ("cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)?(?: 2 [01])?", "cecill-2.1", 2, 0.9),
    ("cecill", r"governed by the cecill [bc] licen[cs]e under french law", "cecill-b", 1, 0.95),
    ("accompanied by information", r"redistributions in any form must be accompanied by information on how to obtain complete source code", "sleepycat", 1, 0.95),
    ("open software", r"licensed under the open software license version [123] [01]", "osl-3.0", 1, 0.95),
    ("academic free", r"licensed under the academic free license version [123] [01]", "afl-3.0", 1, 0.95),
    ("reciprocal public", r"reciprocal public licen[cs]e(?: version)?(?: 1 [15])?", "rpl-1.5", 2, 0.9),
    ("ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", "ipl-1.0", 2, 0.95),
    ("lucent public", r"lucent public licen[cs]e(?: version)?(?: 1 0[12]?)?", "lpl-1.02", 2, 0.95),
    ("sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?", "spl-1.0", 2, 0.95),
    ("sun industry", r"sun industry standards source licen[cs]e", "sissl", 2, 0.95),
    ("nokia open source", r"nokia open source licen[cs]e", "nokia", 2, 0.95),
    ("apple public", r"apple public source licen[cs]e(?: version)?(?: [12] [0-2])?", "apsl-2.0", 2, 0.95),
    ("realnetworks", r"realnetworks public source licen[cs]e", "rpsl-1.0", 2, 0.95),
    ("watcom", r"sybase open watcom public licen[cs]e", "watcom-1.0", 2, 0.95),
    ("vovida", r"vovida software licen[cs]e", "vsl-1.0", 2, 0.95),
    ("zope public", r"zope public licen[cs]e(?: version)?(?: [12] [01])?", "zpl-2.1", 2, 0.95),
    ("ricoh source", r"ricoh source code public licen[cs]e", "rscpl", 2, 0.95),
    ("intel open source", r"intel open source licen[cs]e", "intel", 2, 0.95),
    ("public domain", r"nist software(?: [^ ]+){0,12} public domain|is not subject to copyright protection and is in the public domain", "nist-pd", 2, 0.85),
    ("latex project", r"latex project public licen[cs]e(?: version)?(?: 1 3)?", "lppl-1.3c", 2, 0.95),
    ("perl", r"(?:free software|licensed|distributed)(?: [^ ]+){0,12} under the same terms as perl itself", "artistic-1.0-or-gpl-1", 1, 0.95),
    ("copyright holder", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder", "artistic-1.0", 2, 0.95),
    ("psf license", r"psf license agreement for python", "python-2.0", 2, 0.95),
    ("cnri", r"cnri (?:open source )?licen[cs]e(?: agreement)?", "cnri-python", 2, 0.9),
    ("php", r"this source file is subject to version 3 01 of the php license", "php-3.01", 1, 1.0),
    ("2 clause bsdl", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl see the file bsdl or the conditions below|this software is distributed under the 2 clause bsdl", "ruby", 2, 0.95),
    ("openldap", r"openldap public licen[cs]e(?: version)?(?: 2 8)?", "oldap-2.8", 2, 0.95),
    ("gust font", r"gust font (?:source )?licen[cs]e", "gust", 2, 0.95),
    ("ubuntu font", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", "ufl-1.0", 2, 0.95),
    ("open font", r"this font software is licensed under the sil open font license version 1 1", "ofl-1.1", 1, 1.0),
    ("cern open hardware", r"cern open hardware licen[cs]e(?: version)?(?: [12](?: [0-2])?)?(?: (?:strongly|weakly) reciprocal| permissive)?", "cern-ohl-2.0", 2, 0.95),
    ("solderpad", r"solderpad hardware licen[cs]e(?: version)?(?: [02] [015]1?)?", "shl-2.1", 2, 0.95),
    ("tapr open hardware", r"tapr open hardware licen[cs]e", "tapr-ohl-1.0", 2, 0.95),
    # content and data
    ("creative commons", r"this work is licensed under a creative commons attribution (?:4 0 )?international(?: 4 0)? license", "cc-by", 1, 0.95),
    ("creative commons", r"this work is licensed under a creative commons attribution share ?alike (?:4 0 )?international", "cc-by-sa", 1, 0.95),
    ("creative commons", r"this work is licensed under a creative commons attribution non ?commercial (?:4 0 )?international", "cc-by-nc", 1, 0.95),
    ("creative commons", r"text is available under the creative commons attribution share ?alike license", "cc-by-sa", 1, 0.95),
    ("creativecommons", r"creativecommons org licenses by sa [1-4] 0", "cc-by-sa", 2, 1.0),
    ("creativecommons", r"creativecommons org licenses by nc sa [1-4] 0", "cc-by-nc-sa", 2, 1.0),
    ("creativecommons", r"creativecommons org licenses by nc nd [1-4] 0", "cc-by-nc-nd", 2, 1.0),
    ("creativecommons", r"creativecommons org licenses by nc [1-4] 0", "cc-by-nc", 2, 1.0),
    ("creativecommons", r"creativecommons org licenses by nd [1-4] 0", "cc-by-nd", 2, 1.0),
    ("creativecommons", r"creativecommons org licenses by [1-4] 0", "cc-by", 2, 1.0),
    ("creativecommons", r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 2, 1.0),
    ("creativecommons", r"creativecommons org publicdomain mark 1 0", "public-domain", 2, 0.95),
    ("waived all copyright", r"has waived all copyright and related or neighboring rights to", "cc0-1.0", 2, 0.95),
    ("to the extent possible", r"to the extent possible under law(?: [^ ]+){1,12} waived all copyright", "cc0-1.0", 2, 0.95),
    ("free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 2, 0.95),
    ("invariant sections", r"with no invariant sections no front cover texts and no back cover texts a copy of the license", "gfdl-no-invariants", 3, 0.85),
    ("open government", r"open government licen[cs]e(?: v| version)? ?(?:[123](?: 0)?)?", "ogl-uk", 2, 0.95),
    ("licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", "etalab-2.0", 2, 0.9),
    ("community data license", r"community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?", "cdla", 2, 0.95),
    ("open database", r"made available under the open database license", "odbl-1.0", 1, 0.95),
    ("openstreetmap", r"openstreetmap contributors(?: [^ ]+){0,6} (?:odbl|open database licen[cs]e)", "odbl-1.0", 2, 0.95),
    ("free art", r"free art licen[cs]e(?: 1 3)?", "fal-1.3", 2, 0.95),
    ("open game", r"open game licen[cs]e(?: version)?(?: 1 0a?)?", "ogl-1.0a", 2, 0.95),
    ("project gutenberg", r"under the terms of the project gutenberg licen[cs]e included with this (?:ebook|work)", "gutenberg", 1, 0.95),
    # model and source-available licenses
    ("rail", r"(?:creativeml|bigscience|bigcode)(?: [^ ]+){0,2} open ?rail(?: m)? licen[cs]e", "openrail", 2, 0.9),
    ("licen", r"responsible ai licen[cs]e|open rail licen[cs]e", "openrail", 3, 0.85),
    ("community license", r"llama(?: [0-9](?: [0-9])?)? community license(?: agreement)?", "llama-community", 2, 0.95),
    ("gemma terms", r"gemma terms of use licen[cs]e", "gemma", 2, 0.9),
    ("licensor hereby grants", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "bsl-1.1", 2, 0.95),
    ("change date", r"change date(?: [^ ]+){1,6} change license", "bsl-1.1", 3, 0.8),
    ("hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", "elastic-2.0", 2, 0.95),
    ("commons clause", r"commons clause licen[cs]e condition(?: v| version)? ?(?:1 0)?", "commons-clause", 1, 0.95),
    ("polyform", r"polyform (?:noncommercial|small business|free trial|shield|strict|perimeter|internal use) licen[cs]e(?: 1 0 0)?", "polyform", 1, 0.95),
    ("functional source", r"functional source licen[cs]e(?: version)?(?: 1 [01])?", "fsl-1.1", 2, 0.95),
    ("confluent community", r"confluent community licen[cs]e(?: agreement)?(?: version)?(?: 1 0)?", "confluent-1.0", 2, 0.95),
    ("timescale licen", r"timescale licen[cs]e(?: agreement)?", "tsl", 2, 0.95),
    ("hippocratic", r"hippocratic licen[cs]e(?: version)?(?: [123] [01])?", "hippocratic", 2, 0.95),
    ("anti 996", r"anti 996 licen[cs]e(?: version)?(?: 1 0)?", "anti-996", 2, 0.95),
    # proprietary terms
    ("all rights reserved", r"all rights reserved", "proprietary", 5, 0.5),
    ("not be reproduced", r"(?:may|must|shall) not be reproduced(?: [^ ]+){0,10} without (?:the )?(?:express )?(?:prior )?(?:written )?permission", "proprietary", 3, 0.8),
    ("confidential", r"proprietary and confidential|confidential and proprietary", "proprietary", 4, 0.6),
    ("prohibited", r"unauthori[sz]ed (?:copying|distribution)(?: [^ ]+){0,14} (?:is )?(?:strictly )?prohibited", "proprietary", 2, 0.9),
    ("contains", r"contains (?:trade secrets|confidential information)(?: [^ ]+){0,12} (?:licen[cs]e|permission)", "proprietary", 2, 0.85),
    ("end user licen", r"end user licen[cs]e agreement", "proprietary", 3, 0.85),
    ("eula", r"(?:subject to|accept) (?:the )?(?:terms of (?:the|this) )?eula(?: [^ ]+){0,6} licen[cs]e", "proprietary", 3, 0.8),
    ("transferable", r"(?:limited )?non ?exclusive non ?transferable(?: [^ ]+){0,4} licen[cs]e", "proprietary", 3, 0.75),
    ("reverse engineer", r"you (?:may|shall|must) not reverse engineer decompile or disassemble the software", "proprietary", 2, 0.9),
    ("evaluation purposes", r"licen[cs]ed? (?:solely )?for evaluation purposes only", "evaluation-only", 2, 0.9),
    ("use only", r"(?:free )?for (?:academic|research|educational) (?:and [^ ]+ )?use only(?: [^ ]+){0,6} licen[cs]e|licen[cs]ed? for (?:academic|research|educational) use only", "academic-only", 2, 0.85),
    ("commercial use", r"(?:not licen[cs]ed for commercial use|commercial use requires a (?:separate )?(?:commercial )?licen[cs]e)", "non-commercial", 2, 0.9),
    ("commercial licen", r"available under a commercial licen[cs]e", "commercial", 2, 0.85),
    ("use only", r"licen[cs]ed? for (?:personal|private) (?:and non ?commercial )?use only", "non-commercial", 2, 0.85),
    ("may be reproduced", r"no part of this (?:publication|work|book|document) may be reproduced", "proprietary", 2, 0.9),
    ("freeware", r"(?:this|the) (?:software|program) is freeware", "freeware", 3, 0.8),
    ("shareware", r"(?:this|the) (?:software|program) is shareware", "shareware", 3, 0.8),
    # public domain
    ("public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", "public-domain", 3, 0.85),
    ("public domain", r"(?:is|are) (?:hereby )?(?:in|into|to) the public domain", "public-domain", 3, 0.8),
    ("public domain", r"no copyright(?: [^ ]+){0,6} public domain", "public-domain", 3, 0.85),
    ("public domain", r"works? of the (?:united states|u s) government(?: [^ ]+){0,12} public domain", "public-domain-us-gov", 2, 0.9),
    ("public domain", r"public domain", "public-domain", 5, 0.5),
    # references
    (" file", r"(?:see|read|refer to) the (?:accompanying )?(?:licen[cs]e|copying|notice) file", "unknown-license", 5, 0.3),
    (" for ", r"(?:see|read) (?:licen[cs]e|copying)(?: txt| md)? for (?:details|more|the full)", "unknown-license", 5, 0.3),
    ("found in the licen", r"(?:that can|which can|can) be found in the licen[cs]e file", "bsd", 4, 0.5),
    ("licensed under", r"(?:dual )?licensed under the terms", "unknown-license", 5, 0.3),
    ("copying", r"see copying for details", "unknown-license", 5, 0.3),
    # what speaks against a license
    ("licen", r"(?:is|are|was|were) not (?:licensed|released|available|distributed) under(?: the| a| an)?(?: [^ ]+){1,5} licen[cs]e", "", 1, 0.0),
    ("not released", r"(?:is|are|was|were) not released under(?: the| a| an)?(?: [^ ]+){1,5} licen[cs]e", "", 1, 0.0),
    ("no longer", r"no longer (?:licensed|released|available|distributed) under(?: the| a| an)?(?: [^ ]+){1,5} licen[cs]e", "", 1, 0.0),
    ("incompatible with", r"incompatible with(?: the| a| an)?(?: [^ ]+){1,5} licen[cs]e", "", 1, 0.0),
    ("driving licen", r"driving licen[cs]e", "", 1, 0.0),
    ("driver s licen", r"driver s licen[cs]e", "", 1, 0.0),
    ("licen", r"(?:fishing|hunting|marriage|liquor|gun|pilot) licen[cs]e", "", 1, 0.0),
]

#: How a name is used: expression around it, priority, weight. {n}: the name's forms; {i}: the identifier's words.
USES = [
    (r"spdx license identifier {i}", "spdx", 1, 1.0),
    (r"(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|covered|made available|redistributed)(?: [^ ]+){{0,3}} (?:under|by|with)(?: the| a| an)?(?: terms (?:of|and conditions of) the)? (?:{n})", None, 2, 0.95),
    (r"(?:subject to|under|governed by|according to)(?: the| a| an)?(?: terms (?:of|and conditions of) the)? (?:{n})", None, 3, 0.9),
    (r"licen[cs]es? (?:is |are )?(?:{i})", "licen", 3, 0.85),
    (r"(?:{n})", None, 4, 0.7),
]

#: Further licenses of an SPDX expression.
LISTED = [(r"(?:or|and) {i}", "spdx license identifier", 2, 0.9)]

#: A lower-cased text without any of these has no detection: every rule and every base phrase needs one of them.
GATE = ("licen", "spdx", "public", "rights", "copying", "warranty", "confidential", "permission", "redistribution", "software", "cc0", "creative", "neither", "unencumbered", "reproduced", "copyright", "exception", "freeware", "shareware", "distribut", "openstreetmap")
#: Pairs of words for what has no such word: the short names of Creative Commons licenses, and two notices.
GATE_PAIRS = (("cc", "by"), ("later", "version"), ("notice", "file"))


def passes(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for first, second in GATE_PAIRS:
        found = found | (F.contains(low, F.lit(first)) & low.rlike(rf"{first}[\x00-\x2F\x3A-\x60\x7B-\x7F]+{second}"))
    for word in reversed(GATE):
        found = F.contains(low, F.lit(word)) | found
    return found


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(keyword, second keyword, expression, label, priority, weight) of every rule, in order of priority.

    What names a license or its identifier in one of several uses is written once for each name; all else is written as it is.
    """
    out = [(keyword, "", *rest) for keyword, *rest in NOTICES]
    for label, keyword, names, ident in NAMES:
        for form, own, priority, weight in [*USES, *LISTED]:
            # a form of its own keyword names the license by its identifier
            words = (ident.split(" ")[0], own) if own else (keyword, "")
            out.append((*words, form.format(n=names, i=ident), label, priority, weight))
    return sorted(out, key=lambda r: r[4])


_PRIORITIES = 5
_OPEN, _CLOSE = "\x01", "\x02"


def _count_words(text: Column) -> Column:
    """Parts between separators, without the empty ones at either end."""
    parts = F.split(text, NOT_WORD_ANY_CASE)
    return F.greatest(F.lit(0), F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int"))


def _places(words: Column, phrase: str) -> Column:
    """All places where the phrase's words stand consecutively, as (start, label)."""
    first, *rest = phrase.split(" ")
    label = F.lit(BASE[phrase])
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    whole = F.filter(starts, lambda i: F.forall(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(rest))), lambda x: F.coalesce(F.get(words, i + x["k"]) == x["w"], F.lit(False))))
    return F.transform(whole, lambda i: F.struct(i.alias("start"), label.alias("label")))


def _detections(joined: Column, rule: Column) -> Column:
    """(start, -last, priority, label, weight) of each match of a rule in the words joined by spaces, with a space at both ends."""
    marked = F.split(F.regexp_replace(joined, F.concat(F.lit("(?<= )(?:"), rule["expression"], F.lit(")(?= )")), F.lit(f"{_OPEN}$0{_CLOSE}")), " ")
    place = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
    pairs = F.arrays_zip(place(lambda w: w.startswith(_OPEN)).alias("start"), place(lambda w: w.endswith(_CLOSE)).alias("last"))
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), (-p["last"]).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))


def _candidates(joined: Column) -> Column:
    """The rules that may match: those of a keyword that stands in the text, if one of their expressions matches at all.

    For each keyword that is one literal expression, compiled once; only then are its rules run one by one.
    """
    groups: dict[tuple[str, str], list[tuple]] = {}
    for keyword, also, *rest in rules():
        groups.setdefault((keyword, also), []).append(tuple(rest))
    none = F.array().cast("array<struct<expression:string,label:string,priority:int,weight:double>>")
    found = []
    for (keyword, also), own in groups.items():
        table = F.array(*(F.struct(F.lit(e).alias("expression"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(w).alias("weight")) for e, label, p, w in own))
        test = F.contains(joined, F.lit(keyword))
        if also:
            test = test & F.contains(joined, F.lit(also))
        any_ = "(?<= )(?:" + "|".join(dict.fromkeys(e for e, *_ in own)) + ")(?= )"
        found.append(F.when(test & joined.rlike(any_), table).otherwise(none))
    return F.flatten(F.array(*found))


def _resolve(found: Column) -> Column:
    """Labels and highest weight of the detections that lie inside no other of at least their priority.

    In order of start, a detection is contained if an earlier one of such a priority ends at its end or later.
    """
    start = F.struct(*(F.lit(-1).alias(f"end{p}") for p in range(1, _PRIORITIES + 1)), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(acc: Column, d: Column) -> Column:
        reach = F.element_at(F.array(*(acc[f"end{p}"] for p in range(1, _PRIORITIES + 1))), d["priority"])
        free = reach < -d["back"]
        ends = [F.when(d["priority"] <= p, F.greatest(acc[f"end{p}"], -d["back"])).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in range(1, _PRIORITIES + 1)]
        return F.struct(*ends, F.when(free & (d["label"] != ""), F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(free, F.greatest(acc["weight"], d["weight"])).otherwise(acc["weight"]).alias("weight"))

    return F.aggregate(found, start, step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score, which replace columns of these names in any spelling."""
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != text.lower() and c.lower() not in added]
    raw, passed, joined, words, count, base, found = free_names(docs, "_text", "_pass", "_joined", "_words", "_count", "_base", "_found")
    gated = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(raw)).withColumn(passed, passes(F.col(raw)))
    lowered = F.translate(raw, UPPER, LOWER)
    cut = gated.withColumn(joined, F.when(F.col(passed), F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NOT_WORD, " ")), F.lit(" ")))).select(
        *kept, F.when(F.col(joined).isNull() | (F.col(joined) == "  "), F.array().cast("array<string>")).otherwise(F.split(F.trim(joined), " ")).alias(words), joined,
        F.when(~F.col(passed), _count_words(F.col(raw))).alias(count),
    )
    detected = F.array_sort(F.flatten(F.transform(_candidates(F.col(joined)), lambda r: _detections(F.col(joined), r))))
    places = F.concat(*(_places(F.col(words), phrase) for phrase in BASE))
    scanned = cut.select(*kept, F.coalesce(count, F.size(words)).cast("bigint").alias("n_words"), places.alias(base), F.when(F.col(joined).isNotNull(), _resolve(detected)).alias(found))
    starts, own = F.col(base)["start"], F.col(base)
    base_labels = F.array_sort(F.array_distinct(own["label"]))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col(found)["labels"], F.array().cast("array<string>"))))
    return scanned.select(
        *kept, "n_words", F.size(own).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.col(found)["weight"], F.lit(0.0)), F.when(F.size(own) > 0, F.lit(0.95)).otherwise(F.lit(0.0))).alias("score"),
    )

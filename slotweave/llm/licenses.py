"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A text that holds none of the gate's words is left after cheap searches for plain words; they are
what the rules themselves need, so the gate rejects no text that a rule matches. In the others
comment marks at line starts and white space, however long and also across lines, count as one
blank; every rule whose own keyword occurs is matched, and each match is an interval with a
priority. A match inside an interval of higher priority is suppressed; among equal priorities the
longer one stays, and of equal intervals the rule that comes first. Labels are those of the matches
that stay, plus the base labels, which are never suppressed.

Two rules read a list of names and give the labels of all of them: SPDX expressions, split at AND,
OR and WITH (an exception after WITH is no license), and short names after a grant.

Null texts count as empty: no words, no labels, score 0. Repeated rows give repeated results.
Texts of any length are scanned whole; the intervals of a text are sorted, not compared pairwise.
Other columns of the table are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import no_null_text, write_stage

# Label, one distinguishing word of the name, the name as a pattern.
FAMILIES = [
    ("mit", "mit", r"(?:the )?mit(?:[ /]x11)?"),
    ("mit-0", "mit", r"mit no attribution"),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)?(?: licen[sc]e)?,? ?(?:version |v)?2(?:\.0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: licen[sc]e)?,? ?(?:version |v)?1\.1"),
    ("gpl-2.0", "general public", r"(?:the )?(?:gnu )?general public licen[sc]e,? ?(?:version |v)?2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:the )?(?:gnu )?general public licen[sc]e,? ?(?:version |v)?3(?:\.0)?"),
    ("lgpl-2.1", "lesser", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e,? ?(?:version |v)?2(?:\.1)?"),
    ("lgpl-3.0", "lesser", r"(?:the )?(?:gnu )?lesser general public licen[sc]e,? ?(?:version |v)?3(?:\.0)?"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e,? ?(?:(?:version |v)?3(?:\.0)?)?"),
    ("gfdl-1.3", "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e,? ?(?:(?:version |v)?1\.[123])?"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:bsd[ -]3[ -]clause|3[ -]clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)"),
    ("0bsd", "bsd", r"(?:the )?(?:0bsd|zero[ -]clause bsd|bsd zero clause)"),
    ("isc", "isc", r"(?:the )?isc"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[sc]e,? ?(?:version |v)?1\.1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[sc]e,? ?(?:version |v)?2\.0"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[sc]e,? ?(?:version |v)?1\.0"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[sc]e,? ?(?:version |v)?2\.0"),
    ("cddl-1.0", "common development", r"(?:the )?common development and distribution licen[sc]e,? ?(?:(?:version |v)?1\.0)?"),
    ("cpl-1.0", "common public", r"(?:the )?common public licen[sc]e,? ?(?:(?:version |v)?1\.0)?"),
    ("eupl-1.2", "european union", r"(?:the )?european union public licen[sc]e,? ?(?:(?:version |v)?1\.2)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[sc]e,? ?(?:version |v)?2\.0"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic licen[sc]e,? ?(?:version |v)?1\.0"),
    ("bsl-1.0", "boost", r"(?:the )?boost software licen[sc]e,? ?(?:(?:version |v)?1\.0)?"),
    ("busl-1.1", "business source", r"(?:the )?business source licen[sc]e,? ?(?:(?:version |v)?1\.1)?"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want to public", r"do what the fuck you want to public licen[sc]e"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("python-2.0", "python", r"(?:the )?python software foundation licen[sc]e"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("php-3.01", "php", r"(?:the )?php licen[sc]e,? ?(?:(?:version |v)?3\.0?1)?"),
    ("ofl-1.1", "open font", r"(?:the )?(?:sil )?open font licen[sc]e,? ?(?:(?:version |v)?1\.1)?"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal"),
    ("osl-3.0", "open software", r"(?:the )?open software licen[sc]e,? ?(?:(?:version |v)?3\.0)?"),
    ("afl-3.0", "academic", r"(?:the )?academic free licen[sc]e,? ?(?:(?:version |v)?3\.0)?"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois/)?ncsa"),
    ("upl-1.0", "universal", r"(?:the )?universal permissive licen[sc]e,? ?(?:(?:version |v)?1\.0)?"),
    ("odbl-1.0", "database", r"(?:the )?open database licen[sc]e,? ?(?:(?:version |v)?1\.0)?"),
    ("pddl-1.0", "public domain dedication", r"(?:the )?(?:odc )?public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by-3.0", "cc", r"cc[ -]by[ -]3\.0"),
    ("cc-by-4.0", "cc", r"cc[ -]by[ -]4\.0"),
    ("cc-by-sa-3.0", "cc", r"cc[ -]by[ -]sa[ -]3\.0"),
    ("cc-by-sa-4.0", "cc", r"cc[ -]by[ -]sa[ -]4\.0"),
    ("cc-by-nc-3.0", "cc", r"cc[ -]by[ -]nc[ -]3\.0"),
    ("cc-by-nc-4.0", "cc", r"cc[ -]by[ -]nc[ -]4\.0"),
    ("cc-by-nd-4.0", "cc", r"cc[ -]by[ -]nd[ -]4\.0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc[ -]by[ -]nc[ -]sa[ -]4\.0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc[ -]by[ -]nc[ -]nd[ -]4\.0"),
    ("beerware", "beer", r"(?:the )?beer[- ]?ware"),
    ("ecl-2.0", "educational", r"(?:the )?educational community licen[sc]e,? ?(?:(?:version |v)?2\.0)?"),
    ("vim", "vim", r"(?:the )?vim"),
    ("x11", "x11", r"(?:the )?x11"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software notice and)?"),
    ("sspl-1.0", "server side", r"(?:the )?server side public licen[sc]e,? ?(?:(?:version |v)?1(?:\.0)?)?"),
    ("elastic-2.0", "elastic", r"(?:the )?elastic licen[sc]e,? ?(?:(?:version |v)?2\.0)?"),
    ("llama2", "llama", r"(?:the )?llama 2 community"),
    ("openrail-m", "openrail", r"(?:the )?(?:creativeml )?open ?rail[- ]?m"),
]

# The phrases that every text is searched for, and their labels.
BASE_PHRASES = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]

# Label, a phrase of the license's body that a match must hold, the body as a pattern.
BODIES = [
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.{0,600}?subject to the following conditions"),
    ("mit-0", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files(?:(?!subject to the following conditions).){0,600}?furnished to do so\. the software is provided"),
    ("ncsa", "to deal with the software without restriction", r"to deal with the software without restriction"),
    ("bsl-1.0", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ofl-1.1", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of the font software"),
    ("upl-1.0", "larger work", r"and/or hardware if one is included with the software \(?each a [\"'“]?larger works?"),
    ("isc", "with or without fee is hereby granted", r"permission to use, copy, modify,? (?:and/or|and) distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", "with or without fee is hereby granted", r"permission to use, copy, modify,? (?:and/or|and) distribute this software for any purpose with or without fee is hereby granted\."),
    ("postgresql", "without a written agreement is hereby granted", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("bsd-2-clause", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met(?:(?!redistribution and use in source and binary forms|all advertising materials mentioning).){0,1200}?neither the names? of "),
    ("bsd-4-clause", "all advertising materials mentioning features", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met(?:(?!redistribution and use in source and binary forms).){0,1200}?all advertising materials mentioning features or use of this software must display(?:(?!redistribution and use in source and binary forms).){0,600}?neither the names? of "),
    ("zlib", "held liable for any damages arising from the use of this software", r"this software is provided ['\u2018]as-is['\u2019], without any express or implied warranty\. in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("apache-2.0", "terms and conditions for use, reproduction, and distribution", r"terms and conditions for use, reproduction, and distribution 1\. definitions"),
    ("gpl-2.0", "terms of the gnu general public license as published", r"under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 2\b"),
    ("gpl-3.0", "terms of the gnu general public license as published", r"under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 3\b"),
    ("lgpl-2.1", "general public license as published", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation[;,] (?:either )?version 2(?:\.1)?\b"),
    ("lgpl-3.0", "general public license as published", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] (?:either )?version 3\b"),
    ("agpl-3.0", "general public license as published", r"under the terms of the gnu affero general public license as published by the free software foundation[;,] (?:either )?version 3\b"),
    ("gfdl-1.3", "terms of the gnu free documentation license", r"under the terms of the gnu free documentation license, version 1\.[123]"),
    ("mpl-2.0", "this source code form is subject to the terms of", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "changing it is allowed as long as the name is changed", r"copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("beerware", "you can do whatever you want with this stuff", r"as long as you retain this notice,? you can do whatever you want with this stuff"),
    ("gpl-2.0", "gnu general public license is intended to guarantee", r"the licenses for most software are designed to take away your freedom to share and change it\. by contrast, the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "the gnu general public license is a free, copyleft license", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", "the gnu affero general public license is a free, copyleft license", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-3.0", "gnu lesser general public license incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("epl-2.0", "terms of this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license(?:(?!the accompanying program is provided).){0,4000}?secondary license"),
    ("epl-1.0", "terms of this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "are made available under the terms of the eclipse public license v1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "are made available under the terms of the eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?)?2\.0"),
    ("mpl-1.1", "mozilla public license version", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation(?: \(https?://www\.apache\.org/?\))?"),
    ("openssl", "openssl project for use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "this product includes php", r"redistributions of any form whatsoever must retain the following acknowledgment: [\"'“]?this product includes php"),
    ("python-2.0", "python software foundation", r"this license agreement is between the python software foundation \(\"?psf\"?\),? and the individual or organization"),
    ("artistic-1.0", "semblance of artistic control", r"the copyright holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the package"),
    ("artistic-2.0", "some artistic control over the development", r"the copyright holder maintains some artistic control over the development of that package while still keeping the package available as open source and free software"),
    ("ms-rl", "this license governs use of the accompanying software", r"this license governs use of the accompanying software(?:(?!this license governs use).){0,6000}?reciprocal grants"),
    ("ms-pl", "this license governs use of the accompanying software", r"this license governs use of the accompanying software"),
    ("cc-by-4.0", "creative commons attribution 4.0 international", r"creative commons attribution 4\.0 international(?: public)? license"),
    ("cc-by-sa-4.0", "creative commons attribution-sharealike 4.0", r"creative commons attribution-sharealike 4\.0 international(?: public)? license"),
    ("cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0", r"creative commons attribution-noncommercial 4\.0 international(?: public)? license"),
    ("cc-by-nd-4.0", "creative commons attribution-noderivatives 4.0", r"creative commons attribution-noderivatives 4\.0 international(?: public)? license"),
    ("cc-by-nc-sa-4.0", "creative commons attribution-noncommercial-sharealike 4.0", r"creative commons attribution-noncommercial-sharealike 4\.0 international(?: public)? license"),
    ("cc-by-nc-nd-4.0", "creative commons attribution-noncommercial-noderivatives 4.0", r"creative commons attribution-noncommercial-noderivatives 4\.0 international(?: public)? license"),
    ("cc-by-3.0", "creative commons attribution 3.0", r"creative commons attribution 3\.0 (?:unported|[a-z ]{1,30}) license"),
    ("cc-by-sa-3.0", "creative commons attribution-sharealike 3.0", r"creative commons attribution-sharealike 3\.0 (?:unported|[a-z ]{1,30}) license"),
    ("sspl-1.0", "make the service source code available", r"you must make the service source code available via network download to everyone at no charge, under the terms of this license"),
    ("elastic-2.0", "provide the software to third parties as a hosted", r"you may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features"),
    ("busl-1.1", "the business source license", r"the business source license \(this document, or the [\"'“]?license[\"'”]?\) is not an open source license"),
    ("llama2", "llama 2 community license agreement", r"llama 2 community license agreement"),
    ("openrail-m", "use-based restrictions", r"use-based restrictions as referenced in paragraph 5"),
    ("x11", "x consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("w3c", "w3c software", r"by obtaining, using and/or copying this work, you \(the licensee\) agree that you have read, understood, and will comply with the following terms and conditions(?:(?!by obtaining, using).){0,2000}?w3c software"),
    ("cddl-1.0", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("osl-3.0", "licensed under the open software license", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "licensed under the academic free license", r"licensed under the academic free license version 3\.0"),
    ("eupl-1.2", "licensed under the eupl", r"licensed under the eupl,? (?:version |v\.? ?)?1\.2"),
    ("vim", "unmodified copies of vim", r"no restrictions on distributing unmodified copies of vim"),
    ("cc0-1.0", "copyright and related or neighboring rights to", r"to the extent possible under law, .{0,200}?waived all copyright and related or neighboring rights to"),
]

# Label, how the license is called in short after a grant.
SHORT_NAMES = [
    ("mit", r"mit(?:/x11)?"),
    ("x11", r"(?<!mit/)x11"),
    ("apache-2.0", r"(?:apache|asl|al)[ -]?(?:v|version )?2(?:\.0)?"),
    ("apache-1.1", r"apache[ -]?(?:v|version )?1\.1"),
    ("gpl-2.0", r"(?:gnu )?gpl[ -]?(?:v|version )?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-3.0", r"(?:gnu )?gpl[ -]?(?:v|version )?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", r"(?:gnu )?lgpl[ -]?(?:v|version )?2(?:\.1)?(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", r"(?:gnu )?lgpl[ -]?(?:v|version )?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("agpl-3.0", r"(?:gnu )?agpl[ -]?(?:v|version )?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gfdl-1.3", r"(?:gnu )?gfdl(?:[ -]?(?:v|version )?1\.3)?"),
    ("mpl-1.1", r"mpl[ -]?(?:v|version )?1\.1"),
    ("mpl-2.0", r"mpl[ -]?(?:v|version )?2(?:\.0)?"),
    ("epl-1.0", r"epl[ -]?(?:v|version )?1(?:\.0)?"),
    ("epl-2.0", r"epl[ -]?(?:v|version )?2(?:\.0)?"),
    ("cddl-1.0", r"cddl(?:[ -]?(?:v|version )?1(?:\.0)?)?"),
    ("cpl-1.0", r"cpl[ -]?(?:v|version )?1(?:\.0)?"),
    ("eupl-1.2", r"eupl(?:[ -]?(?:v|version )?1\.2)?"),
    ("bsd-2-clause", r"bsd[ -]2(?:[ -]clause)?|2[ -]clause bsd|simplified bsd"),
    ("bsd-3-clause", r"bsd[ -]3(?:[ -]clause)?|3[ -]clause bsd|(?:new|modified|revised) bsd"),
    ("bsd-4-clause", r"bsd[ -]4(?:[ -]clause)?|4[ -]clause bsd|original bsd"),
    ("0bsd", r"0bsd"),
    ("isc", r"isc"),
    ("zlib", r"zlib(?:/libpng)?"),
    ("bsl-1.0", r"bsl[ -]1\.0|boost"),
    ("busl-1.1", r"busl[ -]1\.1|bsl[ -]?1\.1"),
    ("artistic-2.0", r"artistic[ -]2(?:\.0)?"),
    ("artistic-1.0", r"artistic[ -]1(?:\.0)?"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl"),
    ("ofl-1.1", r"(?:sil )?ofl(?:[ -]?(?:v|version )?1\.1)?"),
    ("ms-pl", r"ms-pl"),
    ("ms-rl", r"ms-rl"),
    ("osl-3.0", r"osl[ -]?(?:v|version )?3(?:\.0)?"),
    ("afl-3.0", r"afl[ -]?(?:v|version )?3(?:\.0)?"),
    ("ncsa", r"ncsa"),
    ("upl-1.0", r"upl(?:[ -]1\.0)?"),
    ("odbl-1.0", r"odbl(?:[ -]1\.0)?"),
    ("postgresql", r"postgresql"),
    ("python-2.0", r"psf(?:-2\.0)?"),
    ("openssl", r"openssl"),
    ("cc0-1.0", r"cc0(?:[ -]1\.0)?"),
    ("cc-by-3.0", r"cc[ -]by[ -]3\.0"),
    ("cc-by-4.0", r"cc[ -]by[ -]4\.0"),
    ("cc-by-sa-3.0", r"cc[ -]by[ -]sa[ -]3\.0"),
    ("cc-by-sa-4.0", r"cc[ -]by[ -]sa[ -]4\.0"),
    ("cc-by-nc-3.0", r"cc[ -]by[ -]nc[ -]3\.0"),
    ("cc-by-nc-4.0", r"cc[ -]by[ -]nc[ -]4\.0"),
    ("cc-by-nd-4.0", r"cc[ -]by[ -]nd[ -]4\.0"),
    ("cc-by-nc-sa-4.0", r"cc[ -]by[ -]nc[ -]sa[ -]4\.0"),
    ("cc-by-nc-nd-4.0", r"cc[ -]by[ -]nc[ -]nd[ -]4\.0"),
    ("sspl-1.0", r"sspl(?:[ -]?(?:v|version )?1(?:\.0)?)?"),
    ("ecl-2.0", r"ecl[ -]2\.0"),
]

_VERBS = "licen[sc]ed|released|distributed|available|published|provided|covered"
_GRANT = rf"(?:{_VERBS})(?: only)? under(?: the terms(?: and conditions)? of)? "
# Words are of ASCII letters and digits and all that is not ASCII; said in two classes, which the engine tests fastest.
_SEPARATOR = r"[^\p{Alnum}\P{ASCII}]"
_WORD = r"[\p{Alnum}\P{ASCII}]"
#: Line starts of commented text, and the blanks that white space becomes.
_COMMENT = r"(?:^|[\r\n])[\t ]*(?:/?\*+/?|//+!?|#+|;+|--+|%+|<!--|rem )"
_SPDX = "spdx-license-identifier:"
_EXPRESSION = rf"{_SPDX} ?\(*[\w.+-]+\)*(?:(?: (?:and|or|with) | ?/ ?)\(*[\w.+-]+\)*)*"
_SHORT = rf"(?<![\w.-])(?:{'|'.join(name for _, name in SHORT_NAMES)})(?!\w)(?!\.\d)"
_SHORT_LIST = rf"{_GRANT}(?:either )?(?:the )?{_SHORT}(?: licen[sc]e)?(?:(?:,? and |,? or |, | ?/ ?| & )(?:the )?{_SHORT}(?: licen[sc]e)?)*"
#: Confidence of a match by its priority.
CONFIDENCE = {1: 0.5, 2: 0.7, 3: 0.9, 4: 1.0}
BASE_CONFIDENCE = 0.6
#: Rules that take their labels from the text of a match; the others have one.
EXPRESSION, SHORT_LIST = "spdx expression", "short names"


def rules() -> list[tuple[int, int, str, str, str]]:
    """(rule, priority, keyword, pattern, label) of lower-case text, in order: the two rules for lists of names, three
    signatures a family, then the bodies.

    White space must be single blanks.
    4: an SPDX expression; 3: a grant that names licenses, or a body's own words; 2: the name with the word license
    beside it; 1: the tag's name alone in brackets or quotes.
    """
    found = [(4, "spdx-", _EXPRESSION, EXPRESSION), (3, " under ", _SHORT_LIST, SHORT_LIST)]
    for label, word, name in FAMILIES:
        tag = label.replace(".", r"\.")
        found += [
            (3, word, rf"{_GRANT}{name}(?: public)?(?: licen[sc]e)?(?!\w)", label),
            (2, word, rf"(?<!\w){name}(?: licen[sc]e|(?<=licen[sc]e)|(?<=licen[sc]e.{{0,16}}))(?!\w)", label),
            (1, label, rf"""[(\["'`]{tag}[)\]"'`]""", label),
        ]
    found += [(3, phrase, pattern, label) for label, phrase, pattern in BODIES]
    return [(i, *rule) for i, rule in enumerate(found)]


# A word that each body's phrase holds; a text without any of them has no body. Phrases with the word
# license need none, as that word opens the gate itself.
BODY_WORDS = [
    "hereby",
    "restriction",
    "redistribution",
    "advertising",
    "liable",
    "reproduction",
    "subject",
    "unencumbered",
    "whatever",
    "neighboring",
    "larger",
    "foundation",
    "openssl",
    "artistic",
    "hosted",
    "unmodified",
]


def gate(text: Column) -> Column:
    """Whether a text has what any rule needs: words of signatures and bodies, a grant, or a tag in brackets."""
    lower = F.lower(text)
    word = lambda *words: reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words])
    verbs = ["licensed", "licenced", "released", "distributed", "available", "published", "provided", "covered"]
    tags = "|".join(label.replace(".", r"\.") for label, *_ in FAMILIES)
    bracket = text.rlike(rf"""[(\["'`](?i:{tags})[)\]"'`]""")
    return word("licens", "licenc", "spdx-", *BODY_WORDS) | (word("under") & word(*verbs)) | bracket


def _phrase(words: list[str]) -> str:
    return rf"(?<!{_WORD}){(_SEPARATOR + '+').join(words)}(?!{_WORD})"


def _count_words(text: Column) -> Column:
    one_each = F.regexp_replace(text, rf"{_SEPARATOR}*+{_WORD}++{_SEPARATOR}*+", "x")
    return F.when(text.rlike(_WORD), F.length(one_each)).otherwise(F.lit(0)).cast("long")


def _labels_of(matched: Column) -> dict[str, Column]:
    """The labels in the text of a match, for the rules that read lists."""
    names = F.array(*[F.lit(label) for label, *_ in FAMILIES])
    listed = F.split(F.regexp_replace(F.regexp_replace(matched, rf"{_SPDX} ?", ""), r"[()]", ""), r" (?:and|or) | ?/ ?")
    # What stands after WITH is an exception of the license before it.
    tags = F.transform(listed, lambda t: F.regexp_replace(t, r"(?: with .*|-only|-or-later|\+|\.)+$", ""))
    short = [F.when(matched.rlike(rf"(?<![\w.-])(?:{name})(?!\w)(?!\.\d)"), F.lit(label)) for label, name in SHORT_NAMES]
    return {EXPRESSION: F.array_intersect(tags, names), SHORT_LIST: F.array_compact(F.array(*short))}


def _detections(text: Column) -> Column:
    """Of each rule that matches: its number and, per match, the lengths of the text before it and of the match, and labels."""
    def spans_of(label: str) -> Callable[[Column, Column], Column]:
        def span(gap: Column, match: Column) -> Column:
            labels = _labels_of(match)[label] if label in (EXPRESSION, SHORT_LIST) else F.array(F.lit(label))
            return F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), labels.alias("labels"))

        return span

    hits = []
    for rule, _, keyword, pattern, label in rules():
        # Matches follow one another from the start, each with the text before it.
        step = F.lit(rf"\G([\s\S]*?)({pattern})")
        gaps, found = (F.regexp_extract_all(text, step, F.lit(group)) for group in (1, 2))
        hit = F.struct(F.lit(rule).alias("rule"), F.zip_with(gaps, found, spans_of(label)).alias("found"))
        hits.append(F.when(F.contains(text, F.lit(keyword)), hit))
    return F.filter(F.array_compact(F.array(*hits)), lambda hit: F.size(hit["found"]) > 0)


def one_line(text: Column) -> Column:
    """The text with A-Z lower-cased, without comment marks at line starts, and with single blanks for white space.

    Only the order of places in a text counts, which this keeps.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, _COMMENT, "\n"), r"\s+", " ")


def scan(documents: DataFrame, gated: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept."""
    text = F.col("text")
    any_base = "(?i)(?:" + "|".join(_phrase(words) for _, words in BASE_PHRASES) + ")"
    # Every base phrase ends in this word.
    has_base = F.contains(F.lower(text), F.lit("license")) & text.rlike(any_base)
    counts = {label: F.when(has_base, F.regexp_count(text, F.lit("(?i)" + _phrase(words)))).otherwise(F.lit(0)) for label, words in BASE_PHRASES}
    before_first = F.regexp_extract(text, rf"(?s)^(.*?){any_base}", 1)
    before_last = F.regexp_extract(text, rf"(?s)^(.*){any_base}", 1)
    # Bound to one variable, so that all rules read the same line instead of making it again.
    hits = F.transform(F.array(one_line(text)), _detections)[0]
    plain = documents.select("doc_id", no_null_text("text").alias("text")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        _count_words(text).alias("n_words"),
        *[n.cast("long").alias(f"n_{label}") for label, n in counts.items()],
        F.when(has_base, _count_words(before_first)).alias("first_word"),
        F.when(has_base, _count_words(before_last)).alias("last_word"),
        F.when(gate(text) if gated else F.lit(True), hits).alias("hits"),
    )
    plain = write_stage(plain, "license_hits")
    known = [c for c in plain.columns if c != "hits"]
    # Most texts have no match; only the others are put in order.
    matches = (
        plain.where(F.size("hits") > 0)
        .select(*known, F.explode("hits").alias("hit"))
        .select(*known, F.col("hit.rule").alias("rule"), F.posexplode("hit.found").alias("place", "span"))
        .repartition("row")
    )
    in_rule = Window.partitionBy("row", "rule").orderBy("place")
    kinds = F.create_map(*[F.lit(x) for i, priority, *_ in rules() for x in (i, priority)])
    placed = matches.select(
        *known,
        "rule",
        kinds[F.col("rule")].alias("priority"),
        F.col("span.labels").alias("labels"),
        (F.sum(F.col("span.gap") + F.col("span.size")).over(in_rule)).alias("stop"),
        F.col("span.size").alias("size"),
    ).withColumn("start", F.col("stop") - F.col("size"))
    # In this order an interval comes after all that contain it.
    outer_first = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule")
    so_far = outer_first.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(CONFIDENCE)
    reach = {p: F.max(F.when(F.col("priority") == p, F.col("stop"))).over(so_far) for p in levels}
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("priority") <= p) & F.coalesce(reach[p] >= F.col("stop"), F.lit(False)) for p in levels],
    )
    judged = placed.withColumn("kept", ~inside)
    base_labels = F.array_compact(F.array(*[F.when(F.col(f"n_{label}") > 0, F.lit(label)) for label, _ in BASE_PHRASES]))
    confidence = F.create_map(*[F.lit(x) for p, c in CONFIDENCE.items() for x in (p, c)])
    found = judged.groupBy(*known).agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kept"), F.col("labels"))))).alias("found"),
        F.max(F.when(F.col("kept"), confidence[F.col("priority")])).alias("best"),
        F.count("rule").alias("n_found"),
        F.count(F.when(F.col("kept"), 1)).alias("n_kept"),
    )
    without = plain.where(F.coalesce(F.size("hits"), F.lit(0)) < 1).select(
        *known,
        F.array().cast("array<string>").alias("found"),
        F.lit(None).cast("double").alias("best"),
        F.lit(0).cast("long").alias("n_found"),
        F.lit(0).cast("long").alias("n_kept"),
    )
    n_base = reduce(lambda a, b: a + b, [F.col(f"n_{label}") for label, _ in BASE_PHRASES])
    return found.unionByName(without).select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("found"))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(n_base > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
        "n_found",
        "n_kept",
    )

"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame expressions only.

A text is reduced to its words (A-Z lower-cased, runs of digits, letters and non-ASCII characters) with single spaces between. Rules are
the regexes of RULES over that form, in order. A rule is tried on a text only if the text has one of its *keys* and all of its *needs*, words
that ``keywords`` derives from the regex itself: whatever the regex fits holds them. A detection inside another one's interval
is suppressed if the other has a higher priority, or the same and is longer (of equal intervals the first rule stays).

The base phrases are found apart from the rules, everywhere they stand, and are never suppressed. A null text is empty: no
words, places, labels, and a score of 0. Repeated rows stay repeated; other columns are not read. A long text is one value of its row and
each step over it takes time in proportion to its length; suppression compares the detections of a text with each other.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower

#: Fixed phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | priority | confidence | regex over words with single spaces between. Spaces separate what must stand there; what need not
#: comes with its space in a group that ends in a question mark. Higher priority: sentences of license texts (60 and 61), then identifiers
#: (50), grants (40), names (30), links (25) and mere mentions (15).
RULES = r"""
mit | 60 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 60 | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | 50 | 1.0 | spdx licen[sc]e identifier mit
mit | 40 | 0.95 | (?:licensed|released|distributed|published|provided|available) under (?:the|an) mit(?: x11)?(?: open source)?(?: licen[sc]e)?
mit | 40 | 0.95 | (?:licensed|released|distributed|published|provided|available) under the terms of the mit(?: open source)?(?: licen[sc]e)?
mit | 40 | 0.9 | (?:licensed|released|distributed) under mit
mit | 30 | 0.9 | mit(?: style| x11| expat)? licen[sc]e
mit | 30 | 0.85 | expat licen[sc]e
mit | 30 | 0.85 | x11 licen[sc]e
mit | 30 | 0.8 | licen[sc]e mit
mit | 25 | 0.9 | opensource org licenses mit
mit | 15 | 0.6 | (?:see|under|with) the mit
mit-0 | 61 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0 | 50 | 1.0 | spdx licen[sc]e identifier mit 0
mit-0 | 31 | 0.9 | mit no attribution(?: licen[sc]e)?
isc | 60 | 0.95 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | 50 | 1.0 | spdx licen[sc]e identifier isc
isc | 40 | 0.9 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? isc(?: licen[sc]e)?
isc | 30 | 0.9 | isc licen[sc]e
isc | 30 | 0.8 | licen[sc]e isc
0bsd | 60 | 0.9 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
0bsd | 50 | 1.0 | spdx licen[sc]e identifier 0bsd
0bsd | 31 | 0.9 | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?
bsd | 60 | 0.95 | redistribution and use in source and binary forms with or without modification are permitted
bsd | 60 | 0.9 | redistributions of source code must retain the above copyright notice
bsd | 60 | 0.9 | redistributions in binary form must reproduce the above copyright notice
bsd | 40 | 0.8 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?(?: a)? bsd(?: style)?(?: licen[sc]e)?
bsd | 30 | 0.75 | bsd(?: style)? licen[sc]e
bsd | 30 | 0.7 | licen[sc]e bsd
bsd-2-clause | 50 | 1.0 | spdx licen[sc]e identifier bsd 2 clause
bsd-2-clause | 31 | 0.95 | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause | 31 | 0.95 | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 31 | 0.9 | (?:simplified bsd|freebsd) licen[sc]e
bsd-3-clause | 61 | 0.95 | neither the name of .{1,80}? may be used to endorse or promote products
bsd-3-clause | 61 | 0.9 | names of its contributors may be used to endorse or promote products
bsd-3-clause | 50 | 1.0 | spdx licen[sc]e identifier bsd 3 clause
bsd-3-clause | 31 | 0.95 | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause | 31 | 0.95 | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 31 | 0.9 | (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | 61 | 0.95 | all advertising materials mentioning features or use of this software must display
bsd-4-clause | 50 | 1.0 | spdx licen[sc]e identifier bsd 4 clause
bsd-4-clause | 31 | 0.9 | bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4-clause | 31 | 0.9 | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | 31 | 0.85 | original bsd licen[sc]e
apache-2.0 | 60 | 1.0 | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 60 | 0.95 | licensed under the apache licen[sc]e version 2(?: 0)?(?: the licen[sc]e)?
apache-2.0 | 60 | 0.9 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 60 | 0.85 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0 | 50 | 1.0 | spdx licen[sc]e identifier apache 2 0
apache-2.0 | 40 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)? apache(?: software)?(?: licen[sc]e)?(?: version| v)? 2(?: 0)?(?: licen[sc]e)?
apache-2.0 | 40 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)? apache(?: software)?(?: licen[sc]e)? v2(?: 0)?
apache-2.0 | 31 | 0.95 | apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2.0 | 31 | 0.95 | apache(?: software)? licen[sc]e v2(?: 0)?
apache-2.0 | 30 | 0.9 | apache 2(?: 0)? licen[sc]e
apache-2.0 | 30 | 0.85 | licen[sc]e apache 2(?: 0)?
apache-2.0 | 25 | 0.95 | apache org licenses license 2 0
apache-1.1 | 50 | 1.0 | spdx licen[sc]e identifier apache 1 1
apache-1.1 | 31 | 0.9 | apache(?: software)? licen[sc]e(?: version| v)? 1 1
apache-1.0 | 50 | 1.0 | spdx licen[sc]e identifier apache 1 0
apache-1.0 | 31 | 0.9 | apache(?: software)? licen[sc]e(?: version| v)? 1 0
apache | 40 | 0.8 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? apache(?: software)?(?: licen[sc]e)?
apache | 30 | 0.75 | apache(?: software)? licen[sc]e
gpl | 60 | 0.9 | under the terms of the gnu general public licen[sc]e as published by the free software foundation
gpl | 60 | 0.85 | you should have received a copy of the gnu general public licen[sc]e
gpl | 40 | 0.85 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? gpl(?: licen[sc]e)?
gpl | 40 | 0.85 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? general public licen[sc]e
gpl | 30 | 0.8 | gnu general public licen[sc]e
gpl | 30 | 0.8 | (?:gnu )?gpl licen[sc]e
gpl | 30 | 0.75 | licen[sc]e gpl
gpl | 25 | 0.85 | gnu org licenses gpl
gpl-2.0 | 61 | 0.95 | either version 2 of the licen[sc]e or at your option any later version
gpl-2.0 | 50 | 1.0 | spdx licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl-2.0 | 41 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:gpl|general public licen[sc]e)(?: version| v)? 2(?: 0)?
gpl-2.0 | 41 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:gpl|general public licen[sc]e) (?:v2|gplv2)(?: 0)?
gpl-2.0 | 31 | 0.9 | general public licen[sc]e(?: version| v)? 2(?: 0)?
gpl-2.0 | 31 | 0.9 | general public licen[sc]e v2(?: 0)?
gpl-2.0 | 31 | 0.9 | gpl(?: version| v)? 2(?: 0)?(?: licen[sc]e)?
gpl-2.0 | 31 | 0.9 | gpl v2(?: 0)?(?: licen[sc]e)?
gpl-2.0 | 31 | 0.9 | gplv2(?: licen[sc]e)?
gpl-3.0 | 61 | 0.95 | either version 3 of the licen[sc]e or at your option any later version
gpl-3.0 | 50 | 1.0 | spdx licen[sc]e identifier gpl 3 0(?: only| or later)?
gpl-3.0 | 41 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:gpl|general public licen[sc]e)(?: version| v)? 3(?: 0)?
gpl-3.0 | 41 | 0.95 | (?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:gpl|general public licen[sc]e) (?:v3|gplv3)(?: 0)?
gpl-3.0 | 31 | 0.9 | general public licen[sc]e(?: version| v)? 3(?: 0)?
gpl-3.0 | 31 | 0.9 | general public licen[sc]e v3(?: 0)?
gpl-3.0 | 31 | 0.9 | gpl(?: version| v)? 3(?: 0)?(?: licen[sc]e)?
gpl-3.0 | 31 | 0.9 | gpl v3(?: 0)?(?: licen[sc]e)?
gpl-3.0 | 31 | 0.9 | gplv3(?: licen[sc]e)?
lgpl | 60 | 0.9 | under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation
lgpl | 40 | 0.85 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? lgpl(?: licen[sc]e)?
lgpl | 32 | 0.85 | (?:lesser|library) general public licen[sc]e
lgpl | 30 | 0.8 | lgpl licen[sc]e
lgpl-2.1 | 50 | 1.0 | spdx licen[sc]e identifier lgpl 2 [01](?: only| or later)?
lgpl-2.1 | 33 | 0.95 | (?:lesser|library) general public licen[sc]e(?: version| v)? 2(?: [01])?
lgpl-2.1 | 33 | 0.95 | (?:lesser|library) general public licen[sc]e v2(?: [01])?
lgpl-2.1 | 31 | 0.9 | lgpl(?: version| v)? 2(?: [01])?
lgpl-2.1 | 31 | 0.9 | (?:lgpl v2|lgplv2)(?: [01])?
lgpl-3.0 | 50 | 1.0 | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | 33 | 0.95 | lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl-3.0 | 33 | 0.95 | lesser general public licen[sc]e v3(?: 0)?
lgpl-3.0 | 31 | 0.9 | lgpl(?: version| v)? 3(?: 0)?
lgpl-3.0 | 31 | 0.9 | (?:lgpl v3|lgplv3)(?: 0)?
agpl-3.0 | 60 | 0.95 | under the terms of the gnu affero general public licen[sc]e
agpl-3.0 | 50 | 1.0 | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
agpl-3.0 | 40 | 0.9 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:agpl|agplv3)(?: licen[sc]e)?
agpl-3.0 | 33 | 0.9 | affero general public licen[sc]e(?: version| v)?(?: 3)?(?: 0)?
agpl-3.0 | 31 | 0.85 | (?:agplv3|agpl v3|agpl 3 0|agpl licen[sc]e)
fdl-1.3 | 60 | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
fdl-1.3 | 50 | 1.0 | spdx licen[sc]e identifier gfdl 1 [123](?: only| or later)?
fdl-1.3 | 31 | 0.9 | free documentation licen[sc]e(?: version| v)?(?: 1 [0-3])?
fdl-1.3 | 30 | 0.8 | gfdl(?: licen[sc]e)?
mpl-2.0 | 60 | 1.0 | this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2.0 | 50 | 1.0 | spdx licen[sc]e identifier mpl 2 0
mpl-2.0 | 31 | 0.95 | mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-2.0 | 31 | 0.9 | (?:mpl 2 0|mpl v2|mplv2)
mpl-1.1 | 60 | 0.95 | the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]
mpl-1.1 | 50 | 1.0 | spdx licen[sc]e identifier mpl 1 [01]
mpl-1.1 | 31 | 0.9 | mozilla public licen[sc]e(?: version| v)? 1 [01]
mpl | 30 | 0.8 | mozilla public licen[sc]e
epl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier epl 1 0
epl-1.0 | 31 | 0.9 | eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl-2.0 | 60 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl-2.0 | 50 | 1.0 | spdx licen[sc]e identifier epl 2 0
epl-2.0 | 31 | 0.9 | eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl | 30 | 0.8 | eclipse public licen[sc]e
edl-1.0 | 30 | 0.85 | eclipse distribution licen[sc]e
cddl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier cddl 1 [01]
cddl-1.0 | 30 | 0.9 | common development and distribution licen[sc]e
cddl-1.0 | 30 | 0.8 | cddl(?: licen[sc]e)?(?: version| v)? 1 [01]
cpl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier cpl 1 0
cpl-1.0 | 30 | 0.85 | common public licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
cpal-1.0 | 30 | 0.85 | common public attribution licen[sc]e
ipl-1.0 | 30 | 0.85 | ibm public licen[sc]e
cc0-1.0 | 60 | 0.95 | has waived all copyright and related or neighboring rights to
cc0-1.0 | 50 | 1.0 | spdx licen[sc]e identifier cc0 1 0
cc0-1.0 | 31 | 0.95 | creative commons zero
cc0-1.0 | 31 | 0.9 | (?:cc0 1 0|cc0 universal|cc0 licen[sc]e|cc0 public domain)
cc0-1.0 | 40 | 0.9 | (?:licensed|released|published|available|dedicated) under(?: the)? cc0
cc0-1.0 | 25 | 0.9 | creativecommons org publicdomain zero
cc-by | 50 | 1.0 | spdx licen[sc]e identifier cc by [1-4] [05]
cc-by | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by(?: [1-4] [05])?
cc-by | 31 | 0.9 | creative commons attribution(?: [1-4] [05])?
cc-by | 30 | 0.85 | cc by [1-4] [05]
cc-by | 25 | 0.9 | creativecommons org licenses by
cc-by-sa | 50 | 1.0 | spdx licen[sc]e identifier cc by sa [1-4] [05]
cc-by-sa | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by sa(?: [1-4] [05])?
cc-by-sa | 32 | 0.9 | creative commons attribution (?:sharealike|share alike)(?: [1-4] [05])?
cc-by-sa | 30 | 0.85 | cc by sa(?: [1-4] [05])?
cc-by-sa | 25 | 0.9 | creativecommons org licenses by sa
cc-by-nd | 50 | 1.0 | spdx licen[sc]e identifier cc by nd [1-4] [05]
cc-by-nd | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by nd(?: [1-4] [05])?
cc-by-nd | 32 | 0.9 | creative commons attribution (?:noderivatives|noderivs|no derivatives|no derivs)(?: [1-4] [05])?
cc-by-nd | 30 | 0.85 | cc by nd(?: [1-4] [05])?
cc-by-nc | 50 | 1.0 | spdx licen[sc]e identifier cc by nc [1-4] [05]
cc-by-nc | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by nc(?: [1-4] [05])?
cc-by-nc | 32 | 0.9 | creative commons attribution (?:noncommercial|non commercial)(?: [1-4] [05])?
cc-by-nc | 30 | 0.85 | cc by nc(?: [1-4] [05])?
cc-by-nc | 25 | 0.9 | creativecommons org licenses by nc
cc-by-nc-sa | 50 | 1.0 | spdx licen[sc]e identifier cc by nc sa [1-4] [05]
cc-by-nc-sa | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | 33 | 0.9 | creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: [1-4] [05])?
cc-by-nc-sa | 30 | 0.85 | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 50 | 1.0 | spdx licen[sc]e identifier cc by nc nd [1-4] [05]
cc-by-nc-nd | 40 | 0.9 | (?:licensed|released|published|available) under(?: the)?(?: a)? cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | 33 | 0.9 | creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives|no derivs)(?: [1-4] [05])?
cc-by-nc-nd | 30 | 0.85 | cc by nc nd(?: [1-4] [05])?
cc | 20 | 0.6 | creative commons licen[sc]e
unlicense | 60 | 1.0 | this is free and unencumbered software released into the public domain
unlicense | 50 | 1.0 | spdx licen[sc]e identifier unlicense
unlicense | 30 | 0.85 | the unlicense
unlicense | 25 | 0.9 | unlicense org
wtfpl | 60 | 0.95 | do what the fuck you want to public licen[sc]e
wtfpl | 50 | 1.0 | spdx licen[sc]e identifier wtfpl
wtfpl | 30 | 0.85 | wtfpl(?: licen[sc]e)?
zlib | 60 | 0.9 | altered source versions must be plainly marked as such
zlib | 60 | 0.85 | the origin of this software must not be misrepresented
zlib | 50 | 1.0 | spdx licen[sc]e identifier zlib
zlib | 40 | 0.9 | (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? zlib(?: libpng)?(?: licen[sc]e)?
zlib | 30 | 0.85 | zlib(?: libpng)? licen[sc]e
bsl-1.0 | 60 | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
bsl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier bsl 1 0
bsl-1.0 | 30 | 0.9 | boost software licen[sc]e(?: version| v)?(?: 1)?(?: 0)?
artistic-1.0 | 50 | 1.0 | spdx licen[sc]e identifier artistic 1 0
artistic-1.0 | 31 | 0.85 | artistic licen[sc]e(?: version| v)? 1(?: 0)?
artistic-2.0 | 50 | 1.0 | spdx licen[sc]e identifier artistic 2 0
artistic-2.0 | 31 | 0.9 | artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic | 30 | 0.75 | artistic licen[sc]e
psf-2.0 | 50 | 1.0 | spdx licen[sc]e identifier (?:psf|python) 2 0
psf-2.0 | 30 | 0.9 | python software foundation licen[sc]e(?: version| v)?(?: 2)?
psf-2.0 | 30 | 0.8 | psf licen[sc]e
ofl-1.1 | 60 | 0.95 | this font software is licensed under the sil open font licen[sc]e
ofl-1.1 | 50 | 1.0 | spdx licen[sc]e identifier ofl 1 [01]
ofl-1.1 | 30 | 0.9 | open font licen[sc]e(?: version| v)?(?: 1)?(?: 1)?
ms-pl | 50 | 1.0 | spdx licen[sc]e identifier ms pl
ms-pl | 30 | 0.9 | microsoft public licen[sc]e
ms-rl | 50 | 1.0 | spdx licen[sc]e identifier ms rl
ms-rl | 30 | 0.9 | microsoft reciprocal licen[sc]e
eupl-1.2 | 50 | 1.0 | spdx licen[sc]e identifier eupl 1 [012]
eupl-1.2 | 30 | 0.9 | european union public licen[sc]e(?: version| v)?(?: 1)?(?: [12])?
osl-3.0 | 50 | 1.0 | spdx licen[sc]e identifier osl 3 0
osl-3.0 | 30 | 0.85 | open software licen[sc]e(?: version| v)?(?: 3)?(?: 0)?
afl-3.0 | 50 | 1.0 | spdx licen[sc]e identifier afl 3 0
afl-3.0 | 30 | 0.85 | academic free licen[sc]e(?: version| v)?(?: 3)?(?: 0)?
ncsa | 50 | 1.0 | spdx licen[sc]e identifier ncsa
ncsa | 30 | 0.9 | university of illinois(?: ncsa)? open source licen[sc]e
ncsa | 30 | 0.85 | ncsa(?: open source)? licen[sc]e
odbl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier odbl 1 0
odbl-1.0 | 30 | 0.9 | open database licen[sc]e
odbl-1.0 | 25 | 0.8 | odbl
odc-by | 30 | 0.85 | open data commons attribution licen[sc]e
pddl-1.0 | 30 | 0.85 | public domain dedication and licen[sc]e
bsl-1.1 | 50 | 1.0 | spdx licen[sc]e identifier busl 1 1
bsl-1.1 | 30 | 0.9 | business source licen[sc]e(?: version| v)?(?: 1)?(?: 1)?
sspl-1.0 | 50 | 1.0 | spdx licen[sc]e identifier sspl 1 0
sspl-1.0 | 30 | 0.9 | server side public licen[sc]e(?: version| v)?(?: 1)?
elastic-2.0 | 50 | 1.0 | spdx licen[sc]e identifier elastic 2 0
elastic-2.0 | 30 | 0.9 | elastic licen[sc]e(?: version| v)?(?: 2)?(?: 0)?
openrail | 30 | 0.85 | (?:openrail|open rail|bigscience rail)(?: m| s)?(?: licen[sc]e)?
openrail | 30 | 0.85 | responsible ai licen[sc]e
cecill-2.1 | 50 | 1.0 | spdx licen[sc]e identifier cecill 2 [01]
cecill-2.1 | 30 | 0.9 | cecill(?: [abc])?(?: free software)? licen[sc]e
postgresql | 50 | 1.0 | spdx licen[sc]e identifier postgresql
postgresql | 30 | 0.85 | postgresql licen[sc]e
openssl | 60 | 0.9 | this product includes software developed by the openssl project
openssl | 30 | 0.8 | openssl licen[sc]e
ruby | 30 | 0.8 | ruby licen[sc]e
php-3.01 | 30 | 0.85 | php licen[sc]e(?: version| v)?(?: 3 0)?
w3c | 30 | 0.8 | w3c software(?: notice and)? licen[sc]e
vim | 30 | 0.8 | vim licen[sc]e
beerware | 60 | 0.9 | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 30 | 0.8 | beerware(?: licen[sc]e)?
lppl-1.3c | 60 | 0.9 | under the conditions of the latex project public licen[sc]e
lppl-1.3c | 30 | 0.85 | latex project public licen[sc]e
json | 60 | 0.9 | the software shall be used for good not evil
upl-1.0 | 30 | 0.85 | universal permissive licen[sc]e
mulan-2.0 | 30 | 0.85 | mulan (?:psl|permissive software licen[sc]e)
commons-clause | 30 | 0.8 | commons clause
public-domain | 15 | 0.7 | (?:in|into|to) the public domain
proprietary | 15 | 0.5 | all rights reserved
proprietary | 15 | 0.7 | confidential and proprietary
proprietary | 15 | 0.7 | unauthorized copying of this file
warranty-disclaimer | 15 | 0.3 | without warrant(?:y|ies) of any kind
warranty-disclaimer | 15 | 0.3 | without any warranty without even the implied warranty of merchantability
"""
#: Words that many texts have: others are better keys.
COMMON = {
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "copy", "copyright", "day", "file", "files", "for", "free", "good", "if", "in", "into", "is", "licence", "license", "may", "must", "name", "new",
    "no", "not", "of", "on", "one", "open", "or", "org", "public", "reserved", "rights", "see", "software", "source", "terms", "that", "the", "this", "to", "under", "use", "used", "version", "with", "without", "you", "zero",
    *"0123456789", "two", "three", "four", "data", "project", "available", "published", "released", "provided", "distributed", "clause",
}


#: Two spellings of one word; needs and what a text holds name the second.
LICENSE = ["licence", "license"]


def rules() -> list[tuple[int, str, int, float, str]]:
    """(id, label, priority, confidence, regex) in order."""
    rows = [[x.strip() for x in line.split(" | ")] for line in RULES.strip().splitlines()]
    return [(i, label, int(p), float(c), r) for i, (label, p, c, r) in enumerate(rows)]


def _parts(pattern: str) -> list[list[str]]:
    """What must stand, one after another: for each part its alternatives. Groups that need not stand are left out."""
    out: list[str] = [""]
    at = 0
    while at < len(pattern):
        if pattern[at] == "(":
            depth, end = 0, at
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
                if not depth:
                    break
            if pattern[end : end + 1] == "?":
                at = end + 1
                continue
            out[-1] += pattern[at:end]
            at = end
        elif pattern[at] == " ":
            out.append("")
            at += 1
        else:
            out[-1] += pattern[at]
            at += 1
    made = []
    for part in out:
        group = re.fullmatch(r"([a-z0-9]*)\(\?:(.*)\)", part)
        made.append([group[1] + x for x in re.split(r"\|(?![^(]*\))", group[2])] if group else [part])
    return made


def _words(alternative: str) -> list[list[str]]:
    """The words of an alternative, each with the spellings of its character class; what has other marks is left out."""
    out = []
    for word in _parts(alternative) if "(" in alternative else [[w] for w in alternative.split(" ")]:
        for w in word[:1]:
            cls = re.fullmatch(r"([a-z0-9]*)\[([a-z0-9]+)\]([a-z0-9]*)", w)
            if cls:
                out.append(sorted(cls[1] + c + cls[3] for c in cls[2]))
            elif re.fullmatch(r"[a-z0-9]+", w):
                out.append([w])
    return out


def keywords(pattern: str) -> tuple[list[str], list[str]]:
    """(keys, needs): whatever ``pattern`` fits has one of the keys as a word, and all of the needs."""
    best, needs = None, set()
    for part in _parts(pattern):
        found = [_words(x) for x in part]
        if not all(found):
            continue
        if len(found) == 1:
            needs |= {w[-1] for w in found[0] if len(w) == 1 or w == LICENSE}
        # of each alternative the least common word, in all its spellings
        chosen = [min(words, key=lambda w: (any(x in COMMON for x in w), len(w), -len(w[0]))) for words in found]
        cost = (any(x in COMMON for w in chosen for x in w), sum(map(len, chosen)), -min(len(x) for w in chosen for x in w))
        if best is None or cost < best[0]:
            best = cost, sorted({x for w in chosen for x in w})
    return best[1], sorted(needs)


def words_of(text: Column) -> Column:
    """The words of a text, with an empty one before or after them where other characters stand there."""
    plain = F.octet_length(text) == F.length(text)  # A-Z are then all that lower() changes
    return F.split(F.when(plain, F.lower(text)).otherwise(ascii_lower(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _places(norm: Column, pattern: Column, of: Column) -> Column:
    """Where the pattern fits whole words: array of (start, end, rule) with ``of`` as rule; words from 0, end exclusive.

    Fits are marked in the text, and the words that bear marks counted: the marks are no word's characters.
    """
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(norm, whole, F.lit("\x01$0\x02")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i - 1)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"), of.alias("rule")))


RULE = "struct<id:int,label:string,needs:array<string>,priority:int,confidence:double,pattern:string>"


def _constant(value: object, kind: str) -> Column:
    """A constant of any type, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _table(rows: list[tuple[int, str, list[str], int, float, str]]) -> Column:
    names = ["id", "label", "needs", "priority", "confidence", "pattern"]
    return _constant([dict(zip(names, row, strict=True)) for row in rows], f"array<{RULE}>")


def detect(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, base and found: arrays of (start, end, rule), found after suppression."""
    made = rules()
    by_key: dict[str, list[int]] = {}
    needs = {}
    for i, _, _, _, pattern in made:
        keys, needs[i] = keywords(pattern)
        for key in keys:
            by_key.setdefault(key, []).append(i)
    phrases = _table([(i, label, phrase.split(" "), 0, 1.0, phrase) for i, (phrase, label) in enumerate(BASE.items())])
    table = _table([(i, label, needs[i], p, c, r) for i, label, p, c, r in made])
    of_key = _constant(by_key, "map<string,array<int>>")
    asked = sorted({*by_key, *LICENSE, *(w for x in needs.values() for w in x), *(w for p in BASE for w in p.split(" "))})
    none = F.array().cast(f"array<struct<start:int,end:int,rule:{RULE}>>")

    out = docs.select("doc_id", words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    held = F.array_intersect(_constant(asked, "array<string>"), F.col("words"))
    out = out.withColumn("held", F.transform(held, lambda w: F.when(w == LICENSE[0], LICENSE[1]).otherwise(w)))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("held", lambda w: w.isin(*by_key)), lambda w: of_key[w]))))
    tried = F.filter(F.transform(numbers, lambda i: F.get(table, i)), lambda r: F.size(F.array_except(r["needs"], F.col("held"))) == 0)
    bases = F.when(F.array_contains("held", "license"), F.filter(phrases, lambda r: F.size(F.array_except(r["needs"], F.col("held"))) == 0))
    out = out.withColumns({"tried": tried, "bases": bases})
    some = (F.size("tried") > 0) | (F.size(F.coalesce("bases", F.array())) > 0)
    n_words = F.size("words") - F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    out = out.select("doc_id", n_words.cast("long").alias("n_words"), "tried", "bases", F.when(some, F.concat(F.lit(" "), F.trim(F.array_join("words", " ")), F.lit(" "))).alias("norm"))

    def found(of: str) -> Column:
        return F.when(F.size(of) > 0, F.flatten(F.transform(of, lambda r: _places(F.col("norm"), r["pattern"], r)))).otherwise(none)

    out = out.select("doc_id", "n_words", found("bases").alias("base"), found("tried").alias("all"))

    def over(t: Column, s: Column) -> Column:
        inside = (t["start"] <= s["start"]) & (t["end"] >= s["end"]) & (t["rule"]["id"] != s["rule"]["id"])
        longer = (t["end"] - t["start"]) > (s["end"] - s["start"])
        p, q = t["rule"]["priority"], s["rule"]["priority"]
        same = (p == q) & (longer | (((t["end"] - t["start"]) == (s["end"] - s["start"])) & (t["rule"]["id"] < s["rule"]["id"])))
        return inside & ((p > q) | same)

    kept = F.filter("all", lambda s: ~F.exists("all", lambda t: over(t, s)))
    return out.select("doc_id", "n_words", "base", kept.alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best detection's confidence)."""
    found = detect(docs)
    starts = F.transform("base", lambda s: s["start"])
    labels = [F.transform(c, lambda s: s["rule"]["label"]) for c in ("base", "found")]
    best = F.array_max(F.transform(F.concat("base", "found"), lambda s: s["rule"]["confidence"]))

    def listed(c: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(c)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(labels[0]).alias("base_labels"), listed(F.concat(*labels)).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """All rules on all texts, without keywords. DuckDB's regexes don't look around, so each word has spaces of its own."""

    def wide(pattern: str) -> str:
        return f" ({pattern.replace(' ', '  ')}) "

    rows = [(0, i, label, 0, 1.0, wide(phrase)) for i, (phrase, label) in enumerate(BASE.items())] + [(1, i, label, p, c, wide(r)) for i, label, p, c, r in rules()]
    values = ", ".join(f"({k}, {i}, '{label}', {p}, {c}::DOUBLE, '{r}')" for k, i, label, p, c, r in rows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS norm FROM d),
r(kind, id, label, priority, confidence, pattern) AS (VALUES {values}),
m AS (SELECT rid, kind, id, label, priority, confidence, string_split(regexp_replace(norm, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), '  ') AS pieces
      FROM n, r WHERE regexp_matches(norm, pattern)),
p AS (SELECT rid, kind, id, label, priority, confidence, unnest(list_filter(list_transform(pieces, lambda x, i: CASE WHEN contains(x, chr(1)) THEN i - 1 END), lambda x: x IS NOT NULL)) AS s,
             unnest(list_filter(list_transform(pieces, lambda x, i: CASE WHEN contains(x, chr(2)) THEN i END), lambda x: x IS NOT NULL)) AS e FROM m),
k AS (SELECT * FROM p a WHERE kind = 0 OR NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 1 AND b.rid = a.rid AND b.s <= a.s AND b.e >= a.e AND b.id <> a.id
        AND (b.priority > a.priority OR b.priority = a.priority AND (b.e - b.s > a.e - a.s OR b.e - b.s = a.e - a.s AND b.id < a.id)))),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_base, min(s) FILTER (kind = 0) AS first_word, max(s) FILTER (kind = 0) AS last_word, max(confidence) AS score,
        array_to_string(list_sort(list_distinct(list(label) FILTER (kind = 0))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM k GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM n LEFT JOIN g USING (rid)
"""


SQL = _sql()

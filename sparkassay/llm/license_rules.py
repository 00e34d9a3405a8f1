"""Signature rules for licence texts and notices.

Rules read a normal form: A-Z lower-cased, words of digits, a-z and non-ASCII
bytes, one space between words.  A line is

    label | priority | confidence | keyword | pattern

``keyword`` gates the rule: the pattern only runs on texts that hold it.  ``{v}``
stands for each version after ``versions:``; in the label it is written with a
dot, in the pattern with a space (that is how a dot reads in the normal form).
Higher priority wins where detections lie inside each other.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: re.Pattern


#: Fixed values of the contract: base phrases and their labels.
BASE = (
    (b"gnu general public license", "gpl"),
    (b"apache license", "apache"),
    (b"cc by", "cc-by"),
    (b"mit license", "mit"),
)

#: With versions.
VERSIONED = r"""
versions: 1.0 2.0 3.0
gpl-{v}-or-later | 95 | 0.99 | gpl | gpl {v} or later
gpl-{v}-only | 95 | 0.99 | gpl | gpl {v} only
gpl-{v}-or-later | 94 | 0.98 | gplv | gplv?{m} or later
gpl-{v}-or-later | 94 | 0.98 | general public license | general public license (?:as published by the free software foundation )?(?:either )?version {m}(?: of the license)? or (?:at your option )?any later version
gpl-{v} | 80 | 0.97 | general public license | gnu general public license (?:gpl )?(?:version |v ?|ver )?{m}(?: 0)?
gpl-{v} | 78 | 0.9 | gpl | gnu gpl (?:version |v ?)?{m}(?: 0)?
gpl-{v} | 76 | 0.85 | gpl | gpl ?v?{m}(?: 0)?
versions: 2.0 2.1 3.0
lgpl-{v}-or-later | 96 | 0.99 | lgpl | lgpl {v} or later
lgpl-{v}-only | 96 | 0.99 | lgpl | lgpl {v} only
lgpl-{v} | 85 | 0.97 | lesser general public | gnu lesser general public license (?:lgpl )?(?:version |v ?)?{v}
lgpl-{v} | 84 | 0.95 | library general public | gnu library general public license (?:version |v ?)?{v}
lgpl-{v} | 79 | 0.85 | lgpl | lgpl ?v?{v}
versions: 1.0 3.0
agpl-{v}-or-later | 96 | 0.99 | agpl | agpl {v} or later
agpl-{v}-only | 96 | 0.99 | agpl | agpl {v} only
agpl-{v} | 86 | 0.97 | affero | (?:gnu )?affero general public license (?:version |v ?)?{m}(?: 0)?
agpl-{v} | 79 | 0.85 | agpl | agpl ?v?{m}(?: 0)?
versions: 1.1 1.2 1.3
gfdl-{v}-or-later | 94 | 0.98 | gfdl | gfdl {v} or later
gfdl-{v} | 85 | 0.97 | free documentation | gnu free documentation license (?:version |v ?)?{v}
versions: 1.0 1.1 2.0
apache-{v} | 85 | 0.98 | apache | (?:the )?apache (?:software )?license (?:version |v ?)?{v}
apache-{v} | 80 | 0.93 | apache | apache {v}
apache-{v} | 82 | 0.95 | apache | asl {v}(?= apache)
versions: 1.0 1.1 2.0
mpl-{v} | 85 | 0.98 | mozilla | mozilla public license (?:mpl )?(?:version |v ?)?{v}
mpl-{v} | 79 | 0.9 | mpl | mpl ?v?{v}
versions: 1.0 2.0
epl-{v} | 85 | 0.97 | eclipse | eclipse public license (?:epl )?(?:version |v ?)?{v}
epl-{v} | 78 | 0.85 | epl | epl {v}
cpl-{v} | 84 | 0.95 | common public | common public license (?:version |v ?)?{v}
versions: 1.0 1.1
cddl-{v} | 85 | 0.97 | common development | common development and distribution license (?:cddl )?(?:version |v ?)?{v}
cddl-{v} | 78 | 0.85 | cddl | cddl {v}
versions: 1.0 1.1 1.2
eupl-{v} | 85 | 0.97 | european union public | european union public licen[cs]e (?:eupl )?(?:version |v ?)?{v}
eupl-{v} | 78 | 0.85 | eupl | eupl v? ?{v}
versions: 1.0 2.0
artistic-{v} | 84 | 0.95 | artistic | artistic license (?:version |v ?)?{v}
versions: 1.0 2.0 2.1 3.0
afl-{v} | 84 | 0.95 | academic free | academic free license (?:version |v ?)?{v}
osl-{v} | 84 | 0.95 | open software | open software license (?:version |v ?)?{v}
versions: 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd-{v} | 93 | 0.98 | nc | cc by nc nd {v}
cc-by-nc-sa-{v} | 93 | 0.98 | nc | cc by nc sa {v}
cc-by-nc-{v} | 90 | 0.98 | nc | cc by nc {v}
cc-by-nd-{v} | 91 | 0.98 | cc by nd | cc by nd {v}
cc-by-sa-{v} | 91 | 0.98 | cc by sa | cc by sa {v}
cc-by-{v} | 88 | 0.98 | cc by | cc by {v}
cc-by-nc-nd-{v} | 93 | 0.98 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?{v}
cc-by-nc-sa-{v} | 93 | 0.98 | creative commons | creative commons attribution non ?commercial share ?alike {v}
cc-by-nc-{v} | 90 | 0.98 | creative commons | creative commons attribution non ?commercial {v}
cc-by-nd-{v} | 91 | 0.98 | creative commons | creative commons attribution no ?deriv(?:ative)?s? {v}
cc-by-sa-{v} | 91 | 0.98 | creative commons | creative commons attribution share ?alike {v}
cc-by-{v} | 88 | 0.98 | creative commons | creative commons attribution {v}
cc-by-nc-nd-{v} | 93 | 0.98 | creativecommons | creativecommons org licenses by nc nd {v}
cc-by-nc-sa-{v} | 93 | 0.98 | creativecommons | creativecommons org licenses by nc sa {v}
cc-by-nc-{v} | 90 | 0.98 | creativecommons | creativecommons org licenses by nc {v}
cc-by-nd-{v} | 91 | 0.98 | creativecommons | creativecommons org licenses by nd {v}
cc-by-sa-{v} | 91 | 0.98 | creativecommons | creativecommons org licenses by sa {v}
cc-by-{v} | 88 | 0.98 | creativecommons | creativecommons org licenses by {v}
versions: 1.0 2.0 2.1
php-{v} | 82 | 0.93 | php license | php license (?:version |v ?)?{v}
zpl-{v} | 82 | 0.93 | zope | zope public license (?:version |v ?)?{v}
versions: 1.0 1.1
odc-by-{v} | 84 | 0.95 | open data commons | open data commons attribution license (?:odc by )?v?{v}
odbl-{v} | 84 | 0.96 | open database | open (?:data commons )?open database license (?:odbl )?v?{v}
ofl-{v} | 84 | 0.96 | open font | (?:sil )?open font license (?:ofl )?(?:version |v ?)?{v}
cecill-{v} | 80 | 0.9 | cecill | cecill (?:version |v ?)?{v}
ms-pl-{v} | 80 | 0.8 | microsoft public | microsoft public license {v}
"""

#: Without versions.
PLAIN = r"""
gpl | 40 | 0.9 | general public license | gnu general public licen[cs]e
gpl | 30 | 0.6 | gpl | gnu gpl
lgpl | 45 | 0.9 | lesser general public | gnu lesser general public licen[cs]e
lgpl | 44 | 0.9 | library general public | gnu library general public licen[cs]e
agpl | 45 | 0.9 | affero | (?:gnu )?affero general public licen[cs]e
gfdl | 45 | 0.9 | free documentation | gnu free documentation licen[cs]e
apache | 40 | 0.9 | apache | apache (?:software )?licen[cs]e
apache-2.0 | 92 | 0.99 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 90 | 0.97 | apache org | www apache org licenses license 2 0
apache-2.0 | 70 | 0.9 | without warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
mit | 40 | 0.9 | mit licen | mit licen[cs]e
mit | 60 | 0.95 | mit license | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit license
mit | 70 | 0.98 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 55 | 0.9 | expat | expat license
mit-0 | 85 | 0.95 | mit no attribution | mit no attribution
x11 | 60 | 0.85 | x11 license | x11 license
bsd-2-clause | 85 | 0.97 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3-clause | 85 | 0.97 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-4-clause | 85 | 0.97 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: license)?
0bsd | 85 | 0.95 | bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
bsd | 40 | 0.85 | bsd | (?:berkeley software distribution|bsd(?: style)?) licen[cs]e
bsd-3-clause | 72 | 0.95 | neither the name | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd | 60 | 0.9 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 73 | 0.95 | all advertising materials | all advertising materials mentioning features or use of this software must display
isc | 80 | 0.95 | isc license | (?:the )?isc license
isc | 70 | 0.95 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | 80 | 0.95 | zlib | zlib(?: libpng)? license
zlib | 70 | 0.9 | provided as is without | this software is provided as is without any express or implied warranty
libpng | 75 | 0.9 | libpng license | libpng license
boost-1.0 | 85 | 0.97 | boost software | boost software license(?: version 1 0)?
unlicense | 85 | 0.95 | unlicense | (?:the )?unlicense
unlicense | 72 | 0.95 | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 85 | 0.95 | wtfpl | wtfpl
wtfpl | 84 | 0.95 | do what the | do what the f\S* you want to public license
cc0-1.0 | 88 | 0.97 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 88 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 86 | 0.9 | creative commons zero | creative commons zero
public-domain | 50 | 0.7 | public domain | (?:dedicated to|placed in|released into|in) the public domain
cc-by-nc-nd | 62 | 0.9 | nc | cc by nc nd
cc-by-nc-sa | 62 | 0.9 | nc | cc by nc sa
cc-by-nc | 60 | 0.9 | nc | cc by nc
cc-by-nd | 60 | 0.9 | cc by nd | cc by nd
cc-by-sa | 60 | 0.9 | cc by sa | cc by sa
cc-by | 40 | 0.85 | cc by | cc by
cc-by-nc-nd | 62 | 0.9 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | 62 | 0.9 | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc | 60 | 0.9 | creative commons | creative commons attribution non ?commercial
cc-by-nd | 60 | 0.9 | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | 60 | 0.9 | creative commons | creative commons attribution share ?alike
cc-by | 45 | 0.9 | creative commons | creative commons attribution
creative-commons | 20 | 0.6 | creative commons | creative commons licen[cs]e
mpl | 40 | 0.9 | mozilla | mozilla public licen[cs]e
epl | 40 | 0.9 | eclipse | eclipse public licen[cs]e
cddl | 40 | 0.9 | common development | common development and distribution licen[cs]e
artistic | 40 | 0.85 | artistic | artistic licen[cs]e
python-2.0 | 80 | 0.9 | python | python software foundation license(?: version 2)?
php | 40 | 0.8 | php license | php license
ruby | 60 | 0.8 | ruby | (?:same terms as ruby|ruby license)
perl | 60 | 0.85 | perl | same terms as perl(?: itself)?
postgresql | 80 | 0.9 | postgresql licen | postgresql licen[cs]e
openssl | 80 | 0.9 | openssl licen | openssl licen[cs]e
curl | 75 | 0.85 | curl license | curl license
vim | 70 | 0.8 | vim license | vim license
tcl | 70 | 0.8 | tcl tk license | tcl tk license
ntp | 70 | 0.8 | ntp license | ntp license
ncsa | 80 | 0.9 | ncsa | (?:university of illinois )?ncsa open source license
icu | 70 | 0.8 | icu license | icu license
unicode | 70 | 0.85 | unicode | unicode (?:license agreement|terms of use)
w3c | 70 | 0.85 | w3c | w3c (?:software|document) (?:notice and )?license
json | 75 | 0.9 | good not evil | the software shall be used for good not evil
ms-pl | 70 | 0.85 | microsoft public | microsoft public license
ms-rl | 70 | 0.85 | microsoft reciprocal | microsoft reciprocal license
ibm-pl | 70 | 0.85 | ibm public | ibm public license
sleepycat | 70 | 0.85 | sleepycat | sleepycat license
qpl | 70 | 0.85 | q public | q public license
apsl | 70 | 0.85 | apple public | apple public source license
ofl | 45 | 0.9 | open font | (?:sil )?open font licen[cs]e
odbl | 45 | 0.9 | open database | open database licen[cs]e
pddl | 60 | 0.9 | public domain dedication | public domain dedication and license
eupl | 45 | 0.9 | european union public | european union public licen[cs]e
ogl-uk | 70 | 0.9 | open government | open government licen[cs]e
etalab | 70 | 0.85 | licence ouverte | licence ouverte
sspl | 85 | 0.95 | server side public | server side public license
busl | 85 | 0.95 | business source | business source license
elastic | 85 | 0.95 | elastic license | elastic license(?: 2 0)?
commons-clause | 80 | 0.95 | commons clause | commons clause
polyform | 80 | 0.9 | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter) license
openrail | 80 | 0.9 | openrail | (?:big(?:science|code) )?openrail(?: m)?(?: license)?
openrail | 79 | 0.9 | rail license | (?:bigscience|creativeml) (?:open )?rail license
llama-community | 80 | 0.9 | community license | llama \S+ community license
spdx-tag | 15 | 0.5 | spdx | spdx license identifier \S+
proprietary | 50 | 0.7 | all rights reserved | all rights reserved
proprietary | 55 | 0.8 | confidential | confidential and proprietary
proprietary | 55 | 0.75 | may not be reproduced | may not be reproduced (?:or transmitted )?in any form
eula | 50 | 0.8 | end user license | end user license agreement
terms-of-use | 30 | 0.5 | subject to the terms | subject to the terms (?:and conditions )?of (?:this|the) licen[cs]e
copyleft | 25 | 0.5 | copyleft | copyleft
copyright-notice | 10 | 0.4 | copyright | copyright (?:c )?(?:19|20)\d\d
license-mention | 5 | 0.3 | licen | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?\S+(?: \S+){0,3} licen[cs]e
warranty-disclaimer | 12 | 0.4 | warranty | without (?:any )?warranty of any kind
"""

#: Sentences of licence texts and of the notices that files carry.
SENTENCES = r"""
gpl-3.0 | 74 | 0.95 | copyleft license for software | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | 74 | 0.93 | freedom to share and change | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | 73 | 0.9 | anti circumvention | protecting users legal rights from anti circumvention law
gpl-2.0 | 66 | 0.85 | mere aggregation of another | mere aggregation of another work not based on the program with the program
gpl | 42 | 0.8 | you can redistribute it and or modify | this (?:program|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public
gpl | 41 | 0.75 | received a copy of the gnu general | you should have received a copy of the gnu general public licen[cs]e along with
lgpl | 46 | 0.85 | you can redistribute it and or modify | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public
lgpl | 46 | 0.8 | gnu lesser general | you should have received a copy of the gnu lesser general public licen[cs]e along with
lgpl-2.1 | 73 | 0.9 | first released version of the lesser | this is the first released version of the lesser gpl
lgpl-3.0 | 73 | 0.9 | combined work | convey a combined work under terms of your choice
agpl-3.0 | 74 | 0.9 | remote network interaction | remote network interaction use with the gnu general public license
agpl | 46 | 0.8 | affero | you should have received a copy of the gnu affero general public licen[cs]e along with
gfdl | 60 | 0.9 | invariant sections | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gpl-with-classpath | 82 | 0.93 | classpath | (?:with (?:the )?)?classpath exception(?: 2 0)?
gpl-with-font | 81 | 0.9 | font exception | font exception(?: 2 0)?
gpl-with-autoconf | 81 | 0.9 | autoconf | autoconf configure script output exception
gpl-with-gcc | 81 | 0.9 | gcc runtime | gcc runtime library exception(?: version 3 1)?
gpl-with-openssl | 80 | 0.88 | openssl | special exception .{0,60}?permission to link .{0,60}?openssl
linux-syscall-note | 80 | 0.9 | linux syscall note | linux syscall note
llvm-exception | 93 | 0.95 | llvm exception | (?:apache 2 0 )?with llvm exceptions?
apache-2.0 | 72 | 0.92 | you may not use this file except | you may not use this file except in compliance with the license
apache-2.0 | 71 | 0.9 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license
apache-2.0 | 71 | 0.9 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor
apache-1.1 | 71 | 0.88 | apache software foundation | this product includes software developed by the apache software foundation
mit | 69 | 0.95 | the above copyright notice and this | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 58 | 0.85 | without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit | 57 | 0.8 | out of or in connection | arising from out of or in connection with the software or the use or other dealings in the software
x11 | 71 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used
mit-modern | 62 | 0.8 | modern variant | mit license modern variant
hpnd | 66 | 0.8 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose
bsd | 56 | 0.85 | source code must retain | redistributions of source code must retain the above copyright notice
bsd | 55 | 0.85 | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | 54 | 0.75 | merchantability and fitness | the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd-3-clause-clear | 86 | 0.95 | clear bsd | (?:the )?(?:clear bsd|bsd 3 clause clear) license
bsd-2-clause-patent | 86 | 0.95 | patent | bsd 2 clause(?: plus)? patent(?: license)?
bsd-source-code | 70 | 0.8 | bsd source code | bsd source code attribution
isc | 66 | 0.88 | the author disclaims all | the author disclaims all warranties with regard to this software
zlib | 69 | 0.93 | must not be misrepresented | the origin of this software must not be misrepresented
zlib | 68 | 0.9 | altered source versions | altered source versions must be plainly marked as such
boost-1.0 | 72 | 0.93 | machine executable object code | works are solely in the form of machine executable object code generated by a source language processor
unlicense | 71 | 0.92 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | 72 | 0.9 | waives | (?:overtly fully permanently irrevocably and )?unconditionally waives abandons and surrenders
cc-by | 46 | 0.8 | creativecommons | creativecommons org licenses by
cc-by-sa | 62 | 0.88 | creativecommons | creativecommons org licenses by sa
cc-by-nc | 62 | 0.88 | creativecommons | creativecommons org licenses by nc
cc-pdm | 84 | 0.93 | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc-by-sa | 58 | 0.8 | attribution sharealike | attribution sharealike (?:international|unported|generic)
cc-by-nc | 58 | 0.75 | attribution noncommercial | attribution noncommercial (?:international|unported|generic)
mpl-2.0 | 82 | 0.96 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 70 | 0.85 | incompatible with secondary | incompatible with secondary licenses
mpl-1.1 | 80 | 0.93 | mozilla org mpl | (?:www )?mozilla org mpl mpl 1 1
mpl-2.0 | 80 | 0.95 | mozilla org mpl | mozilla org mpl 2 0
epl-1.0 | 80 | 0.93 | eclipse org legal | eclipse org legal epl v10
epl-2.0 | 80 | 0.93 | eclipse org legal | eclipse org legal epl (?:2 0|v20)
epl | 56 | 0.85 | program and the accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | 56 | 0.85 | cddl header start | cddl header start
artistic-2.0 | 72 | 0.9 | perlfoundation | perlfoundation org legal licenses artistic 2 0
artistic | 58 | 0.8 | artistic control | semblance of artistic control over the development of the package
python-2.0 | 70 | 0.85 | beopen | beopen python open source license agreement
ofl-1.1 | 72 | 0.92 | reserved font name | with reserved font names?
ofl-1.1 | 71 | 0.9 | scripts sil org | scripts sil org ofl
unicode | 72 | 0.9 | unicode inc license | unicode inc license agreement data files and software
openssl | 70 | 0.88 | openssl toolkit | developed by the openssl project for use in the openssl toolkit
odc-by-1.0 | 80 | 0.93 | opendatacommons | opendatacommons org licenses by 1 0
odbl-1.0 | 80 | 0.93 | opendatacommons | opendatacommons org licenses odbl 1 0
pddl-1.0 | 80 | 0.93 | opendatacommons | opendatacommons org licenses pddl 1 0
cdla-permissive | 82 | 0.93 | community data license | community data license agreement permissive(?: version [12] 0)?
cdla-sharing | 82 | 0.93 | community data license | community data license agreement sharing(?: version 1 0)?
blueoak-1.0.0 | 84 | 0.95 | blue oak | blue oak model license(?: 1 0 0)?
upl-1.0 | 82 | 0.93 | universal permissive | universal permissive license(?: v(?:ersion )?1 0)?
mulan-psl | 82 | 0.93 | mulan | mulan permissive software license(?: v(?:ersion )?2)?
cal-1.0 | 82 | 0.93 | cryptographic autonomy | cryptographic autonomy license(?: version 1 0)?
rpl | 78 | 0.9 | reciprocal public | reciprocal public license(?: 1 [15])?
cpal-1.0 | 82 | 0.93 | common public attribution | common public attribution license(?: version 1 0)?
parity | 80 | 0.9 | parity public | parity public license(?: 7 0 0)?
prosperity | 80 | 0.9 | prosperity public | prosperity public license(?: 3 0 0)?
ncgl-uk | 80 | 0.9 | non commercial government | non commercial government licen[cs]e
fal | 78 | 0.9 | free art license | free art license(?: 1 3)?
beerware | 80 | 0.93 | beer | (?:the )?beer ?ware license
hippocratic | 80 | 0.9 | hippocratic | hippocratic license(?: version)?(?: [123] [01])?
anti-996 | 80 | 0.9 | 996 license | anti 996 license
openmdw | 78 | 0.85 | open model | open model(?: data and)? (?:weights|data) license
gemma-terms | 78 | 0.85 | gemma terms | gemma terms of use
proprietary | 56 | 0.8 | trade secret | contains (?:confidential|proprietary)(?: and proprietary)? (?:information and )?trade secrets?
proprietary | 54 | 0.7 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 52 | 0.7 | express written | without (?:the )?(?:prior|express) written (?:permission|consent)
research-only | 54 | 0.75 | research purposes only | for (?:non commercial )?research purposes only
noncommercial | 52 | 0.7 | non commercial use only | for non commercial use only
"""


def _line(text: str) -> list[str]:
    return [x.strip() for x in text.split(" | ", 4)]


def _rule(label: str, priority: str, confidence: str, keyword: str, pattern: str) -> Rule:
    return Rule(label, int(priority), float(confidence), keyword.encode(), re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"))


def build_rules() -> list[Rule]:
    """All rules, by falling priority, then as written."""
    rules, versions = [], []
    for text in VERSIONED.strip().splitlines():
        if text.startswith("versions:"):
            versions = text.split()[1:]
            continue
        label, priority, confidence, keyword, pattern = _line(text)
        for v in versions:
            major, _, minor = v.partition(".")
            loose = major if minor == "0" else f"{major} {minor}"
            rules.append(_rule(
                label.replace("{v}", v), priority, confidence, keyword,
                pattern.replace("{v}", v.replace(".", " ")).replace("{m}", loose),
            ))
    rules += [_rule(*_line(text)) for text in [*PLAIN.strip().splitlines(), *SENTENCES.strip().splitlines()]]
    return sorted(rules, key=lambda r: -r.priority)


RULES = build_rules()

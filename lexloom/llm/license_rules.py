"""The ordered signature rules of operator 9: label | keyword | priority | regex.

Regexes run over lower-case words of digits, a-z and non-ASCII characters with one space
between them, so "Apache License, Version 2.0" reads "apache license version 2 0". A rule
is tried only where its keyword occurs. {V} is an optional "version" or "v"; {L} an
optional spelling of "licence"; {N} an end of a version number.
"""

RULES = r"""
mit | mit | 90 | (?:under|subject to|by) (?:the )?(?:terms of the )?mit {L}
mit | mit | 80 | mit licen[cs]ed?
mit | mit | 70 | licen[cs]e mit
mit | mit | 60 | the mit licen[cs]e mit
mit | mit | 60 | dual licensed under (?:the )?mit
mit | x11 | 60 | mit x11
mit-0 | mit | 85 | mit no attribution
mit-0 | mit | 85 | mit 0 licen[cs]e
mit | permission is hereby | 95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | without limitation the rights | 85 | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
x11 | x11 | 75 | x11 {L}
x11 | x consortium | 75 | x consortium licen[cs]e
expat | expat | 80 | expat licen[cs]e
apache-2 | apache | 95 | (?:under )?(?:the )?apache (?:software )?licen[cs]e {V}2(?: 0)?{N}
apache-2 | apache | 90 | apache 2(?: 0)? {L}
apache-2 | apache | 75 | apache {V}2 0{N}
apache-2 | apache | 95 | apache org licenses license 2 0
apache-1.1 | apache | 95 | apache (?:software )?licen[cs]e {V}1 1{N}
apache-1.0 | apache | 95 | apache (?:software )?licen[cs]e {V}1 0{N}
apache-1.1 | apache | 80 | apache 1 1 {L}
apache | apache | 50 | apache (?:software )?licen[cs]e
apache | apache | 50 | licensed to the apache software foundation
apache-2 | unless required by | 85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl-3 | general public | 95 | gnu general public licen[cs]e {V}3(?: 0)?{N}
gpl-2 | general public | 95 | gnu general public licen[cs]e {V}2(?: 0)?{N}
gpl-1 | general public | 95 | gnu general public licen[cs]e {V}1(?: 0)?{N}
gpl-3 | general public | 90 | {V}3(?: 0)?(?: or later)? of the gnu general public licen[cs]e
gpl-2 | general public | 90 | {V}2(?: 0)?(?: or later)? of the gnu general public licen[cs]e
gpl-3-or-later | general public | 97 | gnu general public licen[cs]e {V}3(?: 0)? or (?:at your option )?(?:any )?later
gpl-2-or-later | general public | 97 | gnu general public licen[cs]e {V}2(?: 0)? or (?:at your option )?(?:any )?later
gpl-3-or-later | general public | 97 | gnu general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-or-later | general public | 97 | gnu general public licen[cs]e as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2 | general public | 93 | gnu general public licen[cs]e as published by the free software foundation version 2
gpl-3 | general public | 93 | gnu general public licen[cs]e as published by the free software foundation version 3
gpl | general public | 50 | gnu general public licen[cs]e
gpl | general public | 30 | general public licen[cs]e
gpl-3-or-later | gpl | 92 | gpl {V}3(?: 0)? or later
gpl-2-or-later | gpl | 92 | gpl {V}2(?: 0)? or later
gpl-3-or-later | gplv3 | 92 | gplv3 or later
gpl-2-or-later | gplv2 | 92 | gplv2 or later
gpl-3 | gpl | 85 | gpl {V}3(?: 0)?{N}
gpl-2 | gpl | 85 | gpl {V}2(?: 0)?{N}
gpl-1 | gpl | 85 | gpl {V}1 0{N}
gpl-3 | gplv3 | 85 | gplv3
gpl-2 | gplv2 | 85 | gplv2
gpl-3 | gpl3 | 80 | gpl3
gpl-2 | gpl2 | 80 | gpl2
gpl | gpl | 40 | (?:the )?gnu gpl
gpl | gpl | 40 | under (?:the )?(?:terms of the )?gpl
gpl-2-classpath | classpath | 96 | classpath exception
gpl-gcc-exception | runtime library exception | 96 | gcc runtime library exception
gpl-font-exception | font exception | 96 | gpl font exception
gpl-linking-exception | linking exception | 96 | gpl (?:with )?linking exception
lgpl-3 | lesser | 95 | (?:gnu )?lesser general public licen[cs]e {V}3(?: 0)?{N}
lgpl-2.1 | lesser | 95 | (?:gnu )?lesser general public licen[cs]e {V}2 1{N}
lgpl-2 | lesser | 95 | (?:gnu )?lesser general public licen[cs]e {V}2(?: 0)?{N}
lgpl-2 | library general | 95 | (?:gnu )?library general public licen[cs]e {V}2(?: 0)?{N}
lgpl-3-or-later | lesser | 97 | lesser general public licen[cs]e {V}3(?: 0)? or (?:at your option )?(?:any )?later
lgpl-2.1-or-later | lesser | 97 | lesser general public licen[cs]e {V}2 1 or (?:at your option )?(?:any )?later
lgpl-2.1-or-later | lesser | 97 | lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later | lesser | 97 | lesser general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version
lgpl | lesser | 55 | (?:gnu )?lesser general public licen[cs]e
lgpl | library general | 55 | (?:gnu )?library general public licen[cs]e
lgpl-3 | lgpl | 85 | lgpl {V}3(?: 0)?{N}
lgpl-2.1 | lgpl | 88 | lgpl {V}2 1{N}
lgpl-2 | lgpl | 85 | lgpl {V}2(?: 0)?{N}
lgpl-3 | lgplv3 | 85 | lgplv3
lgpl-2.1 | lgplv2 | 88 | lgplv2 1
lgpl-2 | lgplv2 | 85 | lgplv2
lgpl | lgpl | 45 | lgpl
agpl-3 | affero | 95 | (?:gnu )?affero general public licen[cs]e {V}3(?: 0)?{N}
agpl-3-or-later | affero | 97 | affero general public licen[cs]e {V}3(?: 0)? or (?:at your option )?(?:any )?later
agpl-1 | affero | 95 | affero general public licen[cs]e {V}1(?: 0)?{N}
agpl | affero | 55 | (?:gnu )?affero general public licen[cs]e
agpl-3 | agpl | 85 | agpl {V}3(?: 0)?{N}
agpl-3 | agplv3 | 85 | agplv3
agpl | agpl | 45 | agpl
gfdl-1.3 | free documentation | 95 | gnu free documentation licen[cs]e {V}1 3{N}
gfdl-1.2 | free documentation | 95 | gnu free documentation licen[cs]e {V}1 2{N}
gfdl-1.1 | free documentation | 95 | gnu free documentation licen[cs]e {V}1 1{N}
gfdl | free documentation | 55 | gnu free documentation licen[cs]e
gfdl | gfdl | 45 | gfdl
bsd-2-clause | bsd | 90 | bsd 2 clause
bsd-2-clause | bsd | 90 | (?:2|two) clause bsd
bsd-2-clause | bsd | 90 | simplified bsd {L}
bsd-2-clause | bsd | 90 | freebsd licen[cs]e
bsd-3-clause | bsd | 90 | bsd 3 clause
bsd-3-clause | bsd | 90 | (?:3|three) clause bsd
bsd-3-clause | bsd | 90 | (?:new|revised|modified) bsd {L}
bsd-4-clause | bsd | 90 | bsd 4 clause
bsd-4-clause | bsd | 90 | (?:4|four) clause bsd
bsd-4-clause | bsd | 90 | (?:original|old) bsd licen[cs]e
0bsd | 0bsd | 90 | 0bsd
0bsd | bsd | 92 | (?:zero|0) clause bsd
bsd | bsd | 50 | bsd (?:style )?licen[cs]ed?
bsd | bsd | 45 | licen[cs]e bsd
bsd-3-clause | neither the name | 85 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd | redistribution and use | 80 | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | advertising materials | 88 | all advertising materials mentioning features or use of this software must display
isc | isc | 85 | isc licen[cs]ed?
isc | permission to use copy | 85 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | historical permission | 90 | historical permission notice and disclaimer
mpl-2 | mozilla | 95 | mozilla public licen[cs]e {V}2(?: 0)?{N}
mpl-1.1 | mozilla | 95 | mozilla public licen[cs]e {V}1 1{N}
mpl-1.0 | mozilla | 95 | mozilla public licen[cs]e {V}1 0{N}
mpl-2 | mozilla | 90 | subject to the terms of the mozilla public license v 2 0
mpl | mozilla | 50 | mozilla public licen[cs]e
mpl-2 | mpl | 85 | mpl {V}2(?: 0)?{N}
mpl-1.1 | mpl | 85 | mpl {V}1 1{N}
epl-2 | eclipse | 95 | eclipse public licen[cs]e {V}2(?: 0)?{N}
epl-1 | eclipse | 95 | eclipse public licen[cs]e {V}1(?: 0)?{N}
epl | eclipse | 50 | eclipse public licen[cs]e
edl-1 | eclipse | 90 | eclipse distribution licen[cs]e
epl-2 | epl | 85 | epl {V}2(?: 0)?{N}
epl-1 | epl | 85 | epl {V}1 0{N}
cddl-1.1 | common development | 95 | common development and distribution licen[cs]e {V}1 1{N}
cddl-1.0 | common development | 95 | common development and distribution licen[cs]e {V}1 0{N}
cddl | common development | 50 | common development and distribution licen[cs]e
cddl-1.0 | cddl | 85 | cddl {V}1 0{N}
cddl-1.1 | cddl | 85 | cddl {V}1 1{N}
cpl-1 | common public | 90 | common public licen[cs]e(?: {V}1 0)?
cpal-1 | common public attribution | 95 | common public attribution licen[cs]e
ipl-1 | ibm public | 90 | ibm public licen[cs]e
eupl-1.2 | european union public | 95 | european union public licen[cs]e {V}1 2{N}
eupl-1.1 | european union public | 95 | european union public licen[cs]e {V}1 1{N}
eupl | european union public | 50 | european union public licen[cs]e
eupl-1.2 | eupl | 85 | eupl {V}1 2{N}
eupl-1.1 | eupl | 85 | eupl {V}1 1{N}
ms-pl | microsoft public | 90 | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | 90 | microsoft reciprocal licen[cs]e
ms-pl | ms pl | 80 | ms pl licen[cs]e
osl-3 | open software | 95 | open software licen[cs]e {V}3(?: 0)?{N}
osl-2.1 | open software | 95 | open software licen[cs]e {V}2 1{N}
osl | open software | 50 | open software licen[cs]e
afl-3 | academic free | 95 | academic free licen[cs]e {V}3(?: 0)?{N}
afl-2.1 | academic free | 95 | academic free licen[cs]e {V}2 1{N}
afl | academic free | 50 | academic free licen[cs]e
artistic-2 | artistic | 95 | artistic licen[cs]e {V}2(?: 0)?{N}
artistic-1 | artistic | 95 | artistic licen[cs]e {V}1(?: 0)?{N}
artistic | artistic | 50 | (?:the )?artistic licen[cs]e
clarified-artistic | clarified artistic | 92 | clarified artistic licen[cs]e
perl | perl | 80 | same terms as perl(?: itself)?
python-2 | python | 85 | python software foundation licen[cs]e
python-2 | python | 80 | psf licen[cs]e
python-cnri | cnri | 85 | cnri python licen[cs]e
ruby | ruby | 75 | ruby licen[cs]e
php-3.01 | php | 90 | php licen[cs]e {V}3 01{N}
php-3 | php | 88 | php licen[cs]e {V}3(?: 0)?{N}
php | php | 50 | php licen[cs]e
zend-2 | zend | 85 | zend (?:engine )?licen[cs]e
zlib | zlib | 85 | zlib licen[cs]e
zlib | zlib | 85 | zlib libpng licen[cs]e
zlib | altered source versions | 85 | altered source versions must be plainly marked as such and must not be misrepresented
libpng | libpng | 80 | libpng licen[cs]e
boost-1 | boost | 95 | boost software licen[cs]e(?: {V}1 0)?
boost-1 | bsl | 75 | bsl 1 0
openssl | openssl | 85 | openssl (?:and ssleay )?licen[cs]e
ssleay | ssleay | 80 | (?:original )?ssleay licen[cs]e
curl | curl | 75 | curl licen[cs]e
ncsa | ncsa | 88 | university of illinois ncsa open source licen[cs]e
ncsa | ncsa | 80 | ncsa licen[cs]e
w3c | w3c | 85 | w3c (?:software )?(?:notice and )?licen[cs]e
w3c | w3c | 80 | w3c document licen[cs]e
unicode | unicode | 80 | unicode (?:inc )?licen[cs]e(?: agreement)?
icu | icu | 75 | icu licen[cs]e
unlicense | unlicense | 90 | (?:the )?unlicense
unlicense | released into the public | 92 | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | 85 | wtfpl
wtfpl | what the fuck | 90 | do what the fuck you want to public licen[cs]e
beerware | beer | 80 | beer ?ware licen[cs]e
postgresql | postgresql | 85 | postgresql licen[cs]e
sqlite-blessing | may you do good | 85 | may you do good and not evil
json | good not evil | 90 | shall be used for good not evil
vim | vim | 75 | vim licen[cs]e
tcl | tcl | 70 | tcl tk licen[cs]e
ofl-1.1 | open font | 92 | sil open font licen[cs]e(?: {V}1 1)?
ofl-1.0 | open font | 95 | sil open font licen[cs]e {V}1 0{N}
ofl | open font | 60 | open font licen[cs]e
bitstream-vera | bitstream | 80 | bitstream vera (?:fonts )?(?:copyright|licen[cs]e)
ijg | independent jpeg | 80 | independent jpeg group
freetype | freetype | 80 | freetype (?:project )?licen[cs]e
imagemagick | imagemagick | 80 | imagemagick licen[cs]e
lpl | lucent | 80 | lucent public licen[cs]e
qpl-1 | q public | 85 | q public licen[cs]e
sleepycat | sleepycat | 85 | sleepycat licen[cs]e
watcom | watcom | 80 | sybase open watcom public licen[cs]e
apsl-2 | apple public | 90 | apple public source licen[cs]e(?: {V}2(?: 0)?)?
spl-1 | sun public | 85 | sun public licen[cs]e
sissl | sun industry | 85 | sun industry standards source licen[cs]e
npl-1.1 | netscape | 85 | netscape public licen[cs]e
nokia | nokia | 75 | nokia open source licen[cs]e
rpl-1.5 | reciprocal public | 85 | reciprocal public licen[cs]e
rpsl-1 | realnetworks | 85 | realnetworks public source licen[cs]e
cecill-2.1 | cecill | 90 | cecill(?: free software)?(?: licen[cs]e)? {V}2 1{N}
cecill-2 | cecill | 88 | cecill(?: free software)?(?: licen[cs]e)? {V}2(?: 0)?{N}
cecill-b | cecill | 88 | cecill b
cecill-c | cecill | 88 | cecill c
cecill | cecill | 50 | cecill
upl-1 | universal permissive | 90 | universal permissive licen[cs]e
bluoak-1 | blue oak | 90 | blue oak model licen[cs]e
mulan-psl-2 | mulan | 90 | mulan (?:psl|permissive software licen[cs]e)(?: {V}2)?
liliq-p | liliq | 85 | liliq p
liliq-r | liliq | 85 | liliq r
nasa-1.3 | nasa | 85 | nasa open source agreement
sspl-1 | server side public | 92 | server side public licen[cs]e(?: {V}1)?
bsl-1.1 | business source | 92 | business source licen[cs]e(?: {V}1 1)?
elastic-2 | elastic | 88 | elastic licen[cs]e(?: {V}2(?: 0)?)?
commons-clause | commons clause | 90 | commons clause(?: licen[cs]e condition)?
polyform-nc | polyform | 90 | polyform noncommercial licen[cs]e
polyform-sb | polyform | 90 | polyform small business licen[cs]e
confluent-1 | confluent | 85 | confluent community licen[cs]e
rail | responsible ai | 85 | (?:open )?responsible ai licen[cs]e
rail | openrail | 80 | (?:bigscience |creativeml )?openrail ?m?
llama | llama | 80 | llama (?:2 |3 |3 1 )?community licen[cs]e
gemma | gemma | 75 | gemma terms of use
cc-by-nc-nd | creative commons | 96 | creative commons attribution non ?commercial no ?deriv(?:ative|s|atives|ative works)?
cc-by-nc-sa | creative commons | 96 | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | 94 | creative commons attribution non ?commercial
cc-by-nd | creative commons | 94 | creative commons attribution no ?deriv(?:ative|s|atives|ative works)?
cc-by-sa | creative commons | 94 | creative commons attribution share ?alike
cc-by | creative commons | 92 | creative commons attribution
cc0 | creative commons | 94 | creative commons (?:zero|cc0|0)
cc-pd-mark | creative commons | 90 | creative commons public domain mark
cc | creative commons | 40 | creative commons(?: licen[cs]e)?
cc-by-nc-nd | cc by | 92 | cc by nc nd(?: \d 0)?
cc-by-nc-sa | cc by | 92 | cc by nc sa(?: \d 0)?
cc-by-nc | cc by | 90 | cc by nc(?: \d 0)?
cc-by-nd | cc by | 90 | cc by nd(?: \d 0)?
cc-by-sa | cc by | 90 | cc by sa(?: \d 0)?
cc-by | cc by | 85 | cc by(?: \d 0)?
cc0 | cc0 | 88 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | creativecommons org | 93 | creativecommons org licenses by nc nd \d 0
cc-by-nc-sa | creativecommons org | 93 | creativecommons org licenses by nc sa \d 0
cc-by-nc | creativecommons org | 91 | creativecommons org licenses by nc \d 0
cc-by-nd | creativecommons org | 91 | creativecommons org licenses by nd \d 0
cc-by-sa | creativecommons org | 91 | creativecommons org licenses by sa \d 0
cc-by | creativecommons org | 89 | creativecommons org licenses by \d 0
cc0 | creativecommons org | 91 | creativecommons org publicdomain zero
odbl-1 | open database | 92 | open (?:data commons open )?database licen[cs]e
odbl-1 | odbl | 85 | odbl
odc-by-1 | open data commons | 92 | open data commons attribution licen[cs]e
pddl-1 | public domain dedication | 92 | public domain dedication and licen[cs]e
cdla-permissive | community data | 90 | community data licen[cs]e agreement permissive
cdla-sharing | community data | 90 | community data licen[cs]e agreement sharing
ogl-uk-3 | open government | 90 | open government licen[cs]e(?: {V}3(?: 0)?)?
etalab-2 | etalab | 85 | (?:etalab )?licence ouverte(?: {V}2(?: 0)?)?
dl-de-by-2 | datenlizenz | 85 | datenlizenz deutschland namensnennung
public-domain | public domain | 60 | (?:placed|released|dedicated|is) (?:in|into|to) the public domain
public-domain | public domain | 55 | this work is in the public domain
public-domain | domaine public | 55 | dans le domaine public
public-domain | gemeinfrei | 50 | gemeinfrei
public-domain | dominio p | 50 | de dominio público
proprietary | all rights | 60 | all rights reserved
proprietary | alle rechte | 60 | alle rechte vorbehalten
proprietary | tous droits | 60 | tous droits réservés
proprietary | todos los derechos | 60 | todos los derechos reservados
proprietary | proprietary | 65 | proprietary and confidential
proprietary | confidential | 60 | confidential and proprietary
proprietary | without the express | 60 | without the express written (?:permission|consent) of
proprietary | may not be reproduced | 60 | may not be reproduced (?:or distributed )?(?:in any form )?without
commercial | commercial | 60 | commercial licen[cs]e (?:agreement|is required|required)
eula | end user | 70 | end user licen[cs]e agreement
noncommercial | non | 55 | for non ?commercial (?:use|purposes) only
noncommercial | personal use | 50 | for personal use only
research-only | research | 55 | for research (?:use|purposes) only
spdx-mit | spdx | 98 | spdx license identifier mit
spdx-apache-2 | spdx | 98 | spdx license identifier apache 2 0
spdx-gpl-2 | spdx | 98 | spdx license identifier gpl 2 0(?: only| or later)?
spdx-gpl-3 | spdx | 98 | spdx license identifier gpl 3 0(?: only| or later)?
spdx-lgpl-2.1 | spdx | 98 | spdx license identifier lgpl 2 1(?: only| or later)?
spdx-lgpl-3 | spdx | 98 | spdx license identifier lgpl 3 0(?: only| or later)?
spdx-agpl-3 | spdx | 98 | spdx license identifier agpl 3 0(?: only| or later)?
spdx-bsd-2-clause | spdx | 98 | spdx license identifier bsd 2 clause
spdx-bsd-3-clause | spdx | 98 | spdx license identifier bsd 3 clause
spdx-mpl-2 | spdx | 98 | spdx license identifier mpl 2 0
spdx-isc | spdx | 98 | spdx license identifier isc
spdx-epl-2 | spdx | 98 | spdx license identifier epl 2 0
spdx-unlicense | spdx | 98 | spdx license identifier unlicense
spdx-other | spdx | 58 | spdx license identifier [a-z0-9]+
freeware | freeware | 45 | (?:is|distributed as) freeware
shareware | shareware | 45 | (?:is|distributed as) shareware
copyleft | copyleft | 40 | copyleft licen[cs]ed?
open-source | open source | 30 | released under an open source licen[cs]e
unknown | licen[cs]e | 10 | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?[a-z0-9]+ (?:[a-z0-9]+ ){0,3}?licen[cs]e
unknown | see the | 10 | see the licen[cs]e file
warranty-disclaimer | without warranty | 15 | without warranty of any kind(?: express or implied)?
warranty-disclaimer | as is | 12 | provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
warranty-disclaimer | merchantability | 12 | warranties of merchantability
"""

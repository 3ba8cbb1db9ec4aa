"""Signature rules of the license scan.

One rule a line: label, priority, gate, expression.  Expressions are matched on a
text's lower-cased words joined by single spaces; ``gate`` is a word that every
match holds, and the rule runs only on texts that hold it.  ``{v}`` in a label is
the version that the expression's group found, its words joined by dots.
Higher priority wins where one detection contains another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The contract's phrases; they are counted wherever they stand and never suppressed.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

V = r"(?: (?:version |v )?v?(\d(?: \d)?))?"
_L = r"(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered|shared)(?: to you)? under(?: the)?(?: terms of)?(?: the)?"

SIGNATURES = f"""
cc-by-nc-nd-{{v}} | 95 | cc | \\bcc by nc nd{V}\\b
cc-by-nc-sa-{{v}} | 95 | cc | \\bcc by nc sa{V}\\b
cc-by-nc-{{v}} | 90 | cc | \\bcc by nc{V}\\b
cc-by-nd-{{v}} | 90 | cc | \\bcc by nd{V}\\b
cc-by-sa-{{v}} | 90 | cc | \\bcc by sa{V}\\b
cc-by-{{v}} | 85 | cc | \\bcc by (?:version |v )?v?(\\d(?: \\d)?)\\b
cc0-{{v}} | 90 | cc0 | \\bcc0{V}\\b
cc0-{{v}} | 90 | zero | \\bcc zero{V}\\b
cc0-{{v}} | 92 | cc0 | \\bcreative commons cc0{V}\\b
cc0 | 92 | cc0 | \\bcc0 public domain dedication\\b
cc-by-nc-nd-{{v}} | 95 | attribution | \\battribution non ?commercial no ?deriv(?:ative)?s(?: works)?{V}\\b
cc-by-nc-sa-{{v}} | 95 | attribution | \\battribution non ?commercial share ?alike{V}\\b
cc-by-nc-{{v}} | 90 | attribution | \\bcreative commons attribution non ?commercial{V}\\b
cc-by-nd-{{v}} | 90 | attribution | \\bcreative commons attribution no ?deriv(?:ative)?s{V}\\b
cc-by-sa-{{v}} | 90 | attribution | \\bcreative commons attribution share ?alike{V}\\b
cc-by-{{v}} | 80 | attribution | \\bcreative commons attribution{V}\\b
cc-by-{{v}} | 80 | attribution | \\bcreative commons attribution licen[sc]e{V}\\b
cc-by-{{v}} | 88 | creativecommons | \\bcreativecommons org licenses by (\\d \\d)\\b
cc-by-sa-{{v}} | 93 | creativecommons | \\bcreativecommons org licenses by sa (\\d \\d)\\b
cc-by-nc-{{v}} | 93 | creativecommons | \\bcreativecommons org licenses by nc (\\d \\d)\\b
cc-by-nd-{{v}} | 93 | creativecommons | \\bcreativecommons org licenses by nd (\\d \\d)\\b
cc-by-nc-sa-{{v}} | 96 | creativecommons | \\bcreativecommons org licenses by nc sa (\\d \\d)\\b
cc-by-nc-nd-{{v}} | 96 | creativecommons | \\bcreativecommons org licenses by nc nd (\\d \\d)\\b
cc0-{{v}} | 93 | creativecommons | \\bcreativecommons org publicdomain zero (\\d \\d)\\b
cc-pd-mark | 93 | creativecommons | \\bcreativecommons org publicdomain mark \\d \\d\\b
cc-unspecified | 40 | creative | \\bcreative commons licen[sc]e\\b
cc-unspecified | 30 | creative | \\blicen[sc]ed under creative commons\\b
cc-sampling | 85 | sampling | \\bcreative commons sampling plus\\b
cc-devnations | 85 | developing | \\bcreative commons developing nations\\b
gpl-{{v}}-or-later | 96 | gnu | \\bgnu general public licen[sc]e as published by the free software foundation either version (\\d) of the licen[sc]e or at your option any later\\b
gpl-{{v}} | 94 | gnu | \\bgnu general public licen[sc]e(?: as published by the free software foundation)?(?: (?:version|v)) (\\d)\\b
gpl-{{v}} | 88 | general | \\bgeneral public licen[sc]e (?:version |v )(\\d)\\b
gpl | 80 | gnu | \\bgnu general public licen[sc]e\\b
gpl | 60 | general | \\bgeneral public licen[sc]e\\b
gpl-{{v}} | 86 | gpl | \\bgpl ?(?:version |v )(\\d)\\b
gpl-{{v}} | 86 | gplv2 | \\bgplv(2)\\b
gpl-{{v}} | 86 | gplv3 | \\bgplv(3)\\b
gpl-{{v}}-or-later | 91 | gpl | \\bgpl (\\d) 0 or later\\b
gpl-{{v}}-only | 91 | gpl | \\bgpl (\\d) 0 only\\b
gpl | 50 | gpl | \\bunder the gpl\\b
gpl | 55 | gnu | \\bgnu gpl\\b
gpl-{{v}} | 90 | gnu | \\bgnu org licenses gpl (\\d) 0\\b
gpl-classpath | 97 | classpath | \\bgpl(?: \\S+){{0,4}} with(?: the)? classpath exception\\b
lgpl-{{v}} | 95 | lesser | \\b(?:gnu )?lesser general public licen[sc]e{V}\\b
lgpl-{{v}} | 95 | library | \\b(?:gnu )?library general public licen[sc]e{V}\\b
lgpl-{{v}} | 88 | lgpl | \\blgpl{V}\\b
lgpl-{{v}} | 90 | lgplv2 | \\blgplv(2(?: 1)?)\\b
lgpl-{{v}} | 90 | lgplv3 | \\blgplv(3)\\b
lgpl-{{v}}-or-later | 93 | lgpl | \\blgpl (\\d \\d) or later\\b
lgpl | 50 | lgpl | \\bunder the lgpl\\b
agpl-{{v}} | 96 | affero | \\b(?:gnu )?affero general public licen[sc]e{V}\\b
agpl-{{v}} | 90 | agpl | \\bagpl{V}\\b
agpl-{{v}} | 91 | agplv3 | \\bagplv(3)\\b
agpl-{{v}}-or-later | 94 | agpl | \\bagpl (\\d) 0 or later\\b
gfdl-{{v}} | 95 | documentation | \\b(?:gnu )?free documentation licen[sc]e{V}\\b
gfdl-{{v}} | 90 | gfdl | \\bgfdl{V}\\b
gfdl-invariants | 96 | invariant | \\bwith no invariant sections no front cover texts\\b
gpl-notice | 85 | warranty | \\bthis program is distributed in the hope that it will be useful but without any warranty\\b
gpl-notice | 84 | redistribute | \\bthis program is free software you can redistribute it and or modify it under the terms of the gnu\\b
gpl-notice | 83 | gnu | \\byou should have received a copy of the gnu general public licen[sc]e\\b
lgpl-notice | 86 | lesser | \\byou should have received a copy of the gnu lesser general public licen[sc]e\\b
agpl-notice | 87 | affero | \\byou should have received a copy of the gnu affero general public licen[sc]e\\b
apache-{{v}} | 95 | apache | \\bapache (?:software )?licen[sc]e version (\\d(?: \\d)?)\\b
apache-{{v}} | 94 | apache | \\b{_L} apache licen[sc]e{V}\\b
apache-{{v}} | 90 | apache | \\bapache (?:licen[sc]e )?(\\d \\d)\\b
apache-{{v}} | 90 | apache | \\bapache org licenses license (\\d \\d)\\b
apache | 60 | apache | \\bapache (?:software )?licen[sc]e\\b
apache-notice | 80 | apache | \\byou may not use this file except in compliance with the license(?=.{{0,400}}apache)
apache-asf | 70 | apache | \\blicensed to the apache software foundation\\b
apache-llvm | 97 | llvm | \\bapache(?: licen[sc]e)?(?: \\S+){{0,4}} with llvm exceptions?\\b
mit | 95 | mit | \\b{_L} mit licen[sc]e\\b
mit | 85 | mit | \\bmit licen[sc]ed?\\b
mit | 88 | mit | \\bthe mit licen[sc]e mit\\b
mit | 90 | mit | \\bopensource org licenses mit\\b
mit | 82 | permission | \\bpermission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files\\b
mit | 81 | permission | \\bthe above copyright notice and this permission notice shall be included in all copies\\b
mit-0 | 96 | mit | \\bmit no attribution\\b
mit-modern | 96 | mit | \\bmit licen[sc]e modern variant\\b
x11 | 88 | x11 | \\bx11 licen[sc]e\\b
expat | 88 | expat | \\bexpat licen[sc]e\\b
mit-advert | 87 | mit | \\bmit licen[sc]e with advertising\\b
mit-warranty | 70 | merchantability | \\bthe software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability\\b
bsd-2-clause | 94 | bsd | \\bbsd 2 clause\\b
bsd-2-clause | 94 | bsd | \\b2 clause bsd\\b
bsd-2-clause | 92 | bsd | \\bsimplified bsd\\b
bsd-2-clause | 92 | bsd | \\btwo clause bsd\\b
bsd-2-clause | 90 | freebsd | \\bfreebsd licen[sc]e\\b
bsd-3-clause | 94 | bsd | \\bbsd 3 clause\\b
bsd-3-clause | 94 | bsd | \\b3 clause bsd\\b
bsd-3-clause | 92 | bsd | \\bnew bsd\\b
bsd-3-clause | 92 | bsd | \\bmodified bsd\\b
bsd-3-clause | 92 | bsd | \\brevised bsd\\b
bsd-3-clause | 92 | bsd | \\bthree clause bsd\\b
bsd-3-clause | 84 | endorse | \\bnor the names of its contributors may be used to endorse or promote products\\b
bsd-4-clause | 94 | bsd | \\bbsd 4 clause\\b
bsd-4-clause | 92 | bsd | \\b(?:original|old) bsd\\b
bsd-4-clause | 86 | advertising | \\ball advertising materials mentioning features or use of this software must display\\b
bsd-0-clause | 94 | bsd | \\b(?:0 clause bsd|zero clause bsd|bsd zero clause)\\b
0bsd | 90 | 0bsd | \\b0bsd\\b
bsd-patent | 96 | patent | \\bbsd 2 clause plus patent\\b
bsd-clear | 96 | clear | \\bbsd 3 clause clear\\b
bsd | 70 | bsd | \\bbsd(?: style)? licen[sc]e\\b
bsd | 72 | bsd | \\b{_L} bsd\\b
bsd-notice | 68 | redistributions | \\bredistributions of source code must retain the above copyright notice\\b
bsd-notice | 68 | redistributions | \\bredistributions in binary form must reproduce the above copyright notice\\b
bsd-notice | 67 | redistribution | \\bredistribution and use in source and binary forms with or without modification are permitted\\b
mpl-{{v}} | 95 | mozilla | \\bmozilla public licen[sc]e{V}\\b
mpl-{{v}} | 88 | mpl | \\bmpl{V}\\b
mpl-{{v}} | 90 | mozilla | \\bmozilla org mpl (\\d \\d)\\b
mpl-notice | 85 | mozilla | \\bthis source code form is subject to the terms of the mozilla public licen[sc]e\\b
mpl-incompatible | 96 | incompatible | \\bincompatible with secondary licenses\\b
epl-{{v}} | 95 | eclipse | \\beclipse public licen[sc]e{V}\\b
epl-{{v}} | 88 | epl | \\bepl{V}\\b
edl | 92 | eclipse | \\beclipse distribution licen[sc]e\\b
cpl-{{v}} | 90 | common | \\bcommon public licen[sc]e{V}\\b
cddl-{{v}} | 92 | cddl | \\bcddl{V}\\b
cddl-{{v}} | 95 | development | \\bcommon development and distribution licen[sc]e{V}\\b
cpal-{{v}} | 92 | attribution | \\bcommon public attribution licen[sc]e{V}\\b
isc | 92 | isc | \\bisc licen[sc]ed?\\b
isc | 80 | permission | \\bpermission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted\\b
zlib | 92 | zlib | \\bzlib(?: libpng)? licen[sc]e\\b
zlib | 80 | misrepresented | \\bthe origin of this software must not be misrepresented\\b
libpng | 90 | libpng | \\blibpng licen[sc]e\\b
boost-{{v}} | 95 | boost | \\bboost software licen[sc]e{V}\\b
bsl-{{v}} | 92 | bsl | \\bbsl (\\d \\d)\\b
busl-{{v}} | 95 | business | \\bbusiness source licen[sc]e{V}\\b
sspl-{{v}} | 95 | server | \\bserver side public licen[sc]e{V}\\b
sspl | 88 | sspl | \\bsspl\\b
elastic-{{v}} | 95 | elastic | \\belastic licen[sc]e{V}\\b
commons-clause | 95 | commons | \\bcommons clause (?:licen[sc]e )?condition\\b
polyform-nc | 95 | polyform | \\bpolyform noncommercial\\b
polyform-sb | 95 | polyform | \\bpolyform small business\\b
polyform | 85 | polyform | \\bpolyform licen[sc]e\\b
prosperity | 90 | prosperity | \\bprosperity public licen[sc]e\\b
parity | 90 | parity | \\bparity public licen[sc]e\\b
unlicense | 95 | unlicense | \\bthe unlicense\\b
unlicense | 92 | unlicense | \\bunlicense org\\b
unlicense | 88 | unencumbered | \\bfree and unencumbered software released into the public domain\\b
wtfpl | 92 | wtfpl | \\bwtfpl\\b
wtfpl | 95 | want | \\bdo what the f\\S* you want to public licen[sc]e\\b
artistic-{{v}} | 95 | artistic | \\bartistic licen[sc]e{V}\\b
artistic-perl | 96 | perl | \\bsame terms as perl itself\\b
python-{{v}} | 95 | python | \\bpython software foundation licen[sc]e{V}\\b
psf | 90 | psf | \\bpsf licen[sc]e\\b
php-{{v}} | 92 | php | \\bphp licen[sc]e{V}\\b
ruby | 90 | ruby | \\bruby licen[sc]e\\b
openssl | 92 | openssl | \\bopenssl licen[sc]e\\b
openldap | 92 | openldap | \\bopenldap public licen[sc]e\\b
postgresql | 92 | postgresql | \\bpostgresql licen[sc]e\\b
ncsa | 95 | ncsa | \\buniversity of illinois ncsa open source licen[sc]e\\b
ncsa | 88 | ncsa | \\bncsa licen[sc]e\\b
afl-{{v}} | 92 | academic | \\bacademic free licen[sc]e{V}\\b
osl-{{v}} | 92 | open | \\bopen software licen[sc]e{V}\\b
ms-pl | 92 | microsoft | \\bmicrosoft public licen[sc]e\\b
ms-rl | 92 | microsoft | \\bmicrosoft reciprocal licen[sc]e\\b
ms-lpl | 92 | microsoft | \\bmicrosoft limited public licen[sc]e\\b
eupl-{{v}} | 95 | european | \\beuropean union public licen[sc]e{V}\\b
eupl-{{v}} | 90 | eupl | \\beupl{V}\\b
cecill-{{v}} | 92 | cecill | \\bcecill(?: [bc])?{V}\\b
ecl-{{v}} | 92 | educational | \\beducational community licen[sc]e{V}\\b
upl-{{v}} | 92 | universal | \\buniversal permissive licen[sc]e{V}\\b
blueoak-{{v}} | 92 | oak | \\bblue oak model licen[sc]e{V}\\b
mulan-psl-{{v}} | 92 | mulan | \\bmulan permissive software licen[sc]e{V}\\b
mulan-publ-{{v}} | 92 | mulan | \\bmulan public licen[sc]e{V}\\b
ofl-{{v}} | 95 | font | \\b(?:sil )?open font licen[sc]e{V}\\b
ofl-{{v}} | 90 | ofl | \\bofl{V}\\b
font-exception | 85 | embedding | \\bfont embedding exception\\b
ubuntu-font-{{v}} | 92 | ubuntu | \\bubuntu font licen[sc]e{V}\\b
bitstream-vera | 90 | vera | \\bbitstream vera\\b(?=.{{0,200}}copyright)
odbl-{{v}} | 95 | database | \\bopen database licen[sc]e{V}\\b
odbl-{{v}} | 90 | odbl | \\bodbl{V}\\b
odc-by-{{v}} | 95 | commons | \\bopen data commons attribution licen[sc]e{V}\\b
pddl-{{v}} | 95 | dedication | \\bpublic domain dedication and licen[sc]e{V}\\b
pddl-{{v}} | 90 | pddl | \\bpddl{V}\\b
ogl-{{v}} | 92 | government | \\bopen government licen[sc]e{V}\\b
cdla-permissive-{{v}} | 95 | permissive | \\bcommunity data licen[sc]e agreement permissive{V}\\b
cdla-sharing-{{v}} | 95 | sharing | \\bcommunity data licen[sc]e agreement sharing{V}\\b
etalab-{{v}} | 92 | etalab | \\b(?:licence ouverte )?etalab{V}\\b
dl-de-by-{{v}} | 92 | datenlizenz | \\bdatenlizenz deutschland namensnennung{V}\\b
dl-de-zero-{{v}} | 92 | datenlizenz | \\bdatenlizenz deutschland zero{V}\\b
open-game-{{v}} | 90 | open | \\bopen gam(?:e|ing) licen[sc]e{V}\\b
free-art-{{v}} | 92 | art | \\b(?:free art licen[sc]e|licence art libre){V}\\b
artlibre | 90 | lal | \\blal (\\d \\d)\\b
design-science | 90 | design | \\bdesign science licen[sc]e\\b
open-publication | 90 | publication | \\bopen publication licen[sc]e\\b
openrail-m | 95 | openrail | \\b(?:creativeml )?openrail m\\b
openrail | 88 | openrail | \\bopenrail\\b
bigscience-rail-{{v}} | 95 | rail | \\brail licen[sc]e{V}\\b
public-domain | 80 | domain | \\b(?:released|dedicated|placed|put) (?:in|in ?to|to) the public domain\\b
public-domain | 78 | domain | \\bthis (?:work|file|software|document) is in the public domain\\b
public-domain | 60 | domain | \\bpublic domain dedication\\b
public-domain-us-gov | 85 | government | \\bworks? of the (?:united states|u s|us) government\\b
copyleft-next-{{v}} | 92 | copyleft | \\bcopyleft next{V}\\b
copyleft | 50 | copyleft | \\bstrong copyleft licen[sc]e\\b
beerware | 92 | beerware | \\bbeerware(?: licen[sc]e)?\\b
beerware | 90 | beer | \\byou can buy me a beer in return\\b
json-good-not-evil | 92 | evil | \\bthe software shall be used for good not evil\\b
hippocratic-{{v}} | 92 | hippocratic | \\bhippocratic licen[sc]e{V}\\b
anti-996 | 92 | 996 | \\banti 996 licen[sc]e\\b
vim | 90 | vim | \\bvim licen[sc]e\\b
tcl | 88 | tcl | \\btcl tk licen[sc]e\\b
w3c | 90 | w3c | \\bw3c (?:software|document)(?: notice and)? licen[sc]e\\b
unicode | 90 | unicode | \\bunicode licen[sc]e(?: agreement)?\\b
icu | 90 | icu | \\bicu licen[sc]e\\b
curl | 88 | curl | \\bcurl licen[sc]e\\b
naist | 88 | naist | \\bnaist licen[sc]e\\b
sleepycat | 90 | sleepycat | \\bsleepycat licen[sc]e\\b
qpl-{{v}} | 90 | q | \\bq public licen[sc]e{V}\\b
spl-{{v}} | 90 | sun | \\bsun public licen[sc]e{V}\\b
apsl-{{v}} | 90 | apple | \\bapple public source licen[sc]e{V}\\b
ipl-{{v}} | 90 | ibm | \\bibm public licen[sc]e{V}\\b
npl-{{v}} | 90 | netscape | \\bnetscape public licen[sc]e{V}\\b
rpl-{{v}} | 90 | reciprocal | \\breciprocal public licen[sc]e{V}\\b
lppl-{{v}} | 92 | latex | \\blatex project public licen[sc]e{V}\\b
lppl-{{v}} | 90 | lppl | \\blppl{V}\\b
wxwindows | 90 | wxwindows | \\bwxwindows library licen[sc]e\\b
nasa-{{v}} | 90 | nasa | \\bnasa open source agreement{V}\\b
simpl | 88 | simple | \\bsimple public licen[sc]e\\b
zope-{{v}} | 90 | zope | \\bzope public licen[sc]e{V}\\b
ecma-text | 85 | ecma | \\becma text copyright policy\\b
ietf-trust | 88 | ietf | \\bietf trust(?: s)? legal provisions\\b
proprietary | 85 | proprietary | \\bproprietary and confidential\\b
proprietary | 80 | unauthorized | \\bunauthorized (?:copying|reproduction|distribution)(?: or \\S+)? (?:of this \\S+ )?is (?:strictly )?prohibited\\b
proprietary | 78 | reproduced | \\bno part of this (?:publication|book|work|document) may be reproduced\\b
proprietary | 75 | permission | \\b(?:used|reproduced|reprinted) (?:with|by) permission\\b
proprietary | 76 | written | \\bwithout the (?:prior )?(?:express )?written permission of\\b
noncommercial | 70 | commercial | \\bfor non ?commercial use only\\b
noncommercial | 70 | noncommercial | \\bfor noncommercial use only\\b
personal-use | 70 | personal | \\bfor personal use only\\b
evaluation-only | 70 | evaluation | \\bfor evaluation purposes only\\b
reserved | 60 | reserved | \\ball rights reserved\\b
reserved | 62 | reserved | \\ball other rights reserved\\b
reserved-some | 62 | reserved | \\bsome rights reserved\\b
copyright-notice | 40 | copyright | \\bcopyright (?:c )?(?:19|20)\\d\\d\\b
copyright-notice | 42 | copyright | \\bcopyright (?:c )?(?:19|20)\\d\\d (?:19|20)\\d\\d\\b
spdx-{{v}} | 98 | spdx | \\bspdx license identifier (\\w+(?: \\d(?: \\d)?)?)\\b
license-file | 45 | license | \\bsee the (?:accompanying )?license (?:file|txt|md)\\b
license-file | 45 | license | \\bsee license in the project root\\b
eula | 75 | eula | \\bend user licen[sc]e agreement\\b(?=.{{0,200}}eula)
eula | 74 | user | \\bend user licen[sc]e agreement\\b
dual | 65 | dual | \\bdual licen[sc]ed under\\b
open-source-other | 30 | licensed | \\blicensed under an? open source licen[sc]e\\b
terms-of-use | 35 | terms | \\bsubject to (?:the|our) terms of (?:use|service)\\b
"""


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    gate: str
    pattern: re.Pattern
    base: bool = False


def signatures() -> list[Signature]:
    """All rules in order: the contract's phrases, then the table."""
    out = [Signature(label, 60, phrase.split()[0], re.compile(rf"\b{phrase}\b"), True) for phrase, label in BASE.items()]
    for line in SIGNATURES.strip().split("\n"):
        label, priority, gate, pattern = line.split(" | ", 3)
        out.append(Signature(label, int(priority), gate, re.compile(pattern)))
    return out

"""Signatures of licences, one rule a line: label, priority, keywords, pattern.

A pattern is a regular expression over normal words (lower case, letters and digits, one blank
between words), and matches whole words. A rule is tried only where one of its keywords stands in
the text as a word; that is part of what a rule says. Priority: 3 names
one licence in one version, 2 a licence or a family, 1 says only that terms exist.

Fragments: {v} an optional word for version, {l} license in both spellings, {z} an optional
zero behind a version number, {later} a clause that allows later versions.
"""

from __future__ import annotations

FRAGMENTS = {"v": "(?:version |ver |v(?: )?)?", "l": "licen[cs]e", "z": "(?: 0)?", "later": "(?: or(?: at your option)?(?: any)? later(?: version)?| and later| plus)"}

#: Fixed values.
RULES = r"""
apache-1.0 | 3 | apache | apache(?: software)?(?: {l})? {v}1 0
apache-1.1 | 3 | apache | apache(?: software)?(?: {l})? {v}1 1
apache-2.0 | 3 | apache | apache(?: software)?(?: {l})? {v}2{z}
apache-2.0 | 3 | apache | apache org {l}s? {l} 2 0(?: txt| html)?
apache-2.0 | 3 | asl | asl {v}2{z}
apache | 2 | apache | apache(?: software)? {l}
apache | 2 | apache | licensed to the apache software foundation
apache | 2 | apache | developed by the apache (?:group|software foundation)
apache-style | 2 | apache | apache (?:style|like) {l}
mit | 3 | mit | (?:the )?mit {l}
mit | 3 | mit | {l} mit
mit | 3 | mit | mit licensed
mit | 3 | mit | licensed under(?: the)?(?: terms of the)? mit
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | noninfringement | fitness for a particular purpose and noninfringement
mit-0 | 3 | mit | mit (?:0|no attribution)(?: {l})?
mit-style | 2 | mit | mit (?:style|like|type)(?: {l})?
mit-advertising | 3 | mit | mit(?: {l})? with advertising
x11 | 3 | x11 | x11(?: {l})?
x11 | 3 | consortium | except as contained in this notice the names? of the x consortium
expat | 3 | expat | expat {l}
mit-feh | 3 | feh | (?:mit )?feh {l}
bsd-0 | 3 | 0bsd,bsd | (?:0bsd|bsd 0 clause|zero clause bsd)(?: {l})?
bsd-1 | 3 | bsd | (?:bsd 1 clause|(?:1|one) clause bsd)(?: {l})?
bsd-2 | 3 | bsd | (?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd)(?: {l})?
bsd-2 | 3 | freebsd | freebsd {l}
bsd-3 | 3 | bsd | (?:bsd 3 clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: {l})?
bsd-4 | 3 | bsd | (?:bsd 4 clause|(?:4|four) clause bsd|(?:original|old) bsd)(?: {l})?
bsd-patent | 3 | bsd | bsd (?:2 clause )?plus patent(?: {l})?
bsd-clear | 3 | bsd | (?:bsd 3 clause clear|clear bsd)(?: {l})?
bsd-lbnl | 3 | bsd | (?:lbnl bsd|lawrence berkeley national labs bsd)(?: variant)?(?: {l})?
bsd | 2 | bsd | bsd {l}
bsd | 2 | bsd | {l} bsd
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-style | 2 | bsd | bsd (?:style|like|type)(?: {l})?
bsd-3 | 3 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | 3 | advertising | all advertising materials mentioning features or use of this software must display
isc | 3 | isc | (?:the )?isc {l}
isc | 3 | isc | {l} isc
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
openbsd | 3 | openbsd | openbsd {l}
gpl-1 | 3 | gpl,gpl1,gplv1 | (?:gnu )?gpl(?: )?{v}1{z}
gpl-2 | 3 | gpl,gpl2,gplv2 | (?:gnu )?gpl(?: )?{v}2{z}(?: only)?
gpl-3 | 3 | gpl,gpl3,gplv3 | (?:gnu )?gpl(?: )?{v}3{z}(?: only)?
gpl-1 | 3 | general | general public {l} {v}1{z}
gpl-2 | 3 | general | (?:gnu )?general public {l} {v}2{z}(?: only)?
gpl-3 | 3 | general | (?:gnu )?general public {l} {v}3{z}(?: only)?
gpl-2-or-later | 3 | gpl,gpl2,gplv2 | (?:gnu )?gpl(?: )?{v}2{z}{later}
gpl-3-or-later | 3 | gpl,gpl3,gplv3 | (?:gnu )?gpl(?: )?{v}3{z}{later}
gpl-2-or-later | 3 | general | (?:gnu )?general public {l} {v}2{z}{later}
gpl-3-or-later | 3 | general | (?:gnu )?general public {l} {v}3{z}{later}
gpl-2-or-later | 3 | either | either version 2 of the {l} or at your option any later version
gpl-3-or-later | 3 | either | either version 3 of the {l} or at your option any later version
gpl-family | 2 | gnu | gnu gpl
gpl-family | 2 | gnu | gnu general public {l}
gpl-family | 2 | gpl | (?:under|of) the gpl
gpl-classpath | 3 | classpath | (?:gpl )?(?:with )?(?:the )?classpath exception
gpl-linking | 3 | linking | (?:gpl )?(?:with )?(?:a )?(?:special )?linking exception
gpl-font | 3 | font | (?:gpl )?with (?:the )?font exception
gcc-exception | 3 | gcc | gcc runtime library exception
bison-exception | 3 | bison | bison exception
autoconf-exception | 3 | autoconf | autoconf(?: configure)?(?: script)? exception
lgpl-2 | 3 | lgpl,lgpl2,lgplv2 | (?:gnu )?lgpl(?: )?{v}2{z}
lgpl-2.1 | 3 | lgpl,lgpl2,lgplv2 | (?:gnu )?lgpl(?: )?{v}2 1
lgpl-3 | 3 | lgpl,lgpl3,lgplv3 | (?:gnu )?lgpl(?: )?{v}3{z}
lgpl-2 | 3 | library | (?:gnu )?library general public {l} {v}2{z}
lgpl-2.1 | 3 | lesser | (?:gnu )?lesser general public {l} {v}2 1
lgpl-3 | 3 | lesser | (?:gnu )?lesser general public {l} {v}3{z}
lgpl-2.1-or-later | 3 | lgpl,lgpl2,lgplv2 | (?:gnu )?lgpl(?: )?{v}2 1{later}
lgpl-2.1-or-later | 3 | lesser | (?:gnu )?lesser general public {l} {v}2 1{later}
lgpl-3-or-later | 3 | lgpl,lgpl3,lgplv3 | (?:gnu )?lgpl(?: )?{v}3{z}{later}
lgpl | 2 | lesser | (?:gnu )?lesser general public {l}
lgpl | 2 | library | (?:gnu )?library general public {l}
lgpl | 2 | lgpl | (?:gnu )?lgpl
agpl-1 | 3 | affero | affero general public {l} {v}1{z}
agpl-3 | 3 | affero | (?:gnu )?affero general public {l} {v}3{z}
agpl-3 | 3 | agpl,agpl3,agplv3 | (?:gnu )?agpl(?: )?{v}3{z}
agpl-3-or-later | 3 | affero | (?:gnu )?affero general public {l} {v}3{z}{later}
agpl-3-or-later | 3 | agpl,agpl3,agplv3 | (?:gnu )?agpl(?: )?{v}3{z}{later}
agpl | 2 | affero | (?:gnu )?affero (?:general public {l}|gpl)
agpl | 2 | agpl | (?:gnu )?agpl
gfdl-1.1 | 3 | documentation | (?:gnu )?free documentation {l} {v}1 1
gfdl-1.2 | 3 | documentation | (?:gnu )?free documentation {l} {v}1 2
gfdl-1.3 | 3 | documentation | (?:gnu )?free documentation {l} {v}1 3
gfdl-1.2 | 3 | gfdl | (?:gnu )?gfdl {v}1 2
gfdl-1.3 | 3 | gfdl | (?:gnu )?gfdl {v}1 3
gfdl | 2 | documentation | (?:gnu )?free documentation {l}
gfdl | 2 | gfdl | gfdl
gnu-all-permissive | 3 | gnu | gnu all permissive {l}
mpl-1.0 | 3 | mozilla | mozilla public {l} {v}1 0
mpl-1.1 | 3 | mozilla | mozilla public {l} {v}1 1
mpl-2.0 | 3 | mozilla | mozilla public {l} {v}2{z}
mpl-1.1 | 3 | mpl | mpl {v}1 1
mpl-2.0 | 3 | mpl | mpl {v}2{z}
mpl | 2 | mozilla | mozilla public {l}
mpl-no-copyleft | 3 | mozilla | mozilla public {l} (?:{v}2 0 )?no copyleft exception
npl-1.0 | 3 | netscape | netscape public {l} {v}1 0
npl-1.1 | 3 | netscape | netscape public {l} {v}1 1
npl | 2 | netscape | netscape public {l}
epl-1.0 | 3 | eclipse | eclipse public {l} {v}1{z}
epl-2.0 | 3 | eclipse | eclipse public {l} {v}2{z}
epl-1.0 | 3 | epl | epl {v}1{z}
epl-2.0 | 3 | epl | epl {v}2{z}
epl | 2 | eclipse | eclipse public {l}
edl-1.0 | 3 | eclipse | eclipse distribution {l}(?: {v}1{z})?
cpl-1.0 | 3 | common | common public {l}(?: {v}1{z})?
ipl-1.0 | 3 | ibm | ibm public {l}(?: {v}1{z})?
cddl-1.0 | 3 | cddl | cddl {v}1 0
cddl-1.1 | 3 | cddl | cddl {v}1 1
cddl-1.0 | 3 | distribution | common development and distribution {l} {v}1 0
cddl-1.1 | 3 | distribution | common development and distribution {l} {v}1 1
cddl | 2 | distribution | common development and distribution {l}
cddl | 2 | cddl | cddl
cpal-1.0 | 3 | attribution | common public attribution {l}(?: {v}1{z})?
osl-1 | 3 | osl | osl {v}1 [01]
osl-2 | 3 | osl | osl {v}2 [01]
osl-3 | 3 | osl | osl {v}3{z}
osl-3 | 3 | open | open software {l} {v}3{z}
osl | 2 | open | open software {l}
afl-2 | 3 | afl | afl {v}2 [01]
afl-3 | 3 | afl | afl {v}3{z}
afl-3 | 3 | academic | academic free {l} {v}3{z}
afl | 2 | academic | academic free {l}
eupl-1.0 | 3 | eupl | eupl {v}1 0
eupl-1.1 | 3 | eupl | eupl {v}1 1
eupl-1.2 | 3 | eupl | eupl {v}1 2
eupl | 2 | european | european union public {l}(?: {v}1 [012])?
eupl | 2 | eupl | eupl
cecill-1 | 3 | cecill | cecill {v}1 [01]
cecill-2 | 3 | cecill | cecill {v}2 [01]
cecill-b | 3 | cecill | cecill b
cecill-c | 3 | cecill | cecill c
cecill | 2 | cecill | cecill(?: {l})?
artistic-1 | 3 | artistic | artistic {l} {v}1{z}
artistic-2 | 3 | artistic | artistic {l} {v}2{z}
artistic-clarified | 3 | artistic | clarified artistic {l}
artistic | 2 | artistic | artistic {l}
perl | 3 | perl | (?:under the )?same terms as perl(?: itself)?
zlib | 3 | zlib | zlib {l}
zlib | 3 | libpng | (?:zlib )?libpng {l}(?: {v}2)?
zlib | 3 | misrepresented | the origin of this software must not be misrepresented
boost-1.0 | 3 | boost | boost software {l}(?: {v}1{z})?
unlicense | 3 | unlicense | (?:the )?unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 3 | wtfpl | wtfpl(?: {v}2)?
wtfpl | 3 | fuck | do what the fuck you want to public {l}
beerware | 3 | beerware,beer | (?:beerware|beer ware)(?: {l})?
public-domain | 2 | domain | (?:released (?:in)?to|in|placed (?:in)?to) the public domain
public-domain | 2 | domain | public domain dedication
pddl | 3 | pddl,domain | (?:pddl|public domain dedication and {l})
odbl | 3 | odbl,database | (?:odbl|open database {l})(?: {v}1{z})?
odc-by | 3 | odc,data | (?:odc by|open data commons attribution {l})(?: {v}1{z})?
cdla-permissive-1 | 3 | cdla,community | (?:cdla|community data {l} agreement) permissive(?: {v}1{z})?
cdla-permissive-2 | 3 | cdla,community | (?:cdla|community data {l} agreement) permissive {v}2{z}
cdla-sharing | 3 | cdla,community | (?:cdla|community data {l} agreement) sharing(?: {v}1{z})?
cc0-1.0 | 3 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 3 | zero | (?:publicdomain|public domain) zero 1 0
cc0 | 2 | cc0 | cc0
cc-by-1.0 | 3 | cc | cc by {v}1 0
cc-by-2.0 | 3 | cc | cc by {v}2 0
cc-by-2.5 | 3 | cc | cc by {v}2 5
cc-by-3.0 | 3 | cc | cc by {v}3 0
cc-by-4.0 | 3 | cc | cc by {v}4 0
cc-by-sa-1.0 | 3 | cc | cc by sa {v}1 0
cc-by-sa-2.0 | 3 | cc | cc by sa {v}2 0
cc-by-sa-2.5 | 3 | cc | cc by sa {v}2 5
cc-by-sa-3.0 | 3 | cc | cc by sa {v}3 0
cc-by-sa-4.0 | 3 | cc | cc by sa {v}4 0
cc-by-nd-2.0 | 3 | cc | cc by nd {v}2 0
cc-by-nd-3.0 | 3 | cc | cc by nd {v}3 0
cc-by-nd-4.0 | 3 | cc | cc by nd {v}4 0
cc-by-nc-1.0 | 3 | cc | cc by nc {v}1 0
cc-by-nc-2.0 | 3 | cc | cc by nc {v}2 0
cc-by-nc-2.5 | 3 | cc | cc by nc {v}2 5
cc-by-nc-3.0 | 3 | cc | cc by nc {v}3 0
cc-by-nc-4.0 | 3 | cc | cc by nc {v}4 0
cc-by-nc-sa-2.0 | 3 | cc | cc by nc sa {v}2 0
cc-by-nc-sa-3.0 | 3 | cc | cc by nc sa {v}3 0
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa {v}4 0
cc-by-nc-nd-2.0 | 3 | cc | cc by nc nd {v}2 0
cc-by-nc-nd-3.0 | 3 | cc | cc by nc nd {v}3 0
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd {v}4 0
cc-by-sa | 2 | cc | cc by sa
cc-by-nd | 2 | cc | cc by nd
cc-by-nc | 2 | cc | cc by nc
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by | 2 | commons | creative commons attribution(?: {l})?
cc-by-3.0 | 3 | commons | creative commons attribution {v}3 0(?: unported| international)?
cc-by-4.0 | 3 | commons | creative commons attribution {v}4 0(?: international)?
cc-by-sa | 2 | commons | creative commons attribution share(?: )?alike
cc-by-sa-3.0 | 3 | commons | creative commons attribution share(?: )?alike {v}3 0(?: unported)?
cc-by-sa-4.0 | 3 | commons | creative commons attribution share(?: )?alike {v}4 0(?: international)?
cc-by-nc | 2 | commons | creative commons attribution non(?: )?commercial
cc-by-nc-sa | 2 | commons | creative commons attribution non(?: )?commercial share(?: )?alike
cc-by-nc-nd | 2 | commons | creative commons attribution non(?: )?commercial no deriv(?:s|atives)
cc-by-nd | 2 | commons | creative commons attribution no deriv(?:s|atives)
cc-zero | 2 | commons | creative commons zero
cc | 2 | creativecommons | creativecommons org licenses by(?: nc)?(?: sa| nd)?(?: [1-4] [05])?
cc | 1 | commons | creative commons(?: {l})?
ofl-1.0 | 3 | ofl | (?:sil )?ofl {v}1 0
ofl-1.1 | 3 | ofl | (?:sil )?ofl {v}1 1
ofl-1.1 | 3 | font | (?:sil )?open font {l} {v}1 1
ofl | 2 | font | (?:sil )?open font {l}
ubuntu-font | 3 | ubuntu | ubuntu font {l}(?: {v}1{z})?
bitstream-vera | 3 | bitstream | bitstream vera(?: fonts?)?(?: {l}| copyright)?
python-2 | 3 | python,psf | (?:psf|python software foundation) {l} {v}2{z}
python | 2 | python,psf | (?:psf|python software foundation|python) {l}
ruby | 3 | ruby | (?:ruby {l}|{l} ruby|same terms as ruby)
php-3.0 | 3 | php | php {l} {v}3 0
php-3.01 | 3 | php | php {l} {v}3 01
php | 2 | php | php {l}
zend-2.0 | 3 | zend | zend {l}(?: {v}2{z})?
openssl | 3 | openssl | openssl {l}
ssleay | 3 | ssleay | (?:original )?ssleay {l}
curl | 3 | curl | curl {l}
ncsa | 3 | ncsa,illinois | (?:ncsa|university of illinois ncsa) open source {l}
ntp | 3 | ntp | ntp {l}
icu | 3 | icu | icu {l}
unicode | 3 | unicode | unicode(?: inc)? {l}(?: agreement)?
w3c | 3 | w3c | w3c(?: software)?(?: notice and)?(?: document)? {l}
ijg | 3 | jpeg | independent jpeg group(?: {l})?
libtiff | 3 | libtiff | libtiff {l}
freetype | 3 | freetype | freetype(?: project)? {l}
imagemagick | 3 | imagemagick | imagemagick {l}
postgresql | 3 | postgresql | postgresql {l}
sqlite | 3 | evil | may you do good and not evil
json | 3 | evil | shall be used for good not evil
tcl | 3 | tcl | tcl tk {l}
vim | 3 | vim | vim {l}
sleepycat | 3 | sleepycat | sleepycat {l}
qpl-1.0 | 3 | qpl,public | (?:qpl|q public {l})(?: {v}1{z})?
lppl-1.3 | 3 | lppl,latex | (?:lppl|latex project public {l}) {v}1 3[ac]?
lppl | 2 | lppl,latex | (?:lppl|latex project public {l})
ms-pl | 3 | microsoft,ms | (?:microsoft public {l}|ms pl)
ms-rl | 3 | microsoft,ms | (?:microsoft reciprocal {l}|ms rl)
mulan-1 | 3 | mulan | mulan(?: permissive software {l}| psl) {v}1
mulan-2 | 3 | mulan | mulan(?: permissive software {l}| psl) {v}2
upl-1.0 | 3 | upl,universal | (?:upl|universal permissive {l})(?: {v}1{z})?
blueoak-1.0 | 3 | oak | blue oak(?: model {l})?(?: {v}1 0 0)?
hippocratic | 3 | hippocratic | hippocratic {l}(?: {v}[123](?: [01])?)?
anti-996 | 3 | 996 | anti 996 {l}(?: {v}1{z})?
sspl-1 | 3 | sspl,server | (?:sspl|server side public {l})(?: {v}1)?
busl-1.1 | 3 | busl,business | (?:busl|business source {l})(?: {v}1 1)?
elastic-2 | 3 | elastic | elastic {l} {v}2{z}
commons-clause | 3 | clause | commons clause(?: {l} condition)?(?: {v}1{z})?
polyform-noncommercial | 3 | polyform | polyform noncommercial(?: {l})?(?: {v}1{z}(?: 0)?)?
polyform-small | 3 | polyform | polyform small business(?: {l})?(?: {v}1{z}(?: 0)?)?
confluent | 3 | confluent | confluent community {l}(?: {v}1{z})?
openrail-m | 3 | openrail,rail | (?:creativeml |bigscience )?(?:openrail|open rail|rail) m(?: {l})?
llama-2 | 3 | llama | llama 2 community {l}(?: agreement)?
llama-3 | 3 | llama | (?:meta )?llama 3(?: [123])? community {l}(?: agreement)?
gemma | 3 | gemma | gemma terms of use
cern-ohl | 3 | cern,ohl | (?:cern )?ohl (?:(?:p|w|s) )?{v}[12]{z}
tapr-ohl | 3 | tapr | tapr open hardware {l}
solderpad | 3 | solderpad | solderpad hardware {l}(?: {v}[02](?: [15])?(?:1)?)?
free-art | 3 | art | (?:licence art libre|free art {l})(?: {v}1 [23])?
open-government-1 | 3 | government | open government {l} {v}1{z}
open-government-2 | 3 | government | open government {l} {v}2{z}
open-government-3 | 3 | government | open government {l} {v}3{z}
etalab-2 | 3 | etalab | etalab(?: open)?(?: {l})? {v}2{z}
dl-de-by-2 | 3 | datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
spdx | 1 | spdx | spdx {l} identifier
copyright | 1 | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
proprietary | 2 | proprietary | (?:confidential and )?proprietary(?: software| information| and confidential)
no-redistribution | 2 | redistribute,redistributed | (?:do not redistribute|may not be redistributed)
noncommercial | 2 | commercial,noncommercial | for (?:personal |private )?(?:and |or )?non(?: )?commercial (?:use|purposes)(?: only)?
research-only | 2 | research | for research (?:use|purposes) only
evaluation-only | 2 | evaluation | for evaluation purposes only
permission-needed | 2 | permission | without (?:the )?(?:prior |express )?(?:written )?permission
licensed-under | 1 | licensed | licensed under(?: the)?(?: terms of)?
released-under | 1 | released | released under(?: the)?(?: terms of)?
distributed-under | 1 | distributed | distributed under(?: the)?(?: terms of)?
see-license | 1 | see | see(?: the)?(?: file)? {l}(?: file)?(?: for(?: more)? (?:details|information))?
as-is | 1 | warranty | without warranty of any kind
as-is | 1 | warranties | without warranties or conditions of any kind
no-liability | 1 | liable | in no event shall the (?:authors?|copyright (?:holders?|owners?)|contributors?)(?: or (?:authors?|copyright (?:holders?|owners?)|contributors?))* be liable
eula | 2 | eula,user | (?:eula|end user {l} agreement)
terms-of-service | 1 | terms | terms of (?:service|use)
"""

"""The signature rules of the license scan, written by hand.

A line is: label, priority, keywords (one of them must be in the text, separated
by strokes), regular expression, separated by runs of two blanks and more. Texts are matched with runs of white space joined to one blank and without
regard to case, so no pattern repeats white space and none repeats without bound.
``{v}`` in a label is the group v of the match with a minor version; a match of
the group later adds "-or-later". Priorities: 95 addresses and full grants with
versions, 85 names with versions, 75 short names with versions, 60 names, 50
phrases of the license text, 40 short names, 10 notices that name no license.
"""

from __future__ import annotations

TABLE = r"""
gpl-{v}  95  gnu.org/licenses  gnu\.org/licenses/(?:old-licenses/)?gpl-(?P<v>1\.0|2\.0|3\.0)
gpl-{v}  95  opensource.org  opensource\.org/licenses?/gpl-(?P<v>2\.0|3\.0)
gpl-{v}  85  general public licen  \b(?:gnu )?general public licen[cs]e,? \(?(?:the )?(?:version|ver\.?|v\.?) ?(?P<v>[123](?:\.0)?)(?![.\d]*\d)(?P<later>,? or (?:\(at your option\) |at your option,? )?(?:any )?later|\+)?
gpl-{v}  85  general public licen  \b(?:gnu )?general public licen[cs]e as published by the free software foundation[,;] (?:either )?version (?P<v>[123](?:\.0)?)(?![.\d]*\d)(?: of the licen[cs]e)?(?P<later>,? or (?:\(at your option\) |at your option,? )?any later)?
gpl-{v}  85  general public licen  \bversion (?P<v>[123](?:\.0)?) of the (?:gnu )?general public licen[cs]e(?P<later>,? or (?:\(at your option\) )?any later)?
gpl-{v}  85  gpl  \bgnu gpl,? \(?(?:version |ver\.? |v\.? ?)?(?P<v>[123](?:\.0)?)(?![.\d]*\d)(?P<later> or (?:any )?later|-or-later|\+)?
gpl-{v}  75  gpl  (?<![\w-])gpl(?:[- ]?v|[- ]| version |, version )?(?P<v>[123](?:\.0)?)(?![.\d]*\d)(?P<later> or (?:any )?later|-or-later|\+)?
gpl  60  general public licen  \bgnu general public licen[cs]e
gpl  55  general public licen  (?<!lesser )(?<!library )(?<!affero )(?<!eclipse )(?<!mozilla )\bgeneral public licen[cs]e
gpl  50  redistribute it  this program is free software[:;,]? you (?:can|may) redistribute it
gpl  50  without even the implied  without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public
gpl  40  gnu gpl  \bgnu gpl\b(?!,? ?v?\d)
gpl  40  under the gpl  \b(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?gpl\b(?![- ]?v?\d)
gpl-2.0-with-classpath-exception  85  classpath  \bgpl(?:v2|-2\.0)? with (?:the )?classpath[- ]exception
gpl-3.0-with-gcc-exception  85  gcc runtime library  \bgcc runtime library exception\b
gpl-font-exception  70  font exception  \bgpl(?:v[23])? with font exception\b
lgpl-{v}  95  gnu.org/licenses  gnu\.org/licenses/(?:old-licenses/)?lgpl-(?P<v>2\.0|2\.1|3\.0)
lgpl-{v}  95  opensource.org  opensource\.org/licenses?/lgpl-(?P<v>2\.1|3\.0)
lgpl-{v}  85  general public licen  \b(?:gnu )?(?:lesser|library) (?:gnu )?general public licen[cs]e,? \(?(?:the )?(?:version|ver\.?|v\.?) ?(?P<v>2\.1|[23](?:\.0)?)(?![.\d]*\d)(?P<later>,? or (?:\(at your option\) |at your option,? )?(?:any )?later|\+)?
lgpl-{v}  85  general public licen  \b(?:lesser|library) general public licen[cs]e as published by the free software foundation[,;] (?:either )?version (?P<v>2\.1|[23](?:\.0)?)(?![.\d]*\d)(?: of the licen[cs]e)?(?P<later>,? or (?:\(at your option\) |at your option,? )?any later)?
lgpl-{v}  85  general public licen  \bversion (?P<v>2\.1|[23](?:\.0)?) of the (?:gnu )?(?:lesser|library) general public licen[cs]e(?P<later>,? or (?:\(at your option\) )?any later)?
lgpl-{v}  75  lgpl  (?<![\w-])(?:gnu )?lgpl(?:[- ]?v|[- ]| version |, version )?(?P<v>2\.1|[23](?:\.0)?)(?![.\d]*\d)(?P<later> or (?:any )?later|-or-later|\+)?
lgpl  60  general public licen  \b(?:gnu )?(?:lesser|library) (?:gnu )?general public licen[cs]e
lgpl  50  redistribute it  this library is free software[:;,]? you (?:can|may) redistribute it
lgpl  40  lgpl  (?<![\w-])(?:gnu )?lgpl\b(?![- ]?v?\d)
agpl-{v}  95  gnu.org/licenses  gnu\.org/licenses/agpl-(?P<v>3\.0)
agpl-{v}  85  affero  \b(?:gnu )?affero (?:gnu )?general public licen[cs]e,? \(?(?:the )?(?:version|ver\.?|v\.?) ?(?P<v>[13](?:\.0)?)(?![.\d]*\d)(?P<later>,? or (?:\(at your option\) |at your option,? )?(?:any )?later|\+)?
agpl-{v}  85  affero  \baffero general public licen[cs]e as published by the free software foundation[,;] (?:either )?version (?P<v>3(?:\.0)?)(?![.\d]*\d)(?: of the licen[cs]e)?(?P<later>,? or (?:\(at your option\) |at your option,? )?any later)?
agpl-{v}  85  affero  \bversion (?P<v>[13](?:\.0)?) of the (?:gnu )?affero general public licen[cs]e(?P<later>,? or (?:\(at your option\) )?any later)?
agpl-{v}  75  agpl  (?<![\w-])(?:gnu )?agpl(?:[- ]?v|[- ]| version |, version )?(?P<v>[13](?:\.0)?)(?![.\d]*\d)(?P<later> or (?:any )?later|-or-later|\+)?
agpl  60  affero  \b(?:gnu )?affero (?:gnu )?general public licen[cs]e
agpl  40  agpl  (?<![\w-])(?:gnu )?agpl\b(?![- ]?v?\d)
gfdl-{v}  95  gnu.org/licenses  gnu\.org/licenses/(?:old-licenses/)?fdl-(?P<v>1\.[123])
gfdl-{v}  85  free documentation  \b(?:gnu )?free documentation licen[cs]e,? \(?(?:version|ver\.?|v\.?) ?(?P<v>1\.[123])(?P<later>,? or (?:\(at your option\) )?any later)?
gfdl-{v}  75  gfdl  (?<![\w-])(?:gnu )?g?fdl(?:[- ]?v|[- ])?(?P<v>1\.[123])(?P<later>-or-later| or (?:any )?later|\+)?
gfdl  60  free documentation  \b(?:gnu )?free documentation licen[cs]e
gfdl  50  invariant sections  \bwith no invariant sections, (?:with )?no front-cover texts
apache-{v}  95  apache.org/licenses  apache\.org/licenses/licen[cs]e-(?P<v>1\.0|1\.1|2\.0)
apache-{v}  95  opensource.org  opensource\.org/licenses?/apache-?(?P<v>1\.1|2\.0)
apache-{v}  85  apache  \bapache(?: software)? licen[cs]e,? \(?(?:the )?(?:version |ver\.? |v\.? ?)?(?P<v>1\.0|1\.1|2(?:\.0)?)(?![.\d]*\d)
apache-{v}  85  apache  \bversion (?P<v>1\.0|1\.1|2(?:\.0)?) of the apache(?: software)? licen[cs]e
apache-{v}  75  apache  (?<![\w-])apache(?:[- ]v?|v)(?P<v>1\.0|1\.1|2(?:\.0)?)(?![.\d]*\d)
apache-{v}  75  asl  (?<![\w-])asl(?:[- ]v?|v)?(?P<v>1\.1|2(?:\.0)?)(?![.\d]*\d)
apache  60  apache  \bapache(?: software)? licen[cs]e
apache  50  apache software foundation  \blicen[cs]ed to the apache software foundation \(asf\)
apache-2.0  50  you may not use this file  you may not use this file except in compliance with the licen[cs]e
apache-2.0  50  unless required by applicable law  unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e
mpl-{v}  95  mozilla.org/mpl  mozilla\.org/mpl/(?P<v>1\.0|1\.1|2\.0)
mpl-{v}  85  mozilla public  \bmozilla public licen[cs]e,? \(?(?:the )?(?:version |ver\.? |v\.? ?)?(?P<v>1\.0|1\.1|2(?:\.0)?)(?![.\d]*\d)(?P<later>\+| or (?:any )?later)?
mpl-{v}  75  mpl  (?<![\w-])mpl(?:[- ]v?|v)?(?P<v>1\.0|1\.1|2(?:\.0)?)(?![.\d]*\d)(?P<later>\+| or (?:any )?later)?
mpl  60  mozilla public  \bmozilla public licen[cs]e
mpl-2.0  50  source code form  \bthis source code form is subject to the terms of the mozilla public
mpl-1.1  50  under the "license"  contents of this file are subject to the mozilla public licen[cs]e version 1\.1
epl-{v}  95  eclipse.org  eclipse\.org/legal/epl-v?(?P<v>1\.?0|2\.?0)
epl-{v}  85  eclipse public  \beclipse public licen[cs]e,? (?:-? ?(?:version|ver\.?|v\.?) ?)?(?P<v>[12](?:\.0)?)(?![.\d]*\d)
epl-{v}  75  epl  (?<![\w-])epl(?:[- ]v?|v)?(?P<v>[12]\.0)(?![.\d]*\d)
epl  60  eclipse public  \beclipse public licen[cs]e
edl-1.0  60  eclipse distribution  \beclipse distribution licen[cs]e
cpl-{v}  85  common public licen  \bcommon public licen[cs]e,? (?:-? ?(?:version|ver\.?|v\.?) ?)?(?P<v>0\.5|1\.0)
cpl  60  common public licen  \bcommon public licen[cs]e
ipl-1.0  60  ibm public  \bibm public licen[cs]e
cddl-{v}  85  common development and distribution  \bcommon development and distribution licen[cs]e,? \(?(?:cddl\)?,? \(?)?(?:version|ver\.?|v\.?) ?(?P<v>1\.[01])
cddl-{v}  75  cddl  (?<![\w-])cddl(?:[- ]v?|v)(?P<v>1\.[01])
cddl  60  common development and distribution  \bcommon development and distribution licen[cs]e
cddl  40  cddl  (?<![\w-])cddl\b(?![- ]?v?\d)
eupl-{v}  85  european union public  \beuropean union public licen[cs]e,? \(?(?:eupl\)?,? )?(?:version|ver\.?|v\.?) ?(?P<v>1\.[012])
eupl-{v}  75  eupl  (?<![\w-])eupl(?:[- ,]{1,2}v?|v)(?P<v>1\.[012])
eupl  60  european union public  \beuropean union public licen[cs]e
osl-{v}  85  open software licen  \bopen software licen[cs]e,? (?:version|ver\.?|v\.?) ?(?P<v>1\.[01]|2\.[01]|3\.0)
osl-{v}  75  osl  (?<![\w-])osl(?:[- ]v?|v)(?P<v>1\.[01]|2\.[01]|3\.0)
osl  60  open software licen  \bopen software licen[cs]e
afl-{v}  85  academic free  \bacademic free licen[cs]e,? (?:version|ver\.?|v\.?) ?(?P<v>1\.[12]|2\.[01]|3\.0)
afl-{v}  75  afl  (?<![\w-])afl(?:[- ]v?|v)(?P<v>1\.[12]|2\.[01]|3\.0)
afl  60  academic free  \bacademic free licen[cs]e
rpl-{v}  85  reciprocal public  \breciprocal public licen[cs]e,? (?:version|ver\.?|v\.?)? ?(?P<v>1\.[15])
rpl  60  reciprocal public  \breciprocal public licen[cs]e
artistic-{v}  95  perlfoundation  perlfoundation\.org/artistic_licen[cs]e_(?P<v>[12]_0)
artistic-{v}  85  artistic  \bartistic licen[cs]e,? \(?(?:version |ver\.? |v\.? ?)?(?P<v>[12]\.0)
artistic-{v}  75  artistic  (?<![\w-])artistic[- ]v?(?P<v>[12]\.0)
artistic  60  artistic  \bartistic licen[cs]e
perl  60  as perl itself  \bsame terms as perl(?: \d+)? itself\b
ofl-{v}  95  scripts.sil.org  scripts\.sil\.org/ofl(?P<v>\b)
ofl-{v}  85  open font  \b(?:sil )?open font licen[cs]e,? \(?(?:version|ver\.?|v\.?) ?(?P<v>1\.[01])
ofl-{v}  75  ofl  (?<![\w-])ofl(?:[- ]v?|v)(?P<v>1\.[01])
ofl  60  open font  \b(?:sil )?open font licen[cs]e
bsl-1.0  95  boost.org  boost\.org/licen[cs]e_1_0\.txt
bsl-1.0  85  boost software  \bboost software licen[cs]e(?:,? (?:-? ?(?:version|ver\.?|v\.?) ?)?1\.0)?
busl-1.1  85  business source  \bbusiness source licen[cs]e,? (?:version |v\.? ?)?1\.1
busl  60  business source  \bbusiness source licen[cs]e
lppl-{v}  95  latex-project.org  latex-project\.org/lppl/lppl-(?P<v>1-[0123])
lppl-{v}  85  latex project public  \blatex project public licen[cs]e,? \(?(?:either )?(?:version|ver\.?|v\.?) ?(?P<v>1\.[0123])(?:[a-c])?(?P<later>,? or (?:\(at your option\) )?any later)?
lppl-{v}  75  lppl  (?<![\w-])lppl(?:[- ]v?|v| version )(?P<v>1\.[0123])
lppl  60  latex project public  \blatex project public licen[cs]e
odbl-1.0  95  opendatacommons.org  opendatacommons\.org/licenses/odbl
odbl-1.0  75  open database licen  \bopen database licen[cs]e,? \(?(?:odbl\)?,? )?v?1\.0
odbl  60  open database licen  \bopen database licen[cs]e
odc-by-1.0  95  opendatacommons.org  opendatacommons\.org/licenses/by
odc-by  60  open data commons attribution  \bopen data commons attribution licen[cs]e
pddl-1.0  95  opendatacommons.org  opendatacommons\.org/licenses/pddl
pddl  60  public domain dedication  \bopen data commons public domain dedication
upl-1.0  60  universal permissive  \buniversal permissive licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
zpl-{v}  85  zope public  \bzope public licen[cs]e,? \(?(?:zpl\)?,? )?(?:version|ver\.?|v\.?)? ?(?P<v>1\.[01]|2\.[01])
zpl  60  zope public  \bzope public licen[cs]e
psf-2.0  85  python software foundation  \bpython software foundation licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?
psf  60  python software foundation  \bpython software foundation licen[cs]e
python-2.0  50  beopen  \bbeopen python open source licen[cs]e agreement
cnri-python  60  cnri  \bcnri (?:open source )?(?:gpl-compatible )?licen[cs]e agreement
mit  95  opensource.org  opensource\.org/licenses?/mit\b
mit  60  mit licen  \bmit licen[cs]e\b
mit  60  expat licen  \bexpat licen[cs]e\b
mit  50  permission is hereby granted  permission is hereby granted, ?free of charge, to any person obtaining a copy
mit  50  above copyright notice and this  the above copyright notice and this permission notice shall be included in all
mit  40  mit/x11  \bmit/x11\b(?: licen[cs]e)?
mit  40  under the mit  \b(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?mit\b
mit-0  70  mit no attribution  \bmit no attribution\b
mit-0  70  mit-0  (?<![\w-])mit-0(?![\w-])
mit-modern  60  modern style mit  \bmodern style mit\b
x11  60  x11 licen  \bx11 licen[cs]e\b
isc  95  opensource.org  opensource\.org/licenses?/isc\b
isc  60  isc licen  \bisc licen[cs]e\b
isc  50  permission to use, copy  permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd  75  0bsd  (?<![\w-])0bsd(?![\w-])
0bsd  75  zero-clause  \bzero-clause bsd\b
bsd-1-clause  75  1-clause  \b(?:bsd[- ]1-clause|1-clause bsd)\b
bsd-2-clause  95  opensource.org  opensource\.org/licenses?/bsd-2-clause
bsd-2-clause  75  bsd  \b(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd\b
bsd-2-clause  75  bsd  \bbsd[- ](?:2|two)[- ]clause\b
bsd-2-clause-patent  80  bsd  \bbsd-2-clause-patent\b|\bbsd\+patent\b
bsd-3-clause  95  opensource.org  opensource\.org/licenses?/bsd-3-clause
bsd-3-clause  75  bsd  \b(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd\b
bsd-3-clause  75  bsd  \bbsd[- ](?:3|three)[- ]clause\b
bsd-3-clause  50  endorse or promote  neither the names? of .{1,120}? may be used to endorse or promote products derived
bsd-3-clause-clear  80  clear bsd  \bclear bsd licen[cs]e\b|\bbsd-3-clause-clear\b
bsd-4-clause  75  bsd  \b(?:original|old|4[- ]clause|four[- ]clause) bsd\b
bsd-4-clause  75  bsd  \bbsd[- ](?:4|four)[- ]clause\b
bsd-4-clause  50  all advertising materials  all advertising materials mentioning features or use of this software must display
bsd-protection  60  bsd protection  \bbsd protection licen[cs]e\b
bsd  60  bsd  \bbsd[- ](?:style[- ])?licen[cs]e\b
bsd  50  redistributions of source  redistributions of source code must retain the (?:above|accompanying) copyright
bsd  50  redistributions in binary  redistributions in binary form must reproduce the (?:above|accompanying) copyright
bsd  40  under the bsd  \b(?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of the )?bsd\b
zlib  95  opensource.org  opensource\.org/licenses?/zlib\b
zlib  60  zlib  \bzlib(?:/libpng)? licen[cs]e\b
zlib  50  provided 'as-is'  this software is provided 'as-is', without any express or implied warranty\. in no event will the authors
libpng  60  libpng licen  (?<!zlib/)\blibpng licen[cs]e\b
unlicense  95  unlicense.org  \bunlicense\.org\b
unlicense  60  unlicense  \bthe unlicense\b
unlicense  50  free and unencumbered  \bfree and unencumbered software released into the public domain\b
public-domain  45  public domain  \b(?:placed|released|dedicated|donated) (?:in|into|to) the public domain\b
public-domain  40  public domain  \b(?:is|are) (?:hereby )?(?:in )?the public domain\b
wtfpl  95  wtfpl.net  \bwtfpl\.net\b
wtfpl  60  you want to public licen  do what the f\S{1,8} you want to public licen[cs]e
wtfpl  40  wtfpl  (?<![\w-])wtfpl\b
beerware  60  beer  \bbeer-?ware licen[cs]e\b
beerware  50  buy me a beer  you can buy me a beer in return
openssl  60  openssl licen  \bopenssl licen[cs]e\b
openssl  50  openssl toolkit  \bthis product includes software developed by the openssl project
ssleay  50  cryptographic software written by  \bthis product includes cryptographic software written by eric young
ms-pl  60  microsoft public  \bmicrosoft public licen[cs]e\b
ms-pl  40  ms-pl  (?<![\w-])ms-pl(?![\w-])
ms-rl  60  microsoft reciprocal  \bmicrosoft reciprocal licen[cs]e\b
ms-rl  40  ms-rl  (?<![\w-])ms-rl(?![\w-])
ncsa  60  university of illinois  \buniversity of illinois/?(?:ncsa)? open source licen[cs]e\b
postgresql  60  postgresql licen  \bpostgresql licen[cs]e\b
php-{v}  95  php.net/license  php\.net/licen[cs]e/(?P<v>3_01|3_0)
php-{v}  85  php licen  \bphp licen[cs]e,? (?:version |v\.? ?)(?P<v>3\.01|3\.0|2\.0)
php  60  php licen  \bphp licen[cs]e\b
ruby  60  ruby licen  \bruby licen[cs]e\b
ruby  50  same terms as ruby  \bsame terms as ruby(?: itself)?\b
vim  60  vim licen  \bvim licen[cs]e\b
curl  60  curl licen  \bcurl licen[cs]e\b
unicode  60  unicode  \bunicode(?:,? inc\.?)? licen[cs]e(?: agreement)?\b
unicode-3.0  75  unicode licen  \bunicode licen[cs]e v3\b
sleepycat  60  sleepycat  \bsleepycat licen[cs]e\b
ftl  60  freetype  \bfreetype (?:project )?licen[cs]e\b
ijg  60  independent jpeg group  \bindependent jpeg group(?:'s)? (?:software|licen[cs]e)\b
icu  60  icu licen  \bicu licen[cs]e\b
json  60  json licen  \bjson licen[cs]e\b
json  50  used for good, not evil  the software shall be used for good, not evil
tcl  60  tcl/tk  \btcl/tk licen[cs]e\b
w3c  60  w3c  \bw3c software(?: notice and)?(?: and document)? licen[cs]e\b
w3c  50  w3.org/consortium/legal  w3\.org/consortium/legal/\d{4}/copyright-software
intel  60  intel open source  \bintel open source licen[cs]e\b
issl  60  intel simplified  \bintel simplified software licen[cs]e\b
npl-{v}  85  netscape public  \bnetscape public licen[cs]e,? (?:version |v\.? ?)?(?P<v>1\.[01])
npl  60  netscape public  \bnetscape public licen[cs]e\b
qpl-1.0  60  q public  \b(?:the )?q public licen[cs]e\b
spl-1.0  60  sun public  \bsun public licen[cs]e\b
sissl  60  sun industry standards  \bsun industry standards source licen[cs]e\b
apsl-{v}  85  apple public source  \bapple public source licen[cs]e,? (?:version |v\.? ?)?(?P<v>1\.[012]|2\.0)
apsl  60  apple public source  \bapple public source licen[cs]e\b
cecill-{v}  75  cecill  (?<![\w-])cecill(?:[- ]v?|v| version )(?P<v>1\.[01]|2\.[01])
cecill-b  70  cecill  (?<![\w-])cecill-b\b
cecill-c  70  cecill  (?<![\w-])cecill-c\b
cecill  40  cecill  (?<![\w-])cecill\b(?![- ]?v?\d|-[bc]\b)
catosl  60  computer associates  \bcomputer associates trusted open source licen[cs]e\b
ecl-{v}  75  educational community  \beducational community licen[cs]e,? (?:version |v\.? ?)?(?P<v>[12]\.0)
ecl  60  educational community  \beducational community licen[cs]e\b
efl-{v}  75  eiffel forum  \beiffel forum licen[cs]e,? (?:version |v\.? ?)?(?P<v>[12](?:\.0)?)
eudatagrid  60  eu datagrid  \beu datagrid software licen[cs]e\b
entessa  60  entessa public  \bentessa public licen[cs]e\b
fair  60  fair licen  \bfair licen[cs]e\b
frameworx  60  frameworx  \bframeworx (?:open )?licen[cs]e\b
nasa-1.3  60  nasa open source  \bnasa open source agreement(?: 1\.3)?
nokia  60  nokia open source  \bnokia open source licen[cs]e\b
motosoto  60  motosoto  \bmotosoto open source licen[cs]e\b
multics  60  multics licen  \bmultics licen[cs]e\b
naumen  60  naumen public  \bnaumen public licen[cs]e\b
oclc-2.0  60  oclc research  \boclc research public licen[cs]e\b
rscpl  60  ricoh source code  \bricoh source code public licen[cs]e\b
simpl-2.0  60  simple public  \bsimple public licen[cs]e\b
vsl-1.0  60  vovida  \bvovida software licen[cs]e\b
watcom-1.0  60  sybase open watcom  \bsybase open watcom public licen[cs]e\b
wxwindows  60  wxwindows  \bwxwindows (?:library )?licen[cs]e\b
xnet  60  x.net  \bx\.net licen[cs]e\b
hpnd  60  historical permission notice  \bhistorical permission notice and disclaimer\b
ntp  60  ntp licen  \bntp licen[cs]e\b
nist  60  national institute of standards  \bnist (?:public domain|software) (?:notice|licen[cs]e)\b
openldap-{v}  75  openldap public  \bopenldap public licen[cs]e,? (?:version |v\.? ?)?(?P<v>2\.\d)
openldap  60  openldap public  \bopenldap public licen[cs]e\b
mulan-psl-{v}  75  mulan  \bmulan (?:psl|permissive software licen[cs]e),? ?(?:version |v\.? ?)?(?P<v>[12](?:\.0)?)
sspl-1.0  75  server side public  \bserver side public licen[cs]e(?:,? (?:version |v\.? ?)?1)?
elastic-2.0  75  elastic licen  \belastic licen[cs]e,? (?:version |v\.? ?)?2\.0
elastic  60  elastic licen  \belastic licen[cs]e\b
commons-clause  60  commons clause  \bcommons clause (?:licen[cs]e|restriction)\b
polyform  60  polyform  \bpolyform (?:noncommercial|small business|perimeter|shield|strict|free trial|internal use) licen[cs]e\b
parity-{v}  75  parity public  \bparity public licen[cs]e,? (?:version |v\.? ?)?(?P<v>[67]\.0)
blueoak-1.0.0  75  blue oak  \bblue oak model licen[cs]e\b
openrail  60  openrail  \b(?:creativeml |bigscience )?open ?rail(?:-[ms])?(?: licen[cs]e)?\b
llama  60  community licen  \bllama [234](?:\.\d)? community licen[cs]e\b
ogl-uk-{v}  75  open government licen  \bopen government licen[cs]e,? (?:version |v\.? ?)?(?P<v>[123](?:\.0)?)
ogl  60  open government licen  \bopen government licen[cs]e\b
cdla-{v}  75  community data licen  \bcommunity data licen[cs]e agreement,? -? ?(?:permissive|sharing),? -? ?(?:version |v\.? ?)?(?P<v>[12]\.0)
cdla  60  community data licen  \bcommunity data licen[cs]e agreement\b
free-art  60  free art licen  \bfree art licen[cs]e\b
dsl  60  design science  \bdesign science licen[cs]e\b
opl  60  open publication  \bopen publication licen[cs]e\b
opencontent  60  opencontent  \bopencontent licen[cs]e\b
cc0-1.0  95  creativecommons.org  creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0  85  cc0  \bcc0[- ]v?1\.0
cc0  60  cc0  \bcc0\b(?![- ]v?\d)
cc0  60  creative commons zero  \bcreative commons zero\b
cc-pdm-1.0  95  creativecommons.org  creativecommons\.org/publicdomain/mark/1\.0
cc-by-{v}  95  creativecommons.org  creativecommons\.org/licenses/by/(?P<v>[1-4]\.[05])
cc-by-sa-{v}  95  creativecommons.org  creativecommons\.org/licenses/by-sa/(?P<v>[1-4]\.[05])
cc-by-nd-{v}  95  creativecommons.org  creativecommons\.org/licenses/by-nd/(?P<v>[1-4]\.[05])
cc-by-nc-{v}  95  creativecommons.org  creativecommons\.org/licenses/by-nc/(?P<v>[1-4]\.[05])
cc-by-nc-sa-{v}  95  creativecommons.org  creativecommons\.org/licenses/by-nc-sa/(?P<v>[1-4]\.[05])
cc-by-nc-nd-{v}  95  creativecommons.org  creativecommons\.org/licenses/by-nc-nd/(?P<v>[1-4]\.[05])
cc-by-nc-sa-{v}  85  creative commons  \bcreative commons attribution[- ]non-?commercial[- ]share-? ?alike (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-nc-nd-{v}  85  creative commons  \bcreative commons attribution[- ]non-?commercial[- ]no-? ?deriv(?:ative)?s?(?: works)? (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-nc-{v}  85  creative commons  \bcreative commons attribution[- ]non-?commercial (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-sa-{v}  85  creative commons  \bcreative commons attribution[- ]share-? ?alike (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-nd-{v}  85  creative commons  \bcreative commons attribution[- ]no-? ?deriv(?:ative)?s?(?: works)? (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-{v}  85  creative commons  \bcreative commons attribution (?:licen[cs]e )?(?:version )?v?(?P<v>[1-4]\.[05])
cc-by-nc-sa-{v}  75  cc by|cc-by  \bcc[- ]by[- ]nc[- ]sa[- ]v?(?P<v>[1-4]\.[05])
cc-by-nc-nd-{v}  75  cc by|cc-by  \bcc[- ]by[- ]nc[- ]nd[- ]v?(?P<v>[1-4]\.[05])
cc-by-nc-{v}  75  cc by|cc-by  \bcc[- ]by[- ]nc[- ]v?(?P<v>[1-4]\.[05])
cc-by-sa-{v}  75  cc by|cc-by  \bcc[- ]by[- ]sa[- ]v?(?P<v>[1-4]\.[05])
cc-by-nd-{v}  75  cc by|cc-by  \bcc[- ]by[- ]nd[- ]v?(?P<v>[1-4]\.[05])
cc-by-{v}  75  cc by|cc-by  \bcc[- ]by[- ]v?(?P<v>[1-4]\.[05])
cc-by-nc-sa  60  creative commons  \bcreative commons attribution[- ]non-?commercial[- ]share-? ?alike\b
cc-by-nc-nd  60  creative commons  \bcreative commons attribution[- ]non-?commercial[- ]no-? ?deriv
cc-by-nc  60  creative commons  \bcreative commons attribution[- ]non-?commercial\b
cc-by-sa  60  creative commons  \bcreative commons attribution[- ]share-? ?alike\b
cc-by-nd  60  creative commons  \bcreative commons attribution[- ]no-? ?deriv
cc-by  60  creative commons  \bcreative commons attribution\b
cc-by-nc-sa  40  cc by|cc-by  \bcc[- ]by[- ]nc[- ]sa\b
cc-by-nc-nd  40  cc by|cc-by  \bcc[- ]by[- ]nc[- ]nd\b
cc-by-nc  40  cc by|cc-by  \bcc[- ]by[- ]nc\b
cc-by-sa  40  cc by|cc-by  \bcc[- ]by[- ]sa\b
cc-by-nd  40  cc by|cc-by  \bcc[- ]by[- ]nd\b
cc-by  40  cc by|cc-by  \bcc[- ]by\b
cc-sampling  60  sampling  \bcreative commons sampling(?: plus)?\b
proprietary  10  all rights reserved  \ball rights reserved\b
proprietary  10  proprietary and confidential  \bproprietary and confidential\b
proprietary  10  end user licen  \bend[- ]user licen[cs]e agreement\b
proprietary  10  end-user licen  \bend[- ]user licen[cs]e agreement\b
proprietary  10  unauthorized copying  \bunauthori[sz]ed copying of this (?:file|software)
"""

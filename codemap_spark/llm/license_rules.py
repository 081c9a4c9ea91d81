"""Hand-written licence signatures, in order of priority.

Each line is ``label : pattern``. A pattern is a Java regex over words that
are lower-cased and joined by single spaces; ``@word`` marks its keyword, which
gates the rule: a rule is tried only where that keyword stands. What stands
left and right of the keyword must match right there. Earlier lines win over
later ones that cover exactly the same words.
"""

RULES_TEXT = r"""
mit : under the mit @license
apache-2 : apache @license version 2
cc-by-nc : @cc by nc
mit : spdx @license identifier mit
apache-2.0 : spdx @license identifier apache 2 0
gpl-2.0-only : spdx @license identifier gpl 2 0(?: only)?
gpl-2.0-or-later : spdx @license identifier gpl 2 0 or later
gpl-3.0-only : spdx @license identifier gpl 3 0(?: only)?
gpl-3.0-or-later : spdx @license identifier gpl 3 0 or later
lgpl-2.1-only : spdx @license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later : spdx @license identifier lgpl 2 1 or later
lgpl-3.0-only : spdx @license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later : spdx @license identifier lgpl 3 0 or later
agpl-3.0-only : spdx @license identifier agpl 3 0(?: only)?
agpl-3.0-or-later : spdx @license identifier agpl 3 0 or later
mpl-2.0 : spdx @license identifier mpl 2 0
epl-1.0 : spdx @license identifier epl 1 0
epl-2.0 : spdx @license identifier epl 2 0
bsd-2-clause : spdx @license identifier bsd 2 clause
bsd-3-clause : spdx @license identifier bsd 3 clause
bsd-4-clause : spdx @license identifier bsd 4 clause
0bsd : spdx @license identifier 0bsd
isc : spdx @license identifier isc
zlib : spdx @license identifier zlib
unlicense : spdx @license identifier unlicense
cc0-1.0 : spdx @license identifier cc0 1 0
cc-by-4.0 : spdx @license identifier cc by 4 0
cc-by-sa-4.0 : spdx @license identifier cc by sa 4 0
bsl-1.0 : spdx @license identifier bsl 1 0
wtfpl : spdx @license identifier wtfpl
artistic-2.0 : spdx @license identifier artistic 2 0
eupl-1.2 : spdx @license identifier eupl 1 2
ms-pl : spdx @license identifier ms pl
postgresql : spdx @license identifier postgresql
python-2.0 : spdx @license identifier python 2 0
ofl-1.1 : spdx @license identifier ofl 1 1
ncsa : spdx @license identifier ncsa
apache-2.0 : licensed under the apache @license version 2(?: 0)?(?: the license)?
apache-2.0 : apache software @license(?: version)? 2(?: 0)?
apache-2.0 : apache @license(?: v2| 2)(?: 0)?
apache-2.0 : apache @license version 2 0
apache-2.0 : www apache org @licenses license 2 0
apache-2.0 : apache 2(?: 0)? @license
apache-1.1 : apache(?: software)? @license(?: version)? 1 1
apache-1.0 : apache(?: software)? @license(?: version)? 1 0
apache : (?:the )?apache(?: software)? @license
mit : (?:released|licensed|distributed|available|provided) under the(?: terms of the)? mit @license
mit : (?:the )?mit @license mit
mit : (?:the )?mit(?: x11| expat)? @license
mit : mit @licensed
mit : opensource org @licenses mit
x11 : (?:the )?x11 @license
expat : (?:the )?expat @license
mit-0 : mit no attribution(?: @license)
mit : @permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit : the above @copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit : the @software is provided as is without warranty of any kind express or implied
isc : @permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc : (?:the )?isc @license
0bsd : (?:bsd )?zero clause(?: bsd)? @license
bsd-2-clause : (?:the )?(?:2|two) clause bsd @license
bsd-2-clause : (?:the )?bsd (?:2|two) clause(?: simplified)? @license
bsd-2-clause : simplified bsd @license
bsd-2-clause : freebsd @license
bsd-3-clause : (?:the )?(?:3|three) clause bsd @license
bsd-3-clause : (?:the )?bsd (?:3|three) clause(?: new| revised)? @license
bsd-3-clause : (?:new|revised|modified) bsd @license
bsd-4-clause : (?:the )?(?:4|four) clause bsd @license
bsd-4-clause : (?:original|old) bsd @license
bsd-4-clause : all @advertising materials mentioning features or use of this software must display
bsd-3-clause : neither the name of .{1,80} nor the names of its @contributors may be used to endorse or promote products
bsd : @redistribution and use in source and binary forms with or without modification are permitted
bsd : @redistributions of source code must retain the above copyright notice
bsd : @redistributions in binary form must reproduce the above copyright notice
bsd : (?:the )?bsd(?: style)? @license
bsd : opensource org @licenses bsd license
bsd-protection : bsd protection @license
gpl-1.0 : gnu general public @license(?: version| v)? 1(?: 0)?
gpl-2.0-or-later : gnu general public @license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0-or-later : gnu general public @license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2.0-only : gnu general public @license as published by the free software foundation version 2
gpl-3.0-only : gnu general public @license as published by the free software foundation version 3
gpl-2.0 : gnu general public @license(?: version| v)? ?2(?: 0)?
gpl-3.0 : gnu general public @license(?: version| v)? ?3(?: 0)?
gpl-2.0-or-later : gpl 2 0 or later @license
gpl-2.0 : gpl(?: version| v)? ?2(?: 0)? @license
gpl-3.0 : gpl(?: version| v)? ?3(?: 0)? @license
gpl-2.0 : gnu org @licenses(?: old licenses)? gpl 2 0
gpl-3.0 : gnu org @licenses gpl 3 0
gpl-2.0 : @gplv2
gpl-3.0 : @gplv3
gpl-2.0-or-later : @gplv2 or later
gpl-3.0-or-later : @gplv3 or later
gpl-2.0-or-later : @gpl v?2(?: 0)? or later
gpl-3.0-or-later : @gpl v?3(?: 0)? or later
gpl : gnu general public @license
gpl : (?:the )?gnu gpl(?: @license)
gpl : (?:the )?gpl @license
gpl : licensed under the @gpl
lgpl-2.0 : gnu library general public @license(?: version)? 2(?: 0)?
lgpl : gnu library general public @license
lgpl-2.1 : gnu lesser general public @license(?: version| v)? 2 1
lgpl-3.0 : gnu lesser general public @license(?: version| v)? 3(?: 0)?
lgpl-2.1-or-later : gnu lesser general public @license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0-or-later : gnu lesser general public @license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
lgpl : gnu lesser general public @license
lgpl-2.1 : @lgplv2 1
lgpl-3.0 : @lgplv3
lgpl-2.1 : @lgpl v?2 1
lgpl-3.0 : @lgpl v?3(?: 0)?
lgpl : (?:the )?lgpl @license
lgpl : licensed under the @lgpl
agpl-3.0 : gnu affero general public @license(?: version| v)? 3(?: 0)?
agpl-3.0-or-later : gnu affero general public @license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-1.0 : affero general public @license(?: version)? 1(?: 0)?
agpl : (?:gnu )?affero general public @license
agpl-3.0 : @agplv3
agpl-3.0 : @agpl v?3(?: 0)?
agpl : (?:the )?agpl @license
gfdl-1.1 : gnu free documentation @license version 1 1
gfdl-1.2 : gnu free documentation @license version 1 2
gfdl-1.3 : gnu free documentation @license version 1 3
gfdl : gnu free documentation @license
gpl-exception-classpath : @classpath exception
gpl-exception-gcc : gcc runtime library @exception
gpl-exception-font : @font exception
gpl-exception-autoconf : autoconf(?: configure script)? @exception
mpl-1.0 : mozilla public @license(?: version| v)? 1 0
mpl-1.1 : mozilla public @license(?: version| v)? 1 1
mpl-2.0 : mozilla public @license(?: version| v)? 2(?: 0)?
mpl-2.0 : subject to the terms of the mozilla public @license v 2 0
mpl-2.0 : mozilla org @mpl 2 0|@mpl 2 0
mpl : mozilla public @license
epl-1.0 : eclipse public @license(?: version| v)? 1 0
epl-2.0 : eclipse public @license(?: version| v)? 2(?: 0)?
epl : eclipse public @license
edl-1.0 : eclipse distribution @license(?: v| version)? 1 0
cddl-1.0 : common development and distribution @license(?: version)? 1 0
cddl-1.1 : common development and distribution @license(?: version)? 1 1
cddl : common development and distribution @license
cpl-1.0 : common public @license(?: version)?(?: 1 0)?
ipl-1.0 : ibm public @license(?: version)?(?: 1 0)?
cpal-1.0 : common public attribution @license(?: version)?(?: 1 0)?
apsl-2.0 : apple public source @license(?: version)? 2(?: 0)?
apsl : apple public source @license
npl-1.1 : netscape public @license(?: version)? 1 1
npl : netscape public @license
spl-1.0 : sun public @license(?: version)?(?: 1 0)?
sissl : sun industry standards source @license
osl-3.0 : open software @license(?: version| v)? 3(?: 0)?
osl : open software @license
afl-3.0 : academic free @license(?: version| v)? 3(?: 0)?
afl : academic free @license
ecl-2.0 : educational community @license(?: version)? 2(?: 0)?
ecl : educational community @license
efl-2.0 : eiffel forum @license(?: version)?(?: 2)?
eupl-1.1 : european union public @license(?: version| v)? 1 1
eupl-1.2 : european union public @license(?: version| v)? 1 2
eupl : european union public @license
cecill-2.1 : cecill(?: free software)? @license(?: agreement)?(?: version)? 2 1
cecill-b : cecill b(?: free software)? @license
cecill-c : cecill c(?: free software)? @license
cecill : cecill(?: free software)? @license
artistic-1.0 : artistic @license(?: version)? 1 0
artistic-2.0 : artistic @license(?: version)? 2 0
artistic : (?:the )?artistic @license
artistic-perl : same terms as @perl(?: 5)? itself
ruby : (?:the )?ruby @license
php-3.01 : php @license(?: version)? 3 01
php-3.0 : php @license(?: version)? 3 0
php : (?:the )?php @license
python-2.0 : python software foundation @license(?: version)?(?: 2)?
psf : psf @license
python-cnri : cnri python @license
zpl-2.1 : zope public @license(?: version| v)? 2 1
zpl : zope public @license
zlib : (?:the )?zlib(?: libpng)? @license
libpng : libpng @license
zlib : this software is provided as is without any express or implied @warranty in no event will the authors be held liable
boost-1.0 : boost software @license(?: version)? 1 0
boost : boost software @license
unlicense : (?:the )?@unlicense
unlicense : this is free and @unencumbered software released into the public domain
public-domain : (?:released|placed|dedicated) (?:in|into|to) the public @domain
public-domain : public @domain dedication
cc0-1.0 : @cc0 1 0(?: universal)?
cc0-1.0 : creative @commons(?: public domain)? zero
cc0 : @cc0
wtfpl : do what the .{1,8} you want to public @license
wtfpl : @wtfpl
beerware : beer ?ware @license
beerware : @beerware
cc-by-1.0 : @cc by 1 0
cc-by-2.0 : @cc by 2 0
cc-by-2.5 : @cc by 2 5
cc-by-3.0 : @cc by 3 0
cc-by-4.0 : @cc by 4 0
cc-by-sa-2.0 : @cc by sa 2 0
cc-by-sa-2.5 : @cc by sa 2 5
cc-by-sa-3.0 : @cc by sa 3 0
cc-by-sa-4.0 : @cc by sa 4 0
cc-by-sa : @cc by sa
cc-by-nd-3.0 : @cc by nd 3 0
cc-by-nd-4.0 : @cc by nd 4 0
cc-by-nd : @cc by nd
cc-by-nc-2.0 : @cc by nc 2 0
cc-by-nc-3.0 : @cc by nc 3 0
cc-by-nc-4.0 : @cc by nc 4 0
cc-by-nc-sa-3.0 : @cc by nc sa 3 0
cc-by-nc-sa-4.0 : @cc by nc sa 4 0
cc-by-nc-sa : @cc by nc sa
cc-by-nc-nd-3.0 : @cc by nc nd 3 0
cc-by-nc-nd-4.0 : @cc by nc nd 4 0
cc-by-nc-nd : @cc by nc nd
cc-by-nc-nd : creative @commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: \d \d)?
cc-by-nc-sa : creative @commons attribution non ?commercial share ?alike(?: \d \d)?
cc-by-nc : creative @commons attribution non ?commercial(?: \d \d)?
cc-by-sa : creative @commons attribution share ?alike(?: \d \d)?
cc-by-nd : creative @commons attribution no ?deriv(?:ative)?s(?: \d \d)?
cc-by : creative @commons attribution(?: \d \d)?
cc : creative @commons(?: license)?
cc-by : creativecommons org @licenses by(?: \d \d)?
cc-by-sa : creativecommons org @licenses by sa(?: \d \d)?
cc-by-nc : creativecommons org @licenses by nc(?: \d \d)?
cc-by-nc-sa : creativecommons org @licenses by nc sa(?: \d \d)?
cc-by-nc-nd : creativecommons org @licenses by nc nd(?: \d \d)?
odbl-1.0 : open database @license(?: odbl)?(?: v?1 0)?
odc-by-1.0 : open data commons attribution @license(?: v?1 0)?
pddl-1.0 : public domain dedication and @license
ofl-1.1 : sil open font @license(?: version)?(?: 1 1)?
ofl : open font @license
ubuntu-font-1.0 : ubuntu font @licen[cs]e
ms-pl : microsoft public @license
ms-rl : microsoft reciprocal @license
ms-limited : microsoft limited public @license
ncsa : university of illinois(?: ncsa)? open source @license
ncsa : ncsa open source @license
postgresql : (?:the )?postgresql @license
openssl : openssl @license
ssleay : original ssleay @license
curl : (?:the )?curl @license
openldap : openldap public @license
openldap-2.8 : openldap public @license version 2 8
w3c : w3c software(?: notice and)? @license
unicode : unicode(?: data files and software)?(?: inc)? @license(?: agreement)?
icu : icu @license
json : (?:the )?json @license
json : the software shall be used for @good not evil
ijg : independent jpeg @group
freetype : freetype(?: project)? @license
imagemagick : imagemagick @license
info-zip : info zip @license
lppl-1.3c : latex project public @license(?: version)? 1 3c?
lppl : latex project public @license
vim : (?:the )?vim @license
sleepycat : sleepycat @license
qpl-1.0 : q public @license(?: version)?(?: 1 0)?
rpl-1.5 : reciprocal public @license(?: version)?(?: 1 5)?
intel : intel open source @license
nasa-1.3 : @nasa open source agreement|nasa open source @license
naumen : naumen public @license
nokia : nokia open source @license
frameworx : frameworx(?: open)? @license
fair : (?:the )?fair @license
watcom-1.0 : sybase open watcom public @license
tcl : tcl tk @license
xfree86-1.1 : xfree86 @license(?: 1 1)?
ntp : (?:the )?ntp @license
hpnd : historical @permission notice and disclaimer
upl-1.0 : universal permissive @license(?: v?1 0)?
mulan-psl-2.0 : mulan permissive software @license(?: v?2)?
blueoak-1.0.0 : blue oak model @license
parity : parity public @license
hippocratic : hippocratic @license
elastic-2.0 : elastic @license(?: version)?(?: 2 0)?
sspl-1.0 : server side public @license(?: version)?(?: v?1)?
busl-1.1 : business source @license(?: version)?(?: 1 1)?
commons-clause : commons clause(?: @license)
polyform-nc : polyform non ?commercial @license
polyform-sb : polyform small business @license
rail : (?:open )?rail(?: m)? @license
openrail : creativeml open rail m(?: @license)
llama : llama(?: \d)? community @license
proprietary : all @rights reserved
proprietary : proprietary and @confidential
proprietary : end user @license agreement
proprietary : commercial @license
dual-license : dual @licensed under
license-file : see the @license file
license-notice : you may not use this file except in compliance with the @license
license-notice : distributed under the terms of the .{1,40} @license
copyright-notice : @copyright c? ?(?:19|20)\d\d
"""

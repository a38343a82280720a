"""Sentences of license texts and notices, beside those in licenses.PHRASES."""

# As (label, pattern, keyword). Written from the texts of the licenses.
SENTENCES = r"""
mit | subject to the following conditions: the above copyright notice | notice
mit | to permit persons to whom the software is furnished to do so | furnished
mit | tort or otherwise, arising from, out of or in connection with | arising
mit-0 | persons to whom the software is furnished to do so\. the software | furnished
mit-advertising | materials and documentation mentioning features or use of this software must acknowledge | acknowledge
mit-feh | copies of the software and its documentation and acknowledgment shall be given | acknowledgment
mit-enna | be included in all copies of the software, its documentation and marketing | marketing
x11 | this notice, the name of the x consortium shall not be used | consortium
hpnd | not be used in advertising or publicity pertaining to distribution | publicity
hpnd | makes no representations about the suitability of this software for any purpose | suitability
isc | of use, data or profits, whether in an action of contract, negligence | negligence
0bsd | for any purpose with or without fee is hereby granted\. the software | hereby
bsd | this list of conditions and the following disclaimer in the documentation | disclaimer
bsd | implied warranties, including, but not limited to, the implied warranties of merchantability | merchantability
bsd | procurement of substitute goods or services; loss of use, data, or profits | procurement
bsd | even if advised of the possibility of such damage | possibility
bsd-3-clause | may be used to endorse or promote products derived from this software | endorse
bsd-4-clause | this product includes software developed by .{1,80}? and its contributors | contributors
bsd-4-clause-uc | this product includes software developed by the university of california | california
bsd-2-clause-patent | each copyright holder and contributor hereby grants to those receiving rights under | contributor
bsd-3-clause-lbnl | you are under no obligation whatsoever to provide any bug fixes, patches | obligation
bsd-3-clause-no-nuclear | use in the design, construction, operation or maintenance of any nuclear facility | nuclear
bsd-source-code | code must retain the copyright notice and this list of conditions, unmodified | unmodified
bsd-protection | this license shall not be construed as permitting | construed
apache-1.0 | product includes software developed by the apache group for use | apache
apache-1.1 | this product includes software developed by the apache software foundation | foundation
apache-1.1 | products derived from this software may not be called "?apache"? | derived
apache-2.0 | "license" shall mean the terms and conditions for use, reproduction, and distribution | reproduction
apache-2.0 | license\. subject to the terms and conditions of this license, each contributor | contributor
apache-2.0 | grant of copyright license\. subject to the terms and conditions of this | copyright
apache-2.0 | cause any modified files to carry prominent notices stating that you changed | prominent
apache-2.0 | includes a "?notice"? text file as part of its distribution | distribution
apache-2.0 | you explicitly state otherwise, any contribution intentionally submitted for inclusion | intentionally
apache-2.0 | enclosed by brackets "\[\]" replaced with your own identifying information | brackets
gpl | preamble the licenses for most software are designed to take away your | preamble
gpl | general public license is intended to guarantee your freedom to share | guarantee
gpl | we speak of free software, we are referring to freedom, not price | referring
gpl | the precise terms and conditions for copying, distribution and modification follow | precise
gpl | general public license does not permit incorporating your program into proprietary programs | incorporating
gpl-1.0 | gnu general public license version 1, february 1989 | february
gpl-2.0 | gnu general public license version 2, june 1991 | june
gpl-2.0 | any work that you distribute or publish, that in whole | publish
gpl-2.0 | accompany it with the complete corresponding machine-readable source code | machine-readable
gpl-2.0 | the program \(or any work based on the program\), the recipient automatically | automatically
gpl-3.0 | gnu general public license version 3, 29 june 2007 | june
gpl-3.0 | no covered work shall be deemed part of an effective technological measure | technological
gpl-3.0 | the "?corresponding source"? for a work in object code form | corresponding
gpl-3.0 | "?covered work"? means either the unmodified program or a work | unmodified
gpl-3.0 | you may convey verbatim copies of the program's source code as you | convey
gpl-3.0 | time you convey a covered work, the recipient automatically receives a license | recipient
gpl-3.0 | installation information for a user product means any methods, procedures | procedures
gpl-with-bison-exception | larger work that contains part or all of the bison parser skeleton | bison
gpl-with-font-exception | document which uses this font, and embed this font or unaltered portions | unaltered
gpl-with-linking-exception | as a special exception, the copyright holders .{0,60}? give you permission | exception
gpl-with-libtool-exception | part of a program or library that is built using gnu libtool | libtool
gpl-with-openssl-exception | code of (?:portions of )?this program with the openssl library | openssl
gpl-with-syscall-note | cover user programs that use kernel services by normal system calls | kernel
lgpl | this library is free software[;:,] you can redistribute it and/or modify it | library
lgpl-2.0 | gnu library general public license version 2, june 1991 | june
lgpl-2.1 | gnu lesser general public license version 2\.1, february 1999 | february
lgpl-2.1 | "?lesser"? general public license because it does less to protect | protect
lgpl-2.1 | library"?\. such a work, in isolation, is not a derivative work | isolation
lgpl-2.1 | sections above, you may also combine or link a "?work | combine
lgpl-3.0 | gnu lesser general public license version 3, 29 june 2007 | june
lgpl-3.0 | and conditions of version 3 of the gnu general public license, supplemented | supplemented
lgpl-3.0 | is a work produced by combining or linking an application with | combining
agpl-3.0 | gnu affero general public license version 3, 19 november 2007 | november
agpl-3.0 | specifically designed to ensure cooperation with the community in the case | cooperation
agpl-3.0 | prominently offer all users interacting with it remotely through a computer network | remotely
agpl-1.0 | affero general public license version 1, march 2002 | march
gfdl | license is to make a manual, textbook, or other functional and useful | textbook
gfdl | with no invariant sections, (?:with )?no front-cover texts | invariant
gfdl-1.1 | gnu free documentation license version 1\.1, march 2000 | march
gfdl-1.2 | gnu free documentation license version 1\.2, november 2002 | november
gfdl-1.3 | gnu free documentation license version 1\.3, 3 november 2008 | november
mpl-1.0 | of this file are subject to the mozilla public license version 1\.0 | mozilla
mpl-1.1 | the initial developer of the original code is | developer
mpl-1.1 | alternatively, the contents of this file may be used under the terms | alternatively
mpl-2.0 | you can obtain one at https?://mozilla\.org/mpl/2\.0 | mozilla
mpl-2.0 | each contributor hereby grants you a world-wide, royalty-free, non-exclusive license | royalty-free
mpl-2.0 | work"? means a work that combines covered software with other material | combines
npl-1.1 | subject to the netscape public license version 1\.1 | netscape
epl-1.0 | provided under the terms of this eclipse public license \(?"?agreement | eclipse
epl-1.0 | eclipse public license v1\.0 which accompanies this distribution | accompanies
epl-2.0 | eclipse public license (?:v\. ?)?2\.0 which | eclipse
edl-1.0 | eclipse distribution license v\.? ?1\.0 which | eclipse
cddl-1.0 | opensolaris\.org/os/licensing | opensolaris
cddl | of this file are subject to the terms of the common development | development
cpl-1.0 | reproduction or distribution of the program constitutes recipient's acceptance of this agreement | constitutes
cpal-1.0 | display of attribution information is required in larger works | attribution
ipl-1.0 | accompanying program is provided under the terms of this ibm public license | ibm
spl-1.0 | subject to the sun public license version 1\.0 | sun
sissl | subject to the sun industry standards source license version 1\.[12] | industry
apsl-2.0 | subject to the apple public source license version 2\.0 | apple
apsl-1.1 | subject to the apple public source license version 1\.1 | apple
rpl-1.5 | governed by the reciprocal public license version 1\.5 | reciprocal
osl-3.0 | licensed under the open software license version 3\.0 | software
afl-2.1 | licensed under the academic free license version 2\.1 | academic
afl-3.0 | licensed under the academic free license version 3\.0 | academic
nposl-3.0 | licensed under the non-profit open software license version 3\.0 | non-profit
ecl-2.0 | licensed under the educational community license,? version 2\.0 | educational
artistic-1.0 | this package in any way, provided that you insert a prominent notice | prominent
artistic-1.0 | the copyright holder maintains some semblance of artistic control over the development | semblance
artistic-2.0 | you are permitted to use the standard version and create and use | permitted
artistic-2.0 | you the right to use any trademark, service mark, tradename, or logo | tradename
perl-5 | under the same terms as perl itself | perl
perl-5 | either the gnu general public license or the artistic license | artistic
ruby | it and/or modify it under either the terms of the 2-clause bsdl | bsdl
python-2.0 | licensor hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze | nonexclusive
python-2.0 | by copying, installing or otherwise using python, licensee agrees to be bound | licensee
cnri-python | corporation for national research initiatives | initiatives
zope-2.1 | zope public license \(zpl\) version 2\.1 | zope
zope-2.1 | subject to the provisions of the zope public license | zope
tcl | hereby grant permission to use, copy, modify, distribute, and license this software | distribute
tcl | no event shall the authors or distributors be liable to any party | distributors
tk | government use: if you are acquiring this software on behalf | acquiring
php-3.0 | this product includes php(?: software)?, freely available from | freely
php-3.01 | products derived from this software may not be called "php" | derived
zend-2.0 | subject to version 2\.0 of the zend (?:engine )?license | zend
openssl | the names "openssl toolkit" and "openssl project" must not be used | toolkit
openssl | redistributions of any form whatsoever must retain the following acknowledgment | acknowledgment
ssleay | licence and distribution terms for any publically available version or derivative | publically
curl | notice, the name of a copyright holder shall not be used | holder
postgresql | no event shall the university of california be liable to any party | california
postgresql | has no obligations to provide maintenance, support, updates, enhancements, or modifications | enhancements
zlib | to anyone to use this software for any purpose, including commercial applications | commercial
zlib | this notice may not be removed or altered from any source distribution | altered
zlib-acknowledgement | an acknowledgement \(see the following\) in the product documentation is required | acknowledgement
libpng-2.0 | the png reference library is supplied "as is" | supplied
libtiff | the names of sam leffler and silicon graphics may not be used | leffler
ijg | is based in part on the work of the independent jpeg group | jpeg
freetype | portions of this software are copyright .{0,30}?the freetype project | freetype
freetype | the freetype project is copyright .{0,30}?by david turner | freetype
bsl-1.0 | or derivative works are solely in the form of machine-executable object code | machine-executable
unicode | unicode data files | unicode
w3c | by obtaining, using and/or copying this work, you \(the licensee\) agree | obtaining
w3c-19980720 | the software or documentation will not infringe any third party patents | infringe
naist | nara institute of science and technology .{0,60}?all rights reserved | nara
ncsa | deal with the software without restriction, including without limitation the rights | restriction
vim | vim is charityware | charityware
unlicense | in jurisdictions that recognize copyright laws, the author or authors of this | jurisdictions
unlicense | of the public at large and to the detriment of our heirs | detriment
cc0-1.0 | the laws of most jurisdictions throughout the world automatically confer exclusive copyright | jurisdictions
cc0-1.0 | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives | affirmer
cc-by-4.0 | by exercising the licensed rights .{0,40}?you accept and agree to be | exercising
cc-by-sa-4.0 | bound by the terms and conditions of this creative commons attribution-sharealike 4\.0 | attribution-sharealike
cc-by-nc-4.0 | bound by the terms and conditions of this creative commons attribution-noncommercial 4\.0 | attribution-noncommercial
cc-by-nd-4.0 | bound by the terms and conditions of this creative commons attribution-noderivatives 4\.0 | attribution-noderivatives
creative-commons | creative commons corporation is not a law firm and does not provide | corporation
creative-commons | other applicable law\. any use of the work other than as authorized | authorized
creative-commons | some rights reserved | reserved
ogl-uk-3.0 | contains public sector information licensed under the open government licence v3\.0 | sector
ogl-uk | re-use the information that is available under this licence freely and flexibly | flexibly
odbl-1.0 | any rights in individual contents of the database are licensed under | individual
pddl-1.0 | is made available under the public domain dedication and license v1\.0 | dedication
odc-by-1.0 | is made available under the open data commons attribution license | commons
cdla-permissive-2.0 | community data license agreement -? ?permissive | permissive
cdla-sharing-1.0 | community data license agreement -? ?sharing | sharing
etalab-2.0 | licence ouverte ?/ ?open licence | ouverte
ofl-1.1 | the fonts and derivatives, however, cannot be released under any other type | derivatives
ofl-1.1 | modified version of the font software may use the reserved font name | reserved
ubuntu-font-1.0 | ubuntu font licence version 1\.0 | ubuntu
arphic-1999 | arphic public license | arphic
bitstream-vera | fonts are allowed on condition .{0,60}?bitstream vera | bitstream
ms-pl | any contributor over patents that you claim are infringed by the software | infringed
ms-rl | code from the software .{0,60}?you must provide recipients the source code | recipients
ms-lpl | this license is limited to use on the windows platform | windows
eupl-1.1 | licen[sc]ed under the eupl,? version 1\.1 | eupl
eupl-1.2 | licen[sc]ed under the eupl,? version 1\.2 | eupl
cecill-2.1 | this software is governed by the cecill license under french law | cecill
cecill | circulated by cea, cnrs and inria | inria
qpl-1.0 | you may make modifications to the software and distribute your modifications | modifications
lppl | distributed and/or modified under the conditions of the latex project public license | latex
lppl | the current maintainer of this work is | maintainer
sleepycat | redistributions in any form must be accompanied by information on how | accompanied
watcom-1.0 | sybase open watcom public license | watcom
intel | each intel corporation contributor | intel
nasa-1.3 | this open source agreement .{0,40}?defines the rights of use, reproduction, distribution | defines
jpnic | japan network information center\. all rights reserved | japan
beerware | retain this notice you can do whatever you want with this stuff | stuff
json | json license | json
upl-1.0 | which the software is contributed by such licensors | licensors
mulan-psl-2.0 | software according to the terms and conditions of the mulan psl v2 | mulan
blueoak-1.0.0 | this license gives everyone as much permission to work with this software | everyone
sspl-1.0 | making the functionality of the program or modified version available to third | functionality
busl-1.1 | the licensor hereby grants you the right to copy, modify, create derivative | licensor
busl-1.1 | change date: .{4,30}? change license | change
elastic-2.0 | you may not move, change, disable, or circumvent the license key functionality | circumvent
polyform-noncommercial-1.0.0 | any noncommercial purpose is a permitted purpose | noncommercial
polyform-shield-1.0.0 | purpose is a permitted purpose, except for providing any product that competes | competes
prosperity-3.0.0 | you to use and share this software for noncommercial purposes for free | noncommercial
llama | is licensed under the llama \d(?:\.\d)? community license | community
openrail | use-based restrictions .{0,80}?shall be included as an enforceable provision | enforceable
proprietary | this (?:document|file|program) contains (?:confidential|proprietary) information | information
proprietary | (?:copied|disclosed|used|reproduced) except (?:as (?:expressly )?(?:permitted|authorized)|in accordance) | except
proprietary | licensed, not sold | licensed
proprietary | you may not reverse engineer, decompile,? or disassemble | decompile
commercial | by installing or using (?:this|the) software,? you agree | installing
"""

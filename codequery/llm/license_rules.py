"""Signatures of licences, written by hand: regexes over lower-case words parted by single spaces.

A rule is (label, regex). Bodies are sentences of licence texts and of their usual notices, exceptions are permissions
that go with another licence, dual rules name a choice, names and short names stand for a licence without a version,
hints say only that there is some licence.
"""

from __future__ import annotations

#: Statements of a choice between licences.
DUAL = (
    ("apache-2.0 or mit", r"(?:dual(?:ly)? )?licen[cs]ed under (?:either of )?(?:the )?apache(?: license)?(?: version)? 2 0 (?:license )?(?:or|and) (?:the )?mit(?: license)?"),
    ("apache-2.0 or mit", r"(?:dual(?:ly)? )?licen[cs]ed under (?:the )?mit(?: license)? (?:or|and) (?:the )?apache(?: license)?(?: version)? 2 0"),
    ("apache-2.0 or mit", r"spdx license identifier (?:mit or apache 2 0|apache 2 0 or mit)"),
    ("artistic or gpl", r"(?:under the )?same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself"),
    ("artistic or gpl", r"either the gnu general public license .{0,60}?or the artistic license"),
    ("bsd or gpl", r"dual bsd gpl"),
    ("bsd or gpl", r"alternatively this software may be distributed under the terms of the gnu general public license"),
    ("gpl or mit", r"dual mit gpl"),
    ("gpl or mit", r"dual(?:ly)? licensed under the mit (?:and|or) gpl(?: version 2)?(?: licenses)?"),
    ("gpl or lgpl or mpl", r"version mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("gpl or lgpl or mpl", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("cddl or gpl", r"(?:dual(?:ly)? licensed under )?(?:the )?cddl(?: 1 1)? (?:and|or) gpl(?: v)? ?2(?: with classpath exception)?"),
    ("cddl or gpl", r"either the gnu general public license version 2 only gpl or the common development and distribution license"),
    ("epl or gpl", r"this program and the accompanying materials are made available under the terms of the eclipse public license .{0,120}?gnu general public license"),
    ("lgpl or mpl", r"dual(?:ly)? licensed under the mpl(?: 1 1)? and (?:the )?lgpl(?: 2 1)?"),
    ("cc0 or mit", r"spdx license identifier (?:mit or cc0 1 0|cc0 1 0 or mit)"),
    ("mit or unlicense", r"dual(?:ly)? licensed under the unlicense and mit"),
    ("mit or unlicense", r"spdx license identifier (?:unlicense or mit|mit or unlicense)"),
    ("bsd-3-clause or gpl", r"spdx license identifier (?:gpl 2 0(?: only| or later)? or bsd 3 clause|bsd 3 clause or gpl 2 0(?: only| or later)?)"),
    ("commercial or gpl", r"commercial license usage licensees holding valid commercial .{0,40}?licen[cs]es"),
    ("commercial or gpl", r"alternatively this (?:file|program|software) may be used under a commercial licen[cs]e"),
)
#: Permissions beside a licence.
EXCEPTIONS = (
    ("classpath-exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("classpath-exception", r"(?:subject to the|designates this particular file as subject to the|with(?: the)?) classpath exception"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("gcc-exception", r"you have permission to propagate a work of target code formed by combining the runtime library with independent modules"),
    ("gcc-exception", r"if you link this library with files compiled with gcc to produce an executable"),
    ("bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("autoconf-exception", r"autoconf configure script exception"),
    ("libtool-exception", r"if you distribute this file as part of a program or library that is built using gnu libtool"),
    ("font-exception", r"as a special exception if you create a document which uses this font"),
    ("font-exception", r"gpl font exception|with font exception(?: 2 0)?"),
    ("openssl-exception", r"permission to link the code of portions of this program with the openssl(?: project s)?(?: openssl)? library"),
    ("openssl-exception", r"in addition as a special exception .{0,80}?openssl"),
    ("llvm-exception", r"llvm exceptions? to the apache 2 0 license"),
    ("llvm-exception", r"apache(?: license)?(?: v| version)? ?2 0 with llvm exceptions?"),
    ("linux-syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("linux-syscall-note", r"with linux syscall note"),
    ("qt-lgpl-exception", r"digia gives you certain additional rights|the qt company gives you certain additional rights"),
    ("qt-gpl-exception", r"the qt company gpl exception 1 0"),
    ("swift-exception", r"runtime library exception to the apache 2 0 license"),
    ("wxwindows-exception", r"wxwindows library licen[cs]e(?: version 3 1)?"),
    ("wxwindows-exception", r"the copyright holders of this library give permission for additional uses of the text contained in this release of the library"),
    ("ecos-exception", r"if other files instantiate templates or use macros or inline functions from this file"),
    ("linking-exception", r"as a special exception .{0,60}?permission to link this (?:program|library|code|work)"),
    ("linking-exception", r"static(?:ally)? link(?:ing)? exception|with (?:a |the )?linking exception"),
    ("freertos-exception", r"freertos(?: gpl)? exception"),
    ("u-boot-exception", r"u boot exception 2 0"),
    ("ocaml-exception", r"ocaml lgpl linking exception"),
    ("universal-foss-exception", r"universal f(?:oss|ree and open source software) exception(?: version 1 0)?"),
)
#: Sentences of licences and notices.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"(?:use of this source code is governed by|this (?:project|software|code|library|package) is (?:licensed|released|available|distributed) under) (?:an?|the) mit(?: style)? license"),
    ("x11", r"except as contained in this notice the name s? ?of the above copyright holders shall not be used in advertising"),
    ("x11", r"x window system is a trademark of"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", r"bsd zero clause license|zero clause bsd(?: license)?"),
    ("bsd", r"redistributions? and use in source and binary forms with or without modification(?:s)?(?: are permitted)?"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", r"neither the names? of .{1,80}? (?:nor|or) the names of (?:its|the|other|any) (?:contributors|authors|copyright holders?)"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", r"bsd 2 clause plus patent license"),
    ("bsd-source-code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer neither"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", r"you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", r"www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", r"the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.0", r"this software consists of voluntary contributions made by many individuals on behalf of the apache group"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)"),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", r"gnu general public license version 2 june 1991"),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version"),
    ("gpl-2.0", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published"),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", r"either version 3 of the license or at your option any later version"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-1.0", r"either version 1 or at your option any later version"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file|package)"),
    ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", r"gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", r"if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license(?: version 1 [01])?"),
    ("epl-2.0", r"are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", r"are made available under the terms of the eclipse public license v?(?: |version )?1 0"),
    ("epl", r"www eclipse org legal epl v(?:10|20|1 0|2 0)(?: html)?"),
    ("eupl", r"licen[cs]ed under the eupl(?: v| version)? ?1 [012]"),
    ("eupl", r"you may not use this work except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at .{0,40}?eupl"),
    ("cddl", r"the contents of this file are subject to the terms of (?:the|either the) common development and distribution license"),
    ("cddl", r"you can obtain a copy of the license at usr src opensolaris license"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license"),
    ("boost-1.0", r"distributed under the boost software license version 1 0"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("libpng", r"this code is released under the libpng license"),
    ("libtiff", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that i the above"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", r"portions of this software are copyright .{0,30}?the freetype project"),
    ("freetype", r"the freetype project license|freetype license ftl"),
    ("curl", r"copyright and permission notice copyright c .{0,20}?daniel stenberg"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", r"the names openssl toolkit and openssl project must not be used to endorse"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("cc0", r"to the extent possible under law .{0,60}?has waived all copyright and related or neighboring rights"),
    ("cc0", r"creative commons org publicdomain zero 1 0|creativecommons org publicdomain zero 1 0"),
    ("cc0", r"cc0 1 0 universal(?: public domain dedication)?"),
    ("cc-pdm", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-sa-3.0", r"text is available under the creative commons attribution share ?alike license"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("psf-2.0", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("cnri-python", r"corporation for national research initiatives having an office at 1895 preston white drive"),
    ("beopen-python", r"beopen com license agreement for python 2 0|beopen python open source license agreement"),
    ("php-3.01", r"this source file is subject to version 3 01 of the php license"),
    ("php-3.0", r"this source file is subject to version 3 0 of the php license"),
    ("ruby", r"you may (?:make and give away|redistribute) .{0,40}?under (?:the terms of the )?(?:same terms as ruby|ruby s? ?license)"),
    ("ruby", r"distributed under the same terms as ruby|under ruby s licen[cs]e"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", r"the font software may be sold as part of a larger software package"),
    ("bitstream-vera", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("upl-1.0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("w3c", r"w3c software notice and license|w3c software and document (?:notice and )?license"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("unicode", r"unicode inc license agreement data files and software"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", r"icu license icu 1 8 1 and later"),
    ("bzip2", r"the bzip2 license|bzip2 and libbzip2 license"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("sqlite-blessing", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("json", r"the software shall be used for good not evil"),
    ("beerware", r"(?:the )?beer ?ware license(?: revision 42)?"),
    ("beerware", r"you can buy me a beer in return"),
    ("zpl-2.1", r"zope public license zpl(?: version)? 2 1"),
    ("latex-lppl", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("latex-lppl", r"this work has the lppl maintenance status"),
    ("odbl-1.0", r"made available under the open database license"),
    ("odbl-1.0", r"opendatacommons org licenses odbl 1 0"),
    ("odc-by-1.0", r"opendatacommons org licenses by 1 0"),
    ("pddl-1.0", r"opendatacommons org licenses pddl 1 0"),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licen[cs]e v3 0"),
    ("ogl-uk", r"open government licen[cs]e(?: for public sector information)?"),
    ("etalab-2.0", r"licence ouverte(?: open licence)?(?: version 2 0)?"),
    ("dl-de-by-2.0", r"datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("cecill-2.1", r"ce logiciel est regi par la licence cecill|ce logiciel est régi par la licence cecill"),
    ("mulanpsl-2.0", r"mulan psl ?v2|mulan permissive software license(?: version 2)?"),
    ("busl-1.1", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause license condition(?: v1 0)?"),
    ("commons-clause", r"the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial-1.0", r"polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business-1.0", r"polyform small business license(?: 1 0 0)?"),
    ("prosperity", r"the prosperity public license(?: 3 0 0)?"),
    ("parity", r"the parity public license(?: 7 0 0)?"),
    ("blue-oak-1.0", r"blue oak model license(?: version)?(?: 1 0 0)?"),
    ("hippocratic", r"hippocratic license(?: version)?(?: 2 1)?"),
    ("openrail-m", r"creativeml open rail m(?: license)?|bigscience (?:open ?)?rail(?: license)?(?: v1 0)?"),
    ("llama-community", r"llama [0-9](?: [0-9])? community license agreement"),
    ("gemma", r"gemma terms of use"),
    ("nvidia-eula", r"nvidia software license agreement|license agreement for nvidia software development kits"),
    ("oracle-bcl", r"oracle binary code license agreement"),
    ("microsoft-eula", r"microsoft software license terms"),
    ("adobe-eula", r"adobe software license agreement"),
    ("public-domain", r"this (?:file|code|software|work|program|document) (?:is|has been) (?:hereby )?(?:placed|put|dedicated|released) (?:in|into|to) the public domain"),
    ("public-domain", r"(?:dedicated to|released into|placed in|put into|in) the public domain"),
    ("public-domain", r"public domain dedication"),
    ("public-domain", r"no copyright is claimed and the author hereby disclaims"),
    ("us-government", r"this is a work of the (?:u s|united states) government and is not subject to copyright protection"),
    ("warranty-disclaimer", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("warranty-disclaimer", r"the software is provided as is without warranty of any kind express or implied"),
    ("warranty-disclaimer", r"this software is provided by the (?:copyright holders?|regents|authors?|contributors?)(?: and contributors?)? as is and any express or implied warranties"),
    ("warranty-disclaimer", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
)
#: Names of licences that have no family of versions.
NAMES = (
    ("adaptive-public", r"adaptive public license"),
    ("apple-psl", r"apple public source license"),
    ("attribution-assurance", r"attribution assurance license"),
    ("bittorrent", r"bittorrent open source license"),
    ("cal-1.0", r"cryptographic autonomy license"),
    ("catosl", r"computer associates trusted open source license"),
    ("cern-ohl", r"cern open hardware licen[cs]e"),
    ("clarified-artistic", r"clarified artistic license"),
    ("condor", r"condor public license"),
    ("cua-opl", r"cua office public license"),
    ("ecl-2.0", r"educational community license"),
    ("efl-2.0", r"eiffel forum license"),
    ("entessa", r"entessa public license"),
    ("eudatagrid", r"eu ?datagrid software license"),
    ("fair", r"fair license"),
    ("frameworx", r"frameworx (?:open )?license"),
    ("free-art", r"free art license|licence art libre"),
    ("hpnd", r"historical permission notice and disclaimer"),
    ("ibm-pl", r"ibm public license"),
    ("intel", r"intel open source license"),
    ("interbase", r"interbase public license"),
    ("jabber", r"jabber open source license"),
    ("leptonica", r"leptonica license"),
    ("liliq", r"licence libre du qu[eé]bec"),
    ("lucent", r"lucent public license"),
    ("mit-0", r"mit no attribution(?: license)?"),
    ("miros", r"miros licen[cs]e"),
    ("motosoto", r"motosoto open source license"),
    ("multics", r"multics license"),
    ("nasa", r"nasa open source agreement"),
    ("naumen", r"naumen public license"),
    ("nethack", r"nethack general public license"),
    ("netscape", r"netscape public license"),
    ("nokia", r"nokia open source license"),
    ("ntp", r"ntp license"),
    ("oclc", r"oclc research public license"),
    ("opl", r"open publication license"),
    ("open-group-test-suite", r"open group test suite license"),
    ("openldap", r"openldap public license"),
    ("phorum", r"phorum license"),
    ("python-2.0", r"python license"),
    ("ricoh", r"ricoh source code public license"),
    ("rpl", r"reciprocal public license"),
    ("rpsl", r"realnetworks public source license"),
    ("ruby", r"ruby license"),
    ("sgi-b", r"sgi free software license b"),
    ("simpl", r"simple public license"),
    ("sissl", r"sun industry standards source license"),
    ("sun-pl", r"sun public license"),
    ("sybase", r"sybase open watcom public license"),
    ("tapr-ohl", r"tapr open hardware license"),
    ("vim", r"vim license"),
    ("vovida", r"vovida software license"),
    ("watcom", r"open watcom public license"),
    ("wxwidgets", r"wxwidgets licen[cs]e"),
    ("xnet", r"x net license"),
    ("zope", r"zope public license"),
    ("kde-eula", r"kde free qt foundation"),
    ("imagemagick", r"imagemagick license"),
    ("info-zip", r"info zip license"),
    ("net-snmp", r"net snmp license"),
    ("yahoo-pl", r"yahoo public license"),
)
#: Words that say no more than that a licence or a copyright is near.
HINTS = (
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"proprietary licen[cs]e"),
    ("proprietary", r"commercial licen[cs]e"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("license-reference", r"licen[cs]ed under"),
    ("license-reference", r"see (?:the )?licen[cs]e(?: file| txt| md)?(?: for)?"),
    ("license-reference", r"under the terms of the licen[cs]e"),
    ("license-reference", r"(?:refer to|read|accept) the (?:end user )?licen[cs]e agreement"),
    ("license-reference", r"spdx license identifier"),
    ("license-reference", r"open source licen[cs]es?"),
    ("license-reference", r"free software foundation"),
    ("non-commercial", r"for non ?commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", r"(?:academic|research|personal) use only"),
)

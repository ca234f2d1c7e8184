"""License signatures, written by hand, in order: those of one priority that come first win over later ones.

An expression runs over lower-case words joined by single blanks. ``<lic>`` is either spelling of license, ``<the>`` an optional article,
``<v:...>`` a version (its digits by blanks), which is appended to the label. Columns: label, expression, priority, confidence.
"""

SIGNATURES = (
    # Identifiers that name a license outright.
    ("mit", r"spdx <lic> identifier mit", 10, 1.0),
    ("apache", r"spdx <lic> identifier apache<v:1 0|1 1|2 0>", 10, 1.0),
    ("gpl", r"spdx <lic> identifier gpl<v:1 0|2 0|3 0>(?: only| or later)?", 10, 1.0),
    ("lgpl", r"spdx <lic> identifier lgpl<v:2 0|2 1|3 0>(?: only| or later)?", 10, 1.0),
    ("agpl", r"spdx <lic> identifier agpl<v:1 0|3 0>(?: only| or later)?", 10, 1.0),
    ("fdl", r"spdx <lic> identifier gfdl<v:1 1|1 2|1 3>", 10, 1.0),
    ("bsd", r"spdx <lic> identifier bsd<v:1 clause|2 clause|3 clause|4 clause>", 10, 1.0),
    ("bsd-0-clause", r"spdx <lic> identifier 0bsd", 10, 1.0),
    ("mpl", r"spdx <lic> identifier mpl<v:1 0|1 1|2 0>", 10, 1.0),
    ("epl", r"spdx <lic> identifier epl<v:1 0|2 0>", 10, 1.0),
    ("isc", r"spdx <lic> identifier isc", 10, 1.0),
    ("zlib", r"spdx <lic> identifier zlib", 10, 1.0),
    ("boost", r"spdx <lic> identifier bsl<v:1 0>", 10, 1.0),
    ("unlicense", r"spdx <lic> identifier unlicense", 10, 1.0),
    ("cc0", r"spdx <lic> identifier cc0 1 0", 10, 1.0),
    ("cc-by-nc-sa", r"spdx <lic> identifier cc by nc sa<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    ("cc-by-nc-nd", r"spdx <lic> identifier cc by nc nd<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    ("cc-by-nc", r"spdx <lic> identifier cc by nc<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    ("cc-by-sa", r"spdx <lic> identifier cc by sa<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    ("cc-by-nd", r"spdx <lic> identifier cc by nd<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    ("cc-by", r"spdx <lic> identifier cc by<v:1 0|2 0|2 5|3 0|4 0>", 10, 1.0),
    # Phrases of full texts.
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 9, 0.95),
    ("mit", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions", 9, 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 9, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 8, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 8, 0.9),
    ("bsd-3-clause", r"neither the name of [\w ]{1,80}? nor the names of its contributors may be used to endorse or promote products", 9, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 9, 0.95),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 9, 0.95),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 8, 0.85),
    ("gpl", r"free software foundation either version <n:1|2|3> of the <lic> or at your option any later version", 9, 0.95),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public <lic>", 9, 0.95),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public <lic>", 9, 0.95),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public <lic>", 9, 0.95),
    ("gpl", r"the <lic>s for most software are designed to take away your freedom to share and change it", 9, 0.95),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this <lic> document", 7, 0.8),
    ("agpl", r"is a free copyleft <lic> for software and other kinds of works specifically designed to ensure cooperation with the community", 9, 0.95),
    ("apache-2.0", r"you may not use this file except in compliance with the <lic>", 8, 0.85),
    ("apache-2.0", r"apache <lic> version 2 0 january 2004", 9, 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the <lic> is distributed on an as is basis", 9, 0.95),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 8, 0.85),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public <lic> v 2 0", 9, 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public <lic> version 1 1", 9, 1.0),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public <lic><v?:1 0|2 0>", 9, 0.95),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", 8, 0.85),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 9, 0.95),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 9, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 9, 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 8, 0.9),
    ("wtfpl", r"you just do what the fuck you want to", 9, 0.95),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 9, 1.0),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 9, 0.95),
    ("artistic-2.0", r"this <lic> establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 9, 0.95),
    ("ofl-1.1", r"the goals of the open font <lic> ofl are to stimulate worldwide development of collaborative font projects", 9, 0.95),
    ("ofl", r"this font software is licensed under the sil open font <lic><v?:1 0|1 1>", 9, 0.95),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", 9, 0.95),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same <lic> as the original", 8, 0.85),
    ("cc-by", r"you must give appropriate credit provide a link to the <lic> and indicate if changes were made", 7, 0.7),
    ("cc-by-nc", r"you may not use the material for commercial purposes", 7, 0.7),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", 8, 0.85),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 8, 0.85),
    ("openssl", r"this product includes software developed by the openssl project", 9, 0.95),
    ("openssl", r"this product includes cryptographic software written by eric young", 8, 0.9),
    ("php", r"this product includes php software freely available from", 9, 0.95),
    ("python", r"python software foundation <lic> version 2", 9, 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 9, 0.95),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", 8, 0.85),
    ("x11", r"except as contained in this notice the name of [\w ]{1,60}? shall not be used in advertising or otherwise to promote the sale", 9, 0.95),
    ("json", r"the software shall be used for good not evil", 9, 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution <lic>", 9, 0.95),
    ("cpl-1.0", r"this program is made available under the terms of the common public <lic> version 1 0", 9, 0.95),
    ("eupl", r"licen[sc]ed under the eupl(?: only)?(?: <lic>)?<v?:1 0|1 1|1 2>", 9, 0.95),
    ("sspl-1", r"server side public <lic> version 1 october 16 2018", 9, 1.0),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 9, 0.95),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 9, 0.95),
    ("ms-pl", r"this <lic> governs use of the accompanying software if you use the software you accept this <lic>", 8, 0.85),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 10, 1.0),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan (?:psl|publ)", 9, 0.95),
    ("llama-community", r"llama <n:2|3|3 1|3 2|3 3|4> community <lic> agreement", 9, 1.0),
    ("openrail", r"creativeml open ?rail m(?: <lic>)?", 9, 0.95),
    ("openrail", r"bigscience(?: bloom)? (?:open )?rail(?: m)?(?: <lic>)?", 9, 0.95),
    ("gemma", r"gemma terms of use", 8, 0.9),
    ("fair-noncommercial", r"fair noncommercial research <lic>", 9, 0.95),
    # Notices: a verb and the name of a license.
    ("mit", r"<under>(?:x11 )?mit(?: style)? <lic>", 7, 0.95),
    ("mit", r"<under>mit", 6, 0.85),
    ("apache", r"<under>apache(?: software)? <lic><v?:1 0|1 1|2 0|2>", 7, 0.95),
    ("apache", r"<under>apache<v:1 0|1 1|2 0|2>", 7, 0.9),
    ("gpl", r"<under>(?:gnu )?(?:general public <lic>|gpl)(?: gpl)?<v?:1|2|3>", 7, 0.95),
    ("gpl", r"<under>gnu general public", 6, 0.9),
    ("lgpl", r"<under>(?:gnu )?(?:(?:lesser|library) general public(?: <lic>)?|lgpl)(?: lgpl)?<v?:2 1|2|3>", 7, 0.95),
    ("agpl", r"<under>(?:gnu )?(?:affero general public(?: <lic>)?|agpl)(?: agpl)?<v?:1|3>", 7, 0.95),
    ("fdl", r"<under>(?:gnu )?(?:free documentation(?: <lic>)?|gfdl|fdl)<v?:1 1|1 2|1 3>", 7, 0.95),
    ("bsd", r"<under>(?:new |modified |simplified |revised |original )?bsd(?: style)?(?: <lic>)?<v?:0 clause|1 clause|2 clause|3 clause|4 clause>", 7, 0.9),
    ("bsd", r"<under>(?:2|two|3|three|4|four) clause bsd(?: <lic>)?", 7, 0.95),
    ("mpl", r"<under>(?:mozilla public(?: <lic>)?|mpl)(?: mpl)?<v?:1 0|1 1|2 0>", 7, 0.95),
    ("epl", r"<under>(?:eclipse public(?: <lic>)?|epl)<v?:1 0|2 0>", 7, 0.95),
    ("cddl", r"<under>(?:common development and distribution(?: <lic>)?|cddl)<v?:1 0|1 1>", 7, 0.95),
    ("cpl", r"<under>common public(?: <lic>)?<v?:1 0>", 7, 0.95),
    ("eupl", r"<under>(?:european union public(?: <lic>)?|eupl)<v?:1 0|1 1|1 2>", 7, 0.95),
    ("artistic", r"<under>(?:perl )?artistic(?: <lic>)?<v?:1 0|2 0>", 7, 0.9),
    ("afl", r"<under>academic free(?: <lic>)?<v?:2 1|3 0>", 7, 0.95),
    ("osl", r"<under>open software(?: <lic>)?<v?:1 0|2 1|3 0>", 7, 0.9),
    ("ofl", r"<under>(?:sil )?open font(?: <lic>)?<v?:1 0|1 1>", 7, 0.95),
    ("isc", r"<under>isc(?: <lic>)?", 7, 0.9),
    ("zlib", r"<under>zlib(?: libpng)?(?: <lic>)?", 7, 0.9),
    ("boost", r"<under>boost(?: software)?(?: <lic>)?<v?:1 0>", 7, 0.9),
    ("unlicense", r"<under>unlicense", 7, 0.95),
    ("wtfpl", r"<under>(?:wtfpl|do what the fuck you want to public(?: <lic>)?)<v?:2>", 7, 0.95),
    ("ncsa", r"<under>(?:university of illinois )?ncsa(?: open source)?(?: <lic>)?", 7, 0.9),
    ("postgresql", r"<under>postgresql(?: <lic>)?", 7, 0.9),
    ("openssl", r"<under>openssl(?: <lic>)?", 7, 0.9),
    ("php", r"<under>php(?: <lic>)?<v?:3 0|3 01>", 7, 0.85),
    ("python", r"<under>(?:python software foundation|psf)(?: <lic>)?<v?:2>", 7, 0.95),
    ("ruby", r"<under>ruby(?: <lic>)?", 7, 0.8),
    ("zpl", r"<under>(?:zope public(?: <lic>)?|zpl)<v?:2 0|2 1>", 7, 0.95),
    ("ms-pl", r"<under>(?:microsoft public(?: <lic>)?|ms pl)", 7, 0.95),
    ("ms-rl", r"<under>(?:microsoft reciprocal(?: <lic>)?|ms rl)", 7, 0.95),
    ("bsl", r"<under>business source(?: <lic>)?<v?:1 0|1 1>", 7, 0.95),
    ("sspl", r"<under>(?:server side public(?: <lic>)?|sspl)<v?:1>", 7, 0.95),
    ("elastic", r"<under>elastic(?: <lic>)?<v?:2 0|2>", 7, 0.9),
    ("unicode", r"<under>unicode(?: <lic>)?<v?:3>", 7, 0.85),
    ("x11", r"<under>x11(?: <lic>)?", 6, 0.9),
    ("odbl", r"<under>(?:open data commons )?(?:open database(?: <lic>)?|odbl)<v?:1 0>", 7, 0.95),
    ("odc-by", r"<under>(?:open data commons attribution(?: <lic>)?|odc by)<v?:1 0>", 7, 0.95),
    ("pddl", r"<under>(?:public domain dedication and(?: <lic>)?|pddl)<v?:1 0>", 7, 0.95),
    ("cecill", r"<under>cecill(?: b| c)?(?: <lic>)?<v?:1 0|2 0|2 1>", 7, 0.95),
    ("mulan", r"<under>mulan(?: permissive software| psl)?(?: <lic>)?<v?:1|2>", 7, 0.95),
    ("upl", r"<under>universal permissive(?: <lic>)?<v?:1 0>", 7, 0.95),
    ("vim", r"<under>vim(?: <lic>)?", 7, 0.85),
    ("opl", r"<under>open publication(?: <lic>)?<v?:1 0>", 7, 0.95),
    ("cc0", r"<under>(?:creative commons )?cc0<v?:1 0>", 7, 0.95),
    ("perl", r"<under>same terms as perl(?: itself)?", 7, 0.95),
    # Titles: a license by its name alone.
    ("mit", r"mit <lic>", 5, 0.85),
    ("mit", r"expat <lic>", 5, 0.85),
    ("apache", r"apache(?: software)? <lic><v?:1 0|1 1|2 0|2>", 5, 0.85),
    ("gpl", r"gnu general public <lic><v?:1|2|3>", 5, 0.9),
    ("gpl", r"general public <lic><v?:1|2|3>", 4, 0.8),
    ("gpl", r"gnu gpl<v?:1|2|3>", 5, 0.85),
    ("gpl", r"gpl ?v<n:1|2|3>", 5, 0.85),
    ("lgpl", r"gnu (?:lesser|library) general public <lic><v?:2 1|2|3>", 6, 0.9),
    ("lgpl", r"(?:gnu )?lgpl(?: ?v<n:2 1|2|3>)?", 5, 0.8),
    ("agpl", r"gnu affero general public <lic><v?:1|3>", 6, 0.9),
    ("agpl", r"(?:gnu )?agpl(?: ?v<n:1|3>)?", 5, 0.8),
    ("fdl", r"gnu free documentation <lic><v?:1 1|1 2|1 3>", 5, 0.9),
    ("bsd", r"(?:new |modified |simplified |revised |original |berkeley )?bsd <lic>", 5, 0.85),
    ("bsd", r"bsd<v:0 clause|1 clause|2 clause|3 clause|4 clause>(?: <lic>)?", 6, 0.9),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: <lic>)?", 6, 0.9),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: <lic>)?", 6, 0.9),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: <lic>)?", 6, 0.9),
    ("mpl", r"mozilla public <lic><v?:1 0|1 1|2 0>", 5, 0.9),
    ("epl", r"eclipse public <lic><v?:1 0|2 0>", 5, 0.9),
    ("edl", r"eclipse distribution <lic><v?:1 0>", 5, 0.9),
    ("cddl", r"common development and distribution <lic><v?:1 0|1 1>", 5, 0.9),
    ("cpl", r"common public <lic><v?:1 0>", 5, 0.85),
    ("ipl", r"ibm public <lic><v?:1 0>", 5, 0.9),
    ("eupl", r"european union public <lic>(?: eupl)?<v?:1 0|1 1|1 2>", 5, 0.9),
    ("artistic", r"artistic <lic><v?:1 0|2 0>", 5, 0.85),
    ("afl", r"academic free <lic><v?:2 1|3 0>", 5, 0.85),
    ("osl", r"open software <lic><v?:1 0|2 1|3 0>", 5, 0.85),
    ("ofl", r"(?:sil )?open font <lic><v?:1 0|1 1>", 5, 0.9),
    ("isc", r"isc <lic>", 5, 0.85),
    ("zlib", r"zlib(?: libpng)? <lic>", 5, 0.85),
    ("boost", r"boost software <lic><v?:1 0>", 5, 0.9),
    ("wtfpl", r"do what the fuck you want to public <lic>", 5, 0.95),
    ("ncsa", r"university of illinois ncsa open source <lic>", 5, 0.95),
    ("postgresql", r"postgresql <lic>", 5, 0.9),
    ("python", r"(?:python software foundation|psf) <lic>", 5, 0.9),
    ("zpl", r"zope public <lic><v?:2 0|2 1>", 5, 0.9),
    ("ms-pl", r"microsoft public <lic>", 5, 0.9),
    ("ms-rl", r"microsoft reciprocal <lic>", 5, 0.9),
    ("bsl", r"business source <lic><v?:1 0|1 1>", 5, 0.9),
    ("sspl", r"server side public <lic><v?:1>", 5, 0.9),
    ("elastic", r"elastic <lic><v?:2 0|2>", 5, 0.85),
    ("odbl", r"open database <lic><v?:1 0>", 5, 0.9),
    ("upl", r"universal permissive <lic><v?:1 0>", 5, 0.9),
    ("opl", r"open publication <lic><v?:1 0>", 5, 0.9),
    ("cecill", r"cecill(?: b| c)? <lic>", 5, 0.9),
    ("mulan", r"mulan (?:permissive software <lic>|psl)<v?:1|2>", 5, 0.9),
    ("beerware", r"beer ?ware <lic>", 5, 0.9),
    ("qpl", r"q public <lic><v?:1 0>", 5, 0.9),
    ("sleepycat", r"sleepycat <lic>", 5, 0.9),
    # Creative Commons by its parts, long and short names and addresses.
    ("cc-by-nc-sa", r"(?:<cc>)?attribution non ?commercial share ?alike<i><v?:1 0|2 0|2 5|3 0|4 0>", 8, 0.9),
    ("cc-by-nc-nd", r"(?:<cc>)?attribution non ?commercial no ?deriv(?:s|atives|ative works)?<i><v?:1 0|2 0|2 5|3 0|4 0>", 8, 0.9),
    ("cc-by-nc", r"<cc>attribution non ?commercial<i><v?:1 0|2 0|2 5|3 0|4 0>", 7, 0.9),
    ("cc-by-sa", r"<cc>attribution share ?alike<i><v?:1 0|2 0|2 5|3 0|4 0>", 7, 0.9),
    ("cc-by-nd", r"<cc>attribution no ?deriv(?:s|atives|ative works)?<i><v?:1 0|2 0|2 5|3 0|4 0>", 7, 0.9),
    ("cc-by", r"<cc>attribution<i><v?:1 0|2 0|2 5|3 0|4 0>", 6, 0.9),
    ("cc-by{parts}", r"(?:<cc>)?cc by<parts><v?:1 0|2 0|2 5|3 0|4 0>", 7, 0.85),
    ("cc-by{parts}", r"creativecommons org licenses by<parts><v?:1 0|2 0|2 5|3 0|4 0>", 8, 0.95),
    ("cc0", r"creativecommons org publicdomain zero<v?:1 0>", 8, 0.95),
    ("cc0", r"creative commons zero<v?:1 0>", 6, 0.9),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", 5, 0.9),
    ("cc-mention", r"creative commons <lic>", 4, 0.6),
    # What is no license, or only hints at one.
    ("public-domain", r"(?:placed in|released (?:in)?to|dedicated to) the public domain", 5, 0.85),
    ("public-domain", r"public domain", 2, 0.5),
    ("proprietary", r"proprietary and confidential", 5, 0.8),
    ("proprietary", r"(?:unauthori[sz]ed|no) (?:copying|reproduction|redistribution)[a-z ]{0,40} prohibited", 5, 0.7),
    ("all-rights-reserved", r"all rights reserved", 4, 0.7),
    ("non-commercial", r"for non ?commercial (?:use|purposes|research) only", 4, 0.7),
    ("warranty-disclaimer", r"as is without (?:any )?(?:express or implied )?warrant(?:y|ies)", 3, 0.4),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", 1, 0.3),
    ("copyright", r"copyright", 0, 0.2),
    ("license-mention", r"licen[sc]ed? (?:under|by|to)", 0, 0.2),
)

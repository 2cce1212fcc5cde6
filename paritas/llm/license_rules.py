"""The signature rules of the license scan, by hand, in order.

A pass has a keyword that every match of its rules holds, a score, its rules, and what may stand before any of them. A
rule is a line: label and expression over normalised words (lower case, one blank between words, no marks). Earlier passes have priority over later ones. Within
a pass the rules are tried in order at each place, and the first that matches takes the words; so narrower rules stand
before wider ones. ``<...>`` are the fragments below.
"""

from __future__ import annotations

from dataclasses import dataclass

FRAGMENTS = {
    "under": "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|used)(?: only)? (?:under|by|with)(?: the terms of)?(?: the| a| an)?",
    "lic": "licen[cs]e",
    "v": "(?: ?v| ver| version)?",
    "later": "(?: only| or later| or newer| or any later version| or at your option any later version)?",
    "by": "(?:by|attribution)",
    "sa": "(?:sa|share ?alike)",
    "nc": "(?:nc|non ?commercial)",
    "nd": "(?:nd|no ?deriv(?:ative)?s(?: works)?)",
    "intl": "(?: international| unported| generic| universal| deed)?",
}

_PASSES = (
    ("spdx license identifier", 1.0, """
        gpl-3.0: spdx license identifier gpl 3 0(?: only| or later)?
        gpl-2.0: spdx license identifier gpl 2 0(?: only| or later)?(?: with (?:classpath|gcc|linux syscall|autoconf) (?:exception|note)(?: [0-9] [0-9])?)?
        gpl-1.0: spdx license identifier gpl 1 0(?: only| or later)?
        lgpl-3.0: spdx license identifier lgpl 3 0(?: only| or later)?
        lgpl-2.1: spdx license identifier lgpl 2 1(?: only| or later)?
        lgpl-2.0: spdx license identifier lgpl 2 0(?: only| or later)?
        agpl-3.0: spdx license identifier agpl 3 0(?: only| or later)?
        gfdl-1.3: spdx license identifier gfdl 1 3(?: only| or later)?
        mit-0: spdx license identifier mit 0
        mit: spdx license identifier mit
        apache-2.0: spdx license identifier apache 2 0(?: with llvm exception)?
        apache-1.1: spdx license identifier apache 1 1
        bsd-2-clause: spdx license identifier bsd 2 clause(?: patent)?
        bsd-3-clause: spdx license identifier bsd 3 clause(?: clear)?
        bsd-4-clause: spdx license identifier bsd 4 clause(?: uc)?
        bsd-1-clause: spdx license identifier bsd 1 clause
        bsd-source-code: spdx license identifier bsd source code
        0bsd: spdx license identifier 0bsd
        isc: spdx license identifier isc
        mpl-2.0: spdx license identifier mpl 2 0(?: no copyleft exception)?
        mpl-1.1: spdx license identifier mpl 1 1
        epl-2.0: spdx license identifier epl 2 0
        epl-1.0: spdx license identifier epl 1 0
        eupl-1.2: spdx license identifier eupl 1 2
        cddl-1.0: spdx license identifier cddl 1 0
        cddl-1.1: spdx license identifier cddl 1 1
        cecill-2.1: spdx license identifier cecill 2 1
        cecill-b: spdx license identifier cecill b
        cecill-c: spdx license identifier cecill c
        cc0-1.0: spdx license identifier cc0 1 0
        cc-by-nc-nd-4.0: spdx license identifier cc by nc nd 4 0
        cc-by-nc-sa-4.0: spdx license identifier cc by nc sa 4 0
        cc-by-nc-4.0: spdx license identifier cc by nc 4 0
        cc-by-nd-4.0: spdx license identifier cc by nd 4 0
        cc-by-sa-4.0: spdx license identifier cc by sa 4 0
        cc-by-sa-3.0: spdx license identifier cc by sa 3 0
        cc-by-4.0: spdx license identifier cc by 4 0
        cc-by-3.0: spdx license identifier cc by 3 0
        odbl-1.0: spdx license identifier odbl 1 0
        odc-by-1.0: spdx license identifier odc by 1 0
        pddl-1.0: spdx license identifier pddl 1 0
        cdla-permissive-2.0: spdx license identifier cdla permissive 2 0
        cdla-sharing-1.0: spdx license identifier cdla sharing 1 0
        artistic-2.0: spdx license identifier artistic 2 0
        artistic-1.0: spdx license identifier artistic 1 0(?: perl)?
        bsl-1.0: spdx license identifier bsl 1 0
        busl-1.1: spdx license identifier busl 1 1
        sspl-1.0: spdx license identifier sspl 1 0
        elastic-2.0: spdx license identifier elastic 2 0
        zlib: spdx license identifier zlib
        libpng: spdx license identifier libpng(?: 2 0)?
        unlicense: spdx license identifier unlicense
        wtfpl: spdx license identifier wtfpl
        ofl-1.1: spdx license identifier ofl 1 1(?: rfn| no rfn)?
        psf-2.0: spdx license identifier psf 2 0
        python-2.0: spdx license identifier python 2 0
        postgresql: spdx license identifier postgresql
        openssl: spdx license identifier openssl
        ncsa: spdx license identifier ncsa
        ms-pl: spdx license identifier ms pl
        ms-rl: spdx license identifier ms rl
        upl-1.0: spdx license identifier upl 1 0
        blueoak-1.0.0: spdx license identifier blueoak 1 0 0
        mulanpsl-2.0: spdx license identifier mulanpsl 2 0
        proprietary: spdx license identifier (?:licenseref )?(?:proprietary|commercial)
    """),
    ("permission", 0.95, """
        bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy
        mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
        ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software
        unicode: permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files
        mit: permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
        mit: permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute
        mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions
        isc: permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?
        hpnd: permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted without fee|and without fee is hereby granted)
        hpnd: historical permission notice and disclaimer
        postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
        zlib: permission is granted to anyone to use this software for any purpose including commercial applications
        gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
        gpl: permission is granted to copy (?:and )?distribute (?:and or modify )?(?:this program )?under the terms of the gnu general public license
        odbl-1.0: this database grants you permission to extract and re ?use
        proprietary: without (?:the )?(?:prior |express |explicit )*written permission(?: (?:of|from) the (?:copyright )?(?:owner|holder|author|publisher)s?)?
        proprietary: (?:may not|must not|cannot) be (?:reproduced|copied|distributed|reprinted) (?:in any form )?without (?:prior |express )?permission
        proprietary: (?:reproduced|reprinted|used) (?:here )?(?:by|with) (?:kind )?permission(?: of the (?:author|publisher|copyright holder))?
        proprietary: permission (?:is required|must be obtained) (?:to|before) (?:reproduc(?:e|ing)|copy(?:ing)?|distribut(?:e|ing)|republish(?:ing)?)
        permissive: permission is (?:hereby )?granted to (?:copy|use|reproduce|distribute)(?: and (?:modify|distribute))?
    """),
    ("redistribut", 0.9, """
        bsd-4-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){0,110} all advertising materials mentioning features
        bsd-3-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: [^ ]+){0,110} neither the name of
        bsd-2-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        bsd: redistribution and use in source and binary forms
        bsd: redistributions of source code must retain the above copyright notice
        bsd: redistributions in binary form must reproduce the above copyright notice
        agpl-3.0: redistribute it and or modify it under the terms of the gnu affero general public license
        lgpl-3.0: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
        lgpl-2.1: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
        lgpl: redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
        gpl-3.0: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
        gpl-2.0: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
        gpl: redistribute it and or modify it under the terms of the gnu general public license
        wtfpl: you can redistribute it and or modify it under the terms of the do what the f[a-z]* you want to public license
        artistic: you can redistribute it and or modify it under the same terms as perl itself
        proprietary: (?:may not|do not|must not) (?:copy )?(?:or )?redistribute(?: this (?:file|document|software|material))?
        proprietary: (?:no|any) (?:part|unauthori[sz]ed|reproduction)(?: [^ ]+){0,6} redistribution (?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted)
        freeware: (?:may be )?freely (?:copied and )?redistribut(?:ed|able)
    """),
    ("warrant", 0.85, """
        zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
        zlib: this software is provided as is without any express or implied warranty
        gpl: this (?:program|library|software) is distributed in the hope that it will be useful but without any warranty
        gpl: without even the implied warranty of merchantability or fitness for a particular purpose
        apache-2.0: on an as is basis without warranties or conditions of any kind either express or implied
        mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        isc: the software is provided as is and the author disclaims all warranties with regard to this software
        bsd: this software is provided by the (?:copyright holders and contributors|authors?|regents and contributors) as is and any express or implied warranties
        mpl-2.0: covered software is provided under this license on an as is basis without warranty of any kind
        epl-2.0: the program is provided on an as is basis without warranties or conditions of any kind
        ofl-1.1: the font software is provided as is without warranty of any kind
        disclaimer: (?:comes|provided|supplied|distributed) (?:as is )?(?:with|without) (?:absolutely )?(?:no|any) warranty(?: of any kind)?
        disclaimer: there is no warranty for the (?:program|software|work)
    """),
    ("licen", 0.9, """
        apache-2.0: licensed under the apache license version 2 0(?: the license)?(?: you may not use this file except in compliance with the license)?
        apache-2.0: you may not use this file except in compliance with the license
        apache-2.0: you may obtain a copy of the license at (?:http |https )?(?:www )?apache org licenses license 2 0
        apache-2.0: see the license for the specific language governing permissions and limitations(?: under the license)?
        mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
        mpl-2.0: this source code form is incompatible with secondary licenses
        mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
        cddl-1.0: the contents of this file are subject to the terms of the common development and distribution license
        epl-2.0: made available under the terms of the eclipse public license (?:v |version )?2 0
        epl-1.0: made available under the terms of the eclipse public license (?:v |version )?1 0
        eupl-1.2: you may not use this work except in compliance with the licence
        osl-3.0: licensed under the open software license version 3 0
        afl-3.0: licensed under the academic free license version 3 0
        gpl: you should have received a copy of the gnu general public license
        lgpl: you should have received a copy of the gnu (?:lesser|library) general public license
        agpl-3.0: you should have received a copy of the gnu affero general public license
        gpl-3.0: free copyleft license for software and other kinds of works
        proprietary: (?:this|the) (?:software|material|content|document) is licensed not sold
        proprietary: end user license agreement
        proprietary: (?:single|multi|site|volume) user license
        proprietary: (?:proprietary|commercial)(?: software)? license(?: agreement)?
        non-commercial: licensed for (?:personal|academic|research|educational|non ?commercial)(?: and (?:personal|academic|research|educational|non ?commercial))? use only
        dual: (?:dual|tri|multi) licensed under
        gpl: same license as (?:the linux kernel|gcc|emacs)
        perl: same license as perl(?: itself| 5)?
    """),
    ("copyleft", 0.5, """
        copyleft: (?:strong|weak|network) copyleft
        copyleft: copyleft (?:license|licence|work|software|material)s?
        copyleft: copyleft
    """),
    ("domain", 0.8, """
        unlicense: this is free and unencumbered software released into the public domain
        unlicense: free and unencumbered software released into the public domain
        pddl-1.0: public domain dedication and license
        cc0-1.0: cc0(?: 1 0)?(?: universal)? public domain dedication
        cc-pdm-1.0: public domain mark(?: 1 0)?
        public-domain: (?:has been |is |are |hereby )?(?:released|dedicated|placed|put|donated) (?:by (?:the|its) (?:author|creator)s? )?(?:in|into|to) the public domain
        public-domain: (?:is|are|was|were|falls|fell|entered|now|work|works|book|text|document|image|photo) in the public domain
        public-domain: (?:a )?work of the (?:united states|u s|us) (?:federal )?government(?: [^ ]+){0,8} public domain
        public-domain: not (?:protected by copyright|copyrighted)(?: [^ ]+){0,6} public domain
        public-domain: (?:considered|believed to be|made) public domain
        public-domain: public domain (?:work|book|text|software|image|material|dedication)s?
    """),
    (" org ", 0.9, """
        cc0-1.0: creativecommons org publicdomain zero 1 0
        cc-pdm-1.0: creativecommons org publicdomain mark 1 0
        cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
        cc-by-nc-nd: creativecommons org licenses by nc nd [123] [05]
        cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
        cc-by-nc-sa: creativecommons org licenses by nc sa [123] [05]
        cc-by-nc-4.0: creativecommons org licenses by nc 4 0
        cc-by-nc: creativecommons org licenses by nc [123] [05]
        cc-by-nd-4.0: creativecommons org licenses by nd 4 0
        cc-by-nd: creativecommons org licenses by nd [123] [05]
        cc-by-sa-4.0: creativecommons org licenses by sa 4 0
        cc-by-sa-3.0: creativecommons org licenses by sa 3 0
        cc-by-sa: creativecommons org licenses by sa [12] [05]
        cc-by-4.0: creativecommons org licenses by 4 0
        cc-by-3.0: creativecommons org licenses by 3 0
        cc-by-2.5: creativecommons org licenses by 2 5
        cc-by-2.0: creativecommons org licenses by 2 0
        apache-2.0: apache org licenses license 2 0(?: html| txt)?
        mit: opensource org licenses mit(?: license)?(?: php| html)?
        bsd-3-clause: opensource org licenses bsd 3 clause
        bsd-2-clause: opensource org licenses bsd 2 clause
        isc: opensource org licenses isc(?: license)?
        gpl-3.0: (?:gnu|opensource) org licenses gpl 3 0
        gpl-2.0: (?:gnu|opensource) org licenses (?:old licenses )?gpl 2 0
        gpl: (?:gnu|fsf) org licenses gpl(?: html| txt)?
        lgpl-3.0: (?:gnu|opensource) org licenses lgpl 3 0
        lgpl-2.1: (?:gnu|opensource) org licenses (?:old licenses )?lgpl 2 1
        lgpl: gnu org licenses lgpl(?: html| txt)?
        agpl-3.0: (?:gnu|opensource) org licenses agpl(?: 3 0)?
        gfdl: gnu org licenses fdl(?: 1 [0-3])?
        mpl-2.0: opensource org licenses mpl 2 0
        epl-2.0: opensource org licenses epl 2 0
        unlicense: unlicense org
        odbl-1.0: opendatacommons org licenses odbl(?: 1 0)?
        odc-by-1.0: opendatacommons org licenses by(?: 1 0)?
        pddl-1.0: opendatacommons org licenses pddl(?: 1 0)?
        ofl-1.1: (?:scripts sil|openfontlicense) org (?:ofl )?(?:open font )?license|opensource org licenses ofl 1 1
        zlib: opensource org licenses zlib(?: license)?
    """),
    ("gpl", 0.9, """
        agpl-3.0: (?:gnu )?agpl<v> ?3(?: 0)?<later>(?: <lic>)?
        agpl: (?:gnu )?agpl(?: <lic>)?
        lgpl-3.0: (?:gnu )?lgpl<v> ?3(?: 0)?<later>(?: <lic>)?
        lgpl-2.1: (?:gnu )?lgpl<v> ?2 1<later>(?: <lic>)?
        lgpl-2.0: (?:gnu )?lgpl<v> ?2(?: 0)?<later>(?: <lic>)?
        lgpl: (?:gnu )?lgpl(?: <lic>)?
        gpl-3.0: (?:gnu )?gpl<v> ?3(?: 0)?<later>(?: <lic>)?
        gpl-2.0: (?:gnu )?gpl<v> ?2(?: 0)?<later>(?: <lic>)?
        gpl-1.0: (?:gnu )?gpl<v> ?1(?: 0)?<later>(?: <lic>)?
        gpl: gnu gpl(?: <lic>)?
        gpl: gpl <lic>(?:d)?
        gpl: gpl compatible
        gpl: <under> gpl
    """, "(?:<under> )?"),
    ("general public", 0.9, """
        agpl-3.0: (?:gnu )?affero general public <lic><v> ?3(?: 0)?<later>
        agpl: (?:gnu )?affero general public <lic>
        lgpl-3.0: (?:gnu )?lesser general public <lic><v> ?3(?: 0)?<later>
        lgpl-2.1: (?:gnu )?lesser general public <lic><v> ?2 1<later>
        lgpl-2.0: (?:gnu )?(?:lesser|library) general public <lic><v> ?2(?: 0)?<later>
        lgpl: (?:gnu )?(?:lesser|library) general public <lic>
        gpl-3.0: (?:gnu )?general public <lic><v> ?3(?: 0)?<later>
        gpl-2.0: (?:gnu )?general public <lic><v> ?2(?: 0)?<later>
        gpl-1.0: (?:gnu )?general public <lic><v> ?1(?: 0)?<later>
        gpl: (?:gnu )?general public <lic>
    """, "(?:<under> )?"),
    ("creative commons", 0.9, """
        cc0-1.0: creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?(?: <lic>)?
        cc-by-nc-nd-4.0: creative commons <by> <nc> <nd> 4 0<intl>(?: <lic>)?
        cc-by-nc-nd: creative commons <by> <nc> <nd>(?: [123] [05])?<intl>(?: <lic>)?
        cc-by-nc-sa-4.0: creative commons <by> <nc> <sa> 4 0<intl>(?: <lic>)?
        cc-by-nc-sa: creative commons <by> <nc> <sa>(?: [123] [05])?<intl>(?: <lic>)?
        cc-by-nc-4.0: creative commons <by> <nc> 4 0<intl>(?: <lic>)?
        cc-by-nc-3.0: creative commons <by> <nc> 3 0<intl>(?: <lic>)?
        cc-by-nc: creative commons <by> <nc>(?: [12] [05])?<intl>(?: <lic>)?
        cc-by-nd-4.0: creative commons <by> <nd> 4 0<intl>(?: <lic>)?
        cc-by-nd: creative commons <by> <nd>(?: [123] [05])?<intl>(?: <lic>)?
        cc-by-sa-4.0: creative commons <by> <sa> 4 0<intl>(?: <lic>)?
        cc-by-sa-3.0: creative commons <by> <sa> 3 0<intl>(?: <lic>)?
        cc-by-sa: creative commons <by> <sa>(?: [12] [05])?<intl>(?: <lic>)?
        cc-by-4.0: creative commons <by> 4 0<intl>(?: <lic>)?
        cc-by-3.0: creative commons <by> 3 0<intl>(?: <lic>)?
        cc-by-2.5: creative commons <by> 2 5<intl>(?: <lic>)?
        cc-by-2.0: creative commons <by> 2 0<intl>(?: <lic>)?
        cc-by: creative commons(?: <lic>)? <by>(?: <lic>)?
        cc: creative commons <lic>(?:s)?
        cc: some rights reserved(?: under)? creative commons
    """, "(?:<under> )?"),
    ("cc0", 0.9, """
        cc0-1.0: cc0(?: 1 0)?(?: universal)?(?: <lic>)?
    """, "(?:<under> )?"),
    ("cc ", 0.85, """
        cc0-1.0: cc zero(?: 1 0)?(?: universal)?(?: <lic>)?
        cc-by-nc-nd-4.0: cc <by> <nc> <nd> 4 0(?: <lic>)?
        cc-by-nc-nd: cc <by> <nc> <nd>(?: [123] [05])?(?: <lic>)?
        cc-by-nc-sa-4.0: cc <by> <nc> <sa> 4 0(?: <lic>)?
        cc-by-nc-sa: cc <by> <nc> <sa>(?: [123] [05])?(?: <lic>)?
        cc-by-nc-4.0: cc <by> <nc> 4 0(?: <lic>)?
        cc-by-nc-3.0: cc <by> <nc> 3 0(?: <lic>)?
        cc-by-nc: cc <by> <nc>(?: [12] [05])?(?: <lic>)?
        cc-by-nd-4.0: cc <by> <nd> 4 0(?: <lic>)?
        cc-by-nd: cc <by> <nd>(?: [123] [05])?(?: <lic>)?
        cc-by-sa-4.0: cc <by> <sa> 4 0(?: <lic>)?
        cc-by-sa-3.0: cc <by> <sa> 3 0(?: <lic>)?
        cc-by-sa: cc <by> <sa>(?: [12] [05])?(?: <lic>)?
        cc-by-4.0: cc <by> 4 0(?: <lic>)?
        cc-by-3.0: cc <by> 3 0(?: <lic>)?
        cc-by-2.5: cc <by> 2 5(?: <lic>)?
        cc-by-2.0: cc <by> 2 0(?: <lic>)?
        cc-by: cc (?:<lic> )?<by>(?: <lic>)?
    """, "(?:<under> )?"),
    ("apache", 0.85, """
        apache-2.0: (?:asf |apache )?apache(?: software| public)? <lic><v> ?2(?: 0)?
        apache-1.1: apache(?: software)? <lic><v> ?1 1
        apache-1.0: apache(?: software)? <lic><v> ?1 0
        apache-2.0: apache<v> ?2(?: 0)?(?: <lic>)?
        apache: apache(?: software| style)? <lic>
    """, "(?:<under> )?"),
    ("bsd", 0.85, """
        0bsd: (?:zero clause bsd|bsd zero clause|0bsd|0 clause bsd)(?: <lic>)?
        bsd-2-clause: (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: <lic>)?
        bsd-3-clause: (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: <lic>)?
        bsd-4-clause: (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: <lic>)?
        bsd: bsd(?: style| type| like)? <lic>
        bsd: <under> bsd
    """, "(?:<under> )?"),
    ("mit ", 0.85, """
        mit-0: mit no attribution(?: <lic>)?
        mit-0: mit 0 <lic>
        mit: mit(?: x11| x consortium| expat| style| type)? <lic>
        mit: licen[cs]ed under(?: the)? mit
    """, "(?:<under> )?"),
    ("public licen", 0.85, """
        mpl-2.0: mozilla public <lic><v> ?2(?: 0)?
        mpl-1.1: mozilla public <lic><v> ?1 1
        mpl-1.0: mozilla public <lic><v> ?1(?: 0)?
        mpl: mozilla public <lic>
        npl-1.1: netscape public <lic>(?:<v> ?1 [01])?
        epl-2.0: eclipse public <lic><v> ?2(?: 0)?
        epl-1.0: eclipse public <lic><v> ?1(?: 0)?
        epl: eclipse public <lic>
        cpl-1.0: common public <lic>(?:<v> ?1(?: 0)?)?
        ipl-1.0: ibm public <lic>(?:<v> ?1(?: 0)?)?
        eupl-1.2: european union public <lic>(?:<v> ?1 [12])?
        lppl-1.3c: latex project public <lic>(?:<v> ?1 3c?)?
        ms-pl: microsoft public <lic>
        sspl-1.0: server side public <lic>(?:<v> ?1(?: 0)?)?
        qpl-1.0: q public <lic>(?:<v> ?1(?: 0)?)?
        spl-1.0: sun public <lic>(?:<v> ?1(?: 0)?)?
        zpl-2.1: zope public <lic>(?:<v> ?2 [01])?
        rpl-1.5: reciprocal public <lic>(?:<v> ?1 [15])?
        ypl-1.1: yahoo public <lic>(?:<v> ?1 1)?
        erlpl-1.1: erlang public <lic>(?:<v> ?1 1)?
        wtfpl: do what the f[a-z]* you want to public <lic>
        oclc-2.0: oclc research public <lic>
        nosl: (?:nethack|netizen open source) general public <lic>
    """, "(?:<under> )?"),
    ("wtfpl", 0.85, """
        wtfpl: wtfpl(?: <lic>)?
    """, "(?:<under> )?"),
    ("cecill", 0.85, """
        cecill-b: cecill b(?: <lic>)?
        cecill-c: cecill c(?: <lic>)?
        cecill-2.1: cecill(?: <lic>)?<v> ?2 1
        cecill: cecill(?: <lic>)?
    """, "(?:<under> )?"),
    ("mulan", 0.85, """
        mulanpsl-2.0: mulan (?:psl|permissive software <lic>)(?:<v> ?2(?: 0)?)?
        mulanpubl-2.0: mulan (?:publ|public <lic>)(?:<v> ?2(?: 0)?)?
    """, "(?:<under> )?"),
    ("licen", 0.8, """
        afl-3.0: academic free <lic>(?:<v> ?3(?: 0)?)?
        apsl-2.0: apple public source <lic>(?:<v> ?[12] [0-2])?
        artistic-2.0: artistic <lic><v> ?2(?: 0)?
        artistic-1.0: artistic <lic><v> ?1(?: 0)?
        artistic: (?:clarified |perl )?artistic <lic>
        beerware: (?:the )?beer ?ware <lic>
        blueoak-1.0.0: blue oak model <lic>(?: 1 0 0)?
        bsl-1.0: boost software <lic>(?:<v> ?1(?: 0)?)?
        bsl-1.0: boost <lic>
        busl-1.1: business source <lic>(?:<v> ?1 1)?
        bsd: berkeley software distribution <lic>
        cc: cc <lic>(?:s)?
        cddl-1.1: common development and distribution <lic><v> ?1 1
        cddl-1.0: common development and distribution <lic>(?:<v> ?1(?: 0)?)?
        cdla-permissive-2.0: community data <lic> agreement permissive(?:<v> ?[12](?: 0)?)?
        cdla-sharing-1.0: community data <lic> agreement sharing(?:<v> ?1(?: 0)?)?
        cpal-1.0: common public attribution <lic>(?:<v> ?1(?: 0)?)?
        ecl-2.0: educational community <lic>(?:<v> ?2(?: 0)?)?
        efl-2.0: eiffel forum <lic>(?:<v> ?2(?: 0)?)?
        elastic-2.0: elastic <lic>(?:<v> ?2(?: 0)?)?
        mit: expat <lic>
        gfdl-1.3: (?:gnu )?free documentation <lic><v> ?1 3
        gfdl-1.2: (?:gnu )?free documentation <lic><v> ?1 2
        gfdl: (?:gnu )?free documentation <lic>
        isc: (?:isc|internet (?:systems|software) consortium) <lic>
        lgpllr: lesser general public <lic> for linguistic resources
        libpng: libpng <lic>
        ms-rl: microsoft reciprocal <lic>
        mpl-2.0: mpl<v> ?2(?: 0)? <lic>
        ncsa: university of illinois (?:ncsa )?open source <lic>
        odbl-1.0: open (?:data commons open )?database <lic>(?:<v> ?1(?: 0)?)?
        odc-by-1.0: open data commons attribution <lic>(?:<v> ?1(?: 0)?)?
        ogl-uk-3.0: open government <lic>(?:<v> ?3(?: 0)?)?
        ofl-1.1: (?:sil )?open font <lic>(?:<v> ?1 1)?
        openldap-2.8: openldap public <lic>|openldap <lic>
        openssl: openssl <lic>
        osl-3.0: open software <lic>(?:<v> ?3(?: 0)?)?
        php-3.01: php <lic>(?:<v> ?3 01)?
        polyform-noncommercial-1.0.0: polyform noncommercial <lic>(?: 1 0 0)?
        postgresql: postgresql <lic>
        psf-2.0: (?:psf|python software foundation) <lic>(?:<v> ?2(?: 0)?)?
        python-2.0: python <lic>(?:<v> ?2(?: 0)?)?
        openrail-m: (?:creativeml |bigscience )?open ?rail(?: m)? <lic>
        responsible-ai: responsible ai <lic>(?:s)?
        ruby: ruby <lic>
        sissl: sun industry standards source <lic>
        sleepycat: sleepycat <lic>
        tcl: tcl(?: tk)? <lic>
        unicode: unicode <lic>(?: agreement)?(?:<v> ?3)?
        unlicense: (?:the )?unlicense
        upl-1.0: universal permissive <lic>(?:<v> ?1(?: 0)?)?
        vim: vim <lic>
        vsl-1.0: vovida software <lic>
        w3c: w3c (?:software|document)(?: notice and)? <lic>
        x11: x11(?: style)? <lic>
        xnet: x net <lic>
        zlib: zlib(?: libpng)? <lic>
        zend-2.0: zend <lic>(?:<v> ?2(?: 0)?)?
        json: json <lic>
        curl: curl <lic>
        ftl: freetype (?:project )?<lic>
        ijg: independent jpeg group <lic>
        imagemagick: imagemagick <lic>
        intel: intel open source <lic>
        nasa-1.3: nasa open source(?: agreement)? <lic>
        open-source: (?:an )?open source <lic>(?:s)?
        permissive: (?:a )?permissive(?: free software| open source)? <lic>(?:s)?
        proprietary: (?:a )?(?:closed source|commercial|evaluation|trial|shareware) <lic>(?:s)?
        free-license: (?:a )?free(?: content| culture| software)? <lic>(?:s)?
    """, "(?:<under> )?"),
    ("reserved", 0.5, """
        cc: some rights reserved
        proprietary: (?:all|copy) ?rights? reserved(?: worldwide| by the (?:author|publisher)s?)?
    """),
    ("copyright", 0.3, """
        cc0-1.0: (?:waives?|waived) all (?:of )?(?:his |her |its |their )?copyright and related (?:or|and) neighbou?ring rights
        fsfap: copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved
        copyright: copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
        copyright: copyright (?:by|of|held by|belongs to) (?:the )?(?:author|publisher|owner|contributor)s?
        copyright: (?:protected|covered) by copyright(?: law)?
        copyright: copyright (?:notice|holder|owner|infringement)s?
    """),
)


@dataclass(frozen=True)
class Pass:
    """``rules``: label and expression; ``before``: an expression that may be empty."""

    keyword: str
    score: float
    rules: tuple[tuple[str, str], ...]
    before: str

    @classmethod
    def of(cls, keyword: str, score: float, block: str, before: str = "") -> Pass:
        for name, fragment in FRAGMENTS.items():
            block, before = block.replace(f"<{name}>", fragment), before.replace(f"<{name}>", fragment)
        return cls(keyword, score, tuple(tuple(line.strip().split(": ", 1)) for line in block.strip().splitlines()), before)


#: In order of priority.
PASSES = tuple(Pass.of(*p) for p in _PASSES)

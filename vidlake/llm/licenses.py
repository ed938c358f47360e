"""License scans: ordered signature rules behind keywords, overlapping findings resolved by priority and containment.

Only built-in column functions are used. A text is matched whole. Null texts have no words and no labels, as
have empty ones; equal rows get equal results; an empty table gives an empty table; extra columns pass
through and those named like an added one are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.binding import let

#: Signatures written by hand for each license: label, then lines of keyword | priority | weight | regex, on lower-case
#: text whose white space is single. Priorities: 60 sentences of a license's text, 50 tags, 40 notices, 30 fields,
#: 20 statements, 10 bare names, 5 hints. The keyword stands in every text that the regex matches.
SIGNATURES = {
    "0bsd": """
        0bsd | 50 | 1.0 | spdx-license-identifier: ?0bsd
        zero | 10 | 0.6 | bsd zero[ -]clause(?: license)?
        0bsd | 10 | 0.6 | 0bsd(?: license)?
        fee is hereby granted. | 60 | 1.0 | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\\.
    """,
    "afl-3.0": """
        afl-3.0 | 50 | 1.0 | spdx-license-identifier: ?afl-3\\.0
        academic free | 10 | 0.6 | academic free license(?:,? (?:version |v\\.? ?)?3\\.0)?
        academic free | 40 | 1.0 | licensed under the academic free license(?: version 3\\.0)?
    """,
    "agpl-3.0": """
        agpl-3.0 | 50 | 1.0 | spdx-license-identifier: ?agpl-3\\.0(?:-only|-or-later|\\+)?
        affero | 10 | 0.6 | (?:gnu )?affero general public license(?:,? (?:version |v\\.? ?)?3(?:\\.0)?)?
        affero | 40 | 1.0 | under the terms of the gnu affero general public license
        agpl | 10 | 0.5 | (?:gnu )?agpl ?v?3(?:\\.0)?(?: or later|\\+)?
        network | 60 | 0.9 | all users interacting with it remotely through a computer network
    """,
    "apache-1.1": """
        apache-1.1 | 50 | 1.0 | spdx-license-identifier: ?apache-1\\.1
        apache | 10 | 0.7 | apache (?:software )?license,? (?:version |v\\.? ?)?1\\.1
        apache software foundation | 60 | 0.8 | this product includes software developed by the apache software foundation
    """,
    "apache-2.0": """
        apache-2.0 | 50 | 1.0 | spdx-license-identifier: ?apache-2\\.0
        apache | 40 | 1.0 | licensed under the apache license,? (?:version |v\\.? ?)?2(?:\\.0)?
        apache | 40 | 1.0 | (?:released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license,? (?:version |v\\.? ?)?2(?:\\.0)?
        apache | 30 | 0.9 | licen[cs]e: ?(?:the )?apache(?: software)?(?: license)?,?[ -](?:version |v\\.? ?)?2(?:\\.0)?
        apache | 10 | 0.6 | apache (?:software )?license,? (?:version |v\\.? ?)?2(?:\\.0)?
        apache | 10 | 0.5 | apache[ -]2(?:\\.0)?
        apache.org/licenses | 50 | 1.0 | apache\\.org/licenses/license-2\\.0
        express or implied | 60 | 0.9 | distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied
        compliance with the license | 60 | 0.9 | you may not use this file except in compliance with the license
    """,
    "artistic-2.0": """
        artistic-2.0 | 50 | 1.0 | spdx-license-identifier: ?artistic-2\\.0
        artistic | 10 | 0.6 | artistic license(?:,? (?:version |v\\.? ?)?2(?:\\.0)?)?
        perl itself | 40 | 0.8 | under the same terms as perl itself
        artistic | 60 | 0.9 | this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
    """,
    "blueoak-1.0.0": """
        blueoak | 50 | 1.0 | spdx-license-identifier: ?blueoak-1\\.0\\.0
        blue oak | 10 | 0.7 | blue oak model license(?: 1\\.0\\.0)?
        contributor licenses you | 60 | 0.9 | each contributor licenses you to do everything with this software
    """,
    "bsd": """
        bsd | 40 | 0.9 | (?:released|licensed|distributed|published|available) under (?:the terms of )?(?:the|a) bsd(?:-style)? license
        bsd | 30 | 0.8 | licen[cs]e: ?bsd(?: license)?
        bsd | 10 | 0.5 | bsd(?:-style)? license
        redistribution and use | 60 | 0.9 | redistribution and use in source and binary forms, with or without modification
        redistributions | 60 | 0.8 | redistributions of source code must retain the above copyright notice
        redistributions | 60 | 0.8 | redistributions in binary form must reproduce the above copyright notice
    """,
    "bsd-2-clause": """
        bsd-2-clause | 50 | 1.0 | spdx-license-identifier: ?bsd-2-clause
        bsd | 10 | 0.7 | bsd[ -]2[ -]clause(?: license)?
        2-clause | 10 | 0.7 | (?:the )?2-clause bsd(?: license)?
        simplified | 10 | 0.7 | simplified bsd(?: license)?
        freebsd | 10 | 0.6 | freebsd license
    """,
    "bsd-3-clause": """
        bsd-3-clause | 50 | 1.0 | spdx-license-identifier: ?bsd-3-clause
        bsd | 10 | 0.7 | bsd[ -]3[ -]clause(?: license)?
        3-clause | 10 | 0.7 | (?:the )?3-clause bsd(?: license)?
        bsd | 10 | 0.7 | (?:new|modified|revised) bsd(?: license)?
        endorse or promote | 60 | 0.9 | may be used to endorse or promote products derived from this software without specific prior written permission
    """,
    "bsd-4-clause": """
        bsd-4-clause | 50 | 1.0 | spdx-license-identifier: ?bsd-4-clause
        bsd | 10 | 0.7 | bsd[ -]4[ -]clause(?: license)?
        original bsd | 10 | 0.6 | original bsd(?: license)?
        advertising materials | 60 | 1.0 | all advertising materials mentioning features or use of this software
    """,
    "bsl-1.0": """
        bsl-1.0 | 50 | 1.0 | spdx-license-identifier: ?bsl-1\\.0
        boost | 10 | 0.7 | boost software license(?:,? (?:- )?(?:version )?1\\.0)?
        boost | 40 | 1.0 | distributed under the boost software license, version 1\\.0
        boost.org | 50 | 0.9 | boost\\.org/license_1_0\\.txt
    """,
    "busl-1.1": """
        busl-1.1 | 50 | 1.0 | spdx-license-identifier: ?busl-1\\.1
        business source | 10 | 0.7 | business source license(?: (?:version )?1\\.1)?
        non-production use | 60 | 0.9 | make non-production use of the licensed work
    """,
    "cc-by-4.0": """
        cc-by-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-4\\.0
        cc | 10 | 0.6 | cc[ -]by(?:[ -]4\\.0)?(?![ -]?(?:nc|nd|sa))
        attribution | 10 | 0.7 | creative commons attribution(?:[ -]4\\.0)?(?: international)?(?: (?:public )?license)?(?![ -]?(?:non|share|no ?deriv))
        licenses/by/ | 50 | 0.9 | creativecommons\\.org/licenses/by/\\d\\.\\d
    """,
    "cc-by-nc-4.0": """
        cc-by-nc-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-nc-4\\.0
        cc | 10 | 0.7 | cc[ -]by[ -]nc(?:[ -]4\\.0)?(?![ -]?(?:nd|sa))
        noncommercial | 10 | 0.8 | creative commons attribution[ -]noncommercial(?:[ -]4\\.0)?(?: international)?(?![ -]?(?:share|no ?deriv))
        licenses/by-nc/ | 50 | 0.9 | creativecommons\\.org/licenses/by-nc/\\d\\.\\d
    """,
    "cc-by-nc-nd-4.0": """
        cc-by-nc-nd-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-nc-nd-4\\.0
        cc | 10 | 0.8 | cc[ -]by[ -]nc[ -]nd(?:[ -]4\\.0)?
        deriv | 10 | 0.8 | creative commons attribution[ -]noncommercial[ -]no ?deriv(?:ative)?s?(?:[ -]4\\.0)?(?: international)?
        licenses/by-nc-nd/ | 50 | 0.9 | creativecommons\\.org/licenses/by-nc-nd/\\d\\.\\d
    """,
    "cc-by-nc-sa-4.0": """
        cc-by-nc-sa-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-nc-sa-4\\.0
        cc | 10 | 0.8 | cc[ -]by[ -]nc[ -]sa(?:[ -]4\\.0)?
        sharealike | 10 | 0.8 | creative commons attribution[ -]noncommercial[ -]sharealike(?:[ -]4\\.0)?(?: international)?
        licenses/by-nc-sa/ | 50 | 0.9 | creativecommons\\.org/licenses/by-nc-sa/\\d\\.\\d
    """,
    "cc-by-nd-4.0": """
        cc-by-nd-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-nd-4\\.0
        cc | 10 | 0.8 | cc[ -]by[ -]nd(?:[ -]4\\.0)?
        deriv | 10 | 0.8 | creative commons attribution[ -]no ?deriv(?:ative)?s?(?:[ -]4\\.0)?(?: international)?
        licenses/by-nd/ | 50 | 0.9 | creativecommons\\.org/licenses/by-nd/\\d\\.\\d
    """,
    "cc-by-sa-4.0": """
        cc-by-sa-4.0 | 50 | 1.0 | spdx-license-identifier: ?cc-by-sa-4\\.0
        cc | 10 | 0.8 | cc[ -]by[ -]sa(?:[ -]4\\.0)?
        sharealike | 10 | 0.8 | creative commons attribution[ -]sharealike(?:[ -]4\\.0)?(?: international)?
        licenses/by-sa/ | 50 | 0.9 | creativecommons\\.org/licenses/by-sa/\\d\\.\\d
    """,
    "cc0-1.0": """
        cc0-1.0 | 50 | 1.0 | spdx-license-identifier: ?cc0-1\\.0
        cc0 | 10 | 0.7 | cc0(?:[ -]1\\.0)?(?: universal)?
        publicdomain/zero | 50 | 0.9 | creativecommons\\.org/publicdomain/zero/1\\.0
        waived | 60 | 0.8 | waived all copyright and related or neighboring rights
    """,
    "cddl-1.0": """
        cddl-1.0 | 50 | 1.0 | spdx-license-identifier: ?cddl-1\\.0
        common development | 10 | 0.7 | common development and distribution license(?:,? (?:\\(cddl\\) )?(?:version |v)?1\\.0)?
        cddl | 10 | 0.6 | cddl(?:[ -]v?1\\.0)?
    """,
    "cpl-1.0": """
        cpl-1.0 | 50 | 1.0 | spdx-license-identifier: ?cpl-1\\.0
        common public | 10 | 0.7 | common public license(?:,? (?:version |v)?1\\.0)?
        common public | 60 | 0.9 | provided under the terms of this common public license
    """,
    "ecl-2.0": """
        ecl-2.0 | 50 | 1.0 | spdx-license-identifier: ?ecl-2\\.0
        educational community | 10 | 0.7 | educational community license(?:,? (?:version |v)?2\\.0)?
        educational community | 40 | 1.0 | licensed under the educational community license
    """,
    "epl-1.0": """
        epl-1.0 | 50 | 1.0 | spdx-license-identifier: ?epl-1\\.0
        eclipse | 10 | 0.7 | eclipse public license,? (?:- )?(?:version |v\\.? ?)?1\\.0
        legal/epl-v10 | 50 | 0.9 | eclipse\\.org/legal/epl-v10
    """,
    "epl-2.0": """
        epl-2.0 | 50 | 1.0 | spdx-license-identifier: ?epl-2\\.0
        eclipse | 10 | 0.7 | eclipse public license,? (?:- )?(?:version |v\\.? ?)?2\\.0
        legal/epl-2.0 | 50 | 0.9 | eclipse\\.org/legal/epl-2\\.0
    """,
    "eupl-1.2": """
        eupl-1.2 | 50 | 1.0 | spdx-license-identifier: ?eupl-1\\.2
        european union | 10 | 0.7 | european union public licen[cs]e(?:,? (?:version |v\\.? ?)?1\\.2)?
        eupl | 10 | 0.6 | eupl(?:,? ?v?\\.? ?1\\.2)?
    """,
    "fdl-1.3": """
        gfdl-1.3 | 50 | 1.0 | spdx-license-identifier: ?gfdl-1\\.3(?:-only|-or-later)?
        free documentation | 10 | 0.7 | gnu free documentation license(?:,? (?:version |v\\.? ?)?1\\.3)?
        invariant sections | 60 | 0.9 | with no invariant sections, no front-cover texts,? and no back-cover texts
    """,
    "gpl": """
        free software foundation | 45 | 0.8 | as published by the free software foundation
        general public | 40 | 0.9 | under the terms of the gnu general public license
        useful | 60 | 0.8 | distributed in the hope that it will be useful, but without any warranty
        gnu.org | 50 | 0.7 | gnu\\.org/licenses/gpl
    """,
    "gpl-2.0": """
        gpl-2.0 | 50 | 1.0 | spdx-license-identifier: ?gpl-2\\.0(?:-only|-or-later|\\+)?
        general public | 10 | 0.8 | gnu general public license,? (?:version |v\\.? ?)?2(?:\\.0)?
        gpl | 10 | 0.6 | (?:gnu )?gpl ?v?2(?:\\.0)?(?: or later|\\+)?
        version 2 of the license | 60 | 0.8 | either version 2 of the license, or \\(at your option\\) any later version
    """,
    "gpl-3.0": """
        gpl-3.0 | 50 | 1.0 | spdx-license-identifier: ?gpl-3\\.0(?:-only|-or-later|\\+)?
        general public | 10 | 0.8 | gnu general public license,? (?:version |v\\.? ?)?3(?:\\.0)?
        gpl | 10 | 0.6 | (?:gnu )?gpl ?v?3(?:\\.0)?(?: or later|\\+)?
        version 3 of the license | 60 | 0.8 | either version 3 of the license, or \\(at your option\\) any later version
    """,
    "hpnd": """
        hpnd | 50 | 1.0 | spdx-license-identifier: ?hpnd
        historical permission | 10 | 0.7 | historical permission notice and disclaimer
    """,
    "isc": """
        isc | 50 | 1.0 | spdx-license-identifier: ?isc
        isc | 40 | 1.0 | (?:released|licensed|distributed|available) under (?:the terms of )?the isc license
        isc | 10 | 0.6 | isc license
        permission to use, copy | 55 | 1.0 | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
    """,
    "lgpl-2.1": """
        lgpl-2.1 | 50 | 1.0 | spdx-license-identifier: ?lgpl-2\\.1(?:-only|-or-later|\\+)?
        lesser | 10 | 0.8 | (?:gnu )?lesser general public license,? (?:version |v\\.? ?)?2\\.1
        lgpl | 10 | 0.6 | (?:gnu )?lgpl ?v?2\\.1(?: or later|\\+)?
        version 2.1 of the license | 60 | 0.8 | either version 2\\.1 of the license, or \\(at your option\\) any later version
    """,
    "lgpl-3.0": """
        lgpl-3.0 | 50 | 1.0 | spdx-license-identifier: ?lgpl-3\\.0(?:-only|-or-later|\\+)?
        lesser | 10 | 0.8 | (?:gnu )?lesser general public license,? (?:version |v\\.? ?)?3(?:\\.0)?
        lgpl | 10 | 0.6 | (?:gnu )?lgpl ?v?3(?:\\.0)?(?: or later|\\+)?
    """,
    "lppl-1.3c": """
        lppl-1.3c | 50 | 1.0 | spdx-license-identifier: ?lppl-1\\.3c
        latex project | 10 | 0.7 | latex project public license(?:,? (?:version |v)?1\\.3c?)?
        latex project | 40 | 1.0 | distributed and/or modified under the conditions of the latex project public license
    """,
    "mit": """
        mit | 50 | 1.0 | spdx-license-identifier: ?mit(?!-)
        mit | 40 | 1.0 | (?:released|licensed|distributed|published|available|made available|provided|is|work is licensed) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
        mit | 35 | 0.9 | subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?mit licen[cs]e
        mit | 30 | 0.9 | licen[cs]e(?:d|s)?: ?(?:the )?mit(?: licen[cs]e)?
        mit | 10 | 0.6 | (?:the )?mit licen[cs]e
        mit | 10 | 0.5 | (?:mit/x11|x11/mit|expat) license
        opensource.org | 50 | 0.9 | opensource\\.org/licenses/mit
        permission is hereby granted | 60 | 1.0 | permission is hereby granted, free of charge, to any person obtaining a copy
        above copyright notice | 60 | 0.8 | the above copyright notice and this permission notice (?:\\(including the next paragraph\\) )?shall be included in all copies
        liable | 55 | 0.7 | in no event shall the authors or copyright holders be liable for any claim, damages or other liability
    """,
    "mit-0": """
        mit-0 | 50 | 1.0 | spdx-license-identifier: ?mit-0
        no attribution | 10 | 0.7 | mit no attribution(?: license)?
        mit-0 | 10 | 0.6 | mit-0(?: license)?
    """,
    "mpl-1.1": """
        mpl-1.1 | 50 | 1.0 | spdx-license-identifier: ?mpl-1\\.1
        mozilla | 10 | 0.7 | mozilla public license,? (?:version |v\\.? ?)?1\\.1
        mozilla.org/mpl | 60 | 0.8 | the contents of this file are subject to the mozilla public license.{0,200}mozilla\\.org/mpl
    """,
    "mpl-2.0": """
        mpl-2.0 | 50 | 1.0 | spdx-license-identifier: ?mpl-2\\.0
        mozilla | 10 | 0.7 | mozilla public license,? (?:version |v\\.? ?)?2(?:\\.0)?
        mozilla | 40 | 1.0 | subject to the terms of the mozilla public license, v\\. 2\\.0
        mozilla.org/mpl/2.0 | 50 | 0.9 | mozilla\\.org/mpl/2\\.0
    """,
    "ms-pl": """
        ms-pl | 50 | 1.0 | spdx-license-identifier: ?ms-pl
        microsoft public | 10 | 0.7 | microsoft public license(?: \\(ms-pl\\))?
        ms-pl | 10 | 0.6 | ms-pl(?: license)?
    """,
    "ms-rl": """
        ms-rl | 50 | 1.0 | spdx-license-identifier: ?ms-rl
        microsoft reciprocal | 10 | 0.7 | microsoft reciprocal license(?: \\(ms-rl\\))?
    """,
    "ncsa": """
        ncsa | 50 | 1.0 | spdx-license-identifier: ?ncsa
        ncsa | 10 | 0.7 | (?:university of illinois/)?ncsa open source license
        with the software | 60 | 0.8 | to deal with the software without restriction
    """,
    "odbl-1.0": """
        odbl-1.0 | 50 | 1.0 | spdx-license-identifier: ?odbl-1\\.0
        open database | 10 | 0.7 | (?:odc )?open database license(?: \\(odbl\\))?(?: v?1\\.0)?
        odbl | 10 | 0.6 | odbl(?: v?1\\.0)?
    """,
    "odc-by-1.0": """
        odc-by-1.0 | 50 | 1.0 | spdx-license-identifier: ?odc-by-1\\.0
        open data commons | 10 | 0.7 | open data commons attribution license(?: v?1\\.0)?
    """,
    "ofl-1.1": """
        ofl-1.1 | 50 | 1.0 | spdx-license-identifier: ?ofl-1\\.1
        open font | 10 | 0.7 | (?:sil )?open font license(?:,? (?:version |v)?1\\.1)?
        scripts.sil.org | 50 | 0.9 | scripts\\.sil\\.org/ofl
    """,
    "osl-3.0": """
        osl-3.0 | 50 | 1.0 | spdx-license-identifier: ?osl-3\\.0
        open software | 10 | 0.7 | open software license(?:,? (?:version |v\\.? ?)?3\\.0)?
        open software | 40 | 1.0 | licensed under the open software license version 3\\.0
    """,
    "postgresql": """
        postgresql | 50 | 1.0 | spdx-license-identifier: ?postgresql
        postgresql | 30 | 0.9 | licen[cs]e: ?postgresql(?: license)?
        postgresql | 10 | 0.6 | (?:the )?postgresql licen[cs]e
    """,
    "psf-2.0": """
        python-2.0 | 50 | 1.0 | spdx-license-identifier: ?(?:python|psf)-2\\.0
        python software | 10 | 0.7 | python software foundation license(?: (?:version |v)?2)?
        psf license | 10 | 0.6 | psf license(?: agreement)?(?: (?:for python|version 2))?
    """,
    "qpl-1.0": """
        qpl-1.0 | 50 | 1.0 | spdx-license-identifier: ?qpl-1\\.0
        q public | 10 | 0.7 | q public license(?:,? (?:version |v)?1\\.0)?
    """,
    "unlicense": """
        unlicense | 50 | 1.0 | spdx-license-identifier: ?unlicense
        unlicense | 10 | 0.7 | (?:the )?unlicense
        unlicense.org | 50 | 0.9 | unlicense\\.org
        unencumbered | 60 | 1.0 | this is free and unencumbered software released into the public domain
    """,
    "upl-1.0": """
        upl-1.0 | 50 | 1.0 | spdx-license-identifier: ?upl-1\\.0
        universal permissive | 10 | 0.7 | universal permissive license(?:,? (?:version |v)?1\\.0)?
    """,
    "vim": """
        vim | 50 | 1.0 | spdx-license-identifier: ?vim
        vim license | 10 | 0.6 | (?:the )?vim license
    """,
    "wtfpl": """
        wtfpl | 50 | 1.0 | spdx-license-identifier: ?wtfpl
        wtfpl | 10 | 0.6 | wtfpl(?: (?:version |v)?2)?
        you want to public | 60 | 1.0 | do what the f\\S+ you want to public license
    """,
    "x11": """
        x11 | 50 | 1.0 | spdx-license-identifier: ?x11
        x11 license | 10 | 0.6 | (?:the )?x11 license
        x consortium | 60 | 0.9 | name of the x consortium shall not be used in advertising
    """,
    "zlib": """
        zlib | 50 | 1.0 | spdx-license-identifier: ?zlib
        zlib | 30 | 0.9 | licen[cs]e: ?(?:the )?zlib(?:/libpng)?(?: license)?
        zlib | 10 | 0.6 | (?:the )?zlib(?:/libpng)? licen[cs]e
        plainly marked | 60 | 0.9 | altered source versions must be plainly marked as such
        misrepresented | 60 | 0.9 | the origin of this software must not be misrepresented
    """,
    "zpl-2.1": """
        zpl-2.1 | 50 | 1.0 | spdx-license-identifier: ?zpl-2\\.1
        zope | 10 | 0.7 | zope public license(?: \\(zpl\\))?(?:,? (?:version |v)?2\\.1)?
    """,
    "public-domain": """
        public domain | 20 | 0.7 | (?:dedicated|released|placed|put) (?:to|in|into|in to) the public domain
        public domain | 20 | 0.7 | (?:is|are|in) (?:in )?the public domain
        public domain | 30 | 0.8 | licen[cs]e: ?public domain
    """,
    "copyleft": """
        copyleft | 5 | 0.4 | copyleft(?:ed)?
        alike | 5 | 0.4 | share[ -]alike
    """,
    "proprietary": """
        all rights reserved | 5 | 0.3 | all rights reserved
        confidential | 25 | 0.8 | confidential and proprietary
        proprietary | 25 | 0.8 | proprietary (?:and confidential|software|license)
        license agreement | 20 | 0.6 | end[ -]user license agreement
        without permission | 25 | 0.6 | (?:may not be|not to be) (?:copied|reproduced|redistributed|distributed) (?:\\S+ ){0,6}without permission
        written permission | 25 | 0.6 | (?:copied|reproduced|distributed|transmitted) without (?:the )?(?:express |prior )*written permission
        trade secret | 20 | 0.6 | contains (?:\\S+ ){0,4}trade secrets?
    """,
}
#: The phrases whose places are counted: label and words.
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
BASE_WEIGHT = 0.5
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(order, label, keyword, regex, priority, weight) of every signature, which starts at a word's start."""
    lines = [(label, [x.strip() for x in line.split("|", 3)]) for label, block in SIGNATURES.items() for line in block.strip().split("\n")]
    return [(i, label, keyword, f"(?<![a-z0-9])(?:{regex})", int(priority), float(weight)) for i, (label, (keyword, priority, weight, regex)) in enumerate(lines)]


def lowered(text: Column) -> Column:
    """Lower case, null as empty. What other letters become makes no word of a phrase and no new word."""
    return F.lower(F.coalesce(text, F.lit("")))


def _places(words: Column) -> Column:
    """Structs (at, label) of every place where a base phrase's words stand in a row."""
    def at(i: Column) -> Column:
        hit = F.lit(None).cast("string")
        for label, phrase in reversed(BASE):
            hit = F.when(F.reduce(F.array(*(F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase))), F.lit(True), lambda a, x: a & x), label).otherwise(hit)
        return F.when(hit.isNotNull(), F.struct(i.alias("at"), hit.alias("label")))

    return F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*(p[0] for _, p in BASE)), at(i))))


#: Line ends with the comment marks after them, and other white space.
GAPS = "\\s*\\n\\s*(?:(?://+|/?\\*+|#+|;+|--+|>+)(?=\\s|$))?\\s*|\\s+"
SPAN = "struct<start:int,end:int,priority:int,order:int,label:string,weight:double>"
#: Findings that are put behind each other before they are put behind the others.
BLOCK = 256
#: Lengths that are summed one by one; sums of so many are added up once for all.
RUN = 64


def flat(text: Column) -> Column:
    """The text with white space, and comment marks at the start of lines, as single spaces."""
    return F.regexp_replace(text, GAPS, " ")


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts, from the texts between matches and the matches."""
    steps = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size(found)), F.length), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), (g + m).alias("both")))
    total = lambda xs, from_: F.aggregate(xs, from_, lambda a, x: a + x["both"])

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (F.size(x) - 1).cast("int"), F.lit(RUN)), lambda at: total(F.slice(x, at + 1, F.lit(RUN)), F.lit(0)))
        upto = F.aggregate(runs, F.array(F.lit(0)), lambda a, r: F.array_append(a, F.element_at(a, -1) + r))
        return let(upto, lambda u: F.transform(x, lambda y, k: total(F.slice(x, (k - k % RUN + 1).cast("int"), (k % RUN).cast("int")), F.get(u, (k / RUN).cast("int"))) + y["g"]))

    return F.when(F.size(found) > 0, let(steps, of)).otherwise(F.array().cast("array<int>"))


def _findings(text: Column) -> Column:
    """All matches of the rules whose keyword is in the text: structs (start, end, priority, order, label, weight)."""
    fields = ("order", "label", "key", "rx", "priority", "weight")
    listed = json.dumps([dict(zip(fields, r, strict=True)) for r in rules()])
    table = F.from_json(F.lit(listed), "array<struct<order:int,label:string,key:string,rx:string,priority:int,weight:double>>")

    def matches(rule: Column) -> Column:
        def placed(found: Column) -> Column:
            starts = _starts(F.split(text, rule["rx"], -1), found)
            return F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["weight"].alias("weight")))

        return let(F.regexp_extract_all(text, rule["rx"], F.lit(0)), placed)

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(text, r["key"])), matches))


def _kept(found: Column) -> Column:
    """Drops a finding inside another that ranks before it: by priority, then length, then the rules' order.

    One goes over the findings by start, wider ones first, and keeps those in hand that have not ended yet. A finding
    inside a dropped one is inside what dropped that as well, so it does not matter that dropped ones stay in hand.
    What is kept is gathered in blocks, as an array is copied whenever something is put behind it.
    """
    rank = lambda x: F.struct(x["priority"], x["end"] - x["start"], -x["order"])
    sorted_ = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("wide"), (-x["priority"]).alias("down"), x["order"].alias("order"), x.alias("x"))))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, s: Column) -> Column:
        a = s["x"]
        beaten = F.exists(acc["open"], lambda b: (b["end"] >= a["end"]) & (rank(b) > rank(a)))
        full = F.size(acc["block"]) >= BLOCK
        return F.struct(
            F.array_append(F.filter(acc["open"], lambda b: b["end"] > a["start"]), a).alias("open"),
            F.when(full, F.array_append(acc["kept"], acc["block"])).otherwise(acc["kept"]).alias("kept"),
            F.when(beaten, F.when(full, none).otherwise(acc["block"])).otherwise(F.array_append(F.when(full, none).otherwise(acc["block"]), a)).alias("block"),
        )

    start = F.struct(none.alias("open"), F.array().cast(f"array<array<{SPAN}>>").alias("kept"), none.alias("block"))
    return F.when(F.size(found) > 1, F.aggregate(sorted_, start, step, lambda acc: F.flatten(F.array_append(acc["kept"], acc["block"])))).otherwise(found)


#: One of these is in every text that a rule can match, whatever its white space.
GATE = ("licen", "spdx", "public", "permi", "redistribution", "bsd", "cc", "copyleft", "reserved", "confidential", "foundation", "attribution", "gpl", "apache", "eupl", "odbl", "cddl", "ms-pl", "mit-0", "mozilla.org", "eclipse.org", "gnu.org", "sil.org", "proprietary", "alike", "secret", "perl", "network", "advertising", "waived", "invariant", "hope", "liable", "restriction", "altered", "misrepresented", "warranties", "wtfpl", "contributor", "business", "non-production", "consortium", "apache.org")


def gated(text: Column) -> Column:
    hit = F.lit(False)
    for key in GATE:
        hit = hit | F.contains(text, F.lit(key))
    return hit


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and findings (surviving matches, with spans in ``flat`` text)."""
    out = docs.withColumn("__low", lowered(F.col(text)))
    out = out.withColumn("__words", F.array_remove(F.split("__low", NOT_WORD), ""))
    out = out.withColumn("__base", F.when(F.contains("__low", F.lit("license")), let(F.col("__words"), _places)).otherwise(F.array().cast("array<struct<at:int,label:string>>")))
    none = F.array().cast(f"array<{SPAN}>")
    out = out.withColumn("findings", F.when(gated(F.col("__low")), let(flat(F.col("__low")), lambda t: let(_findings(t), _kept))).otherwise(none))
    names = lambda c: F.transform(c, lambda x: x["label"])
    base = names(F.col("__base"))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_base": F.size("__base").cast("long"),
        "first_word": F.array_min(F.transform("__base", lambda x: x["at"])).cast("long"),
        "last_word": F.array_max(F.transform("__base", lambda x: x["at"])).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(base, names(F.col("findings")))), ","),
        "score": F.greatest(F.when(F.size("__base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("findings", lambda x: x["weight"])), F.lit(0.0))),
    })
    return out.drop("__low", "__words", "__base")


def op6(docs: DataFrame) -> DataFrame:
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

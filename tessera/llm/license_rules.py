"""The ordered signature rules of the license scan: written by hand, read as text.

Rules are patterns over a text's words, lower-cased and joined by single blanks: "GPL-3.0-or-later"
reads ``gpl 3 0 or later``. A line ``[keyword]`` opens a group: each match of its rules holds that
keyword, and texts without it never see them. A rule's line has its level, its label, and its pattern:

1. an identifier, or a sentence that only this license has
2. a name with its version
3. a name
4. words that speak of a license in passing
"""

from __future__ import annotations

from dataclasses import dataclass

TABLE = r"""
[spdx license identifier]
1 mit spdx license identifier mit
1 mit-0 spdx license identifier mit 0
1 apache-2.0 spdx license identifier apache 2 0
1 apache-1.1 spdx license identifier apache 1 1
1 gpl-2.0-only spdx license identifier gpl 2 0(?: only)?
1 gpl-2.0-or-later spdx license identifier gpl 2 0 or later
1 gpl-3.0-only spdx license identifier gpl 3 0(?: only)?
1 gpl-3.0-or-later spdx license identifier gpl 3 0 or later
1 lgpl-2.1-only spdx license identifier lgpl 2 1(?: only)?
1 lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
1 lgpl-3.0-only spdx license identifier lgpl 3 0(?: only)?
1 lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
1 agpl-3.0-only spdx license identifier agpl 3 0(?: only)?
1 agpl-3.0-or-later spdx license identifier agpl 3 0 or later
1 bsd-2-clause spdx license identifier bsd 2 clause
1 bsd-3-clause spdx license identifier bsd 3 clause
1 bsd-4-clause spdx license identifier bsd 4 clause
1 0bsd spdx license identifier 0bsd
1 isc spdx license identifier isc
1 mpl-2.0 spdx license identifier mpl 2 0
1 epl-1.0 spdx license identifier epl 1 0
1 epl-2.0 spdx license identifier epl 2 0
1 cddl-1.0 spdx license identifier cddl 1 0
1 bsl-1.0 spdx license identifier bsl 1 0
1 busl-1.1 spdx license identifier busl 1 1
1 cc0-1.0 spdx license identifier cc0 1 0
1 cc-by-4.0 spdx license identifier cc by 4 0
1 cc-by-sa-4.0 spdx license identifier cc by sa 4 0
1 cc-by-nc-4.0 spdx license identifier cc by nc 4 0
1 unlicense spdx license identifier unlicense
1 zlib spdx license identifier zlib
1 wtfpl spdx license identifier wtfpl
1 artistic-2.0 spdx license identifier artistic 2 0
1 eupl-1.2 spdx license identifier eupl 1 2
1 ofl-1.1 spdx license identifier ofl 1 1
1 ncsa spdx license identifier ncsa
1 postgresql spdx license identifier postgresql
1 psf-2.0 spdx license identifier (?:psf 2 0|python 2 0)
1 upl-1.0 spdx license identifier upl 1 0
1 ms-pl spdx license identifier ms pl
1 mulanpsl-2.0 spdx license identifier mulanpsl 2 0
1 blueoak-1.0.0 spdx license identifier blueoak 1 0 0
4 unknown-spdx spdx license identifier

[mit license]
4 mit mit license
3 mit (?:under|with) the(?: terms of the)?(?: expat)? mit license
3 mit (?:is|are) mit licensed
2 mit mit license (?:see|refer to) (?:the )?license(?: file| md| txt)?

[permission is hereby granted]
1 mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit-0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
1 bsl-1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
1 x11 permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ ]+){0,80} except as contained in this notice the names? of
1 ofl-1.1 permission is hereby granted free of charge to any person obtaining a copy of the font software
1 unicode permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation
2 permissive-text permission is hereby granted(?: [^ ]+){0,12} to use copy modify

[permission to use]
1 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 isc permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
1 0bsd permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
1 hpnd permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
1 hpnd permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted

[redistribution and use in source and binary forms]
1 bsd-2-clause redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 bsd-3-clause redistribution and use in source and binary forms with or without modification are permitted(?: [^ ]+){0,90} neither the names? of
1 bsd-4-clause redistribution and use in source and binary forms with or without modification are permitted(?: [^ ]+){0,90} all advertising materials mentioning features
1 apache-1.1 redistribution and use in source and binary forms with or without modification are permitted(?: [^ ]+){0,120} the names? apache

[bsd]
2 bsd-2-clause (?:simplified|2 clause|two clause|freebsd) bsd licen[cs]e
2 bsd-3-clause (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
2 bsd-4-clause (?:original|old|4 clause|four clause) bsd licen[cs]e
2 bsd-2-clause bsd 2 clause(?: licen[cs]e)?
2 bsd-3-clause bsd 3 clause(?: licen[cs]e)?
2 bsd-4-clause bsd 4 clause(?: licen[cs]e)?
2 0bsd (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
3 bsd bsd(?: style| like)? licen[cs]e[ds]?

[apache]
4 apache apache license
1 apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache-2.0 https? www apache org licenses license 2 0
2 apache-2.0 apache licen[cs]e(?: version)? 2(?: 0)?
2 apache-1.1 apache (?:software )?licen[cs]e(?: version)? 1 1
2 apache-1.0 apache (?:software )?licen[cs]e(?: version)? 1 0
2 apache-2.0 apache 2(?: 0)? licen[cs]ed?
2 apache-2.0 licensed under apache 2(?: 0)?
3 apache apache software licen[cs]e
3 apache licensed to the apache software foundation asf under one or more contributor license agreements
4 apache copyright(?: [^ ]+){0,4} the apache software foundation

[general public licen]
4 gpl general public license
2 gpl-1.0 (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 1
2 gpl-2.0 (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?
2 gpl-3.0 (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
1 gpl-2.0-or-later gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 gpl-3.0-or-later gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gpl-2.0-only gnu general public license version 2 as published by the free software foundation
1 gpl-2.0-only gnu general public license as published by the free software foundation version 2 of the license
1 gpl-2.0 gnu general public license version 2 june 1991
1 gpl-3.0 gnu general public license version 3 29 june 2007
2 gpl-2.0-with-classpath-exception general public licen[cs]e(?: [^ ]+){0,12} classpath exception
2 gpl-with-linking-exception general public licen[cs]e(?: [^ ]+){0,12} linking exception
3 gpl gnu general public licen[cs]e
2 lgpl-2.0 (?:gnu )?(?:library|lesser) general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?
2 lgpl-2.1 (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2 1
2 lgpl-3.0 (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
1 lgpl-2.1-or-later gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 lgpl-3.0-or-later gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 lgpl-2.1 gnu lesser general public license version 2 1 february 1999
1 lgpl-2.0 gnu library general public license version 2 june 1991
3 lgpl gnu (?:lesser|library) general public licen[cs]e
3 lgpl (?:lesser|library) general public licen[cs]e
2 agpl-3.0 (?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
1 agpl-3.0-or-later gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 agpl-3.0 gnu affero general public license version 3 19 november 2007
3 agpl (?:gnu )?affero general public licen[cs]e
2 sspl-1.0 server side public license(?: [^ ]+){0,20} general public licen[cs]e

[gpl]
2 gpl-2.0 gpl ?v?2(?: 0)?(?: only)?
2 gpl-3.0 gpl ?v?3(?: 0)?(?: only)?
2 gpl-2.0-or-later gpl ?v?2(?: 0)?(?: or later| or any later version)
2 gpl-3.0-or-later gpl ?v?3(?: 0)?(?: or later| or any later version)
2 lgpl-2.1 lgpl ?v?2 1(?: only)?
2 lgpl-2.1-or-later lgpl ?v?2 1(?: or later| or any later version)
2 lgpl-3.0 lgpl ?v?3(?: 0)?(?: only)?
2 lgpl-3.0-or-later lgpl ?v?3(?: 0)?(?: or later| or any later version)
2 agpl-3.0 agpl ?v?3(?: 0)?(?: only)?
2 agpl-3.0-or-later agpl ?v?3(?: 0)?(?: or later| or any later version)
3 gpl (?:under|licensed|license) (?:the )?(?:gnu )?gpl
3 lgpl (?:under|licensed|license) (?:the )?(?:gnu )?lgpl
3 agpl (?:under|licensed|license) (?:the )?(?:gnu )?agpl

[free documentation licen]
2 gfdl-1.1 (?:gnu )?free documentation licen[cs]e version 1 1
2 gfdl-1.2 (?:gnu )?free documentation licen[cs]e version 1 2
2 gfdl-1.3 (?:gnu )?free documentation licen[cs]e version 1 3
3 gfdl (?:gnu )?free documentation licen[cs]e

[mozilla public licen]
1 mpl-2.0 this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
2 mpl-2.0 mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
2 mpl-1.1 mozilla public licen[cs]e(?: version| v)? ?1 1
2 mpl-1.0 mozilla public licen[cs]e(?: version| v)? ?1 0
3 mpl mozilla public licen[cs]e

[eclipse]
1 epl-2.0 terms of the eclipse public license 2 0 which is available at
1 epl-1.0 terms of the eclipse public license v1 0 which accompanies this distribution
2 epl-2.0 eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
2 epl-1.0 eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
2 edl-1.0 eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)?
3 epl eclipse public licen[cs]e

[common development and distribution licen]
2 cddl-1.0 common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 0
2 cddl-1.1 common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 1
3 cddl common development and distribution licen[cs]e

[common public licen]
2 cpl-1.0 common public licen[cs]e(?: version| v)? ?1(?: 0)?
3 cpl common public licen[cs]e

[creativecommons]
1 cc-by-4.0 https? creativecommons org licenses by 4 0
1 cc-by-3.0 https? creativecommons org licenses by 3 0
1 cc-by-sa-4.0 https? creativecommons org licenses by sa 4 0
1 cc-by-sa-3.0 https? creativecommons org licenses by sa 3 0
1 cc-by-nc-4.0 https? creativecommons org licenses by nc 4 0
1 cc-by-nc-sa-4.0 https? creativecommons org licenses by nc sa 4 0
1 cc-by-nc-nd-4.0 https? creativecommons org licenses by nc nd 4 0
1 cc-by-nd-4.0 https? creativecommons org licenses by nd 4 0
1 cc0-1.0 https? creativecommons org publicdomain zero 1 0
1 public-domain https? creativecommons org publicdomain mark 1 0
4 creative-commons creativecommons org licenses

[creative commons]
2 cc-by-4.0 creative commons attribution 4 0(?: international)?
2 cc-by-3.0 creative commons attribution 3 0(?: unported)?
2 cc-by-2.5 creative commons attribution 2 5(?: generic)?
2 cc-by-2.0 creative commons attribution 2 0(?: generic)?
2 cc-by-sa-4.0 creative commons attribution share ?alike 4 0(?: international)?
2 cc-by-sa-3.0 creative commons attribution share ?alike 3 0(?: unported)?
2 cc-by-nc-4.0 creative commons attribution non ?commercial 4 0(?: international)?
2 cc-by-nc-3.0 creative commons attribution non ?commercial 3 0(?: unported)?
2 cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0(?: international)?
2 cc-by-nc-sa-3.0 creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
2 cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?
2 cc-by-nd-4.0 creative commons attribution no ?derivatives 4 0(?: international)?
2 cc0-1.0 creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
3 cc-by creative commons attribution(?: only)? licen[cs]e
3 cc-by-sa creative commons attribution share ?alike(?: licen[cs]e)?
3 cc-by-nc creative commons attribution non ?commercial(?: licen[cs]e)?
3 cc-by-nd creative commons attribution no ?derivatives(?: licen[cs]e)?
4 creative-commons creative commons licen[cs]e[ds]?

[cc by]
2 cc-by-4.0 cc by 4 0
2 cc-by-3.0 cc by 3 0
2 cc-by-sa-4.0 cc by sa 4 0
2 cc-by-sa-3.0 cc by sa 3 0
2 cc-by-nc-4.0 cc by nc 4 0
2 cc-by-nc-sa-4.0 cc by nc sa 4 0
2 cc-by-nc-nd-4.0 cc by nc nd 4 0
2 cc-by-nd-4.0 cc by nd 4 0

[cc0]
2 cc0-1.0 cc0 1 0(?: universal)?
3 cc0-1.0 (?:under|with|licensed) (?:the )?cc0

[public domain]
1 unlicense this is free and unencumbered software released into the public domain
2 public-domain (?:dedicated|released|placed|put) (?:in|into|to) the public domain
3 public-domain (?:is|are) in the public domain
3 public-domain public domain (?:dedication|work|software)

[unlicense]
1 unlicense (?:refer to|see) https? unlicense org
3 unlicense (?:under|with) the unlicense

[boost software licen]
2 bsl-1.0 boost software licen[cs]e(?: version)? 1 0
3 bsl-1.0 boost software licen[cs]e

[this software is provided as is without any express or implied warranty]
1 zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable

[zlib]
3 zlib zlib(?: libpng)? licen[cs]e

[isc licen]
3 isc isc licen[cs]e[ds]?

[artistic licen]
2 artistic-1.0 artistic licen[cs]e(?: version)? 1(?: 0)?
2 artistic-2.0 artistic licen[cs]e(?: version)? 2(?: 0)?
2 perl-5 same terms as perl(?: 5)? itself(?: [^ ]+){0,20} artistic licen[cs]e
3 artistic artistic licen[cs]e

[perl]
2 perl-5 (?:under )?the same terms as (?:the )?perl(?: 5)?(?: itself| programming language system itself)

[do what the fuck you want]
1 wtfpl do what the fuck you want to public licen[cs]e

[wtfpl]
3 wtfpl (?:under|with) the wtfpl

[python]
2 psf-2.0 python software foundation licen[cs]e(?: version)? 2
3 psf python software foundation licen[cs]e
3 psf psf licen[cs]e agreement for python

[php licen]
2 php-3.01 php licen[cs]e(?: version)? 3 01
3 php php licen[cs]e

[ruby]
3 ruby ruby(?: s)? licen[cs]e
3 ruby distributes under the same terms as ruby

[postgresql licen]
3 postgresql postgresql licen[cs]e

[european union public licen]
2 eupl-1.1 european union public licen[cs]e(?: eupl)?(?: version| v)? ?1 1
2 eupl-1.2 european union public licen[cs]e(?: eupl)?(?: version| v)? ?1 2
3 eupl european union public licen[cs]e

[open font licen]
2 ofl-1.1 (?:sil )?open font licen[cs]e(?: version)? 1 1
3 ofl (?:sil )?open font licen[cs]e

[open database licen]
2 odbl-1.0 open database licen[cs]e(?: odbl)?(?: version| v)? ?1 0
3 odbl open database licen[cs]e

[open data commons]
3 odc-by open data commons attribution licen[cs]e
3 pddl open data commons public domain dedication and licen[cs]e

[microsoft]
2 ms-pl microsoft public licen[cs]e
2 ms-rl microsoft reciprocal licen[cs]e
3 ms-eula microsoft software licen[cs]e terms

[university of illinois]
2 ncsa university of illinois(?: [^ ]+){0,4} ncsa open source licen[cs]e

[academic free licen]
2 afl-3.0 academic free licen[cs]e(?: version| v)? ?3(?: 0)?
3 afl academic free licen[cs]e

[open software licen]
2 osl-3.0 open software licen[cs]e(?: version| v)? ?3(?: 0)?
3 osl open software licen[cs]e

[universal permissive licen]
2 upl-1.0 universal permissive licen[cs]e(?: upl)?(?: version| v)? ?1(?: 0)?
3 upl-1.0 universal permissive licen[cs]e

[business source licen]
2 busl-1.1 business source licen[cs]e(?: version)? 1 1
3 busl business source licen[cs]e

[server side public licen]
2 sspl-1.0 server side public licen[cs]e(?: version| v)? ?1
3 sspl server side public licen[cs]e

[elastic licen]
2 elastic-2.0 elastic licen[cs]e(?: version)? 2(?: 0)?
3 elastic elastic licen[cs]e

[commons clause]
3 commons-clause commons clause(?: licen[cs]e condition)?

[mulan]
2 mulanpsl-2.0 mulan p(?:sl|ermissive software licen[cs]e) ?v?2

[vim licen]
3 vim vim licen[cs]e

[for good not evil]
1 json the software shall be used for good not evil

[json]
3 json json licen[cs]e

[beerware]
3 beerware beerware licen[cs]e

[beer ware licen]
1 beerware the beer ware licen[cs]e revision 42

[openssl licen]
3 openssl openssl licen[cs]e

[cecill]
2 cecill-2.1 cecill(?: free software licen[cs]e agreement)?(?: version| v)? ?2 1
3 cecill cecill(?: b| c)? licen[cs]e

[all rights reserved]
4 proprietary all rights reserved
3 proprietary proprietary and confidential(?: [^ ]+){0,12} all rights reserved
3 proprietary all rights reserved(?: [^ ]+){0,12} (?:unauthorized|unauthorised) (?:copying|use|reproduction)

[proprietary]
3 proprietary (?:is|are) proprietary (?:software|and confidential)
3 proprietary proprietary licen[cs]e

[licen]
4 license-reference see (?:the )?(?:accompanying )?licen[cs]e(?: file| txt| md)?(?: for details| for more information)?
4 license-reference licen[cs]ed under the terms of
4 license-reference distributed under the terms of the(?: [^ ]+){1,4} licen[cs]e
4 license-reference dual licen[cs]ed under
4 license-reference this (?:file|program|work|library|project|software) is licen[cs]ed under
4 license-reference released under the(?: [^ ]+){1,4} licen[cs]e
4 license-reference licen[cs]e agreement
4 license-reference open source licen[cs]e
4 license-reference free software licen[cs]e
"""

#: Words whose places count as the base of a scan, whatever else is found.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    keyword: str
    level: int
    label: str
    pattern: str


def read_rules(table: str = TABLE) -> list[Rule]:
    """The rules of a table, in its order."""
    rules, keyword = [], None
    for line in table.splitlines():
        if line.startswith("[") and line.endswith("]"):
            keyword = line[1:-1]
        elif line.strip():
            level, label, pattern = line.split(" ", 2)
            if keyword is None or not 1 <= int(level) <= 4:
                raise ValueError(f"not a rule: {line}")
            rules.append(Rule(keyword, int(level), label, pattern))
    return rules

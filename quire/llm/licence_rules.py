"""Signature rules of the licence scan, in order.

They are matched against a text's words: ASCII lower case, everything but
letters, digits and non-ASCII characters folded to one space.  So "Apache
License, Version 2.0" reads ``apache license version 2 0``.

One rule a line: tier, keyword, label, expression.  Tier 1 holds declared
identifiers, 2 names with a version and distinctive sentences, 3 families, 4
general notices.  The keyword gates the rule: the expression is tried only on
texts that contain it, so every match must contain it too (``_`` stands for a
space, so ``_mit_`` is a whole word).
An expression always begins and ends at word borders.
"""

from __future__ import annotations

from typing import NamedTuple

#: Chance that a match of the tier means a licence statement.
WEIGHT = {1: 0.98, 2: 0.95, 3: 0.8, 4: 0.5}


class Rule(NamedTuple):
    number: int
    tier: int
    keyword: str
    label: str
    pattern: str


RULES_TEXT = r"""
1 spdx_ apache-2.0 spdx license identifier apache 2 0
1 spdx_ apache-1.1 spdx license identifier apache 1 1
1 spdx_ apache-1.0 spdx license identifier apache 1 0
1 spdx_ mit-0 spdx license identifier mit 0
1 spdx_ mit spdx license identifier mit
1 spdx_ bsd-0-clause spdx license identifier 0bsd
1 spdx_ bsd-1-clause spdx license identifier bsd 1 clause
1 spdx_ bsd-2-clause spdx license identifier bsd 2 clause( patent)?
1 spdx_ bsd-3-clause spdx license identifier bsd 3 clause( clear)?
1 spdx_ bsd-4-clause spdx license identifier bsd 4 clause
1 spdx_ isc spdx license identifier isc
1 spdx_ zlib spdx license identifier zlib
1 spdx_ unlicense spdx license identifier unlicense
1 spdx_ wtfpl spdx license identifier wtfpl
1 spdx_ gpl-1.0 spdx license identifier gpl 1 0( only| or later)?
1 spdx_ gpl-2.0 spdx license identifier gpl 2 0( only| or later)?
1 spdx_ gpl-3.0 spdx license identifier gpl 3 0( only| or later)?
1 spdx_ lgpl-2.0 spdx license identifier lgpl 2 0( only| or later)?
1 spdx_ lgpl-2.1 spdx license identifier lgpl 2 1( only| or later)?
1 spdx_ lgpl-3.0 spdx license identifier lgpl 3 0( only| or later)?
1 spdx_ agpl-3.0 spdx license identifier agpl 3 0( only| or later)?
1 spdx_ mpl-1.1 spdx license identifier mpl 1 1
1 spdx_ mpl-2.0 spdx license identifier mpl 2 0( no copyleft exception)?
1 spdx_ epl-1.0 spdx license identifier epl 1 0
1 spdx_ epl-2.0 spdx license identifier epl 2 0
1 spdx_ eupl spdx license identifier eupl 1 [012]
1 spdx_ cddl-1.0 spdx license identifier cddl 1 0
1 spdx_ cddl-1.1 spdx license identifier cddl 1 1
1 spdx_ cc0-1.0 spdx license identifier cc0 1 0
1 spdx_ cc-by-nc-nd spdx license identifier cc by nc nd [1-4] [05]
1 spdx_ cc-by-nc-sa spdx license identifier cc by nc sa [1-4] [05]
1 spdx_ cc-by-nc spdx license identifier cc by nc [1-4] [05]
1 spdx_ cc-by-nd spdx license identifier cc by nd [1-4] [05]
1 spdx_ cc-by-sa spdx license identifier cc by sa [1-4] [05]
1 spdx_ cc-by spdx license identifier cc by [1-4] [05]
1 spdx_ artistic-1.0 spdx license identifier artistic 1 0( perl| cl8)?
1 spdx_ artistic-2.0 spdx license identifier artistic 2 0
1 spdx_ boost-1.0 spdx license identifier bsl 1 0
1 spdx_ busl-1.1 spdx license identifier busl 1 1
1 spdx_ sspl-1.0 spdx license identifier sspl 1 0
1 spdx_ ofl-1.1 spdx license identifier ofl 1 [01]
1 spdx_ postgresql spdx license identifier postgresql
1 spdx_ python spdx license identifier (python|psf) 2 0( 1)?
1 spdx_ ruby spdx license identifier ruby
1 spdx_ php spdx license identifier php 3 0?1?
1 spdx_ openssl spdx license identifier openssl
1 spdx_ ncsa spdx license identifier ncsa
1 spdx_ upl-1.0 spdx license identifier upl 1 0
1 spdx_ odbl-1.0 spdx license identifier odbl 1 0
1 spdx_ odc-by-1.0 spdx license identifier odc by 1 0
1 spdx_ pddl-1.0 spdx license identifier pddl 1 0
1 spdx_ ms-pl spdx license identifier ms pl
1 spdx_ ms-rl spdx license identifier ms rl
1 spdx_ mulan-2.0 spdx license identifier mulanpsl 2 0
1 spdx_ ecl-2.0 spdx license identifier ecl 2 0
1 spdx_ cecill spdx license identifier cecill [12] [01]
1 spdx_ ipl-1.0 spdx license identifier ipl 1 0
1 spdx_ cpl-1.0 spdx license identifier cpl 1 0
1 spdx_ osl-3.0 spdx license identifier osl 3 0
1 spdx_ afl-3.0 spdx license identifier afl [123] [01]
1 spdx_ blueoak-1.0.0 spdx license identifier blueoak 1 0 0
1 spdx_ proprietary spdx license identifier licenseref [a-z0-9]+
1 license_ osi-classifier license osi approved [a-z0-9]+( [a-z0-9]+){0,3} license
1 licenses_ apache-2.0 apache org licenses license 2 0( txt| html)?
1 licenses_ gpl www gnu org licenses (old licenses )?gpl( [123] 0)?( txt| html)?
1 licenses_ lgpl www gnu org licenses (old licenses )?lgpl( [23] [01])?( txt| html)?
1 licenses_ agpl www gnu org licenses agpl( 3 0)?( txt| html)?
1 licenses_ gfdl www gnu org licenses fdl( 1 [1-3])?( txt| html)?
1 licenses_ mit opensource org licenses mit( license)?( php)?
1 licenses_ bsd opensource org licenses bsd( [234] clause| license)?( php)?
1 licenses_ mpl-2.0 opensource org licenses mpl 2 0
1 licenses_ isc opensource org licenses isc
1 mozilla mpl-1.1 mozilla org mpl( mpl 1 1( html| txt)?)?
1 mozilla mpl-2.0 mozilla org mpl 2 0
1 eclipse epl-1.0 eclipse org legal epl v10( html)?
1 eclipse epl-2.0 eclipse org legal epl (2 0|v20)( html)?
1 creativecommons cc-by-nc-nd creativecommons org licenses by nc nd [1-4] [05]
1 creativecommons cc-by-nc-sa creativecommons org licenses by nc sa [1-4] [05]
1 creativecommons cc-by-nc creativecommons org licenses by nc [1-4] [05]
1 creativecommons cc-by-nd creativecommons org licenses by nd [1-4] [05]
1 creativecommons cc-by-sa creativecommons org licenses by sa [1-4] [05]
1 creativecommons cc-by creativecommons org licenses by [1-4] [05]
1 creativecommons cc0-1.0 creativecommons org publicdomain zero 1 0
1 creativecommons pd-mark creativecommons org publicdomain mark 1 0
1 unlicense unlicense unlicense org
1 boost boost-1.0 www boost org license 1 0( txt)?
2 apache apache-2.0 apache licen[cs]e( version| v)? ?2 0
2 apache apache-2.0 apache (software )?licen[cs]e v2( 0)?
2 apache apache-2.0 apache 2( 0)? licen[cs]ed?
2 apache apache-2.0 apache 2 0
2 apache apache-1.1 apache (software )?licen[cs]e( version| v)? 1 1
2 apache apache-1.0 apache (software )?licen[cs]e( version| v)? 1 0
2 apache apache-2.0 licensed under the apache license version 2 0( the license)?
2 compliance apache-2.0 you may not use this file except in compliance with the license
2 limitations apache-2.0 see the license for the specific language governing permissions and limitations under the license
2 permission mit permission is hereby granted free of charge to any person obtaining a copy of this software( and associated documentation files)?
2 permission mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 permission isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 permission hpnd permission to use copy modify (and )?distribute( and sell)? this software and its documentation for any purpose
2 permission ofl-1.1 permission is hereby granted free of charge to any person obtaining a copy of the font software
2 redistribution bsd redistribution and use in source and binary forms with or without modification are permitted
2 redistribution bsd redistributions of source code must retain the above copyright notice
2 redistribution bsd redistributions in binary form must reproduce the above copyright notice
2 endorse bsd-3-clause neither the names? of [a-z0-9 ]{1,80}? nor the names of (its|their) contributors may be used to endorse or promote products
2 advertising bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 bsd_ bsd-2-clause (2|two) clause( simplified)? bsd( licen[cs]e)?
2 bsd_ bsd-3-clause (3|three) clause( modified| new| revised)? bsd( licen[cs]e)?
2 bsd_ bsd-4-clause (4|four) clause( original)? bsd( licen[cs]e)?
2 bsd_ bsd-2-clause (bsd 2 clause|simplified bsd|freebsd)( licen[cs]e)?
2 bsd_ bsd-3-clause (bsd 3 clause|new bsd|modified bsd|revised bsd)( licen[cs]e)?
2 bsd_ bsd-4-clause (bsd 4 clause|original bsd)( licen[cs]e)?
2 bsd_ bsd-0-clause (0bsd|zero clause bsd|bsd zero clause)( licen[cs]e)?
2 general_public gpl-2.0 gnu general public licen[cs]e( as published by the free software foundation)?( either)? (version|v) ?2( 0)?
2 general_public gpl-3.0 gnu general public licen[cs]e( as published by the free software foundation)?( either)? (version|v) ?3( 0)?
2 general_public gpl-1.0 gnu general public licen[cs]e (version|v) ?1
2 gpl gpl-2.0 (gnu )?gpl ?(version |v ?)?2( 0)?( only| or later)?
2 gpl gpl-3.0 (gnu )?gpl ?(version |v ?)?3( 0)?( only| or later)?
2 gpl lgpl-2.1 (gnu )?lgpl ?(version |v ?)?2 1( only| or later)?
2 gpl lgpl-2.0 (gnu )?lgpl ?(version |v ?)?2( 0)?( only| or later)?
2 gpl lgpl-3.0 (gnu )?lgpl ?(version |v ?)?3( 0)?( only| or later)?
2 gpl agpl-3.0 (gnu )?agpl ?(version |v ?)?3( 0)?( only| or later)?
2 lesser_general lgpl-2.1 gnu lesser general public licen[cs]e( as published by the free software foundation)?( either)? (version|v) ?2 1
2 lesser_general lgpl-3.0 gnu lesser general public licen[cs]e( as published by the free software foundation)?( either)? (version|v) ?3( 0)?
2 library_general lgpl-2.0 gnu library general public licen[cs]e( (version|v) ?2( 0)?)?
2 affero agpl-3.0 gnu affero general public licen[cs]e( as published by the free software foundation)?( either)? (version|v) ?3( 0)?
2 affero agpl-1.0 affero general public licen[cs]e (version|v) ?1
2 free_documentation gfdl gnu free documentation licen[cs]e( (version|v) ?1 [1-3])?
2 free_software gpl this program is free software you can redistribute it and or modify it
2 free_software lgpl this library is free software you can redistribute it and or modify it
2 received_a_copy gpl you should have received a copy of the gnu general public license along with this program
2 received_a_copy lgpl you should have received a copy of the gnu lesser general public license along with
2 received_a_copy agpl you should have received a copy of the gnu affero general public license along with
2 merchantability gpl without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
2 mozilla mpl-1.0 mozilla public licen[cs]e( version| v)? ?1 0
2 mozilla mpl-1.1 mozilla public licen[cs]e( version| v)? ?1 1
2 mozilla mpl-2.0 mozilla public licen[cs]e( version| v)? ?2 0
2 source_code_form mpl-2.0 this source code form is subject to the terms of the mozilla public license
2 eclipse epl-1.0 eclipse public licen[cs]e( version| v)? ?1 0
2 eclipse epl-2.0 eclipse public licen[cs]e( version| v)? ?2 0
2 eclipse edl-1.0 eclipse distribution licen[cs]e( version| v)? ?1 0
2 common_development cddl-1.0 common development and distribution licen[cs]e( version| v)? ?1 0
2 common_development cddl-1.1 common development and distribution licen[cs]e( version| v)? ?1 1
2 common_public cpl-1.0 common public licen[cs]e( version| v)? ?1 0
2 european_union eupl european union public licen[cs]e( version| v)?( 1 [012])?
2 artistic artistic-1.0 artistic licen[cs]e( version| v)? ?1 0
2 artistic artistic-2.0 artistic licen[cs]e( version| v)? ?2 0
2 artistic artistic same terms as perl itself under the artistic license
2 boost boost-1.0 boost software licen[cs]e( version| v)?( 1 0)?
2 business_source busl-1.1 business source licen[cs]e( version| v)?( 1 1)?
2 server_side sspl-1.0 server side public licen[cs]e( version| v)?( 1)?
2 elastic_licen elastic-2.0 elastic licen[cs]e( version| v)?( 2 0)?
2 commons_clause commons-clause commons clause licen[cs]e condition( v?1 0)?
2 open_font ofl-1.1 (sil )?open font licen[cs]e( version| v)?( 1 [01])?
2 open_database odbl-1.0 open database licen[cs]e( version| v)?( 1 0)?
2 open_data odc-by-1.0 open data commons attribution licen[cs]e( version| v)?( 1 0)?
2 open_data pddl-1.0 open data commons public domain dedication( and licen[cs]e)?
2 open_government ogl open government licen[cs]e( version| v)?( ?[123] 0)?
2 academic_free afl academic free licen[cs]e( version| v)?( ?[123] [01])?
2 open_software osl open software licen[cs]e( version| v)?( ?[123] [01])?
2 educational ecl-2.0 educational community licen[cs]e( version| v)?( 2 0)?
2 universal_permissive upl-1.0 universal permissive licen[cs]e( version| v)?( 1 0)?
2 blue_oak blueoak-1.0.0 blue oak model licen[cs]e( version| v)?( 1 0 0)?
2 mulan mulan-2.0 mulan permissive software licen[cs]e( version| v)?( ?2)?
2 microsoft ms-pl microsoft public licen[cs]e
2 microsoft ms-rl microsoft reciprocal licen[cs]e
2 microsoft ms-eula microsoft software licen[cs]e terms
2 ibm_public ipl-1.0 ibm public licen[cs]e( version| v)?( 1 0)?
2 python psf python software foundation licen[cs]e( version| v)?( ?2( 0)?)?
2 php_licen php php licen[cs]e( version| v)?( ?3 01?)?
2 openssl openssl openssl licen[cs]e
2 postgresql postgresql postgresql licen[cs]e
2 zlib zlib zlib( libpng)? licen[cs]e
2 origin_of zlib the origin of this software must not be misrepresented
2 ncsa ncsa (university of illinois )?ncsa open source licen[cs]e
2 x11 x11 x11 licen[cs]e
2 unencumbered unlicense this is free and unencumbered software released into the public domain
2 you_want_to_public wtfpl do what the f[a-z]+ you want to public licen[cs]e
2 beer beerware (the )?beer ?ware licen[cs]e( revision 42)?
2 good_not_evil json the software shall be used for good not evil
2 creative_commons cc-by-nc-nd creative commons( licen[cs]e)? attribution non ?commercial no ?deriv(ative)?s?( works)?( [1-4] [05])?( international| unported)?
2 creative_commons cc-by-nc-sa creative commons( licen[cs]e)? attribution non ?commercial share ?alike( [1-4] [05])?( international| unported)?
2 creative_commons cc-by-nc creative commons( licen[cs]e)? attribution non ?commercial( [1-4] [05])?( international| unported)?
2 creative_commons cc-by-nd creative commons( licen[cs]e)? attribution no ?deriv(ative)?s?( works)?( [1-4] [05])?( international| unported)?
2 creative_commons cc-by-sa creative commons( licen[cs]e)? attribution share ?alike( [1-4] [05])?( international| unported)?
2 creative_commons cc-by creative commons( licen[cs]e)? attribution( [1-4] [05])?( international| unported)?( licen[cs]e)?
2 creative_commons cc0-1.0 creative commons (zero|cc0)( public domain dedication)?( [1] 0)?( universal)?
2 _cc_ cc-by-nc-nd cc by nc nd( [1-4] [05])?
2 _cc_ cc-by-nc-sa cc by nc sa( [1-4] [05])?
2 _cc_ cc-by-nc cc by nc( [1-4] [05])?
2 _cc_ cc-by-nd cc by nd( [1-4] [05])?
2 _cc_ cc-by-sa cc by sa( [1-4] [05])?
2 _cc_ cc-by cc by [1-4] [05]
2 cc0 cc0-1.0 cc0( 1 0)?( universal)?( public domain dedication)?
3 apache apache (the )?apache (software )?licen[cs]e
3 apache apache (released|distributed|licen[cs]ed|available) under (the )?apache
3 _mit_ mit (the )?mit licen[cs]e
3 _mit_ mit (released|distributed|licen[cs]ed|available) under (the )?(terms of the )?mit
3 _mit_ mit mit licen[cs]ed
3 _mit_ mit licen[cs]e mit
3 expat mit expat licen[cs]e
3 bsd_ bsd (the )?bsd( style| type)? licen[cs]es?
3 bsd_ bsd (released|distributed|licen[cs]ed|available) under (the )?bsd
3 _isc_ isc (the )?isc licen[cs]e
3 general_public gpl (gnu )?general public licen[cs]e
3 general_public gpl general public license
3 gpl gpl (the )?(gnu )?gpl( licen[cs]ed?)?
3 gpl lgpl (the )?(gnu )?lgpl( licen[cs]ed?)?
3 gpl agpl (the )?(gnu )?agpl( licen[cs]ed?)?
3 lesser_general lgpl (gnu )?lesser general public licen[cs]e
3 affero agpl (gnu )?affero (general public )?licen[cs]e
3 mozilla mpl mozilla public licen[cs]e
3 eclipse epl eclipse public licen[cs]e
3 common_development cddl common development and distribution licen[cs]e
3 artistic artistic artistic licen[cs]e
3 perl perl same (licen[cs]e )?terms as perl( itself)?
3 ruby_licen ruby ruby licen[cs]e
3 licen psf (psf|python) licen[cs]e
3 creative_commons cc (a )?creative commons( public)? licen[cs]es?
3 creative_commons cc creative commons
3 _cc_ cc-by cc by
3 unlicense unlicense (the )?unlicense
3 wtfpl wtfpl wtfpl
3 copyleft copyleft copyleft( licen[cs]ed?)?
3 public_domain public-domain (released|dedicated|placed|put) (in|to|into) the public domain
3 public_domain public-domain (is|are) in the public domain
3 public_domain public-domain public domain( dedication)?
3 dual_licen dual dual licen[cs](ed|ing)( under)?
3 open_source open-source open source licen[cs]es?
3 proprietary proprietary (proprietary and confidential|confidential and proprietary)
3 proprietary proprietary proprietary (software|licen[cs]e|information)
3 trade_secret proprietary trade secrets?
3 end_user eula end user licen[cs]e agreement
3 eula eula eula
3 royalty_free royalty-free royalty free( non exclusive| worldwide)*( licen[cs]e)?
3 non_commercial non-commercial (for )?non commercial (use|purposes)( only)?
3 noncommercial non-commercial (for )?noncommercial (use|purposes)( only)?
3 personal_use personal-use for personal use only
3 _only_ academic-use (for )?(academic|research|educational)( and research)? (use|purposes) only
3 permission reserved (may not|cannot|must not) be (reproduced|copied|distributed|republished)( [a-z]+){0,8} without( [a-z]+){0,3} permission
3 no_part reserved no part of this [a-z]+ may be (reproduced|copied|distributed|transmitted)
3 without_warranty no-warranty without warranty of any kind( express or implied)?
3 without_warranties no-warranty without warranties or conditions of any kind( either express or implied)?
3 as_is no-warranty (is|are) (provided|distributed) (on an )?as is( basis)?
4 rights_reserved reserved all rights reserved
4 rights_reserved some-reserved some rights reserved
4 rights_reserved no-reserved no rights reserved
4 alle_rechte reserved alle rechte vorbehalten
4 tous_droits reserved tous droits réservés
4 todos_los reserved todos los derechos reservados
4 copyright copyright copyright( c)? (19|20)[0-9][0-9]
4 copyright copyright copyright( c)?( by)?
4 _c_ copyright c (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?
4 licen licence (licen[cs]ed|released|distributed|available) under( the)?( terms of)?( the)?( [a-z0-9]+){1,4} licen[cs]e
4 licen licence licen[cs]ed under
4 licen licence (see|read) the (accompanying )?licen[cs]e( file)?
4 subject_to_the licence subject to the (following )?(terms|licen[cs]e)
4 terms_of terms terms of (use|service)
4 trademark trademark (is|are) (a )?(registered )?trademarks?
4 patent patent patent pending
"""


def _parse(text: str) -> list[Rule]:
    rules = []
    for line in text.strip().splitlines():
        tier, keyword, label, pattern = line.split(" ", 3)
        rules.append(Rule(len(rules), int(tier), keyword.replace("_", " "), label, pattern))
    return rules


RULES = _parse(RULES_TEXT)

"""Signature rules of the license scan: hand-written signatures of license texts, and statements that name a license."""

from __future__ import annotations

from dataclasses import dataclass

#: Priorities, the stronger first: license texts and headers, identifiers, statements, mere mentions.
TEXT, IDENTIFIER, STATEMENT, MENTION = range(4)
PRIORITIES = 4


@dataclass(frozen=True)
class Rule:
    """label where regex stands in the words joined by single spaces. Where it matches, these words, between blanks,
    hold a keyword and an anchor, if any are given; so the regex is looked at only in texts that hold them."""

    label: str
    keywords: tuple[str, ...]
    regex: str
    priority: int
    confidence: float
    anchors: tuple[str, ...] = ()


#: Label, keyword, and how the license's own text or its usual header reads, in order.
TEXTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?"),
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "permission notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "copyright holders be liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "is hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("0bsd", "is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "is hereby granted", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted without fee|and without fee is hereby granted)"),
    ("postgresql", "is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-2-clause", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:[^ ]+ ){1,12}(?:nor|or) the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "patent rights are granted", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", "express or implied warranties", "this software is provided by the (?:[^ ]+ ){1,6}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "exemplary or consequential", "in no event shall the (?:[^ ]+ ){1,6}be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("apache-2", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", "you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2", "governing permissions", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "apache license", "apache license version 2 0 january 2004"),
    ("apache-2", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl-2-or-later", "general public license", "under the terms of (?:version 2 of )?the gnu general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-3-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-1-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 1(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-2", "general public license", "under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) as published by the free software foundation"),
    ("gpl-3", "general public license", "under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3) as published by the free software foundation"),
    ("lgpl-2-or-later", "general public license", "under the terms of the gnu (?:library|lesser) general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", "general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-3-or-later", "general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("agpl-3-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("gpl", "general public license", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "general public license", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details"),
    ("agpl-3", "affero", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("gpl", "general public license", "you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("lgpl", "general public license", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program|software)"),
    ("agpl-3", "affero", "you should have received a copy of the gnu affero general public license along with this (?:program|software)"),
    ("gpl-1", "general public license", "gnu general public license version 1 february 1989"),
    ("gpl-2", "general public license", "gnu general public license version 2 june 1991"),
    ("gpl-3", "general public license", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "general public license", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "general public license", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "general public license", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero", "gnu affero general public license version 3 19 november 2007"),
    ("gpl-2", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", "copyleft license", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-with-classpath-exception", "as a special exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    ("gpl-with-autoconf-exception", "as a special exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-with-bison-exception", "as a special exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-with-gcc-exception", "runtime library exception", "gcc runtime library exception version 3 1"),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2-no-copyleft-exception", "secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-tri-license", "alternatively the contents", "alternatively the contents of this file may be used under the terms of (?:either )?the gnu (?:lesser )?general public license"),
    ("epl-1", "eclipse public license", "made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", "eclipse public license", "made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl", "eclipse public license", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cpl-1", "common public license", "the accompanying program is provided under the terms of this common public license agreement"),
    ("cddl-1", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", "cddl header", "when distributing (?:covered code|the software) include this cddl header notice in each file"),
    ("zlib", "without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "source distribution", "this notice may not be removed or altered from any source distribution"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsl-1", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", "boost software license", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "what the fuck", "do what the fuck you want to(?: public license)?"),
    ("cc0", "neighboring rights", "has waived all copyright and related or neighboring rights to"),
    ("cc0", "by waiving all", "has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc0", "neighboring rights", "to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", "(?:placed|released|put) (?:in|into) the public domain"),
    ("public-domain", "public domain", "dedicated to the public domain"),
    ("public-domain", "not subject to copyright", "(?:work of the u(?:nited)? s(?:tates)? government(?: and is)?|is) not subject to copyright(?: protection)?"),
    ("creative-commons", "licensed rights", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("artistic-1", "artistic control", "such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2", "given free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "same terms as", "under the same terms as (?:the )?perl (?:5 )?itself"),
    ("psf-2", "psf is making", "psf is making python available to licensee on an as is basis"),
    ("psf-2", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic software", "this product includes cryptographic software written by eric young"),
    ("php", "php software", "this product includes php software freely available from"),
    ("ruby", "terms of ruby", "you (?:may|can) redistribute (?:it|this software) and or modify it under (?:either )?the terms of ruby"),
    ("ofl-1.1", "open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font name s?"),
    ("unicode", "unicode inc license", "unicode inc license agreement data files and software"),
    ("ms-pl", "bring a patent claim", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license from such contributor to the software ends automatically"),
    ("ms-rl", "reciprocal grants", "reciprocal grants for any file you distribute that contains code from the software"),
    ("eupl", "european union", "european union public licen[cs]e"),
    ("odbl-1", "open database license", "this (?:[^ ]+ ){1,8}is made available under the open database license"),
    ("odc-by-1", "open data commons", "open data commons attribution license"),
    ("pddl-1", "open data commons", "open data commons public domain dedication and licen[cs]e"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("beerware", "buy me a beer", "you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("sspl-1", "server side public license", "server side public license(?: version 1)?"),
    ("busl-1.1", "business source license", "business source license(?: 1 1)?"),
    ("elastic-2", "elastic license", "elastic license (?:version )?2 0"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("osl-3", "open software license", "licensed under the open software license version 3 0"),
    ("afl-3", "academic free license", "licensed under the academic free license version 3 0"),
    ("upl-1", "universal permissive", "the universal permissive license(?: upl)?(?: version 1 0)?"),
    ("blueoak-1", "blue oak", "blue oak model license(?: 1 0 0)?"),
    ("llama", "llama", "llama (?:[0-9] )?(?:[0-9] )?community license(?: agreement)?"),
    ("openrail", "openrail", "(?:creativeml )?openrail m(?: license)?"),
    ("w3c", "w3c software", "w3c software (?:and document )?notice and license"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype project", "portions of this software are copyright (?:[^ ]+ ){0,3}the freetype project"),
    ("vim", "charityware", "vim is charityware you can use and copy it as much as you like"),
    ("proprietary", "strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "confidential and proprietary", "(?:is )?(?:the )?confidential and proprietary information of"),
)

#: Label, keywords, and the name as it reads once words are joined by single spaces.
NAMES = (
    ("mit", ("mit", "expat"), "(?:mit|expat|mit x11)"),
    ("mit-0", ("mit",), "mit (?:no attribution|0)"),
    ("apache-1.1", ("apache",), "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", ("apache",), "apache(?: software)?(?: license)?(?: version)? (?:v2|2)(?: 0)?"),
    ("bsd", ("bsd",), "bsd"),
    ("bsd-2-clause", ("bsd",), "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", ("bsd",), "(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4-clause", ("bsd",), "(?:bsd 4 clause|(?:4|four) clause bsd|original bsd)"),
    ("0bsd", ("0bsd", "zero clause"), "(?:0bsd|zero clause bsd)"),
    ("gpl", ("gnu",), "gnu (?:general public license|gpl)"),
    ("gpl-2", ("gnu", "gpl"), "(?:gnu (?:general public license|gpl)(?: version)? (?:v2|2)|gpl ?(?:version )?v?2)(?: 0)?"),
    ("gpl-3", ("gnu", "gpl"), "(?:gnu (?:general public license|gpl)(?: version)? (?:v3|3)|gpl ?(?:version )?v?3)(?: 0)?"),
    ("lgpl", ("lesser", "library general"), "gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", ("lgpl", "lesser"), "(?:gnu lesser general public license(?: version)?|lgpl(?: version)?) ?v?2 1"),
    ("lgpl-3", ("lgpl", "lesser"), "(?:gnu lesser general public license(?: version)?|lgpl(?: version)?) ?v?3(?: 0)?"),
    ("agpl-3", ("affero", "agpl"), "(?:gnu affero general public license(?: version)?|agpl(?: version)?) ?v?3(?: 0)?"),
    ("mpl-1.1", ("mozilla",), "mozilla public license(?: version)? 1 1"),
    ("mpl-2", ("mozilla", "mpl"), "(?:mozilla public license(?: version)?|mpl) ?v?2(?: 0)?"),
    ("epl-1", ("eclipse",), "eclipse public license(?: version)? ?v?1(?: 0)?"),
    ("epl-2", ("eclipse",), "eclipse public license(?: version)? ?v?2(?: 0)?"),
    ("cddl-1", ("cddl",), "cddl(?: version)? 1(?: 0)?"),
    ("isc", ("isc",), "isc"),
    ("zlib", ("zlib",), "zlib(?: libpng)?"),
    ("bsl-1", ("boost",), "boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("artistic-2", ("artistic",), "artistic license(?: version)? 2(?: 0)?"),
    ("ofl-1.1", ("sil",), "sil open font license(?: version)?(?: 1 1)?"),
    ("unlicense", ("unlicense",), "unlicense"),
    ("wtfpl", ("wtfpl",), "wtfpl"),
    ("cc0", ("cc0",), "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", ("public domain",), "public domain"),
    ("eupl-1.2", ("eupl",), "eupl(?: version)? 1 2"),
    ("ms-pl", ("microsoft",), "microsoft public license"),
    ("odbl-1", ("odbl",), "odbl(?: 1 0)?"),
    ("gfdl", ("gfdl", "free documentation"), "(?:gfdl|gnu free documentation license(?: version)?)(?: 1 [123])?"),
    ("psf-2", ("python",), "python software foundation license(?: version)?(?: 2)?"),
)

#: Priority, confidence, and how a name stands in a statement.
TEMPLATES = (
    (IDENTIFIER, 0.99, "spdx(?: license)?(?: id| identifier)? {name}(?: only| or later)?"),
    (STATEMENT, 0.95, "spdx license identifier(?: [^ ]+){1,5}? (?:or|and) {name}(?: only| or later)?"),
    (STATEMENT, 0.95, "(?:licen[sc]ed|released|distributed|published|available|shared) under (?:either |both )?(?:of )?(?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]es?)?"),
    (STATEMENT, 0.9, "licen[sc]ed (?:as|with|by|via|using) (?:the )?{name}(?: licen[sc]e)?"),
    (STATEMENT, 0.9, "{name} licen[sc]ed"),
    (STATEMENT, 0.8, "(?:under|terms of|terms and conditions of) (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?"),
    (STATEMENT, 0.8, "{name} licen[sc]es?"),
    (MENTION, 0.6, "{name}(?= copyright)|licen[sc]es?(?: is| are| type| name| id)?(?: the)? {name}"),
)
#: The names that say enough alone, so that they need no statement; their confidence. "mit 0" isn't one:
#: in German it says "with 0".
ALONE = (
    "apache-1.1", "apache-2", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-1.1", "mpl-2", "epl-1", "epl-2",
    "bsl-1", "artistic-2", "ofl-1.1", "wtfpl", "cc0", "eupl-1.2", "ms-pl", "odbl-1", "gfdl", "psf-2",
)
NAMED = 0.6
#: One of these is in the text of every statement, and of every license text.
ANCHORS = (" licen", " under ", " copyright", " spdx ", " terms ")
TEXT_ANCHORS = (" licen", " copyright", " software ", " public ", " redistribution", " distribut", " terms ", " liable ", " library ", " exception ", " invariant ", " worth ", " charityware ", " prohibited", " proprietary ", " openrail ", " fuck ", " advertising ")


def creative_commons() -> list[tuple[str, tuple[str, ...], str]]:
    """A name for every Creative Commons variant, by rule: without a version, and with each of its versions."""
    long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
    out = []
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        name = f"(?:cc {' '.join(parts)}|creative commons {' '.join(long[p] for p in parts)})(?! (?:sa|nc|nd|share|non|no ?deriv))"
        label = "cc-" + "-".join(parts)
        out.append((label, ("cc by", "creative commons"), name))
        out += [(f"{label}-{v}.0", ("cc by", "creative commons"), f"{name} {v} 0(?: international)?") for v in (2, 3, 4)]
    return out


def signature_rules() -> list[Rule]:
    """The ordered rules, each once: the texts, then every name in every statement, then the names that need none. The
    order breaks ties."""
    whole = lambda regex: f"(?<![^ ])(?:{regex})(?![^ ])"
    rules = [Rule(label, (keyword,), whole(regex), TEXT, 0.97, TEXT_ANCHORS) for label, keyword, regex in TEXTS]
    for priority, confidence, template in TEMPLATES:
        for label, keywords, name in (*NAMES, *creative_commons()):
            rules.append(Rule(label, keywords, whole(template.replace("{name}", f"(?:{name})")), priority, confidence, ANCHORS))
    alone = [x for x in NAMES if x[0] in ALONE]
    return rules + [Rule(label, keywords, whole(name), MENTION, NAMED) for label, keywords, name in (*alone, *creative_commons())]

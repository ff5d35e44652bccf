"""License detection by ordered signature rules, in DataFrame functions alone.

A text becomes its lower-case words, each between two blanks.  Rules are
regexes over such words.  A rule runs only on texts that hold its keyword.
Detections are word intervals; one that lies inside another is suppressed,
and of equal intervals the rule of the higher priority (the earlier one)
stays.  Rules without a label only suppress: they match mentions that grant
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but a-z and 0-9.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that are always looked for, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 0.8
#: Matches of a rule whose places are summed up together.
BLOCK_MATCHES = 64


@dataclass(frozen=True)
class Rule:
    """``regex`` over words with one blank between them; ``keyword``: a word that every match holds.

    ``says_license``: every match also holds a word that begins with licen.
    """

    label: str
    keyword: str
    regex: str
    score: float
    says_license: bool = False


# label, keyword, how the license is named, its SPDX words
LICENSES = (
    ("mit", "mit", "mit(?: expat)? licen[cs]e", "mit"),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("expat", "expat", "expat licen[cs]e", "expat"),
    ("x11", "x11", "x11 licen[cs]e", "x11"),
    ("isc", "isc", "isc licen[cs]e", "isc"),
    ("bsd-0-clause", "bsd", "(?:zero|0) clause bsd licen[cs]e", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|(?:2|two) clause) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|(?:3|three) clause) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|old|(?:4|four) clause) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("apache-1", "apache", "apache(?: software)? licen[cs]e (?:version |v )?1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache", "apache(?: software)? licen[cs]e (?:version |v )?(?:v?2)(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "apache"),
    ("gpl-1", "general", "gnu general public licen[cs]e (?:version |v )?v?1", "gpl 1 0 only"),
    ("gpl-2", "general", "gnu general public licen[cs]e (?:version |v )?v?2", "gpl 2 0(?: only)?"),
    ("gpl-2-or-later", "later", "gnu general public licen[cs]e (?:version |v )?v?2(?: 0)? or (?:any |at your option any )?later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3", "general", "gnu general public licen[cs]e (?:version |v )?v?3", "gpl 3 0(?: only)?"),
    ("gpl-3-or-later", "later", "gnu general public licen[cs]e (?:version |v )?v?3(?: 0)? or (?:any |at your option any )?later(?: version)?", "gpl 3 0 or later"),
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "gpl"),
    ("lgpl-2", "library", "gnu library general public licen[cs]e (?:version |v )?v?2", "lgpl 2 0(?: only)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public licen[cs]e (?:version |v )?v?2 1", "lgpl 2 1(?: only)?"),
    ("lgpl-3", "lesser", "gnu lesser general public licen[cs]e (?:version |v )?v?3", "lgpl 3 0(?: only)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "lgpl"),
    ("agpl-3", "affero", "gnu affero general public licen[cs]e (?:version |v )?v?3", "agpl 3 0(?: only)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", "gfdl 1 [123](?: only)?"),
    ("mpl-1", "mozilla", "mozilla public licen[cs]e (?:version |v )?v?1(?: [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl"),
    ("eupl", "european", "european union public licen[cs]e", "eupl 1 [12]"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "cddl 1 [01]"),
    ("cpl", "common", "common public licen[cs]e", "cpl 1 0"),
    ("artistic-1", "artistic", "artistic licen[cs]e (?:version )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic licen[cs]e (?:version )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic licen[cs]e", "artistic"),
    ("bsl-1", "boost", "boost software licen[cs]e", "bsl 1 0"),
    ("busl-1.1", "business", "business source licen[cs]e", "busl 1 1"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", "libpng licen[cs]e", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[cs]e)?", "wtfpl"),
    ("python-2", "python", "python(?: software foundation)? licen[cs]e", "python 2 0"),
    ("php-3", "php", "php licen[cs]e", "php 3 0[1]?"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[cs]e", "ofl 1 1"),
    ("odbl", "database", "open database licen[cs]e", "odbl 1 0"),
    ("afl-3", "academic", "academic free licen[cs]e", "afl 3 0"),
    ("osl-3", "open", "open software licen[cs]e", "osl 3 0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)?(?: open source)? licen[cs]e", "ncsa"),
    ("sspl-1", "server", "server side public licen[cs]e", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic licen[cs]e", "elastic 2 0"),
    ("upl-1", "universal", "universal permissive licen[cs]e", "upl 1 0"),
    ("blueoak-1", "oak", "blue oak model licen[cs]e", "blueoak 1 0 0"),
    ("mulan-psl-2", "mulan", "mulan (?:psl|permissive software licen[cs]e)", "mulanpsl 2 0"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc", "cc by(?: [1234] [0-9])?", "cc by [1234] [0-9]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234] [0-9])?", "cc by sa [1234] [0-9]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [0-9])?", "cc by nd [1234] [0-9]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234] [0-9])?", "cc by nc [1234] [0-9]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [0-9])?", "cc by nc sa [1234] [0-9]"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [0-9])?", "cc by nc nd [1234] [0-9]"),
)

# Creative Commons by their long names.
CREATIVE_COMMONS = (
    ("cc-by", "attribution"), ("cc-by-sa", "attribution share ?alike"), ("cc-by-nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc", "attribution non ?commercial"), ("cc-by-nc-sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("cc0-1", "(?:cc0|zero)"),
)

# Sentences of license texts and of plain notices.
SIGNATURES = (
    Rule("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    Rule("mit", "substantial", "shall be included in all copies or substantial portions of the software", 0.9),
    Rule("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    Rule("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 0.9),
    Rule("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 0.9),
    Rule("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", 0.9),
    Rule("apache-2", "apache", "www apache org licenses license 2 0", 0.95, True),
    Rule("apache-2", "compliance", "you may not use this file except in compliance with the license", 0.8, True),
    Rule("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.95, True),
    Rule("gpl", "gnu", "you should have received a copy of the gnu general public license", 0.9, True),
    Rule("gpl", "gpl", "gpl(?: licensed)?", 0.6),
    Rule("lgpl", "lgpl", "lgpl(?: licensed)?", 0.6),
    Rule("agpl", "agpl", "agpl(?: licensed)?", 0.6),
    Rule("mpl-2", "mozilla", "mozilla org mpl 2 0", 0.95),
    Rule("bsl-1", "boost", "www boost org license 1 0 txt", 0.95, True),
    Rule("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 0.95),
    Rule("zlib", "altered", "altered source versions must be plainly marked as such", 0.9),
    Rule("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.9),
    Rule("public-domain", "domain", "(?:is|are) in the public domain", 0.8),
    Rule("proprietary", "rights", "all rights reserved", 0.6),
    Rule("proprietary", "confidential", "proprietary and confidential", 0.8),
    Rule("no-derivatives", "reproduced", "no part of this (?:publication|work|document) may be reproduced", 0.8),
    Rule("mit", "deal", "to deal in the software without restriction including without limitation the rights to use", 0.9),
    Rule("x11", "consortium", "the name of the x consortium shall not be used in advertising", 0.9),
    Rule("isc", "fee", "for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.8),
    Rule("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use", 0.9),
    Rule("bsd", "retain", "redistributions of source code must retain the above copyright notice", 0.85),
    Rule("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice", 0.85),
    Rule("bsd-3-clause", "contributors", "neither the name of the copyright holder nor the names of its contributors", 0.9),
    Rule("bsd-4-clause", "berkeley", "this product includes software developed by the university of california berkeley and its contributors", 0.95),
    Rule("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 0.95, True),
    Rule("apache-1", "includes", "this product includes software developed by the apache (?:software foundation|group)", 0.85),
    Rule("apache-2", "writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.85, True),
    Rule("apache-2", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.95, True),
    Rule("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.7, True),
    Rule("gpl-2", "prominent", "you must cause the modified files to carry prominent notices stating that you changed the files", 0.85),
    Rule("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 0.95, True),
    Rule("gpl-3", "convey", "you may convey verbatim copies of the program s source code as you receive it", 0.85),
    Rule("lgpl", "lesser", "(?:you can redistribute it and or modify it under the terms|you should have received a copy) of the gnu lesser general public license", 0.95, True),
    Rule("lgpl-2", "library", "(?:you can redistribute it and or modify it under the terms|you should have received a copy) of the gnu library general public license", 0.95, True),
    Rule("lgpl-2.1", "designated", "the lesser general public license applies to some specially designated software packages typically libraries", 0.95, True),
    Rule("lgpl-2.1", "reverse", "permit modification of the work for the customer s own use and reverse engineering for debugging such modifications", 0.85),
    Rule("lgpl-3", "supplemented", "version 3 of the gnu general public license supplemented by the additional permissions listed below", 0.95, True),
    Rule("agpl", "affero", "(?:you can redistribute it and or modify it under the terms|you should have received a copy) of the gnu affero general public license", 0.95, True),
    Rule("agpl-3", "copyleft", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 0.95, True),
    Rule("agpl-3", "interacting", "must prominently offer all users interacting with it remotely through a computer network", 0.95),
    Rule("gfdl", "documentation", "copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95, True),
    Rule("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 0.9),
    Rule("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]", 0.95, True),
    Rule("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.95, True),
    Rule("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.9),
    Rule("mpl-2", "secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 0.95, True),
    Rule("epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion )?1 0", 0.95, True),
    Rule("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v |v|version )?2 0", 0.95, True),
    Rule("epl-1", "eclipse", "www eclipse org legal epl v10(?: html)?", 0.9),
    Rule("epl-2", "eclipse", "www eclipse org legal epl (?:2 0|v20)(?: html)?", 0.9),
    Rule("eupl", "eupl", "licensed under the eupl(?: version)?(?: 1 [12])?", 0.95, True),
    Rule("cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license", 0.95, True),
    Rule("cddl", "opensolaris", "you can obtain a copy of the license at usr src opensolaris license", 0.95, True),
    Rule("cddl", "cddl", "when distributing covered code include this cddl header in each file", 0.95),
    Rule("artistic-1", "semblance", "such that the copyright holder maintains some semblance of artistic control over the development of the package", 0.95),
    Rule("artistic-2", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 0.95, True),
    Rule("perl", "perl", "under the same terms as perl itself", 0.9),
    Rule("ofl-1.1", "font", "this font software is licensed under the sil open font license", 0.95, True),
    Rule("ofl-1.1", "sold", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 0.95),
    Rule("ofl-1.1", "fonts", "the fonts and derivatives however cannot be released under any other type of license", 0.95, True),
    Rule("bsl-1", "organization", "granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.95, True),
    Rule("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0.95, True),
    Rule("busl-1.1", "anniversary", "effective on the change date or the fourth anniversary of the first publicly available distribution", 0.95),
    Rule("sspl-1", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service", 0.95),
    Rule("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service", 0.95),
    Rule("elastic-2", "circumvent", "you may not move change disable or circumvent the license key functionality in the software", 0.95, True),
    Rule("commons-clause", "sell", "the license does not grant to you the right to sell the software", 0.95, True),
    Rule("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    Rule("unlicense", "unlicense", "please refer to http(?:s)? unlicense org", 0.9),
    Rule("wtfpl", "fuck", "you just do what the fuck you want to", 0.9),
    Rule("zlib", "held", "in no event will the authors be held liable for any damages arising from the use of this software", 0.85),
    Rule("zlib", "altered", "this notice may not be removed or altered from any source distribution", 0.9),
    Rule("python-2", "psf", "the python software foundation psf and the individual or organization licensee", 0.95, True),
    Rule("php-3", "php", "this product includes php software freely available from", 0.95),
    Rule("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    Rule("ssleay", "cryptographic", "this product includes cryptographic software written by eric young", 0.95),
    Rule("postgresql", "california", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 0.85),
    Rule("odbl", "contents", "any rights in individual contents of the database are licensed under the database contents license", 0.95, True),
    Rule("ms-pl", "portion", "if you distribute any portion of the software in source code form you may do so only under this license", 0.8, True),
    Rule("ms-rl", "reciprocal", "reciprocal grants for any file you distribute that contains code from the software", 0.95),
    Rule("upl-1", "collectively", "obtaining a copy of this software associated documentation and or data collectively the software", 0.95),
    Rule("blueoak-1", "liability", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", 0.95, True),
    Rule("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0.95),
    Rule("json", "evil", "the software shall be used for good not evil", 0.95),
    Rule("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 0.9),
    Rule("ftl", "freetype", "the freetype project licen[cs]e", 0.85, True),
    Rule("cecill", "cecill", "cecill(?: [bc])?(?: free software)? licen[cs]e(?: agreement)?", 0.85, True),
    Rule("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", 0.8),
    Rule("llama", "llama", "llama [234](?: [0-9])? community licen[cs]e(?: agreement)?", 0.9, True),
    Rule("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.8, True),
    Rule("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.85, True),
    Rule("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material", 0.85),
    Rule("cc-by-nc", "commercial", "you may not use the material for commercial purposes", 0.8),
    Rule("cc0-1", "waived", "waived all copyright and related or neighboring rights", 0.9),
    Rule("cc0-1", "deed", "the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    Rule("cc0-1", "creativecommons", "creativecommons org publicdomain zero 1 0", 0.95),
    Rule("cc-by", "creativecommons", "creativecommons org licenses by [1234] [0-9]", 0.95, True),
    Rule("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [0-9]", 0.95, True),
    Rule("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [0-9]", 0.95, True),
    Rule("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [0-9]", 0.95, True),
    Rule("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [0-9]", 0.95, True),
    Rule("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [0-9]", 0.95, True),
    Rule("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 0.9),
    Rule("proprietary", "confidential", "this software is the confidential and proprietary information of", 0.95),
    Rule("proprietary", "internal", "for internal use only", 0.6),
    Rule("", "mit", "not (?:licensed )?under the mit licen[cs]e", 0.0, True),
    Rule("", "general", "not (?:licensed |released |distributed )?under the (?:gnu )?(?:lesser |affero )?general public licen[cs]e", 0.0, True),
    Rule("", "apache", "not (?:licensed |released |distributed )?under the apache licen[cs]e", 0.0, True),
    Rule("", "bsd", "not (?:licensed |released |distributed )?under the bsd licen[cs]e", 0.0, True),
    Rule("", "gpl", "(?:not|formerly|previously|no longer) (?:licensed |released |distributed )?under the (?:gnu )?gpl", 0.0),
    Rule("", "incompatible", "incompatible with (?:the )?(?:gnu )?(?:gpl|general public licen[cs]e|mit licen[cs]e|apache licen[cs]e)", 0.0),
    Rule("", "compatible", "compatible with (?:the )?(?:gnu )?(?:gpl|general public licen[cs]e|mit licen[cs]e)", 0.0),
    Rule("", "unlike", "unlike (?:the )?(?:gnu )?(?:gpl|general public licen[cs]e|mit licen[cs]e|apache licen[cs]e)", 0.0),
)

#: How the words license and licence begin.
LICENSE = "licen"

GRANT = "(?:licensed|released|distributed|available|published|provided|covered|offered)"


def rules() -> list[Rule]:
    """All rules, the highest priority first: SPDX tags, grants, signature sentences, versions named in passing."""
    tags = [Rule(label, "spdx", f"spdx licen[cs]e identifier {spdx}", 1.0, True) for label, _, _, spdx in LICENSES]
    named = [(label, word, f"(?:{name})", always_says_license(name)) for label, word, name, _ in LICENSES]
    named += [(label, "creative", f"creative commons {name}(?: (?:[1234] [0-9] )?(?:international|unported|generic))?(?: licen[cs]e)?", False) for label, name in CREATIVE_COMMONS]
    grants = [Rule(label, word, f"{GRANT} under (?:the )?(?:terms of (?:the )?)?{name}", 0.95, says) for label, word, name, says in named]
    terms = [Rule(label, word, f"(?:subject to|governed by|see|under) (?:the )?(?:terms of (?:the )?)?{name}", 0.85, says) for label, word, name, says in named]
    mentions = [Rule(label, word, name, 0.7, says) for label, word, name, says in named]
    return tags + grants + list(SIGNATURES) + terms + mentions


def always_says_license(name: str) -> bool:
    """Whether each alternative of a license's name holds the word license or licence outside its optional parts."""
    return all("licen[cs]e" in x for x in re.sub(r"\(\?:[^()]*\)\?", "", name).split("|"))


def spaced(regex: str) -> str:
    """A regex over words that stand each between two blanks of its own."""
    return " " + regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_in(text: Column) -> Column:
    """Number of words of a text whose words stand between two blanks of their own."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Words count from 0.  ``n_base`` counts the places of the base phrases,
    ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any).  ``labels`` holds the base labels and those of the
    rules' detections that are not suppressed; without any it is empty.
    ``score`` is the largest of the detections' scores, 0 without any.  A
    null or empty text has no words; a null id stays null; repeated rows are
    each scanned.  An empty table gives no rows.  Other columns are not read.
    """
    all_rules = rules()
    # lower() also lowers letters beyond ASCII, which no rule holds.  Two of them would turn into ASCII letters.
    low = F.coalesce(F.col(text_col), F.lit(""))
    for letter in ("\u212a", "\u0130"):
        low = F.replace(low, F.lit(letter), F.lit("\u00ff"))
    low = F.lower(low)
    plain = F.trim(F.regexp_replace(low, SEPARATORS, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("plain"))
    text = F.when(F.col("plain") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace("plain", F.lit(" "), F.lit("  ")), F.lit(" ")))
    rows = rows.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", "t", words_in(F.col("t")).alias("n_words"))

    places, firsts, lasts, found = [], [], [], []
    for phrase, label in BASE:
        p, n = spaced(phrase), phrase.count(" ") + 1
        there = F.contains(F.col("t"), F.lit(p))
        size = (F.length("t") - F.length(F.replace("t", F.lit(p), F.lit("")))) / F.lit(len(p))
        places.append(F.when(there, size.cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, words_in(F.substring_index("t", p, 1))))
        lasts.append(F.when(there, F.col("n_words") - words_in(F.substring_index("t", p, -1)) - n))
        found.append(F.when(there, F.lit(label)))

    table = F.array(*[
        F.struct(F.lit(i).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.says_license).alias("says_license"),
                 F.lit(spaced(r.regex)).alias("regex"), F.lit(float(r.score)).alias("score"))
        for i, r in enumerate(all_rules)
    ])
    says_license = F.contains("t", F.lit(f" {LICENSE}"))
    alone = sorted({r.keyword for r in all_rules if not r.says_license})
    gate = says_license | F.col("t").rlike(f" (?:{'|'.join(alone)}) ")
    words = F.array(*[F.lit(k) for k in sorted({r.keyword for r in all_rules})])
    there = F.filter(words, lambda w: F.contains(F.col("t"), F.concat(F.lit(" "), w, F.lit(" "))))
    gated = F.filter(table, lambda r: F.array_contains(F.col("gates.words"), r["keyword"]) & (F.col("gates.license") | ~r["says_license"]))

    def detections(rule: Column) -> Column:
        """(start, -end, priority, label, score) of a rule's matches."""
        hits = F.regexp_extract_all("t", rule["regex"], F.lit(0))
        gaps = F.split("t", rule["regex"], -1)
        steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(words_in(g).alias("gap"), (words_in(g) + words_in(h)).alias("step")))

        def words_of(some: Column) -> Column:
            return F.aggregate(some, F.lit(0).cast("long"), lambda n, x: n + x["step"])

        # Words before each block of matches, then those before a match within its block: a fold over all matches would copy its list at each.
        def blocks(of: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(of) - 1) / BLOCK_MATCHES), F.lit(0)).cast("int"))
            nothing = F.array(F.lit(0).cast("long"))
            return F.aggregate(numbers, nothing, lambda ahead, b: F.array_append(
                ahead, F.element_at(ahead, -1) + words_of(F.slice(of, b * BLOCK_MATCHES + 1, F.lit(BLOCK_MATCHES)))))

        def place(of: Column, ahead: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK_MATCHES).cast("int")
                before = F.element_at(ahead, block + 1) + words_of(F.slice(of, block * BLOCK_MATCHES + 1, i % BLOCK_MATCHES))
                return F.struct((before + x["gap"]).alias("start"), (-(before + x["step"])).alias("minus_end"), rule["priority"].alias("priority"),
                                rule["label"].alias("label"), rule["score"].alias("score"))
            return F.transform(of, one)

        return bound(steps, lambda of: bound(blocks(of), lambda ahead: place(of, ahead)))

    hits = F.when(F.col("gates").isNotNull(), F.array_sort(F.flatten(F.transform(gated, detections))))
    none = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def keep(state: Column, d: Column) -> Column:
        """Sorted by start, the longer first: a detection lies inside an earlier one if it ends no later than one of them."""
        inside = -d["minus_end"] <= state["reach"]
        return F.struct(
            F.greatest(state["reach"], -d["minus_end"]).alias("reach"),
            F.when(inside | (d["label"] == ""), state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["score"])).alias("score"),
        )

    base = F.array_compact(F.array(*found))
    rows = rows.withColumn("gates", F.when(gate, F.struct(there.alias("words"), says_license.alias("license"))))
    rows = rows.select(
        "doc_id", "n_words", sum(places[1:], places[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.sort_array(F.array_distinct(base)).alias("base"), hits.alias("hits"),
    )
    rows = rows.withColumn("kept", F.coalesce(F.aggregate("hits", none, keep), none))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.col("kept.labels"))), ",").alias("labels"),
        F.greatest(F.col("kept.score"), F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``scan``."""
    words = "(length({0}) - length(replace({0}, ' ', '')))::BIGINT // 2"
    base = []
    for phrase, label in BASE:
        p = spaced(phrase)
        base.append(f"""SELECT rid, '{label}' AS label, len(string_split(t, '{p}')) - 1 AS n, {words.format(f"string_split(t, '{p}')[1]")} AS first_word,
  n_words - {words.format(f"string_split(t, '{p}')[-1]")} - {phrase.count(' ') + 1} AS last_word FROM texts WHERE contains(t, '{p}')""")
    values = ",\n".join(f"({i}, '{r.label}', ' {r.keyword} ', '{spaced(r.regex)}', {float(r.score)}::DOUBLE)" for i, r in enumerate(rules()))
    return f"""
WITH plain AS (SELECT row_number() OVER () AS rid, doc_id,
  trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', ' ', 'g'), ' ') AS p FROM {table}),
spread AS (SELECT rid, doc_id, CASE WHEN p = '' THEN '' ELSE ' ' || replace(p, ' ', '  ') || ' ' END AS t FROM plain),
texts AS (SELECT *, {words.format('t')} AS n_words FROM spread),
base AS ({" UNION ALL ".join(base)}),
base_of AS (SELECT rid, sum(n)::BIGINT AS n_base, min(first_word) AS first_word, max(last_word) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY rid),
rules(priority, label, keyword, regex, score) AS (VALUES {values}),
hits AS (SELECT rid, priority, label, score, regexp_extract_all(t, regex) AS h, regexp_split_to_array(t, regex) AS g
  FROM texts JOIN rules ON contains(t, keyword)),
each AS (SELECT rid, priority, label, score, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM hits WHERE len(h) > 0),
counted AS (SELECT *, {words.format('hit')} AS hit_words, {words.format('gap')} AS gap_words FROM each),
spans AS (SELECT rid, priority, label, score, hit_words,
  sum(gap_words + hit_words) OVER (PARTITION BY rid, priority ORDER BY i) AS stop FROM counted),
judged AS (SELECT rid, label, score, stop, max(stop) OVER (PARTITION BY rid ORDER BY stop - hit_words, stop DESC, priority
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
kept AS (SELECT rid, list(DISTINCT label) FILTER (label <> '') AS labels, max(score) AS score FROM judged WHERE reach IS NULL OR stop > reach GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, b.first_word, b.last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ','), '') AS labels,
  greatest(coalesce(k.score, 0), CASE WHEN b.rid IS NULL THEN 0 ELSE {BASE_SCORE} END)::DOUBLE AS score
FROM texts LEFT JOIN base_of b USING (rid) LEFT JOIN kept k USING (rid)"""

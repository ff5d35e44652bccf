"""License rules: base places by brute force, suppression, whole rows by SQL (test_queries)."""

import re

from loanlag.llm import license_rules
from tests.llm.helpers import EDGE, docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


CASES = [
    (100, "Released under the MIT License. under the mit license under THE mit license!"), (101, "APACHE license, Version 2.0; cc-by-nc"),
    (102, "undert he mit license under the mitt license"), (103, "cc by nc by nc cc by nc sa"), (104, "underKthe mit license under the mİt license"),
    (105, "éunder the mit license"), (106, "SPDX-License-Identifier: GPL-3.0-or-later"), (107, "not under the MIT license"),
    (108, "under the terms of the GNU General Public License version 2 or later"), (109, "x " * 30000 + "under the mit license"),
    (110, "under the mit license " * 700), (111, "This is distributed under the BSD 3-Clause License and the Artistic License 2.0"),
]


def test_base_places(spark):
    rows = [*EDGE, *CASES]
    got = license_rules.scan(docs_of(spark, rows)).collect()
    key = lambda x: str(x)
    want = sorted(((d, *base(t)) for d, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_rules_and_suppression(spark):
    got = {r.doc_id: (r.labels, r.score) for r in license_rules.scan(docs_of(spark, CASES)).collect()}
    assert got[106] == ("gpl-3-or-later", 1.0)
    assert got[107][0] == "mit"  # the base label stays, though the rule for what is not granted holds the place
    assert got[108] == ("gpl-2-or-later", 0.85)
    assert got[111][0] == "artistic-2,bsd-3-clause"
    assert got[102] == ("mit", 0.7)  # no base phrase, but a license that is named
    assert got[104] == ("mit", 0.7) and got[105] == ("mit", 0.7)


#: Sentences as license texts and notices print them, and their labels.
SENTENCES = [
    ("it under the terms of the GNU Lesser General Public License: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "lgpl"),
    ("You should have received a copy of the GNU Library General Public License along", "lgpl-2"),
    ("the Lesser General Public License, applies to some specially designated software packages--typically libraries", "lgpl,lgpl-2.1"),
    ("permit modification of the work for the customer's own use and reverse engineering for debugging such modifications.", "lgpl-2.1"),
    ("You should have received a copy of the GNU Affero General Public License", "agpl"),
    ("your modified version must prominently offer all users interacting with it remotely through a computer network", "agpl-3"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "gpl-3"),
    ("You may convey verbatim copies of the Program's source code as you receive it", "gpl-3"),
    ("with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", "gfdl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2"),
    ("are made available under the terms of the Eclipse Public License v1.0", "epl-1"),
    ("made available under the terms of the Eclipse Public License 2.0 which", "epl-2"),
    ("see http://www.eclipse.org/legal/epl-v10.html", "epl-1"),
    ("Licensed under the EUPL, Version 1.2 or", "eupl"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License", "cddl"),
    ("When distributing Covered Code, include this CDDL HEADER in each file", "cddl"),
    ("such that the Copyright Holder maintains some semblance of artistic control over the development of the package", "artistic-1"),
    ("may be distributed under the same terms as Perl itself.", "perl"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.", "ofl-1.1"),
    ("The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.", "busl-1.1"),
    ("Effective on the Change Date, or the fourth anniversary of the first publicly available distribution", "busl-1.1"),
    ("If you make the functionality of the Program or a modified version available to third parties as a service, you must", "sspl-1"),
    ("You may not provide the software to third parties as a hosted or managed service", "elastic-2"),
    ("You may not move, change, disable, or circumvent the license key functionality in the software", "elastic-2"),
    ("and the License does not grant to you, the right to Sell the Software.", "commons-clause"),
    ("You must give appropriate credit, provide a link to the license, and indicate if changes were made.", "cc-by"),
    ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.", "cc-by-sa"),
    ("If you remix, transform, or build upon the material, you may not distribute the modified material.", "cc-by-nd"),
    ("You may not use the material for commercial purposes.", "cc-by-nc"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("Redistributions of source code must retain the above copyright notice, this list", "bsd"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.", "apache-2"),
    ("to deal in the Software without restriction, including without limitation the rights to use", "mit"),
    ("to deal with the Software without restriction, including without limitation the rights to use", "ncsa"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
]
#: Near them, without any license.
HARMLESS = [
    "The library lends books to the lesser known general public", "The font software was sold by itself", "He gave credit to the license plate", "A service for third parties is hosted",
    "We remix and transform the material", "Berkeley has a university, California too", "the anniversary of the first distribution", "an MPL file was distributed", "not released under the GPL",
    "a library that is incompatible with the GPL", "not distributed under the Apache License", "it was previously released under the GNU GPL", "the eclipse of 2.0 public interest", "perl itself and its terms",
]


def test_sentences_of_licenses(spark):
    rows = [(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(1000 + i, t) for i, t in enumerate(HARMLESS)]
    got = {r.doc_id: (r.labels, r.score) for r in license_rules.scan(docs_of(spark, rows)).collect()}
    for i, (text, labels) in enumerate(SENTENCES):
        assert set(got[i][0].split(",")) & set(labels.split(",")), (text, got[i])
        assert got[i][1] >= 0.7
    assert {t: got[1000 + i] for i, t in enumerate(HARMLESS) if got[1000 + i][0]} == {}


def test_every_sentence_is_found_by_its_rule(spark):
    def plainest(regex):
        while "(?:" in regex:
            regex = re.sub(r"\(\?:([^()|]*)[^()]*\)(\??)", lambda m: "" if m.group(2) else m.group(1), regex, count=1)
        return re.sub(r"\[(.)[^\]]*\]", r"\1", regex)

    kept = [r for r in license_rules.SIGNATURES if r.label]
    got = {r.doc_id: r.labels for r in license_rules.scan(docs_of(spark, [(i, plainest(r.regex)) for i, r in enumerate(kept)])).collect()}
    assert [(r.label, got[i]) for i, r in enumerate(kept) if r.label not in got[i].split(",")] == []


def test_many_matches_of_one_rule(spark):
    """More than a block of matches: each place is counted from the text's beginning."""
    text = "x " + "gpl licensed y mit license " * 500
    got = license_rules.scan(docs_of(spark, [(1, text), (2, "z " + "under the mit license " * 129)])).collect()
    rows = {r.doc_id: r for r in got}
    assert rows[1].labels == "gpl,mit" and rows[1].n_words == 1 + 500 * 5
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].score) == (129, 1, 1 + 128 * 4, 0.85)


def test_empty(spark):
    assert license_rules.scan(docs_of(spark, [])).count() == 0


def test_every_match_holds_its_gate():
    assert len(license_rules.rules()) >= 300
    for r in license_rules.rules():
        sure = r.regex
        while (less := re.sub(r"\(\?:[^()]*\)\?", "", sure)) != sure:
            sure = less
        assert r.keyword in re.findall("[a-z0-9]+", sure), r
        re.compile(license_rules.spaced(r.regex))

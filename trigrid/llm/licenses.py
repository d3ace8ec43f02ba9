"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased (A-Z only) and set apart by single spaces; every rule is a regular
expression over that. Rules run only on texts with one of their keywords: whole words, one of which every match
contains, read off the phrases a pattern stands for (:func:`keywords`). A text meets the keywords of all rules
by one hashed intersection of its words. Each match is a detection with an interval and the rule's priority; a detection inside
the interval of another of the same or a higher priority is suppressed, so that "licensed under the
Apache License, Version 2.0" is one detection and not also one of the bare name. Three base phrases are
always reported.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a null or empty text has none, no labels and
score 0; texts of any length are scanned whole; of detections with the same interval and priority the one whose label
comes first stays; what is denied ("not licensed under ...", with the six words after it) gives no label; repeated rows give repeated results; an empty table gives an empty
result; columns besides id and text are ignored. ``score`` is the highest weight of the detections left.
"""

from __future__ import annotations

import json
import re._constants as op
import re._parser as parser
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts

#: Fixed phrases and labels of the base result.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
DELIMITERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


#: Stands in a phrase for a part of a pattern that is left open.
OPEN = "\x00"


def phrases(nodes: Iterable) -> list[str]:
    """What a parsed pattern stands for: every choice written out, open parts as ``OPEN``."""
    out = [""]
    for kind, arg in nodes:
        if kind is op.LITERAL:
            more = [chr(arg)]
        elif kind is op.SUBPATTERN:
            more = phrases(arg[-1])
        elif kind is op.BRANCH:
            more = [p for branch in arg[1] for p in phrases(branch)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = [chr(one) for _, one in arg]
        elif kind is op.MAX_REPEAT and arg[:2] == (0, 1):
            more = ["", *phrases(arg[2])]
        else:
            more = [OPEN]
        out = [a + b for a in out for b in more]
    return out


def keywords(pattern: str) -> tuple[str, ...]:
    """Whole words, one of which is in every text that holds one of the pattern's phrases between spaces: of
    each phrase its longest word, if possible one that is not a number."""
    chosen = set()
    for phrase in phrases(parser.parse(pattern)):
        whole = [w for w in phrase.split() if OPEN not in w]
        if not whole:
            raise ValueError(f"no word is certain in {pattern!r}")
        chosen.add(max(whole, key=lambda w: (not w.isdigit(), len(w), w)))
    return tuple(sorted(chosen))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    weight: float
    #: One of these words is in every match.
    keywords: tuple[str, ...]


#: Short names that stand for a license without its version: label, pattern.
GENERIC = (
    ("apache", "apache licen[cs]e"),
    ("bsd", "bsd licen[cs]e"),
    ("gpl", "gnu (?:gpl|general public licen[cs]e)"),
    ("lgpl", "gnu (?:lgpl|lesser general public licen[cs]e)"),
    ("agpl", "gnu (?:agpl|affero general public licen[cs]e)"),
    ("mpl", "mozilla public licen[cs]e"),
    ("epl", "eclipse public licen[cs]e"),
)

#: Addresses of license texts, as words: label, pattern.
ADDRESSES = (
    ("cc-by", "creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc0-1", "creativecommons org publicdomain zero 1 0"),
    ("apache-2", "apache org licenses license 2 0"),
    ("mit", "opensource org licenses? mit"),
    ("bsd-2", "opensource org licenses? bsd 2 clause"),
    ("bsd-3", "opensource org licenses? bsd 3 clause"),
    ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "gnu org licenses agpl 3 0"),
    ("mpl-2", "mozilla org mpl 2 0"),
    ("epl-2", "eclipse org legal epl 2 0"),
)

VERBS = "licensed|released|distributed|available|published|provided|offered|dual licensed".split("|")
GRANT = f"(?:{'|'.join(f'{v} {to}under ' for v in VERBS for to in ('', 'to you '))})(?:the )?(?:terms of )?(?:the )?"
VERSION = "(?:license )?(?:version |v )?"

#: label, names as they read in running text, SPDX identifiers as words.
FAMILIES = (
    ("mit", "mit|expat", "mit"),
    ("mit-0", "mit no attribution|mit 0", "mit 0"),
    ("apache-1.1", "apache (?:software )?" + VERSION + "1 1", "apache 1 1"),
    ("apache-2", "apache (?:software )?" + VERSION + "2(?: 0)?", "apache 2 0"),
    ("gpl-1", "(?:gnu )?(?:general public|gpl) " + VERSION + "1(?: 0)?|gplv1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "(?:gnu )?(?:general public|gpl) " + VERSION + "2(?: 0)?|gplv2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?(?:general public|gpl) " + VERSION + "3(?: 0)?|gplv3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "(?:gnu )?(?:library general public|lgpl) " + VERSION + "2(?: 0)?|lgplv2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public|lgpl) " + VERSION + "2 1|lgplv2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public|lgpl) " + VERSION + "3(?: 0)?|lgplv3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu )?(?:affero general public|agpl) " + VERSION + "3(?: 0)?|agplv3", "agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", "(?:gnu )?free documentation " + VERSION + "1 3", "gfdl 1 3(?: only| or later)?"),
    ("bsd-2", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause"),
    ("bsd-3", "(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause"),
    ("bsd-4", "(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause"),
    ("0bsd", "zero clause bsd|bsd zero clause|free public 1 0 0", "0bsd"),
    ("isc", "isc|internet systems consortium", "isc"),
    ("mpl-1.1", "(?:mozilla public|mpl) " + VERSION + "1 1", "mpl 1 1"),
    ("mpl-2", "(?:mozilla public|mpl) " + VERSION + "2(?: 0)?|mplv2(?: 0)?", "mpl 2 0"),
    ("epl-1", "(?:eclipse public|epl) " + VERSION + "1(?: 0)?", "epl 1 0"),
    ("epl-2", "(?:eclipse public|epl) " + VERSION + "2(?: 0)?", "epl 2 0"),
    ("cddl-1", "(?:common development and distribution|cddl) " + VERSION + "1(?: 0)?", "cddl 1 0"),
    ("cpl-1", "common public " + VERSION + "1(?: 0)?", "cpl 1 0"),
    ("artistic-2", "artistic " + VERSION + "2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost-1", "boost (?:software )?" + VERSION + "1(?: 0)?", "bsl 1 0"),
    ("busl-1.1", "business source " + VERSION + "1 1", "busl 1 1"),
    ("sspl-1", "server side public " + VERSION + "1(?: 0)?", "sspl 1 0"),
    ("elastic-2", "elastic " + VERSION + "2(?: 0)?", "elastic 2 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public|wtfpl", "wtfpl"),
    ("cc0-1", "(?:creative commons )?(?:cc0|cc zero|zero)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international| unported| generic)?", "cc by [1-4] [05]"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv[a-z]*|cc by nd)(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv[a-z]*|cc by nc nd)(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("odbl-1", "open (?:data commons open )?database(?: odbl)? " + VERSION + "1(?: 0)?|odbl", "odbl 1 0"),
    ("ofl-1.1", "(?:sil )?open font " + VERSION + "1 1", "ofl 1 1"),
    ("eupl-1.2", "(?:european union public|eupl) " + VERSION + "1 2", "eupl 1 2"),
    ("python-2", "python software foundation(?: " + VERSION + "2)?|psf", "python 2 0|psf 2 0"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("upl-1", "universal permissive " + VERSION + "1(?: 0)?", "upl 1 0"),
    ("ncsa", "university of illinois ncsa(?: open source)?", "ncsa"),
    ("afl-3", "academic free " + VERSION + "3(?: 0)?", "afl 3 0"),
    ("osl-3", "open software " + VERSION + "3(?: 0)?", "osl 3 0"),
)

#: Names that stand alone, where that is less than the names beside the word license: "zero" by itself is a number.
BARE = {"cc0-1": "(?:(?:creative commons )?(?:cc0|cc zero)|creative commons zero)(?: 1 0)?(?: universal)?|zero 1 0 universal"}

#: Sentences that give a license away: label, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("gpl-2-or-later", "either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("public-domain", "(?:is|are|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "no copyright is claimed and this work is in the public domain"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("bsd", "this software is provided by (?:the )?(?:[^ ]+ ){1,8}as is and any express or implied warranties"),
    ("bsd", "in no event shall (?:the )?(?:[^ ]+ ){1,8}be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-4", "this product includes software developed by"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "(?:program|software) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2", "either version 2 of the license only"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-3-or-later", "lesser general public license as published by the free software foundation either version 3 of the license or"),
    ("agpl", "the gnu affero general public license is a free copyleft license"),
    ("agpl-3", "remote network interaction use with the gnu general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1", "the accompanying program is provided under the terms of this common public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost-1", "must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("ofl", "the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl", "reserved font name"),
    ("odbl", "you are free to share create and adapt as long as you attribute keep open"),
    ("cc0-1", "has dedicated the work to the public domain by waiving all of his or her rights to the work"),
    ("cc0-1", "to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("cc-by", "you are free to share and adapt for any purpose even commercially under the following terms attribution"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by", "this work is licensed under a creative commons attribution(?: [1-4] 0)?(?: international| unported)? license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)? license"),
    ("python-2", "psf is making python available to licensee on an as is basis"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("openssl", "this product includes cryptographic software written by"),
    ("curl", "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("ncsa", "neither the names of (?:[^ ]+ ){1,20}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("json", "the software shall be used for good not evil"),
    ("vim", "vim is charityware"),
    ("php", "this product includes php software freely available from"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the license does not grant to you the right to sell the software"),
    ("eupl", "licensed under the eupl"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("public-domain", "(?:the )?authors? disclaims? copyright to this source code"),
    ("public-domain", "this (?:file|code|work|software|data) is public domain"),
    ("public-domain", "work of the (?:united states|u s|us) government"),
    ("proprietary", "confidential and proprietary"),
    ("proprietary", "may not be (?:reproduced|copied|distributed|disclosed) (?:[^ ]+ ){0,6}without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)"),
    ("proprietary", "for internal use only"),
    ("proprietary", "this software contains trade secrets"),
    ("proprietary", "by installing or using (?:the|this) software you agree to be bound by"),
    ("non-commercial", "for (?:personal|academic|research|educational)(?: and)?(?: personal| academic| research| educational)? use only"),
    ("non-commercial", "(?:not|never) (?:be )?(?:used|sold) for commercial purposes"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "no part of this (?:work|publication|document) may be reproduced"),
    ("proprietary", "unauthorized (?:copying|use|distribution) (?:of this file )?is strictly prohibited"),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: identifier tags, grants and sentences, full names, bare names."""
    out = []
    for label, names, ids in FAMILIES:
        named, words = f"(?:{names})", keywords(names)
        out.append(Rule(label, f" spdx licen[cs]e identifier (?:{ids})(?= )", 4, 1.0, ("spdx",)))
        out.append(Rule(label, f" {GRANT}{named}(?: licen[cs]e)?(?: version| v)?(?: [1-4](?: [0-9])?)?(?= )", 3, 0.95, words))
        out.append(Rule(label, f" (?:the )?{named} licen[cs]e(?= )", 2, 0.8, words))
        out.append(Rule(label, f" licen[cs]ed? (?:is |as |type |name |text )?{named}(?= )", 2, 0.75, words))
        if " " in names and label != "zlib":
            bare = BARE.get(label, names)
            out.append(Rule(label, f" (?:{bare})(?= )", 1, 0.6, keywords(bare)))
    out += [Rule(label, f" (?:{words})(?= )", 3, 0.9, keywords(words)) for label, words in SENTENCES]
    out += [Rule(label, f" (?:{words})(?= )", 3, 0.9, keywords(words)) for label, words in ADDRESSES]
    out += [Rule(label, f" (?:{words})(?= )", 1, 0.5, keywords(words)) for label, words in GENERIC]
    # What is denied is a detection without a label: it suppresses those inside.
    denied = "(?:not|never) (?:be )?" + GRANT
    out.append(Rule("", f" {denied}[^ ]+(?: [^ ]+){{0,5}}(?= )", 4, 0.0, keywords(denied)))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


GATE = tuple(sorted({k for r in rules() for k in r.keywords}))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A detection.
_FOUND = "array<struct<a:int,b:int,priority:int,weight:double,label:string>>"
#: One rule's detections: pieces between matches and the matches give the intervals. They are gathered in blocks of about the square
#: root of their number, each an array of its own, so that growing arrays are never copied whole.
_BLOCK = "cast(ceil(sqrt(size(m.hits))) AS int)"
_INTERVALS = f"""
  flatten(aggregate(sequence(0, (size(m.hits) - 1) div {_BLOCK}), named_struct('at', 0, 'out', cast(array() as array<{_FOUND}>)),
    (s, j) -> transform(array(aggregate(sequence(cast(j AS int) * {_BLOCK} + 1, least(size(m.hits), (cast(j AS int) + 1) * {_BLOCK})),
        named_struct('at', s.at, 'out', cast(array() as {_FOUND})),
        (t, i) -> named_struct(
          'at', t.at + length(m.gaps[i - 1]) + length(m.hits[i - 1]),
          'out', concat(t.out, array(named_struct('a', t.at + length(m.gaps[i - 1]), 'b', t.at + length(m.gaps[i - 1]) + length(m.hits[i - 1]),
            'priority', m.priority, 'weight', m.weight, 'label', m.label)))))),
      t -> named_struct('at', t.at, 'out', concat(s.out, array(t.out))))[0],
    s -> s.out))"""

#: Sweep in order of start (longer and higher first), with the furthest end seen at each priority: the labels (of which there are few) and
#: the highest weight left. Detections without a label only suppress.
_SWEEP = """
  aggregate(array_sort(found, (x, y) -> CASE WHEN x.a <> y.a THEN x.a - y.a WHEN x.b <> y.b THEN y.b - x.b WHEN x.priority <> y.priority THEN y.priority - x.priority
      WHEN x.label < y.label THEN -1 WHEN x.label > y.label THEN 1 ELSE 0 END),
    named_struct('e1', 0, 'e2', 0, 'e3', 0, 'e4', 0, 'labels', cast(array() as array<string>), 'weight', cast(null as double)),
    (s, d) -> transform(array(d.label <> '' AND d.b > greatest(if(d.priority <= 1, s.e1, 0), if(d.priority <= 2, s.e2, 0), if(d.priority <= 3, s.e3, 0), s.e4)), stays -> named_struct(
      'e1', if(d.priority = 1, greatest(s.e1, d.b), s.e1), 'e2', if(d.priority = 2, greatest(s.e2, d.b), s.e2),
      'e3', if(d.priority = 3, greatest(s.e3, d.b), s.e3), 'e4', if(d.priority = 4, greatest(s.e4, d.b), s.e4),
      'labels', if(stays AND NOT array_contains(s.labels, d.label), concat(s.labels, array(d.label)), s.labels),
      'weight', if(stays, greatest(s.weight, d.weight), s.weight)))[0],
    s -> named_struct('labels', s.labels, 'weight', s.weight))"""


def normalised(text: Column) -> Column:
    """Lower-cased words set apart and framed by single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), DELIMITERS, " ")), F.lit(" "))


def detections(norm: str, present: str) -> Column:
    """What the rules with a keyword among ``present`` match in a normalised text."""
    # One constant, folded when the plan is made: thousands of literals would take the planner a minute.
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in rules()])), "array<struct<label:string,pattern:string,priority:int,weight:double,keywords:array<string>>>")
    text = F.col(norm)
    live = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], F.col(present)) & F.regexp(text, r["pattern"]))
    return F.transform(
        live,
        lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"), F.split(text, r["pattern"], -1).alias("gaps"), F.regexp_extract_all(text, r["pattern"], F.lit(0)).alias("hits")),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrase places, labels, and the score of the best detection."""
    rows = keyed_texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long"))
    present = F.array_intersect(F.split("norm", " "), F.from_json(F.lit(json.dumps(GATE)), "array<string>"))
    rows = rows.withColumn("present", present)
    rows = rows.withColumn("matches", F.when(F.size("present") > 0, detections("norm", "present")))
    rows = rows.withColumn("found", F.expr(f"flatten(transform(matches, m -> {_INTERVALS}))"))
    rows = rows.withColumn("left_over", F.expr(_SWEEP))
    # Base phrases, word by word; only where the phrase stands at all.
    has = [F.contains("norm", F.lit(f" {phrase} ")) for phrase, _ in BASE]
    any_base = has[0] | has[1] | has[2]
    rows = rows.withColumn("words", F.when(any_base, F.split(F.trim("norm"), " ")))
    places = []
    for phrase, _ in BASE:
        parts = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts))
        places.append(f"if(contains(norm, ' {phrase} ') AND size(words) >= {len(parts)}, filter(sequence(0, size(words) - {len(parts)}), i -> {same}), cast(array() as array<int>))")
    rows = rows.withColumn("at", F.when(any_base, F.expr(f"array({', '.join(places)})")))
    flat = F.flatten("at")
    named = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, BASE, strict=True)]))
    none = F.array().cast("array<string>")
    labels = F.array_union(named, F.coalesce(F.col("left_over.labels"), none))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(any_base, F.size(flat)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(named)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("labels"),
        F.coalesce(F.col("left_over.weight"), F.when(any_base, F.lit(0.9)), F.lit(0.0)).alias("score"),
    )

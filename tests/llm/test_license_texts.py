"""Spellings found in the wild, written apart from the rules; texts with very many detections."""

from __future__ import annotations

import time

from trigrid.llm import licenses

#: text, labels that must be there, labels that must not.
CASES = [
    ("Licensed under GPLv2", "gpl-2", "gpl-3"),
    ("This plugin is licensed under the GPLv3+.", "gpl-3", "gpl-2"),
    ("libfoo (LGPLv2.1)", "lgpl-2.1", "gpl-2"),
    ("AGPLv3 server", "agpl-3", "gpl-3"),
    ("covered by the GNU GPL", "gpl", "gpl-3"),
    ("See the Apache License for details", "apache", "apache-2"),
    ("Apache License, Version 2.0", "apache-2", "apache"),
    ("It has a BSD license.", "bsd", "bsd-3"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa", "cc-by"),
    ("<a href='http://creativecommons.org/licenses/by/3.0/'>", "cc-by", "cc-by-sa"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2", "mit"),
    ("https://opensource.org/licenses/MIT", "mit", "bsd"),
    ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3", "lgpl-3"),
    ("this is not licensed under the GPL version 3", None, "gpl-3"),
    ("It may never be distributed under the Mozilla Public License 2.0, ok", None, "mpl-2"),
    ("Not yours. Licensed under the ISC license", "isc", "mit"),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License", "cc-by", "cc-by-nc"),
    ("Everything here is in the public domain: no copyright is claimed and this work is in the public domain", "public-domain", "mit"),
    ("The license of the driver was suspended; her BSD diploma and an apache helicopter", None, "bsd"),
    ("a general public that reads mit interest", None, "gpl"),
]


def test_spellings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, (text, there, absent) in enumerate(CASES):
        labels = got[i].labels.split(",")
        assert there is None or there in labels, (text, labels)
        assert absent not in labels, (text, labels)
        assert (got[i].score > 0) == (got[i].labels != "")


def test_many_detections_in_one_text(spark):
    df = spark.createDataFrame([(1, "mit license foo " * 130_000), (2, "licensed under the gpl version 2 or the apache license " * 3000)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert time.time() - start < 60
    assert got[1].labels == "mit" and got[1].n_words == 390_000
    assert got[2].labels == "apache,gpl-2"

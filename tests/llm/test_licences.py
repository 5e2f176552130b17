"""Licence sentences that the filter, the rules or the sentence table once lost."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.llm import licenses


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    return [rows[i] for i in range(len(texts))]


@pytest.mark.parametrize("name,pattern", licenses.KNOWN)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_each_known_sentence_has_a_hint(name, pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 "))
    assert re.search(licenses.HINTS, text)


def test_sentences_without_the_word_licence(spark):
    got = found(spark, "Released under the BSD 3-Clause.", "Published by simplified BSD", "This work is available under CC BY-SA 4.0.", "Published under CC-BY-SA 4.0.", "Written by BSD users.")
    assert [r.licences for r in got] == ["BSD-3-Clause", "BSD-2-Clause", "CC-BY-SA-4.0", "CC-BY-SA-4.0", ""]
    assert [r.n_hints for r in got] == [1, 1, 1, 1, 0]


GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer. "
ENDORSE = "Neither the name of the owner nor the names of others may be used to endorse or promote products derived from this software. "
DISCLAIMER = "This software is provided by the owner as is and any express or implied warranties are disclaimed. "
LATER = "Either version 3 of the License, or (at your option) any later version. "


def test_licences_between_the_parts_of_a_rule(spark):
    mit, cc = "Released under the MIT License. ", "Licensed under CC BY 4.0. "
    gpl3, gpl2 = "Licensed under the GNU General Public License version 3. ", "Licensed under the GNU General Public License version 2. "
    bsd2, bsd3 = GRANT + SOURCE + BINARY + DISCLAIMER, GRANT + SOURCE + BINARY + ENDORSE + DISCLAIMER
    got = found(spark, bsd2 + mit + bsd3, bsd3 + mit + bsd2, gpl3 + mit + cc + LATER, GRANT + mit + SOURCE + BINARY + cc + ENDORSE + DISCLAIMER, gpl2 + gpl3 + LATER, bsd2 + bsd2, "\n".join([GRANT + SOURCE] * 3000))
    assert [set(r.licences.split(",")) - {""} for r in got] == [
        {"BSD-3-Clause", "BSD-2-Clause", "MIT"}, {"BSD-3-Clause", "BSD-2-Clause", "MIT"}, {"GPL-3.0-or-later", "MIT", "CC-BY-4.0"},
        {"BSD-3-Clause", "MIT", "CC-BY-4.0"}, {"GPL-3.0-or-later", "GPL-2.0"}, {"BSD-2-Clause"}, set(),
    ]


FREE = "This {what} is free software{sep} you can redistribute it and/or modify\nit under the terms of the GNU {name} as published by\nthe Free Software Foundation{rest}"
WARRANTY = "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
LATER_OF = " either version {} of the License, or\n(at your option) any later version."
NOTICES = [
    (FREE.format(what="program", sep=":", name="General Public License", rest="," + LATER_OF.format(3)), "GPL-3.0-or-later"),
    (FREE.format(what="program", sep=";", name="General Public License", rest=";" + LATER_OF.format(2)), "GPL-2.0-or-later"),
    (FREE.format(what="program", sep=";", name="General Public License", rest="; version 2 of the License."), "GPL-2.0"),
    (FREE.format(what="program", sep=";", name="General Public License version 2", rest="."), "GPL-2.0"),
    (FREE.format(what="program", sep=";", name="General Public License", rest="."), "GPL"),
    (FREE.format(what="library", sep=";", name="Lesser General Public License", rest=";" + LATER_OF.format("2.1")), "LGPL"),
    (FREE.format(what="library", sep=";", name="Library General Public License", rest=";" + LATER_OF.format(2)), "LGPL"),
    (FREE.format(what="program", sep=":", name="Lesser General Public License", rest="," + LATER_OF.format(3)), "LGPL"),
    (FREE.format(what="program", sep=":", name="Affero General Public License", rest="," + LATER_OF.format(3)), "AGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Licensed under the Mozilla Public License, v. 2.0. Keep it.", "MPL-2.0"),
    ("You may copy it under the terms of version 3 of the GNU General Public License.", "GPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
]


def test_standard_notices(spark):
    texts = [n for n, _ in NOTICES]
    commented = ["\n".join("# " + line for line in (n + WARRANTY).split("\n")) for n in texts]
    got = [r.licences for r in found(spark, *texts, *[n + WARRANTY for n in texts], *commented)]
    assert got == [name for _, name in NOTICES] * 3


def test_a_version_belongs_to_the_nearest_gnu_licence(spark):
    gpl2, lgpl, gpl2_later = "Licensed under the GNU General Public License version 2.\n", NOTICES[6][0] + "\n", NOTICES[1][0] + "\n"
    got = found(spark, gpl2 + lgpl, gpl2 + gpl2_later, lgpl + gpl2_later)
    assert [set(r.licences.split(",")) for r in got] == [{"GPL-2.0", "LGPL"}, {"GPL-2.0", "GPL-2.0-or-later"}, {"LGPL", "GPL-2.0-or-later"}]


def plain_matcher(ids):
    """The licences of a sequence, found by walking it once for each rule."""
    ids, out = list(ids), []
    for name, parts in licenses.NOTICE_RULES:
        gone, open_ = set(), []
        for at, x in enumerate(ids):
            if x == parts[0]:
                open_ = [at]
            elif open_ and x == parts[len(open_)]:
                open_.append(at)
            elif open_ and parts[-1].endswith(("_later", "_only")) and x in licenses._GNU:
                open_ = []
            if len(open_) == len(parts):
                gone.update(open_)
                open_ = []
        if gone:
            ids = [x for at, x in enumerate(ids) if at not in gone]
            if name not in out:
                out.append(name)
    return ",".join(out)


def test_rules_by_a_plain_matcher(spark):
    rng = random.Random(3)
    sets = [sorted({p for _, parts in licenses.NOTICE_RULES if len(parts) > 1 for p in parts}), [i for i, _ in licenses.KNOWN]]
    sets += [list(parts) + ["mit_ref"] for _, parts in licenses.NOTICE_RULES if len(parts) > 1]
    rows = [[rng.choice(s) for _ in range(rng.randrange(0, 25))] for s in sets for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<string>").withColumn("got", licenses.match_rules(F.col("ids")))
    assert [r.got for r in df.orderBy("i").collect()] == [plain_matcher(r) for r in rows]


def test_very_long_texts(spark):
    """Twenty thousand sentences after a start that never ends, runs of marks and blanks, and interleaved licences."""
    many = GRANT + "All rights reserved.\n" * 20_000
    mixed = "\n".join(random.Random(1).choice([GRANT, SOURCE, BINARY, ENDORSE, DISCLAIMER, "Released under the MIT License."]) for _ in range(20_000))
    ids = [next(i for i, p in licenses.KNOWN if re.fullmatch(p, re.sub("[^a-z0-9]+", " ", line.rstrip(" :.").lower()).strip())) for line in mixed.split("\n")]
    got = found(spark, many, mixed, "license" + "." * 300_000 + "x" + " " * 300_000 + "x", "permission " * 100_000)
    assert got[0].licences == "Proprietary" and got[1].licences == plain_matcher(ids)
    assert [r.licences for r in got[2:]] == ["", ""]


FULL = [
    ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work.\n3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies.", "Apache-2.0"),
    ("Preamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n2. Basic Permissions.\n\nAll rights granted under this License are granted for the term of\ncopyright on the Program, and are irrevocable provided the stated\nconditions are met.", "GPL-3.0"),
    ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation. All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided the stated conditions are met.", "AGPL-3.0"),
    ("The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.", "GPL-2.0"),
    ("The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software.", "LGPL"),
    ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "LGPL"),
    ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:\n(a) to use it.\n3.1. All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.", "MPL-2.0"),
    ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License.", "CC-BY-NC-SA-4.0"),
    ("You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License.", "CC-BY-4.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
]


def test_sentences_of_full_texts(spark):
    assert [r.licences for r in found(spark, *[t for t, _ in FULL])] == [n for _, n in FULL]


def test_sql_gives_the_same_rows(spark):
    import duckdb

    rng = random.Random(9)
    lines = [GRANT, SOURCE, BINARY, ENDORSE, DISCLAIMER, LATER, "Released under the MIT License. ", *(n for n, _ in NOTICES), *(t for t, _ in FULL), "Licensed under the GNU General Public License version 3. "]
    texts = [None, ""] + ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    got = sorted(map(tuple, licenses.scan_licenses(df).select("doc_id", "n_hints", "sentence_ids", "licences").collect()))
    assert got == sorted(duckdb.sql(licenses.oracle()).fetchall())

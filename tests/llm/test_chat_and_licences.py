"""Preference formatting and license scans on small hand-made tables."""
import re
import textwrap

import maskfold.llm.license_templates as T
from maskfold.llm.chat_format import preference_format, with_altered_answers
from maskfold.llm.license_scan import ANCHOR, inherit, scan, weigh


def test_preference_format(spark):
    rows = [(0, 0, "user", "hi", 1), (0, 1, "assistant", "good", 1), (0, 2, "user", "more", 1), (0, 3, "assistant", "yes", 1),
            (1, 0, "user", "hi", 1), (1, 1, "assistant", "good", 1), (1, 2, "user", "other", 1),
            (2, 0, None, None, 1), (2, 0, None, None, 1), (3, 0, None, None, 1), (4, 0, "user", "alone", 1), (None, 0, "user", "x", 1),
            (6, 0, "user", "x", 1), (7, 0, "assistant", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id int")
    got = {r.chosen: r for r in preference_format(turns).collect()}
    assert set(got) == {0, 2, 6}
    r = got[0]
    assert r.rejected == 1 and r.n_common == 2
    assert r.prompt == "<|user|>\nhi\n<|end|>\n<|assistant|>\ngood\n<|end|>\n"
    assert r.chosen_text == "<|user|>\nmore\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"
    assert "".join(s.text for s in r.chosen_segments) == r.chosen_text
    assert [s.mask for s in r.chosen_segments] == [0, 0, 0, 1] and [s.mask for s in r.rejected_segments] == [0, 0]
    assert got[2].n_common == 1 and got[2].chosen_text == "" and got[2].prompt == "<||>\n\n<|end|>\n"
    assert got[6].n_common == 0 and got[6].prompt == "" and [s.mask for s in got[6].rejected_segments] == [0, 1]
    pairs = spark.createDataFrame([(1, 0), (0, 99)], "chosen long, rejected long")
    assert [(r.chosen, r.rejected, r.n_common) for r in preference_format(turns, pairs).collect()] == [(1, 0, 2)]
    assert preference_format(turns.where("false")).count() == 0


def test_altered_answers_share_their_prompt(spark):
    long = "word " * 100_000
    rows = [(0, 0, "user", "q", 1), (0, 1, "assistant", "a0", 1), (0, 2, "user", long, 1), (0, 3, "assistant", long, 1),
            (1, 0, "user", "q", 1), (1, 1, "assistant", "a1", 1), (4, 0, "user", "only", 1), (4, 1, "assistant", None, 1), (5, 0, "user", "x", 1),
            (8, None, "assistant", "no turn", 1), (None, 0, "user", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string")
    both = with_altered_answers(turns)
    got = {r.chosen // 2: r for r in preference_format(both).collect()}
    assert set(got) == {0, 1, 4, 5, 8} and all(r.chosen + 1 == r.rejected for r in got.values())
    assert {c: r.n_common for c, r in got.items()} == {0: 3, 1: 1, 4: 2, 5: 1, 8: 1}  # 4: both answers are empty
    assert got[0].prompt.endswith(f"<|user|>\n{long}\n<|end|>\n") and got[0].rejected_text == "<|assistant|>\na1\n<|end|>\n"
    assert got[1].rejected_text == f"<|assistant|>\n{long}\n<|end|>\n" and got[5].chosen_text == got[5].rejected_text == ""
    assert with_altered_answers(turns.where("false")).count() == 0


def files_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "key string, path string, text string, score int").repartition(2)


def wrapped(text, width, start=""):
    return "\n".join(textwrap.wrap(text, width, initial_indent=start, subsequent_indent=start))


def test_license_scan(spark):
    rows = [("1", "a/LICENSE", "Released under\nthe MIT License."), ("2", "a/b/c.txt", "words only"), ("3", "a/b/d.txt", "x\nAll rights reserved.\ny"),
            ("4", "a/b/e/f.txt", None), ("5", "g/h.txt", ""), ("6", "top.txt", "Licensed under the Apache License, Version 2.0."),
            ("7", "z/q/r.txt", "license " * 20000), ("8", None, "released under the mit license"), ("9", "a/k.txt", "")]
    files = files_of(spark, rows)
    found = {r.file: (r.license, r.whole) for r in scan(files).collect()}
    assert found == {"1": ("mit", True), "3": ("all-rights-reserved", False), "6": ("apache-2.0", False), "8": ("mit", False)}
    got = {r.file: (r.license, r.origin, r.from_dir) for r in inherit(files, scan(files)).collect()}
    assert got["2"] == ("all-rights-reserved", "inherited", "a/b") and got["4"] == ("all-rights-reserved", "inherited", "a/b")
    assert got["9"] == ("mit", "inherited", "a") and got["1"] == ("mit", "own", None)
    assert got["5"][1:] == ("inherited", "") and got["7"][1] == "inherited"  # the root has notices
    empty = files.where("false")
    assert scan(empty).count() == 0 and inherit(empty, scan(empty)).count() == 0


def test_varied_notices(spark):
    notices = {
        "mit": ["Licensed under the MIT License.", "This file is released under the MIT license", "# SPDX-License-Identifier: MIT",
                "Copyright 2020 Jane Doe. Licensed under the MIT License."],
        "apache-2.0": ["Licensed under the Apache License, Version 2.0. See LICENSE for details.", "// SPDX-License-Identifier: Apache-2.0",
                       "Some words first\n * Licensed under the Apache License, Version 2.0 (the"],
        "all-rights-reserved": ["Copyright 2021 Acme Inc. All rights reserved.", "(c) X. All Rights Reserved"],
        "gpl-3.0": ["SPDX-License-Identifier: GPL-3.0", "This work is licensed under the GNU General Public License, version 3."],
        "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
        "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
        None: ["The license plate of the car was released to the public by the police, who had reserved a room at the hotel for the night.",
               "All rights of way were reserved for carts, and permission to redistribute the hay was asked of the mayor.",
               "They released the software update to improve the warranty terms of the engine in all markets.", "license", "MIT", "reserved"]}
    rows = [(f"{name}/{i}", "x.txt", t) for name, texts in notices.items() for i, t in enumerate(texts)]
    found = {r.file: r.license for r in scan(files_of(spark, rows)).collect()}
    assert {k: found.get(k) for k, _, _ in rows} == {k: None if k.startswith("None") else k.split("/")[0] for k, _, _ in rows}


def test_whole_licence_texts(spark):
    """Full texts and headers, wrapped at several widths and marked as comments, below a copyright line and above code or prose."""
    texts = {"mit": T.MIT, "isc": T.ISC, "bsd-2-clause": T.BSD_START + T.BSD_END, "bsd-3-clause": T.BSD_START + T.BSD_NAMES + T.BSD_END,
             "zlib": T.ZLIB, "unlicense": T.UNLICENSE, "apache-2.0": T.APACHE_HEADER, "mpl-2.0": T.MPL_HEADER,
             "gpl-3.0": T.GNU_HEADER.format(name="General Public License", version="3"),
             "lgpl-3.0": T.GNU_HEADER.format(name="Lesser General Public License", version="3"),
             "agpl-3.0": T.GNU_HEADER.format(name="Affero General Public License", version="3")}
    code = "\n\nimport os\n\n" + "\n".join(f"def function_{i}(a, b): return a + b * {i}" for i in range(60))
    rows = []
    for name, text in texts.items():
        text = " ".join(text.split())
        for width in (60, 76, 120):
            rows.append((f"{name}/{width}", "src/a.py", "# Copyright (c) 2019 Some Holder\n#\n" + wrapped(text, width, "# ") + code))
        rows.append((f"{name}/file", "LICENSE.txt", f"{name} licence\n\nCopyright (c) 2019 Some Holder\n\n" + wrapped(text, 78) + "\n"))
        rows.append((f"{name}/one", "src/b.py", text + "\n" + code))
    title = T.GNU_TITLE.format(name="GENERAL PUBLIC LICENSE", version="3", date="29 June 2007", year="2007")
    prose = wrapped("The precise terms and conditions for copying, distribution and modification follow. " * 60, 76)
    rows.append(("gpl-3.0/title", "COPYING", "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n" + wrapped(title.split("2007 ", 1)[1], 70) + "\n" + prose))
    rows.append(("apache-2.0/title", "LICENSE", "      Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS "
                 "FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + prose))
    found = {r.file: r.license for r in scan(files_of(spark, rows)).collect()}
    assert {k: found.get(k) for k, _, _ in rows} == {k: k.split("/")[0] for k, _, _ in rows}


def test_null_and_repeated_keys(spark):
    """Files without an id are told apart by their texts, as the query's key does."""
    from pyspark.sql import functions as F
    rows = [(None, "a/x.txt", "All rights reserved."), (None, "b/y.txt", "SPDX-License-Identifier: MIT"), (None, "c/z.txt", "no notice"),
            ("1", "d/1.txt", "SPDX-License-Identifier: MIT"), ("1", "d/1.txt", "SPDX-License-Identifier: MIT"), ("1", "e/1.txt", "words")]
    files = files_of(spark, rows).withColumn("id", F.col("key")).withColumn("key", F.concat_ws("|", "key", F.md5("text")))
    got = inherit(files, scan(files), keep=("id",)).collect()
    assert sorted((str(r.id), str(r.license), r.origin) for r in got) == [
        ("1", "None", "none"), ("1", "mit", "own"), ("1", "mit", "own"), ("None", "None", "none"), ("None", "all-rights-reserved", "own"), ("None", "mit", "own")]


def test_every_template_has_an_anchor():
    assert all(re.search(ANCHOR, text) for _, text in T.TEMPLATES)
    vectors, _ = weigh(T.TEMPLATES)
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for _, v in vectors)

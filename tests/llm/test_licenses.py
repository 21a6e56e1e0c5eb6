import re

from shopstream.llm import licenses


def _normal(s):
    s = re.sub(r"\.(?![0-9])|[^\w.]+|_", " ", s.lower().replace("licence", "license"))
    return re.sub(" +", " ", s).strip()


def _brute(text):
    known = {_normal(s): i for i, s in licenses.SENTENCES.items()}
    parts = re.split(r"\n+", re.sub(r"([.!?;:])[ \t\r]+", r"\1\n", text or ""))
    left, names = [known[_normal(p)] for p in parts if _normal(p) in known], []
    ids = list(left)
    for name, seq in licenses.RULES:
        i = 0
        while i + len(seq) <= len(left):
            if left[i:i + len(seq)] == seq:
                left[i:i + len(seq)] = [None]
                names += [name] if name not in names else []
            i += 1
    return ids, names


def test_sentences_and_rules(spark):
    s = licenses.SENTENCES
    mit = f"{s['mit-title']}\n\n{s['mit-grant']} {s['mit-condition']}"
    texts = [mit, "prose here. " + s["apache2-notice"] + " more prose\n" + s["gpl3-work"], "released UNDER the  MIT licence!", "The MIT License of nothing",
             f"{s['mit-grant']} unrelated words. {s['mit-condition']}", s["mit-condition"], "", None, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0. " * 3,
             f"{s['bsd-redistribution']}\n{s['bsd-binary']}", s["all-rights"] + " " + s["mit-notice"], "x " * 50_000 + s["mit-notice"]]
    docs = spark.createDataFrame([(i % 12 if i < 12 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = [(r["sentence_ids"], r["licenses"]) for r in licenses.find_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted((_brute(t) for t in texts), key=str)
    assert (["mit-title", "mit-grant", "mit-condition"], ["MIT"]) in got and ([], []) in got
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["n_known"]) for r in licenses.op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
    for r in docs:
        ids, names = _brute(r["text"])
        assert got[r["doc_id"]] == (",".join(ids), ",".join(names), len(ids))
    assert any(v[1] for v in got.values())


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


def test_texts_in_their_usual_form(spark):
    cases = [
        (MIT, ["mit-title-short", "mit-grant", "mit-condition"], ["MIT"]),
        (MIT.replace("\n", "\r\n"), ["mit-title-short", "mit-grant", "mit-condition"], ["MIT"]),
        (BSD, ["bsd-redistribution", "bsd-source", "bsd-binary"], ["BSD-2-Clause"]),
        (GPL, ["gpl-free", "gpl-hope"], ["GPL-3.0-or-later"]),
        (APACHE, ["apache2-notice-long", "apache2-use", "apache2-copy"], ["Apache-2.0"]),
        ("// SPDX-License-Identifier: MIT\nimport os\n", ["mit-spdx"], ["MIT"]),
        ("/* SPDX-License-Identifier: Apache-2.0 */", ["apache2-spdx"], ["Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-only", ["gpl2-spdx"], ["GPL-2.0"]),
        ("x\nSPDX-License-Identifier: GPL-3.0-only\nSPDX-License-Identifier: MIT", ["gpl3-spdx", "mit-spdx"], ["MIT", "GPL-3.0"]),
        ("Licensed under the\nMIT License.\nMIT License\nCopyright", ["mit-notice-licensed", "mit-title-short"], ["MIT"]),
        ("SPDX-License-Identifier: MIT OR Zlib", [], []),
        ("Licensed under the\n\nMIT License.", ["mit-title-short"], ["MIT"]),
        ("All rights\n\nreserved.", [], []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.find_licenses(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [(ids, names) for _, ids, names in cases]
    # the words of a table need not hold any word of the given one
    other = licenses.find_licenses(docs.limit(0).union(spark.createDataFrame([(1, "Do what\nyou: like!")], docs.schema)), {"own": "Do what you: like"}, [("Own", ["own"])])
    assert other.collect()[0]["licenses"] == ["Own"]


LGPL = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 */
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_the_right_licence_and_no_other(spark):
    cases = [
        (BSD + ENDORSE, ["BSD-3-Clause"]), (BSD, ["BSD-2-Clause"]), (BSD + "\n\n" + BSD + ENDORSE, ["BSD-3-Clause", "BSD-2-Clause"]),
        (LGPL, ["LGPL-2.1-or-later"]), (MPL, ["MPL-2.0"]), (ISC, ["ISC"]), (ISC.split(", provided")[0] + ".", ["0BSD"]),
        (GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2"), ["GPL-2.0-or-later"]),
        (GPL.replace("General Public", "Affero General Public"), ["AGPL-3.0-or-later"]),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later"]), ("# SPDX-License-Identifier: BSD-3-Clause\n", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT OR Apache-2.0"]), ("This project is released under the MIT License.", ["MIT"]),
        ("This project is released under the MIT Licence, which see.", []), ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
        ("The licence of prose about software and redistribution is no licence.", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [names for _, names in cases]


def test_tables_of_any_length_and_clashing_columns(spark):
    known = {f"s{i}": f"sentence number {i} of a long table" for i in range(700)}
    rules = [(f"L{i}", [f"s{i}"]) for i in range(700)]
    docs = spark.createDataFrame([(1, "Sentence number 699 of a long table. Sentence number 3 of a\nlong table.", "x", "y"), (2, "none", "x", "y")],
                                 "doc_id long, text string, sentence_ids string, id string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.find_licenses(docs, known, rules).collect()}
    assert got == {1: (["s699", "s3"], ["L3", "L699"]), 2: ([], [])}
    assert licenses.find_licenses(docs, {}, []).count() == 2

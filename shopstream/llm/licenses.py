"""Licence recognition by sentence rules, with Spark expressions only.

A text is cut into paragraphs (at lines without letters and digits) and these into pieces (at
line breaks, and after ``.``, ``!``, ``?``, ``:`` or ``;`` before white space).  Pieces are
normalised (lower case, one spelling, punctuation and spacing unified).  A known sentence is
found wherever successive pieces of a paragraph together are its words, so it may be wrapped
over any lines and may hold such signs itself.  Of sentences that begin at one piece the
longest counts, and pieces taken by one sentence do not begin another.  The identifiers found,
in order, are matched against rules.  Rules are tried in their order, longer ones first by
convention; a rule takes each place where its identifiers follow one another (other sentences
may stand between), and what it took is not seen by later rules.

All of it happens in the document's own row: no shuffle, no join.  The known sentences and
rules are tables of any length, carried as literals.  A text is looked at closely only if it
holds one of the sentences' longest words, which every known sentence in it would bring.

Defined results: null, empty or licence-free texts give an empty list and no identifiers;
repeated rows are returned each; a licence that matches several times is listed once;
columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of well-known licences and notices, and their identifiers
SENTENCES = {
    "mit-title": "The MIT License",
    "mit-title-short": "MIT License",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache2-title": "Apache License",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-notice-long": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-use": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-endorse-holder": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-holders": "Neither the names of the copyright holders nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-project": "Neither the name of the project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "all-rights": "All rights reserved.",
}
# fixed values: licences and the identifier sequences that show them, in the order in which they are tried
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition"]),
    ("MIT", ["mit-title-short", "mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache2-notice-long", "apache2-use", "apache2-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-holder"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-holders"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-author"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-university"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-project"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-notice"]), ("MIT", ["mit-notice-licensed"]), ("MIT", ["mit-spdx"]), ("MIT", ["mit-title"]), ("MIT", ["mit-title-short"]),
    ("Apache-2.0", ["apache2-notice"]), ("Apache-2.0", ["apache2-notice-long"]), ("Apache-2.0", ["apache2-spdx"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-work"]), ("GPL-2.0", ["gpl2-spdx"]), ("GPL-3.0", ["gpl3-work"]), ("GPL-3.0", ["gpl3-spdx"]),
    ("CC-BY-4.0", ["cc-by-4"]), ("CC-BY-NC-4.0", ["cc-by-nc-4"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]), ("CC0-1.0", ["cc0-notice"]),
    ("GPL-2.0-or-later", ["gpl2-free"]), ("AGPL-3.0-or-later", ["agpl-free"]), ("LGPL-2.1-or-later", ["lgpl21-free"]), ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("MPL-2.0", ["mpl2-form"]), ("ISC", ["isc-grant"]), ("ISC", ["isc-grant-and"]), ("0BSD", ["0bsd-grant"]), ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["boost-notice"]),
    ("proprietary", ["all-rights"]),
]
# fixed values: licences that a tag names by these words (beside those in SENTENCES), and by which titles notices name them
TAGS = ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
        "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MPL-2.0", "ISC", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
        "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "GPL-2.0-only OR MIT", "MIT AND Apache-2.0"]
TITLES = [("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
          ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-2.0", "GNU General Public License v2.0"),
          ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"), ("AGPL-3.0", "GNU Affero General Public License v3.0")]
LEADS = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This project is released under", "This software is licensed under",
         "This software is released under", "This program is licensed under", "This library is licensed under"]


def _known_words(sentence: str) -> str:
    s = re.sub(r"\.(?![0-9])|[^\w.]+|_", " ", sentence.lower().replace("licence", "license"))
    return " ".join(s.split())


def _with_tags_and_notices() -> None:
    """Add the sentences that TAGS, TITLES and LEADS make, and a rule for each; sentences of known words stay as they are."""
    known = {_known_words(s) for s in SENTENCES.values()}
    made = [(f"tag-{t}", f"SPDX-License-Identifier: {t}", t) for t in TAGS]
    made += [(f"notice-{i}-{j}", f"{lead} the {title}.", name) for i, (name, title) in enumerate(TITLES) for j, lead in enumerate(LEADS)]
    for name, sentence, licence in made:
        if _known_words(sentence) not in known:
            known.add(_known_words(sentence))
            SENTENCES[name] = sentence
            RULES.append((licence, [name]))


_with_tags_and_notices()


def normalised(text: Column) -> Column:
    """Lower case, license for licence, dots only inside numbers, single spaces; line and page breaks stay."""
    s = F.replace(F.lower(text), F.lit("licence"), F.lit("license"))
    return F.regexp_replace(s, r"\.(?![0-9])|[^\p{L}\p{N}.\n\f]+", " ")


def paragraphs(text: Column) -> Column:
    """Normalised pieces (array) of each paragraph (array); pieces without words are left out."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?:[^\p{L}\p{N}\n]*\n)+", "\f")
    cut = normalised(F.regexp_replace(lines, r"[.!?;:][ \t]+", "\n"))
    return F.transform(F.split(cut, r"\f"), lambda p: F.filter(
        F.transform(F.split(p, r"\n"), lambda s: F.trim(F.regexp_replace(s, r" +", " "))), lambda s: s != ""))


def _found(pieces: Column, known: Column, most: int) -> Column:
    """Identifiers of the known sentences in one paragraph, in order."""
    def longest(piece, i):
        # what follows from here, a line break after each piece
        after = F.concat(F.array_join(F.slice(pieces, i + 1, most), "\n"), F.lit("\n"))
        flat = F.concat(piece, F.lit(" "))
        begun = F.exists(known, lambda k: F.startswith(F.concat(k["words"], F.lit(" ")), flat))
        whole = F.filter(known, lambda k: F.startswith(F.translate(after, "\n", " "), k["words"]) & (F.substring(after, k["n"] + 1, F.lit(1)) == "\n"))
        best = F.array_max(F.transform(whole, lambda k: F.struct(k["n"].alias("n"), k["id"].alias("id"))))
        taken = F.size(F.split(F.substring(after, F.lit(1), best["n"]), r"\n"))
        return F.when(begun, F.when(best.isNotNull(), F.struct(i.alias("at"), (i + taken).alias("end"), best["id"].alias("id"))))

    places = F.filter(F.transform(pieces, longest), lambda c: c.isNotNull())
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("ids"))
    return F.aggregate(places, start, lambda acc, c: F.when(c["at"] >= acc["free"], F.struct(
        c["end"].alias("free"), F.concat(acc["ids"], F.array(c["id"])).alias("ids"))).otherwise(acc), lambda acc: acc["ids"])


def find_licenses(docs: DataFrame, known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """doc_id, sentence_ids (array, in order), licenses (array, in the order of the rules) of each row."""
    words = [(name, w) for name, s in known.items() if (w := _known_words(s))]
    table = (F.array(*[F.struct(F.lit(name).alias("id"), F.lit(w).alias("words"), F.lit(len(w)).alias("n")) for name, w in words]) if words
             else F.array().cast("array<struct<id:string,words:string,n:int>>"))
    most = max((w.count(" ") + 1 for _, w in words), default=1)  # a piece has a word at least
    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("ids")) for name, seq in rules]).cast("array<struct<name:string,ids:string>>")
    start = F.struct(F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(tried, start, lambda acc, r: F.when(F.contains(acc["left"], r["ids"]), F.struct(
        F.replace(acc["left"], r["ids"], F.lit(" | ")).alias("left"), F.array_union(acc["names"], F.array(r["name"])).alias("names"))).otherwise(acc))
    text = F.coalesce(F.col("text"), F.lit(""))
    anchors = sorted({re.escape(max(w.split(), key=len)).replace("license", "licen[cs]e") for _, w in words})
    worth = F.rlike(F.lower(text), F.lit("|".join(anchors))) if anchors else F.lit(False)
    found = F.when(worth, F.flatten(F.transform(paragraphs(text), lambda p: _found(p, table, most)))).otherwise(F.array().cast("array<string>"))
    return (docs.select("doc_id", found.alias("sentence_ids"))
            .select("doc_id", "sentence_ids", matched["names"].alias("licenses")))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))

import re
from collections import Counter

import duckdb

from sparkloom.llm import licenses

MIT = next(t for i, t in licenses.TEMPLATES if i == "MIT" and len(t) > 200)


def plain(rows, threshold=licenses.THRESHOLD):
    """Every passage against every template."""
    out = {}
    for doc, text in rows:
        lines = re.sub(r"[^\w\n]+|_", " ", (text or "")).lower()
        parts = [*lines.split("\n"), *re.split(r"\n *\n[ \n]*", lines), lines]
        words, whole = lines.split(), set()
        for _, template in licenses.TEMPLATES:  # runs of a template's length where its first, middle or last bigram stands
            theirs = licenses.template_words(template)
            for place in (0, (len(theirs) - 1) // 2, len(theirs) - 2):
                for k in range(place, len(words) - 1):
                    if words[k : k + 2] == theirs[place : place + 2]:
                        whole.add(" ".join(words[k - place : k - place + len(theirs)]))
        cut = {" ".join(p.split()) for p in parts}
        for passage in whole | cut:
            own = Counter(licenses.bigrams(passage.split(" ")))
            best = []
            for license_id, template in licenses.TEMPLATES:
                their = Counter(licenses.bigrams(licenses.template_words(template)))
                if passage not in cut and sum(own.values()) != sum(their.values()):
                    continue
                dice = 2.0 * sum((own & their).values()) / (sum(own.values()) + sum(their.values()))
                best.append((-dice, license_id))
            if best and -min(best)[0] >= threshold:
                out.setdefault((doc, min(best)[1]), {})[passage] = -min(best)[0]
    return sorted((repr(d), i, max(p.values()), len(p)) for (d, i), p in out.items())


ROWS = [
    (1, "Intro.\nReleased under the MIT License.\nMore text here."),
    (2, "licensed UNDER the apache license version 2 0"),
    (3, "This work is licensed under the GNU General Public License, version 2."),
    (4, "This work is licensed under the GNU General Public License, version 3. Really it is."),
    (5, MIT.replace(", ", ",\n") + "\n\nA paragraph of its own."),
    (6, "Released under the MIT License.\n\nReleased under the\nMIT License\n\nLicensed under CC BY-NC 4.0."),
    (7, None), (8, ""), (9, "MIT"), (10, "no licence " * 5000), (11, "under the MIT"),
    (12, "Released under the MIT License. " * 300), (None, "Released under the MIT License."), (13, "Released under the MIT License."), (13, "Released under the MIT License."),
]


def found(df):
    return sorted((repr(r["doc_id"]), r["license_id"], r["dice"], r["n_passages"]) for r in df.collect())


def test_against_all_pairs(documents, clashing):
    assert found(licenses.scan(documents(ROWS, clashing))) == plain(ROWS)
    assert found(licenses.scan(documents(ROWS), threshold=0.5)) == plain(ROWS, 0.5)


def test_sql_agrees(documents):
    docs = documents(ROWS).toArrow()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", docs)
    rows = con.sql(licenses.oracle_sql()).to_arrow_table().to_pylist()
    assert sorted((repr(r["doc_id"]), r["license_id"], r["dice"], r["n_passages"]) for r in rows) == plain(ROWS)


LICENSE_MIT = """MIT License

Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
FILES = [
    (1, LICENSE_MIT, {"MIT"}),
    (2, "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", {"Apache-2.0"}),
    (3, "This project is free software. Licensed under the Apache License, Version 2.0. It does many things in one long line.", {"Apache-2.0"}),
    (4, "// SPDX-License-Identifier: BSD-2-Clause\nint main() {}", {"BSD-2-Clause"}),
    (5, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", {"ISC"}),
    (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", {"BSD-2-Clause OR BSD-3-Clause"}),
    (7, "All in one line: see our page, released under the MIT License; docs, pictures, and the rest is licensed under CC BY-NC 4.0 and nothing else " + "x y z " * 50_000, {"MIT", "CC-BY-NC-4.0"}),
    (8, "The software has a licence and a license, copyright and warranty, permission and the public domain, but no notice.", set()),
    (9, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", {"GPL-3.0"}),
]


def test_licence_files_and_notices_in_long_lines(documents):
    ids = {}
    for r in licenses.scan(documents([(k, t) for k, t, _ in FILES])).collect():
        ids.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert ids == {k: want for k, _, want in FILES if want}


def test_every_template_is_its_own_licence(documents):
    rows = list(enumerate(t for _, t in licenses.TEMPLATES))
    found = {(r["doc_id"], r["license_id"]) for r in licenses.scan(documents(rows)).where("dice = 1").collect()}
    assert {(k, i) for k, (i, _) in enumerate(licenses.TEMPLATES)} <= found


def test_keywords_are_needed_to_reach_the_threshold():
    for threshold in (0.5, 0.8):
        known = set(licenses.keywords(threshold))
        assert threshold < 0.8 or len(known) < 80 and not known & {"the", "of", "and", "to"}
        for _, text in licenses.TEMPLATES:
            words = licenses.template_words(text)
            without = sum(not {a, b} & known for a, b in zip(words, words[1:], strict=False))
            assert 2 * without < threshold * (without + len(words) - 1)


def test_size_bounds_lose_nothing():
    for size in range(1, 40):
        low, high = licenses.size_bounds(size, 0.8)
        assert all((2 * min(n, size) / (n + size) >= 0.8) == (low <= n <= high) for n in range(1, 200))


def test_native_and_empty(documents):
    assert not re.search("Python|Pandas|Arrow", licenses.scan(documents(ROWS))._jdf.queryExecution().toString())
    assert licenses.scan(documents([])).collect() == []

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import license_scan as L

TEXTS = L.whole_texts()
PLAIN = L.Matcher({}, 1.0)
MIT = next(" ".join(p) for p in L.paragraphs(TEXTS["MIT"]) if p[0].startswith("Permission"))


def filled(name):
    """A licence as a project has it: holders named, lines broken elsewhere."""
    text = re.sub(r"<year>", "2019-2024", re.sub(r"<copyright holders>", "Ann Example and the Widget Project", TEXTS[name]))
    return "\n\n".join(re.sub(r"(.{40,60}?) ", r"\1\n", " ".join(p)) for p in L.paragraphs(text))


def test_whole_licences():
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(TEXTS)
    for name in TEXTS:
        assert PLAIN.scan(TEXTS[name])[0] == name and PLAIN.scan(TEXTS[name])[1] > 0.999
        got = PLAIN.scan(filled(name))
        assert got[0] == name and got[1] > 0.9 and got[2] == 1.0, (name, got)


def test_licences_within_other_text():
    rng = random.Random(3)
    prose = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(12)) + "." for _ in range(200))
    for name in TEXTS:
        comment = "\n".join(f"# {line}".rstrip() for line in filled(name).split("\n"))
        for text in (f"{comment}\n\nimport os\n{prose}", f"{prose}\n\n{filled(name)}\n\n{prose}"):
            got = PLAIN.scan(text)
            assert got[0] == name and (got[2] < L.MOSTLY or len(L.terms(TEXTS[name])) > 900), (name, got)
    assert PLAIN.scan(f"{prose}\n\n{MIT}")[0] == "MIT" and PLAIN.scan(MIT)[0] == "MIT" and PLAIN.scan(MIT)[2] == 1.0
    head = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    assert PLAIN.scan(f"/*\n * {head}\n */\nclass X {{}}\n{prose}")[0] == "Apache-2.0"
    assert PLAIN.scan("a text about driving licenses and permission to park")[0] is None and PLAIN.scan(prose) == (None, 0.0, 0.0)
    assert PLAIN.scan("x " * 100000 + "\nLicensed under CC BY-NC 4.0.\n")[0] == "CC-BY-NC-4.0"


def test_nothing_in_reach_is_passed_over():
    """Words of the templates, at random: what the terms that are needed let through is all that reaches a template."""
    rng = random.Random(5)
    idf = {t: rng.uniform(1, 8) for t in L.vocabulary(L.NOTICES, TEXTS)}
    matcher = L.Matcher(idf, 3.0)
    pool = [t for some in L.NOTICES.values() for n in some for t in L.terms(n)] + [f"x{i}" for i in range(200)]
    notices = [n for some in L.NOTICES.values() for n in some]
    reached = 0
    for _ in range(4000):
        words = L.terms(rng.choice(notices))
        words = [w if rng.random() < 0.75 else rng.choice(pool) for w in words]
        vector = matcher.vector(Counter(words))
        if max(matcher.notices.best(vector)[1], matcher.parts.best(vector)[1]) >= L.THRESHOLD:
            reached += 1
            assert matcher._of(" ".join(words)) is not None
    assert reached > 500


def test_nearest_ancestor(spark):
    rows = [
        (1, "r/LICENSE", MIT), (2, "r/a/b.py", "plain words here"), (3, "r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "r/a/c/d.py", "more words"),
        (5, "r/e.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (6, "other/x.py", None), (7, None, "loose"), (8, "top.py", "Released under the MIT License. And much more text about other things follows here in the file."), (4, "r/a/c/d.py", "more words"),
        (9, "r/s.py", "// SPDX-License-Identifier: ISC"), (10, "r/aa/x.py", "not below a"), (11, "b/notice.txt", filled("BSD-3-Clause")), (12, "b/c/d/e.py", "code"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumns({c: F.lit(1) for c in ("own", "a.b", "share", "id", "licence", "folder")})
    got = sorted((r.doc_id, r.own_license, r.license, r.inherited_from) for r in L.scan_licenses(df, "p").collect() if r.doc_id != 4)
    assert got == sorted([
        (1, "MIT", "MIT", None), (2, None, "GPL-3.0", "r/a"), (3, "GPL-3.0", "GPL-3.0", None), (5, "Apache-2.0", "Apache-2.0", None), (6, None, None, None), (7, None, None, None),
        (8, "MIT", "MIT", None), (9, "ISC", "ISC", None), (10, None, "MIT", "r"), (11, "BSD-3-Clause", "BSD-3-Clause", None), (12, None, "BSD-3-Clause", "b"),
    ])
    assert [(r.license, r.inherited_from) for r in L.scan_licenses(df, "p").where("doc_id = 4").collect()] == [("GPL-3.0", "r/a")] * 2


def test_empty_and_own_templates(spark):
    none = spark.createDataFrame([], "doc_id long, p string, text string")
    assert L.scan_licenses(none, "p").count() == 0
    one = spark.createDataFrame([(1, "a/x", "Covered by the House Rules of the Widget Project."), (2, "a/y", "")], "doc_id long, p string, text string")
    got = L.scan_licenses(one, "p", notices={"House": ("Covered by the House Rules of the Widget Project.",)}, licences={}).collect()
    assert {r.doc_id: r.license for r in got} == {1: "House", 2: "House"}


GNU = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}


def test_relatives_are_told_apart():
    rng = random.Random(4)
    idf = L.Matcher({t: rng.uniform(1, 8) for t in L.vocabulary(L.NOTICES, TEXTS)}, 4.0)
    for matcher in (PLAIN, idf):
        for name, head in GNU.items():
            comment = "/*\n * " + head.replace("\n", "\n * ") + "\n */\nclass X {}\n"
            assert matcher.scan(head)[0] == name and matcher.scan(comment)[0] == name, name
        for other in ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Licensed under the GNU General Public License, version 4.", "Licensed under CC BY-SA-NC-ND 4.0."):
            assert matcher.scan(other)[0] is None, other


def test_spdx_expressions():
    for said, want in (
        ("GPL-2.0-only", "GPL-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("AGPL-3.0-only", "AGPL-3.0"), ("MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("(MIT AND BSD-3-Clause)", "MIT AND BSD-3-Clause"), ("GPL-2.0+ */", "GPL-2.0"),
        ("Foo-1.0", None), ("apache-2.0 with LLVM-exception", "Apache-2.0 WITH LLVM-exception"), ("(MIT OR Foo) AND ISC -->", "(MIT OR Foo) AND ISC"), ("", None), ("mit and more words", "MIT AND more"),
    ):
        assert PLAIN.scan(f"# SPDX-License-Identifier: {said}\nx = 1")[0] == want, said


def test_cosines_are_what_they_are():
    """Inverted lists against plain cosines of whole vectors."""
    rng = random.Random(6)
    idf = {t: rng.uniform(1, 8) for t in L.vocabulary(L.NOTICES, TEXTS)}
    matcher = L.Matcher(idf, 3.0)
    pool = sorted(idf) + [f"x{i}" for i in range(300)]
    for _ in range(200):
        vector = matcher.vector(Counter(rng.choices(pool, k=rng.randrange(1, 60))))
        got = matcher.whole.cosines(vector)
        for k, other in enumerate(matcher.whole.vectors):
            assert abs(got.get(k, 0.0) - sum(w * other.get(t, 0.0) for t, w in vector.items())) < 1e-9


def test_inheritance_over_a_random_tree(spark):
    """Each file's licence is that of the nearest directory above it that has a voice."""
    rng = random.Random(7)
    heads = ["Released under the MIT License.", "Licensed under the ISC License.", "Licensed under the GNU General Public License, version 3."]
    names = ["MIT", "ISC", "GPL-3.0"]
    folders = ["/".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    voices = {f: rng.randrange(3) for f in set(folders) if rng.random() < 0.2}
    rows = [(i, f"{f}/LICENSE", heads[k]) for i, (f, k) in enumerate(sorted(voices.items()))] + [(1000 + i, f"{f}/x{i}.py", "plain words of code") for i, f in enumerate(folders)]
    got = {r.doc_id: (r.license, r.inherited_from) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), "p").collect()}
    for i, f in enumerate(folders):
        ups = ["/".join(f.split("/")[:k]) for k in range(len(f.split("/")), 0, -1)]
        near = next((u for u in ups if u in voices), None)
        assert got[1000 + i] == ((names[voices[near]], near) if near else (None, None))

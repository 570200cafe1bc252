"""License scans against the cosine of every line to every template, and inheritance against walking up the path."""

import math
import random
import re
import time
from collections import Counter

import pytest

from keyloom.llm import licenses as li

FILES = [
    ("a/LICENSE", "Some project\nReleased under the MIT License.\nmore text here that is no notice at all"),
    ("a/b/c/x.txt", "plain words under the sun"),
    ("a/b/y.txt", "first\nLicensed under the Apache License, Version 2.0.\nlast"),
    ("a/b/z.txt", "This is the license"),
    ("d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("d/copying", "Licensed under CC BY-NC 4.0."),
    ("d//e/f.txt", None),
    ("d/e/g.txt", ""),
    ("h/whole.txt", "SPDX-License-Identifier: MIT"),
    ("h/i.txt", "word " * 20000),
    ("top.txt", "hello"),
    (None, "nothing"),
    ("k/l.txt", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n" + "x y z " * 50),
]


def brute():
    texts = [t or "" for _, t in FILES]
    total = len(texts)
    df = Counter(w for t in texts for w in set(li.words(t)))
    known = {w for _, t in li.TEMPLATES + li.TITLES for w in li.words(t)}
    idf = lambda w: math.log((1 + total) / (1 + (df[w] if w in known else 1))) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(li.words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vec(t)) for name, t in li.TEMPLATES + li.TITLES]
    own = []
    for t in texts:
        best, lines, words, all_words = (0.0, None), 0, 0, 0
        for line in t.split("\n"):
            v = vec(line)
            all_words += len(li.words(line))
            hits = [(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), -k, name) for k, (name, u) in enumerate(templates) if v]
            if given := re.match(r"SPDX-License-Identifier: (\S+)$", line):
                hits = [(1.0, 0, given[1])]
            if hits and (hit := max(hits))[0] >= 0.8 - 1e-9:
                lines += 1
                words += len(li.words(line))
                if hit[0] > best[0] + 1e-12:
                    best = hit[0], hit[2]
        own.append((best[1], round(best[0], 9), lines, words / max(1, all_words)))
    clean = [[p for p in (path or "").split("/") if p] for path, _ in FILES]
    declared = {}
    for parts, (name, score, _, share) in zip(clean, own):
        if name and (share >= 0.5 or re.search(li.DECLARES, parts[-1] if parts else "")):
            key = "/".join(parts[:-1])
            declared[key] = min(declared.get(key, (1, "")), (-score, name))
    out = {}
    for i, (parts, (name, score, lines, _)) in enumerate(zip(clean, own)):
        ups = ["/".join(parts[:n]) for n in range(max(0, len(parts) - 1), -1, -1)]
        near = next((d for d in ups if d in declared), None)
        out[i] = (name, score, lines, name or (declared[near][1] if near is not None else None), "own" if name else "inherited" if near is not None else None, None if name else near)
    return out


def test_same_as_every_line_against_every_template(spark):
    files = spark.createDataFrame([(i, p, t, 1.0) for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string, score double")
    got = {r.doc_id: (r.license, round(r.score, 9), r.n_lines, r.effective_license, r.origin, r.from_directory) for r in li.license_scan(files).collect()}
    assert got == brute()
    assert got[1][3:] == ("Apache-2.0", "inherited", "a/b") and got[6][3] == "CC-BY-NC-4.0"


def test_wrapped_headers_and_license_files(spark):
    gpl = "# This program is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nimport os\n"
    bsd = "Copyright 2020 X\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    files = [
        ("a/LICENSE", bsd, "BSD-3-Clause"), ("a/x.py", "x = 1", None), ("b/x.py", gpl.format(";", "", 2), "GPL-2.0"), ("c/x.py", gpl.format(":", "Affero ", 3), "AGPL-3.0"), ("d/x.py", gpl.format(":", "", 3), "GPL-3.0"),
        ("e/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.", "Apache-2.0"),
        ("f/x.py", "one two three four five six seven eight nine ten Licensed under the Apache License, Version 2.0. and some more words here on this line", "Apache-2.0"),
    ]
    rows = [(i, p, t) for i, (p, t, _) in enumerate(files)] + [(100 + i, "z/y.txt", "plain words of other texts") for i in range(300)]
    got = {r.doc_id: r for r in li.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i].license for i in range(len(files))] == [name for _, _, name in files]
    assert (got[1].effective_license, got[1].from_directory) == ("BSD-3-Clause", "a")


def test_windows_against_all_windows():
    """Every window of every template's length, and of those that overlap the best, one by one."""
    rng = random.Random(4)
    matcher = li.Matcher(li.TEMPLATES[:8], {"license": 40, "the": 90, "under": 30}, 100, 0.8)
    bags = [Counter(li.words(t)) for _, t in li.TEMPLATES[:8]]
    weigh = lambda bag: {w: n * matcher.idf.get(w, matcher.other) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for _ in range(20):
        parts = [li.words(rng.choice(li.TEMPLATES[:8])[1]) if rng.random() < 0.5 else rng.choices(["x", "the", "license", "y"], k=rng.randint(0, 6)) for _ in range(8)]
        tokens = [w for p in parts for w in p if rng.random() > 0.05]
        found = []
        for k, bag in enumerate(bags):
            u, size = weigh(bag), bag.total()
            for at in range(len(tokens) - size + 1):
                v = weigh(Counter(tokens[at : at + size]))
                cosine = sum(x * u.get(w, 0) for w, x in v.items()) / norm(u) / norm(v)
                if cosine >= 0.8 - 1e-9:
                    found.append((at, at + size, min(1.0, cosine), k))
        kept = []
        for w in sorted(found, key=lambda w: (-round(w[2] ** 8 * (w[1] - w[0]), 9), w[3], w[0])):
            if all(w[1] <= x[0] or x[1] <= w[0] for x in kept):
                kept.append(w)
        got = matcher.windows(tokens)
        assert [(a, b, k) for a, b, _, k in got] == [(a, b, k) for a, b, _, k in sorted(kept)]


NOTICES = [
    ("The MIT License (MIT)\n\nCopyright (c) 2020 X", "MIT"),
    ("MIT License", "MIT"),
    ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: gpl-2.0+ */", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("x SPDX-License-Identifier: (mit or Apache-2.0) AND LicenseRef-Own.", "(MIT OR Apache-2.0) AND LicenseRef-Own"),
    ("<!-- SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 -->", "GPL-2.0 WITH Classpath-exception-2.0"),
    ("SPDX-License-Identifier: ", None),
    ("Licensed under either of Apache License, Version 2.0 or MIT license", "MIT OR Apache-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"),
    ("unlike the terms of the MIT license, ours asks for a fee", None),
]


@pytest.mark.parametrize(("text", "license_"), NOTICES)
def test_common_notices(text, license_):
    frequency = {"the": 900, "of": 900, "is": 900, "this": 800, "or": 500, "under": 100, "license": 60, "licensed": 40, "version": 40, "public": 90}
    matcher = li.Matcher(li.TEMPLATES, frequency, 1000, 0.8, li.TITLES)
    name, cosine, _, _ = matcher.text("other words before\n" + text + "\nother words behind")
    assert name == license_ and cosine == pytest.approx(1.0 if license_ else 0.0)


def test_a_text_of_many_expressions_takes_no_square_of_them():
    matcher = li.Matcher(li.TEMPLATES, {}, 10, 0.8, li.TITLES)
    began = time.process_time()
    assert matcher.text("SPDX-License-Identifier: MIT OR ISC\n" * 20_000 + "SPDX-License-Identifier: " + "(" * 100_000)[:3] == ("MIT OR ISC", 1.0, 20_000)
    assert time.process_time() - began < 60


def test_a_file_of_many_notices_takes_no_square_of_them():
    matcher = li.Matcher(li.TEMPLATES, {}, 10, 0.8, li.TITLES)
    text = "Licensed under the Apache License, Version 2.0.\n" * 20_000
    began = time.process_time()
    assert matcher.text(text)[:3] == ("Apache-2.0", pytest.approx(1.0), 20_000)
    assert time.process_time() - began < 60  # a square takes many times that


def test_null_and_repeated_ids(spark):
    files = spark.createDataFrame([(None, "a/LICENSE", "Released under the MIT License."), (1, "a/x", "x"), (1, "a/x", "x"), (1, "b/x", "y")], "doc_id long, path string, text string")
    got = sorted((r.doc_id or 0, r.path, r.effective_license) for r in li.license_scan(files).collect())
    assert got == [(0, "a/LICENSE", "MIT"), (1, "a/x", "MIT"), (1, "a/x", "MIT"), (1, "b/x", None)]


def test_empty(spark):
    assert li.license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0

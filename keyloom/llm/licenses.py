"""License scans: sparse TF-IDF cosine of lines and of windows over joined lines to templates, then inheritance from the nearest directory above.

Every line of every whole text is a vector over its words; document frequencies of the templates' words are counted over
all documents. A line can only reach the least cosine if it has one of a template's anchor words (the words of largest
weight, such that all others together stay below it), so other lines are passed over without loss. Around such words, windows of a template's length in the joined text are compared
too, whatever the line breaks, so that wrapped headers, whole license files and notices inside longer lines are found; of
windows that overlap, long and near ones count. Files without a
license of their own take that of the nearest directory at or above their own which declares one: the paths above are
exploded, once a distinct directory, and joined.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents, map_texts

WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")
#: Notices by which licenses are known, and sentences of their texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "%(bsd)s 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "%(bsd)s 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
]
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
TEMPLATES = [(name, text.replace("%(bsd)s", BSD)) for name, text in TEMPLATES]
#: Titles of license texts. Prose has such words too, so they count as whole lines only, never as windows.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Unlicense", "The Unlicense"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A line that names its license by an expression of identifiers.
TAG = "SPDX-License-Identifier:"
EXPRESSION = re.compile(TAG + r"[ \t]*(\(*[A-Za-z0-9][\w.+:-]*\)*(?:[ \t]+(?i:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+:-]*\)*)*)", re.ASCII)
#: Names of files that declare the license of their directory.
DECLARES = r"(?i)^(un)?(licen[cs]e|copying)([._-].*)?$"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _identifier(name: str, known: dict[str, str]) -> str:
    """A license's identifier: as the templates spell it, without `-only`, and a GNU license's `+` as `-or-later`."""
    name = name.rstrip(".:-")
    if name.endswith("+") and "GPL-" in name.upper():
        name = name[:-1] + "-or-later"
    base, tail = re.fullmatch(r"(.*?)(-only|-or-later)?", name, re.IGNORECASE).groups()
    return known.get(base.lower(), base) + ("-or-later" if (tail or "").lower() == "-or-later" else "")


def expression(line: str, known: dict[str, str]) -> str | None:
    """The expression of a line that has one, null if it doesn't: operators as capitals, single blanks, parentheses only
    where they are closed."""
    if TAG not in line or not (m := EXPRESSION.search(line)):
        return None
    parts = re.findall(r"[()]|[^()\s]+", m[1])
    if parts.count("(") != parts.count(")"):
        parts = [p for p in parts if p not in "()"]
    out = [p if p in "()" else p.upper() if p.upper() in ("AND", "OR", "WITH") else _identifier(p, known) for p in parts]
    return " ".join(out).replace("( ", "(").replace(" )", ")")


#: Windows that are compared at once.
STRETCH = 4096


def _stretches(first: np.ndarray, last: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """Ranges, both ends included and in order, that overlap or have a gap of so many between them at most, as one each."""
    if not len(first):
        return [], []
    new = np.append(True, first[1:] > last[:-1] + 1 + gap)
    return first[new].tolist(), last[np.append(new[1:], True)].tolist()


class Matcher:
    """Cosine of a line to the templates over TF-IDF weights; words of no template weigh as one in a document."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], total: int, least: float, titles: list[tuple[str, str]] = ()):
        windowed, templates = len(templates), [*templates, *titles]
        self.least, self.names = least, [name for name, _ in templates]
        self.known = {name.lower(): name for name in self.names}
        idf = lambda n: float(np.log((1 + total) / (1 + n)) + 1)
        bags = [Counter(words(t)) for _, t in templates]
        self.idf, self.other = {t: idf(frequency.get(t, 0)) for b in bags for t in b}, idf(1)
        self.lists: dict[str, list[tuple[int, float]]] = {}
        self.anchors, self.sizes, self.weights, self.starts = set(), [b.total() for b in bags], [], {}
        for k, bag in enumerate(bags):
            v = {t: n * self.idf[t] for t, n in bag.items()}
            length = sum(w * w for w in v.values()) ** 0.5
            self.weights.append({t: w / length for t, w in v.items()})
            rest = 1.0
            for t in sorted(v, key=lambda t: (-v[t], t)):
                self.lists.setdefault(t, []).append((k, v[t] / length))
                if rest >= least - 1e-9:  # what is left could still reach the least cosine
                    self.anchors.add(t)
                    if k < windowed:
                        self.starts.setdefault(t, []).append(k)
                rest = max(0.0, rest**2 - (v[t] / length) ** 2) ** 0.5

    def line(self, tokens: list[str]) -> tuple[float, str] | None:
        bag = Counter(tokens)
        length = sum((n * self.idf.get(t, self.other)) ** 2 for t, n in bag.items()) ** 0.5
        dots: dict[int, float] = {}
        for t, n in bag.items():
            for k, w in self.lists.get(t, ()):
                dots[k] = dots.get(k, 0.0) + n * self.idf[t] * w
        best = max(((d / length, -k) for k, d in dots.items()), default=(0.0, 0))
        return (best[0], self.names[-best[1]]) if best[0] >= self.least - 1e-9 else None

    def windows(self, tokens: list[str]) -> list[tuple[int, int, float, int]]:
        """start, end, cosine, template: of each template, the best windows of its length that reach `least`; of those that
        overlap, the one of the greatest length times eighth power of the cosine. By start."""
        spots: dict[int, list[int]] = {}
        for at, t in enumerate(tokens):
            for k in self.starts.get(t, ()):
                spots.setdefault(k, []).append(at)
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(t, len(number)) for t in tokens])
        found = []
        for k, places in spots.items():
            size, at = self.sizes[k], np.array(places)
            first, last = np.maximum(at - size + 1, 0), np.minimum(at, len(tokens) - size)
            for a, b in zip(*_stretches(first[first <= last], last[first <= last], 4 * size)):
                for lo in range(a, b + 1, STRETCH):
                    hi = min(b + 1, lo + STRETCH)
                    cosine = self._cosines(k, tokens[lo : hi - 1 + size], ids[lo : hi - 1 + size])
                    near = np.flatnonzero(cosine >= self.least - 1e-9)
                    found.append((lo + near, np.full(len(near), size), np.minimum(1.0, cosine[near]), np.full(len(near), k)))
        if not found:
            return []
        start, size, cosine, of = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, of, -np.round(cosine**8 * size, 9)))
        kept, taken = [], bytearray(len(tokens))
        for w in zip(*(x[order].tolist() for x in (start, start + size, cosine, of))):
            if taken.find(1, w[0], w[1]) < 0:
                taken[w[0] : w[1]] = b"\1" * (w[1] - w[0])
                kept.append(w)
        return sorted(kept)

    def _cosines(self, k: int, tokens: list[str], ids: np.ndarray) -> np.ndarray:
        """The cosine of each window of a template's length. The square of a window's vector is the sum of its tokens'
        squares, and twice that of a pair of equal tokens for each such pair."""
        size, own = self.sizes[k], self.weights[k]
        squares = np.array([self.idf.get(t, self.other) for t in tokens]) ** 2
        sliding = np.lib.stride_tricks.sliding_window_view
        dot = sliding(np.array([own.get(t, 0.0) for t in tokens]) * np.sqrt(squares), size).sum(axis=1)
        whole = sliding(squares, size).sum(axis=1)
        for apart in range(1, size):
            same = np.where(ids[apart:] == ids[:-apart], squares[apart:], 0.0)
            if same.any():
                sums = np.append(0.0, np.cumsum(same))
                whole += 2 * (sums[size - apart :] - sums[: len(sums) - size + apart])[: len(whole)]
        return dot / np.sqrt(whole)

    def text(self, text: str) -> tuple[str | None, float, int, float]:
        """The license of the best line or window, its cosine, how many lines match or lie in a window, and their share of
        the words. A line inside a window of a longer template counts for the window's license; one with an expression of
        identifiers has that, at a cosine of one."""
        raw = text.split("\n")
        lines = [words(line) for line in raw]
        tokens = [t for line in lines for t in line]
        tagged = TAG in text
        if not tagged and self.anchors.isdisjoint(tokens):
            return None, 0.0, 0, 0.0
        windows, hits, covered, told, at, first = self.windows(tokens), [], [False] * len(tokens), 0, 0, 0
        for whole, line in zip(raw, lines):
            end = at + len(line)
            while first < len(windows) and windows[first][1] <= at:
                first += 1
            over = list(takewhile(lambda w: w[0] < end, islice(windows, first, None)))  # noqa: B023
            longer = any(w[1] - w[0] > len(line) for w in over)
            given = expression(whole, self.known) if tagged else None
            hit = (1.0, given) if given else self.line(line) if not longer and not self.anchors.isdisjoint(line) else None
            if hit:
                hits.append((at, *hit))
                covered[at:end] = [True] * len(line)
            told += bool(hit or over)
            at = end
        for start, end, cosine, k in windows:
            hits.append((start, cosine, self.names[k]))
            covered[start:end] = [True] * (end - start)
        best = (None, 0.0)
        for _, cosine, name in sorted(hits, key=lambda h: h[0]):
            if cosine > best[1] + 1e-12:
                best = name, cosine
        return *best, told, sum(covered) / max(1, len(tokens))


def _frequencies(texts: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Documents that hold each of the templates' words, over the whole table; a row a word and task before the sum."""

    def run(frames):
        seen = Counter()
        for f in frames:
            for text in f["text"]:
                seen.update(vocabulary.intersection(words(text)))
        if seen:  # an empty frame has no string column that Arrow takes
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return {r.term: r.n for r in texts.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def above(directory: Column) -> Column:
    """A directory and all above it, the root as an empty string."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def license_scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = 0.8, whole: float = 0.5, templates: list[tuple[str, str]] | None = None, titles: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, path, license, score, n_lines, declares, effective_license, origin, from_directory: a row for each row.

    license is that of the best line, or window over joined lines, of the whole text, null if none has a cosine of `least`; ties go to the earlier
    line, then template. titles are compared to whole lines only, and a line with an SPDX expression has that as its license,
    whatever identifiers it names. A file declares its directory's license if it has one and is named like a license file or `whole`
    of its words are license lines; of several, the best score, then the least license, holds. origin: own, inherited or null. Null
    and empty texts have no license, null paths count as the root, slashes that repeat as one. Rows that repeat an id
    stay as they are. An empty table gives no rows; other columns are ignored.
    """
    scratch, templates = Scratch(files.sparkSession, "licenses"), templates or TEMPLATES
    titles = TITLES if titles is None else titles
    texts = documents(files, id_col, text_col, path_col).withColumnRenamed(path_col, "path")
    frequency = _frequencies(texts, {t for _, text in [*templates, *titles] for t in words(text)})
    matcher = Matcher(templates, frequency, texts.count(), least, titles)
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: p != "")
    scanned = map_texts(
        texts,
        lambda m, doc_id, text, path: (doc_id, path, *m.text(text)),
        "doc_id long, path string, license string, score double, n_lines long, share double",
        lambda: matcher,
    )
    scanned = scanned.withColumn("directory", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    name = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    scanned = scratch.write(scanned.withColumn("declares", F.col("license").isNotNull() & (name.rlike(DECLARES) | (F.col("share") >= whole))))
    declared = scanned.where("declares").groupBy("directory").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    declared = declared.select(F.col("directory").alias("from_directory"), F.col("best.license").alias("inherited"))
    ways = scanned.select("directory").distinct().select("directory", F.explode(above(F.col("directory"))).alias("from_directory"))
    nearest = ways.join(declared, "from_directory").groupBy("directory").agg(F.max(F.struct(F.length("from_directory").alias("n"), "from_directory", "inherited")).alias("near"))
    out = scanned.join(nearest, "directory", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", "license", "score", "n_lines", "declares",
        F.coalesce("license", "near.inherited").alias("effective_license"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("near.from_directory")).alias("from_directory"),
    )

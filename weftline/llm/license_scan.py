"""License scans (5): sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Templates are short notices, by which headers name a licence, and whole licence texts. A text is compared whole with the
whole texts. If that settles nothing, its passages (lines, sentences and paragraphs, comment marks taken off) are compared
with the notices, and runs of paragraphs that each match a paragraph of a licence are compared, as one passage, with the
whole texts: so texts that share paragraphs are told apart by the rest. Inverse document frequencies of the templates' terms
come from all texts; terms outside the templates weigh as a middling one. Passages are passed over unread only if they hold
none of the terms without which no template can be reached: a bound of the cosine, not a list of words. Relatives (of the GNU
and Creative Commons families, and versions) are told apart by the terms that mark them: a passage is never given to a notice
with other marks. An SPDX tag decides before all, its expression with known names.

A file named like a licence file (or one that is mostly licence wording) speaks for its directory, and files without a
licence of their own take that of the nearest ancestor directory: distinct directories, not files, are joined with their
ancestors, and files then meet their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cache
from importlib import resources
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_broadcast, materialize, text_or_empty

#: How headers name a licence.
NOTICES: Mapping[str, Sequence[str]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "ISC": ("Licensed under the ISC License.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Least cosine of a passage with a notice or a paragraph, and of a whole text with a licence.
THRESHOLD, WHOLE = 0.75, 0.85
#: Paragraphs of licences of so many terms and more are looked for.
PARAGRAPH = 8
#: Terms that mark one of several relatives, by what they stand for; versions mark too, where both sides name one.
MARKS = {"affero": "affero", "lesser": "lesser", "noncommercial": "nc", "nc": "nc", "sharealike": "sa", "sa": "sa", "noderivatives": "nd", "noderivs": "nd", "nd": "nd"}
#: Share of a text's terms in its licence passages from which it counts as a licence file.
MOSTLY = 0.5
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)")
_SPDX_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_VERSION = re.compile(r"[0-9]+(?:\.[0-9]+)?$")
_COMMENT = re.compile(r"^[\s#/*;%\-!<>]+|[\s*/\-<>]+$")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


@cache
def whole_texts() -> Mapping[str, str]:
    """The licence texts that come with the package, by name."""
    found = (resources.files(__package__) / "licences").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(found, key=lambda f: f.name) if f.name.endswith(".txt")}


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def vocabulary(notices: Mapping[str, Sequence[str]], texts: Mapping[str, str]) -> list[str]:
    every = [n for some in notices.values() for n in some] + list(texts.values())
    return sorted({t for n in every for t in terms(n)})


def paragraphs(text: str) -> Iterator[list[str]]:
    """Lines of each paragraph, comment marks taken off; lines without anything else part them."""
    block: list[str] = []
    for raw in [*text.split("\n"), ""]:
        line = _COMMENT.sub("", raw)
        if line:
            block.append(line)
        elif block:
            yield block
            block = []


def marks(found: Iterable[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The marks of relatives among terms, and the versions (2.0 is 2)."""
    return frozenset(MARKS[t] for t in found if t in MARKS), frozenset(t.removesuffix(".0") for t in found if len(t) <= 4 and _VERSION.match(t))


def alike(a: tuple[frozenset[str], frozenset[str]], b: tuple[frozenset[str], frozenset[str]]) -> bool:
    """Whether marks are the same, and versions, where both have some, meet."""
    return a[0] == b[0] and (not a[1] or not b[1] or not a[1].isdisjoint(b[1]))


def spdx_licence(expression: str, known: Mapping[str, str]) -> str | None:
    """A tag's expression with the names that are known, by any writing, and -only, -or-later and + taken off; None if it has none."""
    out, any_known, operand = [], False, False
    for part in _SPDX_PART.findall(expression):
        if part in "()":
            out.append(part)
        elif part.upper() in ("AND", "OR", "WITH"):
            out.append(part.upper())
            operand = False
        elif operand:  # what follows without an operator is no part of the expression
            break
        else:
            base = re.sub(r"(?i)(-only|-or-later|\+)$", "", part)
            any_known |= base.lower() in known
            out.append(known.get(base.lower(), part))
            operand = True
    text = re.sub(r"\( ", "(", re.sub(r" \)", ")", " ".join(out))).strip()
    if text.startswith("(") and text.endswith(")") and text.count("(") == 1:
        text = text[1:-1]
    return text if any_known else None


class Index:
    """Named texts as unit vectors with an inverted index over their terms."""

    def __init__(self, named: Sequence[tuple[str, str]], weigh):
        self.names, self.postings, self.vectors = [n for n, _ in named], {}, []
        self.marks = [marks(set(terms(text))) for _, text in named]
        for k, (_, text) in enumerate(named):
            vector = weigh(Counter(terms(text)))
            self.vectors.append(vector)
            for t, w in vector.items():
                self.postings.setdefault(t, []).append((k, w))

    def cosines(self, vector: Mapping[str, float]) -> dict[int, float]:
        dots: dict[int, float] = {}
        for t, w in vector.items():
            for k, x in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * x
        return dots

    def best(self, vector: Mapping[str, float], least: float = 0.0, marked: bool = False) -> tuple[str | None, float]:
        """The name and cosine of the nearest text (with marked: of those with the same marks), if it is least near or more; ties go to the earlier."""
        dots = {k: c for k, c in self.cosines(vector).items() if c >= least}
        if dots and marked:
            own = marks(vector)
            dots = {k: c for k, c in dots.items() if alike(own, self.marks[k])}
        if not dots:
            return None, 0.0
        k = min(dots, key=lambda i: (-round(dots[i], 12), i))
        return self.names[k], min(1.0, dots[k])

    def needed(self, least: float) -> set[str]:
        """Terms of which a text must hold one to reach the cosine with any template: without a template's heaviest, the rest of its unit vector is shorter than that."""
        out = set()
        for vector in self.vectors:
            rest = 1.0
            for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                out.add(t)
                rest -= w * w
                if rest < least * least - 1e-9:
                    break
        return out


class Matcher:
    """Scans texts against notices and whole licence texts."""

    def __init__(self, idf: Mapping[str, float], rest: float, notices: Mapping[str, Sequence[str]] | None = None, texts: Mapping[str, str] | None = None):
        notices, texts = NOTICES if notices is None else notices, whole_texts() if texts is None else texts
        self.idf, self.rest = dict(idf), rest
        self.tags = {n.lower(): n for n in (*notices, *texts)}
        self.notices = Index([(name, n) for name, some in notices.items() for n in some], self.vector)
        self.whole = Index(list(texts.items()), self.vector)
        cut = [(name, " ".join(p)) for name, text in texts.items() for p in paragraphs(text)]
        self.parts = Index([(name, p) for name, p in cut if len(terms(p)) >= PARAGRAPH], self.vector)
        self.triggers = self.notices.needed(THRESHOLD) | self.parts.needed(THRESHOLD)
        self.openers = self.whole.needed(WHOLE)

    def vector(self, counts: Mapping[str, int]) -> dict[str, float]:
        raw = {t: (1 + math.log(c)) * self.idf.get(t, self.rest) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    def _of(self, text: str) -> tuple[dict[str, float], int] | None:
        """The vector of a passage and its number of terms; None if no template can be reached."""
        counts = Counter(terms(text))
        return None if self.triggers.isdisjoint(counts) else (self.vector(counts), counts.total())

    def _run(self, run: list[tuple[str, dict[str, float]]]) -> tuple[str, float]:
        """The licence of consecutive paragraphs that each match some: that of a notice that is as near as the paragraphs, else that to whose paragraphs these come nearest in all, of equal ones that whose whole text is nearest."""
        vector = self.vector(Counter(terms(" ".join(p for p, _ in run))))
        most = max(max(near.values()) for _, near in run)
        notice, near = self.notices.best(vector, THRESHOLD, marked=True)
        if near >= most - 1e-9:
            return notice, near
        sums: Counter[str] = Counter()
        for _, names in run:
            sums.update(names)
        top = max(sums.values())
        whole = {self.whole.names[k]: c for k, c in self.whole.cosines(vector).items()}
        name = min((n for n in sums if sums[n] >= top - 1e-9), key=lambda n: (-round(whole.get(n, 0.0), 12), n))
        return name, min(1.0, max(whole.get(name, 0.0), most))

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """Licence, cosine, and the share of the text's terms that its licence passages hold."""
        counts = Counter(terms(text))
        if "spdx" in counts:
            for tag in _SPDX.finditer(text):
                if said := spdx_licence(tag[1], self.tags):
                    return said, 1.0, 0.0
        if not self.openers.isdisjoint(counts):
            name, cos = self.whole.best(self.vector(counts))
            if cos >= WHOLE:
                return name, cos, 1.0
        if self.triggers.isdisjoint(counts):
            return None, 0.0, 0.0
        found: list[tuple[float, str]] = []
        runs: Counter[str] = Counter()  # terms of the runs of paragraphs of each licence
        size = 0
        run: list[tuple[str, dict[str, float]]] = []  # paragraphs, and the nearest paragraph of each licence
        covered = 0
        for lines in [*paragraphs(text), []]:
            whole = " ".join(lines)
            seen = self._of(whole) if lines else None
            dots = {k: c for k, c in self.parts.cosines(seen[0]).items() if c >= THRESHOLD} if seen else {}
            own = marks(seen[0]) if dots else None
            dots = {k: c for k, c in dots.items() if alike(own, self.parts.marks[k])}
            if dots:
                near: dict[str, float] = {}
                for k, c in dots.items():
                    near[self.parts.names[k]] = max(c, near.get(self.parts.names[k], 0.0))
                run.append((whole, near))
                covered += seen[1]
                size += seen[1]
                continue
            if run and (not seen or not lines):
                name, cos = self._run(run)
                found.append((cos, name))
                runs[name] += size
                run, size = [], 0
            if not seen:
                continue
            name, cos = self.notices.best(seen[0], THRESHOLD, marked=True)
            if cos >= THRESHOLD:
                found.append((cos, name))
                covered += seen[1]
            for line in lines if len(lines) > 1 or cos < THRESHOLD else ():
                hits = [(c, n, k) for p in dict.fromkeys([line, *re.split(r"(?<!\bv\.)(?<=[.!?;])\s+", line)]) if (own := self._of(p)) for n, c, k in [(*self.notices.best(own[0], THRESHOLD, marked=True), own[1])] if c >= THRESHOLD]
                found += [(c, n) for c, n, _ in hits]
                covered += max((k for _, _, k in hits), default=0) if cos < THRESHOLD else 0
        if not found:
            return None, 0.0, 0.0
        best = max(c for c, _ in found)
        best_ones = [n for c, n in found if c >= best - 1e-12]
        name = max(best_ones, key=lambda n: runs[n])  # of those that are equally near, that of the most paragraphs, then the first
        return name, best, min(1.0, covered / max(1, counts.total()))


def term_weights(texts: DataFrame, notices: Mapping[str, Sequence[str]], licences: Mapping[str, str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all texts, and their median for other terms. Bounded by the templates.

    Whole terms are counted; each task sends one count per term.
    """
    names = vocabulary(notices, licences)
    known = {t.encode(): i for i, t in enumerate(names)}
    split = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = Counter(), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0):
                total.update(known.keys() & set(split.findall(text.as_buffer().to_pybytes().lower())))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(known[t] for t in total)], pa.int32()), pa.array([rows, *total.values()], pa.int64())], names=["t", "n"])

    found = {r.t: r.n for r in texts.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    rows = found.pop(-1, 0)
    idf = {t: math.log((rows + 1) / (found.get(i, 0) + 1)) + 1 for i, t in enumerate(names)}
    return idf, median(idf.values()) if idf else 1.0


def folder_of(path: Column) -> Column:
    """The part before the last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, Sequence[str]] | None = None, licences: Mapping[str, str] | None = None) -> DataFrame:
    """id, path, own_license, cosine, license (own or inherited), inherited_from (directory, null if own or none): one row per input row.

    notices, licences: templates by name instead of NOTICES and whole_texts(). Null texts are empty; texts of any length are
    read whole; a null path stands alone (nothing is inherited); of several licence files in a directory one that is named
    like one, then the highest cosine, then the least name, speaks; of passages that are equally
    near that counts of whose licence there are most paragraphs, then the first, of templates the first given. Repeated
    rows stay; other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    notices, licences = NOTICES if notices is None else notices, dict(whole_texts() if licences is None else licences)
    bounded_batches(files)
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("text"))
    idf, rest = term_weights(rows, notices, licences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(idf, rest, notices, licences)
        for batch in batches:
            found = [matcher.scan(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=["id", "path", "own", "cosine", "share"])

    scanned = materialize(rows.mapInArrow(run, f"id {kind}, path string, own string, cosine double, share double"), "licences")
    speaks = scanned.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(_NAMED) | (F.col("share") >= MOSTLY)))
    first = F.min(F.struct((~F.col("path").rlike(_NAMED)).alias("n"), (-F.col("cosine")).alias("c"), "own"))
    voices = speaks.groupBy(folder_of(F.col("path")).alias("up")).agg(first.alias("v")).select("up", F.col("v.own").alias("licence"))
    voices = bounded_broadcast(materialize(voices, "voices"))
    # each distinct directory with itself and its ancestors: parts of its path, the top included
    folders = scanned.where("path is not null and own is null").select(folder_of(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    ups = folders.select("folder", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.size(parts)))).alias("depth"), parts.alias("parts"))
    ups = ups.select("folder", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice("parts", 1, F.greatest("depth", F.lit(1))), "/")).alias("up"))
    nearest = ups.join(voices, "up").groupBy("folder").agg(F.max(F.struct("depth", "up", "licence")).alias("n"))
    nearest = bounded_broadcast(materialize(nearest.select("folder", F.col("n.up").alias("up"), F.col("n.licence").alias("licence")), "nearest"))
    out = scanned.withColumn("folder", folder_of(F.col("path"))).join(nearest, "folder", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.col("own").alias("own_license"), F.round("cosine", 6).alias("cosine"), F.when(inherits, F.col("licence")).otherwise(F.col("own")).alias("license"), F.when(inherits, F.col("up")).alias("inherited_from")
    )

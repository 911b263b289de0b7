"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every file's lines, its spans of a template's length (over line breaks) and its whole text
are compared with licence notices, headers and full texts by the cosine of TF-IDF vectors;
document frequencies are counted over all files.  A specific licence goes before "All rights
reserved".  A file whose whole text resembles a template is a licence file of its
directory.  A file without a licence of its own inherits from the nearest ancestor
directory that has a licence file; the lookup joins distinct directories with their
ancestors, so a directory with very many files costs one row.

Which comparisons can be left out is decided by a bound that holds for every vector: the
cosine with a template t is at most the root of the share of |t|^2 that lies on terms
which the text has.  Cosines that reach no threshold are given as 0.

Nulls: a null text has no licence of its own; a null path has no directory and inherits
nothing.  Ties go to the template whose name comes first, among licence files to the most
similar one, then the name, then the path.  Repeated rows get the same result each and weigh
as often as they occur.  Empty texts have no terms; very long texts are compared as a whole
and in all their lines and spans.  An empty table gives an empty table.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmetrics.llm.license_texts import FULL_TEXTS
from draftmetrics.llm.rowmap import free_name, with_text_struct
from draftmetrics.llm.shared import table, text_slices, tidied

_GNU = "licensed under the GNU {} Public License, version {}."
_GNU_NOTICE = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License"
_CC = ("Licensed under CC {0} 4.0.", "This work is licensed under a Creative Commons {1} 4.0 International License.")


def _gnu(kind: str, thing: str, version: str, day: str) -> tuple[str, ...]:
    return f"This work is {_GNU.format(kind, version)}", _GNU_NOTICE.format(thing, kind, version), f"GNU {kind.upper()} PUBLIC LICENSE Version {version}, {day}"


#: Short public licence notices and titles, then full texts where they are at hand.
TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General", "program", "3", "19 November 2007"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "Artistic-1.0": ("The Artistic License. Preamble. The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY-4.0": tuple(x.format("BY", "Attribution") for x in _CC),
    "CC-BY-NC-4.0": tuple(x.format("BY-NC", "Attribution-NonCommercial") for x in _CC),
    "CC-BY-NC-ND-4.0": tuple(x.format("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives") for x in _CC),
    "CC-BY-NC-SA-4.0": tuple(x.format("BY-NC-SA", "Attribution-NonCommercial-ShareAlike") for x in _CC),
    "CC-BY-ND-4.0": tuple(x.format("BY-ND", "Attribution-NoDerivatives") for x in _CC),
    "CC-BY-SA-4.0": tuple(x.format("BY-SA", "Attribution-ShareAlike") for x in _CC),
    "CC0-1.0": ("Creative Commons Legal Code. CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."),
    "GFDL-1.2": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    "GPL-1.0": _gnu("General", "program", "1", "February 1989"),
    "GPL-2.0": _gnu("General", "program", "2", "June 1991"),
    "GPL-3.0": (*_gnu("General", "program", "3", "29 June 2007"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.0": _gnu("Library General", "library", "2", "June 1991"),
    "LGPL-2.1": _gnu("Lesser General", "library", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser General", "library", "3", "29 June 2007"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
}
TEMPLATES = {name: (*many, *([FULL_TEXTS[name]] if name in FULL_TEXTS else [])) for name, many in TEMPLATES.items()}
_VARIANT = {"nc": "nc noncommercial", "nd": "nd noderivatives noderivs", "sa": "sa sharealike"}
_GPL_KINDS = "affero lesser library documentation mozilla"


def _tells(needs: tuple[str, ...], never: str = "") -> tuple[tuple[frozenset[str], ...], frozenset[str]]:
    return tuple(frozenset(x.split()) for x in needs), frozenset(never.split())


def _cc(*parts: str) -> tuple[tuple[frozenset[str], ...], frozenset[str]]:
    return _tells(("cc creative", *(_VARIANT[p] for p in parts)), " ".join(v for p, v in _VARIANT.items() if p not in parts))


#: Words that tell a licence from its neighbours: one of each group has to stand in what matches, none of the last set may.
#: Where the versions of a family differ by their numbers, the numbers decide.
TELLS = {
    "AGPL-3.0": _tells(("affero", "3 3.0")), "Apache-2.0": _tells(("apache", "2 2.0")), "Artistic-1.0": _tells(("artistic",)),
    "BSD-2-Clause": _tells((), "3 4"), "BSD-3-Clause": _tells((), "2 4"),
    "CC-BY-4.0": _cc(), "CC-BY-NC-4.0": _cc("nc"), "CC-BY-NC-ND-4.0": _cc("nc", "nd"), "CC-BY-NC-SA-4.0": _cc("nc", "sa"), "CC-BY-ND-4.0": _cc("nd"), "CC-BY-SA-4.0": _cc("sa"), "CC0-1.0": _tells(("cc0", "1.0 1")),
    "GFDL-1.2": _tells(("documentation", "1.2")), "GFDL-1.3": _tells(("documentation", "1.3")),
    "GPL-1.0": _tells(("general", "1 1.0"), f"2 2.0 2.1 3 3.0 {_GPL_KINDS}"), "GPL-2.0": _tells(("general", "2 2.0"), f"3 3.0 2.1 {_GPL_KINDS}"), "GPL-3.0": _tells(("general", "3 3.0"), f"2 2.0 2.1 {_GPL_KINDS}"),
    "ISC": _tells(("isc fee",)), "LGPL-2.0": _tells(("library", "2 2.0"), "affero lesser 2.1 3"), "LGPL-2.1": _tells(("lesser", "2.1"), "affero 3"), "LGPL-3.0": _tells(("lesser", "3 3.0"), "affero 2 2.0 2.1"),
    "MIT": _tells(("mit charge",)), "MPL-1.1": _tells(("mozilla", "1.1")), "MPL-2.0": _tells(("mozilla", "2.0"), "1.1"),
}
#: A full text resembles its neighbours in everything else: words that only one of them has.
FULL_TELLS = {"BSD-3-Clause": _tells(("endorse",)), "GPL-3.0": _tells(("2007",), "mozilla"), "Apache-2.0": _tells(("apache",)), "MIT": _tells(("charge",))}
#: The same words open both BSD licences: the rest of the file tells which it is.
WHOLE_FILE = ("BSD-2-Clause", "BSD-3-Clause")
SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)
#: What any licence may say as well.
GENERAL = "Proprietary"
TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)?")
#: Least cosine of a line, of a whole text that is a licence file, and of a span.
LEAST_LINE, LEAST_FILE, LEAST_SPAN = 0.6, 0.75, 0.8
#: Templates from this many terms on are full texts.
FULL = 100
#: A long text that opens with a licence's title or notice, so many terms at most from its start, is a licence file as well.
OPENING, LEAST_OPENING = 60, 0.9


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({t for many in templates.values() for one in many for t in terms(one)})


def document_frequencies(files: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many files each of ``words`` (a template vocabulary) occurs; "" counts all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, n = frozenset(words), Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, texts in text_slices(batch.column(0), 1 << 20):
                for text in texts:
                    if text:
                        seen.update(wanted.intersection(terms(text)))
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counted = files.select(F.col(text_col).cast("string")).mapInArrow(tidied(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}  # a row for each word of the vocabulary


class Matcher:
    """Cosines with all templates; a word that no template has weighs as the rarest."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequencies: dict[str, int], tells: dict = TELLS, full_tells: dict = FULL_TELLS):
        self.tells: list[tuple[tuple[frozenset[str], ...], frozenset[str]]] = []
        n = frequencies.get("", 0)
        words = vocabulary(templates)
        self.column = {w: k for k, w in enumerate(words)}
        self.rare = math.log(1 + n) + 1
        #: weight of each word of the vocabulary, and of any other at the end
        self.idf = np.array([math.log((1 + n) / (1 + frequencies.get(w, 0))) + 1 for w in words] + [self.rare])
        self.names, self.sizes, rows = [], [], []
        for name, one in ((name, one) for name, many in sorted(templates.items()) for one in many):
            found = terms(one)
            v = np.bincount([self.column[w] for w in found], minlength=len(self.idf)) * self.idf
            self.names.append(name)
            self.sizes.append(len(found))
            self.tells.append(tells.get(name, ((), frozenset())) if len(found) < FULL else full_tells.get(name, ((), frozenset())))
            rows.append(v / np.linalg.norm(v))
        self.templates = np.array(rows).reshape(len(rows), len(self.idf))
        self.squares = self.templates**2

    def reachable(self, words: list[str], least: float) -> np.ndarray:
        """Templates with which a text of these words, or a part of it, may have a cosine of ``least``."""
        at = [k for k in map(self.column.get, set(words)) if k is not None]
        return np.flatnonzero(self.squares[:, at].sum(1) >= least * least - 1e-9)

    def told(self, k: int, words: set[str]) -> bool:
        """Whether words say what tells template ``k`` from its neighbours."""
        needs, never = self.tells[k]
        return all(not group.isdisjoint(words) for group in needs) and never.isdisjoint(words)

    def _best(self, cosines: list[tuple[int, float]], least: float) -> tuple[str | None, float]:
        """The most similar specific licence that reaches ``least``, else the general one if it does; ties to the first."""
        passed = [(self.names[k] != GENERAL, round(min(1.0, x), 12), -k) for k, x in cosines if x >= least - 1e-12]
        if not passed:
            return None, 0.0
        _, x, k = max(passed)
        return self.names[-k], x

    def best(self, words: list[str], least: float) -> tuple[str | None, float]:
        """Of all templates, by the cosine with these words as one vector."""
        every = set(words)
        some = np.array([k for k in self.reachable(words, least) if self.told(k, every)], np.int64)
        if not len(some):
            return None, 0.0
        known = self.templates.shape[1] - 1
        counts = Counter(words)
        at, n = [], []
        norm = 0.0
        for w, c in counts.items():
            k = self.column.get(w, known)
            if k < known:
                at.append(k)
                n.append(c)
            else:
                norm += (c * self.rare) ** 2
        v = np.array(n) * self.idf[at]
        norm = math.sqrt(norm + float(v @ v))
        return self._best(list(zip(some.tolist(), (self.templates[np.ix_(some, at)] @ v / norm).tolist())), least)

    def best_span(self, words: list[str], least: float) -> tuple[str | None, float]:
        """The same over all spans of consecutive words that are as long as a template."""
        some = [k for k in self.reachable(words, least).tolist() if self.sizes[k] < len(words)]  # as a whole the text is compared by ``best``
        if not some:
            return None, 0.0
        at = np.array([self.column.get(x, len(self.idf) - 1) for x in words])
        w = self.idf[at]
        squares = np.concatenate([[0.0], np.cumsum(w * w)])
        norms: dict[int, np.ndarray] = {}
        found = []
        for k in some:
            n = self.sizes[k]
            dots = np.concatenate([[0.0], np.cumsum(w * self.templates[k][at])])
            dots = dots[n:] - dots[:-n]
            if (dots / np.sqrt(squares[n:] - squares[:-n])).max() < least - 1e-9:  # repeated terms only lengthen a vector
                continue
            if n not in norms:
                norms[n] = self._span_norms(words, w, n)
            inside = self._told_spans(k, words, n)
            if inside.any():
                found.append((k, float((dots / norms[n])[inside].max())))
        return self._best(found, least)

    def _told_spans(self, k: int, words: list[str], n: int) -> np.ndarray:
        """Which spans of n words say what tells template ``k`` from its neighbours."""
        needs, never = self.tells[k]

        def counts(group: frozenset[str]) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(np.fromiter((w in group for w in words), np.int64, len(words)))])
            return c[n:] - c[:-n]

        out = counts(never) == 0
        for group in needs:
            out &= counts(group) > 0
        return out

    @staticmethod
    def _span_norms(words: list[str], w: np.ndarray, n: int) -> np.ndarray:
        counts: Counter = Counter()
        total, out = 0.0, []
        for i, (x, y) in enumerate(zip(words, (w * w).tolist())):
            total += y * (2 * counts[x] + 1)
            counts[x] += 1
            if i >= n:
                old = words[i - n]
                total -= float(w[i - n]) ** 2 * (2 * counts[old] - 1)
                counts[old] -= 1
            if i >= n - 1:
                out.append(total)
        return np.sqrt(np.array(out))


def bsd(name: str | None, words: set[str]) -> str | None:
    """Which BSD licence a file has whose opening both share."""
    if name in WHOLE_FILE and "clause" not in words:
        return "BSD-3-Clause" if "endorse" in words else "BSD-2-Clause"
    return name


def spdx_name(identifier: str) -> str:
    """An identifier without what it says about later versions."""
    return re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``files`` with a struct column: own licence with its cosine, and the licence of a licence file."""
    name = name or free_name(files, "license_scan")
    frequencies = document_frequencies(files, vocabulary(templates), text_col)

    def make():
        matcher = Matcher(templates, frequencies)
        known = {name.lower(): name for name in templates}

        def work(texts: list[str | None]) -> list[list]:
            own, cosine, whole, whole_cosine = [], [], [], []
            for text in texts:
                passed, file = [], (None, 0.0)
                words = terms(text or "")
                stated = [known[x] for x in map(spdx_name, SPDX.findall(text or "")) if x in known]
                passed += [(x, 1.0) for x in stated]
                if len(matcher.reachable(words, min(LEAST_LINE, LEAST_FILE, LEAST_SPAN))):
                    file = matcher.best(words, LEAST_FILE)
                    if not file[0] and len(words) > FULL:
                        file = matcher.best_span(words[:OPENING], LEAST_OPENING)
                    lines = [matcher.best(terms(part), LEAST_LINE) for part in text.split("\n")]
                    every = set(words)
                    passed += [x for x in (*lines, file, matcher.best_span(words, LEAST_SPAN)) if x[0]]
                    passed = [(bsd(x[0], every), x[1]) for x in passed]
                    file = (bsd(file[0], every), file[1])
                line = max(passed, key=lambda x: (x[0] != GENERAL, x[1]), default=(None, 0.0))
                own.append(line[0])
                cosine.append(round(line[1], 6))
                whole.append(file[0])
                whole_cosine.append(round(file[1], 6))
            return [own, cosine, whole, whole_cosine]

        return work

    return with_text_struct(files, text_col, name, "license string, cosine double, file_license string, file_cosine double", make)


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, own_license, cosine, license, origin, license_dir): origin is own, inherited or none."""
    picked = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = scan(picked, templates, "text", "s").select("id", "path", F.expr("nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '')").alias("dir"), "s.license", "s.cosine", "s.file_license", "s.file_cosine")
    found = table(found, "license-files")
    holders = found.filter("file_license IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("license_dir")).agg(F.min_by("file_license", F.struct((-F.col("file_cosine")).alias("c"), "file_license", "path")).alias("dir_license"))
    dirs = found.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "license_dir"))
    nearest = ancestors.join(holders, "license_dir").groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("near"))
    out = found.join(nearest, "dir", "left")
    own = F.col("license")
    return out.select(F.col("id").alias(id_col), "path", own.alias("own_license"), "cosine", F.coalesce(own, F.col("near.dir_license")).alias("license"), F.when(own.isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(own.isNull(), F.col("near.license_dir")).alias("license_dir"))

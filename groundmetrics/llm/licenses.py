"""License scan: TF-IDF cosine of word windows and lines to header templates and of whole files to full licence texts, then inheritance from the nearest
ancestor directory that has a licence file, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, written

HEADER, FILE, WHOLE = 0.55, 0.5, 0.8
WEAK = {"Proprietary"}  # counts only where no other licence is found
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
# fixed values: characteristic sentences of public licences
TEMPLATES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL-2.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "Licensed under the GNU General Public License version 2", "GNU GENERAL PUBLIC LICENSE Version 2", "SPDX-License-Identifier: GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "Licensed under the GNU General Public License version 3", "GNU GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-2.1": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", "Licensed under the GNU Lesser General Public License version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "Licensed under the GNU Lesser General Public License version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC0-1.0": ["CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["Copyright all rights reserved. Unauthorized copying of this file is strictly prohibited", "All rights reserved"],
    "unknown": ["SPDX-License-Identifier"],  # of a licence that is not listed
}

# fixed values: the words that tell one licence from another. A match needs those of its template, and none of its family's others.
DECIDING = {"mit", "apache", "bsd", "gnu", "gpl", "lgpl", "agpl", "lesser", "mozilla", "mpl", "isc", "unlicense", "unencumbered", "cc", "cc0", "creative", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "reserved"}
_OTHERS = {"gnu": {"lesser", "library", "affero"}, "cc": {"nc", "sa", "nd", "noncommercial", "commercial", "sharealike", "share", "alike", "noderivatives", "noderivs", "derivatives"}}
_OTHERS["creative"] = _OTHERS["cc"]
# the sentence that opens both BSD licences: words the rest of the text must have, and must not have
_REST = {"BSD-2-Clause": ({"disclaimer"}, {"endorse"}), "BSD-3-Clause": ({"disclaimer", "endorse"}, set())}
_NAMED = {"license", "licence", "licensed", "licenced"}  # must stand by "mit", which is also a German word
UNKNOWN = "unknown"
_NUMBER = re.compile(r"v?([0-9]+(?:[.][0-9]+)*?)(?:[.]0)*")


def tokens(text: str) -> list[str]:
    """Words of the text, lower-cased; 3, v3, 3.0 and v3.0 are the same."""
    return [w if w[-1] > "9" else m[1] if (m := _NUMBER.fullmatch(w.lstrip("."))) else w for w in _WORD.findall(text.lower())]


def numbers(words) -> set[str]:
    return {w for w in words if w[0].isdigit() and _NUMBER.fullmatch(w)}


def agrees(name: str, own: list[str], part: list[str], everywhere: set[str]) -> bool:
    """Whether the deciding words of the template ``own`` (names, versions, restrictions) agree with those of ``part``."""
    need, have = (DECIDING & set(own)) | numbers(own), set(part)
    others = set().union(*(_OTHERS[w] for w in need & _OTHERS.keys())) - set(own)
    if name in _REST and "redistribution" in own:
        must, not_ = _REST[name]
        return must <= everywhere and not not_ & everywhere
    return need <= have and not others & have


def full_texts() -> dict[str, list[str]]:
    """Licence -> its full text; read on the driver, tasks get the vectors."""
    return {f.stem: [f.read_text(encoding="utf-8")] for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


class Vectors:
    """Unit TF-IDF vectors of templates. ``pull`` is idf times template weight by word, the last word being the unknown one."""

    def __init__(self, templates: dict[str, list[str]], vocabulary: dict[str, int]):
        self.texts = [(name, tokens(t)) for name, all_ in sorted(templates.items()) for t in all_]
        counts = [Counter(w) for _, w in self.texts]
        seen = Counter(w for c in counts for w in c)
        self.idf = np.full(len(vocabulary) + 1, math.log(1 + len(counts)) + 1)
        for w, n in seen.items():
            self.idf[vocabulary[w]] = math.log((1 + len(counts)) / (1 + n)) + 1
        self.weight = np.zeros((len(counts), len(self.idf)))
        for k, c in enumerate(counts):
            for w, n in c.items():
                self.weight[k, vocabulary[w]] = n * self.idf[vocabulary[w]]
        self.weight /= np.maximum(np.linalg.norm(self.weight, axis=1, keepdims=True), 1e-9)
        self.pull, self.square, self.share = self.weight * self.idf, self.idf**2, self.weight**2

    def norm(self, words: list[str], ids: np.ndarray) -> float:
        """Length of the TF-IDF vector of these words, unknown ones each for itself."""
        return math.sqrt(sum(n * n * self.square[i] for (_, i), n in Counter(zip(words, ids.tolist(), strict=True)).items()))


class Matcher:
    """Best header of a text over all windows of template length and all lines, and the full licence that it is, if any.

    A window reaches HEADER only if its words hold HEADER squared of the template's squared weight, and its score is at most that
    of all-different words; what fails one of these is left out before the exact cosine, without loss.
    """

    def __init__(self, templates: dict[str, list[str]], full: dict[str, list[str]]):
        self.vocabulary: dict[str, int] = {}
        for t in [*templates.values(), *full.values()]:
            for w in tokens(" ".join(t)):
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.headers, self.full = Vectors(templates, self.vocabulary), Vectors(full, self.vocabulary)

    def whole(self, words: list[str], ids: np.ndarray) -> tuple[str | None, float]:
        v = self.full
        if not len(words) or not v.texts:
            return None, 0.0
        count = np.bincount(ids, minlength=len(v.idf))
        dots = v.pull @ count
        known = math.sqrt((count[:-1] ** 2 * v.square[:-1]).sum() + count[-1] * v.square[-1])
        k = int(np.argmax(dots))
        if dots[k] < WHOLE * known:
            return None, 0.0
        score = float(dots[k] / v.norm(words, ids))
        return (v.texts[k][0], score) if score >= WHOLE else (None, 0.0)

    def present(self, ids: np.ndarray) -> np.ndarray:
        here = np.zeros(len(self.headers.idf))
        here[ids] = 1
        here[-1] = 0
        return here

    def segments(self, ids: np.ndarray, lines: np.ndarray):
        """(template, start, end) of the windows and lines that may reach HEADER."""
        v, here = self.headers, self.present(ids)
        alive = np.flatnonzero(v.share @ here >= HEADER**2 - 1e-9)
        if not len(alive):
            return
        square = np.append(0, np.cumsum(v.square[ids]))
        for k in alive.tolist():
            dot, n = np.append(0, np.cumsum(v.pull[k][ids])), min(len(v.texts[k][1]), len(ids))
            start = np.concatenate([np.arange(len(ids) - n + 1), lines[:-1]])
            end = np.concatenate([np.arange(n, len(ids) + 1), lines[1:]])
            ok = (dot[end] - dot[start] >= HEADER * np.sqrt(square[end] - square[start]) - 1e-9) & (end - start > 1)
            yield from zip([k] * int(ok.sum()), start[ok].tolist(), end[ok].tolist(), strict=True)

    def varied(self, k: int, words: list[str]) -> bool:
        """Whether the words still match if template words repeated beyond the template count no further, and are a fifth of its words."""
        v, own = self.headers, Counter(self.headers.texts[k][1])
        part = {w: min(n, own[w]) if w in own else n for w, n in Counter(words).items()}
        if len(own.keys() & part.keys()) < max(2, len(own) / 5) or "mit" in own and not _NAMED & part.keys():
            return False
        at = {w: self.vocabulary.get(w, len(v.idf) - 1) for w in part}
        dot = sum(n * v.pull[k, at[w]] for w, n in part.items())
        return dot >= HEADER * math.sqrt(sum(n * n * v.square[at[w]] for w, n in part.items()))

    def find(self, text: str) -> tuple[str | None, float, float]:
        """(licence, score, share of the text's words in lines or windows that match, 1 for a full licence text)."""
        words = tokens(text)
        unknown = len(self.headers.idf) - 1
        get = self.vocabulary.get
        ids = np.array([get(w, unknown) for w in words], np.int64)
        name, score = self.whole(words, ids)
        if name:
            return name, score, 1.0
        if not (self.headers.share @ self.present(ids) >= HEADER**2 - 1e-9).any():
            return None, 0.0, 0.0
        lines = np.cumsum([0, *(len(_WORD.findall(x.lower())) for x in text.splitlines())])
        best, found, inside, norms, everywhere = (0, 0.0, 0), None, np.zeros(len(words), bool), {}, set(words)
        for k, s, e in self.segments(ids, lines):
            if (s, e) not in norms:
                norms[s, e] = self.headers.norm(words[s:e], ids[s:e])
            score = float(self.headers.pull[k][ids[s:e]].sum()) / norms[s, e]
            name, own = self.headers.texts[k]
            if score < HEADER or not self.varied(k, words[s:e]):
                continue
            if not agrees(name, own, words[s:e], everywhere):
                if name in WEAK:
                    continue
                name = UNKNOWN
            inside[s:e] = True
            rank = (0 if name in WEAK else 1 if name == UNKNOWN else 2, round(score, 9), len(own))
            if found is None or rank > best:
                best, found = rank, name
        if not found:
            return None, 0.0, 0.0
        covered, size, at = 0, 0, 0
        for w in text.split():
            n = len(tokens(w))
            covered, size, at = covered + bool(inside[at : at + n].any()), size + 1, at + n
        return found, best[1], covered / max(size, 1)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, own_license, own_score, is_license_file) for every row of (path, text).

    A text that is a full licence (``WHOLE``) has that one. Otherwise every window of template length, across and inside
    lines, and every line is compared; the best at ``HEADER`` or more names the licence (ties: the longest template), which is
    ``UNKNOWN`` if no match agrees with its template in names, version and restrictions. A licence
    file is a full licence, or one where at least ``FILE`` of the words lie in matches, or that is named LICENSE or COPYING.
    """
    matcher = Matcher(templates or TEMPLATES, full_texts())

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                found, best, share = matcher.find(text or "")
                named = (path or "").rpartition("/")[2].upper().startswith(("LICENSE", "LICENCE", "COPYING"))
                rows.append((path, found, best, bool(found and (named or share >= FILE))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.float64(), pa.bool_()], strict=True)], ["path", "own_license", "own_score", "is_license_file"])

    return map_batches(files.select("path", "text"), run, "path string, own_license string, own_score double, is_license_file boolean")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license, origin (own, inherited, none) and from_dir: a file without a licence takes that of its nearest ancestor
    directory with a licence file. Two licence files in one directory: the higher score, then the smaller name.

    Directories, not files, are expanded into their ancestors, so the joins are over distinct directories.
    """
    up = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    # The scan is dear and read three times below.
    rows = written(scanned).withColumn("_dir", up(F.coalesce("path", F.lit(""))))
    held = rows.filter("is_license_file").groupBy("_dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("dir_license"))
    held = written(held.withColumnRenamed("_dir", "up"))
    dirs = rows.select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("up")).distinct()
    near = above.join(held, "up").groupBy("_dir").agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("n"))
    near = written(near.select(F.col("_dir").alias("_d"), F.col("n.up").alias("from_dir"), "n.dir_license"))
    out = rows.join(near, rows["_dir"] == near["_d"], "left")
    return out.select("path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "dir_license").alias("license"),
                      F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"))


def of_documents(docs: DataFrame) -> DataFrame:
    """The scan over ``documents``: a document lies at <source>/<id // 1000>/<id // 50>/<id>.txt."""
    n = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(n / 1000).cast("string"), F.floor(n / 50).cast("string"), F.concat(n.cast("string"), F.lit(".txt")))
    got = inherit(scan(docs.select(path.alias("path"), "text")))
    return got.select(F.expr("try_cast(regexp_extract(path, '([0-9-]+)[.]txt$', 1) as long)").alias("doc_id"), "*")

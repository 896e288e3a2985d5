"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a text (a header may stand anywhere) and the text as a whole are
compared with license templates. A line that reaches ``LEAST`` names the text's
license; a text that reaches it as a whole, or that has a license file's name
and a matching line, is a license file. Files without a license of their own
take that of the nearest directory above them that holds a license file.

Document frequencies of the template terms are counted over all texts. Terms no
template has weigh as much as the mean template term. Lines are skipped without
loss when they have none of the terms without which the cosine stays below
``LEAST``. Inheritance is resolved for distinct directories and then joined to
the files, so a directory that holds a third of them is one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import stored, table, text_slices

LEAST = 0.7
# Usual statements of licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "Use of this source code is governed by a BSD 2-Clause license"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "Licensed under the GNU General Public License, version 3",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Licensed under the ISC License", "Released under the ISC License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "MIT": (
        "Licensed under the MIT License",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction',
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
LICENSE_FILE = re.compile(r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[-._].*)?$")
_TERM = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Scanner:
    """Templates with their weights, ready to score lines."""

    def __init__(self, frequencies: dict[str, int], texts: int, templates: dict = TEMPLATES, least: float = LEAST):
        counts = [(name, Counter(terms(t))) for name, own in templates.items() for t in own]
        vocabulary = sorted({t for _, c in counts for t in c})
        self.weight = {t: math.log((2.0 + texts) / (1.0 + frequencies.get(t, 0))) for t in vocabulary}
        self.other = sum(self.weight.values()) / max(len(vocabulary), 1)
        self.least = least
        self.names, self.vectors, anchors = [], [], set()
        for name, c in counts:
            vector = {t: n * self.weight[t] for t, n in c.items()}
            norm = math.sqrt(sum(v * v for v in vector.values())) or 1.0
            vector = {t: v / norm for t, v in vector.items()}
            self.names.append(name)
            self.vectors.append(vector)
            # lightest terms whose share of the norm stays below the least cosine
            spared = 0.0
            for t, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                spared += v * v
                if math.sqrt(spared) >= least:
                    anchors.add(t)
        self.anchors = frozenset(anchors)

    def best(self, words: list[str]) -> tuple[str | None, float]:
        """License with the largest cosine; ties to the first template."""
        count = Counter(words)
        line = {t: n * self.weight.get(t, self.other) for t, n in count.items()}
        norm = math.sqrt(sum(v * v for v in line.values()))
        name, top = None, 0.0
        for own, vector in zip(self.names, self.vectors, strict=True):
            cosine = sum(v * line[t] for t, v in vector.items() if t in line) / norm if norm else 0.0
            if cosine > top + 1e-12:
                name, top = own, cosine
        return name, min(top, 1.0)

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """License and cosine of the best line or of the whole text, and whether the whole text matches."""
        found, whole = (None, 0.0), []
        for line in (text or "").split("\n"):
            words = terms(line)
            whole.append(words)
            if not self.anchors.isdisjoint(words):
                here = self.best(words)
                if here[1] > found[1]:
                    found = here
        if found[0] is None:
            return None, 0.0, False
        all_words = [w for words in whole for w in words]
        every = self.best(all_words) if len(whole) > 1 else found
        if every[1] > found[1]:
            found = every
        name = found[0] if found[1] >= self.least else None
        return name, found[1], every[1] >= self.least


def frequencies(files: DataFrame, text: str, templates: dict = TEMPLATES) -> tuple[dict[str, int], int]:
    """Texts that hold each template term, and the number of texts; a bounded number of rows."""
    vocabulary = sorted({t for own in templates.values() for s in own for t in terms(s)})
    known = F.array(*[F.lit(t) for t in vocabulary])
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))
    rows = files.select(F.explode_outer(F.array_append(F.array_intersect(words, known), F.lit(""))).alias("t"))
    found = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: found.get(t, 0) for t in vocabulary}, found.get("", 0)


def own_licenses(files: DataFrame, text: str, templates: dict = TEMPLATES) -> Column:
    """Struct (license, score, whole) of every text."""
    counted, n = frequencies(files, text, templates)

    def run(texts: pa.Array) -> pa.Array:
        scanner = Scanner(counted, n, templates)
        found = []
        for lo, hi in text_slices(texts):
            found += [scanner.scan(t) for t in texts.slice(lo, hi - lo).to_pylist()]
        names, scores, whole = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.array(scores, dtype=np.float64)), pa.array(whole, pa.bool_())],
            ["license", "score", "whole"],
        )

    return F.arrow_udf(run, "license string, score double, whole boolean")(F.col(text))


def directory(path: Column) -> Column:
    """Directory of a normalised path; empty for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, deepest first, as (depth, folder)."""
    parts = F.split(folder, "/")
    n = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(
        F.sequence(n, F.lit(0)),
        lambda k: F.struct(k.alias("depth"), F.when(k > 0, F.array_join(F.slice(parts, 1, k), "/")).otherwise("").alias("folder")),
    )


def scan(files: DataFrame, file_id: str, path: str, text: str, templates: dict = TEMPLATES) -> DataFrame:
    """License of every file, its own or inherited.

    Columns file_id, path, own_license, own_score, is_license_file, license and
    inherited_from (a directory, null for an own license or none). Among the
    license files of a directory the best score counts, then the first license
    and path. Null texts count as empty; a null path inherits nothing. Repeated
    rows each get their line.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(path), "/+", "/"), "^/|/$", "")
    rows = files.select(
        F.col(file_id).alias("file_id"), clean.alias("path"), own_licenses(files, text, templates).alias("own")
    )
    name = F.regexp_extract("path", r"[^/]*$", 0)
    named = F.coalesce(name.rlike(LICENSE_FILE.pattern), F.lit(False))
    scanned = stored(
        rows.select(
            "file_id",
            "path",
            F.col("own.license").alias("own_license"),
            F.col("own.score").alias("own_score"),
            (F.col("own.license").isNotNull() & (F.col("own.whole") | named)).alias("is_license_file"),
            directory(F.col("path")).alias("folder"),
        )
    )
    order = F.struct(-F.col("own_score"), "own_license", "path")
    holders = scanned.where("is_license_file and folder is not null").groupBy(F.col("folder").alias("holder")).agg(
        F.min_by("own_license", order).alias("license_")
    )
    folders = scanned.where("own_license is null and folder is not null").select("folder").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
    reached = above.join(holders, F.col("a.folder") == F.col("holder"))
    nearest = reached.groupBy("folder").agg(F.max_by(F.struct("license_", "holder"), "a.depth").alias("near"))
    out = scanned.join(nearest, "folder", "left")
    lacks = F.col("own_license").isNull()
    return out.select(
        "file_id",
        "path",
        "own_license",
        "own_score",
        "is_license_file",
        F.coalesce("own_license", "near.license_").alias("license"),
        F.when(lacks, F.col("near.holder")).alias("inherited_from"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files of the directories source/lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return scan(docs.withColumn("path", path), "doc_id", "path", "text").withColumnRenamed("file_id", "doc_id")

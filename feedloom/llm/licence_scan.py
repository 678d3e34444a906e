"""Licences of files: sparse TF-IDF cosine of their lines to templates, then inheritance from the nearest directory. DataFrame functions only.

The vocabulary is that of the templates, weighted by inverse document frequency over all files; any other word of a line counts in its norm with
the weight of a word that no file has. By Cauchy and Schwarz a line cannot reach the threshold without one of a template's heaviest
words (its anchors: without them the rest of the template is shorter than the threshold), so only lines with an anchor are scored, each different
line once. A file named as a licence file is also scored as a whole. The licence of a directory passes down to files without their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import literal_table, text_key
from feedloom.session import materialise

_NO_WORD = "[^a-z0-9]+"


def template_words(text: str) -> Counter:
    return Counter(w for w in re.split(_NO_WORD, text.lower()) if w)


class Template(NamedTuple):
    license: str
    text: str
    #: Words that a line must have beside the cosine; short templates would else accept the names of other licences.
    must: tuple[str, ...] = ()


#: How common licences name themselves in headers.
_SENTENCES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Identifiers and names of licences.
_NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("Unlicense", "The Unlicense"),
)
#: First sentences of licence texts, as they are commonly wrapped.
_OPENINGS = (
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission", "distribute", "fee")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby", "charge", "obtaining")),
)


def _named_templates() -> list[Template]:
    """Per name the plain title and two sentences around it, per identifier the tag that tools read; all words of the name must be there."""
    out = []
    for license, name in _NAMES:
        words = tuple(sorted(template_words(name)))
        out += [Template(license, form.format(name), words) for form in ("{}", "Licensed under the {}.", "This file is released under the {}.")]
    for license in sorted({k for k, _ in _NAMES}):
        out.append(Template(license, f"SPDX-License-Identifier: {license}", tuple(sorted({"spdx", "identifier", *template_words(license)}))))
    return out


THRESHOLD = 0.75
#: Names of licence files, in lower case.
FILE_NAMES = r"(^|/)(un)?licen[cs]e(s|\.[a-z]+|-[^/]*)?$|(^|/)copying(\.[a-z]+)?$"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NO_WORD), lambda w: w != "")


TEMPLATES = (*[Template(*t) for t in _SENTENCES], *_named_templates(), *[Template(*t) for t in _OPENINGS])


def inverse_frequency(n_files: int, n_with: int) -> float:
    return math.log((1 + n_files) / (1 + n_with)) + 1


def weigh_templates(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for text in (t.text for t in templates):
        raw = {w: n * idf[w] for w, n in template_words(text).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({w: v / norm for w, v in raw.items()})
    return out


def anchors(vectors: list[dict[str, float]], threshold: float, musts: list[tuple[str, ...]] | None = None) -> list[str]:
    """Words of which every line at ``threshold`` or more from some template has one. A template with words that must be there has its heaviest as anchor."""
    found = set()
    for vector, must in zip(vectors, musts or [()] * len(vectors)):
        if must:
            found.add(max(must, key=lambda w: (vector[w], w)))
            continue
        rest = 1.0
        for word, value in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 * (1 - 1e-9):
                break
            found.add(word)
            rest -= value * value
    return sorted(found)


def term_frequencies(files: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """(number of files, per term the number of files with it), over all files."""
    wanted = F.array(*[F.lit(t) for t in terms])
    counted = files.select(F.explode(F.array_union(F.array_intersect(F.split(F.lower("text"), _NO_WORD), wanted), F.array(F.lit("")))).alias("term"))
    rows = counted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per template word
    found = {r.term: r.n for r in rows}
    return found.pop("", 0), found


def score_lines(lines: DataFrame, templates, vectors: list[dict[str, float]], idf: dict[str, float], unknown: float, threshold: float) -> DataFrame:
    """(line, license, score) of the best template of each distinct line at ``threshold`` or more that has the template's words that must be there; equal scores go to the first license by name."""
    spark = lines.sparkSession
    weights = literal_table(spark, [(k, t.license, w, v, w in t.must, len(t.must)) for k, (t, vector) in enumerate(zip(templates, vectors)) for w, v in vector.items()], "template int, license string, _word string, weight double, must boolean, n_must int")
    known = literal_table(spark, sorted(idf.items()), "_known string, idf double")
    words = lines.select("line", F.explode(_words(F.col("line"))).alias("word")).groupBy("line", "word").agg(F.count(F.lit(1)).alias("n"))
    # Both tables have as many rows as the templates have words.
    words = words.join(F.broadcast(known), F.col("word") == F.col("_known"), "left").withColumn("value", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    norms = words.groupBy(F.col("line").alias("_line")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = words.join(F.broadcast(weights), F.col("word") == F.col("_word")).groupBy("line", "template", "license", "n_must").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"), F.count_if("must").alias("has"))
    dots = dots.where("has = n_must")
    scored = dots.join(norms, dots.line == norms["_line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("line", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path; the top has the empty name, and a null path none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """The folder itself, then its parents up to the top."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, stand_in: bool = True, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, license, score, origin, source), one row per input row.

    ``origin`` is 'own' (a line of the file, or a licence file as a whole, is like a template), 'inherited' (from the nearest directory above, its own included,
    that has a licence), 'stand_in' or null; ``source`` is the path that the licence comes from. A directory takes the licence of its licence files: the best
    score, then the smallest path. With ``stand_in`` a directory without one takes that of its first file, by path, with an own
    licence, and what inherits it has the origin 'stand_in': a guess, which no licence file backs. A null or empty text has no own licence; a file without path inherits nothing. Rows that repeat path and text get the same result; a path with
    different texts stands for all its rows in inheritance. Other columns are not read.
    """
    plain = files.select(F.col(f"`{path_col}`").cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    terms = sorted(set().union(*(template_words(t.text) for t in templates)))
    n_files, counts = term_frequencies(plain, terms)
    idf = {t: inverse_frequency(n_files, counts.get(t, 0)) for t in terms}
    vectors = weigh_templates(templates, idf)
    # Terms are letters and digits only.
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(anchors(vectors, threshold, [t.must for t in templates])) + r")(?![a-z0-9])"

    keyed = plain.withColumn("_key", text_key("text"))
    named = F.coalesce(F.lower("path").rlike(FILE_NAMES), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern))
    units = keyed.where(F.col("text").rlike(pattern)).select("path", "_key", F.explode(F.when(named, F.array_union(lines, F.array("text"))).otherwise(lines)).alias("line"))
    units = materialise(units.distinct())
    scores = score_lines(units.select("line").distinct(), templates, vectors, idf, inverse_frequency(n_files, 0), threshold)
    own = units.join(scores.withColumnRenamed("line", "_line"), F.col("line") == F.col("_line")).groupBy("path", "_key")
    own = materialise(own.agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("path", "_key", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score")))

    holders = own.where("path is not null").withColumn("rank", F.when(named, 0).otherwise(1)).where(F.col("rank") <= int(stand_in))
    order = F.struct("rank", F.when(F.col("rank") == 0, -F.col("score")).alias("minus"), "path", "license", "score")
    held = holders.groupBy(directory(F.col("path")).alias("folder")).agg(F.min(order).alias("h"))
    held = held.select(F.col("folder").alias("_folder"), F.col("h.license").alias("given"), F.col("h.score").alias("given_score"), F.col("h.path").alias("given_by"), (F.col("h.rank") == 1).alias("guess"))
    # Each different directory looks its licence up once, whatever the number of its files.
    narrow = keyed.select("path", "_key").withColumn("folder", directory(F.col("path")))
    folders = narrow.where("path is not null").select("folder").distinct()
    upward = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("up", "above"))
    nearest = upward.join(held, F.col("above") == F.col("_folder")).groupBy("folder").agg(F.min(F.struct("up", "given", "given_score", "given_by", "guess")).alias("g"))
    nearest = nearest.select(F.col("folder").alias("_f"), "g.*")
    mine = own.select(F.col("path").alias("_p"), F.col("_key").alias("_k"), "license", "score")
    joined = narrow.join(mine, F.col("path").eqNullSafe(F.col("_p")) & (F.col("_key") == F.col("_k")), "left").join(nearest, F.col("folder") == F.col("_f"), "left")
    has, gets = F.col("license").isNotNull(), F.col("given").isNotNull()
    return joined.select(
        "path", F.coalesce("license", "given").alias("license"), F.coalesce("score", "given_score").alias("score"),
        F.when(has, "own").when(gets & F.col("guess"), "stand_in").when(gets, "inherited").alias("origin"), F.when(has, F.col("path")).when(gets, F.col("given_by")).alias("source"),
    )

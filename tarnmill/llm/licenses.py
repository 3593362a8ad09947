"""Licence scan in DataFrame functions alone: TF-IDF cosine to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.runtime import materialise

#: Statements by which licences are commonly declared, as (licence, statement).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
_GNU = [("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]
TEMPLATES += [(name, f"This work is licensed under the GNU {kind} Public License, version {v}") for name, kind, v in _GNU]
TEMPLATES += [(name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License") for name, kind, v in _GNU]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
TEMPLATES += [(f"CC-{short}-{v}", f"Licensed under CC {short} {v}") for short, _ in _CC for v in ("4.0", "3.0")]
TEMPLATES += [(f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {name} {v} {area} License") for short, name in _CC for v, area in (("4.0", "International"), ("3.0", "Unported")) if (short, v) != ("BY", "4.0")]
#: An SPDX tag names its licence itself; templates would drown the name in the tag's own words, or match the name alone.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([a-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(?[a-z0-9.+-]+\)?)*)"
#: Function words, which are no terms.
COMMON = set("a all an and any are as at be by can either file following form forms free from if in is it may not of or provided that the this to under use with without work you".split())
#: Terms that are words of prose in some language. Alone or together they state no licence.
PROSE = {"mit", "nd", "sa", "nc", "source", "general", "public", "code", "version", "v", "2", "3"}
THRESHOLD = 0.7
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
#: A sentence ends at a mark before a capital, or at a line without letters; it may run over lines and their comment signs.
SENTENCE = r"""([.!?])["')\]]*\s+([^A-Za-z0-9\n]{0,8}[A-Z])"""
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
CUT = "\x1e"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def _terms(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in COMMON]


def terms_of(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*sorted(COMMON)))


class Weights:
    """TF-IDF of the templates: document frequencies over templates; a term of no template weighs as the rarest would."""

    def __init__(self, templates: list[tuple[str, str]]):
        counts = [Counter(_terms(t)) for _, t in templates]
        df = Counter(term for c in counts for term in c)
        n = len(templates)
        self.other = math.log(1 + n) + 1
        self.idf = {term: math.log((1 + n) / (1 + k)) + 1 for term, k in df.items()}
        self.names = [name for name, _ in templates]
        self.sizes = [sum(c.values()) for c in counts]
        self.vectors = []
        for c in counts:
            raw = {term: k * self.idf[term] for term, k in c.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors.append({term: v / norm for term, v in raw.items()})

    def telling(self, threshold: float) -> list[str]:
        """Terms of which every text holds one that states a licence: shares two terms of a template, not of prose alone, and has at least this cosine.

        By Cauchy and Schwarz a text's cosine is at most the norm of the template's part that it shares. So terms
        are taken, those that serve most templates first, until what is left of each template could not be a
        statement or stays below the threshold.
        """
        chosen: set[str] = set()
        while True:
            left = [{t: x for t, x in v.items() if t not in chosen} for v in self.vectors]
            open_ = [v for v in left if len(v) > 1 and v.keys() - PROSE and sum(x * x for x in v.values()) >= (threshold - 1e-9) ** 2]
            if not open_:
                return sorted(chosen)
            serves: dict[str, float] = {}
            for v in open_:
                for t in v.keys() - PROSE:
                    serves[t] = serves.get(t, 0.0) + v[t] ** 2
            chosen.add(max(serves, key=lambda t: (t[0].isalpha(), serves[t], t)))


def holds_one(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms occurs in the text, if only as part of a word. The text is lowered once."""
    some = F.transform(F.array(F.lower(text)), lambda low: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))
    return F.element_at(some, 1)


def windows(units: DataFrame, weights: Weights, telling: list[str], threshold: float) -> DataFrame:
    """unit, line: the runs of a unit of as many terms as a template has that can reach the threshold.

    Such a run holds a telling term, so only runs around those are formed; the bound on the terms that a run
    shares with any template of its size decides which are scored.
    """
    terms = units.select(F.col("line").alias("unit"), terms_of("line").alias("terms"))
    sizes = []
    for n in sorted(set(weights.sizes)):  # the larger parts of the templates of a size bound each of them
        bound: dict = {}
        for v in (v for v, k in zip(weights.vectors, weights.sizes) if k == n):
            bound |= {t: max(bound.get(t, 0.0), x * x) for t, x in v.items()}
        parts = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(x).alias("part")) for t, x in sorted(bound.items())])
        sizes.append(F.struct(F.lit(n).alias("n"), parts.alias("parts")))
    known = F.array(*[F.lit(t) for t in telling])
    n = F.col("n")
    # terms are bound once: as a column they would be worked out anew for each position
    told = terms.withColumn("at", F.get(F.transform(F.array("terms"), lambda ts: F.filter(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1))), lambda i: F.array_contains(known, F.get(ts, i - 1)))), F.lit(0))).where(F.size("at") > 0)
    fit = told.select("unit", "terms", "at", F.explode(F.array(*sizes)).alias("s")).select("unit", "terms", "at", "s.*").where(F.size("terms") > n)
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(i - n + 1, F.lit(1)), F.least(i, F.size("terms") - n + 1)))))
    # a run is cut where the terms are: rows that carried all terms beside each run would grow with their square
    runs = fit.select("unit", "parts", F.explode(F.transform(starts, lambda at: F.slice("terms", at, n))).alias("run"))
    share = F.aggregate("parts", F.lit(0.0), lambda held, x: held + F.when(F.array_contains(F.col("run"), x["term"]), x["part"]).otherwise(0.0))
    return runs.where(share >= threshold**2 - 1e-9).select("unit", F.array_join("run", " ").alias("line")).distinct()


def score_lines(lines: DataFrame, weights: Weights, threshold: float, same_size: bool = False) -> DataFrame:
    """line, license, score, template: the best template of each distinct line, where its cosine reaches the threshold.

    A line that shares but one term with a template, or terms of prose alone, states nothing by it.

    same_size: of the templates with as many terms as the line.
    """
    spark = lines.sparkSession
    entries = [(term, k, v * weights.idf[term], weights.sizes[k]) for k, vector in enumerate(weights.vectors) for term, v in vector.items()]
    table = F.broadcast(spark.createDataFrame(entries, "term string, template int, weight double, size int"))  # the templates: of fixed size
    idf = F.broadcast(spark.createDataFrame(sorted(weights.idf.items()), "term string, idf double"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(weights.names)), "template int, license string"))
    terms = lines.select("line", F.explode(terms_of("line")).alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(idf, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(weights.other)))
    # one pass over a line's terms gives its norm and all dot products
    met = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("tf").alias("n"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "tf"))).alias("known"))
    shared = met.select("line", "norm", "n", F.explode("known").alias("k")).select("line", "norm", "n", "k.term", "k.tf").join(table, "term")
    dots = (shared.where("n = size") if same_size else shared).groupBy("line", "norm", "template").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("shared"), F.max((~F.col("term").isin(*sorted(PROSE))).cast("int")).alias("tells")).where("shared > 1 and tells = 1")
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = dots.select("line", "template", cosine.alias("score")).where(F.col("score") >= threshold).groupBy("line").agg(F.max(F.struct("score", (-F.col("template")).alias("t"))).alias("b"))
    return best.select("line", F.col("b.score").alias("score"), (-F.col("b.t")).alias("template")).join(names, "template").select("line", "license", "score", "template")


def scan_licenses(files: DataFrame, id_col: str, path: Column, text_col: str = "text", license_file: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per file: id, path, own_license, own_score, license, inherited_from.

    A file's own licence is that of its line or sentence with the highest cosine to a template (ties: the template
    that comes first). A sentence may run over lines; of a longer line or sentence, runs of as many terms as a
    template has are compared with the templates of that size too, so wrapped headers, licence files and embedded
    statements count. A line with an SPDX tag has the licence that the tag names, with score 1. Function words are
    no terms, and one shared term, or several of prose alone, make no statement. A file without an own licence inherits from the nearest directory above it that has a licence file
    with one (license_file: by default by name); of several in one directory the smallest path counts.
    inherited_from is that directory, null where nothing is inherited.

    Null and empty texts have no own licence; a null path has no directory. Repeated rows are reported each.
    An empty table gives no rows; other columns are ignored. Lines are scored once however many files hold
    them, and directories are resolved once however many files they hold.
    """
    weights = Weights(templates)
    telling = weights.telling(threshold)
    signs = [t for t in [*telling, "spdx-license"] if not any(o != t and o in t for o in telling)]  # one that holds another says nothing new
    rows = files.select(F.col(id_col).alias("_id"), path.alias("path"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    some = rows.where(holds_one(F.col("_text"), signs))
    sentences = F.split(F.regexp_replace(F.regexp_replace("_text", SENTENCE, f"$1{CUT}$2"), PARAGRAPH, CUT), CUT)
    units = F.array_distinct(F.filter(F.concat(F.split("_text", "\n"), sentences), lambda x: holds_one(x, signs)))
    held = materialise(some.select("_id", "path", "_hash", F.explode(units).alias("line")))
    lines = held.select("line").distinct()
    scored = score_lines(lines, weights, threshold)
    cut = materialise(windows(lines, weights, telling, threshold))
    inside = cut.join(score_lines(cut.select("line").distinct(), weights, threshold, same_size=True), "line").select(F.col("unit").alias("line"), "license", "score", "template")
    scored = scored.unionByName(inside)
    tagged = held.select("line", F.regexp_extract("line", SPDX, 1).alias("tag")).where("tag <> ''").distinct()
    tags = tagged.select("line", F.regexp_replace("tag", "(?i)-(only|or-later)(?![a-z0-9.+-])", "").alias("license"), F.lit(1.0).alias("score"), F.lit(-1).alias("template"))
    scored = scored.join(tags.select("line"), "line", "left_anti").unionByName(tags)
    found = held.join(scored, "line").groupBy("_id", "path", "_hash").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("b"))
    own = materialise(found.select("_id", "path", "_hash", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score")))

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_license = license_file if license_file is not None else F.col("path").rlike(LICENSE_FILE)
    declared = own.where(is_license).groupBy(folder.alias("at")).agg(F.min(F.struct("path", "own_license")).alias("d")).select("at", F.col("d.own_license").alias("declared"))
    folders = rows.select(folder.alias("folder")).where("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(declared, "at").groupBy("folder").agg(F.max(F.struct("depth", "at", "declared")).alias("n")).select("folder", F.col("n.at").alias("at"), F.col("n.declared").alias("declared"))
    nearest = few(materialise(nearest))

    keyed = rows.select("_id", "path", "_hash", folder.alias("folder"))
    mine = few(own).alias("o")
    same = keyed["_id"].eqNullSafe(F.col("o._id")) & keyed["path"].eqNullSafe(F.col("o.path")) & (keyed["_hash"] == F.col("o._hash"))
    with_own = keyed.join(mine, same, "left").select(keyed["_id"], keyed["path"], "folder", "own_license", "own_score")
    out = with_own.join(nearest, "folder", "left")
    return out.select(
        F.col("_id").alias(id_col), "path", "own_license", "own_score", F.coalesce("own_license", "declared").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("at")).alias("inherited_from"),
    )


#: Rows of a lookup table that may be broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def few(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows are few."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table

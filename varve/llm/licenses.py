"""Licence scan: sparse TF-IDF cosine of text lines to templates, and inheritance from the nearest directory.

Everything is DataFrame operations. Each line of a text is compared, each run of up to RUN successive lines with a term,
each block (lines between lines without a term) and the whole text: terms are weighted by term frequency and inverse
document frequency (texts with the term, of all texts, for every term). What can't reach the threshold by the templates'
term weights is left out early, and so are runs that score higher without their first or last line; this loses nothing.
A file's licence is that of its best line, run, block or whole, so a header that is wrapped over lines counts by
itself, whatever comes before and after it. Licences have a short notice, most a header in full too; the better one
counts. A file without a licence takes that of the nearest directory above it that has a licence file, by joining the
paths of all directories above it.

Rows: null or empty texts have no licence of their own but inherit. A null path has no directory and inherits
nothing. Of several licence files in one directory the smallest path counts, and of equal scores the smallest
template name. Repeated rows get the same result each; rows of one id and path with different texts get the best of
them. An empty table gives an empty result. Columns of files other than id, path and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

# Short notices by which licences are declared, by licence name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
}
# Headers by which files are put under a licence, in full.
HEADERS = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
}
# Other wordings of short notices, so that licences of one family differ in their names only.
WORDINGS = {
    "GPL-3.0": "Licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
}
LEAST_COSINE = 0.6
#: Lines with a term in a run; longer notices are found by their block or as a whole text.
RUN = 32
#: Terms in more than this share of all texts are told from rarer ones where they are at most MOST_FREQUENT. This only
#: decides how early a candidate is left out.
FREQUENT, MOST_FREQUENT = 1 / 20, 5000
#: Steps (of a factor of two) in which the terms' largest gains are told apart.
STEPS = 6


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def notices() -> list[tuple[str, str]]:
    return [*TEMPLATES.items(), *HEADERS.items(), *WORDINGS.items()]


def _templates(spark: SparkSession, said: list[tuple[str, str]]) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("notice"), F.lit(name).alias("license"), F.lit(v).alias("said")) for k, (name, v) in enumerate(said)])).alias("x")).select("x.*")
    return rows.select("notice", "license", F.explode(terms(F.col("said"))).alias("term")).groupBy("notice", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def units() -> Column:
    """What of a text is compared beside runs: each line, each block (lines between lines without a term) and the whole text."""
    return F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[^\\p{L}\\p{N}]*\n"), F.array("text")))


class Bounds:
    """What terms can add to a cosine at most. The product with a template is at most the sum of each known term's idf times
    its largest weight in any template (gain); the squared norm is at least the sum of each term's squared idf (square),
    where a term that no template has counts as 1 if it is frequent and as the least of the rarer ones if not. Known terms
    are put in steps by their gain, with the largest gain and the least square of the step."""

    def __init__(self, known: list, frequent: list[str] | None, rare_square: float):
        self.words, self.frequent, self.rare = [r["term"] for r in known], frequent, rare_square
        top = max((r["gain"] for r in known), default=1.0)
        steps: dict[int, list] = {}
        for r in known:
            steps.setdefault(min(int(math.log2(top / max(r["gain"], 1e-300))), STEPS), []).append(r)
        self.steps = [([r["term"] for r in rows], max(r["gain"] for r in rows), min(r["square"] for r in rows)) for _, rows in sorted(steps.items())]

    def counts(self, found: Column) -> Column:
        """What is added up over lines: terms of each step (s0, s1, ...) and the square of the others."""

        def told(known: Column) -> Column:
            among = lambda words: F.size(F.filter(known, lambda t: t.isin(words)))
            steps = [among(words).cast("double").alias(f"s{k}") for k, (words, _, _) in enumerate(self.steps)]
            others = F.size(found) - F.size(known)
            often = others if self.frequent is None else F.size(F.filter(found, lambda t: t.isin(self.frequent))) if self.frequent else F.lit(0)
            return F.struct(*steps, (often + (others - often) * F.lit(self.rare)).cast("double").alias("other"))

        return _with(F.filter(found, lambda t: t.isin(self.words)), told)

    def bound(self, counts: Column) -> Column:
        """gain and square of counts. Of n terms of a step that has m, the squared counts add up to n^2 / m at least."""
        steps = [(counts[f"s{k}"], len(words), g, q) for k, (words, g, q) in enumerate(self.steps)]
        gain = reduce(lambda a, b: a + b, (n * F.lit(g) for n, _, g, _ in steps), F.lit(0.0))
        square = reduce(lambda a, b: a + b, (F.greatest(n * F.lit(q), n * n * F.lit(q / m)) for n, m, _, q in steps), counts["other"])
        return F.struct(gain.alias("gain"), square.alias("square"))

    def fields(self) -> list[str]:
        return [*(f"s{k}" for k in range(len(self.steps))), "other"]


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(lines: Column, sums: Column, bounds: Bounds, least: float) -> Column:
    """First line and length of each run of two lines or more that may be the best of its text; sums has each line's counts
    and bound. A run reaches a cosine of least only if its gain is least times the root of its square at least. Without an
    end line of more square than 2 gain(line) gain(run) / least^2 it would score higher, so such a run is left out: the
    shorter one is compared."""
    c = least - 1e-6
    names = bounds.fields()
    kind = f"struct<{','.join(f'{f}:double' for f in names)},n:int,found:array<int>>"

    def from_line(i: Column) -> Column:
        first = F.get(sums, i)
        start = F.struct(*(first["counts"][f].alias(f) for f in names), F.lit(1).alias("n"), F.array().alias("found")).cast(kind)

        def add(s: Column, line: Column) -> Column:
            whole = F.struct(*((s[f] + line["counts"][f]).alias(f) for f in names))

            def grown(run: Column) -> Column:
                def judged(b: Column) -> Column:
                    most = F.lit(2 / (c * c)) * b["gain"]
                    kept = (line["bound"]["gain"] > 0) & (b["gain"] >= F.lit(c) * F.sqrt(b["square"])) & (first["bound"]["square"] <= most * first["bound"]["gain"]) & (line["bound"]["square"] <= most * line["bound"]["gain"])
                    found = F.when(kept, F.array_append(s["found"], s["n"] + 1)).otherwise(s["found"])
                    return F.struct(*(run[f].alias(f) for f in names), (s["n"] + 1).alias("n"), found.alias("found")).cast(kind)

                return _with(bounds.bound(run), judged)

            return _with(whole, grown)

        lengths = F.aggregate(F.slice(sums, i + 2, RUN - 1), start, add, lambda s: s["found"])
        return F.transform(F.when(first["bound"]["gain"] > 0, lengths).otherwise(F.array().cast("array<int>")), lambda n: F.struct(i.alias("at"), n.alias("n")))

    places = F.when(F.size(lines) > 1, F.sequence(F.lit(0), F.size(lines) - 2)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, from_line))


def scan(files: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", least: float = LEAST_COSINE) -> DataFrame:
    """id, path, license and cosine of each file of which a line, a run, a block or the whole matches a template. files: id,
    path, text. templates: a notice of each licence; unless given, all of notices()."""
    spark = files.sparkSession
    wanted = _templates(spark, list(templates.items()) if templates else notices())
    texts = files.select(F.col(id_col).alias("id"), "path", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = texts.count()
    seen = cut(texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    idf = F.log((n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weights = wanted.join(seen.join(F.broadcast(wanted.select("term").distinct()), "term"), "term", "left").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weights = cut(weights.join(norms, "notice").select("notice", "license", "term", "idf", (F.col("w") / F.col("t_norm")).alias("t_w")), "weights")
    known = weights.groupBy("term").agg((F.max("t_w") * F.first("idf")).alias("gain"), F.first(F.col("idf") * F.col("idf")).alias("square")).collect()  # bounded by the templates
    often = seen.filter(F.col("df") > n * FREQUENT).join(F.broadcast(weights.select("term").distinct()), "term", "left_anti").select("term").limit(MOST_FREQUENT + 1).collect()
    frequent = [r["term"] for r in often] if len(often) <= MOST_FREQUENT else None
    bounds = Bounds(known, frequent, (math.log((n + 1.0) / (n * FREQUENT + 1)) + 1) ** 2)
    may_reach = lambda b: (b["gain"] > 0) & (b["gain"] >= F.lit(least - 1e-6) * F.sqrt(b["square"]))
    whole = texts.select("id", "path", F.explode(F.transform(units(), terms)).alias("terms")).filter(_with(_with(bounds.counts(F.col("terms")), bounds.bound), may_reach))
    by_line = texts.select("id", "path", F.filter(F.transform(F.split("text", "\n"), terms), lambda t: F.size(t) > 0).alias("lines")).filter(F.size("lines") > 1)
    by_line = by_line.withColumn("sums", F.transform("lines", lambda t: _with(bounds.counts(t), lambda n: F.struct(n.alias("counts"), bounds.bound(n).alias("bound")))))
    runs = by_line.select("id", "path", "lines", F.explode(_runs(F.col("lines"), F.col("sums"), bounds, least)).alias("run")).select("id", "path", F.flatten(F.slice("lines", F.col("run.at") + 1, F.col("run.n"))).alias("terms"))
    lines = cut(whole.unionByName(runs).withColumn("line_id", F.monotonically_increasing_id()), "lines")
    per = cut(lines.select("line_id", F.explode("terms").alias("term")).groupBy("line_id", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    few = cut(per.select("term").distinct().join(seen, "term").select("term", idf.alias("idf")), "few")
    per = per.join(few, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = per.groupBy("line_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = per.join(F.broadcast(weights.drop("idf")), "term").groupBy("line_id", "notice", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    best = dots.join(norm, "line_id").withColumn("cosine", F.floor(F.col("dot") / F.col("norm") * 1e9 + 0.5) / 1e9).filter(F.col("cosine") >= least)
    best = best.groupBy("line_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    hits = lines.select("line_id", "id", "path").join(best, "line_id")
    per_file = hits.groupBy("id", "path").agg(F.min("b").alias("b"))
    return per_file.select(F.col("id").alias(id_col), "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directories(path: Column) -> Column:
    """All directories above a path, the nearest first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    up = F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, depth - k), "/"))
    return F.when(depth > 0, up)


def inherit(files: DataFrame, own: DataFrame, is_licence_file: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per file: id, path, license, cosine (null if inherited), from_path (the licence file), inherited."""
    own = cut(own, "own").withColumn("depth", F.size(F.split("path", "/")))
    directory = F.regexp_replace("path", "/[^/]*$", "")
    placed = own.filter(is_licence_file & F.col("path").contains("/")).groupBy(directory.alias("dir")).agg(F.min(F.struct("path", "license")).alias("f"))
    placed = cut(placed.select("dir", F.col("f.path").alias("from_path"), F.col("f.license").alias("dir_license")), "placed")
    mine = own.select(F.col(id_col).alias("own_id"), F.col("path").alias("own_path"), F.col("license").alias("own_license"), "cosine")
    rows = files.select(F.col(id_col).alias("id"), "path").withColumn("rid", F.monotonically_increasing_id())
    rows = cut(rows.join(mine, F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").drop("own_id", "own_path"), "rows")
    # the directories that occur are far fewer than the files: the nearest is found once for each
    dirs = rows.filter(F.col("own_license").isNull() & F.col("path").contains("/")).select(directory.alias("dir")).distinct()
    above = dirs.select(F.col("dir").alias("of"), F.posexplode(directories(F.concat("dir", F.lit("/x")))).alias("up", "dir"))
    nearest = above.join(placed, "dir").groupBy("of").agg(F.min(F.struct("up", "from_path", "dir_license")).alias("n"))
    nearest = cut(nearest.select(F.col("of").alias("dir"), "n.from_path", "n.dir_license"), "nearest")
    out = rows.withColumn("dir", F.when(F.col("own_license").isNull() & F.col("path").contains("/"), directory)).join(nearest, "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own_license", "dir_license").alias("license"), "cosine", F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("from_path")).alias("from_path"), (F.col("own_license").isNull() & F.col("dir_license").isNotNull()).alias("inherited"))

"""Operator 6: licences of files by TF-IDF cosine to templates, inherited along directories.

Units are compared: the lines of a file that mention a licence (its header, wherever
it stands), and the whole text of a licence file. Equal units are compared once,
however many files hold them. A term weighs (1 + ln tf) · idf with idf over
all units and templates; the terms of a unit meet those of the templates in a join, so
only terms that occur count. A unit has the licence of the most similar
template, from ``LEAST`` on.

A file has the licence of its best unit; else that of the licence file in the
nearest directory above it (its own included). Ties go to the licence that is
first by name. Null paths and texts have no licence; repeated paths are one file,
returned as often as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import skew_join
from pageloom.session import materialize

LEAST = 0.5
HINT = r"(?i)\b(licen[cs]ed?|copyright|spdx|copyleft|public domain|all rights reserved)\b"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([-._][^/]*)?$"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

# Statements and opening words of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _terms(units: DataFrame, key: str, text: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return units.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def match_units(units: DataFrame, least: float = LEAST) -> DataFrame:
    """``(unit, license, score)`` of ``(unit, files)``; ``files`` is how many hold the unit."""
    spark = units.sparkSession
    units = units.withColumn("id", F.sha2("unit", 256))
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    own = materialize(_terms(units, "id", "unit"), "unit-terms")
    model = _terms(templates, "template", "text")
    total = (units.agg(F.sum("files")).head()[0] or 0) + len(TEMPLATES)
    seen = own.join(units.select("id", "files"), "id").groupBy("term").agg(F.sum("files").alias("df"))
    seen = seen.union(model.groupBy("term").agg(F.count("*"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = materialize(
        seen.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")), "idf"
    )
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    heavy = own.join(idf, "term").select("id", "term", weight)
    light = model.join(idf, "term").select("template", "term", weight)
    unit_norm = heavy.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    model_norm = light.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    # The templates' terms are a fixed list of some hundred rows.
    dots = heavy.join(F.broadcast(light.withColumnRenamed("w", "m")), "term").groupBy("id", "template")
    dots = dots.agg(F.sum(F.col("w") * F.col("m")).alias("dot")).join(unit_norm, "id")
    scored = dots.join(F.broadcast(model_norm), "template").join(F.broadcast(templates.drop("text")), "template")
    scored = scored.select("id", "license", F.round(F.col("dot") / F.col("norm") / F.col("size"), 9).alias("score"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = best.where(-F.col("b.s") >= least).select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    return units.join(best, "id").select("unit", "license", "score")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``(path, license, score, how, from_dir)`` for every row of ``(path, text)``.

    ``how`` is header, file (a licence file) or inherited; null without a licence.
    """
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(HINT))
    units = rows.where("path is not null").select("path", is_file.alias("whole"), F.explode(
        F.when(is_file & (F.trim("text") != ""), F.array("text")).otherwise(lines)
    ).alias("unit"))
    units = materialize(units.distinct(), "license-units")
    known = match_units(units.groupBy("unit").agg(F.count("*").alias("files")), least)
    found = skew_join(units, known, ["unit"], "inner").groupBy("path", "whole")
    best = found.agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = materialize(best.select("path", "whole", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "own-licenses")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    of_folder = own.where("whole").select(folder.alias("dir"), "license", "score").groupBy("dir")
    given = of_folder.agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    given = given.select("dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    open_paths = rows.where("path is not null").select("path").distinct().join(own.select("path"), "path", "left_anti")
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ways = open_paths.select("path", F.explode(F.array_distinct(above)).alias("dir"))
    nearest = skew_join(ways, given, ["dir"], "inner").groupBy("path").agg(
        F.max_by(F.struct("license", "score", "dir"), F.length("dir")).alias("n")
    )
    inherited = nearest.select("path", "n.license", "n.score", F.lit("inherited").alias("how"), F.col("n.dir").alias("from_dir"))
    direct = own.select(
        "path", "license", "score", F.when(F.col("whole"), "file").otherwise("header").alias("how"), F.lit(None).cast("string").alias("from_dir")
    )
    return skew_join(rows.select("path"), direct.union(inherited), ["path"])

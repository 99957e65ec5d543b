"""License scans: units of text against license templates by the Dice coefficient of word bigrams.

Text and templates are normalised alike: lower-cased, and every run of other characters than
ASCII letters and digits becomes a blank. The units of a text are its lines, its blocks
between blank lines, and the text as a whole. The Dice coefficient of two sets of bigrams of
a and b elements is at most 2 min(a, b) / (a + b), so a unit is only compared with templates
of between (t / (2 - t)) and ((2 - t) / t) times its size for a threshold t; units outside
all these bounds are dropped before any bigram is made. As repeats make a set smaller than
its number of words, the lower bound is tested on the words and both on the bigrams.

Column expressions only, in the row of the text: no shuffle and no join. The templates are
part of the plan.

Cases: null and empty texts and units of fewer than two words have no bigrams and match
nothing; of templates with equal coefficients the first by name is the best; repeated rows
are scanned row by row. Only the text column is read; result columns replace columns of the
same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import bind

RESULT = ["license", "dice", "licenses", "n_hits", "n_compared"]

#: Notices and short texts by license. Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, by the rule that the texts are normalised by."""
    words = re.findall("[0-9a-z]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^0-9a-z\n]+", " ")


def _units(normal: Column) -> Column:
    """Word arrays of the lines, the blocks and the whole of a normalised text."""
    parts = bind(F.split(normal, "\n(?: *\n)+"), lambda blocks: F.concat(
        F.split(normal, "\n"), blocks, F.when(F.size(blocks) > 1, F.array(normal)).otherwise(F.array().cast("array<string>"))))
    return F.transform(parts, lambda p: F.array_remove(F.split(F.translate(p, "\n", " "), " "), ""))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(
        F.slice(words, 2, F.size(words)), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))


def scan(
    documents: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    threshold: float = 0.8,
    templates: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The ``keep`` columns with the best license and its coefficient, all licenses found, and counts.

    ``n_hits`` are pairs of unit and template at the threshold, ``n_compared`` the pairs inside the bounds.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c not in RESULT]
    sets = [(name, b) for name, texts in sorted((templates or TEMPLATES).items()) for b in map(template_bigrams, texts) if b]
    sizes = [len(b) for _, b in sets]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    index = F.expr("array(" + ", ".join(
        f"named_struct('name', '{name}', 'n', {len(b)}, 'b', array(" + ", ".join(f"'{x}'" for x in b) + "))" for name, b in sets) + ")")

    def compare(grams: Column) -> Column:
        near = F.filter(index, lambda t: F.size(grams).between(F.ceil(t["n"] * low - 1e-9), F.floor(t["n"] * high + 1e-9)))
        return F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(grams, t["b"])) / (F.size(grams) + t["n"])).alias("dice"), t["name"].alias("name")))

    # A unit of n words has at most n - 1 bigrams; too short for every template means no match.
    least = min(sizes) * low
    compared = F.flatten(F.transform(
        F.filter(_units(F.col("_normal")), lambda w: F.size(w) - 1 >= least),
        lambda w: bind(_bigrams(w), compare)))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), _normal(F.coalesce(F.col(text_col), F.lit(""))).alias("_normal"))
    found = rows.select("_row", bind(compared, lambda all_of: bind(
        F.filter(all_of, lambda p: p["dice"] >= threshold), lambda hits: F.struct(
            F.size(all_of).alias("n"), hits.alias("hits")))).alias("_f"))
    top = F.array_max(F.transform(F.col("_f.hits"), lambda p: p["dice"]))
    return found.select(
        *[F.col("_row").getField(c).alias(c) for c in keep], F.col("_f.hits").alias("_hits"), F.col("_f.n").alias("_n"), top.alias("dice"),
    ).select(
        *keep,
        F.array_min(F.transform(F.filter("_hits", lambda p: p["dice"] == F.col("dice")), lambda p: p["name"])).alias("license"), "dice",
        F.array_sort(F.array_distinct(F.transform("_hits", lambda p: p["name"]))).alias("licenses"),
        F.size("_hits").cast("long").alias("n_hits"), F.col("_n").cast("long").alias("n_compared"))

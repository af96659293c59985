"""Operator 2: known license texts inside documents, found through MinHash bands of windows.

DataFrame functions only. A window is two overlapping five-word shingles (six words), one
begins at every word. For each of SEEDS hash functions the lesser value of the window's
shingles is a band; a band that some template window also has retrieves that template, and
no template is looked at without. A window of a template makes the same bands as the same words in a text, so
an unbroken copy of two shingles or more collides surely; a shingle alone among other
words is the lesser one in one of its two windows with a chance of 2/3 for each function:
1 - 3**-6 = 99.9 %. Candidates are then confirmed by the exact share of the template's
shingles that the text holds.

Long texts and notices are collected as passages, each a template of its own, so that an
edited copy still holds most of them. A template's name is the license, a slash and which
wording or passage it is; ``license_names`` gives the licenses alone.
"""

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
CONTAINED = 0.8
SEEDS = [0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, -0x64FA9873BB67AE86, 0x3C6EF372FE94F82B, -0x5AB00AC5A54FF53A, 0x510E527FADE682D1]
# A row of all template bands goes to every task; larger collections are scanned in several calls.
MOST_BANDS = 200_000

# Words of a passage; one changed word costs 5 of some 50 shingles, so up to two may change and the passage still counts.
PASSAGE = 50
# Shingles and bands are looked up by their lowest bits.
BUCKETS = 1 << 16

# License notices as their publishers word them.
SHORT = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

LONGER = {
    "agpl-3.0/notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3.0/network": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network",
    "lgpl/notice": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl/library-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "gpl/notice-semicolon": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0/where": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "apache-2.0/as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd/style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mit/style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    "cc0-1.0/waiver": "the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "unlicense/dedication": "This is free and unencumbered software released into the public domain",
    "wtfpl/notice": "This program is free software. It comes without any warranty, to the extent permitted by applicable law",
    "epl-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-1.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "ofl-1.1/notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
}
# What a license is called in one-line notices.
NAMES = {
    "mit": ["the MIT License", "an MIT License", "the terms of the MIT License", "the Expat License"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License v2.0", "the Apache Software License 2.0"],
    "bsd": ["the BSD License", "a BSD-style license", "the modified BSD License", "the simplified BSD License"],
    "bsd-2-clause": ["the BSD 2-Clause License", "the 2-clause BSD License", "the two-clause BSD License"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the 3-clause BSD License", "the three-clause BSD License", "the New BSD License"],
    "isc": ["the ISC License", "the terms of the ISC License"],
    "0bsd": ["the Zero-Clause BSD License", "the 0BSD License"],
    "zlib": ["the zlib License", "the zlib/libpng License"],
    "bsl-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "unlicense": ["the Unlicense License", "the terms of the Unlicense"],
    "artistic": ["the Artistic License", "the Artistic License 2.0", "the same terms as Perl itself"],
    "gpl": ["the GNU General Public License", "the GNU GPL License", "the GPL License"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL version 2", "the GNU GPL v2", "the GPL version 2", "the GPLv2 License"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL version 3", "the GNU GPL v3", "the GPL version 3", "the GPLv3 License"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU LGPL License", "the LGPL License"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1", "the LGPL v2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3", "the LGPLv3 License"],
    "agpl-3.0": ["the GNU Affero General Public License", "the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3", "the AGPL version 3", "the AGPLv3 License"],
    "mpl-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"],
    "mpl-1.1": ["the Mozilla Public License, version 1.1", "the Mozilla Public License 1.1"],
    "epl": ["the Eclipse Public License", "the Eclipse Public License v2.0", "the Eclipse Public License v1.0"],
    "gfdl": ["the GNU Free Documentation License", "the GNU Free Documentation License, version 1.3"],
    "ofl-1.1": ["the SIL Open Font License", "the SIL Open Font License, Version 1.1"],
    "wtfpl": ["the Do What The Fuck You Want To Public License"],
    "cc0-1.0": ["CC0 1.0 Universal", "the CC0 1.0 License", "CC0 1.0", "the Creative Commons Zero License", "the Creative Commons CC0 1.0 Universal"],
} | {
    f"cc-{short.lower().replace(' ', '-')}-{version}": [
        f"CC {short} {version}", f"a CC {short} {version} License", f"the CC {short} {version} License",
        *[f"{which} Creative Commons {long} {version} {scope}License" for which in ("a", "the") for scope in ("International ", "Unported ", "")],
    ]
    for version in ("3.0", "4.0")
    for short, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
}
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")


def wordings() -> dict[str, str]:
    """One-line notices: each verb, "under", each name of a license; those of four words or fewer are no templates."""
    return {f"{key}/{verb}-{i}": f"{verb} under {name}" for key, names in NAMES.items() for i, name in enumerate(names) for verb in VERBS}


def passages() -> dict[str, str]:
    """The whole license texts, cut into passages of PASSAGE words; the last one has up to half as many more."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        words = path.read_text(encoding="utf-8").split()
        starts = list(range(0, max(1, len(words) - PASSAGE // 2), PASSAGE))
        for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
            out[f"{path.stem}/text-{a // PASSAGE + 1:03d}"] = " ".join(words[a:b])
    return out


NOTICES = SHORT | LONGER | wordings() | passages()


def license_names(licenses: Column) -> Column:
    """The licenses of a list of template names joined by commas, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(licenses, ","), lambda n: n != ""), lambda n: F.substring_index(n, "/", 1))))


def constant(values, kind: str) -> Column:
    """One literal for a long list: Spark folds it before the rows are read."""
    text = json.dumps(values, separators=(",", ":"))
    # Long strings reach the JVM slowly.
    return F.from_json(F.concat(*[F.lit(text[at : at + 20_000]) for at in range(0, len(text), 20_000)]), kind)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word runs, words being letters and digits in lower case; none for fewer words."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    runs = F.transform(F.array(words), lambda w: F.when(
        F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    ).otherwise(F.array().cast("array<bigint>")))
    return runs[0]


def bands(shingles: Column, wanted=None) -> Column:
    """Bands of all windows, or of those with a ``wanted`` shingle; a single shingle is a window by itself."""
    rest = F.greatest(F.size(shingles) - 1, F.lit(1))
    before, after = (F.when(F.size(shingles) > 1, F.slice(shingles, start, rest)).otherwise(shingles) for start in (1, 2))
    windows = F.zip_with(before, after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    if wanted is not None:
        windows = F.filter(windows, lambda w: wanted(w["x"]) | wanted(w["y"]))
    lesser = lambda w, seed: F.least(w["x"].bitwiseXOR(F.lit(seed)), w["y"].bitwiseXOR(F.lit(seed)))
    return F.flatten(F.transform(windows, lambda w: F.array(*[lesser(w, seed) for seed in SEEDS])))


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    """license, shingles, bands of each notice of five words or more."""
    rows = spark.createDataFrame(list((NOTICES if notices is None else notices).items()), "license string, notice string")
    return rows.select("license", shingle_hashes(F.col("notice")).alias("made")).select(
        "license", F.array_distinct("made").alias("own"), F.when(F.size("made") > 0, bands(F.col("made"))).alias("bands")
    ).filter("size(own) > 0")


def _bucket(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _buckets(values) -> list[list[int]]:
    """The values by their lowest bits."""
    out: list[list[int]] = [[] for _ in range(BUCKETS)]
    for x in sorted(values):
        out[x & BUCKETS - 1].append(x)
    return out


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, id_column="doc_id", text_column="text", contained=CONTAINED) -> DataFrame:
    """doc_id, n_licenses, licenses (names sorted, joined by commas) of every whole text.

    A notice is in a text if the text holds ``contained`` of its distinct shingles or
    more. A null text, or one with fewer than five words, has none; repeated rows each
    give a row; a null id stays null; notices of fewer than five words are left out;
    other columns are left behind. No exchange: the notices' bands, MOST_BANDS at most,
    are part of the plan.
    """
    known = templates(docs.sparkSession, notices).collect()
    marks = len({b for t in known for b in t["bands"]})
    if marks > MOST_BANDS:
        raise ValueError(f"{marks} bands of notices; scan them in several calls of at most {MOST_BANDS}")
    frame = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    made = frame.select("doc_id", shingle_hashes(F.col("text")).alias("made"))
    if not known:
        return made.select("doc_id", F.lit(0).cast("bigint").alias("n_licenses"), F.lit("").alias("licenses"))
    # A band is a shingle of its window, so a window without any shingle of the templates has no band of theirs:
    # bands are made of the other windows only, and of no window in most texts.
    shingles = {x for t in known for x in t["own"]}
    sieve = constant(_buckets(shingles), "array<array<bigint>>")
    ours = lambda x: F.array_contains(F.get(sieve, _bucket(x)), x)
    made = made.select("doc_id", "made", F.filter("made", ours).alias("hits"))
    some = F.size("hits") > 0
    found = made.select("doc_id", "hits", F.when(some, F.array_distinct(bands(F.col("made"), ours))).alias("met"))
    # The templates that each band retrieves.
    retrieves: dict[int, list[int]] = {}
    for i, t in enumerate(known):
        for band in set(t["bands"]):
            retrieves.setdefault(band, []).append(i)
    buckets = _buckets(retrieves)
    table = constant(buckets, "array<array<bigint>>")
    lists = constant([[retrieves[band] for band in bucket] for bucket in buckets], "array<array<array<int>>>")
    collection = constant([{"license": t["license"], "own": t["own"]} for t in known], "array<struct<license:string,own:array<bigint>>>")

    def retrieved(band):
        place = F.array_position(F.get(table, _bucket(band)), band).cast("int")
        return F.when(place > 0, F.get(F.get(lists, _bucket(band)), place - 1)).otherwise(F.array().cast("array<int>"))

    # Only what a band has retrieved is compared. What a text holds is bound to a variable so that it is made once.
    def confirmed(text):
        enough = lambda t: F.size(F.array_intersect(text["hits"], t["own"])) >= contained * F.size(t["own"]) - 1e-9
        candidates = F.transform(text["ids"], lambda i: F.get(collection, i))
        return F.sort_array(F.transform(F.filter(candidates, enough), lambda t: t["license"]))

    ids = F.array_distinct(F.flatten(F.transform("met", retrieved)))
    names = F.when(some, F.transform(F.array(F.struct(ids.alias("ids"), F.array_distinct("hits").alias("hits"))), confirmed)[0]).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", names.alias("names")).select("doc_id", F.size("names").cast("bigint").alias("n_licenses"), F.array_join("names", ",").alias("licenses"))

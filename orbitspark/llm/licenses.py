"""License scan by MinHash bands over overlapping word windows, then exact shingle containment; DataFrame operations only.

Words are lower-cased and freed of punctuation. Each word is hashed once, and the hash of a 5-word shingle is made from
those of its words. Texts are cut into windows of four shingles that overlap by half; templates have a window at every
place. The smallest and the largest hash of a window are its MinHashes under two opposite orders, each a band of one
row. Two windows of Jaccard similarity j share a given band with probability j, so at least one of the two with
probability j or more (about 1 - (1 - j)^2), and equal windows share both with certainty.

A template of m >= 7 shingles, of which 80 per cent are present, keeps a run of at least 6 in a row, as each changed
word takes 5 shingles: such a run holds a whole window of the text, so that it is retrieved with certainty. Templates
of fewer shingles than a window are retrieved by single shingles, those of fewer than five words by their whole
sequence. Retrieved pairs are verified on the words themselves: the largest number of distinct template shingles within
a stretch of 1.25 times the template's length, by the number of its shingles. All this happens within a row, so that
nothing but results is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm.common import WORD_BREAK

#: Notices by name. Callers may pass their own.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Characters taken out of words.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#/\\_-"
WIDTH, WINDOW, STEP, LEAST = 5, 4, 2, 0.8
#: Templates of a call at most, so that what is sent to every task is bounded.
MOST_TEMPLATES = 500
NO_LONGS = "cast(array() as array<bigint>)"


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    found = {}
    for name, text in templates.items():
        words = [w for w in re.split(WORD_BREAK, text.lower().translate({ord(c): None for c in PUNCTUATION})) if w]
        if words:
            k = min(WIDTH, len(words))
            found[name] = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return found


def words_of(text: Column) -> Column:
    """Words without punctuation, in lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[" + re.escape(PUNCTUATION) + "]+", "")
    return F.filter(F.split(plain, WORD_BREAK), lambda w: w != "")


def shingle_hashes(table: DataFrame, widths: list[int]) -> DataFrame:
    """table (with words) with a column h<k> for each width: hashes of the k-word shingles, made of the words' own."""
    table = table.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))

    def joined(a: int, b: int) -> Column:
        """Shingles of a and then b words."""
        n = F.greatest(F.size("h1") - (a + b - 1), F.lit(0))
        return F.zip_with(F.slice(F.col(f"h{a}"), 1, n), F.slice(F.col(f"h{b}"), F.lit(a + 1), n), lambda x, y: F.xxhash64(x, y))

    for k in range(2, WIDTH + 1):
        # 4 = 2 + 2, else one word more
        if k in widths or k in (2, 4) and max(widths) > k:
            table = table.withColumn(f"h{k}", joined(2, 2) if k == 4 else joined(k - 1, 1))
    return table


def window_keys(hashes: Column, step: int) -> tuple[Column, Column]:
    """The two bands of the windows that begin at every step-th shingle: their smallest and their largest hashes."""
    starts = F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1, F.lit(step))

    def band(pick) -> Column:
        return F.when(F.size(hashes) >= WINDOW, F.transform(starts, lambda i: pick(F.slice(hashes, i, WINDOW)))).otherwise(F.expr(NO_LONGS))

    return band(F.array_min), band(F.array_max)


def template_keys(spark: SparkSession, templates: dict[str, str]) -> dict[str, dict[int, list[str]]]:
    """Templates by retrieval key, for each column that keys are looked up in: h<k>, low and high."""
    shingles = template_shingles(templates)
    rows = [(n, " ".join([s[0], *(x.rsplit(" ", 1)[-1] for x in s[1:])]).split(" ")) for n, s in shingles.items()]
    widths = sorted({min(WIDTH, len(w)) for _, w in rows} | {WIDTH})
    table = shingle_hashes(spark.createDataFrame(rows, "template string, words array<string>").coalesce(1), widths)
    low, high = window_keys(F.col(f"h{WIDTH}"), 1)
    found: dict[str, dict[int, list[str]]] = {c: {} for c in (*(f"h{k}" for k in widths), "low", "high")}
    for r in table.withColumns({"low": low, "high": high}).collect():
        n = len(r["words"])
        columns = ("low", "high") if n - WIDTH + 1 >= WINDOW else (f"h{min(WIDTH, n)}",)
        for c in columns:
            for key in r[c]:
                found[c].setdefault(key, []).append(r["template"])
    return {c: keys for c, keys in found.items() if keys}


def looked_up(keys: Column, by_key: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.element_at(by_key, k)))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, template, containment, first_word): the templates of which at least `least` is within a text.

    containment is the best stretch's share of the template's distinct shingles, first_word where the earliest such
    stretch begins, counted in words from 0. Texts are scanned whole. Each row is verified by itself; rows that repeat
    an id are one document's rows and reported once, with the best, ties to the earliest word; a null id is reported as
    null; null, empty and wordless texts match nothing, and an empty table gives no rows. Other columns are never read.
    Templates are a small fixed list (at most MOST_TEMPLATES), which goes to every task.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    shingles = template_shingles(templates)
    keys = template_keys(spark, templates) if shingles else {}
    widths = sorted({len(x[0].split(" ")) for x in shingles.values()} | {WIDTH})
    hashed = shingle_hashes(docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")), widths)
    low, high = window_keys(F.col(f"h{WIDTH}"), STEP)
    bands = {"low": low, "high": high}
    met = [F.expr("cast(array() as array<string>)")]
    for c, of in keys.items():
        shared = F.array_intersect(bands.get(c, F.col(c)), F.array(*map(F.lit, sorted(of))))
        by_key = F.create_map(*(x for key, names in of.items() for x in (F.lit(key), F.array(*map(F.lit, sorted(set(names)))))))
        met.append(looked_up(shared, by_key))
    retrieved = hashed.select("doc_id", "words", F.array_distinct(F.concat(*met)).alias("met"))
    # the filter is on what explode_outer gives: one on met would be pushed down and have the hashes made again
    pairs = retrieved.select("doc_id", "words", F.explode_outer("met").alias("template")).where("template is not null")
    rows = [(t, len(x[0].split(" ")), sorted(set(x)), -(-5 * len(x) // 4)) for t, x in shingles.items()]
    sized = spark.createDataFrame(rows, "template string, width int, shingles array<string>, stretch int")
    return verified(pairs.join(F.broadcast(sized), "template"), least)  # at most MOST_TEMPLATES rows


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """The best stretch of each retrieved pair of a row and a template, if it holds at least `least` of the template."""
    starts = F.when(F.size("words") >= F.col("width"), F.sequence(F.lit(0), F.size("words") - F.col("width"))).otherwise(F.expr("cast(array() as array<int>)"))
    each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, F.col("width")), " ").alias("shingle")))
    held = pairs.withColumn("hits", F.filter(each, lambda x: F.array_contains("shingles", x["shingle"]))).drop("words")

    def stretch_from(x: Column, j: Column) -> Column:
        # a stretch of n words has at most n hits, those right after its first
        inside = F.filter(F.slice("hits", j + 1, F.col("stretch")), lambda y: y["at"] < x["at"] + F.col("stretch"))
        share = F.size(F.array_distinct(F.transform(inside, lambda y: y["shingle"]))) / F.size("shingles")
        return F.struct(share.alias("containment"), (-x["at"]).alias("at"))

    best = held.select("doc_id", "template", F.array_max(F.transform("hits", stretch_from)).alias("best"))
    found = best.groupBy("doc_id", "template").agg(F.max("best").alias("best")).where(F.col("best.containment") >= least)
    return found.select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("long").alias("first_word"))

"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of a text's words; its size follows from the template's (``stride``). A template is found in a block if
at least ``THRESHOLD`` of the template's distinct words are among the block's. It gives its label if the phrases that name the license stand in that block too, word by word.
Only texts that hold enough words of some template, wherever they stand, are cut into blocks, as no block of another can. The join is exact: words are ordered by how
many of these texts hold them, rarest first; only the first words of each template are indexed (prefix
filter), blocks with fewer distinct words than needed are passed over (length filter), and a
meeting too late in either order is too (positional filter); what is left is verified.

Also reported are the places where a fixed phrase's words stand consecutively; their labels stay
whatever the join finds.

Defined results: null texts count as empty: no words, no labels, score 0. Repeated rows are each
reported. Texts of any length are cut into blocks; other columns are not read. Only DataFrame
functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialise

# Phrases, and notices of public licenses.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: (label, phrases that name the license and must all stand in the block, notice or license text). Licenses that share
#: most of their notice with another are told apart by these phrases.
TEMPLATES = [
    ("mit", ["mit license"], "Released under the terms of the MIT License"),
    ("cc-by-nc", ["attribution noncommercial 4 0"], "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", ["attribution noncommercial sharealike 4 0"], "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", ["attribution noncommercial noderivatives 4 0"], "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    ("cc-by-sa", ["attribution sharealike 4 0"], "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", ["attribution 4 0 international"], "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", ["permission is hereby granted", "sublicense"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", ["permission to use", "with or without fee"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2", ["apache license version 2 0"], "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *[(label, [f"gnu {name.lower()} public license", "version 3 of the license"], f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") for label, name in (("gpl-3", "General"), ("agpl-3", "Affero General"), ("lgpl-3", "Lesser General"))],
    ("bsd-3", ["neither the name of", "endorse or promote"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
THRESHOLD = 0.8
#: The least stride of blocks, in words.
STRIDE = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def stride(words: int) -> int:
    """How far the blocks for a template of so many words lie apart; a block has twice as many words, so that any passage of
    the template's length lies whole in one."""
    return max(STRIDE, 1 << max(0, words - 1).bit_length())


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def _words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _places(words: Column, n: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return F.coalesce(same, F.lit(False))

    none = F.array().cast("array<int>")
    held = F.forall(F.lit(parts), lambda w: F.array_contains(words, w))
    return F.when((n >= len(parts)) & held, F.filter(F.sequence(F.lit(0), (n - len(parts)).cast("int")), here)).otherwise(none)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: list[tuple[str, list[str], str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and the templates found
    (label, template, first word of its best block, share of the template's words there, whether its naming phrases stand there): all
    that reach the threshold in some block. Labels and score are of those that are named."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    sets = [(label, k, sorted(set(_split(t))), sorted({" ".join(_split(p)) for p in naming}), stride(len(_split(t)))) for k, (label, naming, t) in enumerate(templates) if _split(t)]
    phrases_named = sorted({p for *_, naming, _ in sets for p in naming})
    vocabulary = sorted({w for *_, ws, _, _ in sets for w in ws})
    least = lambda ws: max(1, math.ceil(threshold * len(ws) - 1e-9))
    reached = F.lit(False)
    for *_, ws, _, _ in sets:
        reached = reached | ((F.size("held") >= least(ws)) & (F.size(F.array_intersect(F.lit(ws), F.col("held"))) >= least(ws)))

    base = docs.select(F.col(key), F.xxhash64(text).alias("print"), _words(F.col(text)).alias("words"))
    base = base.withColumn("n", F.size("words").cast("bigint"))
    base = base.withColumns({f"at{k}": _places(F.col("words"), F.col("n"), p) for k, p in enumerate(phrases.values())})
    every = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    base = base.select(key, "print", F.col("n").alias("n_words"), F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
                       F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases)])).alias("base_set"),
                       F.array_intersect(F.lit(vocabulary or [""]), F.col("words")).alias("held"), "words").withColumn("words", F.when(reached, F.col("words"))).drop("held")
    base = materialise(base, "licenses")
    found = base.select(F.explode(F.array_intersect(F.lit(vocabulary), F.col("words"))).alias("w")).groupBy("w").count().collect() if vocabulary else []
    df = {r["w"]: r["count"] for r in found}  # at most one row per word of the templates
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, k, ws, naming, step in sets:
        ws = sorted(ws, key=rank.__getitem__)
        need = least(ws)
        index += [(w, label, k, i, len(ws), need, ws, naming, step) for i, w in enumerate(ws[: len(ws) - need + 1])]
    names = ["token", "label", "template", "i", "size", "need", "words", "naming", "step"]
    none = [("", "", 0, 0, 0, 0, [""], [""], 0)]
    postings = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r)]) for r in index or none]))).where("size > 0")
    steps = F.explode(F.lit(sorted({r[-1] for r in index}) or [STRIDE]))
    blocks = base.where(F.col("words").isNotNull()).select(key, "print", "words", steps.alias("step"))
    blocks = blocks.select(key, "print", "words", "step", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.col("step"))).alias("start"))
    here = F.slice("words", F.col("start") + 1, 2 * F.col("step"))
    line = F.concat(F.lit(" "), F.array_join(here, " "), F.lit(" "))
    told = F.filter(F.lit(phrases_named or [""]), lambda p: F.contains(line, F.concat(F.lit(" "), p, F.lit(" "))))
    blocks = blocks.select(key, "print", "start", "step", F.array_intersect(F.lit(order or [""]), here).alias("own"), told.alias("said"))
    probes = blocks.select(key, "print", "start", "step", "own", "said", F.posexplode("own").alias("j", "token"))
    # The templates are parameters, so their index has a bounded size.
    met = probes.join(F.broadcast(postings), ["token", "step"]).where((F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need")))
    # Shared words are compared as whole numbers: a share times its size can fall short of the words that it came from.
    met = met.withColumn("common", F.size(F.array_intersect("own", F.col("words")))).where(F.col("common") >= F.col("need"))
    # A template without naming phrases asks for none.
    met = met.withColumns({"share": F.col("common") / F.col("size"), "named": F.size(F.array_intersect("said", F.col("naming"))) == F.size("naming"), "back": -F.col("start")})
    best = met.groupBy(key, "print", "label", "template").agg(F.max(F.struct("named", "share", "back")).alias("b"))
    best = best.groupBy(key, "print").agg(F.array_sort(F.collect_set(F.struct("label", "template", (-F.col("b.back")).alias("start"), F.col("b.share").alias("share"), F.col("b.named").alias("named")))).alias("found"), F.max(F.when(F.col("b.named"), F.col("b.share"))).alias("best"))
    best = best.withColumnRenamed(key, "__key").withColumnRenamed("print", "__print")
    joined = base.drop("words").join(best, F.col(key).eqNullSafe(F.col("__key")) & F.col("print").eqNullSafe(F.col("__print")), "left")
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base_set", F.coalesce(F.transform(F.filter("found", lambda x: x["named"]), lambda x: x["label"]), empty))))
    return joined.select(key, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                         F.when(F.size("base_set") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "found")

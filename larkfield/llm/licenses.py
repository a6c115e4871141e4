"""Licence scans: a sparse word n-gram logistic regression over paragraphs, with templates that confirm it.

The driver trains a softmax regression on the template sentences below (with parts left out and words around them) against
paragraphs that are no licence: decoys and a bounded sample of the corpus's lines, of `negatives` documents LINES_EACH runs of LINES_EACH lines, all by
hash, of which training sees LINE_CHARS characters. Its weights are a table of n-grams, a row each; scoring joins the n-grams of candidate paragraphs to it and sums,
with DataFrame functions only. Its last class is `unknown`; a temperature calibrates the probabilities, fitted on variants, decoys and lines kept
out of the fit, none of which has the features of a row in it. A family counts if it beats `unknown`, reaches MIN_PROBABILITY and a template of that family is
contained in the paragraph to MIN_CONTAINED of its word trigrams.

Paragraphs are lines, of any length, and runs of two or more lines between blank ones (without a letter or digit, as a bare comment mark),
joined with their comment marks stripped, so that a wrapped text is found too. A run counts for each family that none of its lines
states, and lines of such a run are not `unknown`. Paragraphs that can't hold
MIN_CONTAINED of any template, by needed_words(), are not scored, but for lines with a trigger word; a line is `unknown` if it has such a
word or holds that much of a template, and no family claims it.

Cases: null and empty texts hold no licence; repeated lines count each; of equally likely classes the first of TEMPLATES' order counts; rows that
repeat a doc_id, a null one too, each get their own text's result; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_of, written

#: Sentences by which licences are stated.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Released under the ISC License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["All rights reserved.", "This document is confidential and proprietary and may not be reproduced without prior written permission."],
}
#: Sentences with the same words that state no licence.
DECOYS = [
    "A driver's license is required to rent a car at the airport.",
    "The version of the report under review was released to the public in May.",
    "The museum is open to the public and free of charge on Sundays.",
    "He studied at MIT before he moved to the Apache reservation.",
    "Permission to land was granted by the tower without restriction.",
    "The foundation published a free software guide for any person with general questions.",
    "The license plate was issued under the terms of the new law.",
    "We reserved all the rooms under the name of the author.",
    "Copyright law is a subject of general interest to the public.",
    "The work was done in the source region with related conditions.",
]
#: Lines that `unknown` counts where no family claims them; it decides no family.
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|redistribut|creative commons|public domain|permission|rights reserved|\bcc0\b|\bcc[ -]by\b|confidential|unencumbered"
TOKENS = r"[a-z0-9]+"
#: Between runs of lines; line breaks with the comment marks after them, those that are words among them.
BLANK, MARK = r"\n[^\p{L}\p{N}]*\n", r"(?i)(?:^|\r?\n)[^\p{L}\p{N}\n]*(?:(?:rem|dnl|c)[ \t]+)?"
MOST_N, MIN_PROBABILITY, MIN_CONTAINED = 3, 0.7, 0.6
#: Bounds of the training sample: documents, runs of each and lines of each run, characters of a run; and a decoy's weight against a line's.
NEGATIVES, LINES_EACH, LINE_CHARS, DECOY_WEIGHT = 1000, 3, 2000, 4.0
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(TOKENS, text.lower())


def ngrams(words: list[str], most: int = MOST_N) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def train(negatives: list[str], seed: int = 5, rounds: int = 400, l2: float = 2e-3) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """(classes, weights by n-gram, biases, temperature)."""
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    filler = [w for t in negatives[:200] for w in tokens(t)] or tokens(" ".join(DECOYS))
    vocabulary = sorted(set().union(*(ngrams(tokens(s)) for ss in TEMPLATES.values() for s in ss)))
    index = {g: i for i, g in enumerate(vocabulary)}
    last = len(classes) - 1
    fold: dict[tuple[frozenset[int], int, bool], float] = {}  # features, class, held out: weight

    def add(words: list[str], k: int, weight: float, keep_out: bool) -> None:
        row = frozenset(index[g] for g in ngrams(words) if g in index), k, keep_out
        fold[row] = fold.get(row, 0.0) + weight

    for k, family in enumerate(TEMPLATES):
        for sentence in TEMPLATES[family]:
            words = tokens(sentence)
            for v in range(9):  # the sentence, alone and inside other words, whole and with a tenth of its words lost; the last three are kept out
                kept = [w for w in words if v % 3 == 0 and v < 6 or rng.random() > 0.1]
                around = [filler[i] for i in rng.integers(0, len(filler), 0 if v < 3 else 20)]
                add([*around[:10], *kept, *around[10:]], k, 1.0, v >= 6)
    for n, text in enumerate(DECOYS):
        add(tokens(text), last, DECOY_WEIGHT, n % 5 == 4)
    for n, text in enumerate(dict.fromkeys(negatives)):
        add(tokens(text), last, 1.0, n % 5 == 4)
    rows = [(x, n) for x, n in fold.items() if not x[2] or (x[0], x[1], False) not in fold]
    x = np.zeros((len(rows), len(vocabulary)))
    for r, ((features, *_), _) in enumerate(rows):
        x[r, list(features)] = 1.0
    y = np.eye(len(classes))[[k for (_, k, _), _ in rows]]
    held, weight = np.array([out for (*_, out), _ in rows]), np.array([n for _, n in rows])
    plain = weight[held]
    share = weight @ y
    weight = (weight * (weight.sum() / (len(classes) * np.maximum(share, 1)))[y.argmax(1)])[:, None]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    x_fit, y_fit, w_fit = x[~held], y[~held], weight[~held] / (~held).sum()
    for t in range(1, rounds + 1):
        z = x_fit @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y_fit) * w_fit
        gw = x_fit.T @ g + l2 * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.5 * g.sum(0)
    z = x[held] @ w + b

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(1, keepdims=True)
        return float(-(plain[:, None] * y[held] * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum())

    temperature = min((0.25 * 1.15**k for k in range(20)), key=loss)
    w[np.abs(w) < 1e-3] = 0.0
    return classes, {g: w[i] for g, i in index.items() if np.abs(w[i]).sum() > 0}, b, temperature


def holds_template(text: str) -> bool:
    own = _trigrams(text)
    return any(len(own & every) / len(every) >= MIN_CONTAINED for every in (_trigrams(s) for ss in TEMPLATES.values() for s in ss))


def needed_words() -> list[str]:
    """Words one of which is in every paragraph that holds MIN_CONTAINED of a template's trigrams: of each template as many as leave too few
    trigrams without them, long ones first, then such as no decoy has."""
    common, found = set(tokens(" ".join(DECOYS))), set()
    for sentence in (s for ss in TEMPLATES.values() for s in ss):
        every = [set(t.split()) for t in _trigrams(sentence)]
        left = [t for t in every if not t & found]
        while len(left) / len(every) >= MIN_CONTAINED:
            word = min(set().union(*left), key=lambda w: (-min(len(w), 6), w in common, -sum(w in t for t in left), w))
            found.add(word)
            left = [t for t in left if word not in t]
    return sorted(found)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (doc_id, mark, a hash of its text, run, line; line -1 is the whole run; asked: a trigger word), paragraph: the lines with a
    trigger word, and all lines and runs of lines that can hold MIN_CONTAINED of a template."""
    near = rf"(?<![a-z0-9])(?:{'|'.join(needed_words())})(?![a-z0-9])"
    able = lambda x: F.lower(x).rlike(near)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(able(F.col("text")) | F.col("text").rlike(TRIGGER))
    runs = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", BLANK)).alias("run", "whole"))
    lines = F.split("whole", "\n")
    joined = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), F.regexp_replace("whole", MARK, " ").alias("paragraph")))).otherwise(F.array().cast("array<struct<line:int,paragraph:string>>"))
    every = F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("paragraph"))), joined)
    every = F.transform(every, lambda x: F.struct(x["line"].alias("line"), x["paragraph"].alias("paragraph"), ((x["line"] >= 0) & x["paragraph"].rlike(TRIGGER)).alias("asked")))
    rows = runs.select("doc_id", "mark", "run", F.inline(F.filter(every, lambda x: x["asked"] | able(x["paragraph"]))))
    return rows.select(F.struct("doc_id", "mark", "run", "line", "asked").alias("key"), "paragraph")


def grams(words, n: int):
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES):
    """train() on lines of `negatives` documents at most, those of least hash of the id: of each LINES_EACH runs, of each run LINES_EACH lines, by
    hash, but for runs and lines that state a family."""
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), text_of(text_col).alias("text"))
    chosen = rows.select("h").distinct().orderBy("h").limit(negatives)
    runs = F.array_sort(F.transform(F.array_distinct(F.split("text", BLANK)), lambda x: F.struct(F.xxhash64(x).alias("k"), F.substring(x, 1, LINE_CHARS).alias("run"))))
    some = rows.join(F.broadcast(chosen), "h").groupBy("h").agg(F.max("text").alias("text")).select("h", F.slice(runs, 1, LINES_EACH)["run"].alias("runs")).collect()
    free = [run.split("\n") for r in sorted(some) for run in r["runs"] if not holds_template(run)]
    return train([line for lines in free for line in sorted(lines, key=lambda x: zlib.crc32(x.encode()))[:LINES_EACH] if line.strip() and not holds_template(line)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES, model=None) -> DataFrame:
    """One row per row of docs: doc_id, licences (families found, in TEMPLATES' order, joined by ', '; empty if none), n_lines (confirmed
    lines, and runs confirmed across lines), confidence (least probability of one of them, null if none), n_unknown (lines about
    licences that no family claims). model: of train(), or one is trained here."""
    spark = docs.sparkSession
    classes, weights, bias, temperature = model or train_on(docs, id_col, text_col, negatives)
    families = classes[:-1]
    table = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, w array<double>")
    shapes = [(f, k, g) for f, ss in TEMPLATES.items() for k, s in enumerate(ss) for g in sorted(_trigrams(s))]
    ids = {(f, k): i for i, (f, k) in enumerate((f, k) for f, ss in TEMPLATES.items() for k in range(len(ss)))}
    known = spark.createDataFrame([(g, f, ids[f, k], len(_trigrams(TEMPLATES[f][k]))) for f, k, g in shapes], "gram string, family string, template int, size int")
    lines = paragraphs(docs, id_col, text_col)
    words = lines.select("key", F.regexp_extract_all(F.lower("paragraph"), F.lit(f"({TOKENS})"), 1).alias("words"))
    words = written(words.distinct(), "licence-lines")  # distinct: rows may repeat a document
    every = words.select("key", F.explode(F.array_distinct(F.concat(*(grams(F.col("words"), n) for n in range(1, MOST_N + 1))))).alias("gram"))
    # both tables are the model: some thousand n-grams of the templates, whatever the input
    total = every.join(F.broadcast(table), "gram").groupBy("key").agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(classes))))
    z = F.array(*((F.col(f"z{k}") + float(bias[k])) / float(temperature) for k in range(len(classes))))
    top = F.array_max("z")
    odds = total.select("key", z.alias("z"))
    scored = odds.where("key.line >= 0").withColumn("p", F.array_max(F.transform("z", lambda v: F.exp(v - top))) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    scored = scored.select("key", F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", top).cast("int")).alias("family"), "p")
    short = words.select("key", F.explode(F.array_distinct(F.when(F.size("words") >= 3, grams(F.col("words"), 3)).otherwise(F.array(F.array_join("words", " "))))).alias("gram"))
    parts = short.join(F.broadcast(known), "gram").groupBy("key", "family", "template").agg((F.count("*") / F.first("size")).alias("share"))
    contained = parts.where("key.line >= 0").groupBy("key", "family").agg(F.max("share").alias("share")).groupBy("key").agg(F.max("share").alias("most"), F.map_from_entries(F.collect_list(F.struct("family", "share"))).alias("shares"))
    sure = (F.col("family") != UNKNOWN) & (F.col("p") >= MIN_PROBABILITY) & (F.coalesce(F.col("shares")[F.col("family")], F.lit(0.0)) >= MIN_CONTAINED)
    lined = scored.join(contained, "key", "left").select("key", "family", "p", sure.alias("sure"), (~sure & (F.col("key.asked") | (F.coalesce("most", F.lit(0.0)) >= MIN_CONTAINED))).alias("left"))
    # a run may state several families, each against `unknown`; a template gives way to a fuller one of another family that has trigrams of it
    rivals = F.array(*(F.array(*(F.lit(ids[o]) for o in ids if o[0] != t[0] and _trigrams(TEMPLATES[o[0]][o[1]]) & _trigrams(TEMPLATES[t[0]][t[1]]))).cast("array<int>") for t in ids))
    held = parts.where(f"key.line < 0 and share >= {MIN_CONTAINED}").groupBy("key").agg(F.collect_list(F.struct("template", "family", "share")).alias("held")).join(odds, "key")
    first = F.filter("held", lambda t: ~F.exists("held", lambda o: (o["share"] > t["share"]) & F.array_contains(F.get(rivals, t["template"]), o["template"])))
    own = F.transform(F.array_distinct(F.transform(first, lambda t: t["family"])), lambda f: F.struct(f.alias("family"), (1 / (1 + F.exp(F.col("z")[len(families)] - F.get("z", F.array_position(F.array(*map(F.lit, families)), f).cast("int") - 1)))).alias("p")))
    whole = held.select("key", F.filter(own, lambda s: s["p"] >= MIN_PROBABILITY).alias("stated"))
    both = lined.unionByName(whole, allowMissingColumns=True).groupBy(F.col("key.doc_id").alias("id"), F.col("key.mark").alias("mark"), "key.run")
    by_run = both.agg(F.collect_set(F.when(F.col("sure"), F.col("family"))).alias("found"), F.count_if("sure").alias("n"), F.min(F.when(F.col("sure"), F.col("p"))).alias("p"), F.count_if("left").alias("left"), F.first("stated", ignorenulls=True).alias("stated"))
    by_run = by_run.withColumn("across", F.filter(F.coalesce("stated", F.array().cast("array<struct<family:string,p:double>>")), lambda s: ~F.array_contains("found", s["family"])))
    stated = F.concat("found", F.transform("across", lambda s: s["family"]))
    flags = [F.max(F.when(F.array_contains(stated, f), F.lit(f))).alias(f"f{k}") for k, f in enumerate(families)]
    least = F.min(F.least("p", F.array_min(F.transform("across", lambda s: s["p"])))).alias("confidence")
    by_doc = by_run.groupBy("id", "mark").agg(*flags, F.sum(F.col("n") + F.size("across")).alias("n_lines"), least, F.sum(F.when(F.size("across") > 0, 0).otherwise(F.col("left"))).alias("n_unknown"))
    by_doc = by_doc.select("id", "mark", F.concat_ws(", ", *(f"f{k}" for k in range(len(families)))).alias("licences"), "n_lines", F.round("confidence", 6).alias("confidence"), "n_unknown")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("own"))
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark")), "left").select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "confidence", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def _trigrams(sentence: str) -> set[str]:
    words = tokens(sentence)
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}

"""License scans by sentence rules, in DataFrame operations alone.

A text is cut into parts at stops and line ends, each is normalised, and every run of
parts is looked up in a table of known licence sentences: a sentence may hold stops and be
wrapped over lines, with comment marks on each. Runs are joined only as far as the longest
known sentence reaches, from parts that begin with the first word of one. A rule is an
ordered list of such sentences. Hits of a document are matched against the rules step by
step: a match is a chain of hits in order, each at most ``gap`` parts after the end of the
one before. Parts can be many, but only the known sentences leave the scan, as the table of
rules (``MAX_SENTENCES`` at most) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAX_SENTENCES = 20_000

# License, rule and its sentences in order, in natural wording.
RULES = [
    ("Apache-2.0", "apache-2.0-line", ["Licensed under the Apache License, Version 2.0."]),
    ("Apache-2.0", "apache-2.0-notice", [
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
    ]),
    ("MIT", "mit-line", ["Released under the MIT License."]),
    ("MIT", "mit-line-2", ["Licensed under the MIT License."]),
    ("MIT", "mit-text", [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ]),
    ("GPL-3.0", "gpl-3.0-line", ["This work is licensed under the GNU General Public License, version 3."]),
    ("GPL-3.0-or-later", "gpl-3.0-notice", [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ]),
    ("BSD-3-Clause", "bsd-3-text", [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]),
    ("BSD-2-Clause", "bsd-2-text", [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ]),
    ("MPL-2.0", "mpl-2.0-notice", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ]),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0-line", ["Licensed under CC BY-NC 4.0."]),
    ("CC-BY-4.0", "cc-by-4.0-line", ["Licensed under CC BY 4.0."]),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0-line", ["Licensed under CC BY-SA 4.0."]),
    ("CC0-1.0", "cc0-1.0-line", ["Released under CC0 1.0."]),
    ("Unlicense", "unlicense-text", ["This is free and unencumbered software released into the public domain."]),
]

#: A part ends at a line's end, or after a stop that white space follows.
BREAK = r"\n+|(?<=[.!?:;])[ \t\r]+"
OTHER = r"[^a-z0-9]+"


def normalised(text):
    """Lower case, with every run of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), OTHER, " "))


def rule_steps(spark: SparkSession, rules=None) -> DataFrame:
    """rule, license, step from 0, steps, sentence (normalised) of all rules."""
    rows = [(rule, name, i, len(sentences), s) for name, rule, sentences in (RULES if rules is None else rules) for i, s in enumerate(sentences)]
    if len(rows) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} rule sentences")
    df = spark.createDataFrame(rows, "rule string, license string, step int, steps int, sentence string")
    return df.withColumn("sentence", normalised("sentence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None, gap: int = 3) -> DataFrame:
    """Every rule match: doc_id, license, rule, first_sentence and last_sentence (numbers of the text's parts from 0).

    Null and empty texts match nothing, nor does a null id. Rows that repeat an id and
    a text give one match each rule and place, as do rows that repeat only the id. Of chains that
    end at the same part the one that starts latest is meant. Other columns are ignored.
    """
    steps = rule_steps(docs.sparkSession, rules)
    known = steps.select("sentence").distinct()
    # Joins begin at parts whose first word begins a known sentence; no part in them has less than a word.
    sizes = steps.agg(F.max(F.length("sentence")), F.max(F.size(F.split("sentence", " "))), F.collect_set(F.substring_index("sentence", " ", 1))).first()
    longest, words, firsts = sizes[0] or 0, sizes[1] or 1, sorted(sizes[2])
    parts = F.transform(F.split(F.col(text_col), BREAK), lambda t, i: F.struct(i.alias("pos"), normalised(t).alias("said")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.filter(parts, lambda x: x["said"] != "").alias("parts")).where("doc_id is not null")

    def longer(have, x, y):
        text = F.concat(F.element_at(have["joins"], -1)["sentence"], F.lit(" "), y["said"])
        more = F.concat(have["joins"], F.array(F.struct(x["pos"].alias("pos"), y["pos"].alias("end"), text.alias("sentence"))))
        fits = have["open"] & (F.length(text) <= longest)
        return F.when(fits, F.struct(more.alias("joins"), fits.alias("open"))).otherwise(F.struct(have["joins"].alias("joins"), F.lit(False).alias("open")))

    def joins(x, i):
        """x alone and with each number of parts behind it, as far as some known sentence can reach."""
        alone = F.array(F.struct(x["pos"].alias("pos"), x["pos"].alias("end"), x["said"].alias("sentence")))
        begins = F.substring_index(x["said"], " ", 1).isin(firsts) & (F.length(x["said"]) <= longest)
        rest = F.slice("parts", i + 2, F.lit(words - 1))
        return F.when(begins, F.aggregate(rest, F.struct(alone.alias("joins"), F.lit(True).alias("open")), lambda have, y: longer(have, x, y), lambda have: have["joins"]))

    found = F.flatten(F.filter(F.transform("parts", joins), lambda x: x.isNotNull()))
    hits = texts.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    hits = hits.join(F.broadcast(known), "sentence").select("doc_id", "pos", "end", "sentence").distinct()
    at = hits.join(F.broadcast(steps), "sentence").select("doc_id", "rule", "license", "steps", "step", "pos", "end")
    # Steps follow one another within the gap, so chains grow by looking back from a hit's first part
    # to last parts: the latest hit of the step before is the best one to continue from. Hits of one
    # document and rule are few, and a document is one row of the input.
    most = max([len(s) for _, _, s in (RULES if rules is None else rules)], default=0)
    sides = F.array(F.struct(F.col("pos").alias("at"), F.lit(True).alias("begins")), F.struct(F.col("end").alias("at"), F.lit(False).alias("begins")))
    chains = at.select("*", F.inline(sides)).withColumn("start", F.when(F.col("step") == 0, F.col("pos")))
    for i in range(1, most):
        near = Window.partitionBy("doc_id", "rule").orderBy("at").rangeBetween(-gap, -1)
        before = F.max(F.when((F.col("step") == i - 1) & ~F.col("begins") & F.col("start").isNotNull(), F.struct("at", "start"))).over(near)
        chains = chains.withColumn("before", F.when((F.col("step") == i) & F.col("begins"), before["start"]))
        same = F.max("before").over(Window.partitionBy("doc_id", "rule", "step", "pos", "end"))
        chains = chains.withColumn("start", F.when(F.col("step") == i, same).otherwise(F.col("start")))
    done = chains.where(~F.col("begins") & (F.col("step") == F.col("steps") - 1) & F.col("start").isNotNull())
    return done.select("doc_id", "license", "rule", F.col("start").alias("first_sentence"), F.col("end").alias("last_sentence"))


def oracle() -> str:
    """DuckDB SQL for ``scan`` of documents with the built-in rules of up to three sentences."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(rule)}, {quote(name)}, {i}, {len(ss)}, trim(regexp_replace(lower({quote(s)}), '{OTHER}', ' ', 'g')))" for name, rule, ss in RULES for i, s in enumerate(ss))
    # RE2 has no look-behind, so a mark is put after each stop and split at.
    return f"""
    WITH steps(rule, license, step, steps, sentence) AS (VALUES {rows}),
    parts AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?:;])[ \\t\\r]+', '\\1' || chr(10) || chr(1), 'g'), '\\n+') AS p FROM documents WHERE text IS NOT NULL),
    rawly AS (SELECT doc_id, p, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS pos FROM parts),
    hits AS (SELECT DISTINCT doc_id, pos, trim(regexp_replace(lower(raw), '{OTHER}', ' ', 'g')) AS sentence FROM rawly),
    found AS (SELECT h.doc_id, s.rule, s.license, s.step, s.steps, h.pos FROM hits h JOIN steps s USING (sentence)),
    c0 AS (SELECT *, pos AS start FROM found WHERE step = 0),
    c1 AS (SELECT f.*, arg_max(c.start, c.pos) AS start FROM found f JOIN c0 c ON f.doc_id = c.doc_id AND f.rule = c.rule AND f.step = 1 AND f.pos - c.pos BETWEEN 1 AND 3 GROUP BY ALL),
    c2 AS (SELECT f.*, arg_max(c.start, c.pos) AS start FROM found f JOIN c1 c ON f.doc_id = c.doc_id AND f.rule = c.rule AND f.step = 2 AND f.pos - c.pos BETWEEN 1 AND 3 GROUP BY ALL)
    SELECT doc_id, license, rule, CAST(start AS INTEGER) AS first_sentence, CAST(pos AS INTEGER) AS last_sentence
    FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) WHERE step = steps - 1
    """

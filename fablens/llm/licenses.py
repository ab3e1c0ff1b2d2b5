"""License scans by diagonal voting.

Every rolling hash of k words (k = 3) of every document is joined to the template positions that have that hash. A match
of document word i and template word t votes for the diagonal i - t. Votes are counted by diagonal, diagonals that lie at
most ``GAP`` apart (a word or two inserted or left out) are merged, and a merged diagonal names its template's label if it
covers enough of the template's k-grams. Exact phrases (``BASE``) are templates of which all words must stand there.
All work is DataFrame code; the template table is a constant of a few hundred rows.

Defined cases: a null text is empty and has no label; rows with equal id and equal text count once, rows with equal id and
different texts give a row each; a null id stays; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, table, words_sql
from .wordscan import scan, sequence_key

K = 3
#: Diagonals so far apart are still merged.
GAP = 2
#: Share of a template's k-grams that a merged diagonal must cover.
COVER = 0.6

# The exact phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Wording of public license notices.
TEMPLATES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", "apache-2"),
    ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("You should have received a copy of the GNU General Public License along with this program", "gpl"),
    ("is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Distributed under the Boost Software License, Version 1.0", "bsl-1"),
    ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"),
]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_rows(base=BASE, templates=TEMPLATES, k: int = K) -> list[tuple]:
    """(template, label, is_base, t, n_grams, first k words, words that must stand there)."""
    rows = []
    for n, (phrase, label) in enumerate(base):
        w = _words(phrase)
        rows.append((n, label, True, 0, 1, w[:k], w))
    for n, (text, label) in enumerate(templates, len(base)):
        w = _words(text)
        rows += [(n, label, False, t, len(w) - k + 1, w[t : t + k], w[t : t + k]) for t in range(len(w) - k + 1)]
    return rows


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: the verified (label, first word, end word, coverage) of merged diagonals. score: the best coverage of any
    template, 1 for an exact phrase, 0 without a match.
    """
    spark = docs.sparkSession
    rows = template_rows(base, templates, k)
    sequences = spark.createDataFrame(rows, "template int, label string, is_base boolean, t int, n_grams int, first array<string>, need array<string>")
    sequences = sequences.select(sequence_key("first", "0", k).alias("key"), F.lit(k).alias("k"), "need", "template", "label", "is_base", "t", "n_grams")
    hits = scan(docs, id_col, text_col, sequences, {k: len(rows)}, max(len(r[6]) for r in rows))

    diagonals = hits.groupBy("doc", "rid", "template", (F.col("i") - F.col("t")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("is_base").alias("is_base"),
        F.first("n_grams").alias("n_grams"),
        F.collect_set("t").alias("ts"),
        F.min("i").alias("lo"),
        F.max("i").alias("hi"),
        F.size(F.collect_set("t")).alias("votes"),  # a repeated row votes once
    )
    order = Window.partitionBy("doc", "rid", "template").orderBy("diagonal")
    step = diagonals.withColumn("starts", (~F.coalesce(F.col("is_base"), F.lit(False)) & (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(gap + 1)) <= gap)).cast("int"))
    merged = step.withColumn("line", F.sum(1 - F.col("starts")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = merged.groupBy("doc", "rid", "template", "line").agg(
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("is_base").alias("is_base"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ts")))) / F.first("n_grams")).alias("coverage"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("votes").alias("votes"),
    )
    on_base, good = F.col("is_base"), ~F.col("is_base") & (F.col("coverage") >= cover)
    out = lines.groupBy("doc", "rid").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(on_base, F.col("votes"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(on_base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(on_base, F.col("hi"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(on_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(on_base | good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("label", F.col("lo").alias("first"), (F.col("hi") + k).alias("end"), "coverage")))).alias("spans"),
    )
    return out.withColumnsRenamed({"doc": "doc_id", "rid": "text_hash"})


def op4(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("text_hash", "spans")


def _rows_sql() -> str:
    q = lambda w: "'" + " ".join(w) + "'"
    return ", ".join(f"({n}, '{label}', {is_base}, {t}, {grams}, {len(need)}, {q(need)})" for n, label, is_base, t, grams, _, need in template_rows())


OP4_SQL = f"""
WITH t(template, label, is_base, t, n_grams, k, need) AS (VALUES {_rows_sql()}),
 d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
 g AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS need
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
 m AS (SELECT doc_id, i, template, label, is_base, t, n_grams, i - t AS diagonal FROM g JOIN t ON g.k = t.k AND g.need = t.need),
 dg AS (SELECT *, CASE WHEN NOT is_base AND diagonal - lag(diagonal) OVER o <= {GAP} THEN 0 ELSE 1 END AS fresh
        FROM (SELECT DISTINCT doc_id, template, is_base, diagonal FROM m) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
 ln AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS line FROM dg),
 cov AS (SELECT m.doc_id, m.template, line, any_value(label) AS label, any_value(m.is_base) AS is_base, count(*) AS votes, min(i) AS lo, max(i) AS hi,
                count(DISTINCT t) / any_value(n_grams) AS coverage
         FROM m JOIN ln ON m.doc_id = ln.doc_id AND m.template = ln.template AND m.diagonal = ln.diagonal GROUP BY ALL),
 per AS (SELECT doc_id, sum(votes) FILTER (is_base) AS n_base, min(lo) FILTER (is_base) AS first_word, max(hi) FILTER (is_base) AS last_word, max(coverage) AS score,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR coverage >= {COVER}) AS labels FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (doc_id)
"""

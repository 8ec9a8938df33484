"""License scans by diagonal voting.

All rolling word k-gram hashes of a document are joined to the templates' k-gram positions. A match
at document position i and template position j votes for the diagonal i - j of its document and
template. Neighbouring diagonals (inserted or missing words shift the offset) are merged, and the
merged span is verified: which share of the template's words its matches cover, and how dense they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_IDS, Memo, id_text, kgrams, sliced, word_hashes, words_of

K, SHIFT, COVERAGE = 3, 4, 0.6

#: Notices by which texts name their license; a caller may scan for any other texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def template_grams(templates: dict[str, str], k: int) -> list[tuple[str, int, int, int]]:
    """(license, position, hash, words) of every k-gram; a template shorter than k words has none and is never found."""
    memo, rows = Memo(), []
    for name, text in sorted(templates.items()):
        h = word_hashes(words_of(text), memo)
        rows += [(name, j, g, len(h)) for j, g in enumerate(kgrams(h, k).view(np.int64).tolist())]
    return rows


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in sliced(batches):
            parts = [kgrams(word_hashes(words_of(t), memo), k) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "grams"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, shift: int = SHIFT, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start_word, end_word, votes, covered) of each verified span, end exclusive.

    covered: share of the template's words in at least one match, `coverage` or more. votes counts
    matches. Diagonals at most `shift` apart in one document and template are one span; if that is longer
    than twice the template, it is cut where the template begins anew (a notice repeated in a row) and each
    part is verified. Texts that are null, empty or shorter than k words have no spans. The matches of rows
    that repeat a doc_id are pooled, equal ones counting once. Rows without doc_id are left out. Empty
    tables and empty templates give no rows.
    """
    spark = docs.sparkSession
    rows = template_grams(TEMPLATES if templates is None else templates, k)
    table = spark.createDataFrame(rows, "license string, tpos int, gram long, words int")
    # The template table is as large as the caller's license list; it is broadcast while that is small.
    table = F.broadcast(table) if len(rows) <= BROADCAST_IDS else table
    grams = id_text(docs).mapInArrow(_grams(k), "doc_id long, grams array<long>")
    hits = grams.select("doc_id", F.posexplode("grams").alias("pos", "gram")).join(table, "gram")
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy("doc_id", "license", "words", "diagonal").agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    line = Window.partitionBy("doc_id", "license").orderBy("diagonal")
    gap = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= shift, 0).otherwise(1)
    matches = F.transform("tpos", lambda j: F.struct((F.col("diagonal") + j).alias("pos"), j.alias("tpos")))
    spans = diagonals.withColumn("gap", gap).withColumn("span", F.sum("gap").over(line)).groupBy("doc_id", "license", "words", "span").agg(
        F.array_sort(F.flatten(F.collect_list(matches))).alias("m"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # A span too long for one occurrence is cut where the template begins anew.
    cuts = F.when(F.col("high") + k - F.col("low") <= 2 * F.col("words"), F.expr("array(1)")).otherwise(F.expr("filter(sequence(1, size(m)), i -> i = 1 or m[i - 1].tpos <= m[i - 2].tpos)"))
    pieces = spans.withColumn("cuts", cuts).select("doc_id", "license", "words", F.explode(F.expr("transform(cuts, (c, n) -> slice(m, c, coalesce(get(cuts, n + 1), size(m) + 1) - c))")).alias("m"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("m", lambda x: F.sequence(x["tpos"], x["tpos"] + (k - 1))))))
    out = pieces.select("doc_id", "license", F.col("m")[0]["pos"].cast("bigint").alias("start_word"), (F.element_at("m", -1)["pos"] + k).cast("bigint").alias("end_word"), F.size("m").cast("bigint").alias("votes"), "words", covered.alias("c"))
    # The matches must fill the span they claim: no more foreign words than the template has words.
    verified = (F.col("c") >= coverage * F.col("words")) & (F.col("end_word") - F.col("start_word") <= 2 * F.col("words"))
    return out.where(verified).select("doc_id", "license", "start_word", "end_word", "votes", F.round(F.col("c") / F.col("words"), 4).alias("covered"))


def oracle_sql(k: int = K, shift: int = SHIFT, coverage: float = COVERAGE) -> str:
    grams = []
    for name, text in sorted(TEMPLATES.items()):
        w = words_of(text)
        grams += [f"('{name}', {j}, '{' '.join(w[j : j + k])}', {len(w)})" for j in range(len(w) - k + 1)]
    return f"""
WITH t(license, tpos, gram, words) AS (VALUES {", ".join(grams)}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS a FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, a, unnest(range(len(a) - {k - 1})) AS pos FROM w),
h AS (SELECT DISTINCT doc_id, pos, {" || ' ' || ".join(f"a[pos + {i + 1}]" for i in range(k))} AS gram FROM g),
d AS (SELECT doc_id, license, words, pos - tpos AS diagonal, list(DISTINCT tpos) AS tp, min(pos) AS low, max(pos) AS high FROM h JOIN t USING (gram) GROUP BY ALL),
e AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, license ORDER BY diagonal) <= {shift} THEN 0 ELSE 1 END AS gap FROM d),
f AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS span FROM e),
x AS (SELECT doc_id, license, words, span, diagonal, unnest(tp) AS tpos FROM f),
y AS (SELECT *, diagonal + tpos AS pos, max(diagonal + tpos) OVER r + {k} - min(diagonal + tpos) OVER r > 2 * words AS long FROM x WINDOW r AS (PARTITION BY doc_id, license, span)),
z AS (SELECT *, long AND tpos <= lag(tpos) OVER (PARTITION BY doc_id, license, span ORDER BY pos, tpos) AS anew FROM y),
v AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, license, span ORDER BY pos, tpos) AS part FROM z),
s AS (SELECT doc_id, license, words, span, part, list(DISTINCT tpos) AS tp, count(*) AS votes, min(pos) AS low, max(pos) AS high FROM v GROUP BY ALL),
c AS (SELECT *, len(list_distinct(flatten(list_transform(tp, lambda j: range(j, j + {k}))))) AS c FROM s)
SELECT doc_id, license, low::bigint AS start_word, (high + {k})::bigint AS end_word, votes::bigint AS votes, round(c::double / words, 4) AS covered
FROM c WHERE c >= {coverage}::double * words AND high + {k} - low <= 2 * words"""

"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined with the k-gram positions of the license
templates. A match at text position p and template position q votes for the diagonal p - q;
neighbouring diagonals (an inserted or lost word or two) merge into one span, and a span whose votes
cover enough different template positions is a candidate. Candidates are verified word by word: each
template word must stand in the text on one of the span's diagonals; template words that do not, and
words of the span that are none of the template, are errors, of which a span may have a share of the
template's length. Everything runs as DataFrame expressions; the template tables are a parameter of the
code, some hundred rows, and with a filter of fixed size the only things broadcast.

Beside the method stand the base phrases, counted wherever their words stand in a row. They do not
touch the score, which is that of the best verified span (0 without one).

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts
have no words. Rows that repeat give repeated results; rows that repeat a doc_id with another text
are told apart by the text's hash. Only the id and text columns are read, so other columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, lower_ascii

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Templates and their labels: short notices, and the texts of short licenses, as they are published (fixed values).
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at""",
    "apache-2.0-disclaimer": """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
        and limitations under the license""",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction""",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software""",
    "mit-line": "released under the mit license",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met""",
    "bsd-2-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies""",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation""",
    "gpl-warranty": """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "reserved-notice": "copyright all rights reserved",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at""",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
K = 3
#: A candidate's votes cover this share of its template's k-grams at least.
SHARE = 0.4
#: Neighbouring diagonals are at most this far apart.
DRIFT = 2
#: Errors that a verified span may have, as a share of its template's words.
ERRORS = 0.15


def template_grams(spark, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """(gram, label, at, grams): one row for each k-gram position of each template."""
    rows = [(label, i, len(w) - k + 1, *w[i : i + k]) for label, text in templates.items() for w in [text.split()] for i in range(len(w) - k + 1)]
    words = [f"w{j}" for j in range(k)]
    return spark.createDataFrame(rows, "label string, at int, grams int, " + ", ".join(f"{w} string" for w in words)).select(F.xxhash64(*words).alias("gram"), "label", "at", "grams", *[F.col(w).alias(f"t_{w}") for w in words])


def words_of(text):
    return F.filter(F.split(lower_ascii(text), SPLIT), lambda w: w != "")


def verified(spans: DataFrame, texts: DataFrame, errors: float) -> DataFrame:
    """The spans whose words agree with the template's, with their place and score.

    ``texts`` has (doc_id, th, text) of the rows that may have spans, each (doc_id, th) once.
    """
    spark = spans.sparkSession
    templates = spark.createDataFrame([(label, text.split()) for label, text in TEMPLATES.items()], "name string, wanted array<string>")
    rows = spans.withColumnsRenamed({"doc_id": "s_doc", "th": "s_th"}).join(texts, F.col("s_doc").eqNullSafe(F.col("doc_id")) & (F.col("s_th") == F.col("th")))
    rows = rows.join(F.broadcast(templates), F.col("label") == F.col("name")).withColumn("words", words_of(F.col("text")))
    place = lambda w, q: F.array_min(F.filter(F.transform("diagonals", lambda d: d + q), lambda p: F.get(F.col("words"), p) == w))
    rows = rows.withColumn("places", F.filter(F.transform("wanted", place), lambda p: p.isNotNull()))
    first, end = F.array_min("places"), F.array_max("places") + 1
    length, hit = F.size("wanted"), F.size("places")
    wrong = length - hit + F.greatest(F.lit(0), end - first - hit)
    rows = rows.select("doc_id", "th", "label", "votes", first.alias("first_word"), end.alias("end_word"), wrong.alias("errors"), length.alias("length"))
    return rows.where(F.col("errors") <= F.floor(F.lit(errors) * F.col("length"))).select("doc_id", "th", "label", "votes", "first_word", "end_word", "errors", (1 - F.col("errors") / F.col("length")).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, drift: int = DRIFT, errors: float = ERRORS) -> tuple[DataFrame, DataFrame]:
    """(summary, spans): one row for each document, and one for each template span found.

    A candidate needs ``share`` of its template's k-grams; diagonals at most ``drift`` apart merge; a span
    counts with at most ``errors`` times its template's words wrong.
    """
    scratch = Scratch(docs.sparkSession, "license")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = plain.select("doc_id", "th", words_of(F.col("text")).alias("words"))
    sizes = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))

    # One row for each place; the last places lack their further words.
    shifted = [F.col("words")] + [F.slice("words", j + 1, F.greatest(F.size("words"), F.lit(1))) for j in range(1, K)]
    grams = rows.select("doc_id", "th", F.posexplode(F.arrays_zip(*[s.alias(f"w{j}") for j, s in enumerate(shifted)])).alias("p", "g")).select("doc_id", "th", F.col("p").alias("at_word"), *[F.col(f"g.w{j}").alias(f"w{j}") for j in range(K)])
    base = F.lit(None).cast("string")
    for words, label in PHRASES.items():
        here = F.lit(True)
        for j, w in enumerate(words):
            here = here & (F.col(f"w{j}") == w)
        base = F.when(here, F.lit(label)).otherwise(base)
    table = F.broadcast(template_grams(docs.sparkSession))
    keyed = grams.select("doc_id", "th", "at_word", base.alias("phrase"), F.xxhash64(*[f"w{j}" for j in range(K)]).alias("gram"), *[f"w{j}" for j in range(K)])
    same = (keyed["gram"] == table["gram"]) & (keyed["w0"] == table["t_w0"]) & (keyed["w1"] == table["t_w1"]) & (keyed["w2"] == table["t_w2"])
    met = keyed.join(table, same, "left").where("phrase is not null or label is not null").select("doc_id", "th", "at_word", "phrase", "label", "at", "grams").distinct()
    met = scratch.save(met, "met")

    votes = met.where("label is not null").withColumn("diagonal", F.col("at_word") - F.col("at"))
    along = Window.partitionBy("doc_id", "th", "label").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= drift, 0).otherwise(1)
    spans = votes.withColumn("new", apart).withColumn("span", F.sum("new").over(along))
    spans = spans.groupBy("doc_id", "th", "label", "grams", "span").agg(F.countDistinct("at").alias("votes"), F.collect_set("diagonal").alias("diagonals"))
    spans = scratch.save(spans.where(F.col("votes") >= share * F.col("grams")).select("doc_id", "th", "label", "votes", "diagonals"), "candidates")
    likely, _ = Bitmap(scratch, spans, "th", "map").split(plain, "th")
    spans = scratch.save(verified(spans, likely.dropDuplicates(["doc_id", "th"]), errors), "spans")

    found = met.where("phrase is not null").groupBy("doc_id", "th").agg(F.countDistinct("at_word").alias("n_base"), F.min("at_word").alias("first_word"), F.max("at_word").alias("last_word"), F.array_sort(F.collect_set("phrase")).alias("base_labels"))
    methods = spans.groupBy("doc_id", "th").agg(F.collect_set("label").alias("labels"), F.max("score").alias("best"))
    keys = lambda df, p: df.withColumnsRenamed({"doc_id": f"{p}_doc", "th": f"{p}_th"})
    on = lambda p: F.col("doc_id").eqNullSafe(F.col(f"{p}_doc")) & (F.col("th") == F.col(f"{p}_th"))
    marks = found.join(keys(methods, "m"), on("m"), "full")
    marks = marks.select(F.coalesce("doc_id", "m_doc").alias("k_doc"), F.coalesce("th", "m_th").alias("k_th"), "n_base", "first_word", "last_word", "base_labels", "labels", "best")
    out = sizes.join(marks, on("k"), "left")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base_labels", none)
    summary = out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("labels", none))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
    return summary, spans


def oracle() -> str:
    """The summary of ``documents`` as SQL, with the default parameters."""
    phrases = " ".join(f"WHEN {' AND '.join(f'w{j} = {chr(39)}{w}{chr(39)}' for j, w in enumerate(words))} THEN '{label}'" for words, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{' '.join(text.split())}')" for label, text in TEMPLATES.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS at_word FROM d
), g AS MATERIALIZED (
  SELECT doc_id, at_word, w AS w0, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY at_word)
), b AS (
  SELECT doc_id, at_word, CASE {phrases} END AS phrase FROM g
), f AS (
  SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, list_sort(list_distinct(list(phrase))) AS base_labels FROM b WHERE phrase IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT label, string_split(text, ' ') AS words FROM (VALUES {templates}) AS v(label, text)
), q AS (
  SELECT label, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos, len(words) AS length FROM t
), k AS (
  SELECT label, pos, length, w AS w0, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM q WINDOW o AS (PARTITION BY label ORDER BY pos)
), v AS (
  SELECT g.doc_id, k.label, k.pos, k.length, g.at_word - k.pos AS diagonal FROM g JOIN k ON g.w0 = k.w0 AND g.w1 = k.w1 AND g.w2 = k.w2
), n AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {DRIFT} THEN 0 ELSE 1 END AS new FROM v WINDOW o AS (PARTITION BY doc_id, label ORDER BY diagonal)
), i AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS span FROM n
), c AS (
  SELECT doc_id, label, span, length, list_distinct(list(diagonal)) AS diagonals FROM i GROUP BY ALL HAVING count(DISTINCT pos) >= CAST({SHARE} AS DOUBLE) * (length - {K - 1})
), e AS (
  SELECT doc_id, label, span, length, unnest(diagonals) AS diagonal FROM c
), h AS (
  SELECT e.doc_id, e.label, e.span, e.length, q.pos, min(p.at_word) AS place
  FROM e JOIN q ON q.label = e.label JOIN p ON p.doc_id = e.doc_id AND p.at_word = q.pos + e.diagonal AND p.w = q.w GROUP BY ALL
), r AS (
  SELECT doc_id, label, length, length - count(*) + greatest(0, max(place) + 1 - min(place) - count(*)) AS errors FROM h GROUP BY doc_id, label, span, length
), s AS (
  SELECT doc_id, list_distinct(list(label)) AS labels, max(1 - errors / length::DOUBLE) AS best FROM r WHERE errors <= floor(CAST({ERRORS} AS DOUBLE) * length) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(f.n_base, 0)::BIGINT AS n_base, f.first_word::BIGINT AS first_word, f.last_word::BIGINT AS last_word,
  coalesce(array_to_string(f.base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.base_labels, []), coalesce(s.labels, [])))), ','), '') AS labels,
  coalesce(s.best, 0.0::DOUBLE) AS score
FROM d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

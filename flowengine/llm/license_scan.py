"""License scans by diagonal voting, in DataFrame functions only.

Every word bigram of every text is joined (a hash join against a fixed list of templates) to the places where the
templates have the same bigram. A hit at word p of the text and word t of the template votes for the diagonal p - t.
Diagonals at most `slack` apart are merged (insertions and deletions move a match to a neighbouring diagonal). A merged
span is verified: of the template's bigrams it must hold at least `coverage` in the template's order (hits that follow
the highest one so far, or, read from the end, lie below the lowest one so far), within `1 / coverage` times the
template's words. One diagonal with that share of the bigrams is a copy by itself, so chance hits beside it don't undo it.

Defined results: a null or empty text has no words, no places, empty label strings and score 0; repeated rows give
repeated results; an empty table gives an empty result; columns other than the key and the text are ignored. Only A-Z
are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Base phrases: every place where a phrase's words stand one after the other.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Fixed values. Longer notices that the method finds besides, whole or in large part.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]
#: Fixed values. Bigrams of two of these words do not vote: they stand in any text.
COMMON = "a and any at be by can for in is it may not of on or the this to under with you".split()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FIRST_NOTICE = len(PHRASES)


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, int, str, str, int, int]]:
    """(template, label, t, word t, word t + 1, votes that the template has, its words); base phrases come first."""
    rows = []
    for k, (text, label) in enumerate([*phrases, *notices]):
        w = text.split()
        pairs = [(t, a, b) for t, (a, b) in enumerate(zip(w, w[1:])) if k < len(phrases) or a not in COMMON or b not in COMMON]
        rows += [(k, label, t, a, b, len(pairs), len(w)) for t, a, b in pairs]
    return rows


def words(text: str | F.Column) -> F.Column:
    """Words of the text, A-Z lower-cased and no other letter: lower() does that in ASCII texts, faster than translate()."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, NOT_WORD), "")


def in_order(hits: F.Column) -> F.Column:
    """Of hits (p, t), sorted: how many rise above all t before them, or fall below all t behind them, whichever are more."""
    state = lambda t, n: F.struct(t.cast("int").alias("t"), n.cast("int").alias("n"))
    up = F.aggregate(hits, state(F.lit(-1), F.lit(0)), lambda s, x: F.when(x["t"] > s["t"], state(x["t"], s["n"] + 1)).otherwise(s), lambda s: s["n"])
    down = F.aggregate(F.reverse(hits), state(F.lit(1 << 30), F.lit(0)), lambda s, x: F.when(x["t"] < s["t"], state(x["t"], s["n"] + 1)).otherwise(s), lambda s: s["n"])
    return F.greatest(up, down)


def license_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """One row per input row: key, n_words, and `spans`, an array of (template, label, base, start, stop, cover).

    `base` spans are the exact places of a base phrase; the others are merged diagonals of a notice.
    """
    spark = docs.sparkSession
    lists = F.broadcast(  # a fixed list of about a thousand rows
        spark.createDataFrame(templates(), "template int, label string, t int, a string, b string, votes int, words int").withColumn("h", F.xxhash64("a", "b"))
    )
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("same"), words(F.col(text)).alias("w"))
    # one row per word and one more, at p = size(w), that keeps texts without hits
    # (the outer form drops nothing here, and keeps Spark from splitting each text once more to look for empty sequences)
    at = rows.select("k", "same", "w", F.explode_outer(F.sequence(F.lit(0), F.size("w"))).alias("p"))
    a, b = F.get("w", F.col("p")), F.get("w", F.col("p") + 1)
    at = at.select("k", "same", "p", F.size("w").alias("n"), a.alias("wa"), b.alias("wb"), F.xxhash64(a, b).alias("wh"))
    hit = at.join(lists, (F.col("wh") == F.col("h")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")), "left")
    hit = hit.where(F.col("template").isNotNull() | (F.col("p") == F.col("n")))
    by_row = ["k", "same", "n"]
    of = ["template", "label", "votes", "words"]
    # repeated rows vote alike; how many there are shows at p = size(w)
    diagonals = hit.groupBy(*by_row, *of, (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.sum(F.when(F.col("p") == F.col("n"), 1).otherwise(0)).alias("copies")
    )
    # neighbouring diagonals of one template make a run; base phrases stay on one diagonal each
    w = Window.partitionBy("k", "same", "template").orderBy("diagonal")
    new = F.when((F.col("template") < _FIRST_NOTICE) | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > slack), 1).otherwise(0)
    runs = diagonals.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    d = F.struct("diagonal", "ts")
    merged = runs.groupBy(*by_row, *of, "run").agg(F.collect_list(d).alias("ds"), F.max(F.size("ts")).alias("alone"), F.max("copies").alias("copies"))
    hits = F.array_sort(F.flatten(F.transform("ds", lambda x: F.transform(x["ts"], lambda t: F.struct((x["diagonal"] + t).alias("p"), t.alias("t"))))))
    merged = merged.withColumn("hits", F.when(F.col("template").isNotNull(), hits))
    start, stop = F.get("hits", F.lit(0))["p"].cast("long"), (F.element_at("hits", -1)["p"] + 2).cast("long")
    ordered = F.when((stop - start) * coverage <= F.col("words"), in_order(F.col("hits"))).otherwise(0)
    cover = F.greatest(F.col("alone"), ordered) / F.col("votes")
    merged = merged.withColumn("start", start).withColumn("stop", stop).withColumn("cover", cover)
    good = F.col("template").isNotNull() & (F.col("cover") >= F.when(F.col("template") < _FIRST_NOTICE, 1.0).otherwise(coverage))
    span = F.struct("template", "label", (F.col("template") < _FIRST_NOTICE).alias("base"), "start", "stop", "cover")
    whole = merged.groupBy(*by_row).agg(F.max("copies").alias("copies"), F.collect_list(F.when(good, span)).alias("spans"))
    return whole.select(F.col("k").alias(key), F.col("n").cast("long").alias("n_words"), F.array_sort("spans").alias("spans"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: word count, base places, labels of the base phrases and of the method, and the best cover."""
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    return ", ".join(f"({k}, '{label}', {t}, '{a}', '{b}', {n}, {m})" for k, label, t, a, b, n, m in templates())


#: The same relation in DuckDB: records of the running highest and lowest place stand for the hits in order.
ORACLE_SQL = rf"""
WITH lists(template, label, t, a, b, votes, words) AS (VALUES {_values()}),
rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT r, w, unnest(range(len(w) - 1)) AS p FROM rows)),
hits AS (SELECT r, template, label, votes, words, p, t, p - t AS diagonal FROM places JOIN lists USING (a, b)),
marks AS (SELECT *, CASE WHEN template < {_FIRST_NOTICE} AND lag(diagonal) OVER o = diagonal THEN 0 WHEN template < {_FIRST_NOTICE} OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > 2 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW o AS (PARTITION BY r, template ORDER BY diagonal, p)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal, p) AS run FROM marks),
records AS (SELECT *, t > coalesce(max(t) OVER (PARTITION BY r, template, run ORDER BY p, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS up,
  t < coalesce(min(t) OVER (PARTITION BY r, template, run ORDER BY p DESC, t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000000) AS down, count(*) OVER (PARTITION BY r, template, run, diagonal) AS alone FROM runs),
merged AS (SELECT r, template, label, run, min(p) AS start, greatest(max(alone), CASE WHEN (max(p) + 2 - min(p)) * 0.8 <= words THEN greatest(count(*) FILTER (up), count(*) FILTER (down)) ELSE 0 END) / votes AS cover
  FROM records GROUP BY r, template, label, votes, words, run),
good AS (SELECT *, template < {_FIRST_NOTICE} AS base FROM merged WHERE cover >= CASE WHEN template < {_FIRST_NOTICE} THEN 1 ELSE 0.8 END),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM rows LEFT JOIN per USING (r)"""

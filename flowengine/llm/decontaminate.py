"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item with q distinct shingles is contained in a text when at least need = ceil(threshold * q) of them occur there.
Then at most q - need are missing, so among the item's q - need + 1 smallest shingle hashes (its bottom-k MinHash
sketch) at least one occurs in the text: the search by sketches misses no contained item. Items are partitioned by
size: the words of their shingles, and doublings of q. A partition has its own ceiling, the largest hash in its sketches,
and its least need; its number is part of the join's key. One scan sends each shingle of a text to the partitions whose
least need the text reaches and whose ceiling the shingle's hash does not pass. A second one reads the texts with a
candidate again and verifies them with the shingles themselves.

Shingles have `width` words (lower-case runs of letters and digits; only A-Z are lower-cased); an item with fewer words
is one shingle of all its words, looked up among shingles of that many words. Defined results: null and empty texts, and
items without words, match nothing; repeated texts each match, repeated items (same id and text) count once. Different
texts under one id, or under none, are looked up apart, and the best contained one is reported; ties go to the more
shared shingles.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_scan import words
from .shared import cut, table, unused

#: Item shingles, and keys of candidate texts, are broadcast up to these counts; beyond them the joins shuffle.
BROADCAST_SHINGLES, BROADCAST_KEYS = 200_000, 200_000


def _shingles(df: DataFrame, keep: list, width: int) -> DataFrame:
    """Rows (keep..., n words of the text, p, s0 .. s[width - 1]): the words of df.w from each place p on, null behind the text's end.

    The outer form keeps Spark from splitting each text once more to look for empty sequences.
    """
    rows = df.select(*keep, "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("p")).where("p IS NOT NULL")
    return rows.select(*keep, F.size("w").alias("n"), "p", *[F.get("w", F.col("p") + i).alias(f"s{i}") for i in range(width)])


def _hash(width: int) -> F.Column:
    return F.xxhash64(*[f"s{i}" for i in range(width)])


def item_sketches(items: DataFrame, key: str, text: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Distinct shingles of the items (item, item_text, m words, s0.., h, q, need, sketch, size_class), and the ceiling of each size partition."""
    rows = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    rows = rows.withColumn("item_text", F.xxhash64("w")).withColumn("m", F.least(F.size("w"), F.lit(width)))
    one = _shingles(rows, ["item", "item_text", "m"], width).where(F.col("p") <= F.col("n") - F.col("m")).drop("n", "p").distinct()
    w = Window.partitionBy("item", "item_text")
    h = F.coalesce(*[F.when(F.col("m") == m, _hash(m)) for m in range(1, width + 1)])
    one = one.withColumn("h", h).withColumn("q", F.count("*").over(w)).withColumn("need", F.ceil(F.col("q") * threshold))
    one = one.withColumn("sketch", F.row_number().over(w.orderBy("h", *[f"s{i}" for i in range(width)])) <= F.col("q") - F.col("need") + 1)
    one = one.withColumn("size_class", F.floor(F.log2("q")).cast("int"))
    return one, one.where("sketch").groupBy("m", "size_class").agg(F.max("h").alias("ceiling"), F.min("need").alias("least"))


def _sent(shingles: DataFrame, keep: list, width: int, partitions: list[tuple[int, int | None, int]]) -> DataFrame:
    """(keep..., n, part, h, s0..): each shingle once for every partition (m, ceiling, least) that it may hit; h hashes its first m words."""
    w = [f"s{i}" for i in range(width)]
    hashed = shingles.select(*keep, "n", "p", *w, *[_hash(m).alias(f"h{m}") for m in sorted({m for m, _, _ in partitions})])

    def goes(m: int, ceiling: int | None, least: int) -> F.Column:
        fits = (F.col("n") - m + 1 >= least) & (F.col("p") <= F.col("n") - m)
        return fits if ceiling is None else fits & (F.col(f"h{m}") <= ceiling)

    somewhere = [goes(*p) for p in partitions]
    rows = hashed.where(reduce(or_, somewhere)).withColumn("part", F.explode(F.array(*[F.when(g, k) for k, g in enumerate(somewhere)]))).where("part IS NOT NULL")
    h = F.coalesce(*[F.when(F.col("part") == k, F.col(f"h{m}")) for k, (m, _, _) in enumerate(partitions)])
    return rows.select(*keep, "n", "part", h.alias("h"), *w)


def _alike(width: int) -> F.Column:
    """Joins shingles (part, h, s0..) to those of items (ipart, ih, im, is0..).

    One long number is the join's key, which Spark looks up fastest; partition and words are then compared one by one, in
    a form that keeps them out of the key.
    """
    same = lambda a, b: F.greatest(a, b) == F.least(a, b)
    words_ = [(F.col("im") <= i) | same(f"s{i}", f"is{i}") for i in range(width)]
    return reduce(and_, [F.col("h").bitwiseXOR(F.col("part")) == F.col("ih").bitwiseXOR(F.col("ipart")), same("part", "ipart"), *words_])


def _contained(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, width: int, threshold: float) -> DataFrame:
    """(k, same, item, q, n_shared) of the pairs that verify, one for each text of an item; `same` is the hash of the document's text."""
    one, per_class = item_sketches(items, item_key, item_text, width, threshold)
    one = cut(one)
    classes = sorted(tuple(c) for c in per_class.select("m", "size_class", "ceiling", "least").collect())  # each m up to `width`, each doubling of the item size
    if not classes:
        return docs.sparkSession.createDataFrame([], f"k {docs.schema[key].dataType.simpleString()}, same long, item {items.schema[item_key].dataType.simpleString()}, q long, n_shared long")
    w = [f"s{i}" for i in range(width)]
    other = ["ipart", F.col("h").alias("ih"), F.col("m").alias("im"), *[F.col(x).alias("i" + x) for x in w]]
    alike = _alike(width)
    small = F.broadcast if one.count() <= BROADCAST_SHINGLES else (lambda df: df)
    raw = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    rows = raw.select("k", "same", words(F.col("text")).alias("w"))
    number = F.coalesce(*[F.when((F.col("m") == m) & (F.col("size_class") == c), k) for k, (m, c, _, _) in enumerate(classes)])
    sketches = one.where("sketch").withColumn("ipart", number).select("need", *other)
    found = _sent(_shingles(rows, ["k", "same"], width), ["k", "same"], width, [(m, ceiling, least) for m, _, ceiling, least in classes])
    found = cut(found.join(small(sketches), alike & (F.col("n") - F.col("im") + 1 >= F.col("need"))).select("k", "same").distinct())
    # verification: the texts with candidates once more, now against all shingles of the items, partitioned by their words only
    keys = found.select(F.col("k").alias("ck"), F.col("same").alias("cs"))
    keys = F.broadcast(keys) if found.count() <= BROADCAST_KEYS else keys
    texts = raw.join(keys, F.col("k").eqNullSafe(F.col("ck")) & (F.col("same") == F.col("cs")), "left_semi").select("k", "same", words(F.col("text")).alias("w"))
    lengths = sorted({m for m, _, _, _ in classes})
    every = one.withColumn("ipart", F.coalesce(*[F.when(F.col("m") == m, k) for k, m in enumerate(lengths)])).select("item", "item_text", "q", "need", *other)
    hits = _sent(_shingles(texts, ["k", "same"], width), ["k", "same"], width, [(m, None, 1) for m in lengths]).join(small(every), alike)
    mine = [F.when(F.col("im") > i, F.col(x)) for i, x in enumerate(w)]
    return hits.groupBy("k", "same", "item", "item_text", "q", "need").agg(F.count_distinct(F.struct(*mine)).alias("n_shared")).where("n_shared >= need").drop("item_text", "need")


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (key, item_key, n_shared, n_shingles, containment) of whole texts and the items they contain."""
    found = _contained(docs, items, key, text, item_key, item_text, width, threshold)
    best = found.groupBy("k", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("q")).alias("containment"), "n_shared", "q")).alias("m"))
    return best.select(F.col("k").alias(key), F.col("item").alias(item_key), "m.n_shared", F.col("m.q").alias("n_shingles"), "m.containment")


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that contain none of the items."""
    own, same = unused(docs, "_bad"), unused(docs, "_same")
    bad = _contained(docs, items, key, text, item_key, item_text, width, threshold).select(F.col("k").alias(own), F.col("same").alias(same)).distinct()
    bad = cut(bad)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return docs.join(bad, docs[key].eqNullSafe(bad[own]) & (F.xxhash64(docs[text]) == bad[same]), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) whose document holds at least 0.8 of the item's 5-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, len(w) AS n, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE [w[p:p + 4] FOR p IN range(1, len(w) - 3)] END) AS s FROM i WHERE len(w) > 0),
c AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
m AS (SELECT DISTINCT least(n, 5) AS m FROM q),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest([w[p:p + m - 1] FOR p IN range(1, len(w) - m + 2)]) AS s FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN q USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM h JOIN c USING (item_id) WHERE n_shared >= ceil(0.8 * n_shingles)"""

"""Mixing sources to target weights, in DataFrame functions only.

targets()  weights go round the sources (by code point, null last); all of them share `budget` times the words of all
           texts. A source's target stops at `most` times its words; what is over goes to the others by weight, in rounds
           until none is above.
packed()   the texts of a source stand one after the other, in the order of a hash of key and text, and are cut into
           blocks of `block` words. A text has a piece in each block that it touches.
counts()   how many blocks of each source an output shard gets: a multinomial draw conditioned on the source's number of
           draws. Every source has as many labels as draws, and a pseudorandom permutation deals all labels to the slots of
           all shards. (Free multinomial draws would miss the targets by chance and could take a block a third time.)
slots()    the draws of a source, numbered through its shards, run through a pseudorandom permutation of its blocks, one
           permutation for each time around. A permutation takes each block once, so no block is taken more than `most`
           times, and no text more than `most` times its size.
mixed()    slots joined to blocks by (source, block): the words of every slot of every shard.

Running sums go by buckets of a hash and buckets of buckets, so no source is summed in one task, and equal rows are
counted once before they are laid out. Permutations are six rounds over the two digits of the index; an index that leaves the
range is permuted on until it is back in it.

Defined results: a null or empty text has size 0 and lies in no block; null keys and sources are values like any other;
repeated rows are texts of their own, each with its own place (rows that are equal in key and text may swap places); a
source without words has the target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, table

#: Fixed by the task: weights in turn, share of all words, and the most that a source or text may be taken.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
#: Words of a block, and blocks of an output shard.
BLOCK, SHARD = 64, 4_096
SEED = 20_11
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket about, and buckets of a bucket of buckets.
BUCKET, WIDER = 1_024, 1_024
#: Draws that one row spreads to, such rows that a task gets, and sources that are broadcast at most.
STEP, EACH, FEW = 65_536, 4, 20_000
#: Modulus and multipliers of the permutations' rounds.
_P, _BY = 2_147_483_647, (1_103_515_245, 1_664_525, 69_621_907, 742_938_285, 950_706_376, 1_226_874_159)


def _dealt(df: DataFrame) -> DataFrame:
    """df, which a join deals out by its key and never broadcasts: Spark takes the size before an explode() for the size
    after it, so slots and their blocks would go whole through the driver."""
    return df.hint("merge")


def _rounds(x: str, a: str, b: str, key: str) -> str:
    left, right = f"({x} div {b})", f"({x} % {b})"
    for i, by in enumerate(_BY):
        other = right if i % 2 == 0 else left
        turned = f"((({other} + {key}) % {_P}) * {by}) % {_P}"
        if i % 2 == 0:
            left = f"(({left} + {turned}) % {a})"
        else:
            right = f"(({right} + {turned}) % {b})"
    return f"({left} * {b} + {right})"


def permuted(df: DataFrame, x: str, n: str, key: str, out: str) -> DataFrame:
    """df with `out`: column x, in [0, n), under a permutation of [0, n) that `key` picks."""
    df = df.withColumn("_a", F.expr(f"cast(ceil(sqrt({n})) as bigint)")).withColumn("_b", F.expr(f"({n} + _a - 1) div _a"))
    df = df.withColumn("_key", F.expr(f"({key}) % {_P}")).withColumn("_x", F.expr(_rounds(x, "_a", "_b", "_key")))
    # _a * _b is less than n + _a, so at most _a steps lie outside the range
    back = f"aggregate(sequence(1L, _a), _x, (y, i) -> if(y < {n}, y, {_rounds('y', '_a', '_b', '_key')}))"
    return df.withColumn(out, F.expr(f"if(_x < {n}, _x, {back})")).drop("_a", "_b", "_key", "_x")


def running(df: DataFrame, group: str, fine: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of its group that come before it, by bucket `fine`, then `order`.

    Windows hold a bucket, the buckets of a wider bucket, or the wider buckets of a group.
    """

    def before(x: DataFrame, keys: list[str], by: list[str], v: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return x.withColumn(name, F.coalesce(F.sum(v).over(w), F.lit(0)))

    df = before(df, [group, fine], order, value, "_in")
    fines = df.groupBy(group, fine).agg(F.sum(value).alias("_v")).withColumn("_wide", F.expr(f"{fine} div {WIDER}"))
    wides = before(fines.groupBy(group, "_wide").agg(F.sum("_v").alias("_u")), [group], ["_wide"], "_u", "_far").drop("_u")
    near = before(fines, [group, "_wide"], [fine], "_v", "_near").join(_dealt(wides), [group, "_wide"])
    on = near.select(group, fine, (F.col("_near") + F.col("_far")).alias("_on"))
    return df.join(_dealt(on), [group, fine]).withColumn(out, F.col("_in") + F.col("_on")).drop("_in", "_on")


def _turn(key: str, text: str):
    """Where a text stands in its source: a hash of key and text."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(src, k, size, turn, n): the different rows of docs with their words and their order, and how many of each."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(source).alias("src"), F.col(key).alias("k"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), _turn(key, text).alias("turn"))
    return rows.groupBy("src", "k", "size", "turn").agg(F.count("*").alias("n"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(src, no, words, target, blocks, draws, label) of every source; label is the first of its `draws` labels."""
    src = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    spread = cut(src.repartitionByRange(F.col("src").isNull(), "src").withColumn("_part", F.spark_partition_id().cast("long")))
    spread = spread.withColumns({"_all": F.lit(0), "_none": F.col("src").isNull(), "_one": F.lit(1)})
    spread = cut(running(spread, "_all", "_part", ["_none", "src"], "_one", "no").drop("_one"))
    spread = spread.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    words = spread.agg(F.sum("words")).first()[0] or 0
    level, above = 0.0, -1
    while True:
        full = F.lit(level) * F.col("w") > most * F.col("words")
        held = spread.agg(F.count_if(full).alias("above"), F.sum(F.when(full, most * F.col("words"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if held.above == above or not held.open:
            break
        above, level = held.above, (budget * words - (held.full or 0)) / held.open
    target = F.least((most * F.col("words")).cast("double"), F.lit(level) * F.col("w"))
    out = spread.withColumn("target", target).withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}"))
    share = F.when(F.col("words") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("words") + 0.5)).otherwise(0).cast("long")
    out = out.withColumn("draws", F.least(share, most * F.col("blocks")))
    return cut(running(out, "_all", "_part", ["_none", "src"], "draws", "label").drop("_all", "_part", "_none", "w"))


def _beside(plan: DataFrame) -> DataFrame:
    """The plan, broadcast if it has few sources."""
    return F.broadcast(plan) if plan.limit(FEW + 1).count() <= FEW else plan


def packed(sizes: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces (no, k, size, turn, copy, block, at, some): words [at, at + some) of a text lie in the block; one piece
    without a block for a text without words."""
    rows = sizes.agg(F.count("*")).first()[0]
    buckets = max(1, rows // BUCKET)
    of = F.expr(f"cast(conv(substr(turn, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    numbered = sizes.join(_beside(plan.select(F.col("src").alias("_src"), "no")), F.col("src").eqNullSafe(F.col("_src"))).drop("_src", "src")
    placed = running(numbered.withColumns({"bucket": of, "_all": F.col("size") * F.col("n")}), "no", "bucket", ["turn", "k", "size"], "_all", "first")
    copies = placed.withColumn("_from", F.explode(F.expr(f"sequence(0L, n - 1, {STEP}L)"))).withColumn("copy", F.explode(F.expr(f"sequence(_from, least(_from + {STEP - 1}, n - 1))")))
    copies = copies.withColumn("first", F.col("first") + F.col("copy") * F.col("size"))
    blocks = F.explode_outer(F.expr(f"if(size > 0, sequence(first div {block}, (first + size - 1) div {block}), null)"))
    pieces = copies.select("no", "k", "size", "turn", "copy", "first", blocks.alias("block"))
    begin = F.greatest(F.col("first"), F.col("block") * block)
    return pieces.select("no", "k", "size", "turn", "copy", "block", (begin - F.col("first")).alias("at"), (F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("some"))


def counts(plan: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, no, n): blocks that an output shard draws from a source."""
    total = plan.agg(F.sum("draws")).first()[0] or 0
    some = plan.where("draws > 0").select("no", "label", "draws", F.explode(F.expr(f"sequence(0L, draws - 1, {STEP}L)")).alias("_from"))
    some = some.repartition(max(1, -(-total // (STEP * EACH))), "no", "_from")
    labels = some.select("no", F.explode(F.expr(f"sequence(label + _from, label + least(_from + {STEP - 1}, draws - 1))")).alias("_label"), F.lit(total).alias("_n"))
    dealt = permuted(labels, "_label", "_n", f"{seed}", "_slot")
    return dealt.groupBy(F.expr(f"_slot div {shard}").alias("shard"), "no").agg(F.count("*").alias("n"))


def slots(plan: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, no, block): which block of which source every slot of every output shard takes."""
    c = cut(counts(plan, shard, seed))
    c = running(c.withColumn("_few", F.expr(f"shard div {WIDER}")), "no", "_few", ["shard"], "n", "_drawn").drop("_few")
    w = Window.partitionBy("shard")
    c = c.withColumn("_at", F.sum("n").over(w.orderBy("no")) - F.col("n")).withColumn("_room", F.sum("n").over(w))
    # few rows stand for many slots: they are dealt out by their number, not by their bytes
    tasks = max(1, -(-(c.agg(F.sum("n")).first()[0] or 0) // (STEP * EACH)))
    c = c.join(_beside(plan.select("no", "blocks")), "no").repartition(tasks, "shard", "no").withColumn("_i", F.explode(F.expr("sequence(0L, n - 1)")))
    c = c.withColumn("_at", F.col("_at") + F.col("_i")).withColumn("_draw", F.col("_drawn") + F.col("_i"))
    c = permuted(c, "_at", "_room", f"{seed} + 1000003 * (shard % 1000000007)", "slot")
    c = c.withColumn("_time", F.expr("_draw div blocks")).withColumn("_index", F.expr("_draw % blocks"))
    c = permuted(c, "_index", "blocks", f"{seed} + 7919 * (no % 1000000007) + 104729 * (_time + 1)", "block")
    return c.select("shard", "slot", "no", "block")


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken) of every row of docs: how many of its words the mix takes."""
    sizes = cut(sized(docs, key, text, source))
    plan = targets(sizes, block=block)
    times = slots(plan, shard, seed).groupBy("no", "block").agg(F.count("*").alias("times"))
    pieces = packed(sizes, plan, block).join(_dealt(times), ["no", "block"], "left")
    rows = pieces.groupBy("no", "turn", "k", "size", "copy").agg(F.sum(F.coalesce(F.col("some") * F.col("times"), F.lit(0))).alias("taken"))
    named = rows.join(_beside(plan.select("no", F.col("words").alias("source_size"), "target")), "no")
    return named.select(F.col("k").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, words array): the mix itself. Blocks are cut once and joined to their slots."""
    sizes = cut(sized(docs, key, text, source))
    plan = targets(sizes, block=block)
    pieces = packed(sizes, plan, block).where("block is not null").select("no", "turn", "k", "copy", "block", "at", "some")
    # one text for each turn: rows that are equal in key and text share their words
    texts = docs.select(_turn(key, text).alias("turn"), F.col(text).alias("_text")).dropDuplicates(["turn"])
    cut_up = pieces.groupBy("turn").agg(F.collect_list(F.struct("no", "copy", "block", "at", "some")).alias("_pieces"))
    words = cut_up.join(_dealt(texts), "turn").withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1)).select("turn", "_words", F.explode("_pieces").alias("_p"))
    parts = words.select("_p.no", "_p.block", F.struct("turn", "_p.copy", "_p.at", F.expr("slice(_words, cast(_p.at + 1 as int), cast(_p.some as int))").alias("words")).alias("_part"))
    blocks = parts.groupBy("no", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p.words)).alias("words"))
    return slots(plan, shard, seed).join(_dealt(blocks), ["no", "block"]).join(_beside(plan.select("no", F.col("src").alias("source"))), "no").select("shard", "slot", "source", "block", "words")


def op11_mixture(spark, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def _walk(name: str, rows: str, x: str, n: str, key: str) -> str:
    """SQL: `rows` with y, column x under the permutation."""
    once = _rounds("y", "a", "b", "k").replace(" div ", " // ")
    return f"""{name}_0 AS (SELECT *, {x} AS y, ceil(sqrt({n}))::BIGINT AS a, ({n} + ceil(sqrt({n}))::BIGINT - 1) // ceil(sqrt({n}))::BIGINT AS b, ({key}) % {_P} AS k, 0 AS step FROM {rows}),
{name}_1 AS (SELECT * FROM {name}_0 UNION ALL SELECT * REPLACE ({once} AS y, step + 1 AS step) FROM {name}_1 WHERE step = 0 OR y >= {n}),
{name} AS (SELECT * EXCLUDE (a, b, k, step) FROM {name}_1 WHERE step > 0 AND y < {n})"""


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS turn, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, coalesce(sum(2 * words) OVER (ORDER BY 2.0 * words / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(w) OVER (ORDER BY 2.0 * words / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (1.5 * (SELECT sum(words) FROM s)::DOUBLE - held::DOUBLE) / rest AS level FROM f),
t AS (SELECT source, no, words, least(2.0 * words, w * (SELECT coalesce(arg_min(level, 2.0 * words / w), 0) FROM l WHERE level * w <= 2 * words))::DOUBLE AS target, (words + {BLOCK - 1}) // {BLOCK} AS blocks FROM l),
u AS (SELECT *, least(2 * blocks, CASE WHEN words > 0 THEN floor(target * blocks / words + 0.5)::BIGINT ELSE 0 END) AS draws FROM t),
p AS (SELECT *, (sum(draws) OVER (ORDER BY no) - draws)::BIGINT AS label, (sum(draws) OVER ())::BIGINT AS all_draws FROM u),
x AS (SELECT no, all_draws, unnest(range(label, label + draws)) AS label FROM p),
{_walk("dealt", "x", "label", "all_draws", str(SEED))},
c AS (SELECT y // {SHARD} AS shard, no, count(*) AS n FROM dealt GROUP BY ALL),
e AS (SELECT shard, no, n, (sum(n) OVER (PARTITION BY no ORDER BY shard) - n)::BIGINT AS drawn FROM c),
g AS (SELECT no, blocks, unnest(range(drawn, drawn + n)) AS draw FROM e JOIN p USING (no)),
h AS (SELECT no, blocks, draw % blocks AS i, draw // blocks AS times FROM g),
{_walk("mix", "h", "i", "blocks", f"{SEED} + 7919 * no + 104729 * (times + 1)")},
m AS (SELECT no, y AS block, count(*) AS times FROM mix GROUP BY ALL),
o AS (SELECT d.doc_id, d.size, d.turn, p.no, p.words, p.target, (sum(d.size) OVER (PARTITION BY p.no ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS first,
        row_number() OVER () AS id FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT id, no, first, size, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS block FROM o WHERE size > 0),
r AS (SELECT id, sum(m.times * (least(first + size, (block + 1) * {BLOCK}) - greatest(first, block * {BLOCK}))) AS taken FROM q JOIN m USING (no, block) GROUP BY id)
SELECT doc_id, size, words AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN r USING (id)"""

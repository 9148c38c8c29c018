"""Exact top-k by inner product with MaxScore, over integer vectors.

Vectors become floor(256 x). Queries and candidates are cut into blocks; a pair of blocks is one task, so no query is
held against rows one pair at a time, and every query meets every row. In a block each dimension is a term whose
postings are one column over the rows. A query's contribution of a term lies between two bounds that follow from the
column's extremes; above the lower bound it is a score of at least zero, and the width of the bounds is the term's
largest score. Terms are sorted by that width.

Rows are visited in ranges. With the k-th best score so far, the terms split: those whose summed largest scores, all
lower bounds included, stay below it are non-essential, since a row scored by them alone can't reach it. The postings of
the essential terms are traversed; the rest are probed, term group by term group, for rows whose partial score plus the
remaining bounds stays competitive. Each range raises the k-th best score, which moves the split. Each block returns its
k best for each query, and a window merges the blocks.

Sums are exact: float64 holds them below 2 ** 53, else long integers below 2 ** 63, else Python's integers; components
and scores beyond a long are kept at its ends.

Defined results: a vector that is null, empty, or holds a null or non-finite component, or whose id is null, takes no
part; shorter vectors count as padded with zeros; ties go to the smaller id; equal rows (id and vector) count once; a row
is never a candidate of a query with the same id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, release, table

QUERY_BLOCK, ROW_BLOCK = 4_096, 32_768
#: Rows visited between two splits of the terms, and non-essential terms probed at a time.
RANGE, GROUP = 4_096, 8


def integers(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    v = F.col(vector)
    sound = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(sound).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    ends = np.cumsum(sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """The fastest type that holds every partial sum exactly."""
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    bound = most(queries) * most(rows) * queries.shape[1]
    return np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 62 else object


def split(bound: np.ndarray, base, floor) -> int:
    """How many of the terms are essential, by falling bound: all others together, over `base`, stay below `floor`."""
    rest = np.concatenate([np.cumsum(bound[::-1])[::-1], np.zeros(1, bound.dtype)])  # what the terms from each place on can add
    return len(bound) if floor is None else int(np.count_nonzero(base + rest >= floor))


def best_in_block(ids: np.ndarray, rows: np.ndarray, query_id: int, q: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, splits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row indices, scores) of the k best rows for one query; ids rise, rows is (dimension, row). `splits` takes every split."""
    least, most = np.minimum(q * high, q * low), np.maximum(q * high, q * low)
    order = np.argsort((least - most).astype(np.float64), kind="stable")
    bound, base = (most - least)[order], least.sum()
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], np.zeros(1, most.dtype)])  # the most that terms from each place on can add
    top, score, floor = np.zeros(0, np.int64), np.zeros(0, q.dtype), None
    for i in range(0, len(ids), RANGE):
        j = min(len(ids), i + RANGE)
        essential = split(bound, base, floor)
        if splits is not None:
            splits.append(essential)
        partial = q[order[:essential]] @ rows[order[:essential], i:j] if essential else np.zeros(j - i, q.dtype)
        alive, place = np.flatnonzero(ids[i:j] != query_id), essential
        partial = partial[alive]
        while True:
            if floor is not None:
                keep = partial + rest[place] >= floor
                alive, partial = alive[keep], partial[keep]
            if place >= len(q) or not len(alive):
                break
            terms = order[place : place + GROUP]
            partial = partial + q[terms] @ rows[np.ix_(terms, alive + i)]
            place = min(len(q), place + GROUP)
        top, score = np.concatenate([top, alive + i]), np.concatenate([score, partial])
        if len(top) > k:
            if len(top) > 4 * k and score.dtype != object:  # those below the k-th best, and none of its ties, can go
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                top, score = top[keep], score[keep]
            first = np.argsort(-score, kind="stable")[:k]  # places rise, and so do ids
            top, score = top[first], score[first]
            again = np.argsort(top)
            top, score = top[again], score[again]
        if len(top) == k:
            floor = score.min()
    first = np.argsort(-score, kind="stable")
    return top[first], score[first]


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each row whose id is divisible by `every`."""
    rows = cut(integers(df, key, vector))
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries = rows.where(F.col("id") % every == 0).count()
    qb, rb = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(total / ROW_BLOCK), min(6, math.ceil(total / 1024)))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", block(qb).alias("q"), all_of(rb).alias("r"))
    points = rows.select("id", "v", block(rb).alias("r"), all_of(qb).alias("q"))

    def search(some: pa.Table, against: pa.Table) -> pa.Table:
        names, out = ["query_id", "id", "score"], []
        if some.num_rows and against.num_rows:
            against = against.sort_by("id")
            ids, m, qs = against.column("id").to_numpy(), _matrix(against.column("v"), width), _matrix(some.column("v"), width)
            kind = exact_type(qs, m)
            m, qs = np.ascontiguousarray(m.T.astype(kind)), qs.astype(kind)
            high, low = m.max(axis=1), m.min(axis=1)
            for i, q in zip(some.column("id").to_numpy(), qs):
                at, score = best_in_block(ids, m, i, q, high, low, k)
                score = score if kind is not object else np.clip(score, -(1 << 63), (1 << 63) - 1)
                out.append((np.full(len(at), i), ids[at], score.astype(np.int64)))
            del m, qs
            release()
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(cols, names=names)

    found = queries.groupBy("q", "r").cogroup(points.groupBy("q", "r")).applyInArrow(search, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

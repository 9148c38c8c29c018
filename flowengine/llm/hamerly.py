"""Centroid clustering of integer vectors (k-means) with Hamerly's bounds.

Every vector keeps its centroid, an upper bound of the distance to it and one lower bound of the distance to any other.
After an update the upper bound grows by its centroid's drift and the lower bound shrinks by the largest drift among the
others. Where the upper bound stays below the lower one, the vector keeps its centroid unseen. Else the upper bound is
tightened to the exact distance, and what is still ambiguous gets a full scan: exact integer distances to all centroids,
ties to the smaller number. Bounds are widened by more than their rounding errors, so the result is that of full scans.

A round is one pass over the vectors, which carry their state in a table written to the shared folder. Vectors that changed
hands add themselves to the new centroid's sums and take themselves from the old one's; tasks add these up, Spark adds up
the tasks' rows, and k x dimensions sums reach the driver. k centroids are the only thing sent to the tasks.

Defined results: a vector that is null, has not exactly `dim` components, or holds a null or non-finite one takes no part;
a null key is written as an empty text when centroids are drawn, repeated rows are vectors of their own; with fewer vectors
than k there are as many centroids as vectors; components beyond +-2 ** 27 are kept at these ends, so that distances
are exact longs, and sums of distances beyond a long are kept at its end; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, extended, table, tidy

#: Fixed by the task: number of centroids, rounds, components, the factor to integers, and what the first centroids are drawn by.
K, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256.0, "2:"
LIMIT = 1 << 27
#: Vectors that a task holds at a time, by their distances to all centroids.
_CELLS = 1 << 21
#: Bounds widen by this share and this much more: far above the rounding of a square root and of a few sums.
_WIDE, _MORE = 1e-9, 1e-6
STATE = {"_of": T.IntegerType(), "_was": T.IntegerType(), "_up": T.DoubleType(), "_low": T.DoubleType()}


def integers(df: DataFrame, vector: str, dim: int, scale: float, out: str) -> DataFrame:
    """The rows that take part, with `out`: the vector as little-endian 32-bit integers."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.where(sound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_raw").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype("<i4")
            rows = pa.Array.from_buffers(pa.binary(4 * dim), len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], rows], [*b.schema.names[:-1], out])

    return kept.withColumn("_raw", v).mapInArrow(tidy(run), extended(df, **{out: T.BinaryType()}))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    a = column.cast(pa.large_binary())
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return data[offsets[0] : offsets[-1]].view("<i4").reshape(len(a), dim).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row a vector, one column a centroid."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 52:  # floats hold every partial sum
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def own_squared(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    return ((x - c[of]) ** 2).sum(1)


def assigned(x: np.ndarray, c: np.ndarray, of: np.ndarray, up: np.ndarray, low: np.ndarray, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper bound, lower bound) of every vector, and how many took a full scan. Without drift all do."""
    of, up, low = of.copy(), up.copy(), low.copy()
    if drift is None:
        scan = np.arange(len(x))
    else:
        first = int(np.argmax(drift))
        second = np.delete(drift, first).max(initial=0.0)
        up = (up + drift[of]) * (1 + _WIDE) + _MORE
        low = (low - np.where(of == first, second, drift[first])) * (1 - _WIDE) - _MORE
        doubt = np.flatnonzero(up >= low)
        up[doubt] = np.sqrt(own_squared(x[doubt], c, of[doubt]).astype(np.float64)) * (1 + _WIDE) + _MORE
        scan = doubt[up[doubt] >= low[doubt]]
    if len(scan):
        d = squared(x[scan], c)
        best = np.argmin(d, 1)  # the first of equals
        rows = np.arange(len(scan))
        of[scan], up[scan] = best, np.sqrt(d[rows, best].astype(np.float64)) * (1 + _WIDE) + _MORE
        d[rows, best] = np.iinfo(np.int64).max
        low[scan] = np.sqrt(d.min(1).astype(np.float64)) * (1 - _WIDE) - _MORE if len(c) > 1 else np.inf
    return of, up, low, len(scan)


def _step(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, vec: str, dim: int) -> DataFrame:
    """state after an assignment to the centroids c."""
    size = max(1, _CELLS // max(len(c), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                b = batch.slice(i, size)
                was = b.column("_of").to_numpy(zero_copy_only=False)
                of, up, low, _ = assigned(matrix(b.column(vec), dim), c, np.maximum(was, 0), b.column("_up").to_numpy(zero_copy_only=False), b.column("_low").to_numpy(zero_copy_only=False), drift)
                own = {"_of": of.astype(np.int32), "_was": was, "_up": up, "_low": low}
                yield pa.RecordBatch.from_arrays([pa.array(own[n]) if n in own else b.column(n) for n in b.schema.names], b.schema.names)

    return state.mapInArrow(tidy(run), state.schema)


def _moved(state: DataFrame, k: int, vec: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """How the sums and counts of the centroids change by the vectors that changed hands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, of, was = matrix(b.column(vec), dim), b.column("_of").to_numpy(), b.column("_was").to_numpy()
            np.add.at(total, of, x)
            np.add.at(n, of, 1)
            np.subtract.at(total, was[was >= 0], x[was >= 0])
            np.subtract.at(n, was[was >= 0], 1)
        at, dims = np.nonzero(total)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, some])), pa.array(np.concatenate([dims, np.full(len(some), dim)])), pa.array(np.concatenate([total[at, dims], n[some]]))], ["c", "d", "v"])

    rows = state.where("_of != _was").select(vec, "_of", "_was").mapInArrow(tidy(run), "c long, d long, v long")
    total, n = np.zeros((k, dim), object), np.zeros(k, object)
    for r in rows.groupBy("c", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k x (dim + 1) rows at most
        if r.d == dim:
            n[r.c] = int(r.v)
        else:
            total[r.c, r.d] = int(r.v)
    return total, n


def first_centroids(rows: DataFrame, k: int, salt: str, key: str, vec: str, dim: int) -> np.ndarray:
    """The k vectors whose salted keys have the smallest hashes, by hash, then vector."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    some = rows.select(named.alias("h"), F.col(vec).alias("v")).orderBy("h", "v").limit(k).collect()
    some.sort(key=lambda r: (r.h, bytes(r.v)))
    return np.array([np.frombuffer(r.v, "<i4") for r in some], np.int64).reshape(len(some), dim)


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, salt: str = SALT, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows with _v, _of, _up, _low and the other state, centroids): df's sound rows after `rounds` updates and one more assignment."""
    vec = "_v"
    taken = {c.lower() for c in df.columns} & {vec, "_raw", *STATE}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)}")
    rows = integers(df, vector, dim, scale, vec).drop(vector)
    state = cut(rows.withColumns({name: F.lit(-1 if kind == T.IntegerType() else 0.0).cast(kind) for name, kind in STATE.items()}))
    c = first_centroids(state, k, salt, key, vec, dim)
    if not len(c):
        return state, c
    total, n, drift = np.zeros((len(c), dim), object), np.zeros(len(c), object), None
    for t in range(rounds + 1):
        state = cut(_step(state, c, drift, vec, dim))
        if t == rounds:
            break
        more = _moved(state, len(c), vec, dim)
        total, n = total + more[0], n + more[1]
        new = c.copy()
        for i in np.flatnonzero(n):
            new[i] = [s // n[i] for s in total[i]]
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + _WIDE)
        c = new
    return state, c


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, salt: str = SALT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    state, c = clustered(df.select(key, vector), k, rounds, dim, scale, salt, key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("_of").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_of"), pa.array(own_squared(matrix(b.column("_v"), dim), c, of))], ["_key", "cluster", "distance"])

    kind = df.schema[key].dataType.simpleString()
    rows = state.select(F.col(key).alias("_key"), "_of", "_v").mapInArrow(tidy(run), f"_key {kind}, cluster int, distance long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s")).collect()  # k rows at most
    top = (1 << 63) - 1
    whole = min(top, sum(int(r.s) for r in sums))
    by = {int(r.cluster): min(top, int(r.s)) for r in sums}
    named = [(i, by.get(i, 0), whole, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(c)]
    facts = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Full scans in SQL: a component is a row (i: vector, d: dimension, x), a centroid component (c, d, y)."""
    out = rf"""
WITH sound AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
drawn AS (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM sound QUALIFY c < {K}),
x AS MATERIALIZED (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM sound),
c0 AS (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS d FROM drawn)"""
    for t in range(ROUNDS + 1):
        out += f""",
a{t} AS MATERIALIZED (SELECT i, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT i, c, sum((x - y) * (x - y))::BIGINT AS s FROM x JOIN c{t} USING (d) GROUP BY ALL) GROUP BY i)"""
        if t < ROUNDS:
            out += f""",
n{t} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{t} USING (i) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{t} LEFT JOIN n{t} USING (c, d))"""
    return out + f""",
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS "cluster", s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN sound USING (i) JOIN h USING (c)"""


ORACLE_SQL = _oracle()

"""Near duplicates by SimHash, linked by vantage-point trees over the distinct fingerprints.

fingerprints()  64-bit SimHash of the 3-word shingles of every whole text.
links()         a vantage-point tree, grown from a bounded sample of fingerprints, cuts the fingerprint space into
                shards. A fingerprint lives in one shard (its home) and is also sent, as a query, to every shard whose
                region its ball of radius `bits` overlaps by the triangle bounds. A shard splits further in memory by
                the same rule, compares what is left exactly, and returns a spanning set of its links, so that a group
                of m near copies gives about m rows.
components()    smallest reachable id over the links, by alternating star contractions.

The sample (`SAMPLE` fingerprints with the smallest hashes) decides only where shards lie, never which pairs are found:
all fingerprints are indexed and searched. Defined results: null and empty texts have the fingerprint zero and link
like any other; equal texts share a fingerprint; a null doc_id is never a component id unless its whole group is null;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release, table, tidy, unused
from .tokens import Words, chunks

BITS = 3
#: At most this many fingerprints reach the driver, to place the shards.
SAMPLE = 16_384
#: Shards at least, fingerprints that a shard is to hold at most, and queries that one task takes. A shard splits further
#: in memory, so few levels of shards are needed, and a fingerprint's copies do not grow with the table below
#: SHARDS * SHARD fingerprints.
SHARDS, SHARD, QUERIES = 32, 131_072, 262_144
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhashes(column: pa.Array, width: int = 3) -> np.ndarray:
    """SimHash of each text over all its word shingles, repeats included."""
    w = Words(column)
    spaced = np.zeros(len(w.data), bool)
    spaced[np.minimum(w.end, len(spaced) - 1)] = True  # one byte after each word becomes its space
    keep = spaced.copy()
    mark = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(mark, w.start, 1)
    np.add.at(mark, w.end, -1)
    inside = np.cumsum(mark[:-1]) > 0
    keep |= inside
    # words of two texts can touch: then no byte is free for the space, and none is needed, as shingles end there
    where = np.cumsum(keep) - keep
    text = w.data[keep]
    text[~inside[keep]] = 0x20
    raw, lo, hi = text.tobytes(), where[w.start], where[w.end - 1] + 1 if len(w) else where[:0]
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for d in range(len(column)):
        a, b = w.first[d], w.first[d + 1]
        if a == b:
            continue
        k = min(width, b - a)
        h = np.array([digest(raw[i:j], 42) for i, j in zip(lo[a : b - k + 1].tolist(), hi[a + k - 1 : b].tolist())], np.uint64)
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        out[d] = _POWERS[counts.ravel() * 2 > len(h)].sum()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(k, same long, fp long) of every row: its key, the hash of its text, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("same"), pa.array(simhashes(b.column("text"), width).view(np.int64))], ["k", "same", "fp"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), f"k {docs.schema[key].dataType.simpleString()}, same long, fp long")


class VantageTree:
    """Inner nodes: vantage point and median distance; leaves: shards, numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: int, bits: int):
        self.bits, self.point, self.radius, self.inside, self.outside, self.load = bits, [], [], [], [], []
        self.root = self._grow(sample, max(leaf, 2))

    def _grow(self, fps: np.ndarray, leaf: int) -> int:
        cut_at = _vantage(fps, self.bits) if len(fps) > leaf else None
        if cut_at is None:
            self.load.append(len(fps))
            return -len(self.load)  # leaf n is -1 - n
        point, radius, d = cut_at
        me = len(self.point)
        for part, x in ((self.point, point), (self.radius, radius), (self.inside, 0), (self.outside, 0)):
            part.append(x)
        self.inside[me], self.outside[me] = self._grow(fps[d <= radius], leaf), self._grow(fps[d > radius], leaf)
        return me

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows of fps that the shard must see, True where the shard is their home)."""
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, home
                continue
            d = np.bitwise_count(fps[rows] ^ self.point[node])
            r = self.radius[node]
            near, far = d <= r + self.bits, d > r - self.bits
            todo += [(self.inside[node], rows[near], home[near] & (d[near] <= r)), (self.outside[node], rows[far], home[far] & (d[far] > r))]


def _vantage(fps: np.ndarray, bits: int):
    """The most spreading of a few vantage points, its median distance, and all distances; None where none splits."""
    best = None
    for p in fps[:: max(1, len(fps) // 8)][:8]:
        d = np.bitwise_count(fps ^ p).astype(np.int64)
        r = int(np.median(d))
        inner = np.count_nonzero(d <= r)
        if inner in (0, len(d)):
            continue
        cost = np.count_nonzero(d <= r + bits) * inner + np.count_nonzero(d > r - bits) * (len(d) - inner)
        if best is None or cost < best[0]:
            best = (cost, p, r, d)
    return best and best[1:] if best and best[0] < 0.95 * len(fps) ** 2 else None


def linked(points: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links (distance 1 .. bits) between points and queries."""
    every = np.unique(np.concatenate([points, queries]))
    label = np.arange(len(every))
    todo = [(np.searchsorted(every, points), np.searchsorted(every, queries))]
    while todo:
        p, q = todo.pop()
        split = _vantage(every[p], bits) if len(p) * len(q) > 1 << 18 else None
        if split:
            v, r, d = split
            dq = np.bitwise_count(every[q] ^ v)
            todo += [(p[d <= r], q[dq <= r + bits]), (p[d > r], q[dq > r - bits])]
            continue
        step = max(1, (1 << 20) // max(1, len(q)))
        for i in range(0, len(p), step):
            a, b = np.nonzero(np.bitwise_count(every[p[i : i + step], None] ^ every[q][None, :]) <= bits)
            label = _merge(label, p[i : i + step][a], q[b])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member of its group, itself a root) after a and b were joined."""
    a, b = label[a], label[b]
    while (differ := a != b).any():
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
    return label


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) between distinct fingerprints fps.fp: enough of the links of at most `bits` bits to connect every group."""
    total = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = VantageTree(sample, max(2, min(len(sample) // SHARDS, SHARD * len(sample) // max(total, 1))), bits)
    # a shard with many queries is shared by several tasks: each takes all its points and a part of its queries
    scale = total / max(len(sample), 1)
    seen = np.zeros(len(tree.load))
    for shard, rows, _ in tree.route(sample):
        seen[shard] = len(rows) * scale
    parts = np.maximum(1, np.ceil(seen / QUERIES)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, rows, home in tree.route(x):
                n, y = int(parts[shard]), x[rows]
                points = np.repeat(y[home], n)
                part = np.concatenate([(y * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n, np.tile(np.arange(n), home.sum())])
                both = np.concatenate([y, points]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), shard)), pa.array(part), pa.array(both), pa.array(np.arange(len(both)) >= len(y))], ["shard", "part", "fp", "point"])

    def compare(group: pa.Table) -> pa.Table:
        x, point = group.column("fp").to_numpy().view(np.uint64), group.column("point").to_numpy()
        a, b = linked(x[point], x[~point], bits)
        release()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(tidy(send), "shard long, part long, fp long, point boolean").groupBy("shard", "part").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component with an edge, roots included."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e, before = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour moves to the smallest node around
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: every smaller neighbour, and the node itself, moves to the smallest one
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a")
        e = cut(star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def _grouped(docs: DataFrame, key: str, text: str, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, same, fp) of docs, and (fp, first) of every fingerprint: `first` is the row of its group that stays.

    That is the row (last, k, same) of the smallest key, null keys coming last, and of the smallest text hash if the key
    has several texts.
    """
    rows = cut(fingerprints(docs, key, text, width))
    one = rows.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "same")).alias("low"))
    roots = cut(components(links(rows.select("fp").distinct(), bits)))
    grouped = one.join(roots, one.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = grouped.groupBy("root").agg(F.min("low").alias("first"))
    return rows, grouped.join(first, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """(key, fp long, component_id): the smallest key that links lead to."""
    rows, groups = _grouped(docs, key, text, width, bits)
    out = rows.join(groups, "fp").select("k", "fp", F.col("first.k").alias("component_id"))
    return out.withColumnRenamed("k", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """One row of docs, all columns, of each group of near duplicates: that of the smallest key.

    If rows of one group share that key, one of them stays, whatever their texts: the one whose text has the smallest hash.
    A group whose keys are all null keeps such a row as well.
    """
    _, groups = _grouped(docs, key, text, width, bits)
    own, same, mine = unused(docs, "_keep"), unused(docs, "_text"), unused(docs, "_same")
    keep = groups.select(F.col("first.k").alias(own), F.col("first.same").alias(same)).distinct()
    hashed = docs.withColumn(mine, F.xxhash64(text))
    kept = hashed.join(keep, hashed[key].eqNullSafe(keep[own]) & (hashed[mine] == keep[same]), "left_semi")
    return kept.dropDuplicates([key, mine]).drop(mine)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

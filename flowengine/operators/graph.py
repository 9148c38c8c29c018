"""Graph construction, components, neighbourhoods and shortest paths."""

from __future__ import annotations

import math
import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nodes of a cell of the network (by ranges of ids), searches made at once in a cell, and such lots that share a task and its edges.
CELL, SOURCES, LOTS = 65_536, 64, 8
#: Values of a packed row, rows that are packed together, and values of a batch of results.
PACK, LOAD, VALUES = 512, 1 << 19, 1 << 19
#: Nodes of one label that share a task while components are found.
CROWD = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one under a local master, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowengine-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder as Parquet, and go on from there.

    A checkpoint would do, but it keeps the estimated size of the plan before it. In loops of joins these estimates
    multiply until planning takes longer than the work; a table has the size of its files.
    """
    at = f"{shared_folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def dense_ids(df: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """df with a dense row number in the order of `order`, without gathering all rows in one task.

    Range partitions are numbered in order; each row adds the size of the partitions before its own.
    """
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_part").orderBy(*order)
    return parts.join(F.broadcast(before), "_part").withColumn(out, F.row_number().over(w) + F.col("_before") + (first - 1)).drop("_part", "_before")


def lines_to_graph(lines: DataFrame, key: str = "line_id", coords: str = "coords", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines, arrays of (x, y): ends that agree after rounding are one node; ids are dense from 1."""
    at = lambda i: F.element_at(coords, i)
    ends = lines.withColumns({"_ax": F.round(at(1)["x"], digits), "_ay": F.round(at(1)["y"], digits), "_bx": F.round(at(-1)["x"], digits), "_by": F.round(at(-1)["y"], digits)})
    points = ends.select(F.explode(F.array(F.struct(F.col("_ax").alias("x"), F.col("_ay").alias("y")), F.struct(F.col("_bx").alias("x"), F.col("_by").alias("y")))).alias("p")).select("p.*").distinct()
    nodes = cut(dense_ids(points, ["x", "y"], "node_id"))
    a = nodes.select(F.col("x").alias("_ax"), F.col("y").alias("_ay"), F.col("node_id").alias("from"))
    b = nodes.select(F.col("x").alias("_bx"), F.col("y").alias("_by"), F.col("node_id").alias("to"))
    edges = dense_ids(ends.join(a, ["_ax", "_ay"]).join(b, ["_bx", "_by"]).drop("_ax", "_ay", "_bx", "_by"), [key], "edge_id")
    return nodes, edges


def symmetric(edges: DataFrame, *keep: str) -> DataFrame:
    """(src, dst, keep...) in both directions."""
    return edges.select(F.col("from").alias("src"), F.col("to").alias("dst"), *keep).unionByName(edges.select(F.col("to").alias("src"), F.col("from").alias("dst"), *keep))


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, neighbour): one hop around each node, itself included."""
    near = symmetric(edges).select(F.col("src").alias("node_id"), F.col("dst").alias("neighbour"))
    return near.join(nodes.select("node_id").distinct(), "node_id", "left_semi").unionByName(nodes.select("node_id", F.col("node_id").alias("neighbour"))).distinct()


def incident_edges(edges: DataFrame, nodes: DataFrame, both: bool = False) -> DataFrame:
    """Edges with one end (or both ends) among nodes."""
    some = nodes.select("node_id").distinct()
    a = edges.join(some, edges["from"] == some["node_id"], "left_semi")
    if both:
        return a.join(some, a["to"] == some["node_id"], "left_semi")
    return a.unionByName(edges.join(some, edges["to"] == some["node_id"], "left_semi")).distinct()


def adjacency(edges: DataFrame, *keep: str) -> DataFrame:
    """(src, neighbours array of (dst, keep...)), sorted."""
    return symmetric(edges, *keep).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", *keep))).alias("neighbours"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id reachable.

    Labels move to the smallest neighbour's label, then jump to their label's label, so long chains halve each round.
    """
    both = cut(symmetric(edges).where("src != dst"))  # an edge twice changes no minimum: making them distinct costs a shuffle of all
    labels = cut(nodes.select("node_id", F.col("node_id").alias("component")).distinct())
    while True:
        low = both.join(labels, both.src == labels.node_id).groupBy(F.col("dst").alias("node_id")).agg(F.min("component").alias("near"))
        hooked = labels.join(low, "node_id", "left").select("node_id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        hooked = cut(hooked)
        # most nodes soon share a label: its rows are dealt to several tasks, each with the label's one row of `up`
        shares = hooked.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("component", F.ceil(F.col("n") / CROWD).alias("parts"))
        shares = F.broadcast(cut(shares))  # fewer rows than nodes / CROWD
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        up = hooked.select(F.col("node_id").alias("component"), F.col("component").alias("up")).join(shares, "component", "left")
        up = up.select("component", "up", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        dealt = hooked.join(shares, "component", "left").withColumn("part", F.pmod(F.xxhash64("node_id"), parts))
        jumped = cut(dealt.join(up, ["component", "part"], "left").select("node_id", "was", F.least("component", "up").alias("component")))
        labels = jumped.select("node_id", "component")
        if jumped.where("component != was").isEmpty():
            return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("n"))


def largest_component(nodes: DataFrame, edges: DataFrame, keep_ties: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of the largest component (of equal ones the first, or all), and the edges with both ends in it."""
    labels = cut(components(nodes, edges))
    sizes = component_sizes(labels)
    top = sizes.agg(F.max("n").alias("n"))
    best = sizes.join(F.broadcast(top), "n") if keep_ties else sizes.orderBy(F.desc("n"), "component").limit(1)
    kept = nodes.join(labels.join(best.select("component"), "component", "left_semi"), "node_id", "left_semi")
    return kept, incident_edges(edges, kept, both=True)


def induced_labels(nodes: DataFrame, edges: DataFrame, label: str = "aoi", none: str = "0") -> DataFrame:
    """Nodes relabelled: of each label's induced subgraph only the largest parts keep it, and their one-hop surroundings join.

    Where surroundings of several labels meet, the later label wins; labels are settled in one pass, from the original ones.
    """
    named = nodes.where(F.col(label) != none).select("node_id", label)
    a, b = named.withColumnsRenamed({"node_id": "from", label: "_a"}), named.withColumnsRenamed({"node_id": "to", label: "_b"})
    inner = edges.join(a, "from").join(b, "to").where("_a = _b").select("from", "to")
    parts = components(named, inner).join(named, "node_id")
    sizes = parts.groupBy(label, "component").agg(F.count("*").alias("n"))
    best = sizes.join(sizes.groupBy(label).agg(F.max("n").alias("n")), [label, "n"]).select(label, "component")
    core = parts.join(best, [label, "component"], "left_semi").select("node_id", label)
    near = symmetric(edges).join(core, F.col("src") == F.col("node_id")).select(F.col("dst").alias("node_id"), label)
    new = core.unionByName(near).groupBy("node_id").agg(F.max(label).alias("_new"))
    return nodes.join(new, "node_id", "left").withColumn(label, F.coalesce("_new", F.lit(none))).drop("_new")


def labels_in_turn(nodes: DataFrame, edges: DataFrame, label: str = "aoi", none: str = "0") -> DataFrame:
    """Nodes relabelled as by induced_labels, but label after label (A, .., Z, AA, ..), each seeing what those before it took.

    Of a label's largest parts and their one-hop surroundings all nodes take it, whatever they had; its other nodes lose it.
    Two labels are in conflict where an edge joins their nodes: only then one changes what the other starts from. A round
    settles every label without a conflict with an earlier open one, all at once, so rounds follow the longest chain of
    rising labels that touch, not their number. Of two labels that take the same node the later keeps it (`_by`, the
    label that took it last), in whichever round they come.
    """
    near = cut(symmetric(edges).where("src != dst").distinct())
    turn = lambda name: F.struct(F.length(name).alias("size"), F.col(name).alias("name"))
    nobody = F.lit(None).cast("struct<size: int, name: string>")
    now = cut(nodes.withColumns({"_open": F.coalesce(F.col(label) != none, F.lit(False)), "_by": nobody}))
    while True:
        open_ = cut(now.where("_open").select("node_id", turn(label).alias("at")))
        if open_.isEmpty():
            return now.drop("_open", "_by")
        a, b = open_.select(F.col("node_id").alias("src"), F.col("at").alias("_a")), open_.select(F.col("node_id").alias("dst"), F.col("at").alias("_b"))
        touching = cut(near.join(a, "src").join(b, "dst").where("_a <= _b"))
        ready = cut(open_.join(touching.where("_a < _b").select(F.col("_b").alias("at")).distinct(), "at", "left_anti"))
        inner = touching.where("_a = _b").select(F.col("src").alias("from"), F.col("dst").alias("to"))
        parts = cut(components(ready, inner.join(ready.select(F.col("node_id").alias("from")), "from", "left_semi")).join(ready, "node_id"))
        sizes = parts.groupBy("at", "component").agg(F.count("*").alias("n"))
        best = sizes.join(sizes.groupBy("at").agg(F.max("n").alias("n")), ["at", "n"]).select("component")
        core = parts.join(best, "component", "left_semi").select("node_id", "at")
        around = near.join(core, near.src == core.node_id).select(F.col("dst").alias("node_id"), "at")
        taken = core.unionByName(around).groupBy("node_id").agg(F.max("at").alias("_new"))
        had = ready.select("node_id", F.lit(True).alias("_had"))
        takes = F.coalesce(F.col("_new") > F.col("_by"), F.col("_new").isNotNull())
        now = now.join(taken, "node_id", "left").join(had, "node_id", "left").withColumn("_takes", takes)
        now = now.withColumns({
            label: F.when(F.col("_takes"), F.col("_new.name")).when(F.col("_had"), none).otherwise(F.col(label)),
            "_open": F.col("_open") & ~F.col("_takes") & F.col("_had").isNull(),
            "_by": F.when(F.col("_takes"), F.col("_new")).otherwise(F.col("_by")),
        })
        now = cut(now.drop("_new", "_had", "_takes"))


def _out(front: np.ndarray, n: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge that leaves places of `front` (search * n + node): the place's index in front, and the edge."""
    node = front % n
    degree = start[node + 1] - start[node]
    ends = np.cumsum(degree)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.arange(len(front)), degree), np.arange(total) + np.repeat(start[node] - (ends - degree), degree)


def _pieces(breaks: np.ndarray, total: int) -> np.ndarray:
    """Offsets of rows of at most PACK values: `breaks` begins with 0 and has the places where a new key begins."""
    size = np.diff(np.append(breaks, total))
    parts = -(-size // PACK)
    return np.append(np.repeat(breaks, parts) + PACK * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)), total)


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns beside `keys` as arrays of up to PACK values: many rows of one key (their order is free) become few, before any shuffle."""
    values = [c for c in df.columns if c not in keys]
    df = df.select(*keys, *values).dropna(subset=keys)

    def rows(held: list) -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(len(t), np.int64)  # stays below LOAD to the power of the keys: three at most
        for k in keys:
            d = t.column(k).combine_chunks().dictionary_encode()
            code = code * len(d.dictionary) + d.indices.to_numpy()
        if (code[1:] < code[:-1]).any():
            order = np.argsort(code, kind="stable")
            t, code = t.take(pa.array(order)).combine_chunks(), code[order]
        offsets = _pieces(np.append(0, 1 + np.flatnonzero(code[1:] != code[:-1])), len(t))
        return pa.table({k: t.column(k).take(pa.array(offsets[:-1])) for k in keys} | {v: _lists(offsets, t.column(v).combine_chunks()) for v in values})

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= LOAD:
                yield from rows(held).to_batches()
                held, n = [], 0
        if n:
            yield from rows(held).to_batches()

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.mapInArrow(run, ", ".join([f"`{k}` {kind(k)}" for k in keys] + [f"`{v}` array<{kind(v)}>" for v in values]))


def _runs(batches, keys: list[str]):
    """(key, table) for every run of rows with equal keys in a partition sorted by them."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(new))
        for i, j in zip(starts.tolist(), np.append(starts[1:], b.num_rows).tolist()):
            key = tuple(b.column(k)[i].as_py() for k in keys)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _flat(rows: pa.Table, c: str, kind=np.int64) -> np.ndarray:
    """All values of a column of arrays."""
    return np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy(zero_copy_only=False) for x in rows.column(c).chunks)]).astype(kind)


class _Net:
    """The edges of one cell: inner ones by their tail, and those that leave it."""

    def __init__(self, tail: np.ndarray, dst: np.ndarray, w: np.ndarray, cell: int, width: int, more: np.ndarray):
        self.given, inner = (tail, dst, w, cell, width), dst // width == cell
        self.names = np.unique(np.concatenate([tail, dst[inner], more]))
        order = np.argsort(tail[inner], kind="stable")
        self.tail, self.head, self.w = np.searchsorted(self.names, tail[inner][order]), np.searchsorted(self.names, dst[inner][order]), w[inner][order]
        self.start = np.searchsorted(self.tail, np.arange(len(self.names) + 1))
        self.out_tail, self.out_dst, self.out_w = np.searchsorted(self.names, tail[~inner]), dst[~inner], w[~inner]

    def having(self, nodes: np.ndarray) -> "_Net":
        at = np.searchsorted(self.names, nodes)
        here = at < len(self.names)
        here[here] = self.names[at[here]] == nodes[here]
        return self if here.all() else _Net(*self.given, np.concatenate([self.names, nodes]))


class _Cell:
    """Searches of one lot in one cell: `d` and `mark` per search and node, from the seeds to the end, all searches at once."""

    def __init__(self, net: _Net, lot: pa.Table, kind: str, news: bool, shared: np.ndarray):
        src = lot.column("src").combine_chunks().dictionary_encode()
        self.searches, code, row = src.dictionary, src.indices.to_numpy().astype(np.int64), lot.column("row").to_numpy()
        mask = (row == "seed") | (row == "new")
        seeds, code_s, fresh = lot.filter(pa.array(mask)), code[mask], row[mask] == "new"
        round_ = seeds.column("round").to_numpy()
        last = np.full(len(self.searches), -1, np.int64)
        np.maximum.at(last, code_s[~fresh], round_[~fresh])
        kept = fresh | (round_ == last[code_s])  # of what a search kept, its last round's
        seeds, code_s, fresh = seeds.filter(pa.array(kept)), code_s[kept], fresh[kept]
        size = pc.list_value_length(seeds.column("a")).to_numpy().astype(np.int64)
        code_s, fresh = np.repeat(code_s, size), np.repeat(fresh, size)
        node, far, up, d, mark = _flat(seeds, "a"), _flat(seeds, "x", float), _flat(seeds, "y"), _flat(seeds, "b", float), _flat(seeds, "c")
        order = np.lexsort((fresh, up, far, mark, d, node, code_s))  # of equal ones what was there before
        code_s, node = code_s[order], node[order]
        one = np.append(True, (code_s[1:] != code_s[:-1]) | (node[1:] != node[:-1])) if len(order) else np.zeros(0, bool)
        order, code_s, node = order[one], code_s[one], node[one]
        if news:  # only searches that something better has reached
            hit = np.zeros(len(self.searches), bool)
            hit[code_s[fresh[order]]] = True
            order, node, code_s = order[hit[code_s]], node[hit[code_s]], (np.cumsum(hit) - 1)[code_s[hit[code_s]]]
            self.searches = self.searches.filter(pa.array(hit))
        self.seed_row, self.seed_node, self.seed_d, self.seed_mark, self.seed_far, self.seed_up = code_s, node, d[order], mark[order], far[order], up[order]
        self.net = net = net.having(node)
        self.names, self.tail, self.head, self.w, self.start, self.out_tail, self.out_dst, self.out_w = net.names, net.tail, net.head, net.w, net.start, net.out_tail, net.out_dst, net.out_w
        self.n, count = len(self.names), len(self.searches)
        self.at = code_s * self.n + np.searchsorted(self.names, node)
        self.d, self.mark = np.full(count * self.n, np.inf), np.zeros(count * self.n, np.int64)
        self.d[self.at] = self.seed_d
        self._fall()
        top = self.d[np.isfinite(self.d)].max(initial=0.0) if kind == "path" else 0.0
        if kind == "label" or (kind == "path" and (self.w.min(initial=np.inf) <= np.spacing(top) or self.seed_mark.any())):
            self._marks(kind)
        if kind == "path":
            before = lot.filter(pa.array(row == "pre"))
            goal, mine = _flat(before, "a"), code[row == "pre"]
            order = np.lexsort((goal, mine))
            width = np.unique(np.concatenate([goal, node]))
            key = (mine * len(width) + np.searchsorted(width, goal))[order]
            want = code_s * len(width) + np.searchsorted(width, node)
            i = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            found = key[i] == want if len(key) else np.zeros(len(want), bool)
            self.pre = before.column("y").combine_chunks().take(pa.array(order[i], mask=~found) if len(key) else pa.nulls(len(want), pa.int64()))
        asks = lot.filter(pa.array(row == "ask"))
        mine, size = code[row == "ask"], pc.list_value_length(asks.column("a")).to_numpy().astype(np.int64)
        goals, ends, by = _flat(asks, "a"), np.cumsum(size), np.argsort(mine, kind="stable")
        self.asks: list[list] = [[shared] if len(shared) else [] for _ in range(count)]
        for k in by.tolist() if not news else []:
            self.asks[mine[k]].append(goals[ends[k] - size[k] : ends[k]])

    def _fall(self) -> None:
        """Lower distances along edges; of every search first what lies within a few mean edges of its nearest open node."""
        d, n, step = self.d, self.n, 4 * float(self.w.mean()) if len(self.w) else 0.0
        degree, open_ = np.diff(self.start), np.zeros(len(d), bool)
        front = self.at
        open_[front] = True
        while front.size:
            far, row = d[front], front // n
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            near = far <= np.repeat(np.minimum.reduceat(far, first) + step, np.diff(np.append(first, len(front))))
            rest, base, far = front[~near], row[near] * n, far[near]
            open_[front[near]] = False
            node = front[near] - base
            some = degree[node]
            ends = np.cumsum(some)
            e = np.arange(ends[-1]) + np.repeat(self.start[node] - (ends - some), some)
            to, new = np.repeat(base, some) + self.head[e], np.repeat(far, some) + self.w[e]
            less = new < d[to]
            to = to[less]
            np.minimum.at(d, to, new[less])
            to = to[~open_[to]]
            open_[to] = True
            front = np.unique(np.concatenate([rest, to]))

    def _marks(self, kind: str) -> None:
        """The least mark over all shortest ways: a label's node, or for paths the edges since distance last grew."""
        d, m, n = self.d, self.mark, self.n
        m[:] = 1 << 62
        on = self.seed_d == d[self.at]
        np.minimum.at(m, self.at[on], self.seed_mark[on])
        for s in range(len(d) // max(n, 1)):
            front = s * n + np.flatnonzero(np.isfinite(d[s * n : s * n + n]))
            while front.size:
                i, e = _out(front, n, self.start)
                u, to = front[i], s * n + self.head[e]
                new = d[u] + self.w[e]
                mark = m[u] if kind == "label" else np.where(new > d[u], 0, m[u] + 1)
                less = (new == d[to]) & (mark < m[to])
                np.minimum.at(m, to[less], mark[less])
                front = np.unique(to[less])

    def table(self, place: np.ndarray, **columns) -> pa.Table:
        return pa.table({"src": self.searches.take(pa.array(place)), **{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}})

    def kept(self, kind: str, cell: int, width: int):
        """The seeds, packed ("seed"), and for other cells what leaves this one ("new"): the node reached, its distance and mark, and the node before it."""
        for s in range(len(self.searches)):
            mine = slice(*np.searchsorted(self.seed_row, [s, s + 1]))
            yield self.rows("seed", s, np.full(mine.stop - mine.start, cell), *(c[mine] for c in (self.seed_node, self.seed_d, self.seed_mark, self.seed_far, self.seed_up)))
            d, m = self.d[s * self.n : s * self.n + self.n][self.out_tail], self.mark[s * self.n : s * self.n + self.n][self.out_tail]
            on = np.isfinite(d)
            d, m, node, new, up = d[on], m[on], self.out_dst[on], d[on] + self.out_w[on], self.names[self.out_tail[on]]
            if kind == "path":
                m, far = np.where(new > d, 0, m + 1), d
            else:
                far, up = np.zeros(len(d)), np.zeros(len(d), np.int64)
            order = np.lexsort((up, far, m, new, node))
            order = order[np.append(True, node[order][1:] != node[order][:-1])] if len(order) else order
            yield self.rows("new", s, node[order] // width, *(c[order] for c in (node, new, m, far, up)))

    def rows(self, row: str, s: int, cell: np.ndarray, *values) -> pa.Table:
        offsets = _pieces(np.append(0, 1 + np.flatnonzero(cell[1:] != cell[:-1])), len(cell)) if len(cell) else np.zeros(1, np.int64)
        n = len(offsets) - 1
        return self.table(np.full(n, s), row=pa.repeat(row, n), cell=cell[offsets[:-1]].astype(np.int64), **{k: _lists(offsets, v) for k, v in zip("abcxy", values)})

    def whole(self):
        for s in range(len(self.searches)):
            d, m = self.d[s * self.n : s * self.n + self.n], self.mark[s * self.n : s * self.n + self.n]
            at = np.flatnonzero(np.isfinite(d))
            yield self.table(np.full(len(at), s), node_id=self.names[at], distance=d[at], mark=m[at])

    def asked(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that search s is asked for, each once, and their places (-1 where it does not reach them)."""
        goals = np.concatenate([np.zeros(0, np.int64), *self.asks[s]])
        if (goals[1:] <= goals[:-1]).any():
            goals = np.unique(goals)
        if not self.n:
            return goals, np.full(len(goals), -1)
        i = np.minimum(np.searchsorted(self.names, goals), self.n - 1)
        return goals, np.where((self.names[i] == goals) & np.isfinite(self.d[s * self.n + i]), i, -1)

    def distances(self):
        for s in range(len(self.searches)):
            goals, at = self.asked(s)
            yield self.table(np.full(len(goals), s), node_id=goals, distance=np.where(at >= 0, self.d[s * self.n + at], 0.0) if self.n else np.zeros(len(goals)))

    def trees(self):
        """Per search (search, d, last, enters): the node before each node in the cell (-1: none), and the rows of seeds whose way enters the cell there."""
        order = np.argsort(self.at, kind="stable")
        cuts = np.searchsorted(self.at[order], np.arange(len(self.searches) + 1) * self.n)
        for s in range(len(self.searches)):
            d, m = self.d[s * self.n : s * self.n + self.n], self.mark[s * self.n : s * self.n + self.n]
            far = d[self.tail]
            tight = np.flatnonzero((far + self.w == d[self.head]) & np.isfinite(far))
            t, h, far = self.tail[tight], self.head[tight], far[tight]
            on = (far < d[h]) | (m[t] + 1 == m[h])
            t, h, far = t[on], h[on], far[on]
            low, last = np.full(self.n, np.inf), np.full(self.n, self.n, np.int64)
            np.minimum.at(low, h, far)
            first = far == low[h]
            np.minimum.at(last, h[first], t[first])  # of equal ones the smallest id: names are in order
            mine = order[cuts[s] : cuts[s + 1]]
            v = self.at[mine] - s * self.n
            ids = np.append(self.names, np.iinfo(np.int64).max)[last[v]]
            enters = (self.seed_d[mine] == d[v]) & (self.seed_mark[mine] == m[v]) & ((self.seed_far[mine] < low[v]) | ((self.seed_far[mine] == low[v]) & (self.seed_up[mine] < ids)))
            last[v[enters]] = -1
            last[last == self.n] = -1
            yield s, d, last, mine[enters]

    def depths(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node the entry that its chain comes from, and the steps from there."""
        top, steps = np.where(last >= 0, last, np.arange(self.n)), (last >= 0).astype(np.int64)
        while (up := top[top] != top).any():
            steps, top = steps + np.where(up, steps[top], 0), top[top]
        return top, steps

    def chains(self, last: np.ndarray, ends: np.ndarray, skip: int, before: np.ndarray, room: np.ndarray):
        """(first, last end, entry, offsets, values) in turn for as many of `ends` as VALUES has room for: per node the chain from its
        entry on, the node `skip` left out, behind room for `before` of its entry."""
        top, steps = self.depths(last)
        whole = np.cumsum(steps[ends] + 1 - (top[ends] == skip) + room[top[ends]])
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(whole, (whole[i - 1] if i else 0) + VALUES, side="right")))
            some, entry = ends[i:j], top[ends[i:j]]
            own = steps[some] + 1 - (entry == skip)
            offsets = np.concatenate([[0], np.cumsum(own + room[entry])])
            values, cur, at = np.empty(offsets[-1], np.int64), some, offsets[1:] - 1
            on = own > 0
            cur, at = cur[on], at[on]
            while cur.size:
                values[at] = self.names[cur]
                cur, at = last[cur], at - 1
                on = (cur >= 0) & (cur != skip)
                cur, at = cur[on], at[on]
            size = room[entry]
            shift = np.repeat(before[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield i, j, entry, offsets, (values, np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum()), shift)
            i = j

    def place_of(self, s: int) -> int:
        """The node of search s, -1 outside the cell."""
        src = self.searches[s].as_py()
        i = int(np.searchsorted(self.names, src))
        return i if i < self.n and self.names[i] == src else -1

    def links(self):
        """For ways across cells: nodes where they enter (`up` the node before, outside) and nodes they may leave from (`up` the
        node where they entered, `seg` the nodes from there on, without the source)."""
        exits = np.unique(self.out_tail)
        none = np.zeros(self.n, np.int64)
        for s, d, last, enters in self.trees():
            enters = enters[self.seed_far[enters] > -np.inf]
            v = self.at[enters] - s * self.n
            yield self.table(np.full(len(v), s), node_id=self.names[v], up=self.seed_up[enters], seg=pa.nulls(len(v), pa.list_(pa.int64())))
            ends = exits[np.isfinite(d[exits])]
            for i, j, entry, offsets, (values, _, _) in self.chains(last, ends, self.place_of(s), none, none):
                yield self.table(np.full(j - i, s), node_id=self.names[ends[i:j]], up=self.names[entry], seg=_lists(offsets, values))

    def paths(self):
        """Distance and path of the asked nodes; `pre` has the nodes before those where ways enter the cell."""
        pre_at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(self.pre), 0).to_numpy().astype(np.int64)))
        pre_values = self.pre.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for s, d, last, enters in self.trees():
            asked, at = self.asked(s)
            src = self.place_of(s)
            before, room = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            v = self.at[enters] - s * self.n
            before[v], room[v] = pre_at[enters], pre_at[enters + 1] - pre_at[enters]
            no = asked[at < 0]
            yield self.table(np.full(len(no), s), node_id=no, distance=np.zeros(len(no)), path=_lists(np.zeros(len(no) + 1), np.zeros(0, np.int64)))
            asked, ends = asked[at >= 0], at[at >= 0]
            for i, j, _, offsets, (values, to, of) in self.chains(last, ends, src, before, room):
                values[to] = pre_values[of]
                size = np.diff(offsets)
                home = np.flatnonzero(asked[i:j] == self.searches[s].as_py())  # the source itself: a path of one node
                values = np.insert(values, np.cumsum(size)[home] - size[home], asked[i:j][home])
                size[home] += 1
                yield self.table(np.full(j - i, s), node_id=asked[i:j], distance=d[ends[i:j]], path=_lists(np.append(0, np.cumsum(size)), values))


_SEEDS = "a array<long>, b array<double>, c array<long>, x array<double>, y array<long>"
_ROWS = {"beyond": f"row string, cell long, {_SEEDS}", "whole": "node_id long, distance double, mark long", "links": "node_id long, up long, seg array<long>", "asked": "node_id long, distance double", "paths": "node_id long, distance double, path array<long>"}


class _Searches:
    """Searches through the cells of a network, settled at the cells' borders; `last(what)` then fills the cells.

    `seeds` is (weighting, src, node_id, distance, mark); `src` is any key of a search. `kind` is "least" (distances alone), "label" (of
    equal distances the smallest mark of a seed) or "path" (of equal ones the node before with the least (distance, id)).
    Weights must not be negative. Nodes are dealt to cells by ranges of their ids (dense_ids numbers neighbouring places
    alike). A round hands what newly reached a cell to that cell alone, with the cell's edges: it searches its own nodes to the
    end and returns what leaves it. So rounds follow the cells that ways cross, not their edges, cells that nothing new
    reaches rest, and only what came in over cells' borders is kept between rounds. With `rounds`, a graph that needs
    more raises.
    """

    def __init__(self, weights: DataFrame, seeds: DataFrame, kind: str, cell: int | None = None, rounds: int | None = None):
        self.cell, self.kind, self.src = cell or CELL, kind, seeds.schema["src"].dataType.simpleString()
        self.spark = weights.sparkSession
        e = weights.select("weighting", self.place("src").alias("cell"), F.col("src").cast("long").alias("a"), F.col("w").cast("double").alias("b"), F.col("dst").cast("long").alias("c"))
        self.edges = cut(packed(e, ["weighting", "cell"]))
        width = self.cell  # a local name: the function below goes to the workers
        leaves = F.exists("c", lambda v: F.floor(v / width) != F.col("cell"))
        self.cells, apart = self.edges.agg(F.count_distinct("weighting", "cell"), F.max(leaves)).first()
        self.apart = bool(apart)
        first = seeds.select("weighting", "src", self.place("node_id").alias("cell"), F.col("node_id").cast("long").alias("a"), F.col("distance").alias("b"), F.col("mark").alias("c"), F.lit(-math.inf).alias("x"), F.lit(-1).cast("long").alias("y"))
        news = cut(packed(first, ["weighting", "src", "cell"]).withColumns({"row": F.lit("new"), "round": F.lit(-1)}))
        self.most = news.groupBy("weighting").agg(F.count_distinct("src").alias("n")).agg(F.max("n")).first()[0] or 0
        self.best, done, at, key = news, 0, f"{shared_folder(self.spark)}/cut-{uuid4().hex}", ["weighting", "cell", "src"]
        while self.apart:
            rows = news if not done else news.unionByName(self.best.join(news.select(*key).distinct(), key, "left_semi"), allowMissingColumns=True)
            self.search(rows, "beyond").write.parquet(f"{at}/round={done}")
            both = self.spark.read.schema(f"weighting string, src {self.src}, {_ROWS['beyond']}, round int").parquet(at)
            if both.where(f"round = {done} AND row = 'seed'").isEmpty():
                break
            if rounds is not None and done > rounds:
                raise ValueError(f"distances still fall after {rounds} rounds")
            # every round writes the seeds of the searches it reached anew: a search counts its last ones
            self.best, news = both.where("row = 'seed'"), both.where(f"round = {done} AND row = 'new'")
            done += 1

    def place(self, c: str):
        return F.floor(F.col(c) / self.cell)

    def search(self, rows: DataFrame, what: str, goals: DataFrame | None = None) -> DataFrame:
        """`what` of all searches (a lot of SOURCES at a time) in every cell that has rows, as a stream of batches.

        Lots that share a task meet its edges once, and come one after the other; so a task holds the edges of a cell and one lot's distances, however
        many results it returns. `goals` (cell, a) are asked by every search that has a row in their cell, and come with the edges.
        """
        kind, width, lots = self.kind, self.cell, max(1, -(-self.most // SOURCES))
        spread = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        share = max(1, min(LOTS, lots * self.cells // spread))
        groups = self.cells * -(-lots // share)
        names = [c.split()[0] for c in f"weighting string, src x, {_ROWS[what]}".split(", ")]
        keys = ["weighting", "cell", "task", "lot"]

        def results(weighting: str, cell: int, net: _Net, goals: np.ndarray, lot: pa.Table):
            c = _Cell(net, lot, kind, what == "beyond", goals)
            found = {"beyond": lambda: c.kept(kind, cell, width), "whole": c.whole, "links": c.links, "asked": c.distances, "paths": c.paths}[what]()
            held, size = [], 0
            for t in found:
                held.append(t.append_column("weighting", pa.repeat(weighting, len(t))).select(names))
                size += len(t) + sum(len(x.flatten()) for x in t.column(t.num_columns - 1).chunks if pa.types.is_list(x.type))
                if size >= VALUES // 4:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, size = [], 0
            if size:
                yield from pa.concat_tables(held).combine_chunks().to_batches()

        def run(batches):
            place, none = None, np.zeros(0, np.int64)
            for (*here, lot), t in _runs(batches, keys):
                if here != place:
                    near = t if lot < 0 else t.slice(0, 0)
                    e, g = near.filter(pc.equal(near.column("row"), "edge")), near.filter(pc.equal(near.column("row"), "goal"))
                    place, net, asked = here, _Net(_flat(e, "a"), _flat(e, "c"), _flat(e, "b", float), here[1], width, none), np.unique(_flat(g, "a"))
                if lot >= 0:
                    yield from results(*here[:2], net, asked, t)

        own = rows.withColumn("lot", F.pmod(F.xxhash64("src"), F.lit(lots))).withColumn("task", F.floor(F.col("lot") / share))
        tasks = own.select("weighting", "cell", "task").distinct()
        near = self.edges.join(tasks, ["weighting", "cell"]).withColumn("row", F.lit("edge"))
        if goals is not None:
            near = near.unionByName(goals.join(tasks, "cell").withColumn("row", F.lit("goal")), allowMissingColumns=True)
        near = near.withColumn("lot", F.lit(-1).cast("long"))
        both = own.unionByName(near, allowMissingColumns=True)
        both = both.repartition(max(1, min(groups, spread)), *keys[:3]).sortWithinPartitions(*keys)
        return both.mapInArrow(run, f"weighting string, src {self.src}, {_ROWS[what]}")

    def answers(self, pairs: DataFrame | tuple[DataFrame, DataFrame], what: str) -> DataFrame:
        """`what` ("asked", "paths") of pairs, each once; they go packed to their goal's cell, where they are made distinct. Of all sources to all goals
        a cell's goals go there once for all searches of a task, and every source to every cell with goals."""
        goals, seeds = None, self._entered() if what == "paths" else self.best
        if isinstance(pairs, tuple):
            sources, to = pairs
            goals = cut(packed(to.select(self.place("goal").alias("cell"), F.col("goal").cast("long").alias("a")).distinct(), ["cell"]))
            asks = sources.select("weighting", "src").distinct().join(goals.select("cell").distinct(), how="cross").withColumn("a", F.expr("CAST(array() AS array<long>)"))
        else:
            asks = packed(pairs.select("weighting", "src", self.place("goal").alias("cell"), F.col("goal").cast("long").alias("a")), ["weighting", "src", "cell"])
        return self.search(seeds.unionByName(asks.withColumn("row", F.lit("ask")), allowMissingColumns=True), what, goals).withColumnRenamed("node_id", "goal")

    def _entered(self) -> DataFrame:
        """The seeds and rows with the paths up to them: from where ways enter a cell to where they entered the one before, doubled."""
        if not self.apart:
            return self.best
        links, key = cut(self.search(self.best, "links")), ["weighting", "src"]
        left = links.where("seg IS NOT NULL").select(*key, F.col("node_id").alias("exit"), F.when(F.col("up") != F.col("src"), F.col("up")).alias("to"), F.col("seg").alias("pre"))
        pre = cut(links.where("seg IS NULL").select(*key, "node_id", F.col("up").alias("exit")).join(left, [*key, "exit"]).drop("exit"))
        while not pre.where("to IS NOT NULL").isEmpty():
            on = pre.select(*key, F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("pre").alias("_pre"))
            pre = cut(pre.join(on, [*key, "to"], "left").select(*key, "node_id", F.col("_to").alias("to"), F.concat(F.coalesce("_pre", F.expr("CAST(array() AS array<long>)")), "pre").alias("pre")))
        pre = pre.select(*key, self.place("node_id").alias("cell"), F.lit("pre").alias("row"), F.array("node_id").alias("a"), F.col("pre").alias("y"))
        return self.best.unionByName(pre, allowMissingColumns=True)


def _sources(df: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    df = df[0] if isinstance(df, tuple) else df
    return df.select("weighting", "src").distinct().select("weighting", "src", F.col("src").cast("long").alias("node_id"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("mark"))


def _exact(weights: DataFrame) -> bool:
    """Whether weights are whole and sum up below 2 ** 53: then any way's sum is the same double from both its ends."""
    whole, total = weights.agg(F.bool_and(F.col("w") == F.floor("w")), F.sum("w")).first()
    return bool(whole) and total < 2**53


def relational_distances(weights: DataFrame, sources: DataFrame, cell: int | None = None, rounds: int | None = None) -> DataFrame:
    """(weighting, src, node_id, distance) from every source to every node that it reaches."""
    found = _Searches(weights, _sources(sources), "least", cell, rounds)
    return found.search(found.best, "whole").drop("mark")


def shortest_distances(weights: DataFrame, pairs: DataFrame | tuple[DataFrame, DataFrame], cell: int | None = None) -> DataFrame:
    """(weighting, src, goal, distance) of distinct pairs; unreachable: 0. Without paths no predecessors are looked up.

    `pairs` is (weighting, src, goal), or (weighting, src) and (goal) for all goals from every source without a row for each pair.
    Of fewer goals than sources the searches start at the goals, against the edges' direction, where sums do not depend on their order.
    """
    if not isinstance(pairs, tuple):
        pairs = cut(pairs.select("weighting", "src", "goal").distinct())
        of, to = pairs.agg(F.count_distinct("weighting", "src"), F.count_distinct("weighting", "goal")).first()
        if to < of and _exact(weights):
            back = weights.select("weighting", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
            turned = pairs.select("weighting", F.col("goal").alias("src"), F.col("src").alias("goal"))
            found = _Searches(back, _sources(turned), "least", cell).answers(turned, "asked")
            return found.select("weighting", F.col("goal").alias("src"), F.col("src").alias("goal"), "distance")
    return _Searches(weights, _sources(pairs), "least", cell).answers(pairs, "asked")


def shortest_paths(weights: DataFrame, pairs: DataFrame | tuple[DataFrame, DataFrame], cell: int | None = None) -> DataFrame:
    """(weighting, src, goal, distance, path) of distinct pairs (as in shortest_distances); pairs of one source share a search. Unreachable: 0 and an empty path.

    Of several predecessors the one settled first (distance, node id) counts; across edges of weight 0 one with fewer such edges.
    A goal's cell writes the path: the part inside from its own search, behind what came before the node where the way
    enters the cell. These parts are gathered over the cells' borders alone, by pointer doubling.
    """
    return _Searches(weights, _sources(pairs), "path", cell).answers(pairs, "paths")


def nearest_label_nodes(weights: DataFrame, sources: DataFrame, labels: DataFrame, none: str = "0", cell: int | None = None) -> DataFrame:
    """(weighting, src, aoi, node_id, distance): from each source the nearest node of each label it reaches; of equal ones the smallest id.

    One search a label, from all its nodes at once and against the edges' direction; every node carries its distance to the
    label and the label's node. The work follows labels and nodes, however many sources ask.
    """
    some = weights.select("weighting", F.col("src").alias("node_id")).distinct()
    seeds = labels.where(F.col("aoi") != none).select("node_id", "aoi").distinct().join(some, "node_id")
    seeds = seeds.select("weighting", F.col("aoi").alias("src"), "node_id", F.lit(0.0).alias("distance"), F.col("node_id").cast("long").alias("mark"))
    back = weights.select("weighting", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    found = _Searches(back, seeds, "label", cell)
    reached = found.search(found.best, "whole").select("weighting", F.col("src").alias("aoi"), F.col("node_id").alias("src"), F.col("mark").alias("node_id"), "distance")
    return sources.select("weighting", "src").distinct().join(reached, ["weighting", "src"]).select("weighting", "src", "aoi", "node_id", "distance")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, goal, history, current): edge ids along a path. The hop from the source to the first node is not recorded and the
    last edge stands apart; a path of one node is the edge from the source."""
    one = edges.groupBy(F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b")).agg(F.min("edge_id").alias("edge_id"))
    n = F.size("path")
    hops = F.when(n == 1, F.array(F.struct(F.col("src").alias("a"), F.element_at("path", 1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
    )
    rows = paths.where(n > 0).select("src", "goal", F.posexplode(hops).alias("pos", "hop"))
    rows = rows.withColumns({"_a": F.least("hop.a", "hop.b"), "_b": F.greatest("hop.a", "hop.b")}).join(one, ["_a", "_b"], "left")
    whole = rows.groupBy("src", "goal").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"]).alias("all"))
    return whole.select("src", "goal", F.slice("all", F.lit(1), F.size("all") - 1).alias("history"), F.element_at("all", -1).alias("current"))

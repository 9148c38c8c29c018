"""Ties, and work that must not grow faster than its result."""

import math
from collections import namedtuple

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowengine.operators import graph, polygons, simulate
from flowengine.plans import registry

DATA = "/root/testdata/sf0.01"


def written(monkeypatch) -> list[int]:
    """The rows of every table that goes to the shared folder from here on."""
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def test_paths_write_borders_not_whole_searches(spark, monkeypatch):
    """Searches from all nodes of the ring keep what crosses cells; no table has a row for every source and node, and paths stay those of the SQL."""
    w, n = registry.whole_ring(spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{DATA}/supplier.parquet'")
    want = {(s, g): p for s, g, p in con.execute("SELECT src, goal, path FROM (" + registry.ORACLE_SQL["shortest_path_nodes"] + ")").fetchall()}
    ends = w.select("weighting", "src").distinct()
    pairs = ends.join(ends.select(F.col("src").alias("goal")), how="cross")
    rows = written(monkeypatch)
    found = {(r.src, r.goal): r.path for r in graph.shortest_paths(w, pairs, cell=n).collect()}
    assert len(found) == n * n and {k: found[k] for k in want} == want
    assert max(rows) < n * n / 10
    monkeypatch.setattr(graph, "SOURCES", 2)
    assert {(r.src, r.goal): r.path for r in graph.shortest_paths(w, pairs, cell=n // 3).collect()} == found


def test_path_geometries_order_points_of_one_step_by_node(spark):
    """Node 102 lies left of node 2, which comes first all the same."""
    nodes = spark.createDataFrame([(2, 2.0, 0.0), (102, 1.0, 0.0), (7, 7.0, 0.0)], "node_id long, x double, y double")
    log = spark.createDataFrame([(1, "nicest", 2, 102), (1, "nicest", 2, 2), (1, "nicest", 1, 7)], "agent_id long, behaviour string, seq int, `to` long")
    assert [[p.x for p in r.coords] for r in simulate.path_geometries(log, nodes).collect()] == [[7.0, 2.0, 1.0]]


def test_line_cells_are_not_shuffled(spark):
    """Lines move once, by their key; their cells are made distinct and counted where they are."""
    plan = registry.QUERIES["oblique_line_cells"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_components_deal_a_crowded_label_to_several_tasks(spark, monkeypatch):
    """A star, a chain and loose nodes, with crowds of more than 3 nodes of a label."""
    monkeypatch.setattr(graph, "CROWD", 3)
    edges = [(1, i) for i in range(2, 20)] * 2 + [(i, i + 1) for i in range(30, 45)] + [(50, 50)]
    nodes = spark.createDataFrame([(i,) for i in (*range(1, 20), *range(30, 46), 50, 51)], "node_id long")
    got = {r.node_id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "`from` long, `to` long")).collect()}
    assert got == {i: 1 if i < 20 else 30 if i < 50 else i for (i,) in nodes.collect()}


def test_strolls_keep_the_chances_of_a_place(monkeypatch):
    """Chances are made once for all agents of a type that come to a place from one side, and moves bring their edges with them."""
    calls = []
    monkeypatch.setattr(simulate.math, "exp", lambda v, exp=simulate.math.exp: calls.append(v) or exp(v))
    n = 12
    at = lambda v: (math.cos(v * 2 * math.pi / n), math.sin(v * 2 * math.pi / n))
    moves = {u: [(v, *at(v), 50.0, 100 * u + v, float(v % 5)) for v in sorted({(u + d) % n for d in (1, 3, n - 1, n - 3)})] for u in range(n)}
    kind = namedtuple("Agent", "agent_id t last at x y lx ly stack retraced path start_v goal_v time_ext extra speed upto")
    seen: dict = {}
    walks = [simulate.stroll(kind(i, 1, 77, i % n, *at(i % n), 9.0, 9.0, [], [], [i % n], 77, i % n, 240, 0.0, 5, 1), moves, seen, 1, 0) for i in range(60)]
    hops = sum(len(w[10]) for w in walks)
    assert all(w[0] == 1 + len(w[10]) for w in walks) and hops > 2000
    assert all(e in (100 * a + b, 100 * b + a) for w in walks for a, b, e in zip(w[12], w[13], w[14]))
    places = sum(len(v) for v in seen.values())
    assert places <= 5 * n and len(calls) <= 4 * places


def test_sides_of_one_file_are_dealt_to_all_tasks(spark):
    """Pairs of sides are made in every task, though one partition holds all of them."""
    ring = lambda corners: F.expr(f"transform(array({corners}), p -> struct(double(p[0] + id) AS x, double(p[1]) AS y))")
    short = polygons.sides(spark.range(60, numPartitions=1).withColumn("ring", ring("array(0, 0), array(1, 0), array(7, 6), array(6, 6)")), "id")
    long = polygons.sides(spark.range(1).withColumn("ring", ring("array(0, 0), array(90, 9), array(0, 1)")).withColumnRenamed("id", "b"), "b")
    pairs, x, y = polygons._near(short, long, "id", "b", 8.0)
    assert pairs.select(F.spark_partition_id()).distinct().count() == 4
    assert {(r._l, r._d) for r in polygons._distances(pairs, x, y).groupBy("_l").agg(F.min("_d").alias("_d")).collect()} >= {(0, 0.0), (20, 0.0)}


def test_distances_of_sides():
    """Crossing, touching, parallel and apart; sides without length; one line."""
    a = [(0, 0, 2, 2), (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 1, 0), (3, 4, 3, 4), (1, 1, 1, 1), (0, 0, 1, 0)]
    b = [(0, 2, 2, 0), (1, 0, 5, 5), (0, 2, 1, 2), (4, 4, 4, 9), (0, 0, 0, 0), (0, 1, 5, 1), (3, 0, 9, 0)]
    columns = lambda rows: list(np.array(rows, float).T)
    assert polygons._distance2(columns(a), columns(b)).tolist() == [0, 0, 4, 25, 25, 0, 4]


def test_paths_leave_a_task_in_bounded_batches(monkeypatch):
    """Paths from a search to all nodes of a line come a batch at a time, and none is much larger than VALUES."""
    monkeypatch.setattr(graph, "VALUES", 500)
    n = 100
    net = graph._Net(np.arange(n - 1), np.arange(1, n), np.ones(n - 1), 0, n, np.zeros(0, np.int64))
    seed = {"src": [0], "row": ["new"], "round": [-1], "a": [[0]], "b": [[0.0]], "c": [[0]], "x": [[-math.inf]], "y": [[-1]]}
    lot = pa.table({k: pa.array(v, pa.int32() if k == "round" else None) for k, v in seed.items()})
    batches = [t.column("path").to_pylist() for t in graph._Cell(net, lot, "path", False, np.arange(n)).paths()]
    assert [p for b in batches for p in b] == [[0]] + [list(range(1, v + 1)) for v in range(1, n)]
    assert len(batches) > 9 and max(sum(map(len, b)) for b in batches) <= 500 + 1


def test_all_goals_go_to_their_cells_once(spark):
    """Sources and goals by their two sides give the rows of their pairs, also of goals that nothing reaches."""
    w, n = registry.whole_ring(spark, "/root/testdata/sf0.001")
    sources, goals = w.where("src % 4 = 0").select("weighting", "src").distinct(), spark.range(n + 2).withColumnRenamed("id", "goal")
    for found in (graph.shortest_distances, graph.shortest_paths):
        assert sorted(found(w, (sources, goals), cell=5).collect()) == sorted(found(w, sources.join(goals, how="cross"), cell=5).collect())


def test_few_goals_are_searched_from_their_side(spark, monkeypatch):
    """One-way edges: distances to two goals from all nodes take two searches; weights that round are searched from the sources."""
    searches, init = [], graph._Searches.__init__

    def counted(self, *a):
        init(self, *a)
        searches.append(self.most)

    monkeypatch.setattr(graph._Searches, "__init__", counted)
    edges = [("d", i, i + 1, 1.0 + i % 3) for i in range(9)] + [("d", 0, 5, 2.0)]
    w = spark.createDataFrame(edges, "weighting string, src long, dst long, w double")
    pairs = spark.range(10).selectExpr("'d' AS weighting", "id AS src", "explode(array(3L, 7L)) AS goal")
    found = {(r.src, r.goal): r.distance for r in graph.shortest_distances(w, pairs).collect()}
    assert found == {(s, g): float((2 + 3 + 1) if (s, g) == (0, 7) else sum(1 + i % 3 for i in range(s, g))) for s in range(10) for g in (3, 7)}
    assert searches == [2]
    tenth = {(r.src, r.goal): r.distance for r in graph.shortest_distances(w.withColumn("w", F.col("w") / 10), pairs).collect()}
    assert searches == [2, 10] and all(abs(tenth[k] * 10 - found[k]) < 1e-9 for k in found)

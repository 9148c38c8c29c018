"""The flows end to end on a small grid of paths, 50 m apart."""

import pytest
from pyspark.sql import functions as F

from flowengine.functions import expressions as X
from flowengine.operators import aoi, graph
from flowengine.plans import workflow

N, STEP, RES, TOP = 9, 50.0, 50.0, 500.0


@pytest.fixture(scope="module")
def network(spark):
    lines, k = [], 0
    for i in range(N):
        for j in range(N):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < N and j + dj < N:
                    k += 1
                    lines.append((k, [(25 + i * STEP, 25 + j * STEP), (25 + (i + di) * STEP, 25 + (j + dj) * STEP)], STEP))
    lines.append((k + 1, [(9e5, 9e5), (9e5 + 1, 9e5)], 1.0))  # a part of its own
    lines = spark.createDataFrame(lines, "line_id long, coords array<struct<x: double, y: double>>, shape_leng double")
    grid = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    residents = grid.withColumn("value", F.when(F.col("col") < 3, 100.0).otherwise(0.0))
    attract = grid.withColumn("value", F.when(F.col("col") > 4, 15.0 + F.col("row")).otherwise(2.0))
    layers = attract.select("row", "col", "value", F.explode(F.array(*map(F.lit, X.SPEED))).alias("layer"))
    return lines, residents, attract, layers


def test_flows(spark, network):
    lines, residents, attract, layers = network
    nodes, edges = workflow.build_network(lines, residents, layers, 0.0, TOP, RES)
    nodes, edges = graph.cut(nodes), graph.cut(edges)
    assert nodes.count() == N * N and edges.count() == 2 * N * (N - 1)
    assert aoi.can_derive(attract, 11.0) and not aoi.can_derive(attract, 99.0)
    areas, cells = aoi.derived(attract, 11.0, 10, RES * RES)
    areas, cells = graph.cut(areas), graph.cut(cells)
    assert [(r.aoi, r.area) for r in areas.collect()] == [("A", 50 * RES * RES)]
    parking = spark.createDataFrame([(1, [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0)]), (2, [(260.0, 260.0), (300.0, 260.0), (300.0, 300.0), (260.0, 300.0)])], "id int, ring array<struct<x: double, y: double>>")
    nodes, weights = workflow.enrich(nodes, edges, cells, areas, parking, 0.0, TOP, RES, 11.0)
    nodes, weights = graph.cut(nodes.withColumn("new_residential", F.lit(0.0))), graph.cut(weights)
    # the area's cells begin at column 5; a hop around it joins
    assert {r.aoi for r in nodes.where("x < 220").collect()} == {"0"} and {r.aoi for r in nodes.where("x > 220").collect()} == {"A"}
    assert weights.where("w > 50 OR w < 10").isEmpty() and weights.select("weighting").distinct().count() == 21
    assert nodes.where("parking > 0").count() >= 1
    out = workflow.run_simulation(nodes, edges, weights, areas, 80, seed=3)
    agents, log, counts = out["agents"].collect(), out["log"].collect(), out["passage"].collect()
    assert len(agents) == 80 and {a.aoi_goal for a in agents} <= {"A", "NO_GOAL"} and any(a.goal_v > 0 for a in agents)
    assert {r.agent_id for r in log} == {a.agent_id for a in agents if a.goal_v != -1 and any(r.agent_id == a.agent_id for r in log)}
    assert sum(r.passage for r in counts) >= len({(r.agent_id, r.edge_id) for r in log})
    assert all(r.passage >= r.passage_aoi and r.passage_aoi2 in (0, r.passage) for r in counts)
    assert out["starts"].count() > 0 and out["paths"].where(F.size("coords") < 2).isEmpty()


def test_sensitivity(spark):
    meta = spark.createDataFrame([("a", "CR", "PR1"), ("b", "LC", "PR2"), ("c", "EN", ""), ("d", "VU", "PR1")], "species string, threat string, ch_priority string")
    presence = spark.createDataFrame([(1, "a", 1.0), (1, "c", 1.0), (2, "a", 1.0), (2, "c", None), (1, "b", 1.0), (1, "d", 0.0)], "cell int, layer string, value double")
    assert {r.cell: r.sensitivity for r in workflow.sensitivity_map(presence, meta).collect()} == {1: 9.0, 2: None}
    assert {r.cell: r.sensitivity for r in workflow.sensitivity_map(presence, meta, "s6", own={"a": 7.0}).collect()} == {1: 7.0, 2: 7.0}


def test_scenario(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(1, 8)], "node_id long, x double, y double, duln double")
    edges = spark.createDataFrame([(i, i, i + 1, 1.0, 0.0) for i in range(1, 7)], "edge_id long, `from` long, `to` long, shape_leng double, duln double")
    edits = spark.createDataFrame([(1, "delete_node", 2, None, None, None, None, None), (2, "add_node", 50, None, None, None, 9.0, 0.0), (3, "add_edge", 60, 7, 50, None, None, None), (4, "change_edge", 6, None, None, 2.0, None, None)], "seq int, op string, id long, `from` long, `to` long, delta double, x double, y double")
    n, e = workflow.apply_scenario(nodes, edges, edits)
    assert sorted((r.node_id, r.node_id_2) for r in n.collect()) == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 50)]
    got = {r.edge_id_2: r for r in e.collect()}
    assert sorted(got) == [3, 4, 5, 6, 60] and got[60].shape_leng == 2.0 and got[6].duln == 2.0 and (got[60]["from"], got[60]["to"]) == (5, 6)


def test_cut_apart(spark):
    cells = spark.createDataFrame([("A", r, c) for r in range(3) for c in range(3)], "aoi string, row int, col int")
    line = spark.createDataFrame([(r, 1) for r in range(3)], "row int, col int")
    parts = aoi.cut_apart(cells, line, 10).collect()
    assert len(parts) == 6 and {r.component for r in parts} == {0, 2}

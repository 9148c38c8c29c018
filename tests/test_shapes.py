"""Polygons, outlines, masks, lines over rasters, draws and medians: by hand, and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowengine.functions import expressions as X
from flowengine.operators import polygons, population, raster, scenario, spatial
from flowengine.plans import workflow
from flowengine.sources import files

RING = "ring array<struct<x: double, y: double>>"


def box(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def test_rings_meet_by_touch_cross_and_hold(spark):
    a = spark.createDataFrame([(1, box(0, 0, 10, 10))], f"a int, {RING}")
    rows = {2: box(10, 10, 1, 1), 3: box(2, 2, 1, 1), 4: box(-5, 4, 20, 1), 5: box(-9, -9, 40, 40), 6: box(10.001, 0, 1, 1), 7: box(10, 2, 3, 3), 8: [(20.0, 0.0), (0.0, 20.5), (30.0, 30.0)], 9: [(0.0, 20.0), (20.0, 0.0), (30.0, 30.0)]}
    b = spark.createDataFrame(list(rows.items()), f"b int, {RING}")
    assert {(r.a, r.b) for r in polygons.meeting(a, b, "a", "b").collect()} == {(1, i) for i in (2, 3, 4, 5, 7, 9)}
    near = {(r.a, r.b): r.distance for r in polygons.within(polygons.sides(a, "a"), polygons.sides(b, "b"), "a", "b", 0.5).collect()}
    assert near[1, 6] == pytest.approx(0.001) and near[1, 8] == pytest.approx(0.25 * 2**0.5, abs=0.2) and (1, 3) not in near
    assert polygons.nearest(a, b.limit(0), "a", "b").collect() == []


def test_nearest_border_is_not_the_nearest_middle(spark):
    parking = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, box(500, 500, 1, 1))], f"id int, {RING}")
    areas = spark.createDataFrame([("long", box(3, -100, 1, 1000)), ("round", box(-8, -2, 4, 4))], f"aoi string, {RING}")
    got = {r.id: (r.aoi, r.distance) for r in polygons.nearest(parking, areas, "id", "aoi").collect()}
    assert got == {1: ("long", 2.0), 2: ("long", 496.0)}  # the middle of "long" is 400 away, that of "round" 6


def test_nearest_against_all_pairs_of_sides(spark):
    rng = np.random.default_rng(1)
    ring = lambda: [tuple(map(float, p)) for p in rng.uniform(-5, 5, 2) * 40 + rng.normal(size=(3, 2)) * rng.choice([0.5, 20])]
    a, b = [(i, ring()) for i in range(25)], [(i, ring()) for i in range(40)]
    got = {r.a: r.distance for r in polygons.nearest(spark.createDataFrame(a, f"a int, {RING}"), spark.createDataFrame(b, f"b int, {RING}"), "a", "b").collect()}

    def dense(r):
        return np.concatenate([np.linspace(p, q, 200) for p, q in zip(r, r[1:] + r[:1])])

    def holds(r, p):
        n = 0
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            n += (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax)
        return n % 2 == 1

    for i, r in a:
        least = min(0.0 if holds(q, r[0]) or holds(r, q[0]) else np.sqrt(((dense(r)[:, None] - dense(q)[None]) ** 2).sum(2).min()) for _, q in b)
        assert got[i] <= least + 1e-9 and got[i] >= least - 1.0


def test_outlines_of_cells(spark, tmp_path):
    rng = np.random.default_rng(7)
    mask = rng.random((12, 14)) < 0.6
    cells = [("A", int(r), int(c)) for r, c in zip(*np.nonzero(mask))] + [("B", 0, c) for c in range(40)] + [("C", 3, 3), ("C", 4, 4), ("C", 3, 3)]
    df = spark.createDataFrame(cells, "aoi string, row int, col int")
    rings = polygons.outlines(df, 100.0, 50.0, 2.0).collect()
    area = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:] + p[:1])) / 2
    for name, n in (("A", int(mask.sum())), ("B", 40), ("C", 2)):
        own = [r for r in rings if r.aoi == name]
        assert sum(r.area for r in own) == pytest.approx(4.0 * n)
        for r in own:
            assert abs(area(r.ring)) == pytest.approx(abs(r.area)) and r.hole == (r.area < 0)
            assert all((a.x == b.x) != (a.y == b.y) for a, b in zip(r.ring, r.ring[1:] + r.ring[:1]))
    assert len([r for r in rings if r.aoi == "C"]) == 2 and len([r for r in rings if r.aoi == "B"][0].ring) == 4
    inside = lambda x, y: sum(sum((a.y > y) != (b.y > y) and x < a.x for a, b in zip(r.ring, r.ring[1:] + r.ring[:1])) for r in rings if r.aoi == "A") % 2 == 1
    assert all(inside(100 + 2 * c + 1, 50 - 2 * r - 1) == mask[r, c] for r in range(12) for c in range(14))
    files.save_areas(df, str(tmp_path / "areas"), 100.0, 50.0, 2.0)
    saved = spark.read.parquet(str(tmp_path / "areas"))
    assert saved.count() == len(rings) and saved.where("geojson LIKE '%Polygon%'").count() == len(rings)
    assert polygons.outlines(df.limit(0), 0.0, 0.0, 1.0).collect() == []


def test_lines_cross_the_cells_they_cut(spark):
    lines = spark.createDataFrame([(1, [(0.5, -0.5), (3.5, -1.6)]), (2, [(0.95, -0.5), (1.05, -1.5)]), (3, [(2.5, -2.5), (2.5, -2.5)]), (4, [(1.0, 1.0)])], "edge_id int, coords array<struct<x: double, y: double>>")
    got = {}
    for r in raster.line_cells(lines, 0.0, 0.0, 1.0).collect():
        got.setdefault(r.edge_id, set()).add((r.row, r.col))
    assert got == {1: {(0, 0), (0, 1), (1, 1), (1, 2), (1, 3)}, 2: {(0, 0), (0, 1), (1, 1)} if (0, 1) in got[2] else {(0, 0), (1, 0), (1, 1)}, 3: {(2, 2)}}
    assert len(got[2]) == 3


def test_masks_keep_present_layers(spark):
    grid = spark.createDataFrame([(s, x + 0.5, y + 0.5, 1.0) for s in "abc" for x in range(6) for y in range(6)], "layer string, x double, y double, value double")
    presence = spark.createDataFrame([("a", box(0, 0, 2, 2)), ("a", box(1, 1, 2, 2)), ("c", box(90, 90, 2, 2))], f"layer string, {RING}")
    got = raster.masked(grid, presence, 2.5)
    assert got.columns == grid.columns and {(r.layer, r.x, r.y) for r in got.collect()} == {("a", x + 0.5, y + 0.5) for x, y in [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]} and got.count() == 7


def test_blend_against_sorted_values(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if v > 9 else float(v)) for g, n in ((0, 400), (1, 1), (2, 7), (3, 50)) for v in rng.integers(0, 12, n)] + [(4, None), (5, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    for nulls in (False, True):
        want = {}
        for g in {r[0] for r in rows if r[0] is not None}:
            own = sorted((v for k, v in rows if k == g and v is not None), reverse=True)
            n = sum(k == g for k, _ in rows) if nulls else len(own)
            if own or nulls:
                want[g] = (np.median(own) + np.median(own[: max(1, n // 4)])) / 2 if own else None
        assert {r.g: r.blend for r in raster.top_quartile_blend(df.where("g IS NOT NULL"), "g", "v", nulls).collect()} == want


def test_draws_of_a_heavy_node_spread_over_parts(spark):
    mass = spark.createDataFrame([(i, 0.1 if i != 40 else 90.0) for i in range(100)], "node_id long, mass double")
    agents = spark.range(20_000).withColumnRenamed("id", "agent_id")
    drawn = population.drawn_nodes(agents, mass)
    upto = np.cumsum([0.1 if i != 40 else 90.0 for i in range(100)])
    u = {r.agent_id: r.u for r in agents.select("agent_id", X.uniform(1, F.lit("start_v"), F.col("agent_id")).alias("u")).collect()}
    got = {r.agent_id: r.start_v for r in drawn.collect()}
    wrong = [a for a in got if got[a] != min(99, int(np.searchsorted(upto, u[a] * upto[-1], "right")))]
    assert len(got) == 20_000 and len(wrong) <= 2  # sums of doubles
    parts = [r.n for r in drawn.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert max(parts) < 15_000


def test_parking_by_border_and_reach(spark):
    nodes = spark.createDataFrame([(1, 5.0, 5.0), (2, 6.0, 6.0), (3, 130.0, 0.0), (4, 500.0, 500.0)], "node_id long, x double, y double")
    parking = spark.createDataFrame([(1, box(0, 0, 30, 30)), (2, box(100, 0, 10, 30)), (3, box(400, 400, 10, 30)), (4, box(0, 0, 30, 60))], f"id int, {RING}")
    outlines = spark.createDataFrame([("A", box(0, 200, 900, 9)), ("B", box(0, -300, 9, 9))], f"aoi string, {RING}")
    areas = spark.createDataFrame([("A", 7.0), ("B", 3.0)], "aoi string, duln double")
    got = {r.node_id: (r.parking, r.parking_attr) for r in workflow.parked(nodes, parking, outlines, areas, 50.0).collect()}
    # polygon 2 puts all on node 3, 20 from its border; 3 has no node within 50 of any polygon but that of 2, which it takes anew
    assert got == {1: (900 / 30 / 2 + 1800 / 30 / 2, 7.0), 2: (900 / 30 / 2 + 1800 / 30 / 2, 7.0), 3: (300 / 30, 7.0), 4: (0.0, 0.0)}


def test_drawn_polygons_are_refused_or_joined(spark):
    drawn = spark.createDataFrame([(10, box(0, 0, 4, 4)), (11, box(3, 3, 4, 4)), (12, box(50, 50, 4, 4)), (13, box(90, 0, 4, 4))], f"id int, {RING}")
    same = spark.createDataFrame([(1, box(6, 6, 4, 4)), (2, box(200, 0, 1, 1))], f"id int, {RING}")
    other = spark.createDataFrame([(1, box(53, 53, 9, 9)), (2, box(94, 4, 1, 1))], f"id int, {RING}")
    assert {r.id: r.group for r in scenario.admitted(drawn, same, other).collect()} == {10: 1, 11: 1, 1: 1, 2: 2}


def test_drawn_edges_take_metres_on_the_sphere(spark):
    nodes = spark.createDataFrame([(1, 8.0, 47.0, 0.0), (2, 8.0, 48.0, 0.0)], "node_id long, x double, y double, duln double")
    edges = spark.createDataFrame([], "edge_id long, `from` long, `to` long, shape_leng double, duln double")
    edit = spark.createDataFrame([(1, "add_edge", 9, 1, 2, None, None, None)], "seq int, op string, id long, `from` long, `to` long, x double, y double, delta double")
    assert scenario.edited(nodes, edges, edit, geodesic=True)[1].first().shape_leng == pytest.approx(111_195, abs=1)
    assert scenario.edited(nodes, edges, edit)[1].first().shape_leng == 1.0


def test_nearest_points_by_grid(spark):
    rng = np.random.default_rng(5)
    t = rng.uniform(0, 100, (900, 2))
    p = rng.uniform(-50, 200, (60, 2))
    got = spatial.nearest(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "k int, x double, y double"), spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(t)], "t int, x double, y double"), "k", "t")
    d = ((p[:, None] - t[None]) ** 2).sum(2)
    assert {r.k: r.t for r in got.collect()} == {i: int(d[i].argmin()) for i in range(60)}

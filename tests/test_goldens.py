"""Values worked out by hand, and properties of the model."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowengine.functions import expressions as X
from flowengine.operators import graph, passage, population, raster, scenario, simulate, spatial
from flowengine.plans import registry
from flowengine.sources import files
from tests import plain_walk

EDGES = [(1, 1, 2, 100.0), (2, 2, 3, 100.0), (3, 1, 4, 50.0), (4, 4, 3, 120.0), (5, 3, 5, 30.0), (6, 2, 5, 200.0)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "length, duln, want",
    [(100, 40, (85.861781, 71.723562, 43.447125)), (100, 45.2423, (87.5, 75, 50)), (100, 2, (10, 10, 10)), (100, -5, (100, 100, 100)), (5, 40, (10, 10, 10)), (100, 0, (10, 10, 10)), (100, None, (None,) * 3)],
)
def test_weighted_length(spark, length, duln, want):
    got = [one(spark, X.weighted_length(F.lit(float(length)), F.lit(duln).cast("double"), k, 11.0)) for k in X.WEIGHTING.values()]
    assert got == [None if w is None else pytest.approx(w, abs=1e-6) for w in want]


@pytest.mark.parametrize("metres, speed, steps", [(130, 5, 6), (1000, 2, 90), (1000, 20, 9)])
def test_travel(spark, metres, speed, steps):
    assert one(spark, X.timesteps(X.travel_minutes(F.lit(metres), F.lit(speed)), "m")) == steps


@pytest.mark.parametrize("n, angle, bonus", [((2, 0), 180, -2), ((1, 1), 90, 0), ((0.001, 0), 0, 1)])
def test_direction_as_written(spark, n, angle, bonus):
    a = X.angle(*[F.lit(float(v)) for v in (0, 0, 1, 0, *n)])
    assert one(spark, a) == pytest.approx(angle, abs=1e-6) and one(spark, X.direction_bonus(a)) == bonus
    assert simulate.bonus((0, 0), (1, 0), n) == bonus


def test_uniform(spark):
    want = int(__import__("hashlib").md5(b"1|a|7").hexdigest()[:8], 16) / 2**32
    assert one(spark, X.uniform(1, F.lit("a"), F.lit(7))) == want == simulate.uniform(1, "a", 7)


def test_route_softmax(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0), (1, 3.0, 0.0, -2.0)], "a int, d double, z double, b double")
    plain = [r.p for r in df.select("d", X.route_probability(F.col("d"), F.col("z"), F.lit(False), "a").alias("p")).orderBy("d").collect()]
    turned = [r.p for r in df.select("d", X.route_probability(F.col("d"), F.col("b"), F.lit(False), "a").alias("p")).orderBy("d").collect()]
    assert plain == pytest.approx([0.015876, 0.117310, 0.866813], abs=1e-6) and sum(plain) == pytest.approx(1)
    assert turned == pytest.approx([0.468311, 0.468311, 0.063379], abs=1e-6)


def test_aoi_utility(spark):
    cols = "agent_id int, aoi string, node_id long, distance double, duln double, area double, speed int, duration int"
    rows = [(1, "A", 1, 300.0, 20.0, 250000.0, 5, 120), (1, "B", 2, 800.0, 30.0, 1e6, 5, 120), (1, "C", 3, 2000.0, 50.0, 4e6, 5, 120)]
    more = [(2, "A", 1, 300.0, 20.0, 250000.0, 2, 30), (2, "B", 2, 800.0, 30.0, 1e6, 2, 30), (3, "A", 1, 9e4, 20.0, 250000.0, 2, 240)]
    out = population.aoi_utility(spark.createDataFrame(rows + more, cols))
    got = {(r.agent_id, r.aoi): (r.u, r.p) for r in out.collect()}
    assert got[1, "A"] == (pytest.approx(-4.141427, abs=1e-6), pytest.approx(0.786881, abs=1e-6))
    assert got[1, "B"] == (pytest.approx(-5.447650, abs=1e-6), pytest.approx(0.213119, abs=1e-6)) and got[1, "C"] == (None, 0)
    goals = {r.agent_id: (r.goal_v, r.aoi_goal) for r in population.drawn_aoi(out).collect()}
    assert goals[2] == (-1, "NO_GOAL") and goals[3] == (1, "A") and goals[1][1] in "AB"


@pytest.mark.parametrize("values, want", [(list(range(1, 11)), 7.5), ([5], 5), ([3, 9], 7.5)])
def test_blend(spark, values, want):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None)], "g int, v double")
    assert raster.top_quartile_blend(df, "g", "v").first().blend == want


def test_passage(spark):
    hist = spark.createDataFrame([("A", "walk", [1, 1, 2], [2]), ("B", "jog", [2], None)], "id string, family string, prior_e array<bigint>, prior_e_aoi array<bigint>")
    edges = spark.createDataFrame([(1,), (2,), (3,)], "edge_id long")
    out = {r.edge_id: r for r in passage.combined_passage(edges, hist).collect()}
    assert (out[1].passage, out[1].passage_aoi, out[1].passage_walk, out[1].passage_jog) == (1, 0, 1, 0)
    assert (out[2].passage, out[2].passage_aoi, out[2].passage_walk, out[2].passage_jog) == (3, 1, 2, 1)
    assert out[3].passage == 0 and all(r.passage == r.passage_walk + r.passage_dog + r.passage_bike + r.passage_jog for r in out.values())


def _network(spark):
    edges = spark.createDataFrame(EDGES, "edge_id long, `from` long, `to` long, w double")
    return edges, graph.symmetric(edges, "w").withColumn("weighting", F.lit("distance"))


def test_shortest_paths(spark):
    edges, w = _network(spark)
    pairs = spark.createDataFrame([("distance", 1, 5), ("distance", 5, 1), ("distance", 2, 4), ("distance", 1, 1), ("distance", 1, 99), ("distance", 77, 1)], "weighting string, src long, goal long")
    paths = graph.shortest_paths(w, pairs)
    got = {(r.src, r.goal): (r.path, r.distance) for r in paths.collect()}
    assert got == {(1, 5): ([4, 3, 5], 200), (5, 1): ([3, 4, 1], 200), (2, 4): ([1, 4], 150), (1, 1): ([1], 0), (1, 99): ([], 0), (77, 1): ([], 0)}
    e = {(r.src, r.goal): (r.history, r.current) for r in graph.path_edges(paths, edges).collect()}
    assert e[1, 5] == ([4], 5)
    far = {r.node_id: r.distance for r in graph.relational_distances(w, w.where("src = 1").select("weighting", "src")).collect()}
    assert far == {1: 0, 2: 100, 3: 170, 4: 50, 5: 200}


def test_relational_distances_are_whole_or_raise(spark):
    chain = graph.symmetric(spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "`from` long, `to` long, w double"), "w").withColumn("weighting", F.lit("distance"))
    source = chain.where("src = 0").select("weighting", "src")
    assert {r.node_id: r.distance for r in graph.relational_distances(chain, source).collect()} == {i: float(i) for i in range(7)}
    assert {r.node_id: r.distance for r in graph.relational_distances(chain, source, cell=2).collect()} == {i: float(i) for i in range(7)}
    with pytest.raises(ValueError):
        graph.relational_distances(chain, source, cell=1, rounds=3)
    assert inspect.signature(graph.relational_distances).parameters["rounds"].default is None


def test_lines_to_graph_and_components(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(1.0000000001, 0.0), (2.0, 0.0)]), (3, [(9.0, 9.0), (8.0, 8.0)])], "line_id long, coords array<struct<x: double, y: double>>")
    nodes, edges = graph.lines_to_graph(lines)
    assert sorted(r.node_id for r in nodes.collect()) == [1, 2, 3, 4, 5] and sorted(r.edge_id for r in edges.collect()) == [1, 2, 3]
    big, inner = graph.largest_component(nodes, edges)
    assert big.count() == 3 and sorted(r.line_id for r in inner.collect()) == [1, 2]


def test_whole_graph_components(spark):
    """All of lineitem against union-find."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for s, p in rows:
        a, b = find(s), find(p + 10_000_000_000)
        up[max(a, b)] = min(a, b)
    want = {}
    for v in list(up):
        want.setdefault(find(v), set()).add(v)
    assert {r.component: r.n for r in registry.QUERIES["whole_component_sizes"](spark, "/root/testdata/sf0.001").collect()} == {c: len(x) for c, x in want.items()}
    best = min(want, key=lambda c: (-len(want[c]), c))
    assert {r.node_id for r in registry.QUERIES["largest_component"](spark, "/root/testdata/sf0.001").collect()} == want[best]
    assert len(up) == len({s for s, _ in rows}) + len({p for _, p in rows})


def test_whole_ring(spark):
    """All suppliers against Floyd-Warshall, and a simulation that reaches the whole network."""
    d = "/root/testdata/sf0.01"
    w, n = registry.whole_ring(spark, d)
    assert n == spark.read.parquet(f"{d}/supplier.parquet").count() > 40
    dist = np.full((n, n), np.inf)
    np.fill_diagonal(dist, 0)
    for r in w.collect():
        dist[r.src, r.dst] = min(dist[r.src, r.dst], r.w)
    step = dist.copy()
    for k in range(n):
        dist = np.minimum(dist, dist[:, k, None] + dist[k])
    want = {(s, g): dist[s, g] for s in range(0, n, 20) for g in range(n)}
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {(r.src, r.goal): r.distance for r in run("shortest_distance")} == want
    assert {(r.src, r.node_id): r.distance for r in run("relational_distance")} == want
    for r in run("shortest_path_nodes"):
        path = [r.src, *r.path]
        assert path[-1] == r.goal and sum(step[a, b] for a, b in zip(path, path[1:])) == want[r.src, r.goal]
    near = {(s, chr(65 + r)): min((dist[s, v], v) for v in range(n) if v % 4 == 1 and v % 3 == r) for s in range(0, n, 20) for r in range(3)}
    assert {(r.src, r.aoi): (r.distance, r.node_id) for r in run("nearest_aoi_node")} == near
    goals = {s: min((dist[s, g], g) for g in (n // 4, n // 2, 3 * n // 4)) for s in range(0, n, 20)}
    assert {r.src: (r.distance, r.goal) for r in run("nearest_of_goals")} == goals
    walked = run("simulate_passage")
    assert len(walked) == 3 * n and sum(r.passage > 0 for r in walked) > n


def test_large_graphs_have_paths_and_labels(spark, monkeypatch):
    edges = spark.createDataFrame([*EDGES, (7, 5, 6, 0.0), (8, 6, 7, 0.0), (9, 7, 5, 0.0), (10, 8, 9, 1.0)], "edge_id long, `from` long, `to` long, w double")
    w = graph.symmetric(edges, "w").withColumn("weighting", F.lit("distance"))
    pairs = spark.createDataFrame([("distance", a, b) for a in (1, 5, 8, 77) for b in (1, 2, 3, 4, 5, 7, 9, 77)] + [("no", 1, 1), ("no", 1, 2)], "weighting string, src long, goal long")
    labels = spark.createDataFrame([(2, "A"), (3, "A"), (7, "B"), (9, "C"), (77, "D"), (4, "0")], "node_id long, aoi string")
    sources = pairs.select("weighting", "src")
    dist = {(a, b): 0.0 if a == b else np.inf for a in range(1, 10) for b in range(1, 10)}
    for r in w.collect():
        dist[r.src, r.dst] = min(dist[r.src, r.dst], r.w)
    for k in range(1, 10):
        for a, b in list(dist):
            dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    near = {(a, x): min((dist[a, v], v) for v in vs) for a in (1, 5, 8) for x, vs in {"A": (2, 3), "B": (7,), "C": (9,)}.items()}
    whole = None
    for cell, searches in ((4096, 512), (3, 1), (1, 2)):
        monkeypatch.setattr(graph, "SOURCES", searches)
        paths = sorted(graph.shortest_paths(w, pairs, cell=cell).collect())
        for r in paths:
            ends = (r.src, r.goal)
            assert r.distance == (dist[ends] if r.weighting == "distance" and dist.get(ends, np.inf) < np.inf else 0.0)
            assert r.path[-1:] == ([r.goal] if r.src == r.goal or r.distance or ends == (5, 7) else []) and len(set(r.path)) == len(r.path)
            if len(r.path) and r.src != r.goal:
                assert sum(dist[p] for p in zip([r.src, *r.path], r.path)) == r.distance
        whole = whole or paths
        assert paths == whole
        got = graph.nearest_label_nodes(w, sources, labels, cell=cell).collect()
        assert {(r.src, r.aoi): (r.distance, r.node_id) for r in got} == {k: v for k, v in near.items() if v[0] < np.inf} and len(got) == len({(r.src, r.aoi) for r in got})


def test_long_ways_take_few_rounds(spark):
    """A grid of 2 x 1,200 nodes, whose ways have over 1,000 edges: rounds follow the cells, path joins the logarithm."""
    n, wide = 1_200, 2
    edges = [(wide * i + j, wide * i + j + 1, 1.0 + i % 3) for i in range(n) for j in range(wide - 1)] + [(wide * i + j, wide * i + wide + j, 2.0 + (i * 7 + j * 3) % 5) for i in range(n - 1) for j in range(wide)]
    w = graph.symmetric(spark.createDataFrame(edges, "`from` long, `to` long, w double"), "w").withColumn("weighting", F.lit("distance")).cache()
    best = {v: np.inf for v in range(n * wide)} | {0: 0.0}
    for _ in range(3):  # forward and backward sweeps along the grid
        for a, b, c in sorted(edges) + sorted(edges, reverse=True):
            best[b], best[a] = min(best[b], best[a] + c), min(best[a], best[b] + c)
    source = spark.createDataFrame([("distance", 0)], "weighting string, src long")
    got = {r.node_id: r.distance for r in graph.relational_distances(w, source, cell=400, rounds=10).collect()}
    assert got == best
    pairs = spark.createDataFrame([("distance", 0, n * wide - 1), ("distance", n * wide - 1, 5)], "weighting string, src long, goal long")
    step = {(a, b): c for x, y, c in edges for a, b in ((x, y), (y, x))}
    for r in graph.shortest_paths(w, pairs).collect():
        path = [r.src, *r.path]
        assert len(path) > 1_000 and path[-1] == r.goal and sum(step[p] for p in zip(path, path[1:])) == r.distance


def test_induced_labels(spark):
    nodes = spark.createDataFrame([(i, "A" if i in (1, 2, 3, 7) else "0") for i in range(1, 9)], "node_id long, aoi string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "`from` long, `to` long")
    assert {r.node_id for r in graph.induced_labels(nodes, edges).where("aoi = 'A'").collect()} == {1, 2, 3, 4}


def test_labels_in_turn(spark):
    """Against a plain fold over the labels, on graphs with rings, chains and labels that touch."""
    for seed in range(3):
        pick = lambda i, m: (i * 7919 + seed * 104729 + i * i * 31) % m  # noqa: B023, E731
        has = {i: ("0", "A", "B", "AA", "C")[pick(i, 5)] for i in range(40)}
        pairs = [(i, (i + 1 + pick(i, 4)) % 40) for i in range(40)]
        near = {i: {i} | {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in has}
        want = dict(has)
        for name in ("A", "B", "C", "AA"):
            left, parts = {v for v in want if want[v] == name}, []
            while left:
                part, front = set(), {left.pop()}
                while front:
                    part |= front
                    front = {n for v in front for n in near[v] if want[n] == name} - part
                parts.append(part)
                left -= part
            top = max(map(len, parts), default=0)
            for part in parts:
                if len(part) < top:
                    want.update(dict.fromkeys(part, "0"))
            for part in [p for p in parts if len(p) == top]:
                want.update(dict.fromkeys(set().union(*(near[v] for v in part)), name))
        nodes = spark.createDataFrame(list(has.items()), "node_id long, aoi string")
        got = graph.labels_in_turn(nodes, spark.createDataFrame(pairs, "`from` long, `to` long"))
        assert {r.node_id: r.aoi for r in got.collect()} == want


def test_labels_that_do_not_touch_settle_in_one_round(spark, monkeypatch):
    """Forty labels along a chain, each beside two others: rounds follow the chains of rising labels, not the labels."""
    rounds, made = [], graph.components
    monkeypatch.setattr(graph, "components", lambda *a: rounds.append(1) or made(*a))
    has = [(i, None if i == 399 else f"{i // 10 * 7 % 41:02d}") for i in range(400)]
    nodes = spark.createDataFrame(has, "node_id long, aoi string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(399)], "`from` long, `to` long")
    got = {r.node_id: r.aoi for r in graph.labels_in_turn(nodes, edges).collect()}
    want = [v for _, v in has]
    for name in sorted({v for v in want if v}):
        mine = [i for i in range(400) if want[i] == name]  # one run
        for i in {j for i in mine for j in (i - 1, i, i + 1) if 0 <= j < 400}:
            want[i] = name
    assert got == dict(enumerate(want)) and len(rounds) <= 6


def test_labels_in_turn_without_labels(spark):
    nodes = spark.createDataFrame([(1, "0"), (2, None)], "node_id long, aoi string")
    edges = spark.createDataFrame([(1, 2), (2, 2)], "`from` long, `to` long")
    assert {r.node_id: r.aoi for r in graph.labels_in_turn(nodes, edges).collect()} == {1: "0", 2: None}
    assert graph.labels_in_turn(nodes.limit(0), edges).collect() == []


def test_drawn_polygons_apply_in_their_order(spark):
    """A polygon without nodes takes the place of what its node had; later shares come on top."""
    def ring(x, y):
        return [(x, y), (x + 30.0, y), (x + 30.0, y + 30.0), (x, y + 30.0)]

    nodes = spark.createDataFrame([(1, 5.0, 5.0, 100.0), (2, 500.0, 500.0, None)], "node_id long, x double, y double, parking double")
    kind = "id long, ring array<struct<x: double, y: double>>"
    put = lambda *rows: {r.node_id: r.parking for r in scenario.with_polygons(nodes, spark.createDataFrame(list(rows), kind), 30.0, 10.0).collect()}
    assert put((1, ring(0.0, 0.0)), (2, ring(10.0, 10.0))) == {1: 30.0, 2: 0.0}
    assert put((1, ring(10.0, 10.0)), (2, ring(0.0, 0.0))) == {1: 60.0, 2: 0.0}
    both = spark.createDataFrame([(1, 5.0, 5.0, 100.0), (2, 6.0, 6.0, 100.0)], "node_id long, x double, y double, parking double")
    gone = lambda **how: {r.node_id: r.parking for r in scenario.without_polygons(both, spark.createDataFrame([(1, ring(0.0, 0.0))], kind), 10.0, **how).collect()}
    assert gone() == {1: 70.0, 2: 70.0} and gone(as_written=False) == {1: 85.0, 2: 85.0}


def test_lines_meet_a_perimeter(spark):
    """Exact after the box: through the ring without a point in it, inside it, and past its corner."""
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    lines = {1: [(-1.0, 1.0), (5.0, 1.5)], 2: [(1.0, 1.0)], 3: [(3.0, 3.0), (4.0, 4.0)], 4: []}
    df = spark.createDataFrame(list(lines.items()), "id long, coords array<struct<x: double, y: double>>")
    side = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    assert {r.id for r in df.where(files.meets(F.col("coords"), side)).collect()} == {1, 2}


def test_raster_sinks(spark, tmp_path):
    grid = spark.createDataFrame([("a", 0, 0, 0.5, -0.5, 1.0), ("a", 0, 9, 9.5, -0.5, 2.0), ("b", 0, 0, 0.5, -0.5, 3.0)], "layer string, row int, col int, x double, y double, value double")
    files.save_raster(grid, str(tmp_path / "new"), "smoothed")
    assert spark.read.text(str(tmp_path / "new_info")).first()[0] == "smoothed"
    files.save_cropped(spark, {"new": str(tmp_path / "new")}, "new", str(tmp_path / "out"), ["a"], (0.0, -1.0, 5.0, 0.0))
    assert [(r.layer, r.value) for r in files.raster(spark, str(tmp_path / "out")).collect()] == [("a", 1.0)]
    files.save_outlines(spark.createDataFrame([("A", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "label string, ring array<struct<x: double, y: double>>"), str(tmp_path / "rings"))
    assert spark.read.parquet(str(tmp_path / "rings")).first().geojson == '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0]]]}'


def test_spatial(spark):
    ring = "array<struct<x: double, y: double>>"
    poly = spark.createDataFrame([(1, [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)]), (2, [(100.0, 100.0), (130.0, 100.0), (130.0, 130.0)])], f"id long, ring {ring}")
    nodes = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 20.0), (3, 90.0, 90.0)], "node_id long, x double, y double")
    got = {r.node_id: r.parking for r in spatial.capacities(poly, nodes, 30.0, 10.0).collect()}
    assert got == {1: 15.0, 2: 15.0, 3: 15.0}
    pts, few = nodes.withColumnRenamed("node_id", "p"), nodes.select(F.col("node_id").alias("t"), "x", "y")
    near = spatial.nearest(pts, few, "p", "t").collect()
    old, spatial.BROADCAST_TARGETS = spatial.BROADCAST_TARGETS, 0
    try:
        assert sorted(spatial.nearest(pts, few, "p", "t").collect()) == sorted(near)
    finally:
        spatial.BROADCAST_TARGETS = old


def test_perimeters(spark):
    wkt = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    df = spark.createDataFrame([(1, wkt), (2, "POLYGON((0 0, 4 4, 4 0, 0 4))"), (3, "POLYGON((0 0, 1 1))"), (4, "no")], "id int, t string")
    got = {r.id: r.ok for r in df.select("id", files.valid_perimeter(files.ring_from_wkt(F.col("t"))).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    back = spark.range(1).select(files.ring_from_geojson(files.geojson(files.ring_from_wkt(F.lit(wkt)))).alias("r")).first().r
    assert [(p.x, p.y) for p in back] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert files.uploadable(["a.shp", "a.shx", "a.dbf"]) == "shp" and files.uploadable(["a.kml"]) == "kml"
    with pytest.raises(ValueError):
        files.uploadable(["a.shp"])


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("latinN;ch.priority;cover\nPica pica;PR1;1,5\n")
    r = files.species_table(spark, str(tmp_path / "s.csv"), ["cover"]).first()
    assert (r.ch_priority, r.cover) == ("PR1", 1.5)
    edges, _ = _network(spark)
    files.save_snapshot({"edges": edges}, str(tmp_path / "snap"), "step5")
    step, tables = files.load_snapshot(spark, str(tmp_path / "snap"))
    assert step == "step5" and tables["edges"].count() == 6
    rows = [(1, [(0.0, 0.0), (1.0, 1.0)], 0.0, 0.0, 1.0, 1.0, 1.4, "1", "2.5", "x"), (2, [(9e4, 9e4), (9e4, 9e4)], 9e4, 9e4, 9e4, 9e4, 0.0, None, "", "2")]
    spark.createDataFrame(rows, files.LINES).write.parquet(str(tmp_path / "lines"))
    near = files.lines(spark, str(tmp_path / "lines"), (0, 0, 10, 10))
    assert [(r.line_id, r.walk_bike, r.road_width, r.hard_natur) for r in near.collect()] == [(1, 2, 2.5, None)]
    assert "PushedFilters: [IsNotNull" in near._jdf.queryExecution().toString()


def test_scenarios():
    assert scenario.free_name("plan", ["plan", "plan_2"]) == "plan_3" and scenario.free_name("new", []) == "new"


def test_simulation(spark):
    """Rows equal to the plain simulation's, in whole areas and in areas walked cell by cell."""
    agents, weights, nodes, edges, duln = registry.simulation_inputs(spark, "/root/testdata/sf0.001")
    # among them agents without a goal, with a goal in no area, that start in the area and at their goal, and beyond the network
    odd = agents.where("agent_id < 9").withColumns({
        "agent_id": F.col("agent_id") + 100_000, "aoi_goal": F.when(F.col("agent_id") == 1, "Z").when(F.col("agent_id") != 6, "A"),
        "start_v": F.when(F.col("agent_id") == 2, 77_777).when(F.col("agent_id") % 2 == 1, F.col("goal_v")).otherwise(F.col("goal_v") - 1),
        "goal_v": F.when(F.col("agent_id") == 4, -1).when(F.col("agent_id") == 8, F.lit(None)).otherwise(F.col("goal_v")),
    })
    # a blind alley of three nodes in the area, with parallel edges, and a node beyond the network
    alley = spark.createDataFrame([(800_001 + i, a, b, 40.0 + i) for i, (a, b) in enumerate([(7, 88_001), (88_001, 88_002), (88_002, 88_003), (88_003, 88_002)])], "edge_id long, `from` long, `to` long, shape_leng double")
    extra = spark.createDataFrame([(77_777, 0.0, 0.0, "0")] + [(88_000 + i, 2.0 + i, 0.5, "A") for i in (1, 2, 3)], "node_id long, x double, y double, aoi string")
    more = graph.symmetric(alley.withColumnRenamed("shape_leng", "w"), "w").withColumn("weighting", F.lit("distance"))
    weights = weights.unionByName(more).unionByName(more.withColumn("weighting", F.lit("little_attr"))).unionByName(more.withColumn("weighting", F.lit("jogger:distance")))
    agents, inputs = graph.cut(agents.where("agent_id < 40").unionByName(odd)), (graph.cut(weights), nodes.unionByName(extra), edges.unionByName(alley), duln)
    read = lambda df: sorted((r.agent_id, r.seq, r.timestep, r.behaviour, r["from"], r["to"], r.edge_id, r.in_aoi) for r in df.collect())
    want = sorted(plain_walk.walked(agents.where("goal_v IS NOT NULL"), *inputs))
    assert {r[3] for r in want} == {"shortest", "nicest", "retracing", "nicestShortest"}
    assert read(simulate.simulated(agents, *inputs)) == want
    short = agents.withColumn("time_ext", F.lit(3))  # in cells of four nodes, so that walks are handed over
    want_short = sorted(plain_walk.walked(short.where("goal_v IS NOT NULL"), *inputs, seed=2, as_written=False))
    assert len(want_short) < len(want) and read(simulate.simulated(short.repartition(3), *inputs, seed=2, as_written=False, area_rows=4)) == want_short
    assert read(simulate.simulated(agents.where("false"), *inputs)) == []
    near = {(r["from"], r["to"]) for r in inputs[2].collect()}
    near |= {(b, a) for a, b in near}
    by = {}
    for r in want:
        assert (r[4], r[5]) in near and r[6] is not None or r[4] == r[5]
        assert by.get(r[0], r[4]) == r[4]  # an unbroken walk
        by[r[0]] = r[5]
    starts = {r.agent_id: r.start_v for r in agents.collect()}
    assert all(by[a] == starts[a] for a in by)  # everybody comes home


def test_mercator_round_trip(spark):
    x, y = X.to_mercator(F.lit(8.5), F.lit(47.3))
    lon, lat = X.from_mercator(x, y)
    assert (one(spark, lon), one(spark, lat)) == (pytest.approx(8.5), pytest.approx(47.3))
    assert math.isclose(one(spark, X.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))), 111195.08, rel_tol=1e-6)


def test_stream(spark, tmp_path):
    from flowengine.streaming.passage_stream import windowed_passage

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_passage(stream, edge="event_type").writeStream.format("memory").queryName("passages").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT sum(n) FROM passages").first()[0]
    assert 0 < got <= events.count()


def test_edits_apply_in_their_order(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(1, 7)], "node_id long, x double, y double, duln double")
    edges = spark.createDataFrame([(i, i, i + 1, 1.0, 0.0) for i in range(1, 6)], "edge_id long, `from` long, `to` long, shape_leng double, duln double")
    log = [
        (1, "change_edge", 4, None, None, 5.0, None, None), (2, "add_edge", 10, 5, 1, None, None, None), (3, "delete_node", 5, None, None, None, None, None), (4, "add_node", 5, None, None, None, 5.0, 3.0),
        (5, "add_edge", 11, 5, 2, None, None, None), (6, "change_edge", 11, None, None, 2.0, None, None), (7, "delete_edge", 1, None, None, None, None, None), (8, "add_edge", 1, 1, 3, None, None, None),
        (9, "add_node", 9, None, None, None, 0.0, 0.0), (10, "delete_node", 9, None, None, None, None, None), (11, "change_edge", 2, None, None, 1.0, None, None), (12, "change_edge", 2, None, None, 0.5, None, None),
    ]
    edits = spark.createDataFrame(log, "seq int, op string, id long, `from` long, `to` long, delta double, x double, y double")

    # plainly, one edit after another
    n, e, new = {i: [float(i), 0.0, 1.0] for i in range(1, 7)}, {i: [i, i + 1, 1.0, 0.0] for i in range(1, 6)}, None
    for _, op, i, a, b, delta, x, y in log:
        if op == "delete_node":
            n.pop(i)
            e = {k: v for k, v in e.items() if i not in v[:2]}
        elif op == "add_node":
            n[i] = [x, y, 0.0]
        elif op == "delete_edge":
            e.pop(i)
        elif op == "add_edge":
            e[i] = [a, b, ((n[a][0] - n[b][0]) ** 2 + (n[a][1] - n[b][1]) ** 2) ** 0.5, 0.0]
        elif i in e:
            e[i][3] += delta
            for v in e[i][:2]:
                n[v][2] += delta
    # a change of an edge that is gone at the end leaves no mark on the ends that stay
    n[4][2] -= 5.0
    got_n, got_e = scenario.edited(nodes, edges, edits)
    assert {r.node_id: [r.x, r.y, r.duln] for r in got_n.collect()} == n
    assert {r.edge_id: [r["from"], r["to"], r.shape_leng, r.duln] for r in got_e.collect()} == e
    assert got_n.columns == nodes.columns and got_e.columns == edges.columns


def test_perimeters_lie_in_a_country(spark):
    border = "POLYGON ((0 0, 10 0, 10 10, 5 2, 0 10, 0 0))"
    rows = [("POLYGON ((1 1, 2 1, 2 2, 1 1))", True), ("POLYGON ((11 1, 12 1, 12 2, 11 1))", False), ("POLYGON ((1 7, 9 7, 9 8, 1 7))", False), ("POLYGON ((9 1, 11 1, 11 2, 9 1))", False)]
    df = spark.createDataFrame(rows, "wkt string, want boolean").select("want", files.in_country(files.ring_from_wkt(F.col("wkt")), files.ring_from_wkt(F.lit(border))).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_height_and_measure_are_dropped(spark):
    rows = ["POLYGON ZM ((1 2 3 4, 5.5 -6e2 7 8, 1 2 3 4))", "LINESTRING Z (0 0 9, 1 1 9)", "POINT M (1 2 3)", "POLYGON ((1 2, 3 4, 1 2))", "POINT Z EMPTY", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(files.flat_wkt(F.col("t"))).collect()]
    assert got == ["POLYGON ((1 2, 5.5 -6e2, 1 2))", "LINESTRING (0 0, 1 1)", "POINT (1 2)", "POLYGON ((1 2, 3 4, 1 2))", "POINT EMPTY", None]

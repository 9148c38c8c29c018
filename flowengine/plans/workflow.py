"""The engine's end-to-end flows: network, areas of interest, simulation, sensitivity, scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowengine.functions import expressions as X
from flowengine.operators import aoi, graph, passage, population, raster, scenario, simulate, species
from flowengine.operators import polygons as rings


def build_network(lines: DataFrame, residents: DataFrame, attractiveness: DataFrame, x0: float, y0: float, res: float, spread: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of path lines: the largest component, with residents and attractiveness sampled at the nodes.

    As written, each node takes the residents of its cell whole; `spread` shares them among the cell's nodes.
    """
    nodes, edges = graph.largest_component(*graph.lines_to_graph(lines))
    nodes = raster.sampled(nodes, residents.select("row", "col", F.col("value").alias("residents")), x0, y0, res)
    if spread:
        row, col = raster.cell_of(F.col("x"), F.col("y"), x0, y0, res)
        nodes = raster.spread_mass(nodes.withColumns({"_r": row, "_c": col}), ["_r", "_c"], "residents", "residents").drop("_r", "_c")
    layers = attractiveness.groupBy("row", "col").pivot("layer", list(X.SPEED)).agg(F.first("value"))
    return raster.sampled(nodes, layers, x0, y0, res), edges


def enrich(nodes: DataFrame, edges: DataFrame, cells: DataFrame, areas: DataFrame, parking: DataFrame, x0: float, y0: float, res: float, threshold: float, in_turn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edge weights): labels of the areas' main parts (one area after the other, or all at once), parking places, and the weighted lengths of every type."""
    settle = graph.labels_in_turn if in_turn else graph.induced_labels
    nodes = settle(aoi.labelled_nodes(nodes, cells, x0, y0, res), edges)
    nodes = parked(nodes, aoi.parking_near(parking, cells, x0, y0, res), rings.outlines(cells, x0, y0, res), areas, 10 * res)
    return nodes, edge_weights(nodes, edges, threshold)


def parked(nodes: DataFrame, parking: DataFrame, outlines: DataFrame, areas: DataFrame, cell: float, reach: float = 50.0, per_place: float = 30.0) -> DataFrame:
    """Nodes with parking places and their attractiveness, polygon after polygon (id, ring).

    Nodes in a polygon share its places; a polygon without nodes puts all of them, in place of what was there, on the node
    nearest to its border among those within `reach` of any polygon. A node's parking is as attractive as the area nearest
    to the border of the last polygon it took places from.
    """
    held = graph.cut(rings.holders(parking, nodes, cell, reach))
    near = rings.nearest(parking.select(F.col("id").alias("poly"), "ring"), outlines.select("aoi", "ring"), "poly", "aoi").join(areas.select("aoi", "duln"), "aoi")
    last = held.join(near, "poly").groupBy("node_id").agg(F.max_by("duln", "poly").alias("parking_attr"))
    out = scenario.with_polygons(nodes.drop("parking_attr").withColumn("parking", F.lit(0.0)), parking, per_place, cell, "parking", held)
    return out.join(last, "node_id", "left").withColumn("parking_attr", F.coalesce("parking_attr", F.lit(0.0)))


def edge_weights(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(agent_type, weighting, src, dst, w) in both directions, by the edge's own attractiveness; where it has none, the mean of its ends'."""
    kinds = list(X.SPEED)
    own = F.array(*[F.col(k).cast("double") if k in edges.columns else F.lit(None).cast("double") for k in kinds])
    at = nodes.select("node_id", F.array(*kinds).alias("d"))
    both = edges.join(at.withColumnsRenamed({"node_id": "from", "d": "_a"}), "from").join(at.withColumnsRenamed({"node_id": "to", "d": "_b"}), "to")
    typed = both.select("edge_id", "from", "to", "shape_leng", F.posexplode(F.arrays_zip("_a", "_b", own.alias("_own"))).alias("i", "d")).withColumn("duln", F.coalesce("d._own", (F.col("d._a") + F.col("d._b")) / 2))
    typed = typed.withColumn("agent_type", F.get(F.array(*map(F.lit, kinds)), F.col("i")))
    long = typed.select(*X.weightings(["edge_id", "from", "to", "agent_type"], "shape_leng", "duln", threshold)).select("edge_id", "from", "to", "agent_type", F.concat_ws(":", "agent_type", "x.weighting").alias("weighting"), "x.w")
    return graph.symmetric(long, "agent_type", "weighting", "w").where("w IS NOT NULL")


def run_simulation(nodes: DataFrame, edges: DataFrame, weights: DataFrame, areas: DataFrame, n_agents: int | None = None, seed: int = 1, parking_intensity: float = 0.1) -> dict[str, DataFrame]:
    """Visitors, their log, and passage per edge. Without a number, one visitor stands for 50 residents."""
    spark = nodes.sparkSession
    n = n_agents if n_agents is not None else int(population.agent_number(nodes).first().n_agents)
    ids = spark.range(1, n + 1).withColumnRenamed("id", "agent_id")
    agents = population.drawn_nodes(population.with_duration(population.with_type(ids, seed), seed), population.node_mass(nodes, parking_intensity), seed)
    agents = graph.cut(agents)
    # as written, areas are searched by the little_attr weights
    sources = agents.select(F.concat(F.col("agent_type"), F.lit(":little_attr")).alias("weighting"), F.col("start_v").alias("src"))
    reached = graph.nearest_label_nodes(weights, sources, nodes.select("node_id", "aoi"))
    choices = agents.withColumn("weighting", F.concat(F.col("agent_type"), F.lit(":little_attr"))).join(reached, (F.col("start_v") == F.col("src")) & (agents.agent_type == F.split(reached.weighting, ":")[0]))
    choices = choices.select("agent_id", "aoi", "node_id", "distance", "speed", F.col("time_ext").alias("duration")).join(areas.select("aoi", "duln", "area"), "aoi")
    goals = population.drawn_aoi(population.aoi_utility(choices), seed)
    agents = graph.cut(agents.join(goals, "agent_id", "left").fillna({"goal_v": -1, "aoi_goal": "NO_GOAL"}))
    kinds = list(X.SPEED)
    duln = nodes.select("node_id", F.explode(F.arrays_zip(F.array(*map(F.lit, kinds)).alias("k"), F.array(*kinds).alias("v"))).alias("d")).select(F.col("d.k").alias("agent_type"), "node_id", F.coalesce("d.v", F.lit(0.0)).alias("duln"))
    log = graph.cut(simulate.simulated(agents, weights, nodes, edges, duln, seed))
    counted = passage.combined_passage(edges, simulate.histories(log, agents))
    inside = nodes.where("aoi <> '0'").select("node_id")
    return {"agents": agents, "log": log, "passage": passage.incident_passage(counted, inside), "starts": passage.start_points(nodes, agents), "paths": simulate.path_geometries(log, nodes)}


def sensitivity_map(presence: DataFrame, metadata: DataFrame, code: str = "s8", by: str = "threat", own: dict[str, float] | None = None) -> DataFrame:
    """(cell, sensitivity) of the species that a filter keeps, by threat or priority weights or weights given by hand."""
    kept = species.weighted(species.filtered(metadata, code), by)
    if own:
        kept = kept.withColumn("weight", F.coalesce(X.lookup(own, F.col("species")), F.col("weight")))
    return raster.sensitivity(raster.non_empty_layers(presence), kept.select(F.col("species").alias("layer"), "weight"))


def apply_scenario(nodes: DataFrame, edges: DataFrame, edits: DataFrame, deltas: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the edits: the largest component, with dense ids; the ids before stay as node_id_2, edge_id_2, from_2, to_2."""
    nodes, edges = graph.largest_component(*scenario.edited(nodes, edges, edits, deltas))
    nodes = graph.cut(graph.dense_ids(nodes.withColumnRenamed("node_id", "node_id_2"), ["node_id_2"], "node_id"))
    edges = edges.withColumnsRenamed({"edge_id": "edge_id_2", "from": "from_2", "to": "to_2"})
    at = nodes.select("node_id", "node_id_2")
    edges = edges.join(at.withColumnsRenamed({"node_id": "from", "node_id_2": "from_2"}), "from_2").join(at.withColumnsRenamed({"node_id": "to", "node_id_2": "to_2"}), "to_2")
    return nodes, graph.dense_ids(edges, ["edge_id_2"], "edge_id")


def scenario_weights(nodes: DataFrame, edges: DataFrame, edits: DataFrame, deltas: dict[str, str], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, weights) after the edits: weights are made anew from the edited edges' own attractiveness."""
    nodes, edges = map(graph.cut, apply_scenario(nodes, edges, edits, deltas))
    return nodes, edges, edge_weights(nodes, edges, threshold)

"""Scenarios: copies of a network and logs of edits folded onto them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowengine.functions import expressions as X

from . import aoi, raster, spatial
from . import polygons as rings
from .graph import cut

#: Effect of each level of an attribute on each attractiveness, in the order of EFFECT_COLUMNS.
EFFECT_COLUMNS = ("walkNat", "walkSoc", "biker", "ebike", "all", "jogger", "dogNat", "dogProx")
EFFECTS = {
    "walkBike1": (0, 0, 0, 0, 0, 0, 0, 0),
    "walkBike2": (3, 1, 0, 1, 1, 2, 3, 1),
    "walkBike3": (2, 1, 3, 3, 3, 2, 2, 1),
    "walkBike4": (0, 0, 3, 2, 2, 0, -1, 0),
    "hardNatur1": (0, 2, 2, 2, 2, 2, 0, 1),
    "hardNatur2": (3, 2, -1, 3, 3, 3, 2, 2),
    "width1": (2, 1, -2, -2, 1, 2, 2, 1),
    "width2": (2, 3, 3, 3, 3, 2, 2, 3),
    "width3": (-3, -2, -1, -1, -2, -3, -3, -2),
    "width4": (-3, -2, -1, -1, -2, -3, -3, -2),
}
#: Codes of the editor's choices.
SIGNAGE = {"c1": 2, "c2": 3, "c3": 4, "c4": 1}
SURFACE = {"c1": 2, "c2": 1}
WIDTH = {"c1": 5, "c2": 4, "c3": 3, "c4": 2}


def edit_codes(edits: DataFrame) -> DataFrame:
    """Edits with walk_bike, hard_natur and road_width from the chosen codes (defaults 1, 2 and 5)."""
    return edits.withColumns({n: F.coalesce(X.lookup(t, F.col(c)), F.lit(d)) for n, t, c, d in (("walk_bike", SIGNAGE, "signage", 1), ("hard_natur", SURFACE, "surface", 2), ("road_width", WIDTH, "width", 5))})


def attribute_effect(level_columns: list[str]) -> dict:
    """Effect on each attractiveness: the sum over the levels named in the columns."""
    return {c: reduce(lambda a, b: a + b, [X.lookup({lv: e[i] for lv, e in EFFECTS.items()}, F.col(x)) for x in level_columns]) for i, c in enumerate(EFFECT_COLUMNS)}


def attribute_delta(changes: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Changes with d_<column>: the new levels' effect less the old ones'."""
    a, b = attribute_effect(old), attribute_effect(new)
    return changes.withColumns({f"d_{c}": b[c] - a[c] for c in EFFECT_COLUMNS})


def copied(tables: DataFrame, source: str, target: str) -> DataFrame:
    """All rows, and those of scenario `source` once more as `target`."""
    return tables.unionByName(tables.where(F.col("scenario_id") == source).withColumn("scenario_id", F.lit(target)))


def removed(tables: DataFrame, name: str) -> DataFrame:
    """All rows but those of scenario `name`."""
    return tables.where(~F.col("scenario_id").eqNullSafe(name))


def free_name(wanted: str, taken: list[str]) -> str:
    n, name = 1, wanted
    while name in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def with_polygons(nodes: DataFrame, polygons: DataFrame, per_place: float, cell: float, out: str = "parking", held: DataFrame | None = None) -> DataFrame:
    """Nodes after drawing polygons (id, ring) in the order of id.

    The nodes in a polygon get equal shares of its area / per_place on top of `out`. Where it holds none, the node nearest
    to its first corner takes all of it, in place of what it had. `held` names the nodes in their stead (polygons.holders).
    """
    h = (spatial.holders(polygons, nodes, cell) if held is None else held).withColumn("_p", F.col("area") / per_place / F.col("n"))
    anew = h.where("NOT inside").groupBy("node_id").agg(F.max(F.struct("poly", "_p")).alias("_m"))
    later = h.join(anew, "node_id", "left").where("inside AND (_m IS NULL OR poly > _m.poly)").groupBy("node_id").agg(F.sum("_p").alias("_more"))
    some = nodes.join(anew, "node_id", "left").join(later, "node_id", "left")
    return some.withColumn(out, F.coalesce("_m._p", out, F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).drop("_m", "_more")


def without_polygons(nodes: DataFrame, polygons: DataFrame, cell: float, per_place: float = 30.0, out: str = "parking", as_written: bool = True) -> DataFrame:
    """Nodes after removing polygons. As written, every node in a polygon loses its whole area / per_place; else its share."""
    places = F.col("area") / per_place / (F.lit(1) if as_written else F.col("n"))
    less = spatial.holders(polygons, nodes, cell).groupBy("node_id").agg(F.sum(places).alias("_less"))
    return nodes.join(less, "node_id", "left").withColumn(out, F.coalesce(out, F.lit(0.0)) - F.coalesce("_less", F.lit(0.0))).drop("_less")


def admitted(drawn: DataFrame, same: DataFrame, other: DataFrame) -> DataFrame:
    """(id, ring, group) after drawing polygons (id, ring): what meets one of the other kind is refused; of the rest and those
    of the same kind that are there already, those that hang together form a group, named by its smallest id."""
    refused = rings.meeting(drawn, other.select(F.col("id").alias("_other"), "ring"), "id", "_other").select("id").distinct()
    whole = cut(drawn.select("id", "ring").join(refused, "id", "left_anti").unionByName(same.select("id", "ring")))
    return whole.join(rings.groups(whole), "id")


def surveyed(lines: DataFrame, grid: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, layers: dict[str, str], key: str = "edge_id") -> DataFrame:
    """Drawn lines (key, coords) with the mean of each layer along them as layers[layer], 0 outside, and the first area they touch."""
    mean = raster.line_mean(lines, grid.where(F.col("layer").isin(list(layers))), x0, y0, res, key)
    wide = mean.groupBy(key).pivot("layer", list(layers)).agg(F.first("value"))
    out = lines.join(wide, key, "left").join(aoi.aoi_of_lines(lines, cells, x0, y0, res, key), key, "left")
    return out.withColumns({c: F.coalesce(layer, F.lit(0.0)) for layer, c in layers.items()}).drop(*[layer for layer, c in layers.items() if layer != c])


def edited(nodes: DataFrame, edges: DataFrame, edits: DataFrame, deltas: dict[str, str] | None = None, geodesic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a log of edits (seq, op, id, and what the op needs), applied in the order of seq.

    delete_node takes its edges along, delete_edge takes one; add_node brings x, y; add_edge brings from, to and gets the
    distance of its ends as its length; change_edge adds `delta` to the duln of the edge and of both its ends. What is
    deleted and added again is new: edges of the old node and earlier changes do not come back. `deltas` names other
    attractiveness columns and the edits' columns that change them. What is added starts with the edits' value of such
    a column (a path's mean of the raster, from `surveyed`), 0 where they have none. With `geodesic`, x and y are degrees of
    longitude and latitude, and lengths are metres on the sphere.
    """
    deltas = deltas or {"duln": "delta"}
    first = [c for c in (*deltas, "aoi") if c in edits.columns]
    start = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in first else F.lit(0.0) for c in deltas}
    of = lambda op: edits.where(F.col("op") == op)

    def latest(kind: str, name: str, *columns: str) -> tuple[DataFrame, DataFrame]:
        """Ids once deleted (with the last time), and what was added and not deleted after."""
        some = edits.where(F.col("op").isin(f"add_{kind}", f"delete_{kind}")).groupBy(F.col("id").alias(name))
        last = some.agg(F.max(F.when(F.col("op") == f"delete_{kind}", F.col("seq"))).alias("_gone"), F.max(F.struct("seq", "op", *columns)).alias("_last"))
        return last.where("_gone IS NOT NULL").select(name, "_gone"), last.where(F.col("_last.op") == f"add_{kind}").select(name, F.col("_last.seq").alias("_since"), *[f"_last.{c}" for c in columns])

    gone, added = latest("node", "node_id", "x", "y", *first)
    nodes = nodes.join(gone, "node_id", "left_anti").unionByName(added.withColumns(start), allowMissingColumns=True)
    at = nodes.select("node_id", "x", "y")
    out, new = latest("edge", "edge_id", "from", "to", *first)
    new = new.join(at.withColumnsRenamed({"node_id": "from", "x": "_ax", "y": "_ay"}), "from").join(at.withColumnsRenamed({"node_id": "to", "x": "_bx", "y": "_by"}), "to")
    dx, dy = F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")
    length = X.haversine(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")) if geodesic else F.sqrt(dx * dx + dy * dy)
    new = new.select("edge_id", "from", "to", length.alias("shape_leng"), *[v.alias(c) for c, v in start.items()], *[c for c in first if c == "aoi"], "_since")
    edges = edges.join(out, "edge_id", "left_anti").unionByName(new, allowMissingColumns=True)
    for end in ("from", "to"):  # an edge goes with its node, unless it was added after that
        cut_off = (F.col("_node") == F.col(end)) & (F.coalesce("_since", F.lit(-1)) < F.col("_gone"))
        edges = edges.join(gone.withColumnRenamed("node_id", "_node"), cut_off, "left_anti")
    moved = list(deltas.values())
    change = of("change_edge").select(F.col("id").alias("edge_id"), F.col("seq").alias("_seq"), *[F.col(v).alias(f"_{v}") for v in moved])
    change = change.join(edges.select("edge_id", "from", "to", "_since"), "edge_id").where(F.col("_seq") > F.coalesce("_since", F.lit(-1)))
    total = [F.sum(f"_{v}").alias(f"_sum_{v}") for v in moved]
    per_edge = change.groupBy("edge_id").agg(*total)
    ends = change.select(F.explode(F.array("from", "to")).alias("node_id"), "_seq", *[f"_{v}" for v in moved]).join(nodes.select("node_id", F.col("_since").alias("_from")), "node_id")
    per_node = ends.where(F.col("_seq") > F.coalesce("_from", F.lit(-1))).groupBy("node_id").agg(*total)
    add = lambda df: df.withColumns({c: F.col(c) + F.coalesce(f"_sum_{v}", F.lit(0.0)) for c, v in deltas.items()}).drop("_since", *[f"_sum_{v}" for v in moved])
    return add(nodes.join(per_node, "node_id", "left")), add(edges.join(per_edge, "edge_id", "left"))

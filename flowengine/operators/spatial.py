"""Points, rings and distances as Column expressions; spatial joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether (x, y) lies in a ring, an array of (x, y) whose last point may repeat the first."""
    n = F.size(ring)
    crossings = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _crosses(x, y, F.get(ring, i - 1), F.get(ring, F.pmod(i, n))))
    return (n >= 3) & (crossings % 2 == 1)


def _crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    straddles = (a["y"] > y) != (b["y"] > y)
    at = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
    return F.when(straddles & (x < at), 1).otherwise(0)


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    n = F.size(ring)
    twice = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.get(ring, i - 1)["x"] * F.get(ring, F.pmod(i, n))["y"] - F.get(ring, F.pmod(i, n))["x"] * F.get(ring, i - 1)["y"])
    return F.abs(twice) / 2


def _gridded(points: DataFrame, polygons: DataFrame, cell: float, label: str) -> tuple[DataFrame, DataFrame]:
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    at = lambda v: F.floor(v / cell)
    cells = polygons.select(F.col(label).alias("_label"), "ring", F.explode(F.sequence(at(low("x")), at(high("x")))).alias("_cx")).select("_label", "ring", "_cx", F.explode(F.sequence(at(low("y")), at(high("y")))).alias("_cy"))
    return cells, points.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))})


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, label: str = "aoi", none: str | None = "0") -> DataFrame:
    """Points with the smallest label of the rings that hold them, `none` outside of all.

    Rings are spread over the grid cells of their bounds and points hashed to theirs: an equi-join, then the exact test.
    """
    cells, keyed = _gridded(points, polygons, cell, label)
    hit = keyed.join(cells, ["_cx", "_cy"], "left").withColumn("_label", F.when(in_ring(F.col("x"), F.col("y"), F.col("ring")), F.col("_label")))
    out = hit.groupBy(*points.columns).agg(F.min("_label").alias(label))
    return out if none is None else out.withColumn(label, F.coalesce(label, F.lit(none)))


def points_in_polygons_all(points: DataFrame, polygons: DataFrame, cell: float, label: str) -> DataFrame:
    """(points, label): one row for each ring that holds a point."""
    cells, keyed = _gridded(points, polygons, cell, label)
    return keyed.join(cells, ["_cx", "_cy"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select(*points.columns, F.col("_label").alias(label))


#: Targets up to this many are broadcast whole; more are searched through grid cells.
BROADCAST_TARGETS = 500


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, distance): the nearest target of each point, the smallest id of equal ones."""
    t = targets.select(F.col(target), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    dx, dy = F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty")
    best = lambda pairs: pairs.groupBy(key).agg(F.min(F.struct((dx * dx + dy * dy).alias("_d"), target)).alias("m")).select(key, F.col(f"m.{target}").alias(target), F.sqrt("m._d").alias("distance"))
    n, low_x, high_x, low_y, high_y = targets.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n <= BROADCAST_TARGETS:
        return best(points.select(key, "x", "y").join(F.broadcast(t), how="cross"))
    # each round looks in the nine cells around a point; what it finds within a cell's width is final, the rest looks wider
    cell, todo, out = max((high_x - low_x) * (high_y - low_y), 1e-9) ** 0.5 / n**0.5, cut(points.select(key, "x", "y")), None
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    while not todo.isEmpty():
        at = lambda v: F.floor(v / cell)  # noqa: B023, E731
        spread = t.withColumn("_i", around).withColumn("_j", around).withColumns({"_cx": at(F.col("_tx")) + F.col("_i"), "_cy": at(F.col("_ty")) + F.col("_j")})
        found = cut(best(todo.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))}).join(spread, ["_cx", "_cy"])).where(F.col("distance") <= cell))
        out = found if out is None else out.unionByName(found)
        todo, cell = cut(todo.join(found.select(key), key, "left_anti")), cell * 4
    return out if out is not None else best(points.select(key, "x", "y").join(t, how="cross"))


def within_distance(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Points with a target at most `radius` away: targets go to the nine cells around their own, then the exact test."""
    at = lambda v: F.floor(v / radius)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    t = targets.select(F.col("x").alias("_tx"), F.col("y").alias("_ty"), F.explode(around).alias("_i")).select("_tx", "_ty", (at(F.col("_tx")) + F.col("_i")).alias("_cx"), F.explode(around).alias("_j"))
    t = t.select("_tx", "_ty", "_cx", (at(F.col("_ty")) + F.col("_j")).alias("_cy"))
    dx, dy = F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty")
    keyed = points.withColumns({"_px": at(F.col("x")), "_py": at(F.col("y"))})
    return keyed.join(t, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & (dx * dx + dy * dy <= radius * radius), "left_semi").drop("_px", "_py")


def holders(polygons: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """(poly, node_id, area, n, inside): the n nodes in each polygon, or the node nearest to its first corner (inside is false)."""
    named = polygons.select(F.col("id").alias("poly"), "ring", ring_area(F.col("ring")).alias("area"))
    held = points_in_polygons_all(nodes.select("node_id", "x", "y"), named, cell, "poly").select("node_id", "poly")
    within = held.join(held.groupBy("poly").agg(F.count("*").alias("n")), "poly").join(named, "poly").select("poly", "node_id", "area", "n", F.lit(True).alias("inside"))
    empty = named.join(held.select("poly").distinct(), "poly", "left_anti")
    corner = empty.select("poly", F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(0))["y"].alias("y"))
    alone = nearest(corner, nodes, "poly", "node_id").join(named, "poly").select("poly", "node_id", "area", F.lit(1).cast("long").alias("n"), F.lit(False).alias("inside"))
    return within.unionByName(alone)


def capacities(polygons: DataFrame, nodes: DataFrame, per_place: float, cell: float, out: str = "parking") -> DataFrame:
    """Nodes with `out`: each polygon's area / per_place shared by the nodes in it, or whole on the node nearest to its first corner."""
    total = holders(polygons, nodes, cell).groupBy("node_id").agg(F.sum(F.col("area") / per_place / F.col("n")).alias(out))
    return nodes.drop(out).join(total, "node_id", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))

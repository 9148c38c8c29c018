"""Areas of interest as sets of raster cells: derivation, edits, and their meeting with lines, polygons and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, raster, spatial
from flowengine.functions.expressions import aoi_label


def can_derive(grid: DataFrame, threshold: float) -> bool:
    """Whether any cell reaches the threshold; else the derivation is skipped."""
    top = grid.agg(F.max("value")).first()[0]
    return top is not None and threshold <= top


def derived(grid: DataFrame, threshold: float, width: int, cell_area: float, least_area: float = 100_000.0) -> tuple[DataFrame, DataFrame]:
    """(areas, cells): patches of cells at or above the threshold, large ones labelled A, B, .. in the order of their first cell."""
    cells = graph.cut(raster.cell_components(raster.thresholded(grid, threshold).select("row", "col"), width))
    areas = raster.aois(cells, grid, cell_area, least_area)
    areas = graph.dense_ids(areas, ["component"], "id").withColumn("aoi", aoi_label(F.col("id")))
    return areas, cells.join(areas.select("component", "aoi"), "component").select("aoi", "row", "col")


def cells_in(grid: DataFrame, polygons: DataFrame, cell: float, label: str = "aoi") -> DataFrame:
    """Cells (row, col, value) whose centre (x, y) lies in a polygon, with its label."""
    return spatial.points_in_polygons(grid, polygons, cell, label, None).where(F.col(label).isNotNull())


def merged(areas: DataFrame, drawn: DataFrame, label: str) -> DataFrame:
    """Cells (aoi, row, col) after drawing a set of cells: it unites with every area it meets under `label`; swallowed areas vanish."""
    met = areas.join(drawn, ["row", "col"], "left_semi").select("aoi").distinct()
    rest = areas.join(met, "aoi", "left_anti")
    union = areas.join(met, "aoi", "left_semi").select("row", "col").unionByName(drawn.select("row", "col")).distinct()
    return rest.select("aoi", "row", "col").unionByName(union.select(F.lit(label).alias("aoi"), "row", "col"))


def erased(areas: DataFrame, drawn: DataFrame) -> DataFrame:
    """Cells left of the areas after erasing a set of cells."""
    return areas.join(drawn.select("row", "col").distinct(), ["row", "col"], "left_anti").select("aoi", "row", "col")


def removed(areas: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of the areas whose label is not among labels.aoi."""
    return areas.join(labels.select("aoi").distinct(), "aoi", "left_anti").select("aoi", "row", "col")


def cut_apart(areas: DataFrame, line: DataFrame, width: int) -> DataFrame:
    """Cells of the areas without those of a cutting line, each with the part of its area it is in now."""
    left = erased(areas, line)
    number = (F.col("row") * width + F.col("col")).cast("long")
    nodes = left.select(number.alias("node_id"), "aoi", "row", "col")
    right = nodes.select(F.col("node_id").alias("from"), "aoi", "row", (F.col("col") + 1).alias("col"))
    below = nodes.select(F.col("node_id").alias("from"), "aoi", (F.col("row") + 1).alias("row"), "col")
    edges = right.unionByName(below).join(nodes.withColumnRenamed("node_id", "to"), ["aoi", "row", "col"]).select("from", "to")
    return nodes.join(graph.components(nodes.select("node_id"), edges), "node_id").select("aoi", "component", "row", "col")


def overlapping(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs (left, right) of two layers of cells that share a cell."""
    return a.select(left, "row", "col").join(b.select(right, "row", "col"), ["row", "col"]).select(left, right).distinct()


def aoi_of_lines(lines: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, key: str = "edge_id") -> DataFrame:
    """(key, aoi): the smallest label of the cells that a line touches."""
    return raster.line_cells(lines, x0, y0, res, key).join(cells, ["row", "col"]).groupBy(key).agg(F.min("aoi").alias("aoi"))


def labelled_nodes(nodes: DataFrame, cells: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Nodes with the smallest label of their cell, 0 outside of all areas."""
    row, col = raster.cell_of(F.col("x"), F.col("y"), x0, y0, res)
    one = cells.groupBy("row", "col").agg(F.min("aoi").alias("aoi"))
    out = nodes.drop("aoi").withColumns({"row": row, "col": col}).join(one, ["row", "col"], "left").drop("row", "col")
    return out.withColumn("aoi", F.coalesce("aoi", F.lit("0")))


def parking_near(parking: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, radius: float = 100.0) -> DataFrame:
    """Parking polygons with a corner at most `radius` from the centre of an area's cell."""
    corners = parking.select("id", F.explode("ring").alias("p")).select("id", "p.x", "p.y")
    centres = cells.select((F.lit(x0) + (F.col("col") + 0.5) * res).alias("x"), (F.lit(y0) - (F.col("row") + 0.5) * res).alias("y"))
    return parking.join(spatial.within_distance(corners, centres, radius).select("id").distinct(), "id", "left_semi")

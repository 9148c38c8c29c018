"""Rasters as long tables (layer, row, col, value): samples, thresholds, zones, layer sums, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut
from .polygons import cells_along
from .spatial import in_ring


def cell_of(x, y, x0: float, y0: float, res: float):
    """(row, col) of the cell that holds a point; y falls with the row."""
    return F.floor((F.lit(y0) - y) / res).cast("int"), F.floor((x - F.lit(x0)) / res).cast("int")


def sampled(points: DataFrame, raster: DataFrame, x0: float, y0: float, res: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the value of their cell in every layer; null outside."""
    row, col = cell_of(F.col(x), F.col(y), x0, y0, res)
    return points.withColumns({"row": row, "col": col}).join(raster, ["row", "col"], "left").drop("row", "col")


def line_cells(lines: DataFrame, x0: float, y0: float, res: float, key: str = "edge_id") -> DataFrame:
    """(key, row, col): the cells that each line crosses, each once, however short its way through a cell.

    Lines are dealt by their key before they become cells, so lines are shuffled and their cells are not.
    """
    at = lambda p: ((p["x"] - x0) / res, (F.lit(y0) - p["y"]) / res)
    pairs = lines.where(F.size("coords") > 1).select(key, "coords").repartition(key).select(key, F.explode(F.arrays_zip(F.slice("coords", F.lit(1), F.size("coords") - 1).alias("a"), F.slice("coords", F.lit(2), F.size("coords") - 1).alias("b"))).alias("s"))
    cells = pairs.select(key, F.explode(cells_along(*at(F.col("s.a")), *at(F.col("s.b")), 1.0)).alias("c"))
    return cells.select(key, F.col("c.cy").cast("int").alias("row"), F.col("c.cx").cast("int").alias("col")).distinct()


def line_mean(lines: DataFrame, raster: DataFrame, x0: float, y0: float, res: float, key: str = "edge_id") -> DataFrame:
    """(key, layer, value): mean of the cells that each line crosses."""
    return line_cells(lines, x0, y0, res, key).join(raster, ["row", "col"]).groupBy(key, "layer").agg(F.avg("value").alias("value"))


def masked(grid: DataFrame, presence: DataFrame, cell: float) -> DataFrame:
    """The cells (layer, x, y, ..) whose centre lies in a ring (layer, ring) of their layer; layers without such a ring drop out.

    Rings go to the squares of `cell` that their bounds cover, cells to their own: an equi-join by layer and square.
    """
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    at = lambda v: F.floor(v / cell)
    rings = presence.select("layer", "ring", F.explode(F.sequence(at(low("x")), at(high("x")))).alias("_cx")).select("layer", "ring", "_cx", F.explode(F.sequence(at(low("y")), at(high("y")))).alias("_cy"))
    keyed = grid.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))}).alias("g")
    same = (F.col("g.layer") == F.col("p.layer")) & (F.col("g._cx") == F.col("p._cx")) & (F.col("g._cy") == F.col("p._cy"))
    return keyed.join(rings.alias("p"), same & in_ring(F.col("g.x"), F.col("g.y"), F.col("p.ring")), "left_semi").drop("_cx", "_cy")


def thresholded(raster: DataFrame, t: float) -> DataFrame:
    return raster.where(F.col("value") >= t)


def cell_components(cells: DataFrame, width: int) -> DataFrame:
    """Cells (row, col) with the smallest cell number of their 4-connected patch; cell number = row * width + col."""
    number = (F.col("row") * width + F.col("col")).cast("long")
    nodes = cells.select(number.alias("node_id"), "row", "col")
    right = nodes.select(F.col("node_id").alias("from"), F.col("row"), (F.col("col") + 1).alias("col"))
    below = nodes.select(F.col("node_id").alias("from"), (F.col("row") + 1).alias("row"), F.col("col"))
    edges = right.unionByName(below).join(nodes.withColumnRenamed("node_id", "to"), ["row", "col"]).select("from", "to")
    return cells.withColumn("node_id", number).join(components(nodes.select("node_id"), edges), "node_id").drop("node_id")


def top_quartile_blend(rows: DataFrame, group: str, value: str, count_nulls: bool = False) -> DataFrame:
    """(group, blend): mean of the median of all and the median of the top max(1, n / 4); nulls sort last and count in n only on demand.

    Equal values are counted first. Different ones lie in ranges of (group, value), whose sums give every value its places
    in the group, so no group is sorted in one task; the medians are the values at up to four places.
    """
    some = rows if count_nulls else rows.where(F.col(value).isNotNull())
    counts = some.groupBy(group, value).agg(F.count("*").alias("_n"))
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = cut(counts.repartitionByRange(n, group, value).withColumn("_part", F.spark_partition_id()))
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    sizes = parts.groupBy(group, "_part").agg(F.sum(known).alias("_m"))  # at most one row a group and partition
    before = sizes.withColumn("_before", F.sum("_m").over(Window.partitionBy(group).orderBy("_part")) - F.col("_m")).drop("_m")
    inner = F.sum("_n").over(Window.partitionBy(group, "_part").orderBy(value)) - F.col("_n")
    placed = parts.where(F.col(value).isNotNull()).withColumn("_in", inner).join(before, [group, "_part"]).withColumn("_low", F.col("_in") + F.col("_before"))
    stats = parts.groupBy(group).agg(F.sum("_n").alias("_all"), F.sum(known).alias("_m"))
    stats = stats.withColumn("_k", F.least(F.greatest(F.lit(1), F.floor(F.col("_all") / 4)), F.col("_m")))
    first = F.col("_m") - F.col("_k")
    places = {"_a": F.floor((F.col("_m") - 1) / 2), "_b": F.floor(F.col("_m") / 2), "_c": first + F.floor((F.col("_k") - 1) / 2), "_d": first + F.floor(F.col("_k") / 2)}
    at = lambda c: F.max(F.when((F.col("_low") <= F.col(c)) & (F.col(c) < F.col("_low") + F.col("_n")), F.col(value)))
    found = placed.join(stats.select(group, *[e.alias(c) for c, e in places.items()]), group).groupBy(group).agg(*[at(c).alias(c) for c in places])
    return stats.select(group).join(found, group, "left").select(group, ((F.col("_a") + F.col("_b") + F.col("_c") + F.col("_d")) / 4).alias("blend"))


def mean_above(rows: DataFrame, group: str, value: str, low: float = -20.0) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(F.when(F.col(value) > low, F.col(value))).alias("mean"))


def layer_cover(raster: DataFrame) -> DataFrame:
    """(layer, cover), widest first; layers without cover drop out."""
    return raster.groupBy("layer").agg(F.sum("value").alias("cover")).where("cover > 0").orderBy(F.desc("cover"), "layer")


def layer_range(raster: DataFrame) -> DataFrame:
    return raster.groupBy("layer").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def non_empty_layers(raster: DataFrame) -> DataFrame:
    """The raster without layers that are zero or null everywhere."""
    return raster.join(raster.groupBy("layer").agg(F.max("value").alias("_m")).where("_m > 0").select("layer"), "layer", "left_semi")


def sensitivity(presence: DataFrame, weights: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, sensitivity): weighted sum over the layers; one null layer makes the cell null."""
    x = presence.join(weights, "layer")
    return x.groupBy(cell).agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("value") * F.col("weight"))).alias("sensitivity"))


def spread_mass(nodes: DataFrame, cells: list[str], mass: str, out: str) -> DataFrame:
    """Nodes with the mass of their cell shared among the cell's nodes."""
    return nodes.withColumn(out, F.col(mass) / F.count("*").over(Window.partitionBy(*cells)))


def aois(patches: DataFrame, values: DataFrame, cell_area: float, least_area: float = 100_000.0) -> DataFrame:
    """(component, duln, area) of patches of more than least_area: the blend of the cells' values."""
    cells = patches.join(values, ["row", "col"])
    area = cells.groupBy("component").agg((F.countDistinct("row", "col") * cell_area).alias("area")).where(F.col("area") > least_area)
    return top_quartile_blend(cells, "component", "value").withColumnRenamed("blend", "duln").join(area, "component")

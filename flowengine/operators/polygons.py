"""Rings against rings: sides hashed to the grid cells they cross, exact tests on the sides, outlines of cell sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, cut, dense_ids
from .spatial import points_in_polygons_all, ring_area

SIDE = ("ax", "ay", "bx", "by")


def cells_along(ax: Column, ay: Column, bx: Column, by: Column, cell: float) -> Column:
    """The grid cells (cx, cy) that a segment crosses, row by row: an array, exact but for cells touched at a corner only."""
    au, av, bu, bv = ax / cell, ay / cell, bx / cell, by / cell
    low, high = F.least(av, bv), F.greatest(av, bv)
    slope = (bu - au) / F.nullif(bv - av, F.lit(0.0))

    def row(r: Column) -> Column:
        u = lambda v: au + (v - av) * slope
        one, two = F.coalesce(u(F.greatest(low, r)), au), F.coalesce(u(F.least(high, r + 1)), bu)
        return F.transform(F.sequence(F.floor(F.least(one, two)), F.floor(F.greatest(one, two))), lambda c: F.struct(c.alias("cx"), r.cast("long").alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(low), F.floor(high)), row))


def sides(polygons: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, ax, ay, bx, by): the sides of every ring, whose last point may repeat the first."""
    at = F.explode(F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, F.pmod(i, F.size(ring))).alias("b"))))
    return polygons.where(F.size(ring) > 0).select(key, at.alias("s")).select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def as_sides(points: DataFrame, key: str) -> DataFrame:
    """Points (key, x, y) as sides without length."""
    return points.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


def _turn(px, py, qx, qy, rx, ry) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def sides_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments share a point, ends included."""
    (px, py, qx, qy), (rx, ry, sx, sy) = a, b
    o1, o2, o3, o4 = _turn(px, py, qx, qy, rx, ry), _turn(px, py, qx, qy, sx, sy), _turn(rx, ry, sx, sy, px, py), _turn(rx, ry, sx, sy, qx, qy)
    # on one line segments meet where their bounds do; elsewhere each must have its ends on both sides of the other, or on it
    apart = (F.greatest(px, qx) < F.least(rx, sx)) | (F.greatest(rx, sx) < F.least(px, qx)) | (F.greatest(py, qy) < F.least(ry, sy)) | (F.greatest(ry, sy) < F.least(py, qy))
    return ~apart & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def _distance2(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Squared distances of segments a and b, row by row; 0 where they share a point, as in sides_meet."""

    def to_side(x, y, px, py, qx, qy):
        dx, dy = qx - px, qy - py
        whole = dx * dx + dy * dy
        t = np.where(whole == 0, 0.0, ((x - px) * dx + (y - py) * dy) / np.where(whole == 0, 1.0, whole))
        t = np.fmin(np.maximum(t, 0.0), 1.0)
        ex, ey = x - (px + t * dx), y - (py + t * dy)
        return ex * ex + ey * ey

    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    (px, py, qx, qy), (rx, ry, sx, sy) = a, b
    apart = (np.maximum(px, qx) < np.minimum(rx, sx)) | (np.maximum(rx, sx) < np.minimum(px, qx)) | (np.maximum(py, qy) < np.minimum(ry, sy)) | (np.maximum(ry, sy) < np.minimum(py, qy))
    across = (turn(px, py, qx, qy, rx, ry) * turn(px, py, qx, qy, sx, sy) <= 0) & (turn(rx, ry, sx, sy, px, py) * turn(rx, ry, sx, sy, qx, qy) <= 0)
    ends = np.fmin(np.fmin(to_side(px, py, *b), to_side(qx, qy, *b)), np.fmin(to_side(rx, ry, *a), to_side(sx, sy, *a)))
    return np.where(~apart & across, 0.0, ends)


def _distances(pairs: DataFrame, x: list[Column], y: list[Column]) -> DataFrame:
    """(_l, _r, _d) of pairs of sides, `_d` squared. In arrays: as one Column this formula is very long."""
    key = f"_l {pairs.schema['_l'].dataType.simpleString()}, _r {pairs.schema['_r'].dataType.simpleString()}"

    def run(batches):
        for t in batches:
            c = [t.column(i).to_numpy(zero_copy_only=False) for i in range(2, 10)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(_distance2(c[:4], c[4:]))], ["_l", "_r", "_d"])

    return pairs.select("_l", "_r", *[v.cast("double") for v in x + y]).mapInArrow(run, f"{key}, _d double")


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over all tasks: what one small file holds would else become cells and pairs in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _near(a: DataFrame, b: DataFrame, left: str, right: str, cell: float) -> tuple[DataFrame, list[Column], list[Column]]:
    """Pairs of sides of a (left, ..) and b (right, ..) whose cells are neighbours at most, with the columns of both."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = lambda cells: F.array_distinct(F.flatten(F.transform(cells, lambda c: F.transform(around, lambda d: F.struct((c["cx"] + d["i"]).alias("cx"), (c["cy"] + d["j"]).alias("cy"))))))
    x = _dealt(a, left, *SIDE).select(F.col(left).alias("_l"), *SIDE, F.explode(wide(cells_along(*map(F.col, SIDE), cell))).alias("_c"))
    y = b.select(F.col(right).alias("_r"), *[F.col(c).alias(f"_{c}") for c in SIDE], F.explode(cells_along(*map(F.col, SIDE), cell)).alias("_c"))
    return x.join(y, "_c"), [F.col(c) for c in SIDE], [F.col(f"_{c}") for c in SIDE]


def _cell_width(b: DataFrame, a: DataFrame | None = None) -> float | None:
    """Width of grid cells: by b's number of sides and their bounds, and no less than an eighth of the mean side of both, so that
    a side crosses few cells; None without sides."""

    def measured(x: DataFrame) -> tuple:
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        return x.agg(F.count("*"), F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by")), F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)), F.lit(0.0))).first()

    n, x0, y0, x1, y1, length = measured(b)
    if not n:
        return None
    width = max(max(x1 - x0, y1 - y0) / n**0.5, length / n / 8)
    if a is not None:
        m, ax0, ay0, ax1, ay1, more = measured(a)
        if m:
            width = max(width, more / m / 8, max(x1, ax1) - min(x0, ax0), max(y1, ay1) - min(y0, ay0)) if width <= 0 else max(width, more / m / 8)
    return width or 1.0


def within(a: DataFrame, b: DataFrame, left: str, right: str, reach: float) -> DataFrame:
    """(left, right, distance) of sides a and b that come within `reach` of each other."""
    pairs, x, y = _near(a, b, left, right, reach)
    best = _distances(pairs, x, y).groupBy("_l", "_r").agg(F.min("_d").alias("_d")).where(F.col("_d") <= reach * reach)
    return best.select(F.col("_l").alias(left), F.col("_r").alias(right), F.sqrt("_d").alias("distance"))


def inside(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right): rings of a with their first corner in a ring of b."""
    corner = _dealt(a.select(F.col(left).alias("_l"), F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(0))["y"].alias("y")), "_l", "x", "y")
    b = _dealt(b.select(right, "ring"), right, "ring")
    width = _cell_width(cut(sides(b, right)))
    found = points_in_polygons_all(corner, b.select(F.col(right).alias("_r"), "ring"), (width or 1.0) * 2, "_r")
    return found.select(F.col("_l").alias(left), F.col("_r").alias(right))


def meeting(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right): pairs of rings that share a point: borders that cross or touch, and rings one in the other."""
    x, y = cut(sides(a, left)), cut(sides(b, right))
    width = _cell_width(y, x)
    nested = inside(a, b, left, right).unionByName(inside(b, a, right, left).select(left, right))
    if width is None:
        return nested.distinct()
    pairs, p, q = _near(x, y, left, right, width)
    return pairs.where(sides_meet(p, q)).select(F.col("_l").alias(left), F.col("_r").alias(right)).unionByName(nested).distinct()


def nearest_sides(a: DataFrame, b: DataFrame, left: str, right: str, known: DataFrame | None = None) -> DataFrame:
    """(left, right, distance): for each of a's sets of sides the nearest set of b, the smallest id of equal ones.

    Each round joins sides over neighbouring cells; what lies within a cell's width is final, the rest takes wider cells.
    `known` (left, right) are pairs at distance 0.
    """
    b, todo, out = cut(b), cut(a), None
    width = _cell_width(b, todo)
    if width is None:
        return a.select(left).limit(0).join(b.select(right).limit(0), how="cross").withColumn("distance", F.lit(0.0))
    while not todo.isEmpty():
        pairs, x, y = _near(todo, b, left, right, width)
        rows = _distances(pairs, x, y).where(F.col("_d") <= width * width).select(F.col("_l").alias(left), "_d", F.col("_r").alias(right))
        if known is not None:
            rows, known = rows.unionByName(known.select(left, F.lit(0.0).alias("_d"), right)), None
        found = cut(rows.groupBy(left).agg(F.min(F.struct("_d", right)).alias("m")).select(left, F.col(f"m.{right}").alias(right), F.sqrt("m._d").alias("distance")))
        out = found if out is None else out.unionByName(found)
        todo, width = cut(todo.join(found.select(left), left, "left_anti")), width * 4
    return out if out is not None else nearest_sides(a.limit(0), b.limit(0), left, right)


def nearest(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, distance): the polygon of b nearest to each of a, border to border; 0 where they share a point.

    Rows of one id are rings of one polygon: a corner in an even number of them lies in a hole.
    """
    nested = inside(a, b, left, right).groupBy(left, right).count().where("count % 2 = 1").select(left, right).unionByName(inside(b, a, right, left).select(left, right))
    return nearest_sides(sides(a, left), sides(b, right), left, right, nested)


def holders(polygons: DataFrame, nodes: DataFrame, cell: float, reach: float) -> DataFrame:
    """(poly, node_id, area, n, inside) as spatial.holders, but a polygon without nodes goes to the node nearest to its border
    among those within `reach` of any polygon; if there is none, it has no holder."""
    named = polygons.select(F.col("id").alias("poly"), "ring", ring_area(F.col("ring")).alias("area"))
    held = cut(points_in_polygons_all(nodes.select("node_id", "x", "y"), named, cell, "poly").select("node_id", "poly"))
    full = held.join(held.groupBy("poly").agg(F.count("*").alias("n")), "poly").join(named, "poly").select("poly", "node_id", "area", "n", F.lit(True).alias("inside"))
    close = within(as_sides(nodes, "node_id"), sides(named, "poly"), "node_id", "poly", reach).select("node_id").unionByName(held.select("node_id")).distinct()
    empty = cut(named.join(held.select("poly").distinct(), "poly", "left_anti"))
    one = nearest_sides(sides(empty, "poly"), as_sides(nodes.join(close, "node_id", "left_semi"), "node_id"), "poly", "node_id")
    alone = one.join(empty, "poly").select("poly", "node_id", "area", F.lit(1).cast("long").alias("n"), F.lit(False).alias("inside"))
    return full.unionByName(alone)


def groups(polygons: DataFrame, key: str = "id") -> DataFrame:
    """(key, group): the smallest id of the polygons that hang together, each meeting another; ids are whole numbers."""
    pairs = meeting(polygons.select(F.col(key).alias("from"), "ring"), polygons.select(F.col(key).alias("to"), "ring"), "from", "to").where("`from` < `to`")
    return components(polygons.select(F.col(key).cast("long").alias("node_id")), pairs).select(F.col("node_id").alias(key), F.col("component").alias("group"))


def cell_sides(cells: DataFrame, label: str = "aoi") -> DataFrame:
    """(label, r, c, way, r2, c2): sides of cells that border on no cell of the label, as steps around their cell with it on the right.

    Corners are counted in rows and columns; ways 0, 1, 2, 3 go right, down, left, up.
    """
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    steps = [(0, r, c, -1, 0), (1, r, c + 1, 0, 1), (2, r + 1, c + 1, 1, 0), (3, r + 1, c, 0, -1)]
    every = cells.select(label, "row", "col").distinct()
    made = every.select(label, F.explode(F.array(*[F.struct(F.lit(w).alias("way"), a.alias("r"), b.alias("c"), (F.col("row") + i).alias("_or"), (F.col("col") + j).alias("_oc")) for w, a, b, i, j in steps])).alias("s")).select(label, "s.*")
    left = made.join(every.select(F.col(label), F.col("row").alias("_or"), F.col("col").alias("_oc")), [label, "_or", "_oc"], "left_anti")
    move = lambda down, right: (F.when(F.col("way") == down, 1).when(F.col("way") == (down + 2) % 4, -1).otherwise(0), F.when(F.col("way") == right, 1).when(F.col("way") == (right + 2) % 4, -1).otherwise(0))
    dr, dc = move(1, 0)
    return left.select(label, "r", "c", "way", (F.col("r") + dr).alias("r2"), (F.col("c") + dc).alias("c2"))


def outlines(cells: DataFrame, x0: float, y0: float, res: float, label: str = "aoi") -> DataFrame:
    """(label, ring_id, hole, ring, area): borders of the labels' sets of cells, corners only; holes have a negative area.

    Sides that two cells of a label share cancel; each of the rest goes on in the next one at its end, where two
    patches touch at a corner in the one that keeps to its own cell. Rings are the circles of these links: their sides
    hang together by `components` and are put in order by pointer doubling, so a ring may be of any length.
    """
    all_sides = cut(dense_ids(cell_sides(cells, label), [label, "r", "c", "way"], "id"))
    # at a corner the next side turns right if it can, which keeps patches that touch at a corner apart; else straight on, else left
    start = all_sides.select(label, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("id").alias("next"), F.col("way").alias("_way"))
    turn = F.pmod(F.col("_way") - F.col("way") + 1, F.lit(4))
    rank = F.when(turn == 2, 0).when(turn == 1, 1).otherwise(2)
    links = cut(all_sides.join(start, [label, "r2", "c2"]).groupBy("id").agg(F.min_by("next", rank).alias("next"), F.min_by("way", "id").alias("way"), F.min_by("_way", rank).alias("way2"), *[F.min_by(x, "id").alias(x) for x in (label, "r", "c", "r2", "c2")]))
    rings = components(links.select(F.col("id").alias("node_id")), links.select(F.col("id").alias("from"), F.col("next").alias("to"))).select(F.col("node_id").alias("id"), F.col("component").alias("ring_id"))
    sided = cut(links.join(rings, "id"))
    # steps to the ring's last side, whose next is the first: links double until all end there
    ahead = cut(sided.select("id", F.when(F.col("next") != F.col("ring_id"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("ring_id"), 1).otherwise(0).cast("long").alias("left")))
    while not ahead.where("to IS NOT NULL").isEmpty():
        on = ahead.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        ahead = cut(ahead.join(on, "to", "left").select("id", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    corner = F.struct((F.lit(x0) + F.col("c2") * res).alias("x"), (F.lit(y0) - F.col("r2") * res).alias("y"))
    bends = F.collect_list(F.when(F.col("way") != F.col("way2"), F.struct((-F.col("left")).alias("o"), corner.alias("p"))))
    area = F.sum(F.col("c") * F.col("r2") - F.col("c2") * F.col("r")) / 2 * (res * res)
    out = sided.join(ahead.select("id", "left"), "id").groupBy(label, "ring_id").agg(F.transform(F.sort_array(bends), lambda p: p["p"]).alias("ring"), area.alias("area"))
    return out.select(label, "ring_id", (F.col("area") < 0).alias("hole"), "ring", "area")

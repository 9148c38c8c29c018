"""Reading and writing the engine's tables: lines, rasters, species, perimeters, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowengine.functions.expressions import SPEED
from flowengine.operators.polygons import outlines

LINES = T.StructType([
    T.StructField("line_id", T.LongType()), T.StructField("coords", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    *[T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax", "shape_leng")], *[T.StructField(c, T.StringType()) for c in ("walk_bike", "road_width", "hard_natur")],
])
#: A path's own attractiveness for each kind of visitor, null where the file has none.
OWN = [T.StructField(c, T.DoubleType()) for c in SPEED]


def lines(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, buffer: float = 1000.0, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """Path lines whose bounds meet the buffered box: plain comparisons, so the scan skips row groups by their statistics.

    With a perimeter (corners of a ring) only lines that meet it remain.
    """
    df = spark.read.schema(T.StructType([*LINES.fields, *OWN])).parquet(path)
    if bbox:
        x0, y0, x1, y1 = bbox[0] - buffer, bbox[1] - buffer, bbox[2] + buffer, bbox[3] + buffer
        df = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    if ring:
        df = df.where(meets(F.col("coords"), F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])))
    # text attributes become numbers where they are numbers, else null
    number = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    return df.withColumns({"walk_bike": number("walk_bike", "int") + 1, "road_width": number("road_width", "double"), "hard_natur": number("hard_natur", "int")})


def large_lakes(lakes: DataFrame, least: float = 10_000.0) -> DataFrame:
    return lakes.where(F.col("shape_area") > least)


def raster(spark: SparkSession, path: str, layers: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A raster table partitioned by layer; layers and bounds are pushed to the scan."""
    df = spark.read.parquet(path)
    if layers:
        df = df.where(F.col("layer").isin(layers))
    return df if bbox is None else df.where(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))


def species_table(spark: SparkSession, path: str, decimals: list[str] = ()) -> DataFrame:
    """Semicolon text with decimal commas; dots in names become underscores."""
    df = spark.read.csv(path, sep=";", header=True)
    df = df.toDF(*[c.replace(".", "_") for c in df.columns])
    return df.withColumns({c: F.regexp_replace(c, ",", ".").try_cast("double") for c in decimals}) if decimals else df


def presence(spark: SparkSession, path: str, species: list[str] | None = None) -> DataFrame:
    """Presence table with the partition column species; a list of species prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("species").isin(species)) if species else df


def uploadable(names: list[str]) -> str:
    """'shp' for a set with .shp, .shx and .dbf, 'kml' for one .kml file; anything else is refused."""
    kinds = {n.rsplit(".", 1)[-1].lower() for n in names if "." in n}
    if {"shp", "shx", "dbf"} <= kinds:
        return "shp"
    if kinds == {"kml"} and len(names) == 1:
        return "kml"
    raise ValueError("a perimeter needs .shp, .shx and .dbf, or one .kml")


def flat_wkt(text: F.Column) -> F.Column:
    """WKT with x and y only: the Z and M ordinates, and their marks, are dropped."""
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    plain = F.regexp_replace(text, r"(?i)\b(ZM|Z|M)\s*(?=\(|EMPTY)", "")
    return F.regexp_replace(plain, rf"({number}\s+{number})(?:\s+{number})+", "$1")


def ring_from_wkt(text: F.Column) -> F.Column:
    """Outer ring of POLYGON ((x y, ...)) as an array of (x, y); null for other text."""
    body = F.nullif(F.regexp_extract(text, r"(?i)POLYGON\s*\(\(([^()]*)\)", 1), F.lit(""))
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).cast("double").alias("y")))


def ring_from_geojson(text: F.Column) -> F.Column:
    """Outer ring of a GeoJSON polygon."""
    rings = F.from_json(text, "type string, coordinates array<array<array<double>>>")["coordinates"]
    return F.transform(F.get(rings, F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def geojson(ring: F.Column) -> F.Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def valid_perimeter(ring: F.Column) -> F.Column:
    """At least three corners, and no two sides that are not neighbours cross."""
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    n = F.size(open_)
    side = lambda i: (F.get(open_, i), F.get(open_, F.pmod(i + 1, n)))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(i, j):
        (a, b), (c, d) = side(i), side(j)
        return (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b))

    clash = F.exists(F.sequence(F.lit(0), n - 3), lambda i: F.exists(F.sequence(i + 2, n - 1), lambda j: (F.pmod(j + 1, n) != i) & cross(i, j)))
    return F.when(ring.isNull() | (n < 3), False).when(n == 3, True).otherwise(~clash)


def within_ring(p: F.Column, ring: F.Column) -> F.Column:
    """Whether a point lies inside a closed or open ring, by the number of sides that a ray to the right meets."""
    n = F.size(ring)

    def met(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        apart = (a["y"] > p["y"]) != (b["y"] > p["y"])
        return apart & (p["x"] < a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / F.when(apart, b["y"] - a["y"]).otherwise(1.0))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), met)) % 2 == 1


def in_country(ring: F.Column, border: F.Column) -> F.Column:
    """Whether a perimeter lies in a country: all its corners inside the border, and none of its sides across it."""
    sides = lambda r, i: (F.get(r, i), F.get(r, F.pmod(i + 1, F.size(r))))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(i, j):
        (a, b), (c, d) = sides(ring, i), sides(border, j)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    places = lambda r: F.sequence(F.lit(0), F.size(r) - 1)
    return F.forall(ring, lambda p: within_ring(p, border)) & ~F.exists(places(ring), lambda i: F.exists(places(border), lambda j: cross(i, j)))


def meets(coords: F.Column, ring: F.Column) -> F.Column:
    """Whether a line has a point inside a ring or crosses one of its sides."""
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(i, j):
        a, b, c, d = F.get(coords, i), F.get(coords, i + 1), F.get(ring, j), F.get(ring, F.pmod(j + 1, F.size(ring)))
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    legs = F.when(F.size(coords) > 1, F.sequence(F.lit(0), F.size(coords) - 2)).otherwise(F.array().cast("array<int>"))
    sides = F.sequence(F.lit(0), F.size(ring) - 1)
    return F.exists(coords, lambda p: within_ring(p, ring)) | F.exists(legs, lambda i: F.exists(sides, lambda j: cross(i, j)))


def save_raster(grid: DataFrame, path: str, info: str = "") -> None:
    """A raster (layer, row, col, ..) partitioned by layer, and a text on how it was made beside it."""
    grid.write.mode("overwrite").partitionBy("layer").parquet(path)
    grid.sparkSession.createDataFrame([(info,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_info")


def save_cropped(spark: SparkSession, sources: dict[str, str], source: str, path: str, layers: list[str], bbox: tuple[float, float, float, float]) -> None:
    """Layers of the chosen raster ("new" or "old", by its path) within the bounds."""
    save_raster(raster(spark, sources[source], layers, bbox), path, f"source: {source}")


def save_outlines(rings: DataFrame, path: str) -> None:
    """A perimeter or areas (label, ring) as GeoJSON text."""
    rings.select("label", geojson(F.col("ring")).alias("geojson")).write.mode("overwrite").parquet(path)


def save_areas(cells: DataFrame, path: str, x0: float, y0: float, res: float) -> None:
    """Areas of interest (aoi, row, col) as GeoJSON outlines, a row a ring; holes say so."""
    rings = outlines(cells, x0, y0, res)
    rings.select("aoi", "ring_id", "hole", "area", geojson(F.col("ring")).alias("geojson")).write.mode("overwrite").parquet(path)


def save_paths(edges: DataFrame, path: str, legacy_columns: bool = False) -> None:
    """Paths with their passage columns; the legacy list leaves joggers out."""
    skip = {"passage_jog", "passage_jog_aoi"} if legacy_columns else set()
    edges.select(*[c for c in edges.columns if c not in skip]).write.mode("overwrite").parquet(path)


def save_snapshot(tables: dict[str, DataFrame], folder: str, step: str) -> None:
    """All tables of a session as Parquet, and a manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"step": step, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")


def load_snapshot(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame]]:
    m = json.loads(spark.read.text(f"{folder}/_manifest").first()[0])
    return m["step"], {name: spark.read.parquet(f"{folder}/{name}") for name in m["tables"]}

"""Column expressions of the flow model: weights, times, choices, angles. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Speed in km/h and draw weight of each visitor type (weights sum to 1.04577 and are normalised when drawn).
SPEED = {"walkNat": 5, "walkSoc": 3, "dogNat": 3, "dogProx": 2, "ebikeNat": 20, "bikeSport": 20, "jogger": 7}
TYPE_WEIGHT = {"walkNat": 0.232, "walkSoc": 0.1667, "dogNat": 0.1535, "dogProx": 0.1124, "ebikeNat": 0.089, "bikeSport": 0.05937, "jogger": 0.2328}
FAMILY = {"walkNat": "walk", "walkSoc": "walk", "dogNat": "dog", "dogProx": "dog", "ebikeNat": "bike", "bikeSport": "bike", "jogger": "jog"}
FAMILIES = ("walk", "dog", "bike", "jog")
#: Minutes of an outing, and the weight of each per visitor type.
DURATIONS = (30, 60, 120, 180, 240)
DURATION_WEIGHT = {
    "walkNat": (7.5, 12.5, 51.25, 23.75, 5), "walkSoc": (6, 34, 58, 0, 2), "dogNat": (0, 34.28, 40, 22.857, 2.87), "dogProx": (0, 55.55, 40.7, 3.7, 0),
    "ebikeNat": (0, 36.84, 42.1, 21.05, 0), "bikeSport": (0, 18.75, 56.25, 25, 0), "jogger": (5.15, 31.818, 44.848, 13.939, 4.24),
}
#: Divisor numerator of each weighting of an edge's length.
WEIGHTING = {"distance": 8.0, "little_attr": 4.0, "mostly_attr": 2.0}
STEPS_PER_MINUTE = 3
PI_AS_WRITTEN = 3.14159265359


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def weighted_length(length: Column, duln: Column, k: Column | float, threshold: float) -> Column:
    """Length less its attractiveness share; at most the length, then at least 10. Zero attractiveness counts as minus infinity."""
    k = k if isinstance(k, Column) else F.lit(k)
    share = F.when(duln != 0, F.lit(1.0) / (k / (34.2423 + threshold) * duln))
    w = F.when(duln == 0, F.lit(10.0)).otherwise(F.greatest(F.least(length * (1.0 - share), length), F.lit(10.0)))
    return F.when(length.isNotNull() & duln.isNotNull(), w)


def weightings(edge_columns: list[str], length: str, duln: str, threshold: float):
    """Select list that turns an edge row into one row per weighting."""
    return [*edge_columns, F.explode(F.array(*[F.struct(F.lit(n).alias("weighting"), weighted_length(F.col(length), F.col(duln), k, threshold).alias("w")) for n, k in WEIGHTING.items()])).alias("x")]


def travel_minutes(metres: Column, speed_kmh: Column) -> Column:
    return F.ceil(metres / (speed_kmh * 1000.0 / 60.0))


def timesteps(amount: Column, unit: str = "h") -> Column:
    return F.ceil(amount * (STEPS_PER_MINUTE * (60 if unit == "h" else 1)))


def uniform(seed: int, *parts: Column) -> Column:
    """Reproducible draw in [0, 1) from the text of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def pick(u: Column, values: list, weights: list[float]) -> Column:
    """The value in whose share of the cumulative weights u falls."""
    total, below, out = sum(weights), 0.0, []
    for v, w in zip(values, weights):
        below += w
        out.append((v, below / total))
    return reduce(lambda rest, x: F.when(u < x[1], F.lit(x[0])).otherwise(rest), reversed(out[:-1]), F.lit(out[-1][0]))


def angle(px, py, cx, cy, nx, ny, as_written: bool = True) -> Column:
    """Turn at c on the way p, c, n, folded to 0 .. 180. As written, only the second direction is in degrees and both vectors
    point into c; otherwise 0 is straight on."""
    if as_written:
        a = F.abs(F.atan2(cy - py, cx - px) - F.atan2(cy - ny, cx - nx) * 180.0 / PI_AS_WRITTEN)
    else:
        a = F.abs(F.degrees(F.atan2(cy - py, cx - px)) - F.degrees(F.atan2(ny - cy, nx - cx)))
    return F.when(a > 180, 360.0 - a).otherwise(a)


def direction_bonus(a: Column) -> Column:
    return F.when(a <= 45, 1.0).when(a <= 90, 0.0).otherwise(-2.0)


def softmax(x: Column, over: list[str], alpha: float = 1.0) -> Column:
    """exp(x / alpha) over its sum in the group; rows of null x get null."""
    w = Window.partitionBy(*over)
    e = F.exp((x - F.max(x).over(w)) / alpha)
    return e / F.sum(e).over(w)


def route_probability(duln: Column, bonus: Column, visited: Column, agent: str) -> Column:
    """Choice among the routes of an agent: softmax at 0.5; a visited route keeps 1e-5 when there is more than one route."""
    p = softmax(F.coalesce(duln, F.lit(0.0)) + bonus, [agent], 0.5)
    return F.when(visited & (F.count(F.lit(1)).over(Window.partitionBy(agent)) > 1), 1e-5).otherwise(p)


def rescaled(x: Column, low: Column, high: Column) -> Column:
    return F.lit(9.0) * (x - low) / (high - low) + 1.0


def aoi_label(n: Column) -> Column:
    """1 -> A .. 26 -> Z, 27 -> AA .. 702 -> ZZ."""
    letter = lambda i: F.chr(i + 65)
    return F.when(n <= 26, letter(n - 1)).otherwise(F.concat(letter(F.floor((n - 27) / 26)), letter(F.pmod(n - 27, F.lit(26)))))


def grey_alpha(x: Column) -> Column:
    return F.abs(x - 255) / 255.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 4326 to 3857."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(PI / 4) + F.radians(lat) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(F.lit(2.0) * F.atan(F.exp(y / r)) - F.lit(PI / 2))


PI = 3.141592653589793

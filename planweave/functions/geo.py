"""Distances between points and two-point routes, in metres on the local ellipsoid, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METERS_PER_MILE = 1609.344


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Of latitude and of longitude."""
    return metres_per_degree_at(F.radians(lat))


def metres_per_degree_at(phi: Column) -> tuple[Column, Column]:
    return 111132.954 - 559.822 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi), 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)


def point_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    ky, kx = metres_per_degree((lat1 + lat2) / 2)
    return F.sqrt(F.pow((lat1 - lat2) * ky, 2) + F.pow((lng1 - lng2) * kx, 2))


#: Columns that ``distance_stages`` adds on the way.
STAGED = ["phi", "ky", "kx", "qx", "qy", "rx", "ry", "sx", "sy", "ux", "uy", "vx", "vy", "uu", "vv", "c1", "c2", "c3", "c4", "t1", "t2", "t3", "t4"]


def distance_stages(a: str, b: str) -> list[dict[str, Column]]:
    """Metres between shapes of columns {a}_lat1 .. {a}_lng2 and {b}_lat1 .. {b}_lng2, 0 where they cross, as ``metres``.

    Each stage uses columns of those before it. Points are two-point routes of no length. In metres from the first
    point p of ``a``: its last point q, and the points r and s of ``b``; u and v are the ways from p to q and from r to s.
    """
    c = F.col
    of = lambda s, n: c(f"{s}_{n}")
    ky, kx = metres_per_degree_at(c("phi"))
    place = {f"{n}x": (of(s, f"lng{i}") - of(a, "lng1")) * c("kx") for n, s, i in (("q", a, 2), ("r", b, 1), ("s", b, 2))}
    place |= {f"{n}y": (of(s, f"lat{i}") - of(a, "lat1")) * c("ky") for n, s, i in (("q", a, 2), ("r", b, 1), ("s", b, 2))}
    ways = {"ux": c("qx"), "uy": c("qy"), "vx": c("sx") - c("rx"), "vy": c("sy") - c("ry")}
    across = lambda x, y, k: c(f"{k}x") * y - c(f"{k}y") * x
    sizes = {"uu": c("ux") * c("ux") + c("uy") * c("uy"), "vv": c("vx") * c("vx") + c("vy") * c("vy")}
    sizes |= {"c1": across(c("rx"), c("ry"), "u"), "c2": across(c("sx"), c("sy"), "u"), "c3": across(-c("rx"), -c("ry"), "v"), "c4": across(c("qx") - c("rx"), c("qy") - c("ry"), "v")}
    share = lambda dot, size: F.when(c(size) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / c(size)))).otherwise(0.0)
    feet = {
        "t1": share(c("rx") * c("ux") + c("ry") * c("uy"), "uu"), "t2": share(c("sx") * c("ux") + c("sy") * c("uy"), "uu"),
        "t3": share(-(c("rx") * c("vx") + c("ry") * c("vy")), "vv"), "t4": share((c("qx") - c("rx")) * c("vx") + (c("qy") - c("ry")) * c("vy"), "vv"),
    }
    away = lambda x, y: x * x + y * y
    least = F.least(
        away(c("rx") - c("t1") * c("ux"), c("ry") - c("t1") * c("uy")), away(c("sx") - c("t2") * c("ux"), c("sy") - c("t2") * c("uy")),
        away(c("rx") + c("t3") * c("vx"), c("ry") + c("t3") * c("vy")), away(c("qx") - c("rx") - c("t4") * c("vx"), c("qy") - c("ry") - c("t4") * c("vy")),
    )
    metres = F.when((c("c1") * c("c2") < 0) & (c("c3") * c("c4") < 0), 0.0).otherwise(F.sqrt(least))
    phi = F.radians((of(a, "lat1") + of(a, "lat2") + of(b, "lat1") + of(b, "lat2")) / 4)
    return [{"phi": phi}, {"ky": ky, "kx": kx}, place, ways, sizes, feet, {"metres": metres}]


def with_metres(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    for stage in distance_stages(a, b):
        pairs = pairs.withColumns(stage)
    return pairs.drop(*STAGED)


def nearest_points(pairs: DataFrame, a: str = "a", b: str = "b", planar: bool = False) -> DataFrame:
    """Adds the points where two shapes are closest: a_lat, a_lng, b_lat, b_lng; where they cross, that point twice.

    ``planar``: closest in degrees, taken as lengths in a plane, not on the ground.
    """
    stages = distance_stages(a, b)[:-1]
    if planar:
        stages[0:2] = [{"phi": F.lit(0.0), "ky": F.lit(1.0), "kx": F.lit(1.0)}]
    for stage in stages:
        pairs = pairs.withColumns(stage)
    c = F.col
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    on_u = lambda t: at(t * c("ux"), t * c("uy"))
    on_v = lambda t: at(c("rx") + t * c("vx"), c("ry") + t * c("vy"))
    met = c("c3") / (c("c3") - c("c4"))  # the share of u before it crosses v
    d2 = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    ends = [(on_u(c("t1")), on_v(F.lit(0.0))), (on_u(c("t2")), on_v(F.lit(1.0))), (on_u(F.lit(0.0)), on_v(c("t3"))), (on_u(F.lit(1.0)), on_v(c("t4")))]
    least = F.least(*[F.struct(d2(p, q).alias("d"), F.lit(k).alias("k"), p.alias("p"), q.alias("q")) for k, (p, q) in enumerate(ends)])
    crossing = (c("c1") * c("c2") < 0) & (c("c3") * c("c4") < 0)
    pairs = pairs.withColumn("ends_", F.when(crossing, F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("k"), on_u(met).alias("p"), on_u(met).alias("q"))).otherwise(least))
    place = {f"{s}_{n}": c(f"{a}_{n}1") + c(f"ends_.{e}.{x}") / c(k) for s, e in (("a", "p"), ("b", "q")) for n, x, k in (("lat", "y", "ky"), ("lng", "x", "kx"))}
    return pairs.withColumns(place).drop("ends_", *STAGED)

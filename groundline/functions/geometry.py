"""Plane geometry on arrays of [x, y] vertices, and the transverse Mercator projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM grid.
SEMI_MAJOR, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
E2 = FLATTENING * (2 - FLATTENING)
SUBSAMPLES = 8
MIN_CELL_SHARE = 0.15


def pixel_x(origin: Column, width: Column, col: Column) -> Column:
    return origin + (col + 0.5) * width


def pixel_y(origin: Column, height: Column, row: Column) -> Column:
    return origin - (row + 0.5) * height


def cell_col(origin: Column, width: Column, x: Column) -> Column:
    return F.floor((x - origin) / width).cast("int")


def cell_row(origin: Column, height: Column, y: Column) -> Column:
    return F.floor((origin - y) / height).cast("int")


def edges(ring: Column) -> Column:
    """Each vertex with the one before it, the ring being closed implicitly."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p[0].alias("x"), p[1].alias("y"), F.get(ring, F.pmod(i - 1, n))[0].alias("px"), F.get(ring, F.pmod(i - 1, n))[1].alias("py")))


def crossings(ring: Column, y: Column) -> Column:
    """Where edges cross the height ``y``; an edge holds its lower end only."""
    across = F.filter(edges(ring), lambda e: (e["y"] > y) != (e["py"] > y))
    return F.transform(across, lambda e: e["x"] + F.try_divide((e["px"] - e["x"]) * (y - e["y"]), e["py"] - e["y"]))


def odd_beyond(crossed: Column, x: Column) -> Column:
    """Parity of the crossings that a ray to the right from ``x`` meets."""
    return F.size(F.filter(crossed, lambda at: x < at)) % 2 == 1


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    return odd_beyond(crossings(ring, y), x)


def in_polygon(outer: Column, x: Column, y: Column, holes: Column | None = None) -> Column:
    inside = in_ring(outer, x, y)
    if holes is None:
        return inside
    return inside & ~F.exists(F.coalesce(holes, F.array().cast("array<array<array<double>>>")), lambda h: in_ring(h, x, y))


def well_inside(outer: Column, x: Column, y: Column, buffer: Column | float) -> Column:
    """The four points at ``buffer`` along the axes are inside too; no buffer, no condition."""
    b = buffer if isinstance(buffer, Column) else F.lit(float(buffer))
    probes = in_polygon(outer, x + b, y) & in_polygon(outer, x - b, y) & in_polygon(outer, x, y + b) & in_polygon(outer, x, y - b)
    return (b <= 0) | probes


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def crossings(ring: Column, y: Column) -> Column:
    """Where the horizontal line at ``y`` meets the ring's edges, an edge holding its lower end only."""
    met = F.filter(edges(ring), lambda e: (e["y"] > y) != (e["py"] > y))
    return F.transform(met, lambda e: e["x"] + F.try_divide((e["px"] - e["x"]) * (y - e["y"]), e["py"] - e["y"]))


def cell_share(outer: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Share of a cell's 8 x 8 sample points inside the polygon, by scan line: each of the eight
    lines meets all edges once, and its points only the few places where it crosses the ring."""
    places = F.sequence(F.lit(0), F.lit(SUBSAMPLES - 1))
    lines = F.transform(places, lambda j: crossings(outer, top - (j + 0.5) / SUBSAMPLES * height))
    inside = lambda xs, i: F.size(F.filter(xs, lambda at: left + (i + 0.5) / SUBSAMPLES * width < at)) % 2 == 1
    total = F.aggregate(lines, F.lit(0), lambda n, xs: n + F.size(F.filter(places, lambda i: inside(xs, i))))
    return total / F.lit(float(SUBSAMPLES * SUBSAMPLES))


def signed_area(ring: Column) -> Column:
    total = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["px"] * e["y"] - e["x"] * e["py"]))
    return F.when(F.size(ring) >= 3, total / 2).otherwise(F.lit(0.0))


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """struct<x, y>: weighted by area, or the vertices' mean if there is no area."""
    a = signed_area(ring)
    cross = lambda e: e["px"] * e["y"] - e["x"] * e["py"]

    def along(c: str) -> Column:
        total = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e[c] + e[f"p{c}"]) * cross(e))
        mean = F.try_divide(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e[c]), F.size(ring))
        return F.coalesce(F.try_divide(total, 6 * a), mean).alias(c)

    return F.struct(along("x"), along("y"))


def inset_factor(area_share: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.01), area_share)))


def inset(ring: Column, factor: Column, digits: int = 3) -> Column:
    """The ring shrunk towards its centroid; vertices rounded half up."""
    return drawn_in(ring, centroid(ring), factor, digits)


def drawn_in(ring: Column, c: Column, factor: Column, digits: int) -> Column:
    by = float(10**digits)
    near = lambda v, m: F.floor((m + (v - m) * factor) * by + 0.5) / by
    return F.transform(ring, lambda p: F.array(near(p[0], c["x"]), near(p[1], c["y"])))


#: Square metres that a derived yard aims at, and the share of its parcel that it may take.
YARD_AREA, PARCEL_SHARE = 9000.0, 0.45


def with_recess_yard(parcels: DataFrame, parcel: str) -> DataFrame:
    """``parcels`` with yard (the parcel drawn in towards its centroid to the aimed-at area) and the
    whole square metres of both. A column a step, as each is named several times by the next."""
    whole = lambda x: F.floor(x + 0.5).cast("bigint")
    a = parcels.withColumns({"__area": ring_area(F.col(parcel)), "__c": centroid(F.col(parcel))})
    share = F.least(F.lit(PARCEL_SHARE), F.lit(YARD_AREA) / F.greatest(F.lit(1.0), F.col("__area")))
    a = a.withColumn("yard", drawn_in(F.col(parcel), F.col("__c"), inset_factor(share), 3))
    return a.withColumns({"yard_area": whole(ring_area(F.col("yard"))), "parcel_area": whole(F.col("__area"))}).drop("__area", "__c")


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def central_meridian(zone: Column) -> Column:
    return (zone - 1) * 6 - 177


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres by the series of the transverse Mercator projection."""
    phi, dl = F.radians(lat), F.radians(lon) - F.radians(central_meridian(zone).cast("double"))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    second = E2 / (1 - E2)
    nu = F.lit(SEMI_MAJOR) / F.sqrt(1 - E2 * sin * sin)
    t, c, a = tan * tan, second * cos * cos, cos * dl
    e4, e6 = E2**2, E2**3
    arc = SEMI_MAJOR * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    x = nu * a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * second) / 120))
    y = arc + nu * tan * a2 * (F.lit(0.5) + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * second) / 720))
    return SCALE * x + EAST, SCALE * y + F.when(north, 0.0).otherwise(SOUTH)

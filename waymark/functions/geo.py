"""Geography as Column expressions: tiles, boxes, distances, proximity scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METERS = 6371008.8
METERS_PER_MILE = 1609.344
MAX_LAT = 85.0511
RADIUS_MILES = {6: 1800.0, 12: 600.0, 14: 100.0}
MIN_DISTANCE, DISTANCE_SCALE = 35.0, 1000.0


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once: expressions that mention it often stay small."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding with halves towards plus infinity, as wanted for longitudes too."""
    return F.floor(x * 10**places + 0.5) / 10**places if places else F.floor(x + 0.5)


def fractional_tile(lon, lat, z) -> tuple[Column, Column]:
    """Position in tiles at a zoom, as fractions."""
    lat = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), _c(lat))))
    lon = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), _c(lon)))
    n = F.pow(F.lit(2.0), _c(z))
    return (lon + 180) / 360 * n, (1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n


def tile_of(lon, lat, z) -> Column:
    """struct(z, x, y) of the tile that covers a point."""
    x, y = fractional_tile(lon, lat, z)
    top = F.pow(F.lit(2.0), _c(z)) - 1
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), top)).cast("int")
    return F.struct(_c(z).cast("int").alias("z"), clamp(x).alias("x"), clamp(y).alias("y"))


def proximity_tile(lon, lat, z) -> Column:
    """struct(z, x, y) of a proximity point: rounded, so up to half a tile off and up to 2^z."""
    x, y = fractional_tile(lon, lat, z)
    return F.struct(_c(z).cast("int").alias("z"), half_up(x).cast("int").alias("x"), half_up(y).cast("int").alias("y"))


def tile_corner(x, y, z) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), _c(z))
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * _c(y) / n))))
    return _c(x) / n * 360 - 180, lat


def parent_tile(x, y, z, to_z) -> tuple[Column, Column]:
    """The ancestor of a tile at a coarser zoom, as expressions for x and y."""
    return tuple(F.floor(_c(v) / F.pow(F.lit(2), _c(z) - _c(to_z))).cast("int") for v in (x, y))


def distance_miles(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance by haversine."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.pow(F.sin(dl / 2), 2) * F.cos(p1) * F.cos(p2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_METERS / METERS_PER_MILE


def cover_distance(plon, plat, lon, lat, x, y, z) -> Column:
    """Miles from a proximity point: to the center, or to the tile's farthest corner if that is less."""
    corners = [distance_miles(plon, plat, *tile_corner(_c(x) + i, _c(y) + j, z)) for i in (0, 1) for j in (0, 1)]
    return F.least(distance_miles(plon, plat, lon, lat), F.greatest(*corners))


def scale_radius(z) -> Column:
    return F.when(_c(z) <= 6, RADIUS_MILES[6]).when(_c(z) <= 12, RADIUS_MILES[12]).otherwise(RADIUS_MILES[14])


def gauss_variance(scale: float = 0.75, decay: float = 0.5) -> float:
    if decay == 0:
        raise ValueError("decay must be > 0")
    return -0.5 * (scale**2 / math.log(decay))


def gauss(dist, variance: float, offset: float = 0.0) -> Column:
    return F.exp(-0.5 * F.pow(F.greatest(F.lit(0.0), _c(dist) - offset), 2) / variance)


def score_weight(score, low, high) -> Column:
    """1 to 500."""
    return (_c(score) - _c(low)) / (_c(high) - _c(low)) * 499 + 1


def dist_weight(dist, z, radius=None) -> Column:
    """10 at the point, falling to 1."""
    reach = scale_radius(z) if radius is None else F.coalesce(_c(radius), scale_radius(z))
    return 9 * gauss(_c(dist) / reach * 3, gauss_variance()) + 1


def scoredist(score, low, high, dist, z, radius=None) -> Column:
    return score_weight(score, low, high) * dist_weight(dist, z, radius)


def relevance_score(relev, scoredist_, missing_address=None, ghost=None) -> Column:
    r = _c(relev)
    if missing_address is not None:
        r = F.when(_c(missing_address), F.greatest(F.lit(0.0), r - 0.0008)).otherwise(r)
    if ghost is not None:
        r = F.when(_c(ghost), F.greatest(F.lit(0.0), r - 0.01)).otherwise(r)
    return r * 0.6 + (_c(scoredist_) - 1) / (5000 - 1) * 0.4


def distscore(dist, score) -> Column:
    """Score of a reverse hit: distances up to 35 are alike."""
    return half_up(_c(score) * (DISTANCE_SCALE / F.greatest(_c(dist), F.lit(MIN_DISTANCE))), 4)


def in_box(lon, lat, w, s, e, n) -> Column:
    """Point in box, the box crossing the antimeridian where w > e."""
    lon, w, e = _c(lon), _c(w), _c(e)
    across = F.when(w <= e, (lon >= w) & (lon <= e)).otherwise((lon >= w) | (lon <= e))
    return (_c(lat) >= _c(s)) & (_c(lat) <= _c(n)) & across


def boxes_meet(a: tuple, b: tuple) -> bool:
    """Whether two boxes (west, south, east, north) meet, either of which may cross the antimeridian; for options and bounds."""
    parts = lambda x: [x] if x[0] <= x[2] else [(x[0], x[1], 180.0, x[3]), (-180.0, x[1], x[2], x[3])]
    return any(p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3] for p in parts(a) for q in parts(b))


def box_parts(box: Column) -> Column:
    """Array of boxes that don't cross the antimeridian, from array(w, s, e, n)."""
    w, s, e, n = (F.element_at(box, i) for i in (1, 2, 3, 4))
    return F.when(w <= e, F.array(box)).otherwise(F.array(F.array(w, s, F.lit(180.0), n), F.array(F.lit(-180.0), s, e, n)))


def boxes_intersect(a: Column, b: Column) -> Column:
    meet = lambda p, q: ~((F.element_at(p, 1) > F.element_at(q, 3)) | (F.element_at(p, 3) < F.element_at(q, 1)) | (F.element_at(p, 2) > F.element_at(q, 4)) | (F.element_at(p, 4) < F.element_at(q, 2)))
    return F.exists(box_parts(a), lambda p: F.exists(box_parts(b), lambda q: meet(p, q)))


def box_intersection(a: Column, b: Column) -> Column:
    """The common box of two, or null where it has no area."""
    g = lambda i, f: f(F.element_at(a, i), F.element_at(b, i))
    out = F.array(g(1, F.greatest), g(2, F.greatest), g(3, F.least), g(4, F.least))
    return F.when((F.element_at(out, 3) > F.element_at(out, 1)) & (F.element_at(out, 4) > F.element_at(out, 2)), out)


def clip_box(box: Column) -> Column:
    """A box over the antimeridian cut at 179.9 degrees on its smaller side."""
    w, s, e, n = (F.element_at(box, i) for i in (1, 2, 3, 4))
    return F.when(w < e, box).when(F.abs(w) > F.abs(e), F.array(F.lit(-179.9), s, e, n)).otherwise(F.array(w, s, F.lit(179.9), n))


def box_tiles(box: Column, z: int) -> Column:
    """struct(z, min_x, min_y, max_x, max_y) of the tiles that a box touches."""
    w, s, e, n = (F.element_at(box, i) for i in (1, 2, 3, 4))
    x0, y1 = fractional_tile(w, s, z)
    x1, y0 = fractional_tile(e, n, z)
    low = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    high = lambda v: F.greatest(F.lit(0), F.ceil(v) - 1).cast("int")
    return F.struct(F.lit(z).alias("z"), low(x0).alias("min_x"), low(y0).alias("min_y"), high(x1).alias("max_x"), high(y1).alias("max_y"))


def extent(points: Column) -> Column:
    """array(w, s, e, n) of an array of struct(lon, lat)."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat))


def in_ring(lon, lat, ring: Column) -> Column:
    """Point in a closed ring (array of struct(lon, lat)) by crossings."""
    x, y = _c(lon), _c(lat)
    edges = F.transform(F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    crossing = lambda e: ((e["a"]["lat"] > y) != (e["b"]["lat"] > y)) & (x < (e["b"]["lon"] - e["a"]["lon"]) * (y - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"])
    return F.size(F.filter(edges, lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1


def along(line: Column, part) -> Column:
    """Point at a fraction of a line's length (in degrees, straight), rounded to six places.
    ``line``: array of struct(lon, lat)."""
    return let(F.struct(line.alias("l"), _c(part).cast("double").alias("part")), lambda v: let(_lengths(v["l"]), lambda run: _at(v["l"], run, v["part"])))


def _lengths(line: Column) -> Column:
    """Length of the line up to each of its points."""
    step = lambda p, q: F.sqrt(F.pow(p["lon"] - q["lon"], 2) + F.pow(p["lat"] - q["lat"], 2))
    indexes = F.when(F.size(line) > 1, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indexes, F.array(F.lit(0.0)), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + step(F.get(line, i), F.get(line, i - 1))))


def _at(line: Column, run: Column, part: Column) -> Column:
    goal = part * F.element_at(run, -1)
    n = F.size(line)
    stop = F.get(F.filter(F.sequence(F.lit(1), n - 1), lambda i: (F.get(run, i) > goal) | (i == n - 1)), F.lit(0))

    def point(i: Column) -> Column:
        span = F.get(run, i) - F.get(run, i - 1)
        share = F.when(span != 0, (goal - F.get(run, i - 1)) / span).otherwise(1.0)
        at = lambda k, t: half_up(F.get(line, i)[k] * t + F.get(line, i - 1)[k] * (1 - t), 6)
        return let(share, lambda t: F.struct(at("lon", t).alias("lon"), at("lat", t).alias("lat")))

    return let(stop, point)


def interpolate(number, start, end, line: Column) -> Column:
    """Point of a house number on a range: the line is walked from the smaller number."""
    args = F.struct(_c(number).cast("double").alias("n"), _c(start).cast("double").alias("a"), _c(end).cast("double").alias("b"), line.alias("l"))

    def place(v):
        low, high = F.least(v["a"], v["b"]), F.greatest(v["a"], v["b"])
        part = F.when(high > low, (v["n"] - low) / (high - low)).otherwise(0.0)
        return along(F.when(v["a"] > v["b"], F.reverse(v["l"])).otherwise(v["l"]), part)

    return let(args, place)

"""Shapes through Arrow UDFs: tile covers of lines and polygons, a point on a surface, the phrase byte."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo

MAX_LAT = 85.0511


def _position(lon: float, lat: float, z: int) -> tuple[float, float]:
    n = 2.0**z
    rad = math.radians(max(-MAX_LAT, min(MAX_LAT, lat)))
    return (lon + 180) / 360 * n, (1 - math.asinh(math.tan(rad)) / math.pi) / 2 * n


def _inside(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _touches(a: tuple[float, float], b: tuple[float, float], x: int, y: int) -> bool:
    """Whether a segment meets the unit square at (x, y), by clipping it."""
    low, high = 0.0, 1.0
    for p, d, lo in ((a[0], b[0] - a[0], x), (a[1], b[1] - a[1], y)):
        if d == 0:
            if not lo <= p < lo + 1:
                return False
            continue
        t0, t1 = sorted(((lo - p) / d, (lo + 1 - p) / d))
        low, high = max(low, t0), min(high, t1)
        if low > high:
            return False
    return True


def cover(points: list[tuple[float, float]], z: int, polygon: bool) -> list[tuple[int, int, int]]:
    """Tiles at a zoom that a line or the polygon of a ring meets, in order; tiles are found edge by edge and, for
    polygons, row by row in between."""
    at = [_position(lon, lat, z) for lon, lat in points]
    top = 2**z - 1
    found: set[tuple[int, int]] = set()
    edges = list(zip(at, at[1:])) + ([(at[-1], at[0])] if polygon and len(at) > 2 else [])
    for a, b in edges or [(p, p) for p in at]:
        for x in range(math.floor(min(a[0], b[0])), math.floor(max(a[0], b[0])) + 1):
            for y in range(math.floor(min(a[1], b[1])), math.floor(max(a[1], b[1])) + 1):
                if _touches(a, b, x, y):
                    found.add((x, y))
    if polygon and len(at) > 2:
        rows: dict[int, list[int]] = {}
        for x, y in found:
            rows.setdefault(y, []).append(x)
        for y, xs in rows.items():
            edge = set(xs)
            for x in range(min(xs), max(xs) + 1):
                if x not in edge and _inside(x + 0.5, y + 0.5, at):
                    found.add((x, y))
    return sorted({(z, max(0, min(top, x)), max(0, min(top, y))) for x, y in found})


def tile_cover(points, z: int | Column, polygon: bool = True) -> Column:
    """Array of struct(z, x, y) for an array of struct(lon, lat); null for null, empty for an empty one."""

    @F.pandas_udf("array<struct<z:int,x:int,y:int>>")
    def run(rows: pd.Series, zooms: pd.Series) -> pd.Series:
        tiles = [None if r is None else [{"z": a, "x": b, "y": c} for a, b, c in cover([(p["lon"], p["lat"]) for p in r], int(k), polygon)] for r, k in zip(rows, zooms)]
        return pd.Series(tiles, index=rows.index, dtype=object)

    return run(F.col(points) if isinstance(points, str) else points, z if isinstance(z, Column) else F.lit(z))


def lines_cover(lines, z: Column) -> Column:
    """Array of struct(z, x, y) that several lines (an array of them) meet."""

    @F.pandas_udf("array<struct<z:int,x:int,y:int>>")
    def run(rows: pd.Series, zooms: pd.Series) -> pd.Series:
        def one(r, k):
            return None if r is None else [{"z": a, "x": b, "y": c} for a, b, c in sorted({t for line in r for t in cover([(p["lon"], p["lat"]) for p in line], int(k), False)})]

        return pd.Series([one(r, k) for r, k in zip(rows, zooms)], index=rows.index, dtype=object)

    return run(lines, z)


PART = "struct<kind:string,lon:double,lat:double,line:array<struct<lon:double,lat:double>>>"


def parts(features: DataFrame) -> DataFrame:
    """The shapes that a feature (all columns of ``schema.OPTIONAL``) is found by, a row each (column ``part``): a point for each address and
    crossing, a line for each range; where it has none of these, its ring, its line, or its center."""
    none = F.lit(None).cast("array<struct<lon:double,lat:double>>")
    point = lambda p: F.struct(F.lit("point").alias("kind"), p["lon"].alias("lon"), p["lat"].alias("lat"), none.alias("line"))
    shape = lambda kind, line, lon, lat: F.struct(F.lit(kind).alias("kind"), lon.alias("lon"), lat.alias("lat"), line.alias("line"))
    empty = F.array().cast(f"array<{PART}>")
    some = lambda c, fn: F.coalesce(F.transform(c, fn), empty)
    own = F.concat(some("points", point), some("intersections", point), some(F.filter("ranges", lambda r: F.size(r["line"]) > 1), lambda r: shape("line", r["line"], r["line"][0]["lon"], r["line"][0]["lat"])))
    lon, lat = F.col("lon"), F.col("lat")
    whole = F.when(F.size("ring") > 3, shape("ring", F.col("ring"), lon, lat)).when(F.size("line") > 1, shape("line", F.col("line"), lon, lat)).otherwise(shape("point", none, lon, lat))
    return features.withColumn("part", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(whole))))


def covers(part: Column, zoom: Column, points_only: bool = False) -> Column:
    """Array of struct(z, x, y) that a part meets; ``points_only``: there are no rings or lines, so no UDF runs."""
    if points_only:
        return F.array(geo.tile_of(part["lon"], part["lat"], zoom))
    long = F.when(part["kind"] != "point", part["line"])
    closed = part["kind"] == "ring"
    return F.when(part["kind"] == "point", F.array(geo.tile_of(part["lon"], part["lat"], zoom))).when(closed, tile_cover(F.when(closed, long), zoom)).otherwise(tile_cover(F.when(~closed, long), zoom, False))


def tiles_of(features: DataFrame) -> DataFrame:
    """A row per feature (columns zoom, lon, lat and those of ``schema.OPTIONAL`` that there are) and tile (column ``t``) of its center, ring,
    line, addresses, ranges and crossings."""
    has = set(features.columns)
    none = F.array().cast("array<struct<z:int,x:int,y:int>>")
    points = lambda c: F.coalesce(F.transform(c, lambda p: geo.tile_of(p["lon"], p["lat"], F.col("zoom"))), none)
    found = [F.array(geo.tile_of("lon", "lat", "zoom")), *(points(c) for c in ("points", "intersections") if c in has)]
    out = features
    if "ring" in has:
        out = out.withColumn("__ring", tile_cover("ring", F.col("zoom")))
        found.append(F.coalesce("__ring", none))
    if has & {"line", "ranges"}:
        empty = F.array().cast("array<array<struct<lon:double,lat:double>>>")
        lines = [F.coalesce(F.transform("ranges", lambda r: r["line"]), empty)] if "ranges" in has else []
        lines += [F.when(F.col("line").isNotNull(), F.array("line")).otherwise(empty)] if "line" in has else []
        out = out.withColumn("__lines", lines_cover(F.concat(*lines), F.col("zoom")))
        found.append(F.coalesce("__lines", none))
    tiles = F.array_distinct(F.concat(*found)) if len(found) > 1 else found[0]
    return out.withColumn("t", F.explode(nearest_tiles(tiles, F.col("lon"), F.col("lat"), F.col("zoom")) if len(found) > 1 else tiles)).drop("__ring", "__lines")


MAX_COVERS = 10_000


def nearest_tiles(tiles: Column, lon, lat, z, most: int = MAX_COVERS) -> Column:
    """The tiles (array of struct(z, x, y)) closest to that of a center, at most ``most``."""

    def cut(v: Column) -> Column:
        gap = lambda t: F.pow(t["x"] - v["c"]["x"], 2) + F.pow(t["y"] - v["c"]["y"], 2)
        return F.transform(F.slice(F.array_sort(F.transform(v["t"], lambda t: F.struct(gap(t).alias("d"), t.alias("t")))), 1, most), lambda s: s["t"])

    return F.when(F.size(tiles) <= most, tiles).otherwise(geo.let(F.struct(tiles.alias("t"), geo.proximity_tile(lon, lat, z).alias("c")), cut))


def surface_point(ring: list[tuple[float, float]]) -> tuple[float, float] | None:
    """A point inside a ring: its vertex mean, or the middle of the widest stretch inside at that height."""
    if not ring:
        return None
    x, y = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    if _inside(x, y, ring):
        return x, y
    cuts = sorted(ax + (bx - ax) * (y - ay) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]) if (ay > y) != (by > y))
    spans = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2])]
    return (max(spans)[1], y) if spans else ring[0]


def on_surface(ring) -> Column:
    """struct(lon, lat) of a point inside of a ring (array of struct(lon, lat)); null for null."""

    @F.pandas_udf("struct<lon:double,lat:double>")
    def run(rows: pd.Series) -> pd.DataFrame:
        found = [None if r is None or not len(r) else surface_point([(p["lon"], p["lat"]) for p in r]) for r in rows]
        return pd.DataFrame({"lon": [f and f[0] for f in found], "lat": [f and f[1] for f in found]}, dtype="float64")

    return run(F.col(ring) if isinstance(ring, str) else ring)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The 32-bit MurmurHash3 for x86."""
    mask, h = 0xFFFFFFFF, seed
    scramble = lambda k: ((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    return h ^ h >> 16


def phrase_byte(text: str) -> int:
    """The top byte of a text's hash, over its Latin-1 bytes; characters beyond count by their low byte."""
    return murmur3_32(bytes(ord(c) & 0xFF for c in text)) >> 24


def phrase_hash(col) -> Column:
    @F.pandas_udf("int")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else phrase_byte(t)).astype("Int32")

    return run(F.col(col) if isinstance(col, str) else col)

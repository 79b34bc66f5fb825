"""House numbers: matching address points, ranges forward and reverse, and their number buckets.

A feature's points are an array of struct(num, lon, lat, style); its ranges an array of struct(i, lf, lt, rf, rt,
lp, rp, line), line an array of struct(lon, lat)."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.geo import let
from waymark.functions.text import mask_number, parse_semi_number

MAX_POINTS = 10
NEAR_NUMBER = 400
METERS_BETWEEN = 200


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def match_rank(number, wanted, style="standard", prefix: bool = False) -> Column:
    """0 for the best kind of match to 2, null for none. Only the first character that isn't a digit is
    dropped from the wanted number, for both styles."""
    n, w, st = F.lower(_c(number)), F.lower(_c(wanted)), F.lit(style) if isinstance(style, str) else style
    digits = lambda c: F.regexp_replace(c, r"^(\d*)\D", "$1")
    hyphened = lambda c: F.regexp_replace(c, r"^([\d-]*)[^\d-]", "$1")
    initial = lambda c: F.regexp_replace(c, r"^(\d+)([^\d].*)", "$1")
    plain = ~F.contains(w, F.lit("-"))
    if prefix:
        standard = F.when(F.startswith(n, w), 0).when(F.startswith(n, digits(w)), 1)
        queens = F.when(F.startswith(n, w), 0).when(F.startswith(hyphened(n), hyphened(w)), 1).when(F.startswith(digits(n), digits(w)) & plain, 2)
    else:
        standard = F.when(n == w, 0).when(n == digits(w), 1).when((initial(n) != "") & (initial(n) == initial(w)), 2)
        queens = F.when(n == w, 0).when(hyphened(n) == hyphened(w), 1).when((digits(n) == digits(w)) & plain, 2)
    return F.when(st == "queens", queens).otherwise(standard)


def matching_points(points, wanted, most: int = MAX_POINTS, prefix: bool = False) -> Column:
    """The points of the best kind of match, in order, at most ``most``; coordinates to six places."""
    w = _c(wanted)
    ranked = F.transform(_c(points), lambda x: F.struct(match_rank(x["num"], w, F.coalesce(x["style"], F.lit("standard")), prefix).alias("rank"), x.alias("p")))

    def best_of(rows):
        kept = let(F.array_min(F.transform(rows, lambda r: r["rank"])), lambda best: F.filter(rows, lambda r: r["rank"] == best))
        place = lambda r: F.struct(r["p"]["num"].alias("num"), geo.half_up(r["p"]["lon"], 6).alias("lon"), geo.half_up(r["p"]["lat"], 6).alias("lat"))
        return F.slice(F.transform(kept, place), 1, most)

    return let(ranked, best_of)


def prefix_points(points, typed, lon=None, lat=None) -> Column:
    """Of the points that a number typed so far may become: the first, middle and last by number, and
    of these the one closest to a proximity point, if there is one."""
    found = F.array_sort(F.transform(matching_points(points, typed, 1 << 20, True), lambda p: F.struct(parse_semi_number(p["num"]).alias("n"), p["num"].alias("num"), p["lon"].alias("lon"), p["lat"].alias("lat"))))
    three = lambda f: F.when(F.size(f) > 2, F.array(F.get(f, F.lit(0)), F.get(f, F.floor(F.size(f) / 2).cast("int")), F.get(f, F.size(f) - 1))).otherwise(f)
    chosen = let(found, three)
    if lon is None:
        return chosen
    near = lambda c: F.array_min(F.transform(c, lambda p: F.struct(geo.distance_miles(lon, lat, p["lon"], p["lat"]).alias("d"), p.alias("p"))))["p"]
    return let(chosen, lambda c: F.when(F.size(c) > 0, F.array(near(c))).otherwise(c))


def nearest_point(points, lon, lat) -> Column:
    """The address point closest to a position; of equally close ones the last."""
    p = _c(points)
    ranked = F.transform(p, lambda x, i: F.struct(geo.distance_miles(lon, lat, x["lon"], x["lat"]).alias("d"), (-i).alias("i"), x.alias("p")))
    return F.array_min(ranked)["p"]


def _within(number, a, b) -> Column:
    return a.isNotNull() & b.isNotNull() & (number >= F.least(a, b)) & (number <= F.greatest(a, b))


def _parity(number, p) -> Column:
    return (p == "B") | F.when(number % 2 == 0, p == "E").otherwise(p == "O")


def on_range(ranges, number) -> Column:
    """struct(lon, lat, omitted) of a house number on ranges: the last range, in order of numbers, that holds
    it with its parity, left side first; else, marked omitted, the first that holds it at all, or the
    closest range end within 400 numbers. Null otherwise."""
    wanted = F.regexp_replace(_c(number).cast("string"), r"^(\d*)\D", "$1").try_cast("double")
    sides = ("lf", "rf", "lt", "rt")
    ordered = F.array_sort(
        F.transform(
            F.filter(_c(ranges), lambda r: F.greatest(*[F.coalesce(r[k], F.lit(0)) for k in sides]) > 0),
            lambda r: F.struct(*[r[k].alias(k) for k in sides], F.size(r["line"]).alias("size"), r["i"].alias("i"), r["lp"].alias("lp"), r["rp"].alias("rp"), r["line"].alias("line")),
        )
    )

    def classed(v):
        """Per range: 2 with its parity, 1 without, 0 not held; whether by its left side."""
        n = v["n"]

        def one(r):
            left, right = F.coalesce(_within(n, r["lf"], r["lt"]), F.lit(False)), F.coalesce(_within(n, r["rf"], r["rt"]), F.lit(False))
            strict_left = left & F.coalesce(_parity(n, r["lp"]), F.lit(False))
            kind = F.when(strict_left, 2).when(right & F.coalesce(_parity(n, r["rp"]), F.lit(False)), 2).when(left | right, 1).otherwise(0)
            return F.struct(kind.alias("kind"), strict_left.alias("strict_left"), left.alias("left"), r.alias("r"))

        return F.struct(n.alias("n"), F.transform(v["o"], one).alias("o"))

    def choose(v):
        strict = F.try_element_at(F.filter(v["o"], lambda c: c["kind"] == 2), F.lit(-1))
        loose = F.get(F.filter(v["o"], lambda c: c["kind"] == 1), F.lit(0))
        pick = lambda c, left, omitted: F.struct(F.when(left, c["r"]["lf"]).otherwise(c["r"]["rf"]).alias("a"), F.when(left, c["r"]["lt"]).otherwise(c["r"]["rt"]).alias("b"), c["r"]["line"].alias("line"), F.lit(omitted).alias("omitted"))
        held = let(F.struct(strict.alias("s"), loose.alias("l")), lambda z: F.when(z["s"].isNotNull(), pick(z["s"], z["s"]["strict_left"], False)).when(z["l"].isNotNull(), pick(z["l"], z["l"]["left"], True)))
        ends = F.flatten(
            F.transform(
                F.reverse(v["o"]),
                lambda c, i: F.transform(
                    F.array(*[F.struct(c["r"][k].alias("hn"), F.lit(at).alias("at")) for k, at in (("lf", 0), ("lt", 1), ("rf", 0), ("rt", 1))]),
                    lambda e, j: F.struct(F.abs(v["n"] - e["hn"]).alias("gap"), (-(i * 4 + j)).alias("late"), F.get(c["r"]["line"], e["at"]).alias("p")),
                ),
            )
        )
        end = F.array_min(F.filter(ends, lambda e: e["gap"].isNotNull()))
        near = let(end, lambda e: F.when(e["gap"] <= NEAR_NUMBER, F.struct(geo.half_up(e["p"]["lon"], 6).alias("lon"), geo.half_up(e["p"]["lat"], 6).alias("lat"), F.lit(True).alias("omitted"))))
        placed = lambda h: let(geo.interpolate(v["n"], h["a"], h["b"], h["line"]), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), h["omitted"].alias("omitted")))
        return let(held, lambda h: F.when(h.isNotNull(), placed(h)).otherwise(near))

    return let(F.struct(wanted.alias("n"), ordered.alias("o")), lambda v: let(classed(v), choose))


def number_on_range(low, high, share, parity) -> Column:
    """House number at a share of a range, rounded to the range's parity."""
    n = _c(low) + (_c(high) - _c(low)) * _c(share)
    return F.when(_c(parity) == "O", geo.half_up((n + 1) / 2) * 2 - 1).when(_c(parity) == "E", geo.half_up(n / 2) * 2).otherwise(geo.half_up(n)).cast("bigint")


def nearest_on_line(line, lon, lat) -> Column:
    """struct(dist, share, lon, lat, side): closest place of a line to a position on a local plane; share of the line's
    length up to it; side of the line: 1 left, -1 right, 0 on it."""

    def placed(v):
        k, ln = F.cos(F.radians(v["lat"])), v["l"]
        x, y = v["lon"] * k, v["lat"]
        seg = F.transform(
            F.when(F.size(ln) > 1, F.sequence(F.lit(0), F.size(ln) - 2)),
            lambda i: F.struct((F.get(ln, i)["lon"] * k).alias("ax"), F.get(ln, i)["lat"].alias("ay"), (F.get(ln, i + 1)["lon"] * k).alias("bx"), F.get(ln, i + 1)["lat"].alias("by"), i.alias("i")),
        )
        length = lambda s: F.sqrt(F.pow(s["bx"] - s["ax"], 2) + F.pow(s["by"] - s["ay"], 2))

        def project(s):
            raw = F.coalesce(((x - s["ax"]) * (s["bx"] - s["ax"]) + (y - s["ay"]) * (s["by"] - s["ay"])) / F.nullif(F.pow(length(s), 2), F.lit(0.0)), F.lit(0.0))

            def at(t):
                px, py = s["ax"] + (s["bx"] - s["ax"]) * t, s["ay"] + (s["by"] - s["ay"]) * t
                det = (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
                return F.struct(F.sqrt(F.pow(px - x, 2) + F.pow(py - y, 2)).alias("d"), s["i"].alias("i"), (length(s) * t).alias("into"), (px / k).alias("lon"), py.alias("lat"), F.signum(det).cast("int").alias("side"))

            return let(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), at)

        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + w)

        def finish(z):
            before = add(F.slice(z["lengths"], F.lit(1), z["best"]["i"])) + z["best"]["into"]
            share = F.coalesce(before / F.nullif(add(z["lengths"]), F.lit(0.0)), F.lit(0.0))
            return F.struct(
                geo.distance_miles(v["lon"], v["lat"], z["best"]["lon"], z["best"]["lat"]).alias("dist"), share.alias("share"),
                z["best"]["lon"].alias("lon"), z["best"]["lat"].alias("lat"), z["best"]["side"].alias("side"),
            )

        return let(let(seg, lambda g: F.struct(F.array_min(F.transform(g, project)).alias("best"), F.transform(g, length).alias("lengths"))), finish)

    some = F.when(F.size(_c(line)) > 1, F.struct(_c(line).alias("l"), _c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat")))
    return let(some, lambda v: F.when(v.isNotNull(), placed(v)))


def reverse_range(ranges, lon, lat) -> Column:
    """struct(number, lon, lat, dist) of the range closest to a position: its number by share of the line and
    side; the other side where that side has no parity."""
    ranked = F.transform(_c(ranges), lambda r: F.struct(nearest_on_line(r["line"], lon, lat).alias("at"), *[r[k].alias(k) for k in ("lf", "lt", "rf", "rt", "lp", "rp")]))

    def numbered(best):
        some = lambda p: F.coalesce(p != "", F.lit(False))
        left = F.when(best["at"]["side"] > 0, some(best["lp"]) | ~some(best["rp"])).otherwise(~some(best["rp"]))
        picked = lambda lf: F.struct(*[F.when(lf, best[f"l{k}"]).otherwise(best[f"r{k}"]).alias(k) for k in "ftp"])
        number = let(let(left, picked), lambda s: F.when(some(s["p"]), number_on_range(s["f"], s["t"], best["at"]["share"], s["p"])))
        return F.struct(number.alias("number"), best["at"]["lon"].alias("lon"), best["at"]["lat"].alias("lat"), best["at"]["dist"].alias("dist"))

    return F.when(F.size(_c(ranges)) > 0, let(F.array_min(ranked), numbered))


def number_buckets(numbers) -> Column:
    """Sorted distinct masks of an array of house numbers, for the index."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(numbers), lambda x: mask_number(parse_semi_number(x).cast("string"))), lambda m: m.isNotNull())))


def routable_point(point: Column, line: Column, interpolated: Column, own: Column | None = None) -> Column:
    """struct(lon, lat) to route to: the feature's own one, an interpolated place itself, else the closest place of its line; null
    without a line."""
    at = nearest_on_line(line, point["lon"], point["lat"])
    near = F.when(at.isNotNull(), F.struct(geo.half_up(at["lon"], 6).alias("lon"), geo.half_up(at["lat"], 6).alias("lat")))
    here = F.struct(point["lon"].alias("lon"), point["lat"].alias("lat"))
    found = F.when(F.coalesce(interpolated, F.lit(False)), here).otherwise(near)
    return found if own is None else F.coalesce(own, found)


def crossing_point(intersections: Column, phrase: Column, tokens_of) -> Column:
    """struct(name, lon, lat) of the crossing that a phrase '+intersection <name> , <street>' means, the first of those so named.
    ``tokens_of``: column of a name -> its tokens as indexed."""
    asked = F.trim(F.replace(F.split(phrase, ",")[0], F.lit("+intersection"), F.lit("")))
    return F.get(F.filter(intersections, lambda x: F.array_join(tokens_of(x["name"]), " ") == asked), F.lit(0))


def range_buckets(low, high) -> Column:
    """Sorted distinct masks of a range: one per ten below 100, one per hundred from there."""
    a, b = F.least(_c(low), _c(high)).cast("bigint"), F.greatest(_c(low), _c(high)).cast("bigint")
    tens = F.when(a < 100, F.sequence(a, F.least(b, F.lit(99)), F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    start = F.greatest(a, F.lit(100))
    rest = F.when(b >= 100, F.concat(F.sequence(start, F.greatest(b, start), F.lit(10).cast("bigint")), F.array(b))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.transform(F.concat(tens, rest), lambda n: mask_number(n.cast("string")))))


def overlay(props, changes) -> Column:
    """Properties with an address's own put over them; a null one deletes."""
    merged = F.map_concat(F.map_filter(_c(props), lambda k, v: ~F.map_contains_key(_c(changes), k)), _c(changes))
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def point_or_range(point, range_, lon, lat) -> Column:
    """Whether the interpolated place is the better of the two: closer, and more than 200 m away from the point."""
    p, r = _c(point), _c(range_)
    apart = geo.distance_miles(p["lon"], p["lat"], r["lon"], r["lat"]) * geo.METERS_PER_MILE > METERS_BETWEEN
    closer = geo.distance_miles(lon, lat, r["lon"], r["lat"]) < geo.distance_miles(lon, lat, p["lon"], p["lat"])
    return r.isNotNull() & (p.isNull() | (apart & closer))


def distance_meters(*args) -> Column:
    return geo.distance_miles(*args) * geo.METERS_PER_MILE

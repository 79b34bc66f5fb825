"""Predicates on features: types, subtypes, stacks, languages, boxes, ghosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.config import Source
from waymark.functions import geo
from waymark.functions.lang import has_language


def of_types(source: Source, types: list[str] | None, score: str = "score") -> Column:
    """Whole types take all features; a subtype those whose score is in its range of the maximum, both
    ends included, and isn't 0 or null."""
    if not types:
        return F.lit(True)
    out = F.lit(bool(set(types) & set(source.all_types)))
    top = source.maxscore or 1.0
    for t in types:
        kind, dot, sub = t.partition(".")
        if dot and kind in source.all_types and sub in source.scoreranges:
            lo, hi = source.scoreranges[sub]
            out = out | (F.coalesce(F.col(score), F.lit(0.0)) != 0) & F.col(score).between(lo * top, hi * top)
    return F.coalesce(out, F.lit(False))


def of_any_types(types: list[str] | None, score: str = "score", own: str = "own_types") -> Column:
    """``of_types`` for rows of several layers: columns with a feature's own types, its layer's scoreranges and maxscore."""
    if not types:
        return F.lit(True)
    whole = [t for t in types if "." not in t]
    out = F.arrays_overlap(own, F.array(*[F.lit(t) for t in whole])) if whole else F.lit(False)
    for kind, _, sub in (t.partition(".") for t in types if "." in t):
        span = F.try_element_at("scoreranges", F.lit(sub))
        inside = (F.col(score) >= span[0] * F.col("maxscore")) & (F.col(score) <= span[1] * F.col("maxscore"))
        out = out | F.array_contains(own, kind) & (F.coalesce(F.col(score), F.lit(0.0)) != 0) & inside
    return F.coalesce(out, F.lit(False))


def in_subtype_range(types: list[str] | None, score: str = "score") -> Column:
    """Reverse queries: of a layer whose subtype is asked for only features with a score in its range, open below."""
    out = F.lit(True)
    for kind, _, sub in (t.partition(".") for t in types or () if "." in t):
        span = F.try_element_at("scoreranges", F.lit(sub))
        held = in_score_range(F.coalesce(F.col(score), F.lit(0.0)), span[0] * F.col("maxscore"), span[1] * F.col("maxscore"))
        out = out & F.when((F.element_at("layer_types", -1) == kind) & span.isNotNull(), held).otherwise(True)
    return out


def allowed(types: list[str] | None, texts: str = "text_lang", languages: list[str] | None = None, strict: bool = False) -> Column:
    """Whether a feature may be a result: of a type asked for, and in strict mode with a text in the language."""
    return of_any_types(types) & in_language(texts, languages, strict)


def of_stacks(stacks: list[str] | None, stack: str = "stack") -> Column:
    return F.lit(True) if not stacks else F.col(stack).isNull() | F.col(stack).isin(stacks)


def of_any_stack(stacks: list[str], stack: str = "stack") -> Column:
    """Sources (``stack``: array) that are of one of the stacks, or of none in particular."""
    return (F.size(stack) == 0) | F.arrays_overlap(stack, F.array(*[F.lit(s) for s in stacks]))


def in_score_range(score, lo, hi) -> Column:
    """Range of reverse queries: open below, closed above."""
    s = F.col(score) if isinstance(score, str) else score
    return (s > lo) & (s <= hi)


def in_language(texts: str, languages: list[str] | None, strict: bool) -> Column:
    """In strict mode: whether there is a text in the first language, or one that counts as the same."""
    return F.coalesce(has_language(texts, languages[0]), F.lit(False)) if strict and languages else F.lit(True)


def in_bbox(bbox, lon: str = "lon", lat: str = "lat") -> Column:
    return F.lit(True) if bbox is None else geo.in_box(lon, lat, *bbox)


def in_bbox_tiles(bbox) -> Column:
    """Tiles (zoom, x, y) that a box touches, the box crossing the antimeridian where west > east."""
    if bbox is None:
        return F.lit(True)
    first, last = geo.tile_of(bbox[0], bbox[3], "zoom"), geo.tile_of(bbox[2], bbox[1], "zoom")
    x, y = F.col("x"), F.col("y")
    across = (x >= first["x"]) & (x <= last["x"]) if bbox[0] <= bbox[2] else (x >= first["x"]) | (x <= last["x"])
    return across & (y >= first["y"]) & (y <= last["y"])


def forward_allowed(reverse_only: str = "reverse_only") -> Column:
    return ~F.coalesce(F.col(reverse_only), F.lit(False))


def not_ghost(score: str = "score", matched: Column | None = None) -> Column:
    alive = F.coalesce(F.col(score), F.lit(0.0)) >= 0
    return alive if matched is None else alive | matched


def without_ghost_doubles(rows: DataFrame, rank: str = "rank", text: str = "text", scoredist: str = "scoredist") -> DataFrame:
    """A result of negative score goes if a better one of its query has the same text."""
    w = Window.partitionBy("query_id", text).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.max((F.col(scoredist) >= 0).cast("int")).over(w), F.lit(0))
    return rows.withColumn("_b", better).where((F.col(scoredist) >= 0) | (F.col("_b") == 0)).drop("_b")

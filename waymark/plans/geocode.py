"""Forward, reverse and id queries, each a plan over a whole table of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.config import InvalidOption, Options, Source, max_score
from waymark.functions import address, bits, geo
from waymark.functions.rewrite import categorize
from waymark.functions.text import as_id, as_reverse, normalize_text, replace_words, tokenize
from waymark.operators import context as ctx
from waymark.operators import filters, match, output, verify
from waymark.operators.index import Index, by_layer
from waymark.schema import complete
from waymark.sources.scratch import materialize

STACKS, CONTEXTS = 50, 20
#: What a target carries from its feature to the result.
CARRIED = ("text", "text_lang", "stack", "score", "props")


@dataclass
class Trace:
    """What each stage of a forward query came to: (stage, rows, seconds since the one before)."""

    stages: list[tuple[str, int, float]] = field(default_factory=list)
    began: float = field(default_factory=time.time)

    def note(self, stage: str, table: DataFrame) -> None:
        rows, now = table.count(), time.time()
        self.stages.append((stage, rows, round(now - self.began, 3)))
        self.began = now


def _narrowed(index: Index, layers: list[Source]) -> Index:
    """The index of some of its layers."""
    if len(layers) == len(index.layers):
        return index
    out = replace(index, sources=index.sources.where(F.col("source").isin([s.name for s in layers])))
    out.__dict__["layers"] = layers
    return out


def of_worldview(index: Index, o: Options) -> Index:
    return _narrowed(index, [s for s in index.layers if s.worldview is None or s.worldview == o.worldview])


def _up_to(layers: list[Source], types: list[str] | None) -> list[Source]:
    """The layers that a result of the types can be of, and all coarser ones."""
    if not types:
        return layers
    heads = {t.split(".")[0] for t in types}
    last = max((i for i, s in enumerate(layers) if heads & set(s.all_types)), default=-1)
    return layers[: last + 1]


def _searched(index: Index, o: Options) -> Index:
    """The layers that forward queries look at: none whose stacks, bounds or place in the order can't give what is asked for."""
    kept = [s for s in _up_to(index.layers, o.types) if s.allows(stacks=o.stacks) and (o.bbox is None or geo.boxes_meet(o.bbox, s.bounds))]
    return _narrowed(index, kept)


def _layer_flags(layers: list[Source], flag: Callable[[Source], bool]) -> Column:
    """Names of the layers that a flag holds for."""
    return ctx.strings([s.name for s in layers if flag(s)])


def type_id(kind: Column | None = None, id_: str = "id") -> Column:
    return F.concat(F.element_at("own_types", -1) if kind is None else kind, F.lit("."), F.col(id_).cast("string"))


def forward(queries: DataFrame, index: Index, options: Options | None = None, helpers: dict | None = None, trace: Trace | None = None) -> DataFrame:
    """For each query (query_id, query) up to ``limit`` results: query_id, rank, id (type.id), place_name, relevance, lon, lat, text, language,
    address, omitted, interpolated, matching_text, matching_place_name, context (id and text of its parents); with several
    languages names, with ``routing`` routable_point. ``helpers``: functions for templates. Queries of more than 256 characters or 20 tokens have no results."""
    o = (options or Options()).checked(index.layers)
    rows = verified(queries, index, o, trace)
    rows = output.with_names(rows, index.layers, o.language, o.language_mode == "strict", helpers)
    rows = materialize(rows, "named")
    if not o.allow_dupes:
        rows = verify.dedupe(rows)
        # the same house on the same street under two names
        brief = output.is_short_address("asked_words")
        key = F.when(F.col("address").isNotNull() & ~brief, output.address_key(F.array(F.col("address"), "matched_phrase"), F.transform(F.slice("context", 2, 100), lambda c: c["id"].cast("string"))))
        rows = verify.dedupe(rows.withColumn("address_key", key), "address_key")
    rows = rows.where(F.col("rank") <= o.limit)
    if trace:
        trace.note("results", rows)
    parents = F.transform(F.slice("context", 2, 100), lambda c: F.struct(F.concat(c["type"], F.lit("."), c["id"].cast("string")).alias("id"), output.displayed(c["text_lang"], c["text"], o.language[0] if o.language else None)["text"].alias("text")))
    more = [c for c in ("names", "routable_point") if c in rows.columns]
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), type_id().alias("id"), "place_name", F.col("verified").alias("relevance"), "lon", "lat", "text", "language", "address", "omitted", "interpolated",
        "matching_text", "matching_place_name", parents.alias("context"), *more,
    )


def _crossing_tokens(layers: list[Source]) -> Callable[[Column], Column]:
    """A crossing street's name -> its tokens as its layer indexes them."""

    def tokens_of(name: Column) -> Column:
        plain = tokenize(normalize_text(name))
        return by_layer({s.name: replace_words(plain, categorize(s.tokens)[0]) for s in layers if s.intersection_token and s.tokens}, plain)

    return tokens_of


def targets(asked: DataFrame, index: Index, o: Options, narrow_stacks: bool = True) -> DataFrame:
    """The features (query_id, idx, id, number, at, crossing) that may be results, each at the place meant: house numbers become the points or
    places on ranges that they stand for, up to ten; where a street has no such number it answers itself (fallback)."""
    layer = index.sources.select("source", "idx", "ndx", F.col("types").alias("layer_types"), "address_order", "zoom", "maxscore", "scoreranges", "is_address", "worldview")
    f = complete(index.features)
    keep = [c for c in ("formats", "overrides") if c in index.features.columns]
    rows = asked.join(F.broadcast(layer), "idx").join(f, ["source", "id"])  # layer: a row per layer
    rows = rows.withColumn("own_types", F.coalesce("types", "layer_types")).where(filters.forward_allowed())
    rows = rows.where(filters.allowed(o.types, "text_lang", o.language, o.language_mode == "strict"))
    if o.stacks and narrow_stacks:
        # the base layer of another worldview may still vouch for a feature: looked at with the hierarchy
        base = index.layers[0].worldview if index.layers else None
        rows = rows.where(filters.of_stacks(o.stacks) | ~F.col("worldview").eqNullSafe(F.lit(base)))
    has_numbers = (F.coalesce(F.size("points"), F.lit(-1)) > 0) | (F.coalesce(F.size("ranges"), F.lit(-1)) > 0)
    one = "struct<address:string,lon:double,lat:double,omitted:boolean,interpolated:boolean,fallback:boolean,crossing:string>"
    made = lambda a, lon, lat, om, it, fb, cr=None: F.struct(a.alias("address"), lon.alias("lon"), lat.alias("lat"), om.alias("omitted"), it.alias("interpolated"), fb.alias("fallback"), (F.lit(None).cast("string") if cr is None else cr).alias("crossing")).cast(one)
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
    if any(s.is_address for s in index.layers):
        numbered = F.col("is_address") & (F.col("number") != "")
        found = F.when(numbered, address.matching_points("points", F.col("number")))
        placed = F.when(numbered & ~F.coalesce(F.size(found) > 0, no), address.on_range("ranges", "number"))
        met = address.crossing_point(F.when(F.col("crossing") != "", F.col("intersections")), F.col("crossing"), _crossing_tokens(index.layers))
        rows = rows.withColumns({"__p": found, "__r": placed, "__x": met})
        outcome = (
            F.when(F.size("__p") > 0, F.transform("__p", lambda p: made(p["num"], p["lon"], p["lat"], no, no, no)))
            .when(F.col("__r").isNotNull(), F.array(made(F.col("number"), F.col("__r.lon"), F.col("__r.lat"), F.col("__r.omitted"), yes, no)))
            .when(F.col("__x").isNotNull(), F.array(made(none, F.col("__x.lon"), F.col("__x.lat"), no, no, no, F.col("__x.name"))))
            .otherwise(F.array(made(none, F.col("lon"), F.col("lat"), no, no, numbered & has_numbers)))
        )
        missing = F.col("is_address") & ((F.col("number") == "") | ~has_numbers)
    else:
        outcome, missing = F.array(made(none, F.col("lon"), F.col("lat"), no, no, no)), no
    rows = rows.select(
        "query_id", "idx", "id", "number", "at", "crossing", "source", "ndx", "own_types", "layer_types", "address_order", "zoom", "worldview", *CARRIED, *keep, "line", missing.alias("missing_address"), F.explode(outcome).alias("o"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "o"], "o.lon", "o.lat", "o.address", "o.omitted", "o.interpolated", "o.fallback", F.col("o.crossing").alias("crossing_name"), F.when(F.col("o.address").isNotNull(), F.col("at")).alias("address_at"))
    rows = rows.where(filters.in_bbox(o.bbox))
    if o.routing:
        rows = rows.withColumn("routable_point", address.routable_point(F.struct("lon", "lat"), F.col("line"), F.col("interpolated")))
    rows = rows.drop("line")
    if o.proximity:
        miles = geo.distance_miles(*o.proximity, "lon", "lat")
        rows = rows.withColumns({"near": near_score(index.layers, F.col("score"), miles, F.col("zoom")), "miles": miles, "inside_radius": miles < geo.scale_radius(F.col("zoom"))})
    return rows


def near_score(layers: list[Source], score: Column, miles: Column, zoom: Column) -> Column:
    top = max_score(layers)
    held = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(float(top)))
    return geo.scoredist(held, 0.0, float(top), miles, zoom)


def verified(queries: DataFrame, index: Index, o: Options, trace: Trace | None = None) -> DataFrame:
    """All verified results of forward queries, ranked, before duplicates go and the limit is applied. ``o``: checked options."""
    view = of_worldview(index, o)
    searched = _searched(view, o)
    layers = view.layers
    zooms = sorted({s.zoom for s in layers})
    language = o.language[0] if o.language else None
    asked = match.tokenized(queries, layers)
    matches = match.phrasematch(asked, searched, o.autocomplete, o.fuzzy, searched.layers)
    found = match.covers(matches, searched, language, searched.layers)
    found = materialize(found.where(filters.in_bbox_tiles(o.bbox)), "covers")
    depth = max(1, len({s.family or s.name for s in searched.layers}))
    combined = materialize(match.stacks(found, zooms or [0], depth), "combined")
    if trace:
        trace.note("phrasematch", found)
        trace.note("spatialmatch", combined)
    # what the options and house numbers ask of a target holds before the best stacks are taken
    head = F.col("entries")[0]
    keyed = combined.withColumns({"idx": head["idx"], "id": head["id"], "number": head["number"], "at": head["at"], "crossing": F.when(F.startswith(head["phrase"], F.lit("+intersection")), head["phrase"]).otherwise("")})
    keys = ["query_id", "idx", "id", "number", "crossing"]
    narrow = bool(o.bbox or o.types or o.stacks or o.proximity or o.language_mode or "reverse_only" in index.features.columns or any(s.is_address for s in searched.layers))
    pool = keyed if narrow else match.ranked_stacks(keyed, STACKS)
    held = materialize(targets(pool.select("query_id", "idx", "id", "number", "at", "crossing").dropDuplicates(keys), view, o), "targets")
    best = held.groupBy(*keys).agg(*([F.max("near").alias("near")] if o.proximity else [F.lit(1).alias("__one")]))
    ranked = match.ranked_stacks(keyed.join(best, keys), STACKS)
    entry = lambda z: F.struct(z["balanced"].alias("relev"), z["entries"]["mask"].alias("mask"), z["entries"]["phrase"].alias("phrase"), z["entries"]["zoom"].alias("zoom"))
    pairs = F.arrays_zip("entries", "balanced")
    top = ranked.select(
        *keys, "n", "position", F.col("relev").alias("stack_relev"), "scoredist", "tmpid", head["phrase"].alias("own_phrase"),
        F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["entries"]["tmpid"], entry(z)))).alias("strict"), F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["entries"]["ndx"], entry(z)))).alias("by_layer"),
    )
    loaded = top.join(held.drop("at"), keys)
    ghost = F.coalesce(F.col("score"), F.lit(0.0)) < 0
    if o.proximity:
        loaded = loaded.withColumn("scoredist", F.col("near")).withColumn("relevance", geo.relevance_score("stack_relev", "near", F.col("missing_address"), ghost))
    else:
        loaded = loaded.withColumns({"scoredist": F.coalesce("score", F.lit(0.0)), "relevance": F.lit(0.0)})
    loaded = materialize(verify.order_features(loaded, CONTEXTS).withColumnRenamed("rank", "nth"), "loaded")
    if trace:
        trace.note("verifymatch", loaded)
    loose = match.best_covers(combined)
    # written down between steps: the expressions of each are large, and a plan of all of them would be planned again at every stage
    rows = materialize(_with_hierarchies(loaded, loose, view, zooms), "hierarchies")
    if o.stacks:
        base = F.element_at("context", -1)
        worldview = lambda source: by_layer({s.name: F.lit(s.worldview) for s in layers}, F.lit(None).cast("string"), source)
        rows = rows.withColumn("__base", base["source"])
        vouched = (F.size("context") > 1) & ~F.col("worldview").eqNullSafe(worldview("__base")) & filters.of_stacks(o.stacks, "__stack")
        rows = rows.withColumn("__stack", base["stack"]).where(filters.of_stacks(o.stacks) | vouched).drop("__base", "__stack")
    rows = materialize(_scored(rows, layers, o).where("verified > 0"), "scored")
    name = output.displayed(F.col("text_lang"), F.col("text"), language)["text"]
    ranked_rows = verify.order_contexts(rows.withColumn("shown", name), CONTEXTS)
    left = filters.without_ghost_doubles(ranked_rows.withColumn("__alive", F.when(ghost, -1.0).otherwise(1.0)), "rank", "shown", "__alive").drop("__alive")
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    words = F.regexp_replace("own_phrase", r"^\S*#\S*\s+", "")
    cats = by_layer({s.name: ctx.strings(c.lower() for c in s.categories) for s in layers if s.categories}, F.lit(None).cast("array<string>"))
    matching = F.when(F.col("crossing") == "", output.matching_name(F.col("text_lang"), F.col("text"), words, F.col("shown"), cats))
    return left.withColumns({"matching_text": matching, "matched_phrase": words, "asked_words": F.col("own_phrase")})


def _with_hierarchies(loaded: DataFrame, loose: DataFrame, index: Index, zooms: list[int]) -> DataFrame:
    """Adds context: the target and, in every coarser layer, the feature at its place, one that the query names before any other; each with
    the best cover it has in any stack (loose)."""
    points = loaded.select(F.struct("query_id", "nth").alias("point_id"), F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col("idx").alias("own"), "strict")
    # nothing lies above the finest layer: a place that many of its features share doesn't pair each of them with each
    coarser = index.place_rows().where(F.col("source").isin([s.name for s in index.layers[:-1]]))
    met = ctx.candidates(points, coarser, zooms).where(F.col("idx") < F.col("own"))
    named = met.withColumn("tmpid", bits.tmpid("idx", "id")).withColumn("query_id", F.col("point_id.query_id")).join(loose.select("query_id", "tmpid", "loose"), ["query_id", "tmpid"], "left")
    chosen = ctx.best_per_layer(named.withColumn("matched", F.map_contains_key("strict", F.col("tmpid")) | F.col("loose").isNotNull()))
    above = ctx.hierarchies(chosen, index.sources, ("loose",))
    kind = above.schema["context"].dataType.simpleString()
    rows = loaded.withColumn("point_id", F.struct("query_id", "nth")).join(above, "point_id", "left").join(loose.select("query_id", "tmpid", F.col("loose").alias("own_loose")), ["query_id", "tmpid"], "left")
    rows = rows.withColumn("context", F.coalesce("context", F.array().cast(kind)))
    rows = ctx.stacked(rows, top=F.element_at("own_types", -1))
    own = {
        "order": -F.col("idx"), "type": F.element_at("own_types", -1), "family": F.col("source"), "types": F.col("layer_types"), "stacks": F.array().cast("array<string>"), "distance": F.lit(0.0), "polygon": F.lit(False), "loose": F.col("own_loose"),
    }
    item = F.struct(*[own.get(c, F.col(c)).alias(c) for c in (*ctx.ITEM, "loose")])
    rows = rows.withColumn("context", F.concat(F.array(item).cast(kind), F.col("context")))
    for extra in ("formats", "overrides"):
        if extra in loaded.columns:
            rows = rows.withColumn("context", F.transform("context", _of_first(extra)))
    return rows.drop("point_id", "own_loose")


def _of_first(name: str) -> Callable[[Column, Column], Column]:
    """Puts a row's column into the first element of an array, null into the others."""
    return lambda c, i: c.withField(name, F.when(i == 0, F.col(name)))


def _scored(rows: DataFrame, layers: list[Source], o: Options) -> DataFrame:
    """Adds verified (the relevance that the context bears out) and the scores lent by namesakes among the results."""
    inherit, grant, ignore = (_layer_flags(layers, f) for f in (lambda s: s.inherit_score, lambda s: s.grant_score, lambda s: s.ignore_order))
    peers = Window.partitionBy("query_id")  # at most CONTEXTS rows
    rows = rows.withColumn("__peers", F.collect_list(F.struct("tmpid", F.element_at("own_types", -1).alias("type"), "text")).over(peers))
    boost = F.lit(0.0)
    if "overrides" in rows.columns:
        said = lambda c: F.try_element_at(F.col("overrides"), c["type"])
        replaced = F.transform("context", lambda c, i: F.when((i > 0) & said(c).isNotNull() & (said(c) != c["text"]), c.withField("text", said(c)).withField("text_lang", F.lit(None).cast("map<string,string>")).withField("tmpid", F.lit(-1).cast("bigint")).withField("loose", F.lit(None).cast(rows.schema["context"].dataType.elementType["loose"].dataType))).otherwise(c))
        rows = rows.withColumn("__borne", output.override_boost(F.lit(0.0), "overrides", "__peers")).withColumn("context", replaced)
        boost = F.col("__borne")
    weaker = lambda i, relev: relev * F.when((i == 0) & F.col("fallback"), 0.99).otherwise(1.0)

    def elements(strict: bool) -> Column:
        def one(c: Column, i: Column) -> Column:
            own = F.try_element_at(F.col("strict"), c["tmpid"])
            lent = F.struct(F.least(c["loose"]["relev"] + F.when(i == 0, boost).otherwise(0.0), F.lit(1.0)).alias("relev"), c["loose"]["mask"].alias("mask"), c["loose"]["phrase"].alias("phrase"), F.lit(0).alias("zoom"))
            hit = own if strict else F.when(c["loose"].isNotNull(), lent).otherwise(own)
            other = F.try_element_at(F.col("by_layer"), c["ndx"])
            is_hit = hit.isNotNull()
            near = ~is_hit & other.isNotNull() & (other["zoom"] > verify.MAX_ZOOM_NEAR_MISS) & (F.length(other["phrase"]) > verify.MAX_TEXT_NEAR_MISS)
            pick = lambda k: F.when(is_hit, hit[k]).otherwise(other[k])
            return F.struct(
                is_hit.alias("hit"), F.coalesce(near, F.lit(False)).alias("near"), pick("mask").alias("mask"), weaker(i, pick("relev")).alias("relev"), pick("phrase").alias("text"), c["ndx"].alias("ndx"),
                F.array_contains(ignore, c["source"]).alias("ignore"), c["text"].alias("name"), F.array_contains(inherit, c["source"]).alias("inherit"), F.array_contains(grant, c["source"]).alias("grant"),
            )

        return F.transform("context", one)

    score = F.greatest(verify.relevance(elements(True), F.col("address_order")), verify.relevance(elements(False), F.col("address_order")))
    rows = rows.withColumn("verified", F.least(geo.half_up(score, 6), F.lit(1.0)))
    if any(s.inherit_score for s in layers):
        ids = F.transform("__peers", lambda p: p["tmpid"])
        alike = lambda c: F.contains(c["text"], F.split("text", ",")[0]) & F.array_contains(ids, c["tmpid"]) & F.array_contains(grant, c["source"])
        matched = lambda c: F.map_contains_key("strict", c["tmpid"]) | c["loose"].isNotNull()
        lenders = F.filter(F.slice("context", 2, 100), lambda c: matched(c) & alike(c))
        lent = F.when(F.array_contains(inherit, F.col("source")), F.aggregate(lenders, F.lit(0.0), lambda a, c: a + F.greatest(F.coalesce(c["score"], F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)
        rows = rows.withColumn("__lent", lent)
        if o.proximity:
            new = near_score(layers, F.coalesce("score", F.lit(0.0)) + F.col("__lent"), F.col("miles"), F.col("zoom"))
            rows = rows.withColumn("scoredist", F.when(F.col("__lent") > 0, new).otherwise(F.col("scoredist")))
            rows = rows.withColumn("relevance", geo.relevance_score("stack_relev", "scoredist", F.col("missing_address"), F.coalesce(F.col("score"), F.lit(0.0)) < 0))
        else:
            rows = rows.withColumn("scoredist", F.col("scoredist") + F.col("__lent"))
        rows = rows.drop("__lent")
    return rows.drop("__peers", "__borne")


def reverse(points: DataFrame, index: Index, options: Options | None = None, tolerance: float | None = ctx.TOLERANCE_METERS, helpers: dict | None = None) -> DataFrame:
    """For each point (query_id, lon, lat) the hierarchy around it and each of its suffixes; with a limit above 1 the nearest features of the
    one type asked for, each with its hierarchy: query_id, rank, id, place_name, lon, lat, distance, text, language, address."""
    o = (options or Options()).checked(index.layers, reverse=True)
    if bad := [k for k in ("proximity", "bbox") if getattr(o, k)]:
        raise InvalidOption(f"without effect in reverse queries: {', '.join(bad)}")
    view = of_worldview(index, o)
    view = _narrowed(view, _up_to(view.layers, o.types))
    zooms = sorted({s.zoom for s in view.layers})
    tiled = view.place_rows().where(F.col("source").isin([s.name for s in view.layers]))
    asked = points.select(F.col("query_id").alias("point_id"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    layer = view.sources.select("source", F.col("types").alias("layer_types"), "maxscore", "scoreranges")
    ranged = lambda met: met.join(F.broadcast(layer), "source").where(filters.in_subtype_range(o.types)) if any("." in t for t in o.types or ()) else met.join(F.broadcast(layer.select("source", "layer_types")), "source")  # noqa: E731 - a row per layer
    met = ranged(ctx.candidates(asked, tiled, zooms or [0], tolerance))
    if o.limit > 1:
        hits = ctx.nearest(met.where(F.element_at("layer_types", -1) == o.types[0].split(".")[0]), o.limit)
        at = lambda k, own: F.when(F.col("part.kind") == "point", F.col(f"part.{k}")).otherwise(F.col(own))
        hits = materialize(hits.select(F.struct("point_id", "rank").alias("point_id"), at("lon", "plon").alias("plon"), at("lat", "plat").alias("plat"), F.struct("source", "id").alias("target"), F.element_at("layer_types", -1).alias("target_type"), F.col("distance").alias("hit_distance")), "hits")
        met = ranged(ctx.candidates(hits, tiled, zooms or [0], tolerance))
        met = met.where((F.element_at("layer_types", -1) != F.col("target_type")) | ((F.col("source") == F.col("target.source")) & (F.col("id") == F.col("target.id"))))
    by_score = F.col("source").isin([s.name for s in view.layers if s.reverse_by_score]) if o.reverse_mode == "score" else False
    chosen = _addressed(ctx.best_per_layer(met.drop("layer_types", "maxscore", "scoreranges"), by_score), view)
    more = ("address", *(c for c in ("formats",) if c in index.features.columns))
    if "formats" in index.features.columns:
        chosen = chosen.join(index.features.select("source", "id", "formats"), ["source", "id"], "left")
    above = materialize(ctx.hierarchies(chosen, view.sources, more), "hierarchies")
    found = ctx.stacked(above, o.types, o.stacks, by_score=o.reverse_mode == "score")
    if o.limit > 1:
        rows = found.where(F.size("context") > 0).withColumns({"depth": F.lit(0), "suffix": F.col("context")})
    else:
        rows = ctx.suffixes(found)
    head = F.col("suffix")[0]
    rows = rows.drop("context").withColumns({"context": F.col("suffix"), "address": head["address"], "crossing_name": F.lit(None).cast("string"), "source": head["source"], "own_types": F.array(head["type"]), "score": head["score"], "text_lang": head["text_lang"]})
    if o.types or o.language_mode:
        kinds = view.sources.select("source", "maxscore", "scoreranges")
        rows = rows.join(F.broadcast(kinds), "source").where(filters.allowed(o.types, "text_lang", o.language, o.language_mode == "strict"))  # a row per layer
    rows = output.with_names(rows, index.layers, o.language, o.language_mode == "strict", helpers)
    first = F.col("context")[0]
    if o.limit > 1:
        # a feature once, but for its addresses each
        once = Window.partitionBy("point_id.point_id", first["tmpid"], "address").orderBy("point_id.rank")
        rows = rows.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n").withColumns({"query": F.col("point_id.point_id"), "rank": F.row_number().over(Window.partitionBy("point_id.point_id").orderBy("point_id.rank"))})
        rows = rows.join(hits.select("point_id", "hit_distance"), "point_id")
    else:
        rows = rows.withColumns({"query": F.col("point_id"), "rank": F.row_number().over(Window.partitionBy("point_id").orderBy("depth")), "hit_distance": first["distance"]})
    extra = [c for c in ("names",) if c in rows.columns]
    return rows.select(
        F.col("query").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.concat(first["type"], F.lit("."), first["id"].cast("string")).alias("id"), "place_name", first["lon"].alias("lon"), first["lat"].alias("lat"),
        F.col("hit_distance").alias("distance"), "text", "language", "address", *extra,
    )


def _addressed(chosen: DataFrame, index: Index) -> DataFrame:
    """Adds address, the house number nearest to the point, and puts the feature there: an address point, or a place on a range if that is closer
    and more than 200 m from it."""
    names = [s.name for s in index.layers if s.is_address]
    if not names or not {"points", "ranges"} & set(index.features.columns):
        return chosen.withColumn("address", F.lit(None).cast("string"))
    full = complete(index.features).where(F.col("source").isin(names)).select("source", "id", "points", "ranges")
    rows = chosen.join(full, ["source", "id"], "left")
    point = F.when(F.size("points") > 0, address.nearest_point("points", F.col("plon"), F.col("plat")))
    placed = F.when(F.size("ranges") > 0, address.reverse_range("ranges", F.col("plon"), F.col("plat")))
    rows = rows.withColumns({"__p": point, "__r": placed})
    on_range = address.point_or_range("__p", "__r", F.col("plon"), F.col("plat")) & F.col("__r.number").isNotNull()
    pick = lambda a, b, c: F.when(on_range, b).otherwise(F.coalesce(a, c))
    return rows.withColumns({"address": pick(F.col("__p.num"), F.col("__r.number").cast("string"), F.lit(None).cast("string")), "lon": pick(F.col("__p.lon"), F.col("__r.lon"), F.col("lon")), "lat": pick(F.col("__p.lat"), F.col("__r.lat"), F.col("lat"))}).drop("points", "ranges", "__p", "__r")


def by_id(queries: DataFrame, index: Index, options: Options | None = None, helpers: dict | None = None) -> DataFrame:
    """query_id, id, place_name, lon, lat, text, language of queries ``type.id``."""
    o = (options or Options()).checked(index.layers)
    view = of_worldview(index, o)
    asked = queries.withColumn("i", as_id("query")).where(F.col("i").isNotNull()).select("query_id", F.col("i.type").alias("type"), F.col("i.id").alias("id"))
    kinds = F.broadcast(view.sources.select("source", "idx", F.explode("types").alias("type")))  # few rows per layer
    hit = asked.join(kinds, "type").join(complete(index.features).drop("types"), ["source", "id"])
    item = F.struct("source", "type", "id", "text", "text_lang", *(["formats"] if "formats" in index.features.columns else []))
    rows = hit.withColumns({"context": F.array(item), "address": F.lit(None).cast("string"), "crossing_name": F.lit(None).cast("string")})
    rows = output.with_names(rows.drop("text"), index.layers, o.language, o.language_mode == "strict", helpers)
    return rows.select("query_id", F.concat("type", F.lit("."), F.col("id").cast("string")).alias("id"), "place_name", "lon", "lat", "text", "language")


def geocode(queries: DataFrame, index: Index, options: Options | None = None, helpers: dict | None = None) -> DataFrame:
    """query_id, kind, rank, id, place_name, relevance, lon, lat, text, language, address: each query as an id, a point or a text. Options without a
    meaning for points, and a limit that points don't allow, count for texts only."""
    o = options or Options()
    kind = F.when(as_id("query").isNotNull(), "id").when(as_reverse("query").isNotNull(), "reverse").otherwise("forward")
    rows = queries.withColumn("kind", kind)
    none, cols = F.lit(None).cast("string"), ("lon", "lat", "text", "language")
    ids = by_id(rows.where("kind = 'id'"), index, o, helpers).select("query_id", F.lit("id").alias("kind"), F.lit(1).cast("long").alias("rank"), "id", "place_name", F.lit(1.0).alias("relevance"), *cols, none.alias("address"))
    at = rows.where("kind = 'reverse'").select("query_id", as_reverse("query").alias("p")).select("query_id", "p.lon", "p.lat")
    around = replace(o, proximity=None, bbox=None, limit=o.limit if len(o.types or ()) == 1 else None)
    back = reverse(at, index, around, helpers=helpers).select("query_id", F.lit("reverse").alias("kind"), "rank", "id", "place_name", F.lit(1.0).alias("relevance"), *cols, "address")
    ahead = forward(rows.where("kind = 'forward'"), index, o, helpers).select("query_id", F.lit("forward").alias("kind"), "rank", "id", "place_name", "relevance", *cols, "address")
    return ids.unionByName(back).unionByName(ahead)

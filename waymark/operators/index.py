"""Indexing: documents to term frequencies, phrases and postings, all as DataFrames keyed by source.

Frequencies cover a source's documents as a whole, each text and variant once. Tables are meant to be written partitioned by source and
sorted by phrase; nothing here is collected but one row per layer."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.config import Source, layers_of
from waymark.functions import address, bits, lang, rewrite, shapes
from waymark.functions.text import deletions, intersection_text, normalize_text, replace_patterns, replace_words, tokenize
from waymark.operators import context, validate
from waymark.operators.joins import hot_join
from waymark.schema import complete
from waymark.sources.scratch import materialize

MIN_RELEVANCE = 0.8
MAX_ALL_SUBSETS = 8
DEFAULT, EVERY = "default", "all"
#: Stands for every mask of a feature's house numbers until the phrases are made.
NUMBER = "#"


@dataclass
class Index:
    """``prefixes``, ``deletions`` and ``places`` are made when a query first asks for them, and stored with the index."""

    sources: DataFrame  # the catalog
    features: DataFrame  # source, id, text, lon, lat, score, ...
    phrases: DataFrame  # source, phrase
    grid: DataFrame  # source, phrase, id, relev, score, langs, x, y
    prefixes: DataFrame | None = None  # source, phrase, prefix
    deletions: DataFrame | None = None  # source, phrase, variant
    places: DataFrame | None = None  # shapes by tile: see context.tiles

    @functools.cached_property
    def layers(self) -> list[Source]:
        return layers_of(self.sources)

    def prefix_rows(self) -> DataFrame:
        if self.prefixes is None:
            self.prefixes = materialize(prefix_table(self.phrases), "prefixes")
        return self.prefixes

    def deletion_rows(self) -> DataFrame:
        if self.deletions is None:
            self.deletions = materialize(deletion_table(self.phrases), "deletions")
        return self.deletions

    def place_rows(self) -> DataFrame:
        if self.places is None:
            self.places = materialize(context.tiles(self.features, self.sources), "places")
        return self.places

    def cached(self) -> Index:
        """Its tables kept in memory as far as they fit."""
        for table in (self.sources, self.features, self.phrases, self.grid):
            table.cache()
        return self


def by_layer(values: dict[str, Column], otherwise: Column | None = None, source: str = "source") -> Column:
    """A value for each layer that has one; a row per layer at most."""
    out = F.when(F.lit(False), otherwise) if otherwise is not None else None
    for name, value in values.items():
        out = F.when(F.col(source) == name, value) if out is None else out.when(F.col(source) == name, value)
    return otherwise if not values else out if otherwise is None else out.otherwise(otherwise)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def synonyms(features: DataFrame, layers: list[Source] | tuple[Source, ...] = ()) -> DataFrame:
    """source, id, lang, syn, langs, numbers, tokens: one row per comma-separated text and language. ``langs``: the languages that
    the text counts for ("default" for the text itself, "all" for universal ones); ``numbers``: whether the feature has house numbers."""
    f = complete(features)
    own = F.transform_keys(F.map_filter("text_lang", lambda k, v: v.isNotNull() & (k != DEFAULT)), lambda k, v: F.replace(k, F.lit("-"), F.lit("_")))
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    numbers = (F.coalesce(F.size("points"), F.lit(-1)) > 0) | (F.coalesce(F.size("ranges"), F.lit(-1)) > 0)
    numbers = numbers & F.col("source").isin([s.name for s in layers if s.is_address])
    rows = f.select("source", "id", F.coalesce("stack", F.lit("")).alias("stack"), numbers.alias("numbers"), F.map_keys(own).alias("has"), F.explode(F.map_concat(F.create_map(F.lit(DEFAULT), F.col("text")), own)).alias("lang", "texts"))
    rows = rows.select("source", "id", "stack", "numbers", "has", "lang", F.posexplode(F.split("texts", ",")).alias("syn", "text"))
    everywhere = F.col("lang") == "universal"
    if cats := {s.name: strings(c.lower() for c in s.categories) for s in layers if s.categories}:
        everywhere = everywhere | (F.col("syn") > 0) & F.coalesce(F.array_contains(by_layer(cats), F.lower(F.trim("text"))), F.lit(False))
    langs = F.array(F.when(everywhere, F.lit(EVERY)).otherwise(F.col("lang")))
    if auto := {s.name: F.try_element_at(F.create_map(*[x for k, v in s.autopopulate.items() for x in (F.lit(k), strings(v))]), F.col("stack")) for s in layers if s.autopopulate}:
        more = F.array_except(F.coalesce(by_layer(auto), strings([])), F.col("has"))
        langs = F.when(F.col("lang") == DEFAULT, F.concat(langs, more)).otherwise(langs)
    text = by_layer({s.name: replace_patterns("text", s.patterns) for s in layers if s.patterns}, F.col("text"))
    return rows.select("source", "id", "lang", "syn", langs.alias("langs"), "numbers", tokenize(normalize_text(text)).alias("tokens")).where(F.size("tokens") > 0)


def with_replacements(texts: DataFrame, layers: list[Source]) -> DataFrame:
    """Adds variant and reduced: simple words replaced, and a row for each variant of the other rules of a layer."""
    groups: dict[str, list[Source]] = {}
    for s in layers:
        if s.tokens:
            groups.setdefault(json.dumps(s.tokens), []).append(s)
    plain = texts.where(~F.col("source").isin([s.name for g in groups.values() for s in g])) if groups else texts
    out = plain.withColumns({"variant": F.lit(0), "reduced": F.lit(False)})
    rest = [c for c in texts.columns if c != "tokens"]
    for group in groups.values():
        own = texts.where(F.col("source").isin([s.name for s in group]))
        simple, complex_ = rewrite.categorize(group[0].tokens)
        if complex_:
            made = rewrite.replaced_variants("tokens", rewrite.compile_rules(complex_, inverse=True))
            own = own.select(*rest, F.posexplode(made).alias("variant", "v")).select(*rest, "v.tokens", "variant", "v.reduced")
        else:
            own = own.withColumns({"variant": F.lit(0), "reduced": F.lit(False)})
        out = out.unionByName(own.withColumn("tokens", replace_words("tokens", simple)))
    return out.where(F.size("tokens") > 0)


def with_numbers(texts: DataFrame) -> DataFrame:
    """Features with house numbers twice: as they are, and behind a token that stands for the masks of their numbers."""
    rows = texts.withColumn("numbered", F.explode(F.when(F.col("numbers"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return rows.withColumn("tokens", F.when(F.col("numbered"), F.concat(strings([NUMBER]), F.col("tokens"))).otherwise(F.col("tokens")))


def number_masks(features: DataFrame) -> DataFrame:
    """source, id, mask: the masks of a feature's house numbers, of points and of ranges."""
    none = strings([])
    spans = F.transform("ranges", lambda r: F.concat(F.coalesce(address.range_buckets(r["lf"], r["lt"]), none), F.coalesce(address.range_buckets(r["rf"], r["rt"]), none)))
    points = address.number_buckets(F.transform("points", lambda p: p["num"]))
    every = F.array_distinct(F.concat(F.coalesce(points, none), F.coalesce(F.flatten(spans), none)))
    return complete(features).select("source", "id", F.explode(every).alias("mask"))


def term_frequency(texts: DataFrame) -> DataFrame:
    """source, term, n, total: occurrences of a term, and of all terms, in a source."""
    counts = texts.select("source", F.explode("tokens").alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "source")  # one row per source


def top_scores(features: DataFrame, layers: list[Source]) -> dict[str, float]:
    """The score that a layer's are scaled by: the one stated, else the greatest of its documents."""
    stated = {s.name: s.maxscore for s in layers if s.maxscore is not None}
    if len(stated) == len(layers):
        return stated
    found = complete(features).where(~F.col("source").isin(list(stated))).groupBy("source").agg(F.max("score").alias("m")).collect()  # a row per layer
    return {r.source: r.m for r in found if r.m is not None} | stated


def weighted(texts: DataFrame, freq: DataFrame) -> DataFrame:
    """Adds ``weights``: each token's ln(1 + total / n) over their sum; number masks have 0.2 and leave 0.8. Frequencies of up to
    ``joins.BROADCAST_ROWS`` terms are broadcast; of more, frequent terms are spread over salts."""
    keys = [c for c in texts.columns if c != "tokens"]
    flat = texts.select(*keys, F.posexplode("tokens").alias("pos", "term"))
    stored = materialize(freq, "frequencies")
    met = hot_join(flat, stored, ["source", "term"], stored.select("source", "term", "n"), "left")
    raw = F.when(F.contains("term", F.lit("#")), F.lit(None)).otherwise(F.ln(1 + F.coalesce("total", F.lit(1)) / F.coalesce("n", F.lit(1))))
    rows = met.select(*keys, F.struct("pos", "term", raw.alias("w")).alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    total = F.aggregate("ts", F.lit(0.0), lambda a, t: a + F.coalesce(t["w"], F.lit(0.0)))
    masks = F.exists("ts", lambda t: t["w"].isNull())
    return rows.select(
        *keys, F.transform("ts", lambda t: t["term"]).alias("tokens"),
        F.transform("ts", lambda t: F.when(t["w"].isNull(), 0.2).otherwise(t["w"] / total * F.when(masks, 0.8).otherwise(1.0))).alias("weights"),
    )


def permutations(texts: DataFrame, frequent: Column | None = None) -> DataFrame:
    """Token subsets (contiguous ones beyond eight tokens) with relevance in fifths: adds mask, phrase_tokens, relev.
    ``frequent``: words that may be left out of a text, one at a time, at no less than 0.8."""
    n = F.size("tokens")
    masks = F.when(n <= MAX_ALL_SUBSETS, bits.all_masks(n)).otherwise(bits.contiguous_masks(n))
    rows = texts.withColumn("mask", F.explode(masks))
    total = F.aggregate(bits.masked("weights", "mask"), F.lit(0.0), lambda a, w: a + w)
    rows = rows.withColumns({"phrase_tokens": bits.masked("tokens", "mask"), "relev": F.floor(total * 5 + 0.5) / 5})
    relev = F.col("relev")
    if frequent is not None:
        without = F.array_except(F.col("tokens"), F.col("phrase_tokens"))
        relev = F.when((F.size("phrase_tokens") == n - 1) & F.coalesce(F.arrays_overlap(without, frequent), F.lit(False)), F.greatest(F.lit(MIN_RELEVANCE), relev)).otherwise(relev)
    if "reduced" in texts.columns:
        relev = F.when(F.col("reduced") & (F.size("phrase_tokens") == n), F.lit(MIN_RELEVANCE)).otherwise(relev)
    return rows.withColumn("relev", relev)


def indexable_phrases(texts: DataFrame, layers: list[Source] | tuple[Source, ...] = ()) -> DataFrame:
    """source, id, phrase, relev, langs: phrases of relevance 0.8 or more, the highest of equal ones."""
    words = {s.name: strings(w.lower() for w in s.frequent_words) for s in layers if s.frequent_words}
    made = permutations(texts, by_layer(words) if words else None).where(F.col("relev") >= MIN_RELEVANCE)
    if "numbered" in texts.columns:
        made = made.where(~F.col("numbered") | (F.col("mask") % 2 == 1))  # without the number it is the plain text's
    rows = made.select("source", "id", "langs", normalize_text(F.array_join("phrase_tokens", " ")).alias("phrase"), "relev")
    return rows.groupBy("source", "id", "phrase").agg(F.max("relev").alias("relev"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("langs")))).alias("langs"))  # a text has few languages


def with_number_masks(phrases: DataFrame, features: DataFrame) -> DataFrame:
    """Phrases that begin with the token for numbers, once for each mask of their feature."""
    held = F.startswith("phrase", F.lit(NUMBER + " "))
    masked = phrases.where(held).join(number_masks(features), ["source", "id"]).withColumn("phrase", F.concat("mask", F.substring("phrase", 2, 1 << 20))).select(*phrases.columns)
    return phrases.where(~held & (F.col("phrase") != NUMBER)).unionByName(masked)


def crossing_phrases(texts: DataFrame, features: DataFrame, layers: list[Source]) -> DataFrame:
    """source, id, phrase, relev, langs: '+intersection <crossing street> , <street>' for each crossing of a feature."""
    named = complete(features).select("source", "id", F.posexplode(F.transform("intersections", lambda x: x["name"])).alias("syn", "name"))
    names = named.select("source", "id", F.lit(DEFAULT).alias("lang"), "syn", tokenize(normalize_text("name")).alias("tokens"))
    names = with_replacements(names, layers).where(~F.col("reduced")).select("source", "id", F.array_join("tokens", " ").alias("crossing"))
    met = texts.where(~F.col("reduced")).select("source", "id", "langs", F.array_join("tokens", " ").alias("street")).join(names, ["source", "id"])
    rows = met.select("source", "id", "langs", intersection_text("crossing", "street")[0].alias("phrase"))
    return rows.groupBy("source", "id", "phrase").agg(F.lit(1.0).alias("relev"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("langs")))).alias("langs"))


def filled_languages(phrases: DataFrame, layers: list[Source]) -> DataFrame:
    """Phrases (source, id, phrase, langs) that also count for the languages of their layer that the feature lacks: those of the
    nearest language that it has."""
    wanted = {s.name: lang.fallback_matrix([x.replace("-", "_") for x in s.languages]) for s in layers if s.languages}
    if not wanted:
        return phrases
    pair = "array<struct<lang:string,near:array<string>>>"
    table = by_layer({k: F.array(*[F.struct(F.lit(w).alias("lang"), strings(c).alias("near")) for w, c in m.items()]).cast(pair) for k, m in wanted.items()})
    has = F.array_distinct(F.flatten(F.collect_list("langs").over(Window.partitionBy("source", "id"))))  # one feature's phrases
    lacking = F.filter(F.coalesce(table, F.array().cast(pair)), lambda w: ~F.array_contains("__has", w["lang"]))
    lent = F.transform(lacking, lambda w: F.struct(w["lang"].alias("lang"), F.get(F.filter(w["near"], lambda c: F.array_contains("__has", c)), F.lit(0)).alias("source")))
    more = F.transform(F.filter(lent, lambda p: p["source"].isNotNull() & F.array_contains("langs", p["source"])), lambda p: p["lang"])
    return phrases.withColumn("__has", has).withColumn("langs", F.array_sort(F.array_union("langs", more))).drop("__has")


def postings(phrases: DataFrame, features: DataFrame, sources: DataFrame, layers: list[Source] | None = None) -> DataFrame:
    """One row per phrase, feature and tile: source, phrase, id, relev, langs, score (3 bits), x, y."""
    tops = top_scores(features, layers or layers_of(sources))
    f = features if "score" in features.columns else features.withColumn("score", F.lit(None).cast("double"))
    f = shapes.tiles_of(f.join(F.broadcast(sources.select("source", "zoom")), "source"))  # a row per layer
    top = by_layer({k: F.lit(float(v)) for k, v in tops.items()}, F.lit(1.0))
    f = f.select("source", "id", bits.encode_log_scale("score", top).alias("score"), F.col("t.x").alias("x"), F.col("t.y").alias("y"))
    return phrases.join(f, ["source", "id"]).select("source", "phrase", "id", "relev", "langs", "score", "x", "y")


def texts_of(features: DataFrame, layers: list[Source]) -> DataFrame:
    """All texts that are indexed, replacements made."""
    return with_replacements(synonyms(features, layers), layers)


def phrases_of(features: DataFrame, layers: list[Source]) -> DataFrame:
    """source, id, phrase, relev, langs of feature documents."""
    texts = texts_of(features, layers)
    addressed = any(s.is_address for s in layers)
    made = weighted(with_numbers(texts) if addressed else texts, term_frequency(texts))
    found = indexable_phrases(made, layers)
    if addressed:
        found = with_number_masks(found, features)
    if any(s.intersection_token for s in layers) and "intersections" in features.columns:
        found = found.unionByName(crossing_phrases(texts, features, layers))
    return filled_languages(found, layers)


def build(features: DataFrame, sources: DataFrame, on_error: str = "fail") -> Index:
    """The index of feature documents (source, id, text, lon, lat, and columns of ``schema.OPTIONAL``). ``on_error``: what becomes of a
    document that fails ``validate.errors``: "fail" the job or "drop" it."""
    layers = layers_of(sources)
    docs = validate.standardized(validate.accepted(features, on_error), layers, set(features.columns)).select(*features.columns)
    docs = materialize(docs, "documents")
    grid = materialize(postings(phrases_of(docs, layers), docs, sources, layers), "grid")
    return Index(sources, docs, materialize(grid.select("source", "phrase").distinct(), "phrases"), grid)


def merge(old: Index, changed: DataFrame, on_error: str = "fail") -> Index:
    """The index with changed documents put in the place of those of the same (source, id). Only they are indexed, by the
    term frequencies among themselves; other postings stay as they are."""
    new = build(changed, old.sources, on_error)
    gone = new.features.select("source", "id").distinct()
    stays = lambda table: table.join(gone, ["source", "id"], "left_anti")
    features = materialize(stays(old.features).unionByName(new.features, allowMissingColumns=True), "documents")
    grid = materialize(stays(old.grid).unionByName(new.grid), "grid")
    return Index(old.sources, features, materialize(grid.select("source", "phrase").distinct(), "phrases"), grid)


def phrase_ids(phrases: DataFrame) -> DataFrame:
    """Adds phrase_id: rank of the phrase within its source. Ranges are ranked apart and offset by what comes
    before, so no source is sorted in one task; they are stored, so that every reader sees the same ones."""
    spark = phrases.sparkSession
    parts = spark.sparkContext.defaultParallelism
    ranged = materialize(phrases.distinct().repartitionByRange(max(2, parts), "source", "phrase").withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy("phrase")) - 1
    return ranged.withColumn("own", own).join(before, ["source", "part"]).select("source", "phrase", (F.col("own") + F.col("offset")).alias("phrase_id"))


def phrase_bins(ids: DataFrame, bins: int = 8192) -> DataFrame:
    """source, bin, first, last, low, high: phrases with ids cut into bins of consecutive ones, by ids and by phrase, so that
    the phrases of a prefix lie in a few neighbouring bins."""
    n = ids.groupBy("source").agg((F.max("phrase_id") + 1).alias("n"))
    bin_ = F.floor(F.col("phrase_id") * F.least(F.lit(bins), F.col("n")) / F.col("n")).cast("int")
    return ids.join(F.broadcast(n), "source").groupBy("source", bin_.alias("bin")).agg(F.min("phrase_id").alias("first"), F.max("phrase_id").alias("last"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))  # n: a row per source


def prefix_table(phrases: DataFrame) -> DataFrame:
    """source, prefix, phrase for every prefix of every phrase."""
    n = F.length("phrase")
    return phrases.select("source", "phrase", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("phrase", F.lit(1), k))).alias("prefix"))


def deletion_table(phrases: DataFrame) -> DataFrame:
    """source, variant, phrase: each phrase under itself and its one-character deletions."""
    return phrases.select("source", "phrase", F.explode(deletions("phrase")).alias("variant"))


def statistics(grid: DataFrame) -> DataFrame:
    """Counts of postings by score, by relevance, and in all: kind, value, n."""
    sets = grid.groupingSets([["score"], ["relev"], []], "score", "relev").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "score").when(F.col("g") == 2, "relev").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce(F.col("score").cast("double"), F.col("relev")).alias("value"), "n")


def upsert(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Features of both; of equal (source, id) the one of the highest ``version``, and of equal versions the last in the order of the other
    columns, as text."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("source", "id", version)]
    order = F.struct(F.col(version), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    return both.groupBy("source", "id").agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("r"), F.max(version).alias(version)).select("source", "id", version, "r.*")

"""Results: which of a feature's texts matched, keys that tell results apart, and what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.config import Source
from waymark.functions.geo import let
from waymark.functions.lang import closest_label
from waymark.functions.template import formatted
from waymark.operators.filters import in_language

SHARD_BASE = 16


def matching_text(texts, asked) -> Column:
    """Of a comma-separated list of synonyms the one closest to the matched phrase by edit distance, the first
    of equals; null if that is the first synonym, which needs no mention."""
    t = F.split(F.col(texts) if isinstance(texts, str) else texts, ",")
    a = F.lower(F.col(asked) if isinstance(asked, str) else asked)
    ranked = F.transform(t, lambda x, i: F.struct(F.levenshtein(F.lower(F.trim(x)), a).alias("d"), i.alias("i"), F.trim(x).alias("t")))
    best = F.array_min(ranked)
    return F.when(best["i"] > 0, best["t"])


def crossing_street(texts, asked) -> Column:
    """The last synonym of a street that contains the asked words."""
    t = F.split(F.col(texts) if isinstance(texts, str) else texts, ",")
    a = F.lower(F.col(asked) if isinstance(asked, str) else asked)
    return F.trim(F.try_element_at(F.filter(t, lambda x: F.contains(F.lower(x), a)), F.lit(-1)))


def is_short_address(text) -> Column:
    """Numbers typed so far with at most two characters more."""
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"^[\d#]+\s*\S{0,2}$"))


def address_key(phrases, parents) -> Column:
    """Key of an address result: the matched phrases, then the ids of its parents."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (phrases, parents))
    return F.concat(F.lit("_"), F.array_join(F.concat(F.array(F.concat(F.lit(" "), F.array_join(p, " "))), q), ":"))


def shard(level: int, id_) -> Column:
    """Number of the shard of an id at a level."""
    i = F.col(id_) if isinstance(id_, str) else id_
    interval = min(64, SHARD_BASE ** (4 - level))
    return F.floor((i % (interval * SHARD_BASE ** (level + 1))) / interval).cast("bigint")


def dedupe_addresses(rows: DataFrame) -> DataFrame:
    """The first result of each (query, feature, house number)."""
    w = Window.partitionBy("query_id", "tmpid", "address").orderBy("rank")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def with_overrides(parents, overrides, types) -> Column:
    """Parents' texts with those an address overrides: map type -> text over an array of struct(type, text)."""
    p, o = (F.col(x) if isinstance(x, str) else x for x in (parents, overrides))
    known = F.transform(p, lambda x: F.struct(x["type"].alias("type"), F.coalesce(F.try_element_at(o, x["type"]), x["text"]).alias("text")))
    return known if types is None else F.filter(known, lambda x: x["type"].isin(types))


def override_boost(relevance, overrides, peers) -> Column:
    """A twentieth more relevance where a peer (struct(type, text)) bears out an override, up to 1."""
    o, p = (F.col(x) if isinstance(x, str) else x for x in (overrides, peers))
    borne = F.exists(p, lambda x: F.coalesce(F.lower(F.try_element_at(o, x["type"])) == F.lower(x["text"]), F.lit(False)))
    r = F.col(relevance) if isinstance(relevance, str) else relevance
    return F.when(F.coalesce(borne, F.lit(False)), F.least(r + 0.05, F.lit(1.0))).otherwise(r)


def with_indexes(rows: DataFrame) -> DataFrame:
    """Adds sources: the layers that a query's results, contexts included, come from."""
    every = F.array_distinct(F.flatten(F.collect_set(F.transform("context", lambda c: c["source"])).over(Window.partitionBy("query_id"))))  # at most ten results
    return rows.withColumn("sources", F.array_sort(every))


def displayed(texts: Column, text: Column, language: str | None) -> Column:
    """struct(language, text): the name that a feature goes by in a language, its first synonym; its own text where it has none near."""
    plain = F.struct(F.lit(None).cast("string").alias("language"), F.trim(F.split(text, ",")[0]).alias("text"))
    if not language:
        return plain
    near = closest_label(texts, language)
    return F.when(near.isNotNull(), F.struct(F.replace(near["language"], F.lit("_"), F.lit("-")).alias("language"), F.trim(F.split(near["text"], ",")[0]).alias("text"))).otherwise(plain)


def templates(layers: list[Source], context: Column, language: str | None, own_formats: bool = False) -> Column:
    """The template for a context (array of ITEM): the target's own one (with ``own_formats``: items have formats), else its layer's; one
    in the language only where something in the context has a text in it."""
    head = F.get(context, F.lit(0))
    layer = F.lit(None).cast("map<string,string>")
    for s in layers:
        if s.formats:
            layer = F.when(head["source"] == s.name, F.create_map(*[F.lit(x) for k, v in s.formats.items() for x in (k.replace("-", "_"), v)])).otherwise(layer)

    def choose(m: Column) -> Column:
        default = F.try_element_at(m, F.lit(""))
        if not language:
            return default
        spoken = F.exists(context, lambda c: closest_label(c["text_lang"], language).isNotNull())
        return F.coalesce(F.when(spoken, closest_label(F.map_filter(m, lambda k, v: k != ""), language)["text"]), default)

    return F.coalesce(choose(head["formats"]), choose(layer)) if own_formats else choose(layer)


def with_names(rows: DataFrame, layers: list[Source], languages: list[str] | None = None, strict: bool = False, helpers: dict | None = None) -> DataFrame:
    """Adds text, language, place_name, and, with languages, names: language -> struct(text, language, place_name). ``context``: array of ITEM
    from the target up; ``address``: its house number or null; ``crossing_name``: the street it crosses, or null."""
    kind = rows.schema["context"].dataType.elementType
    context = F.col("context")
    own_formats = "formats" in kind.fieldNames()
    head = F.get(context, F.lit(0))
    token = F.lit(None).cast("string")
    for s in layers:
        if s.intersection_token:
            token = F.when(head["source"] == s.name, s.intersection_token).otherwise(token)
    use_templates = own_formats or any(s.formats for s in layers)

    def named(language: str | None, matched: bool = False) -> tuple[Column, Column]:
        kept = F.filter(context, lambda c: in_language(c["text_lang"], [language], True)) if strict and language else context

        def name(c: Column, i: Column) -> Column:
            shown = displayed(c["text_lang"], c["text"], language)["text"]
            shown = F.coalesce(F.when(i == 0, F.concat(F.col("crossing_name"), F.lit(" "), token, F.lit(" "), shown)), shown)
            return F.coalesce(F.when(i == 0, F.col("matching_text")), shown) if matched else shown

        parts = F.transform(kept, lambda c, i: F.struct(c["type"].alias("type"), name(c, i).alias("name"), F.when(i == 0, F.col("address")).alias("number")))
        plain = F.concat(F.coalesce(F.concat(F.col("address"), F.lit(" ")), F.lit("")), F.array_join(F.transform(parts, lambda p: p["name"]), ", "))
        if not use_templates:
            return displayed(head["text_lang"], head["text"], language), F.trim(plain)
        template = templates(layers, context, language, own_formats)
        return displayed(head["text_lang"], head["text"], language), F.when(template.isNull(), F.trim(plain)).otherwise(formatted(parts, template, helpers))

    shown, place = named(languages[0] if languages else None)
    out = rows.withColumns({"text": shown["text"], "language": shown["language"], "place_name": place})
    if languages:
        every = []
        for code in languages:
            s, p = named(code)
            every += [F.lit(code), F.struct(s["text"].alias("text"), s["language"].alias("language"), p.alias("place_name"))]
        out = out.withColumn("names", F.create_map(*every))
    if "matching_text" in rows.columns:
        out = out.withColumn("matching_place_name", F.when(F.col("matching_text").isNotNull(), named(languages[0] if languages else None, True)[1]))
    return out


def matching_name(texts: Column, text: Column, asked: Column, shown: Column, categories: Column | None = None) -> Column:
    """The synonym, in whatever language, that a matched phrase is closest to; null if it is what is shown, or a category."""
    every = F.concat(F.split(text, ","), F.coalesce(F.flatten(F.transform(F.map_values(texts), lambda v: F.split(v, ","))), F.array().cast("array<string>")))
    a = F.lower(asked)

    def ranked(v: Column) -> Column:
        return F.array_min(F.transform(v["e"], lambda x, i: F.struct(F.levenshtein(F.lower(F.trim(x)), v["a"]).alias("d"), i.alias("i"), F.trim(x).alias("t"))))["t"]

    best = let(F.struct(every.alias("e"), a.alias("a")), ranked)
    plain = F.when((best != shown) & asked.isNotNull(), best)
    return plain if categories is None else F.when(~F.coalesce(F.array_contains(categories, F.lower(plain)), F.lit(False)), plain)

"""Phrase matching and stacking of a whole table of queries.

Every step is keyed by query_id, so a batch of queries is one job."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.config import Source
from waymark.functions import bits, geo, lang, rewrite
from waymark.functions.text import (
    MAX_QUERY_CHARS, MAX_QUERY_TOKENS, SEPARATORS, damerau_within_one, deletions, normalize_text, number_variants, replace_patterns, replace_words, split_number_and_letters, tokenize,
)
from waymark.operators.index import DEFAULT, EVERY, Index, by_layer, deletion_table, prefix_table
from waymark.sources.scratch import materialize

MIN_CORRECTION, MAX_FUZZY_TOKENS = 4, 8
MAX_SHORT_CORRECTIONS, SHORT_PHRASE = 6, 6
EXACT_LETTER_ZOOM = 14
LANGUAGE_PENALTY = 0.96


def tokenized(queries: DataFrame, layers: list[Source] | tuple[Source, ...] = ()) -> DataFrame:
    """Adds tokens, n and boundary (whether the last word is complete); queries of no or too many tokens or characters are left out."""
    patterns = {k: v for s in layers for k, v in s.patterns.items()}
    q = queries.where(F.length("query") <= MAX_QUERY_CHARS)
    t = q.withColumn("tokens", tokenize(normalize_text(replace_patterns("query", patterns)))).withColumn("n", F.size("tokens"))
    return t.withColumn("boundary", F.rlike("query", F.lit(f"[{SEPARATORS}]$"))).where((F.col("n") > 0) & (F.col("n") <= MAX_QUERY_TOKENS))


def rule_groups(layers: list[Source] | tuple[Source, ...]) -> list[tuple[dict, list[Source]]]:
    """The distinct replacement rules, each with its layers."""
    groups: dict[str, tuple[dict, list[Source]]] = {}
    for s in layers:
        groups.setdefault(json.dumps(s.tokens), (s.tokens, []))[1].append(s)
    return list(groups.values()) or [({}, [])]


def hypotheses(queries: DataFrame, layers: list[Source] | tuple[Source, ...], fuzzy: bool = True) -> DataFrame:
    """What a query may have meant in each group of layers (number g): tokens after the group's rules, owner (for each the number of the
    typed token it came from), gaps (masks that take in tokens which vanished), edits made so far, rewritten_end (whether its last
    word was replaced). In groups with address layers also the query with words cut from numbers (corrected)."""
    if "boundary" not in queries.columns:
        queries = queries.withColumn("boundary", F.lit(False))
    base = queries.select("query_id", "n", "boundary", "tokens", F.sequence(F.lit(0), F.col("n") - 1).alias("owner"), F.lit(0).alias("edits"), F.lit(False).alias("corrected"))
    parts = F.flatten(F.transform("tokens", lambda t, i: F.transform(F.split(split_number_and_letters(t), " "), lambda x: F.struct(x.alias("t"), i.alias("o")))))
    apart = base.withColumn("p", parts).where((F.size("p") > F.col("n")) & (F.col("n") <= MAX_FUZZY_TOKENS))
    apart = apart.select("query_id", "n", "boundary", F.transform("p", lambda x: x["t"]).alias("tokens"), F.transform("p", lambda x: x["o"]).alias("owner"), F.lit(1).alias("edits"), F.lit(True).alias("corrected"))
    out = None
    for g, (rules, own) in enumerate(rule_groups(layers)):
        rows = base.unionByName(apart) if fuzzy and any(s.is_address for s in own) else base
        simple, complex_ = rewrite.categorize(rules)
        changed = F.lit(False)
        if complex_:
            made = rows.withColumn("r", rewrite.replaced_with_owner("tokens", rewrite.query_rules(complex_)))
            rows = made.withColumns({"owner": F.transform("r.owner", lambda i: F.get("owner", i)), "before": F.col("tokens"), "tokens": F.col("r.tokens")}).drop("r").where(F.size("tokens") > 0)
            changed = F.element_at("before", -1) != F.element_at("tokens", -1)
        words = replace_words("tokens", simple)
        changed = changed | (F.element_at(words, -1) != F.element_at("tokens", -1))
        held = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(F.array_contains("owner", i), "x").otherwise(""))
        gaps = bits.gap_masks(held) if complex_ else F.array().cast("array<bigint>")
        one = rows.select("query_id", "n", F.lit(g).alias("g"), "boundary", words.alias("tokens"), "owner", gaps.alias("gaps"), "edits", "corrected", changed.alias("rewritten_end"))
        out = one if out is None else out.unionByName(one)
    return out


def address_permutations(rows: DataFrame) -> DataFrame:
    """Spans (terms, ender, mask) of queries with a masked house number: without those that have it in their middle, each once, longest first
    in ``place``."""
    inside = F.exists(F.slice("terms", 2, F.greatest(F.size("terms") - 2, F.lit(0))), lambda t: F.contains(t, F.lit("#")))
    kept = rows.where(~inside).dropDuplicates(["query_id", "terms", "ender", "mask"])
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.size("terms")), "mask", F.array_join("terms", " "))))


def crossing_spans(hyps: DataFrame, token: str) -> DataFrame:
    """Spans from the start of a query on that name a crossing, '<street> <token> <other street>', as the index has them."""
    n = F.size("tokens")
    pairs = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (F.get("tokens", i) == token) & (i < n - 1)),
            lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    words = lambda a, k: F.array_join(F.slice("tokens", a, k), " ")
    rows = hyps.where(n >= 3).withColumn("p", F.explode(pairs))
    phrase = F.concat(F.lit("+intersection "), words(F.lit(1), F.col("p.i")), F.lit(" , "), words(F.col("p.i") + 2, F.col("p.j") - F.col("p.i")))
    last = F.when(F.col("p.j") == n - 1, F.col("n") - 1).otherwise(F.get("owner", F.col("p.j")))
    return rows.select("query_id", "n", "g", "boundary", "edits", "corrected", "rewritten_end", bits.span_mask(F.lit(0), last + 1).alias("mask"), (F.col("p.j") + 1).alias("size"), phrase.alias("phrase"), (F.col("p.j") == n - 1).alias("ender"), F.lit("").alias("number"), F.lit(-1).alias("at"), F.lit("").alias("number_order"))


def spans(queries: DataFrame, layers: list[Source] | tuple[Source, ...] = (), fuzzy: bool = True) -> DataFrame:
    """A row per contiguous span of tokens: query_id, n, g, mask, size, phrase, ender, edits; for address layers also spans whose first or
    last token is a house number, masked and in front, with number, at (its place in the query) and number_order."""
    hyps = hypotheses(queries, layers, fuzzy)
    groups = rule_groups(layers)
    plain = hyps.withColumns({"number": F.lit(""), "at": F.lit(-1)})
    with_address = [g for g, (_, own) in enumerate(groups) if any(s.is_address for s in own)]
    if with_address:
        tried = hyps.where(F.col("g").isin(with_address) & (F.size("tokens") > 1))
        rest = [c for c in hyps.columns if c != "tokens"]
        numbered = tried.select(*rest, F.explode(number_variants("tokens")).alias("v")).select(*rest, "v.tokens", F.col("v.number").alias("number"), F.col("v.position").alias("at"))
        plain = plain.unionByName(numbered)
    rows = plain.withColumn("m", F.explode(bits.contiguous_masks(F.size("tokens"))))
    low, size = bits.low_bit("m"), F.bit_count("m").cast("int")
    rows = rows.withColumns({"low": low, "high": low + size - 1, "size": size})
    at = F.col("at")
    rows = rows.where((at < 0) | ((F.col("size") > 1) & ((at == F.col("low")) | (at == F.col("high")))))
    rows = rows.where(bits.covers_windows("m", bits.required_masks("owner")))
    terms, turned = bits.masked("tokens", "m"), (at == F.col("high")) & (at >= 0)
    terms = F.when(turned, F.concat(F.slice(terms, -1, 1), F.slice(terms, 1, F.col("size") - 1))).otherwise(terms)
    end = F.col("high") == F.size("tokens") - 1
    first, last = F.get("owner", F.col("low")), F.when(end, F.col("n") - 1).otherwise(F.get("owner", F.col("high")))
    mask = bits.span_mask(first, last - first + 1)
    out = rows.select(
        "query_id", "n", "g", "boundary", "edits", "corrected", "rewritten_end", F.explode(bits.cover_gaps(mask, "gaps")).alias("mask"), "size", F.array_join(terms, " ").alias("phrase"), (end & ~turned).alias("ender"),
        "number", F.when(at >= 0, F.get("owner", at)).otherwise(-1).alias("at"), F.when(at < 0, "").when(turned, "last").otherwise("first").alias("number_order"),
    )
    for g, (_, own) in enumerate(groups):
        for token in {s.intersection_token for s in own if s.intersection_token}:
            out = out.unionByName(crossing_spans(hyps.where(F.col("g") == g), token))
    return out


def owned(owner, mask) -> Column:
    """Whether a span starts and ends where tokens of the query as typed do: replacements share their owner."""
    return bits.covers_windows(mask, bits.required_masks(owner))


def not_only_number(phrase) -> Column:
    """In address layers a house number by itself is no match."""
    return ~F.rlike(F.col(phrase) if isinstance(phrase, str) else phrase, F.lit("^[0-9#]+$"))


def without_single_letters(matches: DataFrame, letter: str = "phrase") -> DataFrame:
    """Matches of one letter go where a query has longer ones of the same layer."""
    w = Window.partitionBy("query_id", "source")
    longer = F.max((F.length(letter) > 1).cast("int")).over(w)
    return matches.withColumn("_l", longer).where((F.length(letter) > 1) | (F.col("_l") == 0)).drop("_l")


def exact_matches(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    return asked.withColumnRenamed("phrase", "asked").join(phrases, F.col("asked") == F.col("phrase")).withColumns({"distance": F.lit(0), "prefix": F.lit(False)})


def prefix_matches(asked: DataFrame, phrases: DataFrame, word_boundary: bool | Column = False, table: DataFrame | None = None) -> DataFrame:
    """Phrases that a span at the end of a query begins; with ``word_boundary`` whole words only. ``table``: the stored prefixes."""
    table = prefix_table(phrases) if table is None else table
    found = asked.where("ender").withColumnRenamed("phrase", "asked").join(table, F.col("asked") == F.col("prefix")).drop("prefix")
    whole = F.startswith(F.concat("phrase", F.lit(" ")), F.concat("asked", F.lit(" ")))
    only = F.lit(word_boundary) if isinstance(word_boundary, bool) else word_boundary
    return found.where((F.col("phrase") != F.col("asked")) & (~only | whole)).withColumns({"distance": F.lit(0), "prefix": F.lit(True)})


def fuzzy_matches(asked: DataFrame, phrases: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Phrases one edit away, from the join of one-character deletions on both sides. ``table``: the stored deletions."""
    table = deletion_table(phrases) if table is None else table
    short = (F.col("size") == 1) & (F.length("phrase") < MIN_CORRECTION)
    left = asked.where((F.col("n") <= MAX_FUZZY_TOKENS) & ~short).withColumnRenamed("phrase", "asked").withColumn("variant", F.explode(deletions("asked")))
    found = left.join(table, "variant").where("phrase <> asked").drop("variant").distinct()
    return found.where(damerau_within_one("asked", "phrase")).withColumns({"distance": F.lit(1), "prefix": F.lit(False)})


def phrasematch(queries: DataFrame, index: Index, autocomplete: bool = True, fuzzy: bool = True, layers: list[Source] | None = None) -> DataFrame:
    """query_id, n, mask, size, source, phrase, asked, distance, prefix, weight, number, at."""
    layers = index.layers if layers is None else layers
    asked = spans(queries, layers, fuzzy)
    found = exact_matches(asked, index.phrases)
    if autocomplete:
        found = found.unionByName(prefix_matches(asked, index.phrases, F.col("boundary") | F.col("rewritten_end"), index.prefix_rows()))
    if fuzzy:
        near = fuzzy_matches(asked.where("edits = 0"), index.phrases, index.deletion_rows())
        # the mask of a number stays as it is
        same_number = (F.col("number") == "") | (F.split("asked", " ")[0] == F.split("phrase", " ")[0])
        found = found.unionByName(near.where(same_number & ~F.startswith("asked", F.lit("+intersection"))))
    groups = rule_groups(layers)
    of_group = F.lit(False)
    for g, (_, own) in enumerate(groups):
        of_group = of_group | (F.col("g") == g) & F.col("source").isin([s.name for s in own])
    address = F.col("source").isin([s.name for s in layers if s.is_address])
    found = found.where(of_group & (address | ~F.col("corrected"))).withColumn("distance", F.col("distance") + F.col("edits"))
    found = found.where(~address | not_only_number("asked"))
    # corrections of or to a single short word
    to_short = (F.length("phrase") < MIN_CORRECTION) & ~F.contains("phrase", F.lit(" ")) & (address | (F.abs(F.length("phrase") - F.length("asked")) <= 1))
    found = found.where(~((F.col("distance") > 0) & (F.col("size") == 1) & to_short))
    fine = F.col("source").isin([s.name for s in layers if s.zoom >= EXACT_LETTER_ZOOM])
    found = found.where(~(fine & (F.length(F.split("asked", " ")[0]) == 1) & (F.split("asked", " ")[0] != F.split("phrase", " ")[0])))
    if any(s.zoom >= EXACT_LETTER_ZOOM for s in layers):
        found = without_single_letters(found.where(fine), "asked").unionByName(found.where(~fine))
    # too many misspellings: corrections go where the same tokens also match as they are
    w = Window.partitionBy("query_id", "source", "mask")
    brief = (F.size(F.split("phrase", " ")) == 1) | (F.length("phrase") <= SHORT_PHRASE)
    exact = F.max((F.col("distance") == 0).cast("int")).over(w)
    corrected = F.count(F.when((F.col("distance") > 0) & brief, 1)).over(w)
    found = found.withColumns({"_e": exact, "_c": corrected}).where(~((F.col("distance") > 0) & brief & (F.col("_e") == 1) & (F.col("_c") > MAX_SHORT_CORRECTIONS))).drop("_e", "_c")
    expected = by_layer({s.name: F.lit(s.number_order) for s in layers if s.number_order}, F.lit(None).cast("string"))
    turned = F.coalesce((F.col("number_order") != "") & (F.col("number_order") != expected), F.lit(False))
    weight = bits.span_weight(F.bit_count("mask"), "n", "distance", F.length("asked"), turned)
    return found.select("query_id", "n", "mask", "size", "source", "phrase", "asked", "distance", "prefix", weight.alias("weight"), "number", "at")


def language_labels(layers: list[Source], language: str | None) -> dict[str, str]:
    """For each layer the language of its phrases that a query in ``language`` asks for: the nearest that the layer states."""
    if not language:
        return {s.name: DEFAULT for s in layers}
    out = {}
    for s in layers:
        known = {x.replace("-", "_").lower(): x.replace("-", "_") for x in s.languages}
        tries = [*lang.label_order(language)[:-1], *(x for x in sorted(known.values()) if lang.primary(x).lower() == lang.primary(language).lower())]
        out[s.name] = next((known[t.lower()] for t in tries if t.lower() in known), language.replace("-", "_"))
    return out


def covers(matches: DataFrame, index: Index, language: str | None = None, layers: list[Source] | None = None) -> DataFrame:
    """A row per matched feature and tile: the best per query, source, feature and mask."""
    layers = index.layers if layers is None else layers
    grid = index.grid.join(F.broadcast(index.sources.select("source", "idx", "ndx", "zoom", "maxscore", "apart")), "source")  # a row per layer
    label = by_layer({k: F.lit(v) for k, v in language_labels(layers, language).items()}, F.lit(DEFAULT))
    universal = F.col("source").isin([s.name for s in layers if s.universal_text])
    own = universal | F.col("langs").isNull() | F.array_contains("langs", label) | F.array_contains("langs", EVERY)
    found = matches.join(grid, ["source", "phrase"]).withColumns({"in_language": own, "entry": F.col("weight") * F.col("relev") * F.when(own, 1.0).otherwise(LANGUAGE_PENALTY)})
    keys = ["query_id", "n", "source", "idx", "ndx", "zoom", "id", "mask", "x", "y"]
    number = ["number", "at"] if "number" in matches.columns else []
    best = F.max(F.struct("entry", "score", "maxscore", "in_language", "prefix", "phrase", "apart", *number))
    out = found.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*").withColumn("tmpid", bits.tmpid("idx", "id"))
    return out if number else out.withColumns({"number": F.lit(""), "at": F.lit(-1)})


def stacks(found: DataFrame, zooms: list[int], depth: int) -> DataFrame:
    """All combinations of covers of different layers with disjoint masks whose tiles contain the finest one's: query_id,
    n, entries (finest first), relev, balanced. The finest member has the highest idx, and members join in falling order of idx,
    so each set of covers comes once. ``depth``: the number of logical layers, the most that a stack can have; levels end where one adds nothing."""
    entry = F.struct("idx", "ndx", "id", "tmpid", "mask", "entry", "score", "maxscore", "phrase", "zoom", "x", "y", "number", "at", "in_language")
    level = found.select("query_id", "n", F.array(entry).alias("entries"), F.col("mask").alias("used"), F.col("idx").alias("last"), F.array("ndx").alias("layers"), F.col("apart"), F.col("zoom").alias("z"), "x", "y")
    all_levels = level
    other = found.select(F.col("query_id").alias("q"), entry.alias("more"), F.col("mask").alias("m"), F.col("idx").alias("i"), F.col("ndx").alias("d"), F.col("apart").alias("ap"), F.col("zoom").alias("kz"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    for _ in range(depth - 1):
        up = level.withColumn("k", F.explode(F.filter(F.array(*[F.lit(z) for z in sorted(set(zooms))]), lambda z: z <= F.col("z"))))
        px, py = geo.parent_tile("x", "y", "z", "k")
        met = up.withColumns({"px": px, "py": py}).join(other, (F.col("query_id") == F.col("q")) & (F.col("k") == F.col("kz")) & (F.col("px") == F.col("kx")) & (F.col("py") == F.col("ky")))
        met = met.where((F.col("i") < F.col("last")) & (F.col("m").bitwiseAND(F.col("used")) == 0) & ~F.array_contains("layers", F.col("d")) & ~F.array_contains("apart", F.col("i")))
        level = met.select("query_id", "n", F.array_append("entries", F.col("more")).alias("entries"), F.col("used").bitwiseOR(F.col("m")).alias("used"), F.col("i").alias("last"), F.array_append("layers", F.col("d")).alias("layers"), F.array_union("apart", "ap").alias("apart"), "z", "x", "y")
        level = materialize(level, "level")  # else each level would join all before it again
        if level.isEmpty():
            break
        all_levels = all_levels.unionByName(level)
    all_levels = maximal(all_levels)
    balanced = bits.rebalance(F.transform("entries", lambda e: e["entry"]), F.transform("entries", lambda e: e["mask"]), "n")
    return all_levels.select("query_id", "n", "entries", "used", balanced.alias("b")).select("query_id", "n", "entries", "used", F.col("b.relev").alias("relev"), F.col("b.relevs").alias("balanced"))


def maximal(combined: DataFrame) -> DataFrame:
    """Only stacks that are no part of another of their query, each once however many tiles its members share: every stack strikes out those with one member less."""
    key = lambda a: F.array_join(F.array_sort(F.transform(a, lambda e: F.concat_ws(":", e["tmpid"], e["mask"]))), ",")
    parts = combined.where(F.size("entries") > 1).select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("entries") - 1), lambda i: key(F.filter("entries", lambda e, j: j != i)))).alias("key")).distinct()
    return combined.withColumn("key", key(F.col("entries"))).dropDuplicates(["query_id", "key"]).join(parts, ["query_id", "key"], "left_anti").drop("key")


def ranked_stacks(combined: DataFrame, most: int = 50) -> DataFrame:
    """Per query and target feature the best stack of each direction (a single one only if no direction came
    first), then the best ``most``: adds position. A column ``near`` takes the place of the score of the target's cover."""
    target = F.col("entries")[0]
    ascending = F.when(F.size("entries") > 1, F.when(target["mask"] < F.col("entries")[1]["mask"], 1).otherwise(2)).otherwise(0)
    idxs = F.transform("entries", lambda e: e["idx"].cast("double"))
    mean = F.aggregate(idxs, F.lit(0.0), lambda a, v: a + v) / F.size("entries")
    rows = combined.withColumns({"tmpid": target["tmpid"], "direction": ascending, "scoredist": F.col("near") if "near" in combined.columns else bits.decode_log_scale(target["score"], target["maxscore"]), "mean_idx": mean, "tie": F.to_json("entries")})
    order = [F.desc("relev"), F.desc("scoredist"), F.asc(F.col("entries")[0]["idx"]), F.asc((target["number"] == "").cast("int")), F.desc("mean_idx"), F.asc("tie")]
    first = F.row_number().over(Window.partitionBy("query_id", "tmpid", "direction").orderBy(*order))
    seen = F.max((F.col("direction") > 0).cast("int")).over(Window.partitionBy("query_id", "tmpid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumns({"_f": first, "_s": F.coalesce(seen, F.lit(0))}).where((F.col("_f") == 1) & ((F.col("direction") > 0) | (F.col("_s") == 0)))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.withColumn("position", position).where(F.col("position") <= most).drop("_f", "_s", "tie")


def best_covers(combined: DataFrame) -> DataFrame:
    """query_id, tmpid, and the cover of highest balanced relevance over all stacks."""
    flat = combined.select("query_id", F.inline(F.arrays_zip("entries", F.col("balanced")))).select("query_id", F.col("entries").alias("e"), F.col("balanced").alias("relev"))
    return flat.groupBy("query_id", F.col("e.tmpid").alias("tmpid")).agg(F.max(F.struct("relev", F.col("e.mask").alias("mask"), F.col("e.phrase").alias("phrase"))).alias("loose"))

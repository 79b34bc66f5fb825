"""Registered queries of sources, text and shape functions, address lookups and whole plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.config import Options, Source, catalog
from waymark.functions import address, bits, geo, rewrite, shapes, template
from waymark.functions import text as tx
from waymark.operators import filters, match, output
from waymark.operators import index as ix
from waymark.plans import geocode
from waymark.plans.queries import query, r6, sql_tile, table
from waymark.sources import readers

L = F.lit
POINT_SQL = "(select n_nationkey as k, cast(n_nationkey as double) as lon, n_nationkey / 2.0 as lat from nation)"


def nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").withColumns({"k": F.col("n_nationkey"), "lon": F.col("n_nationkey").cast("double"), "lat": F.col("n_nationkey") / 2.0})


def features_of(spark, d) -> DataFrame:
    """Nations as features on a diagonal."""
    return nations(spark, d).select(L("nation").alias("source"), F.col("k").cast("long").alias("id"), F.col("n_name").alias("text"), "lon", "lat", L(1.0).alias("score"))


@query("op_load", "select r_regionkey, r_name from region")
def op_load(spark, d):
    return readers.load(spark, f"parquet:{d}/region.parquet").select("r_regionkey", "r_name")


@query("op_load_directory", "select 'nation' as source, count(*) as n from nation union all select 'region', count(*) from region")
def op_load_directory(spark, d):
    found = readers.load_directory(spark, d)
    return found["nation"].agg(L("nation").alias("source"), F.count("*").alias("n")).unionByName(found["region"].agg(L("region").alias("source"), F.count("*").alias("n")))


@query("op_serialized", """select 'nation' as source, n_nationkey::bigint as shard, base64(encode('{"source":"nation","id":' || n_nationkey || ',"text":"' || n_name || '"}')) as data from nation""")
def op_serialized(spark, d):
    return readers.serialized(features_of(spark, d).select("source", "id", "text"))


@query("op_get_features", "select n_nationkey::bigint as id, n_name as text from nation where n_nationkey % 3 = 0")
def op_get_features(spark, d):
    keys = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(L("nation").alias("source"), F.col("n_nationkey").cast("long").alias("id"))
    return readers.get_features(features_of(spark, d), keys).select("id", "text")


@query("op_storable", "select 'nation' as source, n_nationkey::bigint as id, n_name as text, n_nationkey::double as lon, n_nationkey / 2.0 as lat, 1.0::double as score from nation")
def op_storable(spark, d):
    return readers.storable(features_of(spark, d).withColumn("other", L(1)))


@query("op_vectors", """select n_nationkey::bigint as id, '{"type":"Feature","id":' || n_nationkey || ',"geometry":{"type":"Point","coordinates":[' || n_nationkey || '.0,' || printf('%.1f', n_nationkey / 2.0) || ']},"properties":{"source":"nation","id":' || n_nationkey || ',"text":"' || n_name || '","score":1.0}}' as json from nation""")
def op_vectors(spark, d):
    return readers.vectors(features_of(spark, d)).select("id", "json")


@query("op_geojson", "select n_nationkey::bigint as id, n_name as text, n_name || ' de' as german, n_nationkey::double as lon, 2.5::double as lat, 7.0::double as score from nation")
def op_geojson(spark, d):
    n = table(spark, d, "nation")
    line = F.format_string('{"id":%d,"type":"Feature","properties":{"x:text":"%s","x:text_de":"%s de","x:score":7},"geometry":{"type":"Point","coordinates":[%d,2.5]}}', "n_nationkey", "n_name", "n_name", "n_nationkey")
    return readers.from_geojson(n.select(line.alias("value")), "nation").select("id", "text", F.col("text_lang")["de"].alias("german"), "lon", "lat", "score")


@query("op_normalize", "select n_nationkey, trim(strip_accents('Ä ' || n_name || ' é ö ñ')) as text from nation")
def op_normalize(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.normalize_text(F.concat(L("Ä  "), "n_name", L(" é  ö ñ 😀"))).alias("text"))


@query("op_global_patterns", "select p_partkey, regexp_replace(p_name, '(?i)[aeiou]+', '*', 'g') as text from part")
def op_global_patterns(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.replace_patterns("p_name", {"[aeiou]+": "*"}).alias("text"))


@query("op_simple_words", "select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda t: case t when 'blue' then 'bleu' when 'hot' then 'chaud' when 'rod' then 'tige' else t end), ' ') as text from part")
def op_simple_words(spark, d):
    rules = {"blue": "bleu", "hot": "chaud", "rod": "tige"}
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.replace_words(tx.tokenize("p_name"), rules), " ").alias("text"))


_RULES = {"(\\d+)th": "$1", "nation 1": "first", "nation 2": "second one"}


@query("op_replaced", "select n_nationkey, case n_nationkey when 1 then 'first' when 2 then 'second one' else 'nation ' || n_nationkey end || ' ' || n_nationkey as text from nation")
def op_replaced(spark, d):
    tokens = tx.tokenize(F.concat_ws(" ", L("Nation"), F.col("n_nationkey").cast("string"), F.concat(F.col("n_nationkey").cast("string"), L("th"))))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(rewrite.replaced(tokens, rewrite.compile_rules(_RULES)), " ").alias("text"))


@query("op_replacement_variants", "select n_nationkey, case when n_nationkey in (1, 2) then 2 else 1 end as n from nation")
def op_replacement_variants(spark, d):
    rules = rewrite.compile_rules({k: v for k, v in _RULES.items() if " " in k})
    tokens = tx.tokenize(F.concat_ws(" ", L("Nation"), F.col("n_nationkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", F.size(rewrite.replaced_variants(tokens, rules)).alias("n"))


@query("op_number_variants", "select c_custkey, 1 as n, case length(k) when 1 then '#' when 2 then '##' when 3 then k[1:1] || '##' else k[1:2] || repeat('#', length(k) - 2) end || ' main st' as text from (select c_custkey, c_custkey::varchar as k from customer)")
def op_number_variants(spark, d):
    v = tx.number_variants(tx.tokenize(F.concat(F.col("c_custkey").cast("string"), L(" main st"))))
    first = geo.let(v, lambda x: F.struct(F.size(x).alias("n"), F.array_join(x[0]["tokens"], " ").alias("text")))
    return table(spark, d, "customer").select("c_custkey", first.alias("first")).select("c_custkey", "first.n", "first.text")


@query("op_split_numbers", "select c_custkey, c_custkey || ' main' as a, c_custkey || 'th' as b from customer")
def op_split_numbers(spark, d):
    k = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", tx.split_number_and_letters(F.concat(k, L("main"))).alias("a"), tx.split_number_and_letters(F.concat(k, L("th"))).alias("b"))


@query("op_move_number", "select c_custkey, 'rue a ' || c_custkey as text from customer")
def op_move_number(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.move_number_to_end(F.concat(F.col("c_custkey").cast("string"), L(" rue a"))).alias("text"))


@query("op_text_alike", "select n_nationkey, n_regionkey, contains(r_name || ' ' || n_name, n_name) as alike, contains(r_name, n_name) as other from nation join region on n_regionkey = r_regionkey")
def op_text_alike(spark, d):
    r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("n_name", L(",x"))
    return r.select("n_nationkey", "n_regionkey", tx.text_alike(name, F.concat_ws(" ", "r_name", "n_name")).alias("alike"), tx.text_alike(name, "r_name").alias("other"))


@query("op_template", "select n_nationkey, n_name || ' (' || r_name || ')' as a, case when n_regionkey = 3 then 'EU' else r_name end as b from nation join region on n_regionkey = r_regionkey")
def op_template(spark, d):
    r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = lambda t, n: F.struct(L(t).alias("type"), F.col(n).alias("name"), L(None).cast("string").alias("number"))
    c = F.array(item("nation", "n_name"), item("region", "r_name"))
    return r.select("n_nationkey", template.formatted(c, "{{nation.name}} ({{region.name}})").alias("a"), template.formatted(c, '{{#eq region.name "EUROPE"}}EU{{else}}{{region.name}}{{/eq}}').alias("b"))


@query("op_matching_text", "select n_nationkey, case when n_nationkey % 2 = 0 then 'alias ' || n_nationkey end as text from nation")
def op_matching_text(spark, d):
    other = F.concat(L("alias "), F.col("n_nationkey").cast("string"))
    asked = F.when(F.col("n_nationkey") % 2 == 0, other).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", output.matching_name(F.create_map(L("de"), other), F.col("n_name"), asked, F.col("n_name")).alias("text"))


@query("op_displayed", "select n_nationkey, case n_nationkey % 3 when 0 then n_name || ' de' when 1 then n_name else n_name || ' at' end as text, case n_nationkey % 3 when 0 then 'de' when 2 then 'de-AT' end as language from nation")
def op_displayed(spark, d):
    m = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(L("de"), F.concat("n_name", L(" de,x")))).when(F.col("n_nationkey") % 3 == 2, F.create_map(L("de_AT"), F.concat("n_name", L(" at"))))
    return table(spark, d, "nation").select("n_nationkey", output.displayed(m, F.col("n_name"), "de").alias("x")).select("n_nationkey", "x.text", "x.language")


@query("op_filled_languages", "select n_nationkey::bigint as id, lower(n_name) as phrase, case when n_nationkey % 2 = 0 then 'hr,sr' else 'en' end as langs from nation")
def op_filled_languages(spark, d):
    p = table(spark, d, "nation").select(L("s").alias("source"), F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("phrase"), L(1.0).alias("relev"), F.array(F.when(F.col("n_nationkey") % 2 == 0, "hr").otherwise("en")).alias("langs"))
    return ix.filled_languages(p, [Source("s", languages=("hr", "sr"))]).select("id", "phrase", F.array_join("langs", ",").alias("langs"))


@query("op_number_masks", "select c_custkey::bigint as id, case length(k) when 1 then '#' when 2 then '##' when 3 then k[1:1] || '##' else k[1:2] || repeat('#', length(k) - 2) end as mask from (select c_custkey, c_custkey::varchar as k from customer)")
def op_number_masks(spark, d):
    c = table(spark, d, "customer")
    num = F.concat(F.col("c_custkey").cast("string"), L("a"))
    points = F.array(F.struct(num.alias("num"), L(1.0).alias("lon"), L(1.0).alias("lat"), L(None).cast("string").alias("style")))
    return ix.number_masks(c.select(L("s").alias("source"), F.col("c_custkey").cast("long").alias("id"), points.alias("points"))).select("id", "mask")


@query("op_required_masks", "select l_orderkey, l_linenumber, cast(3 << cast(l_partkey % 3 as int) as bigint) as mask from lineitem")
def op_required_masks(spark, d):
    k = F.col("l_partkey") % 3
    owner = F.when(k == 0, F.array(*map(L, (0, 0, 1, 2)))).when(k == 1, F.array(*map(L, (0, 1, 1, 2)))).otherwise(F.array(*map(L, (0, 1, 2, 2))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bits.required_masks(owner)[0].alias("mask"))


@query("op_gap_masks", "select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then '3' when 1 then '3,6' when 2 then '6,12' else '12' end as masks from lineitem")
def op_gap_masks(spark, d):
    k = (F.col("l_partkey") % 4).cast("int")
    tokens = F.transform(F.sequence(L(0), L(3)), lambda i: F.when(i == k, "").otherwise("x"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(bits.gap_masks(tokens), lambda m: m.cast("string")), ",").alias("masks"))


@query("op_shard", "select c_custkey, cast(floor((c_custkey % 1024) / 64.0) as bigint) as shard from customer")
def op_shard(spark, d):
    return table(spark, d, "customer").select("c_custkey", output.shard(0, "c_custkey").alias("shard"))


@query("op_address_permutations", "select l_orderkey as query_id, count(distinct case when l_linenumber % 3 = 0 then '# ' || (l_partkey % 5) else (l_partkey % 5) || ' st' end) as n from lineitem where l_linenumber % 3 <> 1 group by l_orderkey")
def op_address_permutations(spark, d):
    k = (F.col("l_partkey") % 5).cast("string")
    kind = F.col("l_linenumber") % 3
    terms = F.when(kind == 0, F.array(L("#"), k)).when(kind == 1, F.array(k, L("#"), L("st"))).otherwise(F.array(k, L("st")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), terms.alias("terms"), L(True).alias("ender"), L(3).alias("mask"))
    return match.address_permutations(rows).groupBy("query_id").agg(F.count("*").alias("n"))


_A5, _B5 = sql_tile(5, "lon - 12", "lat - 12")
_C5, _D5 = sql_tile(5, "lon + 12", "lat + 12")


@query("op_tile_cover", f"select k, (x1 - x0 + 1) * (y0 - y1 + 1) as n, x0, y1 from (select k, {_A5} as x0, {_B5} as y0, {_C5} as x1, {_D5} as y1 from {POINT_SQL})")
def op_tile_cover(spark, d):
    at = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(at(-12, -12), at(12, -12), at(12, 12), at(-12, 12), at(-12, -12))
    t = shapes.tile_cover(ring, F.lit(5))
    rows = nations(spark, d).withColumn("t", t)
    return rows.select("k", F.size("t").cast("bigint").alias("n"), F.array_min(F.transform("t", lambda x: x["x"])).alias("x0"), F.array_min(F.transform("t", lambda x: x["y"])).alias("y1"))


@query("op_box_intersection", f"select k, greatest(lon, 5) as w, greatest(lat, 3) as s, least(lon + 4, 15) as e, least(lat + 4, 9) as n from {POINT_SQL} where least(lon + 4, 15) > greatest(lon, 5) and least(lat + 4, 9) > greatest(lat, 3)")
def op_box_intersection(spark, d):
    b = geo.box_intersection(F.array("lon", "lat", F.col("lon") + 4, F.col("lat") + 4), F.array(*map(L, (5.0, 3.0, 15.0, 9.0))))
    return nations(spark, d).withColumn("b", b).where("b is not null").select("k", *[F.col("b")[i].alias(c) for i, c in enumerate("wsen")])


@query("op_extent", f"select k, lon - 1 as w, lat as s, lon + 2 as e, lat + 3 as n from {POINT_SQL}")
def op_extent(spark, d):
    p = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    return nations(spark, d).withColumn("b", geo.extent(F.array(p(-1, 0), p(2, 1), p(0, 3)))).select("k", *[F.col("b")[i].alias(c) for i, c in enumerate("wsen")])


@query("op_relevance_score", "select c_custkey, floor(((c_custkey % 10) / 10.0 * 0.6 + ((c_custkey % 500 + 1) - 1) / 4999.0 * 0.4) * 1e6 + 0.5) / 1e6 as score from customer")
def op_relevance_score(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", r6(geo.relevance_score(k % 10 / 10.0, (k % 500 + 1).cast("double"))).alias("score"))


@query("op_on_range", "select l_orderkey, l_linenumber, floor((n - 100) / 100.0 * 1e6 + 0.5) / 1e6 as lat, n % 2 = 1 as omitted from (select l_orderkey, l_linenumber, 100 + l_partkey % 101 as n from lineitem)")
def op_on_range(spark, d):
    line = F.array(*[F.struct(L(1.0).alias("lon"), L(y).alias("lat")) for y in (0.0, 1.0)])
    ranges = F.array(F.struct(L(0).alias("i"), L(100).alias("lf"), L(200).alias("lt"), L(None).cast("int").alias("rf"), L(None).cast("int").alias("rt"), L("E").alias("lp"), L("").alias("rp"), line.alias("line")))
    rows = table(spark, d, "lineitem").withColumns({"r": ranges, "n": F.lit(100) + F.col("l_partkey") % 101})
    return rows.withColumn("p", address.on_range("r", "n")).select("l_orderkey", "l_linenumber", "p.lat", "p.omitted")


@query("op_reverse_range", "select l_orderkey, l_linenumber, cast(floor((100 + 100 * x) / 2 + 0.5) * 2 as bigint) as number from (select l_orderkey, l_linenumber, l_discount as x from lineitem)")
def op_reverse_range(spark, d):
    line = F.array(*[F.struct(L(1.0).alias("lon"), L(y).alias("lat")) for y in (0.0, 1.0)])
    ranges = F.array(F.struct(L(0).alias("i"), L(100).alias("lf"), L(200).alias("lt"), L(None).cast("int").alias("rf"), L(None).cast("int").alias("rt"), L("E").alias("lp"), L("").alias("rp"), line.alias("line")))
    rows = table(spark, d, "lineitem").withColumn("r", ranges)
    return rows.select("l_orderkey", "l_linenumber", address.reverse_range("r", L(0.9), F.col("l_discount"))["number"].alias("number"))


@query("op_nearest_point", "select l_orderkey, cast(min_by(l_linenumber, (l_discount, -l_linenumber)) as int) as nearest from lineitem group by l_orderkey")
def op_nearest_point(spark, d):
    p = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("num"), L(0.0).alias("lon"), F.col("l_discount").alias("lat"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("p"))  # an order has few lines
    return rows.select("l_orderkey", address.nearest_point("p", L(0.0), L(0.0))["l_linenumber"].alias("nearest"))


@query("op_routable_point", f"select k, 30.0::double as lon, floor(lat * 1e6 + 0.5) / 1e6 as lat from {POINT_SQL}")
def op_routable_point(spark, d):
    line = F.array(*[F.struct(L(30.0).alias("lon"), L(y).alias("lat")) for y in (-50.0, 50.0)])
    return nations(spark, d).withColumn("p", address.routable_point(F.struct("lon", "lat"), line, L(False))).select("k", "p.lon", "p.lat")


@query("op_overlay", "select n_nationkey, n_name as a, case when n_nationkey % 2 = 0 then 'new' end as b from nation")
def op_overlay(spark, d):
    base = F.create_map(L("a"), F.col("n_name"), L("b"), L("old"))
    changes = F.create_map(L("b"), F.when(F.col("n_nationkey") % 2 == 0, "new"))
    return table(spark, d, "nation").withColumn("m", address.overlay(base, changes)).select("n_nationkey", F.try_element_at("m", L("a")).alias("a"), F.try_element_at("m", L("b")).alias("b"))


@query("op_types_filter", "select p_partkey from part where p_size <> 0 and p_size between 25 and 37.5 or p_partkey % 7 = 0")
def op_types_filter(spark, d):
    p = table(spark, d, "part").withColumns({"own_types": F.when(F.col("p_partkey") % 7 == 0, F.array(L("place"))).otherwise(F.array(L("poi"))), "scoreranges": F.create_map(L("landmark"), F.array(L(0.5), L(0.75))), "maxscore": L(50.0), "score": F.col("p_size").cast("double")})
    return p.where(filters.of_any_types(["place", "poi.landmark"])).select("p_partkey")


@query("op_language_filter", "select n_nationkey from nation where n_nationkey % 4 in (0, 2)")
def op_language_filter(spark, d):
    key = F.element_at(F.array(*map(L, ("hr", "de", "universal", "en"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    n = table(spark, d, "nation").withColumn("t", F.create_map(key, F.col("n_name")))
    return n.where(filters.in_language("t", ["sr"], True)).select("n_nationkey")


@query("op_reverse_only", "select n_nationkey from nation where n_nationkey % 3 <> 0 and n_nationkey - 5 >= 0")
def op_reverse_only(spark, d):
    n = table(spark, d, "nation").withColumns({"reverse_only": F.when(F.col("n_nationkey") % 3 == 0, True), "score": F.col("n_nationkey") - 5})
    return n.where(filters.forward_allowed() & filters.not_ghost()).select("n_nationkey")


@query("address_geocode", """select c_custkey as query_id, 'street.' || (c_custkey % 20) as id, c_custkey || ' road' || (c_custkey % 20) as place_name, c_custkey::varchar as address, 1.0::double as relevance from customer where c_custkey <= 400""")
def address_geocode(spark, d):
    """Houses of twenty streets, each asked for by number and street."""
    c = table(spark, d, "customer").where("c_custkey <= 400").select("c_custkey", (F.col("c_custkey") % 20).alias("k"))  # the houses that the streets have
    point = F.struct(F.col("c_custkey").cast("string").alias("num"), (F.col("c_custkey") / 100.0).alias("lon"), (F.col("c_custkey") / 50.0).alias("lat"), L(None).cast("string").alias("style"))
    streets = c.groupBy("k").agg(F.collect_list(point).alias("points")).select(L("street").alias("source"), F.col("k").cast("long").alias("id"), F.concat(L("road"), "k").alias("text"), L(0.0).alias("lon"), L(0.0).alias("lat"), L(1.0).alias("score"), "points")
    q = c.select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", F.col("c_custkey").cast("string"), F.concat(L("road"), "k")).alias("query"))
    index = ix.build(streets, catalog(spark, [Source("street", is_address=True, zoom=6)]))
    return geocode.forward(q, index, Options(limit=1, fuzzy=False, autocomplete=False)).select("query_id", "id", "place_name", "address", "relevance")


@query("typo_geocode", """select n_nationkey as query_id, 'country.' || n_nationkey as id, floor((length(n_name) + 0.5) / (length(n_name) + 1) * 1e6 + 0.5) / 1e6 as relevance from nation where not contains(n_name, ' ') and length(n_name) >= 4""")
def typo_geocode(spark, d):
    """Nations of one word, each asked for with its third letter doubled, by the default options: a correction costs half a letter."""
    n = table(spark, d, "nation").where("not contains(n_name, ' ') and length(n_name) >= 4")
    q = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.substring("n_name", 1, 3), F.substring("n_name", 3, 99)).alias("query"))
    index = ix.build(features_of(spark, d).withColumn("source", L("country")), catalog(spark, [Source("country")]))
    return geocode.forward(q, index, Options(limit=1)).select("query_id", "id", "relevance")


@query("typed_geocode", """select r_regionkey as query_id, 'region.' || r_regionkey as id from region""")
def typed_geocode(spark, d):
    """Regions by the first half of their names, as typed so far."""
    r = table(spark, d, "region")
    q = r.select(F.col("r_regionkey").alias("query_id"), F.substring("r_name", 1, 4).alias("query")).withColumn("query", F.when(F.col("query_id") == 0, "afri").otherwise(F.col("query")))
    feats = r.select(L("region").alias("source"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("text"), F.col("r_regionkey").cast("double").alias("lon"), L(1.0).alias("lat"), L(1.0).alias("score"))
    return geocode.forward(q, ix.build(feats, catalog(spark, [Source("region")])), Options(limit=1, fuzzy=False)).select("query_id", "id")


@query("edge_reverse", """select n_nationkey as query_id, 'poi.' || n_nationkey as id from nation where n_nationkey % 2 = 0""")
def edge_reverse(spark, d):
    """Points just west of a tile's edge, features just east of it: half of them within reach."""
    k = F.col("n_nationkey")
    edge = (k * 100 + 1000) * 360 / 2.0**14 - 180
    n = table(spark, d, "nation")
    feats = n.select(L("poi").alias("source"), k.cast("long").alias("id"), F.col("n_name").alias("text"), (edge + F.when(k % 2 == 0, 0.001).otherwise(0.02)).alias("lon"), L(10.0).alias("lat"), L(1.0).alias("score"))
    points = n.select(k.alias("query_id"), (edge - 0.001).alias("lon"), L(10.0).alias("lat"))
    cat = catalog(spark, [Source("poi", zoom=14)])
    return geocode.reverse(points, ix.Index(cat, feats, feats, feats)).select("query_id", "id")


@query("dispatch_geocode", """select n_nationkey as query_id, case n_nationkey % 3 when 0 then 'id' when 1 then 'reverse' else 'forward' end as kind, 'nation.' || n_nationkey as id, n_name as place_name from nation""")
def dispatch_geocode(spark, d):
    """Nations by id, by place and by name in one table of queries."""
    f = features_of(spark, d)
    k = F.col("id").cast("string")
    q = f.select(F.col("id").cast("int").alias("query_id"), F.when(F.col("id") % 3 == 0, F.concat(L("nation."), k)).when(F.col("id") % 3 == 1, F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"))).otherwise(F.col("text")).alias("query"))
    found = geocode.geocode(q, ix.build(f, catalog(spark, [Source("nation")])), Options(fuzzy=False, autocomplete=False))
    return found.where("rank = 1").select("query_id", "kind", "id", "place_name")

"""Geocodes that need more than the first candidates, layers or tiles."""

import pytest

from waymark.config import InvalidOption, Options, Source, catalog
from waymark.operators import index as ix
from waymark.operators import match
from waymark.plans import geocode

DOC = "source string, id bigint, text string, lon double, lat double, score double"


@pytest.fixture(scope="module")
def namesakes(spark):
    """Seventy streets of one name, the last of lowest score, and a place of that name with a lower one."""
    docs = [("street", i, "main st", float(i), 10.0, 1000.0 if i < 70 else 1.0) for i in range(1, 71)] + [("place", 1, "main st", -50.0, 10.0, 1.0)]
    return ix.build(spark.createDataFrame(docs, DOC), catalog(spark, [Source("place", maxscore=1000.0, stack=("us",)), Source("street", maxscore=1000.0, stack=("ca",))]))


@pytest.mark.parametrize(
    "options, first",
    [
        (Options(bbox=(69.5, 9.0, 71.0, 11.0)), "street.70"), (Options(bbox=(69.5, 9.0, -170.0, 11.0)), "street.70"), (Options(types=["place"]), "place.1"), (Options(stacks=["us"]), "place.1"),
        (Options(proximity=(69.0, 10.0)), "street.69"), (Options(proximity=(3.0, 10.0)), "street.3"),
    ],
)
def test_options_hold_before_the_best_targets_are_taken(spark, namesakes, options, first):
    q = spark.createDataFrame([(1, "main st")], "query_id bigint, query string")
    assert geocode.forward(q, namesakes, options).where("rank = 1").head().id == first


POINTS = "array<struct<num:string,lon:double,lat:double,style:string>>"
RANGES = "array<struct<i:int,lf:int,lt:int,rf:int,rt:int,lp:string,rp:string,line:array<struct<lon:double,lat:double>>>>"


def test_the_number_is_looked_up_before_streets_are_cut(spark):
    """Seventy streets of one name; those that have the numbers asked for score least."""
    own = {1: [("7", 1.0, 10.0, None)], 70: [("100", 70.0, 10.5, None)]}
    docs = [("street", i, "main st", float(i), 10.0, 1.0 if i in own else 1000.0, own.get(i)) for i in range(1, 71)]
    index = ix.build(spark.createDataFrame(docs, f"{DOC}, points {POINTS}"), catalog(spark, [Source("street", maxscore=1000.0, is_address=True)]))
    q = spark.createDataFrame([(1, "100 main st"), (2, "main st 7"), (3, "8 main st")], "query_id bigint, query string")
    rows = {r.query_id: r for r in geocode.forward(q, index, Options(limit=1)).collect()}
    assert (rows[1].id, rows[1].place_name, rows[1].lat, rows[1].address) == ("street.70", "100 main st", 10.5, "100")
    assert (rows[2].id, rows[2].place_name) == ("street.1", "7 main st")
    assert rows[3].address is None and rows[3].relevance < rows[1].relevance  # no street has it: a street by itself


def test_stacks_have_as_many_layers_as_the_query_names(spark):
    names = ["country", "region", "district", "place", "locality", "street"]
    texts = ["usa", "carolina", "forsyth", "winston", "ardmore", "cabin"]
    docs = [(n, 1, t, 1.0, 1.0, 1.0) for n, t in zip(names, texts)]
    index = ix.build(spark.createDataFrame(docs, DOC), catalog(spark, [Source(n) for n in names]))
    q = spark.createDataFrame([(1, " ".join(reversed(texts))), (2, "cabin ardmore winston forsyth carolina x")], "query_id bigint, query string")
    options = Options(limit=1, fuzzy=False, autocomplete=False)
    found = match.covers(match.phrasematch(match.tokenized(q), index, False, False), index)
    stacks = match.stacks(found, [6], len(names)).selectExpr("query_id", "size(entries) as layers", "relev").collect()
    assert {(r.query_id, r.layers, round(r.relev, 3)) for r in stacks} == {(1, 6, 1.0), (2, 5, 0.833)}
    assert {(r.query_id, r.id, round(r.relevance, 3)) for r in geocode.forward(q, index, options).collect()} == {(1, "street.1", 1.0), (2, "street.1", 0.833)}


def test_polygons_are_found_in_every_tile_they_cover(spark):
    square = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    docs = [("country", 1, "usa", 10.0, 10.0, 1.0, square), ("place", 1, "paris", 18.5, 1.5, 1.0, None), ("place", 2, "paris", 20.5, 1.5, 1.0, None)]
    feats = spark.createDataFrame(docs, DOC + ", ring array<struct<lon:double,lat:double>>")
    index = ix.build(feats, catalog(spark, [Source("country"), Source("place")]))
    at = spark.createDataFrame([(1, 18.5, 1.5), (2, 1.0, 19.0), (3, 20.5, 4.0)], "query_id bigint, lon double, lat double")
    assert {(r.query_id, r.id) for r in geocode.reverse(at, index).collect()} == {(1, "place.1"), (1, "country.1"), (2, "country.1")}
    q = spark.createDataFrame([(1, "paris usa")], "query_id bigint, query string")
    rows = geocode.forward(q, index, Options(fuzzy=False, autocomplete=False)).collect()
    assert [(r.id, r.place_name, r.relevance) for r in rows if r["rank"] == 1] == [("place.1", "paris, usa", 1.0)]
    assert {r.place_name for r in rows if r.id == "place.2"} <= {"paris"}


def test_points_refuse_what_has_no_effect(spark, namesakes):
    q = spark.createDataFrame([(1, 1.0, 10.0)], "query_id bigint, lon double, lat double")
    for o in (Options(worldview="us"), Options(types=["street.big"]), Options(bbox=(0.0, 0.0, 1.0, 1.0)), Options(proximity=(0.0, 0.0))):
        with pytest.raises(InvalidOption):
            geocode.reverse(q, namesakes, o)
    assert {r.id for r in geocode.reverse(q, namesakes, Options(stacks=["us"])).collect()} == set()
    assert {r.id for r in geocode.reverse(q, namesakes, Options(stacks=["ca"])).collect()} == {"street.1"}

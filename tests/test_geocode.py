"""Whole geocodes over small hand-made layers."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.config import InvalidOption, Options, Source, catalog, max_score
from waymark.operators import index as ix
from waymark.operators import validate
from waymark.plans import geocode
from waymark.sources import readers
from waymark.streaming import ingest

SOURCES = [Source("country"), Source("region"), Source("place"), Source("street")]
DOCS = [
    ("country", 1, "usa,united states", 1.0, 1.0, 10.0), ("region", 1, "north carolina", 1.0, 1.0, 1.0), ("place", 1, "winston salem", 1.0, 1.0, 1.0),
    ("place", 9, "paris", 50.0, 10.0, 1.0), ("street", 1, "log cabin ln", 1.0, 1.0, 1.0), ("street", 2, "main st", 1.0, 1.0, 1.0),
]


@pytest.fixture(scope="module")
def index(spark):
    feats = spark.createDataFrame(DOCS, "source string, id bigint, text string, lon double, lat double, score double")
    return ix.build(feats, catalog(spark, SOURCES))


def test_forward_reverse_and_id(spark, index):
    q = spark.createDataFrame(
        [
            (1, "log cabin ln winston salem north carolina"), (2, "Log Cabin Ln North Carolina Winston-Salem"), (3, "North Carolina Winston-Salem"), (4, "log cabin"),
            (5, "log cabni ln"), (6, "place.9"), (7, "1,1"), (8, "nowhere"), (9, None), (10, ""),
        ],
        "query_id bigint, query string",
    )
    rows = geocode.geocode(q, index).collect()
    first = {r.query_id: (r.kind, r.id, r.relevance) for r in rows if r["rank"] == 1}
    assert first[1] == ("forward", "street.1", 1.0)
    assert first[2] == ("forward", "street.1", 0.843915)
    assert first[3] == ("forward", "place.1", 0.99)
    assert first[4][1] == "street.1"
    assert first[5][1] == "street.1" and first[5][2] < 1
    assert first[6] == ("id", "place.9", 1.0)
    assert first[7][:2] == ("reverse", "street.1")  # of equally close ones the lowest id
    assert not {8, 9, 10} & set(first)
    back = sorted((r["rank"], r.id) for r in rows if r.query_id == 7)
    assert back == [(1, "street.1"), (2, "place.1"), (3, "region.1"), (4, "country.1")] or len(back) == 4


def test_options_narrow_results(spark, index):
    q = spark.createDataFrame([(1, "paris")], "query_id bigint, query string")
    assert geocode.forward(q, index, Options(bbox=(0.0, 0.0, 5.0, 5.0))).count() == 0
    assert geocode.forward(q, index, Options(types=["place"])).count() == 1
    assert geocode.forward(q, index, Options(types=["street"])).count() == 0
    assert geocode.forward(q, index, Options(proximity=(50.0, 10.0))).head().id == "place.9"


def test_option_checks():
    with pytest.raises(InvalidOption):
        Options(types=["zoo"]).checked(SOURCES)
    with pytest.raises(InvalidOption):
        Options(language=["en", "en"]).checked(SOURCES)
    with pytest.raises(InvalidOption):
        Options(limit=3).checked(SOURCES, reverse=True)
    s = [Source("poi", scoreranges={"landmark": (0.5, 1.0)})]
    assert Options(types=["poi", "poi.landmark"], limit=50).checked(s).types == ["poi"]
    assert Options(limit=50).checked(s).limit == 10
    assert max_score([Source("a", maxscore=5.0), Source("b")]) == 1.0


def test_sources_prune():
    s = Source("poi", stack=("us",), scoreranges={"landmark": (0.5, 1.0)}, worldview="us")
    assert s.allows(["poi.landmark"]) and not s.allows(["place"]) and not s.allows(None, ["ca"]) and not s.allows(worldview="cn")


def test_validation(spark):
    docs = spark.createDataFrame([(None, "a", 0.0, 0.0), (1, None, 0.0, 0.0), (2, "a", None, 0.0), (3, "a", 0.0, 0.0)], "id bigint, text string, lon double, lat double")
    assert [len(r.errors) for r in validate.checked(docs).collect()] == [1, 1, 1, 0]
    with pytest.raises(Exception, match="doc has no"):
        validate.checked(docs, strict=True).collect()


def test_index_round_trip(spark, index, tmp_path):
    readers.write_index(index, str(tmp_path / "ix"))
    back = readers.read_index(spark, str(tmp_path / "ix"))
    assert back.grid.count() == index.grid.count()
    q = spark.createDataFrame([(1, "log cabin ln")], "query_id bigint, query string")
    found = geocode.forward(q, back)
    assert found.head().id == "street.1"
    doc = json.loads(readers.to_geojson(found).head().geojson)
    assert doc["type"] == "FeatureCollection" and doc["features"][0]["id"] == "street.1"


def test_geojson_and_directory(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text(
        '{"id":1,"type":"Feature","properties":{"geo:text":"x","geo:center":"[1,2]","geo:text_de":"y","kind":"k"},"geometry":{"type":"Point","coordinates":[3,4]}}\n\n'
        '{"id":2,"type":"Feature","properties":{"text":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}\n'
    )
    rows = {r.id: r for r in readers.read_geojson(spark, str(tmp_path / "a.ndjson"), "s").collect()}
    assert (rows[1].text, rows[1].lon, rows[1].text_lang, rows[1].props) == ("x", 1.0, {"de": "y"}, {"kind": "k"})
    assert len(rows[2].ring) == 4
    (tmp_path / ".hidden.json").write_text("{}")
    assert list(readers.load_directory(spark, str(tmp_path))) == ["a"]


def test_streams(spark, tmp_path):
    docs = readers.memory(spark, [{"source": s, "id": i, "text": t, "lon": x, "lat": y, "score": c} for s, i, t, x, y, c in DOCS])
    docs.write.json(str(tmp_path / "in"))
    cat = catalog(spark, SOURCES)
    ingest.index_stream(ingest.read_documents(spark, str(tmp_path / "in")), cat, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    index = ingest.merged(spark, str(tmp_path / "out"), cat)
    spark.createDataFrame([(1, "main st")], "query_id bigint, query string").write.parquet(str(tmp_path / "q"))
    qs = spark.readStream.schema("query_id bigint, query string").parquet(str(tmp_path / "q"))
    ingest.geocode_stream(qs, index, str(tmp_path / "answers"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "answers")).where("rank = 1").head().id == "street.2"


def test_empty_tables(spark, index):
    none = spark.createDataFrame([], "query_id bigint, query string")
    assert geocode.geocode(none, index).count() == 0
    assert index.grid.where(F.col("x").isNull()).count() == 0

"""Whole geocodes: addresses, replacements, languages, options, hierarchies; each over a small index of its own."""

import pytest
from pyspark.sql import functions as F

from waymark.config import InvalidOption, Options, Source, catalog
from waymark.operators import index as ix
from waymark.operators import match
from waymark.plans import geocode
from waymark.sources import readers

RING = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
EXACT = dict(fuzzy=False, autocomplete=False)


def made(spark, sources, docs, **kw):
    return ix.build(readers.memory(spark, docs).drop(*[f for f in readers.FEATURE.names if f not in {"score", *{k for d in docs for k in d}}]), catalog(spark, sources), **kw)


def doc(source, id_, text, lon=1.0, lat=1.0, score=1.0, **kw):
    return {"source": source, "id": id_, "text": text, "lon": float(lon), "lat": float(lat), "score": score} | kw


def ask(spark, index, *queries, helpers=None, **options):
    q = spark.createDataFrame(list(enumerate(queries, 1)), "query_id bigint, query string")
    out = {i: [] for i in range(1, len(queries) + 1)}
    for r in sorted(geocode.forward(q, index, Options(**options), helpers).collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r)
    return list(out.values())


def around(spark, index, *points, **options):
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points, 1)], "query_id bigint, lon double, lat double")
    out = {i: [] for i in range(1, len(points) + 1)}
    for r in sorted(geocode.reverse(p, index, Options(**options)).collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r)
    return list(out.values())


@pytest.fixture(scope="module")
def town(spark):
    """A street with points and ranges, another that crosses it, in a place of a region."""
    line = [(1.0, 1.0), (1.0, 1.005)]
    return made(
        spark,
        [Source("region", zoom=6), Source("place", zoom=6), Source("street", zoom=14, is_address=True, number_order="first", intersection_token="and", tokens={"street": "st", "avenue": "ave"})],
        [
            doc("region", 1, "north carolina", ring=RING(0.0, 0.0, 3.0, 3.0)), doc("place", 1, "winston salem", ring=RING(0.5, 0.5, 1.5, 1.5)),
            doc("street", 1, "main street,highway one", 1.0, 1.0, points=[("100", 1.0, 1.0, None), ("100b", 1.0, 1.001, None)], ranges=[(0, 200, 298, 201, 299, "E", "O", line)]),
            doc("street", 2, "oak avenue", 1.002, 1.0, intersections=[("main street", 1.0, 1.0002)]),
        ],
    )


def test_addresses(spark, town):
    a, b, c, d, e, f = ask(spark, town, "100 main street", "main st 100 winston salem", "250 main street", "999 main street", "main street", "100b highway one", **EXACT)
    assert (a[0].id, a[0].place_name, a[0].address, a[0].lat, a[0].relevance) == ("street.1", "100 main street, winston salem, north carolina", "100", 1.0, 1.0)
    assert b[0].address == "100" and 0.9 < b[0].relevance < 1.0  # the number is where it isn't expected
    assert (c[0].address, c[0].interpolated, c[0].omitted) == ("250", True, False) and 1.0 < c[0].lat < 1.005
    assert d[0].address is None and d[0].place_name.startswith("main street") and d[0].relevance < a[0].relevance
    assert e[0].address is None and e[0].relevance == 1.0
    assert (f[0].address, f[0].matching_text) == ("100b", "highway one")
    assert [x["text"] for x in a[0].context] == ["winston salem", "north carolina"]


def test_number_and_word_run_together(spark, town):
    (a,) = ask(spark, town, "100main street")
    assert a[0].address == "100" and a[0].relevance < 1.0


def test_crossings(spark, town):
    a, b = ask(spark, town, "main street and oak avenue", "main st and oak ave", **EXACT)
    for found in (a, b):
        assert found[0].id == "street.2" and found[0].lat == pytest.approx(1.0002) and found[0].place_name.startswith("main street and oak avenue")


def test_reverse_addresses(spark, town):
    near, far = around(spark, town, (1.0, 1.0009), (1.0001, 1.004))
    assert (near[0].id, near[0].address) == ("street.1", "100b")
    assert [r.id for r in near] == ["street.1", "place.1", "region.1"]
    assert far[0].address is not None and 200 <= int(far[0].address) <= 299 and far[0].place_name.endswith("main street, winston salem, north carolina")


def test_routable_points(spark, town):
    (a,) = ask(spark, made(spark, [Source("poi")], [doc("poi", 1, "cafe", 1.0, 1.001, line=[(1.01, 1.0), (1.01, 1.01)])]), "cafe", routing=True)
    assert (a[0].routable_point.lon, a[0].routable_point.lat) == (1.01, pytest.approx(1.001, abs=1e-5))


def test_replacements(spark):
    rules = {"street": "st", "saint": "st", "north west": "nw", "(\\d+)th": "$1"}
    index = made(spark, [Source("street", tokens=rules)], [doc("street", 1, "north west saint clair street"), doc("street", 2, "5th road", 9.0, 9.0)])
    a, b, c, d = ask(spark, index, "nw st clair st", "North West St Clair Street", "5 road", "north clair", **EXACT)
    assert a[0].id == b[0].id == "street.1" and a[0].relevance == b[0].relevance == 1.0
    assert c[0].id == "street.2" and c[0].relevance == 1.0
    assert not d or d[0].relevance < 1.0


def test_global_patterns(spark):
    index = made(spark, [Source("place", patterns={"^(?:the )": ""})], [doc("place", 1, "the hague")])
    assert [x[0].id for x in ask(spark, index, "hague", "The Hague", **EXACT)] == ["place.1"] * 2


def test_languages(spark):
    index = made(
        spark, [Source("country"), Source("place", languages=("es", "de", "ca"))],
        [doc("country", 1, "usa"), doc("place", 1, "new york", text_lang={"es": "nueva york", "de": "neuyork"})],
    )
    (a,) = ask(spark, index, "nueva york usa", language=["es", "de"], **EXACT)
    assert (a[0].id, a[0].relevance, a[0].text, a[0].language, a[0].place_name) == ("place.1", 0.982963, "nueva york", "es", "nueva york, usa")
    assert a[0].names["de"].text == "neuyork" and a[0].names["es"].place_name == "nueva york, usa"
    (b,) = ask(spark, index, "nueva york", language=["ca"], **EXACT)
    assert b[0].relevance == 1.0  # no ca text: the nearest language is asked for instead
    (d,) = ask(spark, index, "nueva york", **EXACT)
    assert (d[0].text, d[0].matching_text, d[0].matching_place_name) == ("new york", "nueva york", "nueva york, usa") and d[0].relevance < 1.0
    e, f = ask(spark, index, "new york usa", "usa", language=["de"], language_mode="strict", **EXACT)
    assert e[0].place_name == "neuyork" and f == []  # usa has no German name


def test_missing_languages_are_filled(spark):
    index = made(spark, [Source("place", languages=("hr", "sr", "en"))], [doc("place", 1, "beograd", text_lang={"hr": "belgrad"}), doc("place", 2, "x", text_lang={"en": "ex"})])
    langs = {(r.id, r.phrase): r.langs for r in index.grid.collect()}
    assert langs[1, "belgrad"] == ["hr", "sr"] and langs[2, "ex"] == ["en"] and langs[1, "beograd"] == ["default"]


def test_formats(spark):
    sources = [Source("region"), Source("place", formats={"": "{{place.name}} ({{region.name}})", "de": "{{region.name}}: {{place.name}}"})]
    docs = [doc("region", 1, "hesse", text_lang={"de": "Hessen"}), doc("place", 1, "hanau"), doc("place", 2, "giessen", formats={"": "{{shout place.name}}!"})]
    index = made(spark, sources, docs)
    a, b = ask(spark, index, "hanau", "giessen", helpers={"shout": lambda s: s.upper()}, **EXACT)
    assert (a[0].place_name, b[0].place_name) == ("hanau (hesse)", "GIESSEN!")
    (c,) = ask(spark, index, "hanau", language=["de"], **EXACT)
    assert c[0].place_name == "Hessen: hanau"


def test_types_and_subtypes(spark):
    index = made(spark, [Source("place"), Source("poi", maxscore=10.0, scoreranges={"landmark": (0.5, 1.0)})], [doc("place", 1, "tower"), doc("poi", 1, "tower", score=9.0), doc("poi", 2, "tower", 40.0, 1.0, 2.0)])
    ids = lambda **o: sorted(r.id for r in ask(spark, index, "tower", allow_dupes=True, **EXACT, **o)[0])
    assert ids(types=["poi.landmark"]) == ["poi.1"] and ids(types=["poi.landmark", "place"]) == ["place.1", "poi.1"]
    assert [[r.id for r in x] for x in around(spark, index, (1, 1), (40, 1), types=["poi.landmark"])] == [["poi.1"], []]
    with pytest.raises(InvalidOption):
        ids(types=["poi.shop"])


def test_worldviews(spark):
    index = made(spark, [Source("country-us", worldview="us", type="country"), Source("country-cn", worldview="cn", type="country"), Source("place")], [doc("country-us", 1, "disputed a"), doc("country-cn", 1, "disputed b"), doc("place", 1, "town")])
    names = lambda **o: ask(spark, index, "town", **EXACT, **o)[0][0].place_name
    assert names() == "town, disputed a" and names(worldview="cn") == "town, disputed b"
    assert around(spark, index, (1, 1), worldview="cn")[0][0].place_name == "town, disputed b"
    with pytest.raises(InvalidOption):
        names(worldview="xx")


def test_stacks_and_reverse_only(spark):
    index = made(spark, [Source("place", stack=("us", "ca"))], [doc("place", 1, "london", stack="us"), doc("place", 2, "london", 30.0, 1.0, stack="ca"), doc("place", 3, "paris", reverse_only=True), doc("place", 4, "rome", 50.0, 1.0, stack="us")])
    ids = lambda *q, **o: [[r.id for r in x] for x in ask(spark, index, *q, allow_dupes=True, **EXACT, **o)]
    assert ids("london", "rome", stacks=["CA"]) == [["place.2"], []]
    both, hidden = ids("london", "paris")
    assert len(both) == 2 and hidden == []
    with pytest.raises(InvalidOption):
        ids("rome", stacks=["mars"])


def test_ghosts_and_scores(spark):
    index = made(spark, [Source("place", maxscore=100.0)], [doc("place", 1, "paris", 1, 1, 20.0), doc("place", 2, "paris", 40, 1, 90.0), doc("place", 3, "paris", 80, 1, -1.0), doc("place", 4, "lone", 20, 1, -1.0)])
    (a, b) = ask(spark, index, "paris", "lone", allow_dupes=True, **EXACT)
    assert [r.id for r in a] == ["place.2", "place.1"] and [r.id for r in b] == ["place.4"]
    (c,) = ask(spark, index, "paris", proximity=(1.0, 1.0), **EXACT)
    assert c[0].id == "place.1"
    assert around(spark, index, (20, 1)) == [[]]


def test_namesakes_lend_scores(spark):
    sources = [Source("region", maxscore=100.0), Source("place", maxscore=100.0, inherit_score=True)]
    docs = [doc("region", 1, "new york", 1, 1, 90.0, ring=RING(0.0, 0.0, 2.0, 2.0)), doc("place", 1, "new york", 1, 1, 10.0), doc("region", 2, "texas", 40, 1, 90.0), doc("place", 2, "new york", 40, 1, 50.0)]
    (a,) = ask(spark, made(spark, sources, docs), "new york", allow_dupes=True, **EXACT)
    assert a[0].id == "place.1"  # 10 + 90 of its region


def test_overrides(spark):
    sources = [Source("place"), Source("street")]
    docs = [doc("place", 1, "springfield"), doc("place", 2, "shelbyville", 40.0, 1.0), doc("street", 1, "elm", overrides={"place": "shelbyville"})]
    (a,) = ask(spark, made(spark, sources, docs), "elm", **EXACT)
    assert a[0].place_name == "elm, shelbyville"


def test_edges_of_tiles(spark):
    """A feature within reach beyond the edge of its tile is found, and one beyond reach isn't."""
    edge = 360 / 2**14 * 3000 - 180
    index = made(spark, [Source("poi", zoom=14)], [doc("poi", 1, "cafe", edge + 0.002, 10.0), doc("poi", 2, "bar", edge + 0.016, 10.0), doc("poi", 3, "west", 179.9995, 0.0)])
    here, there, far = around(spark, index, (edge - 0.002, 10.0), (-179.9995, 0.0), (edge - 0.012, 10.0))
    assert [r.id for r in here] == ["poi.1"] and [r.id for r in there] == ["poi.3"] and far == []
    several = around(spark, index, (edge + 0.01, 10.0), types=["poi"], limit=5)[0]
    assert [r.id for r in several] == ["poi.2", "poi.1"] and several[0].distance < several[1].distance < 1000


def test_several_nearest_have_their_hierarchies(spark, town):
    rows = around(spark, town, (1.001, 1.0), types=["street"], limit=5)[0]
    assert {r.id for r in rows} == {"street.1", "street.2"} and all(r.place_name.endswith("winston salem, north carolina") for r in rows)


def test_score_mode(spark):
    index = made(spark, [Source("poi", zoom=14)], [doc("poi", 1, "near", 1.0, 1.0, 1.0), doc("poi", 2, "grand", 1.002, 1.0, 100.0)])
    assert around(spark, index, (1.0, 1.0))[0][0].id == "poi.1" and around(spark, index, (1.0, 1.0), reverse_mode="score")[0][0].id == "poi.2"


def test_features_of_several_types(spark):
    """A place that is a region too leaves no room for another region."""
    sources = [Source("region"), Source("place", types=("region", "place")), Source("poi")]
    docs = [doc("region", 1, "old region"), doc("place", 1, "city state"), doc("poi", 1, "pier")]
    assert [r.id for r in around(spark, made(spark, sources, docs), (1, 1))[0]][:2] == ["poi.1", "place.1"]


def test_frequent_words_and_categories(spark):
    docs = [doc("poi", i, f"cafe number{i}", float(i), 1.0) for i in range(1, 30)] + [doc("poi", 99, "royal,coffee", 50.0, 1.0, text_lang={"de": "koenig"})]
    plain = made(spark, [Source("poi")], docs)
    words = made(spark, [Source("poi", frequent_words=("number7",), categories=("coffee",))], docs)
    has = lambda index, phrase, id_: index.grid.where((F.col("phrase") == phrase) & (F.col("id") == id_)).count() > 0
    assert not has(plain, "cafe", 7) and has(words, "cafe", 7) and not has(words, "cafe", 8)
    assert {tuple(r.langs) for r in words.grid.where("phrase = 'coffee'").collect()} == {("all",)}


def test_documents_are_checked_and_mended(spark):
    bad = [doc("place", 1, "ok"), doc("place", 2, None), doc("place", 3, "far", 999.0, 1.0)]
    with pytest.raises(Exception, match="doc has no text|off the map"):
        made(spark, [Source("place")], bad)
    assert [r.id for r in made(spark, [Source("place")], bad, on_error="drop").features.collect()] == [1]
    u = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (8.0, 9.0), (8.0, 1.0), (1.0, 1.0), (1.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    (row,) = made(spark, [Source("place", zoom=10)], [doc("place", 1, "u", 4.5, 6.0, ring=u)]).features.collect()
    assert (row.lon, row.lat) != (4.5, 6.0)
    numbers = [(str(n), 1.0, 1.0, None) for n in (*range(1, 40, 2), 5000)]
    (row,) = made(spark, [Source("street", is_address=True)], [doc("street", 1, "main", points=numbers, ranges=[(0, 1, 5000, 2, 40, "O", "E", [(1.0, 1.0), (1.0, 2.0)])])]).features.collect()
    assert row.ranges[0].lt == 39 and row.ranges[0].rt == 40


def test_changed_documents_are_merged(spark):
    old = made(spark, [Source("place")], [doc("place", 1, "alpha"), doc("place", 2, "beta")])
    new = ix.merge(old, readers.memory(spark, [doc("place", 2, "gamma"), doc("place", 3, "delta")]).select(*old.features.columns))
    assert [[r.id for r in x] for x in ask(spark, new, "alpha", "beta", "gamma", "delta", **EXACT)] == [["place.1"], [], ["place.2"], ["place.3"]]


def test_whole_dispatcher(spark, town):
    q = spark.createDataFrame([(1, "street.1"), (2, "1.0,1.0009"), (3, "100 main street"), (4, "x" * 300)], "query_id bigint, query string")
    rows = {(r.query_id, r["rank"]): r for r in geocode.geocode(q, town, Options(limit=3, bbox=(0.0, 0.0, 3.0, 3.0))).collect()}
    assert rows[1, 1].kind == "id" and rows[1, 1].place_name == "main street" and rows[2, 1].address == "100b" and rows[3, 1].address == "100" and not [k for k in rows if k[0] == 4]


def test_trace(spark, town):
    trace = geocode.Trace()
    geocode.forward(spark.createDataFrame([(1, "100 main street")], "query_id bigint, query string"), town, Options(**EXACT), trace=trace).collect()
    assert [s for s, _, _ in trace.stages] == ["phrasematch", "spatialmatch", "verifymatch", "results"] and all(n > 0 and t >= 0 for _, n, t in trace.stages)


def test_address_permutations(spark):
    rows = spark.createDataFrame([(1, ["1##", "main"], True, 3), (1, ["main", "1##", "st"], True, 7), (1, ["1##", "main"], True, 3), (1, ["main", "st", "1##"], False, 7)], "query_id int, terms array<string>, ender boolean, mask bigint")
    got = match.address_permutations(rows).orderBy("place").collect()
    assert [r.terms for r in got] == [["main", "st", "1##"], ["1##", "main"]]


def test_stored_index_answers_alike(spark, town, tmp_path):
    readers.write_index(town, str(tmp_path / "ix"))
    back = readers.read_index(spark, str(tmp_path / "ix"))
    assert back.layers == town.layers
    assert [r.place_name for x in ask(spark, back, "100 main street", "wniston salem", "nor") for r in x[:1]] == [r.place_name for x in ask(spark, town, "100 main street", "wniston salem", "nor") for r in x[:1]]
    assert [r.id for r in around(spark, back, (1.0, 1.0009))[0]] == ["street.1", "place.1", "region.1"]

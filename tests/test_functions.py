"""Literal expectations of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import address, bits, geo, lang, rewrite
from waymark.functions import text as tx

L = F.lit


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda *cols: [x for x in one.select(*cols).head()]


def line(*pts):
    return F.array(*[F.struct(L(float(x)).alias("lon"), L(float(y)).alias("lat")) for x, y in pts])


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("69-150", ["69-150"]), ("5-02A", ["5-02a"]), ("34+1/2+s+vermont+avenue+#1", ["34", "1/2", "s", "vermont", "avenue", "1"]),
        ("京都市", ["京", "都", "市"]), ("foo's bar", ["foos", "bar"]), ("1-2-3-4", ["1-2-3", "4"]), ("", []), ("--", []), ("a😀 😀 b", ["a😀", "b"]),
    ],
)
def test_tokenize(ev, text, tokens):
    assert ev(tx.tokenize(L(text))) == [tokens]


def test_tokenize_null(ev):
    assert ev(tx.tokenize(L(None).cast("string"))) == [None]


def test_number_masks(ev):
    assert ev(*[tx.mask_number(L(x)) for x in ("", "1", "12", "123", "1234", "12345")]) == ["", "#", "##", "1##", "12##", "12###"]
    assert ev(*[tx.mask_number_prefixes(L(x)) for x in ("5", "50", "500", "5000")]) == [["#"], ["##", "5#"], ["5##", "50#"], ["50##"]]
    assert ev(F.size(tx.number_variants(tx.tokenize(L("500 main street 20009"))))) == [2]


def test_numbers_and_shapes(ev):
    assert ev(tx.parse_semi_number(L("LS24 8EG")), tx.parse_semi_number(L("320th")), tx.parse_semi_number(L("x"))) == [248, 320, None]
    assert [r and tuple(r) for r in ev(*[tx.as_reverse(L(x)) for x in ("40,0", "1400 15", "1,2,3", ",5")])] == [(40.0, 0.0), None, None, (0.0, 5.0)]
    assert ev(tx.as_id(L("place.12")), tx.as_id(L("place"))) == [("place", 12), None]
    assert ev(tx.split_number_and_letters(L("100main")), tx.split_number_and_letters(L("21st"))) == ["100 main", "21st"]
    assert ev(tx.remove_diacritics(L("Äpfelstrüdeln Straße"))) == ["Apfelstrudeln Strasse"]
    assert ev(*[tx.is_address(L(x)) for x in ("10", "10a", "10-19a", "6n23", "w350n5337", "main", "1st")]) == [True, True, True, True, True, False, False]


@pytest.mark.parametrize("a, b, near", [("ab", "ba", True), ("abc", "abd", True), ("abc", "ab", True), ("abcd", "abdc", True), ("abc", "cba", False), ("", "a", True), ("", "ab", False)])
def test_one_edit(ev, a, b, near):
    assert ev(tx.damerau_within_one(L(a), L(b))) == [near]
    shared = set(ev(tx.deletions(L(a)))[0]) & set(ev(tx.deletions(L(b)))[0])
    assert not near or shared


def test_tiles_and_boxes(ev):
    assert tuple(ev(geo.proximity_tile(L(-90.0), L(45.0), 5))[0]) == (5, 8, 12)
    assert tuple(ev(geo.tile_of(L(0.0), L(0.0), 6))[0]) == (6, 32, 32)
    assert tuple(ev(geo.box_tiles(F.array(*map(L, (-78.0, 38.0, -76.0, 40.0))), 5))[0]) == (5, 9, 12, 9, 12)
    assert ev(geo.in_box(L(175.0), L(0.0), 170.0, -5.0, -170.0, 5.0), geo.in_box(L(0.0), L(0.0), 170.0, -5.0, -170.0, 5.0)) == [True, False]
    assert ev(geo.clip_box(F.array(*map(L, (170.0, 0.0, -160.0, 1.0))))) == [[-179.9, 0.0, -160.0, 1.0]]  # the larger side stays


def test_distances_and_scores(ev):
    assert ev(geo.distscore(L(50.0), L(10.0)), geo.distscore(L(500.0), L(10000.0))) == [200.0, 20000.0]
    assert ev(geo.scoredist(L(0.0), 0.0, 1.0, L(0.0), 6))[0] == pytest.approx(10.0)
    assert ev(geo.half_up(L(-2.5))) == [-2]


def test_lines(ev):
    assert tuple(ev(geo.interpolate(L(2), L(0), L(8), line((0, 0), (1, 0))))[0]) == (0.25, 0.0)
    assert tuple(ev(geo.interpolate(L(2), L(8), L(0), line((0, 0), (1, 0))))[0]) == (0.75, 0.0)
    square = line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    assert ev(geo.in_ring(L(0.5), L(0.5), square), geo.in_ring(L(1.5), L(0.5), square)) == [True, False]


def test_masks(ev):
    assert ev(bits.contiguous_masks(L(4)))[0] == [15, 7, 14, 3, 6, 12, 1, 2, 4, 8]
    assert [tuple(x) for x in ev(*[bits.mask_bounds(L(m).cast("bigint")) for m in (0, 6, 11, 1)])] == [(-1, -1), (1, 2), (0, 1), (0, 0)]
    assert ev(*[bits.encode_log_scale(L(n), L(10)) for n in range(1, 11)]) == [1, 3, 4, 5, 5, 6, 6, 7, 7, 7]
    assert ev(bits.encode_log_scale(L(3566), L(180000)), bits.decode_log_scale(L(5), L(180000))) == [5, 5672]
    assert ev(bits.covers_windows(L(6).cast("bigint"), F.array(L(6).cast("bigint"), L(8).cast("bigint"))), bits.covers_windows(L(2).cast("bigint"), F.array(L(6).cast("bigint")))) == [True, False]


def test_rebalance(ev):
    masks = lambda *m: F.array(*[L(x).cast("bigint") for x in m])
    b = ev(bits.rebalance(F.array(L(0.5), L(1 / 6), L(1 / 6), L(1 / 6)), masks(7, 8, 16, 32), L(6)))[0]
    assert b.relevs == [0.36111111, 0.21296296, 0.21296296, 0.21296296] and b.relev == 0.99999999
    assert ev(bits.rebalance(F.array(L(0.75)), masks(7), L(4)))[0].relev == 0.61111111


def test_address_points(ev):
    p = lambda n, s="standard": F.struct(L(n).alias("num"), L(1.0).alias("lon"), L(2.0).alias("lat"), L(s).alias("style"))
    points = F.array(p("9"), p("9b"), p("90"), p("7-1"))
    assert [r.num for r in ev(address.matching_points(points, L("9")))[0]] == ["9"]
    assert [r.num for r in ev(address.matching_points(points, L("9c")))[0]] == ["9"]
    assert [r.num for r in ev(address.prefix_points(points, L("9")))[0]] == ["9", "9b", "90"]
    assert ev(address.match_rank(L("22-22"), L("22-22"), "queens"), address.match_rank(L("2222"), L("22-22"), "queens")) == [0, None]


def test_address_ranges(ev):
    r = lambda lf, lt, lp, rf, rt, rp: F.array(F.struct(L(0).alias("i"), *[L(v).cast("int").alias(k) for k, v in (("lf", lf), ("lt", lt), ("rf", rf), ("rt", rt))], L(lp).alias("lp"), L(rp).alias("rp"), line((0, 0), (0, 1)).alias("line")))
    both = r(0, 100, "E", 1, 101, "O")
    assert tuple(ev(address.on_range(both, L(50)))[0]) == (0.0, 0.5, False)
    assert ev(address.on_range(r(0, 100, "O", None, None, ""), L(50)))[0].omitted is True
    assert ev(address.on_range(both, L(400)))[0].omitted is True
    assert ev(address.on_range(both, L(900))) == [None]
    found = ev(address.reverse_range(both, L(-0.1), L(0.5)))[0]
    assert found.number == 50 and found.lat == pytest.approx(0.5)
    assert ev(address.reverse_range(both, L(0.1), L(0.5)))[0].number == 51


def test_labels(ev):
    m = F.create_map(L("universal"), L("u"), L("zh_Hant"), L("t"), L("de_AT"), L("a"))
    assert ev(*[lang.closest_label(m, c)["text"] for c in ("zh", "de", "fr")]) == ["t", "a", "u"]
    assert "de" not in lang.fallback_ranking("de", ["de", "de_AT"])
    assert ev(lang.has_language(F.create_map(L("hr"), L("x")), "sr")) == [True]


def test_rewriting():
    rules = rewrite.compile_rules({"Street": "St", "North West": "NW", "(\\d+)th": "$1"}, inverse=True)
    assert rewrite.replace_all(rewrite.compile_rules({"street": "st"}), ["main", "street"]) == (["main", "st"], [0, 1])
    assert rewrite.replace_all(rewrite.compile_rules({"north west": "nw"}), ["north", "west", "rd"]) == (["nw", "rd"], [0, 2])
    assert rewrite.replace_all([rewrite.Rule("(\\d+)th", "$1")], ["5th", "ave"]) == (["5", "ave"], [0, 1])
    made = rewrite.variants(rules, ["north", "west", "street"])
    assert ["north", "west", "street"] in made and ["nw", "st"] in made and len(made) <= 8
    assert rewrite.categorize({"Street": "st", "a b": "c"}) == ({"street": "st"}, {"a b": "c"})


def test_rewriting_as_column(spark):
    df = spark.createDataFrame([(["main", "street"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(rewrite.replaced("t", rewrite.compile_rules({"street": "st"}))).collect()] == [["main", "st"], None]

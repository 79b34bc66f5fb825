"""Covers, hashes, span filters and the command line."""

import json

from pyspark.sql import functions as F

from waymark.__main__ import main
from waymark.functions import shapes
from waymark.operators import match


def test_covers():
    assert shapes.cover([(0.0, 0.0)], 6, False) == [(6, 32, 32)]
    square = [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)]
    whole = shapes.cover(square, 6, True)
    assert {(x, y) for _, x, y in whole} == {(x, y) for x in range(30, 34) for y in range(30, 34)}
    assert len(shapes.cover(square, 6, False)) < len(whole)
    assert len(shapes.cover([(-20.0, 1.0), (20.0, 1.0)], 4, False)) == 2
    inner = shapes.cover([(-40.0, -40.0), (40.0, -40.0), (40.0, 40.0), (-40.0, 40.0)], 5, True)
    assert (5, 16, 16) in inner


def test_surface_point():
    bent = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    x, y = shapes.surface_point(bent)
    assert shapes._inside(x, y, bent) and shapes.surface_point([]) is None


def test_phrase_bytes(spark):
    assert [shapes.phrase_byte(t) for t in ("Main Street", "a", "main st", "Äpfelstrüdeln Strasse")] == [248, 60, 112, 73]
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(shapes.phrase_hash("t")).collect()] == [60, None]


def test_tile_cover_column(spark):
    df = spark.createDataFrame([([(0.0, 0.0)],), (None,), ([],)], "p array<struct<lon:double,lat:double>>")
    got = [r[0] for r in df.select(shapes.tile_cover("p", 6)).collect()]
    assert [tuple(t) for t in got[0]] == [(6, 32, 32)] and got[1] is None and got[2] == []


def test_span_filters(spark):
    df = spark.createDataFrame([([0, 0, 1], 1), ([0, 0, 1], 3), ([0, 0, 1], 4), ([0, 0, 1], 6)], "owner array<int>, mask bigint")
    assert [r[0] for r in df.select(match.owned("owner", F.col("mask"))).collect()] == [False, True, True, False]
    rows = spark.createDataFrame([(1, "s", "a"), (1, "s", "ab"), (2, "s", "a")], "query_id bigint, source string, phrase string")
    assert sorted(tuple(r) for r in match.without_single_letters(rows).collect()) == [(1, "s", "ab"), (2, "s", "a")]
    assert [r.phrase for r in spark.createDataFrame([("12#",), ("12 main",)], "phrase string").where(match.not_only_number("phrase")).collect()] == ["12 main"]


def test_command_line(spark, tmp_path, capsys):
    doc = {"id": 1, "type": "Feature", "properties": {"text": "springfield"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "place.ndjson").write_text(json.dumps(doc))
    main(["index", "--source", f"place={tmp_path}/place.ndjson:6", "--out", str(tmp_path / "ix")], spark)
    main(["query", "--index", str(tmp_path / "ix"), "springfield"], spark)
    main(["analyze", "--index", str(tmp_path / "ix")], spark)
    out = capsys.readouterr().out
    assert "place.1" in out and "total" in out
